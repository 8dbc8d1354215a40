"""Readers and writers of vector, text and image files."""

from __future__ import annotations

import io
import struct
import tarfile
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows that one task reads of a binary vector file.
ROWS = 65_536


def _place(path: str) -> tuple[FileSystem, str]:
    """The file system of a path, which all machines must reach, and the path in it. Paths without a scheme are local."""
    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path.removeprefix("file:"))


class _Range(InputPartition):
    def __init__(self, path: str, first: int, rows: int, dimension: int, at: int):
        super().__init__((path, first, rows, dimension, at))


class _VectorReader(DataSourceReader):
    """Ranges of rows of float32 matrices, one task a range; ids are row numbers, counted from `offset`."""

    def __init__(self, options: dict, header):
        self.path, self.header = options["path"], header
        self.offset, self.limit = int(options.get("offset", 0)), int(options.get("limit", -1))

    def partitions(self) -> list[InputPartition]:
        n, d, at = self.header(self.path)
        stop = n if self.limit < 0 else min(n, self.offset + self.limit)
        return [_Range(self.path, a, min(ROWS, stop - a), d, at) for a in range(self.offset, stop, ROWS)] or [_Range(self.path, 0, 0, d, at)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        path, first, rows, d, at = part.value
        system, own = _place(path)
        with system.open_input_file(own) as f:
            f.seek(at + 4 * d * first)
            raw = f.read(4 * rows * d)
        x = np.frombuffer(raw[: len(raw) // 4 * 4], np.float32)
        if len(x) < rows * d:
            raise ValueError(f"{path} ends early")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * d + 1, max(d, 1), dtype=np.int32)[: rows + 1]), pa.array(x))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + rows)), lists], names=["vec_id", "embedding"])


def _fbin_header(path: str) -> tuple[int, int, int]:
    system, own = _place(path)
    with system.open_input_file(own) as f:
        n, d = struct.unpack("<ii", f.read(8))
    return n, d, 8


def _npy_header(path: str) -> tuple[int, int, int]:
    system, own = _place(path)
    with system.open_input_file(own) as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if fortran or kind != np.float32 or len(shape) != 2:
            raise ValueError(f"{path} is no row-major float32 matrix")
        return shape[0], shape[1], f.tell()


class FbinSource(DataSource):
    """Files of two int32, rows and dimension, and float32 rows. Options: path, offset, limit. Written files, one a task, have the same form."""

    @classmethod
    def name(cls) -> str:
        return "fbin"

    def schema(self) -> str:
        return "vec_id bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _VectorReader(self.options, _fbin_header)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _VectorWriter(self.options, "fbin", lambda n, d: struct.pack("<ii", n, d))


class NpySource(FbinSource):
    """Row-major float32 matrices as numpy saves them."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def reader(self, schema) -> DataSourceReader:
        return _VectorReader(self.options, _npy_header)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _VectorWriter(self.options, "npy", _npy_head)


def _npy_head(n: int, d: int) -> bytes:
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": (n, d)})
    return head.getvalue()


class _VectorWriter(DataSourceWriter):
    """A file a task: a head that says how many rows of how many numbers follow, and the rows."""

    def __init__(self, options: dict, suffix: str, head: Callable[[int, int], bytes]):
        self.path, self.suffix, self.head = options["path"], suffix, head

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        context = TaskContext.get()
        part = f"{folder}/part-{context.partitionId():05d}.{self.suffix}"
        hidden, n, d = f"{part}.{context.taskAttemptId()}.tmp", 0, 0
        with tempfile.TemporaryFile() as spool:  # the head says how many rows follow, which is known at the end
            for r in rows:
                x = np.asarray(r["embedding"], np.float32)
                n, d = n + 1, len(x)
                spool.write(x.tobytes())
            spool.seek(0)
            with system.open_output_stream(hidden) as f:
                f.write(self.head(n, d))
                while chunk := spool.read(1 << 20):
                    f.write(chunk)
        if system.get_file_info(part).type != FileType.NotFound:  # a task that runs again replaces its own file
            system.delete_file(part)
        system.move(hidden, part)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FbinSource)
    spark.dataSource.register(NpySource)


def read_fbin(spark: SparkSession, path: str, offset: int = 0, limit: int = -1) -> DataFrame:
    register(spark)
    return spark.read.format("fbin").option("offset", offset).option("limit", limit).load(path)


def write_fbin(df: DataFrame, path: str, kind: str = "fbin") -> None:
    register(df.sparkSession)
    df.select("vec_id", "embedding").write.format(kind).mode("append").save(path)


def write_npy(df: DataFrame, path: str) -> None:
    write_fbin(df, path, "npy")


def read_npy(spark: SparkSession, path: str, first: int = 0, drop_last: int = 0) -> DataFrame:
    """Rows from `first` on, without the last ones."""
    register(spark)
    n = _npy_header(path)[0]
    return spark.read.format("npy").option("offset", first).option("limit", max(0, n - first - drop_last)).load(path)


def read_glove(spark: SparkSession, path: str) -> DataFrame:
    """(token, embedding) of lines of a token and numbers."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(parts[0].alias("token"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("float")).alias("embedding"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of JSON lines with _id, title and text: title and text joined and trimmed."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.select(F.col("_id").alias("id"), F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))).alias("text"))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, caption): the first caption of each image in a JSON document with annotations."""
    doc = spark.read.schema("annotations array<struct<image_id: bigint, caption: string>>").json(path, multiLine=True)
    at = doc.select(F.posexplode("annotations").alias("pos", "a")).select("pos", "a.image_id", "a.caption")
    return at.groupBy("image_id").agg(F.min_by("caption", "pos").alias("caption"))


def read_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.concat_ws(" ", *columns).alias("text"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all jpg, jpeg and png files below a folder, whatever the case of their endings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}").load(folder)
    return files.select("path", "content")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, name, content) of the files in tar, tar.gz, tgz and zip archives below a folder, an archive a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                if path.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for i in z.infolist():
                            if not i.is_dir():
                                yield pd.DataFrame({"archive": [path], "name": [i.filename], "content": [z.read(i)]})
                else:
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        for m in t:
                            if m.isfile():
                                yield pd.DataFrame({"archive": [path], "name": [m.name], "content": [t.extractfile(m).read()]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tar,tar.gz,tgz,zip}").load(folder)
    return files.select("path", "content").repartition("path").mapInPandas(run, "archive string, name string, content binary")
