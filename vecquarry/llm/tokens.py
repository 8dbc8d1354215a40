"""Token ids of whole texts by a public byte-level BPE tokenizer, through a table of distinct words."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecquarry.session import materialize

#: Where the files of the public tokenizers are.
FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern that splits text into words before the merges of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a chunk of documents, unless one text is longer.
CHUNK = 1 << 20
OTHER, LETTER, NUMBER, SPACE = range(4)


def _ranks(name: str, folder: str) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(1)
def kinds() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point, by the Unicode tables that the tokenizers use."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = (x if x <= 0xD800 else x + 0x800 for x in (m.start(), m.end()))
            table[a:b] = kind
    return table


def word_starts(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """True where a word of PATTERN starts, in the code points of one text after another; begins: where texts begin.

    Words are runs of one kind. The last blank before a run belongs to it if it is an ordinary one, else it stands alone;
    those before it are a word. An apostrophe that starts a word takes the letters of a contraction with it.
    """
    n = len(codes)
    kind = kinds()[codes]
    first = np.zeros(n + 1, bool)  # of a text, and behind the last
    first[begins[begins < n]] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    last = ends[(kind[runs] == SPACE) & ~first[ends]] - 1
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    at = np.flatnonzero((codes[: max(0, n - 1)] == 39) & start[:-1] & (kind[1:] == LETTER) & ~first[1:n]) if n else np.empty(0, np.int64)
    one = codes[at + 1]
    after = np.minimum(at + 2, n - 1)
    two = np.where(first[at + 2], 0, codes[after])
    length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
    for a, b in ("re", "ve", "ll"):
        length = np.where((one == ord(a)) & (two == ord(b)), 3, length)
    at, length = at[length > 0], length[length > 0]
    start[at + 1] = False
    rest = (at + length)[~first[at + length]]
    start[rest[kind[rest] == LETTER]] = True
    return start


@functools.lru_cache(1)
def _powers() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distinct_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, codes, ends): the distinct words of the texts, the number of each word of the texts in order, and how many
    words there are up to the end of each text. Words are told apart by a hash of 64 bits; that equal hashes are equal
    words is then checked."""
    joined = "".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.flatnonzero(word_starts(codes, np.concatenate([[0], ends[:-1]]).astype(np.int64)))
    if not len(starts):
        return [], np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    stops = np.append(starts[1:], len(codes))
    lengths = stops - starts
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    spread = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    hashes = np.add.reduceat(spread * _powers()[np.minimum(place, 63)], starts) ^ lengths.astype(np.uint64)
    for i in np.flatnonzero(lengths > 64):
        hashes[i] = hash(joined[starts[i] : stops[i]]) & 0xFFFFFFFFFFFFFFFF
    _, some, number = np.unique(hashes, return_index=True, return_inverse=True)
    shift = np.repeat(starts[some][number] - starts, lengths)
    if (lengths[some][number] == lengths).all() and (codes[np.arange(len(codes)) + shift] == codes).all():
        words = [joined[a:b] for a, b in zip(starts[some].tolist(), stops[some].tolist())]
    else:
        known: dict[str, int] = {}
        number = np.array([known.setdefault(joined[a:b], len(known)) for a, b in zip(starts.tolist(), stops.tolist())])
        words = list(known)
    return words, number.astype(np.int32), np.searchsorted(starts, ends)


def _split(docs: DataFrame, kept: list[str], chunk: int) -> tuple[DataFrame, DataFrame]:
    """(chunk, kept..., codes) of every row of docs, and (chunk, code, word) of the distinct words of each chunk: the
    code of a word is its number in its chunk. Written once, as both are used."""
    used = docs.select(*kept, F.coalesce("text", F.lit("")).alias("__text"))
    doc = T.StructType([*[used.schema[c] for c in kept], T.StructField("codes", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("doc", doc), T.StructField("code", T.IntegerType()), T.StructField("word", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            sizes = np.cumsum(np.asarray(pa.compute.utf8_length(b.column("__text"))).astype(np.int64))
            cut = np.flatnonzero(np.diff(sizes // chunk, prepend=0)) if b.num_rows else []
            edges = np.unique(np.concatenate([[0], cut, [b.num_rows]])).astype(int)
            for a, e in zip(edges[:-1], edges[1:]):
                part = b.slice(a, e - a)
                words, codes, ends = distinct_words(part.column("__text").to_pylist())
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                fields = [part.column(c) for c in kept] + [pa.ListArray.from_arrays(offsets, pa.array(codes))]
                rows = pa.StructArray.from_arrays(fields, [*kept, "codes"])
                n, m = len(rows), len(words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), rows, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=schema.names)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), pa.nulls(m, rows.type), pa.array(np.arange(m, dtype=np.int32)), pa.array(words, pa.string())], names=schema.names)
                number += 1

    both = materialize(used.mapInArrow(run, schema))
    return both.filter(F.col("doc").isNotNull()).select("chunk", "doc.*"), both.filter(F.col("word").isNotNull()).select("chunk", "code", "word")


def encode_words(words: DataFrame, name: str, folder: str) -> DataFrame:
    """(word, ids) of a DataFrame of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=_ranks(name, folder), special_tokens={})
        for b in batches:
            ids = [bpe.encode_ordinary(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def _joined_by_position(kept: list[str], counts_only: bool):
    """Per chunk: the ids (or their number) of the word at each position of each document, one after the other."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        docs, words = docs.combine_chunks(), words.combine_chunks()
        lists = docs["codes"].combine_chunks() if docs.num_rows else pa.array([], pa.list_(pa.int32()))
        codes, bounds = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)
        by = np.argsort(np.asarray(words["code"]))
        if counts_only:
            total = np.concatenate([[0], np.cumsum(np.asarray(words["n"])[by][codes] if len(codes) else [])]).astype(np.int64)
            last = pa.array(total[bounds[1:]] - total[bounds[:-1]])
        else:
            ids = words["ids"].combine_chunks().take(pa.array(by)) if words.num_rows else pa.array([], pa.list_(pa.int32()))
            sizes = np.asarray(ids.value_lengths()).astype(np.int64)
            starts, flat = np.cumsum(sizes) - sizes, np.asarray(ids.flatten())
            own = sizes[codes] if len(codes) else np.empty(0, np.int64)
            total = np.concatenate([[0], np.cumsum(own)]).astype(np.int64)
            at = np.repeat(starts[codes] - total[:-1], own) + np.arange(total[-1]) if len(codes) else np.empty(0, np.int64)
            last = pa.ListArray.from_arrays(pa.array(total[bounds].astype(np.int32)), pa.array(flat[at].astype(np.int32)))
        return pa.table([*[docs[c] for c in kept], last], names=[*kept, "tokens" if counts_only else "ids"])

    return run


def _encoded(docs: DataFrame, kept: list[str], name: str, folder: str, chunk: int, counts_only: bool) -> DataFrame:
    split, used = _split(docs, kept, chunk)
    table = encode_words(used.select("word").distinct(), name, folder)
    table = table.select("word", F.size("ids").alias("n") if counts_only else "ids")
    back = used.join(table, "word").select(F.col("chunk").alias("words_chunk"), "code", "n" if counts_only else "ids")
    last = T.StructField("tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*[split.schema[c] for c in kept], last])

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        return _joined_by_position(kept, counts_only)(docs, words)

    return split.groupBy("chunk").cogroup(back.groupBy("words_chunk")).applyInArrow(run, schema)


def encode(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids): the token ids of every docs.text by the named vocabulary, without special tokens; a special
    token's string in a text is ordinary text.

    Method: texts are split into words in Spark, each distinct word of the corpus is encoded once, and the ids go back to
    the positions of the words. To move little, the texts of a chunk of about `chunk` characters hold the numbers of
    their words in the chunk, whose distinct words are joined to the word table; the ids then meet the documents of the
    chunk, where each position takes those of its word. A frequent word is one row per chunk.

    Null, empty: an empty list. Whole texts of any length are encoded. Rows repeated with the same doc_id give a row
    each. Other columns are ignored. An empty docs gives no rows.
    """
    return _encoded(docs, ["doc_id"], name, folder, chunk, False)


def decode(encoded: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), doc_id being unique: ids are joined to the table of pieces and put together by
    position. An empty list gives an empty text; a null list null; an id outside the vocabulary is an error."""
    ranks = _ranks(name, folder)
    pieces = encoded.sparkSession.createDataFrame(pd.DataFrame({"id": list(ranks.values()), "piece": [k.hex() for k in ranks]}), "id int, piece string")
    at = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id"))
    joined = at.join(F.broadcast(pieces), "id", "left")  # the vocabulary, a fixed 50,256 rows
    piece = F.when(F.col("piece").isNotNull(), F.col("piece")).otherwise(F.raise_error(F.lit("an id is not in the vocabulary")))
    hexes = joined.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda x: x["piece"]).alias("p"))
    text = F.decode(F.unhex(F.array_join("p", "")), "UTF-8")
    whole = encoded.select("doc_id", F.col("ids").isNull().alias("none")).join(hexes, "doc_id", "left")
    return whole.select("doc_id", F.when(~F.col("none"), F.coalesce(text, F.lit(""))).alias("text"))


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER, keep: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, keep..., tokens) of every document, without building the ids; 0 for null and empty texts."""
    return _encoded(docs, ["doc_id", *(keep or [])], name, folder, chunk, True)
