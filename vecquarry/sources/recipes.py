"""The suite's datasets by name, and how each is built from its sources.

Nothing is downloaded: the caller gives a table for each source and an encoder for each model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecquarry.operators import derive
from vecquarry.session import materialize
from vecquarry.sources.datasets import encoded, read_dataset, write_dataset

Encoder = Callable[[], Callable[[list], np.ndarray]]
#: Rows that are held out as queries, or drawn from a table of queries.
TEST = 1000

#: The names of the suite's datasets with their kind and sources. texts, images: a source and held-out rows
#: of it; asked: a source and queries from another one; cross: corpus, queries and learn rows of other kinds; vectors:
#: ready corpus and query vectors; words: word vectors; uint8, binary: another dataset quantized; tokens: many vectors a row.
TABLE = """
agnews-mxbai-1024-euclidean               texts    agnews
agnews-mxbai-1024-euclidean-uint8         uint8    agnews-mxbai-1024-euclidean
agnews-mxbai-1024-hamming-binary          binary   agnews-mxbai-1024-euclidean
agnews-pplx-1024-cosine-int8              texts    agnews
arxiv-nomic-768-normalized                texts    arxiv
ccnews-nomic-768-euclidean-uint8          uint8    ccnews-nomic-768-normalized
ccnews-nomic-768-hamming-binary           binary   ccnews-nomic-768-normalized
ccnews-nomic-768-normalized               texts    ccnews
celeba-resnet-2048-cosine                 images   celeba
coco-nomic-768-normalized                 cross    coco-images coco-captions-val coco-captions-train
codesearchnet-jina-768-cosine             asked    codesearchnet codesearchnet-queries
cqadupstack-lemur-2048-ip                 tokens   cqadupstack-colbert-128-chamfer
cqadupstack-muvera-5120-ip                tokens   cqadupstack-colbert-128-chamfer
dpr-jina-768-euclidean-uint8              uint8    dpr-jina-768-normalized
dpr-jina-768-hamming-binary               binary   dpr-jina-768-normalized
dpr-jina-768-normalized                   texts    dpr
glove-200-cosine                          words    glove
gooaq-distilroberta-768-normalized        texts    gooaq
hotpotqa-harrier-640-normalized           asked    hotpotqa hotpotqa-queries
imagenet-align-640-normalized             cross    imagenet-images imagenet-captions
imagenet-clip-512-normalized              cross    imagenet-images imagenet-images-val
inaturalist-resnet-2048-cosine            images   inaturalist
laion-clip-512-normalized                 vectors  laion-images laion-texts
landmark-dino-768-cosine                  images   landmark
landmark-nomic-768-euclidean-uint8        uint8    landmark-nomic-768-normalized
landmark-nomic-768-hamming-binary         binary   landmark-nomic-768-normalized
landmark-nomic-768-normalized             images   landmark
llama-128-ip                              vectors  llama-keys llama-queries
msmarco-qwen-1024-normalized              texts    msmarco
simplewiki-openai-3072-euclidean-uint8    uint8    simplewiki-openai-3072-normalized
simplewiki-openai-3072-hamming-binary     binary   simplewiki-openai-3072-normalized
simplewiki-openai-3072-normalized         texts    simplewiki
yahoo-minilm-384-normalized               texts    yahoo
yandex-200-cosine                         vectors  yandex yandex-queries yandex-learn
yi-128-ip                                 vectors  yi-keys yi-queries
"""


@dataclass(frozen=True)
class Recipe:
    kind: str
    sources: tuple[str, ...]


RECIPES: dict[str, Recipe] = {name: Recipe(kind, tuple(sources)) for name, kind, *sources in map(str.split, TABLE.strip().splitlines())}


def shape(name: str) -> tuple[int, str, str]:
    """(dimension, distance, point type) that a name says."""
    parts = name.split("-")
    at = next((i for i, p in enumerate(parts) if p.isdigit()), None)
    if at is None:
        raise ValueError(f"{name} says no dimension")
    rest = parts[at + 1 :]
    return int(parts[at]), rest[0] if rest else "normalized", rest[1] if len(rest) > 1 else "float"


def recipes(spark: SparkSession) -> DataFrame:
    """(dataset, kind, sources, dimension, distance, point_type) of all names."""
    rows = [(n, r.kind, list(r.sources), *shape(n)) for n, r in RECIPES.items()]
    return spark.createDataFrame(rows, "dataset string, kind string, sources array<string>, dimension int, distance string, point_type string")


def _vectors(table: DataFrame, encoder: Encoder | None) -> DataFrame:
    """(vec_id, embedding) of a source: ready, or encoded from its text or content."""
    if "embedding" in table.columns:
        return table.select("vec_id", "embedding")
    column = "text" if "text" in table.columns else "content"
    if encoder is None:
        raise ValueError("a source of texts or images needs an encoder")
    return encoded(table.select("vec_id", F.col(column).alias("text")), encoder, key="vec_id")


def parts_of(name: str, source: Callable[[str], DataFrame], encoders: dict[str, Encoder], test: int = TEST, seed: int = 42) -> dict[str, DataFrame]:
    """train, test and, where there is one, learn (vec_id, embedding) of a dataset that is not derived from another.

    source: name -> (vec_id, text | content | embedding). encoders: by the name of a source, or "" for all others.
    Repeated texts count once; held-out rows and draws are those of derive.split and derive.draw."""
    recipe = RECIPES[name]
    of = lambda s, t=None: materialize(_vectors(source(s) if t is None else t, encoders.get(s, encoders.get(""))))
    held = lambda df: {p: rows.select("vec_id", "embedding") for p in ("train", "test") for rows in [df.filter(F.col("part") == p)]}
    first, *more = recipe.sources
    if recipe.kind == "texts":
        texts = derive.distinct_texts(source(first).select("vec_id", "text"), key="vec_id")
        placed = derive.split(texts.select("vec_id", "text"), test, seed=seed)
        vectors = of(first, placed.select("vec_id", "text"))
        return held(vectors.join(placed.select("vec_id", "part"), "vec_id"))
    if recipe.kind in ("images", "words"):
        return held(derive.split(of(first), test, seed=seed))
    if recipe.kind == "tokens":
        encoder = source(first)  # (vec_id, tok_id, embedding, part)
        sketch = lambda part, total: derive.multi_vector_sketch(encoder.filter(F.col("part") == part).withColumnRenamed("vec_id", "doc_id"), sum_of=total).withColumnRenamed("doc_id", "vec_id")
        return {"train": sketch("train", False), "test": sketch("test", True)}
    if recipe.kind in ("asked", "vectors", "cross"):
        queries = of(more[0])
        if len(more) > 1:
            return {"train": of(first), "test": derive.draw(queries, test, seed=seed), "learn": of(more[1])}
        placed = derive.split(queries, test, seed=seed)
        return {"train": of(first), "test": placed.filter("part = 'test'").select("vec_id", "embedding"), "learn": placed.filter("part = 'train'").select("vec_id", "embedding")}
    raise ValueError(f"{name} is derived from {first}")


def build(spark: SparkSession, folder: str, name: str, source: Callable[[str], DataFrame] | None = None, encoders: dict[str, Encoder] | None = None, count: int = 100, test: int = TEST) -> str:
    """Build the named dataset in folder/name, with its ground truth, and return its path. uint8 and binary ones are
    quantized from their original, which must be there already."""
    if name not in RECIPES:
        raise ValueError(f"no dataset {name}")
    _, distance, kind = shape(name)
    path, recipe = f"{folder}/{name}", RECIPES[name]
    if recipe.kind in ("uint8", "binary"):
        try:
            train, asked, _ = read_dataset(spark, f"{folder}/{recipe.sources[0]}")
        except Exception as e:
            raise ValueError(f"{recipe.sources[0]}, from which {name} is made, is not there") from e
        write_dataset(spark, path, name, train, asked, distance, kind, count)
        return path
    if source is None:
        raise ValueError(f"{name} needs its sources {', '.join(recipe.sources)}")
    parts = parts_of(name, source, encoders or {}, test)
    write_dataset(spark, path, name, parts["train"], parts["test"], distance, kind, count, parts.get("learn"))
    return path
