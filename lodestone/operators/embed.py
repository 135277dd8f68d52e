"""Embeddings: strategies by name, the backfill of nodes without one, and its coverage.

A strategy is a function of a batch of texts; it runs in an Arrow UDF. The one that is built in hashes words into a
fixed number of dimensions, which needs no model and gives equal vectors everywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import Flags
from lodestone.functions import texts

# fixed values: dimensions of known models
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "mxbai-embed-large": 1024, "nomic-embed-text": 768, "all-MiniLM-L6-v2": 384}


def hash_strategy(dimension: int) -> Callable[[list[str]], list]:
    """Signed hashing of lower-case words into dimension numbers, scaled to length one."""

    def embed(batch: list[str]) -> list:
        out = []
        for text in batch:
            v = np.zeros(dimension, np.float32)
            for word in re.findall(r"\w+", text.lower()):
                h = int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)
                v[h % dimension] += 1.0 if h >> 31 else -1.0
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return out

    return embed


STRATEGIES: dict[str, Callable[[int], Callable[[list[str]], list]]] = {"hash": hash_strategy}


def register(name: str, make: Callable[[int], Callable[[list[str]], list]]) -> None:
    STRATEGIES[name] = make


def embedder(name: str = "hash", dimension: int = 64) -> Callable[[Column], Column]:
    """A Column function; blank texts have a null embedding. The strategy is made once for each task."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name}; there are {sorted(STRATEGIES)}")
    make = STRATEGIES[name]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        strategy = make(dimension)
        for batch in batches:
            some = batch.notna() & (batch.fillna("").str.strip() != "")
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            vectors = strategy(batch[some].tolist())
            if any(len(v) != dimension for v in vectors):
                raise ValueError(f"strategy {name} did not give {dimension} numbers")
            for i, v in zip(batch.index[some], vectors, strict=True):
                out[i] = v
            yield out

    return run


def embed_text(text: str, name: str = "hash", dimension: int = 64, flags: Flags | None = None) -> list[float]:
    (flags or Flags()).require("embeddings")
    if not text.strip():
        raise ValueError("there is no text to embed")
    return STRATEGIES[name](dimension)([text])[0]


def backfill(nodes: DataFrame, name: str = "hash", dimension: int = 64, flags: Flags | None = None) -> DataFrame:
    """nodes, with embeddings for those that have none and whose text by label is not blank."""
    (flags or Flags()).require("batch_embeddings")
    text = F.when(F.col("embedding").isNull(), texts.embedding_text(F.col("label")))
    return nodes.withColumn("embedding", F.coalesce("embedding", embedder(name, dimension)(text)))


def coverage(nodes: DataFrame) -> DataFrame:
    """(label, total, embedded, percent) in one pass."""
    out = nodes.groupBy("label").agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"))
    return out.withColumn("percent", F.round(100.0 * F.col("embedded") / F.col("total"), 1))
