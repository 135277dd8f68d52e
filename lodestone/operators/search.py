"""Vector, hybrid and similarity search over nodes with an embedding.

A query vector is a literal in the plan; nodes are scored in one scan, of the columns that the caller uses alone, and
the best taken by TakeOrderedAndProject, or by a window whose limit holds before the shuffle too: each task passes on its
own best rows, and no other text is shuffled. Nothing runs before the caller asks for rows. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import Flags, Settings
from lodestone.functions import vectors

#: Digits of a score that count: the last ones depend on the order of summation.
DIGITS = 6


def scored(nodes: DataFrame, query: list[float], similarity: str = "cosine") -> DataFrame:
    """nodes with cosine and vector_score (0 to 1); those without a usable embedding are left out.

    euclidean scores 1 / (1 + squared distance).
    """
    v = vectors.literal(query)
    some = nodes.where(F.size("embedding") == len(query)) if query else nodes.limit(0)
    out = some.withColumn("cosine", F.round(vectors.cosine(F.col("embedding"), v), DIGITS))
    if similarity == "euclidean":
        d = vectors.euclidean(F.col("embedding"), v)
        return out.withColumn("vector_score", F.round(1 / (1 + d * d), DIGITS)).where("vector_score is not null")
    return out.withColumn("vector_score", vectors.score(F.col("cosine"))).where("cosine is not null")


def vector_search(nodes: DataFrame, query: list[float], limit: int = 5, settings: Settings = Settings(), flags: Flags | None = None) -> DataFrame:
    (flags or Flags()).require("vector_search")
    best = scored(nodes, query, settings.similarity).withColumn("score", F.col("vector_score"))
    return best.orderBy(F.desc("vector_score"), "id").limit(min(limit, settings.max_limit))


def text_score(label: str, text: str) -> Column:
    """How well a node matches a text as a whole: 1 for its name (or content), less for what else names it."""
    q = text.lower()

    def has(c: str) -> Column:
        return F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q)

    if label == "Commit":
        files = F.exists(F.coalesce("files_changed", F.array().cast("array<string>")), lambda f: F.lower(f).contains(q))
        return F.when(has("content"), 1.0).when(has("author_name"), 0.9).when(files, 0.8).otherwise(0.0)
    return F.when(has("name"), 1.0).when(has("signature"), 0.8).otherwise(0.0)


def hybrid_search(nodes: DataFrame, query: list[float], text: str, label: str = "Function", limit: int = 5, weight: float | None = None, settings: Settings = Settings(), flags: Flags | None = None) -> DataFrame:
    """The best of the 2 * limit nearest nodes by weight * vector + (1 - weight) * text score.

    A node that only the text finds, beyond those, is not returned.
    """
    (flags or Flags()).require("hybrid_search")
    weight = settings.vector_weight if weight is None else weight
    if not 0 <= weight <= 1:
        raise ValueError("weight must be from 0 to 1")
    pool = scored(nodes, query, settings.similarity).orderBy(F.desc("vector_score"), "id").limit(2 * min(limit, settings.max_limit))
    both = pool.withColumn("keyword_score", text_score(label, text))
    both = both.withColumn("score", F.round(weight * F.col("vector_score") + (1 - weight) * F.col("keyword_score"), DIGITS + 3))
    return both.orderBy(F.desc("score"), "id").limit(min(limit, settings.max_limit))


def search(nodes: DataFrame, query: list[float], text: str, kind: str = "hybrid", label: str = "Function", limit: int = 5, **more) -> DataFrame:
    if kind == "vector":
        return vector_search(nodes, query, limit, **more)
    if kind == "hybrid":
        return hybrid_search(nodes, query, text, label, limit, **more)
    raise ValueError(f"unknown kind of search: {kind}")


#: Ids that one call may ask for; their vectors are sent to all tasks.
MOST_ASKED = 1000


def more_like_this(nodes: DataFrame, ids: list, limit: int = 5) -> DataFrame:
    """(query, id, vector_score, rank): for each of ids the nearest other nodes; none if it has no embedding."""
    if len(ids) > MOST_ASKED:
        raise ValueError(f"at most {MOST_ASKED} ids at once")
    asked = nodes.where(F.col("id").isin(*ids) & F.col("embedding").isNotNull()).select(F.col("id").alias("query"), F.col("embedding").alias("asked"))
    pairs = nodes.where("embedding is not null").join(F.broadcast(asked), F.col("id") != F.col("query"))
    found = pairs.withColumn("vector_score", vectors.score(F.round(vectors.cosine(F.col("embedding"), F.col("asked")), DIGITS))).where("vector_score is not null")
    return top_by(found, ["query"], limit).select("query", "id", "vector_score", "rank")


def nearest_by_label(nodes: DataFrame, query: list[float], limit: int, similarity: str = "cosine") -> DataFrame:
    """The nearest nodes of each label, with cosine, vector_score and rank."""
    return top_by(scored(nodes, query, similarity), ["label"], limit)


def top_by(found: DataFrame, by: list[str], limit: int, score: str = "vector_score") -> DataFrame:
    """The best of each group, with rank."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)
