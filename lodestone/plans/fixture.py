"""A property graph made of the star schema: the tables stand for repositories, files, functions and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, label, name): nations as Repo, customers as File, orders as Function, parts as Package, suppliers as
    Person, events as Commit, regions as Project."""
    parts = [
        table(spark, folder, name).select(_id(prefix, key).alias("id"), F.lit(label).alias("label"), named.alias("name"))
        for name, prefix, key, label, named in (
            ("region", "region", "r_regionkey", "Project", F.col("r_name")),
            ("nation", "repo", "n_nationkey", "Repo", F.col("n_name")),
            ("customer", "file", "c_custkey", "File", F.col("c_name")),
            ("orders", "function", "o_orderkey", "Function", F.col("o_orderpriority")),
            ("part", "package", "p_partkey", "Package", F.col("p_name")),
            ("supplier", "person", "s_suppkey", "Person", F.col("s_name")),
            ("events", "commit", "event_id", "Commit", F.col("event_type")),
        )
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    """(src, dst, type) of the kinds named, or of all."""
    makers = {
        "PART_OF": ("nation", _id("repo", "n_nationkey"), _id("region", "n_regionkey")),
        "HAS_FILE": ("customer", _id("repo", "c_nationkey"), _id("file", "c_custkey")),
        "CONTAINS_FUNCTION": ("orders", _id("file", "o_custkey"), _id("function", "o_orderkey")),
        "DEFINED_IN": ("orders", _id("function", "o_orderkey"), _id("file", "o_custkey")),
        "IMPORTS": ("lineitem", _id("function", "l_orderkey"), _id("package", "l_partkey")),
        "TOUCHED": ("events", _id("commit", "event_id"), _id("file", "user_id")),
        "BELONGS_TO": ("supplier", _id("person", "s_suppkey"), _id("repo", "s_nationkey")),
    }
    out = None
    for kind in kinds or makers:
        name, src, dst = makers[kind]
        part = table(spark, folder, name).select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
        out = part if out is None else out.unionByName(part)
    return out


#: Edges of code: table or tables, rows, number of the source, number of the target, and what both stand for.
_CODE = {
    "HAS_FILE": ("customer", "true", "c_nationkey", "c_custkey", "repo", "file"),
    "CONTAINS_FUNCTION": ("orders", "true", "o_custkey", "o_orderkey", "file", "function"),
    "TOUCHED": ("events", "true", "event_id", "user_id", "commit", "file"),
    "BELONGS_TO": ("supplier", "true", "s_suppkey", "s_nationkey", "person", "repo"),
    "CONTAINS_CLASS": ("orders", "o_orderkey % 4 = 0", "o_custkey", "o_orderkey", "file", "class"),
    "HAS_METHOD": ("orders", "o_orderkey % 4 = 0", "o_orderkey", "o_orderkey", "class", "method"),
    "HAS_TEST": ("customer", "c_custkey % 3 = 0", "c_custkey", "c_custkey", "file", "test"),
    "HAS_DOC": ("customer", "c_custkey % 2 = 0", "c_custkey", "c_custkey", "file", "doc"),
    "FILE_IMPORTS": ("orders lineitem", "true", "o_custkey", "l_partkey", "file", "package"),
    "TARGETS": ("events", "event_type = 'signup'", "event_id", "user_id % 25", "pr", "repo"),
}


def code_keys(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(src, dst) of one kind as the tables' own numbers."""
    names, rows, src, dst, _, _ = _CODE[kind]
    first, *more = names.split()
    found = table(spark, folder, first)
    if more:
        found = found.join(table(spark, folder, more[0]), F.col("o_orderkey") == F.col("l_orderkey"))
    return found.where(rows).select(F.expr(src).cast("long").alias("src"), F.expr(dst).cast("long").alias("dst"))


def code_edges(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    """(src, dst, type) of classes, methods, tests, docs, imports of files and pull requests beside those of edges; of
    the kinds named, or of all."""
    plain = ("PART_OF", "HAS_FILE", "CONTAINS_FUNCTION", "DEFINED_IN", "IMPORTS", "TOUCHED", "BELONGS_TO")
    out = None if kinds else edges(spark, folder)
    for kind in kinds or [k for k in _CODE if k not in plain]:
        named = "IMPORTS" if kind == "FILE_IMPORTS" else kind
        part = code_keys(spark, folder, kind).select(*(F.concat(F.lit(_CODE[kind][i] + ":"), F.col(c).cast("string")).alias(c) for i, c in ((4, "src"), (5, "dst"))), F.lit(named).alias("type"))
        out = part if out is None else out.unionByName(part)
    return out


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as searchable nodes: id, label by language, name, signature, content, embedding (null for many)."""
    docs, vectors = table(spark, folder, "documents"), table(spark, folder, "embeddings")
    label = F.when(F.col("lang") == "en", "Function").when(F.col("lang") == "de", "Class").when(F.col("lang") == "fr", "File").otherwise("Commit")
    out = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return out.select(
        F.col("doc_id").alias("id"), label.alias("label"), F.substring_index("text", "\n", 1).alias("name"), F.col("source").alias("signature"), F.col("text").alias("content"), F.col("source").alias("author_name"),
        F.array(F.concat("source", F.lit("/"), "lang")).alias("files_changed"), F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("message"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sha"), "embedding",
    )
