"""Changes to node and edge tables: each returns the new table, to be written as a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import reachable, stored


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old: bool = True, created: str | None = None, now: Column | None = None) -> DataFrame:
    """old with the rows of new, matched by key, which has to be unique in both.

    keep_old: a null of new leaves the old value; else it removes it. A column that new lacks stays. created names a
    column that a row gets (now) when it is made and keeps from then on.
    """
    left, right = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    both = left.join(right, on, "full_outer")
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    out = []
    for c in columns:
        was = F.col(f"o.{c}") if c in old.columns else None
        got = F.col(f"n.{c}") if c in new.columns else None
        if c == created:
            value = F.coalesce(was, got, now) if got is not None else F.coalesce(was, now)
        elif got is None or was is None:
            value = was if got is None else got
        elif c in key or keep_old:
            value = F.coalesce(got, was)
        else:
            value = F.when(F.col("n._new"), got).otherwise(was)
        out.append(value.alias(c))
    return both.select(*out)


def link(edges: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges and the wanted ones (src, dst, type) whose ends are nodes, each once; the properties of old ones stay."""
    ids = nodes.select("id").distinct()
    good = wanted.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").dropDuplicates(["src", "dst", "type"])
    fresh = good.join(edges, ["src", "dst", "type"], "left_anti")
    return edges.unionByName(fresh.select(*[c for c in edges.columns if c in fresh.columns]), allowMissingColumns=True)


def append_memory(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with rows (type, content, metadata map) as new memories with an identifier and a time.

    An identifier is made of what a memory says, when, and its number among equal ones, so that a task that is repeated
    makes the same.
    """
    said = rows.select(F.col("type").alias("label"), "content", F.to_json("metadata").alias("metadata"), F.current_timestamp().alias("created_at"))
    same = Window.partitionBy("label", "content", "metadata").orderBy(F.lit(0))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("label", "content", "metadata", "created_at")]
    h = F.md5(F.concat_ws("\x1f", *parts, F.row_number().over(same).cast("string")).cast("binary"))
    new = said.withColumn("id", F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))
    return table.unionByName(new, allowMissingColumns=True)


def set_embeddings(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """nodes with the embeddings (id, embedding) of their ids; others keep theirs."""
    got = embeddings.select("id", F.col("embedding").alias("_got"))
    return nodes.join(got, "id", "left").withColumn("embedding", F.coalesce("_got", "embedding")).drop("_got").select(*nodes.columns)


def without(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the ids of doomed and all that touches them; doomed is worked out once, and written."""
    ids = stored(doomed.select("id").distinct(), "doomed")
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti").select(*nodes.columns), left.select(*edges.columns)


def file_subgraph(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(id): files and their classes, functions, tests and docs, and the methods of the classes."""
    own = files.select("id")
    edges = edges.where(F.col("type").isin("CONTAINS_CLASS", "CONTAINS_FUNCTION", "HAS_TEST", "HAS_DOC", "HAS_METHOD"))
    direct = edges.where(F.col("type").isin("CONTAINS_CLASS", "CONTAINS_FUNCTION", "HAS_TEST", "HAS_DOC")).join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    methods = edges.where(F.col("type") == "HAS_METHOD").join(direct.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    return own.unionByName(direct).unionByName(methods).distinct()


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return without(nodes, edges, file_subgraph(edges, files))


def clear_repository(nodes: DataFrame, edges: DataFrame, repo_id: str, owned_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Without all that is reachable from a repository; owned_only spares what packages alone join to it."""
    start = nodes.where(F.col("id") == repo_id).select("id")
    used = edges.where(F.col("type") != "IMPORTS") if owned_only else edges
    return without(nodes, edges, reachable(used, start))


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """(label, id, n) that break the rule of one node for each label and id."""
    return nodes.groupBy("label", "id").agg(F.count("*").alias("n")).where("n > 1")


def sanitised(df: DataFrame) -> DataFrame:
    """Times as ISO texts, maps, structs and arrays of those as JSON."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f.name)
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif kind in ("map", "struct") or kind == "array" and f.dataType.elementType.typeName() in ("map", "struct", "array"):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two manifests (path, sha): added, removed or modified."""
    both = old.select("path", F.col("sha").alias("was"), F.lit(1).alias("_o")).join(new.select("path", F.col("sha").alias("now"), F.lit(1).alias("_n")), "path", "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def pending_migrations(files: DataFrame, applied: DataFrame) -> DataFrame:
    """(filename, statement) of migrations (filename, content) not applied yet: comment lines go, ; ends a statement."""
    todo = files.join(applied.select("filename"), "filename", "left_anti")
    plain = F.regexp_replace("content", r"(?m)^\s*--.*$", "")
    return todo.select("filename", F.posexplode(F.split(plain, ";")).alias("i", "statement")).withColumn("statement", F.trim("statement", F.lit(" \t\n\r"))).where("statement <> ''")
