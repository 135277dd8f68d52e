"""Webhook events: routing, and incremental updates by micro-batch."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import paths, texts
from lodestone.operators import dml
from lodestone.operators.buckets import Buckets

PAYLOAD = """action string, ref string, repository struct<clone_url: string, html_url: string>,
pull_request struct<number: int, title: string, body: string, state: string, merged: boolean, merged_at: string,
user: struct<login: string, email: string>, base: struct<ref: string>, head: struct<ref: string>>"""


def verified(body: bytes, signature: str | None, secret: str) -> bool:
    """Whether signature (sha256=...) belongs to body; without a secret there is nothing to check."""
    if not secret:
        return True
    wanted = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    return hmac.compare_digest(wanted, signature or "")


def signature(body: Column, secret: str) -> Column:
    """sha256=... of a text with a secret, by the definition of HMAC over the built-in hash."""
    key = secret.encode() if len(secret.encode()) <= 64 else hashlib.sha256(secret.encode()).digest()
    key = key.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in key)), body.cast("binary")), 256)
    return F.concat(F.lit("sha256="), F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in key)), F.unhex(inner)), 256))


def is_signed(body: Column, given: Column, secret: str) -> Column:
    """Whether given is the signature of body; without a secret there is nothing to check."""
    return F.coalesce(signature(body, secret) == given, F.lit(False)) if secret else F.lit(True)


def parsed(events: DataFrame) -> DataFrame:
    """events (event_type, body) with the column payload."""
    return events.withColumn("payload", F.from_json("body", PAYLOAD))


def routed(events: DataFrame) -> DataFrame:
    """events (event_type, payload) with status, repo_url and branch: triggered, processed or ignored."""
    p = F.col("payload")
    url = F.coalesce(F.nullif(p.repository.clone_url, F.lit("")), F.nullif(p.repository.html_url, F.lit("")))
    is_pull, is_push = F.col("event_type") == "pull_request", F.col("event_type") == "push"
    merged = is_pull & (p.action == "closed") & F.coalesce(p.pull_request.merged, F.lit(False))
    branch = F.when(merged, F.nullif(p.pull_request.base.ref, F.lit(""))).when(is_push, F.nullif(paths.branch_of_ref(p.ref), F.lit("")))
    out = events.withColumn("_url", url).withColumn("_branch", branch)
    go = F.col("_url").isNotNull() & F.col("_branch").isNotNull()
    status = F.when(go, "triggered").when(is_pull, "processed").otherwise("ignored")
    return out.withColumn("status", status).withColumn("repo_url", F.when(go, F.col("_url"))).withColumn("branch", F.when(go, F.col("_branch"))).drop("_url", "_branch")


def pull_requests(events: DataFrame) -> DataFrame:
    """PullRequest nodes of events (event_type, payload), with defaults for what a payload lacks."""
    p, r = F.col("payload.pull_request"), F.col("payload.repository")
    url = F.coalesce(r.html_url, r.clone_url, F.lit(""))
    info = paths.repo_info(url)
    merged = F.coalesce(p.merged, F.lit(False))
    some = events.where("event_type = 'pull_request' and payload.pull_request.number is not null")
    content = texts.pull_request_document(p.number, p.title, p.body, p.user.login, p.state, merged, p.base.ref, p.head.ref)
    return some.select(
        paths.node_id(info["name"], F.lit("pr"), p.number.cast("string")).alias("id"), F.lit("PullRequest").alias("label"), p.number.alias("pr_number"), p.title.alias("title"), p.body.alias("body"), content.alias("content"),
        p.user.login.alias("author"), url.alias("repo_url"), p.state.alias("state"), merged.alias("merged"), p.merged_at.alias("merged_at"), p.base.ref.alias("base_branch"), p.head.ref.alias("head_branch"),
    )


def run(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Handles all events there are by micro-batch. A batch may come again after a failure, so handle has to give the
    same state when it repeats one, as upserts by key do."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned(spark: SparkSession, path: str, empty: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A handler that keeps a table in two folders that take turns: a repeated batch starts from the one before it, and
    no more than two versions are kept."""

    def handle(batch: DataFrame, number: int) -> None:
        old = spark.read.schema(empty.schema).parquet(f"{path}/turn={(number - 1) % 2}") if number else empty
        fresh = change(old, batch)
        fresh.write.mode("overwrite").parquet(f"{path}/turn={number % 2}")
        spark.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("append").parquet(f"{path}-batches")

    return handle


def newest(spark: SparkSession, path: str, empty: DataFrame) -> DataFrame:
    """The table that versioned keeps, after its last batch; empty before the first."""
    try:
        last = spark.read.schema("batch long").parquet(f"{path}-batches").agg(F.max("batch").alias("last")).first().last
    except AnalysisException:
        return empty
    return spark.read.schema(empty.schema).parquet(f"{path}/turn={last % 2}")


def incremental(nodes: DataFrame, edges: DataFrame, old: DataFrame, new: DataFrame, repo: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """nodes and edges after files (repo, path, sha, content) became those of new: what came from changed files goes,
    and changed and added files are parsed again. Without changes the graph is returned as it is."""
    changes = dml.changed_files(old, new)
    gone = changes.where("change <> 'added'").select(paths.node_id(repo, F.col("path"), "file").alias("id"))
    left_nodes, left_edges = dml.delete_files(nodes, edges, gone)
    fresh = new.join(changes.where("change <> 'removed'").select("path"), "path", "left_semi")
    more_nodes, more_edges = parse(fresh)
    # of a node that is there already the newly parsed values count
    return dml.upsert(left_nodes, more_nodes, ["id"]), left_edges.unionByName(more_edges, allowMissingColumns=True).dropDuplicates(["src", "dst", "type"])


def once(events: DataFrame, delivery: str = "delivery", at: str = "at", late: str = "1 day") -> DataFrame:
    """A stream's events without those that are delivered again within late of each other; Spark keeps the deliveries'
    names that long and drops them as the watermark goes on. Events later than that against the stream are left out."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([delivery])


def kept(table: Buckets, rows: Callable[[DataFrame], DataFrame], newest_by: list[str], sums: list[str] = ()) -> Callable[[DataFrame, int], None]:
    """A handler for run that keeps the newest row of each key in a table of buckets: a batch rewrites only the buckets
    that its keys fall into. rows makes rows of the table of a batch; events that arrive late lose against newer ones,
    and a batch that comes again changes nothing."""

    def handle(batch: DataFrame, number: int) -> None:
        table.fold(rows(batch), number, newest_by, sums)

    return handle
