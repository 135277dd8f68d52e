"""Numbers of different items that are kept up to date by what comes and goes.

For each owner, branch and item there is a count of the edges that join them, in a table of buckets. A change is rows of
what came (1) and went (-1): only the buckets of its items are rewritten. Beside it are the numbers of different items by
owner, branch and bucket; those of the rewritten buckets are counted again, and a statistic is their sum. No other edge
is read, and an owner with very many items is spread over all buckets.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import SHARE, Buckets
from .graph import dealt, stored


@dataclass
class Tallies:
    """The tables in the folder path; owners and items are of one kind, texts unless it says otherwise. Numbers are
    grouped faster."""

    spark: SparkSession
    path: str
    buckets: int = 256
    kind: str = "string"

    def __post_init__(self):
        self.items = Buckets(self.spark, f"{self.path}/items", f"id {self.kind}, branch string, item {self.kind}, n long", ["id", "branch", "item"], buckets=self.buckets, grouped=True)
        self.sums = Buckets(self.spark, f"{self.path}/sums", f"bucket int, id {self.kind}, branch string, n long", ["bucket", "id", "branch"], ["bucket"], self.buckets)

    def update(self, changes: dict[str, DataFrame] | DataFrame, batch: int) -> int:
        """Applies changes, by branch (id, item, n) or with branch as a column, n being 1 for each edge that came and -1 for
        each that went; numbers of batches rise, and one that comes again counts once. Returns how many buckets had to be
        looked at."""
        parts = [c.withColumn("branch", F.lit(name)) for name, c in changes.items()] if isinstance(changes, dict) else [changes]
        rows = functools.reduce(DataFrame.unionByName, (p.select(F.col("id").cast(self.kind).alias("id"), "branch", F.col("item").cast(self.kind).alias("item"), F.col("n").cast("long").alias("n")) for p in parts))
        with dealt(self.spark, 0, share=SHARE):
            new = stored(rows.where("id is not null and item is not null"), "changes")

        def merge(old: DataFrame) -> DataFrame:
            # an edge may go in a batch before the one it comes in, so that counts below zero stay
            return old.unionByName(new).groupBy("id", "branch", "item").agg(F.sum("n").alias("n")).where("n <> 0")

        touched = self.items.touched(new)
        self.items.change(touched, merge, batch)
        if touched:
            counted = self.items.table(list(touched), "bucket").where("n > 0").groupBy("bucket", "id", "branch").agg(F.count("*").alias("n"))
            self.sums.replace(self.spark.createDataFrame([(b,) for b in touched], "bucket int"), counted, batch)
        return len(touched)

    def statistics(self, starts: DataFrame, branches: list[str]) -> DataFrame:
        """starts (id, ...) with the number of different items of each branch, 0 without any, as graph.statistics gives."""
        sums = [F.sum(F.when(F.col("branch") == b, F.col("n"))).alias(b) for b in branches]
        counted = self.sums.table().groupBy(F.col("id").alias("_id")).agg(*sums)
        out = starts.join(counted, F.col("id").cast(self.kind) == F.col("_id"), "left").drop("_id")
        return out.na.fill(0, branches)
