"""Keyed tables that a change rewrites only in part.

A table is a folder of Parquet files, divided by a hash of the key into buckets, which are folders of their own. A change
names its keys; only the buckets that they fall into are read, changed, and put in place of the old ones by Spark's
dynamic partition overwrite. All else, the files of the other buckets, stays as it is.

A change is numbered. Its new buckets are first written aside, whole; then a mark says that they are to be put in place,
and another one that they are. A change that is repeated after a crash puts the same buckets in place again, and one that
was finished is not done twice, so that counts and sums are right too, as micro-batches need it.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dml
from .graph import dealt, stored

MARK = "batch long, placed boolean"
#: A task that groups takes so much of files or of a shuffle: some million short rows, whose hash table fits its memory.
SHARE = "16m"


def _nullable(kind: T.DataType) -> T.DataType:
    """kind as a file gives it back: all may be null."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType)) if isinstance(kind, T.MapType) else kind


@dataclass
class Buckets:
    """The table in the folder path. key tells rows apart; by (key, if left out) says which rows share a bucket, as all
    rows of a file do. The number of buckets belongs to the table: it must not change once there are rows; it should be
    such that a bucket has some hundred megabytes. A larger one is written by several tasks, as adaptive execution finds.

    grouped says that every change groups its rows by the columns by, in that order. Buckets then are divided by the hash
    that Spark groups by, so that a task of the grouping has rows of few buckets and they need not be moved again."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: list[str]
    by: list[str] = field(default_factory=list)
    buckets: int = 256
    grouped: bool = False

    def __post_init__(self):
        if isinstance(self.schema, str):
            self.schema = self.spark.createDataFrame([], self.schema).schema
        self.schema = _nullable(self.schema)
        self.by = self.by or self.key

    def bucket(self) -> Column:
        """The bucket of a row that has the columns by."""
        hashed = F.hash if self.grouped else F.xxhash64
        return F.pmod(hashed(*(F.col(c) for c in self.by)), F.lit(self.buckets)).cast("int")

    def _kind(self) -> T.StructType:
        """Rows of the files; _row is null in the one that stands for an empty bucket."""
        return T.StructType([T.StructField("_row", self.schema), T.StructField("_bucket", T.IntegerType())])

    def _read(self, folder: str, some: list[int] | None = None) -> DataFrame:
        try:
            rows = self.spark.read.schema(self._kind()).parquet(f"{self.path}/{folder}")
        except AnalysisException:
            return self.spark.createDataFrame([], self._kind())
        return rows if some is None else rows.where(F.col("_bucket").isin(some))

    def table(self, some: list[int] | None = None, number: str | None = None) -> DataFrame:
        """The rows there are; of some buckets alone, whose files then are the only ones read. number is a column to have
        their buckets in."""
        return self._read("table", some).where("_row is not null").select("_row.*", *([F.col("_bucket").alias(number)] if number else []))

    def _mark(self) -> tuple[int, bool] | None:
        try:
            row = self.spark.read.schema(MARK).parquet(f"{self.path}/mark").first()
        except AnalysisException:
            return None
        return (row.batch, row.placed) if row else None

    def _set_mark(self, batch: int, placed: bool) -> None:
        self.spark.createDataFrame([(batch, placed)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/mark")

    def _write(self, rows: DataFrame, folder: str, mode: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("_bucket").parquet(f"{self.path}/{folder}")

    def _place(self, batch: int) -> None:
        """Puts the buckets of a change, which were written aside, in place of the old ones."""
        self._write(self._read(f"aside/turn={batch % 2}"), "table", "dynamic")
        self._set_mark(batch, True)

    def touched(self, keys: DataFrame) -> dict[int, int]:
        """The buckets of keys (the columns by), rising, with the number of keys in each."""
        # at most one row for each bucket
        return {r.bucket: r.n for r in sorted(keys.groupBy(self.bucket().alias("bucket")).agg(F.count("*").alias("n")).collect())}

    def change(self, keys: DataFrame | dict[int, int], merge: Callable[[DataFrame], DataFrame], batch: int) -> list[int]:
        """Rows of the buckets of keys (the columns by, or what touched gives of them) become merge(those rows), which has
        to be made of them and of rows with the same keys. Returns the buckets that were rewritten: none if this batch was
        done before.

        Batches are numbered upwards, and one is finished before the next begins. The first one finds nothing in its place
        and is written once; a crash within it leaves a table without a mark, which counts as empty when it is repeated.
        """
        mark = self._mark()
        if mark and not mark[1]:
            self._place(mark[0])  # a crash came between writing aside and putting in place
            mark = mark[0], True
        if mark and batch <= mark[0]:
            return []
        keys = keys if isinstance(keys, dict) else self.touched(keys)
        touched = list(keys)
        if not touched:
            return []
        old = self.table(touched) if mark else self.spark.createDataFrame([], self.schema)
        rows = merge(old).select(*self.schema.names)
        packed = rows.select(F.struct(*self.schema.names).cast(self.schema).alias("_row"), self.bucket().alias("_bucket"))
        # one that loses all its rows has to be put in place too
        none = self.spark.createDataFrame([(None, b) for b in touched], self._kind())
        packed = packed.unionByName(none.coalesce(1)) if self.grouped else packed.unionByName(none).hint("rebalance", "_bucket")
        there = self._read("table", touched).count() if self.grouped and mark else 0
        with dealt(self.spark, sum(keys.values()) + there, self.buckets, SHARE) if self.grouped else nullcontext():
            self._write(packed, f"aside/turn={batch % 2}" if mark else "table", "static")
        if mark:
            self._set_mark(batch, False)
            self._place(batch)
        else:
            self._set_mark(batch, True)
        return touched

    def upsert(self, new: DataFrame, batch: int, **how) -> list[int]:
        """dml.upsert of new, whose keys are unique, into the buckets that it touches."""
        new = stored(new, "upsert")
        return self.change(new, lambda old: dml.upsert(old, new, self.key, **how), batch)

    def replace(self, owners: DataFrame, rows: DataFrame, batch: int) -> list[int]:
        """All rows that belong to owners (the columns by) go, and rows come, which belong to them: what a file gave
        before it changed, and what it gives now. Of rows with one key the smallest comes."""
        rest = [c for c in self.schema.names if c not in self.key]
        rows = rows.groupBy(*self.key).agg(F.min(F.struct(*rest)).alias("_least")).select(*self.key, "_least.*")
        owners, rows = stored(owners.select(*self.by).distinct(), "owners"), stored(rows, "rows")

        def merge(old: DataFrame) -> DataFrame:
            on = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in self.by]
            return old.alias("o").join(owners.alias("n"), on, "left_anti").unionByName(rows, allowMissingColumns=True)

        return self.change(owners.unionByName(rows.select(*self.by)), merge, batch)

    def fold(self, new: DataFrame, batch: int, newest_by: list[str], sums: list[str] = ()) -> list[int]:
        """One row for each key of the table and new: sums are added up, and of the other columns those of the row with
        the greatest newest_by count. So rows may come late and in any order; new may have many of a key."""
        new = stored(new, "fold")
        rest = [c for c in self.schema.names if c not in self.key and c not in sums]

        def merge(old: DataFrame) -> DataFrame:
            newest = F.max_by(F.struct(*rest), F.struct(*newest_by)).alias("_newest")
            both = old.unionByName(new.select(*self.schema.names)).groupBy(*self.key).agg(newest, *(F.sum(c).alias(c) for c in sums))
            return both.select(*self.key, "_newest.*", *sums)

        return self.change(new, merge, batch)
