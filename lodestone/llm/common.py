"""Shared helpers: tables cut out of the lineage, output columns, Arrow batches."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from spark.checkpoint.dir. Only a local session without that setting gets a folder of its own; a
    cluster without it is refused, since machine-local folders are lost with their machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class _Made(threading.local):
    """Folders that temporary has named in this thread."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _made.paths.append(path)
    return path


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: its lineage ends there and survives executors."""
    spark = df.sparkSession
    path = temporary(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches_of(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, since a row may hold a very long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def with_columns(schema: T.StructType, new: list[T.StructField]) -> T.StructType:
    """schema without the columns that new replaces (names compare without case), then new."""
    names = {f.name.lower() for f in new}
    return T.StructType([f for f in schema if f.name.lower() not in names] + new)


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, with underscores before those that df has, whatever their case: for columns of an operator's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def append_columns(df: DataFrame, source: str, new: list[T.StructField], compute: Callable[[list], list[list]]) -> DataFrame:
    """df with columns computed from the column source by batches; columns of the same names are replaced."""
    schema = with_columns(df.schema, new)
    kept = schema.names[: len(schema.names) - len(new)]
    arrow = [pa.field(f.name, _arrow_type(f.dataType)) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch.column(batch.schema.get_field_index(source)).to_pylist())
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in kept] + [pa.array(x, type=f.type) for x, f in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("kd", "tag")) -> DataFrame:
    """docs with two columns that tell rows apart by id and text; a null id is replaced by a hash of the text."""
    kt = F.xxhash64(F.col(text_col))
    return docs.select("*", F.coalesce(F.col(id_col).cast("long"), kt).alias(names[0]), kt.bitwiseAND(0xFFFFFFF).cast("int").alias(names[1]))


def joined(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes, bound: int = 32 << 20) -> DataFrame:
    """big joined with small: by broadcast if small takes at most bound bytes, else by shuffle.

    small must be a written table; row_bytes (a number or column) is its size in bytes a row, which is summed first.
    """
    row_bytes = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    size = small.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("size")).first().size
    return big.join(F.broadcast(small) if size <= bound else small.hint("merge"), on, how)


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark writes to; Python has no public call for that."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tables_made() -> int:
    """A mark for finished: how many tables this thread has written."""
    return len(_made.paths)


def finished(result: DataFrame, name: str, since: int) -> DataFrame:
    """result as a written table, with all tables deleted that this thread has written since the mark; for jobs that go
    on with result alone."""
    out = stored(result, name)
    for path in _made.paths[since:-1]:
        _delete(result.sparkSession, path)
    del _made.paths[since:-1]
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Frees the disk of steps that are done: deletes written tables that nothing reads any more, and has the driver
    collect its garbage, upon which Spark removes the shuffle files of results that are gone."""
    for path in {os.path.dirname(f) for t in tables for f in t.inputFiles()}:
        if "/lodestone/" in path:
            _delete(spark, path)
    gc.collect()
    spark._jvm.System.gc()
