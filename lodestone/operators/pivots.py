"""Exact nearest neighbours without a full scan: vectors in cells whose distances to pivots are known.

Vectors of length one lie on a sphere, where the chord is a metric. Some vectors of a bounded sample are pivots; each
vector belongs to the cell of its label, its nearest pivot and a ring of distances to it, and a cell is a folder of
Parquet files. For every cell the index keeps the least and the greatest distance to each pivot. By the triangle
inequality a query is at least so far from all vectors of a cell as its own distance to a pivot is outside that range.

A search reads the cells that seem nearest first, until it has seen enough vectors, and takes from them how good the
last wanted neighbour is at least. Then it reads all cells whose bound doesn't rule them out, and no others: the result
is that of a scan. The index is only files and numbers; Spark prunes the folders, reads and ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import DIGITS

#: Vectors that pivots are chosen from, at most.
SAMPLE = 4096
#: Numbers of the query vectors that one pass takes to all tasks, at most: 32 MB.
BLOCK = 1 << 22
#: Rows multiplied at a time.
ROWS = 2048
#: What rounding a cosine can hide.
SLACK = 2 * 10.0**-DIGITS


def _matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a usable vector, those vectors with length one)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    right = np.array([x is not None and x == dimension for x in pc.list_value_length(column).to_pylist()], bool)
    flat = column.filter(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    some = flat.reshape(int(right.sum()), dimension)
    with np.errstate(all="ignore"):
        norms = np.sqrt((some * some).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    right[right] = good
    return right, some[good] / norms[good, None]


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _spread(vectors: np.ndarray, wanted: int) -> np.ndarray:
    """Pivots: each the vector that is farthest from those before it."""
    out = [0] if len(vectors) else []
    far = _chords(vectors, vectors[:1])[:, 0] if out else np.zeros(0)
    while len(out) < min(wanted, len(vectors)) and far.max() > 0:
        out.append(int(far.argmax()))
        far = np.minimum(far, _chords(vectors, vectors[out[-1] : out[-1] + 1])[:, 0])
    return vectors[out]


@dataclass
class PivotIndex:
    """An index in the folder path: vectors, cells and pivots as Parquet tables. Cells are as many as labels * pivots *
    rings at most, which is what the driver keeps of them: two numbers for each cell and pivot."""

    spark: SparkSession
    path: str
    pivots: np.ndarray
    cells: list
    least: np.ndarray
    most: np.ndarray
    rows: np.ndarray

    @classmethod
    def build(cls, nodes: DataFrame, path: str, dimension: int, pivots: int = 48, rings: int = 3, rows_per_file: int = 1 << 16) -> PivotIndex:
        """Writes the index of nodes (id, label, embedding) to path, a new folder that all executors reach.

        Rows without an embedding of the dimension, with nulls or numbers that aren't finite in it, or of length zero
        have no cosine and are left out. A cell's files have at most rows_per_file rows; a cell with more of them is
        dealt over as many tasks. A null label is a label of its own.
        """
        spark = nodes.sparkSession
        nodes = nodes.select("id", "label", "embedding")
        # a bounded sample: hashes of ids put them into an order of their own
        first = nodes.where(F.size("embedding") == dimension).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()
        centres = _spread(_matrix(first.column(0), dimension)[1], pivots)
        shared = spark.sparkContext.broadcast(centres)
        kind = T.StructType([*nodes.schema, T.StructField("pivot", T.IntegerType()), T.StructField("distance", T.DoubleType())])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    right, vectors = _matrix(batch.column(2), dimension)
                    d = _chords(vectors, shared.value)
                    own = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
                    kept = batch.filter(pa.array(right))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])], names=kind.names)

        placed = nodes.mapInArrow(assign, kind)
        placed.write.parquet(f"{path}/placed")
        placed = spark.read.schema(kind).parquet(f"{path}/placed")
        steps = [(i + 1) / rings for i in range(rings - 1)]
        limits = F.percentile_approx("distance", steps, 1000) if steps else F.array().cast("array<double>")
        groups = placed.groupBy("label", "pivot").agg(limits.alias("limits"), F.count("*").alias("n"))
        number = F.row_number().over(Window.orderBy("label", "pivot")) - 1  # one row for each label and pivot
        groups = groups.withColumn("first_cell", number * rings)
        groups.write.parquet(f"{path}/groups")
        groups = spark.read.schema(groups.schema).parquet(f"{path}/groups")
        ring = F.size(F.filter("limits", lambda x: x < F.col("distance")))
        salt = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("n") / rings / rows_per_file)))
        same = placed["label"].eqNullSafe(groups["label"]) & (placed["pivot"] == groups["pivot"])
        celled = placed.join(F.broadcast(groups), same).select("id", placed["label"], "embedding", (F.col("first_cell") + ring).cast("int").alias("cell"), salt.alias("salt"))
        celled.repartition("cell", "salt").sortWithinPartitions("cell").drop("salt").write.option("maxRecordsPerFile", rows_per_file).partitionBy("cell").parquet(f"{path}/vectors")

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    d = _chords(_matrix(batch.column(1), dimension)[1], shared.value)
                    cell = batch.column(0).to_numpy()
                    for c in np.unique(cell).tolist():
                        here = d[cell == c]
                        yield pa.RecordBatch.from_arrays([pa.array([c] * d.shape[1], pa.int32()), pa.array(np.arange(d.shape[1], dtype=np.int32)), pa.array(here.min(axis=0)), pa.array(here.max(axis=0)), pa.array([len(here)] * d.shape[1], pa.int64())], names=["cell", "pivot", "least", "most", "n"])

        written = spark.read.schema(T.StructType([*nodes.schema, T.StructField("cell", T.IntegerType())])).parquet(f"{path}/vectors")
        found = written.select("cell", "embedding").mapInArrow(bounds, "cell int, pivot int, least double, most double, n long")
        found = found.groupBy("cell", "pivot").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))
        labels = groups.select("label", F.explode(F.sequence("first_cell", F.col("first_cell") + rings - 1)).alias("cell"))
        found.join(F.broadcast(labels), "cell").write.parquet(f"{path}/cells")
        spark.createDataFrame([(c.tolist(),) for c in centres], "pivot array<double>").coalesce(1).withColumn("i", F.monotonically_increasing_id()).write.parquet(f"{path}/pivots")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PivotIndex:
        """The index that build has written to path, in any later session."""
        pivots = np.array([r.pivot for r in spark.read.parquet(f"{path}/pivots").orderBy("i").collect()])
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell", "pivot").collect() if len(pivots) else []
        shape = (-1, max(len(pivots), 1))
        least, most, n = (np.array([r[c] for r in rows], float).reshape(shape) for c in ("least", "most", "n"))
        cells = [(r.cell, r.label) for r in rows[:: shape[1]]]
        return cls(spark, path, pivots, cells, least, most, n[:, 0].astype(np.int64) if rows else np.zeros(0, np.int64))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """[query, cell]: the greatest cosine that a vector of the cell can have with the query."""
        out = np.zeros((len(queries), len(self.cells)))
        d = _chords(queries, self.pivots)
        for p in range(len(self.pivots)):
            out = np.maximum(out, np.maximum(d[:, p : p + 1] - self.most[:, p], self.least[:, p] - d[:, p : p + 1]))
        return 1 - out * out / 2

    def _best(self, visits: np.ndarray, names: list, queries: np.ndarray, limit: int, but_itself: bool) -> DataFrame:
        """(query, id, label, cosine) of the best of the cells that each query visits: each task keeps the best of its
        rows, then the best of all are taken."""
        chosen = np.nonzero(visits.any(axis=0))[0]
        numbers = [self.cells[c][0] for c in chosen]
        table = self.spark.read.parquet(f"{self.path}/vectors")
        table = table.where(F.col("cell").isin(numbers)).select("id", "label", "embedding", "cell")
        shared = self.spark.sparkContext.broadcast((queries, {n: np.nonzero(visits[:, c])[0] for n, c in zip(numbers, chosen.tolist(), strict=True)}, names))
        dimension, keep = queries.shape[1], limit + but_itself

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, asked, names = shared.value
            best: dict[int, list] = {}
            kind = pa.null()
            for whole in batches:
                kind = whole.schema.field("id").type
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    right, some = _matrix(batch.column(2), dimension)
                    batch = batch.filter(pa.array(right))
                    cells, ids, labels = batch.column(3).to_numpy(), batch.column(0), batch.column(1)
                    for cell in np.unique(cells).tolist():
                        here, who = np.nonzero(cells == cell)[0], asked[cell]
                        cosines = np.round(vectors[who] @ some[here].T, DIGITS)
                        for q, row in zip(who.tolist(), cosines, strict=True):
                            old = best.get(q, [])
                            least = -old[-1][0] if len(old) == limit else -2.0
                            new = np.nonzero(row >= least)[0]
                            if len(new) > keep:  # with all that tie with the last of them, since ids decide
                                new = new[row[new] >= np.partition(row[new], -keep)[-keep]]
                            places = here[new].tolist()
                            found = [(-c, i, l) for c, i, l in zip(row[new].tolist(), ids.take(pa.array(places, pa.int64())).to_pylist(), labels.take(pa.array(places, pa.int64())).to_pylist(), strict=True) if not (but_itself and i == names[q])]
                            best[q] = sorted(old + found, key=lambda x: x[:2])[:limit]
            flat = [(q, i, l, -c) for q, rows in best.items() for c, i, l in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], kind), pa.array([x[2] for x in flat], pa.string()), pa.array([x[3] for x in flat], pa.float64())], names=["query", "id", "label", "cosine"])

        out = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("id", table.schema["id"].dataType), T.StructField("label", T.StringType()), T.StructField("cosine", T.DoubleType())])
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
        return table.mapInArrow(run, out).withColumn("rank", rank).where(F.col("rank") <= limit)

    def visits(self, queries: np.ndarray, limit: int, names: list, label: str | None = None, but_itself: bool = False) -> np.ndarray:
        """[query, cell]: which cells have to be read for the exact best of each query, found by reading the nearest."""
        allowed = np.array([label is None or x == label for _, x in self.cells], bool)
        top = np.where(allowed, self.bounds(queries), -np.inf)
        order = np.argsort(-top, axis=1, kind="stable")
        first = np.zeros(top.shape, bool)
        enough = np.cumsum(self.rows[order] * allowed[order], axis=1) - self.rows[order] * allowed[order] < 2 * (limit + but_itself)
        np.put_along_axis(first, order, enough & allowed[order], axis=1)
        worst = np.full(len(queries), -2.0)
        last = self._best(first, names, queries, limit, but_itself).where(F.col("rank") == limit).select("query", "cosine")
        for r in last.collect():  # one number for each query
            worst[r.query] = r.cosine
        return (top >= worst[:, None] - SLACK) & allowed

    def nearest(self, asked: DataFrame, limit: int = 5, label: str | None = None, but_itself: bool = False) -> DataFrame:
        """(query, id, label, vector_score, rank) for asked (query, embedding): the rows of greatest cosine, ties to the
        smaller id, as a scan would give them. but_itself leaves out the row whose id is the query's name. A vector
        without length or of another dimension has no neighbours; names of queries have to differ.

        Queries are taken in blocks of some megabytes, by a hash of their names, so that the driver and each task hold
        one block at a time; each block reads the cells that it needs.
        """
        asked = asked.select(F.col("query"), F.col("embedding"))
        dimension = self.pivots.shape[1] if len(self.pivots) else 0
        name, cells = asked.schema["query"].dataType, max(dimension, 1, len(self.cells))
        blocks = max(1, -(-asked.count() * cells // BLOCK)) if dimension else 0
        kinds = [("query", name), ("id", self.spark.read.parquet(f"{self.path}/placed").schema["id"].dataType), ("label", T.StringType()), ("vector_score", T.DoubleType()), ("rank", T.IntegerType())]
        out = self.spark.createDataFrame([], T.StructType([T.StructField(*k) for k in kinds]))
        for block in range(blocks):
            some = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toArrow()
            right, queries = _matrix(some.column(1), dimension)
            names = some.column(0).filter(pa.array(right)).to_pylist()
            if names:
                best = self._best(self.visits(queries, limit, names, label, but_itself), names, queries, limit, but_itself)
                named = self.spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField("name", name)]))
                out = out.unionByName(best.join(F.broadcast(named), "query").select(F.col("name").alias("query"), "id", "label", ((1 + F.col("cosine")) / 2).alias("vector_score"), "rank"))
        return out
