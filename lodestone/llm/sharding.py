"""Exact uniform sharding through a hypergeometric communication matrix.

The input is divided into parts of consecutive rows. The matrix of how many rows each part sends to each shard is drawn
from the multivariate hypergeometric law, with the part sizes as row sums and the wanted shard sizes as column sums; so
shard sizes are exact. Each part permutes its rows, deals them by its matrix row, and draws a random key for each. The
key divides a shard into cells, so that no task holds a whole shard; one exchange brings the rows to their cells, where
the key permutes them again. Counts of the cells, taken before from the rows' places alone, give each cell its first
slot. The result is a uniform permutation of all rows that depends only on the seed and the rows' places in the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, stored, unused, with_columns

#: Rows of one part; parts are runs of a file's rows.
PART = 1 << 18
#: Cells of all shards at most, and so partitions of the exchange and numbers on the driver.
CELLS = 200_000
#: Bits of a row's random key.
KEY = 62


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows sent from each part to each shard: uniform among all ways to deal the rows into the shards.

    It halves the parts and draws how the left half divides over the shards, so that the draws are few and small.
    """
    out = np.zeros((len(parts), len(shards)), np.int64)
    rng = np.random.default_rng(seed)
    method = "marginals"

    def draw(lo: int, hi: int, room: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = room
            return
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(room, int(sum(parts[lo:mid])), method=method) if room.sum() else room.copy()
        draw(lo, mid, left)
        draw(mid, hi, room - left)

    if parts:
        draw(0, len(parts), np.array(shards, np.int64))
    return out


class _Names(NamedTuple):
    """Columns of the operator's own, named unlike those of the table."""

    file: str
    row: str
    size: str
    part: str
    cell: str
    order: str


def _parts(docs: DataFrame, kept: list[str], own: _Names) -> tuple[DataFrame, dict, int] | None:
    """docs with each row's part and place, the rows of each part, and the bytes of the files; None where rows have no
    places of their own."""
    try:
        places = docs.metadataColumn("_metadata")
        placed = docs.select(*[F.col(f"`{n}`") for n in kept], places["file_path"].alias(own.file), places["row_index"].alias(own.row), places["file_size"].alias(own.size))
        placed = placed.withColumn(own.part, F.floor(F.col(own.row) / PART).cast("int"))
    except AnalysisException:
        return None
    at = F.col(own.row) % PART
    # a few numbers for each PART rows: the driver's share of the work
    told = placed.select(F.col(own.file).alias("file"), F.col(own.part).alias("part"), F.col(own.size).alias("bytes"), at.alias("at"))
    found = told.groupBy("file", "part").agg(F.count("*").alias("n"), F.max("at").alias("last"), F.sum("at").alias("sum"), F.first("bytes").alias("size")).collect()
    if any(r.n != r.last + 1 or 2 * r["sum"] != r.n * (r.n - 1) for r in found):
        return None  # rows were left out or copied
    return placed, {(r["file"], r["part"]): r.n for r in found}, sum({r["file"]: r["size"] for r in found}.values())


def shuffle_to_shards(docs: DataFrame, shards: int = 24, seed: int = 20, rows_per_cell: int = 16_384, bytes_per_cell: int = 16 << 20) -> DataFrame:
    """docs with shard int (0 to shards-1) and slot long (gapless from 0 in its shard).

    Shard sizes differ by one row at most, and every permutation of the rows is equally likely. Null, empty and very
    long texts are rows like any other; equal texts and repeated rows are dealt independently, since only their place
    in the input counts, so they may come to different shards. An empty table gives an empty one. Columns named shard or
    slot are replaced. A cell, which is what one task exchanges, has about rows_per_cell rows or bytes_per_cell bytes of
    the files, whichever is less, up to CELLS cells; beyond that, at 3 TB with these sizes, cells grow: at 100 TB one has
    500 MB, which Spark sorts outside of memory and this reads by batches. The driver keeps one number for each cell.

    Rows are told apart by file and row number, which every re-run of a lost task sees alike; docs that don't come
    straight from Parquet files are first written to the shared folder.
    """
    spark = docs.sparkSession
    batches_of(spark)
    kept = [f.name for f in docs.schema if f.name.lower() not in ("shard", "slot")]
    own = _Names(*unused(docs, "_file", "_row", "_size", "_part", "_cell", "_order"))
    placed, counts, size = _parts(docs, kept, own) or _parts(stored(docs.select(*[F.col(f"`{n}`") for n in kept]), "rows"), kept, own)
    parts, total = sorted(counts), sum(counts.values())
    matrix = communication_matrix([counts[p] for p in parts], shard_sizes(total, shards), seed)
    wanted = max(1, -(-total // (shards * rows_per_cell)), -(-size // (shards * bytes_per_cell)))
    per_shard = min(wanted, max(1, CELLS // shards))
    sent = spark.sparkContext.broadcast(({p: i for i, p in enumerate(parts)}, matrix))

    def drawn(batch: pa.RecordBatch, dealt: dict) -> tuple[np.ndarray, np.ndarray]:
        """Cell and key of each row of a batch; dealt remembers the last parts."""
        index, rows = sent.value
        files, at, part = (batch.column(batch.schema.get_field_index(n)) for n in (own.file, own.row, own.part))
        place = np.array([index[k] for k in zip(files.to_pylist(), part.to_pylist(), strict=True)], np.int64)
        at = at.to_numpy() % PART
        shard, key = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for p in np.unique(place).tolist():
            if p not in dealt:
                if len(dealt) > 2:
                    dealt.clear()
                rng = np.random.default_rng((seed, p))
                labels = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), rows[p]))
                dealt[p] = labels, rng.integers(0, 1 << KEY, len(labels))
            here = place == p
            shard[here], key[here] = dealt[p][0][at[here]], dealt[p][1][at[here]]
        return (shard * per_shard + (key >> 20) * per_shard // (1 << (KEY - 20))).astype(np.int32), key

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(drawn(batch, dealt)[0])], names=["cell"])

    # one number for each cell: a pass over the rows' places, without their texts
    filled = {r.cell: r["count"] for r in placed.select(own.file, own.row, own.part).mapInArrow(cells, "cell int").groupBy("cell").count().collect()}
    sizes = np.array([filled.get(c, 0) for c in range(shards * per_shard)], np.int64).reshape(shards, per_shard)
    first = spark.sparkContext.broadcast((np.cumsum(sizes, axis=1) - sizes).reshape(-1))
    schema = with_columns(T.StructType([f for f in docs.schema if f.name in kept]), [T.StructField(own.cell, T.IntegerType()), T.StructField(own.order, T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: dict = {}
        for batch in batches:
            cell, key = drawn(batch, dealt)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(cell), pa.array(key)], names=schema.names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come one after the other, in the order of their second permutation."""
        cell, seen = -1, 0
        for batch in batches:
            cells_ = batch.column(batch.schema.get_field_index(own.cell)).to_numpy()
            slot = first.value[cells_]
            for c in np.unique(cells_).tolist():
                if c != cell:
                    cell, seen = c, 0
                here = np.nonzero(cells_ == c)[0]
                slot[here] += np.arange(seen, seen + len(here))
                seen += len(here)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array((cells_ // per_shard).astype(np.int32)), pa.array(slot)], names=[*kept, "shard", "slot"])

    out = with_columns(T.StructType([f for f in docs.schema if f.name in kept]), [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    exchanged = placed.mapInArrow(deal, schema).repartitionById(shards * per_shard, own.cell).sortWithinPartitions(own.cell, own.order)
    return exchanged.mapInArrow(number, out)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard, rows in slot order within a file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
