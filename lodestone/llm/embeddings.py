"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one vector of a group kept.

Centroids come from a bounded sample; those nearer to each other than linked vectors may be are merged, so that a tight
spot has one cell. Every vector has its home in the cell of its nearest centroid. The border of two cells is the plane
where both centroids are equally near. Of two linked vectors on both sides of it, which are at most the chord
sqrt(2 - 2 * least) apart, one stands within half the chord of the border: a vector that near also visits the cell
beyond, so every linked pair meets in a cell, and once at least. Where both visit each other's cells each end is
credited where it is the guest, else both are where they meet. Nothing is missed.

Within a cell vectors stand in blocks, and a task gets two blocks. Vectors within half the linking angle of the centroid
all link with each other: where they are more than a block they are counted and tied to one of them without products,
so that a hot spot of different vectors costs no products within itself. Equal vectors are compared once and counted as
often as they occur. A task returns link counts and a spanning star, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, joined, stored
from .components import Links, components


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 4) -> np.ndarray:
    """k unit centroids of unit vectors by largest cosine; an empty cell starts anew at the vector least like its own."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        cosines = sample @ centroids.T
        cell = cosines.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        norms = np.linalg.norm(sums, axis=1)
        empty = np.nonzero(norms < 1e-12)[0]
        far = np.argsort(cosines.max(axis=1), kind="stable")[: len(empty)]
        sums[empty[: len(far)]], norms[empty[: len(far)]] = sample[far], 1.0
        centroids = sums / np.maximum(norms, 1e-12)[:, None]
    return centroids


def unit(rows: list) -> np.ndarray:
    """Rows of numbers of one length as unit vectors in double precision; scaled first, so that no square overflows."""
    x = np.array(rows, np.float64)  # a copy
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def merged_centroids(sample: np.ndarray, k: int, least: float) -> np.ndarray:
    """Centroids by k-means, no two of them with a cosine of least or more; the more populous one of such two stays."""
    centroids = spherical_kmeans(sample, k)
    size = np.bincount((sample @ centroids.T).argmax(axis=1), minlength=len(centroids))
    kept: list[int] = []
    for c in np.argsort(-size, kind="stable").tolist():
        if not kept or (centroids[kept] @ centroids[c]).max() < least:
            kept.append(c)
    centroids = centroids[kept]
    if len(kept) < k:
        # the centroids left move to the middle of what they got
        for _ in range(2):
            sums = np.zeros_like(centroids)
            np.add.at(sums, (sample @ centroids.T).argmax(axis=1), sample)
            norms = np.linalg.norm(sums, axis=1)[:, None]
            centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


class Cells:
    """Where unit vectors of one length are at home, and what cells they visit."""

    def __init__(self, centroids: np.ndarray, least: float):
        self.centroids = centroids
        chord = np.sqrt(2 - 2 * least)
        self.reach = np.sqrt(np.maximum(0, 2 - 2 * (centroids @ centroids.T))) * chord / 2 + 1e-9
        #: Vectors with at least this cosine to their centroid all link with each other.
        self.core = np.cos(np.arccos(least) / 2) + 1e-9

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home, whether in its core, rows by cells: whether home or visited)."""
        cosines = x @ self.centroids.T
        home = cosines.argmax(axis=1)
        every = np.arange(len(x))
        near = cosines[every, home][:, None] - cosines <= self.reach[home]
        near[every, home] = True
        return home, cosines[every, home] >= self.core, near


#: Sides of a group: rim with rim, core with rim, guests with rim, guests with core.
RIM_RIM, CORE_RIM, GUEST_RIM, GUEST_CORE = range(4)
#: Lengths of vectors that get centroids; vectors of further, rarer lengths have one cell a length.
LENGTHS = 16


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, cell_size: int = 4096, block: int = 8192, sample_limit: int = 20_000) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of vectors.

    n_links counts the other rows with a cosine of least or more, component_id is the smallest id reachable by links,
    and kept marks that one. Vectors that are null, empty, zero or hold a null or non-finite number link with nothing;
    so do vectors of different lengths. Repeated rows are copies that link with each other; different vectors under one
    id are vectors of their own. A null id is ignored when the smallest is taken; copies that have no other id are named
    by a hash of the vector. An empty table gives an empty one. Long vectors come in smaller blocks.

    sample_limit bounds the vectors from which the driver takes centroids (fewer if they are long); all are compared.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    spark = vectors.sparkSession
    batches_of(spark)
    v = F.col(vector_col)
    number = F.transform(v, lambda x: x.cast("double"))
    sound = F.coalesce(F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(number, lambda x: x != 0), F.lit(False))
    # minus zero is zero: two vectors that differ in its sign alone are still equal in every product
    table = stored(vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, v).alias("v")).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(1))}), "vectors")
    merged = table.where("v is not null").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("id").alias("id"), F.count("*").alias("copies"))
    # a number of its own for each different vector, which the table keeps: links are between numbers, not hashes
    merged = stored(merged.select(F.monotonically_increasing_id().alias("key"), "h1", "h2", "id", "v", F.size("v").alias("length"), "copies"), "merged")

    cells: dict[int, Cells] = {}
    for r in merged.groupBy("length").count().where(F.col("count") > cell_size).orderBy(F.desc("count"), "length").limit(LENGTHS).collect():
        # cells of cell_size, but no more than twice the root, beyond which finding the cell would cost most of the work
        k = max(1, min(-(-r["count"] // cell_size), int(2 * r["count"] ** 0.5), sample_limit // 8))
        wanted = min(sample_limit, max(2 * k, 64 * k), max(64, 4_000_000 // r.length))
        sample = unit([x.v for x in merged.where(F.col("length") == r.length).orderBy("h1", "h2").limit(wanted).select("v").collect()])
        cells[r.length] = Cells(merged_centroids(sample, min(k, len(sample)), least), least)
    sent = spark.sparkContext.broadcast(cells)

    def parts(batch: pa.RecordBatch, step: int = 4096) -> Iterator[tuple]:
        """(rows, their length, home, core, near) of the vectors (v, length, ...) of a batch by length."""
        lengths = batch.column(1).to_numpy()
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(lengths)
        for n in np.unique(lengths).tolist():
            at = np.nonzero(lengths == n)[0]
            own = sent.value.get(n)
            for i in range(0, len(at), step):
                rows = at[i : i + step]
                if own is None:
                    yield rows, n, np.full(len(rows), -1), np.zeros(len(rows), bool), np.ones((len(rows), 1), bool)
                else:
                    x = flat[(ends[rows] - n)[:, None] + np.arange(n)]
                    yield rows, n, *own.home(unit(x))

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("length", "cell", "own", "core", "guests", "copies", "tie")
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for rows, n, home, core, near in parts(batch):
                copies, key = batch.column(2).to_numpy()[rows], batch.column(3).to_numpy()[rows]
                for c in np.unique(np.concatenate((home, np.nonzero(near.any(axis=0))[0] if n in sent.value else home))).tolist():
                    here = home == c
                    guests = int(near[:, c].sum() - here.sum()) if c >= 0 else 0
                    inner = here & core
                    for column, value in zip(out, (n, c, int(here.sum()), int(inner.sum()), guests, int(copies[inner].sum()), int(key[inner].min()) if inner.any() else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=list(names))

    tallied = merged.select("v", "length", "copies", "key").mapInArrow(tallies, "length long, cell long, own long, core long, guests long, copies long, tie long")
    sums = tallied.groupBy("length", "cell").agg(*(F.sum(c).alias(c) for c in ("own", "core", "guests", "copies")), F.min("tie").alias("tie"))
    plan = {}
    # one row for each cell
    for r in sums.collect():
        size = max(256, min(block, 8_000_000 // max(1, r.length))) if block > 256 else block
        core = r.core if r.core > size else 0
        plan[r.length, r.cell] = (-(-(r.own - core) // size), -(-core // size), -(-r.guests // size), r.copies, r.tie)
    dealt = spark.sparkContext.broadcast(plan)
    kind = merged.schema["v"].dataType

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector for every group of two blocks that its block is in; side 2 is a core vector's own count."""
        for batch in batches:
            h = batch.column(3).to_numpy().view(np.uint64)
            for rows, n, home, core, near in parts(batch, 1000):
                out = []
                for c in np.unique(np.concatenate((home, np.nonzero(near.any(axis=0))[0] if n in sent.value else home))).tolist():
                    rim, cores, guests, copies, tie = dealt.value[n, c]
                    here = home == c
                    inner = here & core if cores else np.zeros(len(rows), bool)
                    others = (near[:, c] & ~here) if c >= 0 else inner & False
                    for some, blocks, groups in (
                        (here & ~inner, rim, [(CORE_RIM, None, cores, 1), (GUEST_RIM, None, guests, 1)]),
                        (inner, cores, [(CORE_RIM, rim, None, 0), (GUEST_CORE, None, guests, 1)]),
                        (others, guests, [(GUEST_RIM, rim, None, 0), (GUEST_CORE, cores, None, 0)]),
                    ):
                        at = np.nonzero(some)[0]
                        if not len(at):
                            continue
                        b = (h[rows[at]] % np.uint64(max(1, blocks))).astype(np.int64)
                        for what, right, left, side in groups:
                            for other in range(right if left is None else left):
                                pair = (b, np.full(len(b), other)) if side == 0 else (np.full(len(b), other), b)
                                out.append((at, np.full(len(at), c), np.full(len(at), what), *pair, np.full(len(at), side), home[at]))
                        if blocks == rim and groups[0][0] == CORE_RIM and groups[0][3] == 1:
                            for other in range(rim):
                                low, high = np.minimum(b, other), np.maximum(b, other)
                                out.append((at, np.full(len(at), c), np.full(len(at), RIM_RIM), low, high, (b > other).astype(np.int64), home[at]))
                        if some is inner:
                            out.append((at, np.full(len(at), c), np.full(len(at), -1), b, b, np.full(len(at), 2), home[at]))
                at, c, what, x, y, side, of = (np.concatenate(z) for z in zip(*out, strict=True))
                for i in range(0, len(at), 2000):
                    s = slice(i, i + 2000)
                    take = pa.array(rows[at[s]])
                    numbers = [pa.array(z[s].astype(np.int32)) for z in (np.full(len(at), n), c, what, x, y, side, of)]
                    yield pa.RecordBatch.from_arrays([*numbers, *(batch.column(k).take(take) for k in (0, 3, 2))], names=["length", "cell", "what", "x", "y", "side", "home", "v", "key", "copies"])

    def products(group: pd.DataFrame) -> pd.DataFrame:
        length, cell, what = (int(group[c].iloc[0]) for c in ("length", "cell", "what"))
        copies, h, side, home = (group[c].to_numpy() for c in ("copies", "key", "side", "home"))
        if what < 0:
            _, _, _, all_, tie = dealt.value[length, cell]
            return pd.DataFrame({"key": h, "n": all_ - copies, "root": np.full(len(h), tie)})
        u = unit(np.stack(group["v"].to_numpy()))
        left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        alone = what == RIM_RIM and int(group["x"].iloc[0]) == int(group["y"].iloc[0])
        if alone:
            right = left
        links, counts = Links(len(u)), np.zeros(len(u), np.int64)
        own = sent.value.get(length)
        # guests are on the left; those at home that visit the guest's cell are credited there
        away = ~own.home(u[right])[2] if what in (GUEST_RIM, GUEST_CORE) and own is not None and len(right) else None
        for i in range(0, len(left), max(1, 4_000_000 // max(1, len(right)))):
            rows = left[i : i + max(1, 4_000_000 // max(1, len(right)))]
            near = u[rows] @ u[right].T >= least
            if alone:
                near &= rows[:, None] != right[None, :]
            counts[rows] += near @ copies[right]
            if not alone:
                back = near if away is None else near & away[:, home[rows]].T
                counts[right] += copies[rows] @ back
            a, b = np.nonzero(near)
            links.union(rows[a], right[b])
        roots = links.roots()
        far = (counts > 0) | (roots != np.arange(len(u)))
        return pd.DataFrame({"key": h[far], "n": counts[far], "root": h[roots[far]]})

    schema = f"length int, cell int, what int, x int, y int, side int, home int, v {kind.simpleString()}, key long, copies long"
    met = merged.select("v", "length", "copies", "key").mapInArrow(visits, schema)
    found = stored(met.groupBy("length", "cell", "what", "x", "y").applyInPandas(products, "key long, n long, root long"), "products")
    counted = found.groupBy("key").agg(F.sum("n").alias("n"))
    groups = components(found, "key", "root").withColumnRenamed("vertex", "key")
    named = merged.select("key", "h1", "h2", "id", "copies").join(counted, "key", "left").join(groups, "key", "left")
    named = stored(named.select("h1", "h2", "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component")), "named")
    least_ids = named.groupBy("component").agg(F.coalesce(F.min("id"), F.min("h1")).alias("component_id"))
    named = stored(named.join(least_ids, "component").select("h1", "h2", "n_links", "component_id"), "components")
    out = joined(table.select("id", "h1", "h2", F.col("v").isNotNull().alias("sound")), named, ["h1", "h2"], "left", 48)
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("id"))
    links_ = F.when(F.col("sound"), F.col("n_links")).otherwise(F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), links_.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
