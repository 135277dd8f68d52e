"""SimHash near-duplicates: fingerprints are dealt to the leaves of a vantage-point tree and joined leaf by leaf.

A small tree over a bounded sample of the distinct fingerprints divides Hamming space: at each node fingerprints nearer
to the vantage point than a radius go in, the others out. Every fingerprint is at home in one leaf and visits each other
leaf that its ball of max_bits can reach by the triangle bound, so every pair meets in a leaf. A leaf is one group of a
shuffle; within it the same division goes on until blocks are small enough for direct comparison. A leaf returns a
spanning star for each of its local groups, never all pairs, and the stars are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, shared_dir, stored
from .components import Links, components

#: Shingles hashed at once for the bits of a batch of documents.
CHUNK = 200_000


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each run of size words, with A-Z lowered; fewer words give one hash, none gives no hash."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(whole, seed)]
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return [h(whole[i:j], seed) for i, j in zip(starts[: len(words) - size + 1].tolist(), stops[size - 1 :].tolist(), strict=True)]


def fingerprints_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of counts[i] hashes: the bits set in over half of them; an empty run gives 0."""
    sums = np.zeros((len(counts), 64), np.int64)
    ends = np.cumsum(counts)
    first = 0
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = int(np.searchsorted(ends, at, side="right"))
        last = int(np.searchsorted(ends, at + len(part), side="left"))
        docs = np.arange(first, last + 1)
        docs = docs[counts[docs] > 0]
        begin = np.maximum(ends[docs] - counts[docs] - at, 0)
        sums[docs] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, and the columns of keep): fp is the fingerprint as a signed long."""
    batches_of(docs.sparkSession)
    more = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = [], []
            for text in batch.column(1).to_pylist():
                own = shingle_hashes(text, size)
                hashes.append(np.array(own, np.uint64))
                counts.append(len(own))
            fp = fingerprints_of(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(counts, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], names=["id", "fp", *keep])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("fp", T.LongType()), *more])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *keep).mapInArrow(run, schema)


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, leaves: int, max_bits: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (vantage, radius, inner, outer); a negative child -1-k is leaf k. A leaf ends where sample or leaves do.

    Of a few vantage points and radii it takes those that copy the fewest fingerprints for the division they bring.
    """
    nodes: list[tuple] = []
    n_leaves = 0
    least = max(8, len(sample) // max(1, leaves))

    def grow(points: np.ndarray) -> int:
        nonlocal n_leaves
        best = None
        if len(points) > least:
            for vantage in points[rng.choice(len(points), min(12, len(points)), replace=False)]:
                d = distance(points, vantage).astype(int)
                for radius in np.unique(np.quantile(d, (0.15, 0.3, 0.4, 0.5, 0.6), method="nearest")):
                    inner = (d < radius).mean()
                    if not 0 < inner < 1:
                        continue
                    both = ((d - max_bits < radius) & (d + max_bits >= radius)).mean()
                    gain = -(inner * np.log2(inner) + (1 - inner) * np.log2(1 - inner))
                    cost = np.log2(1 + both) / gain
                    if best is None or cost < best[0]:
                        best = (cost, vantage, int(radius), d)
        if best is None:
            n_leaves += 1
            return -n_leaves
        _, vantage, radius, d = best
        at = len(nodes)
        nodes.append(())
        nodes[at] = (vantage, radius, grow(points[d < radius]), grow(points[d >= radius]))
        return at

    grow(sample)
    return nodes


def route(nodes: list[tuple], fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, position in fps, at home?) of every visit."""
    out = []

    def walk(node: int, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if node < 0 or not nodes:
            out.append((np.full(len(at), -1 - node if nodes else 0), at, home))
            return
        vantage, radius, inner, outer = nodes[node]
        d = distance(fps[at], vantage).astype(np.int16)
        for child, may, own in ((inner, d - max_bits < radius, d < radius), (outer, d + max_bits >= radius, d >= radius)):
            walk(child, at[may], home[may] & own[may])

    walk(0, np.arange(len(fps)), np.ones(len(fps), bool))
    leaf, at, home = zip(*out, strict=True) if out else ([], [], [])
    return (np.concatenate(leaf), np.concatenate(at), np.concatenate(home)) if out else (np.zeros(0, int),) * 2 + (np.zeros(0, bool),)


def link_block(links: Links, fps: np.ndarray, asks: np.ndarray, homes: np.ndarray, max_bits: int, depth: int = 0) -> None:
    """Links every position of asks with those of homes within max_bits; goes on dividing while blocks are large."""
    if not len(asks) or not len(homes):
        return
    if len(homes) > 192 and depth < 40:
        d_homes = distance(fps[homes], fps[homes[0]]).astype(np.int16)
        radius = int(np.median(d_homes))
        inner = d_homes < radius
        if inner.any() and not inner.all():
            d_asks = distance(fps[asks], fps[homes[0]]).astype(np.int16)
            link_block(links, fps, asks[d_asks - max_bits < radius], homes[inner], max_bits, depth + 1)
            link_block(links, fps, asks[d_asks + max_bits >= radius], homes[~inner], max_bits, depth + 1)
            return
    step = max(1, 2_000_000 // len(homes))
    for i in range(0, len(asks), step):
        part = asks[i : i + step]
        x, y = np.nonzero(distance(fps[part][:, None], fps[homes][None, :]) <= max_bits)
        x, y = part[x], homes[y]
        differ = x != y
        if differ.any():
            links.union(x[differ], y[differ])


def link_fingerprints(distinct: DataFrame, max_bits: int = 2, leaf_size: int = 4096, sample_limit: int = 65_536) -> DataFrame:
    """Stars (a, b) over the column fp of distinct that connect just what links of at most max_bits connect.

    sample_limit bounds the fingerprints from which the driver draws the tree; all are routed and compared.
    """
    n = distinct.count()
    leaves = -(-n // leaf_size)
    wanted = min(sample_limit, 64 * leaves)
    drawn = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(wanted).collect() if leaves > 1 else []
    sample = np.sort(np.array([r.fp for r in drawn], np.int64).view(np.uint64))
    nodes = build_tree(sample, leaves, max_bits, np.random.default_rng(7))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            leaf, at, home = route(nodes, fps, max_bits)
            for i in range(0, len(leaf), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[part].astype(np.int32)), pa.array(fps[at[part]].view(np.int64)), pa.array(home[part])], names=["leaf", "fp", "home"])

    def stars(group: pd.DataFrame) -> pd.DataFrame:
        fps = group["fp"].to_numpy().view(np.uint64)
        links = Links(len(fps))
        at = np.arange(len(fps))
        link_block(links, fps, at, at[group["home"].to_numpy()], max_bits)
        roots = links.roots()
        far = np.nonzero(roots != at)[0]
        return pd.DataFrame({"a": fps[far].view(np.int64), "b": fps[roots[far]].view(np.int64)})

    visited = distinct.select("fp").mapInArrow(visits, "leaf int, fp long, home boolean")
    return visited.groupBy("leaf").applyInPandas(stars, "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, size: int = 3, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(id, fp, and the columns of keep) of every row of docs, and (fp, first, component) of every fingerprint.

    first is the smallest id of the fingerprint, component the smallest fingerprint of its group, which is never null.
    Both are written tables.
    """
    shared_dir(docs.sparkSession)
    prints = stored(with_fingerprints(docs, id_col, text_col, size, keep), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    groups = components(link_fingerprints(distinct, max_bits)).withColumnRenamed("vertex", "fp")
    return prints, stored(distinct.join(groups, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, size: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs.

    Null or blank texts have fingerprint zero and link like any other; shorter texts have one shingle. Repeated rows
    are returned as often as they occur. A null id is ignored when the smallest id of a component is taken; a component
    of null ids alone has a null component_id. An empty table gives an empty one. Other columns are not used.
    """
    prints, groups = grouped(docs, id_col, text_col, max_bits, size)
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stored(groups.join(least, "component").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
