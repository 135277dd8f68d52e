"""Importance resampling of documents towards a target, by hashed words and word pairs.

Each bucket of hashed features has a gain, the logarithm of its share in the target over its share in all documents;
gains are an array, and a document's weight is the mean of its features' gains. Weight plus a keyed Gumbel variable is
the score, so that the best scores are a draw without replacement in proportion to the weights.

The draw: scored rows are a written table. A bounded sample of their keys cuts the order of scores into ranges, whose
rows are counted exactly, so that the first rank of each range is known and ranges behind the draw are not read again.
Within its partition each task sorts what is left, into a run, and cuts the run at the ranges into segments of arrays.
The segments of a range meet in one task, where a tournament tree merges them and hands out ranks, and stops with the
last one drawn. The sample only balances the ranges: ranks don't depend on it.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, stored

#: Words remembered by a worker before the cache starts anew.
CACHE = 300_000
#: Texts hashed at a time.
ROWS = 64
#: Rows of one range at about, and keys sampled to find the ranges.
RANGE, SAMPLE = 1 << 18, 1 << 17
#: Rows of one segment at most.
SEGMENT = 8192
#: Longest word whose pair is hashed by tables.
LONG = 255


def _byte_classes() -> bytes:
    """Words' bytes for themselves, A-Z in lower case, all else as spaces; bytes from 0x80 on are words'."""
    out = bytearray(b" " * 256)
    for b in itertools.chain(range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
        out[b] = b
    for b in range(0x41, 0x5B):
        out[b] = b + 32
    return bytes(out)


BYTES = _byte_classes()


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, in lower case, digits and all beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(BYTES).split()


@functools.cache
def _shifts() -> np.ndarray:
    """[n, place, byte]: what a byte of a CRC-32 becomes when n bytes follow, for n up to LONG + 1."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0))
    out = np.empty((LONG + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, LONG + 2):
        out[n] = (out[n - 1] >> 8) ^ table[out[n - 1] & 0xFF]
    return out


def _followed(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    t = _shifts()
    return t[n, 0, crc & 0xFF] ^ t[n, 1, (crc >> 8) & 0xFF] ^ t[n, 2, (crc >> 16) & 0xFF] ^ t[n, 3, crc >> 24]


class Words(dict):
    """CRC-32 of words, with their length (LONG + 1 at most) above it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = zlib.crc32(word) | min(len(word), LONG + 1) << 32
        if len(word) <= 64:
            self[word] = found
        return found


def hashed(texts: list[str | None], known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, CRC-32 of all words, CRC-32 of each with its next, which of these pairs are in one text)."""
    words = [words_of(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    packed = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(n.sum()))
    crc, size = (packed & 0xFFFFFFFF).astype(np.uint32), packed >> 32
    pairs, real = np.zeros(len(crc), np.uint32), np.ones(len(crc), bool)
    real[(np.cumsum(n) - 1)[n > 0]] = False
    if len(crc) > 1:
        follow = np.minimum(size[1:], LONG)
        spaced = _followed(np.full(len(follow), zlib.crc32(b" "), np.uint32), follow) ^ crc[1:]
        pairs[:-1] = _followed(crc[:-1], follow + 1) ^ spaced
        for i in np.nonzero(size[1:] > LONG)[0].tolist():
            second = next(itertools.islice(itertools.chain.from_iterable(words), i + 1, None))
            pairs[i] = zlib.crc32(b" " + second, int(crc[i]))
    return n, crc, pairs, real


def counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of the column text fall into each bucket: tasks add up arrays, which meet as a few rows."""
    batches_of(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Words(), np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                _, crc, pairs, real = hashed(batch.column(0).slice(at, ROWS).to_pylist(), known)
                total += np.bincount(crc % buckets, minlength=buckets) + np.bincount(pairs[real] % buckets, minlength=buckets)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # at most one row a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the buckets' smoothed shares in the target over those in the source."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def luck(doc_id, seed: int) -> int:
    """The keyed Gumbel variable of a document, in thousandths; a null doc_id is spelled as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_features, weight, score, tie) of docs (doc_id, text); tie tells equal rows apart."""
    batches_of(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain, tie = Words(), shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, crc, pairs, real = hashed(part.column(1).to_pylist(), known)
                both = gain[crc % len(gain)] + np.where(real, gain[pairs % len(gain)], 0)
                ends = np.cumsum(n)
                sums = np.concatenate(([0], np.cumsum(both)))
                features = np.maximum(2 * n - 1, 0)
                weight = np.where(n > 0, (sums[ends] - sums[ends - n]) // np.maximum(features, 1), 0)
                score = weight + np.array([luck(i, seed) for i in part.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (features, weight, score, np.arange(tie, tie + len(n))))], names=["doc_id", "n_features", "weight", "score", "tie"])
                tie += len(n)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_features long, weight long, score long, tie long")


class Tournament:
    """Merges sorted lists by a tree of losers: an inner node keeps who lost there, so that the next of the winner plays
    again along one path only."""

    END = (math.inf,)

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, self.END) for r in runs]
        self.losers = [0] * max(self.k, 1)
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
        self.best = winners[1] if self.k > 1 else 0

    def __iter__(self) -> Iterator[tuple]:
        heads, losers = self.heads, self.losers
        while self.k and heads[self.best] is not self.END:
            yield heads[self.best]
            best = self.best
            heads[best] = next(self.runs[best], self.END)
            node = (self.k + best) // 2
            while node:
                if heads[losers[node]] < heads[best]:
                    losers[node], best = best, losers[node]
                node //= 2
            self.best = best


def _key() -> list[Column]:
    """The order of the draw as ascending numbers: score from above, doc_id (null ones last), tie."""
    return [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("tie")]


def _places(columns: list[np.ndarray], cuts: list[tuple]) -> np.ndarray:
    """The range of each row: how many of the sorted cuts are at or before its key."""
    n, m = len(columns[0]), len(cuts)
    both = [np.concatenate((c, np.array([x[i] for x in cuts], np.int64))) for i, c in enumerate(columns)]
    order = np.lexsort([np.arange(n + m) < n, *reversed(both)])  # at equal keys a cut stands before the row
    out = np.empty(n + m, np.int64)
    out[order] = np.cumsum(order >= n)
    return out[:n]


def _numbers(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names]


_PARTS = ("k0", "k1", "k2", "k3")
_ARRAYS = (*_PARTS, "n_features", "weight")


def _ranges(rows: DataFrame, n: int, per_range: int) -> list[tuple]:
    """Sorted keys that cut rows into ranges of about so many; the sample is of SAMPLE rows at about, whatever n is."""
    wanted = n // per_range
    if not wanted:
        return []
    sample = sorted(tuple(r) for r in rows.select(*_PARTS).sample(min(1.0, SAMPLE / n), seed=1).collect())
    return sorted({sample[len(sample) * i // (wanted + 1)] for i in range(1, wanted + 1)}) if sample else []


def ranked(rows: DataFrame, n: int, draw: int, per_range: int = RANGE) -> DataFrame:
    """rows (doc_id, n_features, weight, score, tie; n of them, a written table) with rank long: 1 to draw for the best
    scores, ties to the smaller doc_id, null for the others."""
    spark = rows.sparkSession
    keyed = rows.select("*", *(c.alias(k) for c, k in zip(_key(), _PARTS, strict=True)))
    none = F.lit(None).cast("long").alias("rank")
    out = ("doc_id", "n_features", "weight", "score")
    if draw <= 0:
        return rows.select(*out, none)
    cuts = _ranges(keyed, n, per_range)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_places(_numbers(batch, _PARTS), cuts).astype(np.int32))], names=["range"])

    filled = {r.range: r["count"] for r in keyed.select(*_PARTS).mapInArrow(place, "range int").groupBy("range").count().collect()}
    before = [0, *itertools.accumulate(filled.get(i, 0) for i in range(len(cuts) + 1))]
    last = next(i for i in range(len(cuts) + 1) if before[i + 1] >= min(draw, n))
    front = F.lit(True)
    if last < len(cuts):
        front = F.struct(*_PARTS) < F.struct(*(F.lit(x).cast("long").alias(k) for x, k in zip(cuts[last], _PARTS, strict=True)))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs cut at the ranges, and every SEGMENT rows."""
        run, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            columns = _numbers(batch, _ARRAYS)
            at = _places(columns[:4], cuts)
            starts = np.concatenate(([0], np.nonzero(np.diff(at))[0] + 1, [len(at)])).tolist()
            pieces = [(a, min(a + SEGMENT, stop)) for start, stop in itertools.pairwise(starts) for a in range(start, stop, SEGMENT)]
            offsets = pa.array([0, *(b for _, b in pieces)], pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]
            numbers = pa.array(np.arange(number, number + len(pieces)))
            number += len(pieces)
            yield pa.RecordBatch.from_arrays([pa.array(at[[a for a, _ in pieces]].astype(np.int32)), pa.array([run] * len(pieces), pa.int64()), numbers, *arrays], names=["range", "run", "part", *_ARRAYS])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The segments of a range, by run; ranges of a task come one after the other."""
        here, runs = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] != here:
                    yield from settled(here, runs)
                    here, runs = row["range"], {}
                runs.setdefault(row["run"], []).append([np.array(row[n], np.int64) for n in _ARRAYS])
        yield from settled(here, runs)

    def settled(here: int | None, runs: dict) -> Iterator[pa.RecordBatch]:
        if here is None:
            return
        lists = [[np.concatenate(c).tolist() for c in zip(*parts, strict=True)] for parts in runs.values()]
        merged = iter(Tournament([zip(*columns, strict=True) for columns in lists]))
        taken = list(itertools.islice(merged, max(0, draw - before[here])))
        rank = [before[here] + i for i in range(1, len(taken) + 1)]
        left = list(itertools.chain.from_iterable(zip(*c, strict=True) for c in lists)) if len(taken) < sum(len(c[0]) for c in lists) else []
        if left:  # the tournament stopped: the others of this range have no rank
            drawn = {t[:4] for t in taken}
            left = [t for t in left if t[:4] not in drawn]
        rows_ = taken + left
        ids, ranks = [None if t[1] else t[2] for t in rows_], rank + [None] * len(left)
        columns = [ids, [t[4] for t in rows_], [t[5] for t in rows_], [-t[0] for t in rows_], ranks]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*out, "rank"])

    kind = "range int, run long, part long, " + ", ".join(f"{n} array<long>" for n in _ARRAYS)
    runs = keyed.where(front).select(*_ARRAYS).sortWithinPartitions(*_PARTS).mapInArrow(segments, kind)
    dealt = runs.repartitionById(last + 1, "range").sortWithinPartitions("range", "run", "part")
    drawn = dealt.mapInArrow(merge, "doc_id long, n_features long, weight long, score long, rank long")
    return drawn.unionByName(keyed.where(~front).select(*out, none)) if last < len(cuts) else drawn


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, per_range: int = RANGE) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), all long, of every row of docs (doc_id, text); target has a column text.

    Of the rows with least_words words or more percent in 100, rounded down, are drawn and have ranks 1, 2, 3...; ties
    go to the smaller doc_id (null last), and equal rows get ranks of their own. A null text has no words: no features,
    weight 0, and it is never drawn; its score is its luck alone. A null doc_id is spelled as nothing in the hash.
    Features are counted over whole texts of all rows. An empty target or table is no error. Other columns are dropped,
    whatever their names. doc_id has to be a number or null. The driver keeps one number for each bucket and range.
    """
    gain = gains(counts(docs, buckets), counts(target, buckets))
    table = stored(scored(docs, gain, seed), "scored")
    enough = F.col("n_features") >= 2 * least_words - 1
    n = table.where(enough).count()
    drawn = ranked(table.where(enough), n, percent * n // 100, per_range)
    return drawn.unionByName(table.where(~enough).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
