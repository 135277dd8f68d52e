"""Substring search through an index of n-grams.

Every run of three characters of a text leads to the texts that have it. The lists are a table sorted by gram, so that
Parquet's statistics lead a search to the few row groups with its grams, and texts are kept in parts by a hash of their
identifier. A search takes the rarest grams of what it looks for, intersects their lists from the rarest on, and reads
only the parts in which candidates are; each candidate is then looked at itself, so that the result is that of a scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import dealt, stored

#: Characters of a gram; shorter texts are looked for by a scan.
GRAM = 3
#: Lists intersected at most: the others would rule out few more candidates than looking at them.
LISTS = 4
#: Rows, and characters of them, whose grams are gathered before they are passed on; and characters looked at at once.
ROWS, GATHERED, CHARACTERS = 2048, 8_000_000, 1_000_000
#: Identifiers of lists that weigh in a shuffle as much as a short row.
IDS = 10


def grams_of(text: str | None) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)} if text else set()


def _runs(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """(start, number) of runs of rows whose texts have sizes characters: as many as are gathered, one at least."""
    start = gathered = at = 0
    for at, size in enumerate(sizes):
        if at > start and (at - start == ROWS or gathered + size > GATHERED):
            yield start, at - start
            start, gathered = at, 0
        gathered += size
    yield start, at + 1 - start


def _pieces(texts: list[tuple[int, str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The characters of texts (row, text) in arrays of bounded length, the row of each, and where a gram of its text
    begins. A longer text goes on two characters before its last piece ended."""
    cut = [(row, text[i : i + CHARACTERS + GRAM - 1]) for row, text in texts for i in range(0, len(text) - GRAM + 1, CHARACTERS)]
    at = 0
    while at < len(cut):
        end, size = at, 0
        while end < len(cut) and size < CHARACTERS:
            size += len(cut[end][1])
            end += 1
        sizes = np.fromiter((len(t) for _, t in cut[at:end]), np.int64, end - at)
        signs = np.frombuffer("".join(t for _, t in cut[at:end]).encode("utf-32-le"), np.uint32)
        begins = np.ones(size, bool)
        ends = np.cumsum(sizes)
        for back in range(1, GRAM):
            begins[ends - back] = False
        yield signs, np.repeat(np.fromiter((r for r, _ in cut[at:end]), np.int64, end - at), sizes), begins
        at = end


def _lists_of(texts: list[tuple[int, str]], rows: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Grams of texts (row below rows, text), the number of rows that have each, and these rows, gram by gram.

    A gram and its row are one number, with characters numbered among those there are, so that sorting numbers brings
    them together. Where characters are too many for that, fewer rows are taken."""
    there = np.zeros(0x110000, bool)
    for signs, _, _ in _pieces(texts):
        there[signs] = True
    known = np.flatnonzero(there)
    bits = max(rows - 1, 0).bit_length()
    if len(known) ** GRAM << bits >= 1 << 63:
        half = 1 << bits - 1
        yield from _lists_of([x for x in texts if x[0] < half], half)
        for grams, sizes, own in _lists_of([(r - half, t) for r, t in texts if r >= half], rows - half):
            yield grams, sizes, own + half
        return
    number = np.cumsum(there) - 1
    found = []
    for signs, own, begins in _pieces(texts):
        codes = number[signs]
        grams = codes[: len(codes) - GRAM + 1]
        for i in range(1, GRAM):
            grams = grams * len(known) + codes[i : len(codes) - GRAM + 1 + i]
        begins = begins[: len(grams)]
        found.append(_different((grams[begins] << bits) + own[: len(grams)][begins]))
    if not found:
        return
    both = _different(np.concatenate(found)) if len(found) > 1 else found[0]
    grams = both >> bits
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    own = grams[first]
    signs = np.empty((len(own), GRAM), np.uint32)
    for i in reversed(range(GRAM)):
        own, signs[:, i] = own // len(known), known[own % len(known)]
    text = signs.tobytes().decode("utf-32-le")
    yield [text[i : i + GRAM] for i in range(0, len(text), GRAM)], np.diff(np.append(first, len(both))), both & ((1 << bits) - 1)


def _different(numbers: np.ndarray) -> np.ndarray:
    """The different numbers, sorted."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate(([True], numbers[1:] != numbers[:-1]))] if len(numbers) else numbers


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")


@dataclass
class GramIndex:
    """An index in the folder path over some text columns; lower looks at texts in lower case."""

    spark: SparkSession
    path: str
    columns: list[str]
    lower: bool
    parts: int

    @classmethod
    def build(cls, rows: DataFrame, path: str, columns: list[str], lower: bool = False, parts: int = 64) -> GramIndex:
        """Writes the index of rows (id and text columns) to path, a new folder that all executors reach.

        parts should be such that a part has some hundred megabytes; a larger one is written by several tasks.

        Null texts have no grams; repeated rows and identifiers are kept as they are. Texts are taken whole. A gram that
        very many texts have is a list in many pieces, which sorting deals over many files.
        """
        spark = rows.sparkSession
        texts = rows.select("id", *columns, _part(parts).alias("part"))
        texts.hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/texts")
        # the written parts are read by many tasks, whatever files rows came in
        written = spark.read.schema(texts.schema).parquet(f"{path}/texts")
        seen = written.select("id", *((F.lower(c) if lower else F.col(c)).alias(c) for c in columns))
        kind = T.StructType([T.StructField("gram", T.StringType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("n", T.IntegerType())])

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at, number in _runs(map(sum, zip(*(pc.fill_null(pc.utf8_length(c), 0).to_pylist() for c in whole.columns[1:]), strict=True))):
                    batch = whole.slice(at, number)
                    texts = [(i, text) for c in batch.columns[1:] for i, text in enumerate(c.to_pylist()) if text and len(text) >= GRAM]
                    for found, sizes, own in _lists_of(texts, batch.num_rows):
                        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), batch.column(0).take(pa.array(own)))
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), ids, pa.array(sizes.astype(np.int32))], names=kind.names)

        found = stored(seen.mapInArrow(lists, kind), "lists")
        # a list in many pieces is dealt by a hash of each piece too
        with dealt(spark, (found.agg(F.sum("n")).first()[0] or 0) // IDS):
            found.repartitionByRange("gram", F.xxhash64("ids")).sortWithinPartitions("gram").write.parquet(f"{path}/lists")
        return cls(spark, path, list(columns), lower, parts)

    def _lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def _has(self, text: str) -> Column:
        out = F.lit(False)
        for c in self.columns:
            seen = F.lower(c) if self.lower else F.col(c)
            out = out | F.coalesce(seen.contains(F.lower(F.lit(text)) if self.lower else F.lit(text)), F.lit(False))
        return out

    def rarest(self, text: str) -> list[tuple[str, int]] | None:
        """The grams that a search for text would use, rarest first, with the number of texts that have them; None where
        only a scan can answer."""
        seen = self.spark.range(1).select(F.lower(F.lit(text)) if self.lower else F.lit(text)).first()[0]
        wanted = sorted(grams_of(seen))
        if not wanted:
            return None
        counted = self._lists().where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n").alias("n"))
        n = {r.gram: r.n for r in counted.collect()}  # one row for each gram of text
        return sorted(((g, n.get(g, 0)) for g in wanted), key=lambda x: (x[1], x[0]))[:LISTS]

    def candidates(self, rarest: list[tuple[str, int]]) -> DataFrame:
        """(part, id) of texts that have all these grams."""
        lists = [self._lists().where(F.col("gram") == g).select(F.explode("ids").alias("id")) for g, _ in rarest]
        out = lists[0].distinct()
        for more in lists[1:]:
            out = out.alias("a").join(more.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")), "left_semi")
        return out.select(_part(self.parts).alias("part"), "id")

    def search(self, text: str) -> DataFrame:
        """Rows (id and the text columns) with text in one of the columns."""
        texts = self.spark.read.parquet(f"{self.path}/texts")
        rarest = self.rarest(text)
        if rarest is not None:
            if not all(n for _, n in rarest):
                return texts.limit(0).select("id", *self.columns)
            found = stored(self.candidates(rarest), "candidates")
            parts = [r.part for r in found.select("part").distinct().collect()]  # at most one row for each part
            same = (texts["part"] == found["part"]) & texts["id"].eqNullSafe(found["id"])
            texts = texts.where(F.col("part").isin(parts)).join(found, same, "left_semi")
        return texts.where(self._has(text)).select("id", *self.columns)
