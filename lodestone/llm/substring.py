"""Substring deduplication with a log-structured index of window fingerprints.

A batch of documents becomes one immutable run: for each document the winnowed anchors of its word windows (the
smallest word gram of every window, one row for all consecutive windows that share it), in files sorted by anchor, and
the sorted anchors with their counts. A new run is merge-joined with the anchors of the older runs; when there are more
than fanout lists of anchors they are compacted into one. Windows whose anchor is met only once cannot be repeated, so
that a few rows for each hundred words are moved instead of one for each.

Anchors that are met again are verified: a whole stretch of windows at once by the hash of all its words; where
stretches differ (the edges of a shared passage) window by window. Two stretches are taken for equal if anchor and hash,
128 bits, are; words are not compared. For 10^12 stretches the odds of one wrong pair are about 10^-15.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, batches_of, release, stored, temporary, unused, with_keys
from .windows import BASES, WordHashes, anchors, mixed, prefix, span_hashes, words_of

#: A place packs the first window of a stretch and its last one's distance from it.
SPAN_BITS = 8
ROW = "kd long, tag int, a long, b long, place long"
SCHEMAS = {"run": ROW, "keys": "a long, n long", "repeated": "a long"}
MANIFEST = "version long, window int, gram int, fanout int, run array<string>, keys array<string>, repeated array<string>"


def anchor_rows(keyed: DataFrame, text_col: str, window: int, gram: int) -> DataFrame:
    """One row for each stretch of windows with one anchor: a the anchor, b the hash of all the stretch's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out, sizes = [], []
            for text in batch.column(2).to_pylist():
                sums = [prefix(ids, w) for w, ids in enumerate(hashes.of(words_of(text)))]
                a, at, first, last = anchors(sums[0], window, gram)
                sizes.append(len(a))
                if len(a):
                    b = span_hashes(sums[1], 1, first, last + window) ^ mixed(((at - first) * 64 + last - first + 1).astype(np.uint64))
                    out.append((a.view(np.int64), b.view(np.int64), (first << SPAN_BITS) + last - first))
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), *map(pa.array, columns)], names=["kd", "tag", "a", "b", "place"])

    return keyed.select("kd", "tag", text_col).mapInArrow(run, ROW)


class FingerprintIndex:
    """Immutable runs of window fingerprints; grows batch by batch.

    The runs, the lists of anchors and the anchors met again are tables below folder. After each batch a manifest names
    those in force, as a new version: a job that fails leaves the last version as it was, and a later session opens the
    index with open(). Without a folder one in the shared folder is taken.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = 35, gram: int = 12, fanout: int = 4):
        if not 0 < gram <= window or window - gram >= 1 << SPAN_BITS:
            raise ValueError("gram must be from 1 to window, and window - gram under 256")
        self.spark, self.folder = spark, (folder or temporary(spark, "index")).rstrip("/")
        self.window, self.gram, self.fanout, self.version = window, gram, fanout, 0
        #: Names of the tables in force.
        self.tables: dict[str, list[str]] = {"run": [], "keys": [], "repeated": []}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that an earlier job left in folder, at its newest version."""
        last = spark.read.schema(MANIFEST).json(f"{folder.rstrip('/')}/manifest").orderBy(F.desc("version")).first()
        if last is None:
            raise ValueError(f"there is no index in {folder}")
        out = cls(spark, folder, last.window, last.gram, last.fanout)
        out.version, out.tables = last.version, {k: list(last[k]) for k in out.tables}
        return out

    def _write(self, kind: str, df: DataFrame, sort: bool = True) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        (df.sortWithinPartitions("a") if sort else df).write.parquet(f"{self.folder}/{name}")
        return name

    def _read(self, kind: str) -> list[DataFrame]:
        return [self.spark.read.schema(SCHEMAS[kind]).parquet(f"{self.folder}/{name}") for name in self.tables[kind]]

    def _commit(self) -> None:
        self.version += 1
        row = (self.version, self.window, self.gram, self.fanout, *(self.tables[k] for k in ("run", "keys", "repeated")))
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Writes the run of a batch, merge-joins it with the history, and compacts when lists of anchors pile up."""
        batches_of(docs.sparkSession)
        name = self._write("run", anchor_rows(with_keys(docs.select(id_col, text_col), id_col, text_col), text_col, self.window, self.gram))
        run = self.spark.read.schema(SCHEMAS["run"]).parquet(f"{self.folder}/{name}")
        own = self._write("keys", run.groupBy("a").agg(F.count("*").alias("n")))
        keys = self.spark.read.schema(SCHEMAS["keys"]).parquet(f"{self.folder}/{own}")
        met = [keys.where("n > 1").select("a"), *(keys.join(old.hint("merge"), "a").select("a") for old in self._read("keys"))]
        self.tables["repeated"].append(self._write("repeated", reduce(DataFrame.unionByName, met), sort=False))
        self.tables["run"].append(name)
        self.tables["keys"].append(own)
        if len(self.tables["keys"]) > self.fanout:
            self._compact()
        self._commit()

    def _compact(self) -> None:
        """One sorted list of anchors instead of many; the rows of the runs stay where they are."""
        whole = reduce(DataFrame.unionByName, self._read("keys")).groupBy("a").agg(F.sum("n").alias("n"))
        repeated = self._write("repeated", reduce(DataFrame.unionByName, self._read("repeated")).distinct(), sort=False)
        self.tables |= {"keys": [self._write("keys", whole)], "repeated": [repeated]}

    def spans(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(kd, tag, spans): in each text of docs the words from start to stop of all repeated windows, merged.

        docs are the texts of all batches. Only those that share an anchor with others are read as words again, for the
        edges of shared passages; so after a new batch its texts and the ones they meet are.
        """
        spark, window = docs.sparkSession, self.window
        repeated = stored(reduce(DataFrame.unionByName, self._read("repeated")).distinct(), "repeated")
        release(spark)
        # what the bit set lets through beside repeated anchors has one stretch, and so stays single below
        found = stored(_where_in(reduce(DataFrame.unionByName, self._read("run")), key_bits(repeated, ["a"]), ["a"]), "found")
        blocks = stored(found.groupBy("a", "b").agg(F.count("*").alias("n")), "blocks")
        release(spark, repeated)
        # whole stretches met again
        again = stored(blocks.where("n > 1").select("a", "b"), "again")
        whole = _where_in(found, key_bits(again, ["a", "b"]), ["a", "b"]).join(again.hint("merge"), ["a", "b"], "left_semi")
        span = F.col("place").bitwiseAND((1 << SPAN_BITS) - 1)
        first = F.shiftright("place", SPAN_BITS)
        whole = stored(whole.select("kd", "tag", _packed(first, span + window).alias("x")), "whole")
        # stretches that differ under one anchor show their windows
        mixed_up = stored(blocks.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1").select("a"), "mixed")
        bits = key_bits(mixed_up, ["a"])
        holders = key_bits(_where_in(found, bits, ["a"]).select("kd", F.col("tag").cast("long").alias("tag")).distinct(), ["kd", "tag"])
        release(spark, found, again, blocks)
        keyed = with_keys(docs.select(id_col, text_col), id_col, text_col)
        lists = stored(self._window_lists(keyed.select("kd", F.col("tag").cast("long").alias("tag"), text_col), bits, holders), "windows")
        each = lists.select("a", F.explode("hashes").alias("w"))
        twice = stored(each.groupBy("a", "w").agg(F.count("*").alias("n")).where("n > 1").select("a", "w"), "twice")
        release(spark, mixed_up)
        edges = _windows_in(lists, key_bits(twice, ["a", "w"]), window).join(twice.hint("merge"), ["a", "w"], "left_semi")
        packed = whole.unionByName(edges.select("kd", "tag", "x"))
        spans = stored(packed.groupBy("kd", "tag").agg(F.collect_set("x").alias("x")).mapInArrow(_merge, "kd long, tag int, spans array<struct<start: long, stop: long>>"), "spans")
        release(spark, whole, lists, twice)
        return spans

    def _window_lists(self, keyed: DataFrame, bits: np.ndarray, holders: np.ndarray) -> DataFrame:
        """(kd, tag, a, first, hashes): the window hashes of each stretch whose anchor is in bits, of rows in holders."""
        window, gram = self.window, self.gram
        sent, asked_for = (keyed.sparkSession.sparkContext.broadcast(x) for x in (bits, holders))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                batch = batch.filter(pa.array(in_bits(asked_for.value, _key(batch, ["kd", "tag"]))))
                sizes, rows, firsts, lengths, flat = [], [], [], [], []
                for text in batch.column(2).to_pylist():
                    ids = hashes.of(words_of(text))
                    a, _, first, last = anchors(prefix(ids[0], 0), window, gram)
                    asked = in_bits(sent.value, mixed(a)) if len(a) else np.zeros(0, bool)
                    a, first, last = a[asked], first[asked], last[asked]
                    sizes.append(len(a))
                    if len(a):
                        n = last - first + 1
                        starts = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                        flat.append(span_hashes(prefix(ids[1], 1), 1, starts, starts + window).view(np.int64))
                        rows.append(a.view(np.int64))
                        firsts.append(first)
                        lengths.append(n)
                take = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
                rows, firsts, lengths, flat = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, firsts, lengths, flat))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take).cast(pa.int32()), pa.array(rows), pa.array(firsts), lists], names=["kd", "tag", "a", "first", "hashes"])

        return keyed.mapInArrow(run, "kd long, tag int, a long, first long, hashes array<long>")


#: Bits of a filter: 16 for each key, within these bounds and as a power of two. A fuller filter lets more rows through,
#: which exact joins and counts then find to be single; it never hides one.
LEAST_BITS, MOST_BITS, CHUNK_BITS = 16, 29, 16


def _key(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """One well spread number for each row's key; anchors themselves lie close to zero, being the least of many."""
    out = np.zeros(batch.num_rows, np.uint64)
    for c in columns:
        out = mixed(out * np.uint64(BASES[0]) + batch.column(batch.schema.get_field_index(c)).to_numpy().view(np.uint64))
    return out


def key_bits(keys: DataFrame, columns: list[str]) -> np.ndarray:
    """A bit set of the keys, packed in bytes; of bounded size."""
    log = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_key(batch, columns) >> np.uint64(64 - log)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> CHUNK_BITS), pa.array((at & ((1 << CHUNK_BITS) - 1)).astype(np.int32))], names=["chunk", "bit"])

    def pack(group):
        import pandas as pd

        bits = np.zeros(1 << CHUNK_BITS, np.uint8)
        bits[group["bit"].to_numpy()] = 1
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(1 << (log - 3), np.uint8)
    size = 1 << (CHUNK_BITS - 3)
    # a chunk has at most 2**CHUNK_BITS different bits
    for r in keys.select(*columns).mapInArrow(run, "chunk long, bit int").distinct().groupBy("chunk").applyInPandas(pack, "chunk long, bits binary").collect():
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def in_bits(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _where_in(rows: DataFrame, bits: np.ndarray, columns: list[str]) -> DataFrame:
    """rows whose key is in bits, with a few others."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bits(sent.value, _key(batch, columns))))

    return rows.mapInArrow(run, rows.schema)


def _windows_in(lists: DataFrame, bits: np.ndarray, window: int) -> DataFrame:
    """(kd, tag, a, w, x) of the single windows in lists whose key (a, w) is in bits, with a few others."""
    sent = lists.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(batch.schema.get_field_index("hashes"))
            n = np.diff(hashes.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), n)
            flat = hashes.flatten()
            a = batch.column(batch.schema.get_field_index("a")).take(pa.array(row))
            keep = np.nonzero(in_bits(sent.value, _key(pa.RecordBatch.from_arrays([a, flat], names=["a", "w"]), ["a", "w"])))[0]
            at = batch.column(batch.schema.get_field_index("first")).to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            take = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), a.take(pa.array(keep)), flat.take(pa.array(keep)), pa.array(at[keep] * 4096 + window)], names=["kd", "tag", "a", "w", "x"])

    return lists.mapInArrow(run, "kd long, tag int, a long, w long, x long")


def _packed(start, length):
    return start * 4096 + length


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted, merged spans of each row."""
    for batch in batches:
        out = []
        for packed in batch.column(2).to_pylist():
            x = np.sort(np.array(packed, np.int64))
            start, stop = x >> 12, np.maximum.accumulate((x >> 12) + (x & 4095))
            new = np.concatenate(([True], start[1:] > stop[:-1]))
            out.append([{"start": int(i), "stop": int(j)} for i, j in zip(start[new], stop[np.concatenate((np.nonzero(new)[0][1:] - 1, [len(x) - 1]))], strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["kd", "tag", "spans"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, batches: int = 2) -> DataFrame:
    """docs with kept_text, n_words, n_removed, removed_spans and kept_sha256.

    Words are runs of anything but ASCII white space. A word goes if a window of that many consecutive words that
    covers it starts anywhere else too, in the same text or another; all occurrences go. kept_text is the text itself
    if nothing goes, else the words left, joined by one space; kept_sha256 is of the words left joined by one space in
    any case. Null texts have no words and a null kept_text; shorter texts keep all words. Repeated rows are copies of
    each other. Columns named like the new ones are replaced, others pass through.

    The table is indexed in that many batches, each merge-joined with those before it.
    """
    index = FingerprintIndex(docs.sparkSession, window=window)
    for i in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)) == i), id_col, text_col)
    spans = index.spans(docs, id_col, text_col)
    *keys, own = unused(docs, "_kd", "_tag", "_spans")
    keyed = with_keys(docs, id_col, text_col, tuple(keys)).join(spans.toDF(*keys, own).hint("shuffle_hash"), keys, "left")
    return removed(keyed.drop(*keys), text_col, own)


def removed(docs: DataFrame, text_col: str, spans_col: str) -> DataFrame:
    """Applies the column spans_col, which goes, to the texts."""
    pairs = docs.withColumn(spans_col, F.struct(F.col(text_col).alias("text"), F.col(spans_col).alias("spans")))

    def compute(rows: list) -> list[list]:
        out = []
        for row in rows:
            text, spans = row["text"], row["spans"] or []
            words = words_of(text)
            kept = words
            if spans:
                edges = [0, *(x for s in spans for x in (s["start"], s["stop"])), len(words)]
                kept = [w for i, j in zip(edges[::2], edges[1::2], strict=True) for w in words[i:j]]
            whole = b" ".join(kept)
            out.append((whole.decode("utf-8", "surrogatepass") if spans else text, len(words), len(words) - len(kept), spans, hashlib.sha256(whole).hexdigest()))
        return [list(c) for c in zip(*out, strict=True)] if out else [[]] * 5

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    new = [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", span), T.StructField("kept_sha256", T.StringType())]
    return append_columns(pairs, spans_col, new, compute).drop(spans_col)
