"""Harmonic packing of tokenised documents into sequences of one capacity.

A document is cut into whole sequences and a tail. Tails are divided by reciprocal capacity: class k has the tails of
more than 1/(k+1) and at most 1/k of a sequence, and each of its bins takes k of them. What is then left of a bin is
filled by cutting the next document, so that a bin takes a fixed number of tails and is full nevertheless. Every task
packs the rows it reads, without regard to others: there is no shuffle, and a lost task packs its rows again. What is
left in the bins when the rows end is laid end to end; the last, shorter stretch becomes sequences whose lengths are
powers of two.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batches_of

#: Words remembered by a worker before the cache starts anew.
CACHE = 400_000
#: Rows tokenised at a time.
ROWS = 64

# How a tokenizer drops white space and divides the rest, as its file states it.
SPACE = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _stands_for_bytes() -> dict[int, int]:
    """Signs that stand for bytes in the vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(others)}


class Words(dict):
    """Identifiers of the words that the tokenizer divides a text into, as little-endian unsigned 32-bit numbers."""

    SIGNS = _stands_for_bytes()

    def __init__(self, tokenizer: Tokenizer):
        self.model = tokenizer.model

    def __missing__(self, word: str) -> bytes:
        tokens = self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.SIGNS))
        found = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found


class Plain:
    """Texts of a tokenizer that drops white space and divides the rest by WORDS.

    Signs below U+0180 but controls have the same normal form and lower case everywhere, and no marks combine among them:
    texts of such signs are divided here. Of other texts the runs between ASCII white space are taken one by one, since
    no token and no normalisation reaches over it, and those of other signs are left to the tokenizer.
    """

    SIGNS = re.compile(r"[\t-\r\x20-\x7E\xA0-ſ]*")
    LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
    #: WORDS for these signs.
    SPLIT = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{LETTERS}{NUMBERS}]+")

    def __init__(self, tokenizer: Tokenizer, special: list[str]):
        self.tokenizer, self.special, self.words = tokenizer, special, Words(tokenizer)

    def _is_plain(self, text: str) -> bool:
        return self.SIGNS.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _divided(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.SPLIT.findall(text.lower())))

    def ids(self, text: str) -> bytes:
        if self._is_plain(text):
            return self._divided(text)
        out = []
        for run in text.encode("utf-8", "replace").split():
            run = run.decode("utf-8", "replace")
            out.append(self._divided(run) if self._is_plain(run) else np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes())
        return b"".join(out)


class Encoder:
    """Identifiers of texts by a tokenizer file, without special tokens of its own."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.tokenizer = Tokenizer.from_str(text)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        drops = steps == [{"type": "NFC"}, SPACE, {"type": "Lowercase"}] and split == {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
        self.plain = Plain(self.tokenizer, special) if drops and not any(any(c.isspace() for c in s) for s in special) else None

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if self.plain is not None:
            return [self.plain.ids(t or "") for t in texts]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


_encoders: dict[bytes, Encoder] = {}


def encoder(text: str) -> Encoder:
    """The encoder of a tokenizer file's text, one a worker; another file gets another one."""
    key = hashlib.sha256(text.encode()).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(text)
    return _encoders[key]


class Bins:
    """Bins of one task; pieces are (document, start, length), sequences lists of pieces.

    It keeps less than one sequence for each class, of which there are about twice the square root of the capacity.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.classes: dict[int, list] = {}
        #: The bin that has all its tails and is filled by cutting, and its room.
        self.filling: list = []
        self.room = 0

    def add(self, doc, length: int) -> Iterator[list]:
        start = 0
        if self.room and length:
            start = min(self.room, length)
            self.filling.append((doc, 0, start))
            self.room -= start
            if not self.room:
                yield self.filling
        while length - start >= self.capacity:
            yield [(doc, start, self.capacity)]
            start += self.capacity
        if start < length:
            k = self.capacity // (length - start)
            tails = self.classes.setdefault(k, [])
            tails.append((doc, start, length - start))
            if len(tails) == k:
                del self.classes[k]
                room = self.capacity - sum(p[2] for p in tails)
                if room:
                    self.filling, self.room = tails, room
                else:
                    yield tails

    def rest(self) -> Iterator[list]:
        """What is in the bins, laid end to end; at last sequences that have powers of two for lengths."""
        left = [p for k in sorted(self.classes) for p in self.classes[k]]
        left = (self.filling if self.room else []) + left
        total = sum(p[2] for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if total % self.capacity >> b & 1]
        at, used = 0, 0
        for size in sizes:
            out = []
            while size:
                doc, start, length = left[at]
                n = min(size, length - used)
                out.append((doc, start + used, n))
                size, used = size - n, used + n
                if used == length:
                    at, used = at + 1, 0
            yield out


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end: int = 1) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids (binary: little-endian unsigned 32-bit numbers),
    doc_tokens, sequence_id, offset.

    A document's tokens are those of the whole text followed by end; each lies in one piece, and pieces of a sequence
    follow each other by offset without a gap. A sequence has capacity tokens or, at the end of a task, a power of two.
    Null texts are empty: they have end alone. Repeated rows are packed each for itself, and a null doc_id is a document
    like any other. Very long texts are tokenised whole. An empty table gives an empty one. Other columns are dropped,
    whatever their names. sequence_id is unique, with the task in its upper bits, and not gapless.
    """
    spark = docs.sparkSession
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    batches_of(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("ids"), F.lit(0).cast("long").alias("doc_tokens"), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(shared.value), Bins(capacity)
        kind, number, out = pa.null(), TaskContext.get().partitionId() << 33, []

        def emit(sequence: list) -> None:
            nonlocal number
            offset = 0
            for (name, ids), start, length in sequence:
                out.append((name, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, number, offset))
                offset += length
            number += 1

        def made() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)
            out.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for name, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += last
                    for sequence in bins.add((name, ids), len(ids) // 4):
                        emit(sequence)
                if out:
                    yield made()
        for sequence in bins.rest():
            emit(sequence)
        if out:
            yield made()

    return rows.mapInArrow(run, schema)
