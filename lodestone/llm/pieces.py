"""SentencePiece BPE encoding with seeded merge-dropout, and its lossless decoding.

Merges are taken from an agenda by score, then from the left; with dropout each candidate that comes up is skipped by a
keyed hash of its own, of the seed, the text, the unit's place in it and the candidate's number. So the same seed always
gives the same segmentation, on any machine and after any retry, and every occurrence of a word is drawn anew.

A unit is a run of spaces with the text up to the next space or line end, or between a letter and a sign that no piece
of the vocabulary joins: no piece reaches across, so units are merged apart, the units of a batch side by side with numpy.
Occurrences none of whose candidates is skipped are segmented as without dropout, which is remembered by unit.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batches_of, with_columns

SPACE = "▁"
#: Letters for cutting units; raised figures, which some pieces join with signs, are none.
LETTER = r"[^\W\d_²³¹]"
#: Units remembered by a task, without dropout, before its memory starts anew.
CACHE = 150_000
#: Units encoded at once, and columns of one table of them.
UNITS, ROWS = 150_000, 1 << 14
#: Characters up to which units are merged side by side (at most 252); beyond them a heap for each unit pays off.
LONG = 128
#: The order of a pair that doesn't merge.
NONE = 2**31 - 1
#: Odd step between the keys of draws.
GOLDEN = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Vocabulary:
    """Normal pieces with score and id, ids of the 256 byte pieces, and the id of the unknown piece."""

    pieces: dict[str, tuple[float, int]]
    byte_ids: tuple[int, ...]
    unknown: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a BPE model file with byte fallback, spaces kept as they are and no other normalisation."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        of_bytes = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        pieces = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if len(of_bytes) != 256 or any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in pieces):
            raise ValueError("the model must have byte fallback and no piece that reaches across spaces or lines")
        return cls(pieces, tuple(of_bytes[f"<0x{b:02X}>"] for b in range(256)), sp.unk_id())

    @functools.cached_property
    def digest(self) -> bytes:
        """What tells a vocabulary from others; worked out once, before it is sent to the workers."""
        out = hashlib.sha256(repr((self.byte_ids, self.unknown)).encode())
        for piece in sorted(self.pieces.items()):
            out.update(repr(piece).encode())
        return out.digest()

    def units(self) -> re.Pattern:
        """Cuts a text where no piece reaches across: before spaces, around line ends, and between a letter and a sign
        (in this order or the other) that stand side by side in no piece."""
        pairs = {(a, b) for p in self.pieces for a, b in zip(p, p[1:])}
        letters = {x for pair in pairs for x in pair if re.match(LETTER, x)}
        behind = re.escape("".join(c for c in string.punctuation if not any((x, c) in pairs for x in letters)))
        ahead = re.escape("".join(c for c in string.punctuation if not any((c, x) in pairs for x in letters)))
        if not behind or not ahead:
            return re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        more = f"(?!(?<={LETTER})[{behind}])(?!(?<=[{ahead}]){LETTER})[^{SPACE}\n]"
        return re.compile(f"{SPACE}*{LETTER}+(?=[{behind}{SPACE}\n]|$)|{SPACE}*[^{SPACE}\n](?:{more})*|{SPACE}+|\n")

    def table(self) -> list[bytes]:
        """The bytes of each id; ids without bytes decode to none."""
        out = [b""] * (1 + max(self.unknown, *self.byte_ids, *(i for _, i in self.pieces.values())))
        for piece, (_, i) in self.pieces.items():
            out[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Merges:
    """Symbols by number, and the table of pairs that merge: its order (lower first) and the symbol it makes.

    A symbol is a piece or a single character; characters of no piece get numbers as they are met.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, pieces = vocabulary, vocabulary.pieces
        self.symbols = {s: i for i, s in enumerate(dict.fromkeys([*pieces, *(c for p in pieces for c in p)]))}
        self.ids: list[tuple[int, ...]] = [self._ids(s) for s in self.symbols]
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in self.symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self._flat = None
        _, order = np.unique([-score for score, _ in pieces.values()], return_inverse=True)
        found = [
            (self.symbols[p[:i]] << 32 | self.symbols[p[i:]], o, self.symbols[p])
            for (p, _), o in zip(pieces.items(), order.tolist(), strict=True)
            for i in range(1, len(p))
            if p[:i] in self.symbols and p[i:] in self.symbols
        ]
        self.shift = np.uint64(64 - max(4, (4 * len(found)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.order, self.made = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.full(size, -1, np.int32)
        for at, (key, o, made) in zip(self._slot(np.array([x[0] for x in found], np.int64)).tolist(), found, strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) % size
            self.keys[at], self.order[at], self.made[at] = key, o, made

    def _ids(self, symbol: str) -> tuple[int, ...]:
        found = self.vocabulary.pieces.get(symbol)
        return (found[1],) if found else tuple(self.vocabulary.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass"))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and symbol of each pair; NONE where it doesn't merge."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        seen = self.keys[at]
        todo = np.nonzero((seen != key) & (seen >= 0))[0]
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[todo]]
            todo = todo[(seen != key[todo]) & (seen >= 0)]
        hit = self.keys[at] == key
        return np.where(hit, self.order[at], NONE), self.made[at]

    def read(self, text: str) -> np.ndarray:
        """The symbol of each character."""
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.of_char[chars]
        for c in np.unique(chars[out < 0]).tolist():
            self.of_char[c] = len(self.ids)
            self.ids.append(self._ids(chr(c)))
        return self.of_char[chars]

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all symbols in a row, where each symbol's begin, how many they are)."""
        if self._flat is None or len(self._flat[1]) < len(self.ids):
            n = np.array([len(x) for x in self.ids], np.int64)
            self._flat = np.fromiter((i for x in self.ids for i in x), np.int32, int(n.sum())), np.cumsum(n) - n, n
        return self._flat


def gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + n[i]] for all i, one after the other."""
    return flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float = 0.0, seed: int = 0):
        if not 0 <= dropout <= 1:
            raise ValueError("dropout must be from 0 to 1")
        self.vocabulary, self.dropout, self.seed = vocabulary, dropout, seed
        self.least = int(dropout * 2.0**64)
        self.bytes, self.cut, self.merges = vocabulary.table(), vocabulary.units(), Merges(vocabulary)
        self._forget()

    def _forget(self) -> None:
        """Starts the memory of undropped units anew: number, ids and candidates of each; number 0 is a space sign that
        the text has itself, spelled in bytes, else it would come back as a space."""
        self.known: dict[str, int] = {SPACE * 2 + "\n": 0}
        self.flat = np.array([self.vocabulary.byte_ids[b] for b in SPACE.encode()], np.int32)
        self.start, self.n, self.tried = np.zeros(1, np.int64), np.full(1, len(self.flat), np.int64), np.zeros(1, np.int64)

    def _skipped(self, draws: np.ndarray, tried: np.ndarray | int) -> np.ndarray:
        """Whether the candidates numbered tried (from 0) of the units with these draws are skipped."""
        if self.dropout in (0, 1):
            return np.full(len(draws), self.dropout == 1)
        return mixed(draws + (np.atleast_1d(tried).astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)) < np.uint64(self.least)

    def units(self, text: str) -> list[str]:
        """The units of a text; one that no unit can be stands for a space sign of the text itself."""
        out: list[str] = []
        for i, part in enumerate(text.split(SPACE)):
            if i:
                out.append(SPACE * 2 + "\n")
            out += self.cut.findall((SPACE + part if not i else part).replace(" ", SPACE))
        return out

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each text has); an empty text has none."""
        ids, counts, some, size = [], [], [], 0
        for text in texts:
            some.append(self.units(text) if text else [])
            size += len(some[-1])
            if size > UNITS:
                ids.append(self._encode(texts[len(counts) : len(counts) + len(some)], some, counts))
                some, size = [], 0
        ids.append(self._encode(texts[len(counts) :], some, counts))
        return np.concatenate(ids), np.array(counts, np.int64)

    def _encode(self, texts: list[str], units: list[list[str]], counts: list[int]) -> np.ndarray:
        if len(self.known) > CACHE:
            self._forget()
        known, every = self.known, list(itertools.chain.from_iterable(units))
        fresh = [u for u in dict.fromkeys(every) if u not in known]
        if fresh:
            flat, n, tried = self.merge(fresh, None)
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(n) - n))
            self.flat, self.n, self.tried = np.concatenate((self.flat, flat)), np.concatenate((self.n, n)), np.concatenate((self.tried, tried))
        own = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
        sizes = np.array([len(u) for u in units], np.int64)
        flat, start, n = self.flat, self.start[own], self.n[own]
        if self.dropout and len(own):
            keys = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), self.seed) for t in texts], np.uint64)
            place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            draws = mixed(np.repeat(keys, sizes) + place.astype(np.uint64) * np.uint64(GOLDEN))
            tried, varied = self.tried[own], np.zeros(len(own), bool)
            open_ = np.nonzero(tried)[0]
            for c in range(int(tried.max())):
                # a unit none of whose candidates is skipped is as without dropout
                skipped = self._skipped(draws[open_], c)
                varied[open_[skipped]] = True
                open_ = open_[~skipped & (tried[open_] > c + 1)]
                if not len(open_):
                    break
            at = np.nonzero(varied)[0]
            more, n_more, _ = self.merge([every[i] for i in at.tolist()], draws[at])
            start[at], n[at] = len(flat) + np.cumsum(n_more) - n_more, n_more
            flat = np.concatenate((flat, more))
        ends = np.concatenate(([0], np.cumsum(n)))
        text_ends = np.concatenate(([0], np.cumsum(sizes)))
        counts += np.diff(ends[text_ends]).tolist()
        return gather(flat, start, n)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def merge(self, units: list[str], draws: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all units in a row, how many each has, candidates that came up); draws None is without dropout."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        symbols = self.merges.read("".join(units))
        first = np.cumsum(lengths) - lengths
        left, n_left, tried = [], np.ones(len(units), np.int64), np.zeros(len(units), np.int64)
        width = np.where(lengths > LONG, 0, -(-lengths // 4) * 4)
        for w in np.unique(width).tolist():
            of_width = np.nonzero(width == w)[0]
            for i in range(0, len(of_width), ROWS):
                at = of_width[i : i + ROWS]
                if w:
                    table = np.full((w + 1, len(at)), -1, np.int32)
                    for k in range(w):
                        has = lengths[at] > k
                        table[k, has] = symbols[first[at[has]] + k]
                    tried[at] = self._side_by_side(table, lengths[at], None if draws is None else draws[at])
                    table = table[:w].T
                    live = table >= 0
                    n_left[at] = live.sum(axis=1)
                    left.append((at, table[live]))
                else:
                    for j in at.tolist():
                        row, tried[j] = self._alone(symbols[first[j] : first[j] + lengths[j]].tolist(), None if draws is None else draws[j : j + 1])
                        n_left[j] = len(row)
                        left.append((np.array([j]), np.array(row, np.int32)))
        # symbols in the order of the units, then their ids
        begin = np.cumsum(n_left) - n_left
        row = np.zeros(int(n_left.sum()), np.int64)
        for at, found in left:
            row[np.repeat(begin[at] - (np.cumsum(n_left[at]) - n_left[at]), n_left[at]) + np.arange(len(found))] = found
        flat, start, n = self.merges.flat()
        ids = gather(flat, start[row], n[row])
        sums = np.concatenate(([0], np.cumsum(n[row])))
        return ids, sums[begin + n_left] - sums[begin], tried

    def _side_by_side(self, symbols: np.ndarray, lengths: np.ndarray, draws: np.ndarray | None) -> np.ndarray:
        """Merges many short units at once, one a column; symbols is left with -1 where one was merged away.

        Each column's agenda is the order of the pair that begins at each place, or NONE; its best is the least, of
        equals the first. A place before the first or behind the last symbol is the last row, which never merges.
        """
        w, m = symbols.shape[0] - 1, symbols.shape[1]
        whole, every = symbols, np.arange(m)
        after = np.repeat(np.arange(1, w + 2, dtype=np.int32)[:, None], m, axis=1)
        after[lengths - 1, every] = w
        before = np.repeat(np.arange(-1, w, dtype=np.int32)[:, None], m, axis=1)
        before[0] = w
        order, made = self.merges.pairs(symbols[:-1].reshape(-1), symbols[1:].reshape(-1))
        places = np.arange(w + 1, dtype=np.int64)[:, None]
        agenda = np.full((w + 1, m), NONE << 8, np.int64)
        agenda[:w] = order.reshape(w, m).astype(np.int64) << 8 | places[:w]
        made = np.concatenate((made.reshape(w, m), np.full((1, m), -1, np.int32)))
        all_tried, tried, rows = np.zeros(m, np.int64), np.zeros(m, np.int64), every
        while True:
            best = agenda.min(axis=0)
            live = best >> 8 < NONE
            n = int(live.sum())
            if n < 0.75 * m:
                # finished columns are put away
                done = ~live
                whole[:, rows[done]], all_tried[rows[done]] = symbols[:, done], tried[done]
                symbols, after, before, agenda, made = (np.ascontiguousarray(x[:, live]) for x in (symbols, after, before, agenda, made))
                tried, rows, best, m = tried[live], rows[live], best[live], n
                draws = None if draws is None else draws[live]
                live = np.ones(m, bool)
            if not n:
                break
            column = np.nonzero(live)[0]
            i = best[column] & 255
            if draws is not None:
                skip = self._skipped(draws[column], tried[column])
                agenda[i[skip], column[skip]] = NONE << 8
                tried[column] += 1
                i, column = i[~skip], column[~skip]
            else:
                tried[column] += 1
            j, p = after[i, column], before[i, column]
            k, s = after[j, column], made[i, column]
            symbols[i, column], symbols[j, column] = s, -1
            after[i, column], before[k, column] = k, i
            agenda[j, column] = NONE << 8
            for a, left, right in ((i, s, symbols[k, column]), (p, symbols[p, column], s)):
                order, both = self.merges.pairs(left, right)
                agenda[a, column] = order.astype(np.int64) << 8 | a
                made[a, column] = both
        return all_tried

    def _alone(self, symbols: list[int], draw: np.ndarray | None) -> tuple[list[int], int]:
        """Merges one long unit; its agenda is a heap: pairs by order, then from the left, void once a side changed."""
        n, tried = len(symbols), 0
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        order, made = (x.tolist() for x in self.merges.pairs(np.array(symbols[:-1]), np.array(symbols[1:])))
        agenda = [(o, i, i + 1, symbols[i], symbols[i + 1], s) for i, (o, s) in enumerate(zip(order, made, strict=True)) if o != NONE]
        heapq.heapify(agenda)
        skips: list[bool] = []
        one = functools.lru_cache(1 << 16)(lambda a, b: tuple(int(x[0]) for x in self.merges.pairs(np.array([a]), np.array([b]))))
        while agenda:
            _, i, j, a, b, s = heapq.heappop(agenda)
            if symbols[i] != a or symbols[j] != b or after[i] != j:
                continue
            if draw is not None:
                if tried == len(skips):
                    skips += self._skipped(np.repeat(draw, 4096), np.arange(tried, tried + 4096)).tolist()
                tried += 1
                if skips[tried - 1]:
                    continue
            else:
                tried += 1
            symbols[i], symbols[j] = s, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0:
                    o, both = one(symbols[x], symbols[y])
                    if o != NONE:
                        heapq.heappush(agenda, (o, x, y, symbols[x], symbols[y], both))
        return [s for s in symbols if s >= 0], tried

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the space set before every text is taken off."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode("utf-8", "replace")


def _digested(model: str) -> Vocabulary:
    out = Vocabulary.load(model)
    out.digest  # noqa: B018, remembered in the object
    return out


_encoders: dict = {}


def _encoder(sent, dropout: float, seed: int) -> Encoder:
    """One encoder for a worker process, so that later tasks find its cache."""
    key = (sent.value.digest, dropout, seed)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(sent.value, dropout, seed)
    return _encoders[key]


def encode(docs: DataFrame, model: str, text_col: str = "text", dropout: float = 0.1, seed: int = 10) -> DataFrame:
    """docs with piece_ids array<int>, n_pieces long and lossless boolean (decoding gives the text back).

    A null text has null in all three; an empty text has no pieces. Equal texts get equal pieces. Whole texts are
    encoded, whatever their length. Columns named like the new ones are replaced, others pass through; the ids of one
    batch are the only state that grows with a text.
    """
    spark = docs.sparkSession
    batches_of(spark)
    sent = spark.sparkContext.broadcast(_digested(model))  # as large as the vocabulary
    new = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())]
    schema = with_columns(docs.schema, new)
    kept = schema.names[:-3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(sent, dropout, seed)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            flat, n = own.encode_all([t or "" for t in texts])
            ends = np.concatenate(([0], np.cumsum(n)))
            right = [None if t is None else own.decode(flat[i:j].tolist()) == t for t, i, j in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            none = np.array([t is None for t in texts], bool)
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=pa.array(none))
            count = pa.array(n, mask=none)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), ids, count, pa.array(right, pa.bool_())], names=schema.names)
        own._forget()  # the worker may go on with other work

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids_col: str = "piece_ids") -> DataFrame:
    """rows with decoded string from the ids; null ids give null."""
    from .common import append_columns

    sent = rows.sparkSession.sparkContext.broadcast(_digested(model))

    def compute(ids: list) -> list[list]:
        own = _encoder(sent, 0.0, 0)
        return [[None if x is None else own.decode(x) for x in ids]]

    return append_columns(rows, ids_col, [T.StructField("decoded", T.StringType())], compute)
