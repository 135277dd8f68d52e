"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

1. A bounded sample of the labelled training rows (Params.examples) supplies the examples. All their words and word
   beginnings are the terms of the vector space; how many examples of each label hold a term is counted by Spark.
2. The document frequency of every term is counted over all documents.
3. A term weighs (1 + ln count) * idf * association; the association, from Params.floor to 1, grows with the term's
   log-likelihood ratio between the labels. It scales axes and leaves none out.
4. The examples' unit vectors, equal ones merged, make an inverted index in blocks; for each term and block it keeps the
   largest weight. A query takes blocks by falling upper bound and stops when no block can beat the k-th best: the
   neighbours are exact.
5. Votes are weighted by distance; a monotone fit of leave-one-out votes to labels turns them into probabilities.

The documents' texts are never shuffled: both passes stream over them. Terms, frequencies and index are as large as the
sample of examples, whatever the number of documents.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, batches_of, stored

WORD = re.compile(r"\w+")
#: Signs that often stand around a word, none of them part of one.
SIGNS = ".,;:!?()[]{}<>\"'`*#/-"
#: Beginnings of words that are terms beside the whole words.
PREFIXES = (5,)
#: Entries after which a worker's word cache starts anew.
CACHE = 300_000
#: Tokens, and queries, taken at once.
TOKENS, BATCH = 150_000, 128


@dataclass(frozen=True)
class Params:
    """examples bounds the labelled rows that are learnt from; floor is the association of a term that tells nothing,
    full the log-likelihood ratio from which it is 1."""

    examples: int = 4000
    floor: float = 0.2
    full: float = 60.0
    neighbours: int = 24
    block: int = 256
    near: float = 0.05
    bins: int = 50


def terms_of(token: str) -> list[int]:
    """The terms of a token as hashes: its words, and their beginnings marked as such."""
    # most tokens are a word and a few signs: what is left without the signs is found faster than by the pattern
    core = token if token.isalnum() else token.strip(SIGNS)
    words = (core,) if core.isalnum() else WORD.findall(token)
    found = ["=" + w for w in words]
    found += [w[:n] + "*" for w in words for n in PREFIXES if len(w) > n]
    try:
        return [xxhash.xxh64_intdigest(t) for t in found]  # of the text in UTF-8
    except UnicodeEncodeError:
        return [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in found]


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], ..., start[i] + n[i] - 1 for all i, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Vectoriser:
    """Term counts of texts, by the terms' places in a sorted vocabulary, or by their hashes without one; looks up each
    distinct token once."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.terms, self.start, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, tokens: list[str]) -> None:
        hashes = [terms_of(t) for t in tokens]
        n = np.fromiter(map(len, hashes), np.int64, len(hashes))
        flat = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(n.sum()))
        if self.vocabulary is not None:
            at = np.searchsorted(self.vocabulary, flat)
            found = np.append(self.vocabulary, 0)[at] == flat if len(self.vocabulary) else np.zeros(len(flat), bool)
            found &= at < len(self.vocabulary)
            n = np.bincount(np.repeat(np.arange(len(n)), n), found, len(n)).astype(np.int64)
            flat = at[found].astype(np.uint64)
        self.known.update(zip(tokens, range(len(self.known), len(self.known) + len(tokens)), strict=True))
        self.start = np.concatenate((self.start, len(self.terms) + np.cumsum(n) - n))
        self.n, self.terms = np.concatenate((self.n, n)), np.concatenate((self.terms, flat))

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, text, term, count) of some texts after the other; texts are counted from the first one, and
        terms come in order."""
        first, tokens, sizes = 0, [], []
        for i, text in enumerate(texts):
            own = (text or "").lower().split()
            tokens += own
            sizes.append(len(own))
            if len(tokens) > TOKENS or i == len(texts) - 1:
                if len(self.known) > CACHE:
                    self._forget()
                fresh = [t for t in dict.fromkeys(tokens) if t not in self.known]
                if fresh:
                    self._learn(fresh)
                own_ = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
                n = self.n[own_]
                terms = self.terms[ranges(self.start[own_], n)]
                doc = np.repeat(np.repeat(np.arange(len(sizes)), sizes), n)
                if self.vocabulary is None:
                    by = np.lexsort((terms, doc))
                    doc, terms = doc[by], terms[by]
                else:
                    # text and term are one number, so that the numbers themselves are sorted
                    bits = len(self.vocabulary).bit_length()
                    both = np.sort((doc << bits) | terms.astype(np.int64))
                    doc, terms = both >> bits, both & ((1 << bits) - 1)
                new = np.nonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (terms[1:] != terms[:-1]))))[0] if len(doc) else np.zeros(0, np.int64)
                yield first, doc[new], terms[new], np.diff(np.append(new, len(doc)))
                first, tokens, sizes = i + 1, [], []

    def each(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, counts) of each text."""
        done = 0
        for first, doc, terms, counts in self(texts):
            # texts up to the next part; those without a term have empty arrays
            last = first + int(doc[-1]) + 1 if len(doc) else first
            ends = np.searchsorted(doc, np.arange(last - first + 1))
            for _ in range(first - done):
                yield terms[:0], counts[:0]
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
                yield terms[i:j], counts[i:j]
            done = last
        for _ in range(len(texts) - done):
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)


class BlockMaxIndex:
    """Exact top-k cosine over unit vectors in blocks.

    Lists of rare terms are postings (position, weight) by term; those of common terms are kept as rows of a table with
    all their weights, and with the largest weight in each block. A query adds up its rare terms everywhere; the largest
    sum in a block and the largest weights of its common terms there bound what the block can give. Blocks that can't
    reach the k-th best cosine so far are left out; in the others the common terms are added.
    """

    def __init__(self, n: np.ndarray, position: np.ndarray, weight: np.ndarray, vectors: int, block: int, share: int = 16):
        """Postings stand by term, n[t] of them for the term t; terms in more than one of share vectors are common."""
        self.n, self.block, self.blocks = vectors, block, -(-vectors // block)
        common = np.nonzero(n > max(2, vectors // share))[0]
        #: Row of each common term, or -1.
        self.row = np.full(len(n), -1)
        self.row[common] = np.arange(len(common))
        of = np.repeat(self.row, n)
        self.table = np.zeros((len(common), self.blocks * block))
        self.table[of[of >= 0], position[of >= 0]] = weight[of >= 0]
        self.top = self.table.reshape(len(common), self.blocks, block).max(axis=2) if self.blocks else np.zeros((len(common), 0))
        self.position, self.weight, self.count = position[of < 0], weight[of < 0], np.where(self.row < 0, n, 0)
        self.start = np.cumsum(self.count) - self.count

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (cosines, positions) of the k nearest with a cosine above 0, and of all that tie with the
        last; best first."""
        if not self.blocks:
            return [(np.zeros(0), np.zeros(0, np.int64)) for _ in queries]
        scores = np.zeros((len(queries), self.blocks * self.block))
        asked = np.zeros((len(queries), len(self.table)))
        for i, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            asked[i, row[row >= 0]] = weights[row >= 0]
            rare = terms[row < 0]
            n = self.count[rare]
            postings = ranges(self.start[rare], n)
            scores[i] = np.bincount(self.position[postings], np.repeat(weights[row < 0], n) * self.weight[postings], scores.shape[1])
        bound = asked @ self.top + scores.reshape(len(queries), self.blocks, self.block).max(axis=2)
        least = np.zeros(len(queries))
        # the blocks that promise most set the least cosine that the others must be able to reach
        order = np.argsort(-bound.mean(axis=0), kind="stable")
        done: list[int] = []
        for step, b in enumerate(order.tolist()):
            here = slice(b * self.block, (b + 1) * self.block)
            some = np.nonzero((bound[:, b] > 0) & (bound[:, b] >= least - 1e-9))[0]
            if len(some) == len(queries):
                scores[:, here] += asked @ self.table[:, here]
            else:
                scores[some, here] += asked[some] @ self.table[:, here]
                left = np.ones(len(queries), bool)
                left[some] = False
                scores[left, here] = 0
            done += range(here.start, here.stop)
            if step in (self.blocks // 4, self.blocks // 2) and len(done) > k:
                least = np.partition(scores[:, done], -k, axis=1)[:, -k]
        last = np.partition(scores, -k, axis=1)[:, -k:][:, :1] if scores.shape[1] > k else 0.0
        of, near = np.nonzero((scores > 0) & (scores >= last - 1e-9))
        ends = np.searchsorted(of, np.arange(len(queries) + 1))
        out = []
        for own, i, j in zip(scores, ends[:-1].tolist(), ends[1:].tolist()):
            at = near[i:j]
            at = at[np.lexsort((at, -own[at]))]
            out.append((np.minimum(own[at], 1.0), at))
        return out


class Model:
    """What the executors need to score a text; as large as the examples."""

    def __init__(self, params: Params, vocabulary: np.ndarray, scale: np.ndarray, examples: list[tuple]):
        """examples are (id, label, terms, counts); scale is each term's idf times its association."""
        self.params, self.vocabulary, self.scale = params, vocabulary, scale
        merged: dict[tuple, list] = {}
        for id_, label, terms, counts in sorted(examples, key=lambda x: x[:2]):
            own = merged.setdefault((terms.tobytes(), counts.tobytes()), [id_, [0, 0], terms, counts])
            own[1][label] += 1
        self.none = merged.pop((b"", b""), [None, [0, 0]])[1]
        everyone = [sum(1 for x in examples if x[1] == label) for label in (0, 1)]
        self.prior = (everyone[1] + 0.5) / (sum(everyone) + 1)
        # vectors led by the same terms share blocks, which keeps the bounds of other blocks low
        kinds = sorted(merged.values(), key=lambda x: x[2][np.argsort(-self.vector(*x[2:])[1], kind="stable")[:3]].tolist())
        self.labels, self.ids = np.array([x[1] for x in kinds], np.float64).reshape(-1, 2), [x[0] for x in kinds]
        sizes = np.array([len(x[2]) for x in kinds], np.int64)
        terms, counts = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in kinds)]) for i in (2, 3))
        by = np.argsort(terms, kind="stable")
        self.n = np.bincount(terms, minlength=len(vocabulary)).astype(np.int32)
        self.position, self.counts = np.repeat(np.arange(len(kinds), dtype=np.int32), sizes)[by], counts[by].astype(np.int32)
        #: Probability of label 1 by bin of the vote, and the broadcast of this model; both set by fit.
        self.values, self.sent = [self.prior] * params.bins, None

    @functools.cached_property
    def index(self) -> BlockMaxIndex:
        """Made from the counts where it is needed, so that little is sent."""
        w = (1 + np.log(self.counts)) * np.repeat(self.scale, self.n)
        norm = np.sqrt(np.bincount(self.position, w * w, len(self.ids)))
        return BlockMaxIndex(self.n.astype(np.int64), self.position.astype(np.int64), w / norm[self.position], len(self.ids), self.params.block)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "sent")}

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.scale[terms]
        return terms, w / np.linalg.norm(w) if len(w) else w

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int | None] | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each text (share of toxic votes, cosines, positions); without leaves out one example of that label and
        this very vector."""
        for i in range(0, len(texts), BATCH):
            near = iter(self.index.nearest([self.vector(*x) for x in texts[i : i + BATCH] if len(x[0])], self.params.neighbours))
            for x, y in zip(texts[i : i + BATCH], without[i : i + BATCH] if without else itertools.repeat(None)):
                yield self._vote(*next(near), y) if len(x[0]) else self._no_terms(y)

    def _no_terms(self, without: int | None) -> tuple[float, np.ndarray, np.ndarray]:
        n = [self.none[y] - (without == y) for y in (0, 1)]
        return (n[1] + self.prior) / (sum(n) + 1), np.zeros(0), np.zeros(0, np.int64)

    def _vote(self, cosines: np.ndarray, at: np.ndarray, without: int | None) -> tuple[float, np.ndarray, np.ndarray]:
        n = self.labels[at]
        if without is not None and len(at) and cosines[0] > 1 - 1e-9:
            n[0, without] = max(0.0, n[0, without] - 1)
        total = n.sum(axis=1)
        # equal vectors are many votes for one kind of text: each kind counts by the logarithm of its size
        w = np.log1p(total) / np.maximum(total, 1) / (self.params.near + 1 - cosines)
        good, bad = w @ n if len(at) else (0.0, 0.0)
        return float((bad + self.prior) / (good + bad + 1)), cosines, at

    def bin(self, raw: float) -> int:
        return min(self.params.bins - 1, int(raw * self.params.bins))

    def calibrate(self, seen: np.ndarray) -> None:
        """Monotone (pool adjacent violators) fit of the labels seen in each bin of leave-one-out votes."""
        pools: list[list[float]] = []
        for b in range(self.params.bins):
            # each bin leans a little on its own vote, so that empty bins stay in order
            middle = (b + 0.5) / self.params.bins
            pools.append([seen[b, 1] + middle * 0.5, seen[b].sum() + 0.5, 1])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
        self.values = [float(p[0] / p[1]) for p in pools for _ in range(int(p[2]))]

    def evidence(self, cosines: np.ndarray, at: np.ndarray) -> list[dict]:
        near = zip(at[:3].tolist(), cosines[:3].tolist(), strict=True)
        return [{"id": self.ids[i], "label": int(self.labels[i, 1] > self.labels[i, 0]), "cosine": round(c, 6)} for i, c in near]


def term_counts(examples: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms in order, in how many examples of each label each occurs, examples of each label); equal texts count once."""
    once = stored(examples.groupBy("text").agg(F.max("toxic").cast("int").alias("toxic")), "once")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vectoriser()
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for first, doc, terms, _ in own(batch.column(0).to_pylist()):
                each, at = np.unique(terms, return_inverse=True)
                labels = toxic[first + doc]
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), *(pa.array(np.bincount(at, labels == y, len(each)).astype(np.int64)) for y in (0, 1))], names=["term", "n0", "n1"])

    sums = once.select("text", "toxic").mapInArrow(run, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    total = once.groupBy("toxic").count().collect()
    terms = sums.column(0).to_numpy().view(np.uint64)
    order = np.argsort(terms)
    held = np.stack([sums.column(i).to_numpy() for i in (1, 2)]).astype(np.float64)[:, order]
    return terms[order], held, np.array([sum(r["count"] for r in total if r.toxic == y) for y in (0, 1)], np.float64)


def association(held: np.ndarray, of: np.ndarray, params: Params) -> np.ndarray:
    """From floor to 1 by the log-likelihood ratio of each term's examples of both labels."""
    if not of.all():
        return np.ones(held.shape[1])
    parts = []
    for seen, total in ((held, held.sum(axis=0)), (of[:, None] - held, of.sum() - held.sum(axis=0))):
        expected = total * of[:, None] / of.sum()
        parts.append(seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1)))
    ratio = 2 * (parts[0] + parts[1]).sum(axis=0)
    return params.floor + (1 - params.floor) * np.clip(ratio / params.full, 0, 1)


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> np.ndarray:
    """In how many of docs each term occurs; the last entry counts the documents."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count = Vectoriser(sent.value), np.zeros(len(sent.value) + 1, np.int64)
        for batch in batches:
            for _, _, terms, _ in own(batch.column(0).to_pylist()):
                count[:-1] += np.bincount(terms, minlength=len(sent.value))
            count[-1] += batch.num_rows
        some = np.nonzero(count)[0]
        for i in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 100_000].astype(np.int32)), pa.array(count[some[i : i + 100_000]])], names=["term", "n"])

    rows = docs.select(text_col).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> Model:
    """A model from labels (id_col, toxic).

    Rows of labels without an id or label, or with one other than 0 and 1, are ignored; of repeated ids the larger
    label counts, and every document of a labelled id is an example. Null and empty texts are examples without terms;
    equal texts are one vector with several labels. Of more labelled ids than params.examples those with the smallest
    hashes are taken. Without examples, or with those of one label alone, all texts get one score.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(params.examples)
    batches_of(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the sample has at most params.examples rows of two numbers: a broadcast of bounded size
    examples = stored(texts.join(F.broadcast(stored(sample, "labelled")), "id"), "examples")
    vocabulary, held, of = term_counts(examples)
    frequency = document_frequencies(docs, text_col, vocabulary)
    scale = (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1) * association(held, of, params)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vectoriser(sent.value)
        for batch in batches:
            found = list(own.each(batch.column("text").to_pylist()))
            lists = [pa.array([x[i].tolist() for x in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), *lists], names=["id", "toxic", "terms", "counts"])

    vectors = stored(examples.select("id", "toxic", "text").mapInArrow(counted, "id long, toxic int, terms array<int>, counts array<int>"), "vectors")
    rows = vectors.toArrow()  # those of the sample alone
    lists = [[x.values.to_numpy() for x in rows.column(i)] for i in (2, 3)]
    model = Model(params, vocabulary, scale, list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), *([x.astype(np.int64) for x in y] for y in lists), strict=True)))
    model.sent = docs.sparkSession.sparkContext.broadcast(model)
    draft = model.sent

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[x.values.to_numpy().astype(np.int64) for x in batch.column(i)] for i in (2, 3)]
            bins = [draft.value.bin(raw) for raw, _, _ in draft.value.votes(list(zip(*lists, strict=True)), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), batch.column(1)], names=["bin", "toxic"])

    seen = np.zeros((params.bins, 2))
    for r in vectors.repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(votes, "bin int, toxic int").groupBy("bin", "toxic").count().collect():
        seen[r.bin, r.toxic] = r["count"]
    model.calibrate(seen)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with toxicity double, toxic_predicted int and toxic_evidence (id, label, cosine of up to 3 neighbours).

    A text without a term of the model, a null or an empty one gets the share of label 1 among examples without terms.
    Without examples of both labels every score is the share of label 1. Repeated rows are scored alike. Columns named
    like the new ones are replaced; other columns pass through.
    """
    spark = docs.sparkSession
    batches_of(spark)
    sent, values = model.sent, model.values
    state: dict = {}

    def compute(texts: list) -> list[list]:
        known = sent.value
        own = state.setdefault("own", Vectoriser(known.vocabulary))
        out = list(known.votes(list(own.each(texts))))
        scores = [values[known.bin(raw)] for raw, _, _ in out]
        return [scores, [int(s >= 0.5) for s in scores], [known.evidence(c, at) for _, c, at in out]]

    evidence = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))
    return append_columns(docs, text_col, [T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType()), T.StructField("toxic_evidence", evidence)], compute)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True where crc32 of the id as text is divisible by folds; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
