import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import queries as Q
from lodestone.llm import toxicity as X

FOLDER = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string"


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            for bad in rng.sample(["idiot", "scum", "moron", "trash"], 2):
                words.insert(rng.randrange(len(words)), bad)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_learns_and_scores_everything(spark):
    docs, labels = corpus()
    extra = [(1000, None), (1001, ""), (1002, "an idiot and SCUM, a moron"), (1002, "an idiot and SCUM, a moron"), (None, "w1 w2"), (1003, "w5 " * 60_000)]
    table = spark.createDataFrame(docs + extra, SCHEMA).withColumn("toxicity", F.lit("clash")).withColumn("Toxic_Evidence", F.lit(1))
    known = spark.createDataFrame(labels + [(None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    model = X.fit(table, known.where(~X.held_out()))
    got = X.score(table, model)
    assert got.columns == ["doc_id", "text", "toxicity", "toxic_predicted", "toxic_evidence"]
    rows = got.withColumn("held", X.held_out()).collect()
    assert len(rows) == len(docs) + len(extra) and all(0 <= r.toxicity <= 1 for r in rows)
    truth = dict(labels)
    held = [r for r in rows if r.held and r.doc_id in truth]
    assert len(held) > 40 and sum(r.toxic_predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in rows}
    assert by[1002].toxic_predicted == 1 and by[1002].toxic_evidence and by[1000].toxicity == by[1001].toxicity < 0.5 and by[1003].toxic_predicted == 0


def test_index_is_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(t))
        vectors.append((t, w / np.linalg.norm(w)))
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    terms, rows = np.nonzero(dense.T)
    index = X.BlockMaxIndex(np.bincount(terms, minlength=40), rows, dense[rows, terms], 500, 16)
    for (got, at), q in zip(index.nearest(vectors[:60], 10), dense, strict=False):
        cosines = dense @ q
        want = np.sort(cosines)[::-1]
        assert len(got) >= 10 and np.allclose(got[:10], want[:10], atol=1e-9) and (got >= want[9] - 1e-8).all() and np.allclose(cosines[at], got, atol=1e-9)
    none = np.zeros(0, int)
    assert len(index.nearest([(none, np.zeros(0))], 5)[0][0]) == 0
    assert len(X.BlockMaxIndex(np.zeros(40, int), none, np.zeros(0), 0, 16).nearest(vectors[:1], 5)[0][0]) == 0


def brute(docs, labels, params):
    """(score, evidence) of each text, from strings and plain sums alone."""
    def bag(text):
        out = Counter()
        for w, n in Counter(re.findall(r"\w+", (text or "").lower())).items():
            for t in {"=" + w} | {w[:k] + "*" for k in (5,) if len(w) > k}:
                out[t] += n
        return out

    texts = dict(docs)
    examples = [(i, y, bag(texts[i])) for i, y in sorted(labels) if i in texts]
    vocabulary = {t for _, _, x in examples for t in x}
    bags = {i: {t: n for t, n in bag(x).items() if t in vocabulary} for i, x in docs}
    df = Counter(t for x in bags.values() for t in x)
    once = {texts[i]: max(y for j, y, _ in examples if texts[j] == texts[i]) for i, _, _ in examples}
    of = [sum(y == k for y in once.values()) for k in (0, 1)]
    held = Counter((t, y) for x, y in once.items() for t in bag(x))
    scale = {}
    for t in vocabulary:
        g = 0.0
        for k in (0, 1):
            n, both = held[t, k], held[t, 0] + held[t, 1]
            for seen, total in ((n, both), (of[k] - n, sum(of) - both)):
                g += 2 * seen * math.log(seen * sum(of) / (total * of[k])) if seen else 0
        scale[t] = (math.log((1 + len(docs)) / (1 + df[t])) + 1) * (params.floor + (1 - params.floor) * min(1, g / params.full))

    def unit(x):
        w = {t: (1 + math.log(n)) * scale[t] for t, n in x.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / norm for t, v in w.items()}

    kinds = {}
    for i, y, x in examples:
        own = kinds.setdefault(tuple(sorted(x.items())), [i, [0, 0], unit(x)])
        own[1][y] += 1
    none = kinds.pop((), [0, [0, 0], {}])[1]
    prior = (sum(y for _, y, _ in examples) + 0.5) / (len(examples) + 1)

    def vote(x, without=None):
        if not x:
            return ((none[1] - (without == 1)) + prior) / (sum(none) - (without is not None) + 1), []
        q, all_ = unit(x), []
        for key, (i, n, w) in kinds.items():
            n = [n[k] - (dict(key) == x and without == k) for k in (0, 1)]
            all_.append((sum(v * w.get(t, 0) for t, v in q.items()), i, n, kinds[key][1]))
        all_ = sorted((a for a in all_ if a[0] > 0), key=lambda a: -a[0])
        last = all_[min(len(all_), params.neighbours) - 1][0] if all_ else 0
        sums = [0.0, 0.0]
        for cosine, _, n, _ in all_:
            if cosine >= last - 1e-9 and sum(n):
                for k in (0, 1):
                    sums[k] += math.log1p(sum(n)) * n[k] / sum(n) / (params.near + 1 - min(1, cosine))
        return (sums[1] + prior) / (sum(sums) + 1), [(i, int(full[1] > full[0]), cosine) for cosine, i, _, full in all_[:3]]

    seen = [[0, 0] for _ in range(params.bins)]
    for _, y, x in examples:
        seen[min(params.bins - 1, int(vote(dict(x), y)[0] * params.bins))][y] += 1
    pairs = [(n[1] + (b + 0.5) / params.bins * 0.5, sum(n) + 0.5) for b, n in enumerate(seen)]
    # isotonic by the min-max formula
    means = {(i, j): sum(x for x, _ in pairs[i : j + 1]) / sum(n for _, n in pairs[i : j + 1]) for i in range(len(pairs)) for j in range(i, len(pairs))}
    values = [max(min(means[i, j] for j in range(b, len(pairs))) for i in range(b + 1)) for b in range(len(pairs))]
    out = {}
    for i, x in bags.items():
        raw, near = vote(x)
        out[i] = values[min(params.bins - 1, int(raw * params.bins))], near
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    want = brute(docs, labels, X.Params())
    rows = Q.op1_toxicity(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        score, near = want[r.doc_id]
        assert abs(r.score - score) < 1e-6 and len(r.evidence) == min(3, len(near))
        assert all(abs(e.cosine - n[2]) < 1e-5 for e, n in zip(r.evidence, near, strict=True))
        if len({round(n[2], 4) for n in near}) == len(near):
            assert [(e.id, e.label) for e in r.evidence] == [n[:2] for n in near]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in Q.op1_toxicity(spark, folder).where("held_out").collect() if labels.get(r.doc_id) is not None]
    assert len(held) > 60 and sum(y == p for y, p in held) / len(held) >= 0.95


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_without_both_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r.doc_id for r in X.score(docs, model).collect()} == {1, 2}
    assert X.score(docs.limit(0), model).count() == 0


def test_terms_of_words_among_signs_need_no_pattern(monkeypatch):
    tokens = ["word", "word,", '("word!")', "a_b.", "don't", "well-known", "...", "_x_", "straße;", "\ud800", "x\ud800"]
    want = []
    for t in tokens:
        words = re.findall(r"\w+", t)
        terms = ["=" + w for w in words] + [w[:5] + "*" for w in words if len(w) > 5]
        want.append([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in terms])
    assert [X.terms_of(t) for t in tokens] == want
    assert not any(re.match(r"\w", c) for c in X.SIGNS)
    monkeypatch.setattr(X, "WORD", None)
    assert [X.terms_of(t) for t in tokens[:3]] == want[:3] and len(X.terms_of("straße;")) == 2
