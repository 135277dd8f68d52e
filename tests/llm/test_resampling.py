import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import queries as Q
from lodestone.llm import resampling as S

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])], len(words)


def brute(docs, target, percent=25, least=20, buckets=10_000, seed=7):
    def counted(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t)[0]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counted(x for _, x in docs), counted(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        found, words = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    best = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    best = best[: percent * len(best) // 100]
    return sorted([r[:4] for r in rows], key=repr), [(r[0], r[3], i + 1) for i, r in enumerate(best)]


def check(got, docs, target, **more):
    want, drawn = brute(docs, target, **more)
    rows = got.collect()
    assert sorted([tuple(r)[:4] for r in rows], key=repr) == want
    assert [(r.doc_id, r.score, r["rank"]) for r in sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])] == drawn


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = Q.op13_resampling(spark, folder)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    check(got, docs, target)
    # many small ranges and runs give the same ranks
    table = spark.createDataFrame(docs, SCHEMA).repartition(5)
    check(S.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), per_range=7), docs, target)


def test_hashes_of_pairs():
    rng = random.Random(3)
    words = ["x" * n for n in (1, 2, 63, 64, 65, 254, 255, 256, 257, 3000)] + ["é", "中", "😀a", "0"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(60)] + [None, "", "...", "A-B_c\x00D"]
    known = S.Words()
    n, crc, pairs, real = S.hashed(texts, known)
    want = [features(t) for t in texts]
    assert n.tolist() == [w for _, w in want]
    assert crc.tolist() == [zlib.crc32(f.encode()) for found, w in want for f in found[:w]]
    assert pairs[real].tolist() == [zlib.crc32(f.encode()) for found, w in want for f in found[w:]]
    assert [len(a) for a in S.hashed([None, ""], known)] == [2, 0, 0, 0]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_tournament(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(9), i, j) for j in range(rng.randrange(0, 9))) for i in range(k)]
    assert list(S.Tournament([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_places():
    keys = [(1, 0), (1, 2), (2, 0), (3, 5)]
    columns = [np.array([k[i] for k in keys], np.int64) for i in range(2)]
    assert S._places(columns, [(1, 2), (3, 0)]).tolist() == [0, 1, 1, 2] and S._places(columns, []).tolist() == [0] * 4


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, "-"), (4, "few words"), (5, long), (5, long), (None, long), (6, long + " more"), (7, "W " * 20_000)] + [(None, long)] * 30 + [(i, long) for i in range(10, 40)]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in docs], SCHEMA + ", score string, tie string, k0 string").repartition(4)
    target = spark.createDataFrame([("w1 w2 w3",), (None,)], "text string")
    got = S.resample(table, target, percent=90, per_range=5)
    check(got, docs, ["w1 w2 w3", None], percent=90)
    check(S.resample(table, target.limit(0), percent=100, per_range=9), docs, [], percent=100)
    check(S.resample(table, target, percent=0), docs, ["w1 w2 w3"], percent=0)
    assert S.resample(table.limit(0), target).count() == 0
