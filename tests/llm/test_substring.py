import hashlib
import random
from collections import Counter

import pytest

from lodestone.llm import substring as S


def brute(docs, window):
    seen = Counter()
    split = [(text or "").encode().split() for _, text in docs]
    for w in split:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(docs, split, strict=True):
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, window):
    rng = random.Random(seed)
    passages = [[f"p{i}_{k}" for k in range(rng.choice([window - 1, window, window + 1, 3 * window]))] for i in range(6)]
    docs = []
    for i in range(70):
        w = [rng.choice(["the", "a", "é", "X", "x"]) if rng.random() < 0.3 else f"w{rng.randrange(10_000)}" for _ in range(rng.randrange(0, 4 * window))]
        if rng.random() < 0.6:
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    docs += [(100, None), (101, ""), (102, "same " * (window + 20)), (103, "other " * (window - 1)), (104, "once " * window), (105, docs[5][1]), (None, docs[6][1]), (7, docs[7][1]), (8, docs[9][1]), (None, None), (106, "a b " * 2 * window), (107, "n b " * 3)]
    return docs


def test_against_brute_force(spark):
    for seed, window, batches in ((1, 35, 2), (2, 20, 1), (3, 14, 3)):
        docs = corpus(seed, window)
        table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as tag", "'k' as kept_text", "2 as a")
        got = S.dedup(table, window=window, batches=batches).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, window)


def test_texts_and_spans(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(1, f"a  b {shared} c"), (2, f"{shared} d"), (3, "un  touched\n"), (4, None)]
    got = {r.doc_id: r for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept_text == "a b c" and [(s.start, s.stop) for s in got[1].removed_spans] == [(2, 42)]
    assert got[2].kept_text == "d" and got[3].kept_text == "un  touched\n" and got[4].kept_text is None
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_batches_sessions_and_compaction(spark, tmp_path):
    docs = corpus(4, 20)
    table = spark.createDataFrame([d for d in docs if d[0] is not None], "doc_id long, text string")
    folder = str(tmp_path / "index")
    index = S.FingerprintIndex(spark, folder, 20, fanout=2)
    for i in range(5):
        index.add(table.where(f"pmod(doc_id, 5) = {i}"))
        # another session goes on where this one stopped
        index = S.FingerprintIndex.open(spark.newSession(), folder)
        assert index.version == i + 1 and (index.window, index.fanout) == (20, 2)
    assert len(index.tables["keys"]) <= 2 and len(index.tables["run"]) == 5
    got = index.spans(table).collect()
    whole = S.FingerprintIndex(spark, window=20)
    whole.add(table)
    want = whole.spans(table).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and got
    with pytest.raises(ValueError):
        S.FingerprintIndex(spark, window=10, gram=12)


def test_words_that_share_one_hash_are_told_apart():
    """A planted collision of one half of the words' hashes: anchors meet, what they are verified by does not."""
    import numpy as np

    from lodestone.llm import windows as W

    class Colliding(W.WordHashes):
        def __missing__(self, word):
            h = W.xxhash.xxh3_128_digest(word.replace(b"other", b"word"))[:8] + W.xxhash.xxh3_128_digest(word)[8:]
            self[word] = h
            return h

    hashes = Colliding()
    words = [b"word%d" % i for i in range(40)]
    sums = [[W.prefix(ids, w) for w, ids in enumerate(hashes.of(x))] for x in (words, [b"other20" if w == b"word20" else w for w in words])]
    met = [W.anchors(s[0], 35, 9) for s in sums]
    assert all((x == y).all() for x, y in zip(*met, strict=True))
    starts = np.arange(6)
    assert (W.span_hashes(sums[0][1], 1, starts, starts + 35) != W.span_hashes(sums[1][1], 1, starts, starts + 35)).all()
