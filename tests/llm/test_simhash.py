import random

import numpy as np
import xxhash

from lodestone.llm import simhash as S
from lodestone.llm.components import Links, components


def fingerprint(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()]
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, bits=2):
    best = {}
    for start in range(len(fps)):
        if start in best:
            continue
        todo, group = [start], {start}
        while todo:
            x = todo.pop()
            for y in range(len(fps)):
                if y not in group and bin(fps[x] ^ fps[y]).count("1") <= bits:
                    group.add(y)
                    todo.append(y)
        for g in group:
            best[g] = min((ids[g] for g in group if ids[g] is not None), default=None)
    return best


def test_against_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 40, 400]))) for _ in range(40)]
    docs = []
    for i, t in enumerate(base):
        w = t.split()
        docs.append((10 * i, t))
        if len(w) == 400:
            w[rng.randrange(400)] = "other"
            docs.append((10 * i + 1, " ".join(w)))
    docs += [(900, None), (901, ""), (902, " \t\n"), (903, "Two words"), (904, "two WORDS"), (905, "é É"), (906, base[0].upper()), (None, base[1]), (0, base[0]), (907, "a b c " * 20_000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as component_id")
    got = S.near_duplicates(table).collect()
    fps = [fingerprint(t) for _, t in docs]
    want = classes([i for i, _ in docs], fps)
    assert sorted([tuple(r) for r in got], key=repr) == sorted([(docs[i][0], f"{fps[i]:016x}", want[i]) for i in range(len(docs))], key=repr)
    assert S.near_duplicates(table.limit(0)).count() == 0


def test_tree_meets_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = centres[:150] ^ np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64) ^ np.uint64(4)
    fps = np.unique(np.concatenate([centres, near, np.array([0, 2**64 - 1], np.uint64)]))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.vertex: r.component for r in components(S.link_fingerprints(table, 2, leaf_size=20)).collect()}
    links = Links(len(fps))
    x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    links.union(x, y)
    roots = links.roots()
    together = {}
    for i, r in enumerate(roots):
        together.setdefault(r, []).append(int(fps.view(np.int64)[i]))
    for group in together.values():
        assert len({got.get(v, v) for v in group}) == 1
    assert len({got.get(int(v), int(v)) for v in fps.view(np.int64)}) == len(together)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(50)]
    odd = [(5, 5), (None, 3), (7, None), (2000, 2001), (2001, 2000), (2000, 2001)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(chain + star + odd, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1001 + i] == 1000 for i in range(50)) and got[2001] == 2000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
