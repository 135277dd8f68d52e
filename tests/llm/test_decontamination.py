import hashlib
import random
import re

from lodestone.llm import decontamination as D

WORD = re.compile(D.WORD)
TABLE = str.maketrans(D.UPPER, D.LOWER)


def words(text):
    return WORD.findall((text or "").translate(TABLE))


def brute(docs, bench, window=13):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, items = set(), set()
        for item, t in bench:
            b = words(t)
            n = min(window, len(b))
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    items.add("" if item is None else str(item))
        listed = ",".join(sorted(items))
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def check(spark, docs, bench):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "2 as tag", "3 as pos")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = D.contamination(d, b).drop("kd", "tag")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, bench)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "a", "Érable", "ÉRABLE", "z9", *[f"w{i}" for i in range(30)]]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    bench = [(i, text(rng.choice([1, 5, 12, 13, 14, 30, 60]))) for i in range(25)] + [(40, "the of a"), (41, None), (42, "... !"), (None, "w1 w2 w3 w4"), (3, text(20)), (50, "dup dup dup dup"), (50, "dup dup dup dup"), (51, "Dup DUP dup dup")]
    docs = [(i, text(rng.randrange(0, 80))) for i in range(60)]
    docs += [(100 + i, f"{text(10)}; {t!s} -- {text(15)}".replace(" ", rng.choice([" ", "\n", ", "]))) for i, (_, t) in enumerate(bench)]
    docs += [(200, None), (201, ""), (202, "?!"), (None, bench[3][1]), (3, docs[3][1]), (203, "dup " * 30), (204, "the of a " * 3000), (3, docs[3][1]), (3, "other " + str(bench[6][1]))]
    check(spark, docs, bench)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, "a b c"), (2, None)], [])
    check(spark, [(1, "a b c")], [(1, None), (2, "a b c")])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha y beta z gamma"), (2, "alpha " + "q " * 30 + "beta gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    index = D.build_index(docs, bench)
    assert {r.kd for r in D.proximity(index, 3).collect()} == {1, 3}
    assert {r.kd for r in D.phrases(index).collect()} == set()


def test_a_document_that_starts_within_an_item(spark):
    item = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(item[20:36])), (2, " ".join(item[27:])), (3, "x " + " ".join(item[5:18]) + " y"), (4, " ".join(item[28:]))]
    check(spark, docs, [(7, " ".join(item))])
