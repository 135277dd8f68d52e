import os
import random
import shutil

import pytest

from lodestone.operators import grams
from lodestone.operators.grams import GramIndex

SCHEMA = "id long, content string, metadata string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = ["alpha", "beta", "ΑΣ", "ΑΣΑ", "Éa", "straße", "İx", "zz top", "o", "中文字", "a_b%c"]
    out = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 6))), rng.choice(["meta", "", None, "a_b"])) for i in range(300)]
    return [*out, (None, None, None), (None, "alpha beta", None), (7, "alpha beta", "again"), (1000, "x" * 100_000 + "needle", "m"), (1001, "", "needle")]


@pytest.mark.parametrize("lower", [False, True])
def test_equals_a_scan(spark, tmp_path, rows, lower):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = GramIndex.build(table, str(tmp_path / "i"), ["content", "metadata"], lower, parts=8)
    for text in ("alpha beta", "needle", "ΑΣ ", "ΑΣΑ", "éA", "ŞTR", "straße", "İx ", "a_b", "b%c", "o", "zz", "", "中文字", "nowhere", "xxxxxxx"):
        got = sorted((tuple(r) for r in index.search(text).collect()), key=repr)
        low = spark.createDataFrame([(text,)], "t string").selectExpr("lower(t)").first()[0]
        want = table.selectExpr("*", "lower(content) lc", "lower(metadata) lm").collect()
        hit = [tuple(r)[:3] for r in want if any((low if lower else text) in (x or "") and x is not None for x in ((r.lc, r.lm) if lower else (r.content, r.metadata)))]
        assert got == sorted(hit, key=repr), text


def test_only_parts_with_candidates_are_read(spark, tmp_path, rows):
    path = str(tmp_path / "i")
    index = GramIndex.build(spark.createDataFrame(rows, SCHEMA), path, ["content", "metadata"], parts=8)
    rarest = index.rarest("needle")
    assert len(rarest) == 4 and all(n == 2 for _, n in rarest) and index.rarest("ne") is None and index.rarest("alpha")[0][1] > 50
    parts = {r.part for r in index.candidates(rarest).collect()}
    assert len(parts) <= 2
    for folder in os.listdir(f"{path}/texts"):
        if folder.startswith("part=") and int(folder[5:]) not in parts:
            shutil.rmtree(f"{path}/texts/{folder}")
    assert {r.id for r in index.search("needle").collect()} == {1000, 1001}


@pytest.mark.parametrize("characters", [1_000_000, 5, 1])
def test_lists_are_made_by_sorting_numbers(monkeypatch, characters):
    monkeypatch.setattr(grams, "CHARACTERS", characters)
    rng = random.Random(3)
    cases = []
    for alphabet in ("ab", "aé中😀\0\n", "".join(map(chr, range(32, 400)))):
        for n in (1, 2, 3, 64):
            cases.append((n, [(r, "".join(rng.choices(alphabet, k=rng.randrange(3, 30)))) for _ in range(2) for r in range(n) if rng.random() < 0.8]))
    if characters > 5:  # so many characters that rows have to be halved
        signs = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
        cases.append((2048, [*((r, signs[r * 1000 : r * 1000 + 20_000]) for r in (0, 1, 2047)), (1023, signs)]))
    for n, texts in cases:
        want, got = {}, {}
        for row, text in texts:
            for gram in grams.grams_of(text):
                want.setdefault(gram, set()).add(row)
        for found, sizes, own in grams._lists_of(texts, n):
            own = iter(own.tolist())
            for gram, size in zip(found, sizes, strict=True):
                got.setdefault(gram, []).extend(next(own) for _ in range(size))
            assert next(own, None) is None
        assert {g: sorted(rows) for g, rows in got.items()} == {g: sorted(rows) for g, rows in want.items()}


def test_rows_are_gathered_within_bounds(spark, tmp_path, monkeypatch):
    sizes = [5, 0, 9_000_000, 0, 3, *[4_000] * 5000]
    runs = list(grams._runs(sizes))
    assert [x for at, n in runs for x in range(at, at + n)] == list(range(len(sizes)))
    assert all(n == 1 or n <= grams.ROWS and sum(sizes[at : at + n]) <= grams.GATHERED for at, n in runs) and len(runs) <= 7
    # lists are dealt over as many tasks as their identifiers need
    seen = []
    dealt = grams.dealt
    monkeypatch.setattr(grams, "dealt", lambda session, rows: seen.append(rows) or dealt(session, rows))
    index = GramIndex.build(spark.range(2000).selectExpr("id", "concat('abcdefghijkl', id) as content"), str(tmp_path / "i"), ["content"], parts=2)
    assert seen == [sum(len(grams.grams_of(f"abcdefghijkl{i}")) for i in range(2000)) // 10] and index.search("l1999").count() == 1
    # two thousand rows are gathered at once: a part of a thousand gives one list a gram
    assert index._lists().where("gram = 'abc'").count() <= 4
    GramIndex.build(spark.range(0).selectExpr("id", "'x' as content"), str(tmp_path / "none"), ["content"], parts=2)
    assert seen[1:] == [0]
