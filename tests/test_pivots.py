import numpy as np
import pytest

from lodestone.operators import pivots, search
from lodestone.operators.pivots import PivotIndex

SCHEMA = "id long, label string, embedding array<float>"


def clustered(n, clusters, dimension=16, spread=0.03, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dimension))
    return [(i, f"l{i % 2}" if i % 11 else None, (centres[i % clusters] + spread * rng.normal(size=dimension)).astype(np.float32).tolist()) for i in range(n)]


def scan(rows, queries, limit, but_itself=False, label=None):
    out = []
    for name, q in queries:
        q = np.array(q, float)
        found = []
        for i, l, v in rows:
            v = np.array([np.nan if x is None else x for x in v or []], float)
            if len(v) == len(q) and np.isfinite(v).all() and v.any() and not (but_itself and i == name) and (label is None or l == label):
                found.append((-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 6), i, l))
        out += [(name, i, l, pytest.approx((1 - c) / 2, abs=1e-9), k + 1) for k, (c, i, l) in enumerate(sorted(found, key=lambda x: x[:2])[:limit])]
    return sorted(out, key=lambda r: (r[0], r[4]))


def got(table):
    return sorted([tuple(r) for r in table.collect()], key=lambda r: (r[0], r[4]))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = clustered(3000, 30)
    path = str(tmp_path_factory.mktemp("pivots") / "index")
    PivotIndex.build(spark.createDataFrame(rows, SCHEMA), path, 16, pivots=24, rings=2)
    return rows, PivotIndex.open(spark, path)


def test_equals_a_scan_and_skips_files(spark, index):
    import glob
    import shutil

    rows, index = index
    queries = [(i, rows[i][2]) for i in (0, 7, 400, 2999)] + [(-1, [1.0] * 16)]
    asked = spark.createDataFrame(queries, "query long, embedding array<double>")
    assert got(index.nearest(asked, 5)) == scan(rows, queries, 5)
    assert got(index.nearest(asked, 7, but_itself=True)) == scan(rows, queries, 7, True)
    assert got(index.nearest(asked, 3, label="l1")) == scan(rows, queries, 3, label="l1")
    one = queries[1:2]
    unit = np.array([one[0][1]], float)
    visits = index.visits(unit / np.linalg.norm(unit), 5, [7])
    read, left = visits.sum(), (~visits).sum()
    assert index.rows[visits[0]].sum() < 0.2 * index.rows.sum() and left > 4 * read
    # what is skipped isn't opened: without those files the answer is the same
    for (cell, _), visited in zip(index.cells, visits[0], strict=True):
        if not visited:
            for f in glob.glob(f"{index.path}/vectors/cell={cell}"):
                shutil.rmtree(f)
    assert got(index.nearest(asked.where("query = 7"), 5)) == scan(rows, one, 5)


def test_many_queries_go_by_blocks(spark, tmp_path, monkeypatch):
    rows = clustered(300, 5, 8)
    index = PivotIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "i"), 8, pivots=4, rings=2)
    monkeypatch.setattr(pivots, "BLOCK", 400)
    queries = [(i, rows[i][2]) for i in range(0, 300, 20)]
    asked = spark.createDataFrame(queries, "query long, embedding array<double>")
    assert got(index.nearest(asked, 4, but_itself=True)) == scan(rows, queries, 4, True)


def test_odd_vectors_ties_and_few_rows(spark, tmp_path):
    v = [1.0, 2.0, 3.0]
    rows = [(i, "a", v) for i in range(40)] + [(50, "a", None), (51, "a", []), (52, "a", [0.0, 0.0, 0.0]), (53, "a", [1.0, None, 2.0]), (54, "a", [float("nan"), 1.0, 1.0]), (55, "b", [1.0]), (56, None, [-1.0, -2.0, -3.0])]
    table = spark.createDataFrame(rows, SCHEMA)
    index = PivotIndex.build(table, str(tmp_path / "i"), 3, pivots=4, rings=3, rows_per_file=8)
    queries = [(3, v), (60, [0.0, 0.0, 1.0])]
    asked = spark.createDataFrame([*queries, (61, [0.0, 0.0, 0.0]), (62, [1.0]), (63, None)], "query long, embedding array<double>")
    assert got(index.nearest(asked, 5)) == scan(rows, queries, 5) and got(index.nearest(asked, 60, but_itself=True)) == scan(rows, queries, 60, True)
    assert got(index.nearest(asked.where("query = 3"), 5)) == [(3, i, "a", pytest.approx(1.0), i + 1) for i in range(5)]
    empty = PivotIndex.build(table.limit(0), str(tmp_path / "e"), 3)
    assert empty.nearest(asked, 5).count() == 0


def test_like_the_scan_of_search(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id as id", "cast(label as string) label", "embedding")
    index = PivotIndex.build(e, str(tmp_path / "i"), 64, pivots=6, rings=1)
    q = e.where("id = 17").first().embedding
    want = search.vector_search(e, [float(x) for x in q], 8).select("id", "vector_score").collect()
    found = index.nearest(spark.createDataFrame([(17, q)], "query long, embedding array<double>"), 8).orderBy("rank").collect()
    assert [(r.id, round(r.vector_score, 6)) for r in found] == [(r.id, round(r.vector_score, 6)) for r in want]
