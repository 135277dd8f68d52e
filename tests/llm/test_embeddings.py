import numpy as np

from lodestone.llm import embeddings as E


def brute(rows, least=0.95):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        return x / np.linalg.norm(x)

    units = [unit(v) for _, v in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least_id = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(near[i]), least_id, rows[i][0] == least_id))
    return sorted(out)


def check(spark, rows, **more):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "0 as label", "1 as n_links")
    assert sorted(map(tuple, E.near_duplicates(table, **more).collect())) == brute(rows)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base.astype(np.float32))]
    rows += [(100 + i, (base[i % 20] + 0.12 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(80)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] + [1.0] * 15), (204, [None] + [1.0] * 15), (205, [float("inf")] + [0.0] * 15), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (208, [3.0] * 17), (209, rows[0][1]), (210, rows[0][1]), (211, (3 * base[0]).astype(np.float32).tolist()), (212, [1e30] * 16), (213, [1e-30] * 16)]
    check(spark, rows, cell_size=8, block=5)
    check(spark, rows, cell_size=20, block=7)
    check(spark, rows)


def test_whole_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(700, 64))
    centres[350:, 3:] *= 0.01  # in these all the difference is in three directions
    rows = [(i, v.tolist()) for i, v in enumerate(centres.astype(np.float32))]
    step = rng.normal(size=(700, 64))
    step[350:, 3:] *= 0.01
    step *= 0.3 * np.linalg.norm(centres, axis=1)[:, None] / np.linalg.norm(step, axis=1)[:, None]
    rows += [(1000 + i, v.tolist()) for i, v in enumerate((centres + step).astype(np.float32))]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cell_size=32, block=100).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_hot_spots_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    spot = np.ones(16) + 0.05 * rng.normal(size=(260, 16))
    rim = np.ones(16) + 0.25 * rng.normal(size=(120, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((spot, rim, rng.normal(size=(150, 16)))).astype(np.float32))]
    check(spark, rows, cell_size=100, block=40)
    check(spark, rows + rows[:50], cell_size=100, block=40)
    check(spark, rows + [(1000 + i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(200, 9)))], cell_size=100, block=40)
    got = E.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_groups_are_two_blocks(spark, monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(6)
    spot = np.concatenate((np.ones((2000, 8)) + 0.02 * rng.normal(size=(2000, 8)), rng.normal(size=(2000, 8))))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(spot)], "vec_id long, embedding array<double>")
    sizes = []
    real = type(table.groupBy("vec_id")).applyInPandas

    def spy(self, func, schema):
        if "root" in str(schema):
            sizes.extend(r["count"] for r in self.count().collect())
        return real(self, func, schema)

    monkeypatch.setattr(type(table.groupBy("vec_id")), "applyInPandas", spy)
    rows = E.near_duplicates(table, cell_size=500, block=200).collect()
    assert len(rows) == 4000 and sizes and max(sizes) <= 2 * 200 * 1.5  # blocks by hash are not quite even
    assert isinstance(pd.Series(sizes).sum(), (int, np.integer)) and sum(sizes) < 40 * 4000


def test_empty_and_bad(spark):
    check(spark, [])
    check(spark, [(1, None), (2, [0.0])])
    got = E.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (None, None), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == sorted([(None, 1, 4), (None, 0, None), (4, 1, 4)], key=repr)


def test_vectors_that_share_one_hash_are_told_apart(spark, monkeypatch):
    """A planted collision: all vectors have the same first hash."""
    from pyspark.sql import functions as F

    from lodestone.llm import embeddings as E

    class Colliding:
        def __getattr__(self, name):
            return getattr(F, name)

        def xxhash64(self, *columns):
            return F.lit(7).cast("long") if len(columns) == 1 else F.xxhash64(*columns)

    monkeypatch.setattr(E, "F", Colliding())
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 0.0, 1.0]), (6, None)]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True)]
