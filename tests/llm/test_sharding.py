import numpy as np
import pytest

from lodestone.llm import sharding as S


def shards(table, **more):
    rows = S.shuffle_to_shards(table, **more).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return rows, {k: len(v) for k, v in by.items()}


@pytest.mark.parametrize("n, cell", [(0, 10), (1, 10), (23, 1), (500, 3), (1001, 4096)])
def test_exact_sizes(spark, tmp_path, n, cell):
    table = spark.createDataFrame([(i if i % 7 else None, "x" * (i % 5) if i % 3 else None) for i in range(n)], "doc_id long, text string").selectExpr("*", "'a' as shard", "0 as Slot")
    rows, sizes = shards(table, shards=24, rows_per_cell=cell)
    assert len(rows) == n and sorted(sizes.get(s, 0) for s in range(24)) == sorted(n // 24 + (s < n % 24) for s in range(24))
    table.repartition(5).write.parquet(str(tmp_path / "t"))
    kept = spark.read.parquet(str(tmp_path / "t"))
    first, again = (shards(kept, shards=24, rows_per_cell=cell)[0] for _ in range(2))
    assert sorted(first, key=repr) == sorted(again, key=repr) and len(first) == n
    some, _ = shards(kept.where("doc_id > 10"), shards=24, rows_per_cell=cell)
    assert len(some) == kept.where("doc_id > 10").count()


def test_matrix_keeps_both_sums_and_is_uniform():
    parts, cells = [7, 0, 13, 5], [9, 8, 8]
    draws = np.array([S.communication_matrix(parts, cells, seed) for seed in range(3000)])
    assert (draws.sum(axis=2) == parts).all() and (draws.sum(axis=1) == cells).all()
    assert np.allclose(draws.mean(axis=0), np.outer(parts, cells) / 25, atol=0.08)
    assert S.communication_matrix([], [0, 0], 1).shape == (0, 2)


def test_places_are_uniform(spark, tmp_path):
    spark.range(40).repartition(3).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    seen = np.zeros((40, 4))
    for seed in range(60):
        for r in S.shuffle_to_shards(table, shards=4, seed=seed).collect():
            seen[r.id, r.shard] += 1
    assert (seen.sum(axis=1) == 60).all() and seen.max() < 34 and seen.min() > 2


def test_written_shards(spark, tmp_path):
    S.write_shards(S.shuffle_to_shards(spark.range(30).selectExpr("id", "cast(id as string) as text"), shards=3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().collect().__len__() == 3


def test_cells_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "CELLS", 12)
    table = spark.range(1000).selectExpr("id", "cast(id as string) as text")
    dealt = S.shuffle_to_shards(table, shards=5, rows_per_cell=3)
    assert dealt.rdd.getNumPartitions() == 10
    rows = dealt.collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(5) for k in range(200)]
