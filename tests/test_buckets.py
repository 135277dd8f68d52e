import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.buckets import Buckets
from lodestone.streaming import events

SCHEMA = "id long, name string, size long"


def rows_of(table):
    return sorted((tuple(r) for r in table.collect()), key=repr)


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/table/*/*.parquet")}


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    table = Buckets(spark, path, SCHEMA, ["id"], buckets=40)
    assert table.table().count() == 0
    first = spark.range(2000).selectExpr("id", "concat('n', id) as name", "id % 7 as size")
    assert len(table.upsert(first, 0)) == 40
    before = files_of(path)
    new = spark.createDataFrame([(5, None, 100), (7, "seven", None), (5000, "new", 1), (None, "null", 2)], SCHEMA)
    touched = table.upsert(new, 1)
    after = files_of(path)
    assert len(touched) <= 4 and {f for f in before if int(f.split("_bucket=")[1].split("/")[0]) not in touched} == set(before) & set(after)
    want = {i: (i, f"n{i}", i % 7) for i in range(2000)} | {5: (5, "n5", 100), 7: (7, "seven", 0), 5000: (5000, "new", 1), None: (None, "null", 2)}
    assert rows_of(table.table()) == sorted(want.values(), key=repr)
    assert table.upsert(new, 1) == [] and files_of(path) == after  # a batch that comes again
    assert Buckets(spark, path, SCHEMA, ["id"], buckets=40).table(touched).count() < 400
    assert table.upsert(spark.createDataFrame([(5, "x", 1)], SCHEMA), 2, keep_old=False) and (5, "x", 1) in rows_of(table.table())
    assert table.upsert(new.limit(0), 3) == []


@pytest.mark.parametrize("where", ["mark", "place"])
def test_a_crash_repeats_work(spark, tmp_path, monkeypatch, where):
    table = Buckets(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=8)
    table.fold(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA), 0, ["name"], ["size"])

    def crash(*_):
        raise OSError("lost")

    batch = spark.createDataFrame([(1, "c", 10), (1, "b", 10), (3, "d", 10)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(Buckets, "_place" if where == "place" else "_set_mark", crash)
        with pytest.raises(OSError):
            table.fold(batch, 1, ["name"], ["size"])
    for _ in range(2):
        table.fold(batch, 1, ["name"], ["size"])
    table.fold(batch.where("id = 3"), 2, ["name"], ["size"])
    assert rows_of(table.table()) == [(1, "c", 21), (2, "b", 1), (3, "d", 20)]


def test_files_of_a_million_paths(spark, tmp_path):
    path = str(tmp_path / "t")
    table = Buckets(spark, path, "file long, id string, text string", ["file", "id"], ["file"], buckets=64)
    nodes = spark.range(1_000_000).selectExpr("id as file", "concat(id, ':f') as id", "'v1' as text")
    table.upsert(nodes, 0)
    before = files_of(path)
    changed = spark.range(0, 1_000_000, 250_000).selectExpr("id as file")
    touched = table.replace(changed.unionByName(spark.createDataFrame([(7,)], "file long")), changed.selectExpr("file", "concat(file, ':g') as id", "'v2' as text"), 1)
    assert len(touched) <= 5 and len(set(before) & set(files_of(path))) >= 59
    some = table.table().where("file < 8 or file % 250000 = 0")
    assert rows_of(some) == sorted([(i, f"{i}:f", "v1") for i in range(1, 7)] + [(i, f"{i}:g", "v2") for i in range(0, 1_000_000, 250_000)], key=repr)


def test_a_bucket_without_rows(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=4)
    table.upsert(spark.range(3).selectExpr("id", "'x' as name", "id as size"), 0)
    table.replace(spark.range(3), spark.createDataFrame([], SCHEMA), 1)
    assert table.table().count() == 0
    table.replace(spark.range(1), spark.createDataFrame([(9, "b", 1), (9, "a", 2)], SCHEMA), 2)
    assert rows_of(table.table()) == [(9, "a", 2)]


def test_stream_of_repeated_and_reordered_deliveries(spark, tmp_path):
    rng = random.Random(1)
    sent = [(f"d{i}", 1_700_000_000 + i, i % 5, f"state {i}") for i in range(60)]
    want = sorted((k, f"state {55 + k}", 12) for k in range(5))
    schema = "delivery string, at timestamp, pr long, state string"
    for order in range(2):
        rows = sent + rng.sample(sent, 25)
        rng.shuffle(rows)
        folder = str(tmp_path / f"in{order}")
        for i in range(0, len(rows), 17):
            spark.createDataFrame(rows[i : i + 17], "delivery string, at long, pr long, state string").withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(folder)
        table = Buckets(spark, str(tmp_path / f"t{order}"), "pr long, at timestamp, state string, n long", ["pr"], buckets=4)
        handle = events.kept(table, lambda batch: batch.select("pr", "at", "state", F.lit(1).cast("long").alias("n")), ["at"], ["n"])

        def twice(batch, number, handle=handle):
            handle(batch, number)
            handle(batch, number)  # as after a failure

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        assert events.run(events.once(stream, late="1 hour"), twice, str(tmp_path / f"c{order}")).awaitTermination(180)
        assert sorted((r.pr, r.state, r.n) for r in table.table().collect()) == want


def test_tallies_follow_what_comes_and_goes(spark, tmp_path):
    from lodestone.operators.tallies import Tallies

    rng = random.Random(9)
    kept = Tallies(spark, str(tmp_path / "t"), buckets=20)
    edges = {}
    starts = spark.createDataFrame([(k, f"n{k}") for k in range(4)], "id long, name string")
    for number in range(4):
        rows = {"a": [], "b": []}
        for _ in range(60 if number == 0 else 3):
            branch, key = rng.choice("ab"), (rng.randrange(3), f"i{rng.randrange(25)}")
            n = -1 if edges.get((branch, *key)) and rng.random() < 0.6 else 1
            edges[(branch, *key)] = edges.get((branch, *key), 0) + n
            rows[branch].append((*key, n))
        changes = {b: spark.createDataFrame(r, "id long, item string, n long") for b, r in rows.items()}
        looked = kept.update(changes, number)
        assert kept.update(changes, number) == looked and (number == 0 or looked <= 3)
        want = [(k, f"n{k}", *(sum(1 for (b, i, _), n in edges.items() if b == branch and i == k and n > 0) for branch in "ab")) for k in range(4)]
        assert sorted(tuple(r) for r in kept.statistics(starts, ["a", "b"]).collect()) == want
    kept.update({"a": spark.createDataFrame([], "id long, item string, n long")}, 9)


def test_tallies_of_numbers_group_once_and_write_a_new_table_once(spark, tmp_path, monkeypatch):
    from lodestone.operators.tallies import Tallies

    written = []
    write = Buckets._write
    monkeypatch.setattr(Buckets, "_write", lambda self, rows, folder, mode: written.append((self.path, folder, rows._jdf.queryExecution().executedPlan().toString())) or write(self, rows, folder, mode))
    path = str(tmp_path / "t")
    kept = Tallies(spark, path, buckets=6, kind="long")
    rows = spark.range(3000).selectExpr("id % 4 as id", "'a' as branch", "id % 1500 - 7 as item", "1 as n")
    extra = spark.createDataFrame([(None, "a", 1, 1), (1, "b", None, 1), (1, "b", -5, 1)], "id long, branch string, item long, n int")
    assert kept.update(rows.unionByName(extra), 0) == 6 and not os.path.exists(f"{path}/items/aside")
    assert kept.update(rows.limit(0), 1) == 0
    assert kept.update(rows.where("item < 0").withColumn("n", F.lit(-2)), 2) > 0
    assert {f"items/{f}" for f in ("table", "aside/turn=0")} == {p[len(path) + 1 :] + "/" + f for p, f, _ in written if p.endswith("items")}
    # what a change groups is moved once, and lies in the bucket that it is written to
    assert all(plan.count("Exchange") <= 1 for p, f, plan in written if p.endswith("items"))
    items = kept.items.table(number="b")
    assert dict(items.dtypes)["item"] == "bigint" and items.where(F.col("b") != kept.items.bucket()).count() == 0
    starts = spark.createDataFrame([(i,) for i in range(5)], "id long")
    want = {i: sum(1 for k in {k % 1500 - 7 for k in range(3000) if k % 4 == i} if k >= 0) for i in range(5)}
    assert {r.id: (r.a, r.b) for r in kept.statistics(starts, ["a", "b"]).collect()} == {i: (n, int(i == 1)) for i, n in want.items()}


def test_a_crash_within_the_first_batch(spark, tmp_path, monkeypatch):
    table = Buckets(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets=8)

    def crash(*_):
        raise OSError("lost")

    batch = spark.createDataFrame([(1, "c", 10), (1, "b", 10), (3, "d", 10)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(Buckets, "_set_mark", crash)
        with pytest.raises(OSError):
            table.fold(batch, 0, ["name"], ["size"])
    for _ in range(2):
        table.fold(batch, 0, ["name"], ["size"])
    assert rows_of(table.table()) == [(1, "c", 20), (3, "d", 10)]


def test_kept_statistics_walk_branches_once(spark, monkeypatch):
    from lodestone.operators.tallies import Tallies
    from lodestone.plans import catalogue

    read = []
    update = Tallies.update

    def watched(self, changes, batch):
        for c in changes.values() if isinstance(changes, dict) else [changes]:
            read.extend(c.inputFiles())
        return update(self, changes, batch)

    monkeypatch.setattr(Tallies, "update", watched)
    got = catalogue.repo_stats_kept(spark, "/root/testdata/sf0.001")
    assert rows_of(got) == rows_of(catalogue.repo_stats(spark, "/root/testdata/sf0.001"))
    assert read and not [f for f in read if "sf0.001" in f]
