import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.operators import extract
from lodestone.sources import files, history
from lodestone.streaming import events

PYTHON = 'import os.path\nimport numpy as np\nfrom json import loads\nX = 1\ndef test_top(a, b):\n    """doc"""\n    return a\nclass K:\n    def m(self):\n        def inner():\n            pass\n@deco\ndef skipped():\n    pass\n# note\n'
SCRIPT = "import x from '@scope/pkg/sub';\nimport y from './local';\nconst z = require('lodash/fp');\nlog('hello');\nvar v = 1; let w = 2;\nfunction f(a) { function g() {} }\nconst arrow = (q) => q;\nclass C { run(n) { return n; } }\n"


def symbols(spark, path, content):
    df = spark.createDataFrame([("r", path, content)], "repo string, path string, content string")
    rows = extract.symbols(df).collect()
    return [r for r in rows if r.kind == "node"], {(r.src, r.type, r.dst) for r in rows if r.kind == "edge"}


def names(rows, label, sort=None):
    return {r.name for r in rows if r.label == label and (sort is None or r.sort == sort)}


def test_python_symbols(spark):
    rows, edges = symbols(spark, "pkg/test_a.py", PYTHON)
    assert names(rows, "Package") == {"os", "json"} and names(rows, "Variable") == {"X"} and names(rows, "Class") == {"K"}
    assert names(rows, "Function", "function") == {"test_top"} and names(rows, "Function", "method") == {"m", "inner"}
    top = next(r for r in rows if r.name == "test_top" and r.label == "Function")
    assert (top.signature, top.start_line, top.end_line) == ("test_top(a, b)", 5, 7)
    assert {(r.sort, r.start_line) for r in rows if r.label == "Doc"} == {("docstring", 6), ("comment", 15)}
    assert {(r.name, r.sort) for r in rows if r.label == "Test"} == {("test_top", "unit")}
    assert ("r:pkg/test_a.py:class:K", "HAS_METHOD", "r:pkg/test_a.py:method:K:inner") in edges
    assert ("r:pkg/test_a.py:file", "IMPORTS", "package:os") in edges


def test_script_symbols(spark):
    rows, _ = symbols(spark, "web/a.js", SCRIPT)
    assert names(rows, "Package") == {"@scope/pkg", "lodash", "hello"} and names(rows, "Variable") == {"v"}
    assert names(rows, "Function", "function") == {"f", "g"} and names(rows, "Class") == {"C"}
    assert [r.signature for r in rows if r.sort == "method"] == ["run(n)"]
    assert names(symbols(spark, "web/a.ts", SCRIPT)[0], "Package") == {"@scope/pkg"}


def test_broken_and_missing_sources(spark):
    assert symbols(spark, "a.py", "def (")[0] == [] and symbols(spark, "a.py", None)[0] == [] and symbols(spark, "a.js", "class { ' ( function")[0] == []
    df = spark.createDataFrame([("r", "a.py", PYTHON), ("r", "b.md", "x")], "repo string, path string, content string")
    assert [(r.id, r.lines) for r in extract.file_nodes(df).collect()] == [("r:a.py:file", 16)]


def test_scan_and_readme(spark, tmp_path):
    for path, text in {"src/a.py": "x = 1\n", ".git/b.py": "", "build/c.py": "y = 2\n", "README.md": "hello" * 3, "notes.txt": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert [(r.path, r.content) for r in files.scan(spark, str(tmp_path), "r").collect()] == [("src/a.py", "x = 1\n")]
    everything = files.all_files(spark, str(tmp_path), "r").withColumn("content", F.decode("bytes", "UTF-8"))
    assert [r.text for r in files.readme(everything, 5).collect()] == ["hello\n\n... (truncated)"]
    wanted = spark.createDataFrame([("build/c.py",), ("gone.py",)], "path string")
    assert [r.path for r in files.listed(everything, wanted).collect()] == ["build/c.py"]


def test_git_log(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A B", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)

    git("init", "-q")
    for i in range(3):
        (tmp_path / "a.txt").write_text("x\n" * (i + 1))
        git("add", "-A")
        git("commit", "-qm", f"change {i}\n\nbody")
    log = history.git_log(spark, str(tmp_path)).collect()
    assert [(r.message, r.insertions, r.files_changed) for r in log] == [(f"change {i}\n\nbody", 1, ["a.txt"]) for i in (2, 1, 0)]
    assert history.git_log(spark, str(tmp_path), 2).count() == 2


def test_blame(spark):
    report = "abcdef1 1 1 2\nauthor A\n\tx\nabcdef1 2 2\n\ty\n"
    df = spark.createDataFrame([("p", report), ("q", None)], "path string, report string")
    assert [tuple(r) for r in history.blame(df).collect()] == [("p", 1, "abcdef1", "A"), ("p", 2, "abcdef1", "A")]


@pytest.mark.parametrize(
    "kind, body, status, branch",
    [
        ("push", '{"ref":"refs/heads/main","repository":{"clone_url":"u"}}', "triggered", "main"),
        ("push", '{"repository":{"clone_url":"u"}}', "ignored", None),
        ("pull_request", '{"action":"opened","pull_request":{"number":1}}', "processed", None),
        ("pull_request", '{"action":"closed","repository":{"html_url":"u"},"pull_request":{"number":1,"merged":true,"base":{"ref":"main"}}}', "triggered", "main"),
        ("issues", "{}", "ignored", None),
        ("push", "broken", "ignored", None),
    ],
)
def test_routes(spark, kind, body, status, branch):
    row = events.routed(events.parsed(spark.createDataFrame([(kind, body)], "event_type string, body string"))).first()
    assert (row.status, row.branch) == (status, branch)


def test_signatures():
    assert events.verified(b"x", None, "") and not events.verified(b"x", None, "s")
    assert events.verified(b"x", "sha256=3d0ae1e46d0c81b82bd2a2e6f0e5b1b4e5d2a7f1", "s") is False


def test_stream_equals_batch(spark, tmp_path):
    from lodestone.operators import dml

    rows = [("pull_request", f'{{"action":"opened","repository":{{"html_url":"https://github.com/o/n"}},"pull_request":{{"number":{i % 5},"title":"t{i}","user":{{"login":"u"}}}}}}') for i in range(12)]
    schema = "event_type string, body string"
    for i in range(0, 12, 4):
        spark.createDataFrame(rows[i : i + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    empty = events.pull_requests(events.parsed(spark.createDataFrame([], schema)))

    def change(old, batch):
        new = events.pull_requests(events.parsed(batch)).dropDuplicates(["id"])
        return dml.upsert(old, new, ["id"], keep_old=False)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = events.run(stream, events.versioned(spark, str(tmp_path / "out"), empty, change), str(tmp_path / "checkpoint"))
    assert query.awaitTermination(120)
    last = events.newest(spark, str(tmp_path / "out"), empty)
    assert events.newest(spark, str(tmp_path / "none"), empty).count() == 0
    assert {r.id for r in last.collect()} == {f"n:pr:{i}" for i in range(5)} and last.count() == 5


def test_renames_and_ranges(spark, tmp_path, monkeypatch):


    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A B", "-c", "user.email=a@x.io", *args], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n" * 20)
    git("add", "."), git("commit", "-qm", "first")
    (tmp_path / "lib").mkdir()
    git("mv", "a.py", "lib/b.py"), git("commit", "-qm", "moved")
    for i in range(5):
        (tmp_path / "c.py").write_text(f"y = {i}\n")
        git("add", "."), git("commit", "-qm", f"step {i}\n\nmore")
    monkeypatch.setattr(history, "COMMITS", 3)
    rows = history.git_log(spark, str(tmp_path)).collect()
    assert [r.message for r in rows][-2:] == ["moved", "first"] and len(rows) == 7 == len({r.sha for r in rows})
    assert rows[-2].files_changed == ["lib/b.py"] and rows[-1].files_changed == ["a.py"] and rows[0].message == "step 4\n\nmore"
    assert len(history.git_log(spark, str(tmp_path), most=2).collect()) == 2
    assert [history.path_now(p) for p in ("a/{b => c}/d.py", "a/{ => c}/d.py", "a/{b => }/d.py", "x => y", "z")] == ["a/c/d.py", "a/c/d.py", "a/d.py", "y", "z"]


def test_update_by_state(spark):
    from lodestone.operators import ingest

    def parse(df):
        nodes = df.select(F.concat(F.lit("r:"), "path", F.lit(":file")).alias("id"), F.lit("File").alias("label"), "sha")
        return nodes, nodes.select(F.lit("repo:r").alias("src"), F.col("id").alias("dst"), F.lit("HAS_FILE").alias("type"))

    def files(**shas):
        return spark.createDataFrame([("r", p, s, "") for p, s in shas.items()], "repo string, path string, sha string, content string")

    none = spark.createDataFrame([], "repo_name string, repo_sha string, updated_at timestamp")
    empty = parse(files(x="").limit(0))
    first = ingest.update(*empty, none, None, files(a="1", b="1"), "r", "c1", parse)
    assert {(r.id, r.sha) for r in first[0].collect()} == {("r:a:file", "1"), ("r:b:file", "1")} and ingest.last_sha(first[2], "r") == "c1"
    assert ingest.update(*first, None, files(z="9"), "r", "c1", parse) == first
    second = ingest.update(*first, files(a="1", b="1"), files(a="2", c="1"), "r", "c2", parse)
    assert {(r.id, r.sha) for r in second[0].collect()} == {("r:a:file", "2"), ("r:c:file", "1")} and ingest.last_sha(second[2], "r") == "c2"


def test_incremental_equals_full(spark):
    def parse(df):
        found = extract.symbols(df)
        return found.where("kind = 'node'").select("id", "label", "name"), found.where("kind = 'edge'").select("src", "dst", "type")

    def manifest(contents):
        return spark.createDataFrame([("r", p, str(hash(c)), c) for p, c in contents.items()], "repo string, path string, sha string, content string")

    old = manifest({"a.py": "def f():\n    pass\n", "b.py": "class K:\n    def m(self):\n        pass\n", "c.py": "import os\n"})
    new = manifest({"a.py": "def g():\n    pass\n", "c.py": "import os\n", "d.py": "import re\n"})
    nodes, edges = parse(old)
    got_nodes, got_edges = events.incremental(nodes, edges, old, new, "r", parse)
    want_nodes, want_edges = parse(new)
    assert {r.id for r in got_nodes.collect()} == {r.id for r in want_nodes.collect()}
    assert {tuple(r) for r in got_edges.collect()} == {tuple(r) for r in want_edges.collect()}


def follow(touches, limit):
    """Walks back from each present file, commit by commit."""
    names, out = {}, {}
    for path, old, at, sha in sorted(touches, key=lambda t: (t[2], t[3])):
        before = names.pop(old, []) if old is not None else names.get(path, [])
        names[path] = [*before, (sha, at, path)]
    for path, line in names.items():
        out[path] = line[::-1][:limit]
    return sorted((path, sha, at, touched, i + 1) for path, line in out.items() for i, (sha, at, touched) in enumerate(line))


@pytest.mark.parametrize("limit", [3, 1000])
def test_history_follows_renames(spark, limit):
    import random

    rng = random.Random(4)
    touches = []
    for i in range(300):
        a, b = rng.sample([f"p{k}" for k in range(7)], 2)
        touches.append((a, b, i // 3, f"{i:04d}") if rng.random() < 0.4 else (a, None, i // 3, f"{i:04d}"))
    # a chain of renames, and a path that is used again after it was renamed
    touches += [(f"c{i + 1}", f"c{i}", 1000 + i, f"x{i:04d}") for i in range(150)] + [("c0", None, 999, "first"), ("c0", None, 2000, "again")]
    table = spark.createDataFrame(touches, "path string, old_path string, committed_at long, sha string").repartition(3)
    assert sorted(tuple(r) for r in history.followed(table, limit).collect()) == follow(touches, limit)
    assert history.followed(table.where("old_path is null"), 2).count() > 0 and history.followed(table.limit(0)).count() == 0


def test_both_paths_of_a_rename():
    assert [(history.path_now(p), history.path_before(p)) for p in ("a.py", "a => b", "x/{b => c}/d", "x/{ => c}/d", "x/{b => }/d")] == [("a.py", None), ("b", "a"), ("x/c/d", "x/b/d"), ("x/c/d", "x/d"), ("x/d", "x/b/d")]


def longest(a, b):
    """Length of a longest common subsequence by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_kept_lines_are_a_longest_common_subsequence():
    import random

    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in "ab")
        kept = history.kept_lines(a, b)
        found = [(i, j) for j, i in enumerate(kept) if i >= 0]
        assert len(kept) == len(b) and all(a[i] == b[j] for i, j in found) and len(found) == longest(a, b)
        assert all(x[0] < y[0] for x, y in zip(found, found[1:]))
    assert history.kept_lines([], []) == [] and history.kept_lines(list("abc"), list("abc")) == [0, 1, 2]


def test_blame_is_worked_out(spark):
    import random

    rng = random.Random(8)
    rows, want = [], {}
    for path in ("a", "b", "c"):
        lines, origins = [], []
        for number in range({"a": 1, "b": 40, "c": 7}[path]):
            new = [x for x in lines if rng.random() < 0.9]
            for _ in range(rng.randrange(4)):
                new.insert(rng.randrange(len(new) + 1), f"{rng.randrange(6)}")
            kept = history.kept_lines(lines, new)
            origins = [number if i < 0 else origins[i] for i in kept]
            lines = new
            rows.append((path, number, f"{path}{number}", f"by {number % 4}", "\n".join(lines) + ("\n" if lines and number % 2 else "")))
        want[path] = origins
    rows += [("gone", 0, "g0", "x", "one\ntwo"), ("gone", 1, "g1", "x", None), ("null", 0, "n0", "x", None), ("blank", 0, "k0", "y", "\n"), ("twice", 0, "t0", "z", "a\n\n")]
    versions = spark.createDataFrame(rows, "path string, number int, sha string, author string, content string").repartition(3)
    got = sorted(tuple(r) for r in history.blamed(versions).collect())
    assert got == sorted([(p, i + 1, f"{p}{n}", f"by {n % 4}") for p, origins in want.items() for i, n in enumerate(origins)] + [("blank", 1, "k0", "y"), ("twice", 1, "t0", "z"), ("twice", 2, "t0", "z")])


def test_a_scan_opens_code_alone(spark, tmp_path):
    root = tmp_path / "my repo"
    names = ["a.py", "src/[id]/b.ts", "src/k=v/c.go", "src/{x}/d e.js", "UP.PY", "node_modules/x/e.js", "src/.hidden/f.py", "vendor/g.py", "notes.txt", "src/h.bin", "é/ü.py", "a%20b.py"]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(f"// {n}\n")
    found = files.scan(spark, str(root), "r")
    code = sorted(names[:5] + ["é/ü.py", "a%20b.py"])
    assert sorted((r.path, r.content) for r in found.collect()) == [(n, f"// {n}\n") for n in code]
    assert len(found.inputFiles()) == len(code) and not any("node_modules" in f or "vendor" in f or ".txt" in f for f in found.inputFiles())
    assert files.named(spark, str(root), "r").agg(F.sum("size")).first()[0] == sum(len(f"// {n}\n".encode()) for n in names if "hidden" not in n)  # Spark itself hides such folders
    assert files.scan(spark, str(root / "vendor"), "r").count() == 1
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x")
    assert files.scan(spark, str(tmp_path / "none"), "r").count() == 0


def test_symbols_go_on_in_small_batches(spark):
    """Files come in small batches, and a file with more symbols than are gathered at once loses none."""
    big = "\n".join(f"# note {i}" for i in range(2 * extract.ROWS))
    files = spark.createDataFrame([("r", f"a{i}.py", big if i == 3 else "x = 1\n# one") for i in range(300)] + [("r", "none.py", None)], "repo string, path string, content string")
    found = extract.symbols(files, owned=True)
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= extract.FILES
    docs = {r.owner: r.n for r in found.where("kind = 'node' and label = 'Doc'").groupBy("owner").agg(F.count("*").alias("n")).collect()}
    assert len(docs) == 300 and docs["r:a3.py:file"] == 2 * extract.ROWS and docs["r:a4.py:file"] == 1
