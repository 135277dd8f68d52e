import json

from lodestone import cli
from lodestone.operators import answer, ingest
from lodestone.sources.history import COMMIT

FILES = [("r", "a.py", "import os\nclass K:\n    def m(self):\n        pass\n"), ("r", "web/b.js", "function f(a) { return a; }\n")]
COMMITS = [("s1", "A B", "a@b.c", "2024-01-01T00:00:00", "first", 2, 0, ["a.py"]), ("s2", "A B", " A@B.c", "2024-01-02T00:00:00", "second", 1, 1, ["a.py", "web/b.js"])]


def graph(spark):
    files = spark.createDataFrame(FILES, "repo string, path string, content string")
    return ingest.full_ingest(files, spark.createDataFrame(COMMITS, COMMIT), "r", "https://github.com/o/r", dimension=8)


def test_full_ingest(spark):
    nodes, edges = graph(spark)
    rows = {r.id: r for r in nodes.collect()}
    assert {"repo:r", "r:a.py:file", "r:a.py:class:K", "r:a.py:method:K:m", "package:os", "r:web/b.js:file", "r:web/b.js:function:f", "r:commit:s1", "r:commit:s2", "person:a@b.c"} == set(rows)
    assert rows["r:a.py:file"].language == "python" and rows["r:a.py:file"].repo_name == "r" and all(r.embedding is not None for r in rows.values())
    found = {tuple(r) for r in edges.select("src", "type", "dst").collect()}
    assert {("r:commit:s2", "TOUCHED", "r:web/b.js:file"), ("r:commit:s1", "AUTHORED_BY", "person:a@b.c"), ("repo:r", "HAS_FILE", "r:a.py:file"), ("r:a.py:file", "BELONGS_TO", "repo:r")} <= found
    assert {r.label: r.n for r in ingest.counts_by_label(nodes).collect()}["Commit"] == 2


def test_last_commits_and_state(spark):
    commits = spark.createDataFrame(COMMITS, COMMIT)
    assert {(r.src, r.dst) for r in ingest.last_commits(commits, "r").collect()} == {("r:commit:s2", "r:a.py:file"), ("r:commit:s2", "r:web/b.js:file")}
    state = spark.createDataFrame([], "repo_name string, repo_sha string, updated_at timestamp")
    state = ingest.with_state(ingest.with_state(state, "r", "1"), "r", "2")
    assert ingest.last_sha(state, "r") == "2" and ingest.last_sha(state, "x") is None and state.count() == 1


def test_answers(spark):
    row = [(1, "Function", "f", "text", 0.5, "s", None, None)]
    context = spark.createDataFrame(row, "position int, label string, name string, content string, score double, sha string, snippet string, message string")
    records = list(answer.answer(context, "why"))
    assert records[0]["items"][0]["name"] == "f" and records[-1] == {"type": "done"} and any("text" in r.get("text", "") for r in records)
    assert list(answer.answer(context.limit(0), "why"))[1]["text"].startswith("No relevant")
    body = "".join(answer.events(iter(records))) + "noise\ndata: plain\n"
    got = answer.received(spark.createDataFrame([(1, body)], "id int, body string")).orderBy("i").collect()
    assert [r.kind for r in got] == ["context", *["chunk"] * (len(records) - 2), "done", "end", "raw"] and got[-1].text == "plain"


def test_cli(capsys):
    cli.main(["languages"])
    cli.main(["settings"])
    out = capsys.readouterr().out
    assert "python .py .pyi" in out and json.loads(out.strip().split("\n")[-1])["max_limit"] == 100


def test_command_line(spark, tmp_path, capsys):
    from lodestone import cli

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\n\ndef f():\n    return 1\n")
    (tmp_path / "src" / "b.txt").write_text("text")
    cli.main(["analyze", str(tmp_path / "src"), "--name", "r", "--out", str(tmp_path / "graph")])
    said = capsys.readouterr().out
    assert "Function 1" in said and "'parsed': 1" in said and "'skipped': 1" in said
    cli.main(["stats", str(tmp_path / "graph")])
    assert "Function 1" in capsys.readouterr().out
    cli.main(["validate", str(tmp_path / "graph")])
    assert capsys.readouterr().out.strip() == "repeated identifiers: 0, edges without ends: 0"
    cli.main(["clear", str(tmp_path / "graph"), "repo:r", "--out", str(tmp_path / "cleared")])
    cli.main(["stats", str(tmp_path / "cleared")])
    assert "Function" not in capsys.readouterr().out
    for command in ("languages", "settings", "flags"):
        cli.main([command])
        assert capsys.readouterr().out


def test_fifty_changed_files_rewrite_few_buckets(spark, tmp_path):
    from lodestone.operators.ingest import GraphTables

    schema = "repo string, path string, sha string, content string"

    def manifest(contents):
        return spark.createDataFrame([("r", p, str(hash(c)), c) for p, c in contents.items()], schema)

    first = {f"m{i}.py": f"import os\n\n\ndef f{i}():\n    pass\n" for i in range(600)}
    second = {p: c for p, c in first.items() if p != "m3.py"} | {"m5.py": "class New:\n    pass\n", "new.py": "import json\n"}
    tables = GraphTables(spark, str(tmp_path / "g"), 100)
    assert len(tables.update(None, manifest(first), "r", "c1", 0)) > 90
    assert 1 <= len(tables.update(manifest(first), manifest(second), "r", "c2", 1)) <= 3
    assert tables.update(manifest(first), manifest(second), "r", "c2", 2) == []
    fresh = GraphTables(spark, str(tmp_path / "h"), 10)
    fresh.update(None, manifest(second), "r", "c2", 0)
    for kept, want in zip(tables.graph(), fresh.graph(), strict=True):
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, want.select(*kept.columns).collect()))
    nodes = {r.id for r in tables.graph()[0].collect()}
    assert {"package:os", "package:json", "r:m5.py:class:New", "r:new.py:file"} <= nodes and not any("m3.py" in n or "f5" in n.split(":")[-1:] for n in nodes)
    assert tables.state.table().first().repo_sha == "c2" and tables.update(None, manifest(second), "r", "c3", 3)
