import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths, texts, vectors


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_languages_and_paths(spark):
    assert values(spark, paths.language, ["x.H", "x.hpp", "x.md", "a/b.PY", ".py", "noending", "a.b/c", None]) == ["c", "cpp", None, "python", None, None, None, None]
    assert values(spark, paths.ignored, ["src/.git/x.py", "build/x.py", "src/x.py", "./x.py", "a/.hidden/x"]) == [True, True, False, False, True]
    assert values(spark, paths.is_test, ["latest.py", "tests/a.go", "src/a.py", "a_SPEC.rb"]) == [True, True, False, True]
    assert values(spark, paths.is_readme, ["docs/README.md", "src/a.py"]) == [True, False]


def test_labels_of_ids(spark):
    ids = ["r:a.py:method:K:m", "r:doc:README", "r:a.py:file", "zzz", "repo:r", "package:os", "r:commit:1", "r:pr:3"]
    assert values(spark, paths.label_of_id, ids) == ["Function", "Doc", "File", "Node", "Repo", "Package", "Commit", "PullRequest"]


@pytest.mark.parametrize(
    "url, owner, name, full",
    [("git@github.com:o/n.git", "o", "n", "o/n"), ("https://github.com/o/n", "o", "n", "o/n"), ("/tmp/abc", "tmp", "abc", "tmp/abc"), ("single", "unknown", "single", "unknown"), ("github.com/o/n", "o", "n", "o/n")],
)
def test_repo_info(spark, url, owner, name, full):
    row = values(spark, paths.repo_info, [url])[0]
    assert (row.owner, row.name, row.full_name) == (owner, name, full)


def test_urls(spark):
    assert values(spark, paths.is_git_url, ["git@h:o/n", "https://h/o", "/a/x.git", "x"]) == [True, True, False, False]
    assert values(spark, paths.is_github_url, ["https://www.github.com/o", "https://gitlab.com/o", "git@github.com:o/n"]) == [True, False, True]
    assert values(spark, paths.branch_of_ref, ["refs/heads/main", None]) == ["main", None]


def test_persons(spark):
    df = spark.createDataFrame([("A B", " Me@X.io "), ("A B", None), (None, None)], "n string, e string")
    assert [r.p.id for r in df.select(paths.person(F.col("n"), F.col("e")).alias("p")).collect()] == ["person:me@x.io", "person:a_b", "person:"]


def test_packages(spark):
    assert values(spark, paths.js_package, ["@a/b/c", "./x", "lodash/fp", "y"]) == ["@a/b", None, "lodash", "y"]


def test_texts(spark):
    assert values(spark, texts.line_count, ["a\nb\n", "", None]) == [3, 1, -1] or values(spark, texts.line_count, ["a\nb\n", ""]) == [3, 1]
    assert values(spark, lambda c: texts.snippet(c, F.lit(2), F.lit(3)), ["1\n2\n3\n4"]) == ["2\n3"]
    assert values(spark, lambda c: texts.truncated(c, 3, "!"), ["abcd", "abc", None]) == ["abc!", "abc", None]
    assert values(spark, texts.blank, [" \n", "", None, "x"]) == [True, True, True, False]
    assert [str(v) for v in values(spark, texts.iso_time, ["2024-01-02T03:04:05Z", "nonsense"])] == ["2024-01-02 03:04:05", "None"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(F.round(vectors.cosine(F.col("a"), F.col("b")), 9)).collect()]
    assert got == [0.0, 1.0, None, None]
    assert [r[0] for r in df.limit(1).select(F.round(vectors.euclidean(F.col("a"), F.col("b")), 6)).collect()] == [1.414214]
