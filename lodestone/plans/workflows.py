"""Queries of whole jobs: sources to symbols and graphs, changes, webhooks, retrieval, answers and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.config import Flag, Flags, Settings, read_env
from lodestone.functions import paths, texts
from lodestone.operators import answer, dml, embed, extract, graph, ingest, rag, search
from lodestone.operators.buckets import Buckets
from lodestone.session import table
from lodestone.sources import files as source_files
from lodestone.sources import history
from lodestone.streaming import events as webhooks

from . import fixture
from .catalogue import _ISSUE, SQL_DOCS, SQL_SCORED, VECTOR, _ask_sql, _customers, _path, _path_sql, _users, _webhooks
from .registry import oracle_sql, query

# symbols: a source for each document, with all its lines as comments


def _sources(spark, d, ending: str, head: list[str], comment: str):
    """(repo, path, content): @ in head is the document's number and % an @; the document's lines follow as comments."""
    number = F.col("doc_id").cast("string")
    lines = F.transform(F.split(F.translate("text", "\r", " "), "\n"), lambda x: F.concat(F.lit(comment), x))
    code = F.concat(*(F.translate(F.replace(F.lit(line + "\n"), F.lit("@"), number), "%", "@") for line in head), F.array_join(lines, "\n"))
    return table(spark, d, "documents").select(F.lit("r").alias("repo"), F.concat(F.lit("pkg/test_"), number, F.lit(ending)).alias("path"), code.alias("content"))


def _symbols_sql(ending: str, head: list[str], comment: str, nodes: list[tuple], edges: list[tuple], comments: bool) -> str:
    """nodes are (label, end of the id, name, first line, last line, signature, sort, condition); edges are (source, end of the id, type, condition).

    A source or id that begins with : belongs to the file; $ is the file itself.
    """

    def text(x: str | None) -> str:
        return "NULL" if x is None else "replace(replace('" + x.replace("'", "''") + "', '@', n), '%', '@')"

    def identifier(x: str) -> str:
        return "file" if x == "$" else f"own || {text(x)}" if x.startswith(":") else text(x)

    listed = ", ".join(text(line) for line in head)
    parts = [
        f"""SELECT 'node' AS kind, '{label}' AS label, {identifier(tail)} AS id, {text(name)} AS name, NULL AS src, NULL AS dst, NULL AS type, {a} AS start_line, {b} AS end_line, {text(signature)} AS signature,
  {"NULL" if label == "Package" else f"array_to_string(list_slice(ls, {a}, least({b}, {a} + 4)), chr(10))"} AS snippet, {text(sort)} AS sort FROM s WHERE {condition}"""
        for label, tail, name, a, b, signature, sort, condition in nodes
    ]
    parts += [f"SELECT 'edge', NULL, NULL, NULL, {identifier(a)}, {identifier(b)}, '{kind}', NULL, NULL, NULL, NULL, NULL FROM s WHERE {condition}" for a, b, kind, condition in edges]
    if comments:
        first = len(head)
        parts.append(f"SELECT 'node', 'Doc', own || ':doc:' || (i + {first}), '', NULL, NULL, NULL, i + {first}, i + {first}, NULL, ls[i + {first}], 'comment' FROM (SELECT *, unnest(range(1, len(ls) - {first} + 1)) AS i FROM s)")
        parts.append(f"SELECT 'edge', NULL, NULL, NULL, file, own || ':doc:' || (i + {first}), 'HAS_DOC', NULL, NULL, NULL, NULL, NULL FROM (SELECT *, unnest(range(1, len(ls) - {first} + 1)) AS i FROM s)")
    return f"""WITH s AS (SELECT *, 'r:pkg/test_' || n || '{ending}' AS own, 'r:pkg/test_' || n || '{ending}:file' AS file FROM (SELECT n,
  list_concat([{listed}], list_transform(string_split(replace(text, chr(13), ' '), chr(10)), lambda x: '{comment}' || x)) AS ls FROM (SELECT CAST(doc_id AS VARCHAR) AS n, text FROM documents)))
SELECT kind, label, id, name, src, dst, type, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, signature, snippet, sort FROM ({" UNION ALL ".join(parts)})"""


_PYTHON = ["import os.path", "import numpy as np", "from json import loads", "X = @", "def test_@(a, b):", '    """doc"""', "    return a", "class K@:", "    def m(self):", "        def inner():", "            pass", "%deco", "def skipped():", "    pass", "class TestCase:", "    size = 1"]
_ALL = "true"


@query(
    _symbols_sql(
        ".py", _PYTHON, "# ",
        [
            ("Package", "package:os", "os", 1, 1, None, None, _ALL), ("Package", "package:json", "json", 3, 3, None, None, _ALL), ("Variable", ":variable:X:4", "X", 4, 4, None, "global", _ALL),
            ("Function", ":function:test_@", "test_@", 5, 7, "test_@(a, b)", "function", _ALL), ("Doc", ":doc:6", "", 6, 6, None, "docstring", _ALL), ("Test", ":test:test_@", "test_@", 5, 7, None, "unit", _ALL),
            ("Class", ":class:K@", "K@", 8, 11, None, None, _ALL), ("Function", ":method:K@:m", "m", 9, 11, "m(self)", "method", _ALL), ("Function", ":method:K@:inner", "inner", 10, 11, "inner()", "method", _ALL),
            ("Class", ":class:TestCase", "TestCase", 15, 16, None, None, _ALL), ("Test", ":test:TestCase", "TestCase", 15, 16, None, "class", _ALL),
        ],
        [
            ("$", "package:os", "IMPORTS", _ALL), ("$", "package:json", "IMPORTS", _ALL), ("$", ":function:test_@", "CONTAINS_FUNCTION", _ALL), (":function:test_@", "$", "DEFINED_IN", _ALL), ("$", ":doc:6", "HAS_DOC", _ALL),
            ("$", ":test:test_@", "HAS_TEST", _ALL), ("$", ":class:K@", "CONTAINS_CLASS", _ALL), (":class:K@", ":method:K@:m", "HAS_METHOD", _ALL), (":method:K@:m", "$", "DEFINED_IN", _ALL), (":class:K@", ":method:K@:inner", "HAS_METHOD", _ALL),
            (":method:K@:inner", "$", "DEFINED_IN", _ALL), ("$", ":class:TestCase", "CONTAINS_CLASS", _ALL), ("$", ":test:TestCase", "HAS_TEST", _ALL),
        ],
        True,
    )
)
def python_symbols(spark, d):
    return extract.symbols(_sources(spark, d, ".py", _PYTHON, "# "))


_SCRIPT = ["import x from '%scope/pkg/sub';", "import y from './local';", "const z = require('lodash/fp');", "log('hello@');", "var v@ = 1; let w = 2;", "function f(a) { function g() {} }", "const arrow = (q) => q;", "class C@ { run(n) { return n; } }", "function f(b) { return b; }"]


def _script_sql(ending: str, script: bool) -> str:
    calls = "true" if script else "false"
    nodes = [
        ("Package", "package:%scope/pkg", "%scope/pkg", 1, 1, None, None, _ALL), ("Package", "package:lodash", "lodash", 3, 3, None, None, calls), ("Package", "package:hello@", "hello@", 4, 4, None, None, calls),
        ("Variable", ":variable:v@:5", "v@", 5, 5, None, "global", _ALL), ("Function", ":function:f", "f", 6, 6, "f(a)", "function", _ALL), ("Function", ":function:g", "g", 6, 6, "g()", "function", _ALL),
        ("Class", ":class:C@", "C@", 8, 8, None, None, _ALL), ("Function", ":method:C@:run", "run", 8, 8, "run(n)", "method", _ALL),
    ]
    edges = [
        ("$", "package:%scope/pkg", "IMPORTS", _ALL), ("$", "package:lodash", "IMPORTS", calls), ("$", "package:hello@", "IMPORTS", calls), ("$", ":function:f", "CONTAINS_FUNCTION", _ALL), (":function:f", "$", "DEFINED_IN", _ALL),
        ("$", ":function:g", "CONTAINS_FUNCTION", _ALL), (":function:g", "$", "DEFINED_IN", _ALL), ("$", ":class:C@", "CONTAINS_CLASS", _ALL), (":class:C@", ":method:C@:run", "HAS_METHOD", _ALL), (":method:C@:run", "$", "DEFINED_IN", _ALL),
    ]
    return _symbols_sql(ending, _SCRIPT, "// ", nodes, edges, False)


@query(_script_sql(".js", True))
def js_symbols(spark, d):
    return extract.symbols(_sources(spark, d, ".js", _SCRIPT, "// "))


@query(_script_sql(".ts", False))
def ts_symbols(spark, d):
    return extract.symbols(_sources(spark, d, ".ts", _SCRIPT, "// "))


# sources and history


def _tree(spark, d):
    """A file for each order, with a README for some repositories."""
    k = F.col("o_orderkey")
    readme = F.element_at(F.array(*map(F.lit, source_files.READMES)), (k % 5 + 1).cast("int"))
    path = F.when(k % 50 == 0, readme).otherwise(_path("o_orderkey"))
    return table(spark, d, "orders").select(F.concat(F.lit("r"), (k % 40).cast("string")).alias("repo"), path.alias("path"), F.concat(F.repeat(F.lit("x"), (k % 3 * 30_000).cast("int")), k.cast("string")).alias("content"))


_TREE = f"""WITH t AS (SELECT 'r' || o_orderkey % 40 AS repo, CASE WHEN o_orderkey % 50 = 0 THEN (['{"', '".join(source_files.READMES)}'])[o_orderkey % 5 + 1] ELSE {_path_sql("o_orderkey")} END AS path,
  repeat('x', CAST(o_orderkey % 3 * 30000 AS INT)) || o_orderkey AS content FROM orders)
"""
_ENDING = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '[^.](\\.[^.]+)$', 1))"
_IS_CODE = f"{_ENDING} IN ({', '.join(repr(e) for e in paths.LANGUAGES)})"
_IGNORED = f"len(list_filter(string_split(path, '/'), lambda p: p IN ({', '.join(repr(x) for x in paths.IGNORED)}) OR (p LIKE '.%' AND length(p) > 1))) > 0"


@query(_TREE + f"SELECT repo, path, sha256(content) AS sha, 1 AS lines, repo || ':' || path || ':file' AS id, regexp_extract(path, '[^/]*$') AS name FROM t WHERE {_IS_CODE} AND NOT {_IGNORED}")
def code_files(spark, d):
    """What a scan of a repository keeps, with the facts of its File nodes."""
    kept = source_files.code_files(_tree(spark, d))
    c = F.col
    return kept.select("repo", "path", texts.content_hash(c("content")).alias("sha"), texts.line_count(c("content")).alias("lines"), paths.node_id(c("repo"), c("path"), "file").alias("id"), paths.basename(c("path")).alias("name"))


@query(_TREE + f"SELECT repo, path, content FROM t WHERE {_IS_CODE} AND path IN (SELECT {_path_sql('c_custkey')} FROM customer)")
def listed_files(spark, d):
    """Named files alone; names without a file are skipped."""
    return source_files.listed(_tree(spark, d), table(spark, d, "customer").select(_path("c_custkey").alias("path")))


@query(
    _TREE
    + f"""SELECT repo, repo || ':doc:README' AS id, 'Doc' AS label, 'README' AS type, CASE WHEN length(c) > 50000 THEN substr(c, 1, 50000) || chr(10) || chr(10) || '... (truncated)' ELSE c END AS text FROM
  (SELECT repo, arg_min(content, (list_position(['{"', '".join(source_files.READMES)}'], path), content)) AS c FROM t WHERE path IN ('{"', '".join(source_files.READMES)}') GROUP BY repo)"""
)
def readmes(spark, d):
    return source_files.readme(_tree(spark, d))


@query(
    """SELECT sha256(CAST(event_id AS VARCHAR)) AS sha, 'user' || user_id AS author_name, 'u' || user_id || '@x.io' AS author_email, '2024-01-01T00:00:00+00:00' AS committed_at, event_type || chr(10) || chr(10) || props AS message,
  CAST(event_id % 7 + 3 AS INT) AS insertions, CAST(event_id % 5 AS INT) AS deletions, CASE WHEN event_id % 2 = 0 THEN ['src/a' || user_id || '.py', 'img.png'] ELSE ['src/a' || user_id || '.py', 'new/b.py'] END AS files_changed FROM events"""
)
def commit_log(spark, d):
    """Commits read from the records of a log."""
    k, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    numbers = F.concat((F.col("event_id") % 7).cast("string"), F.lit("\t"), (F.col("event_id") % 5).cast("string"), F.lit("\tsrc/a"), u, F.lit(".py\n"))
    second = F.when(F.col("event_id") % 2 == 0, "3\t-\timg.png\n").otherwise("3\t0\t{old => new}/b.py\n")
    record = F.concat_ws("\x1f", F.sha2(k, 256), F.concat(F.lit("user"), u), F.concat(F.lit("u"), u, F.lit("@x.io")), F.lit("2024-01-01T00:00:00+00:00"), F.concat("event_type", F.lit("\n\n"), "props", F.lit("\n")), F.concat(F.lit("\n"), numbers, second))
    return history.commits_of(table(spark, d, "events").select(record.alias("record"))).drop("old_paths")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS path, CAST(i AS INT) AS line, sha256(doc_id || '-' || (i % 3)) AS sha, source || '-' || (i % 3) AS author FROM (SELECT doc_id, source, unnest(range(1, len(string_split(replace(text, chr(13), ' '), chr(10))) + 1)) AS i FROM documents)"""
)
def blame_lines(spark, d):
    """The commit and author of every line of every document; a commit's author stands at its first line alone."""
    n = F.col("doc_id").cast("string")

    def line(x, i):
        part = ((i + 1) % 3).cast("string")
        head = F.concat(F.sha2(F.concat(n, F.lit("-"), part), 256), F.lit(" 1 "), (i + 1).cast("string"), F.lit("\n"))
        return F.concat(head, F.when(i < 3, F.concat(F.lit("author "), F.col("source"), F.lit("-"), part, F.lit("\n"))).otherwise(""), F.lit("\t"), x, F.lit("\n"))

    report = F.array_join(F.transform(F.split(F.translate("text", "\r", " "), "\n"), line), "")
    return history.blame(table(spark, d, "documents").select(n.alias("path"), report.alias("report")))


#: Versions of each document that blame_versions makes.
VERSIONS = 6


@query(
    f"""WITH v AS (SELECT doc_id, n, i, (doc_id + i * 31 + n * 17) % 5 <> 0 AS there FROM (SELECT doc_id, unnest(range(len(string_split(replace(text, chr(13), ' '), chr(10))))) AS i FROM documents), range({VERSIONS}) r(n)),
b AS (SELECT doc_id, i, coalesce(max(n) FILTER (WHERE NOT there), -1) + 1 AS origin FROM v GROUP BY doc_id, i)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS line, sha256(doc_id || '-' || origin) AS sha, 'author' || (origin % 3) AS author FROM b WHERE origin < {VERSIONS}"""
)
def blame_versions(spark, d):
    """The commit and author of every line of every document's last version, worked out from its versions: each of them
    leaves out other numbered lines of the document."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.array(*[F.lit(n) for n in range(VERSIONS)])).alias("number", "_n"), "text")
    numbered = F.transform(F.split(F.translate("text", "\r", " "), "\n"), lambda x, i: F.struct(i.alias("i"), F.concat(i.cast("string"), F.lit(": "), x).alias("x")))
    kept = F.filter(numbered, lambda x: (F.col("doc_id") + x.i * 31 + F.col("number") * 17) % 5 != 0)
    content = F.array_join(F.transform(kept, lambda x: x.x), "\n")
    n = F.col("doc_id").cast("string")
    sha, author = F.sha2(F.concat(n, F.lit("-"), F.col("number").cast("string")), 256), F.concat(F.lit("author"), (F.col("number") % 3).cast("string"))
    return history.blamed(docs.select(n.alias("path"), "number", sha.alias("sha"), author.alias("author"), content.alias("content")))


@query("SELECT 'r:commit:' || arg_max(event_id, (ts, event_id)) AS src, 'r:f' || user_id || ':file' AS dst, 'TOUCHED' AS type FROM events GROUP BY user_id")
def last_commits(spark, d):
    """The newest commit of each file as an edge."""
    commits = table(spark, d, "events").select(F.col("event_id").alias("sha"), F.col("ts").alias("committed_at"), F.array(F.concat(F.lit("f"), F.col("user_id").cast("string"))).alias("files_changed"))
    return ingest.last_commits(commits, "r")


# graphs of repositories


def _commits(spark, d):
    u = F.col("user_id").cast("string")
    return table(spark, d, "events").select(
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("sha"), F.concat(F.lit("User "), u).alias("author_name"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("U"), u, F.lit("@X.io"))).alias("author_email"),
        F.date_format("ts", "yyyy-MM-dd").alias("committed_at"), F.col("event_type").alias("message"), F.lit(1).alias("insertions"), F.lit(0).alias("deletions"), F.array(F.concat(F.lit("pkg/test_"), u, F.lit(".py"))).alias("files_changed"),
    )


_PEOPLE = "CASE WHEN user_id % 2 = 0 THEN 'person:u' || user_id || '@x.io' ELSE 'person:user_' || user_id END"
_INGEST = f"""WITH n AS (SELECT 'repo:r' AS id, 'Repo' AS label UNION SELECT 'r:commit:c' || event_id, 'Commit' FROM events UNION SELECT {_PEOPLE}, 'Person' FROM events
  UNION SELECT 'r:pkg/test_' || user_id || '.py:file', 'File' FROM events UNION SELECT 'r:pkg/test_' || doc_id || '.py:file', 'File' FROM documents),
e AS (SELECT 'r:commit:c' || event_id AS src, 'repo:r' AS dst, 'BELONGS_TO' AS type FROM events UNION SELECT 'r:commit:c' || event_id, {_PEOPLE}, 'AUTHORED_BY' FROM events
  UNION SELECT 'r:commit:c' || event_id, 'r:pkg/test_' || user_id || '.py:file', 'TOUCHED' FROM events UNION SELECT 'r:pkg/test_' || user_id || '.py:file', 'repo:r', 'BELONGS_TO' FROM events
  UNION SELECT 'repo:r', 'r:pkg/test_' || doc_id || '.py:file', 'HAS_FILE' FROM documents)
"""


def _ingested(spark, d):
    """Files of documents without code, so that files, history and their common nodes are left."""
    number = F.col("doc_id").cast("string")
    sources = table(spark, d, "documents").select(F.lit("r").alias("repo"), F.concat(F.lit("pkg/test_"), number, F.lit(".py")).alias("path"), F.lit("").alias("content"))
    return ingest.merged([ingest.source_graph(sources, "r", "https://github.com/o/r"), ingest.history_graph(_commits(spark, d), "https://github.com/o/r", "r")])


@query(_INGEST + "SELECT id, label FROM n")
def ingested_nodes(spark, d):
    """Sources and history as one graph: of two nodes with one id the source's label stays."""
    return _ingested(spark, d)[0].select("id", "label")


@query(_INGEST + "SELECT src, dst, type FROM e")
def ingested_edges(spark, d):
    return _ingested(spark, d)[1].select("src", "dst", "type")


@query(_INGEST + "SELECT label, count(*) AS n FROM n GROUP BY label")
def ingested_counts(spark, d):
    return ingest.counts_by_label(_ingested(spark, d)[0])


@query(
    f"""WITH p AS ({oracle_sql()["python_symbols"]}), c AS (SELECT * FROM events ORDER BY strftime(ts, '%Y-%m-%d') DESC, 'c' || event_id LIMIT 50),
n AS (SELECT id, label FROM p WHERE kind = 'node' UNION SELECT 'repo:r', 'Repo' UNION SELECT 'r:pkg/test_' || doc_id || '.py:file', 'File' FROM documents UNION SELECT 'r:commit:c' || event_id, 'Commit' FROM c
  UNION SELECT {_PEOPLE}, 'Person' FROM c UNION SELECT 'r:pkg/test_' || user_id || '.py:file', 'File' FROM c),
e AS (SELECT src, dst, type FROM p WHERE kind = 'edge' UNION SELECT 'repo:r', 'r:pkg/test_' || doc_id || '.py:file', 'HAS_FILE' FROM documents UNION SELECT 'r:commit:c' || event_id, 'repo:r', 'BELONGS_TO' FROM c
  UNION SELECT 'r:commit:c' || event_id, {_PEOPLE}, 'AUTHORED_BY' FROM c UNION SELECT 'r:commit:c' || event_id, 'r:pkg/test_' || user_id || '.py:file', 'TOUCHED' FROM c UNION SELECT 'r:pkg/test_' || user_id || '.py:file', 'repo:r', 'BELONGS_TO' FROM c)
SELECT 'node' AS kind, id, label, NULL AS src, NULL AS dst, NULL AS type, true AS embedded FROM n UNION ALL SELECT 'edge', NULL, NULL, src, dst, type, NULL FROM e"""
)
def full_ingest(spark, d):
    """The whole ingest: sources parsed, the newest commits, embeddings of all nodes that have a text, edges with both ends."""
    nodes, edges = ingest.full_ingest(_sources(spark, d, ".py", _PYTHON, "# "), _commits(spark, d), "r", "https://github.com/o/r", Settings(commits_full=50))
    none = F.lit(None).cast("string")
    left = nodes.select(F.lit("node").alias("kind"), "id", "label", none.alias("src"), none.alias("dst"), none.alias("type"), F.col("embedding").isNotNull().alias("embedded"))
    return left.unionByName(edges.select(F.lit("edge").alias("kind"), none.alias("id"), none.alias("label"), "src", "dst", "type", F.lit(None).cast("boolean").alias("embedded")))


@query(
    f"""WITH t AS (SELECT {_path_sql("o_orderkey")} AS path FROM orders) SELECT count(*) AS files, count(*) FILTER (WHERE {_IS_CODE} AND NOT {_IGNORED}) AS parsed, count(*) FILTER (WHERE NOT ({_IS_CODE} AND NOT {_IGNORED})) AS skipped,
  count(*) FILTER (WHERE {_IS_CODE} AND {_IGNORED}) AS ignored, count(*) FILTER (WHERE NOT {_IS_CODE}) AS other FROM t"""
)
def scan_totals(spark, d):
    return source_files.totals(table(spark, d, "orders").select(_path("o_orderkey").alias("path")))


@query("SELECT repo_name, repo_sha FROM (SELECT 'r' || n_nationkey AS repo_name, CASE WHEN n_nationkey = 3 THEN 'new' ELSE n_name END AS repo_sha FROM nation UNION ALL SELECT 'fresh', 'first')")
def ingest_state(spark, d):
    """The checkpoint table after two repositories were ingested."""
    old = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("repo_name"), F.col("n_name").alias("repo_sha"), F.lit(None).cast("timestamp").alias("updated_at"))
    return ingest.with_state(ingest.with_state(old, "r3", "new"), "fresh", "first").select("repo_name", "repo_sha")


@query("SELECT * FROM (VALUES ('never seen', 'full'), ('same', 'none'), ('moved', 'incremental'), ('diff failed', 'full')) AS t(what, plan)")
def ingest_plans(spark, d):
    """How a repository is brought up to date: in full, by its changes, or not at all."""
    cases = [("never seen", None, "b", True), ("same", "b", "b", True), ("moved", "a", "b", True), ("diff failed", "a", "b", False)]
    return spark.createDataFrame([(what, ingest.plan(was, now, diff)) for what, was, now, diff in cases], "what string, plan string")


def _versions(spark, d):
    """Manifests before and after: customers with orders changed, some are gone, some are new."""
    c = F.col("c_custkey")
    customers = table(spark, d, "customer")
    path = F.concat(F.lit("f"), c.cast("string"), F.lit(".py"))

    def files(rows, mark):
        return rows.select(F.lit("r").alias("repo"), path.alias("path"), mark.alias("sha"), mark.alias("content"))

    return files(customers.where(c % 7 != 0), F.lit("v1")), files(customers.where(c % 5 != 0), F.when(c % 3 == 0, "v2").otherwise("v1"))


@query(
    """SELECT 'r:f' || c_custkey || '.py:file' AS id, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN c_custkey % 3 = 0 THEN sha256('v2') ELSE sha256('v1') END AS sha FROM customer WHERE c_custkey % 5 <> 0"""
)
def incremental_update(spark, d):
    """The graph after a change of sources: what was changed or added is parsed anew, what is gone goes."""
    old, new = _versions(spark, d)

    def parse(files):
        nodes = extract.file_nodes(files).withColumn("state", F.lit("new"))
        return nodes, nodes.select(F.lit("repo:r").alias("src"), F.col("id").alias("dst"), F.lit("HAS_FILE").alias("type"))

    nodes, edges = parse(old)
    return webhooks.incremental(nodes.withColumn("state", F.lit("old")), edges, old, new, "r", parse)[0].select("id", "state", "sha")


@query(
    f"""WITH p AS ({oracle_sql()["python_symbols"].replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 5 <> 0)")})
SELECT DISTINCT 'node' AS kind, id, label, NULL AS src, NULL AS dst, NULL AS type FROM p WHERE kind = 'node' UNION ALL SELECT 'node', 'r:pkg/test_' || doc_id || '.py:file', 'File', NULL, NULL, NULL FROM documents WHERE doc_id % 5 <> 0
UNION ALL SELECT DISTINCT 'edge', NULL, NULL, src, dst, type FROM p WHERE kind = 'edge' UNION ALL SELECT 'edge', NULL, NULL, 'repo:r', 'r:pkg/test_' || doc_id || '.py:file', 'HAS_FILE' FROM documents WHERE doc_id % 5 <> 0"""
)
def updated_graph(spark, d):
    """The graph in tables of buckets after two commits: in the second one files went, came, and changed."""
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    sources = _sources(spark, d, ".py", _PYTHON, "# ").withColumn("_n", number)
    before = F.when(F.col("_n") % 3 == 0, F.concat("content", F.lit("\nclass Gone:\n    pass\n"))).otherwise(F.col("content"))
    old = sources.where("_n % 7 <> 0").withColumn("content", before)
    old, new = (m.select("repo", "path", F.sha2("content", 256).alias("sha"), "content") for m in (old, sources.where("_n % 5 <> 0")))
    tables = ingest.GraphTables(spark, graph.folder(spark, "graph"), 32)
    tables.update(None, old, "r", "first", 0)
    tables.update(old, new, "r", "second", 1)
    nodes, edges = tables.graph()
    none = F.lit(None).cast("string")
    left = nodes.select(F.lit("node").alias("kind"), "id", "label", none.alias("src"), none.alias("dst"), none.alias("type"))
    return left.unionByName(edges.select(F.lit("edge").alias("kind"), none.alias("id"), none.alias("label"), "src", "dst", "type"))


# changes of tables


@query("SELECT event_type AS label, props AS content, '{\"user\":\"' || user_id || '\"}' AS metadata, true AS named, true AS dated FROM events")
def append_memory(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("type"), F.col("props").alias("content"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"))
    empty = spark.createDataFrame([], "id string, label string, content string, metadata string, created_at timestamp")
    return dml.append_memory(empty, rows).select("label", "content", "metadata", (F.length("id") == 36).alias("named"), F.col("created_at").isNotNull().alias("dated"))


@query(f"WITH {SQL_DOCS} SELECT id, CASE WHEN id % 3 = 0 THEN [CAST(id AS FLOAT), 1.0::FLOAT] ELSE embedding END AS embedding FROM docs")
def set_embeddings(spark, d):
    docs = fixture.documents(spark, d).select("id", "embedding")
    new = docs.where("id % 3 = 0").select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    return dml.set_embeddings(docs, new)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, '{\"user\":' || user_id || ',\"kind\":\"' || event_type || '\"}' AS who, '{\"k\":\"' || user_id || '\"}' AS tags FROM events")
def sanitised_rows(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("who"), F.create_map(F.lit("k"), F.col("user_id").cast("string")).alias("tags"))
    return dml.sanitised(e)


@query("SELECT printf('%03d_m.sql', s) AS filename, CAST(i AS INT) AS i, 'CREATE ' || s || ' ' || i AS statement FROM (SELECT unnest(range(0, 25)) AS s) CROSS JOIN (SELECT unnest(range(0, 3)) AS i) WHERE s % 4 <> 0")
def pending_migrations(spark, d):
    """Statements of the migrations that were not applied yet, in order of file and place."""
    n = F.col("n_nationkey").cast("string")
    name = F.concat(F.lpad(n, 3, "0"), F.lit("_m.sql"))
    content = F.concat(F.lit("-- first; of all\nCREATE "), n, F.lit(" 0;\n CREATE "), n, F.lit(" 1; \n  -- more\nCREATE "), n, F.lit(" 2;\n"))
    files = table(spark, d, "nation").select(name.alias("filename"), content.alias("content"))
    return dml.pending_migrations(files, files.where("n_nationkey % 4 = 0").select("filename")).select("filename", "i", "statement")


# webhooks


@query(
    """SELECT event_id, event_id % 2 = 0 AS good FROM events"""
)
def webhook_signatures(spark, d):
    """Whether the signature of a body is the one its secret gives."""
    body = F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit("}"))
    e = table(spark, d, "events").select("event_id", body.alias("body"))
    signed = e.withColumn("signature", webhooks.signature(F.when(F.col("event_id") % 2 == 0, F.col("body")).otherwise("{}"), "secret"))
    return signed.select("event_id", webhooks.is_signed(F.col("body"), F.col("signature"), "secret").alias("good"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS at FROM events")
def iso_times(spark, d):
    iso = F.when(F.col("event_id") % 3 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return table(spark, d, "events").select("event_id", texts.iso_time(iso).cast("timestamp_ntz").alias("at"))


@query("SELECT 'n' || user_id || ':pr' AS id, max(event_id) AS last, count(*) AS n FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id")
def webhook_stream(spark, d):
    """Pull requests by repository after all events went through a stream of micro-batches; every fourth event is
    delivered again in another batch."""
    sent = _webhooks(spark, d).drop("payload").join(table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at")), "event_id")
    sent = sent.withColumn("delivery", F.col("event_id").cast("string"))
    folder = graph.stored(sent.unionByName(sent.where("event_id % 4 = 0")).repartition(4), "webhooks").inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    state = Buckets(spark, f"{folder}-state", "id string, last long, n long", ["id"], buckets=32)

    def rows(batch):
        pulls = webhooks.parsed(batch).where("event_type = 'pull_request'")
        repo = F.element_at(F.split(F.col("payload.repository.html_url"), "/"), -1)
        return pulls.groupBy(F.concat(repo, F.lit(":pr")).alias("id")).agg(F.max("event_id").alias("last"), F.count("*").alias("n"))

    run = webhooks.run(webhooks.once(stream, late="1000 days"), webhooks.kept(state, rows, ["last"], ["n"]), f"{folder}-progress")
    run.awaitTermination()
    return state.table()


@query(oracle_sql()["upsert_coalesce"])
def upsert_buckets(spark, d):
    """upsert_coalesce on a table of buckets: customers come first, then users change the buckets that they fall into."""
    state = Buckets(spark, graph.folder(spark, "customers"), _customers(spark, d).schema, ["id"], buckets=64)
    state.upsert(_customers(spark, d), 0)
    state.upsert(_users(spark, d), 1)
    return state.table()


@query(oracle_sql()["incremental_update"])
def replaced_files(spark, d):
    """incremental_update on a table of buckets by file: what changed or went is replaced, the other buckets stay."""
    old, new = _versions(spark, d)

    def parsed(files, state):
        nodes = extract.file_nodes(files)
        return nodes.select(F.col("id").alias("owner"), "id", F.lit(state).alias("state"), "sha")

    state = Buckets(spark, graph.folder(spark, "files"), parsed(old, "").schema, ["owner", "id"], ["owner"], 64)
    state.upsert(parsed(old, "old"), 0)
    changes = dml.changed_files(old, new)
    owners = changes.select(paths.node_id("r", F.col("path"), "file").alias("owner"))
    fresh = new.join(changes.where("change <> 'removed'").select("path"), "path", "left_semi")
    state.replace(owners, parsed(fresh, "new"), 1)
    return state.table().drop("owner")


# search, answers, settings


@query(f"WITH {SQL_SCORED} SELECT id, label, vector_score FROM scored ORDER BY vector_score DESC, id LIMIT 7")
def search_dispatch(spark, d):
    return search.search(fixture.documents(spark, d), VECTOR, "The", "vector", limit=7).select("id", "label", "vector_score")


@query(f"WITH {SQL_DOCS} SELECT id, round(1 / (1 + d * d), 6) AS vector_score FROM (SELECT id, list_distance(CAST(embedding AS DOUBLE[]), list_transform(range(64), lambda i: ((i * 37) % 64) / 64.0::DOUBLE - 0.5)) AS d FROM docs WHERE embedding IS NOT NULL) ORDER BY vector_score DESC, id LIMIT 10")
def euclidean_search(spark, d):
    return search.vector_search(fixture.documents(spark, d), VECTOR, 10, Settings(similarity="euclidean")).select("id", "vector_score")


@query("SELECT * FROM (VALUES ('kind', true), ('limit', true), ('weight', true), ('off', true)) AS t(what, refused)")
def search_arguments(spark, d):
    """Arguments that are out of range, and a search that is switched off, are refused."""
    docs = fixture.documents(spark, d)
    off = Flags(flags={"vector_search": Flag(False)})
    calls = {"kind": lambda: search.search(docs, VECTOR, "x", "other"), "limit": lambda: rag.ask_context(docs, VECTOR, "x", limit=21), "weight": lambda: search.hybrid_search(docs, VECTOR, "x", weight=1.5), "off": lambda: search.vector_search(docs, VECTOR, flags=off)}

    def refused(call) -> bool:
        try:
            call()
        except (ValueError, RuntimeError):
            return True
        return False

    return spark.createDataFrame([(what, refused(call)) for what, call in calls.items()], "what string, refused boolean")


@query(f"SELECT 'hybrid off' AS what, count(*) AS n, true AS by_vectors FROM ({_ask_sql(['Function', 'Class', 'File'], 1)} SELECT * FROM context) UNION ALL SELECT 'all off', 0, true")
def flag_fallbacks(spark, d):
    """Without hybrid search the vectors decide alone; without any there is no context."""
    docs = fixture.documents(spark, d)
    some = Flags(flags={"vector_search": Flag(), "hybrid_search": Flag(False)})
    rows = rag.ask_context(docs, VECTOR, "The", flags=some).select(F.lit("hybrid off").alias("what"), (F.col("score") == F.round("vector_score", 9)).alias("same"))
    none = rag.ask_context(docs, VECTOR, "The", flags=Flags(flags={}))
    one = rows.groupBy("what").agg(F.count("*").alias("n"), F.min("same").alias("by_vectors"))
    return one.unionByName(none.agg(F.lit("all off").alias("what"), F.count("*").alias("n"), F.lit(True).alias("by_vectors")))


@query(f"SELECT '{rag.NO_CONTEXT}' AS text")
def empty_context(spark, d):
    return rag.context_text(rag.ask_context(fixture.documents(spark, d), VECTOR, "The", flags=Flags(flags={})))


_PROMPT = """(SELECT string_agg(chr(10) || '--- Context ' || position || ': ' || label || ' ''' || CASE WHEN label = 'Commit' THEN substr(sha, 1, 8) ELSE name END || '''' || printf(' (relevance: %.3f)', score) || ' ---' || chr(10)
  || CASE WHEN length(content) > 1000 THEN substr(content, 1, 1000) || chr(10) || '... (truncated)' ELSE content END, chr(10) ORDER BY position) AS text FROM context)"""


@query(
    _ask_sql(["Function", "Class", "File"], 1)
    + f""", l AS (SELECT list_slice(string_split(text, chr(10)), 1, 20) AS ls FROM {_PROMPT} AS p)
SELECT 0 AS i, 'context' AS kind, NULL AS text UNION ALL SELECT CAST(i AS INT), 'chunk', ls[i] || chr(10) FROM (SELECT ls, unnest(range(1, len(ls) + 1)) AS i FROM l) UNION ALL SELECT CAST(len(ls) + 1 AS INT), 'done', NULL FROM l UNION ALL SELECT CAST(len(ls) + 2 AS INT), 'end', NULL FROM l"""
)
def answer_events(spark, d):
    """The event stream of an answer, as a client reads it."""
    records = answer.answer(rag.ask_context(fixture.documents(spark, d), VECTOR, "The"), "Where is it?")
    body = "".join(answer.events(records))
    got = answer.received(spark.createDataFrame([("a", body)], "id string, body string"))
    # each record takes two lines of the stream
    return got.select((F.col("i") / 2).cast("int").alias("i"), "kind", "text")


_AGENTS = f"['{"', '".join(answer.PROMPTS)}', 'unknown']"
_TOLD = f"['{"', '".join([*answer.PROMPTS.values(), answer.PROMPTS['pathfinder']])}']"


def _asked(spark, d):
    """A question about each document, with its text as the context, to one agent after the other."""
    agents = F.array(*map(F.lit, [*answer.PROMPTS, "unknown"]))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.get(agents, (F.col("doc_id") % 6).cast("int")).alias("agent"), F.concat(F.lit("What is in "), "source", F.lit("?")).alias("question"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("context"))


@query(f"SELECT doc_id AS id, {_TOLD}[doc_id % 6 + 1] || chr(10) || chr(10) || 'Question: What is in ' || source || '?' AS prompt FROM documents")
def agent_prompts(spark, d):
    asked = _asked(spark, d)
    return asked.select("id", answer.prompt(F.col("agent"), F.col("question")).alias("prompt"))


@query(
    f"""WITH l AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN ['{rag.NO_CONTEXT}'] ELSE list_transform(list_slice(string_split(text, chr(10)), 1, 20), lambda x: x || chr(10)) END AS ls FROM documents)
SELECT id, CAST(i - 1 AS INT) AS i, 'chunk' AS kind, ls[i] AS text FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l) UNION ALL SELECT id, CAST(len(ls) AS INT), 'done', NULL FROM l"""
)
def answered_questions(spark, d):
    """The pieces of an answer to a question about each document."""
    return answer.answered(_asked(spark, d))


@query(_ISSUE.replace("SELECT id, label, score, CAST", "SELECT CAST").replace(" AS position FROM best", " AS position, label, score FROM best"))
def issue_events(spark, d):
    """The context record of a streamed analysis of an issue; pieces of the answer and an end follow it."""
    records = list(answer.analyse_issue(fixture.documents(spark, d), VECTOR, "No such title", "No such body"))
    kinds = [r["type"] for r in records]
    if kinds[0] != "context" or kinds[-1] != "done" or set(kinds[1:-1]) != {"chunk"}:
        raise RuntimeError(f"records out of order: {kinds}")
    return spark.createDataFrame([(x["position"], x["type"], x["score"]) for x in records[0]["items"]], "position int, label string, score double")


@query(
    """WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 4 AS k, source FROM documents)
SELECT id, 0 AS i, CASE k WHEN 3 THEN 'raw' ELSE 'chunk' END AS kind, CASE k WHEN 3 THEN 'not json' ELSE source END AS text FROM f UNION ALL SELECT id, 2, 'end', NULL FROM f"""
)
def received_events(spark, d):
    """Streams of events as texts, one for each document; a record that can't be read is given raw."""
    k = F.col("doc_id") % 4
    record = F.struct(F.lit("chunk").alias("type"), F.col("source").alias("text"))
    data = F.when(k == 3, "data: not json\n\n").otherwise(texts.server_event(record))
    return answer.received(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(data, F.lit("data: [DONE]\n\n")).alias("body")))


@query(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h FROM w), s AS (SELECT doc_id, h % 64 AS spot, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY doc_id, h % 64),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM s GROUP BY doc_id)
SELECT d.doc_id AS id, CASE WHEN trim(d.text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN NULL ELSE list_transform(list_transform(range(64), lambda i: CAST(coalesce(map_extract(m, i)[1], 0.0) AS FLOAT)), lambda x: CASE WHEN n > 0 THEN x / CAST(n AS FLOAT) ELSE 0.0::FLOAT END) END AS embedding
FROM documents d LEFT JOIN (SELECT doc_id, map(list(spot), list(x)) AS m, any_value(n.n) AS n FROM s JOIN n USING (doc_id) GROUP BY doc_id) USING (doc_id)"""
)
def hash_embed(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), embed.embedder("hash", 64)(F.col("text")).alias("embedding"))


@query(f"WITH {SQL_DOCS} SELECT label, count(*) AS total, count(*) FILTER (WHERE embedding IS NOT NULL OR trim(content) <> '') AS embedded FROM docs GROUP BY label")
def backfilled(spark, d):
    """How many nodes have an embedding after those without one got theirs; blank texts get none."""
    docs = fixture.documents(spark, d).withColumns({"path": F.col("signature"), "language": F.col("author_name"), "type": F.lit("README"), "text": F.col("content"), "package": F.lit(""), "author": F.col("author_name")})
    return embed.coverage(embed.backfill(docs)).select("label", "total", "embedded")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in embed.DIMENSIONS.items()) + ") AS t(model, dimension)")
def embedding_dimensions(spark, d):
    return spark.createDataFrame(sorted(embed.DIMENSIONS.items()), "model string, dimension int")


@query(
    "SELECT * FROM (VALUES ('dimension', '12'), ('similarity', 'euclidean'), ('api_key', '***'), ('refused', 'true'), ('flags on', '2'), ('flags off', '2'), ('env', 'A=1|B=x y|C='), ('vector_search', 'false')) AS t(name, value)"
)
def settings_in_force(spark, d):
    """Settings from an environment, without secrets; flags by environment; lines of an environment file."""
    import json

    shown = json.loads(Settings.from_env({"DIMENSION": "12", "SIMILARITY": "euclidean", "API_KEY": "s3cret"}).export())
    try:
        Settings(vector_weight=2)
        refused = "false"
    except ValueError:
        refused = "true"
    flags = Flags("production", {"vector_search": Flag(True, frozenset({"development"})), "hybrid_search": Flag(), "embeddings": Flag(), "batch_embeddings": Flag(False)})
    env = read_env(["# note", "A=1", ' B = "x y" ', "no value", "C=", ""])
    rows = [(k, str(shown[k])) for k in ("dimension", "similarity", "api_key")] + [("refused", refused), ("flags on", str(flags.totals()["enabled"])), ("flags off", str(flags.totals()["disabled"])), ("env", "|".join(f"{k}={v}" for k, v in env.items())), ("vector_search", str(flags.on("vector_search")).lower())]
    return spark.createDataFrame(rows, "name string, value string")


@query("SELECT page_id, true AS ssh, true AS https, false AS local, 'https://github.com/o/n' || page_id AS plain, page_id % 2 = 0 AS on_github FROM pages")
def git_urls(spark, d):
    n = F.col("page_id").cast("string")
    ssh, https = F.concat(F.lit("git@github.com:o/n"), n, F.lit(".git")), F.concat(F.when(F.col("page_id") % 2 == 0, "https://github.com/").otherwise("https://example.org/"), n)
    return table(spark, d, "pages").select("page_id", paths.is_git_url(ssh).alias("ssh"), paths.is_git_url(https).alias("https"), paths.is_git_url(F.concat(F.lit("/tmp/"), n)).alias("local"), paths.https_url(ssh).alias("plain"), paths.is_github_url(https).alias("on_github"))


@query("SELECT c_custkey AS id, coalesce(u.name, c_name) AS name FROM customer LEFT JOIN (SELECT DISTINCT user_id * 2 AS id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'user' || user_id END AS name FROM events) u ON u.id = c_custkey")
def upsert_known_only(spark, d):
    """An upsert that makes no rows: new ones are left out before."""
    from .catalogue import _users

    known = _users(spark, d).join(_customers(spark, d).select("id"), "id", "left_semi")
    return dml.upsert(_customers(spark, d).select("id", "name"), known, ["id"])
