import random

import pytest
from pyspark.sql import functions as F

from lodestone.config import Flag, Flags, Settings, read_env
from lodestone.operators import dml, embed, graph, rag, search

NODE = "id string, label string, embedding array<float>, name string, signature string, content string, author_name string, files_changed array<string>, snippet string, message string, sha string"


@pytest.fixture
def nodes(spark):
    rows = [("a", [1.0, 0.0], "alpha", "alpha(x)"), ("b", [0.0, 1.0], "beta", "uses_alpha(x)"), ("c", [-1.0, 0.0], "gamma", None), ("d", None, "alpha2", None)]
    return spark.createDataFrame([(i, "Function", e, n, s, f"text of {n}", None, None, None, None, None) for i, e, n, s in rows], NODE)


def test_vector_and_hybrid_scores(nodes):
    got = search.vector_search(nodes, [1.0, 0.0], 10).collect()
    assert [(r.id, r.score) for r in got] == [("a", 1.0), ("b", 0.5), ("c", 0.0)]
    got = search.hybrid_search(nodes, [1.0, 0.0], "ALPHA", limit=10).collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [("a", 1.0), ("b", 0.59), ("c", 0.0)]
    assert [r.id for r in search.hybrid_search(nodes, [1.0, 0.0], "ALPHA", limit=1).collect()] == ["a"]
    assert [r.id for r in search.hybrid_search(nodes, [1.0, 0.0], "", limit=3, weight=1.0).collect()] == ["a", "b", "c"]


def test_more_like_this(nodes):
    assert [r.id for r in search.more_like_this(nodes, ["a"]).orderBy("rank").collect()] == ["b", "c"]
    assert search.more_like_this(nodes, ["d", "nobody"]).count() == 0


def test_flags_and_dispatch(nodes):
    off = Flags(flags={"hybrid_search": Flag(False), "vector_search": Flag(True, frozenset({"production"}))})
    with pytest.raises(RuntimeError):
        search.hybrid_search(nodes, [1.0, 0.0], "x", flags=off)
    with pytest.raises(RuntimeError):
        search.vector_search(nodes, [1.0, 0.0], flags=off)
    with pytest.raises(ValueError):
        search.search(nodes, [1.0, 0.0], "x", kind="other")
    assert rag.ask_context(nodes, [1.0, 0.0], "x", flags=off).count() == 0
    assert off.totals() == {"enabled": 0, "disabled": 2}


def test_context(nodes):
    context = rag.ask_context(nodes, [1.0, 0.0], "alpha", limit=3)
    assert [(r.id, r.position) for r in context.collect()] == [("a", 1)]
    assert rag.context_text(context).first().text == "--- [Function] alpha ---\ntext of alpha\n"
    assert rag.context_text(context.limit(0)).first().text == rag.NO_CONTEXT
    assert "(relevance: 1.000)" in rag.prompt_text(context).first().text
    assert rag.shown(rag.context_summary(context)).first().percent == "100%"
    with pytest.raises(ValueError):
        rag.ask_context(nodes, [1.0, 0.0], "x", limit=21)


@pytest.mark.parametrize("keep, a, b", [(True, "x", "z"), (False, None, "z")])
def test_upsert(spark, keep, a, b):
    old = spark.createDataFrame([(1, "x", "y")], "id int, a string, b string")
    new = spark.createDataFrame([(1, None, "z"), (2, "q", None)], "id int, a string, b string")
    once = dml.upsert(old, new, ["id"], keep)
    assert sorted(map(tuple, once.collect()), key=str) == sorted([(1, a, b), (2, "q", None)], key=str)
    assert sorted(map(tuple, dml.upsert(once, new, ["id"], keep).collect())) == sorted(map(tuple, once.collect()))


def test_upsert_keeps_created(spark):
    old = spark.createDataFrame([(1, "then")], "id int, at string")
    new = spark.createDataFrame([(1, 5), (2, 6)], "id int, v int")
    assert {r.id: (r.at, r.v) for r in dml.upsert(old, new, ["id"], created="at", now=F.lit("now")).collect()} == {1: ("then", 5), 2: ("now", 6)}


def test_links(spark):
    n = spark.createDataFrame([("1",), ("2",)], "id string")
    e = spark.createDataFrame([], "src string, dst string, type string")
    wanted = spark.createDataFrame([("1", "2", "T"), ("1", "2", "T"), ("1", "9", "T")], "src string, dst string, type string")
    once = dml.link(e, wanted, n)
    assert [tuple(r) for r in once.collect()] == [("1", "2", "T")]
    assert dml.link(once, wanted, n).count() == 1


def test_reachability_against_search(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    e = spark.createDataFrame([(str(a), str(b), "T") for a, b in pairs], "src string, dst string, type string")
    seen, todo = {"0"}, ["0"]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            for p, q in ((str(a), str(b)), (str(b), str(a))):
                if p == x and q not in seen:
                    seen.add(q)
                    todo.append(q)
    assert {r.id for r in graph.reachable(e, spark.createDataFrame([("0",)], "id string")).collect()} == seen


def test_delete_file_takes_methods(spark):
    edges = [("f", "k", "CONTAINS_CLASS"), ("k", "m", "HAS_METHOD"), ("f", "p", "IMPORTS"), ("g", "h", "CONTAINS_FUNCTION")]
    e = spark.createDataFrame(edges, "src string, dst string, type string")
    n = spark.createDataFrame([(i,) for i in "fkmpgh"], "id string")
    left, kept = dml.delete_files(n, e, n.where("id = 'f'"))
    assert {r.id for r in left.collect()} == set("pgh") and [tuple(r) for r in kept.collect()] == [("g", "h", "CONTAINS_FUNCTION")]


def test_degree_counts_a_loop_once(spark):
    e = spark.createDataFrame([("a", "a", "T"), ("a", "b", "T")], "src string, dst string, type string")
    assert {r.id: r.degree for r in graph.degrees(e).collect()} == {"a": 2, "b": 1}


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "x")], "src string, dst string")
    ranks = {r.id: r["rank"] for r in graph.pagerank(e, 20).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["a"] > ranks["d"]


def test_pagerank_looks_ranks_up_by_number(spark):
    rows = [("a", "b"), ("a", "b"), ("a", None), ("b", "a"), (None, "c"), ("c", "c"), ("c", "a")]
    got = graph.pagerank(spark.createDataFrame(rows, "src string, dst string"), 3)
    links = set(rows)
    ids = {x for r in links for x in r}
    outs = {i: [d for s, d in links if s == i] for i in ids if i is not None}
    want = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(3):
        lost = sum(r for i, r in want.items() if not outs.get(i))
        sent = {i: sum(want[s] / len(d) for s, d in outs.items() if i in d) if i is not None else 0.0 for i in ids}
        want = {i: (0.15 + 0.85 * lost) / len(ids) + 0.85 * sent[i] for i in ids}
    assert {r.id: round(r["rank"], 12) for r in got.collect()} == {i: round(r, 12) for i, r in want.items()}
    # ranks are written as (number, out-edges, rank), so that no round shuffles or sorts ids
    rounds = []
    stored = graph.stored
    graph.stored = lambda df, name: rounds.append((name, df.dtypes)) or stored(df, name)
    try:
        graph.pagerank(spark.createDataFrame(rows, "src string, dst string"), 3)
    finally:
        graph.stored = stored
    assert ("links", [("src", "bigint"), ("dst", "bigint")]) in rounds and [d for n, d in rounds if n == "ranks"][:2] == [[("n", "bigint"), ("n_out", "bigint"), ("rank", "double")]] * 2


def test_migrations_and_changes(spark):
    files = spark.createDataFrame([("1.sql", "a;"), ("2.sql", "-- note\nb;\n c ;")], "filename string, content string")
    done = spark.createDataFrame([("1.sql",)], "filename string")
    assert [r.statement for r in dml.pending_migrations(files, done).orderBy("i").collect()] == ["b", "c"]
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, sha string")
    new = spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], "path string, sha string")
    assert {r.path: r.change for r in dml.changed_files(old, new).collect()} == {"a": "removed", "b": "modified", "d": "added"}


def test_sanitised_and_memories(spark):
    df = spark.sql("select timestamp'2024-01-02 03:04:05' t, map('a', 1) m, array('x') l, 1 i")
    assert tuple(dml.sanitised(df).first()) == ("2024-01-02T03:04:05.000000", '{"a":1}', ["x"], 1)
    table = spark.createDataFrame([("i", "l", "c", "{}", None)], "id string, label string, content string, metadata string, created_at timestamp")
    more = dml.append_memory(table, spark.sql("select 'note' type, 'hello' content, map('k', 'v') metadata"))
    assert rag.memories(more, "hel").count() == 1 and rag.memories(more, "HEL").count() == 0 and rag.memories(more, '"v"').count() == 1


def test_embeddings(spark, nodes):
    filled = embed.backfill(nodes.withColumns({c: F.lit(None).cast("string") for c in ("path", "language", "type", "text", "package", "author")}), dimension=2)
    got = {r.id: r.embedding for r in filled.collect()}
    assert got["a"] == [1.0, 0.0] and len(got["d"]) == 2
    assert embed.embed_text("one two", dimension=8) == embed.embed_text("ONE  two", dimension=8)
    with pytest.raises(ValueError):
        embed.embed_text("  ")
    with pytest.raises(ValueError):
        embed.embedder("nothing")
    assert [(r.total, r.embedded, r.percent) for r in embed.coverage(nodes).collect()] == [(4, 3, 75.0)]


def test_settings():
    assert Settings.from_env({"MAX_LIMIT": "7"}).max_limit == 7
    with pytest.raises(ValueError):
        Settings(vector_weight=2.0)
    assert '"api_key": "***"' in Settings(api_key="x").export()
    assert read_env(["# no", "A = 'b c' ", "bad", "D=e=f"]) == {"A": "b c", "D": "e=f"}


def test_equal_memories_have_identifiers_of_their_own(spark):
    rows = spark.createDataFrame([("note", "same", {"a": "1"})] * 3 + [("note", None, None), ("note", "other", {})], "type string, content string, metadata map<string,string>")
    table = spark.createDataFrame([], "id string, label string, content string, metadata string, created_at timestamp")
    made = dml.append_memory(table, rows)
    ids = [r.id for r in made.collect()]
    assert len(set(ids)) == 5 and all(len(i) == 36 and i.count("-") == 4 for i in ids)
    assert {r.id for r in dml.append_memory(made, rows).collect()} > set() and dml.append_memory(made, rows).count() == 10


def test_a_hot_file_is_counted_whole(spark):
    files = spark.createDataFrame([("f", "F"), ("g", "G")], "id string, name string")
    edges = spark.range(500).selectExpr("concat('c', id % 400) as src", "'f' as dst", "'TOUCHED' as type").unionByName(spark.createDataFrame([("f", "k", "CONTAINS_CLASS")], "src string, dst string, type string"))
    got = {r.id: r for r in graph.explain_file(files, edges).collect()}
    assert got["f"].summary == "F has 1 classes, 0 functions, 0 imports and 400 commits" and got["f"].commits == ["c0", "c1", "c10", "c100", "c101"]
    assert got["g"].summary == "G has 0 classes, 0 functions, 0 imports and 0 commits" and got["g"].commits == []


@pytest.mark.parametrize("n", [20_000])
def test_a_long_chain_is_reached_in_few_rounds(spark, n):
    edges = spark.range(n).selectExpr("cast(id as string) as src", "cast(id + 1 as string) as dst").unionByName(spark.createDataFrame([("x", "y"), ("x", "x"), (None, "y")], "src string, dst string"))
    assert graph.contracted(edges)[1] < 20
    starts = spark.createDataFrame([("7",), ("alone",)], "id string")
    assert graph.reachable(edges, starts).count() == n + 2 and graph.reachable(edges.limit(0), starts).count() == 2


def test_a_star_collapses_and_numbers_are_told_apart(spark):
    """Leaves that come before their hub are not left alone, and shuffles grow with the edges."""
    star = spark.range(1, 3001).selectExpr("cast(id as string) as src", "'hub' as dst")
    maps, rounds, names = graph.contracted(star)
    assert rounds <= 2 and names.count() == 3001 and names.select("n").distinct().count() == 3001
    assert graph.components(star).select("component").distinct().count() == 1
    was = spark.conf.get("spark.sql.shuffle.partitions")
    with graph.dealt(spark, 50 * graph.ROWS_OF_TASK):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    assert spark.conf.get("spark.sql.shuffle.partitions") == was


def test_clearing_a_repository_contracts_once(spark, monkeypatch):
    from lodestone.plans import catalogue

    calls, contracted = [], graph.contracted
    monkeypatch.setattr(graph, "contracted", lambda edges: calls.append(1) or contracted(edges))
    catalogue.clear_repo(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_edges_without_a_node_are_found_by_their_ends(spark):
    """Ends are looked up once each; only what is missing is a table, and no edge is lost or doubled."""
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", "T"), ("a", "b", "T"), ("a", "x", "T"), ("y", "b", "T"), ("x", "y", "T"), (None, "a", "T"), ("a", None, "T")], "src string, dst string, type string")
    assert {r.id for r in graph.missing_ends(edges, nodes).collect()} == {"x", "y"}
    assert sorted(map(tuple, graph.with_endpoints(edges, nodes).collect())) == [("a", "b", "T")] * 2
    assert sorted(map(str, map(tuple, graph.dangling(edges, nodes).collect()))) == sorted(map(str, map(tuple, edges.where("not (src = 'a' and dst <=> 'b')").collect())))
