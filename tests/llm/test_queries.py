import zlib

import duckdb
import pytest

import corpus_pipeline
from lodestone.llm import pieces, toxicity
from lodestone.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got = Q.queries()[name](spark, FOLDER)
    found = duck.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = [dict(zip(columns, row, strict=True)) for row in found.fetchall()]
    assert sorted([r.asDict() for r in got.collect()], key=lambda r: repr(sorted(r.items()))) == sorted(want, key=lambda r: repr(sorted(r.items())))


def test_other_queries(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = Q.op1_toxicity(spark, FOLDER).collect()
    assert len(rows) == n and {r.predicted for r in rows} <= {0, 1} and all(r.predicted == (r.score >= 0.5) for r in rows)
    rows = Q.op6_sharding(spark, FOLDER).collect()
    assert len(rows) == n and len({(r.shard, r.slot) for r in rows}) == n
    assert Q.op8_token_counts(spark, FOLDER).count() == n
    assert Q.op5_html(spark, FOLDER).where("n_chars > 0").count() == spark.read.parquet(f"{FOLDER}/pages.parquet").count()
    assert all(r.lossless for r in Q.op10_sentencepiece(spark, FOLDER).collect())


def test_pipeline_stage_by_stage(spark):
    from test_decontamination import brute as contaminated
    from test_simhash import classes, fingerprint
    from test_substring import brute as repeats
    from test_toxicity import brute as scores

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = corpus_pipeline.stored(stage(spark, kept, FOLDER), name)
        after = {r.doc_id: r.text for r in kept.collect()}
        assert len(after) == kept.count() and set(after) <= set(before)
        ids = list(before)
        if name == "simhash_near_dedup":
            group = classes(ids, [fingerprint(before[i]) for i in ids])
            assert set(after) == {i for k, i in enumerate(ids) if group[k] == i}
        elif name == "substring_dedup":
            want = {r[0]: r for r in repeats(list(before.items()), 35)}
            assert set(after) == {i for i, r in want.items() if r[1] > r[2]}
            assert all(after[i] == before[i] for i in after if not want[i][2]) and all(len(after[i].split()) == want[i][1] - want[i][2] for i in after)
        elif name == "benchmark_decontamination":
            bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            assert set(after) == {r[0] for r in contaminated(list(before.items()), bench) if not r[5]}
        elif name == "toxicity":
            labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
            want = scores(list(before.items()), labels, toxicity.Params())
            assert set(after) == {i for i, (score, _) in want.items() if score < 0.5} and len(after) < len(before)
        else:
            own = pieces.Encoder(pieces.Vocabulary.load(f"{Q.TOKENIZERS}/piece_bpe_32k.model"), 0.1, 10)
            assert set(after) == set(before) and all(r.lossless and r.piece_ids == own.encode(r.text).tolist() for r in kept.collect())
    assert corpus_pipeline.run(spark, FOLDER).count() == kept.count()


def test_near_duplicates_go_by_row(spark):
    words = [f"{w}{i}" for i in range(40) for w in ("alpha", "beta")]
    same, other, third, fourth, null = (" ".join(f"{w}{k}" for w in words) for k in "abcde")
    rows = [(1, same), (1, same), (None, null), (None, null), (None, null), (2, other), (3, other), (3, third), (None, fourth), (9, fourth)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.stored(kept, "kept")
    want = [(1, same), (2, other), (3, third), (9, fourth), (None, null)]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted(want, key=repr)
    cut = corpus_pipeline.cut_repeats(spark, kept, FOLDER).collect()
    assert sorted([(r.doc_id, r.text) for r in cut], key=repr) == sorted(want, key=repr)


EDGES = [(1, "plain words here"), (1, "plain words here"), (2, None), (3, ""), (4, " \n"), (None, "no name"), (None, None), (5, "long " * 30_000), (6, "\u3000é 😀 ▁ \x00"), (7, "plain words here")]


@pytest.mark.parametrize("name, left", [("toxicity", 10), ("simhash_near_dedup", 5), ("substring_dedup", 9), ("benchmark_decontamination", 10), ("sentencepiece", 10)])
def test_stages_take_odd_rows(spark, name, left):
    """left: rows that stay; in simhash one of three equal texts, one without words, and three others."""
    stage = dict(corpus_pipeline.STAGES)[name]
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in EDGES], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = table.selectExpr("*", *(f"'x' as {c}" for c in ("kd", "kt", "tag", "id", "fp", "wins", "n", "toxicity", "kept_text", "piece_ids", "term", "host")))
    got = stage(spark, clashing.repartition(3), FOLDER)
    rows = got.collect()
    assert len(rows) == left and got.columns[:5] == list(corpus_pipeline.COLUMNS) and len(got.columns) == (8 if name == "sentencepiece" else 5)
    assert {r.text for r in rows} <= {t for _, t in EDGES}
    assert stage(spark, clashing.limit(0), FOLDER).count() == 0


def test_sharding_law_at_the_query(spark):
    rows = Q.op6_sharding(spark, FOLDER).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None
    n = len(texts)
    assert set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) and len(s) in (n // 24, n // 24 + 1) for s in by.values())
