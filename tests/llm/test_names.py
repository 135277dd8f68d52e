"""Columns of the caller's that are named like an operator's own, and two vocabularies in one session."""

import base64

import pytest

from lodestone.llm import html, pieces, sharding, substring, tokenfiles
from lodestone.llm import queries as Q

OWN = ("_file", "_row", "_size", "_part", "_cell", "_order", "_metadata", "_kd", "_tag", "_spans", "_host", "_page", "_wrappers", "kd", "tag", "spans", "host", "wrappers", "fp", "cell", "key", "block", "n", "h1", "x", "_Row", "_unit")


def clashing(table):
    return table.selectExpr("*", *(f"concat('own ', '{c}') as `{c}`" for c in OWN if c != "_Row"))


@pytest.mark.parametrize("name", ["sharding", "substring", "html"])
@pytest.mark.parametrize("empty", [False, True])
def test_own_columns_pass_through(spark, tmp_path, name, empty):
    if name == "html":
        table = spark.createDataFrame([(1, "https://a.b/c", "<p>Some words that stand here.</p>"), (2, None, None)], "page_id long, url string, html string")
    else:
        table = spark.createDataFrame([(1, "some words"), (None, None), (2, "some words")], "doc_id long, text string")
    run = {"sharding": sharding.shuffle_to_shards, "substring": substring.dedup, "html": html.main_text}[name]
    plain, table = table, clashing(table)
    if empty:
        plain, table = plain.limit(0), table.limit(0)
    table.write.parquet(str(tmp_path / "t"))
    for given in (table, spark.read.parquet(str(tmp_path / "t"))):
        got = run(given)
        rows = got.collect()
        assert got.columns[: len(given.columns)] == given.columns and len(rows) == (0 if empty else given.count())
        assert all(r[c] == f"own {c}" for r in rows for c in OWN if c != "_Row")
        if name != "sharding":
            new = [c for c in got.columns if c not in given.columns]
            assert sorted(map(repr, got.select("*").toPandas()[new].values.tolist())) == sorted(map(repr, run(plain).toPandas()[new].values.tolist()))


def test_two_rank_files_of_one_size(spark, tmp_path):
    base = {bytes([b]): b for b in range(256)}
    paths = []
    for i, merged in enumerate((b"ab", b"cd")):
        paths.append(str(tmp_path / f"ranks{i}"))
        with open(paths[-1], "wb") as out:
            out.writelines(base64.b64encode(t) + b" %d\n" % r for t, r in {**base, merged: 256}.items())
    table = spark.createDataFrame([(1, "abab")], "doc_id long, text string")
    assert [tokenfiles.token_counts(table, p, 300).first().n_tokens for p in (*paths, paths[0])] == [2, 4, 2]


def test_two_vocabularies_of_one_size():
    first = pieces.Vocabulary.load(f"{Q.TOKENIZERS}/piece_bpe_32k.model")
    swapped = dict(first.pieces)
    a, b = "▁the", "▁of"
    swapped[a], swapped[b] = swapped[b], swapped[a]
    second = pieces.Vocabulary(swapped, first.byte_ids, first.unknown)

    class Sent:
        def __init__(self, value):
            self.value = value

    one, two = (pieces._encoder(Sent(v), 0.0, 1) for v in (first, second))
    assert one is not two and one.encode("the").tolist() != two.encode("the").tolist()
    assert pieces._encoder(Sent(pieces.Vocabulary.load(f"{Q.TOKENIZERS}/piece_bpe_32k.model")), 0.0, 1).encode("the").tolist() == one.encode("the").tolist()
