import random

import numpy as np
import pytest
import tiktoken

from lodestone.llm import tokenfiles as T
from lodestone.llm.queries import TOKENIZERS

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_counts_are_those_of_the_texts(spark, block):
    rng = random.Random(block)
    docs = [(i, " ".join(rng.choice(["alpha", "βeta", "γ", "x1"]) for _ in range(rng.randrange(0, 40)))) for i in range(50)]
    docs += [(100, None), (101, ""), (102, ""), (None, "hello"), (7, docs[7][1]), (103, "word " * 60_000), (104, "x" * 150_000), (105, "<|endoftext|>")]
    own = tiktoken.Encoding("t", pat_str=T.PATTERN, mergeable_ranks=T.load_ranks(RANKS), special_tokens={})
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as file", "2 as n_tokens").repartition(3)
    got = T.token_counts(table, RANKS, 50256, block=block).collect()
    want = [(i, len(own.encode_ordinary(t or ""))) for i, t in docs]
    assert sorted([tuple(r) for r in got], key=repr) == sorted(want, key=repr) and len(got) == len(docs)
    assert T.token_counts(table.limit(0), RANKS, 50256).count() == 0


def test_width_follows_the_largest_identifier(spark):
    ranks = {bytes([i]): i for i in range(256)}
    assert T.width_of(ranks, 256) == 2 and T.width_of(ranks | {b"ab": 70_000}, 256) == 4 and T.width_of(ranks, 1 << 16) == 4
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    with pytest.raises(ValueError):
        T.write_token_files(docs, RANKS, 1 << 20, width=2)
    assert sorted(map(tuple, T.token_counts(docs, RANKS, 1 << 20).collect())) == [(1, 1), (2, 0)]


def test_long_texts_are_cut_where_the_pattern_splits(spark, monkeypatch):
    rng = random.Random(4)
    own = tiktoken.Encoding("t", pat_str=T.PATTERN, mergeable_ranks=T.load_ranks(RANKS), special_tokens={})
    pages = "".join(rng.choice(["page 12", ' said "no', "\n\n", "  (x)", "it's", " 3.5", "\u3000", "x1"]) for _ in range(60_000))
    han = "".join(rng.choice("一二三四字。，") for _ in range(120_000))
    texts = ["1234567 8901 " * 12_000, pages, han, "ab12'" * 30_000, "字" * 110_000, "page 12" + "y" * 120_000 + " 12", "\n" * 120_000 + "x"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in T.token_counts(table, RANKS, 50256).collect()} == {i: len(own.encode_ordinary(t)) for i, t in enumerate(texts)}
    monkeypatch.setattr(T, "PIECE", 3)
    signs = ["a", "B", "é", "字", "1", "²", "'", "'s", "'ll", "!", "。", " ", "  ", "\n", "\u3000", "\x1c", "\u0301"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 25)))
        assert [t for p in T._parts(text) for t in own.encode_ordinary(p)] == own.encode_ordinary(text), text


def test_scan_of_any_blocks(spark):
    import numpy as np

    rng = random.Random(9)
    for width, kind in ((2, "<u2"), (4, "<u4")):
        rows, want = [], []
        for file in range(6):
            lengths = [rng.choice([0, 0, 1, 5, 30]) for _ in range(rng.randrange(0, 12))]
            stream = [x for n in lengths for x in [*([1] * n), 9]]
            if file % 2:
                stream += [1] * 4
                lengths.append(4)
            at = block = 0
            while at < len(stream):
                n = rng.choice([1, 3, 8])
                rows.append((file, block, bytearray(np.array(stream[at : at + n], kind).tobytes())))
                at, block = at + n, block + 1
            rows.append((file, block, bytearray()))
            start = 0
            for i, n in enumerate(lengths):
                want.append((file, i, start, n))
                start += n + 1
        files = spark.createDataFrame(rows, "file int, block int, tokens binary")
        assert sorted(map(tuple, T.documents_in(files, 9, width).select("file", "ordinal", "start", "n_tokens").collect())) == sorted(want)


def test_separator_must_be_free(spark):
    with pytest.raises(ValueError):
        T.token_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), RANKS, 5)


def test_flat_token_files_are_read_from_disk(spark, tmp_path):
    rng, want = np.random.default_rng(4), {}
    for k, documents in enumerate(([3, 0, 70, 1], [], [0], [500], [1] * 40)):
        tokens = np.concatenate([np.append(rng.integers(0, 9, n), 9) for n in documents] or [np.zeros(0, np.int64)])
        if k == 3:
            tokens = tokens[:-1]  # no separator at the end
        tokens.astype("<u2").tofile(tmp_path / f"part{k}.bin")
        want[f"part{k}.bin"] = documents
    for block in (1, 7, 64, 1 << 16):
        blocks, names = T.read_token_files(spark, str(tmp_path), 2, block)
        got = T.documents_in(blocks, 9, 2).join(names, "file").collect()
        by = {n: [r.n_tokens for r in sorted((r for r in got if r.path.endswith(n)), key=lambda r: r.ordinal)] for n in want}
        assert by == want and names.count() == 4  # Spark leaves out empty files
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        T.read_token_files(spark, str(tmp_path), 2)
