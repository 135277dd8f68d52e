import json
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing as P
from lodestone.llm import queries as Q

FILE = f"{Q.TOKENIZERS}/word_bpe_49k.json"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def whole(rows, want, capacity):
    """The pieces tile every document and every sequence; want: ids of each document, in any order."""
    by_seq, total = {}, 0
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        total += r.length
        assert len(r.ids) == 4 * r.length
    assert total == sum(len(ids) for _, ids in want)
    for name, ids in want:
        pieces = sorted(docs[name], key=lambda p: p.start)
        assert sum(p.length for p in pieces) == len(ids) == pieces[0].doc_tokens
        assert b"".join(p.ids for p in pieces) == np.array(ids, "<u4").tobytes()
    return by_seq


def test_query_equals_the_tokenizer(spark, tokenizer):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in table.collect()}
    rows = P.pack(table, FILE).collect()
    whole(rows, list(want.items()), 2048)
    got = Q.op11_packing(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for r in got.collect():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])


def test_every_plain_sign_is_split_as_the_tokenizer_does(tokenizer):
    encode = P.Encoder(open(FILE).read())
    assert encode.plain is not None
    signs = [chr(c) for c in range(0x300) if not 0xD800 <= c < 0xE000]
    texts = [f"{c} a{c} {c}b1{c}{c}2 it's{c}ll X{c}Y" for c in signs] + ["I'LL don't 'S '' é'll ǰ J̌ Σας ΑΣ 中文,字 ½²x <|endoftext|> a<|startoftext|>b <|x|>", "\x1c\x85  a b\x0bc", "", "word" * 5000]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_two_tokenizers_in_one_session(spark, tmp_path):
    spec = json.load(open(FILE))
    vocab = spec["model"]["vocab"]
    a, b = "a</w>", "b</w>"
    vocab[a], vocab[b] = vocab[b], vocab[a]
    other = str(tmp_path / "other.json")
    json.dump(spec, open(other, "w"))
    table = spark.createDataFrame([(1, "a")], SCHEMA)
    first, second = (P.pack(table, f).first().ids for f in (FILE, other))
    assert first != second and P.pack(table, FILE).first().ids == first
    assert P.pack(table, f"{Q.TOKENIZERS}/byte_bpe_50k.json").first().doc_tokens == 2


@pytest.mark.parametrize("capacity", [1, 7, 64, 100])
def test_bins_waste_nothing(capacity):
    rng = np.random.default_rng(capacity)
    lengths = rng.integers(0, 3 * capacity, 400).tolist()
    bins, out = P.Bins(capacity), []
    for doc, n in enumerate(lengths):
        out += bins.add(doc, n)
    early = len(out)
    out += bins.rest()
    seen = {}
    for sequence in out:
        for doc, start, n in sequence:
            seen.setdefault(doc, []).append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen.get(doc, [])):
            assert start == at and size > 0
            at += size
        assert at == n
    sums = [sum(p[2] for p in s) for s in out]
    assert all(s == capacity for s in sums[:early]) and sum(s != capacity for s in sums) <= capacity.bit_length() and all(s == capacity or s & (s - 1) == 0 for s in sums)


def test_odd_rows(spark, tokenizer):
    texts = [(1, None), (2, ""), (None, "no name"), (3, "long " * 40_000), (4, "twice"), (4, "twice"), (5, " \n")]
    table = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], SCHEMA + ", ids string, start string, offset string").repartition(3)
    rows = P.pack(table, FILE).collect()
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * (len(tokenizer.encode("twice").ids) + 1)
    assert P.pack(table.limit(0), FILE).count() == 0
