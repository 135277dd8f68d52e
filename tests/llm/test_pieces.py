import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pieces as P
from lodestone.llm.queries import TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
VOCABULARY = P.Vocabulary.load(MODEL)
PLAIN, DROPPED = P.Encoder(VOCABULARY), P.Encoder(VOCABULARY, 0.3, 7)
DROPPED_SCORES = {p: score for p, (score, _) in VOCABULARY.pieces.items()}
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = st.text(st.one_of(st.sampled_from(" \n\tabeht.,▁é一😀"), st.characters(exclude_categories=("Cs",))), max_size=80)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_equals_the_library_without_dropout(text):
    if P.SPACE not in text and "\0" not in text:
        assert list(PLAIN.encode(text)) == LIBRARY.encode(text)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_is_lossless(text):
    assert PLAIN.decode(PLAIN.encode(text)) == text and DROPPED.decode(DROPPED.encode(text)) == text


M64 = 2**64 - 1


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def brute(text, dropout, seed, scores):
    """Without tables or memory: of all pairs not skipped since they arose, the best goes first."""
    step, out = 0x9E3779B97F4A7C15, []
    for place, unit in enumerate(PLAIN.units(text)):
        draw = mix(xxhash.xxh64_intdigest(text.encode(), seed) + place * step & M64)
        symbols, passed, tried, alive = [[c] for c in unit], set(), 0, []
        while True:
            # a pair is told apart by its two symbols, which are made anew by each merge
            open_ = [(-scores["".join(a) + "".join(b)], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if "".join(a) + "".join(b) in scores and (id(a), id(b)) not in passed]
            if not open_:
                break
            _, i = min(open_)
            tried += 1
            if mix(draw + tried * step & M64) < int(dropout * 2**64):
                passed.add((id(symbols[i]), id(symbols[i + 1])))
                continue
            alive += symbols[i : i + 2]  # else their ids could come again
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        out += ["".join(x) for x in symbols]
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \nabcdehnrt,.é一😀"), max_size=160), st.sampled_from([0.05, 0.3, 0.7]))
def test_dropout_equals_a_plain_agenda(text, dropout):
    some = P.Encoder.__new__(P.Encoder)
    some.__dict__ |= DROPPED.__dict__ | {"dropout": dropout, "least": int(dropout * 2**64)}
    some._forget()
    want = []
    for symbol in brute(text, dropout, 7, DROPPED_SCORES):
        found = VOCABULARY.pieces.get(symbol)
        want += [found[1]] if found else [VOCABULARY.byte_ids[b] for b in symbol.encode()]
    assert some.encode(text).tolist() == (want if text else [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcdehnt▁é", min_size=2, max_size=100), min_size=1, max_size=6), st.booleans())
def test_side_by_side_equals_alone(units, drop):
    draws = np.arange(len(units), dtype=np.uint64) if drop else None
    many = DROPPED.merge(units, draws)
    for i, unit in enumerate(units):
        row, tried = DROPPED._alone(DROPPED.merges.read(unit).tolist(), None if draws is None else draws[i : i + 1])
        ids = [x for s in row for x in DROPPED.merges.ids[s]]
        at = int(many[1][:i].sum())
        assert ids == many[0][at : at + many[1][i]].tolist() and tried == many[2][i]


def test_dropout_varies_by_seed_alone():
    text = "the quick brown foxes are jumping over lazy dogs " * 5
    one, same, other = (P.Encoder(VOCABULARY, 0.3, seed).encode(text) for seed in (1, 1, 2))
    one, same, other = one.tolist(), same.tolist(), other.tolist()
    assert one == same and one != other and len(one) > len(PLAIN.encode(text))
    full = P.Encoder(VOCABULARY, 1.0, 1)
    assert len(full.encode("abc def")) == len("▁abc▁def")
    with pytest.raises(ValueError):
        P.Encoder(VOCABULARY, 1.5)


def test_dropout_varies_by_text_and_occurrence():
    some = P.Encoder(VOCABULARY, 0.1, 3)
    word = " international"
    runs = [tuple(some.encode(word * 400)), *(tuple(some.encode(f"{i}{word}")) for i in range(400))]
    assert len(set(runs)) == 401
    forms = {tuple(some.encode(f"{i}{word}"))[len(some.encode(str(i))) :] for i in range(400)}
    assert len(forms) > 8
    # a pair that one merge joins stays apart in one of ten places
    n = 40_000
    pair = next(p for p, _ in sorted(VOCABULARY.pieces.items()) if len(p) == 2 and p[0] == P.SPACE and p[1].isalpha())
    ids = P.Encoder(VOCABULARY, 0.1, 3).encode(" ".join([pair[1]] * n))
    assert abs((len(ids) - n) / n - 0.1) < 0.01
    long = "international" * 30
    assert DROPPED.decode(DROPPED.encode(long)) == long and len({tuple(DROPPED.encode(long + "\n" + x)[:50]) for x in "abcd"}) == 4


def test_table(spark):
    long = "wordy text " * 40_000 + "x" * 30_000
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (None, "a▁b"), (1, "Hello  world\n"), (4, long)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as Piece_ids", "2 as n")
    got = P.encode(table, MODEL)
    assert got.columns == ["doc_id", "text", "n", "piece_ids", "n_pieces", "lossless"]
    found = got.collect()
    assert len(found) == len(rows) and all((r.lossless, r.n_pieces, r.piece_ids) == (None, None, None) if r.text is None else r.lossless and r.n_pieces == len(r.piece_ids) for r in found)
    assert all(r.decoded == r.text for r in P.decode(got, MODEL).collect())
    assert P.encode(table.limit(0), MODEL).count() == 0
