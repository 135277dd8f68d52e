import hashlib
import itertools
import random
import re
import zlib

import pytest

from lodestone.llm import queries as Q
from lodestone.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute_edits(rows):
    """(cost, edits) by trying all edits; rows: (role, fault)."""
    best = None

    def go(i, done, cost, edits):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows):
            for extra in ("", "u", "a", "ua"):
                if re.fullmatch("(s?(ua)+)?", done + extra):
                    found = cost + 2 * len(extra), edits + "I" * len(extra)
                    best = found if best is None else min(best, found)
            return
        role, fault = rows[i]
        for before in ("", "u", "a", "ua", "au"):
            spent, now, letters = cost + 2 * len(before), done + before, edits + "I" * len(before)
            go(i + 1, now, spent + 3, letters + "D")
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            for new, price, letter in ((role[:1] or "-", 0, "K"), ("u", 2, "R"), ("a", 2, "R")):
                if re.fullmatch("s?(ua)*u?", now + new):
                    go(i + 1, now + new, spent + price + more, letters + letter)

    go(0, "", 0, "")
    return best


def brute(conversation):
    """The contract for the rows of one conversation, by hand."""
    rows = []
    for conv_id, turn, role, text in conversation:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = brute_edits([(r[1], f) for r, f in zip(rows, faults, strict=True)]) if rows else (0, "")
    said, at, done = [], 0, ""
    for letter in audit:
        if letter in "IR":
            done += "a" if done.endswith("u") else "u"
            said.append(("assistant" if done.endswith("a") else "user") + ":" + ("" if letter == "I" else rows[at][2]))
        elif letter == "K":
            done += rows[at][1][:1]
            said.append(rows[at][1] + ":" + rows[at][2])
        at += letter != "I"
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def check(got, table):
    by = {}
    for row in table:
        by.setdefault(row[0], []).append(row)
    rows = got.collect()
    assert len(rows) == len(by)
    for r in rows:
        assert tuple(r)[1:] == brute(by[r.conv_id]), r.conv_id


def test_edits_equal_all_edits_tried():
    signs = {"x": ("user", "blank"), "s": ("system", None), "u": ("user", None), "a": ("assistant", None), "o": ("tool", None), "S": ("system", "truncated"), "U": ("user", "truncated"), "A": ("assistant", "truncated"), "O": ("", "truncated")}
    trie, n = R.Trie(), 0
    names = sorted("".join(s) for k in range(5) for s in itertools.product("xsuaU", repeat=k)) + sorted("".join(random.Random(i).choices(list(signs), k=5)) for i in range(150))
    for s in sorted(names):
        assert trie.answer(s) == brute_edits([signs[c] for c in s]), s
        n += len(s)
    assert trie.layers < n / 2  # shared beginnings are worked out once


def suffixes(signature):
    """(cost, edits) from the end: edits of each suffix as strings, one insertion at a time."""
    n = len(signature)
    best = [{} for _ in range(n + 2)]
    for i in range(n, -1, -1):
        for inserted in (2, 1, 0):
            for state in range(4):
                then = 3 if state == 2 else 2
                found = [(0, "")] if i == n and state in (0, 3) else []
                ways = [(2, "I", (i, then, inserted + 1))] if inserted < 2 else []
                if i < n:
                    ways.append((3, "D", (i + 1, state, 0)))
                    role, more = signature[i].lower(), signature[i].isupper()
                    if role != "x":
                        ways.append((2 + more, "R", (i + 1, then, 0)))
                        if role in R.AFTER and state in R.AFTER[role][0]:
                            ways.append((more, "K", (i + 1, R.AFTER[role][1], 0)))
                for cost, letter, (j, s, k) in ways:
                    if (s, k) in best[j]:
                        found.append((best[j][s, k][0] + cost, letter + best[j][s, k][1]))
                if found:
                    best[i][state, inserted] = min(found)
    return best[0][0, 0]


def test_longer_signatures_equal_another_way_to_the_answer():
    rng, trie = random.Random(1), R.Trie()
    for s in sorted("".join(rng.choices("xsuaoSUAO", weights=[1, 1, 6, 6, 1, 1, 2, 2, 1], k=rng.randrange(60))) for _ in range(400)):
        assert trie.answer(s) == suffixes(s), s


def test_long_signatures():
    trie = R.Trie()
    cost, audit = trie.answer("ua" * 50_000 + "u")
    assert (cost, audit) == (2, "K" * 100_001 + "I")
    assert trie.answer("ua" * 50_000 + "x") == (3, "K" * 100_000 + "D") and trie.layers == 100_002


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = Q.op12_repair(spark, folder)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    check(got, table)


def test_odd_rows(spark):
    rng = random.Random(5)
    table = [(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, None]), rng.choice([0, 1, 1, 2, 3, 9, None]), rng.choice(["user", "assistant", "system", "u2", "tool", "", None]), rng.choice(["Yes.", "no", "", " \t\x0b", "why?\n", None, "é!", "ü😀"])) for _ in range(48)]
    table += [(100, t, "user", "x" * 50_000 + ".") for t in range(3)] + [(k, None, None, None) for k in range(200, 240)]
    clashing = spark.createDataFrame([(*r, "x", "y", "z") for r in table], SCHEMA + ", _kind string, there string, copy string").repartition(3)
    check(R.repair(R.damaged(clashing)), table)
    assert R.repair(R.damaged(clashing.limit(0))).count() == 0


def test_dropped_conversations_remain(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = R.repair(R.damaged(spark.createDataFrame([(dropped, 0, "user", "Hello.")], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", EMPTY)]


@pytest.mark.parametrize("n", [700])
def test_one_long_conversation(spark, n):
    table = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 300}.") for t in range(n)]
    got = R.repair(R.damaged(spark.createDataFrame(table, SCHEMA))).first()
    assert got.duplicate > n - 2 * 300 and len(got.audit.replace("I", "")) >= n - n // 10
