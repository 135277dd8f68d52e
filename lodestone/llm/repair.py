"""Repair of conversations: the cheapest edits that give an optional system turn and then user and assistant in turn.

What the repair of a conversation depends on is one sign for each row, of its role's initial and its fault: its
signature. Different signatures are sorted, so that those with a common beginning follow each other; a task walks the
prefix trie that they form, keeps one DP layer for each node of the path that it stands on, and so works out each layer
once for a shared prefix. At the end of a signature the answer is read back along the path.

A layer has four states: nothing yet, after the system, after a user, after an assistant turn. A step is a row with the
turns inserted before it; nothing is inserted before a deleted row, since deleting first costs the same and comes first
in ASCII. All edits of a layer thus end with the same row, none begins with another one, and the order of the four
strings is all that a later comparison needs: a layer keeps costs, ranks and the way it came by, not the strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
START, SYSTEM, USER, ASSISTANT = range(4)
#: States that a turn of each role may follow, and the state then.
AFTER = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
#: White space.
BLANKS = " \t\n\x0b\x0c\r"


def _inserted() -> dict[int, list[tuple[str, int]]]:
    """From each state what may be inserted, and the state then: a user turn, an assistant one, both."""
    out = {}
    for state in range(4):
        found, now = [("", state)], state
        for _ in range(2):
            now = ASSISTANT if now == USER else USER
            found.append((found[-1][0] + INSERT, now))
        out[state] = found
    return out


INSERTED = _inserted()


def _steps(sign: str) -> list[tuple[int, str, int, int]]:
    """(state before, edits, cost, state then) of a row: x has to go; s, u, a and o (another role) are initials, in
    capitals if the row is truncated."""
    if sign == "x":
        return [(s, DELETE, COSTS[DELETE], s) for s in range(4)]
    role, more = sign.lower(), int(sign.isupper())
    out = [(s, DELETE, COSTS[DELETE], s) for s in range(4)]
    for before in range(4):
        for edits, now in INSERTED[before]:
            spent = COSTS[INSERT] * len(edits) + more
            if role in AFTER and now in AFTER[role][0]:
                out.append((before, edits + KEEP, spent + COSTS[KEEP], AFTER[role][1]))
            for new in "ua":
                if now in AFTER[new][0]:
                    out.append((before, edits + REROLE, spent + COSTS[REROLE], AFTER[new][1]))
    return out


STEPS = {sign: _steps(sign) for sign in "xsuaoSUAO"}
#: A layer: (cost, rank) of each state, None if there is no way; costs are above the cheapest of the layer.
FIRST = ((0, 0), None, None, None)
_known: dict[tuple, tuple] = {}


def step(layer: tuple, sign: str) -> tuple[tuple, int, tuple]:
    """(next layer, cost of its cheapest state above this one's, (state before, edits) of each state); remembered, since
    layers without their common cost are few."""
    key = layer, sign
    if key not in _known:
        best: list = [None] * 4
        for before, edits, cost, now in STEPS[sign]:
            if layer[before] is not None:
                found = (layer[before][0] + cost, layer[before][1], edits, before)
                if best[now] is None or found < best[now]:
                    best[now] = found
        least = min(b[0] for b in best if b)
        order = {b[1:3]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
        _known[key] = tuple(b and (b[0] - least, order[b[1:3]]) for b in best), least, tuple(b and (b[3], b[2]) for b in best)
    return _known[key]


class Trie:
    """The path of the trie that leads to the last signature."""

    def __init__(self):
        self.signature = ""
        self.path: list[tuple[tuple, int, tuple]] = [(FIRST, 0, ())]
        #: Layers worked out, for tests.
        self.layers = 0

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, edits); cheap if signature begins like the one before."""
        shared = 0
        for a, b in zip(self.signature, signature):
            if a != b:
                break
            shared += 1
        del self.path[shared + 1 :]
        for sign in signature[shared:]:
            layer, cost, _ = self.path[-1]
            after, more, ways = step(layer, sign)
            self.path.append((after, cost + more, ways))
            self.layers += 1
        self.signature = signature
        layer, cost, _ = self.path[-1]
        ends = [(layer[s][0] + COSTS[INSERT] * len(i), layer[s][1], i, s) for s in range(4) if layer[s] is not None for i, now in INSERTED[s] if now in (START, ASSISTANT)]
        more, _, last, state = min(ends)
        edits = [last]
        for _, _, ways in self.path[:0:-1]:
            state, edit = ways[state]
            edits.append(edit)
        return cost + more, "".join(reversed(edits))


def damaged(conversations: DataFrame, key: Column | None = None) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults put in by key modulo 20: 0 drops the row (there is None),
    1 empties the text, 2 takes out its . ! ?, 3 repeats the row, 4 makes it the user's. Null roles and texts are a space.

    There is boolean tells rows that are left; a dropped row remains as a mark of its conversation.
    """
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    key = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"]).cast("binary")) if key is None else key
    kind = (key % 20).alias("_kind")
    rows = conversations.select("conv_id", "turn", spaced["role"].alias("role"), spaced["text"].alias("text"), kind)
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") != 0).alias("there"), F.explode(copies).alias("copy"))


def _marked(rows: DataFrame) -> DataFrame:
    """rows with their fault: blank, duplicate, truncated or none.

    Equal rows of a conversation are counted by a window of their own, so that a large conversation is dealt over many
    tasks here; their texts stand for themselves, not by a hash.
    """
    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    earlier = Window.partitionBy("conv_id", "role", "text", "there").orderBy(F.col("turn").asc_nulls_first(), "copy")
    fault = F.when(ended == "", "blank").when(F.row_number().over(earlier) > 1, "duplicate").when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.select("*", F.when(F.col("there"), fault).alias("fault"), F.sha2("text", 256).alias("digest"))


def _order() -> list[Column]:
    """Rows of a conversation in order; equal turns by role and a hash of the text, which narrow rows have too."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("copy")]


class _Conversation:
    """What is known of the conversation that a task is reading."""

    def __init__(self, conv_id):
        self.conv_id, self.signs = conv_id, []
        self.turns, self.first, self.last, self.illegal, self.before = 0, None, None, 0, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn, role: str, fault: str | None) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if fault:
            self.faults[fault] += 1
        sign = initial if initial in ("s", "u", "a") else "o"
        self.signs.append("x" if fault in ("blank", "duplicate") else sign.upper() if fault == "truncated" else sign)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, "".join(self.signs), gaps, *self.faults.values(), self.illegal


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def signatures(marked: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of each conversation, read row by row in order;
    a task keeps one sign for each row of the conversation it is reading, and no texts come here."""
    narrow = marked.select("conv_id", "turn", "role", "digest", "copy", "fault", "there")
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", *_order()).select("conv_id", "turn", "role", "fault", "there")
    kind = marked.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, schema = None, [], None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("signature", pa.string()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal"))])
            for conv_id, turn, role, fault, there in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(conv_id)
                if there:
                    now.add(turn, role, fault)
            if out:
                yield _batch(out, schema)
                out = []
        if now is not None:
            yield _batch([now.row()], schema)

    return ordered.mapInArrow(run, f"conv_id {kind}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


def answers(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each different signature, from tries of sorted ranges."""
    ranged = found.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            names = batch.column(0).to_pylist()
            got = [trie.answer(s) for s in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in got], pa.int64()), pa.array([a for _, a in got], pa.string())], names=["signature", "cost", "audit"])

    return ranged.mapInArrow(run, "signature string, cost long, audit string")


class _Repaired:
    """The repaired conversation's hash, taken turn by turn along the edits."""

    def __init__(self, conv_id, edits: str):
        self.conv_id, self.edits, self.at, self.state, self.n = conv_id, edits, 0, START, 0
        self.hash = hashlib.sha256()

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.n else "") + role + ":" + text).encode("utf-8", "replace"))
        self.n += 1

    def _turn(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def inserted(self) -> None:
        while self.edits[self.at : self.at + 1] == INSERT:
            self._say(self._turn(), "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = AFTER[role[:1]][1]
            self._say(role, text)
        elif edit == REROLE:
            self._say(self._turn(), text)

    def row(self) -> tuple:
        self.inserted()
        return self.conv_id, self.hash.hexdigest()


def _hashes(marked: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256). The edits of a conversation are a row before its turns, not a value beside each."""
    head = edits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copy"), F.lit("").alias("digest"), F.lit(0).alias("part"))
    turns = marked.where("there").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "copy", "digest", F.lit(1).alias("part"))
    both = head.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "part", *_order()).select("conv_id", "role", "text", "part")
    kind = marked.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema = None, None
        for batch in batches:
            out = []
            if schema is None:
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("repaired_sha256", pa.string())])
            for at in range(0, batch.num_rows, 256):
                for conv_id, role, text, part in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if part == 0:
                        if now is not None:
                            out.append(now.row())
                        now = _Repaired(conv_id, text)
                    else:
                        now.add(role, text)
            if out:
                yield _batch(out, schema)
        if now is not None:
            yield _batch([now.row()], schema)

    return both.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """For each conv_id of rows (conv_id, turn, role, text, there, copy): gaps, blank, duplicate, truncated, illegal,
    cost, audit and repaired_sha256.

    Rows are taken by turn (nulls first), equal turns by role, hash of the text and copy. Edits are K (keep), R (another
    role), D (delete) and I (insert an empty turn); of the cheapest the first in ASCII is taken. A conversation without
    rows (all of them not there) has zeros, no edits and the hash of an empty text, and so has one whose rows all go, but
    for its edits. A null conv_id is a conversation like any other; null roles and texts are a space; repeated rows are
    duplicates; an empty table gives an empty one; other columns are dropped, whatever their names. Texts are hashed
    whole, row by row, so that a conversation may be larger than the memory of its task; one sign for each row is kept.
    """
    space = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    marked = stored(_marked(rows.select("conv_id", "turn", *space, "there", "copy")), "marked")
    found = stored(signatures(marked), "signatures")
    edits = stored(answers(found), "answers")
    size = F.octet_length("signature") + F.octet_length("audit") + 16
    solved = stored(joined(found, edits, ["signature"], "left", size), "solved")
    hashes = _hashes(marked, solved)
    # both sides have one row for each conversation; a null conv_id meets itself
    out = solved.join(hashes.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
