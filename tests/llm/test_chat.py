import json

from lodestone.llm import chat as C

MESSAGE = "conv_id long, turn int, role string, text string"
TOOL = "name string, parameter string, type string, required boolean"


def text(**x):
    return json.dumps(x)


def call(i, name="add", **arguments):
    return {"id": i, "name": name, "arguments": arguments}


def test_links_orders_and_validates(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", text(content="c", tool_calls=[call("a", y=2, x=1), call("q", "nope")])), (1, 2, "tool", text(tool_call_id="a", content="3")), (1, 3, "tool", text(tool_call_id="zz", content="?")), (1, 4, "assistant", "done"),
        (2, 0, "tool", text(tool_call_id="c", content="early")), (2, 1, "assistant", text(tool_calls=[call("c", "now")])), (2, 2, None, None),
        (3, 0, "assistant", text(tool_calls=[call("d", x={"$result": "e"})])), (3, 1, "assistant", text(tool_calls=[call("e", x=1)])), (3, 2, "tool", text(tool_call_id="e", content="1")), (3, 3, "tool", text(tool_call_id="d", content="2")),
        (4, 0, "assistant", text(tool_calls=[call("f", x={"$result": "f"})])), (4, 1, "tool", text(tool_call_id="f", content="1")),
        (None, 0, "user", '{"x'), (5, None, "user", '"q"\n'), (5, None, "user", '"q"\n'), (5, 1, "assistant", "{broken"), (6, 0, "tool", "plain"),
    ]
    tools = spark.createDataFrame([("add", "x", "integer", True), ("add", "y", "integer", False), ("now", None, None, None)], TOOL)
    table = spark.createDataFrame(rows, MESSAGE).selectExpr("*", "1 as conv", "'at' as at", "2 as depth")
    got = {r.conv_id: r for r in C.format_chats(table, tools).collect()}
    one = json.loads(got[1].chat)["messages"]
    assert [m["content"] for m in one] == ["hi", "c", "3", "?", "done"] and one[1]["tool_calls"][0] == {"arguments": {"x": 1, "y": 2}, "id": "a", "name": "add"}
    assert '"arguments":{"x":1,"y":2},"id":"a","name":"add"' in got[1].chat
    assert (got[1].n_calls, got[1].n_linked, got[1].n_orphans, got[1].n_invalid) == (2, 1, 2, 1)
    assert [m["role"] for m in json.loads(got[2].chat)["messages"]] == ["assistant", "tool", ""] and got[2].n_orphans == 0
    order = [m.get("tool_call_id") or m["tool_calls"][0]["id"] for m in json.loads(got[3].chat)["messages"]]
    assert order == ["e", "e", "d", "d"] and got[3].n_invalid == 1 and got[3].n_cyclic == 0
    assert got[4].n_cyclic == 2 and got[5].n_messages == 3 and json.loads(got[None].chat)["messages"][0]["content"] == '{"x'
    problems = C.invalid_arguments(C.calls_of(C.parsed(table)), tools).collect()
    assert sorted(r.problems for r in problems) == ["not integer: x", "not integer: x", "unknown tool nope"]


def test_missing_unknown_and_wrong_arguments(spark):
    rows = [(1, 0, "assistant", text(tool_calls=[call("a", z=1, s="t", n=1.5, b=True, l=[1], o={"k": 1}), {"id": "b", "name": "add", "arguments": [1]}, call("c", x=1, s=2, n=3, b="no", l={}, o=[])]))]
    spec = [("add", p, t, p == "x") for p, t in (("x", "integer"), ("s", "string"), ("n", "number"), ("b", "boolean"), ("l", "array"), ("o", "object"))]
    problems = C.invalid_arguments(C.calls_of(C.parsed(spark.createDataFrame(rows, MESSAGE))), spark.createDataFrame(spec, TOOL)).collect()
    assert {r.i: r.problems for r in problems} == {0: "missing x; unknown z", 1: "arguments are no object", 2: "not array: l; not boolean: b; not object: o; not string: s"}


def test_a_long_chain_is_ordered_and_has_no_cycle(spark):
    n = 50
    rows = [(1, 2 * (n - i), "assistant", text(tool_calls=[call(f"c{i}", x={"$result": f"c{i - 1}"} if i else 1)])) for i in range(n)]
    rows += [(1, 2 * (n - i) - 1, "tool", text(tool_call_id=f"c{i}", content=str(i))) for i in range(n)]
    rows += [(2, 0, "assistant", text(tool_calls=[call("f", x={"$result": "f"})])), (2, 1, "tool", text(tool_call_id="f", content="1")), (2, 2, "assistant", text(tool_calls=[call("g", x={"$result": "f"})]))]
    got = {r.conv_id: r for r in C.format_chats(spark.createDataFrame(rows, MESSAGE)).collect()}
    order = [m.get("tool_call_id") or m["tool_calls"][0]["id"] for m in json.loads(got[1].chat)["messages"]]
    assert order == [f"c{i}" for i in range(n) for _ in "ab"] and got[1].n_cyclic == 0 and got[2].n_cyclic == 3


def test_escaped_ids_and_leading_space(spark):
    rows = [(1, 0, "assistant", " \n" + text(tool_calls=[call("b", x={"$result": 'a"\\é'})])), (1, 1, "assistant", text(tool_calls=[call('a"\\é', x=1)])), (1, 2, "tool", text(tool_call_id='a"\\é', content="1"))]
    got = C.format_chats(spark.createDataFrame(rows, MESSAGE)).collect()[0]
    order = [m.get("tool_call_id") or m["tool_calls"][0]["id"] for m in json.loads(got.chat)["messages"]]
    assert order == ['a"\\é', 'a"\\é', "b"] and (got.n_calls, got.n_linked, got.n_orphans, got.n_cyclic) == (2, 1, 1, 0)


def test_equal_chats_have_equal_bytes(spark):
    rows = [(c, i, "user", f"text {i} é\t") for c in (1, 2) for i in (2, 0, 1)]
    got = C.format_chats(spark.createDataFrame(rows, MESSAGE)).collect()
    assert len({r.chat for r in got}) == 1 and [m["content"] for m in json.loads(got[0].chat)["messages"]] == [f"text {i} é\t" for i in range(3)]
    assert C.format_chats(spark.createDataFrame([], MESSAGE)).count() == 0


def test_a_thousand_dependent_calls_take_no_longer_than_a_few(spark):
    import time

    def chain(n):
        rows = [(1, 2 * (n - i), "assistant", text(tool_calls=[call(f"c{i}", x={"$result": f"c{i - 1}"} if i else 1)])) for i in range(n)]
        rows += [(1, 2 * (n - i) - 1, "tool", text(tool_call_id=f"c{i}", content=str(i))) for i in range(n)]
        table = spark.createDataFrame(rows, MESSAGE)
        start = time.time()
        got = C.format_chats(table).first()
        took = time.time() - start
        order = [m.get("tool_call_id") or m["tool_calls"][0]["id"] for m in json.loads(got.chat)["messages"]]
        assert order == [f"c{i}" for i in range(n) for _ in "ab"] and got.n_cyclic == 0 and got.n_linked == n
        return took

    chain(4)
    few = chain(8)
    assert chain(1000) < 3 * few + 15


def test_order_equals_one_worked_out_by_hand(spark):
    import random

    rng, rows = random.Random(7), []
    for conv in range(12):
        ids = [f"k{i}" for i in range(rng.randrange(2, 9))]
        turns = rng.sample(range(40), 2 * len(ids))
        for n, i in enumerate(ids):
            needs = rng.sample(ids, rng.randrange(0, 3))
            rows.append((conv, turns[2 * n], "assistant", text(tool_calls=[call(i, x=[{"$result": k} for k in needs])])))
            rows.append((conv, turns[2 * n + 1], "tool", text(tool_call_id=i, content="r")))
    got = {r.conv_id: r for r in C.format_chats(spark.createDataFrame(rows, MESSAGE)).collect()}
    for conv in range(12):
        own = [(t, role, json.loads(x)) for c, t, role, x in rows if c == conv]
        call_at = {x["tool_calls"][0]["id"]: t for t, role, x in own if role == "assistant"}
        result_at = {x["tool_call_id"]: t for t, role, x in own if role == "tool"}
        waits = {t: {call_at[x["tool_call_id"]]} if role == "tool" else {result_at[k["$result"]] for k in x["tool_calls"][0]["arguments"]["x"]} for t, role, x in own}
        place, level = {t: (t, 0) for t in waits if not waits[t]}, 0
        while more := {t for t in waits if t not in place and waits[t] <= set(place)}:
            level += 1
            place |= {t: (max([t, *(place[o][0] for o in waits[t])]), level) for t in more}
        want = sorted(waits, key=lambda t: (*place.get(t, (t, C.NO_DEPTH)), t))
        names = {t: ("tool", x.get("tool_call_id")) if role == "tool" else ("assistant", x["tool_calls"][0]["id"]) for t, role, x in own}
        found = [(m["role"], m.get("tool_call_id") or m["tool_calls"][0]["id"]) for m in json.loads(got[conv].chat)["messages"]]
        assert found == [names[t] for t in want] and got[conv].n_cyclic == len(waits) - len(place)


def test_op9_takes_every_step(spark, tmp_path):
    """The query itself checks arguments and orders by what waits for what, wherever its table has calls."""
    import json

    from lodestone.llm import queries

    def call(id_, **arguments):
        return json.dumps({"tool_calls": [{"id": id_, "name": "look0", "arguments": arguments}]})

    result = json.dumps({"tool_call_id": "a", "content": "found"})
    rows = [(1, 0, "tool", result), (1, 1, "assistant", call("a", x=1)), (2, 0, "user", "hi"), (2, 1, "assistant", call("b", x="no"))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op9_chat(spark, str(tmp_path)).collect()}
    assert got[1].n_linked == 1 and got[1].n_invalid == 0 and got[2].n_invalid == 1
    assert [m["role"] for m in json.loads(got[1].chat)["messages"]] == ["assistant", "tool"]
