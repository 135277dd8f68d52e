"""Chat formatting with linked tool calls, in DataFrame functions alone.

A message is (conversation, turn, role, text). An assistant's text may be a JSON object with tool_calls, a list of
{"id", "name", "arguments"}, beside content; the text of role tool may be one with tool_call_id and content. Calls and
results of a conversation are joined by hash on that identifier. Arguments are checked against the schemas of the
tools. Messages come in topological order: a result after its call, and a call after the results that its arguments
name as {"$result": id}; among those that are free, by turn. The output is canonical JSON: sorted keys, no spaces, no
nulls, so that equal conversations have equal bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CALLS = "array<struct<id: string, name: string, arguments: variant>>"
#: Types of a variant value by the type name of a schema.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}
#: Stands for the depth of messages in or behind a cycle, after all others.
NO_DEPTH = 2**31 - 1
#: Stands for a null turn, before all others.
NO_TURN = -(2**62)


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, at, role, content, calls, call_id): at tells apart messages with the same turn.

    conv is a struct of the conversation's identifier, so that a null one equals itself in joins.
    """
    value = F.when(F.col("role").isin("assistant", "tool") & F.ltrim("text", F.lit(" \t\r\n")).startswith("{"), F.try_parse_json(F.col("text")))
    base = messages.select(F.struct(F.col(conv).alias("c")).alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(NO_TURN)).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("v", value)
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", CALLS))
    call_id = F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string"))
    structured = calls.isNotNull() | call_id.isNotNull()
    content = F.when(structured, F.try_variant_get("v", "$.content", "string")).otherwise(F.col("text"))
    order = F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text")) - 1
    return base.select("conv", "turn", "role", "text", content.alias("content"), calls.alias("calls"), call_id.alias("call_id")).withColumn("at", order).drop("text")


def calls_of(messages: DataFrame) -> DataFrame:
    """One row for each call: its place (turn, at, i), identifier, name and arguments; the first of equal ids counts."""
    each = messages.where("calls is not null").select("conv", "turn", "at", F.posexplode("calls").alias("i", "c")).select("conv", "turn", "at", "i", "c.id", "c.name", "c.arguments")
    rank = F.row_number().over(Window.partitionBy("conv", "id").orderBy("turn", "at", "i"))
    return each.withColumn("first", (rank == 1) & F.col("id").isNotNull())


def invalid_arguments(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """(conv, turn, at, i, problems): problems sorted and joined; calls without one have no row.

    tools is (name, parameter, type, required), one row for each parameter; a tool without parameters has one row with
    a null parameter. Unknown tools, missing required, unknown, and wrongly typed parameters are problems.
    """
    key = ["conv", "turn", "at", "i"]
    names = tools.select("name").distinct()
    unknown = calls.join(names, "name", "left_anti").select(*key, F.concat(F.lit("unknown tool "), F.coalesce("name", F.lit(""))).alias("problem"))
    known = calls.join(names, "name", "left_semi")
    shape = F.schema_of_variant("arguments")
    broken = known.where(F.col("arguments").isNull() | ~shape.startswith("OBJECT")).select(*key, F.lit("arguments are no object").alias("problem"))
    spec = tools.where("parameter is not null")
    objects = known.where(shape.startswith("OBJECT"))
    expected = objects.select(*key, "name", "arguments").join(spec, "name")
    value = F.expr("element_at(cast(arguments as map<string, variant>), parameter)")
    expected = expected.select(*key, "parameter", "type", "required", value.alias("value"))
    pattern = F.coalesce(*(F.when(F.col("type") == t, F.lit(f"^{p}$")) for t, p in TYPES.items()), F.lit(".*"))
    missing = expected.where("value is null and required").select(*key, F.concat(F.lit("missing "), "parameter").alias("problem"))
    typed = expected.where("value is not null").where(~F.rlike(F.schema_of_variant("value"), pattern)).select(*key, F.concat(F.lit("not "), "type", F.lit(": "), "parameter").alias("problem"))
    given = objects.select(*key, "name", F.explode(F.map_keys(F.expr("cast(arguments as map<string, variant>)"))).alias("parameter"))
    extra = given.join(spec.select("name", "parameter").distinct(), ["name", "parameter"], "left_anti").select(*key, F.concat(F.lit("unknown "), "parameter").alias("problem"))
    problems = unknown.unionByName(broken).unionByName(missing).unionByName(typed).unionByName(extra)
    return problems.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("problem")), "; ").alias("problems"))


def ordered(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """messages with depth and place, by which they sort in topological order.

    depth is 0 for messages that wait for nothing, else one more than the deepest they wait for; place is the largest
    turn among a message and all it waits for. A message in a cycle, or behind one, has a null depth and stays at its
    turn; a result without a call waits for nothing. Which messages of a conversation wait for which is one value, as the
    conversation is: a fold over it places all messages whose turn has come, level by level, so that a chain of any
    length needs no more jobs than a short one.
    """
    own = calls.where("first").select("conv", "id", F.col("turn").alias("on_turn"), F.col("at").alias("on_at"))
    results = messages.where("call_id is not null").select("conv", "turn", "at", F.col("call_id").alias("id"))
    back = results.join(own.hint("shuffle_hash"), ["conv", "id"]).drop("id")
    named = F.regexp_extract_all(F.to_json("arguments"), F.lit(r'"\$result":("(?:[^"\\]|\\.)*")'), F.lit(1))
    named = F.transform(named, lambda x: F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>")[0])
    needs = calls.where("arguments is not null").select("conv", "turn", "at", F.explode(named).alias("id"))
    on = results.select("conv", F.col("turn").alias("on_turn"), F.col("at").alias("on_at"), "id")
    edges = stored(back.unionByName(needs.join(on.hint("shuffle_hash"), ["conv", "id"]).drop("id")).distinct(), "waits")
    key = ["conv", "turn", "at"]
    ends = edges.select(*key).unionByName(edges.select("conv", F.col("on_turn").alias("turn"), F.col("on_at").alias("at"))).distinct()
    nodes = stored(ends.withColumn("i", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "at")) - 1), "nodes")
    targets = nodes.select("conv", F.col("turn").alias("on_turn"), F.col("at").alias("on_at"), F.col("i").alias("j"))
    on = edges.join(nodes, key).join(targets, ["conv", "on_turn", "on_at"]).groupBy("conv", "i").agg(F.collect_list("j").alias("on"))
    node = F.struct("i", "turn", "at", F.coalesce("on", F.array().cast("array<int>")).alias("on"))
    graphs = nodes.join(on, ["conv", "i"], "left").groupBy("conv").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    placed = graphs.select("conv", F.explode(F.arrays_zip("nodes", _levels(F.col("nodes")).alias("found"))).alias("x"))
    placed = placed.select("conv", "x.nodes.turn", "x.nodes.at", F.col("x.found.place").alias("place"), F.col("x.found.depth").alias("depth"), F.lit(True).alias("waits"))
    out = messages.join(placed, key, "left")
    return out.withColumn("place", F.coalesce("place", "turn")).withColumn("depth", F.when(F.col("waits"), F.col("depth")).otherwise(0)).drop("waits")


def _levels(nodes: Column) -> Column:
    """For nodes (turn, on: places of those it waits for) an array of (depth, place), by a fold of as many steps as there
    are nodes, which does nothing any more once a level is empty."""

    def one(depth: Column, place: Column) -> Column:
        return F.struct(depth.cast("int").alias("depth"), place.cast("long").alias("place"))

    def state(more: Column, found: Column) -> Column:
        return F.struct(more.alias("more"), found.alias("found"))

    def level(acc: Column, depth: Column) -> Column:
        def place(n: Column, i: Column) -> Column:
            own = F.get(acc["found"], i)
            ready = F.forall(n["on"], lambda o: F.get(acc["found"], o)["depth"].isNotNull())
            latest = F.array_max(F.transform(n["on"], lambda o: F.get(acc["found"], o)["place"]))
            return F.when(own["depth"].isNotNull() | ~ready, own).otherwise(one(depth, F.greatest(n["turn"], latest)))

        def left(found: Column) -> Column:
            return F.size(F.filter(found, lambda x: x["depth"].isNull()))

        # the transform over one element gives the new level a name, so that it is worked out once
        named = F.transform(F.array(F.transform(nodes, place)), lambda new: state((left(new) < left(acc["found"])) & (left(new) > 0), new))
        return F.when(acc["more"], F.get(named, F.lit(0))).otherwise(acc)

    first = F.transform(nodes, lambda n: one(F.when(F.size(n["on"]) == 0, 0), n["turn"]))
    return F.aggregate(F.sequence(F.lit(1), F.size(nodes)), state(F.lit(True), first), level)["found"]


def format_chats(messages: DataFrame, tools: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv, n_messages, n_calls, n_linked, n_orphans, n_invalid, n_cyclic, chat.

    chat is {"messages":[...]} in topological order, each with content, role and, where given, tool_call_id and
    tool_calls. Null texts are empty strings, null roles empty ones, null turns come first; messages with a null
    conversation form one of their own; repeated rows are repeated messages. A call without a result and a result
    without a call are kept as they are and counted as orphans. Without tools nothing is validated. A conversation is
    one value of the result and so has to fit a task, as its longest text has.
    """
    read = stored(parsed(messages, conv, turn, role, text), "messages")
    calls = calls_of(read)
    results = read.where("call_id is not null").select("conv", F.col("call_id").alias("id")).distinct()
    answered = calls.where("first").join(results.hint("shuffle_hash"), ["conv", "id"], "left_semi").select("conv", "turn", "at", "i", F.lit(1).alias("linked"))
    key = ["conv", "turn", "at", "i"]
    facts = calls.select(*key).join(answered, key, "left")
    if tools is not None:
        facts = facts.join(invalid_arguments(calls, tools).select(*key, F.lit(1).alias("invalid")), key, "left")
    else:
        facts = facts.withColumn("invalid", F.lit(0))
    per_chat = facts.groupBy("conv").agg(F.count("*").alias("n_calls"), F.count("linked").alias("n_linked"), F.sum(F.coalesce("invalid", F.lit(0))).alias("n_invalid"))
    lost = read.where("call_id is not null").join(calls.where("first").select("conv", F.col("id").alias("call_id")), ["conv", "call_id"], "left_anti").groupBy("conv").agg(F.count("*").alias("lost"))
    as_json = F.transform("calls", lambda c: F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json(c.arguments), F.lit("{}")), F.lit(","), F.to_json(F.struct(c.id.alias("id"), c["name"].alias("name"))).substr(2, 1 << 30)))
    head = F.to_json(F.struct("content", "role", F.col("call_id").alias("tool_call_id")))
    message = F.when(F.col("calls").isNull(), head).otherwise(F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"tool_calls":['), F.array_join(as_json, ","), F.lit("]}")))
    lines = ordered(read, calls).select("conv", "depth", F.struct("place", F.coalesce("depth", F.lit(NO_DEPTH)).alias("depth"), "turn", "at", message.alias("json")).alias("line"))
    chats = lines.groupBy("conv").agg(F.count("*").alias("n_messages"), F.sum(F.col("depth").isNull().cast("long")).alias("n_cyclic"), F.sort_array(F.collect_list("line")).alias("lines"))
    out = chats.join(per_chat, "conv", "left").join(lost, "conv", "left")
    n = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_calls", "n_linked", "n_invalid", "lost")}
    chat = F.concat(F.lit('{"messages":['), F.array_join(F.transform("lines", lambda x: x.json), ","), F.lit("]}"))
    return out.select(F.col("conv.c").alias(conv), "n_messages", n["n_calls"].alias("n_calls"), n["n_linked"].alias("n_linked"), (n["n_calls"] - n["n_linked"] + n["lost"]).alias("n_orphans"), n["n_invalid"].alias("n_invalid"), "n_cyclic", chat.alias("chat"))

