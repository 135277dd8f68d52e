"""Answers from context: providers by name, prompts, and the event stream to a client."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rag

PROMPTS = {
    "pathfinder": "Explain where things are in this code base and how to get from one to another.",
    "chronicle": "Explain from the commits how this code base came to be as it is.",
    "diagnostician": "Find the likely cause of the fault that is described, and say what supports it.",
    "blueprint": "Explain the structure of this code base and why its parts are cut as they are.",
    "sentinel": "Review the code that is shown and name what should be changed.",
}


def extractive(prompt: str, context: str) -> Iterator[str]:
    """Quotes the first lines of the context: a provider that needs no model."""
    yield from (line + "\n" for line in context.split("\n")[:20])


PROVIDERS: dict[str, Callable[[str, str], Iterator[str]]] = {"extractive": extractive}


def register(name: str, provider: Callable[[str, str], Iterator[str]]) -> None:
    PROVIDERS[name] = provider


def answer(context: DataFrame, question: str, agent: str = "pathfinder", provider: str = "extractive") -> Iterator[dict]:
    """A record with the context, one for each piece of the answer, and an end; the context has a few rows."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider}; there are {sorted(PROVIDERS)}")
    rows = [r.asDict() for r in rag.context_summary(context).orderBy("position").collect()]
    yield {"type": "context", "items": rows}
    if not rows:
        yield {"type": "chunk", "text": rag.NO_CONTEXT}
    else:
        prompt = f"{PROMPTS.get(agent, PROMPTS['pathfinder'])}\n\nQuestion: {question}"
        for piece in PROVIDERS[provider](prompt, rag.prompt_text(context).first().text):
            yield {"type": "chunk", "text": piece}
    yield {"type": "done"}


def prompt(agent: Column, question: Column) -> Column:
    """What an agent is told, and the question; an unknown agent is the first one."""
    words = F.create_map(*(F.lit(x) for pair in PROMPTS.items() for x in pair))
    told = F.coalesce(F.try_element_at(words, F.coalesce(agent, F.lit(""))), F.lit(PROMPTS["pathfinder"]))
    return F.concat(told, F.lit("\n\nQuestion: "), F.coalesce(question, F.lit("")))


def answered(asked: DataFrame, provider: str = "extractive") -> DataFrame:
    """(id, i, kind, text) for asked (id, agent, question, context), many questions at once: the pieces of each answer in
    order, and an end. Tasks ask the provider question by question, and pass pieces on as they come; without a context
    the answer says so. Equal questions are asked each for itself, so ids should differ.
    """
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider}; there are {sorted(PROVIDERS)}")
    ask, rows = PROVIDERS[provider], asked.select("id", prompt(F.col("agent"), F.col("question")).alias("prompt"), "context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                id_, told, context = (c[at].as_py() for c in batch.columns)
                pieces = ask(told, context) if context and context.strip() else iter([rag.NO_CONTEXT])
                out = [("chunk", p) for p in pieces] + [("done", None)]
                yield pa.RecordBatch.from_arrays([pa.array([id_] * len(out), batch.schema.field("id").type), pa.array(range(len(out)), pa.int32()), pa.array([k for k, _ in out]), pa.array([t for _, t in out], pa.string())], names=["id", "i", "kind", "text"])

    return rows.mapInArrow(run, f"id {asked.schema['id'].dataType.simpleString()}, i int, kind string, text string")


def analyse_issue(nodes: DataFrame, query: list[float], title: str, body: str, provider: str = "extractive") -> Iterator[dict]:
    """The records of an answer to an issue, from functions, files and commits near its title and body."""
    yield from answer(rag.issue_context(nodes, query, title, body), f"{title}\n\n{body}", "diagnostician", provider)


def events(records: Iterator[dict]) -> Iterator[str]:
    """Lines of a server-sent event stream."""
    for r in records:
        yield f"data: {json.dumps(r, sort_keys=True, default=str)}\n\n"
    yield "data: [DONE]\n\n"


def received(streams: DataFrame) -> DataFrame:
    """(id, i, kind, text) from (id, body): the records of event streams in order; lines that are none are left out."""
    lines = streams.select("id", F.posexplode(F.split("body", "\n")).alias("i", "line")).where(F.col("line").startswith("data: "))
    data = F.substring("line", 7, 1 << 30)
    record = F.from_json(data, "type string, text string")
    kind = F.when(data == "[DONE]", "end").otherwise(F.coalesce(record.type, F.lit("raw")))
    return lines.select("id", "i", kind.alias("kind"), F.when(kind == "raw", data).otherwise(record.text).alias("text"))
