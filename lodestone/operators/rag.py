"""Retrieval of context for questions: quotas by node type, summaries and prompt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import Flags, Settings
from lodestone.functions import texts

from .search import nearest_by_label, text_score, top_by

# fixed values: node types of each agent, by priority
AGENTS = {
    "pathfinder": ("Function", "Class", "File"),
    "chronicle": ("Commit", "File"),
    "diagnostician": ("Function", "Class", "Commit", "File"),
    "blueprint": ("Class", "File", "Function"),
    "sentinel": ("Function", "Class", "File", "Commit"),
}
OTHERS = ("Function", "Class", "File")
NO_CONTEXT = "No relevant context was found for this question."


def agent_types(agent: str) -> tuple[str, ...]:
    return AGENTS.get(agent, OTHERS)


def ask_context(nodes: DataFrame, query: list[float], text: str, agent: str = "pathfinder", limit: int = 5, kind: str = "hybrid", types: tuple[str, ...] | None = None, per_type: int | None = None, settings: Settings = Settings(), flags: Flags | None = None) -> DataFrame:
    """Context rows with label, score, type_rank and position for a question.

    Every type of the agent has the same share of limit, at least one. All types are searched in one scan: the nearest
    of each label make its pool (twice the share for hybrid search), the best of the pool are kept. Without hybrid
    search the vectors alone decide; without vector search there is no context.
    """
    if kind not in ("vector", "hybrid") or not 1 <= limit <= 20:
        raise ValueError("kind must be vector or hybrid, and limit from 1 to 20")
    flags = flags or Flags()
    types = types or agent_types(agent)
    share = per_type or max(1, limit // len(types))
    hybrid = kind == "hybrid" and flags.on("hybrid_search")
    some = nodes.where(F.col("label").isin(*types)) if hybrid or flags.on("vector_search") else nodes.limit(0)
    pool = nearest_by_label(some, query, share * (2 if hybrid else 1), settings.similarity)
    words = F.when(F.col("label") == "Commit", text_score("Commit", text)).otherwise(text_score("Function", text)) if hybrid else F.lit(0.0)
    weight = settings.vector_weight if hybrid else 1.0
    both = pool.drop("rank").withColumn("score", F.round(weight * F.col("vector_score") + (1 - weight) * words, 9))
    rank = F.array_position(F.array(*map(F.lit, types)), F.col("label")).cast("int").alias("type_rank")
    best = top_by(both, ["label"], share, "score").drop("rank").select("*", rank)
    # a few rows: the shares of all types
    return best.withColumn("position", F.row_number().over(Window.orderBy("type_rank", F.desc("score"), "id")))


def issue_context(nodes: DataFrame, query: list[float], title: str, body: str) -> DataFrame:
    """Context of an issue: functions, files and commits for its title and body."""
    text = f"{title}\n\n{body}"
    parts = [ask_context(nodes, query, text, types=(label,), per_type=n).drop("type_rank", "position").withColumn("type_rank", F.lit(i)) for i, (label, n) in enumerate((("Function", 5), ("File", 3), ("Commit", 5)), 1)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("position", F.row_number().over(Window.orderBy("type_rank", F.desc("score"), "id")))


def _name() -> Column:
    return F.coalesce(F.nullif("name", F.lit("")), F.substring("sha", 1, 8), F.lit("N/A"))


def context_summary(context: DataFrame) -> DataFrame:
    """(position, type, name, content up to 500 characters, score) for display."""
    return context.select("position", F.coalesce("label", F.lit("Unknown")).alias("type"), _name().alias("name"), texts.truncated(F.coalesce("content", F.lit("")), 500).alias("content"), F.coalesce("score", F.lit(0.0)).alias("score"))


def shown(summary: DataFrame) -> DataFrame:
    """Rows that a reader sees: named and with content; the score as a percentage if there is one."""
    return summary.where(~F.col("name").isin("", "N/A") & ~texts.blank(F.col("content"))).withColumn("percent", F.when(F.col("score") > 0, F.format_string("%.0f%%", F.col("score") * 100)))


# fixed values: the lines of the texts below are formats of prompts
def context_text(context: DataFrame) -> DataFrame:
    """One row with the context as a text; a fixed answer without any."""
    content = F.coalesce(F.nullif("content", F.lit("")), F.nullif("snippet", F.lit("")), F.nullif("message", F.lit("")), F.lit(""))
    line = F.concat(F.lit("--- ["), F.coalesce("label", F.lit("Unknown")), F.lit("] "), F.coalesce(F.nullif("name", F.lit("")), "sha", F.lit("N/A")), F.lit(" ---\n"), content, F.lit("\n"))
    lines = context.agg(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return lines.select(F.when(F.size("lines") > 0, F.array_join(F.col("lines.line"), "\n")).otherwise(NO_CONTEXT).alias("text"))


def prompt_text(context: DataFrame) -> DataFrame:
    """One row with numbered context entries, each up to 1000 characters."""
    name = F.when(F.col("label") == "Commit", F.substring("sha", 1, 8)).otherwise(F.coalesce("name", F.lit("Unnamed")))
    entry = F.concat(
        F.lit("\n--- Context "), F.col("position").cast("string"), F.lit(": "), F.coalesce("label", F.lit("Unknown")), F.lit(" '"), name, F.lit("'"),
        F.when(F.col("score").isNotNull(), F.format_string(" (relevance: %.3f)", F.col("score"))).otherwise(""), F.lit(" ---\n"), texts.truncated(F.coalesce("content", F.lit("")), 1000, "\n... (truncated)"),
    )
    lines = context.agg(F.sort_array(F.collect_list(F.struct("position", entry.alias("line")))).alias("lines"))
    return lines.select(F.when(F.size("lines") > 0, F.array_join(F.col("lines.line"), "\n")).otherwise("No relevant context found.").alias("text"))


def memories(table: DataFrame, text: str) -> DataFrame:
    """Memories whose content or metadata hold text, letter for letter."""
    return table.where(F.col("content").cast("string").contains(text) | F.col("metadata").cast("string").contains(text))
