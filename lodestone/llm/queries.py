"""The queries opN_<name> and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, embeddings, html, oracles, packing, pieces, repair, resampling, sharding, simhash, substring, tokenfiles, toxicity

#: Vocabulary files of public tokenizers.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic_predicted").alias("predicted"), F.col("toxic_evidence").alias("evidence"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("kd", "tag")


OP2_SQL = r"""
WITH lowered AS (SELECT 'd' AS k, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT k, id, regexp_extract_all(t, '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM lowered),
bw AS (SELECT DISTINCT id AS item_id, array_to_string(ws[s:s + least(13, len(ws)) - 1], ' ') AS h, least(13, len(ws)) AS n
  FROM (SELECT id, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS s FROM w WHERE k = 'b' AND len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT id AS doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS h FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, sizes WHERE k = 'd' AND len(ws) >= n)),
m AS (SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (h, n)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, s + unnest(range(n)) AS pos FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit ON w.id = hit.doc_id LEFT JOIN items ON w.id = items.doc_id WHERE k = 'd'
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) ON v.vec_id = a JOIN (SELECT a AS i, min(b) AS c FROM r GROUP BY a) ON v.vec_id = i
"""


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", F.col("main_text").alias("text"), F.col("n_main_chars").alias("n_chars"), "n_left_out")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffle_to_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return dealt.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM d)),
r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, s + k AS pos FROM (SELECT doc_id, s, unnest(range(35)) AS k FROM p SEMI JOIN r USING (h))),
each AS (SELECT doc_id, pos, ws[pos] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM d)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS t, count(*) AS n FROM each ANTI JOIN hit USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_counts(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", 50256)


def _tools(spark: SparkSession) -> DataFrame:
    """The schemas that calls are checked against; as SQL, since rows given from Python would need a Python worker."""
    return spark.sql("SELECT * FROM VALUES ('look0', 'x', 'integer', true), ('look0', 'after', 'object', false), ('look1', 'x', 'string', true), ('look1', 'after', 'object', false) AS t(name, parameter, type, required)")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps: calls and results joined, arguments checked against schemas, topological order, canonical JSON."""
    return chat.format_chats(_table(spark, sf_dir, "conversations"), _tools(spark))


OP9_SQL = """
SELECT conv_id, count(*) AS n_messages, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_orphans,
  CAST(0 AS BIGINT) AS n_invalid, CAST(0 AS BIGINT) AS n_cyclic,
  '{"messages":[' || string_agg(CAST(json_object('content', text, 'role', role) AS VARCHAR), ',' ORDER BY turn) || ']}' AS chat
FROM conversations GROUP BY conv_id
"""


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 on conversations with calls made of them: every assistant's turn calls a tool and names the result of the
    call before; in every third conversation the turns behind are results; in every fifth each call waits for itself."""
    c, turn = F.col("conv_id"), F.col("turn")
    said = F.coalesce("text", F.lit(""))

    def name(t):
        return F.concat(F.lit("c"), t.cast("string"))

    waits = F.struct(name(F.when(c % 5 == 0, turn).otherwise(turn - 2)).alias("$result"))
    call = F.to_json(F.struct(said.alias("content"), F.array(F.struct(name(turn).alias("id"), F.concat(F.lit("look"), (turn % 3).cast("string")).alias("name"), F.struct(turn.alias("x"), waits.alias("after")).alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), said.alias("content")))
    calls, answers = F.col("role") == "assistant", (F.col("role") != "assistant") & (c % 3 == 0)
    messages = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(answers, "tool").otherwise(F.col("role")).alias("role"), F.when(calls, call).when(answers, result).otherwise(F.concat(F.lit("said "), said)).alias("text"))
    return chat.format_chats(messages, _tools(spark)).drop("chat")


CHAT_TOOL_CALLS_SQL = """
WITH t AS (SELECT conv_id, turn, role = 'assistant' AS calls, role <> 'assistant' AND conv_id % 3 = 0 AS answers FROM conversations),
l AS (SELECT a.conv_id, a.turn FROM t a JOIN t b ON a.calls AND b.answers AND a.conv_id = b.conv_id AND b.turn = a.turn + 1),
o AS (SELECT b.conv_id, count(*) AS n FROM t b WHERE answers AND NOT EXISTS (SELECT 1 FROM t a WHERE a.calls AND a.conv_id = b.conv_id AND a.turn = b.turn - 1) GROUP BY b.conv_id)
SELECT t.conv_id, count(*) AS n_messages, count(*) FILTER (WHERE calls) AS n_calls, count(l.turn) AS n_linked, CAST(count(*) FILTER (WHERE calls) - count(l.turn) + coalesce(any_value(o.n), 0) AS BIGINT) AS n_orphans,
  count(*) FILTER (WHERE calls AND t.turn % 3 <> 0) AS n_invalid, CASE WHEN t.conv_id % 5 = 0 THEN 2 * count(l.turn) ELSE 0 END AS n_cyclic
FROM t LEFT JOIN l ON t.calls AND l.conv_id = t.conv_id AND l.turn = t.turn LEFT JOIN o ON o.conv_id = t.conv_id GROUP BY t.conv_id
"""


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), f"{TOKENIZERS}/piece_bpe_32k.model").select("doc_id", "n_pieces", "lossless", "piece_ids")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_decontamination": op2_decontamination, "op3_simhash": op3_simhash, "op4_embeddings": op4_embeddings, "op5_html": op5_html, "op6_sharding": op6_sharding, "op7_substring": op7_substring, "op8_token_counts": op8_token_counts, "op9_chat": op9_chat, "op10_sentencepiece": op10_sentencepiece, "op11_packing": op11_packing, "op12_repair": op12_repair, "op13_resampling": op13_resampling, "chat_tool_calls": chat_tool_calls}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op4_embeddings": OP4_SQL, "op7_substring": OP7_SQL, "op9_chat": OP9_SQL, "op12_repair": oracles.OP12_SQL, "op13_resampling": oracles.OP13_SQL, "chat_tool_calls": CHAT_TOOL_CALLS_SQL}
