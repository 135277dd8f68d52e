"""Cleaning documents for training in five stages, each an operator of lodestone.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, and each keeps every row that it does not reject.

In every stage other columns than those of documents are dropped, whatever their names; doc_id has to be a number or
null; an empty table gives an empty one; texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, pieces, simhash, substring, toxicity
from lodestone.llm.common import finished, joined, stored, tables_made, with_keys
from lodestone.llm.queries import TOKENIZERS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic; trained on rows that are not held out.

    Null and empty texts are judged like the labelled examples without words, and are kept where there are none.
    Repeated rows and equal texts are judged alike. Without labels of both kinds every document is kept.
    """
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, model).where("toxic_predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of SimHash near-duplicates: that with the smallest identifier, null ones last.

    Rows are told apart by identifier and text; of rows equal in both, one stays. Null, empty and blank texts have one
    fingerprint, so that one of them all stays. Ties between rows with one identifier go to the smaller hash of the text.
    """
    docs = docs.select(*COLUMNS)
    text_hash = F.xxhash64("text")
    keyed = docs.withColumns({"kd": F.coalesce(F.col("doc_id").cast("long"), text_hash), "kt": text_hash})
    prints, groups = simhash.grouped(keyed, keep=("kd", "kt"))
    rows = stored(prints.groupBy("fp", "kd", "kt").agg(F.min("id").alias("id"), F.count("*").alias("n")), "rows")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "kt", "kd")
    best = rows.groupBy("fp").agg(F.min(place).alias("place")).join(groups, "fp")
    winners = stored(best.groupBy("component").agg(F.min("place").alias("place")).select("place.kd", "place.kt", F.lit(True).alias("wins")), "winners")
    marked = rows.join(winners, ["kd", "kt"], "left").select("kd", "kt", F.col("wins").isNotNull().alias("wins"), "n")
    marked = stored(marked.where("n > 1 or not wins").select("kd", "kt", "wins"), "rejected")
    out = keyed.join(marked.hint("shuffle_hash"), ["kd", "kt"], "left_anti").select(*COLUMNS)
    again = stored(marked.where("wins").select("kd", "kt"), "repeated")
    if not again.limit(1).count():
        return out
    # of equal rows one stays; combined before the shuffle, so that a row with very many copies is no hot key
    other = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "lang", "source", "n_chars")
    once = joined(keyed, again, ["kd", "kt"], "left_semi", 16).groupBy("kd", "kt").agg(F.min(other).alias("x"), F.first("text").alias("text"))
    return out.unionByName(once.select("x.doc_id", "text", "x.lang", "x.source", "x.n_chars"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand elsewhere too; those that lose all their words go.

    A passage is 35 words or more; each place of it goes, also in one document. Null and empty texts are kept as they
    are. Of repeated rows with so many words nothing is left, which is why near-duplicates go before.
    """
    docs = docs.select(*COLUMNS)
    kept = substring.dedup(docs)
    left = (F.col("n_words") > F.col("n_removed")) | (F.col("n_words") == 0)
    text = F.col("kept_text")
    return kept.where(left).select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages by the contamination rule: one word in twenty or more is hit.

    Null and empty texts hold none. Repeated rows are judged alike, and go or stay together.
    """
    docs = docs.select(*COLUMNS)
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rejected = stored(found.where("contaminated").select("kd", "tag").distinct(), "rejected")
    return with_keys(docs).join(rejected.hint("shuffle_hash"), ["kd", "tag"], "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, with seeded merge-dropout.

    Null texts have null pieces, empty ones none; equal texts get equal pieces.
    """
    return pieces.encode(docs.select(*COLUMNS), f"{TOKENIZERS}/piece_bpe_32k.model").select("doc_id", "text", "lang", "source", "n_chars", "piece_ids", "n_pieces", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: No SQL: nearest examples by blocks, a vantage-point tree and merge-dropout have no form in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder, where it replaces what was there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    mark = tables_made()
    for name, stage in STAGES[:-1]:
        docs = finished(stage(spark, docs, sf_dir), name, mark)
    return STAGES[-1][1](spark, docs, sf_dir)
