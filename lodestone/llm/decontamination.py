"""Benchmark decontamination with a positional inverted index, in DataFrame functions alone.

The index holds the postings (term, document, position) of every benchmark term in the documents, in files sorted by
term, written once; one further posting for each document tells its length. A window of benchmark words is looked for
from its rarest term: that term's list gives the places where the window could stand, the list of its second rarest
term, adjusted by the offset between the two, thins them out, and the lists of all remaining terms of the item are
intersected on the places that are left. Runs of consecutive words that agree are phrase matches.

Nothing is moved but postings of rare terms and of places that two rare terms share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, stored, with_keys

#: Words of the contamination rule: runs of digits, a to z and everything beyond ASCII, after A-Z are lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


@dataclass(frozen=True)
class Index:
    """items (item, item_id, at, term, length), terms (word, term) and postings (kd, tag, term, pos).

    A posting with a term of 0 or less has the document's number of words as pos; -1 stands for a null id.
    """

    items: DataFrame
    terms: DataFrame
    postings: DataFrame


def build_index(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> Index:
    numbered = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).distinct()
    numbered = numbered.withColumn("item", F.xxhash64("item_id", "text")).withColumn("words", words(F.col("text")))
    exploded = stored(numbered.select("item", "item_id", F.size("words").alias("length"), F.posexplode("words").alias("at", "word")), "benchmark")
    # numbers by task and row, fixed by being written: no task sees the whole vocabulary
    terms = stored(exploded.select("word").distinct().withColumn("term", F.monotonically_increasing_id() + 1), "terms")
    items = stored(joined(exploded, terms, ["word"], "inner", 40 + F.octet_length("word")).select("item", "item_id", "at", "term", "length"), "items")
    ends = terms.unionByName(docs.sparkSession.createDataFrame([("", 0)], "word string, term long"))
    keyed = with_keys(docs.select(id_col, text_col), id_col, text_col).select("kd", "tag", F.col(id_col).isNull().alias("unnamed"), words(F.col(text_col)).alias("words"))
    tokens = keyed.select("kd", "tag", "unnamed", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    found = joined(tokens, stored(ends, "vocabulary"), ["word"], "inner", 40 + F.octet_length("word"))
    term = F.when((F.col("term") == 0) & F.col("unnamed"), -1).otherwise(F.col("term")).cast("long").alias("term")
    return Index(items, terms, stored(found.select("kd", "tag", term, "pos").sortWithinPartitions("term"), "postings"))


def phrases(index: Index, window: int = 13) -> DataFrame:
    """(kd, tag, item, item_id, start, stop): the longest runs of item words, of at least a window, in documents.

    An item of fewer words than window is one window.
    """
    postings = index.postings.where("term > 0")
    frequency = stored(postings.groupBy("term").agg(F.count("*").alias("frequency")), "frequencies")
    items = joined(index.items, frequency, ["term"], "left", 24).na.fill(0, ["frequency"])
    items = stored(items.withColumn("size", F.least("length", F.lit(window))), "weighted")
    # each word stands in the windows that start up to size - 1 before it
    in_window = items.withColumn("first", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("size") + 1), F.least("at", F.col("length") - F.col("size")))))
    rank = F.row_number().over(Window.partitionBy("item", "first").orderBy("frequency", "term", "at"))
    ranked = in_window.withColumn("rank", rank).where("rank <= 2").groupBy("item", "first").agg(
        F.min("frequency").alias("least"), F.min(F.when(F.col("rank") == 1, F.struct("at", "term"))).alias("one"), F.min(F.when(F.col("rank") == 2, F.struct("at", "term"))).alias("two")
    )
    pairs = stored(ranked.where("least > 0").select("item", F.col("one.at").alias("at1"), F.col("one.term").alias("term1"), F.col("two.at").alias("at2"), F.col("two.term").alias("term2")).distinct(), "pairs")
    rarest = stored(pairs.select("item", "at1", F.col("term1").alias("term")).distinct(), "rarest")
    seen = joined(postings, rarest, ["term"], "inner", 40).select("kd", "tag", "item", "at1", (F.col("pos") - F.col("at1")).alias("shift"))
    second = joined(seen, pairs.withColumnRenamed("term2", "term"), ["item", "at1"], "inner", 48)
    alone = second.where("term is null").select("kd", "tag", "item", "shift")
    asked = second.where("term is not null").select("kd", "tag", "item", "shift", "term", (F.col("shift") + F.col("at2")).alias("pos")).where("pos >= 0")
    lists = joined(postings, stored(pairs.where("term2 is not null").select(F.col("term2").alias("term")).distinct(), "second"), ["term"], "left_semi", 16)
    places = stored(asked.join(lists, ["kd", "tag", "pos", "term"]).select("kd", "tag", "item", "shift").unionByName(alone).distinct(), "places")
    # all terms of the item at the places left; an item's beginning may lie before that of the document
    wanted = joined(places, items.select("item", "item_id", "at", "term", "size"), ["item"], "inner", 64).select("kd", "tag", "item", "item_id", "shift", "at", "size", "term", (F.col("shift") + F.col("at")).alias("pos")).where("pos >= 0")
    some = joined(postings, stored(places.select("kd", "tag").distinct(), "some"), ["kd", "tag"], "left_semi", 24)
    agreed = wanted.join(some.distinct(), ["kd", "tag", "pos", "term"], "left_semi")
    by = Window.partitionBy("kd", "tag", "item", "shift").orderBy("at")
    runs = agreed.withColumn("run", F.col("at") - F.row_number().over(by)).groupBy("kd", "tag", "item", "shift", "run")
    runs = runs.agg(F.first("item_id").alias("item_id"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.first("size").alias("size"))
    return runs.where("stop - start >= size").select("kd", "tag", "item", "item_id", "start", "stop")


def proximity(index: Index, slack: int = 5) -> DataFrame:
    """(kd, tag, item, item_id, start): items all of whose different words stand, in any order, within the item's
    length plus slack words; start is the place of one occurrence of the item's rarest term."""
    postings = index.postings.where("term > 0")
    frequency = postings.groupBy("term").agg(F.count("*").alias("frequency"))
    terms = joined(index.items.select("item", "item_id", "term", "length").distinct(), stored(frequency, "frequencies"), ["term"], "left", 24).na.fill(0, ["frequency"])
    rank = F.row_number().over(Window.partitionBy("item").orderBy("frequency", "term"))
    terms = stored(terms.withColumn("rank", rank).withColumn("kinds", F.count("*").over(Window.partitionBy("item"))), "ranked")
    rarest = stored(terms.where("rank = 1 and frequency > 0").select("item", "item_id", "term", "length", "kinds"), "rarest")
    seen = joined(postings, rarest, ["term"], "inner", 64).withColumnRenamed("pos", "start").drop("term")
    wanted = joined(seen, terms.select("item", "term"), ["item"], "inner", 32)
    reach = F.col("length") + slack
    near = wanted.join(postings, ["kd", "tag", "term"]).where(F.abs(F.col("pos") - F.col("start")) < reach)
    # a stretch of reach words that holds the rarest term starts at one of the words near it
    starts = near.select("kd", "tag", "item", "item_id", "start", "kinds", "term", "pos", reach.alias("reach"))
    begin = starts.select("kd", "tag", "item", "start", F.col("pos").alias("begin")).where("begin <= start").distinct()
    full = starts.join(begin, ["kd", "tag", "item", "start"]).where("pos >= begin and pos < begin + reach and start < begin + reach")
    full = full.groupBy("kd", "tag", "item", "item_id", "start", "begin", "kinds").agg(F.count_distinct("term").alias("n")).where("n = kinds")
    return full.select("kd", "tag", "item", "item_id", "start").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 13) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated, kd and tag.

    n_hit counts the words inside any occurrence of a window of consecutive benchmark words; contaminated is set where
    they are at least one word in twenty. Null and empty texts have no words; null ids stay null; repeated rows have
    equal results; repeated items are one; items without words are never met, and an item without an id is named by an
    empty string. An empty benchmark hits nothing. Other columns are not used.
    """
    index = build_index(docs, benchmark, id_col, text_col, item_col)
    runs = stored(phrases(index, window), "phrases")
    before = F.max("stop").over(Window.partitionBy("kd", "tag").orderBy("start", "stop", "item").rowsBetween(Window.unboundedPreceding, -1))
    covered = runs.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0)))))
    per_doc = covered.groupBy("kd", "tag").agg(F.sum("new").cast("long").alias("n_hit"), F.array_sort(F.collect_set(F.coalesce("item_id", F.lit("")))).alias("items"))
    per_doc = stored(per_doc, "hits")
    base = index.postings.where("term <= 0").select("kd", "tag", F.when(F.col("term") == 0, F.col("kd")).alias(id_col), F.col("pos").cast("long").alias("n_words"))
    out = joined(base, per_doc, ["kd", "tag"], "left", 64 + F.size("items") * 24)
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        id_col, "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), "kd", "tag"
    )
