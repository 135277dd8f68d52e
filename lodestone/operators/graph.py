"""Operators on a property graph: nodes (id, label, ...) and edges (src, dst, type, ...)."""

from __future__ import annotations

import random
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the folder that all executors share (spark.checkpoint.dir)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        spark.conf.set("spark.checkpoint.dir", top := "file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return f"{top.rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the folder that all executors share and read back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task should have of a shuffle.
ROWS_OF_TASK = 1_000_000


@contextmanager
def dealt(spark: SparkSession, rows: int, times: int = 1, share: str | None = None) -> Iterator[None]:
    """Jobs that run within it shuffle into as many partitions as rows need, so that a task's share doesn't grow with the
    table; never into fewer than the session asks for, and into a multiple of times. share is the size of
    files that a task reads, and up to which adaptive execution puts small partitions together; the session's if left out."""
    keys = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
    was = [spark.conf.get(key) for key in keys]
    spark.conf.set(keys[0], str(-(-max(int(was[0]), -(-rows // ROWS_OF_TASK)) // times) * times))
    for key in keys[1:] if share else ():
        spark.conf.set(key, share)
    try:
        yield
    finally:
        for key, value in zip(keys, was, strict=True):
            spark.conf.set(key, value)


def expand(starts: DataFrame, edges: DataFrame, nodes: DataFrame, kind: str | None = None, reverse: bool = False) -> DataFrame:
    """(start, id and columns of nodes): nodes one edge away from the column id of starts, along or against it."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    some = edges.where(F.col("type") == kind) if kind else edges
    hops = starts.select(F.col("id").alias("start")).join(some.select(F.col(near).alias("start"), F.col(far).alias("id")), "start")
    return hops.join(nodes, "id")


def dedupe_edges(edges: DataFrame, first_by: Column | None = None) -> DataFrame:
    """One edge for each (src, dst, type): the first by first_by, else any."""
    if first_by is None:
        return edges.dropDuplicates(["src", "dst", "type"])
    rest = [c for c in edges.columns if c not in ("src", "dst", "type")]
    picked = edges.groupBy("src", "dst", "type").agg(F.min_by(F.struct(*rest), first_by).alias("x"))
    return picked.select("src", "dst", "type", *(F.col(f"x.{c}").alias(c) for c in rest))


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): ends of edges that are no nodes, a written table. Ends are made different before they are looked up, so that
    no edge is moved."""
    ends = edges.select(F.col("src").alias("id")).distinct().unionByName(edges.select(F.col("dst").alias("id")).distinct()).where("id is not null")
    both = ends.select("id", F.lit(False).alias("there")).unionByName(nodes.select("id", F.lit(True).alias("there")))
    with dealt(edges.sparkSession, edges.count()):
        return stored(both.groupBy("id").agg(F.max("there").alias("there")).where("not there").select("id"), "missing")


def _end_missing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the column _dangling: whether an end is no node. Few ids are missing as a rule, and then Spark
    broadcasts them."""
    missing = missing_ends(edges, nodes)
    out = edges
    for end in ("src", "dst"):
        out = out.join(missing.select(F.col("id").alias(end), F.lit(True).alias(f"_no_{end}")), end, "left")
    lost = F.col("_no_src").isNotNull() | F.col("_no_dst").isNotNull() | F.col("src").isNull() | F.col("dst").isNull()
    return out.select(*edges.columns, lost.alias("_dangling"))


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    return _end_missing(edges, nodes).where("not _dangling").select(*edges.columns)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an end of which is no node."""
    return _end_missing(edges, nodes).where("_dangling").select(*edges.columns)


def edge_list(edges: DataFrame, nodes: DataFrame, limit: int | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """Edges with label and name of both ends, value (rank of the source from ranks (id, rank), else 1) and ln of the
    weight, for a drawing. Edges without both ends are left out; the first ones by source, target and type are taken."""

    def end(side: str) -> DataFrame:
        return nodes.select(F.col("id").alias(side), F.col("label").alias(f"{side}_label"), F.col("name").alias(f"{side}_name"))

    weight = F.col("weight") if "weight" in edges.columns else F.lit(None).cast("double")
    out = edges.select("src", "dst", "type", F.ln(weight).alias("log_weight")).join(end("src"), "src").join(end("dst"), "dst")
    out = out.orderBy("src", "dst", "type").limit(limit) if limit else out
    value = F.lit(1.0)
    if ranks is not None:
        out = out.join(ranks.select(F.col("id").alias("src"), "rank"), "src", "left")
        value = F.coalesce("rank", value)
    return out.withColumn("value", value).drop("rank")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges that touch a node; a self loop counts once.

    Both sides are counted before they are added, so that no edge is written twice.
    """
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    into = edges.where("not (src <=> dst)").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return out.unionByName(into).groupBy("id").agg(F.sum("n").alias("degree"))


#: Rounds of contraction after which something must be wrong: each leaves half of the nodes that have edges at most.
MOST_ROUNDS = 100


def numbered(pairs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(names, src, dst): a written table (id, n) of the ends of pairs (src, dst), a written table, and what numbers their
    columns. A number is a hash of the id; it is drawn anew if two ids should have the same."""
    ends = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).where("id is not null").distinct()
    for salt in range(MOST_ROUNDS):
        names = stored(ends.withColumn("n", F.xxhash64("id", F.lit(salt))), "names")
        if not names.groupBy("n").agg(F.count("*").alias("ids")).where("ids > 1").limit(1).count():
            return names, F.xxhash64("src", F.lit(salt)), F.xxhash64("dst", F.lit(salt))
    raise RuntimeError("ids can't be told apart by a hash")


def contracted(edges: DataFrame) -> tuple[list[DataFrame], int, DataFrame]:
    """(maps, rounds, names): tables (id, to) of each round, by which the nodes of a component come to one node; nodes are
    numbers, and names (id, n) has them.

    In a round each node hooks to the first of itself and its neighbours, in the order of the numbers with some bits turned,
    which are drawn anew; one that is first itself, and that no other one hooks to, hooks to the first of its neighbours,
    all of which go elsewhere. Pointers jump twice over hooks, and edges move to where their ends point. So no node is
    left alone: each round leaves half of the nodes that have edges at most, however long a path is. Every round is written
    tables; a node with very many edges is combined before the shuffle, and the joins are between written tables, which
    adaptive execution splits where a key is hot. Shuffles have as many partitions as there are edges for.
    """
    spark = edges.sparkSession
    pairs = stored(edges.select("src", "dst").where("src <> dst"), "pairs")
    with dealt(spark, 2 * pairs.count()):
        names, a, b = numbered(pairs)
        # an edge is there once, whichever way it points
        links = stored(pairs.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct(), "links")
    maps: list[DataFrame] = []
    draw = random.Random(42)
    while left := links.count():
        if len(maps) >= MOST_ROUNDS:
            raise RuntimeError(f"more than {MOST_ROUNDS} rounds")
        turned = F.lit(draw.getrandbits(64) - (1 << 63))
        with dealt(spark, 2 * left):
            both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            near = both.groupBy(F.col("src").alias("id")).agg(F.min(F.col("dst").bitwiseXOR(turned)).alias("near"))
            first = F.least(F.col("id").bitwiseXOR(turned), "near")
            near = stored(near.select("id", first.bitwiseXOR(turned).alias("to"), F.col("near").bitwiseXOR(turned).alias("near")), "near")
            taken = near.where("to <> id").select(F.col("to").alias("id")).distinct().withColumn("taken", F.lit(True))
            to = F.when((F.col("to") == F.col("id")) & F.col("taken").isNull(), F.col("near")).otherwise(F.col("to"))
            hooks = stored(near.join(taken, "id", "left").select("id", to.alias("to")), "hooks")
            next_ = hooks.select(F.col("id").alias("to"), F.col("to").alias("next"))
            jumped = hooks
            for _ in range(2):
                jumped = jumped.join(next_, "to").select("id", F.col("next").alias("to"))
            hooks = stored(jumped, "jumped")
            maps.append(hooks)
            a, b = hooks.select(F.col("id").alias("src"), F.col("to").alias("a")), hooks.select(F.col("id").alias("dst"), F.col("to").alias("b"))
            moved = links.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
            links = stored(moved.distinct(), "links")
    return maps, len(maps), names


def _numbers_by_component(maps: list[DataFrame]) -> DataFrame:
    """(n, component): nodes' numbers, and that of a node of their own component that stands for it."""
    # from the last round, which has the fewest nodes, to the first
    out = maps[-1].select("id", F.col("to").alias("component"))
    for i, earlier in enumerate(reversed(maps[:-1])):
        later = out.withColumnRenamed("id", "to")
        out = earlier.join(later, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
        out = stored(out, "components") if i % 4 == 3 else out
    return stored(out.withColumnRenamed("id", "n"), "components")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): nodes that have an edge to another one, and a node of their own component that stands for it."""
    maps, _, names = contracted(edges)
    if not maps:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    with dealt(edges.sparkSession, names.count()):
        found = _numbers_by_component(maps)
        heads = names.select(F.col("n").alias("component"), F.col("id").alias("head"))
        return stored(found.join(heads, "component").join(names, "n").select("id", F.col("head").alias("component")), "components")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id): nodes that a path of edges in either direction joins to the ids of starts, those included."""
    first = starts.select("id").distinct()
    maps, _, names = contracted(edges)
    if not maps:
        return first
    with dealt(edges.sparkSession, names.count()):
        found = _numbers_by_component(maps)
        met = stored(names.join(first, "id", "left_semi"), "met")
        wanted = found.join(met, "n", "left_semi").select("component").distinct()
        reached = names.join(found.join(wanted, "component", "left_semi").select("n"), "n", "left_semi").select("id")
        return stored(reached.unionByName(first.join(met, "id", "left_anti")), "reached")


def statistics(starts: DataFrame, branches: dict[str, DataFrame]) -> DataFrame:
    """starts with one count for each branch (id, item): different items of the id, 0 without any.

    Each branch is counted on its own before it is joined, so that branches don't multiply.
    """
    out = starts
    for name, branch in branches.items():
        out = out.join(branch.groupBy("id").agg(F.count_distinct("item").alias(name)), "id", "left")
    return out.na.fill(0, list(branches))


def path_branch(*hops: tuple[DataFrame, str, str]) -> DataFrame:
    """(id, item) along a chain of hops (edges, near column, far column)."""
    edges, near, far = hops[0]
    out = edges.select(F.col(near).alias("id"), F.col(far).alias("item"))
    for edges, near, far in hops[1:]:
        out = out.join(edges.select(F.col(near).alias("item"), F.col(far).alias("next")), "item").select("id", F.col("next").alias("item"))
    return out


def asked_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (id) with the columns of files, and error where there is no such file."""
    found = wanted.select("id").distinct().join(files.withColumn("_there", F.lit(True)), "id", "left")
    return found.withColumn("error", F.when(F.col("_there").isNull(), "no such file")).drop("_there")


def explain_file(files: DataFrame, edges: DataFrame, commits: int = 5) -> DataFrame:
    """For each file its classes, functions, packages and first commits, and a sentence that counts them.

    All commits of a file are counted, but only the first ones are brought together, by a rank whose limit holds before
    the shuffle: a file that very many commits touch is no large group.
    """
    def around(kind: str, near: str, far: str) -> DataFrame:
        return edges.where(F.col("type") == kind).select(F.col(near).alias("id"), F.col(far).alias("item"))

    def listed(items: DataFrame, name: str) -> DataFrame:
        return items.groupBy("id").agg(F.sort_array(F.collect_set("item")).alias(name))

    touched = around("TOUCHED", "dst", "src").distinct()
    first = touched.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("item"))).where(F.col("rank") <= commits)
    counts = touched.groupBy("id").agg(F.count("*").alias("n_commits"))
    out = files.select("id", "name").join(listed(first, "commits"), "id", "left").join(counts, "id", "left")
    for kind, name in (("CONTAINS_CLASS", "classes"), ("CONTAINS_FUNCTION", "functions"), ("IMPORTS", "packages")):
        out = out.join(listed(around(kind, "src", "dst"), name), "id", "left")
    for name in ("classes", "functions", "packages", "commits"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    said = F.format_string("%s has %d classes, %d functions, %d imports and %d commits", "name", F.size("classes"), F.size("functions"), F.size("packages"), F.coalesce("n_commits", F.lit(0)))
    return out.select("id", "name", "classes", "functions", "packages", "commits", said.alias("summary"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank) after rounds of power iteration; the rank of nodes without out-edges is spread evenly.

    Rounds run on numbers in shuffles dealt by edges, and look ranks up in hash tables, of which each node is one row, so
    that links are not sorted. Every round is one written table, of ranks beside the number of out-edges: from it come what
    a node sends along each edge and, by a scan of two columns, the rank that is to be spread. A null end is a node that
    nothing is sent to or from.
    """
    spark = edges.sparkSession
    # edges are read twice: to write them as they are takes longer than to scan tables again
    with dealt(spark, 2 * edges.count()):
        names, a, b = numbered(edges)
        links = stored(edges.select(F.when(F.col("src").isNotNull(), a).alias("src"), F.when(F.col("dst").isNotNull(), b).alias("dst")).distinct(), "links")
        outs = links.where("src is not null").groupBy(F.col("src").alias("n")).agg(F.count("*").alias("n_out"))
        unnamed = links.where("src is null or dst is null").select(F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("n_out")).limit(1)
        nodes = stored(names.select("n").join(outs.hint("shuffle_hash"), "n", "left").unionByName(unnamed), "ids")
        links = links.where("src is not null and dst is not null")
        n = max(nodes.count(), 1)
        ranks = nodes.withColumn("rank", F.lit(1.0 / n))
        for i in range(rounds):
            ranks = stored(ranks, "ranks") if i else ranks
            lost = ranks.where("n_out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")).first().lost
            share = ranks.where("n_out is not null").select(F.col("n").alias("src"), (F.col("rank") / F.col("n_out")).alias("share"))
            got = links.join(share.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("n")).agg(F.sum("share").alias("got"))
            ranks = nodes.join(got.hint("shuffle_hash"), "n", "left").select("n", "n_out", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n))).alias("rank"))
        return stored(ranks.join(names.hint("shuffle_hash"), "n", "left").select("id", "rank"), "ranks")
