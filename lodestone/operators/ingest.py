"""Graphs of whole repositories: sources, history, and both together; and the checkpoint of what was ingested."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions import paths, texts
from lodestone.sources import history

from . import dml, embed, extract
from .buckets import Buckets
from .graph import dedupe_edges, stored


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def history_graph(commits: DataFrame, url: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Repository, Commit, Person and File nodes of commits (the columns of gitlog), and the edges between them."""
    info = paths.repo_info(F.lit(url))
    repo = F.lit(name) if name else info["name"]
    rows = commits.select("*", repo.alias("repo"), paths.person(F.col("author_name"), F.col("author_email")).alias("person")).withColumn("id", paths.node_id(F.col("repo"), "commit", F.col("sha")))
    c = F.col
    document = texts.commit_document(F.lit(url), c("sha"), c("author_name"), c("author_email"), c("committed_at"), c("message"), c("insertions"), c("deletions"), c("files_changed"))
    commit_nodes = rows.select("id", F.lit("Commit").alias("label"), "sha", "message", document.alias("content"), "author_name", "author_email", "committed_at", "insertions", "deletions", "files_changed", F.lit(url).alias("repo_url"))
    people = rows.select("person.*").distinct().withColumn("label", F.lit("Person"))
    touched = rows.select("id", "repo", F.explode("files_changed").alias("path")).withColumn("file", paths.node_id(F.col("repo"), F.col("path"), "file"))
    file_nodes = touched.select(F.col("file").alias("id"), F.lit("File").alias("label"), "path", paths.basename(F.col("path")).alias("name"), F.col("repo").alias("repo_name")).distinct()
    one = commits.sparkSession.range(1)
    repository = one.select(F.concat(F.lit("repo:"), repo).alias("id"), F.lit("Repository").alias("label"), repo.alias("name"), info.url.alias("url"), info.owner.alias("owner"), info.full_name.alias("full_name"), info.full_name.alias("content"))
    whole = F.concat(F.lit("repo:"), repo)

    def edge(df: DataFrame, src, dst, kind: str) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))

    edges = [edge(rows, c("id"), whole, "BELONGS_TO"), edge(rows, c("id"), c("person.id"), "AUTHORED_BY"), edge(touched, c("id"), c("file"), "TOUCHED"), edge(touched, c("file"), whole, "BELONGS_TO")]
    return _union([repository, commit_nodes, people, file_nodes]), dedupe_edges(_union(edges))


def source_graph(files: DataFrame, repo: str, url: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Repo, File and symbol nodes of files (repo, path, content), and the edges between them.

    Each file is parsed once: its nodes and edges are rows of one written table, which both tables are read from.
    """
    found = stored(extract.symbols(files), "symbols")
    file_nodes = extract.file_nodes(files)
    top = files.sparkSession.range(1).select(F.lit(f"repo:{repo}").alias("id"), F.lit("Repo").alias("label"), F.lit(repo).alias("name"), F.lit(url).cast("string").alias("url"))
    symbols = found.where("kind = 'node'").select("id", "label", "name", "start_line", "end_line", "signature", "snippet", F.col("sort").alias("kind"))
    symbols = merged_rows(symbols)
    has = file_nodes.select(F.lit(f"repo:{repo}").alias("src"), F.col("id").alias("dst"), F.lit("HAS_FILE").alias("type"))
    edges = found.where("kind = 'edge'").select("src", "dst", "type").unionByName(has)
    return _union([top, file_nodes, symbols]), dedupe_edges(edges)


def merged_rows(nodes: DataFrame) -> DataFrame:
    """One row for each id: of several the one that comes first by all its columns."""
    rest = [c for c in nodes.columns if c != "id"]
    return nodes.groupBy("id").agg(F.min(F.struct(*rest)).alias("x")).select("id", *(F.col(f"x.{c}").alias(c) for c in rest))


def merged(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Graphs as one: a node of several keeps the value of the earliest graph that has one, column by column.

    Equal nodes of one graph that differ give the smallest value, so that the result depends on no order of tasks.
    """
    nodes, edges = _union([n.withColumn("_graph", F.lit(i)) for i, (n, _) in enumerate(graphs)]), _union([e for _, e in graphs])
    columns = [c for c in nodes.columns if c not in ("id", "_graph")]
    best = [F.min(F.when(F.col(c).isNotNull(), F.struct("_graph", F.col(c).alias("value")))).alias(c) for c in columns]
    return nodes.groupBy("id").agg(*best).select("id", *(F.col(f"{c}.value").alias(c) for c in columns)), dedupe_edges(edges)


def plan(was: str | None, now: str, diff: bool = True) -> str:
    """How to bring a graph from the commit was to now: full without a known commit or a diff, none if nothing moved."""
    if was == now:
        return "none"
    return "incremental" if was and diff else "full"


def update(nodes: DataFrame, edges: DataFrame, state: DataFrame, old: DataFrame | None, new: DataFrame, repo: str, sha: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, state) of a repository brought up to sha; old are the files (repo, path, sha, content) of the
    commit that state names, None if they can't be told."""
    from lodestone.streaming import events

    todo = plan(last_sha(state, repo), sha, old is not None)
    if todo == "none":
        return nodes, edges, state
    if todo == "incremental":
        nodes, edges = events.incremental(nodes, edges, old, new, repo, parse)
    else:
        nodes, edges = merged([parse(new), (nodes, edges)])
    return nodes, edges, with_state(state, repo, sha)


NODES = "owner string, id string, label string, name string, start_line int, end_line int, signature string, snippet string, kind string, path string, language string, sha string, lines long"
EDGES = "owner string, src string, dst string, type string"
STATE = "repo_name string, repo_sha string, updated_at timestamp"


@dataclass
class GraphTables:
    """A graph of sources in tables of buckets below path, in which every row belongs to the file that gave it.

    A change of files replaces what they gave, and touches only the buckets that these files fall into. A node of many
    files, as a package, is a row for each, and one node in what graph returns.
    """

    spark: SparkSession
    path: str
    buckets: int = 256

    def __post_init__(self):
        self.nodes = Buckets(self.spark, f"{self.path}/nodes", NODES, ["owner", "id"], ["owner"], self.buckets)
        self.edges = Buckets(self.spark, f"{self.path}/edges", EDGES, ["owner", "src", "dst", "type"], ["owner"], self.buckets)
        self.state = Buckets(self.spark, f"{self.path}/state", STATE, ["repo_name"], buckets=1)

    def update(self, old: DataFrame | None, new: DataFrame, repo: str, sha: str, batch: int) -> list[int]:
        """Brings the tables up to the commit sha, whose files (repo, path, sha, content) are new; old are those of the
        commit that the state names, or None if they can't be told: then all of the repository is replaced. Returns the
        buckets of nodes that were rewritten. The state comes last, so that a crash repeats work instead of losing it.
        """
        todo = plan(last_sha(self.state.table(), repo), sha, old is not None)
        if todo == "none":
            return []
        if todo == "incremental":
            changes = dml.changed_files(old, new)
            owners = changes.select(paths.node_id(repo, F.col("path"), "file").alias("owner"))
            fresh = new.join(changes.where("change <> 'removed'").select("path"), "path", "left_semi")
        else:
            there = self.nodes.table().where(F.col("owner").startswith(f"{repo}:")).select("owner")
            owners, fresh = there.unionByName(new.select(paths.node_id(repo, F.col("path"), "file").alias("owner"))), new
        owners = stored(owners.distinct(), "owners")  # worked out before the tables change
        nodes, edges = self.parsed(fresh, repo)
        touched = self.nodes.replace(owners, nodes, batch)
        self.edges.replace(owners, edges, batch)
        self.state.upsert(self.spark.createDataFrame([(repo, sha)], "repo_name string, repo_sha string").withColumn("updated_at", F.current_timestamp()), batch)
        return touched

    def parsed(self, files: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of files with their owners; each file is parsed once."""
        found = stored(extract.symbols(files, owned=True), "symbols")
        own = extract.file_nodes(files).withColumn("owner", F.col("id"))
        nodes = found.where("kind = 'node'").select("owner", "id", "label", "name", "start_line", "end_line", "signature", "snippet", F.col("sort").alias("kind"))
        has = own.select("owner", F.lit(f"repo:{repo}").alias("src"), F.col("id").alias("dst"), F.lit("HAS_FILE").alias("type"))
        columns = [c.split()[0] for c in NODES.split(", ")]
        return nodes.unionByName(own, allowMissingColumns=True).select(*columns), found.where("kind = 'edge'").select("owner", "src", "dst", "type").unionByName(has)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """The nodes and edges there are, without owners."""
        return merged_rows(self.nodes.table().drop("owner")), dedupe_edges(self.edges.table().drop("owner"))


def full_ingest(files: DataFrame, commits: DataFrame, repo: str, url: str, settings: Settings = Settings(), dimension: int = 64) -> tuple[DataFrame, DataFrame]:
    """Nodes with embeddings, and edges, of a repository's sources and its newest commits."""
    newest = commits.orderBy(F.desc("committed_at"), "sha").limit(settings.commits_full)
    nodes, edges = merged([source_graph(files, repo, url), history_graph(newest, url, repo)])
    wanted = {c: "string" for c in ("path", "language", "type", "text", "package", "author", "content")}
    for c, kind in wanted.items():
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast(kind))
    nodes = embed.backfill(nodes.withColumn("embedding", F.lit(None).cast("array<float>")), dimension=dimension)
    return nodes, dml.link(edges.limit(0), edges, nodes)


def counts_by_label(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def last_commits(commits: DataFrame, repo: str) -> DataFrame:
    """TOUCHED edges from the newest commit of each file."""
    latest = history.latest_commit(history.touched(commits))
    return latest.select(paths.node_id(repo, "commit", F.col("sha")).alias("src"), paths.node_id(repo, F.col("path"), "file").alias("dst"), F.lit("TOUCHED").alias("type"))


def with_state(state: DataFrame, repo: str, sha: str) -> DataFrame:
    """The table (repo_name, repo_sha, updated_at) of what was ingested, after repo got to sha; written last of all, so
    that a crash repeats work instead of losing it."""
    new = state.sparkSession.createDataFrame([(repo, sha)], "repo_name string, repo_sha string").withColumn("updated_at", F.current_timestamp())
    return dml.upsert(state, new, ["repo_name"])


def last_sha(state: DataFrame, repo: str) -> str | None:
    row = state.where(F.col("repo_name") == repo).select("repo_sha").first()
    return row.repo_sha if row else None
