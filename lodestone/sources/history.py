"""Commit history and line origins."""

from __future__ import annotations

import bisect
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.operators.graph import stored

COMMIT = "sha string, author_name string, author_email string, committed_at string, message string, insertions int, deletions int, files_changed array<string>"
#: What a log gives: old_paths has the path before the commit for each of files_changed that was renamed, else null.
LOGGED = COMMIT + ", old_paths array<string>"


class GitLog(DataSource):
    """spark.read.format("gitlog").option("repo", folder).load(): commits, newest first; option max bounds their number.

    The folder has to be in reach of the executors, as a local clone is in local mode.
    """

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return LOGGED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["repo"], self.options.get("branch", "HEAD"), int(self.options.get("max", "0")))


class _Reader(DataSourceReader):
    def __init__(self, repo: str, branch: str, most: int):
        self.repo, self.branch, self.most = repo, branch, most

    def partitions(self) -> list[InputPartition]:
        """Runs of commits of about the same number, so that a long history is read by many tasks. Each names its commits,
        so that none is walked twice, and commits that arrive meanwhile shift nothing."""
        command = ["git", "-C", self.repo, "rev-list", *([f"--max-count={self.most}"] if self.most else []), self.branch]
        shas = subprocess.run(command, capture_output=True, check=True, encoding="ascii").stdout.split()
        return [_Run(i, shas[i : i + COMMITS]) for i in range(0, len(shas), COMMITS)] or [_Run(0, [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.shas:
            return
        command = ["git", "-C", self.repo, "log", "--no-walk=unsorted", "--stdin", "--numstat", "--find-renames", "--format=%x1e%H%x1f%an%x1f%ae%x1f%cI%x1f%B%x1f"]
        with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, encoding="utf-8", errors="replace") as log:
            log.stdin.write("\n".join(partition.shas) + "\n")  # git reads all names before it answers
            log.stdin.close()
            held = ""
            for line in log.stdout:
                # a record ends where the next one begins
                if line.startswith("\x1e") and held:
                    yield commit_of(held)
                    held = ""
                held += line.lstrip("\x1e")
            if held:
                yield commit_of(held)
        if log.returncode:
            raise RuntimeError(f"git log failed with code {log.returncode}")


#: Commits read by one task.
COMMITS = 5_000


class _Run(InputPartition):
    def __init__(self, first: int, shas: list[str]):
        super().__init__(first)
        self.shas = shas


_RENAMED = re.compile(r"\{([^{}]*) => ([^{}]*)\}")


def path_now(path: str) -> str:
    """The new path of a file that was renamed: a/{b => c}/d or a => d."""
    if " => " not in path:
        return path
    return _RENAMED.sub(r"\2", path).replace("//", "/") if "{" in path else path.split(" => ")[1]


def path_before(path: str) -> str | None:
    """The old path of a file that was renamed, else None."""
    if " => " not in path:
        return None
    return _RENAMED.sub(r"\1", path).replace("//", "/") if "{" in path else path.split(" => ")[0]


def commit_of(record: str) -> tuple:
    """A row of LOGGED from a record: fields with the unit separator between them, the last one being the file counts."""
    sha, name, email, date, message, stats = record.split("\x1f")
    rows = [r.split("\t") for r in stats.strip().split("\n") if r.count("\t") == 2]
    added, gone = (sum(int(r[i]) for r in rows if r[i].isdigit()) for i in (0, 1))
    return sha, name, email, date, message.strip(), added, gone, [path_now(r[2]) for r in rows], [path_before(r[2]) for r in rows]


def commits_of(records: DataFrame) -> DataFrame:
    """Commits (the columns of gitlog) from the column record; null records give none."""

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in LOGGED.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([commit_of(r) for r in pdf["record"] if r is not None], columns=names)

    return records.select("record").mapInPandas(run, LOGGED)


def git_log(spark: SparkSession, repo: str, most: int = 0, branch: str = "HEAD") -> DataFrame:
    spark.dataSource.register(GitLog)
    return spark.read.format("gitlog").option("repo", repo).option("branch", branch).option("max", str(most)).load()


def touched(commits: DataFrame) -> DataFrame:
    """(sha, path, committed_at) for each file of each commit."""
    return commits.select("sha", "committed_at", F.explode("files_changed").alias("path"))


def moved(commits: DataFrame) -> DataFrame:
    """(sha, committed_at, path, old_path) for each file of each commit; old_path is null unless it was renamed."""
    pairs = F.explode(F.arrays_zip(F.col("files_changed").alias("path"), F.col("old_paths").alias("old_path")))
    return commits.select("sha", "committed_at", pairs.alias("x")).select("sha", "committed_at", "x.path", "x.old_path")


def _lives(touches: DataFrame) -> DataFrame:
    """(path, life, since, until): the stretches in which a path that renames touch is one file. since is the commit that
    begins one (null for the first), until that of the next one."""
    renames = touches.where("old_path is not null")
    cuts = renames.select("path", "at").unionByName(renames.select(F.col("old_path").alias("path"), "at")).distinct()
    first = cuts.select("path").distinct().withColumn("at", F.lit(None).cast(cuts.schema["at"].dataType))
    order = Window.partitionBy("path").orderBy(F.col("at").asc_nulls_first())
    return cuts.unionByName(first).select("path", (F.row_number().over(order) - 1).alias("life"), F.col("at").alias("since"), F.lead("at").over(order).alias("until"))


def followed(touches: DataFrame, limit: int = 10, tie: str = "sha") -> DataFrame:
    """(path, sha, committed_at, touched_path, rank): the newest touches of each present file, under all its names.

    touches has path, old_path (null unless the commit renames it to path), committed_at and the unique column tie.
    A path is another file from the commit on that renames something to it, or it to something else. Each such life has
    at most one life that it comes from, so lives are a forest; lists of newest touches are joined along it, each round
    twice as far, until they have limit entries or the line ends. So a chain of any length takes a number of rounds that
    grows with its logarithm, and no list is longer than limit. A copy has the history of what it was copied from.
    """
    own = stored(touches.select("path", "old_path", F.struct(F.col("committed_at"), F.col(tie).alias("tie")).alias("at")), "touches")
    lives = stored(_lives(own), "lives")
    spans = lives.withColumnRenamed("path", "of")
    inside = (F.col("of") == F.col("path")) & (F.col("since").isNull() | (F.col("at") >= F.col("since"))) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    placed = own.join(spans, inside, "left").select("path", F.coalesce("life", F.lit(0)).alias("life"), "at", F.col("until").isNull().alias("present"))
    newest = F.row_number().over(Window.partitionBy("path", "life").orderBy(F.desc("at")))
    entry = F.struct("at", F.col("path").alias("touched"))
    lists = placed.withColumn("rank", newest).where(F.col("rank") <= limit).groupBy("path", "life").agg(F.sort_array(F.collect_list(entry), False).alias("list"), F.max("present").alias("present"))
    lists = stored(lists, "lists")
    renames = own.where("old_path is not null")
    child = lives.select("path", F.col("since").alias("at"), "life")
    parent = lives.select(F.col("path").alias("old_path"), F.col("until").alias("at"), F.col("life").alias("from_life"))
    links = renames.join(child, ["path", "at"]).join(parent, ["old_path", "at"]).select("path", "life", F.struct(F.col("old_path").alias("path"), F.col("from_life").alias("life")).alias("from"))
    links = stored(links, "links")
    # only lives that renames join go through the rounds; one without touches of its own may still lead to others
    ends = links.select("path", "life").unionByName(links.select("from.*")).distinct()
    empty = F.array().cast(lists.schema["list"].dataType)
    state = ends.join(links, ["path", "life"], "left").join(lists.drop("present"), ["path", "life"], "left").withColumn("list", F.coalesce("list", empty))
    state = stored(state, "followed")
    while state.where("`from` is not null").limit(1).count():
        far = state.select(F.struct("path", "life").alias("from"), F.col("from").alias("next"), F.col("list").alias("older"))
        step = state.join(far, "from", "left")
        both = F.slice(F.concat("list", F.coalesce("older", empty)), 1, limit)
        state = stored(step.select("path", "life", F.when(F.size(both) < limit, F.col("next")).alias("from"), both.alias("list")), "followed")
    through = state.select("path", "life", F.col("list").alias("all"))
    full = lists.where("present").join(through, ["path", "life"], "left").select("path", F.posexplode(F.coalesce("all", "list")).alias("i", "x"))
    return full.select("path", F.col("x.at.tie").alias(tie), F.col("x.at.committed_at").alias("committed_at"), F.col("x.touched").alias("touched_path"), (F.col("i") + 1).alias("rank"))


def file_history(touches: DataFrame, limit: int = 10, order: str = "committed_at", path: str = "path", tie: str = "sha") -> DataFrame:
    """The newest touches of each file, with rank."""
    rank = F.row_number().over(Window.partitionBy(path).orderBy(F.desc(order), F.desc(tie)))
    return touches.withColumn("rank", rank).where(F.col("rank") <= limit)


def latest_commit(touches: DataFrame, order: str = "committed_at", path: str = "path", tie: str = "sha") -> DataFrame:
    """The newest touch of each file, by a combining aggregate."""
    return touches.groupBy(path).agg(F.max_by(tie, F.struct(order, tie)).alias(tie), F.max(order).alias(order))


def change_counts(touches: DataFrame, path: str = "path", most: int = 1000) -> DataFrame:
    return touches.groupBy(path).agg(F.least(F.count("*"), F.lit(most)).alias("changes"))


def kept_lines(old: list, new: list) -> list[int]:
    """For each line of new the line of old that it is by a longest common subsequence, or -1.

    Equal beginnings and ends go first. Of the rest, places of equal lines are taken in the order of new, from the last
    of old to the first, and a longest increasing sequence of them is found by bisection. Among such sequences the one
    whose last place in old comes first is taken, and so on to the front.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    out = [*range(head), *[-1] * (len(new) - head - tail), *range(len(old) - tail, len(old))]
    places: dict = {}
    for i in range(len(old) - tail - 1, head - 1, -1):
        places.setdefault(old[i], []).append(i)
    ends: list[int] = []
    links: list[tuple] = []
    for j in range(head, len(new) - tail):
        for i in places.get(new[j], ()):
            k = bisect.bisect_left(ends, i)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(i)
                links.append(link)
            else:
                ends[k], links[k] = i, link
    link = links[-1] if links else None
    while link:
        out[link[1]], link = link[0], link[2]
    return out


def line_origins(versions: DataFrame, key: str = "path", number: str = "number", text: str = "content") -> DataFrame:
    """(key, number, line, origin): for each line of the last version of a file the version that its text came with.

    versions has one row for each version of a file, numbered 0, 1, 2... without gaps. Lines are compared with those of
    the version before, a pair of versions a row, by longest common subsequences of line hashes; what a line of version n
    is in n - 1, n - 2, n - 4... is then found by joining versions twice as far apart each round, so that many versions
    take few rounds. A null text has no lines; lines end at line feeds.
    """
    hashes = F.when(F.col(text).isNull() | (F.col(text) == ""), F.array().cast("array<long>")).otherwise(F.transform(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"), lambda x: F.xxhash64(x)))
    lines = stored(versions.select(F.col(key).alias("key"), F.col(number).cast("int").alias("number"), hashes.alias("lines")), "lines")
    before = lines.select("key", (F.col("number") + 1).alias("number"), F.col("lines").alias("old"))
    pairs = lines.join(before, ["key", "number"], "left").select("key", "number", "old", "lines")
    kind = lines.schema["key"].dataType.simpleString()

    def compare(batches):
        import pandas as pd

        for pdf in batches:
            pdf["back"] = [kept_lines([] if o is None else o.tolist(), n.tolist()) for o, n in zip(pdf["old"], pdf["lines"], strict=True)]
            yield pd.DataFrame(pdf[["key", "number", "back"]])

    back = pairs.mapInPandas(compare, f"key {kind}, number int, back array<int>")
    # a line is settled (line -1) with the version that it came with, or is a line of the version as far back as the round
    settled = F.transform("back", lambda x: F.struct(F.when(x < 0, F.col("number")).alias("origin"), x.alias("line")))
    state, step = stored(back.select("key", "number", settled.alias("at")), "origins"), 1
    while state.where(F.exists("at", lambda x: x.line >= 0)).limit(1).count():
        far = state.select("key", (F.col("number") + step).alias("number"), F.col("at").alias("far"))
        moved_ = F.transform("at", lambda x: F.when(x.line < 0, x).otherwise(F.get("far", x.line)))
        state, step = stored(state.join(far, ["key", "number"], "left").select("key", "number", moved_.alias("at")), "origins"), step * 2
    last = state.groupBy("key").agg(F.max("number").alias("number"))
    ended = state.join(last, ["key", "number"], "left_semi").select("key", "number", F.posexplode("at").alias("i", "x"))
    return ended.select(F.col("key").alias(key), F.col("number").alias(number), (F.col("i") + 1).alias("line"), F.col("x.origin").alias("origin"))


def blamed(versions: DataFrame) -> DataFrame:
    """(path, line, sha, author) of the last version of each file, from versions (path, number, sha, author, content)."""
    named = versions.select("path", F.col("number").alias("origin"), "sha", "author")
    return line_origins(versions).join(named, ["path", "origin"]).select("path", "line", "sha", "author")


_HEAD = re.compile(r"^([0-9a-f]{7,64}) \d+ (\d+)")


def blame(reports: DataFrame) -> DataFrame:
    """(path, line, sha, author) from (path, report), report being the porcelain output of a blame."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, report in zip(pdf["path"], pdf["report"], strict=True):
                authors: dict[str, str] = {}
                sha, line = "", 0
                for text in (report or "").split("\n"):
                    if text.startswith("\t"):
                        rows.append((path, line, sha, authors.get(sha)))
                    elif found := _HEAD.match(text):
                        sha, line = found[1], int(found[2])
                    elif text.startswith("author "):
                        authors[sha] = text[7:]
            yield pd.DataFrame(rows, columns=["path", "line", "sha", "author"])

    return reports.select("path", "report").mapInPandas(run, "path string, line int, sha string, author string")
