"""Source files and READMEs of repositories as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths, texts

# fixed values: README names, the first that exists counts
READMES = ("README.md", "README.rst", "README.txt", "README", "readme.md")


def scan(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, path, content) of the code files below root, in any store that Spark reads; ignored folders are left out.

    Names are listed first; only files that are code outside ignored folders are opened, in tasks of about as many bytes.
    """
    wanted = code_files(named(spark, root, repo)).select("url").collect()  # names, which a listing keeps on the driver anyway
    if not wanted:
        return spark.createDataFrame([], "repo string, path string, content string")
    return _read(spark, [r.url for r in wanted], root, repo).withColumn("content", F.decode("bytes", "UTF-8")).drop("bytes")


def named(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, path, url, size) of all files below root, without opening any."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_escaped(root))
    return found.select(F.lit(repo).alias("repo"), _inside(root).alias("path"), F.col("path").alias("url"), F.col("length").alias("size"))


def _escaped(path: str) -> str:
    """A path that Spark takes literally."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _inside(root: str):
    """The column path without root: both may have a scheme or none."""
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    bare = "/" + root.split("://")[-1].strip("/").split(":")[-1].strip("/") + "/"
    return F.substring_index(plain, bare, -1)


def _read(spark: SparkSession, urls: list[str], root: str, repo: str) -> DataFrame:
    found = spark.read.format("binaryFile").load([_escaped(u) for u in urls])
    return found.select(F.lit(repo).alias("repo"), _inside(root).alias("path"), F.col("content").alias("bytes"))


def code_files(files: DataFrame) -> DataFrame:
    """The rows of files (path, ...) that are code outside ignored folders."""
    return files.where(paths.is_code(F.col("path")) & ~paths.ignored(F.col("path")))


def totals(files: DataFrame) -> DataFrame:
    """One row: files, parsed, skipped, and of those ignored (code in ignored folders) and other (no code)."""
    code, away = paths.is_code(F.col("path")), paths.ignored(F.col("path"))
    return files.agg(F.count("*").alias("files"), F.count_if(code & ~away).alias("parsed"), F.count_if(~(code & ~away)).alias("skipped"), F.count_if(code & away).alias("ignored"), F.count_if(~code).alias("other"))


def all_files(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """(repo, path, bytes) of all files below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_escaped(root))
    return found.select(F.lit(repo).alias("repo"), _inside(root).alias("path"), F.col("content").alias("bytes"))


def listed(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Code files named in wanted (path); missing and other files are skipped, ignored folders are not."""
    return files.where(paths.is_code(F.col("path"))).join(wanted.select("path").distinct(), "path", "left_semi")


def readme(files: DataFrame, limit: int = 50_000) -> DataFrame:
    """One Doc row (repo, id, label, text) for each repository with a README at its top."""
    order = F.array_position(F.array(*map(F.lit, READMES)), F.col("path"))
    best = files.where(order > 0).groupBy("repo").agg(F.min_by("content", F.struct(order, "content")).alias("content"))
    return best.select("repo", paths.node_id(F.col("repo"), "doc", "README").alias("id"), F.lit("Doc").alias("label"), F.lit("README").alias("type"), texts.truncated(F.col("content"), limit, "\n\n... (truncated)").alias("text"))
