"""Texts of nodes: lines, snippets, templates and truncations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def snippet(text: Column, start: Column, end: Column, lines: int = 5) -> Column:
    """The first lines of the range from start to end, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), start, F.least(F.lit(lines), end - start + 1)), "\n")


def truncated(text: Column, limit: int, mark: str = "") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r")) == ""


def _or(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


# fixed values: the templates below are formats of stored texts
def commit_document(repo_url: Column, sha: Column, name: Column, email: Column, date: Column, message: Column, insertions: Column, deletions: Column, files: Column) -> Column:
    """The text kept for a commit: who, when, why and the first fifty files."""
    listed = F.array_join(F.transform(F.slice(files, 1, 50), lambda f: F.concat(F.lit("  - "), f)), "\n")
    return F.concat(
        F.lit("Commit: "), sha, F.lit("\nAuthor: "), name, F.lit(" <"), email, F.lit(">\nDate:   "), date, F.lit("\nRepo:   "), repo_url, F.lit("\n\nMessage:\n"), message,
        F.lit("\n\nScope:\n  Files changed: "), F.size(files).cast("string"), F.lit("\n  Insertions:    "), insertions.cast("string"), F.lit("\n  Deletions:     "), deletions.cast("string"),
        F.lit("\n\nFiles:\n"), F.when(F.size(files) > 0, listed).otherwise("  (no file stats available)"), F.lit("\n"),
    )


def pull_request_document(number: Column, title: Column, body: Column, author: Column, state: Column, merged: Column, base: Column, head: Column) -> Column:
    indent = "\n\n      "
    said = F.when(merged, "True").otherwise("False")
    return F.concat(
        F.lit("Pull Request #"), number.cast("string"), F.lit(": "), _or(title), F.lit(indent), _or(body), F.lit(indent + "Author: "), _or(author), F.lit("\n      State: "), _or(state),
        F.lit("\n      Merged: "), said, F.lit("\n      Base Branch: "), F.coalesce(base, F.lit("None")), F.lit("\n      Head Branch: "), F.coalesce(head, F.lit("None")), F.lit("\n      "),
    )


def embedding_text(label: Column) -> Column:
    """The text to embed for a node, by its label and columns; both shapes of a commit and pull requests by content."""
    c = _or
    return (
        F.when(label == "Function", F.concat(F.lit("Function: "), c("name"), F.lit("\nSignature: "), c("signature"), F.lit("\nCode:\n"), c("snippet")))
        .when(label == "Class", F.concat(F.lit("Class: "), c("name"), F.lit("\nCode:\n"), c("snippet")))
        .when(label == "File", F.concat(F.lit("File: "), c("path"), F.lit("\nLanguage: "), c("language")))
        .when(label == "Doc", F.concat(F.lit("Documentation ("), c("type"), F.lit("):\n"), c("text")))
        .when(label == "Module", F.concat(F.lit("Module: "), c("name"), F.lit("\nPackage: "), c("package")))
        .when(label == "Commit", F.concat(F.lit("Commit by "), _or(F.coalesce("author", "author_name")), F.lit(":\n"), _or(F.coalesce("message", "content"))))
        .when((label == "PullRequest") & F.col("content").isNotNull(), F.col("content"))
        .otherwise(F.coalesce(F.nullif("name", F.lit("")), F.col("id").cast("string")))
    )


def server_event(payload: Column) -> Column:
    """A line of a server-sent event stream."""
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


def iso_time(text: Column) -> Column:
    """Timestamp of an ISO 8601 text, Z included; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
