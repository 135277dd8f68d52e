"""python -m lodestone.cli analyze FOLDER [--out GRAPH] | stats GRAPH | validate GRAPH | clear GRAPH ID --out GRAPH | languages | settings | flags

A GRAPH is a folder with the tables nodes and edges.
"""

from __future__ import annotations

import argparse
import os

from lodestone.config import Flags, Settings
from lodestone.functions.paths import LANGUAGES


def _tables(folder: str):
    from lodestone.session import session

    spark = session()
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def _write(nodes, edges, folder: str) -> None:
    nodes.write.parquet(f"{folder}/nodes")
    edges.write.parquet(f"{folder}/edges")


def _counts(nodes) -> None:
    from lodestone.operators import ingest

    for row in ingest.counts_by_label(nodes).orderBy("label").collect():
        print(row.label, row.n)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze", help="count the nodes of a folder's sources by label, and keep the graph")
    analyze.add_argument("folder")
    analyze.add_argument("--name", default="repo")
    analyze.add_argument("--out")
    for name, about in (("stats", "nodes by label, and files parsed and skipped"), ("validate", "repeated identifiers and edges without ends")):
        commands.add_parser(name, help=about).add_argument("graph")
    clear = commands.add_parser("clear", help="the graph without a repository")
    clear.add_argument("graph")
    clear.add_argument("id")
    clear.add_argument("--out", required=True)
    commands.add_parser("languages", help="file endings by language")
    commands.add_parser("settings", help="settings in force, without secrets")
    commands.add_parser("flags", help="features that are on and off")
    given = parser.parse_args(args)
    if given.command == "languages":
        for language in sorted(set(LANGUAGES.values())):
            print(language, *(e for e, v in LANGUAGES.items() if v == language))
    elif given.command == "settings":
        print(Settings.from_env(os.environ).export())
    elif given.command == "flags":
        flags = Flags(Settings.from_env(os.environ).environment)
        for name in flags.flags:
            print(name, "on" if flags.on(name) else "off")
        print(flags.totals())
    elif given.command == "analyze":
        from lodestone.operators import ingest
        from lodestone.session import session
        from lodestone.sources import files

        spark = session()
        nodes, edges = ingest.source_graph(files.scan(spark, given.folder, given.name), given.name)
        if given.out:
            _write(nodes, edges, given.out)
            nodes = spark.read.parquet(f"{given.out}/nodes")
        _counts(nodes)
        print(files.totals(files.all_files(spark, given.folder, given.name)).first().asDict())
    elif given.command == "stats":
        _counts(_tables(given.graph)[0])
    elif given.command == "validate":
        from lodestone.operators import dml, graph

        nodes, edges = _tables(given.graph)
        repeated, whole = dml.duplicate_keys(nodes).count(), graph.with_endpoints(edges, nodes).count()
        print(f"repeated identifiers: {repeated}, edges without ends: {edges.count() - whole}")
    else:
        from lodestone.operators import dml

        nodes, edges = dml.clear_repository(*_tables(given.graph), given.id)
        _write(nodes, edges, given.out)


if __name__ == "__main__":
    main()
