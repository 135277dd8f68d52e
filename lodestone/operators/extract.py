"""Symbols of source files: nodes and edges from (repo, path, content).

Files are read row by row from small Arrow batches, and their symbols go on in small ones, so that a repository of any
size is one map whose memory is that of its largest file. Python is
read with the parser of the standard library, JavaScript and TypeScript with a small token reader; a file that can't be
parsed still gives its File node.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths, texts
from lodestone.session import small_batches

SCHEMA = "kind string, label string, id string, name string, src string, dst string, type string, start_line int, end_line int, signature string, snippet string, sort string"
SNIPPET = 5
#: Rows and characters that are gathered before they are passed on, and files of an Arrow batch at most.
ROWS, CHARACTERS, FILES = 2000, 1 << 20, 200


def symbols(files: DataFrame, owned: bool = False) -> DataFrame:
    """Rows of kind node or edge for the symbols in files (repo, path, content); null contents give none. owned adds the
    column owner, the file's node."""
    schema = SCHEMA + (", owner string" if owned else "")
    fields = [c.split() for c in schema.split(", ")]
    kind = pa.schema([(name, pa.int32() if type_ == "int" else pa.string()) for name, type_ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                repo, path, language, content = (c[i].as_py() for c in batch.columns)
                if content is None:
                    continue
                for r in _file_symbols(repo, path, language, content):
                    rows.append(r | {"owner": f"{repo}:{path}:file"})
                    size += len(r.get("snippet") or "")
                    if len(rows) >= ROWS or size >= CHARACTERS:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)

    some = files.withColumn("language", paths.language(F.col("path"))).where(F.col("language").isin("python", "javascript", "typescript"))
    small_batches(files.sparkSession, FILES)
    return some.select("repo", "path", "language", "content").mapInArrow(run, schema)


def file_nodes(files: DataFrame) -> DataFrame:
    """File nodes of the code files in files."""
    some = files.withColumn("language", paths.language(F.col("path"))).where("language is not null")
    return some.select(paths.node_id(F.col("repo"), F.col("path"), "file").alias("id"), F.lit("File").alias("label"), paths.basename(F.col("path")).alias("name"), "path", "language", texts.content_hash(F.col("content")).alias("sha"), texts.line_count(F.col("content")).alias("lines"))


def _file_symbols(repo: str, path: str, language: str, content: str) -> list[dict]:
    out: list[dict] = []
    lines = content.split("\n")
    file = f"{repo}:{path}:file"

    def node(label: str, tail: str, name: str, start: int, end: int, **more) -> str:
        own = tail if label == "Package" else f"{repo}:{path}:{tail}"
        out.append({"kind": "node", "label": label, "id": own, "name": name, "start_line": start, "end_line": end, "snippet": None if label == "Package" else "\n".join(lines[start - 1 : min(end, start - 1 + SNIPPET)]), **more})
        return own

    def edge(src: str, dst: str, type_: str) -> None:
        out.append({"kind": "edge", "src": src, "dst": dst, "type": type_})

    def function(name: str, start: int, end: int, signature: str, of: tuple[str, str] | None = None) -> None:
        own = node("Function", f"method:{of[0]}:{name}" if of else f"function:{name}", name, start, end, signature=signature, sort="method" if of else "function")
        edge(of[1] if of else file, own, "HAS_METHOD" if of else "CONTAINS_FUNCTION")
        edge(own, file, "DEFINED_IN")

    def class_(name: str, start: int, end: int) -> str:
        own = node("Class", f"class:{name}", name, start, end)
        edge(file, own, "CONTAINS_CLASS")
        return own

    packages: set[str] = set()

    def package(name: str, line: int) -> None:
        if name not in packages:
            packages.add(name)
            node("Package", f"package:{name}", name, line, line)
        edge(file, f"package:{name}", "IMPORTS")

    if language == "python":
        _python(content, path, file, node, edge, function, class_, package)
    else:
        _script(content, language, node, function, class_, package)
    seen, unique = set(), []
    for r in out:
        key = (r["kind"], r.get("id"), r.get("src"), r.get("dst"), r.get("type"))
        if key not in seen:
            seen.add(key)
            unique.append(r)
    return unique


def _python(content, path, file, node, edge, function, class_, package) -> None:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return
    plain = (ast.FunctionDef, ast.AsyncFunctionDef)

    def signature(f) -> str:
        return f"{f.name}({ast.unparse(f.args)})"

    test_file = any(s in path.lower() for s in paths.TEST_SIGNS)
    for c in ast.walk(tree):
        if isinstance(c, ast.ClassDef):
            own = class_(c.name, c.lineno, c.end_lineno)
            # all functions below a class are its methods, also those within methods
            for f in ast.walk(c):
                if isinstance(f, plain):
                    function(f.name, f.lineno, f.end_lineno, signature(f), (c.name, own))
            if test_file and c.name.startswith("Test"):
                edge(file, node("Test", f"test:{c.name}", c.name, c.lineno, c.end_lineno, sort="class"), "HAS_TEST")
        elif isinstance(c, ast.Import):
            for a in c.names:
                if not a.asname:
                    package(a.name.split(".")[0], c.lineno)
        elif isinstance(c, ast.ImportFrom) and not c.level and c.module:
            package(c.module.split(".")[0], c.lineno)
        elif isinstance(c, ast.Expr) and isinstance(c.value, ast.Constant) and isinstance(c.value.value, str):
            edge(file, node("Doc", f"doc:{c.lineno}", "", c.lineno, c.end_lineno, sort="docstring"), "HAS_DOC")
        if isinstance(c, plain) and test_file and c.name.startswith("test_"):
            edge(file, node("Test", f"test:{c.name}", c.name, c.lineno, c.end_lineno, sort="unit"), "HAS_TEST")
    for s in tree.body:
        # a decorated function is no plain definition of the module
        if isinstance(s, plain) and not s.decorator_list:
            function(s.name, s.lineno, s.end_lineno, signature(s))
        elif isinstance(s, ast.Assign):
            for t in s.targets:
                if isinstance(t, ast.Name):
                    node("Variable", f"variable:{t.id}:{s.lineno}", t.id, s.lineno, s.end_lineno, sort="global")
    try:
        for t in tokenize.generate_tokens(io.StringIO(content).readline):
            if t.type == tokenize.COMMENT:
                edge(file, node("Doc", f"doc:{t.start[0]}", "", t.start[0], t.start[0], sort="comment"), "HAS_DOC")
    except (tokenize.TokenError, IndentationError):
        pass


_TOKEN = re.compile(r"""(?P<skip>//[^\n]*|/\*.*?(?:\*/|$)|\s+)|(?P<text>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<sign>.)""", re.S)


def _script(content, language, node, function, class_, package) -> None:
    tokens = [(m.lastgroup, m.group(), m.start()) for m in _TOKEN.finditer(content) if m.lastgroup != "skip"]
    starts = [0] + [m.end() for m in re.finditer("\n", content)]

    def line(at: int) -> int:
        import bisect

        return bisect.bisect_right(starts, at)

    def closing(i: int, opens: str, closes: str) -> int:
        depth = 0
        for j in range(i, len(tokens)):
            if tokens[j][0] == "sign":
                depth += (tokens[j][1] == opens) - (tokens[j][1] == closes)
                if not depth:
                    return j
        return len(tokens) - 1

    def at(i: int) -> str:
        return tokens[i][1] if 0 <= i < len(tokens) else ""

    def module(text: str) -> None:
        parts = text[1:-1].split("/")
        if text[1:2] not in (".", "") and text[0] != "`":
            package("/".join(parts[:2]) if text[1] == "@" else parts[0], line(tokens[i][2]))

    def callable_(i: int) -> tuple[int, int, str] | None:
        """(end of parameters, end of body, parameters) of a definition whose ( is at i."""
        if at(i) != "(":
            return None
        stop = closing(i, "(", ")")
        j = stop + 1
        while j < len(tokens) and at(j) not in ("{", ";", "}"):
            j += 1
        if at(j) != "{":
            return None
        return stop, closing(j, "{", "}"), content[tokens[i][2] : tokens[stop][2] + 1]

    names: set[str] = set()
    for i, (kind, text, where) in enumerate(tokens):
        if kind != "name" or at(i - 1) == ".":
            continue
        if text == "class" and i + 1 < len(tokens) and tokens[i + 1][0] == "name":
            j = i + 1
            while j < len(tokens) and at(j) != "{":
                j += 1
            if at(j) != "{":
                continue
            end = closing(j, "{", "}")
            own = class_(at(i + 1), line(where), line(tokens[end][2]))
            k = j + 1
            while k < end:
                found = callable_(k + 1) if tokens[k][0] == "name" else None
                if found:
                    function(at(k), line(tokens[k][2]), line(tokens[found[1]][2]), at(k) + found[2], (at(i + 1), own))
                    k = found[1]
                elif at(k) == "{":
                    k = closing(k, "{", "}")
                k += 1
        elif text == "function":
            k = i + 1 + (at(i + 1) == "*")
            found = callable_(k + 1) if k < len(tokens) and tokens[k][0] == "name" else None
            # the first of a name; an expression is no declaration
            if found and at(k) not in names and at(i - 1) not in ("=", "(", ",", ":", "return", "?", "["):
                names.add(at(k))
                function(at(k), line(where), line(tokens[found[1]][2]), at(k) + found[2])
        elif text == "import":
            j = i + 1
            while j < len(tokens) and tokens[j][0] != "text" and at(j) not in (";", "("):
                j += 1
            if j < len(tokens) and tokens[j][0] == "text":
                module(at(j))
        elif text == "var":
            j, depth, wanted = i + 1, 0, True
            while j < len(tokens) and at(j) != ";" and line(tokens[j][2]) == line(where):
                depth += (at(j) in ("(", "[", "{")) - (at(j) in (")", "]", "}"))
                if wanted and tokens[j][0] == "name":
                    node("Variable", f"variable:{at(j)}:{line(tokens[j][2])}", at(j), line(tokens[j][2]), line(tokens[j][2]), sort="global")
                wanted = at(j) == "," and not depth
                j += 1
        elif language == "javascript" and at(i + 1) == "(" and i + 2 < len(tokens) and tokens[i + 2][0] == "text" and at(i + 3) == ")":
            # any call of a name with one literal counts as require
            module(at(i + 2))
