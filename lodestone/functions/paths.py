"""Functions of paths, identifiers, URLs and persons, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: languages by file ending, ignored folder names, signs of a test file
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".h": "c", ".c": "c", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin",
}
IGNORED = (".git", ".svn", ".hg", "node_modules", "vendor", "venv", ".venv", "env", ".env", "__pycache__", ".pytest_cache", "dist", "build", "target", "out", ".next", ".nuxt", ".vscode", ".idea", ".eclipse", ".DS_Store", "coverage", ".coverage")
TEST_SIGNS = ("test_", "_test.", "tests/", "/test/", "spec.", "_spec.", "__tests__/", ".test.", ".spec.", "test.py", "test.js", "test.ts")
# fixed values: labels by parts of an identifier, tried in this order
LABEL_PARTS = (
    ("class", "Class"), ("function", "Function"), ("method", "Function"), ("variable", "Variable"), ("doc", "Doc"), ("commit", "Commit"), ("module", "Module"), ("test", "Test"), ("issue", "Issue"), ("pr", "PullRequest"),
)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """Language of a file by its ending, null if unknown."""
    ending = F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))
    return F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[ending]


def is_code(path: Column) -> Column:
    return language(path).isNotNull()


def ignored(path: Column) -> Column:
    """Whether a part of a path inside its repository is an ignored name or starts with a dot."""
    return F.exists(F.split(path, "/"), lambda part: part.isin(*IGNORED) | (part.startswith(".") & (F.length(part) > 1)))


def is_test(path: Column) -> Column:
    lowered = F.lower(path)
    found = lowered.contains(TEST_SIGNS[0])
    for sign in TEST_SIGNS[1:]:
        found |= lowered.contains(sign)
    return found


def is_readme(path: Column) -> Column:
    return F.lower(basename(path)).startswith("readme")


def node_id(*parts: Column | str) -> Column:
    return F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def label_of_id(node: Column) -> Column:
    """The label that an identifier stands for; Node if none."""
    found = F.when(node.startswith("repo:"), "Repo").when(node.startswith("package:"), "Package").when(node.contains(":file:") | node.endswith(":file"), "File")
    for part, label in LABEL_PARTS:
        found = found.when(node.contains(f":{part}:"), label)
    return found.otherwise("Node")


def is_git_url(url: Column) -> Column:
    """A URL with a scheme, or the short form user@host:path."""
    return url.rlike(r"^(https?|ssh|git)://") | url.rlike(r"^[\w.-]+@[\w.-]+:")


def is_github_url(url: Column) -> Column:
    return url.rlike(r"^\w+://(www\.)?github\.com(/|$)") | url.startswith("git@github.com")


def https_url(url: Column) -> Column:
    """The https form of a GitHub URL without .git at the end; other URLs lose only that ending."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^git@github\.com:", "https://github.com/"), r"\.git$", "")
    return F.when(bare.startswith("github.com"), F.concat(F.lit("https://"), bare)).otherwise(bare)


def repo_info(url: Column) -> Column:
    """struct<owner, name, url, full_name>: first two parts of the URL's path, or unknown and the last part."""
    plain = https_url(url)
    path = F.regexp_replace(plain, r"^\w+://[^/]*", "")
    parts = F.filter(F.split(F.regexp_replace(path, "[?#].*$", ""), "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.struct(parts[0].alias("owner"), parts[1].alias("name"), plain.alias("url"), F.concat_ws("/", parts[0], parts[1]).alias("full_name"))).otherwise(
        F.struct(F.lit("unknown").alias("owner"), basename(F.regexp_replace(url, "/+$", "")).alias("name"), url.alias("url"), F.lit("unknown").alias("full_name"))
    )


def branch_of_ref(ref: Column) -> Column:
    return F.replace(ref, F.lit("refs/heads/"), F.lit(""))


def python_package(module: Column) -> Column:
    return F.split(module, r"\.")[0]


def js_package(module: Column) -> Column:
    """The package of an import; null for relative ones."""
    parts = F.split(module, "/")
    return F.when(module.startswith("."), F.lit(None)).when(module.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])


def person(name: Column, email: Column) -> Column:
    """struct<id, name, email>, by email if there is one, else by name."""
    mail, called = F.lower(F.trim(F.coalesce(email, F.lit("")))), F.trim(F.coalesce(name, F.lit("")))
    own = F.when(mail != "", mail).otherwise(F.replace(F.lower(called), F.lit(" "), F.lit("_")))
    return F.struct(F.concat(F.lit("person:"), own).alias("id"), called.alias("name"), mail.alias("email"))
