"""Paths, languages and the filters over files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by suffix, for retrieval (suffix lower-cased, else '') and for parsing (as it stands, else null).
RETRIEVAL_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".java": "java", ".go": "go", ".rs": "rust",
    ".rb": "ruby", ".php": "php", ".cs": "csharp", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".sh": "bash", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".md": "markdown", ".html": "html", ".css": "css", ".sql": "sql", ".r": "r", ".R": "r",
}
PARSER_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".svelte": "svelte", ".vue": "vue", ".html": "html",
    ".htm": "html", ".css": "css", ".scss": "css", ".sass": "css", ".sql": "sql", ".java": "java", ".kt": "kotlin", ".swift": "swift", ".erl": "erlang",
    ".hrl": "erlang", ".ex": "elixir", ".exs": "elixir", ".rs": "rust", ".sh": "shell", ".bash": "shell", ".zsh": "shell",
}
# What is not worth indexing.
BUNDLE_WORDS = ["bundle", "vendor", "chunk", "runtime"]
LOCK_FILES = ["package-lock.json", "yarn.lock", "Cargo.lock", "poetry.lock", "Pipfile.lock", "Gemfile.lock", "go.sum", "pnpm-lock.yaml"]
BUILD_DIRS = ["node_modules", "dist", "build", "__pycache__", ".next", "target", "vendor", ".venv", "venv", ".git", ".svn", "staticfiles", "static", "assets/vendor", "public/vendor"]
GENERATED_SUFFIXES = [".min.js", ".min.css", ".map", ".pb.go", ".g.dart"]
GENERATED_WORDS = ["generated", "codegen"]
DOC_SUFFIXES = [".md", ".rst", ".txt"]
SKIPPED_DOCS = ["changelog.md", "changelog.txt", "license.md", "license.txt", "license", "authors.md", "authors.txt", "contributors.md", "code_of_conduct.md", "security.md"]
SKIPPED_DOC_DIRS = ["/node_modules/", "/.git/", "/vendor/", "/.venv/", "/venv/", "/site-packages/", "/__pycache__/"]
MAX_FILE_BYTES, MAX_SCRIPT_BYTES, MAX_LINE = 500_000, 50_000, 500


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """Empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def suffix(path: Column) -> Column:
    """With its dot; a leading dot makes no suffix."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def ancestors(folder: Column) -> Column:
    """The folder and all above it, without the root."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(pairs, key)


def retrieval_language(path: Column) -> Column:
    return F.coalesce(_lookup(F.lower(suffix(path)), RETRIEVAL_LANGUAGES), F.lit(""))


def parser_language(path: Column) -> Column:
    return _lookup(suffix(path), PARSER_LANGUAGES)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def skipped(path: Column, size: Column, text: Column) -> Column:
    """Whether a source file is left out."""
    name = basename(path)
    low = F.lower(name)
    lines = F.slice(F.split(F.substring(text, 1, 10_000), "\n"), 1, 10)
    return (
        _any([name.endswith(s) for s in GENERATED_SUFFIXES])
        | _any([low.contains(w) for w in BUNDLE_WORDS + GENERATED_WORDS])
        | name.isin(LOCK_FILES)
        | _any([path.contains(f"/{d}/") | path.startswith(f"{d}/") for d in BUILD_DIRS])
        | (size > MAX_FILE_BYTES)
        | ((name.endswith(".js") | name.endswith(".css")) & (size > MAX_SCRIPT_BYTES) & F.exists(lines, lambda x: F.length(x) > MAX_LINE))
    )


def is_document(path: Column) -> Column:
    low = F.lower(path)
    return _any([path.endswith(s) for s in DOC_SUFFIXES]) & ~F.lower(basename(path)).isin(SKIPPED_DOCS) & ~_any([low.contains(d) for d in SKIPPED_DOC_DIRS])


def flattened(repo: Column) -> Column:
    return F.replace(repo, F.lit("/"), F.lit("_"))


def glob_pattern(glob: str) -> str:
    """A file-name glob as a regular expression."""
    import fnmatch

    return fnmatch.translate(glob)


def stays_inside(path: Column) -> Column:
    """Whether a relative path, resolved, never leaves its root."""
    steps = F.transform(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), lambda p: F.when(p == "..", -1).otherwise(1))
    low = F.aggregate(steps, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, x: F.struct((a.d + x).alias("d"), F.least(a.low, a.d + x).alias("low")), lambda a: a.low)
    return ~path.startswith("/") & (low >= 0)


def is_store_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_\-]*$")
