"""Extraction: symbols, imports, statements, sections, specs and commits from text.

What needs a parser or a fold over lines runs file by file in Arrow batches
(``extract``); what a regular expression says is a Column.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

SYMBOL = "name string, kind string, start_line int, end_line int, docstring string"
Symbol = tuple[str, str, int, int, str | None]
#: Files whose findings are handed on together.
FILES = 200


def extract(files: DataFrame, find: Callable[[str, str], list[tuple]], schema: str, keys: tuple[str, ...] = ("repo_id", "file_path"), content: str = "content") -> DataFrame:
    """(keys..., found columns...): ``find(path, text)`` over every file; the last key is the path."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), FILES):  # what is found in a whole batch of long files is never held at once
                rows = [(*[getattr(r, k) for k in keys], *found) for r in b.iloc[i : i + FILES].itertuples(index=False) for found in find(getattr(r, keys[-1]), getattr(r, content) or "")]
                yield pd.DataFrame(rows, columns=[*keys, *names])

    typed = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.select(*keys, content).mapInPandas(run, f"{typed}, {schema}")


def python_symbols(path: str, source: str) -> list[Symbol]:
    """Undecorated top-level functions and classes, and the methods of classes; by pattern where the file doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return python_symbols_by_pattern(path, source)
    out: list[Symbol] = []
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        if not isinstance(node, (*functions, ast.ClassDef)) or node.decorator_list:
            continue
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        out.append((node.name, kind, node.lineno, node.end_lineno, ast.get_docstring(node)))
        if kind == "class":
            out += [(f"{node.name}.{m.name}", "method", m.lineno, m.end_lineno, ast.get_docstring(m)) for m in node.body if isinstance(m, functions) and not m.decorator_list]
    return out


def _spans(source: str, pattern: str, kind: str) -> list[Symbol]:
    """A match reaches to the next one."""
    found = list(re.finditer(pattern, source, re.M))
    line = lambda at: source.count("\n", 0, at) + 1
    ends = [m.start() for m in found[1:]] + [len(source)]
    return [(m[1], kind, line(m.start()), line(e), None) for m, e in zip(found, ends, strict=True)]


def python_symbols_by_pattern(path: str, source: str) -> list[Symbol]:
    return _spans(source, r"^def\s+([A-Za-z_]\w*)\s*\(", "function") + _spans(source, r"^class\s+([A-Za-z_]\w*)\s*[:(]", "class")


def _blanked(source: str) -> str:
    """Comments and strings replaced by blanks, so that braces in them don't count."""
    return re.sub(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"', lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def _closing(code: str, at: int) -> int:
    """Where the block that opens at or after ``at`` closes; the end of the line if none opens there."""
    opened = code.find("{", at)
    stop = re.compile(r"[;\n]\s*\n|;").search(code, at)
    if opened < 0 or (stop and stop.start() < opened):
        return stop.start() if stop else len(code) - 1
    depth = 0
    for i in range(opened, len(code)):
        depth += (code[i] == "{") - (code[i] == "}")
        if depth == 0:
            return i
    return len(code) - 1


def _nested(source: str, types: str, members: str, qualify: bool) -> list[Symbol]:
    """Types and their members in a language with braces; bodies of members are passed over."""
    code = _blanked(source)
    line = lambda at: code.count("\n", 0, at) + 1
    out: list[Symbol] = []

    def scan(low: int, high: int, owner: str) -> None:
        at = low
        pattern = re.compile(f"(?:{types})|(?:{members})", re.M)
        while (m := pattern.search(code, at, high)) is not None:
            found = {k: v for k, v in m.groupdict().items() if v}
            end = _closing(code, m.end() - (code[m.end() - 1] == "{"))
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if "kind" in found:
                name = found.get("type") or ""
                if "trait" in found:
                    name = f"{found['trait']} for {name}"
                out.append((name, found["kind"], line(start), line(end), None))
                inner = code.find("{", m.end() - 1, end + 1)
                if inner >= 0:
                    scan(inner + 1, end, found.get("type") or owner)
            else:
                name = found.get("name") or found.get("special") or ""
                out.append((f"{owner}.{name}" if qualify and owner else name, "method" if qualify and owner else "function", line(start), line(end), None))
            at = max(end, m.end())

    scan(0, len(code), "")
    return out


def java_symbols(path: str, source: str) -> list[Symbol]:
    """Types, and methods and constructors as functions."""
    types = r"^[ \t]*(?:[\w@]+[ \t]+)*?(?P<kind>class|interface|enum|record|@interface)\s+(?P<type>\w+)[^;{]*\{"
    members = r"^[ \t]*(?!return\b|new\b|else\b|throw\b)(?:[\w<>\[\],.?@]+[ \t]+)+(?P<name>[A-Za-z_]\w*)\s*\([^;{}]*\)[^;{}]*\{|^[ \t]*(?:public|private|protected)\s+(?P<special>[A-Z]\w*)\s*\([^;{}]*\)[^;{}]*\{"
    return _nested(source, types, members, False)


def rust_symbols(path: str, source: str) -> list[Symbol]:
    """Types, modules and impls; functions of an impl or module are methods of its type."""
    types = r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?P<kind>struct|enum|trait|union|mod|type|impl)\b(?:<[^>{]*>)?\s+(?:(?P<trait>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?P<type>\w+)"
    members = r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(?P<name>\w+)"
    return [(n, "struct" if k == "union" else k, a, b, d) for n, k, a, b, d in _nested(source, types, members, True)]


def swift_symbols(path: str, source: str) -> list[Symbol]:
    types = r"^[ \t]*(?:@\w+\s+)*(?:(?:public|private|internal|open|final|fileprivate)\s+)*(?P<kind>class|struct|enum|extension|actor|protocol)\s+(?!func\b|var\b)(?P<type>\w+)[^{\n]*\{"
    members = r"^[ \t]*(?:@\w+\s+)*(?:(?:public|private|internal|open|final|fileprivate|static|class|override|mutating|convenience|required)\s+)*(?:func\s+(?P<name>\w+)|(?P<special>init|deinit)\b)"
    return _nested(source, types, members, False)


def elixir_symbols(path: str, source: str) -> list[Symbol]:
    """Modules and their definitions, by the indentation of their ends."""
    lines, out = source.split("\n"), []
    for i, row in enumerate(lines):
        m = re.match(r"^(\s*)(defmodule|defp?|defmacrop?)[ (]\s*([\w.!?]+)", row)
        if not m:
            continue
        end = i
        if re.search(r"\bdo\s*$", row):
            end = next((j for j in range(i + 1, len(lines)) if re.match(rf"^{m[1]}end\b", lines[j])), len(lines) - 1)
        out.append((m[3], "module" if m[2] == "defmodule" else "function", i + 1, end + 1, None))
    return out


def script_symbols(path: str, source: str) -> list[Symbol]:
    """JavaScript and TypeScript by pattern: function declarations, and exported functions bound to a name."""
    line = lambda at: source.count("\n", 0, at) + 1
    found = [(m.start(), m[1], "function") for m in re.finditer(r"function\s+([A-Za-z_$][\w$]*)\s*\(", source)]
    found += [(m.start(), m[1], "function") for m in re.finditer(r"export\s+(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=", source)]
    found += [(m.start(), m[1], "class") for m in re.finditer(r"^(?:export\s+(?:default\s+)?)?class\s+([A-Za-z_$][\w$]*)", source, re.M)]
    found.sort()
    ends = [f[0] for f in found[1:]] + [len(source)]
    return [(name, kind, line(at), line(e), None) for (at, name, kind), e in zip(found, ends, strict=True)]


PARSERS: dict[str, Callable[[str, str], list[Symbol]]] = {
    "python": python_symbols,
    "javascript": script_symbols,
    "typescript": script_symbols,
    "java": java_symbols,
    "rust": rust_symbols,
    "swift": swift_symbols,
    "elixir": elixir_symbols,
}


# The sections of a single-file component.
SECTION_TAGS = {
    "script": r"""(?s)<script((?:\s+lang=["']ts["'])?(?:\s+context=["']module["'])?\s*)>(.*?)</script>""",
    "style": r"""(?s)<style(?:\s+lang=["'](?:scss|sass)["'])?\s*>(.*?)</style>""",
    "any script": r"(?s)<script(?:\s+[^>]*)?>.*?</script>",
    "any style": r"(?s)<style(?:\s+[^>]*)?>.*?</style>",
}


def component_parts(source: Column) -> Column:
    """(script, typescript, style, template) of a single-file component; a missing part is empty.

    Script and style are the first of their kind with plain attributes; the
    template is what is left without any of them.
    """
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    template = F.regexp_replace(F.regexp_replace(source, SECTION_TAGS["any script"], ""), SECTION_TAGS["any style"], "")
    return F.struct(
        bare(F.regexp_extract(source, SECTION_TAGS["script"], 2)).alias("script"),
        F.regexp_extract(source, SECTION_TAGS["script"], 1).rlike("""lang=["']ts["']""").alias("typescript"),
        bare(F.regexp_extract(source, SECTION_TAGS["style"], 1)).alias("style"),
        bare(template).alias("template"),
    )


def component_symbols(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, symbols...) of the scripts in components, whose path gets `` <script>`` appended."""
    scripts = files.select("repo_id", F.concat("file_path", F.lit(" <script>")).alias("file_path"), component_parts(F.col("content"))["script"].alias("content"))
    return extract(scripts.filter("content <> ''"), script_symbols, SYMBOL)


# How a statement's object is told, in the order in which they are tried.
SQL_OBJECTS = {
    "table": r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?(\w+)",
    "view": r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?(\w+)",
    "index": r"(?i)CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?(\w+)",
    "function": r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?FUNCTION\s+[`\"\[]?(\w+)",
    "procedure": r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?PROCEDURE\s+[`\"\[]?(\w+)",
    "trigger": r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?TRIGGER\s+[`\"\[]?(\w+)",
}
SQL_COMMENT_NAME = r"(?i)--\s*(?:Query|Name|Function):\s*(\w+)"
SQL_VERBS = ["SELECT", "INSERT", "UPDATE", "DELETE", "WITH", "ALTER", "DROP"]


def sql_statements(files: DataFrame, keys: tuple[str, ...] = ("repo_id", "file_path"), content: str = "content") -> DataFrame:
    """(keys..., ordinal, kind, name, start_line) of statements of 20 characters or more."""
    s = files.select(*keys, F.col(content).alias("__c"), F.posexplode(F.split(content, r";\s*(?=\n|$)")).alias("ordinal", "raw"))
    s = s.withColumn("statement", T.stripped(F.col("raw"))).filter(F.length("statement") >= 20)
    created = [(k, F.nullif(F.regexp_extract("statement", p, 1), F.lit(""))) for k, p in SQL_OBJECTS.items()]
    commented = F.nullif(F.regexp_extract("statement", SQL_COMMENT_NAME, 1), F.lit(""))
    verbs = F.array_join(F.filter(F.transform(F.slice(F.split("statement", r"\s+"), 1, 3), F.upper), lambda w: w.isin(SQL_VERBS)), "_")
    kind = F.coalesce(*[F.when(n.isNotNull(), f"sql_{k}") for k, n in created], F.when(commented.isNotNull(), "sql_query"), F.lit("sql_statement"))
    name = F.coalesce(*[n for _, n in created], commented, F.nullif(verbs, F.lit("")), F.lit("statement"))
    start = T.line_count(F.expr("substring(__c, 1, greatest(locate(statement, __c) - 1, 0))"))
    return s.select(*keys, "ordinal", kind.alias("kind"), name.alias("name"), start.alias("start_line"))


# Import statements by language.
IMPORTS = {
    "python": r"(?m)^(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "javascript": r"(?:import|require)\s*\(?['\"]([^'\"]+)['\"]",
    "typescript": r"(?:import|require)\s*\(?['\"]([^'\"]+)['\"]",
    "svelte": r"(?:import|require)\s*\(?['\"]([^'\"]+)['\"]",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
    "swift": r"(?m)^\s*import\s+([\w.]+)",
    "elixir": r"(?m)^\s*(?:alias|import|use|require)\s+([\w.]+(?:\.\{[^}]+\})?)",
}
IMPORT_LIMIT = 30


def imports(source: Column, language: Column) -> Column:
    out = F.array().cast("array<string>")
    for lang, pattern in IMPORTS.items():
        first = F.regexp_extract_all(source, F.lit(pattern), F.lit(1))
        if lang == "python":
            second = F.regexp_extract_all(source, F.lit(pattern), F.lit(2))
            first = F.zip_with(first, second, lambda a, b: F.when(a != "", a).otherwise(b))
        out = F.when(language == lang, F.slice(first, 1, IMPORT_LIMIT)).otherwise(out)
    return out


def file_chunks(path: str, source: str, whole: int = 6000) -> list[tuple[int, str, int, int]]:
    """(ordinal, kind, start_line, end_line): what stands before the first definition, then the whole file or its symbols."""
    lines = source.split("\n")
    first = next((i for i, x in enumerate(lines) if re.match(r"\s*(?:async\s+def|def|class|func|fn|function)\b", x)), len(lines))
    out = [(0, "metadata", 1, min(first, 50))] if first else []
    if len(source) < whole:
        return [*out, (len(out), "file", 1, len(lines))]
    spans = [(s[2], s[3]) for s in python_symbols(path, source) if s[1] != "method"] or [(1, len(lines))]
    return out + [(len(out) + i, "symbol", a, b) for i, (a, b) in enumerate(spans)]


def commit_log(path: str, log: str) -> list[tuple[str, str, str, str, int, int, int]]:
    """(hash, author, date, subject, added, deleted, files) of a log with numbers of lines; '-' counts 0, anything else odd is passed over."""
    out: list[list] = []
    for row in log.split("\n"):
        head = row.split("|", 3)
        if len(head) == 4 and re.fullmatch(r"[0-9a-f]{7,40}", head[0]):
            out.append([*head, 0, 0, 0])
        elif out and len(parts := row.split("\t")) >= 3:
            added, deleted = (("0" if p == "-" else p) for p in parts[:2])
            if added.isdigit() and deleted.isdigit():
                out[-1][4] += int(added)
                out[-1][5] += int(deleted)
                out[-1][6] += 1
    return [tuple(x) for x in out]


def markdown_sections(path: str, source: str) -> list[tuple[int, str | None, int, str, str]]:
    """(ordinal, title, level, header_path, body); the path is the stack of titles above."""
    out, stack, title, level, body = [], [], None, 0, []

    def close() -> None:
        if title is not None or body:
            out.append((len(out), title, level, " > ".join(t for _, t in stack), "\n".join(body)))

    for row in source.split("\n"):
        m = re.match(r"^(#{1,6})\s+(.+)$", row.strip())
        if m:
            close()
            level, title, body = len(m[1]), m[2].strip(), [row]
            stack = [x for x in stack if x[0] < level] + [(level, title)]
        else:
            body.append(row)
    close()
    return out


def underlined_sections(path: str, source: str) -> list[tuple[int, str | None, int, str, str]]:
    """Sections whose titles are underlined by one repeated sign, at least three times; levels by first use of a sign."""
    lines, signs, starts = source.split("\n"), [], []
    for i in range(1, len(lines)):
        sign = lines[i].strip()
        if len(sign) >= 3 and len(set(sign)) == 1 and not sign[0].isalnum() and lines[i - 1].strip():
            if sign[0] not in signs:
                signs.append(sign[0])
            starts.append((i - 1, lines[i - 1].strip(), signs.index(sign[0]) + 1))
    out, stack = [], []
    for k, (at, title, level) in enumerate(starts):
        end = starts[k + 1][0] if k + 1 < len(starts) else len(lines)
        stack = [x for x in stack if x[0] < level] + [(level, title)]
        out.append((k, title, level, " > ".join(t for _, t in stack), "\n".join(lines[at:end])))
    return out or [(0, None, 0, "", source)]


SECTION = "ordinal int, title string, level int, header_path string, body string"


def document_chunks(path: str, source: str, capacity: int = 4000, least: int = 100) -> list[tuple[int, str | None, int, str, str]]:
    """Sections cut at paragraphs to ``capacity`` characters; chunks below ``least`` go."""
    find = underlined_sections if path.endswith(".rst") else markdown_sections
    out = []
    for _, title, level, above, body in find(path, source):
        part = ""
        for paragraph in re.split(r"(?<=\n)\n+", body):
            pieces = [paragraph[i : i + capacity] for i in range(0, len(paragraph), capacity)] or [""]
            for piece in pieces:
                if part and len(part) + len(piece) > capacity:
                    out.append((title, level, above, part))
                    part = ""
                part += piece
        out.append((title, level, above, part))
    kept = [x for x in out if len(x[3].strip()) >= least]
    return [(i, *x) for i, x in enumerate(kept)]


def structured_document(path: str, source: str) -> list[tuple[str, str]]:
    """(keys, text): top-level keys of JSON or YAML; other text has none."""
    if path.endswith(".json"):
        try:
            value = json.loads(source)
        except ValueError:
            return [("", source)]
        return [(",".join(value) if isinstance(value, dict) else "", json.dumps(value, indent=2))]
    if path.endswith((".yaml", ".yml")):
        return [(",".join(re.findall(r"^([A-Za-z_][\w-]*)\s*:", source, re.M)), source)]
    return [("", source)]


SPEC_TITLE = r"(?m)^#\s+(?:Feature\s+)?Spec:\s*(.+)$"
SPEC_LEVEL = r"(?m)^##\s+.*?\b(L[0-5])\b"
SPEC_INTENT = r"(?im)^>\s*Intent\s+Patterns?:\s*(.+)$"
COMPONENT = r"[A-Z][A-Za-z0-9]+(?:[A-Z][a-z0-9]*)*"
SKIPPED_COMPONENTS = ["Component", "Name", "Props", "Description", "True", "False", "None", "State", "Heuristic", "Status", "Region"]


def is_spec(source: Column) -> Column:
    return source.rlike(SPEC_TITLE) | (F.size(F.array_distinct(F.regexp_extract_all(source, F.lit(SPEC_LEVEL), F.lit(1)))) >= 3)


def spec_metadata(source: Column) -> Column:
    """(spec_name, intent_patterns, l_levels, components)."""
    every = lambda s, p: F.regexp_extract_all(s, F.lit(p), F.lit(1))
    raw = F.regexp_replace(T.stripped(F.regexp_extract(source, SPEC_INTENT, 1)), r"^[\[\]]+|[\[\]]+$", "")
    patterns = F.transform(F.split(raw, "[,|;]"), lambda p: T.stripped(F.regexp_replace(T.stripped(p), "^`+|`+$", "")))
    patterns = F.filter(patterns, lambda p: ~p.isin("", "...", "…"))
    section = F.regexp_extract(source, r"(?ms)(^##\s+[^\n]*?\bL1\b.*?)(?=^##\s|\z)", 1)
    scanned = F.when(section != "", section).otherwise(source)
    rows = every(source, rf"(?m)^\|\s*`?({COMPONENT})`?\s*\|")
    defined = every(scanned, rf"(?m)^({COMPONENT}):$")
    ticked = F.filter(every(scanned, f"`({COMPONENT})`"), lambda n: F.length(n) > 2)
    components = F.filter(F.array_distinct(F.concat(rows, defined, ticked)), lambda n: ~n.isin(SKIPPED_COMPONENTS))
    return F.struct(
        T.stripped(F.regexp_extract(source, SPEC_TITLE, 1)).alias("spec_name"),
        patterns.alias("intent_patterns"),
        F.array_sort(F.array_distinct(every(source, SPEC_LEVEL))).alias("l_levels"),
        components.alias("components"),
    )


# Patterns of code within code, and names of files that matter.
EMBEDDED = [
    (r'(?i)"""[\s\S]{200,}?"""', "long_docstring_or_sql"),
    (r"(?i)f'''[\s\S]{100,}?'''", "f_string_multiline"),
    (r'(?i)f"[^"]{100,}"', "long_f_string"),
    (r"(?i)SELECT\s+.+FROM", "embedded_sql"),
    (r"(?i)INSERT\s+INTO", "embedded_sql"),
    (r"(?i)UPDATE\s+.+SET", "embedded_sql"),
    (r"(?i)DELETE\s+FROM", "embedded_sql"),
    (r"(?i)CREATE\s+TABLE", "embedded_sql"),
    (r"(?i)<[a-z]+[^>]*>[\s\S]{50,}?</[a-z]+>", "embedded_html"),
    (r"(?i)mutation\s*\{", "embedded_graphql"),
    (r"(?i)query\s*\{", "embedded_graphql"),
]
IMPORTANT_NAMES = ["service", "handler", "controller", "manager", "helper", "util", "api", "view"]


def underchunked(path: Column, source: Column, chunks: Column, language: Column) -> Column:
    """Why a file has too few chunks, joined by '; '; 'adequately_chunked' if nothing speaks for it."""
    size, lines = F.length(source), T.line_count(source)
    number = lambda c: c.cast("string")
    density = lines / F.nullif(chunks, F.lit(0))
    formats = F.regexp_count(source, F.lit(r"\.format\s*\(|%\s*\(|f[\"']"))
    templates = F.regexp_count(source, F.lit(r"`[^`]*\$\{[^}]+\}[^`]*`"))
    has_sql = F.lit(False)
    for pattern, name in EMBEDDED:
        if name == "embedded_sql":
            has_sql = has_sql | source.rlike(pattern)
    important = F.lit(False)
    for word in IMPORTANT_NAMES:
        important = important | F.lower(path).contains(word)
    reasons = [
        F.when((size > 5000) & (chunks <= 1), F.concat(F.lit("large_file_single_chunk ("), number(size), F.lit(" chars, "), number(chunks), F.lit(" chunks)"))),
        F.when(density > 100, F.concat(F.lit("high_density ("), number(F.bround(density, 0).cast("bigint")), F.lit(" lines/chunk)"))),
        *[F.when(source.rlike(pattern), name) for pattern, name in EMBEDDED],
        F.when((language == "python") & source.rlike(r"(?i)\.execute\s*\(|\.query\s*\(|cursor\.|rawsql|text\s*\(") & ~has_sql, "sql_execution_pattern"),
        F.when((language == "python") & (formats > 5), F.concat(F.lit("heavy_string_formatting ("), number(formats), F.lit(" instances)"))),
        F.when(language.isin("javascript", "typescript") & (templates > 3), F.concat(F.lit("template_literals ("), number(templates), F.lit(" instances)"))),
        F.when(language.isin("sql", "svelte", "vue", "unknown") & (chunks <= 2), F.concat(F.lit("unsupported_language_minimal_chunks ("), language, F.lit(")"))),
        F.when(important & (chunks <= 2), "important_file_minimal_chunks"),
    ]
    joined = F.array_join(F.array_compact(F.array(*reasons)), "; ")
    return F.when(joined == "", "adequately_chunked").otherwise(joined)


def merged_symbols(symbols: DataFrame) -> DataFrame:
    """One row a (file_path, name) of structural and semantic symbols: the structural span, any docstring, significant if either is."""
    first = F.min_by(F.struct("start_line", "end_line", "kind"), F.struct(F.when(F.col("structural"), 0).otherwise(1), "start_line"))
    doc = F.min_by("docstring", F.when(F.coalesce("docstring", F.lit("")) != "", F.struct(F.when(F.col("structural"), 0).otherwise(1), "start_line")))
    g = symbols.groupBy("file_path", "name").agg(first.alias("s"), doc.alias("docstring"), F.bool_or("significant").alias("significant"))
    return g.select("file_path", "name", "s.*", "docstring", "significant")


def file_blocks(symbols: DataFrame, imports_: DataFrame) -> DataFrame:
    """(file_path, names, imports): significant symbols, documented ones first, and up to eight imports."""
    place = F.struct(F.when(F.coalesce("docstring", F.lit("")) != "", 0).otherwise(1).alias("d"), "start_line", "name")
    g = symbols.filter("significant").groupBy("file_path").agg(F.array_sort(F.collect_list(place))["name"].alias("names"))
    return g.join(imports_.select("file_path", F.slice("imports", 1, 8).alias("imports")), "file_path", "left")


class _Renamed(ast.NodeTransformer):
    """Arguments and assigned names by order of appearance; with ``strict`` attributes and called names too."""

    def __init__(self, own: set[str], strict: bool):
        self.own, self.strict, self.names = own, strict, {}

    def _new(self, name: str) -> str:
        return self.names.setdefault(name, f"v{len(self.names)}") if name in self.own or self.strict else name

    def visit_Name(self, node: ast.Name) -> ast.AST:
        node.id = self._new(node.id)
        return node

    def visit_arg(self, node: ast.arg) -> ast.AST:
        node.arg, node.annotation = self._new(node.arg), None
        return node

    def visit_Attribute(self, node: ast.Attribute) -> ast.AST:
        self.generic_visit(node)
        if self.strict:
            node.attr = self._new(node.attr)
        return node


def renamed_function(source: str, strict: bool = False) -> str | None:
    """A function with its own names replaced, or null where it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    own = {n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)} | {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            f.name = "f"
            if f.body and isinstance(f.body[0], ast.Expr) and isinstance(f.body[0].value, ast.Constant) and isinstance(f.body[0].value.value, str) and len(f.body) > 1:
                f.body = f.body[1:]
    return ast.unparse(_Renamed(own, strict).visit(tree))


def arrow_udf(f, returns: str):
    """``f`` of one string as a function of columns that takes Arrow batches; null stays null."""

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return run


def syntax_shingles(source: str, n: int = 5) -> list[str]:
    """Distinct runs of n node types in breadth-first order."""
    try:
        kinds = [type(x).__name__ for x in ast.walk(ast.parse(source))]
    except (SyntaxError, ValueError):
        return []
    return sorted({" ".join(kinds[i : i + n]) for i in range(len(kinds) - n + 1)})


NO_COMMIT = "no_commit"


def commits_of_chunks(chunks: DataFrame) -> DataFrame:
    """(repo_id, commit_hash, author, files_changed) of (repo_id, ordinal, commit_hash, author, file_path): the first chunk of a commit counts alone.

    Chunks without a commit are left out. One aggregate, combined before the exchange.
    """
    known = chunks.filter((F.col("commit_hash") != "") & (F.col("commit_hash") != NO_COMMIT))
    first = known.groupBy("repo_id", "commit_hash").agg(F.min_by(F.struct("author", "file_path"), "ordinal").alias("f"))
    return first.select("repo_id", "commit_hash", "f.author", F.array("f.file_path").alias("files_changed"))


def history(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """(commit_hash, files_changed): paths that differ from the commit's first parent; none for a root.

    ``commits`` is (commit_hash, parent), ``trees`` (commit_hash, path, blob),
    a row a path. Both sides of a comparison meet in one aggregate by (commit,
    path), so no pairs of trees are built.
    """
    c = commits.select("commit_hash", "parent")
    own = c.filter("parent IS NOT NULL").join(trees, "commit_hash").select("commit_hash", "path", F.col("blob").alias("new"), F.lit(None).cast(trees.schema["blob"].dataType).alias("old"))
    before = trees.withColumnRenamed("commit_hash", "parent").join(c, "parent").select("commit_hash", "path", F.lit(None).cast(trees.schema["blob"].dataType).alias("new"), F.col("blob").alias("old"))
    changed = own.unionByName(before).groupBy("commit_hash", "path").agg(F.max("new").alias("new"), F.max("old").alias("old")).filter("NOT new <=> old")
    listed = changed.groupBy("commit_hash").agg(F.sort_array(F.collect_list("path")).alias("files_changed"))
    none = F.array().cast(listed.schema["files_changed"].dataType)
    return c.select("commit_hash").join(listed, "commit_hash", "left").withColumn("files_changed", F.coalesce("files_changed", none))
