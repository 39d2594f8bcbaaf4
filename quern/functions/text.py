"""Text functions of summaries, previews and spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"^\s+|\s+$"

# Words that are no keywords of a query.
QUERY_STOP_WORDS = (
    "a an and are as at be by for from has have how in into is it its of on or that the then this to up was which will with if when any each "
    "function method class code used uses using given also"
).split()


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, _BLANK, "")


def long_enough(text: Column, least: int) -> Column:
    return F.length(stripped(text)) >= least


def clipped(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def line_span(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from 1, both included, cut to what there is."""
    lines = F.split(text, "\n")
    low = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, low, F.greatest(F.least(end, F.size(lines)) - low + 1, F.lit(0))), "\n")


def middle_cut(text: Column, most: int = 6000, head: int = 4500, tail: int = 1400, mark: str = "\n\n... [truncated] ...\n\n") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(tail)))).otherwise(text)


def at_word(text: Column, n: int) -> Column:
    """Cut after at most n characters at the last space before, with an ellipsis."""
    cut = F.left(text, F.lit(n))
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.when(cut.contains(" "), F.regexp_extract(cut, r"(?s)^(.*) ", 1)).otherwise(cut), F.lit("…")))


def clean_docstring(text: Column) -> Column:
    return at_word(stripped(F.regexp_replace(F.regexp_replace(stripped(text), "^(\"\"\"|''')|(\"\"\"|''')$", ""), r"\s+", " ")), 240)


def preview(text: Column, n: int = 160) -> Column:
    """The first sentence of the first line, or the line cut at a word."""
    line = stripped(F.substring_index(text, "\n", 1))
    at = F.locate(". ", line)
    return F.when((at > 1) & (at <= n), F.left(line, at)).otherwise(at_word(line, n))


def lead(text: Column) -> Column:
    return F.split(stripped(text), r"(?<=[.!?])\s+")[0]


def keywords(text: Column, n: int = 18) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z_][A-Za-z0-9_]+"), F.lit(0))
    return F.array_join(F.slice(F.filter(found, lambda w: ~w.isin(QUERY_STOP_WORDS) & (F.length(w) > 2)), 1, n), " ")


def gaps(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[GAP:\s*([^\]]+)\]"), F.lit(1))


def context_header(text: Column, path: Column, inside: Column | None = None) -> Column:
    head = F.concat(F.lit("# Context: "), path, F.lit("\n"))
    if inside is not None:
        head = F.concat(head, F.when(inside.isNotNull(), F.concat(F.lit("# Inside: "), inside, F.lit("\n"))).otherwise(""))
    return F.concat(head, text)


def cited_files(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"`?([a-zA-Z0-9_/.-]+\.(py|js|ts|tsx|jsx|go|rs|java|rb|svelte))`?(?::\d+)?"), F.lit(1))))


def cited_symbols(text: Column) -> Column:
    ticked = F.regexp_extract_all(text, F.lit(r"`([A-Z][a-zA-Z0-9_]+)`"), F.lit(1))
    named = F.regexp_extract_all(text, F.lit(r"(?:class|def|function)\s+([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(ticked, named)))


def cited_repos(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+)"), F.lit(1))))


def tolerant_json(text: Column) -> Column:
    """A model's reply without its code fence, with backslashes doubled that escape nothing."""
    bare = stripped(F.regexp_replace(stripped(text), r"^```[a-z]*\s*|\s*```$", ""))
    return F.regexp_replace(bare, r"(?<!\\)((?:\\\\)*)\\(?![\\\"/bfnrtu])", r"$1\\\\")


# What models put before queries and documents.
PREFIXES = {
    "Qwen/Qwen3-Embedding-0.6B": ("", ""),
    "nomic-ai/nomic-embed-text-v1.5": ("search_query: ", "search_document: "),
}


def prefixed(text: Column, model: str, of_query: bool) -> Column:
    """``text`` as a model embeds it; a model without a known convention is refused."""
    if model not in PREFIXES:
        raise ValueError(f"no convention is known for {model!r}")
    return F.concat(F.lit(PREFIXES[model][0 if of_query else 1]), text)
