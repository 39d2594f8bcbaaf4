"""Results as Markdown, JSON and HTML text, one Column for each kind of result.

A null text renders as an empty one, and an empty list leaves its section out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW_CHARS, RESULT_CHARS = 200, 500


def _t(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else _t(p) for p in parts])


def _when(condition: Column, text: Column) -> Column:
    return F.when(condition, text).otherwise("")


def bullets(items: Column, most: int | None = None, indent: str = "", rest: bool = False) -> Column:
    """The first ``most`` items as a list; with ``rest`` a last line counts the others."""
    shown = items if most is None else F.slice(items, 1, most)
    lines = F.array_join(F.transform(shown, lambda x: F.concat(F.lit(indent + "- "), x)), "\n")
    if most is None or not rest:
        return lines
    return F.concat(lines, _when(F.size(items) > most, _join(f"\n{indent}- ... and ", F.size(items) - most, " more")))


def repository(repo: Column, docs: Column, languages: Column) -> Column:
    some = _when(F.size(languages) > 0, _join(" (", F.array_join(F.slice(languages, 1, 3), ", "), ")"))
    return _join("- **", F.coalesce(repo, F.lit("Unknown")), "**: ", docs, " documents", some)


def hit(doc_type: Column, repo: Column, path: Column, symbol: Column, kind: Column, module: Column, start: Column, end: Column, content: Column, score: Column, preview: Column) -> Column:
    """One search result: a heading by type, where it is from, and the start of its content."""
    lines = _when((start > 0) & (end > 0), _join(" [lines ", start, "-", end, "]"))
    named = F.when(F.length(symbol) > 0, symbol).otherwise(path)
    head = (
        F.when(doc_type == "symbol_index", _join(symbol, " (", F.coalesce(kind, F.lit("symbol")), ") in ", path, lines))
        .when(doc_type == "file_index", _t(path))
        .when(doc_type == "module_summary", _join("Module: ", F.coalesce(module, path), "/"))
        .when(doc_type == "repo_summary", _join("Repository: ", repo))
        .when(doc_type == "spec", _join("Spec: ", named))
        .when(doc_type == "document", _join("Doc: ", path, " (", F.coalesce(kind, F.lit("doc")), ")"))
        .otherwise(_t(F.when(F.length(path) > 0, path).otherwise(repo)))
    )
    most = F.when(preview, PREVIEW_CHARS).otherwise(RESULT_CHARS)
    start_of = F.concat(F.substring(_t(content), F.lit(1), most), _when(F.length(content) > most, F.lit("...")))
    return _join("### ", head, "\n_Repo: ", repo, " | Score: ", F.format_string("%.2f", F.coalesce(score, F.lit(0.0))), "_\n\n", start_of, "\n")


def file_view(repo: Column, path: Column, code: Column, start: Column, end: Column, total: Column, language: Column, truncated: Column) -> Column:
    cut = _when(truncated, F.lit(" (truncated)"))
    return _join("## ", repo, "/", path, "\nLines ", start, "-", end, " of ", total, cut, "\n\n```", language, "\n", code, "\n```")


def answer(text: Column, sources: Column, gaps: Column) -> Column:
    """An answer, its first five sources, and what it lacks."""
    found = _when(F.size(sources) > 0, _join("\n\n**Sources:**\n", bullets(sources, 5)))
    return _join(F.coalesce(text, F.lit("No answer received.")), found, _when(F.size(gaps) > 0, _join("\n\n**Gaps identified:**\n", bullets(gaps))))


def proposal(text: Column, sources: Column, gaps: Column, intent: Column) -> Column:
    """A draft: what it lacks before its sources, and the intent that it was written for."""
    lacks = _when(F.size(gaps) > 0, _join("\n\n**Gaps (need more input):**\n", bullets(gaps)))
    found = _when(F.size(sources) > 0, _join("\n\n**Sources:**\n", bullets(sources, 5)))
    return _join(F.coalesce(text, F.lit("No answer received.")), lacks, found, _when(F.length(intent) > 0, _join("\n\n_Intent: ", intent, "_")))


def criticality(module: Column, repo: Column, score: Column, percentile: Column, in_degree: Column, out_degree: Column, is_test: Column, dependents: Column) -> Column:
    listed = _join("**Direct dependents (", F.size(dependents), "):**\n", bullets(dependents, 15, "  ", rest=True))
    facts = _join("**Repo:** ", repo, "\n**Score:** ", F.format_string("%.6f", score), " (percentile: ", percentile, ")\n**In-degree:** ", in_degree, " (modules depend on this)")
    kind = _when(is_test, F.lit("\n**Type:** Test module"))
    tail = F.when(F.size(dependents) > 0, listed).otherwise("_No direct dependents (leaf module)_")
    return _join("## Criticality: ", module, "\n\n", facts, "\n**Out-degree:** ", out_degree, " (modules this depends on)", kind, "\n\n", tail)


def affected_tests(cluster: Column, changed: Column, affected: Column, tests: Column, graph_found: Column) -> Column:
    section = lambda name, items: _when(F.size(items) > 0, _join(f"**{name} modules:** ", F.size(items), "\n", bullets(items, 10, "  ", rest=True), "\n\n"))
    run = F.when(F.size(tests) > 0, _join("**Tests to run:** ", F.size(tests), "\n", bullets(tests, indent="  "))).otherwise("**No test modules affected**")
    found = _join("## Affected Tests for ", cluster, "\n\n", section("Changed", changed), section("Affected", affected), run)
    return F.when(graph_found, found).otherwise(_join("No dependency graph found for cluster '", cluster, "'. Run all tests."))


def html_row(*cells: Column) -> Column:
    """A table row with what is special to HTML escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(_t(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in cells], F.lit("</tr>"))
