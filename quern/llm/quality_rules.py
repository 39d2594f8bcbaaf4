"""Quality rules: a threshold table compiled into one Spark projection.

Only built-in expressions run; there is no shuffle, so one very long document
costs one task its own length and nothing else.

Defined results: a null or empty text has no words and fails the base rule; a
repeated row is judged each time; an empty table gives an empty result; extra
columns of any name are ignored by ``measure`` and returned untouched by
``keep``. Windows are compared by a 64-bit hash within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE, WORD

# Common function words of the supported languages.
STOP_WORDS = (
    "the be to of and that have with is in for this it as are was "
    "le la les de des du et un une que qui dans en est pour par sur avec "
    "der die das und zu den von mit ist ein eine nicht auf für auch sich "
    "el los las y del una por con para se es su como al lo"
).split()

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document is rejected if ``metric`` is out of [low, high] and it has ``min_words``."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 1


#: Metrics are SQL over the measured columns; every one is a ratio whose divisor is never 0,
#: as Spark may compute it for rows that need it not.
RULES = (
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", low=2.0, high=14.0),
    Rule("symbols_per_word", "n_symbols / greatest(n_words, 1)", high=0.1),
    Rule("stop_words_per_word", "n_stop_words / greatest(n_words, 1)", low=0.02, min_words=50),
    Rule("words_with_letter", "n_alpha_words / greatest(n_words, 1)", low=0.7),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", high=0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines / greatest(n_lines, 1)", high=0.3),
    Rule("bullet_lines", "n_bullet_lines / greatest(n_lines, 1)", high=0.9),
    Rule("shouted_words", "n_shouts / greatest(n_words, 1)", high=0.1),
)
BASE_MIN_WORDS = 10
BASE_MAX_REPEAT_PERCENT = 20


def compiled(rules: tuple[Rule, ...] = RULES) -> str:
    """The threshold table as one SQL condition that holds for documents to keep."""
    parts = []
    for r in rules:
        bounds = [f"({r.metric}) >= {r.low}"] * (r.low is not None) + [f"({r.metric}) <= {r.high}"] * (r.high is not None)
        parts.append(f"(n_words < {r.min_words} OR ({' AND '.join(bounds)}))")
    return " AND ".join(parts) or "true"


def _measured(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(kept as it came: ``row``, and the struct ``__q`` of all measures and verdicts) from (row, text)."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    d = df.withColumn("__t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = d.withColumn("__w", F.expr(f"filter(split(__t, '{_sql(SPACE)}'), w -> w <> '')"))
    d = d.withColumn("__l", F.expr(f"filter(split(__t, '\\n'), l -> l rlike '{_sql(WORD)}')"))
    at = ", ".join(f"__w[i + {k}]" for k in range(WINDOW))
    d = d.withColumn(
        "__h",
        F.expr(f"CASE WHEN size(__w) >= {WINDOW} THEN transform(sequence(0, size(__w) - {WINDOW}), i -> xxhash64({at})) ELSE cast(array() AS array<bigint>) END"),
    )
    # Positions are sorted by hash only where some window occurs twice.
    d = d.withColumn(
        "__s",
        F.expr("CASE WHEN size(array_distinct(__h)) = size(__h) THEN NULL ELSE array_sort(transform(__h, (h, i) -> struct(h AS h, i AS i))) END"),
    )
    pos = "array_sort(transform(filter(__s, (x, k) -> (k > 0 AND __s[greatest(k - 1, 0)].h = x.h) OR (k < size(__s) - 1 AND __s[least(k + 1, size(__s) - 1)].h = x.h)), x -> x.i))"
    repeat = f"CASE WHEN __s IS NULL THEN 0L ELSE aggregate({pos}, struct(0L AS n, -{WINDOW} AS p), (a, p) -> struct(a.n + least({WINDOW}, p - a.p) AS n, p AS p), a -> a.n) END"
    measures = {
        "n_words": "cast(size(__w) AS bigint)",
        "word_chars": f"cast(length(regexp_replace(__t, '{_sql(SPACE)}', '')) AS bigint)",
        "n_symbols": f"cast(length(__t) - length(translate(__t, '{SYMBOLS}', '')) AS bigint)",
        "n_dup_lines": "cast(size(__l) - size(array_distinct(__l)) AS bigint)",
        "n_repeat_words": repeat,
        "n_lines": "cast(size(__l) AS bigint)",
        "n_stop_words": f"cast(size(filter(__w, w -> lower(w) IN ({stops}))) AS bigint)",
        "n_alpha_words": "cast(size(filter(__w, w -> w rlike '\\\\p{L}')) AS bigint)",
        "n_ellipsis_lines": "cast(size(filter(__l, l -> endswith(rtrim(l), '...') OR endswith(rtrim(l), '…'))) AS bigint)",
        "n_bullet_lines": "cast(size(filter(__l, l -> ltrim(l) rlike '^[-*•]')) AS bigint)",
        "n_shouts": "cast(regexp_count(__t, '!!') AS bigint)",
    }
    d = d.withColumn("__m", F.struct(*[F.expr(e).alias(n) for n, e in measures.items()]))
    failed = f"n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words"
    verdict = f"NOT ({failed}) AND {compiled(rules)}"
    for n in sorted(measures, key=len, reverse=True):
        failed = _named(failed, n)
        verdict = _named(verdict, n)
    # A generator of one row: Spark doesn't move a filter on its output below the steps that it names,
    # where every measure would be spelled out and computed many times over.
    verdicts = F.struct("__m.*", F.expr(failed).alias("base_failed"), F.expr(verdict).alias("kept"))
    return d.select("row", F.explode(F.array(verdicts)).alias("__q"))


def _named(sql: str, name: str) -> str:
    import re

    return re.sub(rf"(?<![\w.]){name}\b", f"__m.{name}", sql)


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def measure(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its id, measures, ``base_failed`` and ``kept``."""
    return _measured(docs.select(F.col(id).alias("row"), F.col(text).alias("text")), rules).select(F.col("row").alias(id), "__q.*")


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return _measured(whole, rules).filter("__q.kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
