"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, line_dedup, minhash, quality_model, quality_rules, secrets, sharding, substrings, url_filters
from quern.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=2)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def vocabulary() -> str:
    """The production vocabulary file; another path can be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rule_table(spark))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("text", 256).alias("kept_sha256"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = secrets.spelled(("assign", "access", "hex"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(F.expr(base), 256).alias("base_sha256"), F.expr(secrets.spelled()).alias("spans"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), outputs=("n_words", "n_removed", "kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that occurs in it."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_minhash": op2_minhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe": op4_bpe,
    "op5_url_filters": op5_url_filters,
    "op6_line_dedup": op6_line_dedup,
    "op7_secret_scans": op7_secret_scans,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
}

_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

ORACLES = {
    "op3_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS j FROM r) GROUP BY k),
m AS (SELECT w.k, doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words,
        len(list_filter(ls, lambda x: ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…'))) AS n_ellipsis_lines,
        len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS n_bullet_lines,
        len(regexp_extract_all(t, '!!')) AS n_shouts
      FROM w LEFT JOIN c ON w.k = c.k),
b AS (SELECT *, (n_words < {quality_rules.BASE_MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.BASE_MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars, cast(n_symbols AS bigint) AS n_symbols,
       cast(n_dup_lines AS bigint) AS n_dup_lines, cast(n_repeat_words AS bigint) AS n_repeat_words, base_failed,
       (NOT base_failed AND {quality_rules.compiled()}) AS kept FROM b
""",
    "op5_url_filters": r"""
WITH p AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT k, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rule, rhost, rpath) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
f AS (SELECT k, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, 'allow') AS verdict FROM h LEFT JOIN f ON h.k = f.k
""",
    # Two lines are one edit apart if taking out one character of the longer one, or of both at the same place, makes them equal.
    "op6_line_dedup": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
c AS (SELECT line, min((doc_id, pos)) AS ord, length(line) AS n FROM l WHERE length(line) >= {line_dedup.MIN_CHARS} AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
v AS (SELECT line, ord, n, unnest(range(1, n + 1)) AS p FROM c),
s AS (SELECT ord, n, p, hash(left(line, p - 1), substr(line, p + 1)) AS sub, hash(left(line, p - 1) || substr(line, p + 1)) AS del FROM v),
m AS (SELECT n, p, sub, min(ord) AS ord FROM s GROUP BY n, p, sub),
near AS (SELECT s.ord FROM s JOIN m ON s.n = m.n AND s.p = m.p AND s.sub = m.sub WHERE m.ord < s.ord
         UNION SELECT greatest(s.ord, c.ord) FROM s JOIN c ON s.del = hash(c.line) AND c.n = s.n - 1),
w AS (SELECT l.doc_id, l.pos, l.line, regexp_matches(l.line, '[^\x20\x09-\x0D]') AS worded,
             near.ord IS NOT NULL AS near, (c.ord IS NOT NULL AND (near.ord IS NOT NULL OR c.ord <> (l.doc_id, l.pos))) AS gone
      FROM l LEFT JOIN c ON l.line = c.line LEFT JOIN near ON c.ord = near.ord)
SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (near) AS n_near,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM w GROUP BY doc_id
""",
}
