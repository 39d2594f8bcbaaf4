"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL is expanded into every host suffix times every path prefix whose
length some rule uses. Expressions meet rules on the first 32 bits of their
SHA-256 in an equi-join; full digests confirm; the longest expression wins,
then block over allow. The rules are broadcast only if they number at most
``BROADCAST_RULES``, else the same join is shuffled.

A rule without ``/`` is one with an empty path: it holds for all URLs of its
hosts. Null and empty rules hold for none.

Defined results: a null URL or one without ``://`` has an empty host and path
and no rule; repeated rows come back as often as they came in, as each row has
a number of its own (its place in its partition of the input, the same if a
task runs again); extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The production rules as (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DEFAULT_VERDICT = "allow"
BROADCAST_RULES = 100_000


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule string")


def parse(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.locate("://", u) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumn("host", lowered).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def judge(urls: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``urls``; ``rules`` is (verdict, rule)."""
    r = (
        rules.filter(F.col("rule") != "")
        .groupBy("rule")
        .agg(F.max("verdict").alias("verdict"))  # block beats allow on the same expression
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    # At most as many rows as a URL has characters.
    lengths = [x[0] for x in r.select(F.expr("CASE WHEN rule LIKE '%/%' THEN length(substring(rule, locate('/', rule))) ELSE 0 END").alias("n")).distinct().orderBy("n").collect()]
    few = r.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES

    u = parse(urls.select(F.monotonically_increasing_id().alias("__k"), F.col(id).alias("__id"), F.col(url).alias("__url")), "__url")
    prefix = F.array(*[F.lit(n) for n in lengths]) if lengths else F.expr("cast(array() AS array<int>)")
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]')) - i + 1), '.'))")
    paths = F.transform(F.filter(prefix, lambda n: n <= F.length("path")), lambda n: F.expr("path").substr(F.lit(1), n))
    u = u.withColumn("__s", suffixes).withColumn("__p", paths)
    made = F.flatten(F.transform("__s", lambda s: F.transform("__p", lambda p: F.concat(s, p))))
    e = u.select("__k", "__id", "host", "path", F.explode_outer(made).alias("__e"))
    e = e.withColumn("__d", F.sha2("__e", 256)).withColumn("__short", F.substring("__d", 1, 8))
    r = r.select(F.col("short").alias("__short"), F.col("digest").alias("__digest"), F.col("rule").alias("__rule"), F.col("verdict").alias("__verdict"))
    hit = e.join(F.broadcast(r) if few else r, "__short", "left")
    found = (F.col("__d") == F.col("__digest")) & F.col("__rule").isNotNull()
    best = F.max(F.when(found, F.struct(F.length("__rule").alias("n"), F.col("__verdict").alias("v"), F.col("__rule").alias("r"))))
    out = hit.groupBy("__k", "__id", "host", "path").agg(best.alias("__best"))
    return out.select(F.col("__id").alias(id), "host", "path", F.col("__best.r").alias("rule"), F.coalesce("__best.v", F.lit(default)).alias("verdict"))
