"""Retrieval quality and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Null if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def relevant(expected: Column, *fields: Column) -> Column:
    """Whether any expected name is part of any field, whatever the case."""
    named = F.array(*[F.lower(F.coalesce(f, F.lit(""))) for f in fields])
    return F.exists(expected, lambda e: F.exists(named, lambda f: f.contains(F.lower(e))))


def ranking_metrics(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """Mean reciprocal rank, recalls and the median of one rank a query; null ranks count as misses."""
    r = F.col(rank)
    at = lambda k: F.round(F.avg(F.coalesce((r <= k).cast("double"), F.lit(0.0))), 6)
    return ranks.agg(
        F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"), at(1).alias("r1"), at(5).alias("r5"), at(10).alias("r10"), F.round(F.median(r), 6).alias("median_rank")
    )


def precision_metrics(hits: DataFrame) -> DataFrame:
    """(query_id, hit, p1, p3, p5, rr) of (query_id, rank, relevant)."""
    rel = F.col("relevant").cast("int")
    p = lambda k: (F.sum(F.when(F.col("rank") <= k, rel)) / F.least(F.lit(k), F.count("*"))).alias(f"p{k}")
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    return hits.groupBy("query_id").agg(F.max("relevant").alias("hit"), p(1), p(3), p(5), F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"))


def auc(scores: DataFrame, score: str, positive: str) -> DataFrame:
    """The area under the curve with ties halved, from counts by distinct score."""
    c = scores.groupBy(score).agg(F.sum(F.col(positive).cast("int")).alias("p"), F.sum((~F.col(positive)).cast("int")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = c.withColumn("below", below)
    return w.agg(F.round(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)) / (F.sum("p") * F.sum("n")), 6).alias("auc"))


def cohens_d(scores: DataFrame, score: str, positive: str) -> DataFrame:
    """Difference of the means over the pooled population deviation."""
    of = lambda f, yes: f(F.when(F.col(positive) if yes else ~F.col(positive), F.col(score)))
    pooled = F.sqrt((of(F.var_pop, True) + of(F.var_pop, False)) / 2)
    return scores.agg(F.round((of(F.avg, True) - of(F.avg, False)) / pooled, 6).alias("d"))
