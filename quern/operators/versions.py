"""Versions of stored documents, identity of symbols, and set reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import ids

UNNAMED = ["anonymous", "arrow_function", ""]


def _ranked(df: DataFrame, keys: list[str], created: str, id: str) -> DataFrame:
    stamp = F.coalesce(F.col(created).cast("string"), F.lit(""))
    w = Window.partitionBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).orderBy(stamp.desc(), F.coalesce(F.col(id), F.lit(-1)).desc())
    return df.withColumn("__r", F.row_number().over(w))


def newest_per_key(df: DataFrame, keys: list[str], created: str = "created_at", id: str = "document_id") -> DataFrame:
    """A missing stamp is oldest; ties fall to the larger id."""
    return _ranked(df, keys, created, id).filter("__r = 1").drop("__r")


def superseded(df: DataFrame, keys: list[str], created: str = "created_at", id: str = "document_id") -> DataFrame:
    return _ranked(df, keys, created, id).filter("__r > 1").drop("__r")


def with_symbol_ids(symbols: DataFrame) -> DataFrame:
    """Name ids where the name is unique in its file, span ids elsewhere."""
    c = F.col
    w = Window.partitionBy("repo_id", "file_path", "symbol_name")
    by_span = c("symbol_name").isin(UNNAMED) | (F.count("*").over(w) > 1)
    span = ids.span_id(c("repo_id"), c("file_path"), c("symbol_name"), c("start_line"), c("end_line"))
    return symbols.withColumn("symbol_id", F.when(by_span, span).otherwise(ids.symbol_id(c("repo_id"), c("file_path"), c("symbol_name"))))


def upsert(old: DataFrame, new: DataFrame, id: str) -> DataFrame:
    """New rows, and the old ones that no new one replaces."""
    return new.unionByName(old.join(new.select(id), id, "left_anti"))


def reconcile(wanted: DataFrame, have: DataFrame, id: str) -> DataFrame:
    """(id, state): missing, superseded or kept."""
    w, h = wanted.select(id).distinct().withColumn("w", F.lit(1)), have.select(id).distinct().withColumn("h", F.lit(1))
    state = F.when(F.col("h").isNull(), "missing").when(F.col("w").isNull(), "superseded").otherwise("kept")
    return w.join(h, id, "full").select(id, state.alias("state"))


def guarded_delete(rows: DataFrame, doomed: DataFrame, key: str, id: str) -> DataFrame:
    """``rows`` without the doomed ids, but for keys that would lose their last row: those keep all."""
    d = doomed.select(id).distinct().withColumn("__d", F.lit(1))
    left = rows.join(d, id, "left")
    alive = left.groupBy(key).agg(F.sum(F.col("__d").isNull().cast("int")).alias("__n"))
    return left.join(alive, key).filter("__d IS NULL OR __n = 0").drop("__d", "__n")


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
