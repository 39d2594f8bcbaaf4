"""Incremental maintenance: change sets, decisions, significance and checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import ids, text
from quern.functions.vectors import cosine
from quern.operators.guards import FAILURES, RESET_S, Breaker

REBUILD_SHARE = 0.5
SAME_COSINE, OTHER_COSINE, SAME_RATIO = 0.95, 0.80, 0.90
# Words of a change that tell its weight.
SIGNIFICANT_WORDS = ["new feature", "added", "implements", "creates", "api", "interface", "breaking", "refactor", "architecture", "dependency", "integration"]
MINOR_WORDS = ["fix", "typo", "comment", "format", "style", "cleanup", "lint", "whitespace", "minor"]
STATES_TO_BANK = ["no_file_changes", "no_indexable_changes"]


def decision() -> Column:
    """The update decision of one row of facts about a repository.

    Columns: excluded, fetched, has_remote, local, origin, stored, n_changed,
    n_indexable, corpus_files. The first case that fits holds.
    """
    c = F.col
    same = c("stored").isNotNull() & (c("local") == c("origin")) & (c("origin") == c("stored"))
    return (
        F.when(c("excluded"), "excluded")
        .when(~c("fetched"), "error")
        .when(~c("has_remote") | c("origin").isNull(), "empty")
        .when(same, "skipped:no_changes")
        .when(c("stored").isNull(), "full_reingest:new_repo")
        .when(c("n_changed") == 0, "skipped:no_file_changes")
        .when(c("n_indexable") == 0, "skipped:no_indexable_changes")
        .when(c("corpus_files") == 0, "full_reingest:empty_corpus")
        .when(c("n_indexable") / c("corpus_files") > REBUILD_SHARE, "full_reingest:threshold_exceeded")
        .otherwise("updated")
    )


SNOOZE_DAYS = 7


def brief_decision(now: Column, force: bool = False) -> Column:
    """What to do about a repository's brief: updated, skipped or snoozed.

    Columns: summary, readme, stored_hash, last_checked (text). Without a summary
    there is nothing to write; a brief of the same inputs is left, silently for
    ``SNOOZE_DAYS`` after its last check. A stamp that cannot be read never snoozes.
    """
    c = F.col
    checked = F.try_to_timestamp(c("last_checked"))
    resting = F.coalesce(checked + F.expr(f"INTERVAL {SNOOZE_DAYS} DAYS") > now, F.lit(False))
    same = F.coalesce(c("stored_hash") == ids.input_hash(c("summary"), F.coalesce(c("readme"), F.lit(""))), F.lit(False)) & F.lit(not force)
    return F.when(c("summary").isNull(), "skipped").when(same & resting, "snoozed").when(same, "skipped").otherwise("updated")


def index_states(repos: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, state): how the commits index stands to the commit that the corpus was built at, where they differ.

    ``repos`` is (repo_id, indexed, corpus, cloned, files), ``commits`` (repo_id,
    commit_hash, ordinal, indexable) of linear histories, in which the smaller
    ordinal is the ancestor. One aggregate by repository gives the head, both
    positions, and whether an indexable commit lies between.
    """
    c = F.col
    differ = repos.filter("NOT indexed <=> corpus")
    at = commits.join(differ.select("repo_id", "indexed", "corpus"), "repo_id")
    pick = lambda name: F.max(F.when(c("commit_hash") == c(name), c("ordinal")))
    placed = at.groupBy("repo_id").agg(pick("indexed").alias("i"), pick("corpus").alias("k"), F.max_by("commit_hash", "ordinal").alias("head"))
    missed = commits.filter("indexable").join(placed.filter("i > k").select("repo_id", "i", "k"), "repo_id").filter("ordinal > k AND ordinal <= i").select("repo_id").distinct()
    j = differ.join(placed, "repo_id", "left").join(missed.withColumn("missed", F.lit(True)), "repo_id", "left")
    state = (
        F.when(c("files") == 0, "no files")
        .when(~c("cloned"), "clone missing")
        .when(c("corpus") == c("head"), "bank: head")
        .when(c("i") <= c("k"), "bank: index behind")
        .when((c("i") > c("k")) & c("missed").isNull(), "expected")
        .when(c("i") > c("k"), "STALE")
        .otherwise("neither")
    )
    return j.select("repo_id", state.alias("state"))


def repository_facts(docs: DataFrame, index: DataFrame, excluded: DataFrame) -> DataFrame:
    """(repo_id, files, stored) without excluded repositories: its files, and its commit from the index or else from its summary.

    ``docs`` is (repo_id, type, commit_hash), ``index`` (repo_id, commit_hash) with one row a repository.
    """
    mine = docs.groupBy("repo_id").agg(F.count_if(F.col("type") == "file_index").alias("files"), F.min(F.when(F.col("type") == "repo_summary", F.col("commit_hash"))).alias("summary"))
    known = index.filter("commit_hash <> ''").select("repo_id", F.col("commit_hash").alias("banked"))
    j = mine.join(known, "repo_id", "full").join(excluded.select("repo_id").distinct(), "repo_id", "left_anti")
    return j.select("repo_id", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("banked", "summary").alias("stored"))


def breaker_outcomes(calls: DataFrame, failures: int = FAILURES, reset: float = RESET_S) -> DataFrame:
    """(service, ordinal, outcome): ok, failed or refused, as a circuit breaker a service has it.

    ``calls`` is (service, ordinal, at double seconds, fails boolean). Services
    are walked in order of their calls within sorted partitions, so that one
    breaker is held at a time whatever a service's number of calls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, breaker, now = None, None, [0.0]
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if breaker is None or r.service != service:
                    service, breaker = r.service, Breaker(failures, reset, lambda: now[0])
                now[0] = r.at
                if breaker.open():
                    out.append("refused")
                else:
                    breaker.record(not r.fails)
                    out.append("failed" if r.fails else "ok")
            yield pd.DataFrame({"service": b["service"], "ordinal": b["ordinal"], "outcome": out})

    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    ordered = calls.select("service", "ordinal", "at", "fails").repartition("service").sortWithinPartitions("service", "at", "ordinal")
    return ordered.mapInPandas(run, f"service {kinds['service']}, ordinal {kinds['ordinal']}, outcome string")


def published_manifests(vectors: DataFrame, by: str, column: str = "embedding") -> DataFrame:
    """(by, dims, n) of each group whose rows all have a vector, of one size; a group with a failure (null) publishes nothing."""
    size = F.size(column)
    g = vectors.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(column).isNull()).alias("failed"), F.min(size).alias("dims"), F.max(size).alias("most"))
    return g.filter("failed = 0 AND dims = most").select(by, "dims", "n")


def commits_of_run(commits: DataFrame, runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Commits that a run (the latest, or ``run_id``) ingested, of the repositories that it changed.

    ``runs`` is (run_id, started, results array of (repo_id, status)), ``commits``
    has (repo_id, ingested). The run is one row, and its repositories are joined by key.
    """
    run = (runs if run_id is None else runs.filter(F.col("run_id") == run_id)).orderBy(F.desc("started"), F.desc("run_id")).limit(1)
    changed = run.select("started", F.inline("results")).filter(F.col("status").isin("updated", "full_reingest")).groupBy("repo_id").agg(F.min("started").alias("__since"))
    return commits.join(changed, "repo_id").filter(F.col("ingested") >= F.col("__since")).drop("__since")


def bankable(status: Column, reason: Column, commit: Column, dry_run: bool = False) -> Column:
    """Whether a run may move the repository's checkpoint."""
    done = status.isin("updated", "full_reingest") | ((status == "skipped") & reason.isin(STATES_TO_BANK))
    return done & commit.isNotNull() & F.lit(not dry_run)


def _has(text_: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text_.contains(w)
    return out


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts, which no built-in function gives."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)])


def significant(old: Column, new: Column, diff: Column, old_vector: Column | None = None, new_vector: Column | None = None, enabled: bool = True) -> Column:
    """Whether a changed summary should be carried to its parent."""
    out = F.when(F.coalesce(old, F.lit("")) == "", True).when(text.stripped(old) == text.stripped(new), False)
    if not enabled:
        return out.otherwise(True)
    if old_vector is not None and new_vector is not None:
        c = cosine(old_vector, new_vector)
        out = out.when(c > SAME_COSINE, False).when(c < OTHER_COSINE, True)
    said = F.concat(F.lower(diff), F.lit(" "), text.stripped(F.replace(F.lower(new), F.lower(old), F.lit(""))))
    strong, weak = _has(said, SIGNIFICANT_WORDS), _has(said, MINOR_WORDS)
    return out.when(similarity_ratio(old, new) > SAME_RATIO, False).when(weak & ~strong, False).otherwise(True)


def change_set(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """(key, change): A, M or D between two snapshots."""
    o, n = old.select(key, F.col(version).alias("__o")), new.select(key, F.col(version).alias("__n"))
    j = o.withColumn("__ho", F.lit(1)).join(n.withColumn("__hn", F.lit(1)), key, "full")
    change = F.when(F.col("__ho").isNull(), "A").when(F.col("__hn").isNull(), "D").when(~F.col("__o").eqNullSafe(F.col("__n")), "M")
    return j.select(key, change.alias("change")).filter("change IS NOT NULL")


def fitted_blocks(symbols: DataFrame, budget: int) -> DataFrame:
    """(module, file, kept): symbols a file keeps under a budget of characters a module.

    Again and again the largest block loses its last symbol, of equal blocks the
    first by name. As sizes are lengths (a missing or negative one counts 0), a
    symbol goes when its block up to it is the largest: in falling order of
    running sums, until what is left of the module fits. A block beyond the
    budget always loses its last symbol, so that only running sums within the
    budget meet by module, and the first symbol of a file, which stands for it.
    """
    size = F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0))
    s = symbols.filter("file IS NOT NULL").select("module", "file", "ordinal", size.alias("size"))
    in_file = Window.partitionBy("module", "file").orderBy("ordinal", "size")
    s = s.withColumn("n", F.row_number().over(in_file)).withColumn("block", F.sum("size").over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.filter((F.col("block") <= budget) | (F.col("n") == 1))
    going = Window.partitionBy("module").orderBy("block", F.desc("file"), "n").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("left", F.sum("size").over(going)).groupBy("module", "file").agg(F.count_if(F.col("left") <= budget).alias("kept"))


def batches_by_budget(rows: Iterator[tuple[int, int]], budget: int, most: int) -> list[list[int]]:
    """Group ids by size, longest first, so that a batch's padded size fits the budget."""
    out: list[list[int]] = []
    width = 0
    for i, size in sorted(rows, key=lambda r: (-r[1], r[0])):
        if not out or len(out[-1]) >= most or width * (len(out[-1]) + 1) > budget:
            out.append([])
            width = size
        out[-1].append(i)
    return out
