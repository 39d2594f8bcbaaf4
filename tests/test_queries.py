"""Every registered query against its oracle, on the smallest tables."""

import pytest

from quern.plans import load
from tests.conftest import SF

R = load()


@pytest.mark.parametrize("name", sorted(R.ORACLES))
def test_oracle(name, same):
    same(R.QUERIES[name], R.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(R.QUERIES) - set(R.ORACLES)))
def test_runs(name, spark):
    assert R.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_chunks_hold_their_documents(spark):
    """EXT-17: in order, within capacity, and without loss but for short ones."""
    from quern.operators import extraction as X

    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect():
        parts = [p[-1] for p in X.document_chunks("x.md", r.text)]
        at = 0
        for p in parts:
            assert 100 <= len(p.strip()) and len(p) <= 4000 + 4
            at = r.text.find(p.strip()[:60], at)
            assert at >= 0
    got = {r.doc_id: r.n for r in R.QUERIES["EXT-17"](spark, SF).groupBy("doc_id").agg({"*": "count"}).toDF("doc_id", "n").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == {i: n for i, t in docs.items() if (n := len(X.document_chunks("x.md", t)))}


def test_fitted_blocks_by_brute_force(spark):
    """EXT-24: the last symbol of the largest block goes until all fit."""
    from quern.operators import incremental as I

    rows = [("m", f"f{i % 3}", i, 100 + 37 * (i % 5)) for i in range(40)] + [("small", "f", 1, 10)]
    left = {f: [r[3] for r in rows if r[0] == "m" and r[1] == f] for f in ("f0", "f1", "f2")}
    while sum(map(sum, left.values())) > 2400:
        left[min(left, key=lambda f: (-sum(left[f]), f))].pop()
    got = {(r.module, r.file): r.kept for r in I.fitted_blocks(spark.createDataFrame(rows, "module string, file string, ordinal int, size int"), 2400).collect()}
    assert got == {("m", f): len(x) for f, x in left.items()} | {("small", "f"): 1}


def test_fitted_blocks_of_large_files(spark):
    """EXT-24: 400,000 symbols in one module, ties and sizes of 0 among them, take no time that grows with the square of a block."""
    import time

    from quern.operators import incremental as I

    n, budget = 400_000, 900
    df = spark.range(n).selectExpr("'m' AS module", "concat('f', id % 3) AS file", "id AS ordinal", "id * 7 DIV 3 % 5 * 10 AS size")
    left = {f"f{k}": [i * 7 // 3 % 5 * 10 for i in range(k, n, 3)] for k in range(3)}
    sums = {f: sum(x) for f, x in left.items()}
    while sum(sums.values()) > budget:
        f = min(left, key=lambda f: (-sums[f], f))
        sums[f] -= left[f].pop()
    began = time.time()
    got = {r.file: r.kept for r in I.fitted_blocks(df, budget).collect()}
    assert time.time() - began < 60
    assert got == {f: len(x) for f, x in left.items()} and all(got.values())


def test_embedding_batches_fit(spark):
    """EXT-25: every document once, in batches whose padded size fits."""
    from quern.plans import extract

    got = R.QUERIES["EXT-25"](spark, SF).collect()
    chars = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(chars)
    batches = {}
    for r in got:
        batches.setdefault(r.batch, []).append(chars[r.doc_id])
        assert r.width == chars[r.batch]
    assert all(len(b) <= extract.EMBEDDING_ITEMS and (len(b) == 1 or max(b) * len(b) <= extract.EMBEDDING_BUDGET) for b in batches.values())


def test_syntax_shingles_by_hand():
    from quern.operators import extraction as X

    assert X.syntax_shingles("x = 1", 3) == ["Assign Name Constant", "Module Assign Name", "Name Constant Store"]
    assert X.syntax_shingles("def") == []


def test_principal_components_by_eigenvalues(spark):
    import numpy as np

    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").collect()], float)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    share = np.cumsum(values) / values.sum()
    got = {round(r.share, 2): r.components for r in R.QUERIES["EVL-10"](spark, SF).collect()}
    assert got == {t: int((share < t).sum()) + 1 for t in (0.9, 0.95)}


def test_breaker_outcomes_by_hand(spark):
    """INC-14: five failures in a row refuse calls until the time is up, then five more are needed."""
    import collections

    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "event_id", "unix_micros(CAST(ts AS timestamp)) / 1e6 AS at", "event_type").collect()
    want, row, last = {}, collections.Counter(), {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.at, r.event_id)):
        u = r.user_id
        if row[u] >= 5 and r.at - last[u] >= 86400:
            row[u] = 0
        if row[u] >= 5:
            want[r.event_id] = "refused"
        elif r.event_type in ("error", "view", "click"):
            row[u], last[u], want[r.event_id] = row[u] + 1, r.at, "failed"
        else:
            row[u], want[r.event_id] = 0, "ok"
    got = {r.ordinal: r.outcome for r in R.QUERIES["INC-14"](spark, SF).collect()}
    assert got == want and set(want.values()) == {"ok", "failed", "refused"}


def test_single_writer(tmp_path):
    from quern.operators.guards import single_writer

    lock = str(tmp_path / "lock")
    with single_writer(lock):
        held = open(lock).read()
        with pytest.raises(BlockingIOError), single_writer(lock):
            pass
        assert open(lock).read() == held != ""
    with single_writer(lock):
        pass
