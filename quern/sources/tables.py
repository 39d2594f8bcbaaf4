"""Loading tables, and the code-corpus views over them.

The views are plain SQL that Spark and DuckDB read alike, so that a query and
its oracle start from the same rows: ``files`` (documents as source files),
``symbols`` (line items as symbols of files), ``versions`` (orders as stored
versions of a key), ``commits`` (events as commits), ``edges`` (line items as
module dependencies) and ``notes`` (labels as verdicts on documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "files": (
        "documents",
        """SELECT doc_id, source AS repo_id, lang, text AS content, n_chars,
  CASE WHEN doc_id % 11 = 0 THEN name ELSE 'src' || CAST(doc_id % 3 AS STRING) || '/' || lang || CASE WHEN doc_id % 5 = 0 THEN '/gen/' ELSE '/' END || name END AS file_path,
  length(text) - length(replace(text, chr(10), '')) + 1 AS line_count
FROM (SELECT *, CASE doc_id % 8 WHEN 0 THEN 'models.py' WHEN 1 THEN 'index.ts' WHEN 2 THEN 'main' || CAST(doc_id AS STRING) || '.py'
  WHEN 3 THEN 'app' || CAST(doc_id AS STRING) || '.min.js' WHEN 4 THEN 'Guide' || CAST(doc_id AS STRING) || '.md' WHEN 5 THEN 'data' || CAST(doc_id AS STRING) || '.json'
  WHEN 6 THEN 'Makefile' ELSE 'Test' || CAST(doc_id AS STRING) || '.java' END AS name FROM documents) d""",
    ),
    "symbols": (
        "lineitem",
        """SELECT 'repo' || CAST(l_suppkey % 20 AS STRING) AS repo_id, 'pkg' || CAST(l_orderkey % 7 AS STRING) || '/f' || CAST(l_orderkey % 400 AS STRING) || '.py' AS file_path,
  CASE WHEN l_partkey % 40 = 0 THEN 'anonymous' ELSE 'sym' || CAST(l_partkey % 300 AS STRING) END AS symbol_name,
  CASE l_linenumber % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS symbol_type,
  l_orderkey * 10 + l_linenumber AS start_line, l_orderkey * 10 + l_linenumber + CAST(floor(l_quantity / 4) AS BIGINT) AS end_line, l_orderkey, l_linenumber
FROM lineitem""",
    ),
    "versions": ("orders", "SELECT o_custkey AS doc_key, o_orderkey AS document_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS created_at, o_orderstatus AS status FROM orders"),
    "commits": (
        "events",
        """SELECT event_id AS commit_id, 'repo' || CAST(user_id % 12 AS STRING) AS repo_id, user_id AS author, ts AS commit_date, event_type AS kind,
  CAST(floor(value) AS BIGINT) AS added, event_id % 37 AS deleted, props FROM events""",
    ),
    "edges": ("lineitem", "SELECT DISTINCT l_suppkey % 60 AS consumer, l_partkey % 97 AS provider FROM lineitem WHERE l_suppkey % 60 <> l_partkey % 97 AND (l_suppkey * 7 + l_partkey) % 11 = 0"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, sql = VIEWS[name]
    return spark.sql(sql.replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: table(spark, sf_dir, base)})


def ctes(*names: str) -> str:
    """The views as common table expressions of an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
