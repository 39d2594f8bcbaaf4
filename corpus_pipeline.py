"""The corpus pipeline: each stage applies one operator to all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Between stages the rows are written as
Parquet in the shared folder and read again.

The near-duplicate stage takes the two-word shingles of ``op2_minhash``, at a
similarity of 0.8. Whole copies and near copies are its business: the line stage
leaves their texts whole (see ``line_dedup.deduplicate``) and drops no document.
No stage caps, samples or cuts anything. SQL cannot express the merges of the
last stage, so there is no oracle; the tests compare all rows with a brute-force
version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontaminate, line_dedup, minhash, quality_rules
from quern.llm.common import materialize, table
from quern.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came before; whole copies keep theirs for the next stage."""
    return line_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.deduplicate(docs, n=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256); ids are packed little-endian 32-bit integers."""
    return bpe.encode(docs, vocabulary(), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe encoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
