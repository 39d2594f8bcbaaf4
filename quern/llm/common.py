"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where ``spark.checkpoint.dir`` is unset in local mode (tests), a temporary
    folder is made, set, and removed when the process ends. On a cluster a
    folder of one machine would lose rows, so there it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables written in each open ``scratch``, innermost last; the first list is of those that no scratch deletes.
_written: list[list[str]] = [[]]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end, but for lasting ones, which go with the scratch around it, if any."""
    _written.append([])
    try:
        yield
    finally:
        _delete(spark, _written.pop())


def release(spark: SparkSession) -> None:
    """Delete the tables that results still read; to be called when these are done with."""
    paths, _written[0] = _written[0], []
    _delete(spark, paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, narrow: bool = False, lasting: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike ``checkpoint()`` the last stage runs once, and the files are columnar
    and compressed. They outlive lost executors. Tables of few, short rows are
    written ``narrow``: in an eighth of the files. A ``lasting`` table outlives
    the innermost ``scratch``, as the operator's result reads it.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    _written[-2 if lasting and len(_written) > 1 else -1].append(path)
    # The usual codec takes a direct buffer for each column of each writer, which a collector that sees only the heap is late to free.
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Bound what one Arrow batch to a Python worker holds, however long the texts are.

    Batches are cut when a plan runs, so this lowers the session's own settings; a lower one stays.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, most)
