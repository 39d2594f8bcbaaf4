"""Reading repositories, and writing stores of documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import paths

CODE_SUFFIXES = tuple(paths.PARSER_LANGUAGES)


def decoded(content: Column) -> Column:
    """Bytes as text without what is no UTF-8, so that images and the like are no error."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def at_commit(paths_: DataFrame, blobs: DataFrame, worktree: DataFrame) -> DataFrame:
    """(repo_id, file_path, content): the commit's bytes of a path, else the working tree's; a path in neither is left out."""
    key = ["repo_id", "file_path"]
    j = paths_.select(*key).join(blobs.select(*key, F.col("content").alias("c")), key, "left").join(worktree.select(*key, F.col("content").alias("w")), key, "left")
    return j.select(*key, decoded(F.coalesce("c", "w")).alias("content")).filter("content IS NOT NULL")


def discovered_files(spark: SparkSession, root: str) -> DataFrame:
    """(repo_id, file_path, size, content) under ``root``/owner_name/..., by Spark's own reader."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_extract("path", rf"/{re.escape(root.rstrip('/').split('/')[-1])}/(.*)$", 1)
    f = raw.select(inside.alias("p"), F.col("length").alias("size"), decoded(F.col("content")).alias("content"))
    folder = F.substring_index("p", "/", 1)
    repo = F.concat_ws("/", F.substring_index(folder, "_", 1), F.regexp_extract(folder, "_(.*)$", 1))
    return f.filter(folder.contains("_") & ~folder.startswith(".")).select(repo.alias("repo_id"), F.regexp_extract("p", "^[^/]*/(.*)$", 1).alias("file_path"), "size", "content")


def repositories(files: DataFrame) -> DataFrame:
    return files.select("repo_id").distinct()


def code_files(files: DataFrame) -> DataFrame:
    p = F.col("file_path")
    return files.filter(paths.parser_language(p).isNotNull() & ~paths.skipped(p, F.col("size"), F.col("content")))


def document_files(files: DataFrame) -> DataFrame:
    p = F.col("file_path")
    return files.filter(paths.is_document(p) & ~paths.skipped(p, F.col("size"), F.col("content")))


def dependency_json(files: DataFrame) -> DataFrame:
    """(module, path, imports, imported_by) of (ordinal, content); of a module in several files the last file counts."""
    entry = "struct<path:string,imports:array<string>,imported_by:array<string>>"
    e = files.select("ordinal", F.explode(F.from_json("content", f"map<string,{entry}>")).alias("module", "v"))
    last = e.groupBy("module").agg(F.max_by("v", "ordinal").alias("v"))
    return last.select("module", "v.path", F.coalesce("v.imports", F.array().cast("array<string>")).alias("imports"), F.coalesce("v.imported_by", F.array().cast("array<string>")).alias("imported_by"))


def name_status(diffs: DataFrame) -> DataFrame:
    """(repo_id, change, file_path) of a list of changed names; a rename is a deletion and an addition, a copy an addition."""
    rows = diffs.select("repo_id", F.explode(F.split("content", "\n")).alias("row")).filter("row <> ''")
    parts = F.split("row", "\t")
    kind = F.substring(parts[0], 1, 1)
    one = lambda change, path: F.struct(F.lit(change).alias("change"), path.alias("file_path"))
    target = F.try_element_at(parts, F.lit(3))
    found = F.when(kind == "R", F.array(one("D", parts[1]), one("A", target))).when(kind == "C", F.array(one("A", target))).otherwise(F.array(F.struct(kind.alias("change"), parts[1].alias("file_path"))))
    return rows.select("repo_id", F.inline(found))


def canonical_repositories(*sources: list[str]) -> list[str]:
    """The first list that holds anything."""
    return next((sorted(set(s)) for s in sources if s), [])


# The lookups that a store has to serve, by name: key columns in order, and types.
LOOKUPS = {
    "repo_summary_list": (["repo_id"], ["repo_summary"]),
    "file_by_repo": (["repo_id", "file_path"], ["file_index"]),
    "module_by_repo": (["repo_id", "file_path"], ["module_summary"]),
    "child_by_repo_file": (["repo_id", "file_path", "type"], ["symbol_index", "semantic_unit"]),
    "annotation_target": (["target_id", "created_at"], ["annotation"]),
    "annotation_repo": (["repo_id", "created_at"], ["annotation"]),
}


def write_store(docs: DataFrame, path: str) -> None:
    """One partition a type, sorted by repository and path, so that files are skipped by their statistics.

    Ranges are cut from a sample of the keys down to the path, so that a large
    repository is spread over several tasks.
    """
    by = ["type", "repo_id", "file_path"]
    docs.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("type").parquet(path)


def lookup(store: DataFrame, name: str) -> DataFrame:
    """The rows of a lookup's types: a partition filter; filters on its keys reach the files' statistics."""
    return store.filter(F.col("type").isin(LOOKUPS[name][1]))
