"""Bottom-up hierarchy: files to modules to repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import ids, paths, text

# Entry points by rank, and technologies with what in the imports or the path tells them.
KEY_FILES = ["models.py", "views.py", "urls.py", "index.ts", "index.js", "main.py", "api.py", "routes.py", "handlers.py", "config.py", "settings.py", "__init__.py"]
TECHNOLOGIES = {
    "django": (["django"], []),
    "flask": (["flask"], []),
    "fastapi": (["fastapi"], []),
    "react": (["react"], ["jsx"]),
    "vue": (["vue"], [".vue"]),
    "svelte": ([], ["svelte"]),
    "sqlalchemy": (["sqlalchemy"], []),
    "postgresql": (["psycopg", "postgresql"], []),
    "redis": (["redis"], []),
    "celery": (["celery"], []),
    "python": ([], ["requirements.txt", "pyproject.toml"]),
    "nodejs": ([], ["package.json"]),
    "docker": ([], ["dockerfile"]),
}
LARGE_FILE_LINES, KEY_FILE_LIMIT, TECH_LIMIT = 200, 10, 15
SHOWN_FILES, SHOWN_CHILDREN = 10, 5


def folders(files: DataFrame) -> DataFrame:
    """(repo_id, folder): every folder that holds a file, and all above it but the root."""
    f = files.select("repo_id", paths.dirname(F.col("file_path")).alias("d")).distinct()
    own = f.select("repo_id", F.col("d").alias("folder"))
    above = f.select("repo_id", F.explode(paths.ancestors(F.col("d"))).alias("folder"))
    return own.union(above).distinct()


def modules(files: DataFrame) -> DataFrame:
    """(repo_id, module_path, depth, file_count, n_children, parent_path): deepest first when ordered by depth."""
    all_folders = folders(files).withColumnRenamed("folder", "module_path")
    count = files.groupBy("repo_id", paths.dirname(F.col("file_path")).alias("module_path")).agg(F.count("*").alias("file_count"))
    up = all_folders.filter("module_path <> ''").select("repo_id", paths.dirname(F.col("module_path")).alias("module_path")).groupBy("repo_id", "module_path").agg(F.count("*").alias("n_children"))
    out = all_folders.join(count, ["repo_id", "module_path"], "left").join(up, ["repo_id", "module_path"], "left").fillna(0, ["file_count", "n_children"])
    parent = F.when(F.col("module_path") != "", paths.dirname(F.col("module_path")))
    return out.select("repo_id", "module_path", paths.depth(F.col("module_path")).alias("depth"), "file_count", "n_children", parent.alias("parent_path"))


def parent_ids(m: DataFrame) -> DataFrame:
    """A top-level module hangs on the repository."""
    c = F.col
    at_top = c("parent_path").isNull() | (c("parent_path") == "")
    return m.withColumn("parent_id", F.when(at_top, ids.repo_id(c("repo_id"))).otherwise(ids.module_id(c("repo_id"), c("parent_path"))))


def key_files(files: DataFrame, limit: int = KEY_FILE_LIMIT) -> DataFrame:
    """(repo_id, module_path, key_files): entry points by rank, then large files by size."""
    rank = F.array_position(F.array(*map(F.lit, KEY_FILES)), paths.basename(F.col("file_path")))
    f = files.groupBy("repo_id", "file_path").agg(F.max("line_count").alias("lines")).withColumn("rank", rank)
    f = f.filter((F.col("rank") > 0) | (F.col("lines") > LARGE_FILE_LINES))
    place = F.struct(F.when(F.col("rank") > 0, 0).otherwise(1).alias("tier"), F.when(F.col("rank") > 0, F.col("rank")).otherwise(-F.col("lines")).alias("order"), F.col("file_path").alias("path"))
    # Numbered and cut before anything is gathered.
    f = f.select("repo_id", paths.dirname(F.col("file_path")).alias("module_path"), place.alias("place"))
    f = f.withColumn("r", F.row_number().over(Window.partitionBy("repo_id", "module_path").orderBy("place"))).filter(F.col("r") <= limit)
    return f.groupBy("repo_id", "module_path").agg(F.array_sort(F.collect_list("place"))["path"].alias("key_files"))



def technologies(imports: Column, path: Column) -> Column:
    """Tags of one file; ``imports`` is the list as text."""
    low, tags = F.lower(path), []
    for tag, (words, parts) in TECHNOLOGIES.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | imports.contains(w)
        for p in parts:
            hit = hit | low.contains(p)
        tags.append(F.when(hit, tag))
    return F.array_compact(F.array(*tags))


def rollup_repos(files: DataFrame) -> DataFrame:
    """(repo_id, total_files, total_lines, languages, modules)."""
    by_language = files.groupBy("repo_id", "lang").agg(F.count("*").alias("n"), F.sum("line_count").alias("l"))
    top = files.filter(F.col("file_path").contains("/")).groupBy("repo_id").agg(F.sort_array(F.collect_set(F.substring_index("file_path", "/", 1))).alias("modules"))
    g = by_language.groupBy("repo_id").agg(F.sum("n").alias("total_files"), F.sum("l").alias("total_lines"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("languages"))
    return g.join(top, "repo_id", "left")


def module_summary(module: Column, n_files: Column, files: Column, n_children: Column, children: Column) -> Column:
    """The template summary; ``files`` is a sorted array of (name, preview), ``children`` of paths, both cut already; the numbers are of all."""
    lines = F.transform(files, lambda x: F.concat(F.lit("\n- "), x["name"], F.when(x["preview"] == "", "").otherwise(F.concat(F.lit(": "), x["preview"]))))
    below = F.transform(children, lambda x: F.concat(F.lit("\n- "), x, F.lit("/")))
    head = F.concat(F.lit("Module: "), F.when(module == "", "(root)").otherwise(module), F.lit("/"))
    part = lambda title, n, body: F.when(n > 0, F.concat(F.lit(f"\n\n{title} ("), n.cast("string"), F.lit("):"), F.array_join(body, ""))).otherwise("")
    return F.concat(head, part("Files", n_files, lines), part("Submodules", n_children, below))


def summarized_modules(files: DataFrame) -> DataFrame:
    """(repo_id, module_path, summary) from the previews of the files and the names of the submodules.

    Of equal previews in a module the first counts. Rows are numbered and cut by
    windows before they are gathered, so a module of many files is no large array.
    """
    own = ["repo_id", "module_path"]
    each = files.select("repo_id", paths.dirname(F.col("file_path")).alias("module_path"), F.col("file_path").alias("path"), paths.basename(F.col("file_path")).alias("name"), text.preview(F.coalesce("content", F.lit(""))).alias("preview"))
    place = ["path", "name", "preview"]
    kinds = each.groupBy(*own, F.lower("preview").alias("kind"), F.when(F.col("preview") == "", F.struct(*place)).alias("blank")).agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n"))
    ranked = kinds.withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy("first"))).withColumn("times", F.when(F.col("kind") == "", F.col("n")).otherwise(1))
    shown = ranked.filter(F.col("r") <= SHOWN_FILES).groupBy(*own).agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "times"))), lambda x: F.array_repeat(x["first"], F.least(x["times"], F.lit(SHOWN_FILES)).cast("int")))), 1, SHOWN_FILES).alias("files"))
    total = kinds.groupBy(*own).agg(F.sum("n").alias("n_files"))
    m = modules(files)
    up = m.filter("parent_path IS NOT NULL").select("repo_id", F.col("parent_path").alias("module_path"), F.col("module_path").alias("child"))
    up = up.withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy("child")))
    below = up.groupBy(*own).agg(F.max("r").alias("n_children"), F.array_sort(F.collect_list(F.when(F.col("r") <= SHOWN_CHILDREN, F.col("child")))).alias("children"))
    j = m.select(*own).join(shown, own, "left").join(total, own, "left").join(below, own, "left").fillna(0, ["n_files", "n_children"])
    none = F.array().cast(shown.schema["files"].dataType)
    summary = module_summary(F.col("module_path"), F.col("n_files"), F.coalesce("files", none), F.col("n_children"), F.coalesce("children", F.array().cast("array<string>")))
    return j.select(*own, summary.alias("summary"))
