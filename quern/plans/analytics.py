"""Corpus and velocity reports, coverage checks and run records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import paths
from quern.plans.registry import query
from quern.sources.tables import ctes, table, view

_FILES, _COMMITS, _EDGES, _SYMBOLS = ctes("files"), ctes("commits"), ctes("edges"), ctes("symbols")
_MONTH = "substr(cast(commit_date AS varchar), 1, 7)"
_OMONTH = "substr(cast(o_orderdate AS varchar), 1, 7)"
_DIR = "regexp_extract(file_path, '^(.*)/[^/]*$', 1)"


def _month(c):
    return F.date_format(c, "yyyy-MM")


def _pct(a, b):
    return F.round(100.0 * a / b, 6)


@query("AGG-01", _FILES + " SELECT repo_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(lang)))[1:5], ',') AS languages FROM files GROUP BY repo_id")
def repos(spark, sf_dir):
    g = view(spark, sf_dir, "files").groupBy("repo_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("lang")).alias("l"))
    return g.select("repo_id", "n", F.array_join(F.slice("l", 1, 5), ",").alias("languages"))


@query("AGG-02", "SELECT source AS repo_id, min(doc_id) AS summary_id FROM documents GROUP BY source ORDER BY repo_id")
def repo_list(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo_id")).agg(F.min("doc_id").alias("summary_id")).orderBy("repo_id")


@query("AGG-03", _SYMBOLS + " SELECT file_path, symbol_type, count(*) AS n FROM symbols GROUP BY ALL")
def child_counts(spark, sf_dir):
    return view(spark, sf_dir, "symbols").groupBy("file_path", "symbol_type").agg(F.count("*").alias("n"))


@query(
    "AGG-04",
    """SELECT cast(quality AS varchar) AS verdict, source, count(*) AS n, count(DISTINCT d.doc_id) AS targets FROM labels l JOIN documents d ON l.doc_id = d.doc_id
GROUP BY GROUPING SETS ((quality, source), (quality), ())""",
)
def verdicts(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("quality").cast("string").alias("verdict"), "source", "doc_id")
    return d.groupingSets([["verdict", "source"], ["verdict"], []], "verdict", "source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("targets"))


@query("AGG-05", "SELECT lang AS type, count(*) AS n, count(DISTINCT source) AS repos FROM documents GROUP BY lang")
def totals_by_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("type")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("repos"))


@query("AGG-06", f"SELECT {_OMONTH} AS month, count(*) AS commits, sum(o_orderkey % 50)::BIGINT AS added, sum(o_custkey % 20)::BIGINT AS deleted FROM orders WHERE cast(o_orderdate AS varchar) >= '1996-01-01' GROUP BY 1")
def monthly_commits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return o.groupBy(_month("o_orderdate").alias("month")).agg(F.count("*").alias("commits"), F.sum(F.col("o_orderkey") % 50).alias("added"), F.sum(F.col("o_custkey") % 20).alias("deleted"))


@query("AGG-07", f"SELECT count(*) AS new_repos FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING min({_OMONTH}) >= '1996-01')")
def new_repos(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(_month("o_orderdate")).alias("first"))
    return g.filter("first >= '1996-01'").agg(F.count("*").alias("new_repos"))


@query("AGG-08", "SELECT cast(year(o_orderdate) AS varchar) || '-Q' || cast(quarter(o_orderdate) AS varchar) AS quarter, count(*) AS n FROM orders GROUP BY 1")
def quarters(spark, sf_dir):
    q = F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").groupBy(q.alias("quarter")).agg(F.count("*").alias("n"))


@query("AGG-09", _COMMITS + " SELECT author, count(*) AS n FROM commits WHERE commit_date >= TIMESTAMP '2024-01-10' AND author NOT IN (1, 2, 3) GROUP BY 1 ORDER BY n DESC, author LIMIT 10")
def top_authors(spark, sf_dir):
    c = view(spark, sf_dir, "commits").filter((F.col("commit_date") >= F.lit("2024-01-10").cast("timestamp_ntz")) & ~F.col("author").isin(1, 2, 3))
    return c.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(10)


@query("AGG-10", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def latest_runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10).select("o_orderkey", "o_orderstatus")


@query("AGG-11", _COMMITS + " SELECT strftime(date_trunc('week', commit_date), '%Y-%m-%d') AS week, count(*) AS commits, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, count(DISTINCT repo_id) AS repos FROM commits GROUP BY 1")
def weekly_velocity(spark, sf_dir):
    week = F.date_format(F.date_trunc("week", "commit_date"), "yyyy-MM-dd").alias("week")
    return view(spark, sf_dir, "commits").groupBy(week).agg(F.count("*").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.countDistinct("repo_id").alias("repos"))


@query(
    "AGG-12",
    f"""WITH m AS (SELECT {_OMONTH} AS p, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS c FROM m),
a AS (SELECT avg(n) FILTER (i <= c // 2) AS early, avg(n) FILTER (i > c // 2) AS late, max(c) AS c FROM r), g AS (SELECT *, CASE WHEN early = 0 THEN 0 ELSE (late - early) / early END AS growth FROM a)
SELECT round(early, 1) AS early, round(late, 1) AS late, round(growth * 100, 1) AS growth_pct, CASE WHEN growth > 0.1 THEN 'accelerating' WHEN growth < -0.1 THEN 'decelerating' ELSE 'steady' END AS trend FROM g WHERE c >= 4""",
)
def acceleration(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(_month("o_orderdate").alias("p")).agg(F.count("*").alias("n"))
    # One row a month: the window's single partition does not grow with the commits.
    r = m.withColumn("i", F.row_number().over(Window.orderBy("p"))).crossJoin(F.broadcast(m.agg(F.count("*").alias("c"))))
    half = F.floor(F.col("c") / 2)
    a = r.agg(F.avg(F.when(F.col("i") <= half, F.col("n"))).alias("early"), F.avg(F.when(F.col("i") > half, F.col("n"))).alias("late"), F.max("c").alias("c"))
    a = a.filter("c >= 4").withColumn("growth", F.when(F.col("early") == 0, 0.0).otherwise((F.col("late") - F.col("early")) / F.col("early")))
    trend = F.when(F.col("growth") > 0.1, "accelerating").when(F.col("growth") < -0.1, "decelerating").otherwise("steady")
    return a.select(F.round("early", 1).alias("early"), F.round("late", 1).alias("late"), F.round(F.col("growth") * 100, 1).alias("growth_pct"), trend.alias("trend"))


@query(
    "AGG-13",
    f"""WITH m AS (SELECT {_OMONTH} AS p, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p DESC) AS i FROM m),
a AS (SELECT sum(n) FILTER (i BETWEEN 2 AND 4) AS recent, sum(n) FILTER (i BETWEEN 5 AND 7) AS previous FROM r)
SELECT cast(recent AS bigint) AS recent, cast(previous AS bigint) AS previous, CASE WHEN coalesce(previous, 0) = 0 THEN 'no baseline' WHEN recent > 1.1 * previous THEN 'up' WHEN recent < 0.9 * previous THEN 'down' ELSE 'steady' END AS verdict FROM a""",
)
def kpi_verdict(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(_month("o_orderdate").alias("p")).agg(F.count("*").alias("n"))
    r = m.withColumn("i", F.row_number().over(Window.orderBy(F.desc("p"))))
    a = r.agg(F.sum(F.when(F.col("i").between(2, 4), F.col("n"))).alias("recent"), F.sum(F.when(F.col("i").between(5, 7), F.col("n"))).alias("previous"))
    v = F.when(F.coalesce("previous", F.lit(0)) == 0, "no baseline").when(F.col("recent") > 1.1 * F.col("previous"), "up").when(F.col("recent") < 0.9 * F.col("previous"), "down")
    return a.select("recent", "previous", v.otherwise("steady").alias("verdict"))


@query(
    "AGG-14",
    """SELECT coalesce(lang, 'unknown') AS language, count(*) AS n, count(DISTINCT source) AS repos, round(avg(length(text)), 6) AS avg_length, min(length(text)) AS min_length, max(length(text)) AS max_length,
  count(*) FILTER (length(text) < 200) AS short, count(l.doc_id) AS judged FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def corpus_profile(spark, sf_dir):
    judged = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("j")).distinct()
    d = table(spark, sf_dir, "documents").join(judged, "doc_id", "left").withColumn("len", F.length("text").cast("bigint"))
    return d.groupBy(F.coalesce("lang", F.lit("unknown")).alias("language")).agg(
        F.count("*").alias("n"),
        F.countDistinct("source").alias("repos"),
        F.round(F.avg("len"), 6).alias("avg_length"),
        F.min("len").alias("min_length"),
        F.max("len").alias("max_length"),
        F.count_if(F.col("len") < 200).alias("short"),
        F.count("j").alias("judged"),
    )


@query("AGG-15", "SELECT source AS repo_id, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, repo_id LIMIT 10")
def maintenance_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo_id").limit(10)


@query("AGG-16", "SELECT lang AS type, source AS repo_id, count(*) AS n FROM documents GROUP BY ALL")
def storage_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("type"), F.col("source").alias("repo_id")).agg(F.count("*").alias("n"))


@query(
    "AGG-17",
    """WITH a AS (SELECT DISTINCT source FROM documents), b AS (SELECT DISTINCT source FROM documents WHERE doc_id % 17 = 0)
SELECT count(*) AS total, count(b.source) AS covered, string_agg(a.source, ',' ORDER BY a.source) FILTER (b.source IS NULL) AS missing, round(100.0 * count(b.source) / count(*), 6) AS pct, count(b.source) = count(*) AS passed FROM a LEFT JOIN b ON a.source = b.source""",
)
def repo_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = d.select("source").distinct(), d.filter("doc_id % 17 = 0").select("source", F.lit(1).alias("c")).distinct()
    g = a.join(b, "source", "left").agg(F.count("*").alias("total"), F.count("c").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("c").isNull(), F.col("source")))).alias("m"))
    return g.select("total", "covered", F.when(F.size("m") > 0, F.array_join("m", ",")).alias("missing"), _pct(F.col("covered"), F.col("total")).alias("pct"), (F.col("covered") == F.col("total")).alias("passed"))


@query(
    "AGG-18",
    _FILES + f""", m AS (SELECT repo_id, count(DISTINCT {_DIR}) AS n FROM files GROUP BY 1)
SELECT sum(n)::BIGINT AS total, round(avg(n), 6) AS mean, count(*) FILTER (n < 9) AS few, sum(n) > 0 AND count(*) FILTER (n < 9) < 0.1 * count(*) AS passed FROM m""",
)
def module_coverage(spark, sf_dir):
    m = view(spark, sf_dir, "files").groupBy("repo_id").agg(F.countDistinct(paths.dirname(F.col("file_path"))).alias("n"))
    g = m.agg(F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("n") < 9).alias("few"), F.count("*").alias("c"))
    return g.select("total", "mean", "few", ((F.col("total") > 0) & (F.col("few") < 0.1 * F.col("c"))).alias("passed"))


@query(
    "AGG-19",
    """SELECT count(*) AS total, count(*) FILTER (l.doc_id IS NULL) AS unembedded, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty,
  count(*) FILTER (l.doc_id IS NULL) = 0 AND count(*) FILTER (trim(coalesce(text, '')) = '') < 0.05 * count(*) AS passed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""",
)
def file_coverage(spark, sf_dir):
    judged = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("j")).distinct()
    d = table(spark, sf_dir, "documents").join(judged, "doc_id", "left")
    g = d.agg(F.count("*").alias("total"), F.count_if(F.col("j").isNull()).alias("unembedded"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"))
    return g.withColumn("passed", (F.col("unembedded") == 0) & (F.col("empty") < 0.05 * F.col("total")))


@query("AGG-20", _SYMBOLS + " SELECT symbol_type, count(*) AS n, count(*) FILTER (symbol_name = 'anonymous') AS unknown FROM symbols GROUP BY 1")
def symbol_coverage(spark, sf_dir):
    return view(spark, sf_dir, "symbols").groupBy("symbol_type").agg(F.count("*").alias("n"), F.count_if(F.col("symbol_name") == "anonymous").alias("unknown"))


@query("AGG-21", "SELECT count(*) AS n, count(*) FILTER (quality = 1) AS llm, round(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS pct, 100.0 * count(*) FILTER (quality = 1) / count(*) > 80 AS passed FROM labels")
def enrichment(spark, sf_dir):
    g = table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("llm"))
    return g.select("n", "llm", _pct(F.col("llm"), F.col("n")).alias("pct"), (100.0 * F.col("llm") / F.col("n") > 80).alias("passed"))


@query(
    "AGG-22",
    _FILES
    + r""", l AS (SELECT repo_id, lang, count(*) AS n FROM files GROUP BY ALL), g AS (SELECT repo_id, string_agg(lang || '=' || cast(n AS varchar), ',' ORDER BY lang) AS languages FROM l GROUP BY 1),
m AS (SELECT repo_id, string_agg(DISTINCT regexp_extract(file_path, '^([^/]*)/', 1), ',' ORDER BY regexp_extract(file_path, '^([^/]*)/', 1)) AS modules FROM files WHERE file_path LIKE '%/%' GROUP BY 1)
SELECT f.repo_id, count(*) AS total_files, sum(line_count)::BIGINT AS total_lines, languages, modules FROM files f JOIN g ON f.repo_id = g.repo_id JOIN m ON f.repo_id = m.repo_id GROUP BY ALL""",
)
def repo_rollup(spark, sf_dir):
    from quern.operators.hierarchy import rollup_repos

    r = rollup_repos(view(spark, sf_dir, "files"))
    languages = F.array_join(F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",")
    return r.select("repo_id", "total_files", "total_lines", languages.alias("languages"), F.array_join("modules", ",").alias("modules"))


@query("AGG-23", _COMMITS + " SELECT kind, repo_id, deleted AS commit_no, count(*) AS n FROM commits WHERE deleted <> 5 GROUP BY ALL")
def orphan_counts(spark, sf_dir):
    return view(spark, sf_dir, "commits").filter("deleted <> 5").groupBy("kind", "repo_id", F.col("deleted").alias("commit_no")).agg(F.count("*").alias("n"))


@query(
    "AGG-24",
    _COMMITS
    + """, r AS (SELECT repo_id, count(*) AS n, sum(added + deleted)::BIGINT AS churn FROM commits WHERE commit_date >= TIMESTAMP '2024-01-28' GROUP BY 1),
s AS (SELECT *, row_number() OVER w AS i, sum(n) OVER (ORDER BY churn DESC, repo_id) AS total FROM r WINDOW w AS (ORDER BY churn DESC, repo_id))
SELECT repo_id, n, churn FROM s WHERE i = 1 OR total <= 150""",
)
def digest_budget(spark, sf_dir):
    c = view(spark, sf_dir, "commits").filter(F.col("commit_date") >= F.lit("2024-01-28").cast("timestamp_ntz"))
    r = c.groupBy("repo_id").agg(F.count("*").alias("n"), F.sum(F.col("added") + F.col("deleted")).alias("churn"))
    w = Window.orderBy(F.desc("churn"), "repo_id")  # one row a repository
    s = r.withColumn("i", F.row_number().over(w)).withColumn("total", F.sum("n").over(w))
    return s.filter("i = 1 OR total <= 150").select("repo_id", "n", "churn")


@query("AGG-25", _EDGES + " SELECT consumer % 5 AS repo, count(DISTINCT consumer) AS module_count, CASE WHEN consumer % 5 = 0 THEN 'mother' ELSE 'daughter' END AS role FROM edges GROUP BY 1, 3")
def dependency_repos(spark, sf_dir):
    repo = F.col("consumer") % 5
    return view(spark, sf_dir, "edges").groupBy(repo.alias("repo")).agg(F.countDistinct("consumer").alias("module_count")).withColumn("role", F.when(F.col("repo") == 0, "mother").otherwise("daughter"))


@query("AGG-26", _FILES + r" SELECT regexp_extract(replace(file_path, '/', '.'), '^([^.]*(\.[^.]*)?)', 1) AS category, sum(n_chars)::BIGINT AS score, count(*) AS n FROM files GROUP BY 1")
def category_criticality(spark, sf_dir):
    module = F.replace("file_path", F.lit("/"), F.lit("."))
    return view(spark, sf_dir, "files").groupBy(F.substring_index(module, ".", 2).alias("category")).agg(F.sum("n_chars").alias("score"), F.count("*").alias("n"))


@query(
    "AGG-27",
    _EDGES
    + """, n AS (SELECT consumer AS v FROM edges UNION SELECT provider FROM edges UNION SELECT 1000), i AS (SELECT provider AS v, count(*) AS d FROM edges GROUP BY 1), o AS (SELECT consumer AS v, count(*) AS d FROM edges GROUP BY 1),
d AS (SELECT n.v, coalesce(i.d, 0) AS i, coalesce(o.d, 0) AS o FROM n LEFT JOIN i ON n.v = i.v LEFT JOIN o ON n.v = o.v)
SELECT count(*) AS nodes, sum(o)::BIGINT AS n_edges, count(*) FILTER (i = 0 AND o = 0) AS isolated, count(*) FILTER (i = 0 AND o > 0) AS roots, count(*) FILTER (o = 0 AND i > 0) AS leaves,
  (SELECT count(*) FROM edges WHERE consumer % 5 <> provider % 5) AS cross_repo, round(sum(o) / (count(*) * count(*)), 6) AS density, min(i) AS min_in, max(i) AS max_in, round(avg(i), 6) AS avg_in FROM d""",
)
def graph_stats(spark, sf_dir):
    from quern.operators.graph import degrees

    e = view(spark, sf_dir, "edges")
    d = degrees(e, e.select(F.col("consumer").alias("v")).union(e.select("provider")).union(spark.createDataFrame([(1000,)], "v bigint")))
    i, o = F.col("in_degree"), F.col("out_degree")
    g = d.agg(
        F.count("*").alias("nodes"),
        F.sum(o).alias("n_edges"),
        F.count_if((i == 0) & (o == 0)).alias("isolated"),
        F.count_if((i == 0) & (o > 0)).alias("roots"),
        F.count_if((o == 0) & (i > 0)).alias("leaves"),
        F.round(F.sum(o) / (F.count("*") * F.count("*")), 6).alias("density"),
        F.min(i).alias("min_in"),
        F.max(i).alias("max_in"),
        F.round(F.avg(i), 6).alias("avg_in"),
    )
    return g.crossJoin(e.agg(F.count_if(F.col("consumer") % 5 != F.col("provider") % 5).alias("cross_repo")))


@query("AGG-28", "SELECT o_orderpriority AS run, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'O') AS updated, count(*) FILTER (o_orderstatus = 'P') AS skipped, sum(o_custkey)::BIGINT AS files FROM orders GROUP BY 1")
def run_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = o.groupBy(F.col("o_orderpriority").alias("run")).pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    s = o.groupBy(F.col("o_orderpriority").alias("run")).agg(F.sum("o_custkey").alias("files"))
    return p.join(s, "run").select("run", F.col("F").alias("failed"), F.col("O").alias("updated"), F.col("P").alias("skipped"), "files")


@query(
    "AGG-29",
    "SELECT source AS repo_id, count(*) AS total, count(*) FILTER (doc_id % 5 = 0) AS absent, count(*) FILTER (doc_id % 5 = 0) <= 0.25 * count(*) AS prune FROM documents GROUP BY 1 HAVING count(*) >= 5",
)
def prune_plan(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo_id")).agg(F.count("*").alias("total"), F.count_if(F.col("doc_id") % 5 == 0).alias("absent"))
    return g.filter("total >= 5").withColumn("prune", F.col("absent") <= 0.25 * F.col("total"))


@query("AGG-30", "WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT round(min(n), 5) AS least, round(max(n), 5) AS most, round(avg(n), 5) AS mean FROM n")
def norm_stats(spark, sf_dir):
    from quern.functions.vectors import norm

    n = table(spark, sf_dir, "embeddings").select(norm(F.col("embedding")).alias("n"))
    return n.agg(F.round(F.min("n"), 5).alias("least"), F.round(F.max("n"), 5).alias("most"), F.round(F.avg("n"), 5).alias("mean"))


@query("AGG-31", "SELECT count(*) AS processed, count(*) FILTER (n_chars < 200) AS failed, round(100.0 * count(*) FILTER (n_chars >= 200) / count(*), 6) AS success_rate FROM documents")
def processing_stats(spark, sf_dir):
    g = table(spark, sf_dir, "documents").agg(F.count("*").alias("processed"), F.count_if(F.col("n_chars") < 200).alias("failed"))
    return g.withColumn("success_rate", _pct(F.col("processed") - F.col("failed"), F.col("processed")))
