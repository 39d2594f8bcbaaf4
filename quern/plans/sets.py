"""Scans, sinks, versions, joins and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import ids, paths
from quern.functions import render as R
from quern.operators import incremental as I
from quern.operators import versions as V
from quern.plans.registry import query
from quern.sources import repositories as S
from quern.sources.tables import ctes, table, view

_FILES, _SYMBOLS, _VERSIONS, _COMMITS = ctes("files"), ctes("symbols"), ctes("versions"), ctes("commits")
_BASE = "regexp_extract(file_path, '([^/]*)$', 1)"
_DIR = "regexp_extract(file_path, '^(.*)/[^/]*$', 1)"
_STAMP = "coalesce(cast(created_at AS varchar), '')"
_NEWEST = f"row_number() OVER (PARTITION BY doc_key ORDER BY {_STAMP} DESC, document_id DESC)"


@query("SRC-09", "SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_custkey = 42")


@query("SRC-10", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def multi_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SRC-11", "SELECT doc_id, lang FROM documents WHERE doc_id > 50 ORDER BY doc_id LIMIT 20")
def keyset_page(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("doc_id > 50").orderBy("doc_id").limit(20).select("doc_id", "lang")


@query("SRC-12", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20 OFFSET 60")
def offset_page(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy("doc_id").offset(60).limit(20).select("doc_id", "lang")


@query(
    "SRC-13",
    """WITH e AS (SELECT *, date_trunc('day', ts) AS day, first_value(event_type) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id) AS status FROM events), run AS (SELECT day, min(ts) AS started FROM e GROUP BY 1 ORDER BY 2 DESC LIMIT 1)
SELECT event_id, user_id AS repo_id FROM e JOIN run ON e.ts >= run.started AND e.day = run.day WHERE status IN ('purchase', 'signup')""",
)
def commits_of_latest_run(spark, sf_dir):
    """A run a day, which tells a repository's status by its first event of the day."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    status = F.when(F.col("kind") == "purchase", "updated").when(F.col("kind") == "signup", "full_reingest").otherwise("skipped")
    states = e.groupBy("day", F.col("user_id").alias("repo_id")).agg(F.min_by("event_type", "event_id").alias("kind"), F.min("ts").alias("started"))
    runs = states.groupBy(F.col("day").cast("string").alias("run_id")).agg(F.min("started").alias("started"), F.collect_list(F.struct("repo_id", status.alias("status"))).alias("results"))
    commits = e.select("event_id", F.col("user_id").alias("repo_id"), F.col("ts").alias("ingested"))
    return I.commits_of_run(commits, runs).select("event_id", "repo_id")


@query("SRC-14", _SYMBOLS + " SELECT repo_id, file_path, count(*) AS chunks, min(l_orderkey) AS commit_no, true AS present FROM symbols GROUP BY 1, 2")
def per_file_reads(spark, sf_dir):
    return view(spark, sf_dir, "symbols").groupBy("repo_id", "file_path").agg(F.count("*").alias("chunks"), F.min("l_orderkey").alias("commit_no"), F.lit(True).alias("present"))


@query("SRC-15", _FILES + f" SELECT doc_id, CASE WHEN file_path LIKE '%.md' THEN file_path WHEN file_path LIKE '%.py' THEN {_DIR} ELSE repo_id END AS path FROM files WHERE file_path LIKE '%.md' OR file_path LIKE '%.py'")
def training_extract(spark, sf_dir):
    p = F.col("file_path")
    f = view(spark, sf_dir, "files").filter(p.like("%.md") | p.like("%.py"))
    return f.select("doc_id", F.when(p.like("%.md"), p).when(p.like("%.py"), paths.dirname(p)).otherwise(F.col("repo_id")).alias("path"))


@query("SNK-01", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT max(o_orderkey) + 1, 'new' FROM orders")
def upserts(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    extra = old.agg((F.max("o_orderkey") + 1).alias("o_orderkey"), F.lit("new").alias("status"))
    new = old.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("status")).union(extra)
    return V.upsert(old, new, "o_orderkey")


@query("SNK-02", "SELECT doc_id FROM documents WHERE NOT (source = 'src4' AND lang IN ('en', 'fr'))")
def deletes(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(~((F.col("source") == "src4") & F.col("lang").isin("en", "fr"))).select("doc_id")


@query("SNK-03", "SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, count(*) FILTER (o_orderkey % 2 = 0) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE o_orderkey % 2 = 0 OR n = 0")
def guarded_deletes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return V.guarded_delete(o, o.filter("o_orderkey % 2 = 1").select("o_orderkey"), "o_custkey", "o_orderkey").select("o_orderkey")


@query("SNK-04", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'deu' ELSE lang END AS language, n_chars FROM documents")
def nested_mutation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.col("lang").alias("language"), "n_chars").alias("metadata"))
    m = d.withColumn("metadata", F.col("metadata").withField("language", F.when(F.col("metadata.language") == "de", "deu").otherwise(F.col("metadata.language"))))
    return m.select("doc_id", "metadata.language", "metadata.n_chars")


@query("SNK-06", r"SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS t FROM documents) GROUP BY ALL")
def token_index(spark, sf_dir):
    from quern.operators.retrieval import tokens

    terms = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


_TYPED = "typed AS (SELECT *, ['repo_summary', 'file_index', 'module_summary', 'symbol_index', 'semantic_unit', 'spec', 'document', 'other'][(doc_id % 8 + 1)::INT] AS doc_type FROM files)"


def _typed(spark, sf_dir):
    types = ("repo_summary", "file_index", "module_summary", "symbol_index", "semantic_unit", "spec", "document", "other")
    return view(spark, sf_dir, "files").withColumn("doc_type", F.element_at(F.array(*map(F.lit, types)), (F.col("doc_id") % 8 + 1).cast("int")))


@query("SNK-05", f"{_FILES}, {_TYPED}, l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, unnest({t}) AS doc_type" for n, (_, t) in S.LOOKUPS.items()) + ") SELECT name, repo_id, count(*) AS n, min(file_path) AS first FROM l JOIN typed USING (doc_type) GROUP BY ALL")
def store_lookups(spark, sf_dir):
    from quern.operators.graph import scratch

    path = scratch(spark)
    S.write_store(_typed(spark, sf_dir).select(F.col("doc_type").alias("type"), "repo_id", "file_path", "doc_id"), path)
    store = spark.read.parquet(path)
    found = [S.lookup(store, n).groupBy("repo_id").agg(F.count("*").alias("n"), F.min("file_path").alias("first")).select(F.lit(n).alias("name"), "repo_id", "n", "first") for n in S.LOOKUPS]
    return reduce(DataFrame.unionAll, found)


@query(
    "SNK-07",
    _FILES
    + """, g AS (SELECT repo_id, count(*) AS n, list_sort(list_distinct(list(lang))) AS l FROM files GROUP BY repo_id)
SELECT '- **' || repo_id || '**: ' || n || ' documents (' || array_to_string(l[1:3], ', ') || ')' AS line, '{"repo_id":"' || repo_id || '","n":' || n || '}' AS json, '<tr><td>' || repo_id || '</td><td>' || n || '</td><td>a &lt; b &amp; c</td></tr>' AS html FROM g""",
)
def rendered_repositories(spark, sf_dir):
    g = view(spark, sf_dir, "files").groupBy("repo_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("lang")).alias("l"))
    line, row = R.repository(F.col("repo_id"), F.col("n"), F.col("l")), R.html_row(F.col("repo_id"), F.col("n"), F.lit("a < b & c"))
    return g.select(line.alias("line"), F.to_json(F.struct("repo_id", "n")).alias("json"), row.alias("html"))


@query(
    "SNK-07b",
    f"""{_FILES}, {_TYPED}, h AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN 'sym' || doc_id END AS sym, CASE WHEN doc_id % 2 = 0 THEN 'kind' END AS kind, CASE WHEN doc_id % 5 > 0 THEN lang END AS module, CASE WHEN doc_id % 7 > 0 THEN doc_id END AS s, CASE WHEN doc_id % 3 = 0 THEN 200 ELSE 500 END AS most FROM typed)
SELECT doc_id, '### ' || CASE doc_type WHEN 'symbol_index' THEN coalesce(sym, '') || ' (' || coalesce(kind, 'symbol') || ') in ' || file_path || CASE WHEN s > 0 THEN ' [lines ' || s || '-' || s + 4 || ']' ELSE '' END WHEN 'file_index' THEN file_path
 WHEN 'module_summary' THEN 'Module: ' || coalesce(module, file_path) || '/' WHEN 'repo_summary' THEN 'Repository: ' || repo_id WHEN 'spec' THEN 'Spec: ' || coalesce(sym, file_path) WHEN 'document' THEN 'Doc: ' || file_path || ' (' || coalesce(kind, 'doc') || ')' ELSE file_path END
 || chr(10) || '_Repo: ' || repo_id || ' | Score: 0.' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '_' || chr(10) || chr(10) || left(coalesce(content, ''), most) || CASE WHEN length(content) > most THEN '...' ELSE '' END || chr(10) AS block FROM h""",
)
def rendered_hits(spark, sf_dir):
    c, d = F.col, F.col("doc_id")
    start = F.when(d % 7 > 0, d)
    block = R.hit(
        c("doc_type"), c("repo_id"), c("file_path"), F.when(d % 3 > 0, F.concat(F.lit("sym"), d.cast("string"))), F.when(d % 2 == 0, "kind"), F.when(d % 5 > 0, c("lang")), start, start + 4, c("content"), d % 100 / 100, d % 3 == 0
    )
    return _typed(spark, sf_dir).select("doc_id", block.alias("block"))


@query(
    "SNK-07c",
    _FILES
    + """ SELECT doc_id, sha256('## ' || repo_id || '/' || file_path || chr(10) || 'Lines 1-' || least(line_count, 100) || ' of ' || line_count || CASE WHEN line_count > 100 THEN ' (truncated)' ELSE '' END || chr(10) || chr(10) || '```' || lang || chr(10) || array_to_string(string_split(content, chr(10))[1:100], chr(10)) || chr(10) || '```') AS rendered FROM files""",
)
def rendered_files(spark, sf_dir):
    n, first = F.col("line_count"), F.array_join(F.slice(F.split("content", "\n"), 1, 100), "\n")
    shown = R.file_view(F.col("repo_id"), F.col("file_path"), first, F.lit(1), F.least(n, F.lit(100)), n, F.col("lang"), n > 100)
    return view(spark, sf_dir, "files").select("doc_id", F.sha2(shown, 256).alias("rendered"))


@query(
    "SNK-07d",
    """WITH w AS (SELECT item_id, text, list_filter(string_split(text, ' '), lambda x: length(x) > 8) AS s, list_filter(string_split(text, ' '), lambda x: length(x) < 3) AS g FROM benchmark),
b AS (SELECT *, array_to_string(list_transform(s[1:5], lambda x: '- ' || x), chr(10)) AS sources, array_to_string(list_transform(g, lambda x: '- ' || x), chr(10)) AS gaps, chr(10) || chr(10) AS gap FROM w)
SELECT item_id, text || CASE WHEN len(s) > 0 THEN gap || '**Sources:**' || chr(10) || sources ELSE '' END || CASE WHEN len(g) > 0 THEN gap || '**Gaps identified:**' || chr(10) || gaps ELSE '' END AS answer,
 text || CASE WHEN len(g) > 0 THEN gap || '**Gaps (need more input):**' || chr(10) || gaps ELSE '' END || CASE WHEN len(s) > 0 THEN gap || '**Sources:**' || chr(10) || sources ELSE '' END || CASE WHEN item_id % 2 = 0 THEN gap || '_Intent: how_' ELSE '' END AS proposal FROM b""",
)
def rendered_answers(spark, sf_dir):
    words = F.split("text", " ")
    s, g = F.filter(words, lambda x: F.length(x) > 8), F.filter(words, lambda x: F.length(x) < 3)
    draft = R.proposal(F.col("text"), s, g, F.when(F.col("item_id") % 2 == 0, "how"))
    return table(spark, sf_dir, "benchmark").select("item_id", R.answer(F.col("text"), s, g).alias("answer"), draft.alias("proposal"))


@query(
    "SNK-07e",
    ctes("edges")
    + """, n AS (SELECT provider AS v, list_sort(list('m' || consumer)) AS l FROM edges GROUP BY 1), d AS (SELECT v, l, (SELECT count(*) FROM edges WHERE consumer = v) AS o, array_to_string(list_transform(l[1:15], lambda x: '  - ' || x), chr(10)) AS b15, array_to_string(list_transform(l[1:10], lambda x: '  - ' || x), chr(10)) AS b10 FROM n)
SELECT v, concat_ws(chr(10), '## Criticality: m' || v, '', '**Repo:** r', '**Score:** 0.500000 (percentile: 7)', '**In-degree:** ' || len(l) || ' (modules depend on this)', '**Out-degree:** ' || o || ' (modules this depends on)', CASE WHEN v % 2 = 0 THEN '**Type:** Test module' END, '', '**Direct dependents (' || len(l) || '):**', b15, CASE WHEN len(l) > 15 THEN '  - ... and ' || len(l) - 15 || ' more' END) AS card,
 CASE WHEN v % 3 = 0 THEN 'No dependency graph found for cluster ''c''. Run all tests.' ELSE concat_ws(chr(10), '## Affected Tests for c', '', '**Changed modules:** 1', '  - m' || v, '', '**Affected modules:** ' || len(l), b10, CASE WHEN len(l) > 10 THEN '  - ... and ' || len(l) - 10 || ' more' END, '', '**No test modules affected**') END AS tests FROM d""",
)
def rendered_cards(spark, sf_dir):
    e, v = view(spark, sf_dir, "edges"), F.col("v")
    into = e.groupBy(F.col("provider").alias("v")).agg(F.sort_array(F.collect_list(F.concat(F.lit("m"), F.col("consumer").cast("string")))).alias("l"))
    both = into.join(e.groupBy(F.col("consumer").alias("v")).agg(F.count("*").alias("o")), "v", "left").fillna(0, ["o"])
    name, none = F.concat(F.lit("m"), v.cast("string")), F.array().cast("array<string>")
    card = R.criticality(name, F.lit("r"), F.lit(0.5), F.lit(7), F.size("l"), F.col("o"), v % 2 == 0, F.col("l"))
    return both.select("v", card.alias("card"), R.affected_tests(F.lit("c"), F.array(name), F.col("l"), none, v % 3 != 0).alias("tests"))


@query("WIN-01", _VERSIONS + f" SELECT doc_key, document_id FROM (SELECT *, {_NEWEST} AS r FROM versions) WHERE r = 1")
def newest(spark, sf_dir):
    return V.newest_per_key(view(spark, sf_dir, "versions"), ["doc_key"]).select("doc_key", "document_id")


@query("WIN-02", _VERSIONS + f" SELECT doc_key, document_id FROM (SELECT *, {_NEWEST} AS r FROM versions) WHERE r > 1")
def older(spark, sf_dir):
    return V.superseded(view(spark, sf_dir, "versions"), ["doc_key"]).select("doc_key", "document_id")


@query("WIN-03", _SYMBOLS + " SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY repo_id, file_path, symbol_name) AS n FROM symbols")
def name_counts(spark, sf_dir):
    w = Window.partitionBy("repo_id", "file_path", "symbol_name")
    return view(spark, sf_dir, "symbols").select("l_orderkey", "l_linenumber", F.count("*").over(w).alias("n"))


@query("WIN-04", "SELECT p_partkey, cast(floor(100 * (1 - (rank() OVER (ORDER BY p_size DESC) - 1) / (count(*) OVER ()))) AS bigint) AS percentile FROM part")
def percentiles(spark, sf_dir):
    from quern.operators.graph import with_percentiles

    return with_percentiles(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "percentile")


@query(
    "WIN-05",
    _VERSIONS
    + f""", f AS (SELECT *, status = 'O' AS live, max(CASE WHEN status = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key) AS any_live, {_NEWEST} AS r FROM versions)
SELECT document_id FROM f WHERE live OR (any_live = 0 AND r = 1)""",
)
def live_generation(spark, sf_dir):
    v = view(spark, sf_dir, "versions")
    live = F.col("status") == "O"
    f = v.withColumn("any_live", F.max(live.cast("int")).over(Window.partitionBy("doc_key")))
    fallback = V.newest_per_key(f.filter("any_live = 0"), ["doc_key"])
    return f.filter(live).select("document_id").union(fallback.select("document_id"))


@query("WIN-06", _VERSIONS + f" SELECT doc_key % 100 AS identity, max_by(document_id, {_STAMP} || lpad(cast(document_id AS varchar), 12, '0')) AS winner FROM versions GROUP BY 1")
def generation_winners(spark, sf_dir):
    v = view(spark, sf_dir, "versions").withColumn("identity", F.col("doc_key") % 100)
    return V.newest_per_key(v, ["identity"]).select("identity", F.col("document_id").alias("winner"))


@query("WIN-07", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS current FROM events GROUP BY ALL")
def current_verdicts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("current"))


@query("WIN-08", "SELECT o_custkey, 1.0 / min(p) AS reciprocal FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders) WHERE o_orderstatus = 'F' GROUP BY 1")
def reciprocal_ranks(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("p", F.row_number().over(w))
    return o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg((1.0 / F.min("p")).alias("reciprocal"))


@query("WIN-09", "SELECT o_custkey, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_k_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("o_custkey", "o_orderkey", "r")


@query(
    "WIN-10",
    """SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'system' THEN turn END IGNORE NULLS) OVER w, -1) AS h1, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w, -1) AS h2
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def header_stack(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    last = lambda role: F.coalesce(F.last(F.when(F.col("role") == role, F.col("turn")), ignorenulls=True).over(w), F.lit(-1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", last("system").alias("h1"), last("user").alias("h2"))


@query("WIN-11", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS average_rank FROM part")
def average_ranks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    c = p.groupBy("p_size").agg(F.count("*").alias("c"))
    below = F.coalesce(F.sum("c").over(Window.orderBy("p_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return p.join(c.withColumn("below", below), "p_size").select("p_partkey", (F.col("below") + 1 + (F.col("c") - 1) / 2.0).alias("average_rank"))


@query("WIN-12", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(cast(doc_id AS varchar))) AS r FROM documents) WHERE r <= 5")
def capped_sample(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.sha2(F.col("doc_id").cast("string"), 256))
    return table(spark, sf_dir, "documents").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("doc_id")


@query("JOIN-01", "SELECT h.doc_id, d.lang FROM (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_quantity > 45) h JOIN documents d ON h.doc_id = d.doc_id")
def hits_to_documents(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("doc_id")).distinct()
    return h.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query(
    "JOIN-02",
    _FILES + """ SELECT f.doc_id, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'N') AS n_n, count(*) FILTER (l_returnflag = 'R') AS n_r FROM files f LEFT JOIN lineitem ON l_orderkey = f.doc_id * 5 GROUP BY 1""",
)
def files_with_counts(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).pivot("l_returnflag", ["A", "N", "R"]).count()
    f = view(spark, sf_dir, "files").withColumn("k", F.col("doc_id") * 5)
    return f.join(n, "k", "left").fillna(0, ["A", "N", "R"]).select("doc_id", F.col("A").alias("n_a"), F.col("N").alias("n_n"), F.col("R").alias("n_r"))


@query("JOIN-03", _FILES + f" SELECT doc_id FROM files WHERE {_DIR} NOT IN (SELECT {_DIR} FROM files WHERE lang = 'en')")
def orphan_files(spark, sf_dir):
    f = view(spark, sf_dir, "files").withColumn("d", paths.dirname(F.col("file_path")))
    return f.join(f.filter("lang = 'en'").select("d").distinct(), "d", "left_anti").select("doc_id")


@query("JOIN-04", _FILES + " SELECT f.doc_id, l.doc_id IS NOT NULL AS indexed, l.k AS indexed_as FROM files f LEFT JOIN (SELECT doc_id, min(quality) AS k FROM labels WHERE quality IS NOT NULL GROUP BY 1) l ON f.doc_id = l.doc_id WHERE f.doc_id % 2 = 0 AND l.doc_id IS NOT NULL")
def indexed_entries(spark, sf_dir):
    f = view(spark, sf_dir, "files").filter("doc_id % 2 = 0")
    first = table(spark, sf_dir, "labels").filter("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("indexed_as"))
    return f.join(first, "doc_id", "left").withColumn("indexed", F.col("indexed_as").isNotNull()).filter("indexed").select("doc_id", "indexed", "indexed_as")


@query("JOIN-05", "SELECT d.doc_id, l.doc_id IS NOT NULL AS has_summary FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def summary_flags(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has_summary")).distinct()  # noqa: E741
    return table(spark, sf_dir, "documents").join(l, "doc_id", "left").select("doc_id", F.coalesce("has_summary", F.lit(False)).alias("has_summary"))


@query("JOIN-06", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unjudged(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query(
    "JOIN-07",
    """WITH a AS (SELECT doc_id AS target, doc_id + 300 AS seen, CASE WHEN toxic = 1 THEN NULL ELSE left(sha256(cast(doc_id % 3 AS varchar)), 16) END AS judged FROM labels)
SELECT target, CASE WHEN d.doc_id IS NULL THEN 'target_missing' WHEN judged IS NULL THEN 'unknown' WHEN judged = left(sha256(cast(d.n_chars % 3 AS varchar)), 16) THEN 'current' ELSE 'content_changed' END AS state FROM a LEFT JOIN documents d ON a.seen = d.doc_id""",
)
def annotation_states(spark, sf_dir):
    three = lambda c: F.substring(F.sha2((F.col(c) % 3).cast("string"), 256), 1, 16)
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("target"), (F.col("doc_id") + 300).alias("seen"), F.when(F.col("toxic") == 1, None).otherwise(three("doc_id")).alias("judged"))
    j = a.join(table(spark, sf_dir, "documents"), F.col("seen") == F.col("doc_id"), "left")
    s = F.when(F.col("doc_id").isNull(), "target_missing").when(F.col("judged").isNull(), "unknown").when(F.col("judged") == three("n_chars"), "current")
    return j.select("target", s.otherwise("content_changed").alias("state"))


@query("JOIN-08", "SELECT v.o_orderkey FROM orders v JOIN (SELECT o_custkey, max(o_orderkey) AS head FROM orders GROUP BY 1) c ON v.o_custkey = c.o_custkey WHERE v.o_orderkey <> c.head")
def orphan_summaries(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("head")), "o_custkey").filter("o_orderkey <> head").select("o_orderkey")


@query("JOIN-09", "SELECT 'new' AS state, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'process', c_custkey FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def repo_sets(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti").select(F.lit("new").alias("state"), "c_custkey").union(c.intersect(o).select(F.lit("process").alias("state"), "c_custkey"))


@query(
    "JOIN-10",
    _SYMBOLS + """ SELECT w.l_orderkey, w.l_linenumber, h.salvaged FROM symbols w LEFT JOIN (SELECT symbol_name, symbol_type, max(l_orderkey) AS salvaged FROM symbols WHERE l_orderkey % 2 = 0 GROUP BY ALL) h
  ON w.symbol_name = h.symbol_name AND w.symbol_type = h.symbol_type WHERE w.l_orderkey % 2 = 1 AND h.salvaged IS NOT NULL""",
)
def salvaged_symbols(spark, sf_dir):
    s = view(spark, sf_dir, "symbols")
    h = s.filter("l_orderkey % 2 = 0").groupBy("symbol_name", "symbol_type").agg(F.max("l_orderkey").alias("salvaged"))
    return s.filter("l_orderkey % 2 = 1").join(h, ["symbol_name", "symbol_type"]).select("l_orderkey", "l_linenumber", "salvaged")


@query(
    "JOIN-11",
    """WITH e AS (SELECT *, substr(sha256(cast(vec_id AS varchar)), 1, 1) AS bucket, sha256(cast(vec_id AS varchar)) AS h FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, vec_id) AS r, count(*) OVER (PARTITION BY bucket) AS n FROM e)
SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM r a JOIN r b ON a.bucket = b.bucket AND b.r = a.r % a.n + 1""",
)
def random_pairs(spark, sf_dir):
    """Each with the next by hash in its bucket of the hash, so that no window runs over all rows."""
    from quern.functions.vectors import dot

    h = F.sha2(F.col("vec_id").cast("string"), 256)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.substring(h, 1, 1).alias("bucket"), h.alias("h"))
    w = Window.partitionBy("bucket").orderBy("h", "vec_id")
    head = F.first(F.struct("vec_id", "embedding")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    j = e.select("vec_id", "embedding", F.coalesce(F.lead(F.struct("vec_id", "embedding")).over(w), head).alias("o"))
    return j.select("vec_id", F.col("o.vec_id").alias("other"), F.round(dot(F.col("embedding"), F.col("o.embedding")), 6).alias("score"))


_REGISTRY = [(0, "spam", "junk"), (1, "www.", "web"), (2, "example.net", "net"), (3, "example", "any")]


@query("JOIN-12", "SELECT page_id, min_by(repo, o) AS repo FROM pages JOIN (VALUES (0, 'spam', 'junk'), (1, 'www.', 'web'), (2, 'example.net', 'net'), (3, 'example', 'any')) r(o, marker, repo) ON contains(url, marker) GROUP BY 1")
def first_marker(spark, sf_dir):
    """The registry is a short list in the code, so it becomes one expression."""
    out = F.lit(None).cast("string")
    for _, marker, repo in reversed(_REGISTRY):
        out = F.when(F.col("url").contains(marker), repo).otherwise(out)
    return table(spark, sf_dir, "pages").select("page_id", out.alias("repo")).filter("repo IS NOT NULL")


@query(
    "JOIN-13",
    """WITH c AS (SELECT c_custkey, 'x/' || c_mktsegment || '/m' || cast(c_custkey % 50 AS varchar) || '.py' AS file FROM customer),
g AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 2 = 0 THEN 'x/BUILDING/m' ELSE 'm' END || cast(s_suppkey % 60 AS varchar) || '.py' AS path, s_suppkey AS ordinal FROM supplier),
f AS (SELECT DISTINCT file FROM c), m AS (SELECT file, node, CASE WHEN file = path THEN 0 ELSE 1 END AS stage, ordinal FROM f JOIN g ON ends_with(file, path) OR ends_with(path, file))
SELECT file, min_by(node, stage * 1000000 + ordinal) AS node FROM m GROUP BY 1""",
)
def changed_to_nodes(spark, sf_dir):
    from quern.operators.graph import matched_nodes

    n = lambda c, k: (F.col(c) % k).cast("string")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("x/"), "c_mktsegment", F.lit("/m"), n("c_custkey", 50), F.lit(".py")).alias("file")).distinct()
    head = F.when(F.col("s_suppkey") % 2 == 0, "x/BUILDING/m").otherwise("m")
    g = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.concat(head, n("s_suppkey", 60), F.lit(".py")).alias("path"), F.lit("no.module").alias("module"), F.col("s_suppkey").alias("ordinal"))
    return matched_nodes(c, g)


@query("JOIN-14", "SELECT q.vec_id AS query_id, count(*) AS n, round(max(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS best FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1")
def all_pairs_similarity(spark, sf_dir):
    """Pairs are counted by ids, the best one is found by products of blocks."""
    from quern.operators.retrieval import nearest

    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    best = nearest(q, e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("type"), F.col("embedding").alias("vec")), 1)
    same = q.groupBy("query_id").agg(F.count("*").alias("copies"))
    n = F.col("copies") * (F.col("all") - F.col("copies"))
    j = same.crossJoin(F.broadcast(e.agg(F.count("vec_id").alias("all")))).select("query_id", n.alias("n")).filter("n > 0")
    return j.join(best.select("query_id", F.col("score").alias("best")), "query_id", "left")


@query("JOIN-15", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text), lang) AS family, count(*) OVER (PARTITION BY sha256(text), lang) AS copies FROM documents QUALIFY copies > 1")
def ported_copies(spark, sf_dir):
    """Class and number of copies of each document that has any; classes, not pairs, so that many equal texts cost no more rows."""
    h = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    many = h.groupBy("lang", "h").agg(F.min("doc_id").alias("family"), F.count("*").alias("copies")).filter("copies > 1")
    return h.join(many, ["lang", "h"]).select("doc_id", "family", "copies")


@query("SET-01", "SELECT vec_id FROM embeddings WHERE label = 1 UNION ALL SELECT vec_id FROM embeddings WHERE label IN (1, 2)")
def concatenated_hits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.filter("label = 1").select("vec_id").unionByName(e.filter("label IN (1, 2)").select("vec_id"))


@query("SET-02", "SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1")
def first_arrivals(spark, sf_dir):
    return V.first_seen(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first"))


@query("SET-03", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def dead_children(spark, sf_dir):
    live = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(live, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query(
    "SET-04",
    "SELECT coalesce(w.k, h.k) AS k, CASE WHEN h.k IS NULL THEN 'missing' WHEN w.k IS NULL THEN 'superseded' ELSE 'kept' END AS state FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0) w FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0) h ON w.k = h.k",
)
def reconciled(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return V.reconcile(o.filter("k % 3 <> 0"), o.filter("k % 2 = 0"), "k")


_SHINGLES = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))"


@query(
    "SET-05",
    f"""WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), s AS (SELECT item_id, {_SHINGLES} AS s FROM w)
SELECT a.item_id, b.item_id AS other, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS jaccard FROM s a JOIN s b ON b.item_id = a.item_id + 1 WHERE len(a.s) + len(b.s) > 0""",
)
def shingle_jaccard(spark, sf_dir):
    from quern.operators.evaluation import jaccard, word_shingles

    s = table(spark, sf_dir, "benchmark").select("item_id", word_shingles(F.split("text", " "), 5).alias("s"))
    b = s.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("s").alias("t"))
    return s.join(b, "item_id").select("item_id", "other", F.round(jaccard(F.col("s"), F.col("t")), 6).alias("jaccard")).filter("jaccard IS NOT NULL")


_UP = f"unnest(list_transform(range(1, len(string_split({_DIR}, '/')) + 1), lambda i: array_to_string(string_split({_DIR}, '/')[1:i], '/')))"


@query("SET-06", _FILES + f" SELECT DISTINCT repo_id, folder FROM (SELECT repo_id, '' AS folder FROM files UNION ALL SELECT repo_id, {_UP} AS folder FROM files WHERE {_DIR} <> '')")
def affected_modules(spark, sf_dir):
    f = view(spark, sf_dir, "files").withColumn("d", paths.dirname(F.col("file_path")))
    up = F.concat(F.array(F.lit("")), paths.ancestors(F.col("d")))
    return f.select("repo_id", F.explode(up).alias("folder")).distinct()


@query("SET-07", _FILES + f" SELECT DISTINCT repo_id, {_UP} AS folder FROM files WHERE {_DIR} <> ''")
def folder_closure(spark, sf_dir):
    from quern.operators.hierarchy import folders

    return folders(view(spark, sf_dir, "files")).filter("folder <> ''")


@query("TOP-01", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]), 6) AS score FROM embeddings WHERE vec_id <> 7 ORDER BY score DESC, vec_id LIMIT 10")
def global_top_k(spark, sf_dir):
    from quern.functions.vectors import dot

    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 7").select(F.col("embedding").alias("q"))
    s = e.filter("vec_id <> 7").crossJoin(F.broadcast(q)).select("vec_id", F.round(dot(F.col("q"), F.col("embedding")), 6).alias("score"))
    return s.orderBy(F.desc("score"), "vec_id").limit(10)


@query("TOP-02", _FILES + f" SELECT DISTINCT {_DIR} AS folder, CASE WHEN {_DIR} = '' THEN 0 ELSE len(string_split({_DIR}, '/')) END AS depth FROM files ORDER BY depth DESC, folder")
def deepest_first(spark, sf_dir):
    d = view(spark, sf_dir, "files").select(paths.dirname(F.col("file_path")).alias("folder")).distinct()
    return d.withColumn("depth", paths.depth(F.col("folder")).cast("bigint")).orderBy(F.desc("depth"), "folder")


_KEYS = "['models.py','views.py','urls.py','index.ts','index.js','main.py','api.py','routes.py','handlers.py','config.py','settings.py','__init__.py']"


@query(
    "TOP-03",
    _FILES
    + f""", u AS (SELECT repo_id, file_path, max(line_count) AS l, list_position({_KEYS}, {_BASE}) AS k FROM files GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, {_DIR} ORDER BY CASE WHEN k > 0 THEN 0 ELSE 1 END, CASE WHEN k > 0 THEN k ELSE -l END, file_path) AS r FROM u WHERE k > 0 OR l > 200)
SELECT repo_id, {_DIR} AS module_path, string_agg(file_path, ',' ORDER BY r) AS key_files FROM r WHERE r <= 10 GROUP BY ALL""",
)
def key_files(spark, sf_dir):
    from quern.operators.hierarchy import key_files as top

    return top(view(spark, sf_dir, "files")).select("repo_id", "module_path", F.array_join("key_files", ",").alias("key_files"))


@query("TOP-05", "SELECT source, array_to_string(list_sort(list(doc_id))[1:5], ',') AS first FROM documents GROUP BY 1")
def sliced_lists(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("m"))
    w = Window.partitionBy("source").orderBy("doc_id")
    five = table(spark, sf_dir, "documents").select("source", "doc_id").withColumn("r", F.row_number().over(w)).filter("r <= 5")
    return g.select("source").join(five.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("first")), "source")


@query("TOP-06", _FILES + f" SELECT DISTINCT file_path AS entry, file_path LIKE '%/%' AS is_dir FROM files WHERE NOT starts_with({_BASE}, '.') ORDER BY is_dir DESC, entry")
def directory_listing(spark, sf_dir):
    f = view(spark, sf_dir, "files").filter(~paths.basename(F.col("file_path")).startswith("."))
    return f.select(F.col("file_path").alias("entry"), F.col("file_path").contains("/").alias("is_dir")).distinct().orderBy(F.desc("is_dir"), "entry")


@query(
    "TOP-07",
    """WITH a AS (SELECT 1 AS query_id, o_custkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, 0 AS source FROM orders QUALIFY rank <= 15),
b AS (SELECT 1 AS query_id, o_custkey AS id, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank, 1 AS source FROM orders QUALIFY rank <= 15),
f AS (SELECT query_id, id, min((rank, source)) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS rank FROM f""",
)
def merged_lists(spark, sf_dir):
    from quern.operators.retrieval import round_robin

    o = table(spark, sf_dir, "orders")

    def best(*order):
        top = o.orderBy(*order).limit(15)
        return top.select(F.lit(1).alias("query_id"), F.col("o_custkey").alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))

    return round_robin(best(F.desc("o_totalprice"), "o_orderkey"), best("o_totalprice", "o_orderkey"))
