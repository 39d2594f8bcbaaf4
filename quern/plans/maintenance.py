"""Hierarchy, incremental maintenance and data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import ids, paths
from quern.operators import hierarchy as H
from quern.operators import incremental as I
from quern.operators import versions as V
from quern.plans.registry import query
from quern.plans.scalars import _CUT
from quern.sources.tables import ctes, table, view

_FILES, _SYMBOLS, _VERSIONS, _COMMITS = ctes("files"), ctes("symbols"), ctes("versions"), ctes("commits")
_DIR = "regexp_extract(file_path, '^(.*)/[^/]*$', 1)"
_BASE = "regexp_extract(file_path, '([^/]*)$', 1)"
_UP = f"unnest(list_transform(range(1, len(string_split({_DIR}, '/')) + 1), lambda i: array_to_string(string_split({_DIR}, '/')[1:i], '/')))"
_FOLDERS = f"fo AS (SELECT DISTINCT repo_id, folder AS module_path FROM (SELECT repo_id, {_DIR} AS folder FROM files UNION ALL SELECT repo_id, {_UP} FROM files WHERE {_DIR} <> ''))"
_PARENT = "CASE WHEN module_path <> '' THEN regexp_extract(module_path, '^(.*)/[^/]*$', 1) END"


@query("HIE-01", _FILES + f" SELECT repo_id, {_DIR} AS module_path, count(*) AS n, min(doc_id) AS first FROM files GROUP BY ALL")
def files_by_folder(spark, sf_dir):
    return view(spark, sf_dir, "files").groupBy("repo_id", paths.dirname(F.col("file_path")).alias("module_path")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(
    "HIE-02",
    _FILES
    + f""", {_FOLDERS}, c AS (SELECT repo_id, {_DIR} AS module_path, count(*) AS n FROM files GROUP BY ALL), k AS (SELECT repo_id, {_PARENT} AS module_path, count(*) AS n FROM fo WHERE module_path <> '' GROUP BY ALL)
SELECT fo.repo_id, fo.module_path, CASE WHEN fo.module_path = '' THEN 0 ELSE len(string_split(fo.module_path, '/')) END AS depth, coalesce(c.n, 0) AS file_count, coalesce(k.n, 0) AS n_children
FROM fo LEFT JOIN c ON fo.repo_id = c.repo_id AND fo.module_path = c.module_path LEFT JOIN k ON fo.repo_id = k.repo_id AND fo.module_path = k.module_path""",
)
def module_tree(spark, sf_dir):
    return H.modules(view(spark, sf_dir, "files")).select("repo_id", "module_path", F.col("depth").cast("bigint").alias("depth"), "file_count", "n_children")


@query(
    "HIE-03",
    "SELECT d.doc_id, CASE WHEN quality = 1 THEN 'fresh' WHEN toxic = 0 AND quality = 0 THEN 'carried' ELSE 'fallback' END AS provenance FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def summary_preference(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    fresh, carried = F.when(F.col("quality") == 1, "fresh"), F.when((F.col("toxic") == 0) & (F.col("quality") == 0), "carried")
    return d.select("doc_id", F.coalesce(fresh, carried, F.lit("fallback")).alias("provenance"))


@query(
    "HIE-04",
    _FILES + f""", {_FOLDERS} SELECT repo_id, module_path, sha256('module:' || repo_id || ':' || module_path) AS document_id,
  CASE WHEN coalesce({_PARENT}, '') = '' THEN sha256('repo:' || repo_id) ELSE sha256('module:' || repo_id || ':' || {_PARENT}) END AS parent_id FROM fo""",
)
def module_documents(spark, sf_dir):
    m = H.parent_ids(H.modules(view(spark, sf_dir, "files")))
    return m.select("repo_id", "module_path", ids.module_id(F.col("repo_id"), F.col("module_path")).alias("document_id"), "parent_id")


@query("HIE-05", _FILES + f" SELECT repo_id, {_DIR} AS module_path, string_agg(file_path, ',' ORDER BY file_path) AS children FROM files GROUP BY ALL")
def children_by_path(spark, sf_dir):
    f = view(spark, sf_dir, "files")
    return f.groupBy("repo_id", paths.dirname(F.col("file_path")).alias("module_path")).agg(F.array_join(F.sort_array(F.collect_list("file_path")), ",").alias("children"))


@query("HIE-06", _SYMBOLS + " SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE start_line END AS first, CASE WHEN l_linenumber % 3 = 2 THEN end_line ELSE 0 END AS last FROM symbols")
def rehydrated_lines(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    lines = F.when(n == 0, F.array().cast("array<bigint>")).when(n == 1, F.array("start_line")).otherwise(F.array("start_line", "end_line"))
    s = view(spark, sf_dir, "symbols").withColumn("lines", lines)
    at = lambda i: F.coalesce(F.try_element_at("lines", F.lit(i)), F.lit(0).cast("bigint"))
    return s.select("l_orderkey", "l_linenumber", at(1).alias("first"), at(2).alias("last"))


@query("HIE-07", "SELECT source, min(d.doc_id) AS doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 GROUP BY 1")
def carried_summaries(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id")
    return j.groupBy("source").agg(F.min("doc_id").alias("doc_id"))


_LINE = r"trim(string_split(content, chr(10))[1], chr(9)||chr(11)||chr(12)||chr(13)||' ')"
_PREVIEW = f"CASE WHEN strpos(t, '. ') > 1 AND strpos(t, '. ') <= 160 THEN left(t, strpos(t, '. ')) ELSE {_CUT.format(t='t', n=160)} END"


@query(
    "FN-14",
    _FILES
    + f""", {_FOLDERS}, a AS (SELECT repo_id, {_DIR} AS module_path, file_path, {_BASE} AS name, {_LINE} AS t FROM files),
p AS (SELECT repo_id, module_path, file_path, name, {_PREVIEW} AS preview FROM a),
q AS (SELECT *, row_number() OVER (PARTITION BY repo_id, module_path, lower(preview) ORDER BY file_path, name, preview) AS dup FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, module_path ORDER BY file_path, name, preview) AS i FROM q WHERE preview = '' OR dup = 1),
f AS (SELECT repo_id, module_path, string_agg(chr(10) || '- ' || name || CASE WHEN preview = '' THEN '' ELSE ': ' || preview END, '' ORDER BY i) FILTER (i <= 10) AS body FROM r GROUP BY ALL),
n AS (SELECT repo_id, module_path, count(*) AS n FROM p GROUP BY ALL),
ks AS (SELECT repo_id, {_PARENT} AS parent, module_path, row_number() OVER (PARTITION BY repo_id, {_PARENT} ORDER BY module_path) AS i FROM fo WHERE module_path <> ''),
k AS (SELECT repo_id, parent AS module_path, count(*) AS n, string_agg(chr(10) || '- ' || module_path || '/', '' ORDER BY i) FILTER (i <= 5) AS body FROM ks GROUP BY ALL)
SELECT fo.repo_id, fo.module_path, sha256('Module: ' || CASE WHEN fo.module_path = '' THEN '(root)' ELSE fo.module_path END || '/' || CASE WHEN n.n > 0 THEN chr(10) || chr(10) || 'Files (' || cast(n.n AS varchar) || '):' || f.body ELSE '' END
  || CASE WHEN k.n > 0 THEN chr(10) || chr(10) || 'Submodules (' || cast(k.n AS varchar) || '):' || k.body ELSE '' END) AS summary
FROM fo LEFT JOIN f USING (repo_id, module_path) LEFT JOIN n USING (repo_id, module_path) LEFT JOIN k USING (repo_id, module_path)""",
)
def template_summaries(spark, sf_dir):
    return H.summarized_modules(view(spark, sf_dir, "files")).select("repo_id", "module_path", F.sha2("summary", 256).alias("summary"))


@query(
    "FN-15",
    "SELECT page_id, array_to_string(list_sort(list_filter(["
    + ", ".join(
        "CASE WHEN " + " OR ".join([f"contains(html, '{w}')" for w in words] + [f"contains(lower(url), '{w}')" for w in parts]) + f" THEN '{tag}' END" for tag, (words, parts) in H.TECHNOLOGIES.items()
    )
    + "], lambda x: x IS NOT NULL)), ',') AS tags FROM pages",
)
def technologies(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(H.technologies(F.col("html"), F.col("url"))), ",").alias("tags"))


@query(
    "FN-27",
    "WITH r AS (SELECT nationkey, early, late FROM (SELECT c_nationkey AS nationkey, avg(c_acctbal) FILTER (c_custkey % 2 = 0) AS early, avg(c_acctbal) FILTER (c_custkey % 2 = 1) AS late FROM customer GROUP BY 1)) SELECT nationkey, round(CASE WHEN early = 0 THEN 0 ELSE (late - early) / early END, 4) AS growth FROM r WHERE early IS NOT NULL AND late IS NOT NULL",
)
def growth(spark, sf_dir):
    even = F.col("c_custkey") % 2 == 0
    r = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.avg(F.when(even, F.col("c_acctbal"))).alias("e"), F.avg(F.when(~even, F.col("c_acctbal"))).alias("l"))
    return r.filter("e IS NOT NULL AND l IS NOT NULL").select("nationkey", F.round(F.when(F.col("e") == 0, 0.0).otherwise((F.col("l") - F.col("e")) / F.col("e")), 4).alias("growth"))


@query("FN-26")
def text_ratios(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark")
    b = t.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return t.join(b, "item_id").select("item_id", F.round(I.similarity_ratio("text", "other"), 6).alias("ratio"))


_FACTS = """f AS (SELECT c_custkey, c_custkey % 29 = 0 AS excluded, c_custkey % 31 <> 0 AS fetched, c_custkey % 37 <> 0 AS has_remote, c_custkey % 5 AS local, c_custkey % 5 AS origin, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN c_custkey % 5 ELSE 99 END AS stored,
  c_custkey % 3 AS n_changed, c_custkey % 3 * (c_custkey % 4) AS n_indexable, c_custkey % 11 AS corpus_files FROM customer)"""
_DECISION = """CASE WHEN excluded THEN 'excluded' WHEN NOT fetched THEN 'error' WHEN NOT has_remote OR origin IS NULL THEN 'empty' WHEN stored IS NOT NULL AND local = origin AND origin = stored THEN 'skipped:no_changes'
  WHEN stored IS NULL THEN 'full_reingest:new_repo' WHEN n_changed = 0 THEN 'skipped:no_file_changes' WHEN n_indexable = 0 THEN 'skipped:no_indexable_changes' WHEN corpus_files = 0 THEN 'full_reingest:empty_corpus'
  WHEN n_indexable / corpus_files > 0.5 THEN 'full_reingest:threshold_exceeded' ELSE 'updated' END"""


def _facts(spark, sf_dir):
    k = F.col("c_custkey")
    stored = F.when(k % 7 == 0, None).when(k % 2 == 0, k % 5).otherwise(99)
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        (k % 29 == 0).alias("excluded"),
        (k % 31 != 0).alias("fetched"),
        (k % 37 != 0).alias("has_remote"),
        (k % 5).alias("local"),
        (k % 5).alias("origin"),
        stored.alias("stored"),
        (k % 3).alias("n_changed"),
        (k % 3 * (k % 4)).alias("n_indexable"),
        (k % 11).alias("corpus_files"),
    )


@query("INC-01", f"WITH {_FACTS} SELECT c_custkey, {_DECISION} AS decision FROM f")
def update_decisions(spark, sf_dir):
    return _facts(spark, sf_dir).select("c_custkey", I.decision().alias("decision"))


@query("INC-02", f"WITH {_FACTS} SELECT c_custkey, round(n_indexable / corpus_files, 6) AS share, n_indexable / corpus_files > 0.5 AS rebuild FROM f WHERE corpus_files > 0")
def change_shares(spark, sf_dir):
    share = F.col("n_indexable") / F.col("corpus_files")
    return _facts(spark, sf_dir).filter("corpus_files > 0").select("c_custkey", F.round(share, 6).alias("share"), (share > I.REBUILD_SHARE).alias("rebuild"))


@query("INC-03")
def significance(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark")
    old = F.when(F.col("item_id") % 5 == 0, "").when(F.col("item_id") % 5 == 1, F.col("text")).otherwise(F.concat(F.left("text", F.lit(60)), F.lit(" fix typo")))
    diff = F.when(F.col("item_id") % 2 == 0, "Added a new api").otherwise("fix whitespace")
    return t.select("item_id", I.significant(old, F.col("text"), diff).alias("significant"))


@query("INC-04", "SELECT source, bool_or(n_chars % 5 = 0 OR doc_id % 40 = 0) AS regenerate FROM documents GROUP BY 1")
def regenerations(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.bool_or((F.col("n_chars") % 5 == 0) | (F.col("doc_id") % 40 == 0)).alias("regenerate"))


@query(
    "INC-05",
    f"WITH {_FACTS}, d AS (SELECT c_custkey, origin, {_DECISION} AS d FROM f) SELECT c_custkey, origin AS banked FROM d WHERE (d = 'updated' OR starts_with(d, 'full_reingest') OR d IN ('skipped:no_file_changes', 'skipped:no_indexable_changes')) AND origin IS NOT NULL",
)
def checkpoints(spark, sf_dir):
    d = _facts(spark, sf_dir).withColumn("d", I.decision())
    status, reason = F.substring_index("d", ":", 1), F.when(F.col("d").contains(":"), F.substring_index("d", ":", -1))
    return d.filter(I.bankable(status, F.coalesce(reason, F.lit("")), F.col("origin"))).select("c_custkey", F.col("origin").alias("banked"))


@query("INC-06", "SELECT c_custkey AS repo, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 1000 ELSE c_custkey END AS head FROM customer")
def commits_index(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo"), F.col("c_custkey").alias("head"))
    return V.upsert(old, old.filter("repo % 4 = 0").select("repo", (F.col("head") + 1000).alias("head")), "repo")


_HISTORY = """h AS (SELECT user_id AS repo_id, event_id AS ordinal, event_id AS commit_hash, value > 100 AS indexable FROM events),
r AS (SELECT repo_id, max(CASE WHEN repo_id % 5 = 0 THEN NULL WHEN ordinal % 7 = 0 THEN commit_hash END) AS indexed, CASE WHEN repo_id % 4 = 1 THEN max(commit_hash) WHEN repo_id % 7 = 5 THEN -1 ELSE max(CASE WHEN ordinal % 11 = 0 THEN commit_hash END) END AS corpus, repo_id % 13 <> 4 AS cloned, repo_id % 9 AS files FROM h GROUP BY repo_id)"""


@query(
    "INC-07",
    f"""WITH {_HISTORY}, p AS (SELECT r.*, (SELECT max(commit_hash) FROM h WHERE h.repo_id = r.repo_id) AS head, (SELECT count(*) FROM h WHERE h.repo_id = r.repo_id AND h.commit_hash = r.corpus) AS known,
 (SELECT count(*) FROM h WHERE h.repo_id = r.repo_id AND h.indexable AND h.ordinal > r.corpus AND h.ordinal <= r.indexed) AS missed FROM r WHERE indexed IS DISTINCT FROM corpus)
SELECT repo_id, CASE WHEN files = 0 THEN 'no files' WHEN NOT cloned THEN 'clone missing' WHEN corpus = head THEN 'bank: head' WHEN known = 0 OR indexed IS NULL THEN 'neither' WHEN indexed <= corpus THEN 'bank: index behind' WHEN missed = 0 THEN 'expected' ELSE 'STALE' END AS state FROM p""",
)
def index_states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    h = e.select(F.col("user_id").alias("repo_id"), F.col("event_id").alias("ordinal"), F.col("event_id").alias("commit_hash"), (F.col("value") > 100).alias("indexable"))
    banked = F.when((F.col("repo_id") % 5 != 0) & (F.col("ordinal") % 7 == 0), F.col("commit_hash"))
    r = h.groupBy("repo_id").agg(F.max(banked).alias("indexed"), F.max("commit_hash").alias("last"), F.max(F.when(F.col("ordinal") % 11 == 0, F.col("commit_hash"))).alias("built"))
    corpus = F.when(F.col("repo_id") % 4 == 1, F.col("last")).when(F.col("repo_id") % 7 == 5, -1).otherwise(F.col("built"))
    r = r.select("repo_id", "indexed", corpus.alias("corpus"), (F.col("repo_id") % 13 != 4).alias("cloned"), (F.col("repo_id") % 9).alias("files"))
    return I.index_states(r, h)


@query(
    "INC-08",
    """WITH f AS (SELECT d.doc_id, CASE WHEN d.doc_id % 9 <> 0 THEN text END AS summary, CASE WHEN d.doc_id % 2 = 0 THEN lang END AS readme, quality, o_orderdate AS checked, d.doc_id % 10 = 3 AS odd FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN orders o ON d.doc_id = o_orderkey),
g AS (SELECT *, left(sha256(left(summary, 1000) || '|' || left(coalesce(readme, ''), 1000)), 16) AS h FROM f), s AS (SELECT *, CASE WHEN quality = 1 THEN h WHEN quality = 0 THEN 'old' END AS stored FROM g)
SELECT doc_id, CASE WHEN summary IS NULL THEN 'skipped' WHEN stored = h AND NOT odd AND checked + INTERVAL 7 DAY > TIMESTAMP '1998-01-01' THEN 'snoozed' WHEN stored = h THEN 'skipped' ELSE 'updated' END AS action FROM s""",
)
def refresh_decisions(spark, sf_dir):
    d, c = table(spark, sf_dir, "documents"), F.col
    d = d.select("doc_id", F.when(c("doc_id") % 9 != 0, c("text")).alias("summary"), F.when(c("doc_id") % 2 == 0, c("lang")).alias("readme"))
    checked = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"))
    j = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").join(checked, "doc_id", "left")
    stored = F.when(c("quality") == 1, ids.input_hash(c("summary"), F.coalesce("readme", F.lit("")))).when(c("quality") == 0, "old")
    facts = j.withColumn("stored_hash", stored).withColumn("last_checked", F.when(c("doc_id") % 10 == 3, "soon").otherwise(c("stamp")))
    return facts.select("doc_id", I.brief_decision(F.lit("1998-01-01").cast("timestamp")).alias("action"))


@query(
    "INC-09",
    _SYMBOLS + """, h AS (SELECT DISTINCT file_path, symbol_name FROM symbols), w AS (SELECT * FROM h WHERE length(symbol_name) % 2 = 0), s AS (SELECT h.*, w.symbol_name IS NULL AS doomed, count(w.symbol_name) OVER (PARTITION BY h.file_path) AS alive FROM h LEFT JOIN w ON h.file_path = w.file_path AND h.symbol_name = w.symbol_name)
SELECT file_path, symbol_name FROM s WHERE NOT doomed OR alive = 0""",
)
def symbol_reconciliation(spark, sf_dir):
    h = view(spark, sf_dir, "symbols").select("file_path", "symbol_name", F.concat_ws(":", "file_path", "symbol_name").alias("id")).distinct()
    return V.guarded_delete(h, h.filter("length(symbol_name) % 2 = 1").select("id"), "file_path", "id").select("file_path", "symbol_name")


@query(
    "INC-10",
    _VERSIONS + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_key % 50 ORDER BY coalesce(cast(created_at AS varchar), '') DESC, document_id DESC) AS r, doc_key % 50 AS identity FROM versions)
SELECT document_id, sha256('file:' || cast(identity AS varchar)) AS new_id, CASE WHEN r = 1 THEN 'survives' ELSE 'deleted' END AS fate FROM r""",
)
def id_migration(spark, sf_dir):
    v = view(spark, sf_dir, "versions").withColumn("identity", F.col("doc_key") % 50)
    new = lambda df, fate: df.select("document_id", ids.hashed("file", F.col("identity")).alias("new_id"), F.lit(fate).alias("fate"))
    return new(V.newest_per_key(v, ["identity"]), "survives").union(new(V.superseded(v, ["identity"]), "deleted"))


@query("INC-11", "SELECT o_orderkey, coalesce(m.new, o.o_custkey) AS parent FROM orders o LEFT JOIN (SELECT c_custkey AS old, c_custkey + 5000 AS new FROM customer WHERE c_custkey % 6 = 0) m ON o.o_custkey = m.old")
def remapped_parents(spark, sf_dir):
    m = table(spark, sf_dir, "customer").filter("c_custkey % 6 = 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") + 5000).alias("new"))
    return table(spark, sf_dir, "orders").join(m, "o_custkey", "left").select("o_orderkey", F.coalesce("new", "o_custkey").alias("parent"))


@query(
    "INC-12",
    """WITH d AS (SELECT user_id AS repo_id, CASE event_type WHEN 'signup' THEN 'repo_summary' WHEN 'error' THEN 'symbol_index' ELSE 'file_index' END AS type, sha256(event_type) AS commit_hash FROM events),
i AS (SELECT c_custkey AS repo_id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS commit_hash FROM customer WHERE c_custkey % 3 = 0),
m AS (SELECT repo_id, count(*) FILTER (type = 'file_index') AS files, min(commit_hash) FILTER (type = 'repo_summary') AS summary FROM d GROUP BY 1)
SELECT repo_id, coalesce(files, 0) AS files, coalesce(i.commit_hash, summary) AS stored FROM m FULL JOIN (SELECT * FROM i WHERE commit_hash <> '') i USING (repo_id) WHERE repo_id NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 = 1)""",
)
def repo_lookups(spark, sf_dir):
    c = F.col
    kind = F.when(c("event_type") == "signup", "repo_summary").when(c("event_type") == "error", "symbol_index").otherwise("file_index")
    docs = table(spark, sf_dir, "events").select(c("user_id").alias("repo_id"), kind.alias("type"), F.sha2("event_type", 256).alias("commit_hash"))
    index = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(c("c_custkey").alias("repo_id"), F.when(c("c_custkey") % 4 == 0, "").otherwise(c("c_name")).alias("commit_hash"))
    excluded = table(spark, sf_dir, "nation").filter("n_nationkey % 5 = 1").select(c("n_nationkey").cast("bigint").alias("repo_id"))
    return I.repository_facts(docs, index, excluded)


@query("INC-14")
def breaker_outcomes(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("service"), F.col("event_id").alias("ordinal"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").isin("error", "view", "click").alias("fails"))
    return I.breaker_outcomes(calls.withColumn("at", F.col("us") / 1e6), reset=86400.0)


@query("INC-15", "SELECT doc_id, sha256(lang || ': ' || left(text, 8000)) AS embedded FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def reembed_page(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("doc_id > 100").orderBy("doc_id").limit(50)
    return d.select("doc_id", F.sha2(F.concat("lang", F.lit(": "), F.left("text", F.lit(8000))), 256).alias("embedded"))


@query("INC-15b", "SELECT vec_id // 20 AS page, 64 AS dims, count(*) AS n FROM embeddings GROUP BY 1 HAVING max(CASE WHEN vec_id % 29 = 0 OR vec_id % 31 = 0 THEN 1 ELSE 0 END) = 0")
def published_manifests(spark, sf_dir):
    """Pages of 20 vectors; every 29th vector failed, and every 31st is short."""
    i, v = F.col("vec_id"), F.col("embedding")
    e = table(spark, sf_dir, "embeddings").select(F.floor(i / 20).alias("page"), F.when(i % 31 == 0, F.slice(v, 1, 8)).when(i % 29 != 0, v).alias("embedding"))
    return I.published_manifests(e, "page")


@query("INC-16", _FILES + f", {_FOLDERS} SELECT repo_id, module_path, CASE WHEN module_path = '' THEN 0 ELSE len(string_split(module_path, '/')) END AS depth FROM fo WHERE length(module_path) % 2 = 1 ORDER BY depth DESC, repo_id, module_path")
def backfill_order(spark, sf_dir):
    m = H.modules(view(spark, sf_dir, "files")).filter("length(module_path) % 2 = 1")
    return m.select("repo_id", "module_path", F.col("depth").cast("bigint").alias("depth")).orderBy(F.desc("depth"), "repo_id", "module_path")


@query("SRC-07b", "SELECT coalesce(a.o_custkey, b.o_custkey) AS key, CASE WHEN a.o_custkey IS NULL THEN 'A' WHEN b.o_custkey IS NULL THEN 'D' ELSE 'M' END AS change FROM (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1) a FULL JOIN (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' GROUP BY 1) b ON a.o_custkey = b.o_custkey WHERE a.v IS DISTINCT FROM b.v")
def change_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    last = lambda df: df.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("v"))
    return I.change_set(last(o.filter(F.col("o_orderdate") < stamp("1997-01-01"))), last(o.filter(F.col("o_orderdate") >= stamp("1996-06-01"))), "key", "v")


@query("DQ-01", "SELECT l.doc_id, source, quality AS verdict FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality IS NOT NULL ORDER BY l.doc_id DESC LIMIT 200")
def annotations(spark, sf_dir):
    j = table(spark, sf_dir, "labels").filter("quality IS NOT NULL").join(table(spark, sf_dir, "documents"), "doc_id")
    return j.orderBy(F.desc("doc_id")).limit(200).select("doc_id", "source", F.col("quality").alias("verdict"))


@query("DQ-02", "SELECT doc_id FROM documents WHERE doc_id > 20 AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 20")
def unjudged_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("doc_id > 20").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return d.orderBy("doc_id").limit(20).select("doc_id")


_SUFFIX = r"regexp_extract(file_path, '[^/](\.[^./]+)$', 1)"


@query("DQ-03", _FILES + f" SELECT {_SUFFIX} AS suffix, count(*) AS n, bool_and({_SUFFIX} IN ('.py', '.ts', '.js', '.java')) AS recoverable FROM files GROUP BY 1")
def language_repair(spark, sf_dir):
    p = F.col("file_path")
    return view(spark, sf_dir, "files").groupBy(paths.suffix(p).alias("suffix")).agg(F.count("*").alias("n"), F.bool_and(paths.parser_language(p).isNotNull()).alias("recoverable"))


@query(
    "DQ-04",
    """WITH u AS (SELECT min(doc_id) AS doc_id, source, lang FROM documents WHERE trim(text) <> '' GROUP BY source, lang, sha256(text)),
r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('7:' || cast(doc_id AS varchar))) AS r, count(*) OVER (PARTITION BY source, lang) AS n FROM u)
SELECT doc_id, CASE WHEN n > 2 AND r <= least(greatest(1, cast(floor(n * 0.1) AS bigint)), n - 1) THEN 'valid' ELSE 'train' END AS split FROM r""",
)
def stratified_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.trim("text") != "")
    u = d.groupBy("source", "lang", F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"))
    w = Window.partitionBy("source", "lang")
    r = F.row_number().over(w.orderBy(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256)))
    u = u.withColumn("r", r).withColumn("n", F.count("*").over(w))
    valid = (F.col("n") > 2) & (F.col("r") <= F.least(F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)), F.col("n") - 1))
    return u.select("doc_id", F.when(valid, "valid").otherwise("train").alias("split"))


@query("DQ-05", "SELECT doc_id FROM documents WHERE n_chars BETWEEN 500 AND 4000 ORDER BY sha256('11:' || cast(doc_id AS varchar)) LIMIT 20")
def evaluation_pick(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("n_chars BETWEEN 500 AND 4000")
    return d.orderBy(F.sha2(F.concat(F.lit("11:"), F.col("doc_id").cast("string")), 256)).limit(20).select("doc_id")
