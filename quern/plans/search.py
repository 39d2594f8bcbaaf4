"""Retrieval, evaluation and graph queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors
from quern.operators import evaluation as E
from quern.operators import graph as G
from quern.operators import retrieval as R
from quern.plans.registry import query
from quern.sources.tables import ctes, table, view

_EDGES, _FILES = ctes("edges"), ctes("files")
_DOT = "round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"


def _queries(spark, sf_dir):
    """Every vector whose id is divisible by 50 asks, against all."""
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("type"), F.col("embedding").alias("qvec"))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("type"), F.col("embedding").alias("vec"))


_LEVELS = "(VALUES ('symbol', 'symbol_index'), ('file', 'file_index'), ('module', 'module_summary'), ('repo', 'repo_summary'), ('doc', 'document,spec'), ('spec', 'spec'), ('commit', 'commit_index')) l(level, types)"


@query("RET-01", f"SELECT level, CASE WHEN level = 'repo' AND persona = 'sales' THEN 'repo_bdr,repo_summary' ELSE types END AS types, persona FROM {_LEVELS}, (VALUES (''), ('developer'), ('sales')) p(persona)")
def level_types(spark, sf_dir):
    asked = [(level, persona) for level in R.LEVEL_TYPES for persona in ("", "developer", "sales")]
    return spark.createDataFrame([(a, ",".join(R.doc_types(a, p)), p) for a, p in asked], "level string, types string, persona string")


@query(
    "RET-02",
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, e.label AS type, {_DOT} AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 AND e.label IN (1, 2, 3)),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, type ORDER BY score DESC, item_id) <= 25)
SELECT query_id, item_id, type, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM t QUALIFY rank <= 5""",
)
def filtered_knn(spark, sf_dir):
    return R.nearest(_queries(spark, sf_dir).drop("type"), _items(spark, sf_dir).filter("type IN (1, 2, 3)"), 5, per_type=25)


@query(
    "RET-03",
    f"SELECT q.vec_id AS query_id, e.vec_id AS item_id, e.label AS type, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 AND (e.label = 4 OR e.vec_id % 10 IN (1, 3)) QUALIFY rank <= 10",
)
def level_search(spark, sf_dir):
    return R.nearest(_queries(spark, sf_dir).drop("type"), _items(spark, sf_dir).filter((F.col("type") == 4) | (F.col("item_id") % 10).isin(1, 3)), 10)


@query(
    "RET-04",
    f"SELECT q.vec_id AS query_id, e.vec_id AS item_id, e.label AS type, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id AND q.label = e.label WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10",
)
def neighbours(spark, sf_dir):
    return R.nearest(_queries(spark, sf_dir), _items(spark, sf_dir), 10, same_type=True)


@query("RET-05", f"SELECT q.vec_id AS query_id, e.vec_id AS item_id, {_DOT} AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 AND e.label = 2 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) <= 8")
def legacy_search(spark, sf_dir):
    return R.nearest(_queries(spark, sf_dir).drop("type"), _items(spark, sf_dir).filter("type = 2"), 8).select("query_id", "item_id", "score")


@query("RET-06", f"SELECT q.vec_id AS query_id, e.vec_id AS item_id, {_DOT} AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 AND e.vec_id % 4 = 1 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) <= 6")
def user_search(spark, sf_dir):
    return R.nearest(_queries(spark, sf_dir).drop("type"), _items(spark, sf_dir).filter("item_id % 4 = 1"), 6).select("query_id", "item_id", "score")


def _bm25(name: str, english: bool) -> str:
    """SQL of the hits of every benchmark item, and the first three repositories among them."""

    def words(text):
        split = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
        if not english:
            return split
        stops = ", ".join(f"'{w}'" for w in R.ENGLISH_STOP_WORDS)
        return (
            f"list_transform(list_filter({split}, lambda w: w NOT IN ({stops})), lambda w: CASE WHEN regexp_matches(w, '[^ea]ies$') THEN regexp_replace(w, 'ies$', 'y') "
            "WHEN regexp_matches(w, '[^aeo]es$') OR regexp_matches(w, '[^use]s$') THEN regexp_replace(w, 's$', '') ELSE w END)"
        )

    n = name
    return f"""{n}t AS (SELECT doc_id AS id, {words('text')} AS w FROM documents), {n}z AS (SELECT count(*) AS n, avg(len(w)) AS avg FROM {n}t WHERE len(w) > 0),
{n}p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM {n}t) GROUP BY ALL),
{n}q AS (SELECT DISTINCT item_id AS query_id, unnest({words('text')}) AS term FROM benchmark), {n}d AS (SELECT term, count(*) AS df FROM {n}p GROUP BY 1),
{n}s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) AS score FROM {n}q JOIN {n}p USING (term) JOIN {n}d USING (term) CROSS JOIN {n}z GROUP BY 1, 2),
{n}h AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {n}s QUALIFY rank <= 12),
{n} AS (SELECT query_id, source AS id, place AS rank FROM (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place FROM {n}h JOIN documents ON doc_id = id GROUP BY query_id, source) WHERE place <= 3)"""


def _repos(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("repo_id"))


@query("RET-07", f"WITH {_bm25('plain', False)}, {_bm25('english', True)} SELECT 'standard' AS analyzer, * FROM plain UNION ALL SELECT 'english', * FROM english")
def lexical(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    one = lambda name, english: R.lexical_repos(docs, asked, _repos(spark, sf_dir), english=english).select(F.lit(name).alias("analyzer"), "*")
    return one("standard", False).unionByName(one("english", True))


@query(
    "RET-08",
    f"""WITH {_bm25('lex', False)}, hit AS (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark) QUALIFY rank <= 20),
vec AS (SELECT query_id, source AS id, place AS rank FROM (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place FROM hit JOIN documents ON doc_id = id GROUP BY query_id, source) WHERE place <= 5),
f AS (SELECT query_id, id, min((rank, source)) AS place FROM (SELECT query_id, id, rank, 0 AS source FROM vec UNION ALL SELECT query_id, id, rank, 1 FROM lex) GROUP BY ALL)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS rank FROM f""",
)
def hybrid_routing(spark, sf_dir):
    """Repositories for every benchmark item: by its vector, five from twenty hits, merged with those by its words."""
    asked = table(spark, sf_dir, "benchmark")
    q = table(spark, sf_dir, "embeddings").join(F.broadcast(asked.select(F.col("item_id").alias("vec_id"))), "vec_id", "left_semi")
    hits = R.nearest(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), _items(spark, sf_dir), 20).select("query_id", F.col("item_id").alias("id"), "rank")
    lex = R.lexical_repos(table(spark, sf_dir, "documents"), asked, _repos(spark, sf_dir))
    return R.round_robin(R.first_repos(hits, _repos(spark, sf_dir), 5), lex)


@query("RET-09", f"SELECT q.vec_id AS query_id, max({_DOT}) < {R.OUT_OF_DOMAIN} AS out_of_scope FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 AND e.label = 0 GROUP BY 1")
def domain_gate(spark, sf_dir):
    best = R.nearest(_queries(spark, sf_dir).drop("type"), _items(spark, sf_dir).filter("type = 0"), 1)
    return best.select("query_id", (F.col("score") < R.OUT_OF_DOMAIN).alias("out_of_scope"))


@query(
    "RET-10",
    """WITH s(intent, start) AS (VALUES ('code_explanation', 'file'), ('architecture', 'module'), ('impact_analysis', 'file'), ('specific_lookup', 'symbol'), ('documentation', 'doc'), ('capability_check', 'repo'),
  ('proposal_draft', 'module'), ('experience_summary', 'repo'), ('change_history', 'commit'), ('other', 'file')), d(direction, base) AS (VALUES ('broad', ['repo', 'module', 'file']), ('narrow', ['file', 'symbol', 'module']), ('specific', ['symbol', 'file'])),
x AS (SELECT intent, start, direction, persona, list_filter(CASE WHEN persona = 'sales' THEN ['module', 'doc'] ELSE base END, lambda l: l <> 'repo') AS levels FROM s, d, (VALUES (''), ('sales')) p(persona))
SELECT intent, direction, persona, array_to_string(CASE WHEN start = 'repo' THEN levels ELSE list_prepend(start, list_filter(levels, lambda l: l <> start)) END, ',') AS path FROM x""",
)
def drill_paths(spark, sf_dir):
    asked = [(i, d, p) for i in [*R.START_LEVELS, "other"] for d in R.PATHS for p in ("", "sales")]
    return spark.createDataFrame([(*a, ",".join(R.drill_path(*a))) for a in asked], "intent string, direction string, persona string, path string")


@query(
    "RET-11",
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, e.label % 3 + 1 AS o, {_DOT} AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, o ORDER BY score DESC, item_id) <= 5),
g0 AS (SELECT query_id, o, sum(CASE WHEN score >= 0.65 THEN 1 ELSE 0 END) AS n FROM h GROUP BY query_id, o), g AS (SELECT query_id, o, sum(n) OVER (PARTITION BY query_id ORDER BY o) AS good FROM g0),
c AS (SELECT query_id, min(o) AS stop FROM g WHERE good >= 2 GROUP BY 1)
SELECT h.query_id, item_id, ['module', 'file', 'symbol'][o] AS level, score FROM h LEFT JOIN c ON h.query_id = c.query_id WHERE stop IS NULL OR o <= stop""",
)
def progressive_drilldown(spark, sf_dir):
    levels = ["module", "file", "symbol"]
    hits = None
    for i, level in enumerate(levels):
        one = R.nearest(_queries(spark, sf_dir).drop("type"), _items(spark, sf_dir).filter(F.col("type") % 3 == i), 5).select("query_id", "item_id", F.lit(level).alias("level"), "score")
        hits = one if hits is None else hits.unionByName(one)
    return R.adequate_levels(hits, levels)


@query(
    "RET-12",
    f"""WITH m AS (SELECT q.vec_id AS query_id, q.embedding AS qv, e.vec_id AS item_id, e.embedding AS v, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 AND e.vec_id % 5 = 0 QUALIFY rank <= 5),
r AS (SELECT query_id, any_value(qv) AS qv, list(v ORDER BY rank) FILTER (rank <= 3) AS vs FROM m GROUP BY 1),
n AS (SELECT query_id, list_transform(range(1, 65), lambda i: qv[i]::DOUBLE + 0.5 * list_sum(list_transform(vs, lambda v: v[i]::DOUBLE)) / len(vs)) AS nv FROM r),
f AS (SELECT m.query_id, e.vec_id AS item_id, e.label AS type, round(list_dot_product(nv, e.embedding::DOUBLE[]), 6) AS score FROM m JOIN n USING (query_id) JOIN embeddings e ON e.vec_id % 5 <> 0 AND e.vec_id - e.vec_id % 5 = m.item_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f QUALIFY rank <= 10""",
)
def module_bridge(spark, sf_dir):
    """Every fifth vector is a module and the next four its files; the rewriter moves a query halfway to the mean of the first contents."""

    def rewrite(q, contents):
        return F.transform(q, lambda x, i: x.cast("double") + F.lit(0.5) * F.aggregate(contents, F.lit(0.0), lambda a, c: a + c[i].cast("double")) / F.size(contents))

    items = _items(spark, sf_dir)
    files = items.filter("item_id % 5 <> 0").withColumn("parent_id", F.col("item_id") - F.col("item_id") % 5)
    return R.bridge(_queries(spark, sf_dir).drop("type"), items.filter("item_id % 5 = 0"), files, 10, rewrite)


@query(
    "RET-13",
    """WITH h AS (SELECT o_custkey % 10 AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_totalprice DESC, o_orderkey) AS rank, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(o_orderkey % 100 AS DOUBLE) END AS s FROM orders QUALIFY rank <= 40)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank <= 20 DESC, CASE WHEN rank <= 20 THEN coalesce(s, 0) END DESC NULLS LAST, rank) AS new_rank FROM h""",
)
def reranking(spark, sf_dir):
    w = Window.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("query_id", F.col("o_custkey") % 10).withColumn("rank", F.row_number().over(w)).filter("rank <= 40")
    h = o.select("query_id", F.col("o_orderkey").alias("id"), "rank", F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 100).cast("double")).alias("s"))
    return R.reranked(h, "s").select("query_id", "id", "new_rank")


@query(
    "RET-14",
    "WITH p AS (SELECT DISTINCT o_custkey % 20 AS q, o_custkey AS parent FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY parent) AS r FROM p) SELECT q, string_agg(c_mktsegment || ':' || left(c_name, 500), chr(10) ORDER BY parent) AS context FROM r JOIN customer ON c_custkey = parent WHERE r <= 3 GROUP BY 1",
)
def parent_context(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("q"), F.col("o_custkey").alias("parent")).distinct()
    three = p.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("parent"))).filter("r <= 3")
    j = three.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("parent"))
    line = F.struct("parent", F.concat_ws(":", "c_mktsegment", F.left("c_name", F.lit(500))).alias("s"))
    return j.groupBy("q").agg(F.array_join(F.array_sort(F.collect_list(line))["s"], "\n").alias("context"))


_DEV, _SALES = (", ".join(f"'{i}'" for i in R.PERSONA_INTENTS[p]) for p in ("developer", "sales"))
#: Replies of a classifier, sound and unsound ones, by turns.
_REPLIES = [
    '{"intent": "architecture", "direction": "broad", "search_keywords": ["queue", "worker"]}',
    'no JSON at all',
    '{"intent": "capability_check", "direction": "narrow"}',
    '{"intent": "small_talk", "direction": "narrow"}',
    '{"intent": "documentation"}',
    '{"intent": "change_history", "direction": "specific", "search_keywords": []}',
    '{"intent": "documentation", "direction": "sideways"}',
]


@query(
    "RET-15",
    f"""WITH c AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 2 = 0 THEN 'developer' ELSE 'sales' END AS persona, [{", ".join("'" + r + "'" for r in _REPLIES)}][((conv_id + turn) % {len(_REPLIES)} + 1)::INT] AS reply FROM conversations WHERE role = 'user'),
v AS (SELECT *, CASE WHEN json_valid(reply) THEN json_extract_string(reply, '$.intent') END AS i, CASE WHEN json_valid(reply) THEN json_extract_string(reply, '$.direction') END AS d, CASE WHEN json_valid(reply) THEN json_extract_string(reply, '$.search_keywords[*]') END AS k FROM c),
o AS (SELECT *, coalesce(i IN ({_DEV}, {_SALES}) AND d IN ('broad', 'narrow', 'specific'), false) AS sound, CASE WHEN persona = 'developer' THEN 'code_explanation' ELSE 'capability_check' END AS fallback FROM v)
SELECT conv_id, turn, CASE WHEN sound AND ((persona = 'developer' AND i IN ({_DEV})) OR (persona = 'sales' AND i IN ({_SALES}))) THEN i ELSE fallback END AS intent, CASE WHEN sound THEN d ELSE 'narrow' END AS direction,
  array_to_string(CASE WHEN sound THEN coalesce(k, []) ELSE list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:10] END, ' ') AS keywords FROM o""",
)
def classified_questions(spark, sf_dir):
    """Every user turn, with a reply of each kind by turns."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    reply = F.element_at(F.array(*map(F.lit, _REPLIES)), ((F.col("conv_id") + F.col("turn")) % len(_REPLIES) + 1).cast("int"))
    x = R.classified(reply, F.when(F.col("conv_id") % 2 == 0, "developer").otherwise("sales"), F.col("text"))
    return c.select("conv_id", "turn", x.alias("x")).select("conv_id", "turn", "x.intent", "x.direction", F.array_join("x.keywords", " ").alias("keywords"))


@query(
    "RET-16",
    f"""WITH h AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5)
SELECT query_id, sha256(string_agg('### ' || rank || '. ' || source || chr(10) || '_Repo: ' || source || ' | Type: file_index | Score: ' || printf('%.2f', score) || '_' || chr(10) || chr(10) || CASE WHEN length(text) > 2000 THEN left(text, 2000) || chr(10) || '...[truncated]' ELSE text END,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM h JOIN documents ON doc_id = id GROUP BY 1""",
)
def synthesis_context(spark, sf_dir):
    """What a model is told for every query: its five nearest documents."""
    hits = R.nearest(_queries(spark, sf_dir).drop("type"), _items(spark, sf_dir), 5)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("repo_id"), F.col("text").alias("content"))
    found = R.contexts(docs.join(F.broadcast(hits), "item_id").withColumn("doc_type", F.lit("file_index")))
    return found.select("query_id", F.sha2("context", 256).alias("context"), F.array_join("sources", ",").alias("sources"))


@query(
    "RET-17",
    f"""WITH h AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 AND e.label = 0 QUALIFY rank <= 20),
r AS (SELECT query_id, source, min(rank) AS rank, max(score) AS score FROM h JOIN documents ON doc_id = id GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM r)
SELECT query_id, 'This question doesn''t appear to be within the scope of the indexed codebases. Closest repositories: ' || string_agg(source, ', ' ORDER BY place) FILTER (place <= 3) || ' (top score ' || printf('%.2f', max(score)) || ', threshold not met).' AS answer
FROM t GROUP BY 1 HAVING max(score) < {R.OUT_OF_DOMAIN}""",
)
def short_circuit(spark, sf_dir):
    """The answers to queries that no repository is near to."""
    hits = R.nearest(_queries(spark, sf_dir).drop("type"), _items(spark, sf_dir).filter("type = 0"), 20).select("query_id", F.col("item_id").alias("id"), "rank", "score")
    top = hits.join(_repos(spark, sf_dir), "id").groupBy("query_id").agg(F.max("score").alias("top")).filter(F.col("top") < R.OUT_OF_DOMAIN)
    near = R.first_repos(hits, _repos(spark, sf_dir), 3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id")))["id"].alias("repos"))
    return top.join(near, "query_id", "left").select("query_id", R.out_of_scope_answer(F.col("repos"), F.col("top")).alias("answer"))


@query("RET-18", "SELECT asked, CASE asked WHEN 'none' THEN 'no manifest' WHEN 'other model' THEN 'mismatch' WHEN 'other size' THEN CASE WHEN bool_and(len(embedding) = 32) THEN 'ok' ELSE 'odd vectors' END ELSE CASE WHEN bool_and(len(embedding) = 64) THEN 'ok' ELSE 'odd vectors' END END AS state, count(*) AS n FROM embeddings, (VALUES ('none'), ('same'), ('other model'), ('other size')) t(asked) GROUP BY asked")
def manifest_check(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("embedding")
    told = {"none": [], "same": [("m", 64)], "other model": [("k", 64)], "other size": [("m", 32)]}
    checks = [R.manifest_state(spark.createDataFrame(rows, "model string, dims int"), e, "m", 32 if asked == "other size" else 64).withColumn("asked", F.lit(asked)) for asked, rows in told.items()]
    return reduce(DataFrame.unionByName, checks)


@query("RET-19", _FILES + " SELECT repo_id, CASE WHEN file_path LIKE '%/%' THEN regexp_extract(file_path, '^([^/]*)/', 1) ELSE file_path END AS entry, count(*) AS files, sum(line_count)::BIGINT AS lines FROM files GROUP BY ALL")
def explore_structure(spark, sf_dir):
    entry = F.substring_index("file_path", "/", 1)
    return view(spark, sf_dir, "files").groupBy("repo_id", entry.alias("entry")).agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))


_HITS = "h AS (SELECT o_custkey % 25 AS query_id, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_totalprice DESC, o_orderkey) AS rank, contains(lower(o_orderpriority), 'urg') OR contains(lower(o_orderstatus), 'urg') AS relevant, o_totalprice AS score, o_orderpriority AS level FROM orders QUALIFY rank <= 20)"


def _hits(spark, sf_dir):
    w = Window.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("query_id", F.col("o_custkey") % 25).withColumn("rank", F.row_number().over(w)).filter("rank <= 20")
    return o.select("query_id", "rank", E.relevant(F.array(F.lit("URG")), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("relevant"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("level"))


@query(
    "EVL-01",
    f"WITH {_HITS} SELECT query_id, bool_or(relevant) AS hit, round(sum(relevant::INT) FILTER (rank <= 1) / 1, 6) AS p1, round(sum(relevant::INT) FILTER (rank <= 3) / least(3, count(*)), 6) AS p3, round(sum(relevant::INT) FILTER (rank <= 5) / least(5, count(*)), 6) AS p5, round(coalesce(1.0 / min(rank) FILTER (relevant), 0), 6) AS rr FROM h GROUP BY 1",
)
def search_precision(spark, sf_dir):
    m = E.precision_metrics(_hits(spark, sf_dir))
    return m.select("query_id", "hit", *[F.round(c, 6).alias(c) for c in ("p1", "p3", "p5", "rr")])


@query("EVL-02", f"WITH {_HITS} SELECT level, round(avg(score), 6) AS mean, round(max(score), 6) AS top, count(*) AS n FROM h GROUP BY 1")
def level_means(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("level").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("top"), F.count("*").alias("n"))


@query(
    "EVL-03",
    """WITH s AS (SELECT doc_id, (CASE WHEN length(text) > 50 THEN 0.2 ELSE 0 END + CASE WHEN length(text) > 200 AND length(text) < 3000 THEN 0.2 ELSE 0 END + CASE WHEN contains(text, '```') THEN 0.2 ELSE 0 END
  + 0.2 * (contains(lower(text), 'the')::INT + contains(lower(text), 'que')::INT) / 2 + CASE WHEN regexp_matches(text, '[a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+') THEN 0.2 ELSE 0 END)::DOUBLE AS s FROM documents)
SELECT doc_id, round(s, 6) AS score, CASE WHEN round(s, 6) >= 0.6 THEN 'Good' WHEN round(s, 6) >= 0.4 THEN 'Fair' ELSE 'Poor' END AS grade FROM s""",
)
def answer_scores(spark, sf_dir):
    t, n = F.col("text"), F.length("text")
    part = lambda c: F.when(c, 0.2).otherwise(0.0)
    hits = (F.lower(t).contains("the").cast("int") + F.lower(t).contains("que").cast("int")) / 2
    s = F.round(part(n > 50) + part((n > 200) & (n < 3000)) + part(t.contains("```")) + 0.2 * hits + part(t.rlike("[a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+")), 6)
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("score"), F.when(s >= 0.6, "Good").when(s >= 0.4, "Fair").otherwise("Poor").alias("grade"))


_RANKS = "r AS (SELECT query_id, min(rank) FILTER (relevant) AS rank FROM h GROUP BY 1)"


@query("EVL-04", f"WITH {_HITS}, {_RANKS} SELECT round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(coalesce((rank <= 1)::INT, 0)), 6) AS r1, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS r5, round(avg(coalesce((rank <= 10)::INT, 0)), 6) AS r10, round(median(rank), 6) AS median_rank FROM r")
def known_items(spark, sf_dir):
    return E.ranking_metrics(_hits(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("rank")))


@query("EVL-05", f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, {_DOT} AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) SELECT a.query_id, count(*) FILTER (b.score > a.score) + 1 AS rank FROM s a JOIN s b ON a.query_id = b.query_id WHERE a.item_id = a.query_id + 20 GROUP BY 1")
def target_ranks(spark, sf_dir):
    q, items = _queries(spark, sf_dir).drop("type"), _items(spark, sf_dir)
    return R.target_ranks(q, items, q.select("query_id", (F.col("query_id") + 20).alias("item_id")))


@query("EVL-06", f"WITH {_HITS}, {_RANKS} SELECT query_id, CASE WHEN rank <= 10 THEN 1 ELSE rank END AS ceiling FROM r WHERE rank IS NOT NULL")
def rerank_ceiling(spark, sf_dir):
    r = _hits(spark, sf_dir).filter("relevant").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return r.select("query_id", F.when(F.col("rank") <= 10, 1).otherwise(F.col("rank")).alias("ceiling"))


@query(
    "EVL-07",
    """WITH s AS (SELECT p_size AS score, p_partkey % 3 = 0 AS positive FROM part), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s)
SELECT round((sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)), 6) AS auc,
  round((avg(score) FILTER (positive) - avg(score) FILTER (NOT positive)) / sqrt((var_pop(score) FILTER (positive) + var_pop(score) FILTER (NOT positive)) / 2), 6) AS d, round(quantile_cont(score, 0.95) FILTER (NOT positive), 6) AS p95 FROM r""",
)
def discrimination(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.col("p_size").alias("score"), (F.col("p_partkey") % 3 == 0).alias("positive"))
    p95 = s.agg(F.round(F.percentile(F.when(~F.col("positive"), F.col("score")), 0.95), 6).alias("p95"))
    return E.auc(s, "score", "positive").crossJoin(E.cohens_d(s, "score", "positive")).crossJoin(p95)


@query("EVL-08", f"SELECT q.label = e.label AS same, round(avg({_DOT}), 5) AS mean, round(stddev_pop({_DOT}), 5) AS deviation, count(*) AS n FROM embeddings q JOIN embeddings e ON e.vec_id BETWEEN q.vec_id + 1 AND q.vec_id + 10 GROUP BY 1")
def coherence(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.select(F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 10)).alias("vec_id"), F.col("label").alias("l"), F.col("embedding").alias("q"))
    s = e.join(q, "vec_id").select((F.col("l") == F.col("label")).alias("same"), F.round(vectors.dot(F.col("q"), F.col("embedding")), 6).alias("s"))
    return s.groupBy("same").agg(F.round(F.avg("s"), 5).alias("mean"), F.round(F.stddev_pop("s"), 5).alias("deviation"), F.count("*").alias("n"))


@query(
    "EVL-09",
    """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM c GROUP BY 1)
SELECT a.label AS a, b.label AS b, round(sum(a.v * b.v) / max(x.n * y.n), 6) AS similarity FROM c a JOIN c b ON a.i = b.i JOIN n x ON x.label = a.label JOIN n y ON y.label = b.label GROUP BY 1, 2""",
)
def centroids(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    a, b = c.select(F.col("label").alias("a"), "i", F.col("v").alias("x")), c.select(F.col("label").alias("b"), "i", F.col("v").alias("y"))
    n = c.groupBy("label").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    d = a.join(b, "i").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    j = d.join(n.select(F.col("label").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("label").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", F.round(F.col("d") / (F.col("na") * F.col("nb")), 6).alias("similarity"))


@query("EVL-10")
def principal_components(spark, sf_dir):
    """Components needed for 90 and 95 % of the variance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    explained = PCA(k=64, inputCol="v", outputCol="p").fit(e).explainedVariance.toArray().cumsum()
    return spark.createDataFrame([(float(t), int((explained < t).sum()) + 1) for t in (0.9, 0.95)], "share double, components int")


@query("EVL-11", "SELECT l_suppkey, min(a) AS a, min(b) AS b FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS a, lead(l_orderkey * 10 + l_linenumber) OVER w AS b, row_number() OVER w AS r FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY sha256(cast(l_orderkey * 10 + l_linenumber AS varchar)))) WHERE r = 1 GROUP BY 1")
def same_file_pairs(spark, sf_dir):
    k = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a")
    w = Window.partitionBy("l_suppkey").orderBy(F.sha2(F.col("a").cast("string"), 256))
    s = table(spark, sf_dir, "lineitem").select("l_suppkey", k).withColumn("b", F.lead("a").over(w)).withColumn("r", F.row_number().over(w))
    return s.filter("r = 1").select("l_suppkey", "a", "b")


@query("GRF-01", _EDGES + " SELECT consumer, provider FROM edges WHERE consumer % 5 = provider % 5")
def intra_edges(spark, sf_dir):
    return view(spark, sf_dir, "edges").filter("consumer % 5 = provider % 5")


_NAME = "CASE WHEN {0} % 5 = 0 THEN 'core.m' ELSE 'app.m' END || cast({0} AS varchar)"


@query("GRF-02", _EDGES + f", n AS (SELECT {_NAME.format('consumer')} AS consumer, {_NAME.format('provider')} AS provider FROM edges) SELECT consumer, provider, starts_with(consumer, 'app.') AS \"cross\" FROM n WHERE starts_with(provider, 'core.')")
def cross_edges(spark, sf_dir):
    """Modules ``core.*`` of the mother and ``app.*`` of a daughter, with their imports both ways."""
    name = lambda c: F.concat(F.when(F.col(c) % 5 == 0, "core.m").otherwise("app.m"), F.col(c).cast("string"))
    e = view(spark, sf_dir, "edges").select(name("consumer").alias("c"), name("provider").alias("p"))
    out, into = e.groupBy(F.col("c").alias("module")).agg(F.collect_list("p").alias("imports")), e.groupBy(F.col("p").alias("module")).agg(F.collect_list("c").alias("imported_by"))
    return G.module_edges(out.join(into, "module", "full"), "core.", "app.")


@query("GRF-03", _EDGES + " SELECT consumer, provider FROM edges WHERE provider % 5 = 0 UNION ALL SELECT consumer, provider FROM edges WHERE consumer % 5 = provider % 5")
def combined_edges(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    return e.filter("provider % 5 = 0").union(e.filter("consumer % 5 = provider % 5"))


@query("GRF-04", _EDGES + " SELECT v, min(repo) AS repo FROM (SELECT consumer AS v, consumer % 5 AS repo FROM edges UNION ALL SELECT provider, provider % 5 FROM edges) GROUP BY 1")
def graph_nodes(spark, sf_dir):
    return G.nodes(view(spark, sf_dir, "edges")).select("v", (F.col("v") % 5).alias("repo"))


#: Rounds as lists in one row, ended by the same rule.
_RANKED = (
    _EDGES.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, n AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT consumer AS v FROM edges UNION SELECT provider FROM edges)), o AS (SELECT consumer, count(*) AS d FROM edges GROUP BY 1),
g AS (SELECT n.i, list(struct_pack(c := c.i, d := o.d)) FILTER (c.i IS NOT NULL) AS ins, any_value(own.d) IS NULL AS loose FROM n LEFT JOIN edges e ON e.provider = n.v LEFT JOIN n c ON c.v = e.consumer LEFT JOIN o ON o.consumer = e.consumer LEFT JOIN o own ON own.consumer = n.v GROUP BY n.i),
k AS (SELECT list(coalesce(ins, []) ORDER BY i) AS ins, list(loose ORDER BY i) AS loose, count(*)::DOUBLE AS n FROM g),
t(step, s, change) AS (SELECT 0, list_transform(k.ins, lambda x: 1 / k.n), 1e9::DOUBLE FROM k UNION ALL
  SELECT step + 1, ns, list_sum(list_transform(range(1, len(ns) + 1), lambda i: abs(ns[i] - s[i]))) FROM (SELECT step, s, list_transform(ins, lambda x: 0.15 / n + 0.85 * (coalesce(list_sum(list_transform(x, lambda y: s[y.c] / y.d)), 0) + lost / n)) AS ns
    FROM (SELECT t.step, t.s, k.ins, k.n, coalesce(list_sum(list_transform(range(1, len(t.s) + 1), lambda i: CASE WHEN k.loose[i] THEN t.s[i] ELSE 0 END)), 0) AS lost FROM t, k WHERE t.change >= 1e-6 * k.n AND t.step < 100))),
r AS (SELECT n.v, round(z.s[n.i], 8) AS score FROM n, (SELECT s FROM t ORDER BY step DESC LIMIT 1) z)"""
)


def _scores(spark, sf_dir):
    return G.pagerank(view(spark, sf_dir, "edges")).select("v", F.round("score", 8).alias("score"))


@query("GRF-05", _RANKED + " SELECT v, score FROM r")
def pagerank(spark, sf_dir):
    return _scores(spark, sf_dir)


@query("TOP-04", _RANKED + " SELECT v, score FROM r ORDER BY score DESC, v LIMIT 10")
def top_pagerank(spark, sf_dir):
    return _scores(spark, sf_dir).orderBy(F.desc("score"), "v").limit(10)


_REACH = _EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + ", t(seed, v) AS (SELECT provider, consumer FROM edges UNION SELECT t.seed, e.consumer FROM t JOIN edges e ON e.provider = t.v)"


@query(
    "GRF-06",
    _RANKED
    + """, w(seed, v) AS (SELECT provider, consumer FROM edges UNION SELECT w.seed, e.consumer FROM w JOIN edges e ON e.provider = w.v)
SELECT v, round(score / (SELECT max(score) FROM r), 6) AS normalized_score, cast(floor(100 * (1 - (rank() OVER (ORDER BY score DESC) - 1) / (count(*) OVER ()))) AS bigint) AS percentile, (SELECT count(*) FROM edges WHERE provider = r.v) AS direct,
  (SELECT count(*) FROM w WHERE seed = r.v AND w.v <> r.v) AS transitive, coalesce((SELECT string_agg(DISTINCT cast(consumer % 5 AS varchar), ',' ORDER BY cast(consumer % 5 AS varchar)) FROM edges WHERE provider = r.v), '') AS downstream_repos FROM r""",
)
def criticality(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    repos = G.nodes(e).withColumn("repo", (F.col("v") % 5).cast("string"))
    return G.criticality(e, _scores(spark, sf_dir), repos).withColumn("downstream_repos", F.array_join("downstream_repos", ",")).withColumn("normalized_score", F.round("normalized_score", 6))


@query("GRF-07", _REACH + " SELECT seed, v FROM t WHERE seed <> v")
def closure(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    return G.dependents(e, G.nodes(e)).select("seed", "v")


_GRAPH = "CASE WHEN v % 4 = 0 THEN 'tests.test_m' ELSE 'pkg.m' END || cast(v AS varchar) AS module, CASE WHEN v % 4 = 0 THEN 'tests/test_m' ELSE 'pkg/m' END || cast(v AS varchar) || '.py' AS path"


def _graph(e):
    test, number = F.col("v") % 4 == 0, F.col("v").cast("string")
    return G.nodes(e).select(F.col("v").alias("node"), F.concat(F.when(test, "tests/test_m").otherwise("pkg/m"), number, F.lit(".py")).alias("path"), F.concat(F.when(test, "tests.test_m").otherwise("pkg.m"), number).alias("module"), F.col("v").alias("ordinal"))


@query(
    "GRF-08",
    _REACH
    + f""", g AS (SELECT v, {_GRAPH} FROM (SELECT consumer AS v FROM edges UNION SELECT provider FROM edges)), f(file) AS (VALUES ('pkg/m3.py'), ('repo/pkg/m11.py'), ('m17.py'), ('none/such.py'), ('pkg/m21.pyi')),
m AS (SELECT file, v, CASE WHEN file = path THEN 0 WHEN ends_with(file, path) OR ends_with(path, file) THEN 1 WHEN ends_with(dotted, module) OR ends_with(module, dotted) THEN 2 END AS stage FROM (SELECT *, replace(regexp_replace(file, '\\.[^./]*$', ''), '/', '.') AS dotted FROM f), g),
s AS (SELECT DISTINCT arg_min(v, (stage, v)) AS v FROM m WHERE stage IS NOT NULL GROUP BY file)
SELECT DISTINCT module FROM g WHERE contains(lower(module), 'test') AND (v IN (SELECT t.v FROM t JOIN s ON t.seed = s.v) OR v IN (SELECT v FROM s))""",
)
def affected_tests(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    files = spark.createDataFrame([(f,) for f in ("pkg/m3.py", "repo/pkg/m11.py", "m17.py", "none/such.py", "pkg/m21.pyi")], "file string")
    return G.affected_tests(files, _graph(e), e)


@query(
    "GRF-09",
    _EDGES
    + f""", g AS (SELECT v, {_GRAPH} FROM (SELECT consumer AS v FROM edges UNION SELECT provider FROM edges)), a(asked) AS (VALUES ('pkg.m7'), ('m1'), ('test_m'), ('nothing')),
b AS (SELECT asked, arg_min(module, (asked <> module, module)) AS module, arg_min(v, (asked <> module, module)) AS v FROM a JOIN g ON contains(module, asked) GROUP BY 1)
SELECT asked, module, array_to_string(list_sort(list(consumer) FILTER (consumer IS NOT NULL))[1:20], ',') AS dependents FROM b LEFT JOIN edges ON provider = v GROUP BY 1, 2""",
)
def module_criticality(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    asked = spark.createDataFrame([(a,) for a in ("pkg.m7", "m1", "test_m", "nothing")], "asked string")
    found = G.node_criticality(asked, _graph(e).select(F.col("node").alias("v"), "module"), e)
    return found.withColumn("dependents", F.array_join(F.col("dependents").cast("array<string>"), ","))


@query("GRF-10", _EDGES + " SELECT consumer % 5 AS cluster, count(*) AS n_edges, max(provider) AS computed FROM edges GROUP BY 1 ORDER BY computed DESC, cluster")
def clusters(spark, sf_dir):
    g = view(spark, sf_dir, "edges").groupBy((F.col("consumer") % 5).alias("cluster")).agg(F.count("*").alias("n_edges"), F.max("provider").alias("computed"))
    return g.orderBy(F.desc("computed"), "cluster")


@query("GRF-11", _FILES + " SELECT doc_id, contains(lower(file_path), 'test') AS is_test, round(n_chars / 7.0, 6) AS criticality FROM files")
def test_flags(spark, sf_dir):
    return view(spark, sf_dir, "files").select("doc_id", F.lower("file_path").contains("test").alias("is_test"), F.round(F.col("n_chars") / 7.0, 6).alias("criticality"))


_TREE = """d AS (SELECT 'c:' || cast(c_custkey AS varchar) AS id, CASE WHEN c_custkey % 17 = 0 THEN 'n:999' ELSE 'n:' || cast(c_nationkey AS varchar) END AS parent_id FROM customer
  UNION ALL SELECT 'n:' || cast(n_nationkey AS varchar), CASE n_nationkey WHEN 3 THEN 'n:4' WHEN 4 THEN 'n:3' WHEN 5 THEN 'r:77' ELSE 'r:' || cast(n_regionkey AS varchar) END FROM nation UNION ALL SELECT 'r:' || cast(r_regionkey AS varchar), NULL FROM region)"""


@query(
    "GRF-12",
    f"""WITH RECURSIVE {_TREE}, w(id, chain, here) AS (SELECT id, [id], id FROM d UNION ALL SELECT w.id, list_append(chain, d.parent_id), d.parent_id FROM w JOIN d ON w.here = d.id JOIN d p ON p.id = d.parent_id WHERE NOT list_contains(chain, d.parent_id)),
l AS (SELECT id, arg_max(chain, len(chain)) AS chain, arg_max(here, len(chain)) AS here FROM w GROUP BY 1)
SELECT l.id, array_to_string(chain, '>') AS chain, CASE WHEN d.parent_id NOT IN (SELECT id FROM d) THEN d.parent_id END AS broken_at FROM l JOIN d ON d.id = l.here""",
)
def ancestry(spark, sf_dir):
    """Customers under nations under regions; some parents are missing, and two nations are each other's."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    key = lambda letter, col: F.concat(F.lit(letter + ":"), F.col(col).cast("string"))
    of_nation = F.when(F.col("n_nationkey") == 3, "n:4").when(F.col("n_nationkey") == 4, "n:3").when(F.col("n_nationkey") == 5, "r:77").otherwise(key("r", "n_regionkey"))
    d = c.select(key("c", "c_custkey").alias("id"), F.when(F.col("c_custkey") % 17 == 0, "n:999").otherwise(key("n", "c_nationkey")).alias("parent_id"))
    d = d.unionByName(n.select(key("n", "n_nationkey").alias("id"), of_nation.alias("parent_id"))).unionByName(r.select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id")))
    return G.ancestry(d, d.select("id")).withColumn("chain", F.array_join("chain", ">"))


@query("GRF-13", _EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + ", p AS (SELECT consumer AS a, provider + 1000 AS b FROM edges WHERE (consumer + provider * 3) % 29 = 0), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), t(s, v) AS (SELECT a, a FROM e UNION SELECT t.s, e.b FROM t JOIN e ON e.a = t.v) SELECT s AS v, min(v) AS component FROM t GROUP BY 1")
def families(spark, sf_dir):
    pairs = view(spark, sf_dir, "edges").filter("(consumer + provider * 3) % 29 = 0").select(F.col("consumer").alias("a"), (F.col("provider") + 1000).alias("b"))
    return G.components(pairs)
