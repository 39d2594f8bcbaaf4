"""Projections, filters and scalar functions over the corpus views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import ids, paths, text, vectors
from quern.plans.registry import query
from quern.sources.tables import ctes, table, view

_FILES = ctes("files")
_SYMBOLS = ctes("symbols")
_BASE = "regexp_extract(file_path, '([^/]*)$', 1)"
_DIR = "regexp_extract(file_path, '^(.*)/[^/]*$', 1)"
_SUFFIX = r"regexp_extract(file_path, '[^/](\.[^./]+)$', 1)"


def _case(table_: dict[str, str], key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {other} END"


@query(
    "FN-01",
    _FILES
    + r""" SELECT doc_id, sha256('repo:' || repo_id) AS repo_key, sha256('module:' || repo_id || ':' || """
    + _DIR
    + r""") AS module_key,
  sha256('file:' || repo_id || ':' || file_path) AS file_key, sha256('symbol:' || repo_id || ':' || file_path || ':' || lang) AS symbol_key,
  sha256('semantic:' || repo_id || ':' || file_path || ':1-' || cast(line_count AS varchar)) AS semantic_key,
  sha256('commit:' || repo_id || ':' || left(sha256(cast(doc_id AS varchar)), 12)) AS commit_key,
  sha256('edge:' || repo_id || ':' || lang || '→' || repo_id || ':' || file_path) AS edge_key,
  sha256('annotation:' || cast(doc_id AS varchar) || ':' || lang || ':' || cast(n_chars AS varchar)) AS note_key FROM files""",
)
def identities(spark, sf_dir):
    f = view(spark, sf_dir, "files")
    c = F.col
    return f.select(
        "doc_id",
        ids.repo_id(c("repo_id")).alias("repo_key"),
        ids.module_id(c("repo_id"), paths.dirname(c("file_path"))).alias("module_key"),
        ids.file_id(c("repo_id"), c("file_path")).alias("file_key"),
        ids.symbol_id(c("repo_id"), c("file_path"), c("lang")).alias("symbol_key"),
        ids.semantic_id(c("repo_id"), c("file_path"), F.lit(1), c("line_count")).alias("semantic_key"),
        ids.commit_id(c("repo_id"), F.sha2(c("doc_id").cast("string"), 256)).alias("commit_key"),
        ids.edge_id(c("repo_id"), c("lang"), c("repo_id"), c("file_path")).alias("edge_key"),
        ids.annotation_id(c("doc_id"), c("lang"), c("n_chars")).alias("note_key"),
    )


@query("FN-02", "SELECT doc_id, left(sha256(coalesce(text, '')), 16) AS content_hash FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


@query("FN-03", "SELECT doc_id, left(sha256(left(text, 1000) || '|' || left(lang, 1000)), 16) AS input_hash FROM documents")
def input_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.input_hash(F.col("text"), F.col("lang")).alias("input_hash"))


@query(
    "FN-04",
    _SYMBOLS
    + """ SELECT l_orderkey, l_linenumber, sha256('symbol:' || repo_id || ':' || file_path || ':' || symbol_name ||
  CASE WHEN symbol_name IN ('anonymous', 'arrow_function', '') OR count(*) OVER (PARTITION BY repo_id, file_path, symbol_name) > 1
    THEN '@' || cast(start_line AS varchar) || '-' || cast(end_line AS varchar) ELSE '' END) AS symbol_id FROM symbols""",
)
def symbol_ids(spark, sf_dir):
    from quern.operators.versions import with_symbol_ids

    return with_symbol_ids(view(spark, sf_dir, "symbols")).select("l_orderkey", "l_linenumber", "symbol_id")


@query(
    "FN-05",
    _FILES + f" SELECT doc_id, {_case(paths.RETRIEVAL_LANGUAGES, 'lower(' + _SUFFIX + ')', chr(39) * 2)} AS retrieval_language, {_case(paths.PARSER_LANGUAGES, _SUFFIX, 'NULL')} AS parser_language FROM files",
)
def languages(spark, sf_dir):
    p = F.col("file_path")
    return view(spark, sf_dir, "files").select("doc_id", paths.retrieval_language(p).alias("retrieval_language"), paths.parser_language(p).alias("parser_language"))


@query("FN-06", "SELECT doc_id, coalesce(array_to_string(string_split(text, chr(10))[2:4], chr(10)), '') AS span FROM documents")
def line_spans(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.line_span(F.col("text"), F.lit(2), F.lit(4)).alias("span"))


@query("FN-07", "SELECT doc_id, len(string_split(text, chr(10))) AS line_count FROM documents")
def line_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.line_count(F.col("text")).cast("bigint").alias("line_count"))


@query(
    "FN-08",
    """WITH s AS (SELECT doc_id, left(sha256(array_to_string(string_split(text, chr(10))[1:2], chr(10))), 16) AS h, CASE doc_id % 3 WHEN 0 THEN left(sha256(text), 16) WHEN 1 THEN NULL
  ELSE left(sha256(array_to_string(string_split(text, chr(10))[1:2], chr(10))), 16) END AS stored FROM documents)
SELECT doc_id, CASE WHEN stored IS NULL THEN 'unknown' WHEN stored = h THEN 'fresh' ELSE 'stale' END AS state FROM s""",
)
def span_staleness(spark, sf_dir):
    t = F.col("text")
    now = ids.content_hash(text.line_span(t, F.lit(1), F.lit(2)))
    stored = F.when(F.col("doc_id") % 3 == 0, ids.content_hash(t)).when(F.col("doc_id") % 3 == 2, now)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(stored.isNull(), "unknown").when(stored == now, "fresh").otherwise("stale").alias("state"))


@query(
    "FN-09",
    """SELECT doc_id, array_to_string(string_split(text, chr(10))[greatest(1, 5 - 10):15], chr(10)) AS around, array_to_string(string_split(text, chr(10))[1:100], chr(10)) AS head FROM documents""",
)
def context_windows(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.line_span(t, F.lit(5 - 10), F.lit(5 + 10)).alias("around"), text.line_span(t, F.lit(1), F.lit(100)).alias("head"))


@query(
    "FN-10",
    "SELECT doc_id, sha256(CASE WHEN length(text) > 6000 THEN left(text, 4500) || chr(10) || chr(10) || '... [truncated] ...' || chr(10) || chr(10) || right(text, 1400) ELSE text END) AS cut FROM documents",
)
def middle_truncation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.middle_cut(F.col("text")), 256).alias("cut"))


@query("FN-11", _FILES + " SELECT doc_id, '# Context: ' || file_path || chr(10) || '# Inside: ' || lang || chr(10) || left(content, 50) AS block FROM files")
def context_headers(spark, sf_dir):
    return view(spark, sf_dir, "files").select("doc_id", text.context_header(F.left("content", F.lit(50)), F.col("file_path"), F.col("lang")).alias("block"))


_WS = r"regexp_replace(regexp_replace(trim(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_CUT = "CASE WHEN length({t}) <= {n} THEN {t} WHEN left({t}, {n}) LIKE '% %' THEN regexp_extract(left({t}, {n}), '(?s)^(.*) ', 1) || '…' ELSE left({t}, {n}) || '…' END"


@query("FN-12", f"WITH a AS (SELECT doc_id, text AS x FROM documents), b AS (SELECT doc_id, {_WS} AS t FROM a) SELECT doc_id, {_CUT.format(t='t', n=240)} AS docstring FROM b")
def docstrings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_docstring(F.concat(F.lit('"""'), "text", F.lit('"""'))).alias("docstring"))


_LINE = r"trim(string_split(text, chr(10))[1], chr(9)||chr(11)||chr(12)||chr(13)||' ')"
_PREVIEW = f"CASE WHEN strpos(t, '. ') > 1 AND strpos(t, '. ') <= 160 THEN left(t, strpos(t, '. ')) ELSE {_CUT.format(t='t', n=160)} END"


@query("FN-13", f"WITH b AS (SELECT doc_id, {_LINE} AS t FROM documents) SELECT doc_id, {_PREVIEW} AS preview FROM b")
def previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query(
    "FN-16",
    _FILES
    + f" SELECT doc_id, {_BASE} AS base, {_DIR} AS dir, CASE WHEN {_DIR} = '' THEN 0 ELSE len(string_split({_DIR}, '/')) END AS depth, CASE WHEN {_DIR} = '' THEN 0 ELSE len(string_split({_DIR}, '/')) END AS n_ancestors FROM files",
)
def path_parts(spark, sf_dir):
    p = F.col("file_path")
    d = paths.dirname(p)
    return view(spark, sf_dir, "files").select(
        "doc_id", paths.basename(p).alias("base"), d.alias("dir"), paths.depth(d).cast("bigint").alias("depth"), F.size(paths.ancestors(d)).cast("bigint").alias("n_ancestors")
    )


@query("FN-17", _FILES + " SELECT doc_id, replace(lang || '/' || repo_id, '/', '_') AS folder FROM files")
def repo_folders(spark, sf_dir):
    return view(spark, sf_dir, "files").select("doc_id", paths.flattened(F.concat("lang", F.lit("/"), "repo_id")).alias("folder"))


@query("FN-20", "SELECT o_orderkey, substr(cast(o_orderdate AS varchar), 1, 7) AS month, substr(cast(o_orderdate AS varchar), 1, 4) || '-Q' || cast(((month(o_orderdate) + 2) // 3) AS varchar) AS quarter FROM orders")
def iso_months(spark, sf_dir):
    d = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    q = F.ceil(F.substring(d, 6, 2).cast("int") / 3).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.substring(d, 1, 7).alias("month"), F.concat(F.substring(d, 1, 4), F.lit("-Q"), q).alias("quarter"))


@query("FN-21", "SELECT o_orderkey, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week FROM orders")
def iso_weeks(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd").alias("week"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: a[i]::DOUBLE * b[i]::DOUBLE))"


@query("FN-22", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round((embedding[1]::DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def norms(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(e), 6).alias("norm"), F.round(vectors.normalized(e)[0], 6).alias("first"))


@query("FN-23", "WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, 16 AS dims, round(embedding[16]::DOUBLE / n, 6) AS last FROM n")
def nested_truncation(spark, sf_dir):
    t = vectors.truncated(F.col("embedding"), 16)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(t).alias("dims"), F.round(t[15], 6).alias("last"))


@query(
    "FN-24",
    "SELECT x.vec_id, y.vec_id AS next_id, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS score FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1",
)
def dot_products(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    y = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("b"))
    return e.join(y, "vec_id").select("vec_id", "next_id", F.round(vectors.dot(F.col("embedding"), F.col("b")), 6).alias("score"))


@query(
    "FN-25",
    "SELECT x.vec_id, round(CASE WHEN x.vec_id % 7 = 0 THEN 0.0 ELSE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) END, 6) AS score FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1",
)
def cosines(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    zero = F.transform("embedding", lambda v: v * 0)
    a = e.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, zero).otherwise(F.col("embedding")))
    y = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(y, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("b")), 6).alias("score"))


_STOPS = ", ".join(f"'{w}'" for w in text.QUERY_STOP_WORDS)


@query(
    "FN-28",
    rf"""SELECT item_id, regexp_extract(trim(text, chr(10)||' '), '(?s)^(.*?[.!?])(\s+|$)', 1) AS lead,
  array_to_string(list_filter(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]+'), lambda w: w NOT IN ({_STOPS}) AND length(w) > 2)[1:18], ' ') AS keywords FROM benchmark""",
)
def query_styles(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", text.lead(t).alias("lead"), text.keywords(t).alias("keywords"))


_ANSWER = "'See `' || file_path || '` and class Repo' || cast(doc_id % 9 AS varchar) || ' in ' || lang || '/' || repo_id || ' [GAP: ' || lang || ' docs]'"


@query(
    "FN-29",
    _FILES
    + rf""", a AS (SELECT doc_id, {_ANSWER} AS answer FROM files) SELECT doc_id,
  array_to_string(list_sort(list_distinct(regexp_extract_all(answer, '`?([a-zA-Z0-9_/.-]+\.(py|js|ts|tsx|jsx|go|rs|java|rb|svelte))`?(?::\d+)?', 1))), ',') AS files,
  array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(answer, '`([A-Z][a-zA-Z0-9_]+)`', 1), regexp_extract_all(answer, '(?:class|def|function)\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)))), ',') AS symbols,
  array_to_string(list_sort(list_distinct(regexp_extract_all(answer, '([a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+)', 1))), ',') AS repos FROM a""",
)
def citations(spark, sf_dir):
    a = view(spark, sf_dir, "files").select("doc_id", F.expr(_ANSWER.replace("varchar", "string")).alias("answer"))
    t = F.col("answer")
    return a.select("doc_id", F.array_join(text.cited_files(t), ",").alias("files"), F.array_join(text.cited_symbols(t), ",").alias("symbols"), F.array_join(text.cited_repos(t), ",").alias("repos"))


@query("FN-30", _FILES + rf" SELECT doc_id, array_to_string(regexp_extract_all({_ANSWER}, '\[GAP:\s*([^\]]+)\]', 1), ',') AS gaps FROM files")
def answer_gaps(spark, sf_dir):
    a = view(spark, sf_dir, "files").select("doc_id", F.expr(_ANSWER.replace("varchar", "string")).alias("answer"))
    return a.select("doc_id", F.array_join(text.gaps(F.col("answer")), ",").alias("gaps"))


@query("FN-31", r"SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN cast(json_extract(props, '$.k') AS bigint) END AS k, CASE WHEN event_id % 4 = 2 THEN 'a\d+\w' WHEN event_id % 4 <> 3 THEN 'plain' END AS pattern FROM events")
def tolerant_json(spark, sf_dir):
    """Replies in a fence, bare, with escapes that JSON has not, and no JSON at all."""
    inner = F.regexp_replace("props", r"^\{|\}$", "")
    kind = F.col("event_id") % 4
    own = F.when(kind == 2, r"a\d+\w").otherwise("plain")
    body = F.concat(F.lit("[{"), inner, F.lit(', "pattern": "'), own, F.lit('"}]'))
    reply = F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 3, F.lit("I can't answer that.")).otherwise(body)
    parsed = F.from_json(text.tolerant_json(reply), "array<struct<k:bigint,pattern:string>>")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select("event_id", F.try_element_at("p", F.lit(1)).alias("x")).select("event_id", "x.k", "x.pattern")


@query("FN-32", "SELECT o_orderkey, o_orderdate + INTERVAL 7 DAY > TIMESTAMP '1998-06-01' AS snoozed FROM orders")
def snoozes(spark, sf_dir):
    stamp = F.try_to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    due = F.coalesce(stamp + F.expr("INTERVAL 7 DAYS") > F.lit("1998-06-01").cast("timestamp"), F.lit(False))
    return table(spark, sf_dir, "orders").select("o_orderkey", due.alias("snoozed"))


@query(
    "FN-33",
    _FILES
    + """ SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN left(content, 300) || chr(10) || chr(10) || 'Code:' || chr(10) || left(content, 8000)
  WHEN 1 THEN 'Spec: ' || lang || chr(10) || left(content, 300) ELSE left(content, 300) END) AS embedded FROM files""",
)
def embedding_texts(spark, sf_dir):
    head = F.left("content", F.lit(300))
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(head, F.lit("\n\nCode:\n"), F.left("content", F.lit(8000)))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Spec: "), "lang", F.lit("\n"), head)).otherwise(head)
    return view(spark, sf_dir, "files").select("doc_id", F.sha2(made, 256).alias("embedded"))


@query("FN-34", "SELECT item_id, 'nomic-ai/nomic-embed-text-v1.5' AS model, 'search_query: ' || text AS query_text, 'search_document: ' || text AS document_text FROM benchmark UNION ALL SELECT item_id, 'Qwen/Qwen3-Embedding-0.6B', text, text FROM benchmark")
def model_prefixes(spark, sf_dir):
    forms = [F.struct(F.lit(m).alias("model"), text.prefixed(F.col("text"), m, True).alias("query_text"), text.prefixed(F.col("text"), m, False).alias("document_text")) for m in text.PREFIXES]
    return table(spark, sf_dir, "benchmark").select("item_id", F.inline(F.array(*forms)))


@query("FN-35", "SELECT item_id, true AS valid FROM benchmark")
def valid_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.lit(True).alias("valid"))


@query(
    "FN-36",
    _FILES
    + """ SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '[spec] ' || file_path || ' (intended behaviour)' WHEN 1 THEN '[file] ' || repo_id || ':' || file_path WHEN 2 THEN '[commit] ' || repo_id ELSE '[document] ' || file_path END AS header FROM files""",
)
def result_headers(spark, sf_dir):
    from quern.operators.retrieval import result_header

    f = view(spark, sf_dir, "files").withColumn("doc_type", F.element_at(F.array(*map(F.lit, ("spec", "file_index", "commit_index", "document"))), (F.col("doc_id") % 4 + 1).cast("int")))
    return f.select("doc_id", result_header(F.col("doc_type"), F.col("repo_id"), F.col("file_path")).alias("header"))


@query(
    "FN-37",
    """SELECT conv_id, string_agg(role || ':' || cast(turn AS varchar), ',' ORDER BY turn) FILTER (r <= 6) AS classify, string_agg(role || ':' || cast(turn AS varchar), ',' ORDER BY turn) FILTER (r <= 4) AS synthesis
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) GROUP BY conv_id""",
)
def conversation_windows(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    c = table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(w)).filter("r <= 6")
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.col("turn").cast("string")).alias("s"), "r")))
    g = c.groupBy("conv_id").agg(turns.alias("t"))
    return g.select("conv_id", F.array_join("t.s", ",").alias("classify"), F.array_join(F.transform(F.filter("t", lambda x: x.r <= 4), lambda x: x.s), ",").alias("synthesis"))


@query("FN-38", "SELECT a.conv_id, a.turn, 'user: ' || a.text || chr(10) || 'assistant: ' || b.text AS chat FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def chat_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.filter("role = 'user'").join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.concat(F.lit("user: "), "text", F.lit("\nassistant: "), "reply").alias("chat"))


@query("FN-39", _FILES + r" SELECT doc_id, repo_id || '::' || CASE WHEN file_path LIKE '%/%' THEN regexp_extract(file_path, '^([^/]*)/', 1) ELSE 'root' END AS stratum FROM files")
def strata(spark, sf_dir):
    top = F.when(F.col("file_path").contains("/"), F.substring_index("file_path", "/", 1)).otherwise("root")
    return view(spark, sf_dir, "files").select("doc_id", F.concat("repo_id", F.lit("::"), top).alias("stratum"))


@query("FN-40", "SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:10], ',') AS keywords FROM benchmark")
def default_keywords(spark, sf_dir):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(w, 1, 10), ",").alias("keywords"))


def _or(column: str, words: list[str], test: str) -> str:
    return "(" + " OR ".join(test.format(c=column, w=w) for w in words) + ")"


@query(
    "FLT-01",
    _FILES
    + f""", n AS (SELECT *, {_BASE} AS name FROM files) SELECT doc_id FROM n WHERE NOT ({_or('name', paths.GENERATED_SUFFIXES, "ends_with({c}, '{w}')")} OR {_or('lower(name)', paths.BUNDLE_WORDS + paths.GENERATED_WORDS, "contains({c}, '{w}')")}
  OR {_or('name', paths.LOCK_FILES, "{c} = '{w}'")} OR {_or('file_path', paths.BUILD_DIRS, "contains({c}, '/{w}/') OR starts_with({c}, '{w}/')")} OR strlen(content) > 500000
  OR ((ends_with(name, '.js') OR ends_with(name, '.css')) AND strlen(content) > 50000 AND len(list_filter(string_split(left(content, 10000), chr(10))[1:10], lambda x: length(x) > 500)) > 0))""",
)
def kept_files(spark, sf_dir):
    skip = paths.skipped(F.col("file_path"), F.octet_length("content"), F.col("content"))
    return view(spark, sf_dir, "files").filter(~skip).select("doc_id")


@query("FLT-02", r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50 AS code, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100 AS document FROM documents")
def large_enough(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.long_enough(t, 50).alias("code"), text.long_enough(t, 100).alias("document"))


@query("FLT-03", _FILES + rf" SELECT doc_id, CASE WHEN regexp_matches(file_path, '\.(md|rst|txt)$') THEN 'doc' WHEN {_case(paths.PARSER_LANGUAGES, _SUFFIX, 'NULL')} IS NOT NULL THEN 'code' ELSE 'other' END AS kind FROM files")
def changed_kinds(spark, sf_dir):
    p = F.col("file_path")
    return view(spark, sf_dir, "files").select("doc_id", F.when(paths.is_document(p), "doc").when(paths.parser_language(p).isNotNull(), "code").otherwise("other").alias("kind"))


@query("FLT-04", _FILES + " SELECT doc_id FROM files WHERE lang IN ('en', 'de') AND repo_id = 'src3' AND file_path LIKE 'src1/%'")
def universal_predicate(spark, sf_dir):
    return view(spark, sf_dir, "files").filter(F.col("lang").isin("en", "de") & (F.col("repo_id") == "src3") & F.col("file_path").startswith("src1/")).select("doc_id")


@query("FLT-05", "SELECT d.doc_id, l.quality IS NULL AS missing, d.source NOT IN ('src1', 'src2') AS allowed, len(string_split(text, ' ')) > 0 AS filled, lang LIKE '%e%' AS likely FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def missing_predicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.col("quality").isNull().alias("missing"), (~F.col("source").isin("src1", "src2")).alias("allowed"), (F.size(F.split("text", " ")) > 0).alias("filled"), F.col("lang").like("%e%").alias("likely"))


@query("FLT-06", _FILES + f" SELECT repo_id, {_DIR} AS module_path, count(*) AS n FROM files GROUP BY ALL")
def direct_children(spark, sf_dir):
    return view(spark, sf_dir, "files").groupBy("repo_id", paths.dirname(F.col("file_path")).alias("module_path")).agg(F.count("*").alias("n"))


@query("FLT-07", _FILES + f" SELECT doc_id FROM files WHERE {_BASE} GLOB 'm*.py'")
def glob_filter(spark, sf_dir):
    return view(spark, sf_dir, "files").filter(paths.basename(F.col("file_path")).rlike(paths.glob_pattern("m*.py").replace(r"\Z", "$").replace(r"\z", "$"))).select("doc_id")


@query("FLT-08", _SYMBOLS + " SELECT l_orderkey, l_linenumber, end_line - start_line + 1 >= 5 AS significant FROM symbols")
def significant_symbols(spark, sf_dir):
    return view(spark, sf_dir, "symbols").select("l_orderkey", "l_linenumber", (F.col("end_line") - F.col("start_line") + 1 >= 5).alias("significant"))


@query("FLT-09", _FILES + " SELECT doc_id FROM files WHERE starts_with(file_path, 'src0/') OR starts_with(file_path, 'src2/de')")
def prefix_filter(spark, sf_dir):
    hit = F.exists(F.array(F.lit("src0/"), F.lit("src2/de")), lambda p: F.col("file_path").startswith(p))
    return view(spark, sf_dir, "files").filter(hit).select("doc_id")


@query("FLT-10", "SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'aggregated_from_symbols' WHEN 0 THEN 'fallback' END, '') <> 'aggregated_from_symbols' OR coalesce(CASE toxic WHEN 0 THEN 'llm_summary' END, '') <> 'llm_summary' AS stale FROM documents LEFT JOIN labels USING (doc_id)")
def stale_summaries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    source = F.when(F.col("quality") == 1, "aggregated_from_symbols").when(F.col("quality") == 0, "fallback")
    level = F.when(F.col("toxic") == 0, "llm_summary")
    stale = (F.coalesce(source, F.lit("")) != "aggregated_from_symbols") | (F.coalesce(level, F.lit("")) != "llm_summary")
    return d.select("doc_id", stale.alias("stale"))


@query("PRJ-01", _FILES + f" SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN file_path WHEN 1 THEN {_DIR} ELSE repo_id END AS path FROM files")
def polymorphic_path(spark, sf_dir):
    k = F.col("doc_id") % 3
    return view(spark, sf_dir, "files").select("doc_id", F.when(k == 0, F.col("file_path")).when(k == 1, paths.dirname(F.col("file_path"))).otherwise(F.col("repo_id")).alias("path"))


@query("PRJ-02", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def clipped_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clipped(F.col("text")).alias("preview"))


@query("PRJ-03", _FILES + " SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN '' END, ''), nullif(CASE WHEN doc_id % 4 = 1 THEN lang END, ''), file_path, '') AS name FROM files")
def display_names(spark, sf_dir):
    k = F.col("doc_id") % 4
    return view(spark, sf_dir, "files").select("doc_id", text.first_filled(F.when(k == 0, F.lit("")), F.when(k == 1, F.col("lang")), F.col("file_path")).alias("name"))


@query("FN-18", "SELECT doc_id, doc_id % 4 IN (1, 3) AS inside FROM documents")
def path_guards(spark, sf_dir):
    made = F.element_at(F.array(F.lit("../x"), F.lit("a/../b"), F.lit("a/../../c"), F.lit("a/./b/../c")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", paths.stays_inside(made).alias("inside"))


@query("FN-19", r"SELECT page_id, regexp_matches(regexp_extract(url, '://([^/]*)', 1), '^[A-Za-z_][A-Za-z0-9_\-]*$') AS ok FROM pages")
def name_guards(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.is_store_name(F.regexp_extract("url", "://([^/]*)", 1)).alias("ok"))
