"""Extraction over a handful of source files, documents and a log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import extraction as X
from quern.operators import incremental as I
from quern.plans.registry import query
from quern.sources import code
from quern.sources import repositories as S
from quern.sources.tables import ctes, table, view

_CODE = code.values(code.FILES, "repo_id, file_path, language, content")
_DOCS = code.values(code.DOCUMENTS, "repo_id, file_path, content")


def _expected(rows: list[tuple], columns: str) -> str:
    spelled = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(spelled, r)) + ")" for r in rows) + f") t({columns})"


def _symbols(spark, language: str, find=None):
    f = code.files(spark).filter(F.col("language") == language)
    return X.extract(f, find or X.PARSERS[language], X.SYMBOL).select("file_path", "name", "kind", "start_line", "end_line")


_S = "file_path, name, kind, start_line, end_line"


@query("EXT-01", _expected([("pkg/core.py", "top", "function", 6, 8), ("pkg/core.py", "Store", "class", 11, 18), ("pkg/core.py", "Store.save", "method", 14, 15), ("pkg/core.py", "Store.load", "method", 17, 18)], _S))
def python_symbols(spark, sf_dir):
    return _symbols(spark, "python").filter("file_path = 'pkg/core.py'")


@query("EXT-02", _expected([("pkg/broken.py", "good", "function", 1, 4), ("pkg/broken.py", "bad", "function", 4, 9), ("pkg/broken.py", "Odd", "class", 7, 9)], _S))
def python_by_pattern(spark, sf_dir):
    return _symbols(spark, "python").filter("file_path = 'pkg/broken.py'")


@query("EXT-03", _expected([("web/app.js", "run", "function", 4, 8), ("web/app.js", "build", "function", 8, 9), ("web/app.js", "View", "class", 9, 12)], _S))
def script_symbols(spark, sf_dir):
    return _symbols(spark, "javascript")


@query("EXT-04", _expected([("src/Main.java", "Main", "class", 4, 12), ("src/Main.java", "Main", "function", 6, 6), ("src/Main.java", "get", "function", 7, 10), ("src/Main.java", "Kind", "enum", 11, 11)], _S))
def java_symbols(spark, sf_dir):
    return _symbols(spark, "java")


@query("EXT-05", _expected([("src/lib.rs", "P", "struct", 2, 2), ("src/lib.rs", "P", "impl", 3, 5), ("src/lib.rs", "P.new", "method", 4, 4), ("src/lib.rs", "fmt::Display for P", "impl", 6, 8), ("src/lib.rs", "P.fmt", "method", 7, 7), ("src/lib.rs", "free", "function", 9, 9)], _S))
def rust_symbols(spark, sf_dir):
    return _symbols(spark, "rust")


@query("EXT-06", _expected([("ios/App.swift", "App", "class", 2, 5), ("ios/App.swift", "init", "function", 3, 3), ("ios/App.swift", "start", "function", 4, 4), ("ios/App.swift", "App", "extension", 6, 8), ("ios/App.swift", "stop", "function", 7, 7)], _S))
def swift_symbols(spark, sf_dir):
    return _symbols(spark, "swift")


@query("EXT-07", _expected([("lib/a.ex", "Shop.Cart", "module", 1, 7), ("lib/a.ex", "add", "function", 3, 5), ("lib/a.ex", "size", "function", 6, 6)], _S))
def elixir_symbols(spark, sf_dir):
    return _symbols(spark, "elixir")


def _component_sql() -> str:
    t = {k: "'" + v.replace("'", "''") + "'" for k, v in X.SECTION_TAGS.items()}
    bare = lambda e: rf"sha256(regexp_replace({e}, '^\s+|\s+$', '', 'g'))"
    rest = f"regexp_replace(regexp_replace(html, {t['any script']}, '', 'g'), {t['any style']}, '', 'g')"
    script, style = f"regexp_extract(html, {t['script']}, 2)", f"regexp_extract(html, {t['style']}, 1)"
    return f"SELECT page_id, {bare(script)} AS script, {bare(style)} AS style, {bare(rest)} AS template FROM pages"


@query("EXT-08", _component_sql())
def component_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", X.component_parts(F.col("html")).alias("p"))
    return p.select("page_id", *[F.sha2(F.col("p")[c], 256).alias(c) for c in ("script", "style", "template")])


@query("EXT-08b", _expected([("web/Form.vue <script>", "send", "function", 2, 5), ("web/Form.vue <script>", "clear", "function", 5, 5)], _S))
def component_symbols(spark, sf_dir):
    return X.component_symbols(code.components(spark)).select("file_path", "name", "kind", "start_line", "end_line")


@query("EXT-09", _expected([("users", "sql_table", 1), ("FindUser", "sql_query", 2), ("DELETE", "sql_statement", 5)], "name, kind, start_line"))
def sql_statements(spark, sf_dir):
    return X.sql_statements(code.files(spark).filter("language = 'sql'")).select("name", "kind", "start_line")


@query(
    "EXT-10",
    _expected([("pkg/core.py", "os,pkg.util"), ("pkg/broken.py", ""), ("web/app.js", "y"), ("web/Card.svelte", ""), ("src/Main.java", "java.util.List,a.B.*"), ("src/lib.rs", ""), ("ios/App.swift", "Foundation"), ("lib/a.ex", "Shop.Item"), ("db/schema.sql", "")], "file_path, imports"),
)
def imports(spark, sf_dir):
    return code.files(spark).select("file_path", F.array_join(X.imports(F.col("content"), F.col("language")), ",").alias("imports"))


@query("EXT-11", _expected([("pkg/core.py", 0, "metadata", 1, 5), ("pkg/core.py", 1, "file", 1, 19)], "file_path, ordinal, kind, start_line, end_line"))
def file_chunks(spark, sf_dir):
    f = code.files(spark).filter("file_path = 'pkg/core.py'")
    return X.extract(f, X.file_chunks, "ordinal int, kind string, start_line int, end_line int").drop("repo_id")


@query("EXT-12", _expected([("a1b2c3d4", "ann@x.org", "Add | pipes", 3, 1, 2), ("b2c3d4e5", "bob@x.org", "Fix", 10, 0, 1)], "hash, author, subject, added, deleted, n_files"))
def commit_log(spark, sf_dir):
    return X.extract(code.log(spark), X.commit_log, "hash string, author string, date string, subject string, added int, deleted int, n_files int").select("hash", "author", "subject", "added", "deleted", "n_files")


@query(
    "EXT-13",
    """WITH c AS (SELECT user_id AS repo_id, event_id AS ordinal, CASE WHEN event_type = 'error' THEN 'no_commit' WHEN event_type <> 'view' THEN left(sha256(event_type || cast(floor(value / 50) AS BIGINT)), 12) END AS commit_hash, event_type || '@x.org' AS author, 'f' || event_id % 90 AS file_path FROM events)
SELECT repo_id, commit_hash, author, file_path AS files FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, commit_hash ORDER BY ordinal) AS r FROM c WHERE commit_hash <> 'no_commit') WHERE r = 1""",
)
def commits_of_chunks(spark, sf_dir):
    key = F.left(F.sha2(F.concat("event_type", F.floor(F.col("value") / 50).cast("string")), 256), F.lit(12))
    known = F.when(F.col("event_type") == "error", X.NO_COMMIT).when(F.col("event_type") != "view", key)
    chunks = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("repo_id"), F.col("event_id").alias("ordinal"), known.alias("commit_hash"), F.concat("event_type", F.lit("@x.org")).alias("author"), F.concat(F.lit("f"), (F.col("event_id") % 90).cast("string")).alias("file_path")
    )
    return X.commits_of_chunks(chunks).select("repo_id", "commit_hash", "author", F.array_join("files_changed", ",").alias("files"))


@query(
    "EXT-13b",
    """WITH c AS (SELECT o_orderkey AS h, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
t AS (SELECT l_orderkey AS h, 'f' || l_suppkey % 4 AS path, max(l_partkey) % 3 AS blob FROM lineitem GROUP BY ALL),
n AS (SELECT c.h, path, blob FROM c JOIN t ON c.h = t.h WHERE c.p IS NOT NULL), o AS (SELECT c.h, path, blob FROM c JOIN t ON c.p = t.h),
d AS (SELECT coalesce(n.h, o.h) AS h, coalesce(n.path, o.path) AS path FROM n FULL JOIN o ON n.h = o.h AND n.path = o.path WHERE n.blob IS DISTINCT FROM o.blob)
SELECT c.h AS commit_hash, coalesce(string_agg(path, ',' ORDER BY path), '') AS files FROM c LEFT JOIN d ON c.h = d.h GROUP BY c.h""",
)
def commit_history(spark, sf_dir):
    parent = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    commits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_hash"), parent.alias("parent"))
    path = F.concat(F.lit("f"), (F.col("l_suppkey") % 4).cast("string"))
    trees = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("commit_hash"), path.alias("path")).agg((F.max("l_partkey") % 3).alias("blob"))
    return X.history(commits, trees).select("commit_hash", F.array_join("files_changed", ",").alias("files"))


@query("EXT-14", _expected([(0, None, 0, ""), (1, "Guide", 1, "Guide"), (2, "Setup", 2, "Guide > Setup"), (3, "Linux", 3, "Guide > Setup > Linux"), (4, "Usage", 2, "Guide > Usage")], "ordinal, title, level, header_path"))
def markdown_sections(spark, sf_dir):
    return X.extract(code.documents(spark).filter("file_path = 'docs/guide.md'"), X.markdown_sections, X.SECTION).select("ordinal", "title", "level", "header_path")


@query("EXT-15", _expected([(0, "Title", 1, "Title"), (1, "Part", 2, "Title > Part"), (2, "Other", 2, "Title > Other")], "ordinal, title, level, header_path"))
def underlined_sections(spark, sf_dir):
    return X.extract(code.documents(spark).filter("file_path = 'docs/old.rst'"), X.underlined_sections, X.SECTION).select("ordinal", "title", "level", "header_path")


@query("EXT-16", _expected([("conf/app.json", "name,port"), ("conf/app.yaml", "name,port")], "file_path, keys"))
def structured_documents(spark, sf_dir):
    return X.extract(code.documents(spark).filter("file_path LIKE 'conf/%'"), X.structured_document, "keys string, body string").select("file_path", "keys")


@query("EXT-17")
def document_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("x.md").alias("file_path"), "text")
    return X.extract(d, X.document_chunks, X.SECTION, ("doc_id", "file_path"), "text").select("doc_id", "ordinal", F.length("body").alias("length"))


@query("EXT-18", rf"SELECT file_path, regexp_matches(content, '(?m)^#\s+(?:Feature\s+)?Spec:\s*(.+)$') AS is_spec FROM {_DOCS}")
def spec_detection(spark, sf_dir):
    return code.documents(spark).select("file_path", X.is_spec(F.col("content")).alias("is_spec"))


@query("EXT-19", _expected([("Login Form", "sign in,log in,auth", "L0,L1,L2", "LoginForm,AuthBox")], "spec_name, intents, levels, components"))
def spec_metadata(spark, sf_dir):
    m = code.documents(spark).filter("file_path = 'docs/spec.md'").select(X.spec_metadata(F.col("content")).alias("m"))
    return m.select("m.spec_name", F.array_join("m.intent_patterns", ",").alias("intents"), F.array_join("m.l_levels", ",").alias("levels"), F.array_join("m.components", ",").alias("components"))


_LANGUAGES = ["go", "python", "javascript", "svelte"]
_CHUNKED = "(SELECT doc_id, text, ['go', 'python', 'javascript', 'svelte'][(doc_id % 4 + 1)::INT] AS language, doc_id % 3 + 1 AS chunks, CASE WHEN doc_id % 7 = 0 THEN 'pkg/Api.x' ELSE 'pkg/x' END AS path, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents)"


def _reasons_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    sql = " OR ".join(f"regexp_matches(text, {quote(p)})" for p, n in X.EMBEDDED if n == "embedded_sql")
    formats, templates = (f"len(regexp_extract_all(text, {quote(p)}))" for p in (r"\.format\s*\(|%\s*\(|f[\"']", r"`[^`]*\$\{[^}]+\}[^`]*`"))
    cases = [
        "CASE WHEN length(text) > 5000 AND chunks <= 1 THEN 'large_file_single_chunk (' || length(text) || ' chars, ' || chunks || ' chunks)' END",
        "CASE WHEN lines / chunks > 100 THEN 'high_density (' || round_even(lines / chunks, 0)::BIGINT || ' lines/chunk)' END",
        *[f"CASE WHEN regexp_matches(text, {quote(p)}) THEN '{n}' END" for p, n in X.EMBEDDED],
        f"CASE WHEN language = 'python' AND regexp_matches(text, {quote(r'(?i)\.execute\s*\(|\.query\s*\(|cursor\.|rawsql|text\s*\(')}) AND NOT ({sql}) THEN 'sql_execution_pattern' END",
        f"CASE WHEN language = 'python' AND {formats} > 5 THEN 'heavy_string_formatting (' || {formats} || ' instances)' END",
        f"CASE WHEN language = 'javascript' AND {templates} > 3 THEN 'template_literals (' || {templates} || ' instances)' END",
        "CASE WHEN language = 'svelte' AND chunks <= 2 THEN 'unsupported_language_minimal_chunks (svelte)' END",
        "CASE WHEN contains(lower(path), 'api') AND chunks <= 2 THEN 'important_file_minimal_chunks' END",
    ]
    return f"SELECT doc_id, coalesce(nullif(array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), '; '), ''), 'adequately_chunked') AS reason FROM {_CHUNKED}"


@query("EXT-20", _reasons_sql())
def underchunked_files(spark, sf_dir):
    """Every document as a file of some language, with one to three chunks."""
    language = F.element_at(F.array(*map(F.lit, _LANGUAGES)), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.when(F.col("doc_id") % 7 == 0, "pkg/Api.x").otherwise("pkg/x")
    return table(spark, sf_dir, "documents").select("doc_id", X.underchunked(path, F.col("text"), F.col("doc_id") % 3 + 1, language).alias("reason"))


@query("EXT-21", "SELECT l_orderkey, l_linenumber, round(l_discount * 10, 6) AS confidence FROM lineitem WHERE round(l_discount * 10, 6) >= 0.7")
def confident_chunks(spark, sf_dir):
    c = F.round(F.col("l_discount") * 10, 6)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c.alias("confidence")).filter("confidence >= 0.7")


_MERGE = "(SELECT l_suppkey AS f, l_partkey % 20 AS name, l_linenumber <= 2 AS structural, l_orderkey * 10 + l_linenumber AS s, l_quantity > 40 AS significant FROM lineitem)"


@query("EXT-22", f"SELECT 'f' || cast(f AS varchar) AS file_path, 'n' || cast(name AS varchar) AS name, min_by(s, (CASE WHEN structural THEN 0 ELSE 1 END, s)) AS start_line, bool_or(significant) AS significant FROM {_MERGE} GROUP BY 1, 2")
def merged_symbols(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file_path"),
        F.concat(F.lit("n"), (F.col("l_partkey") % 20).cast("string")).alias("name"),
        F.lit("function").alias("kind"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("start_line"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("end_line"),
        F.lit(None).cast("string").alias("docstring"),
        (F.col("l_quantity") > 40).alias("significant"),
        (F.col("l_linenumber") <= 2).alias("structural"),
    )
    return X.merged_symbols(s).select("file_path", "name", "start_line", "significant")


@query("EXT-23", "SELECT 'f' || cast(l_suppkey AS varchar) AS file_path, string_agg('n' || cast(s AS varchar), ',' ORDER BY d, s) AS names FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS s, CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 1 END AS d FROM lineitem WHERE l_quantity > 45) GROUP BY 1")
def file_blocks(spark, sf_dir):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    file = F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file_path")
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    s = l.select(file, F.concat(F.lit("n"), k.cast("string")).alias("name"), k.alias("start_line"), F.when(F.col("l_partkey") % 2 == 0, "doc").alias("docstring"), (F.col("l_quantity") > 45).alias("significant"))
    none = l.select(file, F.array().cast("array<string>").alias("imports")).limit(0)
    return X.file_blocks(s, none).select("file_path", F.array_join("names", ",").alias("names"))


@query("EXT-24")
def fitted_blocks(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    s = l.select(F.concat(F.lit("m"), (F.col("l_suppkey") % 50).cast("string")).alias("module"), F.concat(F.lit("f"), (F.col("l_orderkey") % 9).cast("string")).alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_quantity").cast("bigint").alias("size"))
    return I.fitted_blocks(s, 2400)


EMBEDDING_BUDGET, EMBEDDING_ITEMS = 65_536, 64


@query("EXT-25")
def embedding_batches(spark, sf_dir):
    """(doc_id, batch, width): batches within a padded budget, of the rows that come to one task together; batches are named by their first document."""
    import pandas as pd

    def run(frames):
        for b in frames:
            size = dict(zip(b.doc_id.tolist(), b.n_chars.tolist(), strict=True))
            out = [(i, ids[0], size[ids[0]]) for ids in I.batches_by_budget(size.items(), EMBEDDING_BUDGET, EMBEDDING_ITEMS) for i in ids]
            yield pd.DataFrame(out, columns=["doc_id", "batch", "width"])

    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").mapInPandas(run, "doc_id bigint, batch bigint, width bigint")


@query("EXT-26", _expected([("def f(v0, v1=1):\n    return helper(v0) + v1",)], "renamed"))
def renamed_functions(spark, sf_dir):
    source = F.regexp_extract("content", r"(?s)(def top.*?\n)\n\n", 1)
    return code.files(spark).filter("file_path = 'pkg/core.py'").select(X.arrow_udf(X.renamed_function, "string")(source).alias("renamed"))


@query("EXT-27")
def syntax_shingles(spark, sf_dir):
    shingles = X.arrow_udf(X.syntax_shingles, "array<string>")
    return code.files(spark).filter("language = 'python'").select("file_path", F.size(shingles("content")).alias("n"))


_LINES = "files_changed AS (SELECT repo_id, file_path, doc_id % 5 AS kind FROM files)"


@query(
    "SRC-07",
    ctes("files")
    + f""", {_LINES} SELECT repo_id, 'M' AS change, file_path FROM files_changed WHERE kind = 0 UNION ALL SELECT repo_id, 'A', file_path FROM files_changed WHERE kind = 1 UNION ALL SELECT repo_id, 'D', file_path FROM files_changed WHERE kind IN (2, 3)
UNION ALL SELECT repo_id, 'A', 'moved/' || file_path FROM files_changed WHERE kind IN (3, 4)""",
)
def change_lists(spark, sf_dir):
    """Every file on a line of a list of names: changed, added, deleted, renamed or copied."""
    k, p = F.col("doc_id") % 5, F.col("file_path")
    tab = F.lit("\t")
    line = (
        F.when(k == 0, F.concat(F.lit("M"), tab, p)).when(k == 1, F.concat(F.lit("A"), tab, p)).when(k == 2, F.concat(F.lit("D"), tab, p))
        .when(k == 3, F.concat(F.lit("R097"), tab, p, tab, F.lit("moved/"), p)).otherwise(F.concat(F.lit("C100"), tab, p, tab, F.lit("moved/"), p))
    )
    return S.name_status(view(spark, sf_dir, "files").select("repo_id", line.alias("content")))


def _checkout(spark):
    from quern.operators.graph import scratch

    return S.discovered_files(spark, code.checkout(spark, scratch(spark)))


@query("SRC-01", "SELECT * FROM (VALUES ('acme/app'), ('other/tool')) t(repo_id)")
def discovered_repositories(spark, sf_dir):
    return S.repositories(_checkout(spark))


@query("SRC-02", "SELECT * FROM (VALUES ('a/x'), ('b/y')) t(repo_id)")
def canonical_repositories(spark, sf_dir):
    return spark.createDataFrame([(r,) for r in S.canonical_repositories([], ["b/y", "a/x", "a/x"], ["c/z"])], "repo_id string")


@query("SRC-03", f"SELECT 'acme/app' AS repo_id, file_path FROM {_CODE} UNION ALL VALUES ('acme/app', 'pkg/latin.py'), ('other/tool', 'main.py')")
def code_files(spark, sf_dir):
    return S.code_files(_checkout(spark)).select("repo_id", "file_path")


@query("SRC-04", f"SELECT file_path FROM {_DOCS} WHERE file_path LIKE '%.md' OR file_path LIKE '%.rst'")
def document_files(spark, sf_dir):
    return S.document_files(_checkout(spark)).select("file_path")


@query("SRC-05", "SELECT doc_id % 7 = 3 AS bad, doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text ELSE lang END) AS content FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 <> 0")
def file_contents(spark, sf_dir):
    """A commit that has every third file, some with bytes that are no UTF-8, and a working tree that lacks every fifth."""
    d = table(spark, sf_dir, "documents").select(F.lit("r").alias("repo_id"), F.col("doc_id").alias("file_path"), "text", "lang")
    odd = F.when(F.col("file_path") % 7 == 3, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit("")))
    blobs = d.filter("file_path % 3 = 0").withColumn("content", F.concat(F.encode("text", "UTF-8"), odd))
    tree = d.filter("file_path % 5 <> 0").withColumn("content", F.encode("lang", "UTF-8"))
    return S.at_commit(d, blobs, tree).select((F.col("file_path") % 7 == 3).alias("bad"), F.col("file_path").alias("doc_id"), F.sha2("content", 256).alias("content"))


@query("SRC-06", _expected([("2024-01-02T03:04:05+00:00",), ("2024-01-03T00:00:00+00:00",)], "date"))
def log_source(spark, sf_dir):
    return X.extract(code.log(spark), X.commit_log, "hash string, author string, date string, subject string, added int, deleted int, n_files int").select("date")


@query("SRC-08", _expected([("a", "a2.py", "b,c"), ("b", "b.py", "")], "module, path, imports"))
def dependency_files(spark, sf_dir):
    rows = [(0, '{"a": {"path": "a.py", "imports": ["x"]}, "b": {"path": "b.py"}}'), (1, '{"a": {"path": "a2.py", "imports": ["b", "c"], "imported_by": []}}')]
    d = S.dependency_json(spark.createDataFrame(rows, "ordinal int, content string"))
    return d.select("module", "path", F.array_join("imports", ",").alias("imports"))
