"""Retrieval: filtered exact nearest neighbours, BM25, merging, gating and drill-down."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors
from quern.operators import lexical, products

# Document types by level, drill-down tables and thresholds.
LEVEL_TYPES = {
    "symbol": ["symbol_index"],
    "file": ["file_index"],
    "module": ["module_summary"],
    "repo": ["repo_summary"],
    "doc": ["document", "spec"],
    "spec": ["spec"],
    "commit": ["commit_index"],
}
START_LEVELS = {
    "code_explanation": "file",
    "architecture": "module",
    "impact_analysis": "file",
    "specific_lookup": "symbol",
    "documentation": "doc",
    "capability_check": "repo",
    "proposal_draft": "module",
    "experience_summary": "repo",
    "change_history": "commit",
}
PATHS = {"broad": ["repo", "module", "file"], "narrow": ["file", "symbol", "module"], "specific": ["symbol", "file"]}
SALES_PATH = ["module", "doc"]
OUT_OF_DOMAIN, ADEQUATE_SCORE, ADEQUATE_RESULTS = 0.45, 0.65, 2
# Intents of each persona, its default, and the directions of a search.
PERSONA_INTENTS = {
    "developer": ["code_explanation", "architecture", "impact_analysis", "specific_lookup", "documentation", "change_history"],
    "sales": ["capability_check", "proposal_draft", "experience_summary", "change_history"],
}
DEFAULT_INTENTS = {"developer": "code_explanation", "sales": "capability_check"}
DIRECTIONS = ["broad", "narrow", "specific"]
# Words that an English analyzer leaves out.
ENGLISH_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]
_STOPS = frozenset(ENGLISH_STOP_WORDS)
NO_WORD = r"[^\p{L}\p{N}]+"
LEXICAL_OVERSAMPLE, LEXICAL_REPOS = 4, 3
CONTEXT_CHARS, BRIDGE_CONTENTS, BRIDGE_MODULES = 2000, 3, 5
RERANK_HEAD = 20
K1, B = 1.2, 0.75


def doc_types(level: str, persona: str = "") -> list[str]:
    if level == "repo" and persona == "sales":
        return ["repo_bdr", "repo_summary"]
    return LEVEL_TYPES[level]


def drill_path(intent: str, direction: str, persona: str = "") -> list[str]:
    """The levels to search, in order; the repository pass comes before and is not among them."""
    path = [x for x in (SALES_PATH if persona == "sales" else PATHS[direction]) if x != "repo"]
    start = START_LEVELS.get(intent, "file")
    if start == "repo":
        return path
    return [start, *[x for x in path if x != start]]


def nearest(queries: DataFrame, items: DataFrame, k: int, per_type: int | None = None, same_type: bool = False, max_queries: int = 100_000) -> DataFrame:
    """(query_id, item_id, type, score, rank) of the k best items of each query.

    ``queries`` is (query_id, qvec[, type]), ``items`` (item_id, type, vec). The
    queries are sent to every task, which is refused beyond ``max_queries``; the
    items, however many, are read once. All pairs are scored, by products of
    blocks, but a task hands on only its own best of a query. Ties fall to the
    smaller item.
    """
    narrow = bool(per_type) and per_type < k
    q = queries.withColumnRenamed("type", "qtype") if "type" in queries.columns else queries
    scored = products.best(q, items, per_type if narrow else k, max_queries, each_type=narrow, same_type=same_type)
    order = [F.desc("score"), F.asc("item_id")]
    if narrow:
        scored = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "type").orderBy(*order))).filter(F.col("r") <= per_type).drop("r")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def target_ranks(queries: DataFrame, items: DataFrame, targets: DataFrame, max_queries: int = 100_000) -> DataFrame:
    """(query_id, rank): one more than the items that score higher than the target of a query, from ``targets`` (query_id, item_id)."""
    wanted = queries.join(targets.distinct(), "query_id").filter("item_id <> query_id")
    t = items.join(F.broadcast(wanted), "item_id").select("query_id", F.round(vectors.dot(F.col("qvec"), F.col("vec")), 6).alias("t"))
    found = products.ahead(queries.join(t, "query_id"), items, max_queries)
    return found.groupBy("query_id").agg((F.sum("ahead") + 1).alias("rank"))


def tokens(text: Column, english: bool = False) -> Column:
    """Lower-cased runs of letters and digits; the English analyzer leaves out stop words and takes plurals for singulars."""
    words = F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")
    if not english:
        return words
    kept = F.filter(words, lambda w: ~w.isin(ENGLISH_STOP_WORDS))
    return F.transform(
        kept,
        lambda w: F.when(w.rlike("[^ea]ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("[^aeo]es$"), F.regexp_replace(w, "s$", "")).when(w.rlike("[^use]s$"), F.regexp_replace(w, "s$", "")).otherwise(w),
    )


def english_word(word: str) -> str | None:
    """What the English analyzer makes of a lower-cased word; none of a stop word. As ``tokens`` does."""
    if word in _STOPS:
        return None
    if word.endswith("ies") and len(word) > 3 and word[-4] not in "ea":
        return word[:-3] + "y"
    if word.endswith("es") and len(word) > 2 and word[-3] not in "aeo" or word.endswith("s") and len(word) > 1 and word[-2] not in "use":
        return word[:-1]
    return word


def plain_word(word: str) -> str:
    return word


def bm25(docs: DataFrame, queries: DataFrame, k: int, id: str = "doc_id", text: str = "text", qid: str = "item_id", qtext: str = "text", english: bool = False, max_terms: int = 1_000_000) -> DataFrame:
    """(query_id, id, score, rank) of the k best documents of each query.

    Documents are read twice, as Arrow batches of words: for the number of
    documents with each term, and for the scores, of which a task hands on only
    its own k best of a query. The queries' terms are sent to every task, which
    is refused beyond ``max_terms``. Only where documents share an id, whose
    words count together, are words exchanged.
    """
    asked = queries.select(F.col(qid).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(qtext), english))).alias("term")).distinct()
    terms = asked.select("term").distinct()
    if terms.limit(max_terms + 1).count() > max_terms:
        raise ValueError("too many query terms for one pass; search in blocks")
    d = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    if d.groupBy("id").count().filter("count > 1").limit(1).count():
        scored = _bm25_by_words(d, asked, terms, english)
    else:
        scored = _bm25_by_batches(d, asked, k, english)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _bm25_by_batches(docs: DataFrame, asked: DataFrame, k: int, english: bool) -> DataFrame:
    split = docs.select("id", F.split(F.lower("text"), NO_WORD).alias("w"))
    pairs = asked.toArrow()
    known = sorted(set(pairs.column("term").to_pylist()))
    analyzed = english_word if english else plain_word
    n, words, df = lexical.statistics(split, known, analyzed)
    idf = np.array([math.log(1 + (n - x + 0.5) / (x + 0.5)) for x in df.tolist()])
    return lexical.best(split, pairs, asked.schema["query_id"].dataType.simpleString(), known, idf, words / max(1, n), k, K1, B, analyzed)


def _bm25_by_words(docs: DataFrame, asked: DataFrame, terms: DataFrame, english: bool) -> DataFrame:
    """Scores of all documents; the words of documents of one id and length count together."""
    split = docs.select("id", tokens(F.col("text"), english).alias("w")).withColumn("len", F.size("w"))
    sizes = split.filter("len > 0").agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    used = split.select("id", "len", F.explode("w").alias("term")).join(F.broadcast(terms), "term", "left_semi").groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    by_term = F.broadcast(asked.join(df, "term").join(F.broadcast(sizes)).select("query_id", "term", idf.alias("idf"), "avg"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return used.join(by_term, "term").groupBy("query_id", "id").agg(F.round(F.sum(weight), 6).alias("score"))


def first_repos(hits: DataFrame, repos: DataFrame, n: int) -> DataFrame:
    """(query_id, id, rank): the first n repositories of ranked hits (query_id, id, rank), by ``repos`` (id, repo_id)."""
    best = hits.join(repos, "id").groupBy("query_id", "repo_id").agg(F.min("rank").alias("at"))
    w = Window.partitionBy("query_id").orderBy("at")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("query_id", F.col("repo_id").alias("id"), "rank")


def lexical_repos(docs: DataFrame, queries: DataFrame, repos: DataFrame, n: int = LEXICAL_REPOS, english: bool = False, **columns) -> DataFrame:
    """(query_id, id, rank): n repositories by BM25, from four times as many hits."""
    return first_repos(bm25(docs, queries, LEXICAL_OVERSAMPLE * n, english=english, **columns), repos, n)


def same_query(query: Column, contents: Column) -> Column:
    """The rewriter of a deployment without a language model."""
    return query


def bridge(queries: DataFrame, modules: DataFrame, files: DataFrame, k: int, rewrite=same_query) -> DataFrame:
    """(query_id, item_id, type, score, rank): files of the best modules, ranked by the rewritten query.

    ``modules`` is (item_id, type, vec), ``files`` also has parent_id. The query
    is rewritten by what the first modules say, given as an array of their
    vectors by rank, and the second pass is narrowed to children of the first
    modules. Both sides that are broadcast are as many as the queries allow.
    """
    hits = nearest(queries, modules, BRIDGE_MODULES)
    told = hits.filter(F.col("rank") <= BRIDGE_CONTENTS).join(modules.select("item_id", "vec"), "item_id")
    told = told.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec"))), lambda x: x["vec"]).alias("contents"))
    asked = queries.join(told, "query_id").select("query_id", rewrite(F.col("qvec"), F.col("contents")).alias("qvec"))
    narrowed = files.join(F.broadcast(hits.select(F.col("item_id").alias("parent_id"), "query_id")), "parent_id").join(F.broadcast(asked), "query_id")
    scored = narrowed.select("query_id", "item_id", "type", F.round(vectors.dot(F.col("qvec"), F.col("vec")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))).filter(F.col("rank") <= k)


def classified(reply: Column, persona: Column, question: Column) -> Column:
    """(intent, direction, keywords) of a classifier's reply, checked.

    An intent that exists but not for the persona gives the persona's default; a
    reply that is no JSON, lacks a field or names what does not exist gives the
    default intent, the narrow direction and the question's first ten words.
    """
    r = F.from_json(reply, "intent string, direction string, search_keywords array<string>")
    every = sorted({i for own in PERSONA_INTENTS.values() for i in own})
    allowed, fallback = F.lit(False), F.lit(None)
    for name, own in PERSONA_INTENTS.items():
        allowed = allowed | ((persona == name) & r["intent"].isin(own))
        fallback = F.when(persona == name, DEFAULT_INTENTS[name]).otherwise(fallback)
    sound = F.coalesce(r["intent"].isin(every) & r["direction"].isin(DIRECTIONS), F.lit(False))
    words = F.slice(F.filter(F.split(question, r"\s+"), lambda w: w != ""), 1, 10)
    return F.when(sound, F.struct(F.when(allowed, r["intent"]).otherwise(fallback).alias("intent"), r["direction"].alias("direction"), F.coalesce(r["search_keywords"], F.array().cast("array<string>")).alias("keywords"))).otherwise(
        F.struct(fallback.alias("intent"), F.lit("narrow").alias("direction"), words.alias("keywords"))
    )


def contexts(results: DataFrame) -> DataFrame:
    """(query_id, context, sources) from ranked results (query_id, rank, repo_id, doc_type, score, content): numbered sections, long contents cut."""
    long = F.length("content") > CONTEXT_CHARS
    body = F.when(long, F.concat(F.left("content", F.lit(CONTEXT_CHARS)), F.lit("\n...[truncated]"))).otherwise(F.col("content"))
    section = F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), "repo_id", F.lit("\n_Repo: "), "repo_id", F.lit(" | Type: "), "doc_type", F.lit(" | Score: "), F.format_string("%.2f", "score"), F.lit("_\n\n"), body)
    g = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", section.alias("s")))).alias("parts"), F.sort_array(F.collect_set("repo_id")).alias("sources"))
    return g.select("query_id", F.array_join(F.col("parts")["s"], "\n\n---\n\n").alias("context"), "sources")


def out_of_scope_answer(repos: Column, top: Column) -> Column:
    """What is said instead of an answer; ``repos`` are the nearest ones."""
    named = F.coalesce(F.nullif(F.array_join(F.slice(repos, 1, 3), ", "), F.lit("")), F.lit("none"))
    return F.concat(F.lit("This question doesn't appear to be within the scope of the indexed codebases. Closest repositories: "), named, F.lit(" (top score "), F.format_string("%.2f", top), F.lit(", threshold not met)."))


def round_robin(*lists: DataFrame) -> DataFrame:
    """Merge ranked lists (query_id, id, rank) in turn, each id once, where it first comes."""
    out = None
    for i, one in enumerate(lists):
        one = one.select("query_id", "id", "rank", F.lit(i).alias("source"))
        out = one if out is None else out.unionByName(one)
    first = out.groupBy("query_id", "id").agg(F.min(F.struct("rank", "source")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at.rank", "at.source", "id")
    return first.select("query_id", "id", F.row_number().over(w).alias("rank"))


def reranked(hits: DataFrame, score: str, head: int = RERANK_HEAD) -> DataFrame:
    """``hits`` with ``new_rank``: the first ``head`` by the new score (missing counts 0), the rest behind in their order."""
    s = F.when(F.col("rank") <= head, F.coalesce(F.col(score), F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy((F.col("rank") <= head).desc(), s.desc_nulls_last(), "rank")
    return hits.withColumn("new_rank", F.row_number().over(w))


def adequate_levels(hits: DataFrame, levels: list[str], score: float = ADEQUATE_SCORE, least: int = ADEQUATE_RESULTS) -> DataFrame:
    """Hits (query_id, level, ..., score) of the levels up to the first after which enough results are good enough."""
    order = F.array_position(F.array(*map(F.lit, levels)), F.col("level"))
    counted = hits.filter(order > 0).withColumn("o", order)
    good = counted.groupBy("query_id", "o").agg(F.sum((F.col("score") >= score).cast("int")).alias("g"))
    w = Window.partitionBy("query_id").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    enough = good.withColumn("sum", F.sum("g").over(w)).filter(F.col("sum") >= least).groupBy("query_id").agg(F.min("o").alias("stop"))
    return counted.join(enough, "query_id", "left").filter(F.col("stop").isNull() | (F.col("o") <= F.col("stop"))).drop("o", "stop")


def result_header(doc_type: Column, repo: Column, path: Column) -> Column:
    return (
        F.when(doc_type == "spec", F.concat(F.lit("[spec] "), path, F.lit(" (intended behaviour)")))
        .when(doc_type == "file_index", F.concat(F.lit("[file] "), repo, F.lit(":"), path))
        .when(doc_type == "commit_index", F.concat(F.lit("[commit] "), repo))
        .otherwise(F.concat(F.lit("[document] "), path))
    )


def manifest_state(manifests: DataFrame, vectors: DataFrame, model: str, dims: int, column: str = "embedding") -> DataFrame:
    """(state, n): whether stored vectors are what queries will be embedded as.

    ``manifests`` is (model, dims) with one row at most. The vectors themselves
    are looked at too, as a manifest says only what was meant.
    """
    size = F.size(column)
    facts = vectors.agg(F.count("*").alias("n"), F.count_if(size != dims).alias("odd"))
    told = manifests.agg(F.count("*").alias("told"), F.count_if((F.col("model") == model) & (F.col("dims") == dims)).alias("agreed"))
    state = F.when(F.col("told") == 0, "no manifest").when(F.col("agreed") == 0, "mismatch").when(F.col("odd") > 0, "odd vectors").otherwise("ok")
    return facts.crossJoin(F.broadcast(told)).select(state.alias("state"), "n")
