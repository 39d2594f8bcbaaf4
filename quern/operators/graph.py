"""Dependency graphs: degrees, PageRank, reachability and criticality.

Edges are (consumer, provider). Loops run on the driver, a round a plan; what
they carry is written to the shared folder, so that lineage stays short and a
lost executor costs one round.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ALPHA = 0.85


def scratch(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset a temporary one is set in local mode, and a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quern-graph-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table at a scratch path."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("consumer").alias("v")).union(edges.select("provider")).distinct()


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(v, in_degree, out_degree)."""
    v = (nodes(edges) if vertices is None else vertices).distinct()
    i = edges.groupBy(F.col("provider").alias("v")).agg(F.count("*").alias("in_degree"))
    o = edges.groupBy(F.col("consumer").alias("v")).agg(F.count("*").alias("out_degree"))
    return v.join(i, "v", "left").join(o, "v", "left").fillna(0, ["in_degree", "out_degree"])


def pagerank(edges: DataFrame, iterations: int = 100, tolerance: float | None = 1e-6, alpha: float = ALPHA) -> DataFrame:
    """(v, score). Stops when the total change falls below tolerance times the nodes; without a tolerance all iterations run.

    Every round is written, and its change and the rank of dangling nodes come
    to the driver as two numbers.
    """
    edges = edges.select("consumer", "provider").distinct()
    out = edges.groupBy("consumer").agg(F.count("*").alias("d"))
    links = written(edges.join(out, "consumer"))
    base = written(nodes(edges).join(out.withColumnRenamed("consumer", "v"), "v", "left").select("v", F.col("d").isNull().alias("dangling")))
    n, loose = base.agg(F.count("*"), F.count_if("dangling")).first()
    rank, lost = base.select("v", F.lit(1.0 / max(n, 1)).alias("score")), loose / max(n, 1)
    for _ in range(iterations if n else 0):
        given = links.join(rank, F.col("consumer") == F.col("v")).groupBy("provider").agg(F.sum(F.col("score") / F.col("d")).alias("g"))
        new = base.join(rank.withColumnRenamed("score", "was"), "v").join(given, F.col("v") == F.col("provider"), "left")
        new = new.select("v", "dangling", "was", ((1 - alpha) / n + alpha * (F.coalesce("g", F.lit(0.0)) + F.lit(lost / n))).alias("score"))
        new = written(new)
        change, lost = new.agg(F.sum(F.abs(F.col("score") - F.col("was"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0))).first()
        rank = new.select("v", "score")
        if tolerance is not None and change < tolerance * n:
            break
    return rank


def criticality(edges: DataFrame, scores: DataFrame, repos: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(v, normalized_score, percentile, direct, transitive, downstream_repos) of the ``chosen`` nodes (v), all by default.

    ``scores`` is (v, score), ``repos`` (v, repo). The closure of all nodes may
    have as many rows as there are pairs that reach each other; on large graphs
    give the nodes asked about.
    """
    edges = edges.select("consumer", "provider").distinct()
    seeds = nodes(edges) if chosen is None else chosen.select("v").distinct()
    top = scores.agg(F.max("score").alias("top"))
    ranked = with_percentiles(scores).crossJoin(F.broadcast(top)).select("v", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("normalized_score"), "percentile")
    reach = dependents(edges, seeds).groupBy(F.col("seed").alias("v")).agg(F.count("*").alias("transitive"))
    near = edges.join(repos.withColumnsRenamed({"v": "consumer"}), "consumer").groupBy(F.col("provider").alias("v")).agg(F.count("*").alias("direct"), F.sort_array(F.collect_set("repo")).alias("downstream_repos"))
    out = ranked.join(seeds, "v", "left_semi").join(near, "v", "left").join(reach, "v", "left").fillna(0, ["direct", "transitive"])
    return out.withColumn("downstream_repos", F.coalesce("downstream_repos", F.array().cast(near.schema["downstream_repos"].dataType)))


def ancestry(documents: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, chain, broken_at): each start's chain of ids up its parents, itself first.

    ``documents`` is (id, parent_id), ``starts`` (id). A walk ends without a
    parent, at an id that it has met, or at one that is no document, which is
    reported in ``broken_at``. A round takes all walks one level up.
    """
    docs = written(documents.select(F.col("id").alias("own"), "parent_id"))
    walks = written(starts.select("id").join(docs, F.col("id") == F.col("own"), "left_semi").select(F.col("id").alias("start"), F.array("id").alias("chain"), F.col("id").alias("at")))
    done = None
    while True:
        up = walks.join(docs, F.col("at") == F.col("own"), "left").select("start", "chain", F.col("own").isNull().alias("missing"), "at", "parent_id")
        ended = F.col("missing") | F.col("parent_id").isNull() | F.array_contains("chain", F.col("parent_id"))
        up = written(up.withColumn("ended", F.coalesce(ended, F.lit(True))))
        over = up.filter("ended").select(
            F.col("start").alias("id"), F.when(F.col("missing"), F.slice("chain", 1, F.size("chain") - 1)).otherwise(F.col("chain")).alias("chain"), F.when(F.col("missing"), F.col("at")).alias("broken_at")
        )
        done = over if done is None else done.unionByName(over)
        walks = up.filter("NOT ended").select("start", F.concat("chain", F.array("parent_id")).alias("chain"), F.col("parent_id").alias("at"))
        if walks.isEmpty():
            return done


def components(edges: DataFrame) -> DataFrame:
    """(v, component) of every end of undirected ``edges`` (a, b); the component is the least node in it.

    Each round a node takes the least label around it and then its label's
    label, until nothing changes; lost executors cost a round.
    """
    ends = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(ends.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        around = ends.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("least"))
        new = labels.join(around, "v").select("v", F.col("component").alias("was"), F.least("component", "least").alias("l"))
        jump = labels.select(F.col("v").alias("l"), F.col("component").alias("next"))
        new = written(new.join(jump, "l", "left").select("v", "was", F.least("l", F.coalesce("next", "l")).alias("component")))
        labels = new.select("v", "component")
        if new.filter("was <> component").isEmpty():
            return labels


def module_edges(modules: DataFrame, mother: str, daughter: str) -> DataFrame:
    """(consumer, provider, cross) from (module, imports, imported_by), by the prefixes of both repositories.

    Edges across repositories are the mother's modules with the daughter's that
    import them; if there are none, the daughter's own edges are taken. The
    mother's own edges come with either. Rows are not made distinct.
    """
    up, down = (lambda c, p=p: c.startswith(p) for p in (mother, daughter))
    inside = modules.select(F.col("module").alias("consumer"), F.explode("imports").alias("provider"))
    own = lambda of: inside.filter(of(F.col("consumer")) & of(F.col("provider"))).withColumn("cross", F.lit(False))
    across = modules.filter(up(F.col("module"))).select(F.explode("imported_by").alias("consumer"), F.col("module").alias("provider"))
    across = across.filter(down(F.col("consumer")) & ~up(F.col("consumer"))).withColumn("cross", F.lit(True))
    return own(up).unionByName(own(down) if across.isEmpty() else across)


def affected_tests(files: DataFrame, graph: DataFrame, edges: DataFrame) -> DataFrame:
    """(module) of the test modules that depend on the changed files (file): ``*`` without a graph, none without a match."""
    if graph.isEmpty():
        return graph.sparkSession.createDataFrame([("*",)], "module string")
    seeds = matched_nodes(files, graph).select(F.col("node").alias("v")).distinct()
    reached = dependents(edges, seeds).select("v").union(seeds).distinct()
    return graph.join(reached, graph["node"] == reached["v"], "left_semi").filter(F.lower("module").contains("test")).select("module").distinct()


def node_criticality(asked: DataFrame, modules: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """(asked, module, dependents): the module of that name, else the first in order whose name holds it; ``most`` direct dependents.

    The names asked for are broadcast, 1,000 at most, as a substring has no key to join by.
    """
    if asked.limit(1001).count() > 1000:
        raise ValueError("too many names for one pass; ask in blocks")
    exact = asked.join(modules, F.col("asked") == F.col("module")).select("asked", F.lit(0).alias("stage"), "module", "v")
    held = modules.join(F.broadcast(asked), F.col("module").contains(F.col("asked"))).select("asked", F.lit(1).alias("stage"), "module", "v")
    best = exact.unionByName(held).groupBy("asked").agg(F.min(F.struct("stage", "module", "v")).alias("b")).select("asked", "b.module", "b.v")
    near = edges.select("consumer", "provider").distinct().join(best, F.col("provider") == F.col("v"))
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy("consumer"))).filter(F.col("r") <= most)
    listed = first.groupBy("asked").agg(F.sort_array(F.collect_list("consumer")).alias("dependents"))
    return best.drop("v").join(listed, "asked", "left").withColumn("dependents", F.coalesce("dependents", F.array().cast(listed.schema["dependents"].dataType)))


def dependents(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, v, depth): all that consume a seed, directly or not, but for the seed itself."""
    edges = written(edges.select("consumer", "provider").distinct())
    seen = written(seeds.select(F.col("v").alias("seed"), "v", F.lit(0).alias("depth")))
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(edges, front["v"] == edges["provider"]).select("seed", F.col("consumer").alias("v")).distinct()
        front = written(step.join(seen.select("seed", "v"), ["seed", "v"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front))
    return seen.filter("depth > 0")


def with_percentiles(scores: DataFrame, score: str = "score") -> DataFrame:
    """``percentile``: 100 * (1 - rank / n) rounded down, ties sharing the first rank, which is 0.

    The rank of a score is the number of higher ones: distinct scores are
    numbered from their counts, so no window runs over all rows.
    """
    counts = scores.groupBy(score).agg(F.count("*").alias("c"))
    above = counts.withColumn("above", F.coalesce(F.sum("c").over(Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = scores.agg(F.count("*").alias("n"))
    j = scores.join(above.select(score, "above"), score).crossJoin(F.broadcast(total))
    return j.withColumn("percentile", F.floor(100 * (1 - F.col("above") / F.col("n")))).drop("above", "n")


def matched_nodes(changed: DataFrame, graph: DataFrame) -> DataFrame:
    """(file, node): exact path, else a suffix either way, else the module name; within a stage the first by ordinal.

    ``changed`` is (file), ``graph`` (node, path, module, ordinal). A suffix is
    met by equality: each side is expanded into all suffixes of its own path.
    Of the nodes of one suffix only the first is joined, so common base names
    cost no pairs.
    """
    name = F.replace(F.regexp_replace("file", r"\.[^./]*$", ""), F.lit("/"), F.lit("."))
    stages = [_first_by_suffix(changed.select("file", F.col("file").alias("own")), graph.select("node", "ordinal", F.col("path").alias("own")), 0, 1)]
    stages.append(_first_by_suffix(changed.select("file", name.alias("own")), graph.select("node", "ordinal", F.col("module").alias("own")), 2, 2))
    best = F.min(F.struct("stage", "ordinal", "node")).alias("best")
    return stages[0].unionByName(stages[1]).groupBy("file").agg(best).select("file", "best.node")


def _first_by_suffix(changed: DataFrame, graph: DataFrame, equal: int, suffix: int) -> DataFrame:
    """(file, stage, ordinal, node) of the first node of an equal name, and of one where either name ends with the other."""
    first = lambda d, *by: d.groupBy(*by).agg(F.min(F.struct("ordinal", "node")).alias("f"))
    ends = lambda c: F.expr(f"transform(sequence(1, length({c})), i -> substring({c}, i))")
    whole = first(graph.filter("own <> ''"), "own")
    cut = first(graph.filter("own <> ''").select("ordinal", "node", F.explode(ends("own")).alias("own")), "own")
    same = changed.join(whole, "own").select("file", F.lit(equal).alias("stage"), "f.*")
    within = changed.join(cut, "own").select("file", F.lit(suffix).alias("stage"), "f.*")
    around = changed.filter("own <> ''").select("file", F.explode(ends("own")).alias("own")).join(whole, "own").select("file", F.lit(suffix).alias("stage"), "f.*")
    return same.unionByName(within).unionByName(around)
