"""Sharding by sampled splitters.

Records are ordered by the hash of their text, so equal texts lie side by side.
A size-weighted sample of the keys gives quantile boundaries of many fine
ranges; their exact sizes are then counted. A range that is still overfull
(a hot group of equal texts, say) is subdivided by boundaries on (text hash, id
hash, part), taken from the sample of that range alone. Consecutive fine ranges
are dealt to shards by exact cumulative bytes.

Equal rows are counted before anything moves, and a row that stands for many is
cut into parts of bounded size. So ten copies of a row, or a table of nothing
else, are dealt out like other rows.

What the driver gathers is bounded by parameters: the sample and one row for
each fine range. Rows move without their texts: once to be counted and once to
be numbered.

Defined results: a null text has size 1 and the checksum of no bytes; a null id
is a key like any other; equal rows each get a slot of their own, and may get
different shards where they are many; an empty table gives an empty result; only
the named columns are read, so others may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialize, scratch

SHARDS = 16
#: Fine ranges: at least this many for each shard, and no more bytes in one than this, up to so many in all.
RANGES_PER_SHARD = 64
RANGE_BYTES = 1 << 30
MAX_RANGES = 1 << 13
#: Keys drawn for each fine range.
DRAWS = 24
#: Bytes that a row weighs besides its own when ranges are cut, so that many short rows are many ranges; rows of one part at most.
ROW_WEIGHT = 16
PART_ROWS = 100_000

_KEY = ("h", "g", "q")


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(id).alias("id"),
        (F.octet_length(t) + 1).cast("bigint").alias("size"),
        F.crc32(t.cast("binary")).cast("bigint").alias("crc"),
        F.xxhash64(t).alias("h"),
        F.xxhash64(F.lit(1), F.col(id)).alias("g"),
    )


def _parts(counted: DataFrame, most: float) -> DataFrame:
    """Each row, which stands for ``n`` equal ones, as parts of about ``most`` weight; ``q`` numbers them."""
    k = F.least("n", F.greatest(F.ceil(F.col("n") * (F.col("size") + ROW_WEIGHT) / F.lit(most)), F.ceil(F.col("n") / F.lit(PART_ROWS)), F.lit(1))).cast("int")
    parted = counted.withColumn("k", k).withColumn("q", F.explode(F.expr("sequence(0L, k - 1L)")))
    parted = parted.withColumn("n", F.expr("n * (q + 1) div k - n * q div k"))
    return parted.withColumn("bytes", F.expr("n * size")).withColumn("w", F.expr(f"n * (size + {ROW_WEIGHT})")).drop("k")


def _draw(rows: DataFrame, step: float) -> DataFrame:
    """Size-weighted and repeatable: a row is drawn with the chance of weight / step, and carries the weight it stands for."""
    u = (F.pmod(F.xxhash64(F.lit(7), *_KEY), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return rows.filter(u < F.col("w") / F.lit(step)).select(*_KEY, F.greatest(F.col("w").cast("double"), F.lit(step)).alias("w"))


def _quantiles(sample: list[tuple], n: int) -> list[tuple]:
    """Distinct keys that cut the weighted, sorted sample into about n parts; a part holds keys above its lower bound and up to its upper one."""
    total, seen, cuts = sum(w for *_, w in sample), 0.0, set()
    due = 1
    for *key, w in sorted(sample):
        seen += w
        if due < n and seen >= total * due / n:
            cuts.add(tuple(key))
            due = int(seen * n / total) + 1
    return sorted(cuts)


def _placed(docs: DataFrame, id: str, text: str, shards: int) -> DataFrame:
    """(id, size, crc, h, shard, first, n): n equal rows with the slots from ``first`` on."""
    spark = docs.sparkSession
    with scratch(spark):
        counted = materialize(_keyed(docs, id, text).groupBy("id", "size", "crc", "h", "g").agg(F.count("*").alias("n")), lasting=True)
    total, rows = (x or 0 for x in counted.agg(F.sum(F.col("n") * F.col("size")), F.sum("n")).first())
    weight = total + ROW_WEIGHT * rows
    n = min(MAX_RANGES, max(shards * RANGES_PER_SHARD, weight // RANGE_BYTES + 1))
    target = max(weight / n, 1.0)
    parts = _parts(counted, max(target / 4, 1.0))
    sample = [tuple(x) for x in _draw(parts, max(target / DRAWS, 1.0)).collect()]
    cuts = [k[0] for k in _quantiles([(h, w) for h, _, _, w in sample], n)]
    ranged = parts.withColumn("r", _range_of("h", cuts))
    sizes = {r: w for r, w in ranged.groupBy("r").agg(F.sum("w")).collect()}

    # An overfull range is cut again, by the whole key.
    fine: dict[int, list[tuple]] = {r: [] for r in range(len(cuts) + 1)}
    for r in (r for r, w in sizes.items() if w > 2 * target):
        low, high = (cuts[r - 1] if r else None), (cuts[r] if r < len(cuts) else None)
        own = [x for x in sample if (low is None or x[0] > low) and (high is None or x[0] <= high)]
        if own:
            fine[r] = _quantiles(own, int(sizes[r] / target) + 1)
    first, at = {}, 0
    for r in sorted(fine):
        first[r] = at
        at += len(fine[r]) + 1
    starts = spark.createDataFrame([(r, first[r], [tuple(k) for k in fine[r]]) for r in sorted(first)], "r int, f int, ks array<struct<h:bigint,g:bigint,q:bigint>>")
    below = F.expr("f + size(filter(ks, k -> k < struct(h, g, q)))")
    ranged = ranged.join(F.broadcast(starts), "r").withColumn("f", below).select("id", "size", "crc", *_KEY, "n", "bytes", "f")

    counts = {f: (b, c) for f, b, c in ranged.groupBy("f").agg(F.sum("bytes"), F.sum("n")).collect()}
    plan, seen, number = [], 0, [0] * shards
    for f in sorted(counts):
        b, c = counts[f]
        s = min(shards - 1, int((seen + b / 2) * shards / max(total, 1)))
        plan.append((f, s, number[s]))
        number[s] += c
        seen += b
    dealt = spark.createDataFrame(plan, "f int, shard int, base bigint")
    before = Window.partitionBy("f").orderBy(*_KEY, "id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("k", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(dealt), "f")
    return out.select("id", "size", "crc", "h", "shard", (F.col("base") + F.col("k")).alias("first"), "n")


def assign(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(id, size, text_crc32, shard, slot): shards of near equal bytes, slots gapless from 0."""
    each = F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot")
    return _placed(docs, id, text, shards).select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), "shard", each)


def _range_of(column: str, cuts: list[int]) -> Column:
    """The number of cuts below a key, by binary search in one constant array."""
    if not cuts:
        return F.lit(0)
    steps = max(1, len(cuts).bit_length())
    array = "cast(split('" + ",".join(map(str, cuts)) + "', ',') AS array<bigint>)"
    half = "cast((s.lo + s.hi) / 2 AS int)"
    return F.expr(
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(cuts)}), "
        f"(s, _i) -> CASE WHEN s.lo >= s.hi THEN s WHEN {array}[{half}] < {column} THEN named_struct('lo', {half} + 1, 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', {half}) END, s -> s.lo)"
    )


def write_shards(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", shards: int = SHARDS, column: str = "shard") -> str:
    """Write all columns of ``docs`` as Parquet under ``path/shard=N``; returns the name of that column.

    A column of that name in ``docs`` is kept, and the partitioning one gets
    underscores until it is free. Rows equal in id and text that have several
    shards are dealt to them at random in the proportions of ``assign``.
    """
    while column.lower() in map(str.lower, docs.columns):
        column += "_"
    placed = _placed(docs, id, text, shards).groupBy("id", "size", "crc", "h", "shard").agg(F.sum("n").alias("n"))
    placed = placed.groupBy("id", "size", "crc", "h").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("to")).withColumnsRenamed({c: f"_{c}" for c in ("id", "size", "crc", "h")})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("u"))
    body = F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))
    rows = rows.withColumn("size", (F.octet_length(body) + 1).cast("bigint")).withColumn("h", F.xxhash64(body)).withColumn("id", F.col(f"row.`{id}`"))
    on = rows["id"].eqNullSafe(placed["_id"]) & (rows["h"] == placed["_h"]) & (rows["size"] == placed["_size"])
    pick = "aggregate(to, named_struct('left', pmod(xxhash64(u), aggregate(to, 0L, (a, x) -> a + x.n)), 's', -1), (a, x) -> CASE WHEN a.s >= 0 THEN a WHEN a.left < x.n THEN named_struct('left', a.left, 's', x.shard) ELSE named_struct('left', a.left - x.n, 's', -1) END, a -> a.s)"
    out = rows.join(placed, on).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.expr(pick).alias(column))
    out.write.partitionBy(column).parquet(path)
    return column
