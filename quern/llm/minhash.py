"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Documents with equal shingle sets form one class; only one of each class goes
on. Each class gets a sketch of ``bands * rows`` coordinates, and classes that
share a band fall into one bucket. No bucket is expanded into all its pairs:

1. its most popular member (the one that meets most others over all its
   buckets) is paired with each other member;
2. what is not yet connected to that member's component is compared, finer
   sketch against finer sketch in blocks, and each such member's best estimates
   go on;
3. those of which some estimates stayed behind are compared again, with every
   estimate above the floor, for pairs whose ends are still in different components.

Each round's pairs are verified on full shingle sets before they count, so a
link is never assumed, and pairs are passed over only where their ends are
connected already or their estimate lies so far below the threshold that a pair
at the threshold is hit with a chance below 1e-6. A bucket of more than ``BLOCK``
members is first divided by set size, as sets of too different sizes cannot be
similar enough, and then into blocks of bounded size. Hot keys meet one row each,
in joins that adaptive execution splits.
A member goes to the blocks once for each bucket and block it meets, so what it carries
is small: a few bits of each finer coordinate, and half of each band's key.

Defined results: a null or empty text, or one without words, has an empty set,
is linked with nothing and kept; so is a row without an id (its component is
null). Rows that repeat an id are judged by their own text and share that id.
Ids are of any type that has an order. Ties fall to the smaller id. An empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import shingles
from quern.llm.common import bounded_batches, materialize, scratch
from quern.llm.components import components

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 32, 5
#: Members of one block when a bucket is compared, and estimates sent on for each in the first comparison.
BLOCK = 512
BEST = 8
#: Coordinates of the finer sketches, how many are compared first, and bits kept of each.
FINE, COARSE, BITS = 2048, 256, 3
#: Chance that one of the two comparisons passes over a pair at the threshold.
MISS = 4e-7
#: Members compared in one call, about.
SLOT_ROWS = 1024


def signatures(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, class, bands) for each row; class is a 128-bit digest of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = shingles.Sketcher(bands * rows)
        for batch in batches:
            sizes, classes, keys = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles.shingle_set(t, n)
                sizes.append(len(s))
                if not len(s):
                    classes.append(None), keys.append(None)
                    continue
                k = sketcher(s)
                classes.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(shingles.bands(k, rows).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "class", "bands"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"id {_type(docs, id)}, n_shingles bigint, class binary, bands array<bigint>")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _planes(sketch: np.ndarray) -> bytes:
    """The lowest bits of all coordinates, then the second lowest ones, and so on."""
    bits = (sketch >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), axis=1).tobytes()


def _agreeing(planes: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many coordinates of each row of ``planes`` (row, bit, words) agree with ``one`` (bit, words) in all bits."""
    other = np.bitwise_or.reduce(planes ^ one, axis=1)
    return 64 * other.shape[1] - np.bitwise_count(other).sum(axis=1, dtype=np.int64)


def _sets(docs: DataFrame, wanted: DataFrame, id: str, text: str, n: int) -> DataFrame:
    """(id, size, fine, set) of the wanted (id, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = shingles.Sketcher(FINE, seed=2)
        for batch in batches:
            found = [shingles.shingle_set(t, n) for t in batch.column(1).to_pylist()]
            columns = (
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()),
                pa.array([len(s) for s in found], pa.int32()),
                pa.array([_planes(sketcher(s)) if len(s) else None for s in found], pa.binary()),
                pa.array([s.tobytes() for s in found], pa.binary()),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "class", "size", "fine", "set"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t")).join(wanted.select("id"), "id", "left_semi")
    made = rows.mapInArrow(run, f"id {_type(docs, id)}, class binary, size int, fine binary, set binary").join(wanted, ["id", "class"], "left_semi")
    return made.dropDuplicates(["id"]).select("id", "size", "fine", "set")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                m = 0 if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)) else shingles.common(p, q)
                good.append(100 * m >= percent * (len(p) + len(q) - m))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("p"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(run, f"a {_type(pairs, 'a')}, b {_type(pairs, 'b')}")


def _floor(percent: int, coordinates: int) -> int:
    """The most agreeing coordinates that a pair at the threshold falls below with no more than a chance of ``MISS``."""
    p = percent / 100 + (1 - percent / 100) / 2**BITS
    below = 0.0
    for k in range(coordinates if p < 1 else 0):
        ways = math.lgamma(coordinates + 1) - math.lgamma(k + 1) - math.lgamma(coordinates - k + 1)
        below += math.exp(ways + k * math.log(p) + (coordinates - k) * math.log1p(-p))
        if below > MISS:
            return k
    return coordinates


def _dealt(members: DataFrame, sets: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """The rows of all blocks of ``_block_pairs``, with the slot that compares them.

    ``z`` is the class of size in a large bucket: those that ask go to their own
    and both next classes, which hold all sizes within the threshold.
    """
    step = F.lit(-math.log(percent / 100) + 1e-9)
    large = F.col("n") > BLOCK
    sized = members.join(sets.select("id", "size"), "id").withColumn("z", F.when(large, F.floor(F.ln("size") / step)).otherwise(0).cast("int"))
    places = "concat(array(struct(z AS z, false AS asks)), CASE WHEN NOT minor THEN array() WHEN large THEN transform(array(z - 1, z, z + 1), x -> struct(x AS z, true AS asks)) ELSE array(struct(z AS z, true AS asks)) END)"
    both = sized.withColumn("large", large).withColumn("place", F.explode(F.expr(places))).select("key", "place.z", "id", "c", "minor", "place.asks")
    both = materialize(both)
    count = both.groupBy("key", "z").agg(F.sum(F.col("asks").cast("int")).alias("m"), F.sum((~F.col("asks")).cast("int")).alias("n"))
    count = count.filter("m > 0 AND n > 0").select("key", "z", "m", "n", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    count = materialize(count, narrow=True)
    dealt = both.join(count.select("key", "z", "mb", "nb"), ["key", "z"]).withColumn("h", F.xxhash64("id"))
    all_side = dealt.filter("NOT asks").select("key", "z", "id", "c", "minor", "asks", F.pmod("h", "nb").cast("int").alias("j"), F.explode(F.expr("sequence(0, mb - 1)")).alias("i"))
    ask_side = dealt.filter("asks").select("key", "z", "id", "c", "minor", "asks", F.pmod("h", "mb").cast("int").alias("i"), F.explode(F.expr("sequence(0, nb - 1)")).alias("j"))
    # Each pair counts in the first bucket that its ends share, so the bands come along.
    rows = all_side.unionByName(ask_side).join(sets.select("id", "size", "fine"), "id").join(bands, "id")
    # Most buckets are small: many are compared in one call. Rows are counted with their copies, of which a large bucket has many.
    copies = count.agg(F.sum(F.col("n") * F.col("mb") + F.col("m") * F.col("nb"))).first()[0] or 0
    slots = max(1, copies // SLOT_ROWS)
    return rows.select(F.pmod(F.xxhash64("key", "z", "i", "j"), F.lit(slots)).alias("slot"), "key", "z", "i", "j", "id", "c", "asks", "minor", "size", "fine", "bands")


def _block_pairs(members: DataFrame, sets: DataFrame, bands: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Pairs (a, b) of one bucket, in different components and similar by their sizes and finer sketches.

    ``members`` is (key, id, n, c, minor), n the size of the bucket: only minor members, those outside the
    component of the bucket's most popular member, need to be compared, with
    each other and with the rest. Both sides are dealt into blocks. A member that had more than
    ``best`` in a block comes as its own pair, with the bucket's key.
    """
    rows = _dealt(members, sets, bands, percent)
    floor, first = _floor(percent, FINE), _floor(percent, COARSE)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "z", "i", "j", "asks", "size", "id"])
        key, z, i, j = (group[k].to_numpy() for k in ("key", "z", "i", "j"))
        ids, cs, asks, minor, sizes = (group[k].to_numpy() for k in ("id", "c", "asks", "minor", "size"))
        fine = np.frombuffer(b"".join(group.fine), np.uint64).reshape(len(group), BITS, FINE // 64)
        head = np.ascontiguousarray(fine[:, :, : COARSE // 64])
        every, own_key = np.stack(group.bands.to_numpy()), key >> 32
        turns = np.flatnonzero((key[1:] != key[:-1]) | (z[1:] != z[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        out: list[tuple] = []
        for start, end in zip([0, *turns], [*turns, len(key)], strict=True):
            middle = start + int(np.searchsorted(asks[start:end], True))  # those asked first, then those that ask
            if middle in (start, end):
                continue
            for x in range(middle, end):
                # Sets of too different sizes can't be similar enough.
                n = int(sizes[x])
                lo = start + int(np.searchsorted(sizes[start:middle], -(-n * percent // 100)))
                hi = start + int(np.searchsorted(sizes[start:middle], n * 100 // percent, "right"))
                at = lo + np.flatnonzero(cs[lo:hi] != cs[x])
                if best is None:  # two that both ask are compared from one side
                    at = at[~(minor[at] & (ids[at] < ids[x]))]
                at = at[_agreeing(head[at], head[x]) >= first]
                if not len(at):
                    continue
                e = _agreeing(fine[at], fine[x])
                at, e = at[e >= floor], e[e >= floor]
                shared = every[at] == every[x]
                own = every[x][np.argmax(shared, axis=1)] == own_key[x]
                at, e = at[own], e[own]
                if best is not None and len(at) > best:
                    at = at[np.argsort(-e, kind="stable")[:best]]
                    out.append((ids[x], ids[x], key[x]))
                out += [(min(ids[x], y), max(ids[x], y), 0) for y in ids[at].tolist()]
        return pd.DataFrame(sorted(set(out)), columns=["a", "b", "key"])

    return rows.groupBy("slot").applyInPandas(compare, f"a {_type(members, 'id')}, b {_type(members, 'id')}, key bigint").distinct()


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, class) for each row, and (class, component) for each class."""
    with scratch(docs.sparkSession):
        return _classes(docs, id, text, n, percent, bands, rows)


def _classes(docs: DataFrame, id: str, text: str, n: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    all_rows = materialize(signatures(docs, id, text, n, bands, rows), lasting=True)
    named = all_rows.filter("class IS NOT NULL AND id IS NOT NULL")
    reps = materialize(named.groupBy("class").agg(F.min("id").alias("rep")))
    chosen = named.join(reps, (named["class"] == reps["class"]) & (named["id"] == reps["rep"]), "left_semi").dropDuplicates(["id", "class"])
    chosen = materialize(chosen.select("id", "class", "bands"))

    # What is joined with many rows of one key is written first: adaptive execution splits joins of two exchanges.
    keys = chosen.select("id", F.explode("bands").alias("key")).distinct()
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = materialize(keys.join(shared, "key"))
    popular = met.groupBy("id").agg(F.sum("n").alias("pop"))
    met = materialize(met.join(popular, "id").select("key", "id", "pop", "n"))
    # The hub: most popular, then least id.
    hubs = met.groupBy("key").agg(F.min_by("id", F.struct(-F.col("pop"), F.col("id"))).alias("hub"))
    hubs = materialize(hubs)
    pairs = met.join(hubs, "key").filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    wanted = chosen.select("id", "class").join(met.select("id").distinct(), "id", "left_semi")
    sets = materialize(_sets(docs, wanted, id, text, n))
    links = materialize(_verified(pairs, sets, percent), narrow=True)
    found = components(links)

    # Half of each key is enough to tell the first band that two rows share: other keys of a band agree in it once in 2**32 pairs.
    halves = chosen.select("id", F.transform("bands", lambda k: F.shiftright(k, 32).cast("int")).alias("bands")).dropDuplicates(["id"])
    again = None
    for best in (BEST, None):
        members = met.select("key", "id", "n").join(found, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
        minor = F.col("c") != F.col("major")
        if again is not None:
            members = members.join(again, ["key", "id"], "left")
            minor &= F.col("again").isNotNull()
        major = hubs.join(found.withColumnRenamed("id", "hub"), "hub", "left").select("key", F.coalesce("component", "hub").alias("major"))
        members = materialize(members.join(major, "key").select("key", "id", "n", "c", minor.alias("minor")))
        open_keys = materialize(members.filter("minor").select("key").distinct(), narrow=True)
        members = members.join(open_keys, "key", "left_semi")
        pairs = materialize(_block_pairs(members, sets, halves, percent, best), narrow=True)
        more = materialize(_verified(pairs.filter("a <> b").select("a", "b"), sets, percent), narrow=True)
        if not more.isEmpty():
            links = links.union(more)
            found = components(links)
        again = pairs.filter("a = b").select("key", F.col("a").alias("id"), F.lit(True).alias("again"))
        if again.isEmpty():
            break
    ends = reps.join(found, reps["rep"] == found["id"], "left").select("class", F.coalesce("component", "rep").alias("component"))
    return all_rows.select("id", "n_shingles", "class"), materialize(ends, lasting=True)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row."""
    rows, ends = classes(docs, id, text, **options)
    out = rows.join(ends, "class", "left").withColumn("c", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id), "n_shingles", F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, with all its columns; repeated rows of it are dropped too. Rows without an id stay."""
    gone = near_duplicates(docs.select(id, text), id, text, **options).filter("NOT kept").select(F.col(id).alias("gone")).distinct()
    # Rows without an id have no part in the join, where they would all meet in one task.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id).alias("id"))
    named = whole.filter("id IS NOT NULL").join(gone, F.col("id") == F.col("gone"), "left_anti")
    return named.unionByName(whole.filter("id IS NULL")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
