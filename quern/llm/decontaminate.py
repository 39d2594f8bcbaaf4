"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and their white space collapsed. A test item of L
characters may differ in L // ``CHARS_PER_EDIT`` edits; it is split into one
piece more than that, so that any occurrence within the budget holds a piece
unchanged. One automaton finds all pieces of all items in a document; around
each hit Myers' bit-parallel algorithm gives the least edit distance between the
item and any stretch of the text.

The items travel to the executors in shards of ``SHARD_CHARS`` characters, about,
one pass over the documents for each, so that memory is bounded whatever the
benchmark's size; one of usual size is one shard. An item longer than
``ITEM_CHARS`` is refused, as a benchmark item of that size is a mistake.

Defined results: a null or empty document or item matches nothing; an item too
short for one edit must occur unchanged; rows that repeat an id or an item are
matched each time and reported once by id; ids of both tables are of any type,
and null ones are reported as such; empty tables give an empty result.
Extra columns are ignored by ``matches`` and returned untouched by ``clean``.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.common import bounded_batches

CHARS_PER_EDIT = 20
SHARD_CHARS = 2_000_000
ITEM_CHARS = 1_000_000


def normalized(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str) -> int:
    return len(item) // CHARS_PER_EDIT


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``edits`` + 1 pieces of near equal length."""
    n = edits + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


class Myers:
    """Bit-parallel search for one pattern of any length."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | (1 << i)

    def best(self, text: str) -> tuple[int, int]:
        """The least distance to any stretch of ``text``, and where the first such one ends."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        plus, minus, score, best = full, 0, self.m, (self.m, 0)
        get = self.masks.get
        for at, c in enumerate(text, 1):
            eq = get(c, 0)
            x = eq | minus
            d0 = ((((x & plus) + plus) ^ plus) | x) & full
            up = (minus | ~(d0 | plus)) & full
            down = plus & d0
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = (up << 1) & full  # a match may start anywhere
            down = (down << 1) & full
            plus = (down | ~(d0 | up)) & full
            minus = up & d0
            if score < best[0]:
                best = (score, at)
        return best


class Matcher:
    """All items of one shard."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t, budget(t)) for i, t in ((i, normalized(t)) for i, t in items) if t]
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for offset, piece in pieces(t, e):
                found.setdefault(piece, []).append((k, offset))
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.myers: dict[int, Myers] = {}

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalized text) of each item found."""
        t = normalized(text)
        if not t or not self.items:
            return []
        spans: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(t):
            for k, offset in where:
                start = end + 1 - length - offset
                _, item, e = self.items[k]
                low, high = max(0, start - e), min(len(t), start + len(item) + e)
                own = spans.setdefault(k, [])
                if own and low <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(low, own[-1][0]), max(high, own[-1][1])
                else:
                    own.append([low, high])
        out = []
        for k in sorted(spans):
            i, item, e = self.items[k]
            best = None
            for low, high in spans[k]:
                at = t.find(item, low, high)
                if at >= 0:
                    found = (0, at + len(item))
                else:
                    distance, end = self.myers.setdefault(k, Myers(item)).best(t[low:high])
                    found = (distance, low + end)
                best = found if best is None else min(best, found)
                if best[0] == 0:
                    break
            if best[0] <= e:
                out.append((i, *best))
        return out


_ready: dict[str, Matcher] = {}


def _matcher(data: bytes) -> Matcher:
    """One for each worker process and shard."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _ready:
        _ready.clear()
        _ready[key] = Matcher(pickle.loads(data))
    return _ready[key]


def _shards(benchmark: DataFrame, id: str, text: str) -> Iterator[bytes]:
    rows = benchmark.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t")).filter("t IS NOT NULL").distinct()
    total, longest = (x or 0 for x in rows.agg(F.sum(F.length("t")), F.max(F.length("t"))).first())
    if longest > ITEM_CHARS:
        raise ValueError(f"a benchmark item has {longest} characters; at most {ITEM_CHARS} are allowed")
    n = total // SHARD_CHARS + 1
    for k in range(n):
        yield pickle.dumps([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k).orderBy("id", "t").collect()])


def matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, distance) for each document and each item that occurs in it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t"))
    item_type = benchmark.schema[item_id].dataType
    item_arrow, schema = to_arrow_type(item_type), f"id {rows.schema['id'].dataType.simpleString()}, item {item_type.simpleString()}, distance bigint"
    out = None
    for data in _shards(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast(data)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = _matcher(shared.value)
            for batch in batches:
                found = [(k, *x[:2]) for k, t in enumerate(batch.column(1).to_pylist()) for x in m.matches(t)]
                ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], item_arrow), pa.array([x[2] for x in found], pa.int64())], names=["id", "item", "distance"])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    out = out.groupBy("id", "item").agg(F.min("distance").alias("distance"))
    return out.select(F.col("id").alias(id), F.col("item").alias(item_id), "distance")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item occurs, with all their columns."""
    spark = docs.sparkSession
    bounded_batches(spark)
    at = docs.columns.index(text)
    for data in _shards(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast(data)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = _matcher(shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not m.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
