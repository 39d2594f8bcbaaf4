"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_j x_j + 1/2 sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2)),
so all pairwise interactions cost one pass over a text's features. Words are
hashed into buckets and weighted by the logarithm of their counts; statistics
of structure, and the stored length, are put into bins.

The model is fitted on ``TRAIN_ROWS`` labelled ids at most (drawn by a hash of
the id), one text each, and on ``TRAIN_VALUES`` features in all, in one task of
that input; scoring goes over every whole text.

Defined results: null and empty texts have no words but are scored by the bins;
a null id is never held out; repeated rows are scored each time, and of the texts
of one id the one with the least hash is learned from; without any labels all
scores are 0.5. Ids are of any type. Label, language, source and id are no features.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches

TRAIN_ROWS = 12_000
TRAIN_VALUES = 16_000_000
BUCKETS = 1 << 16
RANK = 8
BINS = 16
BATCH = 64
#: Minibatches to take at least, unless that were more epochs than the second bound.
STEPS, EPOCHS = 1500, 150
RATE = 0.1
THRESHOLD = 0.3
FOLDS = 5

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>{}[]^~\\@=+_"
_STOPS = ".,;:!?"
_CACHE = 500_000


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        b = self[word] = xxhash.xxh32_intdigest(word) & (BUCKETS - 1)
        return b


_buckets = _Buckets()


def statistics(text: str, words: list[str], stored: int | None) -> list[float]:
    """Each in [0, 1]; the names of the bins are their places."""
    n, m = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    share = lambda chars, scale: min(1.0, scale * sum(map(text.count, chars)) / n)
    upper = sum(map(str.isupper, words)) / m
    capital = sum(w[0].isupper() for w in words) / m
    ended = sum(x.rstrip()[-1:] in ".!?…\"'" for x in lines) / max(1, len(lines))
    lengths = sum(map(len, words)) / m
    return [
        min(1.0, math.log2(m) / 16),
        min(1.0, lengths / 16),
        share(_SYMBOLS, 5),
        share("|", 5),
        share("!", 5),
        share(_STOPS, 5),
        share("0123456789", 5),
        upper,
        min(1.0, 2 * capital),
        len(set(words)) / m,
        len(set(lines)) / max(1, len(lines)),
        min(1.0, math.log2(1 + len(lines)) / 12),
        min(1.0, math.log2(1 + n / max(1, len(lines))) / 14),
        ended,
        sum(len(w) == 1 for w in words) / m,
        sum(map(str.__eq__, words, words[1:])) / m,
        min(1.0, max(map(len, words), default=0) / 64),
        min(1.0, math.log2(1 + (len(text) if stored is None else max(0, stored))) / 20),
    ]


N_STATISTICS = 18
SIZE = BUCKETS + N_STATISTICS * BINS


def features(text: str | None, stored: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values."""
    text = text or ""
    words = _WORD.findall(text)
    if len(_buckets) > _CACHE:
        _buckets.clear()
    hashed = np.fromiter(map(_buckets.__getitem__, _WORD.findall(text.lower())), np.int64)
    index, counts = np.unique(hashed, return_counts=True)
    values = np.log1p(counts).astype(np.float32)
    values *= 1 / max(1e-9, float(np.sqrt((values**2).sum())))
    stats = statistics(text, words, stored)
    bins = [BUCKETS + k * BINS + min(BINS - 1, int(s * BINS)) for k, s in enumerate(stats)]
    return np.concatenate([index, bins]).astype(np.int32), np.concatenate([values, np.full(len(bins), 0.5, np.float32)])


class Machine:
    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def pack(self) -> bytes:
        return np.float32(self.bias).tobytes() + self.weights.astype(np.float32).tobytes() + self.factors.astype(np.float32).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Machine:
        a = np.frombuffer(data, np.float32)
        return cls(float(a[0]), a[1 : SIZE + 1], a[SIZE + 1 :].reshape(SIZE, RANK))

    @classmethod
    def blank(cls) -> Machine:
        return cls(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32))

    def score(self, index: np.ndarray, values: np.ndarray) -> float:
        xv = self.factors[index] * values[:, None]
        z = self.bias + float(self.weights[index] @ values) + 0.5 * float((xv.sum(axis=0) ** 2).sum() - (xv**2).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Minibatches of the logistic loss with adaptive steps."""
    rng = np.random.default_rng(seed)
    y = labels.astype(np.float32)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias, w = math.log(rate / (1 - rate)), np.zeros(SIZE, np.float32)
    v = rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32)
    gw, gv, gb = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, RANK), 1e-3, np.float32), 1e-3
    for _ in range(min(EPOCHS, max(4, STEPS * BATCH // len(rows)))):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            own = order[start : start + BATCH]
            sizes = [len(rows[i][0]) for i in own]
            index = np.concatenate([rows[i][0] for i in own])
            x = np.concatenate([rows[i][1] for i in own])
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            xv = v[index] * x[:, None]
            s = np.add.reduceat(xv, at, axis=0)
            z = bias + np.add.reduceat(w[index] * x, at) + 0.5 * ((s**2).sum(axis=1) - np.add.reduceat((xv**2).sum(axis=1), at))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
            each = np.repeat(d, sizes)
            dv = each[:, None] * (np.repeat(s, sizes, axis=0) * x[:, None] - xv * x[:, None])
            used, place = np.unique(index, return_inverse=True)
            sum_w = np.bincount(place, each * x, len(used)).astype(np.float32) + 1e-6 * w[used]
            sum_v = np.stack([np.bincount(place, dv[:, f], len(used)) for f in range(RANK)], axis=1).astype(np.float32) + 1e-6 * v[used]
            gw[used] += sum_w**2
            gv[used] += sum_v**2
            w[used] -= RATE * sum_w / np.sqrt(gw[used])
            v[used] -= 0.5 * RATE * sum_v / np.sqrt(gv[used])
            step = float(d.sum())
            gb += step**2
            bias -= RATE * step / math.sqrt(gb)
    return Machine(bias, w, v)


def fold(id: Column) -> Column:
    """The remainder that holds rows out where it is 0."""
    return F.crc32(id.cast("string").cast("binary")) % FOLDS


def _featured(docs: DataFrame, id: str, text: str, chars: str | None) -> DataFrame:
    stored = F.col(chars).cast("bigint") if chars and chars in docs.columns else F.lit(None).cast("bigint")
    return docs.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__t"), stored.alias("__n"))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", chars: str | None = "n_chars", rows: int = TRAIN_ROWS) -> bytes:
    """The packed machine."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull() & (fold(F.col(id)) != 0))
    # Conflicting labels of one id count as the lower one.
    known = known.groupBy(F.col(id).alias("__lid")).agg(F.min(label).cast("int").alias("__y"))
    drawn = known.orderBy(F.xxhash64("__lid"), "__lid").limit(rows)  # the documented bound of the sample
    joined = _featured(docs, id, text, chars).join(F.broadcast(drawn), F.col("__id") == F.col("__lid"))
    one = F.min(F.struct(F.xxhash64("__t").alias("h"), "__t", "__n")).alias("one")
    joined = joined.groupBy(F.col("__id").cast("string").alias("__id"), "__y").agg(one).select("__id", "one.__t", "one.__n", "__y")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=["id", "y", "i", "v"]
            )

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "v"])
        made = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(group.i, group.v, strict=True)]
        return pd.DataFrame({"model": [fit(made, group.y.to_numpy()).pack()]})

    got = joined.mapInArrow(extract, "id string, y int, i binary, v binary")
    # A window over at most ``rows`` rows.
    got = got.withColumn("sum", F.sum(F.length("i") / 4).over(Window.orderBy(F.xxhash64("id"), "id"))).filter(F.col("sum") <= TRAIN_VALUES).drop("sum")
    found = got.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "model binary").collect()
    return bytes(found[0].model) if found else Machine.blank().pack()


_ready: dict[bytes, Machine] = {}


def _machine(data: bytes) -> Machine:
    key = xxhash.xxh3_128_digest(data)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Machine.unpack(data)
    return _ready[key]


def score(docs: DataFrame, model: bytes, id: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """(id, score) for each row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _machine(shared.value)
        for batch in batches:
            scores = [m.score(*features(t, n)) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["__id", "score"])

    rows = _featured(docs, id, text, chars)
    return rows.mapInArrow(run, f"__id {rows.schema[0].dataType.simpleString()}, score double").withColumnRenamed("__id", id)


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", chars: str | None = "n_chars") -> DataFrame:
    """(id, held_out, score, predicted) for each row."""
    out = score(docs, train(docs, labels, id, text, label, chars), id, text, chars)
    held = F.coalesce(fold(F.col(id)) == 0, F.lit(False))
    return out.select(id, held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
