"""Substring dedup with fixed-block anchors.

A window of w words is repeated if its words also start elsewhere, in the same
or another document; every word that some repeated window covers goes.

1. Anchors: each document is cut into non-overlapping blocks of (w + 1) // 2
   words, so that any window holds one whole block. Blocks are the index; the
   rolling windows of that length of all documents probe it. Both are dealt by
   the high bits of their hash. Probes travel as sorted, delta-coded arrays
   without an address: an index block is hit if its hash comes twice.
2. Extension: around each hit block, the windows that hold it are hashed in
   full and compared the same way, now with their addresses. Runs of repeated
   windows are the maximal exact repeats.
3. The documents, partitioned by row key once for both joins, lose the covered
   words.

A common passage costs no pairs of documents: hashes are counted, never joined
with each other. What comes twice in one batch of documents is known to be
repeated there and then: of its addresses one goes to the hash's bucket, and all
are passed on by a bucket that depends on the batch. So a passage of a third of
all documents brings one entry a batch to its bucket. Full windows are compared
by 96 bits.

Defined results: a null or empty text has no words; documents of fewer than w
words keep all; equal rows repeat each other and both lose the text; rows are
told apart by id and text, so that a null id, or one that comes again with
another text, is judged by its own text. Ids are of any type. An empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import shingles
from quern.llm.common import bounded_batches, materialize, scratch

WINDOW = 35
#: Words whose probes one bucket takes, about; bytes of a word, about; fewest buckets.
BUCKET_WORDS = 2_000_000
WORD_BYTES = 4
LEAST_BUCKETS = 64

_C = 0x9E3779B97F4A7C15
_D = pow(_C, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _powered(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16) * 2
        _powers[:] = [_geometric(c, size) for c in (_C, _D)]
    return _powers[0][:n], _powers[1][:n]


def _geometric(c: int, size: int) -> np.ndarray:
    out = np.full(size, c, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive items."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    up, down = _powered(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    return shingles.mixed((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


def _planes(a: np.ndarray) -> bytes:
    """Little-endian byte planes, as many as the largest value needs, behind their number; zero bytes then lie together."""
    a = np.ascontiguousarray(a, "<u8")
    n = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([n]) + np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    n = data[0]
    found = np.frombuffer(data, np.uint8, offset=1).reshape(n, -1).T
    out = np.zeros((found.shape[0], 8), np.uint8)
    out[:, :n] = found
    return out.reshape(-1).view("<u8")


def _sizes(docs: DataFrame, text: str) -> tuple[int, int]:
    """Bits of the bucket and of the probes' hashes: what the whole input asks for."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()[0] or 0
    n = max(1, total // WORD_BYTES)
    bucket = max(LEAST_BUCKETS, n // BUCKET_WORDS).bit_length() - 1
    return bucket, min(64, max(bucket + 16, n.bit_length() + 11))


def _split(values: np.ndarray, bits: int, bucket: int) -> Iterator[tuple[int, slice]]:
    """The non-empty buckets of sorted values and where they lie."""
    tops = values >> np.uint64(bits - bucket)
    at = np.flatnonzero(np.concatenate([[True], tops[1:] != tops[:-1]])) if len(values) else np.empty(0, int)
    for i, start in enumerate(at):
        yield int(tops[start]), slice(int(start), int(at[i + 1]) if i + 1 < len(at) else len(values))


def _repeats(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries come more than once, and which are the first of their kind."""
    order = np.lexsort(keys)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    again, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
    if len(order):
        again[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        first[order] = ~np.concatenate([[False], same])
    return again, first


def _anchor_rows(rows: DataFrame, window: int, bucket: int, bits: int) -> DataFrame:
    """(bucket, probes, blocks, keys, numbers, known) from (k, t, text); known are addresses of blocks that the batch knows to be hit."""
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rolls, own, keys, numbers = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                w = shingles.words(text)
                if len(w) < window:
                    continue
                r = rolling(shingles.word_hashes(w), block) >> np.uint64(64 - bits)
                rolls.append(r)
                own.append(r[::block])
                keys.append(np.full(len(own[-1]), i, np.int64))
                numbers.append(np.arange(len(own[-1]), dtype=np.uint64))
            if not rolls:
                continue
            probes = np.sort(np.concatenate(rolls))
            twice = np.unique(probes[1:][probes[1:] == probes[:-1]])
            probes = probes[np.concatenate([[True, True], probes[2:] != probes[:-2]])[: len(probes)]]  # two of a kind say enough
            blocks, keys, numbers = np.concatenate(own), np.concatenate(keys).view(np.uint64), np.concatenate(numbers)
            known = np.isin(blocks, twice)
            passed = _planes(keys[known]), _planes(numbers[known])
            home = int(shingles.mixed(keys[:1])[0] >> np.uint64(64 - bucket)) if bucket else 0
            blocks, keys, numbers = blocks[~known], keys[~known], numbers[~known]
            order = np.argsort(blocks)
            blocks, keys, numbers = blocks[order], keys[order], numbers[order]
            mask = np.uint64((1 << (bits - bucket)) - 1)
            found: dict[int, list] = {}
            for b, at in _split(probes, bits, bucket):
                found[b] = [_planes(np.diff(probes[at] & mask, prepend=np.uint64(0))), None, None, None, None]
            for b, at in _split(blocks, bits, bucket):
                found[b][1:4] = [_planes(np.diff(blocks[at] & mask, prepend=np.uint64(0))), _planes(keys[at]), _planes(numbers[at])]
            found.setdefault(home, [_planes(np.empty(0, np.uint64)), None, None, None, None])[4] = {"keys": passed[0], "numbers": passed[1]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int32()), *(pa.array([x[k] for x in found.values()], pa.binary()) for k in range(4)), *(pa.array([x[4] and x[4][k] for x in found.values()], pa.binary()) for k in ("keys", "numbers"))],
                names=["bucket", "probes", "blocks", "keys", "numbers", "known_keys", "known_numbers"],
            )

    return rows.mapInArrow(run, "bucket int, probes binary, blocks binary, keys binary, numbers binary, known_keys binary, known_numbers binary")


def _hit_blocks(dealt: DataFrame) -> DataFrame:
    """(k, number) of the index blocks that come more than once."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        probes = np.sort(np.concatenate([np.cumsum(_unplanes(x)) for x in group.probes]))
        twice = np.unique(probes[1:][probes[1:] == probes[:-1]])
        keys, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, n in zip(group.known_keys, group.known_numbers, strict=True):
            if i is not None:
                keys.append(_unplanes(i).view(np.int64))
                numbers.append(_unplanes(n).astype(np.int64))
        for b, i, n in zip(group.blocks, group["keys"], group.numbers, strict=True):
            if b is None or not len(twice):
                continue
            blocks = np.cumsum(_unplanes(b))
            at = np.minimum(np.searchsorted(twice, blocks), len(twice) - 1)
            hit = twice[at] == blocks
            keys.append(_unplanes(i)[hit].view(np.int64))
            numbers.append(_unplanes(n)[hit].astype(np.int64))
        return pd.DataFrame({"k": np.concatenate(keys), "number": np.concatenate(numbers)})

    return dealt.groupBy("bucket").applyInPandas(run, "k bigint, number bigint")


def _window_rows(rows: DataFrame, window: int, bucket: int) -> DataFrame:
    """(bucket, hashes, more, refs, positions, keys, ts): the full windows around hit blocks, from (k, t, text, numbers).

    A row without hashes passes on windows that its batch knows to be repeated.
    """
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, refs, places = [], [], [], []
            keys, ts = (np.asarray(batch.column(k).to_pylist(), np.int64) for k in (0, 1))
            for k, (text, numbers) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                w = shingles.words(text)
                if len(w) < window:
                    continue
                h = shingles.word_hashes(w)
                spread = np.asarray(numbers, np.int64)[:, None] * block - np.arange(block)[None, :]
                at = np.unique(spread[(spread >= 0) & (spread <= len(w) - window)])
                first.append(rolling(h, window)[at])
                second.append(rolling(shingles.mixed(h + np.uint64(1)), window)[at] >> np.uint64(32))
                refs.append(np.full(len(at), k, np.uint64))
                places.append(at.astype(np.uint64))
            if not first or not sum(map(len, first)):
                continue
            first, second, refs, places = map(np.concatenate, (first, second, refs, places))
            again, one = _repeats(second, first)
            out = []

            def put(b: int, hashes: bytes | None, more: bytes | None, refs: np.ndarray, places: np.ndarray, keys=keys, ts=ts, out=out) -> None:
                used, local = np.unique(refs.astype(np.int64), return_inverse=True)
                out.append((b, hashes, more, _planes(local.astype(np.uint64)), _planes(places), keys[used].tobytes(), ts[used].tobytes()))

            if again.any():
                put(int(shingles.mixed(first[:1])[0] >> np.uint64(64 - bucket)) if bucket else 0, None, None, refs[again], places[again])
            first, second, refs, places = first[one], second[one], refs[one], places[one]
            order = np.argsort(first, kind="stable")
            first, second, refs, places = first[order], second[order], refs[order], places[order]
            for b, at in _split(first, 64, bucket):
                put(b, _planes(first[at]), _planes(second[at]), refs[at], places[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in range(1, 7))], names=["bucket", "hashes", "more", "refs", "positions", "keys", "ts"]
            )

    return rows.mapInArrow(run, "bucket int, hashes binary, more binary, refs binary, positions binary, keys binary, ts binary")


def _repeated(dealt: DataFrame) -> DataFrame:
    """(k, t, positions): where repeated windows start."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked = group[group.hashes.notna()]
        h = np.concatenate([np.empty(0, np.uint64), *map(_unplanes, asked.hashes)])
        m = np.concatenate([np.empty(0, np.uint64), *map(_unplanes, asked.more)])
        twice, _ = _repeats(m, h)
        out, at = {"k": [], "t": [], "positions": []}, 0
        for hashes, r, p, i, t in zip(group.hashes, group.refs, group.positions, group["keys"], group.ts, strict=True):
            refs, places = _unplanes(r), _unplanes(p).astype("<u4")
            if hashes is not None:
                hit = twice[at : at + len(refs)]
                at += len(refs)
                refs, places = refs[hit], places[hit]
            keys, ts = np.frombuffer(i, np.int64), np.frombuffer(t, np.int64)
            order = np.argsort(refs, kind="stable")
            refs, places = refs[order], places[order]
            for k in np.unique(refs):
                lo, hi = np.searchsorted(refs, [k, k + np.uint64(1)])
                out["k"].append(keys[int(k)]), out["t"].append(ts[int(k)]), out["positions"].append(places[lo:hi].tobytes())
        return pd.DataFrame(out)

    return dealt.groupBy("bucket").applyInPandas(run, "k bigint, t bigint, positions binary")


OUTPUTS = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "kept_sha256": pa.string(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
_SQL = {"n_words": "bigint", "n_removed": "bigint", "kept": "string", "kept_sha256": "string", "removed": "array<struct<start:bigint,end:bigint>>"}


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, outputs: tuple[str, ...] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """(id, *outputs) for each row; ``removed`` lists word ranges, end exclusive."""
    bounded_batches(docs.sparkSession)
    bucket, bits = _sizes(docs, text)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id), body).alias("k"), F.xxhash64(body).alias("t"), body.alias("text"), F.col(id).alias("id"))
    hits = _hit_blocks(_anchor_rows(rows.select("k", "t", "text"), window, bucket, bits))
    with scratch(docs.sparkSession):
        hits = materialize(hits.groupBy("k").agg(F.collect_set("number").alias("numbers")), lasting=True)
    # With the id, though it is not read, so that both joins take the same exchange of the rows.
    around = rows.join(hits, "k").select("k", "t", "text", "numbers", "id")
    again = _repeated(_window_rows(around, window, bucket))
    again = again.groupBy("k").agg(F.collect_list(F.struct("t", "positions")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {o: [] for o in outputs}
            for t, text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                w = shingles.words(text)
                n, kept, ranges = len(w), w, []
                own = [np.frombuffer(x["positions"], "<u4") for x in found or () if x["t"] == t]
                if own:
                    edge = np.zeros(n + 1, np.int64)
                    starts = np.unique(np.concatenate(own)).astype(np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    gone = np.cumsum(edge)[:n] > 0
                    kept = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    ranges = [{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)]
                for o, values in made.items():
                    if o == "n_words":
                        values.append(n)
                    elif o == "n_removed":
                        values.append(n - len(kept))
                    elif o == "removed":
                        values.append(ranges)
                    else:
                        joined = " ".join(kept)
                        values.append(joined if o == "kept" else hashlib.sha256(joined.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[o], OUTPUTS[o]) for o in outputs)], names=["id", *outputs])

    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.join(again, "k", "left").select("id", "t", "text", "found").mapInArrow(run, f"id {id_type}, " + ", ".join(f"{o} {_SQL[o]}" for o in outputs))
    return out.withColumnRenamed("id", id)
