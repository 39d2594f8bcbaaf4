"""Byte-level BPE encoding and decoding with a transducer lexicon.

One pass over all texts sums up the words of at most ``WORD_LENGTH`` characters
(a Misra-Gries summary in each task, so its memory is bounded; every word above
its share is in it). The most frequent ones, ``LEXICON_WORDS`` at most, are
encoded once and compiled into a minimal acyclic transducer, which executors map
into memory. A second pass encodes: all different pieces of a stretch of text
walk the transducer side by side, one byte a step, and those that it does not
know are merged exactly by rank, side by side as well, one merge a step; a small
memo spares merging them again in the next stretch. The result depends on
neither.

The vocabulary file is read on the driver and broadcast; its size, that of the
lexicon and of what the driver gathers are bounded by the file and by parameters.
The transducer's file lies in a temporary folder of each machine, where a lost
executor's successor makes it again from the broadcast.

Defined results: a null text counts as empty and has no ids; repeated rows are
encoded each time; an empty table gives an empty result; only the named columns
are read. Very long texts are taken by stretches of about ``STRETCH``
characters, cut where a piece starts; very long words are merged with a heap in
n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import lexicon
from quern.llm.common import bounded_batches, materialize, scratch

#: Fixed value: the pattern of byte-level pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?=\p{White_Space}|\Z)|\p{White_Space}+"
LEXICON_WORDS = 50_000
SUMMARY_WORDS = 20_000
WORD_LENGTH = 64
#: Of merged words, some 35 MB a worker.
MEMO_WORDS = 200_000
STRETCH = 4 << 20
HEAP_LENGTH = 48
#: Places of pieces that are merged side by side, some 5 MB.
CELLS = 1 << 17
MASK = (1 << 20) - 1
NEVER = 1 << 62

#: A space before anything but white space always starts a new piece.
_CUT = re.compile(r" (?=\S)")


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Reads a byte-level BPE file of the tokenizers library."""

    def __init__(self, file: bytes, lexicon_data: bytes | None = None):
        spec = json.loads(file)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        chars = byte_chars()
        as_bytes = lambda token: bytes(chars[c] for c in token)
        vocab = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.tokens = [b""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = map(as_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            self.pairs[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        self.added: dict[str, int] = {}
        for a in spec["added_tokens"]:
            if a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]:
                raise ValueError(f"unsupported added token {a['content']}")
            self.added[a["content"]] = a["id"]
            self.tokens[a["id"]] = a["content"].encode()
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        # The same pairs as arrays; a value orders by rank, then by the place that is put in later, and holds the merged id. The last one is of no pair.
        keys, found = np.array([*self.pairs], np.int64), np.array([*self.pairs.values()], np.int64)
        self._pair_places, self._pair_values = lexicon.Places(keys), np.append(found >> 20 << 26 | found & MASK, NEVER)
        self._byte_ids = np.array([*self.byte_id, MASK], np.int64)  # the last one stands for no byte
        self._byte_pairs = self._values((self._byte_ids[:, None] << 20 | self._byte_ids).ravel())
        self.lexicon = lexicon.opened(lexicon_data) if lexicon_data else None
        self.memo: dict[bytes, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost first."""
        ids, get = [self.byte_id[b] for b in piece], self.pairs.get
        if len(ids) > HEAP_LENGTH:
            return self._merged_long(ids)
        # A pair's value orders by rank and holds the merged id.
        found = [get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == NEVER:
                break
            at = found.index(best)
            ids[at : at + 2] = [best & MASK]
            del found[at]
            if at:
                found[at - 1] = get(ids[at - 1] << 20 | ids[at], NEVER)
            if at < len(found):
                found[at] = get(ids[at] << 20 | ids[at + 1], NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        left, right, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []

        def offer(i: int) -> None:
            if i >= 0 and right[i] < n and (found := pairs.get(ids[i] << 20 | ids[right[i]])) is not None:
                heapq.heappush(heap, (found, i, ids[i], ids[right[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            found, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = found & MASK, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(left[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def _values(self, keys: np.ndarray) -> np.ndarray:
        return self._pair_values[self._pair_places.find(keys)]

    def merged_all(self, pieces: list[bytes]) -> list[bytes]:
        """``merged`` for many pieces, as little-endian 32-bit integers; those of like length take their merges side by side."""
        done: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        lengths = lengths[order]
        start, end = np.searchsorted(lengths, (1, HEAP_LENGTH + 1)).tolist()
        for k in order[end:].tolist():
            done[k] = array("I", self.merged(pieces[k])).tobytes()
        while start < end:
            n = int(lengths[start])
            stop = min(end, start + max(1, CELLS // n), int(np.searchsorted(lengths, n + n // 8, "right")))
            which = order[start:stop].tolist()
            for k, ids in zip(which, self._merged_block([pieces[k] for k in which], lengths[start:stop]), strict=True):
                done[k] = ids
            start = stop
        return done

    def _merged_block(self, pieces: list[bytes], lengths: np.ndarray) -> Iterator[bytes]:
        """One column for each piece, its bytes below each other with an empty place above and below."""
        n, places = len(pieces), np.arange(int(lengths.max()) + 2)
        symbols = np.full((len(places), n), 256)
        inside = (places >= 1) & (places <= lengths[:, None])
        symbols.T[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        ids, values = self._byte_ids[symbols], self._byte_pairs[symbols[:-1] * 257 + symbols[1:]] | places[:-1, None] << 20
        below, above = np.repeat(places + 1, n), np.repeat(places - 1, n)
        flat_ids, flat_values = ids.reshape(-1), values.reshape(-1)  # the same memory
        while True:
            best = values.min(axis=0)
            on = np.flatnonzero(best < NEVER)
            if not len(on):
                break
            place, merged = best[on] >> 20 & 63, best[on] & MASK
            at = place * n + on
            gone = below[at] * n + on
            after, before = below[gone], above[at]
            flat_ids[at], flat_ids[gone], flat_values[gone] = merged, -1, NEVER
            below[at], above[after * n + on] = after, place
            made = self._values(np.concatenate([merged << 20 | flat_ids[after * n + on], flat_ids[before * n + on] << 20 | merged]))
            flat_values[at], flat_values[before * n + on] = made[: len(on)] | place << 20, made[len(on) :] | before << 20
        left = ((ids >= 0) & (ids < MASK)).T
        data, ends = ids.T[left].astype("<u4").tobytes(), np.cumsum(left.sum(axis=1)) * 4
        return (data[a:b] for a, b in pairwise([0, *ends.tolist()]))

    def _pieces_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces, as little-endian 32-bit integers: from the lexicon, else by merging."""
        data = [p.encode() for p in pieces]
        found = self.lexicon.get_all(data) if self.lexicon else [None] * len(data)
        memo = self.memo
        for k, word in enumerate(data):
            if found[k] is None:
                found[k] = memo.get(word)
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(rest, self.merged_all([data[k] for k in rest]), strict=True):
            found[k] = ids
            if len(data[k]) <= WORD_LENGTH:
                if len(memo) >= MEMO_WORDS:
                    for old in list(islice(memo, MEMO_WORDS // 2)):
                        del memo[old]
                memo[data[k]] = ids
        return found

    def _cut(self, parts: Iterable[str], plain: list[str], several: dict[str, int], pieces: list[str]) -> set[str]:
        """Deal out what stands behind a space: those of one piece, and the number and the pieces of others. Returns what may not start a piece there."""
        loose = set()
        for p in parts:
            if p.isascii() and p.isalpha():
                plain.append(p)
            elif not p or p[0].isspace():
                loose.add(p)
            else:
                c = (" " + p[:-1], p[-1]) if p[-1] in ",." and p.isascii() and p[:-1].isalpha() else self.pieces(" " + p)
                several[p] = len(c)
                pieces += c
        return loose

    def _stretches(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, all together about one stretch long and without added tokens."""
        tails = [t.split(" ") for t in texts]
        heads = [parts.pop(0) for parts in tails]
        plain, several, cut = [], {}, []
        parts = set().union(*tails)
        if loose := self._cut(parts, plain, several, cut):
            # White space next to white space: there only a space before something else starts a piece.
            again = [k for k, t in enumerate(tails) if not loose.isdisjoint(t)]
            for k in again:
                heads[k], *tails[k] = _CUT.split(texts[k])
            self._cut(set().union(*(tails[k] for k in again)) - parts, plain, several, cut)
        first = {p: self.pieces(p) for p in set(heads)}
        pieces = [" " + p for p in plain]
        pieces += set(chain(cut, *first.values())).difference(pieces)
        found = self._pieces_ids(pieces)
        ids, known = dict(zip(pieces, found, strict=True)), dict(zip(plain, found))
        each = map(ids.__getitem__, cut)
        for p, n in several.items():
            known[p] = next(each) + next(each) if n == 2 else b"".join(islice(each, n))
        start = {p: b"".join([ids[x] for x in c]) for p, c in first.items()}
        return [start[h] + b"".join(map(known.__getitem__, t)) for h, t in zip(heads, tails, strict=True)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        # What to join for each text: ids of added tokens, and numbers of stretches.
        plan, todo = [], []
        for t in texts:
            own: list[bytes | int] = []
            for i, s in enumerate(self.special.split(t) if self.special and self.special.search(t) else [t]):
                if i % 2:
                    own.append(np.array([self.added[s]], "<u4").tobytes())
                    continue
                at = 0
                while at < len(s):
                    cut = _CUT.search(s, at + STRETCH) if len(s) - at > STRETCH else None
                    end = cut.start() if cut else len(s)
                    own.append(len(todo))
                    todo.append(s[at:end])
                    at = end
            plan.append(own)
        done: list[bytes] = []
        start, size = 0, 0
        for k, s in enumerate(todo):
            size += len(s)
            if size >= STRETCH or k == len(todo) - 1:
                done += self._stretches(todo[start : k + 1])
                start, size = k + 1, 0
        return [b"".join([done[x] if isinstance(x, int) else x for x in own]) for own in plan]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_ready: dict[str, Tokenizer] = {}


def _tokenizer(key: str, file: Broadcast, data: Broadcast | None) -> Tokenizer:
    """One for each worker process."""
    if key not in _ready:
        _ready.clear()
        _ready[key] = Tokenizer(file.value, data.value if data else None)
    return _ready[key]


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _summed(tables: list[pa.Table], most: int) -> pa.Table:
    """One row for each word; where there are more than ``most``, only those that count more than the first one beyond ``SUMMARY_WORDS``, less its count."""
    found = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")])
    word, n = found["word"], found["n_sum"]
    if len(n) > most:
        n = n.to_numpy()
        least = np.partition(n, -SUMMARY_WORDS - 1)[-SUMMARY_WORDS - 1]
        word, n = word.filter(pa.array(n > least)), pa.array(n[n > least] - least)
    return pa.table({"word": word, "n": n})


def frequent_words(docs: DataFrame, text: str = "text", limit: int = LEXICON_WORDS) -> list[str]:
    """What stands between spaces, by falling frequency; ``limit`` at most.

    A word must make up 1 / (4 ``limit``) of what the summaries count, so that
    not more than 4 ``limit`` rows come to the driver.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, rows, most = [], 0, 8 * SUMMARY_WORDS
        for batch in batches:
            found = pc.split_pattern(batch.column(0), " ").flatten().value_counts()
            short = pc.less_equal(pc.utf8_length(found.field("values")), WORD_LENGTH)
            tables.append(pa.table({"word": found.field("values"), "n": found.field("counts")}).filter(short))
            rows += len(tables[-1])
            if rows > 2 * most:
                tables = [_summed(tables, most)]
                rows = len(tables[0])
        if tables:
            top = _summed(tables, most)
            if len(top) > SUMMARY_WORDS:
                top = top.take(np.argpartition(top["n"].to_numpy(), -SUMMARY_WORDS)[-SUMMARY_WORDS:])
            tables.clear()
            yield from top.to_batches()
            del top
        pa.default_memory_pool().release_unused()  # the worker serves other stages

    spark = docs.sparkSession
    bounded_batches(spark)
    found = docs.select(F.col(text).cast("string")).mapInArrow(summed, "word string, n bigint")
    with scratch(spark):
        found = materialize(found.groupBy("word").agg(F.sum("n").alias("n")), narrow=True)
        least = (found.agg(F.sum("n")).first()[0] or 0) // (4 * limit)
        top = found.filter(F.col("n") > least).orderBy(F.desc("n"), "word").limit(limit)
        return [r.word for r in top.collect()]


def compiled(docs: DataFrame, path: str, text: str = "text", limit: int = LEXICON_WORDS) -> bytes:
    """The transducer of the corpus's frequent words."""
    plain = Tokenizer(_file(path))
    pieces = {p for w in frequent_words(docs, text, limit) for p in plain.pieces(" " + w)}
    return lexicon.build({p.encode(): plain.merged(p.encode()) for p in pieces})


OUTPUTS = {"n_tokens": pa.int64(), "ids": pa.binary(), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}
_SQL = {"n_tokens": "bigint", "ids": "binary", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids"), data: bytes | None = None) -> DataFrame:
    """(id, *outputs) for each row; ``data`` is a transducer from ``compiled``, made here if not given."""
    spark = docs.sparkSession
    data, file = compiled(docs, path, text) if data is None else data, _file(path)
    key = hashlib.sha256(file + data).hexdigest()
    shared, vocabulary = spark.sparkContext.broadcast(data), spark.sparkContext.broadcast(file)
    decoding = any(o.startswith("decoded") for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(key, vocabulary, shared)
        for batch in batches:
            made: dict[str, list] = {o: [] for o in outputs}
            for ids in t.encode_all([x or "" for x in batch.column(1).to_pylist()]):
                back = t.decode(ids) if decoding else ""
                for o, values in made.items():
                    if o == "n_tokens":
                        values.append(len(ids) // 4)
                    elif o == "ids":
                        values.append(ids)
                    elif o == "ids_sha256":
                        values.append(hashlib.sha256(ids).hexdigest())
                    elif o == "decoded":
                        values.append(back)
                    else:
                        values.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[o], OUTPUTS[o]) for o in outputs)], names=["__id", *outputs])
        pa.default_memory_pool().release_unused()

    bounded_batches(spark)
    rows = docs.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__text"))
    schema = f"__id {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{o} {_SQL[o]}" for o in outputs)
    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id)


def decode(rows: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, decoded) of packed ids; null ids decode to the empty text."""
    file = _file(path)
    key, vocabulary = hashlib.sha256(file).hexdigest(), rows.sparkSession.sparkContext.broadcast(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(key, vocabulary, None)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], names=["__id", "decoded"])

    bounded_batches(rows.sparkSession)
    d = rows.select(F.col(id).alias("__id"), F.col(ids).alias("__ids"))
    return d.mapInArrow(run, f"__id {d.schema[0].dataType.simpleString()}, decoded string").withColumnRenamed("__id", id)
