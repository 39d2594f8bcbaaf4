"""BM25 over Arrow batches: words are counted by document, and a task hands on only its best documents of each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.products import HALF, merged, rounded

#: Scores of (document, query) that a task holds at once, words it remembers, and documents it takes at once.
SCORES, WORDS, DOCUMENTS = 100_000, 200_000, 1000

Counted = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _counted(batches: Iterator[pa.RecordBatch], terms: list[str], analyzed: Callable[[str], str | None]) -> Iterator[Counted]:
    """(ids, lengths, documents, terms, counts) of batches (id, w): the words of each document, and how often it has which of the terms."""
    place = {t: i for i, t in enumerate(terms)}
    code: dict[str | None, int] = {}
    for whole in batches:
        for i in range(0, whole.num_rows, DOCUMENTS):
            b = whole.slice(i, DOCUMENTS)
            w = b.column(1)
            size = pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False)
            words = w.flatten().dictionary_encode()
            if len(code) > WORDS:
                code.clear()
            codes = []
            for word in words.dictionary.to_pylist():
                if (c := code.get(word)) is None:
                    term = analyzed(word) if word else None
                    c = code[word] = -2 if term is None else place.get(term, -1)
                codes.append(c)
            found = np.array([*codes, -2], np.int64)[pc.fill_null(words.indices, len(codes)).to_numpy(zero_copy_only=False)]
            doc = np.repeat(np.arange(len(size)), size)
            length = np.bincount(doc[found > -2], minlength=len(size))
            doc, found = doc[found >= 0], found[found >= 0]
            key, tf = np.unique(doc * len(terms) + found, return_counts=True)
            yield b.column(0), length, key // max(1, len(terms)), key % max(1, len(terms)), tf


def statistics(split: DataFrame, terms: list[str], analyzed: Callable[[str], str | None]) -> tuple[int, int, np.ndarray]:
    """(documents that have words, their words, documents that have each term) of (id, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 2, np.int64)
        for _, length, _, term, _ in _counted(batches, terms, analyzed):
            total += np.concatenate([np.bincount(term, minlength=len(terms)), [np.count_nonzero(length), length.sum()]])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    total = np.zeros(len(terms) + 2, np.int64)
    found = split.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return int(total[-2]), int(total[-1]), total[:-2]


def best(split: DataFrame, asked: pa.Table, kind: str, terms: list[str], idf: np.ndarray, mean: float, k: int, k1: float, b: float, analyzed: Callable[[str], str | None]) -> DataFrame:
    """(query_id, id, score): the k best documents of each query among those of each task; ``asked`` is (query_id, term), each once, with ids of Spark's type ``kind``."""
    query = asked.combine_chunks().column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    place = {t: i for i, t in enumerate(terms)}
    term = np.array([place[t] for t in asked.column("term").to_pylist()], np.int64)
    order = np.argsort(term, kind="stable")
    asks = query.indices.to_numpy()[order].astype(np.int64)
    many = np.bincount(term, minlength=len(terms))
    sent = split.sparkSession.sparkContext.broadcast((query.dictionary, asks, many, terms, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, asks, many, terms, idf = sent.value
        n, first = len(named), np.cumsum(many) - many
        at_once = max(1, SCORES // max(1, n))
        found, kth = None, np.full(n, -np.inf)
        type = None
        for ids, length, doc, term, tf in _counted(batches, terms, analyzed):
            type = ids.type
            id = ids.to_numpy(zero_copy_only=False).astype(np.int64) if pa.types.is_integer(type) else np.array(ids.to_pylist(), str)
            weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
            for i in range(0, len(ids), at_once):
                lo, hi = np.searchsorted(doc, (i, i + at_once))
                times = many[term[lo:hi]]
                each = np.repeat(np.arange(lo, hi), times)
                q = asks[first[term[each]] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]
                score = np.bincount(q * at_once + doc[each] - i, weight[each], minlength=n * at_once).reshape(n, at_once)
                r, c = np.nonzero((score > 0) & (score >= (kth - 2 * HALF)[:, None]))
                if r.size:
                    found = merged(found, (r, rounded(score[r, c]), id[i + c]), k, kth)
        if found:
            row, score, id = found
            yield pa.RecordBatch.from_arrays([named.take(pa.array(row)), pa.array(id.tolist(), type), pa.array(score)], ["query_id", "id", "score"])

    return split.mapInArrow(run, f"query_id {kind}, id {split.schema['id'].dataType.simpleString()}, score double")
