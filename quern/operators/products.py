"""Scores of all pairs of queries and items, by products of blocks in Arrow batches.

A product of two blocks only picks the pairs that matter. What is ranked or
compared is summed again in the order of ``vectors.dot`` and rounded as
``F.round`` does, so results do not hang on how a library adds.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items and queries of a product; a task holds this many products of them at once.
ITEMS, ASKED = 4096, 512
#: Half of the last place that scores are rounded to.
HALF = 0.5e-6
_EXACT = decimal.Context(prec=400, rounding=decimal.ROUND_HALF_UP)


def rounded(x: np.ndarray) -> np.ndarray:
    """Six places, half away from zero, of a number's shortest decimal form."""
    with np.errstate(invalid="ignore"):
        a = np.abs(x) * 1e6
        below = np.floor(a)
        near = ~(np.abs(a - below - 0.5) > 1e-6 + a * 1e-15)
    out = np.copysign(np.floor(a + 0.5), x) / 1e6 + 0.0
    if near.any():
        values, at = np.unique(x[near], return_inverse=True)
        out[near] = np.array([float(decimal.Decimal(repr(v)).quantize(decimal.Decimal("1e-6"), context=_EXACT)) + 0.0 if np.isfinite(v) else v for v in values.tolist()])[at]
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), str)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length; vectors that are null or have nulls are left out."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    good = size >= 0
    if flat.null_count:
        lost = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        good &= lost[start + np.maximum(size, 0)] == lost[start]
    for d in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == d))
        yield rows, x[start[rows, None] + np.arange(d)]


class _Side:
    """Vectors of one length with their ids, codes of types, and norms; ``odd`` ones have no finite norm."""

    def __init__(self, x: np.ndarray, **columns: np.ndarray):
        self.x, self.columns = np.ascontiguousarray(x), columns
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.odd = ~np.isfinite(self.norm)

    def __len__(self) -> int:
        return len(self.x)

    def __getattr__(self, name: str) -> np.ndarray:
        if name in ("columns", "x"):
            raise AttributeError(name)
        return self.columns[name]

    def at(self, rows) -> _Side:
        return _Side(self.x[rows], **{k: v[rows] for k, v in self.columns.items()})


def _product(asked: _Side, items: _Side) -> tuple[np.ndarray, np.ndarray]:
    """All scores but for rounding errors, and a bound of these for each query. Not a number: to be summed anew. Least: an item that is the query."""
    s = asked.x @ items.x.T
    if items.odd.any():
        s[:, items.odd] = np.nan
    if asked.odd.any():
        s[asked.odd] = np.nan
    own = np.flatnonzero(np.isin(items.id, asked.own))
    if own.size:
        r, c = np.nonzero(asked.own[:, None] == items.id[own][None, :])
        s[r, own[c]] = -np.inf
    most = items.norm[~items.odd].max(initial=0.0)
    return s, np.where(asked.odd, 0.0, asked.norm) * most * (items.x.shape[1] + 1) * 1e-15


def _scores(asked: _Side, items: _Side, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    q, v = np.ascontiguousarray(asked.x.T), np.ascontiguousarray(items.x.T)
    out = np.zeros(len(r))
    for a, b in zip(q, v, strict=True):
        out += a[r] * b[c]
    return rounded(out)


def merged(found: tuple | None, new: tuple, k: int, kth: np.ndarray) -> tuple:
    """The k best of each row of (row, score, id, ...): by score, not a number first, then by id. ``kth`` gets the last score of rows that have k."""
    parts = tuple(np.concatenate(x) for x in zip(found, new, strict=True)) if found else new
    row, score, id = parts[:3]
    order = np.lexsort((id, -score, ~np.isnan(score), row))
    row, score = row[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    last = place == k - 1
    kth[row[last]] = np.where(np.isnan(score[last]), np.inf, score[last])
    return tuple(x[order[place < k]] for x in parts)


class _Best:
    """The k best items of some queries so far: by score, not a number first, then by id."""

    def __init__(self, asked: _Side, k: int):
        self.asked, self.k = asked, k
        self.found, self.kth = None, np.full(len(asked), -np.inf)

    def add(self, items: _Side) -> None:
        k, n = self.k, len(items)
        s, error = _product(self.asked, items)
        least = self.kth - HALF - error
        keep = ~(s < least[:, None])
        if n > k and np.count_nonzero(keep) > 4 * k * len(s):
            kth = np.partition(s, n - k, axis=1)[:, n - k]
            least = np.where(np.isnan(kth), least, np.maximum(least, kth - 2 * HALF - 2 * error))
            keep = ~(s < least[:, None])
        r, c = np.nonzero(keep)
        other = self.asked.own[r] != items.id[c]
        r, c = r[other], c[other]
        if not r.size:
            return
        self.found = merged(self.found, (r, _scores(self.asked, items, r, c), items.id[c], items.type[c]), k, self.kth)


def _blocks(batches: Iterator[pa.RecordBatch], types: list, split: bool) -> Iterator[tuple[int, int | None, _Side]]:
    """(length, code of type or None, items) of at most ``ITEMS``, full ones where a task's rows are that many."""
    held: dict[tuple, list[_Side]] = {}
    code = {t: i for i, t in enumerate(types)}
    count = 0

    def emptied() -> Iterator[tuple[int, int | None, _Side]]:
        for (d, t), parts in held.items():
            whole = _Side(np.concatenate([p.x for p in parts]), **{k: np.concatenate([p.columns[k] for p in parts]) for k in parts[0].columns})
            for i in range(0, len(whole), ITEMS):
                yield d, t, whole.at(slice(i, i + ITEMS))
        held.clear()

    for whole in batches:
        for i in range(0, whole.num_rows, ITEMS):
            b = whole.slice(i, ITEMS)
            b = b.filter(b.column("item_id").is_valid())
            e = b.column("type").dictionary_encode()
            for t in e.dictionary.to_pylist():
                if t not in code:
                    code[t] = len(types)
                    types.append(t)
            known = np.array([code[t] for t in e.dictionary.to_pylist()] + [-1], np.int64)
            kind = known[pc.fill_null(e.indices, len(known) - 1).to_numpy(zero_copy_only=False)]
            ids = _ids(b.column("item_id"))
            for rows, x in _matrices(b.column("vec")):
                side = _Side(x, id=ids[rows], type=kind[rows])
                for t in np.unique(side.type).tolist() if split else [None]:
                    held.setdefault((x.shape[1], t), []).append(side if t is None else side.at(side.type == t))
                count += len(rows)
            if count >= 2 * ITEMS:
                yield from emptied()
                count = 0
    yield from emptied()


def collected(queries: DataFrame, most: int) -> pa.Table:
    """The queries, which every task gets; more than ``most`` are refused."""
    found = queries.limit(most + 1).toArrow().combine_chunks()
    if found.num_rows > most:
        raise ValueError("too many queries for one pass; search in blocks")
    return found


def _column(found: pa.Table, name: str) -> pa.Array:
    c = found.column(name)
    return c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)


def _asked(found: pa.Table) -> Iterator[_Side]:
    """The queries of each length; ``own`` is the item that a query is, ``row`` its place."""
    id = _column(found, "query_id")
    own = _ids(pc.fill_null(id, -1 if pa.types.is_integer(id.type) else "-1"))
    for rows, x in _matrices(_column(found, "qvec")):
        yield _Side(x, own=own[rows], row=rows)


def _over(queries: DataFrame, items: DataFrame, most: int, schema: str, work: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[list]]) -> DataFrame:
    """Rows that ``work`` gives, as lists of columns, for the queries and the batches of items that come to a task."""
    sent = items.sparkSession.sparkContext.broadcast(collected(queries, most))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for columns in work(sent.value, batches):
                yield pa.RecordBatch.from_arrays(columns, names)

    return items.select("item_id", "type", "vec").mapInArrow(run, schema)


def best(queries: DataFrame, items: DataFrame, k: int, most: int, each_type: bool = False, same_type: bool = False) -> DataFrame:
    """(query_id, item_id, type, score): the k best items of each query among those of each task; ``each_type``: k of each type."""
    kind = {c: items.schema[c].dataType.simpleString() for c in ("item_id", "type")}
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {kind['item_id']}, type {kind['type']}, score double"

    def work(found: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        first = next(batches, None)
        if first is None:
            return
        sides = {s.x.shape[1]: s for s in _asked(found)}
        of = np.array(_column(found, "qtype").to_pylist(), object) if same_type else None
        types: list = []
        tops: dict[tuple, list[_Best]] = {}
        for d, t, block in _blocks(chain([first], batches), types, each_type or same_type):
            if d not in sides or same_type and t < 0:
                continue
            if (d, t) not in tops:
                own = sides[d].at(of[sides[d].row] == types[t]) if same_type else sides[d]
                tops[d, t] = [_Best(own.at(slice(i, i + ASKED)), k) for i in range(0, len(own), ASKED)]
            for top in tops[d, t]:
                top.add(block)
        for top in (x for each in tops.values() for x in each if x.found):
            row, score, id, type = top.found
            named = [types[i] if i >= 0 else None for i in type.tolist()]
            yield [_column(found, "query_id").take(pa.array(top.asked.row[row])), pa.array(id.tolist(), first.schema.field("item_id").type), pa.array(named, first.schema.field("type").type), pa.array(score)]

    return _over(queries.select("query_id", "qvec", *["qtype"] * same_type), items, most, schema, work)


def ahead(queries: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """(query_id, ahead): how many items of a task score more than ``t`` of queries (query_id, qvec, t); the query itself does not count."""

    def work(found: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        total = np.zeros(found.num_rows, np.int64)
        limit = pc.fill_null(_column(found, "t"), np.nan).to_numpy(zero_copy_only=False)
        sides: dict[int, list[_Side]] = {}
        for s in _asked(found):
            some = s.at(~np.isnan(limit[s.row]))
            sides[s.x.shape[1]] = [some.at(slice(i, i + ASKED)) for i in range(0, len(some), ASKED)]
        for d, _, block in _blocks(batches, [], False):
            for asked in sides.get(d, []):
                s, error = _product(asked, block)
                t = limit[asked.row]
                sure = s > (t + HALF + error)[:, None]
                count, near = np.count_nonzero(sure, axis=1), ~(s < (t + HALF - error)[:, None])
                if near.sum() > count.sum():
                    r, c = np.nonzero(near & ~sure)
                    x = _scores(asked, block, r, c)
                    more = ((x > t[r]) | np.isnan(x)) & (asked.own[r] != block.id[c])
                    count += np.bincount(r[more], minlength=len(count))
                np.add.at(total, asked.row, count)
        yield [_column(found, "query_id"), pa.array(total)]

    return _over(queries.select("query_id", "qvec", "t"), items, most, f"query_id {queries.schema['query_id'].dataType.simpleString()}, ahead bigint", work)
