"""A minimal acyclic transducer: words to lists of ids, in one memory-mapped file.

The automaton is built from sorted words by Daciuk's incremental method, so
equal suffixes share their states. Each edge carries the number of words that
come before those behind it; their sum along a word is its rank, which picks
its ids from one array.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import struct
import tempfile

import numpy as np


class _State:
    __slots__ = ("edges", "final", "number", "words")

    def __init__(self):
        self.edges: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.words = 0

    def key(self):
        return self.final, tuple((c, id(s)) for c, s in self.edges.items())


def build(entries: dict[bytes, list[int]]) -> bytes:
    """The file's bytes for words and their ids."""
    root, register, path, last = _State(), {}, [], b""

    def close(depth: int) -> None:
        while len(path) > depth:
            parent, label, child = path.pop()
            parent.edges[label] = register.setdefault(child.key(), child)

    words = sorted(entries)
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same)
        state = path[-1][2] if path else root
        for c in word[same:]:
            child = _State()
            state.edges[c] = child
            path.append((state, c, child))
            state = child
        state.final, last = True, word
    close(0)

    order: list[_State] = []
    stack = [(root, False)]
    while stack:  # children before parents
        state, done = stack.pop()
        if done:
            state.words = state.final + sum(s.words for s in state.edges.values())
            order.append(state)
        elif state.number == -1:
            state.number = -2
            stack.append((state, True))
            stack.extend((s, False) for s in state.edges.values() if s.number == -1)
    order.reverse()  # the root is state 0
    for i, state in enumerate(order):
        state.number = i
    first, labels, targets, before, final = [0], bytearray(), [], [], bytearray()
    for state in order:
        seen = int(state.final)
        for c, s in sorted(state.edges.items()):
            labels.append(c)
            targets.append(s.number)
            before.append(seen)
            seen += s.words
        first.append(len(labels))
        final.append(state.final)
    starts, ids = [0], []
    for word in words:
        ids.extend(entries[word])
        starts.append(len(ids))
    head = struct.pack("<4I", len(order), len(labels), len(words), len(ids))
    arrays = [np.asarray(x, "<u4").tobytes() for x in (first, targets, before, starts, ids)]
    return head + b"".join(arrays) + bytes(labels) + bytes(final)


class Places:
    """Where keys stand in an array of different integers of 0 or more: a hash table that all keys asked for probe side by side."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._places = np.full(1 << bits, -1), np.full(1 << bits, -1, np.int32)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self._keys[at] < 0
            self._keys[at[free]] = keys[left[free]]  # of those that meet one stays
            own = self._keys[at] == keys[left]
            self._places[at[own]] = left[own]
            at, left = at[~own] + 1 & self._mask, left[~own]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those not in it."""
        at = self._slots(keys)
        held = self._keys[at]
        hit = held == keys
        found = np.where(hit, self._places[at], -1)
        on = np.flatnonzero(~hit & (held >= 0))
        at = at[on]
        while len(on):
            at = at + 1 & self._mask
            held = self._keys[at]
            hit = held == keys[on]
            found[on[hit]] = self._places[at[hit]]
            more = ~hit & (held >= 0)
            on, at = on[more], at[more]
        return found


class Lexicon:
    """Lookups in a file made by ``build``."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, edges, words, ids = struct.unpack_from("<4I", self._map, 0)
        at, parts = 16, []
        for n in (states + 1, edges, edges, words + 1, ids):
            parts.append(memoryview(self._map)[at : at + 4 * n].cast("I"))
            at += 4 * n
        self._first, self._targets, self._before, self._starts, self._ids = parts
        self._labels, self._final = at, at + edges
        self.states, self.words = states, words
        # The same memory as arrays; of each edge its state and label as one key in a table, which is the one copy made.
        firsts, labels = np.frombuffer(self._first, np.uint32), np.frombuffer(self._map, np.uint8, edges, at)
        self._edges = Places(np.repeat(np.arange(states), np.diff(firsts.astype(np.int64))) * 256 + labels)
        self._nexts, self._befores = np.frombuffer(self._targets, np.uint32), np.frombuffer(self._before, np.uint32)
        self._ends = np.frombuffer(self._map, np.uint8, states, self._final).astype(bool)

    def get_all(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of each word as little-endian 32-bit integers, None for those not in it. All words take a step at a time."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        state, rank = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        on = np.flatnonzero(lengths > 0)
        for step in range(int(lengths.max())):
            key = state[on] * 256 + data[starts[on] + step]
            at = self._edges.find(key)
            hit = at >= 0
            state[on[~hit]] = -1
            on, at = on[hit], at[hit]
            rank[on] += self._befores[at]
            state[on] = self._nexts[at]
            on = on[lengths[on] > step + 1]
            if not len(on):
                break
        state[(state >= 0) & ~self._ends[state]] = -1
        ids, first = self._ids, self._starts
        return [ids[first[r] : first[r + 1]].tobytes() if s >= 0 else None for s, r in zip(state.tolist(), rank.tolist(), strict=True)]

    def get(self, word: bytes) -> list[int] | None:
        state, rank, find, base, first = 0, 0, self._map.find, self._labels, self._first
        for i in range(len(word)):
            at = find(word[i : i + 1], base + first[state], base + first[state + 1])
            if at < 0:
                return None
            rank += self._before[at - base]
            state = self._targets[at - base]
        if not self._map[self._final + state]:
            return None
        return self._ids[self._starts[rank] : self._starts[rank + 1]].tolist()


def opened(data: bytes) -> Lexicon:
    """A lexicon mapped from a file of this machine, shared by its processes."""
    path = os.path.join(tempfile.gettempdir(), f"quern-lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin")
    if not os.path.exists(path):
        handle, part = tempfile.mkstemp(dir=tempfile.gettempdir())
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(part, path)
    return Lexicon(path)
