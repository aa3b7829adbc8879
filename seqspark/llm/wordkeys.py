"""Words of whole texts as 64-bit keys, in numpy over Arrow's buffers: no Python object a word.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return, A-Z in lower case. Its key holds 57 bits of a hash and, in
the low 7, a class by spelling; two words share a key with a chance of about 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CLASS_BITS = 7

#: The key of the end of a text.
END = 0

#: Bytes looked at together; longer texts are cut between words.
PIECE = 1 << 20

#: Longer words are hashed one at a time.
LOOP_BYTES = 48

_BYTES = np.arange(256)
_IN_WORD = ~np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_MARK = np.isin(_BYTES, [b for b in range(33, 127) if not chr(b).isalnum()])
_KIND = np.full(256, 3, np.int64)
_KIND[[0, ord(","), ord(".")]] = 0, 1, 2
_MUL, _MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _hash(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    order = np.argsort((65535 - np.minimum(size, 65535)).astype(np.uint16), kind="stable")  # long words first
    s, n = start[order], size[order]
    top = int(min(n[0], LOOP_BYTES)) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(top), side="left")  # words longer than j
    h = np.full(len(n), _MUL2)
    for j in range(top):
        k = live[j]
        x = h[:k]
        x ^= low[s[:k] + j]
        x *= _MUL
        x ^= x >> _S
    for i in range(np.searchsorted(-n, -LOOP_BYTES, side="left")):
        h[i] = int.from_bytes(hashlib.blake2b(low[s[i] : s[i] + n[i]].tobytes(), digest_size=8).digest(), "little")
    h ^= n.astype(np.uint64)
    h *= _MUL2
    h ^= h >> _S
    h *= _MUL
    out = np.empty_like(h)
    out[order] = h
    return out


def _spelling(low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Classes: by the last two bytes before the marks at a word's end, and the first of the marks."""
    end = stop.copy()
    i = np.flatnonzero(_MARK[low[end - 1]])
    while len(i):
        end[i] -= 1
        i = i[end[i] > start[i]]
        i = i[_MARK[low[end[i] - 1]]]
    bare = end == start  # marks alone
    kind = np.where(end < stop, _KIND[low[np.minimum(end, len(low) - 1)]], 0)
    a = low[np.where(bare, start, end - 1)].astype(np.uint32)
    b = np.where(end - start > 1, low[np.maximum(end - 2, 0)], 0).astype(np.uint32)
    mixed = ((a | b << np.uint32(8)) + np.uint32(1)) * np.uint32(0x9E3779B1)
    return kind * 32 + (mixed >> np.uint32(27))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the words of texts side by side, how many words begin before each offset)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = _IN_WORD[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = at[1:] > at[:-1]
    first, last = at[:-1][full], at[1:][full] - 1
    begin[first], end[last] = inside[first], inside[last]  # nothing parts neighbouring texts
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    low = _LOWER[data]
    key = _hash(low, start, stop - start)
    key &= ~np.uint64((1 << CLASS_BITS) - 1)
    key |= _spelling(low, start, stop).astype(np.uint64)
    return key.view(np.int64), np.searchsorted(start, at)


def _long(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end at a space."""
    at = 0
    while at < len(data):
        cut = min(at + PIECE, len(data))
        while cut < len(data) and _IN_WORD[data[cut]]:
            space = np.flatnonzero(~_IN_WORD[data[cut : cut + 4096]])
            cut = cut + int(space[0]) if len(space) else min(cut + 4096, len(data))
        yield data[at:cut]
        at = cut


def tokens(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a batch, some at a time: (first row, one past the last, keys of all their
    tokens, where each row's tokens begin and one past the last). Words, then END in each row."""
    data, at = buffers(batch.column(text))
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
        j = min(j, n, i + 4096)
        own = data[at[i] : at[j]]
        if j == i + 1 and len(own) > PIECE:
            parts = [words(p, np.array([0, len(p)]))[0] for p in _long(own)]
            keys = np.concatenate([*parts, [END]])
            yield i, j, keys, np.array([0, len(keys)])
        else:
            found, before = words(own, at[i : j + 1] - at[i])
            first = before + np.arange(j - i + 1)
            keys = np.full(len(found) + j - i, END, np.int64)
            keys[np.arange(len(found)) + np.repeat(np.arange(j - i), np.diff(before))] = found
            yield i, j, keys, first
        i = j


class Counts:
    """Counts by key; no more than `limit` keys are held."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.held, self.size = limit, [], 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.held.append(np.unique(keys, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size > self.limit:
            k, c = self._merged()
            if len(k) > self.limit // 2:
                yield k, c
                self.held, self.size = [], 0
            else:
                self.held, self.size = [(k, c)], len(k)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            yield self._merged()

    def _merged(self):
        k, c = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(k)
        k, c = k[order], c[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        return k[first], np.add.reduceat(c, first)


class Table:
    """Places of keys in an array of distinct ones, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.view(np.uint64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), (self.keys >> self.shift).astype(np.int64)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        x = keys.view(np.uint64)
        if not len(self.keys):
            return np.full(len(x), -1, np.int32)
        at = (x >> self.shift).astype(np.int64)
        out = self.slots[at]
        i = np.flatnonzero((out >= 0) & (self.keys[out] != x))
        while len(i):
            at[i] = (at[i] + 1) & self.mask
            out[i] = self.slots[at[i]]
            i = i[(out[i] >= 0) & (self.keys[out[i]] != x[i])]
        return out
