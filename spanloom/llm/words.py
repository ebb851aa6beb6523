"""Vectorised word splitting for BPE, and a table of words that were encoded before.

The two public splitting patterns that are handled here differ in a few points only (``Split``). Rows of
ASCII and Latin-1 letters are split by array operations over their bytes; any other row is the caller's
to split with the library.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import U64, ranges_equal, ranges_hash

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
KIND[48:58] = DIGIT


def plain_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows whose bytes are all ASCII (but 0x1C-0x1F) or two-byte letters from U+00C0 to U+00FF."""
    bad = (data >= 0x1C) & (data < 0x20)
    high = data >= 0x80
    if high.any():
        lead = data == 0xC3
        after = np.zeros(len(data), bool)
        after[1:] = lead[:-1]
        bad |= high & ~lead & ~after
        bad |= after & ((data == 0x97) | (data == 0xB7))
    run = np.concatenate([[0], np.cumsum(bad)])
    return run[offsets[1:]] == run[offsets[:-1]]


def split(data: np.ndarray, offsets: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows.

    ``keep_space``: one space belongs to the word after it, other white space is words of its own, and digits
    go together; otherwise white space is dropped and each digit is a word. Either way an apostrophe that
    opens a word takes one of s, t, m, d, re, ve, ll with it.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = KIND[data]
    row = np.zeros(n + 1, bool)
    row[offsets[:-1]] = row[n] = True  # where a row begins
    edge = row[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    start = edge.copy()
    last = np.zeros(n, bool)
    if keep_space:
        blank = data == 32
        start[1:] &= space[1:] | row[1:n] | ~blank[:-1]
        last[:-1] = space[:-1] & ~space[1:] & ~row[1:n]
        start |= last
    else:
        start &= ~space
        start |= kind == DIGIT
    mark = np.flatnonzero(data == 39)
    if len(mark):
        ok = row[mark] | ((kind[mark - 1] != OTHER) & ((data[mark - 1] != 32) if keep_space else True))
        wide = np.concatenate([data, np.zeros(3, np.uint8)])
        inside = lambda k: ~row[np.minimum(mark + k, n)]  # noqa: E731  the next k bytes are in the row
        one = inside(1) & np.isin(wide[mark + 1], np.frombuffer(b"stmd", np.uint8))
        a, b = wide[mark + 1], wide[mark + 2]
        two = inside(1) & inside(2) & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        ok &= one | two
        at, size = mark[ok], np.where(one[ok], 2, 3)
        start[at] = True
        start[at + 1] = False
        after = at + size
        after = after[(after < n)]
        start[after[kind[after] == LETTER]] = True
    starts = np.flatnonzero(start)
    if keep_space:
        return starts, np.append(starts[1:], n)
    # a word ends where the next begins, or where white space or the next row does
    stop = np.flatnonzero(start | (space & edge) | row[:n])
    stop = np.append(stop, n)
    return starts, stop[np.searchsorted(stop, starts, side="right")]


class WordTable:
    """ids of words, filled from ``encode`` (words to id lists) as words turn up.

    Words are found by their 64-bit hash and then compared byte by byte; where two words of a batch or of the
    table share a hash, the batch is encoded without the table. Bounded: beyond ``most`` words or ``most_bytes``
    bytes of words it starts anew.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 1_500_000, most_bytes: int = 64 << 20):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.size = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.text_at, self.text_size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.text, self.text_used = np.empty(1 << 18, np.uint8), 0

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and how many each word has."""
        if not len(starts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.keys) > self.most or self.text_used > self.most_bytes:
            self.clear()
        keys, where, inv = np.unique(ranges_hash(data, starts, ends), return_index=True, return_inverse=True)
        a, b = starts[where], ends[where]
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        there = at < len(self.keys)
        known[there] = self.keys[at[there]] == keys[there]
        old = at[known]
        if not (ranges_equal(data, starts, ends, data, a[inv], b[inv]).all() and ranges_equal(data, a[known], b[known], self.text[: self.text_used], self.text_at[old], self.text_at[old] + self.text_size[old]).all()):
            raw = data.tobytes()
            ids, size = self.encode([raw[x:y] for x, y in zip(starts.tolist(), ends.tolist())])
            return ids, size.astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            words = [raw[x:y] for x, y in zip(a[new].tolist(), b[new].tolist())]
            ids, size = self.encode(words)
            self.ids, first = self._append(self.ids, self.used, ids, size)
            self.used += len(ids)
            length = b[new] - a[new]
            self.text, text_at = self._append(self.text, self.text_used, np.frombuffer(b"".join(words), np.uint8), length)
            self.text_used += int(length.sum())
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.first = np.insert(self.first, at[new], first)
            self.size = np.insert(self.size, at[new], size)
            self.text_at = np.insert(self.text_at, at[new], text_at)
            self.text_size = np.insert(self.text_size, at[new], length)
            at = np.searchsorted(self.keys, keys)
        first, size = self.first[at][inv], self.size[at][inv].astype(np.int64)
        total = np.cumsum(size)
        pos = np.arange(total[-1]) + np.repeat(first - (total - size), size)
        return self.ids[pos], size

    @staticmethod
    def _append(store: np.ndarray, used: int, more: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The store with ``more`` written at ``used``, grown where needed, and where each of its parts begins."""
        if used + len(more) > len(store):
            store = np.concatenate([store, np.empty(max(len(store), len(more)), store.dtype)])
        store[used : used + len(more)] = more
        return store, used + np.cumsum(size, dtype=np.int64) - size
