"""Units of text that an encoder has met before, and their ids, in flat numpy arrays.

A unit is known by a 64-bit hash; whole arrays of units are looked up at once. A few dozen bytes a unit make room for
millions of them in a worker. A pool that is full starts anew, so its size is bounded and its results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Table:
    """Numbers by 64-bit keys other than 0: open addressing, looked up and filled by whole arrays."""

    def __init__(self, bits: int = 16):
        self.keys, self.values, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, keys: np.ndarray, missing: int = -1) -> np.ndarray:
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(missing))
        rows = np.flatnonzero((held != keys) & (held != 0))
        while len(rows):
            at[rows] = (at[rows] + 1) & mask
            held = self.keys[at[rows]]
            hit = held == keys[rows]
            out[rows[hit]] = self.values[at[rows[hit]]]
            rows = rows[~hit & (held != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table does not have."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            used = self.keys != 0
            old = self.keys[used], self.values[used]
            self.__init__(int(4 * (self.n + len(keys))).bit_length())
            self.add(*old)
        self.n += len(keys)
        mask = len(self.keys) - 1
        at, rows = (keys & np.uint64(mask)).astype(np.int64), np.arange(len(keys))
        while len(rows):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[rows[free]]  # of several the last one wins, the others go on
            won = self.keys[at] == keys[rows]
            self.values[at[won]] = values[rows[won]]
            rows, at = rows[~won], (at[~won] + 1) & mask


class Pool:
    """Ids of units by key; at most about `most` units, and four times as many ids."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.table, self.n, self.used = Table(), 0, 0
        self.starts, self.counts, self.values = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)

    def keep(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Numbers of new entries with these ids, end to end."""
        for name, n, more in (("starts", self.n, len(counts)), ("counts", self.n, len(counts)), ("values", self.used, len(ids))):
            if n + more > len(old := getattr(self, name)):
                grown = np.zeros(max(n + more, 3 * len(old) // 2), old.dtype)
                grown[:n] = old[:n]
                setattr(self, name, grown)
        self.starts[self.n : self.n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.counts[self.n : self.n + len(counts)] = counts
        self.values[self.used : self.used + len(ids)] = ids
        entries = np.arange(self.n, self.n + len(counts), dtype=np.int32)
        self.n, self.used = self.n + len(counts), self.used + len(ids)
        return entries

    def ids(self, keys: np.ndarray, odd: np.ndarray, make: Callable[[np.ndarray], np.ndarray], once: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units end to end, and n + 1 offsets.

        make: entries of new units (one of each key), by their places; once: of the units at the places `odd`, whose keys do not count.
        """
        if self.n > self.most or self.used > 4 * self.most:
            self.forget()
        entries = self.table.find(keys)
        usual = np.ones(len(keys), bool)
        usual[odd] = False
        new = np.flatnonzero((entries < 0) & usual)
        if len(new):
            _, at = np.unique(keys[new], return_index=True)
            self.table.add(keys[new[at]], make(new[at]))
            entries[new] = self.table.find(keys[new])
        if len(odd):
            entries[odd] = once(odd)
        counts = self.counts[entries].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(total[-1])
        at += np.repeat(self.starts[entries] - total[:-1], counts)
        return self.values[at], total
