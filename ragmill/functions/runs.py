"""Runs of words of some items, looked up in texts where they lie."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

#: Odd multipliers.
STEP, LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Numbers(dict):
    """Numbers of words from 1; any other word is 0."""

    def __missing__(self, word: str) -> int:
        return 0


class Runs:
    """The different runs of ``width`` words of items (id, words); of an item of fewer words, where
    ``shorter`` asks for these, all its words are its run. Runs are 64-bit numbers of their words' numbers: an item's word
    has one, a text's other words have none, so that what is held hangs on the items alone."""

    def __init__(self, items: list[tuple[object, list[str]]], width: int, shorter: bool):
        self.number, self.ids, rows = Numbers(), [], []
        for key, words in items:
            if len(words) >= (1 if shorter else width):
                self.ids.append(key)
                rows.append((np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.uint64), min(width, len(words))))
        self.widths = sorted({n for _, n in rows})
        runs = [np.unique(self.runs(x, n)) for x, n in rows]
        self.keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *runs]))
        #: An item's runs, and a run's items, by places.
        self.of = [np.searchsorted(self.keys, r).tolist() for r in runs]
        self.items = defaultdict(list)
        for i, r in enumerate(self.of):
            for k in r:
                self.items[k].append(i)
        #: Items by the run that the fewest items have.
        self.anchored = defaultdict(list)
        for i, r in enumerate(self.of):
            self.anchored[min(r, key=lambda k: len(self.items[k]))].append(i)
        self.bits = max(18, min(26, len(self.keys).bit_length() + 7))
        self.shift = np.uint64(64 - self.bits)

    @staticmethod
    def runs(x: np.ndarray, n: int) -> np.ndarray:
        """Of so many words from each word on, where all have numbers."""
        m = len(x) - n + 1
        if m < 1:
            return np.zeros(0, np.uint64)
        there = x[:m] > 0
        for j in range(1, n):
            there &= x[j : m + j] > 0
        at = np.flatnonzero(there)
        key = np.full(len(at), n, np.uint64)
        for j in range(n):
            key = key * STEP + x[at + j]
        return (key ^ (key >> np.uint64(31))) * LAST

    def found(self, text: str) -> list[int]:
        """Places of the runs that stand in a text, whose words blanks part."""
        if "table" not in self.__dict__:
            self.table = np.zeros(1 << self.bits, bool)
            self.table[self.keys >> self.shift] = True
        words = text.split(" ")
        x = np.fromiter(map(self.number.__getitem__, words), np.uint64, len(words))
        every = [np.zeros(0, np.uint64)]
        for n in self.widths:
            key = self.runs(x, n)
            every.append(key[self.table[key >> self.shift]])
        key = np.unique(np.concatenate(every))
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return at[self.keys[at] == key].tolist() if len(key) else []

    def within(self, text: str) -> list:
        """Ids of the items all of whose runs stand in a text."""
        there = set(self.found(text))
        return list({self.ids[i]: None for k in there for i in self.anchored.get(k, ()) if there.issuperset(self.of[i])})

    def sharing(self, text: str, least: int) -> list[dict]:
        """(id, shared): items that share ``least`` runs with a text, or all their runs if they have fewer."""
        count = defaultdict(int)
        for k in self.found(text):
            for i in self.items[k]:
                count[i] += 1
        return [{"id": self.ids[i], "shared": n} for i, n in count.items() if n >= min(least, len(self.of[i]))]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}
