"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many short texts.

Round j inserts, for every text of at least j symbols, the suffix of length j: its place follows from
the place of the shorter suffix by counting equal symbols before it. The transform, with the lengths of
the common prefixes beside it, lies in a pair of external files; each round reads one from front to back
and writes the other. The symbols themselves are laid down once in a file with one column per
round. Memory holds one column and the arrays that the round's counts need.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np

END = 0  # smaller than any symbol; one for each text
ENTRY = np.dtype([("symbol", np.uint8), ("prefix", np.uint8)])


class Collection:
    """Texts as byte strings, indexed by `build`; common prefixes are counted up to `cap`."""

    def __init__(self, texts: list[bytes], cap: int):
        assert cap < 256
        self.cap = cap
        self.order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        self.texts = [texts[i] for i in self.order]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)

    def _columns(self, folder: Path) -> np.memmap:
        """columns[j, i] is the symbol before the suffix of length j of text i, or END."""
        used = np.zeros(256, bool)
        for text in self.texts:
            used[np.frombuffer(text, np.uint8)] = True
        if used.all():
            raise ValueError("a collection may use at most 255 different bytes")
        code = np.zeros(256, np.uint8)
        code[used] = np.arange(1, used.sum() + 1)
        rounds = int(self.lengths.max()) + 1
        columns = np.memmap(folder / "columns", np.uint8, "w+", shape=(rounds, len(self.texts)))
        for i, text in enumerate(self.texts):
            columns[: len(text), i] = code[np.frombuffer(text, np.uint8)[::-1]]
        return columns

    def build(self, folder: str) -> tuple[np.ndarray, np.ndarray]:
        """The transform and, before each suffix, the length of its common prefix with the one before."""
        place = Path(folder)
        columns = self._columns(place)
        n, total = len(self.texts), int(self.lengths.sum()) + len(self.texts)
        pair = [np.memmap(place / f"index{k}", ENTRY, "w+", shape=(total + 1,)) for k in (0, 1)]
        symbols, at = np.array(columns[0]), np.arange(n)
        pair[0][:n]["symbol"] = symbols
        self.counts = np.bincount(symbols, minlength=256)
        for j in range(1, len(columns)):
            active = int(np.searchsorted(-self.lengths, -j, "right"))
            old, new = np.asarray(pair[(j + 1) % 2][: n + 1]), np.asarray(pair[j % 2])
            at, before, after = self._places(old, at[:active], symbols[:active])
            symbols, n = np.array(columns[j, :active]), n + active
            self.counts += np.bincount(symbols, minlength=256)
            stays = np.ones(n, bool)
            stays[at] = False
            new.view(np.uint16)[:n][stays] = old.view(np.uint16)[:-1]
            follows = after > 0
            new["prefix"][at[follows] + 1] = after[follows]
            new["prefix"][at] = before
            new["symbol"][at] = symbols
            new[n] = 0
        last = pair[(len(columns) - 1) % 2]
        return np.array(last["symbol"][:n]), np.array(last["prefix"][: n + 1])

    def _places(self, index, at, symbols):
        """Where the suffixes that begin with `symbols` go, and their common prefixes with both neighbours.

        The neighbours of the new suffix stem from the nearest equal symbols before and after; the
        common prefix is one more than the least on the way there.
        """
        ranks = np.argsort(index["symbol"][:-1], kind="stable")
        ends = np.cumsum(self.counts)
        starts = ends - self.counts
        rank = np.empty(len(at), np.int64)
        by_symbol = np.argsort(symbols, kind="stable")
        for own in np.split(by_symbol, np.flatnonzero(np.diff(symbols[by_symbol])) + 1):
            symbol = symbols[own[0]]
            rank[own] = starts[symbol] + np.searchsorted(ranks[starts[symbol] : ends[symbol]], at[own])
        # The suffixes that consist of END come first, and no suffix begins with the ENDs in the transform.
        spot = rank - starts[1] + len(self.texts)
        first, last = rank == starts[symbols], rank == ends[symbols] - 1
        edges = np.empty((len(at), 3), np.int64)
        edges[:, 0] = np.where(first, at, ranks[np.maximum(rank - 1, 0)])
        edges[:, 1] = at
        edges[:, 2] = np.where(last, at, ranks[np.minimum(rank + 1, len(ranks) - 1)])
        turn = np.argsort(at)  # from front to back, or else the stretches between the wanted ones are long
        least = np.empty(edges.shape, np.uint8)
        least[turn] = np.minimum.reduceat(np.ascontiguousarray(index["prefix"]), edges[turn].reshape(-1) + 1).reshape(-1, 3)
        least = np.minimum(least, self.cap - 1) + np.uint8(1)
        return spot, np.where(first, 0, least[:, 0]), np.where(last, 0, least[:, 1])

    def repeats(self) -> list[np.ndarray]:
        """For each text, in the order given: whether each string of `cap` symbols also starts elsewhere."""
        with tempfile.TemporaryDirectory() as folder:
            bwt, lcp = self.build(folder)
            twice = (lcp[:-1] >= self.cap) | (lcp[1:] >= self.cap)
            ranks = np.argsort(bwt, kind="stable")
            step = np.empty(len(ranks), np.int64)
            ends = int(np.searchsorted(bwt[ranks], 1))
            step[ranks[ends:]] = np.arange(len(ranks) - ends) + len(self.texts)
            found = [np.zeros(max(0, n - self.cap + 1), bool) for n in self.lengths.tolist()]
            flags = np.zeros((int(self.lengths.max()) + 1, len(self.texts)), bool)
            at = np.arange(len(self.texts))
            for j in range(1, len(flags)):
                at = step[at[: int(np.searchsorted(-self.lengths, -j, "right"))]]
                flags[j, : len(at)] = twice[at]
            for i, n in enumerate(self.lengths.tolist()):
                found[i] = flags[self.cap : n + 1, i][::-1]
        out: list = [None] * len(found)
        for i, marks in zip(self.order, found):
            out[i] = marks
        return out
