"""Sequences as a run-length grammar made by recompression, with longest common extensions read off the grammar."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd


@dataclass
class Level:
    """One level of the grammar, as a table of its symbols in order.

    ``width`` is the number of base symbols below each. The step to the next
    level is told by ``opens`` (whether a symbol is the first below its
    parent), ``parent`` (the parent's place there) and ``child`` (each parent's
    first symbol here, and one past the end); ``blocks`` says whether
    the step joined blocks of one symbol or pairs.
    """

    symbol: np.ndarray
    width: np.ndarray
    blocks: bool = False
    opens: np.ndarray | None = None
    parent: np.ndarray | None = None
    child: np.ndarray | None = None

    def link(self, opens: np.ndarray, blocks: bool) -> None:
        self.blocks, self.opens = blocks, opens
        self.parent = np.cumsum(opens) - 1
        self.child = np.append(np.flatnonzero(opens), len(self.symbol))

    def mirrored(self) -> Level:
        """The same level read from the right."""
        n = len(self.symbol)
        if self.opens is None:
            return Level(self.symbol[::-1], self.width[::-1])
        closes = np.append(self.opens[1:], True)
        parents = len(self.child) - 1
        return Level(self.symbol[::-1], self.width[::-1], self.blocks, closes[::-1], parents - 1 - self.parent[::-1], n - self.child[::-1])


def _names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, from 0 on."""
    return pd.factorize(first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second)[0]


class Grammar:
    """Recompression of many sequences at once: in turn, blocks of one symbol and pairs of unlike ones get new names.

    ``codes`` holds the sequences end to end, ``fence`` marks the places
    before the first, between any two, and behind the last; each fence gets a
    name of its own and is never joined with anything. For pairs the symbols
    are dealt to two sides by a mixed hash, and a left one is joined with a
    right one behind it, on the orientation that joins more. What is joined
    depends on the symbols beside a place only, so equal stretches are cut
    alike but for their ends, which is what makes extensions quick. A round
    leaves about three quarters; rounds end when no sequence has more than
    ``few`` symbols left.
    """

    def __init__(self, codes: np.ndarray, fence: np.ndarray, few: int = 4):
        symbol = codes.astype(np.int64) + 1
        symbol[fence] = int(symbol.max(initial=0)) + 1 + np.arange(int(fence.sum()))
        self.levels = [Level(symbol, np.ones(len(symbol), np.int64))]
        turn = 0
        while len(ends := np.flatnonzero(fence)) and int(np.diff(ends).max(initial=1)) - 1 > few:
            low = self.levels[-1]
            opens = np.append(True, low.symbol[1:] != low.symbol[:-1])
            if not opens.all():
                self._add(opens, blocks=True)
                fence, low = fence[opens], self.levels[-1]
            side = self._sides(low.symbol, turn)
            turn += 1
            inner = ~(fence[1:] | fence[:-1])
            ahead, back = inner & side[:-1] & ~side[1:], inner & ~side[:-1] & side[1:]
            joined = ahead if np.count_nonzero(ahead) >= np.count_nonzero(back) else back
            self._add(np.append(True, ~joined), blocks=False)
            fence = fence[low.opens]

    @staticmethod
    def _sides(symbol: np.ndarray, turn: int) -> np.ndarray:
        """One bit of a mixed hash of each symbol."""
        x = (symbol.astype(np.uint64) + np.uint64(turn * 0x9E37 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(40)) & np.uint64(1) == 1

    def _add(self, opens: np.ndarray, blocks: bool) -> None:
        low = self.levels[-1]
        low.link(opens, blocks)
        first, size = low.child[:-1], np.diff(low.child)
        second = size if blocks else np.where(size == 2, low.symbol[low.child[1:] - 1] + 1, 0)
        self.levels.append(Level(_names(low.symbol[first], second), np.add.reduceat(low.width, first)))

    def mirrored(self) -> Grammar:
        """The grammar read from the right; place ``i`` is ``n - 1 - i`` there."""
        other = object.__new__(Grammar)
        other.levels = [level.mirrored() for level in self.levels]
        return other

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many base symbols are alike from ``a`` and from ``b`` on, for many pairs of unlike places of one sequence.

        Up: while both stand at a parent's first symbol and are alike, the
        parents are compared instead; else alike symbols are passed, a block
        at once. Down from the first unlike ones: their children are
        passed as far as they are alike. On each level a few symbols are passed.
        """
        a, b, gained = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        going, stopped = np.arange(len(a)), []
        for level in self.levels:
            halted, risen = [], []
            while going.size:
                x, y = a[going], b[going]
                same = level.symbol[x] == level.symbol[y]
                halted.append(going[~same])
                going, x, y = going[same], x[same], y[same]
                if level.opens is not None:
                    up = level.opens[x] & level.opens[y]
                    risen.append(going[up])
                    a[going[up]], b[going[up]] = level.parent[x[up]], level.parent[y[up]]
                    going, x, y = going[~up], x[~up], y[~up]
                self._pass(level, going, x, y, a, b, gained)
            stopped.append(np.concatenate(halted) if halted else going)
            going = np.concatenate(risen) if risen else going
        down = stopped[-1]
        for level, halted in zip(self.levels[-2::-1], stopped[-2::-1], strict=True):
            a[down], b[down] = level.child[a[down]], level.child[b[down]]
            moving = down
            while moving.size:
                x, y = a[moving], b[moving]
                same = level.symbol[x] == level.symbol[y]
                moving, x, y = moving[same], x[same], y[same]
                self._pass(level, moving, x, y, a, b, gained)
            down = np.concatenate([down, halted])
        return gained

    @staticmethod
    def _pass(level: Level, which: np.ndarray, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, gained: np.ndarray) -> None:
        """Step over alike symbols at ``x`` and ``y``; over all that both have left of their block, where blocks are joined next."""
        step = 1
        if level.blocks:
            step = np.minimum(level.child[level.parent[x] + 1] - x, level.child[level.parent[y] + 1] - y)
        gained[which] += level.width[x] * step
        a[which], b[which] = x + step, y + step
