"""A probabilistic suffix tree over word symbols in numpy, which the tables of the library are held against."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from surveyloom.llm.language_model import DISCOUNT


def positions(ends: np.ndarray) -> np.ndarray:
    """Place of every symbol in its own text, for texts laid end to end."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(starts, np.diff(np.concatenate([[0], ends])))


@dataclass
class Level:
    """Contexts of one depth.  A context is an older symbol before a context of the depth above."""

    keys: np.ndarray                     # sorted: index of the shorter context * symbols + older symbol
    symbols: np.ndarray                  # one row per context, the latest symbol first
    counts: np.ndarray
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    shorter: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))   # state used for what is not stored
    states: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0))                # log10 weight of the shorter state


class SuffixTree:
    """Variable-length contexts with smoothed next-symbol distributions.

    State 0 has no context and a chance for every symbol.  A longer state stores
    the successors that follow it often; the rest of its mass goes to all other
    successors in the proportions of the next shorter state, so every state's
    distribution sums to one.
    """

    def __init__(self, root: np.ndarray, end: int):
        self.size, self.end = len(root), end
        with np.errstate(divide="ignore"):
            self.root = np.log10(root)
        self.levels: list[Level] = []
        self.parent, self.weight = np.zeros(1, np.int64), np.zeros(1)
        self.keys, self.logs = np.zeros(0, np.int64), np.zeros(0)

    def first_contexts(self, counts: np.ndarray, least: float) -> None:
        some = np.flatnonzero(counts >= max(least, 1))
        self.levels.append(Level(some.astype(np.int64), some[:, None], counts[some].astype(np.float64)))

    def walk(self, symbols: np.ndarray, place: np.ndarray, depth: int) -> list[np.ndarray]:
        """For each depth the index of the context before every symbol, or -1.

        A text is preceded by one end, that of the text before it, and by nothing older.
        """
        found, last = [], np.zeros(len(symbols), np.int64)
        for k, level in enumerate(self.levels[:depth], start=1):
            older = np.full(len(symbols), self.end, np.int64)
            inside = place >= k
            older[inside] = symbols[np.flatnonzero(inside) - k]
            last = self._find(level.keys, np.where((last >= 0) & (place >= k - 1), last * self.size + older, -1))
            found.append(last)
        return found

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def count(self, symbols: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(context index * symbols + successor, how often) at one depth."""
        context = self.walk(symbols, positions(ends), depth)[-1]
        some = context >= 0
        return np.unique(context[some] * self.size + symbols[some], return_counts=True)

    def log_chance(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of the chance of each symbol in each state."""
        out, state, open_ = np.zeros(len(symbol)), state.copy(), np.arange(len(symbol))
        while len(open_):
            at_root = state[open_] == 0
            top = open_[at_root]
            out[top] += self.root[symbol[top]]
            open_ = open_[~at_root]
            place = self._find(self.keys, state[open_] * self.size + symbol[open_])
            hit = place >= 0
            out[open_[hit]] += self.logs[place[hit]]
            open_ = open_[~hit]
            out[open_] += self.weight[state[open_]]
            state[open_] = self.parent[state[open_]]
        return out

    def grow(self, keys: np.ndarray, counts: np.ndarray, least: float, total: float) -> None:
        """Test the contexts of the deepest level on their successors, and add the level below.

        A context becomes a state if its successors diverge from what the next
        shorter state says by more than storing them costs: times seen times
        relative entropy against half a logarithm of the corpus for each.
        """
        level, depth = self.levels[-1], len(self.levels)
        context, symbol = keys // self.size, keys % self.size
        n = len(level.keys)
        level.shorter = self._state_above(level, depth)
        share = counts / level.counts[context]
        below = 10.0 ** self.log_chance(level.shorter[context], symbol)
        stored = np.bincount(context, minlength=n)
        gain = np.bincount(context, counts * np.log(share / below), minlength=n)
        left = np.maximum(1 - np.bincount(context, share, minlength=n), 0)
        left_below = np.maximum(1 - np.bincount(context, below, minlength=n), 1e-12)
        gain += np.where(left > 0, level.counts * left * np.log(np.maximum(left, 1e-300) / left_below), 0)
        level.kept = (stored > 0) & (gain > 0.5 * stored * math.log(max(total, 2)))
        level.states = np.where(level.kept, len(self.parent) + np.cumsum(level.kept) - 1, -1)
        mine = level.kept[context]
        logs = np.log10((counts[mine] - DISCOUNT) / level.counts[context[mine]])
        rest = 1 - np.bincount(context[mine], 10.0 ** logs, minlength=n)
        self.parent = np.concatenate([self.parent, level.shorter[level.kept]])
        self.weight = np.concatenate([self.weight, np.log10(rest / left_below)[level.kept]])
        new = level.states[context[mine]] * self.size + symbol[mine]
        order = np.argsort(np.concatenate([self.keys, new]), kind="stable")
        self.keys = np.concatenate([self.keys, new])[order]
        self.logs = np.concatenate([self.logs, logs])[order]
        # A context followed by its successor is a string one longer; frequent ones are the next contexts.
        often = counts >= max(least, 2)
        strings = np.concatenate([symbol[often][:, None], level.symbols[context[often]]], axis=1)
        place = np.zeros(len(strings), np.int64)
        for k, upper in enumerate(self.levels):
            place = self._find(upper.keys, np.where(place >= 0, place * self.size + strings[:, k], -1))
        some = place >= 0
        deeper = place[some] * self.size + strings[some, depth]
        order = np.argsort(deeper)
        self.levels.append(Level(deeper[order], strings[some][order], counts[often][some][order].astype(np.float64)))

    def _state_above(self, level: Level, depth: int) -> np.ndarray:
        """The longest state that is a proper suffix of each context."""
        state, place = np.zeros(len(level.keys), np.int64), np.zeros(len(level.keys), np.int64)
        for k, upper in enumerate(self.levels[:depth - 1]):
            place = self._find(upper.keys, np.where(place >= 0, place * self.size + level.symbols[:, k], -1))
            known = np.where(place >= 0, upper.states[place] if len(upper.states) else -1, -1)
            state = np.where(known >= 0, known, state)
        return state

    def score(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 of the chance of every symbol after the longest state that ends before it."""
        state = np.zeros(len(symbols), np.int64)
        tested = sum(1 for level in self.levels if len(level.kept) == len(level.keys) and len(level.states))
        for level, place in zip(self.levels, self.walk(symbols, positions(ends), tested), strict=False):
            known = np.where(place >= 0, level.states[place], -1)
            state = np.where(known >= 0, known, state)
        return self.log_chance(state, symbols.astype(np.int64))
