"""A run-length grammar by recompression, and longest common extensions on it.

Block compression replaces each maximal block of one symbol by a symbol of its own; pair compression parts the symbols into
left and right ones and replaces each neighbouring (left, right) pair.  The two alternate until every text is one symbol.
Whether a place is a boundary of the next level depends on its two neighbours alone, so two equal stretches are parsed alike
but for their edges: an extension climbs the levels with one step on each and comes down again the same way.  All queries of
a batch climb together, so the work is arrays over queries, once per level.  No suffix array, no hash: extensions are exact.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.llm.common import U64, mix64, seeded_words

_SEEDS = seeded_words(71, 512)


@dataclass
class Level:
    """A sequence of symbols and how it is grouped into the next level's."""
    symbols: np.ndarray
    up: np.ndarray      # group of each symbol
    first: np.ndarray   # first symbol of each group, and the end
    pairs: bool         # grouped into pairs, otherwise into blocks


def _named(parts: list[np.ndarray], next_name: int) -> tuple[np.ndarray, int]:
    """One new name for each distinct row of two columns of names or counts."""
    width = int(max(int(parts[1].max()) + 1, next_name))
    distinct, name = np.unique(parts[0] * width + parts[1], return_inverse=True)
    return name + next_name, next_name + len(distinct)


def _grouped(symbols: np.ndarray, starts: np.ndarray, pairs: bool) -> Level:
    return Level(symbols, (np.cumsum(starts) - 1).astype(np.int32),
                 np.append(np.flatnonzero(starts), len(symbols)).astype(np.int32), pairs)


def compressed(symbols: np.ndarray) -> list[Level]:
    """The levels of the grammar; the last one is left ungrouped.

    ``symbols`` are words' numbers (not negative), each text between two negative numbers that occur once and never join a
    group: at the top each text that is not empty is one symbol.
    """
    levels: list[Level] = []
    names, turn = int(max(symbols.max(), 0)) + 1, 0
    while np.any((symbols[1:] >= 0) & (symbols[:-1] >= 0)):
        starts = np.concatenate([[True], symbols[1:] != symbols[:-1]])
        if not starts.all():
            level = _grouped(symbols, starts, False)
            size = np.diff(level.first).astype(np.int64)
            symbols = symbols[level.first[:-1]]
            many = np.flatnonzero(size > 1)
            symbols[many], names = _named([symbols[many], size[many]], names)
            levels.append(level)
        bit = (mix64(symbols.astype(np.uint64) ^ _SEEDS[turn % len(_SEEDS)]) & U64(1)).astype(bool)
        turn += 1
        word = symbols >= 0
        left, right = word & ~bit, word & bit
        one, other = left[:-1] & right[1:], right[:-1] & left[1:]
        joined = one if one.sum() >= other.sum() else other
        if joined.any():
            level = _grouped(symbols, np.concatenate([[True], ~joined]), True)
            at = np.flatnonzero(joined)
            name, names = _named([symbols[at], symbols[at + 1]], names)
            symbols = symbols[level.first[:-1]]
            symbols[level.up[at]] = name
            levels.append(level)
    levels.append(Level(symbols, np.zeros(0, np.int32), np.zeros(0, np.int32), False))
    return levels


def extension(levels: list[Level], i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """How many symbols agree from places i and j on (``forward``), or before them; i and j differ and lie within texts."""
    a, b = i.astype(np.int64), j.astype(np.int64)
    back = 0 if forward else 1
    stop = np.full(len(a), len(levels) - 1)
    live = np.arange(len(a))

    def left_in_group(level: Level, place: np.ndarray) -> np.ndarray:
        group = level.up[place - back]
        return level.first[group + 1] - place if forward else place - level.first[group]

    def step(which: np.ndarray, by: np.ndarray) -> None:
        a[which] += by if forward else -by
        b[which] += by if forward else -by

    for h, level in enumerate(levels[:-1]):
        x, y = a[live], b[live]
        loose = np.flatnonzero((level.first[level.up[x]] != x) | (level.first[level.up[y]] != y))
        if len(loose):
            which, x, y = live[loose], x[loose], y[loose]
            same = level.symbols[x - back] == level.symbols[y - back]
            p, q = left_in_group(level, x), left_in_group(level, y)
            step(which[same], np.minimum(p, q)[same])
            ended = loose[~same | (p != q)]  # another symbol comes next: the extension ends on this level
            stop[live[ended]] = h
            keep = np.ones(len(live), bool)
            keep[ended] = False
            live = live[keep]
        a[live], b[live] = level.up[a[live]], level.up[b[live]]
    for h in range(len(levels) - 2, -1, -1):
        level = levels[h]
        which = np.flatnonzero(stop > h)
        if not len(which):
            continue
        x, y = level.first[a[which]].astype(np.int64), level.first[b[which]].astype(np.int64)
        a[which], b[which] = x, y
        same = np.flatnonzero(level.symbols[x - back] == level.symbols[y - back])
        if len(same):
            x, y = x[same], y[same]
            step(which[same], np.ones(len(same), np.int64) if level.pairs else np.minimum(left_in_group(level, x), left_in_group(level, y)))
    return np.abs(a - i)
