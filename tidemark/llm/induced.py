"""External induced suffix sorting with common-prefix values.

The suffixes of a symbol string are sorted by induction from its left-most S-type (LMS) suffixes: a forward pass induces
the L-type suffixes, a backward pass the S-type ones.  Both passes run over a priority queue of suffix tuples ordered by
symbol; within a symbol, tuples leave in the order they came, which is their order by rank.  The queue keeps at most
``memory`` bytes and appends the rest to a temporary file.  With each tuple travels the length of its common prefix with
the one before, ``1 + min`` over the scanned range between their sources.  The LMS suffixes are sorted by naming their
substrings (by a first induction) and ranking the string of names, by doubling, to the depth asked for.
"""
from __future__ import annotations

import tempfile

import numpy as np

from tidemark.llm.common import U64, mix64, seeded_words

_BASE = 0x9E3779B97F4A7C15


class SymbolQueue:
    """Priority queue of (position, common prefix) tuples by symbol; equal symbols first in, first out."""

    def __init__(self, symbols: int, memory: int):
        self.held: list[list] = [[] for _ in range(symbols)]
        self.memory, self.used, self.file = memory, 0, None

    def push(self, symbol: int, positions: np.ndarray, prefix: np.ndarray) -> None:
        self.held[symbol].append((positions, prefix))
        self.used += positions.nbytes + prefix.nbytes
        if self.used > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for chunks in self.held:
            for i, chunk in enumerate(chunks):
                if isinstance(chunk[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(chunk[0].tobytes())
                    self.file.write(chunk[1].tobytes())
                    chunks[i] = (at, len(chunk[0]))
        self.used = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a symbol, and forget them."""
        parts = []
        for a, b in self.held[symbol]:
            if isinstance(a, np.ndarray):
                self.used -= a.nbytes + b.nbytes
                parts.append((a, b))
            else:
                self.file.seek(a)
                parts.append((np.frombuffer(self.file.read(4 * b), np.int32), np.frombuffer(self.file.read(4 * b), np.int32)))
        self.held[symbol] = []
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def run_ends(text: np.ndarray) -> np.ndarray:
    """For each position, the end of its run of equal symbols."""
    ends = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]])).astype(np.int32) + 1
    return np.repeat(ends, np.diff(ends, prepend=0))


def s_types(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end of the text counts as smaller than any symbol."""
    following = np.concatenate([text.astype(np.int32), [-1]])[ends]
    return text < following


class Induction:
    """One text with what both passes need."""

    def __init__(self, text: np.ndarray, symbols: int, memory: int):
        self.text, self.symbols, self.memory = text, symbols, memory
        self.ends = run_ends(text)
        self.small = s_types(text, self.ends)
        self.lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]).astype(np.int32) + 1

    def _push(self, queue: SymbolQueue, scan: np.ndarray, prefix: np.ndarray, chosen: np.ndarray) -> None:
        """Push the predecessors of the chosen places of a scan, with the common prefixes their sources give."""
        before = scan[chosen] - 1
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(symbol[order].astype(np.int32)) != 0]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            places = chosen[order[a:b]]
            shared = np.ones(len(places), np.int32)  # from another symbol before: the first symbol alone
            if len(places) > 1:
                shared[1:] += np.minimum.reduceat(prefix[:places[-1] + 1], places[:-1] + 1)
            queue.push(int(symbol[order[a]]), before[order[a:b]], shared)

    def _close(self, queue: SymbolQueue, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """The tuples of a symbol, and those they induce in the same symbol, round after round."""
        now, shared = queue.pop(symbol)
        shared = shared.copy()
        if len(shared):
            shared[0] = 0
        all_, prefix = [now], [shared]
        while len(now):
            same = np.flatnonzero((now > 0) & (self.text[now - 1] == symbol))
            if not len(same):
                break
            # the first of a round follows the last of the round before: both runs of the symbol, of different length
            last = now[-1]
            nxt = now[same] - 1
            new = np.zeros(len(same), np.int32)
            new[0] = min(self.ends[last] - last, self.ends[nxt[0]] - nxt[0])
            if len(same) > 1:
                new[1:] = 1 + np.minimum.reduceat(shared[:same[-1] + 1], same[:-1] + 1)
            all_.append(nxt)
            prefix.append(new)
            now, shared = nxt, new
        return np.concatenate(all_), np.concatenate(prefix)

    def _seam(self, a: int, b: int) -> int:
        """Common prefix of an L-type and an S-type suffix of one symbol: the shorter of their runs."""
        return min(int(self.ends[a] - a), int(self.ends[b] - b))

    def sort(self, seeds: np.ndarray, seed_prefix: np.ndarray):
        """Yield (suffixes, common prefixes) symbol by symbol, largest symbol first, each in ascending order.

        ``seeds`` are the LMS positions in their order, ``seed_prefix`` their common prefixes with the one before.
        """
        text, n = self.text, len(self.text)
        of = text[seeds]
        first = np.searchsorted(of, np.arange(self.symbols + 1))
        forward, backward = SymbolQueue(self.symbols, self.memory), SymbolQueue(self.symbols, self.memory)
        large = SymbolQueue(self.symbols, self.memory)
        if n:
            forward.push(int(text[n - 1]), np.array([n - 1], np.int32), np.zeros(1, np.int32))
        for symbol in range(self.symbols):
            scan, prefix = self._close(forward, symbol)
            if len(scan):
                large.push(symbol, scan, prefix)
            own, shared = seeds[first[symbol]:first[symbol + 1]], seed_prefix[first[symbol]:first[symbol + 1]].copy()
            if len(own):
                shared[0] = self._seam(scan[-1], own[0]) if len(scan) else 0
                scan, prefix = np.concatenate([scan, own]), np.concatenate([prefix, shared])
            if len(scan):
                chosen = np.flatnonzero((scan > 0) & (text[scan - 1] > symbol))
                if len(chosen):
                    self._push(forward, scan, prefix, chosen)
        for symbol in range(self.symbols - 1, -1, -1):
            down, prefix = self._close(backward, symbol)  # S-type, descending
            up, up_prefix = large.pop(symbol)  # L-type, ascending
            turned = np.concatenate([np.zeros(1, np.int32), up_prefix[:0:-1]]) if len(up) else up_prefix
            if len(up) and len(down):
                turned[0] = self._seam(up[-1], down[-1])
            scan, shared = np.concatenate([down, up[::-1]]), np.concatenate([prefix, turned])
            if not len(scan):
                continue
            chosen = np.flatnonzero((scan > 0) & (text[scan - 1] < symbol))
            if len(chosen):
                self._push(backward, scan, shared, chosen)
            # ascending again: the prefix of an entry belongs to the one after it
            yield scan[::-1], np.concatenate([np.zeros(1, np.int32), shared[:0:-1]])


def _spans(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each symbol span."""
    out = []
    for seed in (3, 4):
        base = _BASE + 16 * seed
        powers = lambda b: np.cumprod(np.concatenate([[U64(1)], np.full(len(text), U64(b))]), dtype=np.uint64)
        table = seeded_words(seed, 65536)
        total = np.concatenate([[U64(0)], np.cumsum(table[text] * powers(base)[:-1], dtype=np.uint64)])
        out.append(mix64((total[ends] - total[starts]) * powers(pow(base, -1, 1 << 64))[starts]))
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks 0.. of equal-or-smaller keys."""
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(np.concatenate([[0], keys[order][1:] != keys[order][:-1]]))
    return ranks


def sorted_lms(induction: Induction, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The LMS positions in the order of their suffixes, with common prefixes, both exact up to ``depth`` symbols."""
    text, lms = induction.text, induction.lms
    n, m = len(text), len(lms)
    if not m:
        return lms, np.zeros(0, np.int32)
    # a first induction, from the LMS positions by symbol only, sorts their substrings
    rough = lms[np.argsort(text[lms], kind="stable")]
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    parts = [suffixes[is_lms[suffixes]] for suffixes, _ in induction.sort(rough, np.zeros(m, np.int32))]
    order = np.concatenate(parts[::-1])
    # equal substrings get equal names
    number = np.zeros(n, np.int32)
    number[lms] = np.arange(m)
    until = np.concatenate([lms[1:] + 1, [n]])
    h1, h2 = _spans(text, lms, until)
    by = number[order]
    length = (until - lms)[by]
    new = (length[1:] != length[:-1]) | (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
    names = np.empty(m, np.int64)
    names[by] = np.cumsum(np.concatenate([[0], new])) + 1
    # rank the string of names by doubling; two symbols a name at least
    ranks, step = [names], 1
    begin = np.concatenate([lms, [n]]).astype(np.int64)
    shortest = lambda names_: int((begin[names_:m] - begin[:m - names_]).min(initial=depth)) if names_ < m else depth
    while shortest(step) < depth and ranks[-1].max() < m:
        following = np.concatenate([ranks[-1][step:], np.zeros(min(step, m), np.int64)])[:m]
        ranks.append(_dense(ranks[-1] * (m + 2) + following) + 1)
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    # common prefix of neighbours: whole equal names, then symbols
    a, b = order[:-1].copy(), order[1:].copy()
    inside = lambda x: x < m
    for k in range(len(ranks) - 1, -1, -1):
        both = inside(a) & inside(b)
        equal = np.zeros(len(a), bool)
        equal[both] = ranks[k][a[both]] == ranks[k][b[both]]
        a, b = np.where(equal, a + (1 << k), a), np.where(equal, b + (1 << k), b)
    x, y = begin[np.minimum(a, m)], begin[np.minimum(b, m)]
    shared = x - lms[order[:-1]]
    shared = np.where((a >= m) | (b >= m), np.minimum(shared, n - np.maximum(lms[order[:-1]], lms[order[1:]])), shared)
    open_ = np.flatnonzero((shared < depth) & (a < m) & (b < m))
    while len(open_):
        i, j = x[open_], y[open_]
        ok = (i < n) & (j < n)
        ok[ok] = text[i[ok]] == text[j[ok]]
        open_ = open_[ok]
        shared[open_] += 1
        x[open_] += 1
        y[open_] += 1
        open_ = open_[shared[open_] < depth]
    return lms[order], np.concatenate([[0], np.minimum(shared, depth)]).astype(np.int32)


def suffix_blocks(text: np.ndarray, symbols: int, depth: int, memory: int = 64 << 20):
    """(suffixes, common prefixes) of all suffixes, largest first symbol first, each block in ascending order.

    Order and common prefixes are exact up to ``depth`` symbols; suffixes that agree further may come in any order.
    """
    induction = Induction(np.ascontiguousarray(text, np.uint16), symbols, memory)
    yield from induction.sort(*sorted_lms(induction, depth))
