"""Periodic runs of words by the linear-time tandem-repeat method of Gusfield and Stoye.

A text's words are cut into LZ blocks. A square whose first occurrence it is touches the start of a block, so common
extensions to both sides of the blocks' starts give a leftmost-covering set of squares. Walks along suffix
links, from a suffix to the one a word later, complete the vocabulary: each step turns a square by one word.
The suffix tree's leaves below a square are its occurrences; those of one period that stand side by side are one run.

The suffix tree is held as a suffix array with common prefixes. Ranks of all substrings of 2^j words, from which
the array is made, also answer extensions exactly. All steps work on whole arrays of numpy.
Words of a text that no run can hold are left out before, and what remains of a batch of texts is one string.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches, utf8

LEAST, TIMES = 6, 4
FOUND = "starts array<long>, lengths array<long>, periods array<long>, collapsed string"


class Suffixes:
    """Order and common extensions of the suffixes of a string of numbers."""

    def __init__(self, s: np.ndarray) -> None:
        n = self.n = len(s)
        self.ranks = []
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
        size = 1
        while True:
            self.ranks.append(np.append(rank, -1).astype(np.int32))
            if not n or rank.max() == n - 1:
                break
            then = np.zeros(n, np.int64)
            then[: max(0, n - size)] = rank[size:] + 1
            rank = np.unique(rank * (n + 1) + then, return_inverse=True)[1].astype(np.int64)
            size *= 2
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def forward(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many numbers from i and from k on are equal; i and k differ."""
        out = np.zeros(len(i), np.int64)
        for j in range(len(self.ranks) - 2, -1, -1):
            same = self.ranks[j][np.minimum(i + out, self.n)] == self.ranks[j][np.minimum(k + out, self.n)]
            out += same.astype(np.int64) << j
        return out

    def backward(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many numbers up to i and up to k are equal."""
        out = np.zeros(len(i), np.int64)
        for j in range(len(self.ranks) - 2, -1, -1):
            x, y = i - out - (1 << j) + 1, k - out - (1 << j) + 1
            same = (x >= 0) & (y >= 0) & (self.ranks[j][np.maximum(x, 0)] == self.ranks[j][np.maximum(y, 0)])
            out += same.astype(np.int64) << j
        return out


def blocks(t: Suffixes) -> np.ndarray:
    """Starts of the LZ blocks, and the end: each block is the longest string that begins earlier too, or one new number."""
    order = t.order.tolist()
    before, after, stack = np.full(t.n, -1), np.full(t.n, -1), []
    for r, p in enumerate(order):
        while stack and order[stack[-1]] > p:
            after[order[stack.pop()]] = p
        if stack:
            before[p] = order[stack[-1]]
        stack.append(r)
    longest = np.zeros(t.n, np.int64)
    for earlier in (before, after):
        at = np.flatnonzero(earlier >= 0)
        longest[at] = np.maximum(longest[at], t.forward(at, earlier[at]))
    step, out, at = np.maximum(longest, 1).tolist(), [], 0
    while at < t.n:
        out.append(at)
        at += step[at]
    return np.array([*out, t.n])


def _each(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sizes (2, 3): owners (0, 0, 1, 1, 1) and numbers (0, 1, 0, 1, 2)."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def covering(t: Suffixes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that cover the first occurrence of every square with a period of `longest` at most."""
    edge = blocks(t)
    size = np.diff(edge)
    found = []
    # the second half crosses the end of the block
    owner, k = _each(np.minimum(size, longest) * (edge[1:] < t.n))
    k = k + 1
    found.append((edge[1:][owner] - k, k))
    # the square crosses the start of the block
    owner, k = _each(np.minimum(size + np.append(size[1:], 0), longest))
    k = k + 1
    ok = edge[:-1][owner] + k < t.n
    found.append((edge[:-1][owner][ok], k[ok]))
    at, k = (np.concatenate(x) for x in zip(*found, strict=True))
    right, left = t.forward(at, at + k), t.backward(at - 1, at + k - 1)
    ok = right + left >= k
    return np.maximum(at - left, at - k)[ok], k[ok]


def _primitive(t: Suffixes, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the half of a square isn't a power of something shorter."""
    out = np.ones(len(k), bool)
    for period in np.unique(k):
        where = np.flatnonzero(k == period)
        rest, p = int(period), 2
        while rest > 1:
            p = p if p * p <= rest else rest
            if rest % p:
                p += 1
                continue
            while rest % p == 0:
                rest //= p
            out[where] &= t.forward(at[where], at[where] + period // p) < period - period // p
    return out


def vocabulary(t: Suffixes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(an occurrence, period) of every primitive square, each once."""
    at, k = covering(t, longest)
    # several blocks may give squares of one walk: it begins where the leftmost does
    at = at - t.backward(at - 1, at + k - 1)
    key = np.unique(at * (longest + 1) + k)
    at, k = key // (longest + 1), key % (longest + 1)
    ok = _primitive(t, at, k)
    at, k = at[ok], k[ok]
    # after k steps a walk is back at its first square
    owner, step = _each(np.minimum(t.forward(at, at + k) - k + 1, k))
    at, k = at[owner] + step, k[owner]
    level = np.frexp(2 * k)[1] - 1
    first, second = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for j in np.unique(level):
        where = level == j
        # the last level tells all substrings apart
        ranks = t.ranks[min(j, len(t.ranks) - 1)]
        first[where], second[where] = ranks[at[where]], ranks[at[where] + 2 * k[where] - (1 << j)]
    kind = np.unique(first * t.n + second, return_inverse=True)[1]
    once = np.unique(kind * (longest + 1) + k, return_index=True)[1]
    return at[once], k[once]


def squares(t: Suffixes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all occurrences of primitive squares, sorted by period and start."""
    at, k = vocabulary(t, longest)
    common = np.zeros(t.n + 1, np.int64)
    common[1 : t.n] = t.forward(t.order[:-1], t.order[1:])
    least = [common]
    while 1 << len(least) <= t.n + 1:
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    low, high = t.rank[at].copy(), t.rank[at].copy()
    for j in range(len(least) - 1, -1, -1):
        size = 1 << j
        ok = high + size < t.n
        ok[ok] = least[j][high[ok] + 1] >= 2 * k[ok]
        high[ok] += size
        ok = low - size >= 0
        ok[ok] = least[j][low[ok] - size + 1] >= 2 * k[ok]
        low[ok] -= size
    owner, step = _each(high - low + 1)
    key = np.sort(k[owner] * t.n + t.order[low[owner] + step])
    return key % t.n, key // t.n


def runs(s: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the maximal runs of a string of numbers: two periods and more, periods of `longest` at most."""
    none = np.zeros(0, np.int64)
    if len(s) < 2 or longest < 1:
        return none, none, none
    at, k = squares(Suffixes(s), longest)
    if not len(at):
        return none, none, none
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(k) != 0))
    head, tail = np.append(0, cut + 1), np.append(cut, len(at) - 1)
    return at[head], at[tail] - at[head] + 2 * k[head], k[head]


def _stretches(s: np.ndarray) -> np.ndarray:
    """Marks what a run may hold: in a run of four periods and six words, every three words in a row occur three times.

    s: words of several texts, each text with numbers of its own, and a number that occurs once after each.
    """
    live = np.zeros(len(s), bool)
    if len(s) > 2:
        pair = np.unique(s[:-1] * (len(s) + 1) + s[1:], return_inverse=True)[1]
        three = np.unique(pair[:-1] * (len(s) + 1) + s[2:], return_inverse=True, return_counts=True)
        often = three[2][three[1]] >= 3
        for k in range(3):
            live[k : len(s) - 2 + k] |= often
    return live


def batch_runs(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text's words, (start, length, period) of its runs of max(6, four periods) words and more, by start and period."""
    numbers, begins = [], [0]
    for words in texts:
        known: dict[bytes, int] = {}
        base = begins[-1]
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        numbers += [ids + base, [base + len(words)]]
        begins.append(base + len(words) + 1)
    s = np.concatenate(numbers)
    live = _stretches(s)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], live, [False]))))
    low, high = edge[::2], edge[1::2]
    low, high = low[high - low >= LEAST], high[high - low >= LEAST]
    empty = np.zeros(0, np.int64)
    if not len(low):
        return [(empty, empty, empty)] * len(texts)
    # one string of all stretches, each with a number after it that occurs once
    owner, step = _each(high - low + 1)
    place = low[owner] + step
    last = step == (high - low)[owner]
    t = np.where(last, len(s) + owner, s[np.minimum(place, len(s) - 1)])
    start, length, period = runs(t, int((high - low).max()) // TIMES)
    ok = length >= np.maximum(LEAST, TIMES * period)
    start, length, period = place[start[ok]], length[ok], period[ok]
    sort = np.lexsort((period, start))
    start, length, period = start[sort], length[sort], period[sort]
    cut = np.searchsorted(start, begins)
    return [(start[a:b] - begin, length[a:b], period[a:b]) for a, b, begin in zip(cut[:-1], cut[1:], begins[:-1], strict=True)]


def collapse(words: list[bytes], found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    start, length, period = found
    if not len(start):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return b" ".join(w for w, d in zip(words, np.cumsum(depth)[:-1].tolist(), strict=True) if not d)


def _found(texts: pd.Series) -> pd.DataFrame:
    # bytes are split at the six ASCII space characters
    words = [utf8(t).split() for t in texts]
    found = batch_runs(words)
    return pd.DataFrame({
        "starts": [f[0] for f in found], "lengths": [f[1] for f in found], "periods": [f[2] for f in found],
        "collapsed": [collapse(w, f).decode("utf-8", "surrogatepass") for w, f in zip(words, found, strict=True)],
    })


def periodic_runs(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """All columns of docs and `runs`, an array of (start, length, period) by start and period, and `collapsed`.

    Words are what stands between space, tab and line-break characters of ASCII. A run is a maximal stretch of words with a smallest period,
    of six words and four periods at least; collapsed is the text without what follows a run's first period.
    A null text has no words; a text without words collapses to the empty string. Columns of docs named runs or
    collapsed are replaced; repeated rows and ties are rows like others, null ids too; an empty table gives no rows.
    A task holds one batch of texts, or one text, and some tens of numbers for each word of repeated parts.
    """
    small_batches(docs.sparkSession)
    find = F.pandas_udf(_found, FOUND)
    column = F.col(text) if isinstance(text, str) else text
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    told = docs.select(*kept, find(column).alias("_found"))
    listed = F.zip_with(F.arrays_zip("_found.starts", "_found.lengths"), "_found.periods", lambda x, p: F.struct(x["starts"].alias("start"), x["lengths"].alias("length"), p.alias("period")))
    return told.select(*kept, listed.alias("runs"), F.col("_found.collapsed").alias("collapsed"))
