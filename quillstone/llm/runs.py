"""Periodic runs: stretches of words that repeat with a period, and texts with the repetitions left out.

Method, text by text: for each period p the grid points 0, p, 2p, … are paired with their next ones (harmonically many
pairs: n ln n). A run of period p and of two periods or more holds such a pair, and is as long as the longest common
extensions of its pair forwards and backwards say. Prefix hashes of the words compare any two stretches in one step, so
that all pairs are searched at once by halving, in numpy: first the two words at the pair, then half of what is needed,
and for the few pairs that are left the whole extensions. Candidates are verified word by word; where that fails, the
text is searched again with another base.

A run is a stretch with smallest period q that no word beside it extends keeping q, of `least` words and 2q at least.
Runs may overlap. Each is found once, with its smallest period.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

_PRIME = (1 << 31) - 1
#: Pairs that are looked at together, which bounds memory for long texts.
PAIRS = 1 << 17

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed_text", T.StringType())]


class _Prefixes:
    """Hashes of all prefixes of a word list, as sums of word * base**place modulo a prime."""

    def __init__(self, words: np.ndarray, base: int):
        self.powers = np.ones(len(words) + 1, np.int64)
        done, step = 1, base
        while done <= len(words):  # powers[done:] from powers[:done], which doubles what is there
            part = self.powers[done : 2 * done]
            part[:] = self.powers[: len(part)] * step % _PRIME
            done, step = 2 * done, step * step % _PRIME
        terms = (words + 1) % _PRIME * self.powers[:-1] % _PRIME
        self.sums = np.concatenate(([0], np.cumsum(terms))) % _PRIME

    def equal(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the `length` words from `at` are those a period later, by their hashes."""
        one = self.sums[at + length] - self.sums[at]
        two = self.sums[at + period + length] - self.sums[at + period]
        return (one * self.powers[period] - two) % _PRIME == 0

    def extend(self, at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from `at` on, or before it, are those a period later: all pairs halve their range in each step."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            same = self.equal(at - middle if back else at, period, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low


def _pairs(n: int, size: int):
    """Grid points and periods of all pairs (i, i + p) of n words, i a multiple of p and p up to n / 2, about `size` of them at a time."""
    periods = np.arange(1, n // 2 + 1)
    ends = np.cumsum((n - 1) // periods)
    for first in range(0, int(ends[-1]), size):
        last = min(first + size, int(ends[-1]))
        low, high = np.searchsorted(ends, [first, last - 1], side="right")
        own = periods[low : high + 1]
        from_ = np.maximum(np.concatenate(([ends[low - 1] if low else 0], ends[low:high])), first)
        till = np.minimum(ends[low : high + 1], last)
        starts = ends[low : high + 1] - (n - 1) // own  # the number of a period's first pair
        p = np.repeat(own, till - from_)
        yield (np.arange(first, last) - np.repeat(starts, till - from_)) * p, p


def _candidates(words: np.ndarray, least: int, base: int, size: int) -> np.ndarray | None:
    """Rows (start, end, period) of what the hashes show, one a stretch; None where they contradict each other."""
    n, prefixes, found = len(words), _Prefixes(words, base), []
    for i, p in _pairs(n, size):
        near = (words[i] == words[i + p]) | (words[i - 1] == words[i + p - 1])
        i, p = i[near], p[near]
        half = (np.maximum(p, least - p) + 1) >> 1  # one of the two extensions has half of what is needed
        ahead, behind = i + p + half <= n, i >= half
        ahead[ahead] = prefixes.equal(i[ahead], p[ahead], half[ahead])
        behind[behind] = prefixes.equal((i - half)[behind], p[behind], half[behind])
        near = ahead | behind
        i, p = i[near], p[near]
        if len(i):
            start, end = i - prefixes.extend(i, p, i, True), i + p + prefixes.extend(i, p, n - i - p, False)
            whole = end - start >= np.maximum(2 * p, least)
            found.append(np.unique(np.stack([start, end, p], 1)[whole], axis=0))
    if not found:
        return np.empty((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)  # by start, end and period
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    smallest = rows[first][np.cumsum(first) - 1, 2] if len(rows) else rows[:, 2]
    # of one stretch with several periods, all are multiples of the smallest, unless a hash has lied
    return rows[first] if (rows[:, 2] % smallest == 0).all() else None


def find_runs(words: np.ndarray, least: int = 12, size: int = PAIRS, bases=(48_271, 69_621, 39_373, 630_360_016)) -> np.ndarray:
    """All runs of a list of word numbers, as rows (start, length, period) by start, then period."""
    if len(words) < max(least, 2):
        return np.empty((0, 3), np.int64)
    for base in [*bases, None]:
        if base is None:
            raise ArithmeticError("hashes of every base collide")
        rows = _candidates(words, least, base, size)
        if rows is not None and all(np.array_equal(words[s : e - p], words[s + p : e]) for s, e, p in rows.tolist()):
            break
    rows[:, 1] -= rows[:, 0]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def split(text: bytes) -> list[bytes]:
    r"""The words [^\x20\x09-\x0D]+ of UTF-8: bytes know no other white space."""
    return text.split()


def find(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    r"""docs with n_words, runs (start, length, period; words are numbered from 0; by start, then period) and collapsed_text: the words that no run
    holds after its first period, joined by one space.

    Words are [^\x20\x09-\x0D]+ and are compared as they are. A null or empty text, or one of white space alone, has no words, no runs and an empty
    collapsed_text. A run's period is its smallest; equal rows give equal results; texts of any length are searched whole, in memory that grows with
    their words (some 60 bytes a word), not with their pairs. Columns of docs with the results' names are replaced, all others stay. No rows
    give no rows. Nothing is shuffled.
    """

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            lengths, offsets, runs, left = [], [0], [], []
            for t in texts.cast(pa.binary()).to_pylist():
                words, numbers = split(t), defaultdict(count().__next__)
                own = find_runs(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), least)
                if len(own):
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, own[:, 0] + own[:, 2], 1)
                    np.add.at(edge, own[:, 0] + own[:, 1], -1)
                    words_left = compress(words, (np.cumsum(edge[:-1]) == 0).tolist())
                else:
                    words_left = words
                lengths.append(len(words))
                offsets.append(offsets[-1] + len(own))
                runs.append(own)
                left.append(b" ".join(words_left))
            rows = np.concatenate([np.empty((0, 3), np.int64), *runs])
            fields = [pa.field(c, pa.int64(), False) for c in RUN.names]
            of = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=fields)
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), of, type=pa.list_(pa.field("element", of.type, False)))
            return [pa.array(lengths, pa.int64()), listed, pa.array(left, pa.binary()).cast(pa.string())]

        return work

    return map_texts(docs, text, FIELDS, make)
