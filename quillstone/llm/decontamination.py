"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Training texts stream through the automaton, which gives the longest match that ends at each word. A match of
`window` words of an item, or of the whole of a shorter item, is a hit: its words are marked, its item noted.
Before that, numpy drops all words that no item has beside the word before them, so that only stretches that
could hold a hit are streamed in Python; hashes of 64 bits stand for words.

Edge cases: a null or empty text has no words and is clean; an item that is null or has no words takes no part;
an item whose id is null marks words but isn't counted; items of equal id count once; repeated items and repeated
texts each get their own result. Input columns stay; a result column replaces one of its name.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import SuffixAutomaton
from .common import held, map_texts, stored, without
from .words import Words, runs, words

_SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "word", "word_end")])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(_SPAN)),
]


def _pairs(h: np.ndarray) -> np.ndarray:
    return h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]


class Items:
    """The automaton of some items and what ends in its states."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int):
        found = words(pa.array([t for _, t in rows], pa.string()))
        self.known, ids = np.unique(found.hash, return_inverse=True)
        first = found.first
        sequences = [ids[first[i] : first[i + 1]].tolist() for i in range(len(rows))]
        same = found.doc[1:] == found.doc[:-1]
        self.pairs = np.unique(_pairs(found.hash)[same]) if len(found.hash) > 1 else np.zeros(0, np.uint64)
        self.automaton = SuffixAutomaton(s for s in sequences if s)
        #: By length and state: the items that have this window.
        self.windows: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        for (item, _), s in zip(rows, sequences, strict=True):
            n = min(window, len(s))
            for i in range(len(s) - n + 1 if n else 0):
                self.windows[n][self.automaton.walk(s[i : i + n])] |= {item} - {None}
        self.lengths = sorted(self.windows)

    def hits(self, found: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the items by text."""
        hit, items = np.zeros(len(found.hash), bool), defaultdict(set)
        if not self.lengths or not len(found.hash):
            return hit, items
        place = np.minimum(np.searchsorted(self.known, found.hash), len(self.known) - 1)
        known = self.known[place] == found.hash
        least = self.lengths[0]
        if least > 1:
            joined = known[:-1] & known[1:] & (found.doc[1:] == found.doc[:-1])
            at = np.flatnonzero(joined)
            joined[at] = np.isin(_pairs(found.hash)[at], self.pairs)
            first, last = runs(joined)
            last = last + 1
        else:  # stretches of one text, as a match doesn't go on in the next
            first, last = runs(known)
            cut = np.flatnonzero(np.diff(found.doc) > 0) + 1
            cut = cut[known[cut] & known[cut - 1]]
            first, last = np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([last, cut]))
        wide = last - first >= least
        step, suffix = self.automaton.step, self.automaton.suffix
        for a, b in zip(first[wide].tolist(), last[wide].tolist(), strict=True):
            state = matched = 0
            for i, c in enumerate(place[a:b].tolist(), a + 1):
                state, matched = step(state, matched, c)
                for n in self.lengths:
                    if n > matched:
                        break
                    if (of := self.windows[n].get(suffix(state, n))) is not None:
                        hit[i - n : i] = True
                        items[int(found.doc[a])] |= of
        return hit, items


def _spans(found: Words, hit: np.ndarray, doc: int, first: np.ndarray) -> list[dict]:
    """Runs of hit words of a text, by code point and by word."""
    a, b = int(first[doc]), int(first[doc + 1])
    out, chars, at = [], 0, int(found.offsets[doc])
    for i, j in zip(*(x.tolist() for x in runs(hit[a:b])), strict=True):
        x, y = int(found.start[a + i]), int(found.end[a + j - 1])
        begin = chars + len(found.data[at:x].tobytes().decode())
        chars, at = begin + len(found.data[x:y].tobytes().decode()), y
        out.append({"start": begin, "end": chars, "word": i, "word_end": j})
    return out


def _pass(docs: DataFrame, rows: list[tuple[str | None, str]], window: int, text: str) -> DataFrame:
    span = pa.list_(pa.struct([(f.name, pa.int64()) for f in _SPAN]))

    key = ("items", window, hash(tuple(rows)))

    def make():
        model = held(key, lambda: Items(rows, window))

        def work(texts: pa.Array) -> list[pa.Array]:
            found = words(texts)
            hit, items = model.hits(found)
            first, some = found.first, set(found.doc[hit].tolist())
            return [
                pa.array(np.diff(first).astype(np.int64)),
                pa.array([sorted(items.get(d, ())) for d in range(len(texts))], pa.list_(pa.string())),
                pa.array([_spans(found, hit, d, first) if d in some else [] for d in range(len(texts))], span),
            ]

        return work

    return map_texts(docs, text, FIELDS, make, keeps=True)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """docs with FIELDS: words, ids of hit items as text, and runs of hit words, by code point and by word.

    The items go to every task in blocks of about block_chars characters, so that what is broadcast and what a worker
    holds has a bound; each further block is another pass over the texts, whose hits join those before and are stored.
    A worker makes a block's automaton once.
    """
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null")
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("t"))).first()[0] or 0) / block_chars))
    out = without(docs, [f.name for f in FIELDS])
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = sorted(((r.i, r.t) for r in own.collect()), key=lambda r: (r[0] or "", r[1]))
        if k:
            out = out.withColumnsRenamed({"hit_items": "__q_items", "hit_spans": "__q_spans"})
        out = _pass(out, rows, window, text)
        if k:
            out = out.withColumns({"hit_items": F.array_sort(F.array_union("__q_items", "hit_items")), "hit_spans": _joined(F.array_sort(F.concat("__q_spans", "hit_spans")))}).drop("__q_items", "__q_spans")
        if k < blocks - 1:
            out = stored(out, "hits")
    return out


def _joined(spans):
    """Sorted spans, those that overlap or follow word on word made one."""

    def add(done, s):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["word"].alias("word"), F.greatest(last["word_end"], s["word_end"]).alias("word_end"))
        return F.when(F.size(done) == 0, F.array(s)).when(s["word"] > last["word_end"], F.concat(done, F.array(s))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)))

    return F.aggregate(spans, F.expr("cast(array() as array<struct<start:bigint,end:bigint,word:bigint,word_end:bigint>>)"), add)


def clean(hits: DataFrame, max_coverage: float = 0.5, text: str = "text") -> DataFrame:
    """The result of find_hits with `n_hit` (hit words), `contaminated`, `coverage` (share of hit words), `clean_text` (without the hit spans) and `keep` (coverage at most max_coverage)."""
    kept = F.aggregate(
        "hit_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["out"], F.col(f"`{text}`").substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).alias("out"), s["end"].alias("at")),
        lambda a: F.concat(a["out"], F.col(f"`{text}`").substr((a["at"] + 1).cast("int"), F.length(f"`{text}`"))),
    )
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["word_end"] - s["word"])
    base = without(hits, ["n_hit", "contaminated", "coverage", "clean_text", "keep"]).withColumn("n_hit", n_hit)
    coverage = F.when(F.col("n_words") > 0, F.col("n_hit") / F.col("n_words")).otherwise(F.lit(0.0))
    return base.select("*", (F.col("n_hit") > 0).alias("contaminated"), coverage.alias("coverage"), F.when(F.col("n_hit") > 0, kept).otherwise(F.col(f"`{text}`")).alias("clean_text"), (coverage <= max_coverage).alias("keep"))
