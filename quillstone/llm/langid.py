"""Language identification by cross-parsing entropy.

Labelled text of each language, letters in lower case and all else as single gaps, goes into a suffix automaton. A
text is parsed against each automaton into phrases, each the longest that occurs in the language's text; the
language with the lowest c * log2(n) / m wins, c being the phrases, n the length of the language's text and m that
of the parsed one. Automata become one sparse table: a transition is in the slot of its state plus its symbol, and the
slot names the state, so that numpy takes a step of many texts and all languages at once and the number of letters
doesn't matter. Phrases end every `LANE` symbols, for all languages alike, which keeps long texts from holding up the others.

The model is a bounded sample: about `chars` characters a language, or an equal share of `total` where there are more than
total / chars languages, of which none is left out up to `languages`; of different texts in order of a hash of them. The beginnings of long
texts come after the others, where these are few. All letters of the sample are symbols.

Edge cases: a null text or one without a letter is `und`, score 0; of equal entropies the first language in order
wins; letters that a language's text lacks are phrases of their own; without labelled text all is `und`. Input
columns stay; a result column replaces one of its name.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import SuffixAutomaton
from .common import hash_limit, held, map_texts

LANE = 512
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
_letters: list[np.ndarray] = []


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")


def is_letter() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _joined(symbols: np.ndarray) -> np.ndarray:
    """Without gaps that follow gaps."""
    gap = symbols == 0
    return symbols[~(gap & np.concatenate(([False], gap[:-1])))] if len(symbols) else symbols


def _places(rows: list[list[int]]) -> list[int]:
    """For each row of ascending symbols a place, no two the same, so that no two rows' place plus symbol are."""
    width = max((r[-1] for r in rows), default=0) + 1
    slots = bytearray(4 * sum(map(len, rows)) + 2 * width)
    taken, begin, out = bytearray(len(slots)), {}, [0] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: -len(rows[i])):
        row = rows[i]
        f = begin.get(len(row), 0)
        while True:
            f = slots.find(0, f)
            if f < 0 or f + width > len(slots):
                more = bytearray(len(slots) + width)
                slots, taken, f = slots + more, taken + more, max(f, 0) if f >= 0 else len(slots)
            at = f - row[0]
            if at >= 0 and not taken[at] and not any(slots[at + c] for c in row):
                break
            f += 1
        taken[at], out[i], begin[len(row)] = 1, at, f
        for c in row:
            slots[at + c] = 1
    return out


class CrossParser:
    """A table of the languages' automata, on the symbols 0 for gaps, 1 for letters that no language has, then letters."""

    def __init__(self, sample: dict[str, list[str]]):
        self.languages = sorted(sample)
        alpha, seen = is_letter(), set()
        for texts in sample.values():
            for t in texts:
                seen.update(np.unique(_code_points(t)).tolist())
        known = sorted(c for c in seen if alpha[c])
        width = 2 + len(known)
        self.symbol = np.where(alpha, 1, 0).astype(np.min_scalar_type(width - 1))
        self.symbol[known] = np.arange(2, width)
        tables, self.bits, base = [], [], 1  # state 0: no transition begins there
        self.begin = np.zeros((len(self.languages), width), np.int64)  # the state after a phrase's first symbol
        for j, language in enumerate(self.languages):
            parts = [_joined(self.symbol[_code_points(t)]).tolist() for t in sample[language]]
            of = SuffixAutomaton(parts)
            states = [s for s, step in enumerate(of.next) if step]
            rows = [sorted(of.next[s]) for s in states]
            place = np.zeros(len(of.next), np.int64)
            place[states] = np.array(_places(rows), np.int64) + base
            sizes = np.array([len(r) for r in rows], np.int64)
            symbols = np.array([c for r in rows for c in r], np.int64)
            to = place[np.array([of.next[s][c] for s, r in zip(states, rows) for c in r], np.int64)]
            own = np.repeat(place[states], sizes)
            table = np.zeros((int(own.max()) if len(own) else base) - base + width, np.int64)
            table[own + symbols - base] = own << 32 | to
            first = own == place[0]
            self.begin[j, symbols[first]] = to[first]
            tables.append(table)
            self.bits.append(np.log2(max(sum(map(len, parts)), 2)))
            base += len(table)
        self.table = np.concatenate([np.zeros(1, np.int64), *tables, np.zeros(width, np.int64)])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text of symbols, by language."""
        lanes = [(i, t[k : k + LANE]) for i, t in enumerate(texts) for k in range(0, len(t), LANE)]
        lanes.sort(key=lambda x: -len(x[1]))
        size = np.array([len(x) for _, x in lanes])
        symbols = np.zeros((LANE, len(lanes)), self.symbol.dtype)
        for j, (_, x) in enumerate(lanes):
            symbols[: len(x), j] = x
        active = len(lanes) - np.searchsorted(size[::-1], np.arange(LANE), "right")
        state = np.zeros((len(self.languages), len(lanes)), np.int64)
        count = np.zeros((len(self.languages), len(lanes)), np.int32)
        for t in range(LANE):
            k = active[t]
            if not k:
                break
            c = symbols[t, :k]
            step = self.table.take(state[:, :k] + c)
            broken = (step >> 32 != state[:, :k]) | (state[:, :k] == 0)  # where a phrase ended
            count[:, :k] += broken
            state[:, :k] = np.where(broken, self.begin.take(c, 1), step & 0xFFFFFFFF)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        np.add.at(out, np.array([i for i, _ in lanes], np.int64), count.T)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        symbols = [_joined(self.symbol[_code_points(t)]) for t in texts]
        lettered = np.array([bool(len(s)) and bool(s.any()) for s in symbols])
        pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if self.languages and lettered.any():
            at = np.flatnonzero(lettered)
            entropy = self.phrases([symbols[i] for i in at]) * np.array(self.bits) / np.array([len(symbols[i]) for i in at])[:, None]
            best = entropy.argmin(1)
            pred[at] = np.array(self.languages, object)[best]
            rest = np.partition(entropy, 1, axis=1)[:, 1] if len(self.languages) > 1 else np.inf
            score[at] = 1 - entropy.min(1) / rest
        return pred.tolist(), score


def sample(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", chars: int = 40_000, longest: int = 8_000, per_language: int = 60, total: int = 4_000_000, languages: int = 4_000) -> dict[str, list[str]]:
    """Labelled texts, `per_language` different ones of each language in order of a hash, cut off after about `chars` in all: whole ones of at most `longest` characters, and if they are too few the first `longest` of longer ones.

    No more than `total` characters in all: where languages are many their shares are smaller, and no text of theirs is longer than a share. Of more than
    `languages` values of lang, those with the most texts are learned."""
    own = docs.where(learn).select(F.col(f"`{lang}`").alias("l"), F.col(f"`{text}`").alias("t")).where("l is not null and l <> 'und'").where(F.length("t") > 0)
    own = own.select("l", (F.length("t") > longest).alias("cut"), F.substring("t", 1, longest).alias("t")).withColumn("h", F.xxhash64("t"))
    # copies share a hash: n rows, d different whole texts and e beginnings
    counts = own.groupBy("l", "cut", "h").agg(F.count("*").alias("n")).groupBy("l").agg(F.sum("n").alias("n"), F.count_if(~F.col("cut")).alias("d"), F.count_if("cut").alias("e")).orderBy(F.desc("n"), "l").limit(languages).collect()
    if not counts:
        return {}
    counts.sort()
    chars = min(chars, total // len(counts))
    if chars < longest:
        own = own.withColumn("t", F.substring("t", 1, chars))

    def first(near: DataFrame) -> list:
        order = Window.partitionBy("l").orderBy("cut", "h", "t")
        ranked = near.dropDuplicates(["l", "cut", "h", "t"]).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
        before = F.coalesce(F.sum(F.length("t")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return ranked.withColumn("before", before).where(F.col("before") < chars).select("l", "k", "t").collect()

    # the first of each language by hash; rows whose hash is too high to be among them go before anything moves
    limits = [(c.l, hash_limit(per_language, c.d) if c.d else None, hash_limit(per_language, c.e) if c.e and c.d < per_language else None) for c in counts]
    known = docs.sparkSession.createDataFrame(limits, "l string, whole long, part long")  # a row a language
    rows = first(own.join(F.broadcast(known), "l").where(F.col("h") <= F.when(F.col("cut"), F.col("part")).otherwise(F.col("whole"))).select(*own.columns))
    got = Counter(r.l for r in rows)
    size = Counter()
    for r in rows:
        size[r.l] += len(r.t)
    short = [c.l for c in counts if got[c.l] < min(per_language, c.d + c.e) and size[c.l] < chars]  # where hashes are very uneven
    if short:
        rows = [r for r in rows if r.l not in short] + first(own.where(F.col("l").isin(short)))
    rows.sort()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.l, []).append(r.t)
    return out


def identify(docs: DataFrame, model: dict[str, list[str]], text: str = "text") -> DataFrame:
    """docs with lang_pred and score: how far the best entropy is below the next one, 0 to 1."""

    def make():
        key = hash(tuple((k, *v) for k, v in sorted(model.items())))
        parser = held(("languages", key), lambda: CrossParser(model))

        def work(texts: pa.Array) -> list[pa.Array]:
            pred, score = parser.predict(texts.to_pylist())
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64())]

        return work

    return map_texts(docs, text, FIELDS, make, max_bytes=4 << 20, keeps=True)
