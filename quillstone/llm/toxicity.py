"""Toxicity from subword-bag embeddings, averaged into a linear softmax and trained with them, in numpy.

A word is its character n-grams (3 to 5 code points, with marks at both ends) and itself, hashed to `buckets`
vectors; a window of words is the mean of its words' means. Vectors and softmax are trained together. Insults
share a long text with much else, so that a text is as toxic as its worst window of ten words in a row, wherever it
begins. Training cuts texts into tiles of ten words, starts from all tiles of a text and goes on with the highest one. As the softmax is linear in the vectors, scoring needs one number for
each bucket, and that is all that goes to the tasks.

The model is fitted on a bounded sample: `per_class` labelled documents of either class at most, in order of a
hash of the id, those of up to `max_chars` characters first. Where these are too few longer ones follow, of which the first
10 * `max_chars` characters count, until the class has per_class * max_chars / 2 characters. A fifth of it, by another hash, isn't trained on but calibrates
scale and bias, so that 0.5 is where either label is as likely.

Edge cases: null and empty texts, and texts without words, get the score of the bias alone, 0 at most 0.5; equal
texts get equal scores; labels that are null teach nothing; repeated labels of a document count as often; without
labels of both classes the score is 0 for all. Input columns stay; a result column replaces one of its name.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_by_hash, map_texts
from .words import Words, mix, words

WINDOW = 10
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def subwords(found: Words, which: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of these words, and where each word's begin (and the last's end)."""
    texts = [b"<%s>" % found.text(i) for i in which.tolist()]
    codes = np.frombuffer(b"".join(texts).decode().encode("utf-32-le"), "<u4").astype(np.uint64)
    left = np.flatnonzero(codes == ord("<"))  # no word has one
    ends = np.append(left[1:], len(codes))
    size = ends - left
    word = np.repeat(np.arange(len(size)), size)
    room = np.repeat(ends, size) - np.arange(len(codes))
    owners, hashes = [np.arange(len(size))], [found.hash[which]]
    for n in (3, 4, 5):
        at = np.flatnonzero(room >= n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[at + j]
        owners.append(word[at])
        hashes.append(mix(h))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(hashes)[order] % np.uint64(buckets)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(size) + 1))


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each word, numbered over the batch, and the text of each window: tiles of size words from a text's first."""
    at = np.arange(len(found.hash)) - found.first[:-1][found.doc]
    new = (at % size == 0)
    return np.cumsum(new) - 1, found.doc[new]


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))

    def logits(self, texts: pa.Array) -> np.ndarray:
        found = words(texts)
        worst = np.full(len(texts), -np.inf)
        if len(found.hash):
            _, which, inverse = np.unique(found.hash, return_index=True, return_inverse=True)
            buckets, begin = subwords(found, which, len(self.weight))
            of_word = np.add.reduceat(self.weight[buckets].astype(np.float64), begin[:-1]) / np.diff(begin)
            upto = np.concatenate(([0.0], np.cumsum(of_word[inverse])))
            first = found.first
            end = first[1:][found.doc]  # a window begins at each word that leaves room, or at a shorter text's first
            at = np.arange(len(end))
            at = at[(at + WINDOW <= end) | (at == first[:-1][found.doc])]
            to = np.minimum(at + WINDOW, end[at])
            begin = np.flatnonzero(np.diff(found.doc[at], prepend=-1))
            worst[found.doc[at][begin]] = np.maximum.reduceat((upto[to] - upto[at]) / (to - at), begin)
        worst[np.isinf(worst)] = min(0.0, -self.bias - 1e-9)
        return worst + self.bias


def calibrate(model: Model, texts: list[str], toxic: list[int], share: float) -> Model:
    """The model with its scale and bias fitted by logistic regression on texts it wasn't trained on; share: of toxic texts among all."""
    y, z = np.array(toxic, float), np.concatenate([model.logits(pa.array(texts[i : i + 256], pa.string())) for i in range(0, len(texts), 256)] or [np.zeros(0)])
    if len(set(toxic)) < 2:
        return model
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    z, y, weight = np.append(z, model.bias), np.append(y, 0), np.append(weight, 0.02 * weight.sum())  # words that nothing is known of
    x, at = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
    for _ in range(50):  # Newton's steps, held back by a weak prior on the scale and a limit on each step
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (weight * (p - y)) + [0.5 * (at[0] - 1), 0.01 * at[1]]
        hessian = (x.T * (weight * p * (1 - p))) @ x + np.diag([0.5, 0.01])
        at = at - np.clip(np.linalg.solve(hessian, grad), -0.5, 0.5)
    at[0] = max(at[0], 0.05)
    return Model((model.weight * at[0]).astype(np.float32), float(model.bias * at[0] + at[1]))


def _vocabulary(texts: list[str], buckets: int, at_once: int = 128) -> tuple[np.ndarray, ...]:
    """Of all texts, a few at a time: subwords of distinct words and how many each has; each word's place among them, its window, and each window's text."""
    known, sub, n_sub, own, window, doc, n_windows = np.zeros(0, np.uint64), [], [], [], [], [], 0
    for i in range(0, len(texts), at_once):
        found = words(pa.array(texts[i : i + at_once], pa.string()))
        new, which = np.unique(found.hash, return_index=True)
        place = np.minimum(np.searchsorted(known, new), max(len(known) - 1, 0))
        fresh = known[place] != new if len(known) else np.ones(len(new), bool)
        if fresh.any():
            b, begin = subwords(found, which[fresh], buckets)
            at = np.searchsorted(known, new[fresh])
            sub.append(b.astype(np.int32))
            n_sub.append(np.stack([new[fresh].view(np.int64), np.diff(begin)], 1))
            known = np.insert(known, at, new[fresh])
        w, d = windows(found, WINDOW)
        own.append(found.hash)
        window.append((w + n_windows).astype(np.int32))
        doc.append((d + i).astype(np.int32))
        n_windows += len(d)
    came = np.concatenate(n_sub) if n_sub else np.zeros((0, 2), np.int64)
    order = np.argsort(came[:, 0].view(np.uint64), kind="stable")
    hashes = came[order, 0].view(np.uint64)
    all_own = np.concatenate([np.searchsorted(hashes, h).astype(np.int32) for h in own] or [np.zeros(0, np.int32)])
    come = order.astype(np.int32)[all_own]  # words are numbered as they came, as their subwords are
    return np.concatenate(sub or [np.zeros(0, np.int32)]), came[:, 1].astype(np.int32), come, np.concatenate(window or [np.zeros(0, np.int32)]), np.concatenate(doc or [np.zeros(0, np.int32)])


def fit(texts: list[str], toxic: list[int], buckets: int = 1 << 17, dim: int = 8, epochs: int = 14, batch: int = 256, rate: float = 0.3, seed: int = 1) -> Model:
    y = np.array(toxic, np.int64)
    if len(set(toxic)) < 2:
        return Model(np.zeros(buckets, np.float32), -30.0)
    rng = np.random.default_rng(seed)
    sub, n_sub, inverse, window, doc = _vocabulary(texts, buckets)
    begin = np.concatenate(([0], np.cumsum(n_sub)))
    first = np.searchsorted(window, np.arange(len(doc) + 1))
    n_words = np.diff(first)
    vectors = rng.uniform(-0.05 / dim, 0.05 / dim, (buckets, dim)).astype(np.float32)
    out = rng.uniform(-0.5, 0.5, (2, dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares, out_squares, bias_squares = np.full((buckets, dim), 1e-6, np.float32), np.full((2, dim), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for epoch in range(epochs):
        if epoch < 2:
            chosen = np.flatnonzero(rng.random(len(doc)) < 8 / np.maximum(8, np.bincount(doc, minlength=len(y))[doc]))
        else:
            u = vectors @ (out[1] - out[0])
            mean = np.bincount(window, (np.add.reduceat(u[sub], begin[:-1]) / n_sub)[inverse]) / n_words
            order = np.lexsort((-mean, doc))
            top = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
            some = np.flatnonzero((y[doc] == 0) & (rng.random(len(doc)) < 1 / np.bincount(doc, minlength=len(y))[doc]))
            chosen = np.concatenate([top, some])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), batch):
            w = chosen[i : i + batch]
            token_of = np.repeat(np.arange(len(w)), n_words[w])
            tokens = inverse[np.arange(len(token_of)) - np.repeat(np.cumsum(n_words[w]) - n_words[w], n_words[w]) + np.repeat(first[w], n_words[w])]
            k = n_sub[tokens]
            flat = sub[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[tokens], k)]
            row = np.repeat(token_of, k)
            share = np.repeat((1 / (k * n_words[w][token_of])).astype(np.float32), k)
            used, local = np.unique(flat, return_inverse=True)
            v = vectors[used]
            h = np.stack([np.bincount(row, v[local, d] * share, len(w)) for d in range(dim)], 1)
            z = h @ out.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(w)), y[doc[w]]] -= 1
            back = (p @ out).astype(np.float32)
            grad = np.stack([np.bincount(local, back[row, d] * share, len(used)) for d in range(dim)], 1).astype(np.float32)
            squares[used] += grad**2
            vectors[used] -= rate * grad / np.sqrt(squares[used])
            g, gb = (p.T @ h / len(w)).astype(np.float32), p.mean(0).astype(np.float32)
            # a tenth as many windows of words that nothing is known of: they aren't toxic, which the bias has to say
            blank = 1 / (1 + np.exp(bias[0] - bias[1]))
            gb += 0.1 * np.array([-blank, blank], np.float32)
            out_squares += g**2
            out -= rate * 0.3 * g / np.sqrt(out_squares)
            bias_squares += gb**2
            bias -= rate * 0.3 * gb / np.sqrt(bias_squares)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", per_class: int = 2500, max_chars: int = 10_000, **how) -> Model:
    """A model of the rows where learn holds. Ids and labels of the sample are chosen without the texts, in order of a hash of the id, and only its texts are sent then, one for each id."""
    texts = docs.where(learn).select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    known = labels.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1)")
    known = texts.select("d", F.length("t").alias("n")).join(known, "d")
    short = F.col("n").between(1, max_chars)
    counts = {r.y: r for r in known.groupBy("y").agg(F.count("*").alias("all"), F.count_if(short).alias("short"), F.count_if(F.col("n") > max_chars).alias("long")).collect()}
    chosen = []
    for y, c in counts.items():
        of_class = known.where(F.col("y") == y).select("d", "y", "n")
        own = first_by_hash(of_class.where(short), F.col("d"), per_class)
        if len(own) < per_class and c.long:
            own += first_by_hash(of_class.where(F.col("n") > max_chars), F.col("d"), per_class - len(own))
        size = 0
        for r in own:
            if r.n > max_chars and size > per_class * max_chars // 2:
                break
            size += min(r.n, 10 * max_chars)
            chosen.append((r.d, r.y))
    ids = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("d", texts.schema["d"].dataType), T.StructField("y", T.IntegerType())]))
    # 2 * per_class ids at most, and one text of each
    rows = texts.join(F.broadcast(ids.distinct()), "d").where(F.length("t") > 0).groupBy("d", "y").agg(F.min(F.substring("t", 1, 10 * max_chars)).alias("t")).select("t", "y").collect()
    rows.sort(key=lambda r: (zlib.crc32(r.t.encode()), r.t, r.y))
    held = [zlib.crc32(r.t.encode()) % 5 == 4 for r in rows]
    part = lambda which: ([r.t for r, h in zip(rows, held, strict=True) if h == which], [r.y for r, h in zip(rows, held, strict=True) if h == which])
    return calibrate(fit(*part(False), **how), *part(True), sum(c["all"] for y, c in counts.items() if y) / max(1, sum(c["all"] for c in counts.values())))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score and predicted."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            s = model.scores(texts)
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

        return work

    return map_texts(docs, text, FIELDS, make)
