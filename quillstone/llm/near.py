"""N-gram Jaccard join: MinHash values compared step by step, Bayesian pruning of pairs, exact verification.

A document's set is that of its word 5-grams; one of fewer words has a single gram, all its words. Documents with
equal sets are copies and go on as one, the smallest id. Bands of MinHash values link those that share one to the
smallest id of the band (as many rows as members, however large a band is), and connected ones come together in
groups. Members' sets are stored once; a group's pairs are compared in blocks of bounded size, each pair of blocks its own
task's work: after every
16 MinHash values, pairs go whose posterior probability of reaching the threshold (uniform prior) is below the
tolerance; what is left is verified on the sets themselves. Only counts and links to a block's smallest connected id
leave a block, so that a group of n near copies makes no n * n rows.

With 32 bands of 4 values, a pair at the threshold of 0.8 shares none with a probability of 5e-8.

Edge cases: texts without words, null ones too, have no copies and no links; rows without an id get a null class and no
links; rows that share an id count one by one, and of those whose grams are equal too keep_one keeps one; long texts count in full. Input columns beside
id and text are left out of the result, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, release, ship, stored, whole_ids
from .words import Words, mix, words

BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
_SEEDS = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)).reshape(2, VALUES)
_SEEDS[1] |= np.uint64(1)


def grams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-grams, repeated ones too, and where each text's begin (and the last ends)."""
    first = found.first
    size = np.diff(first)
    count = np.where(size == 0, 0, np.maximum(size - n + 1, 1))
    begin = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    short = np.repeat(np.minimum(size, n), count)
    h = np.full(len(at), 7, np.uint64)
    for j in range(n):
        inside = j < short
        h[inside] = h[inside] * np.uint64(0x9E3779B97F4A7C15) + found.hash[at[inside] + j]
    return mix(h + short.astype(np.uint64)), begin


def signatures(gram: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of 16 bits for each text with grams."""
    starts = begin[:-1][np.diff(begin) > 0]
    out = np.empty((len(starts), VALUES), "<u2")
    for k in range(VALUES):
        least = np.minimum.reduceat((gram ^ _SEEDS[0, k]) * _SEEDS[1, k], starts)
        out[:, k] = (mix(least) >> np.uint64(48)).astype("<u2")
    return out


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def least_matches(threshold: float, tolerance: float, step: int) -> list[int]:
    """After each step of values, how many must be equal for the posterior P(J >= threshold) to be tolerance or more.

    With a uniform prior, m of n equal values give a Beta(m + 1, n - m + 1) posterior, whose tail beyond the
    threshold t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(step, VALUES + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


STEP = 16


def candidates(left: np.ndarray, right: np.ndarray | None, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of signatures that no step dropped; within left where right is None, the first row the smaller index."""
    rows, columns = [], []
    other = left if right is None else right
    for a in range(0, len(left), 128):
        part = left[a : a + 128]
        b = a if right is None else 0
        equal = np.zeros((len(part), len(other) - b), np.uint8)
        for k in range(STEP):
            equal += part[:, k, None] == other[None, b:, k]
        i, j = np.nonzero(equal >= need[0])
        if right is None:
            i, j = i[j > i], j[j > i]
        matched = equal[i, j].astype(np.int16)
        i, j = i + a, j + b
        for s in range(1, len(need)):
            if not len(i):
                break
            cut = slice(s * STEP, (s + 1) * STEP)
            matched = matched + (left[i, cut] == other[j, cut]).sum(1)
            keep = matched >= need[s]
            i, j, matched = i[keep], j[keep], matched[keep]
        rows.append(i)
        columns.append(j)
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(columns or [np.zeros(0, np.int64)])


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets (sorted hashes) have a Jaccard similarity of threshold or more. i must be sorted."""
    size = np.array([len(s) for s in sets])
    flat, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(size)))
    mark, common = np.zeros(len(flat), bool), np.zeros(len(i), np.int64)
    edges = np.flatnonzero(np.diff(i, prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(i)], strict=True):
        own = ids[begin[i[a]] : begin[i[a] + 1]]
        mark[own] = True
        for c in range(a, b, 512):
            js = j[c : min(b, c + 512)]
            k = size[js]
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[js], k)
            common[c : c + len(js)] = np.add.reduceat(mark[ids[at]].astype(np.int64), np.cumsum(k) - k)
        mark[own] = False
    return common >= threshold * (size[i] + size[j] - common) - 1e-9


def _compare(block: list[dict], threshold: float, need: list[int]) -> list[tuple[int, int, int]]:
    """Of a pair of blocks: each document, the smallest id that it is connected with here, and how many documents it links to."""
    seen, keep = set(), []
    for k, row in enumerate(block):
        if (key := (row["doc"], row["digest"])) not in seen:
            seen.add(key)
            keep.append(k)
    first, second = block[0]["i"], block[0]["j"]
    keep.sort(key=lambda k: block[k]["own"] != first)
    rows = [block[k] for k in keep]
    sets = [np.frombuffer(r["set"], "<u8") for r in rows]
    sig = np.stack([np.frombuffer(r["sig"], "<u2") for r in rows])
    cut = sum(r["own"] == first for r in rows)
    if first == second:
        i, j = candidates(sig, None, need)
    else:
        i, j = candidates(sig[:cut], sig[cut:], need)
        j = j + cut
    ids, copies = np.array([r["doc"] for r in rows]), np.array([r["copies"] for r in rows])
    size = np.array([len(s) for s in sets])
    close = (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9) & (ids[i] != ids[j])
    i, j = i[close], j[close]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    if len(i):
        good = verified(sets, i, j, threshold)
        i, j = i[good], j[good]
    links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
    root = ids.copy()
    while len(i):  # labels fall to the smallest id of what is connected
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, low[i])
        if (low == root).all():
            break
        root = low
    return list(zip(ids.tolist(), root.tolist(), links.astype(np.int64).tolist(), strict=True))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label, the smallest node connected with it, of undirected edges: labels of neighbours and labels of labels, until none falls. Each round is stored."""
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = stored(ends.union(ends.select("y", "x")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("label"), F.lit(1).alias("fell")), "labels")
    while labels.where("fell = 1").limit(1).count():
        known = labels.select(F.col("node").alias("y"), "label")
        near = both.join(known, "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("low"))
        new = labels.select("node", "label").join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        new = new.join(above, "label").select("node", F.least("label", "higher").alias("label"), "was")
        labels = stored(new.select("node", "label", (F.col("label") < F.col("was")).cast("int").alias("fell")), "labels")
    return labels.select("node", "label")


def join(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, text: str = "text", doc_id: str = "doc_id", block_docs: int = 512, block_grams: int = 1_000_000, digests: bool = False) -> DataFrame:
    """doc_id, class_id (the smallest id connected by links), n_links (other documents of this similarity, copies included), a row for each row of docs; with digests also digest (of the set of grams, null without one). Ids must be whole numbers (TypeError else)."""
    whole_ids(docs, doc_id)
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    fields = [T.StructField("grams", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())]

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            gram, begin = grams(words(texts), n)
            some = np.flatnonzero(np.diff(begin))
            sig = signatures(gram, begin) if len(some) else np.zeros((0, VALUES), "<u2")
            size, digest, held = [0] * len(texts), [None] * len(texts), [None] * len(texts)
            for k, s in zip(some.tolist(), sig, strict=True):
                distinct = np.unique(gram[begin[k] : begin[k + 1]])
                size[k], digest[k], held[k] = len(distinct), _digest(distinct), s.tobytes()
            return [pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(held, pa.binary())]

        return work

    kept = map_texts(own, "text", fields, make).select("doc", *(f.name for f in fields))
    signed = stored(kept, "signatures")
    alone = signed.where("doc is null or digest is null").select(F.col("doc").alias("doc_id"), F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "digest")
    sets = signed.where("doc is not null and digest is not null")
    reps = stored(sets.groupBy("digest", "sig", "grams").agg(F.min("doc").alias("doc"), F.count("*").alias("copies")), "sets")

    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), k -> xxhash64(k, substring(sig, {2 * ROWS} * k + 1, {2 * ROWS})))")
    bands = reps.select("doc", F.explode(keys).alias("band"))
    leaders = bands.groupBy("band").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).where("leader <> last").select("band", "leader")
    # a document's leaders, BANDS at most, all link to the least of them: what its neighbours' leaders have in common is one link
    led = bands.join(leaders, "band").groupBy("doc").agg(F.collect_set("leader").alias("leaders"))
    links = led.select(F.array_min("leaders").alias("a"), F.explode(F.array_union(F.array("doc"), "leaders")).alias("b")).where("a <> b").distinct()
    groups = components(links)

    members = reps.join(groups.withColumnRenamed("node", "doc"), "doc")
    sizes = members.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("grams") / block_grams)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))


    def make_sets():
        def work(texts: pa.Array) -> list[pa.Array]:
            gram, begin = grams(words(texts), n)
            sets = [np.unique(gram[x:y]) for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            return [pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), pa.array([_digest(s) for s in sets], pa.binary())]

        return work

    # a member's set is made once, however many blocks it meets; rows of equal id with another text fall away
    whole = dealt.join(own, "doc").select("doc", "copies", "digest", "sig", "label", "blocks", "own", "text")
    whole = map_texts(whole, "text", [T.StructField("set", T.BinaryType()), T.StructField("of", T.BinaryType())], make_sets)
    whole = stored(whole.where("of = digest").drop("text", "of"), "members")
    met = whole.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("doc", "copies", "digest", "sig", "set", "own", "label", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("blocks") > 1).alias("split"))
    need = least_matches(threshold, tolerance, STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        key, held = None, []
        out: list[tuple[int, int, int, bool]] = []

        def flush() -> None:
            if len(held) > 1:
                out.extend((*x, held[0]["split"]) for x in _compare(held, threshold, need))

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())], names=["doc", "root", "links", "split"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if (now := (row["label"], row["i"], row["j"])) != key:
                        flush()
                        key, held = now, []
                    held.append(row)
            if len(out) > 10_000:
                yield made()
        flush()
        yield made()

    results = stored(met.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(run, "doc long, root long, links long, split boolean"), "links")
    linked = results.groupBy("doc").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    over = components(results.where("split and doc <> root").select(F.col("doc").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("doc"), "label")
    classes = reps.select("doc", "digest", "copies").join(linked, "doc", "left").join(over, "doc", "left").groupBy("digest").agg(F.min(F.coalesce("label", "root", "doc")).alias("class_id"), F.min(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # stored, so that both sides of the join are dealt out for it and Spark can split a set that a third of all documents have
    return sets.select(F.col("doc").alias("doc_id"), "digest").join(stored(classes, "classes"), "digest").select("doc_id", "class_id", "n_links", "digest").unionByName(alone).drop(*([] if digests else ["digest"]))


def keep_one(docs: DataFrame, members: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """docs without all but the first document of each class. Of rows that share an id and their grams, the first in order of their columns stays; rows that share an id alone are judged apart. Rows without an id stay.

    members: what join gave for docs and n, with digests.
    """
    first_ones = members.where("doc_id = class_id").select(F.col("doc_id").alias(doc_id), "digest")
    own = docs.where(F.col(f"`{doc_id}`").isNotNull())
    repeated = stored(own.groupBy(doc_id).count().where("count > 1").select(doc_id), "repeated")
    once = own.join(first_ones.select(doc_id).distinct(), doc_id, "left_semi").join(repeated, doc_id, "left_anti").select(*docs.columns)

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            gram, begin = grams(words(texts), n)
            return [pa.array([_digest(np.unique(gram[x:y])) if y > x else None for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())]

        return work

    # only rows that share an id are read again for what their grams are
    again = own.join(repeated, doc_id, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__q_row"), F.col(f"`{doc_id}`").cast("long").alias("__q_id"), F.col(f"`{text}`").alias("__q_text"))
    again = map_texts(again, "__q_text", [T.StructField("__q_digest", T.BinaryType())], make).drop("__q_text")
    firsts = again.groupBy("__q_id", "__q_digest").agg(F.min("__q_row").alias("__q_row"))
    kept = firsts.join(first_ones, (F.col("__q_id") == first_ones[doc_id]) & F.col("__q_digest").eqNullSafe(F.col("digest")), "left_semi")
    return once.unionByName(kept.select("__q_row.*").select(*docs.columns)).unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
