"""Exact top-k by inner product: a ball tree for each shard of the vectors, searched by branch and bound.

Vectors are dealt to shards by their number. A shard's tree has nodes with a centre and a radius; q.c + |q|r
bounds the product of a query with any vector of the node. Nodes are opened in descending order of the bound, by
blocks of queries that share a heap, and a node is left alone by queries whose kth score exceeds its bound. Each
query first searches the shard that its own hash names; the kth score found there goes with it to the next three, and what
is the kth score after those to all others: three waves, each of which knows what the shards before it found. What shards
find is merged by a grouping: at most k rows a query and shard.

Queries are a stated set and meet every shard. Vectors and queries of a shard come to its task in this order, so that the
tree is made once a wave and a task holds a shard and a block of queries only.
Scores are exact: where products could reach 2**53 they are worked out in 64-bit integers, and where they could reach 2**62
in Python's, which have no end. A score among a shard's k best that no 64-bit integer holds raises OverflowError.

Edge cases: ids must be whole numbers (TypeError else); vectors that are null, empty, or hold null or non-finite components take no part; queries only meet vectors of
their own length; equal scores go to smaller ids, and rows with the same id are distinct candidates but for those
with a query's own id; of queries that share an id the least vector asks; fewer than k candidates give fewer rows; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored, whole_ids

LEAF = 128
#: No score yet, where all are less than 2**62 away from 0.
_NEVER = -(1 << 62)


class BallTree:
    """Balls of a shard's vectors; x holds them in the order of the leaves."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray):
        x = whole.astype(np.float64)
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []
        todo = [(0, len(x), -1)]
        children: dict[int, list[int]] = {}
        while todo:
            a, b, parent = todo.pop()
            own = x[self.order[a:b]]
            centre = own.mean(0)
            # a little more than the radius, so that rounding never makes the bound too low
            radius = float(np.sqrt(((own - centre) ** 2).sum(1).max())) * (1 + 1e-9) + 1e-6 + 1e-9 * float(np.sqrt((centre**2).sum()))
            me = len(self.nodes)
            self.nodes.append((a, b, centre, radius, -1, -1))
            if parent >= 0:
                children.setdefault(parent, []).append(me)
            if b - a > LEAF:
                far = own[((own - centre) ** 2).sum(1).argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                side = own @ (other - far)
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(side, half)]
                todo += [(a, a + half, me), (a + half, b, me)]
        for me, (left, right) in children.items():
            a, b, c, r, _, _ = self.nodes[me]
            self.nodes[me] = (a, b, c, r, left, right)
        self.x, self.whole, self.ids = x[self.order], whole[self.order], ids[self.order]
        self.most = float(np.abs(x).max(initial=0.0))

    def products(self, q: np.ndarray, whole: np.ndarray, a: int, b: int, most: float) -> np.ndarray:
        """Of queries with the vectors from a to b, exactly. most: what none of them passes."""
        if most < 2**53:
            return (q @ self.x[a:b].T).astype(np.int64)
        if most < 2**62:
            return whole @ self.whole[a:b].T
        return whole.astype(object) @ self.whole[a:b].T.astype(object)

    def search(self, q_ids: np.ndarray, whole: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query index, id and score of up to k best a query, of those that reach its floor, a double: -inf without one."""
        q = whole.astype(np.float64)
        n = len(q)
        most = self.most * float(np.abs(q).max(initial=0.0)) * q.shape[1]
        large = most >= 2**62  # then scores are Python's integers, in lists by query
        score = np.full((n, k), _NEVER, np.int64)
        which = np.full((n, k), np.iinfo(np.int64).max)
        lists: list[list[tuple[int, int]]] = [[] for _ in range(n if large else 0)]
        norm = np.sqrt((q**2).sum(1))
        kth = floor.copy()

        def bound(node: int, at: np.ndarray) -> np.ndarray:
            _, _, c, r, _, _ = self.nodes[node]
            return q[at] @ c + norm[at] * (r * (1 + 1e-9) + 1e-9 * np.sqrt(c @ c)) + 1e-3

        every = np.arange(n)
        heap = [(-float(bound(0, every).max()), 0, every)] if n and len(self.x) else []
        while heap:
            _, node, at = heapq.heappop(heap)
            a, b, _, _, left, right = self.nodes[node]
            at = at[bound(node, at) >= kth[at]]
            if not len(at):
                continue
            if left >= 0:
                for child in (left, right):
                    up = bound(child, at)
                    keep = up >= kth[at]
                    if keep.any():
                        heapq.heappush(heap, (-float(up[keep].max()), child, at[keep]))
                continue
            s = self.products(q[at], whole[at], a, b, most)
            ids = self.ids[a:b]
            if large:
                for row, products in zip(at.tolist(), s.tolist(), strict=True):
                    met = [(-x, i) for x, i in zip(products, ids.tolist(), strict=True) if i != q_ids[row]]
                    lists[row] = heapq.nsmallest(k, lists[row] + met)
                    if len(lists[row]) == k:
                        kth[row] = max(kth[row], -float(lists[row][-1][0]))
                continue
            s[ids[None, :] == q_ids[at, None]] = _NEVER
            s = np.concatenate([score[at], s], 1)
            i = np.concatenate([which[at], np.broadcast_to(ids, (len(at), b - a))], 1)
            best = np.lexsort((i, -s), axis=1)[:, :k] if s.shape[1] <= 4 * k else _best(s, i, k)
            score[at], which[at] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            kth[at] = np.maximum(kth[at], np.where(score[at, k - 1] > _NEVER, score[at, k - 1], -np.inf))
        if large:
            flat = [(row, i, -x) for row, own in enumerate(lists) for x, i in own]
            return np.array([r for r, _, _ in flat], np.int64), np.array([i for _, i, _ in flat], np.int64), np.array([x for _, _, x in flat], object)
        row, col = np.nonzero(score > _NEVER)
        return row, which[row, col], score[row, col]


def _best(s: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best a row by (score, smaller id): the scores from the kth on first, then their order."""
    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    few = int((s >= kth[:, None]).sum(1).max())
    if few > 16 * k:  # many ties
        return np.lexsort((i, -s), axis=1)[:, :k]
    near = np.argpartition(-s, min(few, s.shape[1]) - 1, axis=1)[:, :few]
    order = np.lexsort((np.take_along_axis(i, near, 1), -np.take_along_axis(s, near, 1)), axis=1)[:, :k]
    return np.take_along_axis(near, order, 1)


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "vector", per_shard: int = 16_384, per_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score. vector: an array of integers. per_shard and per_block: about how many vectors and queries a task holds."""
    spark = vectors.sparkSession
    ship(spark)
    whole_ids(vectors, vec_id)
    v = F.col(f"`{vector}`")
    good = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()) & F.col(f"`{vec_id}`").isNotNull())
    good = good.select(F.col(f"`{vec_id}`").cast("long").alias("i"), F.transform(v, lambda x: x.cast("long")).alias("v"), is_query.alias("is_query"))
    # stored, as rows are dealt by their number, which is only right for one run; ids may repeat without end
    dealt = stored(good.select("i", "v", "is_query", F.size("v").alias("dim"), F.xxhash64(F.monotonically_increasing_id()).alias("deal")), "vectors")
    shards = max(1, -(-dealt.count() // per_shard))
    held = dealt.select("dim", F.pmod("deal", F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("role"), "i", "v", F.lit(None).cast("double").alias("floor"))
    queries = dealt.where("is_query").groupBy("i").agg(F.min("v").alias("v"))
    queries = queries.select("i", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("i"), F.lit(shards)).cast("int").alias("first"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found, met = None, 0
    for wave in (1, 3, shards):
        wave = min(wave, shards - met)
        if not wave:
            break
        asked = queries.withColumn("floor", F.lit(None).cast("double"))
        if found is not None:
            kth = found.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("i"), "low")
            asked = queries.join(kth, "i", "left").withColumn("floor", F.col("low").cast("double"))
        to = F.explode(F.sequence(F.lit(met), F.lit(met + wave - 1)))
        asked = asked.withColumn("to", to).select("dim", F.pmod(F.col("first") + F.col("to"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("role"), "i", "v", "floor")
        rows = held.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "role")
        more = rows.mapInArrow(_searcher(k, per_block), "query_id long, vec_id long, score long")
        every = more if found is None else found.unionByName(more)
        found = every.withColumn("rank", best).where(F.col("rank") <= k)
        met += wave
        if met < shards:
            found = stored(found.drop("rank"), "found")
    return found.select("query_id", "rank", "vec_id", "score")


def _searcher(k: int, per_block: int):
    """Of rows by (dim, shard), vectors before queries: the tree of a shard is made once, and queries pass it by the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, asked, waiting, tree = None, [], [], 0, None

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, tree
            if asked and held:
                tree = tree or BallTree(*(np.concatenate(x) for x in zip(*held, strict=True)))
                ids, q, floor = (np.concatenate(x) for x in zip(*asked, strict=True))
                row, which, score = tree.search(ids, q, k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(which), pa.array(score.tolist(), pa.int64())], names=["query_id", "vec_id", "score"])
            asked.clear()
            waiting = 0

        for batch in batches:
            dim, shard, role, i = (batch.column(c).to_numpy() for c in ("dim", "shard", "role", "i"))
            floor = batch.column("floor").fill_null(-np.inf).to_numpy()
            new = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(i)], strict=True):
                if a == b:
                    continue
                if (now := (dim[a], shard[a])) != key:
                    yield from answer()
                    key, tree = now, None
                    held.clear()
                for c in range(a, b, per_block):
                    d = min(b, c + per_block)
                    x = batch.column("v").slice(c, d - c).flatten().to_numpy().reshape(d - c, dim[a])
                    if role[a] == 0:
                        held.append((i[c:d], x))
                        continue
                    asked.append((i[c:d], x, floor[c:d]))
                    waiting += d - c
                    if waiting >= per_block:
                        yield from answer()
        yield from answer()

    return run
