"""Retrieval: nearest neighbours by a stated set of queries, reranking, caps by group, and the dominance gate.

Ranked lists are rows (query_id, rank, grp, article, …), rank from 1, best first. Caps and gate shuffle by query once;
row_number() <= n lets Spark keep only n rows a group on the map side.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.sources.tables import stored

#: Queries that are broadcast at once; more are taken in blocks of this size.
QUERY_BLOCK = 4096
#: About how many rows and queries of a nearest-neighbour search a task holds at once.
PER_SHARD, PER_BLOCK = 16_384, 16_384
#: Tasks of a nearest-neighbour search at most.
MOST_TASKS = 4096


@dataclass(frozen=True)
class RetrievalConfig:
    """Fixed values as defaults: pool before reranking, results, share that collapses to one group, caps, results over several groups."""

    pre_rerank: int = 50
    top_k: int = 5
    purity_threshold: float = 0.6
    max_per_article: int | None = None
    max_per_group: int | None = 2
    top_k_auto: int = 12


def squared_distance(a: Column, b: Column) -> Column:
    """In double precision, whatever the vectors' type."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def finite(vector: Column) -> Column:
    """Whether a vector has components, all of them numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def knn(queries: DataFrame, rows: DataFrame, k: int, on: dict[str, str] | None = None) -> DataFrame:
    """The columns of rows but vector, those of queries but query, distance (squared) and rank of the k nearest rows a query, equal distances by id.

    queries: query_id, query (a vector) and more; rows: id, vector and more. on: columns of rows and those of queries which they must equal; that holds
    before ranking, so that a filter never leaves fewer than k rows where more fit. Vectors that are null, empty or hold null or non-finite components take
    no part, and queries meet rows of their own length only.

    All pairs are compared, which is quadratic where queries are a share of the rows, a matrix product for each shard of rows and block of queries: one task holds no more, and gives
    out k rows a query at most.
    """
    on = on or {}
    keys = ["__dim", *[f"__key{i}" for i in range(len(on))]]
    keyed = lambda df, v, own: df.where(finite(F.col(v))).withColumns({"__dim": F.size(v), **{f"__key{i}": F.col(c) for i, c in enumerate(own)}}).dropna(subset=keys)
    held, asked = keyed(rows, "vector", on), keyed(queries, "query", on.values())
    most = asked.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // PER_BLOCK))
    # cells, pairs of a shard and a block, are numbered from 0; each is a partition and so a task of its own, however few bytes it has
    shards = held.groupBy(*keys).agg(F.ceil(F.count("*") / PER_SHARD).cast("int").alias("__n"))
    shards = stored(shards.withColumn("__first", (F.sum("__n").over(Window.orderBy(*keys)) - F.col("__n")).cast("int")), "shards")  # one row a key
    cells = blocks * (shards.agg(F.sum("__n")).first()[0] or 0)
    held = held.join(F.broadcast(shards), keys).withColumn("__shard", F.pmod(F.xxhash64("id"), "__n").cast("int"))
    held = held.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.join(F.broadcast(shards), keys).withColumn("__shard", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    asked = asked.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    number = ((F.col("__first") + F.col("__shard")) * blocks + F.col("__block")).alias("__cell")
    held, asked = (df.select(*own.columns, number).repartitionById(max(2, min(cells, MOST_TASKS)), "__cell").groupBy("__cell") for df, own in ((held, rows), (asked, queries)))
    fields = [f for f in [*rows.schema.fields, *queries.schema.fields] if f.name not in ("vector", "query")]
    found = held.cogroup(asked).applyInArrow(_nearest(k, len(rows.columns) - 1, [f.name for f in fields]), T.StructType([*fields, T.StructField("distance", T.DoubleType())]))
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _nearest(k: int, n: int, names: list[str]):
    """Of a shard's rows and a block's queries: k rows a query, the n first names from rows, the others from queries, and their distance."""

    def run(held, asked):
        import numpy as np
        import pyarrow as pa

        def matrix(column):
            return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(np.float64).reshape(len(column), -1)

        if not len(held) or not len(asked):
            return pa.Table.from_arrays([*[held.column(c).slice(0, 0) for c in names[:n]], *[asked.column(c).slice(0, 0) for c in names[n:]], pa.array([], pa.float64())], names=[*names, "distance"])
        held = held.sort_by("id")  # places are in the order of ids
        x, q = matrix(held.column("vector")), matrix(asked.column("query"))
        # of equal vectors, which are as far, only the k of least id can be found
        of = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
        order = np.argsort(of, kind="stable")
        of = of[order]
        first = np.sort(order[np.arange(len(of)) - np.searchsorted(of, of) < k])
        held, x = held.take(pa.array(first)), x[first]
        dims, step = x.shape[1], max(1, (1 << 21) // len(x))
        with np.errstate(over="ignore"):
            squares = (x * x).sum(1)
            scale = (np.sqrt((q * q).sum(1)) + np.sqrt(squares.max())) ** 2
        with_squares = np.column_stack([x, squares])
        row, col, distance = [], [], []
        for start in range(0, len(q), step):
            own = q[start : start + step]
            if len(x) > k and np.isfinite(scale[start : start + step]).all():
                # how near, but for rounding and the query's own square; what rounding might have kept out is worked out exactly
                slack = 16 * (dims + 8) * 2.0**-52 * scale[start : start + step]
                near = np.column_stack([-2 * own, np.ones(len(own))]) @ with_squares.T
                few = near[:, : 32 * k]
                limit = np.partition(few, k - 1, axis=1)[:, k - 1] + slack  # no kth of all is farther than the kth of some
                at = np.flatnonzero(near <= limit[:, None])
                near = near.ravel()[at]
                a, b = np.divmod(at, len(x))
                ends = np.searchsorted(a, np.arange(len(own) + 1))
                kth = np.array([np.partition(near[i:j], k - 1)[k - 1] for i, j in zip(ends[:-1], ends[1:], strict=True)])
                close = near <= (kth + slack)[a]
                a, b = a[close], b[close]
            else:
                a, b = np.divmod(np.arange(len(own) * len(x)), len(x))
            d = np.zeros(len(a))
            with np.errstate(over="ignore"):
                for j in range(dims):  # one after the other, as a sum over an array goes
                    e = own[a, j] - x[b, j]
                    d += e * e
            order = np.lexsort((b, d, a))
            a, b, d = a[order], b[order], d[order]
            best = np.arange(len(a)) - np.searchsorted(a, a) < k
            row.append(start + a[best])
            col.append(b[best])
            distance.append(d[best])
        row, col = pa.array(np.concatenate(row)), pa.array(np.concatenate(col))
        columns = [held.column(c).take(col) for c in names[:n]] + [asked.column(c).take(row) for c in names[n:]]
        return pa.Table.from_arrays([*columns, pa.chunked_array([np.concatenate(distance)])], names=[*names, "distance"])

    return run


def in_blocks(queries: DataFrame) -> list[DataFrame]:
    """queries (query_id, …) in parts of about QUERY_BLOCK rows, each small enough to broadcast."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    return [queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]


def best_by_score(queries: DataFrame, rows: DataFrame, score: Column, k: int, *ties: str) -> DataFrame:
    """The columns of queries and rows, score and rank of the k rows of highest score a query, equal ones by ties; queries come in blocks."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    met = [rows.join(F.broadcast(own), F.lit(True)).withColumn("score", score) for own in in_blocks(queries)]
    return reduce(DataFrame.unionByName, [m.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) for m in met])


def token_overlap(question: Column, passage: Column) -> Column:
    """A stand-in for a reranking model: the share of the question's distinct words that the passage has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != ""))
    return F.coalesce(F.size(F.array_intersect(words(question), words(passage))) / F.nullif(F.size(words(question)), F.lit(0)), F.lit(0.0))


def rerank(hits: DataFrame, score: Column, top_n: int | None = None) -> DataFrame:
    """hits with score and a new rank by it, equal scores in their old order; top_n of them, or all for None and 0."""
    scored = hits.withColumn("score", score)
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))
    return out.where(F.col("rank") <= top_n) if top_n else out


def cap(ranked: DataFrame, by: list[str], n: int | Column | None, query: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first n rows a query of each group; all for None, and for a null column. Ranks keep their gaps."""
    if n is None:
        return ranked
    place = F.row_number().over(Window.partitionBy(*query, *by).orderBy("rank"))
    stay = F.col("__place") <= n
    return ranked.withColumn("__place", place).where(stay if isinstance(n, int) else F.coalesce(stay, F.lit(True))).drop("__place")


def purity_gate(ranked: DataFrame, top_k: int | Column, threshold: float | Column, group: str = "grp", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first top_k rows a query with rank (anew from 1), collapsed and resolved (the groups that are left).

    The share of a group is its count among the first top_k rows by top_k, however few rows there are. Where the
    largest share reaches the threshold only that group's rows stay, from the whole list; of equal counts the group that
    comes first is taken.
    """
    query = Window.partitionBy(*by)
    of_group = Window.partitionBy(*by, group)
    top_k = F.lit(top_k) if isinstance(top_k, int) else top_k
    placed = ranked.withColumn("__at", F.row_number().over(query.orderBy("rank")))
    seen = placed.withColumns({"__n": F.count_if(F.col("__at") <= top_k).over(of_group), "__first": F.min("__at").over(of_group)})
    best = F.max(F.struct(F.col("__n"), -F.col("__first"), F.col(group))).over(query)
    judged = seen.withColumn("__best", best).withColumn("collapsed", F.col("__best.__n") / top_k >= threshold)
    stay = judged.where(F.when(F.col("collapsed"), F.col(group) == F.col(f"__best.{group}")).otherwise(F.col("__at") <= top_k))
    out = stay.withColumn("rank", F.row_number().over(query.orderBy("__at"))).where(F.col("rank") <= top_k)
    return out.withColumn("resolved", F.array_sort(F.collect_set(group).over(query))).drop("__at", "__n", "__first", "__best")


def retrieve_auto(ranked: DataFrame, cfg: RetrievalConfig, group: str = "grp", article: str = "article") -> DataFrame:
    """Caps by article, then by group, then the gate."""
    capped = cap(cap(ranked, [group, article], cfg.max_per_article), [group], cfg.max_per_group)
    return purity_gate(capped, cfg.top_k_auto or cfg.top_k, cfg.purity_threshold, group)


def sweep(ranked: DataFrame, configs: list[RetrievalConfig], group: str = "grp", article: str = "article") -> DataFrame:
    """What retrieve_auto gives for each configuration, with its number from 0 as config; the ranked list is made once."""
    rows = [(i, c.max_per_article, c.max_per_group, c.top_k_auto or c.top_k, float(c.purity_threshold)) for i, c in enumerate(configs)]
    table = ranked.sparkSession.createDataFrame(rows, "config int, __articles int, __groups int, __k int, __share double")
    by = ("config", "query_id")
    capped = cap(cap(ranked.crossJoin(F.broadcast(table)), [group, article], F.col("__articles"), by), [group], F.col("__groups"), by)
    return purity_gate(capped, F.col("__k"), F.col("__share"), group, by).drop("__articles", "__groups", "__k", "__share")


def first_hit(ranked: DataFrame, hit: Column) -> DataFrame:
    """query_id and the rank of its first hit, -1 without one."""
    return ranked.groupBy("query_id").agg(F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(-1)).alias("first_rank"))


def with_header(hits: DataFrame, headers: DataFrame, group: str = "grp") -> DataFrame:
    """hits with the columns of their own group's header."""
    return hits.join(headers, group)


def first_of_each(ranked: DataFrame, key: str) -> DataFrame:
    """The best row a query of each key, in order of rank, ranks anew from 1."""
    best = cap(ranked, [key], 1)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def pool_counts(ranked: DataFrame, group: str = "grp") -> DataFrame:
    """How many rows of each group a query's pool has."""
    return ranked.groupBy("query_id", group).agg(F.count("*").alias("n"))
