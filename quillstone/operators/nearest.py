"""Exact nearest neighbours that leave out what can't be near: rows in cells around sampled centres, bounded by the triangle inequality.

Each row goes to the cell of its nearest centre, with its distance to it. A query first meets the cells nearest to it, until they hold some more
than k rows; the kth distance found there is a bound. Of all other cells it meets those that can hold a row within the bound, and in them rows whose distance
to the centre lets them be near enough. Fewer than k fitting rows at first give no bound, and all cells are met: the result never depends on cells.

This pays where vectors lie in clusters. Where all distances are much alike, as with random vectors of many dimensions, no bound excludes much, and
retrieval.knn, which compares all pairs by matrix products, is the better choice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators import retrieval
from quillstone.operators.retrieval import finite, squared_distance
from quillstone.operators.trace import Trace
from quillstone.sources.tables import stored

#: Centres at most: what is sent to every task, and how many rows a query has among the pairs of queries and cells.
MOST_CELLS = 1024
#: More than the rounding of a distance, relative and absolute.
_SLACK = 1e-9
#: Pairs that a task holds before it keeps the k nearest a query, where a condition has to see each.
_HELD = 1 << 16


def _centres(rows: DataFrame, cells: int) -> list[list[float]]:
    """Different vectors, by a hash of the vector: a sample that copies can't fill."""
    own = rows.select(F.transform("vector", lambda x: x.cast("double")).alias("v"))
    n = own.agg(F.approx_count_distinct(F.xxhash64("v")).alias("n")).first()["n"]
    limit = min(2**63 - 1, int(-(2**63) + min(1.0, (4 * cells + 100) / max(n, 1)) * 2**64))
    first = lambda df: [list(r.v) for r in df.groupBy(F.xxhash64("v").alias("h")).agg(F.min("v").alias("v")).orderBy("h").limit(cells).collect()]
    found = first(own.where(F.xxhash64("v") <= F.lit(limit)))
    return found if len(found) == cells else first(own)


def _to_centres(df: DataFrame, vector: str, centres: list[list[float]], every: bool) -> DataFrame:
    """df with cell and to_centre: of the nearest centre of the vector's own length, or a row for every such centre, without the vector. Vectors of a length without a centre get the cell -length and no distance."""
    at = df.columns.index(vector)
    kept = [i for i in range(len(df.columns)) if not every or i != at]
    fields = T.StructType([*[df.schema.fields[i] for i in kept], T.StructField("cell", T.IntegerType()), T.StructField("to_centre", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        by_length: dict[int, tuple] = {}
        for i, c in enumerate(centres):
            by_length.setdefault(len(c), ([], []))[0].append(i)
            by_length[len(c)][1].append(c)
        known = {n: (np.array(i, np.int32), np.array(c, np.float64)) for n, (i, c) in by_length.items()}
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                column = part.column(at)
                lengths = np.diff(column.offsets.to_numpy())
                for n in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == n)
                    rows = part.take(pa.array(own))
                    if n not in known:
                        more = pa.array(np.full(len(own), -n, np.int32)), pa.array([None] * len(own), pa.float64())
                    else:
                        ids, c = known[n]
                        x = rows.column(at).flatten().to_numpy().astype(np.float64).reshape(len(own), n)
                        if every:
                            d = np.sqrt(((x[:, None, :] - c[None]) ** 2).sum(2)) if len(c) * x.size < 1 << 24 else np.stack([np.sqrt(((x - k) ** 2).sum(1)) for k in c], 1)
                            rows = rows.select(kept).take(pa.array(np.repeat(np.arange(len(own)), len(c))))
                            more = pa.array(np.tile(ids, len(own))), pa.array(d.ravel())
                        else:
                            best = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)  # which centre needn't be exact, the distance to it must be
                            more = pa.array(ids[best]), pa.array(np.sqrt(((x - c[best]) ** 2).sum(1)))
                    columns = rows.columns if rows.num_columns == len(kept) else rows.select(kept).columns
                    yield pa.RecordBatch.from_arrays([*columns, *more], names=fields.names)

    return df.mapInArrow(run, fields)


def _in_cell(k: int, n: int, names: list[str]):
    """Of a shard of a cell's rows and a block of the queries that meet it: k rows a query at most, none beyond the query's bound; and a row that has but the number of pairs."""
    run = retrieval._nearest(k, n, [*names, "__bound"])

    def within(held, asked):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        bound, away = (asked.column(c).to_numpy() for c in ("__bound", "from_query"))
        if len(held) and len(asked) and not np.isnan(bound + away).any():  # a null is a nan; rows that are too near to the centre, or too far from it, for every query
            near, far = (away * (1 - _SLACK) - bound).min() / (1 - _SLACK), (away * (1 - _SLACK) + bound).max() / (1 - _SLACK)
            held = held.filter(pc.and_(pc.greater_equal(held.column("to_centre"), near), pc.less_equal(held.column("to_centre"), far)))
        found = run(held, asked)
        found = found.filter(pc.fill_null(pc.less_equal(pc.sqrt(found.column("distance")), found.column("__bound")), True)).drop_columns(["__bound"])
        found = found.append_column("__pairs", pa.nulls(len(found), pa.int64()))
        seen = pa.table([*[pa.nulls(1, f.type) for f in found.schema][:-1], pa.array([len(held) * len(asked)], pa.int64())], names=found.schema.names)
        return pa.concat_tables([found, seen.cast(found.schema)])

    return within


def _few(k: int):
    """Of rows (query_id, id, distance, ...) of a task: k a query at most. No more are held than that and _HELD, and what is left goes out when it is too much itself."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def best(some):
            own = pa.Table.from_batches(some).combine_chunks()
            code = own.column("query_id").combine_chunks().dictionary_encode().indices.fill_null(-1)
            own = own.append_column("__code", code).sort_by([("__code", "ascending"), ("distance", "ascending"), ("id", "ascending")])
            code = own.column("__code").to_numpy()
            return own.filter(pa.array(np.arange(len(code)) - np.searchsorted(code, code) < k)).drop_columns(["__code"]).combine_chunks().to_batches()

        some, n = [], 0
        for b in batches:
            some.append(b)
            n += b.num_rows
            if n >= _HELD:
                some = best(some)
                n = sum(b.num_rows for b in some)
                if n > _HELD // 2:
                    yield from some
                    some, n = [], 0
        if n:
            yield from best(some)

    return run


def search(queries: DataFrame, rows: DataFrame, k: int, condition: Column | None = None, cells: int | None = None, trace: Trace | None = None, on: dict[str, str] | None = None) -> DataFrame:
    """What retrieval.knn gives, and for any condition: query_id, the columns of queries but query, those of rows, distance (squared) and rank of the k nearest rows a query.

    queries: query_id, query and what condition compares; rows: id, vector and more. on (columns of rows and those of queries which they must equal) and the condition hold
    before ranking. Vectors that are null, empty or hold null or non-finite components take no part, and queries meet rows of their own length only. Equal distances go by id.
    trace gets how many pairs were compared. cells: as many as the root of the number of rows, MOST_CELLS at most, unless given.

    A cell's rows and the queries that meet it are compared as matrix products, a shard of rows and a block of queries at a time, and k rows a query come out of each. Where there is a
    condition, which may be on anything, pairs are joined one by one instead, and a task keeps k a query of them as they come: on, where it can say the same, is the better choice.
    """
    on = on or {}
    keys = [f"__key{i}" for i in range(len(on))]
    # cogroup() deals out each side by the hash of its own types, in which an int and a long of one value differ: both get the type that a union gives them
    types = [rows.select(F.col(a)).union(queries.select(F.col(b))).schema[0].dataType for a, b in on.items()]

    def keyed(df: DataFrame, vector: str, names: Iterable[str]) -> DataFrame:
        df = df.where(finite(F.col(vector)))
        return df.withColumns({f"__key{i}": F.col(c).cast(types[i]) for i, c in enumerate(names)}).dropna(subset=keys) if keys else df

    good = keyed(rows, "vector", on)
    if cells is None:
        cells = max(1, min(MOST_CELLS, int(good.count() ** 0.5)))
    centres = _centres(good, cells)
    dealt = stored(_to_centres(good, "vector", centres, every=False), "cells")
    stats = dealt.groupBy("cell", *keys).agg(F.min("to_centre").alias("low"), F.max("to_centre").alias("high"), F.count("*").alias("n"))
    few = stats if keys else F.broadcast(stats)  # MOST_CELLS rows, and one for each length without a centre; with keys as many for each
    asked = stored(keyed(queries, "query", on.values()).withColumn("__q", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // retrieval.PER_BLOCK))
    ids = asked.select("__q", "query_id", "query", *keys)
    pairs = _to_centres(ids, "query", centres, every=True).where("cell >= 0").unionByName(_to_centres(ids, "query", [], every=True))  # and cells without a centre
    pairs = pairs.withColumnRenamed("to_centre", "from_query").join(few, ["cell", *keys])
    order = Window.partitionBy("query_id").orderBy(F.col("from_query").asc_nulls_first(), "cell")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = stored(pairs.withColumn("first", before < 2 * k).drop("query_id"), "query-cells")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    own = [c for c in queries.columns if c != "query"]
    keep = [*own, *[c for c in rows.columns if c not in own], "distance"]
    shards = F.ceil(F.col("n") / retrieval.PER_SHARD).cast("int")
    held = dealt.join(few.drop("low", "high"), ["cell", *keys]).withColumn("__shard", F.pmod(F.xxhash64("id"), shards).cast("int")).drop("n").withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    fields = [*rows.schema.fields, *[queries.schema[c] for c in own if c not in rows.columns]]
    distance, seen = T.StructField("distance", T.DoubleType()), T.StructField("__pairs", T.LongType())

    def met(some: DataFrame, name: str, close: Column | None = None) -> DataFrame:
        some = some.join(asked.drop(*keys), "__q")
        if condition is None:
            some = some.withColumns({"__shard": F.explode(F.sequence(F.lit(0), shards - 1)), "__block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")})
            group = ["cell", *keys, "__shard", "__block"]
            out = T.StructType([T.StructField(f.name, f.dataType) for f in [*fields, distance, seen]])
            both = held.groupBy(*group).cogroup(some.groupBy(*group)).applyInArrow(_in_cell(k, len(rows.columns), [f.name for f in fields]), out)
            both = trace.step(name, both, n=F.coalesce(F.sum("__pairs"), F.lit(0))) if trace else both
            return both.where("__pairs is null").select(*keep)
        both = some.drop("low", "high", "n", "first").join(dealt, ["cell", *keys])
        both = both.where(condition if close is None else close & condition)
        both = trace.step(name, both) if trace else both
        both = both.withColumn("distance", squared_distance(F.col("query"), F.col("vector"))).select(*keep)
        return both.mapInArrow(_few(k), both.schema)

    near = met(pairs.where("first").withColumn("__bound", F.lit(None).cast("double")), "compared at first").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    near = stored(near, "near")
    bound = near.groupBy("query_id").agg(F.max("distance").alias("kth"), F.count("*").alias("found")).where(F.col("found") >= k).select("query_id", (F.sqrt("kth") * (1 + _SLACK) + _SLACK).alias("__bound"))
    bound = asked.select("__q", "query_id").join(bound, "query_id").drop("query_id")
    rest = pairs.where("not first").join(bound, "__q", "left")
    # how far at least a row of the cell, or this row, is
    of_cell = F.greatest(F.col("from_query") - F.col("high"), F.col("low") - F.col("from_query")) * (1 - _SLACK)
    of_row = F.abs(F.col("from_query") - F.col("to_centre")) * (1 - _SLACK)
    free = F.col("__bound").isNull() | F.col("from_query").isNull()
    more = met(rest.where(free | (of_cell <= F.col("__bound"))), "compared then", free | (of_row <= F.col("__bound")))
    return near.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
