"""Nearest neighbours in cells against all pairs, in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import nearest, retrieval
from quillstone.operators.trace import Trace

SCHEMA = "id long, vector array<double>, grp int"


def brute(vectors, asked, k, fits=lambda q, r: True):
    good = [v for v in vectors if v[1] and all(x is not None and x == x and abs(x) < float("inf") for x in v[1])]
    out = set()
    for q in asked:
        if q not in good:
            continue
        near = sorted((sum((a - b) ** 2 for a, b in zip(q[1], r[1])), r[0]) for r in good if len(r[1]) == len(q[1]) and fits(q, r))
        out |= {(q[0], i, rank) for rank, (_, i) in enumerate(near[:k], 1)}
    return out


def found(spark, vectors, asked, k, condition=None, **how):
    rows = spark.createDataFrame(vectors, SCHEMA)
    queries = spark.createDataFrame(asked, SCHEMA).select(F.col("id").alias("query_id"), F.col("vector").alias("query"), F.col("grp").alias("own"))
    got = nearest.search(queries, rows, k, condition, **how)
    assert got.columns == ["query_id", "own", "id", "vector", "grp", "distance", "rank"]
    return {(r.query_id, r.id, r.rank) for r in got.collect()}


def clusters(rng, n, dims=6, many=8):
    return [(i, [rng.gauss(0, 1) + (40 if d == i % many % dims else 0) + i % many for d in range(dims)], i % 4) for i in range(n)]


def test_clusters_leave_most_pairs_out(spark):
    vectors, trace = clusters(random.Random(1), 900), Trace()
    asked = vectors[::30]
    assert found(spark, vectors, asked, 5, trace=trace) == brute(vectors, asked, 5)
    assert sum(v for *_, v in trace.values()) < len(asked) * len(vectors) / 3


@pytest.mark.parametrize("cells", [1, 3, 40, None])
def test_any_vectors_and_any_cells(spark, cells):
    rng = random.Random(2)
    vectors = [(i, [rng.choice([0.0, 1.0, 2.0, 1e6]) for _ in range(3)], rng.randrange(3)) for i in range(200)]  # many ties
    vectors += [(300 + i, [7.0, 7.0, 7.0], 0) for i in range(150)]  # a hot vector
    vectors += [(500, None, 0), (501, [], 0), (502, [1.0, None, 2.0], 0), (503, [float("nan")] * 3, 0), (504, [float("inf"), 0.0, 0.0], 0), (505, [1.0, 2.0], 0), (506, [1.5, 2.0], 1), (507, [1.0] * 9, 2)]
    asked = [*vectors[::25], *vectors[-8:]]
    assert found(spark, vectors, asked, 4, cells=cells) == brute(vectors, asked, 4)


def test_conditions_hold_before_ranking(spark):
    vectors = clusters(random.Random(3), 300)
    asked = vectors[::20]
    assert found(spark, vectors, asked, 6, F.col("grp") == F.col("own")) == brute(vectors, asked, 6, lambda q, r: q[2] == r[2])
    # no query finds k rows, so that there is no bound
    assert found(spark, vectors, asked, 6, F.col("id") < 3) == brute(vectors, asked, 6, lambda q, r: r[0] < 3)


def test_nothing(spark):
    vectors = clusters(random.Random(4), 10)
    assert found(spark, [(1, None, 0)], vectors[:2], 3) == set()
    rows = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame(vectors, SCHEMA).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    assert nearest.search(queries, rows, 3).count() == 0
    assert nearest.search(queries.limit(0), spark.createDataFrame(vectors, SCHEMA), 3).count() == 0


def test_cells_in_shards_and_blocks(spark, monkeypatch):
    """A hot cell is met in shards, queries in blocks, and what must be equal parts cells as well; queries' vectors aren't repeated for each cell."""
    monkeypatch.setattr(retrieval, "PER_SHARD", 40)
    monkeypatch.setattr(retrieval, "PER_BLOCK", 7)
    vectors = [*clusters(random.Random(5), 300), *[(300 + i, [1.0] * 6, i % 4) for i in range(200)]]
    asked = vectors[::20]
    assert found(spark, vectors, asked, 5) == brute(vectors, asked, 5)
    assert found(spark, vectors, asked, 5, on={"grp": "own"}) == brute(vectors, asked, 5, lambda q, r: q[2] == r[2])
    assert nearest._to_centres(spark.createDataFrame(asked, SCHEMA), "vector", [[0.0] * 6], every=True).columns == ["id", "grp", "cell", "to_centre"]


def test_pairs_with_a_condition_are_few_in_memory(spark, monkeypatch):
    monkeypatch.setattr(nearest, "_HELD", 50)
    vectors = [*clusters(random.Random(6), 200), *[(200 + i, [1.0] * 6, i % 4) for i in range(100)]]
    asked = vectors[::20]
    assert found(spark, vectors, asked, 4, F.col("grp") <= F.col("own")) == brute(vectors, asked, 4, lambda q, r: r[2] <= q[2])


def test_keys_of_unlike_types_meet_in_any_partition(spark):
    """A long on one side and an int on the other are equal, though their hashes aren't: with more than one partition their cells once missed each other."""
    vectors = clusters(random.Random(7), 300)
    asked = vectors[::20]
    rows = spark.createDataFrame(vectors, SCHEMA).withColumn("grp", F.col("grp").cast("long"))
    queries = spark.createDataFrame(asked, SCHEMA).select(F.col("id").alias("query_id"), F.col("vector").alias("query"), F.col("grp").alias("own"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = nearest.search(queries, rows, 5, on={"grp": "own"})
        assert dict(got.dtypes)["grp"] == "bigint" and dict(got.dtypes)["own"] == "int"
        assert {(r.query_id, r.id, r.rank) for r in got.collect()} == brute(vectors, asked, 5, lambda q, r: q[2] == r[2])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
