"""Queries on tables that once gave other rows than their SQL, or less than the whole job."""

import random
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from test_queries import rows

from quillstone.functions import text
from quillstone.operators import retrieval
from quillstone.plans import QUERIES, SQL, flows


def same(spark, tmp_path, name, **tables):
    """The rows of a query, which are those of its SQL."""
    duck = duckdb.connect()
    for t, df in tables.items():
        df.to_parquet(f"{tmp_path}/{t}.parquet", coerce_timestamps="us")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(duck.sql(SQL[name]).df())
    return got


def test_mean_rates_half_way(spark, tmp_path):
    """64 minutes of ten events each, far apart: all windows have ten, and the mean of their rates lies half-way between two results. It is rounded up; what
    DuckDB's sums of doubles round it to depends on their order, so that its rows are not asked for here."""
    rng = random.Random(1)
    bad = [rng.randrange(1, 10) for _ in range(64)]
    assert sum(bad) / 640 == 0.5203125
    made = [(k * 10 + i, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=k, seconds=i), "error" if i < n else "view") for k, n in enumerate(bad) for i in range(10)]
    pd.DataFrame(made, columns=["event_id", "ts", "event_type"]).to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    got = QUERIES["block_rate_sliding"](spark, str(tmp_path)).toPandas()
    assert got["mean_rate"].tolist() == [0.520313]


def test_heading_lines_of_texts_are_no_titles(spark, tmp_path):
    texts = ["words of a text", "1 Its own heading\nwords\n2 Another heading\nmore words", "one line", "4754543480058766 Ieein zute ist, er der", "ALL CAPITALS\nwords"]
    got = same(spark, tmp_path, "segment_documents", documents=pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    assert set(got["title"].dropna()) == {"FIRST PART", "SECOND PART"}


def vectors(n, dims=4, seed=0, labels=10):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"vec_id": range(n), "embedding": list(rng.normal(size=(n, dims)).astype("float32")), "label": rng.integers(0, labels, n).astype("int32")})


def test_expected_groups_in_the_whole_pool(spark, tmp_path):
    """A group whose only row is the fortieth of a pool of fifty is in it."""
    v = pd.DataFrame({"vec_id": range(60), "embedding": [[float(i), 0.0] for i in range(60)], "label": [1] * 39 + [3] + [12] * 20})
    v.loc[40:49, "label"] = 1
    got = same(spark, tmp_path, "expected_in_pool", embeddings=v)
    assert got[["present", "missing"]].values.tolist() == [["1,3", "12"]]


def test_nearest_of_all_pairs(spark, monkeypatch):
    """Several shards and blocks, ties and copies, vectors of any length and size: as in plain Python."""
    monkeypatch.setattr(retrieval, "PER_SHARD", 150)
    monkeypatch.setattr(retrieval, "PER_BLOCK", 7)
    rng = random.Random(5)
    made = [(i, [rng.choice([0.0, 1.0, 2.5, 1e6]) for _ in range(3)], rng.randrange(3)) for i in range(600)]  # many ties
    made += [(600 + i, [7.0, 7.0, 7.0], 0) for i in range(200)]  # copies
    made += [(900 + i, [rng.random() + 1e8, rng.random()], i % 2) for i in range(300)]  # where a product of matrices rounds much
    made += [(2000, None, 0), (2001, [], 0), (2002, [1.0, None, 2.0], 0), (2003, [float("nan")] * 3, 0), (2004, [float("inf"), 0.0, 0.0], 0), (2005, [1e200, 1e200, 0.0], 1), (2006, [1.0, 2.0, 3.0], None)]
    asked = [*made[::40], *made[-7:]]
    rows = spark.createDataFrame(made, "id long, vector array<double>, grp int")
    queries = spark.createDataFrame(asked, "query_id long, query array<double>, own int")
    good = [r for r in made if r[1] and all(x is not None and abs(x) < float("inf") for x in r[1])]
    for on, fits in ((None, lambda q, r: True), ({"grp": "own"}, lambda q, r: q[2] is not None and q[2] == r[2])):
        want = set()
        for q in asked:
            if q in good:
                near = sorted((sum((a - b) * (a - b) for a, b in zip(q[1], r[1])), r[0]) for r in good if len(r[1]) == len(q[1]) and fits(q, r))
                want |= {(q[0], i, d, rank) for rank, (d, i) in enumerate(near[:5], 1)}
        got = retrieval.knn(queries, rows, 5, on)
        assert got.columns == ["id", "grp", "query_id", "own", "distance", "rank"]
        assert {(r.query_id, r.id, r.distance, r.rank) for r in got.collect()} == want


def test_each_cell_is_a_task_of_its_own(spark, tmp_path, monkeypatch):
    """Twelve shards and three blocks are compared in 36 tasks, though they are few bytes and eight partitions are what other shuffles have."""
    monkeypatch.setattr(retrieval, "PER_SHARD", 50)
    monkeypatch.setattr(retrieval, "PER_BLOCK", 5)
    nearest = retrieval._nearest

    def noted(*args):
        run = nearest(*args)

        def note(held, asked):
            with open(tmp_path / str(TaskContext.get().partitionId()), "a") as f:
                f.write("x")
            return run(held, asked)

        return note

    monkeypatch.setattr(retrieval, "_nearest", noted)
    rows = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(600)], "id long, vector array<double>")
    queries = rows.where("id % 50 = 0").toDF("query_id", "query")
    assert retrieval.knn(queries, rows, 3).count() == 36
    assert [p.read_text() for p in tmp_path.iterdir()] == ["x"] * 36


def test_copies_are_compared_no_more_than_can_be_found():
    """All pairs of a shard of copies and queries like them are equally near; no task holds them."""
    held = pa.table({"id": range(20_000), "vector": [[1.0, 2.0, 3.0]] * 20_000})
    asked = pa.table({"query_id": range(100), "query": [[1.0, 2.0, 3.0]] * 100})
    run = retrieval._nearest(5, 1, ["id", "query_id"])
    tracemalloc.start()
    found = run(held, asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [{"id": i, "query_id": q, "distance": 0.0} for q in range(100) for i in range(5)]
    assert peak < 16 << 20


def test_pairs_are_not_sorted_as_rows(spark, tmp_path):
    """No plan of a nearest-neighbour search joins all pairs as rows."""
    vectors(300).to_parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("knn_topk", "cap_per_group", "knn_by_language", "expected_in_pool"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_tokenizer_gets_some_texts_at_a_time(spark):
    """Counts keep their order, nulls are empty, and what a call gets is bounded, though a batch holds all rows."""
    sizes = [300_000, None, 900_000, 0, 500_000, 500_000, 10]
    made = spark.createDataFrame([(i, None if n is None else "x" * n) for i, n in enumerate(sizes)], "i int, text string").coalesce(1)

    def load():
        return lambda texts: [len(t) + 10**7 * sum(map(len, texts)) for t in texts]

    got = [r.n for r in made.select("i", text.exact_tokens(load)(F.col("text")).alias("n")).orderBy("i").collect()]
    assert [n % 10**7 for n in got] == [n or 0 for n in sizes]
    assert max(n // 10**7 for n in got) <= text.AT_ONCE + 900_000


def test_documents_are_sanitized_once(spark, sf_dir):
    """What several steps of a report read is stored: the plan of the reports has no step of sanitizing left."""
    plan = QUERIES["document_reports"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Generate" not in plan


def test_flows_shuffle_no_whole_texts(spark):
    docs = spark.createDataFrame([(1, "x" * 1000), (2, None), (3, "é")], "doc_id long, text string")
    assert sorted(map(tuple, flows._texts(lambda name: docs).collect())) == [(1, "x" * 200), (2, None), (3, "é")]


def test_reports_of_texts_that_look_like_more(spark, tmp_path):
    """Texts without a word have no report, those with other ends of lines are one line, those with instructions of their own are as others, and a row more with one id makes no finding more."""
    texts = [None, "", " \n\t", None, "", "words", "A B\r1 Head one\r2 Head two\rrest", "x\x0b1 Head one\x0c2 Head two", "a### end### b", "x you are now", "skip the previous section", "\uff24\uff21\uff2e \u200b", "A\u200bct as a lawyer who concludes", "\x0b"]
    docs = pd.DataFrame({"doc_id": [*range(1, len(texts) + 1), 8], "text": [*texts, "more words"]})
    got = same(spark, tmp_path, "document_reports", documents=docs)
    assert sorted(got["doc_id"]) == [5, *range(6, len(texts) + 1)]


def test_times_count_to_the_nearest_millisecond(spark, tmp_path):
    """The last half of a millisecond before a minute is the minute's, minutes around 1970 go towards zero, and events without a time are a window of their own."""
    minute = 60_000_000
    for i, times in enumerate([[0, minute - 1, 15 * minute], [minute - 501, minute - 500, 15 * minute], [-30_000_000, 30_000_000, -20 * minute, 500, -500], [0, None, None, 3 * minute], [None]]):
        path = tmp_path / str(i)
        path.mkdir()
        same(spark, path, "block_rate_sliding", events=pd.DataFrame({"ts": pd.Series(pd.to_datetime(times, unit="us")), "event_type": ["error", "view", None, "view", "error"][: len(times)]}))
