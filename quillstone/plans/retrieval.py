"""Queries on embeddings: every row whose id is divisible by 100 is a query, against all rows; labels are the groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import nearest, retrieval
from quillstone.operators.retrieval import RetrievalConfig
from quillstone.operators.trace import Trace
from quillstone.sources.tables import stored

from .catalog import query

_KNN = """
    q AS (SELECT vec_id AS query_id, embedding AS query, label AS query_label FROM embeddings WHERE vec_id % 100 = 0),
    d AS (SELECT query_id, query_label, vec_id AS id, label AS grp, vec_id % 7 AS article, list_sum(list_transform(list_zip(query, embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS distance FROM q, embeddings),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d QUALIFY rank <= 50)
"""


def _pool(table, filtered: bool = False):
    v = table("embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))
    rows = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("grp"), (F.col("vec_id") % 7).alias("article"))
    return retrieval.knn(q, rows, 50, {"grp": "query_label"} if filtered else None)


@query(f"WITH {_KNN} SELECT query_id, id, grp, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def knn_topk(table):
    return _pool(table).where("rank <= 10").select("query_id", "id", "grp", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {_KNN.replace('FROM q, embeddings', 'FROM q, embeddings WHERE label = query_label')} SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def knn_filtered(table):
    return _pool(table, filtered=True).where("rank <= 10").select("query_id", "id", "rank")


@query(f"""
    WITH {_KNN}, s AS (SELECT query_id, id, rank AS old, round(1 / (1 + distance), 6) + (id % 3) AS score FROM ranked)
    SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS INTEGER) AS rank FROM s QUALIFY rank <= 10
""")
def rerank_stable(table):
    return retrieval.rerank(_pool(table), F.round(1 / (1 + F.col("distance")), 6) + F.col("id") % 3, 10).select("query_id", "id", "rank")


@query(f"WITH {_KNN} SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id, grp ORDER BY rank) <= 2")
def cap_per_group(table):
    return retrieval.cap(_pool(table), ["grp"], 2).select("query_id", "id", "rank")


_CAPPED = """
    a AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id, grp, article ORDER BY rank) <= {articles}),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, grp ORDER BY rank) <= {groups})
"""


@query(f"WITH {_KNN}, {_CAPPED.format(articles=1, groups=3)} SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM b")
def cap_two_level(table):
    return retrieval.cap(retrieval.cap(_pool(table), ["grp", "article"], 1), ["grp"], 3).select("query_id", "id", "rank")


def _gate(source: str, k: int, threshold: float, extra: str = "") -> str:
    return f"""
    p{extra} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM {source}),
    g{extra} AS (SELECT query_id, grp, count(*) AS n, min(pos) AS first FROM p{extra} WHERE pos <= {k} GROUP BY ALL),
    t{extra} AS (SELECT query_id, grp AS top, n / {k}.0 >= {threshold} AS collapsed FROM g{extra} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) = 1),
    o{extra} AS (SELECT query_id, id, grp, collapsed, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM p{extra} JOIN t{extra} USING (query_id) WHERE CASE WHEN collapsed THEN grp = top ELSE pos <= {k} END QUALIFY place <= {k})
    """


#: For every other query the ten labels are two groups, of eight and two, so that one dominates.
_TWO = "two AS (SELECT * REPLACE (CASE WHEN query_id % 200 = 0 THEN grp // 8 ELSE grp END AS grp) FROM ranked)"


def _grouped(table):
    return _pool(table).withColumn("grp", F.when(F.col("query_id") % 200 == 0, F.floor(F.col("grp") / 8).cast("int")).otherwise(F.col("grp")))


@query(f"WITH {_KNN}, {_TWO}, {_gate('two', 5, 0.6)} SELECT query_id, id, grp, collapsed, CAST(place AS INTEGER) AS rank, (SELECT string_agg(DISTINCT grp, ',' ORDER BY grp) FROM o x WHERE x.query_id = o.query_id) AS resolved FROM o")
def purity_gate(table):
    return retrieval.purity_gate(_grouped(table), 5, 0.6).select("query_id", "id", "grp", "collapsed", "rank", F.array_join("resolved", ",").alias("resolved"))


@query(f"WITH {_KNN}, {_TWO}, {_CAPPED.format(articles=10**9, groups=8).replace('FROM ranked', 'FROM two')}, {_gate('b', 12, 0.6)} SELECT query_id, id, grp, collapsed, CAST(place AS INTEGER) AS rank FROM o")
def retrieve_auto(table):
    return retrieval.retrieve_auto(_grouped(table), RetrievalConfig(max_per_group=8)).select("query_id", "id", "grp", "collapsed", "rank")


_CONFIGS = [(a, g, k, t) for a in (1, 10**9) for g in (2, 10**9) for k, t in ((5, 0.6), (12, 0.5), (4, 0.75))]


def _sweep() -> str:
    parts = [_KNN, _TWO]
    for i, (a, g, k, t) in enumerate(_CONFIGS):
        parts.append(_CAPPED.format(articles=a, groups=g).replace("FROM ranked", "FROM two").replace("a AS", f"a{i} AS").replace("FROM a ", f"FROM a{i} ").replace("    b AS", f"    b{i} AS"))
        parts.append(_gate(f"b{i}", k, t, str(i)))
    return "WITH " + ",".join(parts) + " UNION ALL ".join(f"SELECT {i} AS config, query_id, count(*) AS n, count(DISTINCT grp) AS n_groups, bool_or(collapsed) AS collapsed FROM o{i} GROUP BY query_id" for i in range(len(_CONFIGS)))


@query(_sweep())
def config_sweep(table):
    """Twelve configurations over one ranked list."""
    configs = [RetrievalConfig(top_k=k, top_k_auto=k, purity_threshold=t, max_per_article=None if a > 1 else 1, max_per_group=None if g > 2 else 2) for a, g, k, t in _CONFIGS]
    return retrieval.sweep(_grouped(table), configs).groupBy("config", "query_id").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("n_groups"), F.bool_or("collapsed").alias("collapsed"))


@query(f"WITH {_KNN} SELECT query_id, CAST(coalesce(min(rank) FILTER (grp = 3), -1) AS INTEGER) AS first_rank FROM ranked GROUP BY query_id")
def first_hit_rank(table):
    return retrieval.first_hit(_pool(table), F.col("grp") == 3)


@query(f"WITH {_KNN} SELECT query_id, grp, count(*) AS n FROM ranked GROUP BY ALL")
def pool_counts(table):
    return retrieval.pool_counts(_pool(table))


@query("""
    WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda w: w <> '')) AS qs FROM benchmark WHERE item_id % 100 = 0),
         p AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda w: w <> '')) AS ps FROM conversations),
         s AS (SELECT item_id, conv_id, turn, round(len(list_intersect(qs, ps)) / len(qs), 6) AS score FROM q, p)
    SELECT item_id, conv_id, turn, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id, turn) AS INTEGER) AS rank FROM s QUALIFY rank <= 5
""")
def token_overlap_rerank(table):
    q = table("benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    p = table("conversations").select("conv_id", "turn", F.col("text").alias("p"))
    score = F.round(retrieval.token_overlap(F.col("q"), F.col("p")), 6)
    return retrieval.best_by_score(q, p, score, 5, "conv_id", "turn").select(F.col("query_id").alias("item_id"), "conv_id", "turn", "score", "rank")


# Vectors with a cluster for each label: ten is added to the component of the label's number.
_CLUSTERS = """
    v AS (SELECT vec_id, label, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + CASE WHEN i = label + 1 THEN 10 ELSE 0 END) AS v FROM embeddings),
    d AS (SELECT q.vec_id AS query_id, q.label AS query_label, r.vec_id AS id, r.label AS grp, list_sum(list_transform(list_zip(q.v, r.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM v q JOIN v r ON q.vec_id % 100 = 0 {on})
"""


def _clustered(table):
    v = table("embeddings").withColumn("v", F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), 10.0).otherwise(0.0)))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"), F.col("label").alias("query_label"))
    return q, v.select(F.col("vec_id").alias("id"), F.col("v").alias("vector"), F.col("label").alias("grp"))


def _share(trace, q, rows):
    """Whether less than a third of all pairs were compared."""
    return sum(value for *_, value in trace.values()) * 3 < q.count() * rows.count()


@query(f"WITH {_CLUSTERS.format(on='')} SELECT query_id, id, grp, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, TRUE AS few_compared FROM d QUALIFY rank <= 10")
def knn_cells(table):
    """Nearest neighbours in cells, among vectors in clusters: exact, with most pairs left out."""
    (q, rows), trace = _clustered(table), Trace()
    found = stored(nearest.search(q, rows, 10, trace=trace), "found")
    return found.select("query_id", "id", "grp", F.round("distance", 6).alias("distance"), "rank", F.lit(_share(trace, q, rows)).alias("few_compared"))


@query(f"WITH {_CLUSTERS.format(on='AND r.vec_id % 3 = q.label % 3')} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, TRUE AS few_compared FROM d QUALIFY rank <= 10")
def knn_cells_filtered(table):
    """The same with a condition that two thirds of the rows don't meet; it holds before ranking."""
    (q, rows), trace = _clustered(table), Trace()
    q, rows = q.withColumn("third", F.col("query_label") % 3), rows.withColumn("rest", F.col("id") % 3)
    found = stored(nearest.search(q, rows, 10, trace=trace, on={"rest": "third"}), "found")
    return found.select("query_id", "id", "rank", F.lit(_share(trace, q, rows)).alias("few_compared"))
