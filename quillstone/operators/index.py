"""The vector index: chunks with vectors, built only for what has changed. The embedder comes from outside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.text import content_hash
from quillstone.operators.corpus import stale, upsert
from quillstone.operators.document import chunks


def embedder(load: Callable[[], Callable[[list[str]], list]], batch: int = 16) -> Callable[[Column], Column]:
    """A column function from a loader of models: the model is loaded once a task, texts go to it in batches and keep their order."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in texts:
            own = part.tolist()
            yield pd.Series([v for i in range(0, len(own), batch) for v in model(own[i : i + batch])], index=part.index, dtype=object)

    return embed


def build(articles: DataFrame, manifest: DataFrame, existing: DataFrame, embed: Callable[[Column], Column], model: str, force: bool = False, max_tokens: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The index (chunk_id, article_id, norma, articulo, apartado, language, text, token_count, content_hash, vector, model) with chunks of
    stale entries (norma, articulo, language, chunks, embedding_model) anew, and how many chunks each norma added, recomputed and left unchanged."""
    keys = ["norma", "articulo", "language"]
    due = stale(manifest, model, force).select(*keys)
    fresh = chunks(articles.join(due, keys, "left_semi"), max_tokens)
    fresh = fresh.withColumns({"content_hash": content_hash(F.col("text")), "vector": embed(F.col("text")), "model": F.lit(model)})
    index = upsert(existing, fresh.select(*existing.columns), "chunk_id", "content_hash")
    counts = fresh.select("norma", "chunk_id").join(existing.select("chunk_id", F.lit(True).alias("was")), "chunk_id", "left").groupBy("norma").agg(F.count_if(F.col("was").isNull()).alias("added"), F.count("was").alias("recomputed"))
    left = existing.join(fresh.select("chunk_id"), "chunk_id", "left_anti").groupBy("norma").agg(F.count("*").alias("unchanged"))
    summary = counts.join(left, "norma", "full").fillna(0, ["added", "recomputed", "unchanged"])
    return index, summary


def open_index(spark: SparkSession, path: str, create: DataFrame | None = None) -> DataFrame:
    """The table at path; create (an empty frame of its columns) makes it where there is none, without it that is an error."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if create is None:
            raise FileNotFoundError(path) from e
        create.limit(0).write.partitionBy("norma", "language").parquet(path)
        return create.limit(0)
