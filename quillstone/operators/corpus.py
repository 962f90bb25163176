"""Corpora: targets, manifests, coverage, merges of languages, integrity, incremental writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import content_hash

#: The registry of corpora, with their identifiers, versions, numbers of articles and labels.
REGISTRY = [
    ("ai_act", "32024R1689", "2024-07-12", 113, "AI Act"), ("gdpr", "02016R0679-20160504", "2016-05-04", 99, "GDPR"), ("nis2", "32022L2555", "2022-12-27", 46, "NIS2"),
    ("dora", "32022R2554", "2022-12-27", 64, "DORA"), ("dora_rts_incident", "32025R0301", "2025-02-20", 7, "DORA RTS Plazos"), ("dora_rts_class", "32024R1772", "2024-06-25", 13, "DORA RTS Clasif."),
    ("amlr", "32024R1624", "2024-06-19", 90, "AMLR"), ("mica", "32023R1114", "2023-06-09", 149, "MiCA"), ("tfr", "32023R1113", "2023-06-09", 40, "TFR"),
]
LANGUAGES = ["es", "en"]


def registry(spark) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "corpus string, celex string, version string, expected_articles int, label string")


def targets(spark, corpus: str = "all", languages: list[str] | None = None) -> DataFrame:
    """corpus and language pairs; all stands for the registry."""
    own = registry(spark).select("corpus")
    own = own if corpus == "all" else own.where(F.col("corpus") == corpus)
    return own.select("corpus", F.explode(F.array(*map(F.lit, languages or LANGUAGES))).alias("language"))


def targets_of(requests: DataFrame) -> DataFrame:
    """requests (…, wanted: a corpus or all, languages: an array or null for all of them) with a row for each corpus of the registry and language that they mean; unknown corpora mean none."""
    own = registry(requests.sparkSession).select("corpus")
    met = requests.join(F.broadcast(own), (F.col("wanted") == "all") | (F.col("wanted") == F.col("corpus")))  # the registry's few rows
    return met.withColumn("language", F.explode(F.coalesce("languages", F.array(*map(F.lit, LANGUAGES))))).drop("wanted", "languages")


def manifest_diff(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """article_id and status (added, removed, changed, unchanged), of entries (article_id, language, hash): an article is unchanged if its hashes are, language for language."""
    whole = lambda df, name: df.groupBy("article_id").agg(F.sort_array(F.collect_set(F.struct("language", "hash"))).alias(name))
    if old is None:
        return new.select("article_id", F.lit("added").alias("status")).distinct()
    met = whole(old, "o").join(whole(new, "n"), "article_id", "full")
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "unchanged").otherwise("changed")
    return met.select("article_id", status.alias("status"))


def coverage(articles: DataFrame, expected: DataFrame) -> DataFrame:
    """corpus, expected, found (different numbers), duplicates, missing, empty, ok. articles: corpus, articulo (a number as text), text; expected: corpus, expected_articles."""
    counts = articles.groupBy("corpus", "articulo").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank"))
    found = counts.groupBy("corpus").agg(
        F.count("*").alias("found"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("articulo")))).alias("duplicates"),
        F.sort_array(F.collect_list(F.when(F.col("blank") > 0, F.col("articulo")))).alias("empty"),
    )
    wanted = expected.select("corpus", "expected_articles", F.explode(F.sequence(F.lit(1), "expected_articles")).alias("number"))
    missing = wanted.join(counts.select("corpus", F.expr("try_cast(articulo as int)").alias("number")), ["corpus", "number"], "left_anti").groupBy("corpus").agg(F.sort_array(F.collect_list("number")).alias("missing"))
    out = expected.join(found, "corpus", "left").join(missing, "corpus", "left")
    lists = {c: F.coalesce(c, F.array().cast(t)) for c, t in (("duplicates", "array<string>"), ("missing", "array<int>"), ("empty", "array<string>"))}
    out = out.select("corpus", F.col("expected_articles").alias("expected"), F.coalesce("found", F.lit(0)).alias("found"), *[v.alias(k) for k, v in lists.items()])
    return out.withColumn("ok", (F.col("found") == F.col("expected")) & (F.size("duplicates") == 0) & (F.size("missing") == 0) & (F.size("empty") == 0))


def merge_languages(es: DataFrame, en: DataFrame, previous: DataFrame) -> DataFrame:
    """article_id, language, hash, title, embedded_at (kept from previous entries of equal hash, else null) and status (new, kept, reprocessed).
    es, en: articulo, article_id, title, text; previous: article_id, language, hash, embedded_at."""
    both = es.withColumn("language", F.lit("es")).unionByName(en.withColumn("language", F.lit("en")))
    now = both.select("article_id", "articulo", "language", "title", content_hash(F.col("text")).alias("hash"))
    was = previous.select("article_id", "language", F.col("hash").alias("old"), "embedded_at")
    met = now.join(was, ["article_id", "language"], "left")
    same = F.coalesce(F.col("hash") == F.col("old"), F.lit(False))
    return met.select("article_id", "articulo", "language", "title", "hash", F.when(same, F.col("embedded_at")).alias("embedded_at"), F.when(F.col("old").isNull(), "new").when(same, "kept").otherwise("reprocessed").alias("status"))


def integrity(manifest: DataFrame, processed: DataFrame) -> DataFrame:
    """Entries of the manifest (article_id, language, hash) whose text is missing or hashes otherwise, with fault."""
    met = manifest.join(processed.select("article_id", "language", content_hash(F.col("text")).alias("actual")), ["article_id", "language"], "left")
    fault = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("hash"), "mismatch")
    return met.withColumn("fault", fault).where(F.col("fault").isNotNull()).select("article_id", "language", "fault")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """existing with rows of new in place of those of their keys; of rows of new with one key the last by order stays."""
    last = new.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__k = 1").drop("__k")
    return existing.join(last.select(key), key, "left_anti").unionByName(last)


def of_article(article_id: str, language: str) -> Column:
    """Whether a chunk_id is an article's or one of its paragraphs' in a language. Ids hold a-z, 0-9, _, . and - only."""
    if not article_id or any(c not in "abcdefghijklmnopqrstuvwxyz0123456789_.-" for c in article_id):
        raise ValueError(f"not an article id: {article_id!r}")
    return (F.col("chunk_id") == f"{article_id}.{language}") | (F.col("chunk_id").startswith(f"{article_id}.") & F.col("chunk_id").endswith(f".{language}"))


def delete_article(chunks: DataFrame, article_id: str, language: str) -> DataFrame:
    """chunks without an article's and its paragraphs' of a language."""
    return chunks.where(~of_article(article_id, language))


def stale(manifest: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Entries to chunk and embed anew: those without chunks or of another model; all if force."""
    return manifest if force else manifest.where((F.size("chunks") == 0) | ~F.col("embedding_model").eqNullSafe(model))


def numeric_first(article: str):
    """Order of articles: numbers by value, then all else."""
    return [F.coalesce(F.expr(f"try_cast({article} as int)"), F.lit(10**9)), F.col(article)]


def stats(manifest: DataFrame, by: str, model: str) -> DataFrame:
    """by, n_articles, n_chunks, n_embedded and n_stale, of entries (by, chunks array, embedding_model)."""
    return manifest.groupBy(by).agg(F.count("*").alias("n_articles"), F.sum(F.size("chunks")).alias("n_chunks"), F.count("embedding_model").alias("n_embedded"), F.count_if((F.size("chunks") == 0) | ~F.col("embedding_model").eqNullSafe(model)).alias("n_stale"))


def summary(changes: DataFrame) -> DataFrame:
    """corpus and how many articles were added, removed, changed and left unchanged, of changes (corpus, status)."""
    return changes.groupBy("corpus").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("added", "removed", "changed", "unchanged")])
