"""Who may ask, and what can be looked up: tenants, providers, articles and their paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.corpus import numeric_first

#: Fixed value: the least length of a token.
MIN_TOKEN = 16
TENANT = "id string, token string, corpora array<string>, rate_limit string"


def tenants(spark: SparkSession, inline: str | None = None, path: str | None = None, token: str | None = None) -> DataFrame:
    """The registry (id, token_hash, corpora or null for all, rate_limit), of a JSON array given inline, else of a file, else of one token for a single
    tenant named default. Tokens are hashed at once; short and repeated ones and repeated ids are errors."""
    if inline:
        own = spark.createDataFrame([(inline,)], "value string").select(F.explode(F.from_json("value", f"array<struct<{','.join(f.replace(' ', ':') for f in TENANT.split(', '))}>>")).alias("t")).select("t.*")
    elif path:
        own = spark.read.schema(TENANT).json(path, multiLine=True)
    else:
        own = spark.createDataFrame([("default", token, None, None)] if token else [], TENANT)
    return registry(own)


def registry(own: DataFrame) -> DataFrame:
    """Rows of TENANT as a registry, checked."""
    short = own.where(F.coalesce(F.length("token"), F.lit(0)) < MIN_TOKEN).limit(1).count()
    if short:
        raise ValueError(f"a token needs {MIN_TOKEN} characters")
    for column in ("id", "token"):
        if own.groupBy(column).count().where("count > 1").limit(1).count():
            raise ValueError(f"repeated {column}")
    return own.select("id", F.sha2(F.col("token").cast("binary"), 256).alias("token_hash"), "corpora", "rate_limit")


def with_tenant(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """requests (token, …) with tenant_id, corpora and rate_limit of the token's tenant in place of the token, and known."""
    own = requests.withColumn("token_hash", F.sha2(F.col("token").cast("binary"), 256)).drop("token")
    met = own.join(tenants.withColumnRenamed("id", "tenant_id"), "token_hash", "left")
    return met.withColumn("known", F.col("tenant_id").isNotNull()).drop("token_hash")


def key_present(calls: DataFrame, providers: DataFrame) -> DataFrame:
    """calls (mode, provider or null) with the provider that takes them (their own, else the mode's) and has_key; a provider that nobody knows of counts as there.
    providers: mode, provider, has_key."""
    by_mode = providers.where("mode is not null").select("mode", F.col("provider").alias("__of_mode"))
    met = calls.join(by_mode, "mode", "left").withColumn("provider", F.coalesce("provider", "__of_mode")).drop("__of_mode")
    keys = providers.groupBy("provider").agg(F.bool_or("has_key").alias("has_key"))
    return met.join(keys, "provider", "left").withColumn("has_key", F.coalesce("has_key", F.lit(True)))


def article_ids(articles: DataFrame) -> DataFrame:
    """norma, language and articulos: all numbers in lexical order, 10 before 2."""
    return articles.groupBy("norma", "language").agg(F.array_sort(F.collect_set("articulo")).alias("articulos"))


def paragraph_ids(paragraphs: Column) -> Column:
    """apartado of each paragraph, in the order of the document."""
    return F.transform(paragraphs, lambda p: p["apartado"])


def numbered(articles: DataFrame) -> DataFrame:
    """articles in order of their numbers, what isn't a number last."""
    return articles.orderBy(*numeric_first("articulo"))


def hint(ids: Column, n: int = 10) -> Column:
    """The first n of an array, and whether there are more."""
    return F.concat(F.array_join(F.slice(ids, F.lit(1), F.lit(n)), ", "), F.when(F.size(ids) > n, "...").otherwise(""))


def fetch(wanted: DataFrame, articles: DataFrame) -> DataFrame:
    """wanted (norma, articulo, language) with title and text, or with a fault that names the first articles there are."""
    keys = ["norma", "articulo", "language"]
    met = wanted.join(articles.select(*keys, "title", "text", F.lit(True).alias("__there")), keys, "left").join(article_ids(articles), ["norma", "language"], "left")
    fault = F.when(F.col("__there").isNull(), F.concat(F.lit("not found; there are: "), hint(F.coalesce("articulos", F.array().cast("array<string>")))))
    return met.select(*wanted.columns, "title", "text", fault.alias("fault"))


def payload(reports: DataFrame) -> DataFrame:
    """Reports as they are shown: the sanitizer's log is left out, segments have six fields."""
    fields = ["segment_id", "title", "verdict", "skipped", "n_citations", "n_invalid"]
    segments = F.transform("segments", lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return reports.drop("sanitizer_log").withColumn("segments", segments)


def trace(turns: DataFrame) -> DataFrame:
    """turns (verdict or null, findings array with verdict and citations with validated) with counts and a verdict that is never null."""
    of = lambda keep: F.aggregate("findings", F.lit(0), lambda a, f: a + F.coalesce(F.size(F.filter(f["citations"], keep)), F.lit(0)))
    some = lambda c: F.coalesce(c, F.lit(0))
    counts = {"n_findings": F.size("findings"), "n_citations": of(lambda c: F.lit(True)), "n_validated": of(lambda c: c["validated"]), "n_blocked": F.size(F.filter("findings", lambda f: f["verdict"] == "block"))}
    return turns.withColumns({"verdict": F.coalesce("verdict", F.lit("no_answer")), **{k: some(c) for k, c in counts.items()}})
