"""The audit log: rows without the questions themselves, tenants, limits, retention, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: US dollars for a million tokens in and out, by model, and two rates of euros to the dollar.
PRICING = [("claude-sonnet-4-6", 3.0, 15.0), ("claude-haiku-4-5-20251001", 1.0, 5.0), ("gpt-4o", 2.5, 10.0), ("gpt-4o-mini", 0.15, 0.6), ("llama-3.3-70b-versatile", 0.59, 0.79), ("mistral-small-latest", 0.1, 0.3)]
EUR_MODELS, EUR_CACHE = 0.93, 0.92


def record(turns: DataFrame) -> DataFrame:
    """turns with query_hash in place of query: null for null and empty ones."""
    return turns.withColumn("query_hash", F.sha2(F.nullif("query", F.lit("")).cast("binary"), 256)).drop("query")


def of_tenant(log: DataFrame, tenant: str | int | None) -> DataFrame:
    """Null is a tenant of its own here."""
    return log.where(F.col("tenant_id").eqNullSafe(F.lit(tenant)))


def count_turns(log: DataFrame, since: str | None = None) -> DataFrame:
    return (log.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else log).groupBy("tenant_id").agg(F.count("*").alias("n"))


def recent(log: DataFrame, n: int, tenant: str | int | None = None, scoped: bool = True) -> DataFrame:
    """The n newest rows, newest first; of all tenants if not scoped."""
    return (of_tenant(log, tenant) if scoped else log).orderBy(F.desc("id")).limit(n)


def export(log: DataFrame, tenant: str | int | None) -> DataFrame:
    return of_tenant(log, tenant).orderBy("id")


def erase(log: DataFrame, tenant: str | int | None) -> DataFrame:
    return log.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant)))


def dsr_tenant(name: Column) -> Column:
    """The tenant that a request names: none, default and - mean rows without one."""
    return F.when(F.coalesce(F.trim(name), F.lit("")).isin("", "default", "-"), F.lit(None).cast("string")).otherwise(name)


def retained(log: DataFrame, now: Column, days: int = 365) -> DataFrame:
    return log.where(F.col("ts") >= now - F.make_interval(days=F.lit(days)))


def rate_limited(requests: DataFrame, per_minute: int, key: str = "tenant_id") -> DataFrame:
    """requests (id, ts, key) with minute and over: beyond the first per_minute of a key in its minute."""
    minute = requests.withColumn("minute", F.date_trunc("minute", "ts"))
    place = F.row_number().over(Window.partitionBy(key, "minute").orderBy("ts", "id"))
    return minute.withColumn("over", place > per_minute)


def limit_key(tenant: Column, token_hash: Column, ip: Column) -> Column:
    return F.coalesce(F.concat(F.lit("tenant:"), tenant), F.concat(F.lit("token:"), token_hash), F.concat(F.lit("ip:"), ip))


def allowed(requested: Column, allowlist: Column) -> Column:
    """Whether all requested corpora are allowed; a null list allows all."""
    return F.coalesce(allowlist.isNull() | F.forall(requested, lambda c: F.array_contains(allowlist, c)), F.lit(False))


def cost(usage: DataFrame, prices: DataFrame, eur: float = EUR_MODELS) -> DataFrame:
    """usage (model, tokens_in, tokens_out) with cost_eur; unknown models cost nothing. prices: model, usd_in, usd_out."""
    met = usage.join(prices, "model", "left")
    usd = F.col("tokens_in") / 1e6 * F.col("usd_in") + F.col("tokens_out") / 1e6 * F.col("usd_out")
    return met.withColumn("cost_eur", F.coalesce(usd * eur, F.lit(0.0))).drop("usd_in", "usd_out")


def pricing(spark) -> DataFrame:
    """Few rows, a price list."""
    return spark.createDataFrame(PRICING, "model string, usd_in double, usd_out double")


def health(checks: DataFrame) -> DataFrame:
    """ok if every critical check (name, status, critical) is ok or present."""
    good = F.col("status").isin("ok", "present")
    return checks.agg(F.coalesce(F.every(F.when(F.col("critical"), good)), F.lit(True)).alias("ok"), F.count_if(~good).alias("n_bad"))


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (key, …) that the cache (key, response) answers, at no cost, and those that it doesn't."""
    return requests.join(cache, "key").withColumn("cost_eur", F.lit(0.0)), requests.join(cache, "key", "left_anti")
