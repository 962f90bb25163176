"""URL filters: rules by host and path, and for other URLs the ratio of two character language models.

The URLs that rules allow and those that they block train a variable-order Markov model each, of contexts up to three
characters, smoothed after Witten and Bell: with n(cx) counts, N(c) their sum and T(c) the different characters
after a context c, P(x|c) = (n(cx) + T(c) P(x|c')) / (N(c) + T(c)), c' being c without its first character; a
context that a model has not seen passes to c' as it is, and before the empty one every character has 1/256.

The log ratio of both models at a character is a sum over the n-grams that end there: what each adds to its suffix
if either model has it, else what its context's escape adds. So a URL's log-likelihood difference is a sum of one
weight for each of its substrings of up to four characters, and scoring is a join and a sum. It is divided by the length,
and URLs at or above the threshold are allowed. Three in sixteen ruled URLs, by a hash, aren't trained on but calibrate: the
threshold lies between the mean scores of both kinds of these, at as many of their standard deviations from either. Where
they, or those left to train on, lack a kind, all ruled URLs train and calibrate.

Edge cases: a null URL is an empty one; without :// host and path are empty and no rule fits; rules are compared by
whole host labels; repeated URLs count as often as they come; without URLs of both kinds the models say nothing and
`otherwise` decides. Input columns stay; a result column replaces one of its name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, without

ORDER = 4
#: A broadcast of more rows than this is left to Spark's own choice; scores don't depend on it.
BROADCAST_ROWS = 200_000


def lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host, then path from its first slash) that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        own_host, own_path = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(own_path)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def substrings(urls: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep, and g and at_end: each substring of up to ORDER characters of the column u, marked at both ends."""
    # a URL becomes hundreds of rows, so that URLs are dealt out by their number, not by their few bytes
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = urls.repartition(parts, "u").withColumn("s", F.concat(F.lit("\x02"), "u", F.lit("\x03")))
    each = f"flatten(transform(sequence(1, length(s)), i -> transform(sequence(1, least({ORDER}, length(s) - i + 1)), k -> struct(substring(s, i, k) as g, i + k > length(s) as at_end))))"
    return marked.select(*keep, F.explode(F.expr(each)).alias("x")).select(*keep, "x.g", "x.at_end")


def weights(training: DataFrame) -> tuple[DataFrame, float]:
    """g, gram (what it adds where it occurs) and context (what it adds where a character follows), of training URLs
    u with allowed (0 or 1) and n (how often); and what every character adds."""
    counts = stored(substrings(training, "allowed", "n").groupBy("g").agg(F.sum(F.col("allowed") * F.col("n")).alias("a"), F.sum((1 - F.col("allowed")) * F.col("n")).alias("b")).withColumns({"c": F.substring("g", F.lit(1), F.length("g") - 1), "m": F.length("g")}), "grams")
    contexts = counts.groupBy("c").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"))
    escape = lambda n, t: F.when(F.col(n) > 0, F.col(t) / (F.col(n) + F.col(t))).otherwise(F.lit(1.0))
    contexts = stored(contexts.withColumns({"ea": escape("na", "ta"), "eb": escape("nb", "tb")}).withColumn("l", F.log("ea") - F.log("eb")), "contexts")
    joined = counts.join(contexts, "c")
    p = lambda n, total, e, low: F.when(F.col(total) > 0, F.col(n) / (F.col(total) + F.col(f"t{n}")) + F.col(e) * low).otherwise(low)
    levels: list[DataFrame] = []
    for m in range(1, ORDER + 1):
        own = joined.where(F.col("m") == m)
        if m == 1:
            own = own.withColumns({"la": F.lit(1 / 256), "lb": F.lit(1 / 256)})
        else:
            low = levels[-1].select(F.col("g").alias("suffix"), F.col("pa").alias("la"), F.col("pb").alias("lb"))
            own = own.withColumn("suffix", F.substring("g", F.lit(2), F.length("g") - 1)).join(low, "suffix")
        levels.append(own.select("g", "l", "la", "lb", p("a", "na", "ea", F.col("la")).alias("pa"), p("b", "nb", "eb", F.col("lb")).alias("pb")))
    every = reduce(DataFrame.unionByName, levels)
    gram = F.log("pa") - F.log("pb") - F.log("la") + F.log("lb") - F.col("l")
    of_context = contexts.select(F.col("c").alias("g"), F.col("l").alias("context"))
    out = stored(every.select("g", gram.alias("gram")).join(of_context, "g", "left").fillna(0.0, ["context"]), "weights")
    empty = contexts.where("c = ''").first()
    return out, float(empty.l) if empty else 0.0


def scores(urls: DataFrame, model: tuple[DataFrame, float]) -> DataFrame:
    """u and score, for distinct u."""
    table, every = model
    table = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    found = substrings(urls, "u").join(table, "g").groupBy("u").agg(F.sum(F.col("gram") + F.when(F.col("at_end"), 0.0).otherwise(F.col("context"))).alias("sum"))
    size = F.length("u") + 2
    return urls.join(found, "u", "left").select("u", (F.coalesce("sum", F.lit(0.0)) / size + every).alias("score"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and score (of the models, for all URLs)."""
    kept = without(pages, ["host", "path", "rule", "verdict", "score"])
    of = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    ruled = kept.withColumns({"__q_url": of, "host": host(of), "path": path(of)}).withColumns({"rule": rule, "__q_says": says})
    distinct = ruled.groupBy(F.col("__q_url").alias("u")).agg(F.count("*").alias("n"), F.max(F.col("__q_says")).alias("says"))
    distinct = stored(distinct.withColumn("held", F.substring(F.md5(F.col("u").cast("binary")), 1, 1).isin("0", "1", "2")), "urls")
    training = distinct.where("says is not null").withColumn("allowed", (F.col("says") == "allow").cast("int"))
    kinds = {(r.allowed, r.held) for r in training.select("allowed", "held").distinct().collect()}
    if len({allowed for allowed, _ in kinds}) < 2:
        return ruled.withColumns({"verdict": F.coalesce("__q_says", F.lit(otherwise)), "score": F.lit(None).cast("double")}).drop("__q_url", "__q_says")
    apart = len(kinds) == 4
    scored = stored(scores(distinct.select("u"), weights(training.where("not held") if apart else training)), "scores")
    calibrating = training.where("held") if apart else training
    stats = {r.allowed: r for r in calibrating.join(scored, "u").groupBy("allowed").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("score") ** 2 * F.col("n")) / F.sum("n") - (F.sum(F.col("score") * F.col("n")) / F.sum("n")) ** 2)).alias("sd")).collect()}
    a, b = stats[1], stats[0]
    threshold = (a["mean"] * b["sd"] + b["mean"] * a["sd"]) / (a["sd"] + b["sd"]) if a["sd"] + b["sd"] > 1e-9 else (a["mean"] + b["mean"]) / 2
    judged = scored.select(F.col("u").alias("__q_url"), "score", F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("__q_model"))
    return ruled.join(judged, "__q_url").withColumn("verdict", F.coalesce("__q_says", "__q_model")).select(*[F.col(f"`{c}`") for c in kept.columns], "host", "path", "rule", "verdict", "score")
