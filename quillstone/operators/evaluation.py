"""Measures of runs: citations, latency, agreement, failures, comparisons, attacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import key_matches


def precision_recall(emitted: Column, expected: Column) -> tuple[Column, Column]:
    """Of arrays of citation keys, repeated ones once: shares of emitted ones that match an expected one, and of expected ones that are matched. Both 0 where either is empty."""
    e, x = F.array_distinct(emitted), F.array_distinct(expected)
    good = F.filter(e, lambda a: F.exists(x, lambda b: key_matches(a, b)))
    covered = F.filter(x, lambda b: F.exists(e, lambda a: key_matches(a, b)))
    none = (F.size(e) < 1) | (F.size(x) < 1) | e.isNull() | x.isNull()
    return F.when(none, 0.0).otherwise(F.size(good) / F.size(e)), F.when(none, 0.0).otherwise(F.size(covered) / F.size(x))


def ranked_values(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, value, n, upto (rows up to and with this value) and total: an order statistic needs no sort of all rows, only of distinct values."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(value)
    return counts.select(*by, value, "n", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(Window.partitionBy(*by)).alias("total"))


def at_rank(value: str, rank: Column) -> Column:
    """An aggregate over ranked_values: the value of this rank, from 1."""
    return F.min(F.when(F.col("upto") >= rank, F.col(value)))


def p95(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by and p95: the 19th of 20 exclusive quantiles, toward zero as an integer. One value is its own; it may lie beyond the largest value."""
    r = ranked_values(values, value, by)
    m = F.col("total") + 1
    j = F.greatest(F.lit(1), F.least(F.floor(m * 19 / 20), F.col("total") - 1))
    out = r.groupBy(*by).agg(F.max("total").alias("n"), at_rank(value, j).alias("low"), at_rank(value, j + 1).alias("high"), F.max(m * 19 - j * 20).alias("d"))
    return out.select(*by, F.when(F.col("n") == 1, F.col("low")).otherwise((F.col("low") * (20 - F.col("d")) + F.col("high") * F.col("d")) / 20).cast("long").alias("p95"))


def lengths(values: DataFrame, value: str) -> DataFrame:
    """n, min, p5 (the value of rank n // 20 from 0), median (the middle two's mean, toward zero) and max."""
    r = ranked_values(values, value, [])
    n = F.col("total")
    out = r.agg(F.max("total").alias("n"), F.min(value).alias("min"), at_rank(value, F.floor(n / 20) + 1).alias("p5"), at_rank(value, F.floor((n + 1) / 2)).alias("a"), at_rank(value, F.floor(n / 2) + 1).alias("b"), F.max(value).alias("max"))
    return out.select("n", "min", "p5", F.floor((F.col("a") + F.col("b")) / 2).cast("long").alias("median"), "max")


def headline(cases: DataFrame) -> DataFrame:
    """One row of means over cases (expected, citation_precision, citation_recall, verdict_match, severity_match or null, cost, mode): citations over cases that expect some, severity over cases that have one; 0 where there are none."""
    some = F.size("expected") > 0
    mean = lambda c, when=F.lit(True): F.coalesce(F.avg(F.when(when, c)), F.lit(0.0))
    return cases.agg(
        F.count("*").alias("n_cases"),
        mean(F.col("citation_precision"), some).alias("citation_precision"),
        mean(F.col("citation_recall"), some).alias("citation_recall"),
        mean(F.col("verdict_match").cast("double")).alias("verdict_match"),
        mean(F.col("severity_match").cast("double")).alias("severity_match"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        mean(F.col("cost"), F.col("mode") == "chat").alias("cost_per_chat"),
        mean(F.col("cost"), F.col("mode") == "doc").alias("cost_per_doc"),
    )


def taxonomy(actual: Column, expected: Column, n_emitted: Column, recall: Column) -> Column:
    """Why a case fell short; other if its verdict is the expected one."""
    return F.when(actual == expected, "other").when(n_emitted == 0, "no_answer").when(recall > 0, "over_citation").otherwise("wrong_article")


#: Phrases of refusals; the longest that occurs names the case.
REFUSALS = [
    "no encuentro", "no encontré", "no puedo proporcionar", "el corpus no respalda", "no respalda", "no respaldada", "el contexto no apoya", "el contexto no respalda",
    "no contiene información", "información no disponible", "no se encontró", "no hay información", "no es posible responder", "no puedo responder", "no dispongo de información",
    "fuera del ámbito del corpus", "esta solicitud no puede ser atendida", "esta consulta no puede ser atendida", "no se puede atender",
    "i cannot provide", "the corpus does not support", "no information is available", "i don't have information", "out of scope of the corpus", "i'm unable to answer",
]


def refusal(answer: Column) -> Column:
    low = F.lower(answer)
    return F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in sorted(REFUSALS, key=lambda p: -len(p))])


def no_answer_class(answer: Column, sentinel: str = "(backend error)") -> tuple[Column, Column]:
    """The class of an answer without findings, and how sure it is."""
    empty, prose = (answer == "") | (answer == sentinel), F.length(F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")) > 100
    name = F.when(answer.isNull(), "analyst_raise").when(empty, "transport_error").when(refusal(answer).isNotNull(), "refusal").when(prose, "prose_without_findings").otherwise("other")
    sure = F.when(name.isin("transport_error", "refusal"), "high").when(name == "other", "low").otherwise("medium")
    return name, sure


def intervention(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """class and n to one row, or one for each of by: the class that recommends what to do, the first whose share of all passes its threshold in percent; mixed without one, none without cases."""
    rules = [("refusal", 50), ("analyst_raise", 30), ("transport_error", 30), ("prose_without_findings", 50), ("other", 30)]
    share = lambda name: F.coalesce(F.sum(F.when(F.col("class") == name, F.col("n"))), F.lit(0)) * 100 / F.sum("n")
    return counts.groupBy(*(by or [])).agg(F.coalesce(F.when(F.coalesce(F.sum("n"), F.lit(0)) == 0, "none"), *[F.when(share(name) > least, name) for name, least in rules], F.lit("mixed")).alias("recommendation"))


def mechanism(verdict: Column, n_emitted: Column, n_invalid: Column) -> Column:
    """A: review without citations; B: block with an invalid one; C: review with two or more; D: review with one; E: all else. A null count was never audited."""
    bad, review = F.coalesce(n_invalid, F.lit(0)), verdict == "requires_human_review"
    return F.when((verdict == "block") & (bad >= 1), "B").when(~review, "E").when((n_emitted >= 1) & (bad >= 2), "C").when(n_emitted == 0, "A").when(bad == 1, "D").otherwise("E")


def flips(old: DataFrame, new: DataFrame) -> DataFrame:
    """case_id, old, new and outcome (predicted, unexpected, unchanged), of runs (case_id, verdict): a review that passes was predicted, any other change was not."""
    met = old.select("case_id", F.col("verdict").alias("old")).join(new.select("case_id", F.col("verdict").alias("new")), "case_id")
    outcome = F.when(F.col("old") == F.col("new"), "unchanged").when((F.col("old") == "requires_human_review") & (F.col("new") == "pass"), "predicted").otherwise("unexpected")
    return met.select("case_id", "old", "new", outcome.alias("outcome"))


def ab_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b and delta (six places), of metrics both runs have."""
    return a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric").withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


def change(delta: Column, flat: float = 0.005) -> Column:
    return F.when(delta > flat, "improved").when(delta < -flat, "regressed").otherwise("flat")


def attacks(outcomes: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of outcomes (id, scenario, blocked, layer): per layer counts of blocked ones, 0 for layers without; per scenario n, n_blocked and block_rate; and the escaped ones as rows, so that no group of them is gathered."""
    hits = outcomes.where("blocked").groupBy("layer").agg(F.count("*").alias("n"))
    per_layer = layers.join(hits, "layer", "left").select("layer", F.coalesce("n", F.lit(0)).alias("n"))
    per_scenario = outcomes.groupBy("scenario").agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked"), F.avg(F.col("blocked").cast("double")).alias("block_rate"))
    return per_layer, per_scenario, outcomes.where("not blocked").select("scenario", "id")


def completed_rate(blocked: Column, timeout: Column, error: Column) -> Column:
    """Blocked attacks among those that ran to their end, 0 if none did."""
    done = F.count("*") - F.count_if(timeout) - F.count_if(error)
    return F.when(done > 0, F.count_if(blocked) / done).otherwise(0.0)


def results(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """A row a case: gold (case_id, expected array, expected_verdict, acceptable_verdicts array or null, expected_severity or null) with what
    answers (case_id, emitted array, verdict, severity or null) gave; a case without an answer has emitted nothing."""
    met = gold.join(answers, "case_id", "left")
    emitted = F.coalesce("emitted", F.array().cast("array<string>"))
    p, r = precision_recall(emitted, F.col("expected"))
    return met.select(
        *gold.columns,
        emitted.alias("emitted"),
        "verdict",
        "severity",
        p.alias("citation_precision"),
        r.alias("citation_recall"),
        acceptable(F.col("verdict"), F.col("expected_verdict"), F.col("acceptable_verdicts")).alias("verdict_match"),
        F.when(F.col("expected_severity").isNotNull(), F.coalesce(F.col("severity") == F.col("expected_severity"), F.lit(False))).alias("severity_match"),
    )


def acceptable(actual: Column, expected: Column, also: Column) -> Column:
    """Whether a verdict is the expected one or, where a list says which others are, one of those; never for null."""
    return F.coalesce((actual == expected) | F.coalesce(F.array_contains(also, actual), F.lit(False)), F.lit(False))


def recount(runs: DataFrame, whitelist: DataFrame) -> DataFrame:
    """runs (case_id, verdict, verdict_match) with verdict_match counted anew for cases of the whitelist (case_id, acceptable array)."""
    met = runs.join(whitelist.select("case_id", F.col("acceptable").alias("__ok")), "case_id", "left")
    return met.withColumn("verdict_match", F.when(F.col("__ok").isNotNull(), F.coalesce(F.array_contains("__ok", F.col("verdict")), F.lit(False))).otherwise(F.col("verdict_match"))).drop("__ok")


def run_means(cases: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Plain means of columns by run, cases that expect nothing among them."""
    return cases.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in columns])


def change_counts(deltas: DataFrame, flat: float = 0.005) -> DataFrame:
    """One row: how many metrics improved, stayed flat and regressed."""
    kind = change(F.col("delta"), flat)
    return deltas.agg(*[F.count_if(kind == k).alias(f"n_{k}") for k in ("improved", "flat", "regressed")])


def emitted_of_segments(segments: DataFrame) -> DataFrame:
    """case_id and the distinct keys that a document's segments (case_id, emitted array or null) emit, in order."""
    return segments.groupBy("case_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("emitted")))).alias("emitted"))


def in_pool(expected: Column, pool: Column) -> tuple[Column, Column]:
    """Of expected keys those that a pool has, and those that it lacks."""
    return F.array_intersect(expected, pool), F.array_except(expected, pool)


def first_severity(findings: Column) -> Column:
    """The severity of the first finding; null without one."""
    return F.try_element_at(findings, F.lit(1))["severity"]


def cached_answers(cases: DataFrame, cache: DataFrame) -> DataFrame:
    """cases (query, …) with the answer and file that the first file of a cache (query, actual_answer, file) has for their query."""
    first = cache.groupBy("query").agg(F.min_by("actual_answer", "file").alias("actual_answer"), F.min("file").alias("file"))
    return cases.join(first, "query", "left")


def first_cases(cases: DataFrame, n: int) -> DataFrame:
    """Of cases (case_id, mode) the first n chats and the first n // 3 documents by id."""
    part = lambda mode, k: cases.where(F.col("mode") == mode).orderBy("case_id").limit(k)
    return part("chat", n).unionByName(part("doc", n // 3))


def crosstab(rows: DataFrame, of: str, kind: str) -> DataFrame:
    """of, kind, n and its share of all rows with the same of."""
    counts = rows.groupBy(of, kind).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(of)))


def merged(header: DataFrame, *reports: DataFrame) -> DataFrame:
    """Cases of several reports under one header (a row): each with the header's columns and the number of its report."""
    every = [r.withColumn("report", F.lit(i)) for i, r in enumerate(reports)]
    out = every[0]
    for r in every[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.crossJoin(F.broadcast(header.limit(1)))


def with_judged(cases: DataFrame, scores: DataFrame, metrics: list[str], key: str = "case_id", skip: bool = False) -> DataFrame:
    """cases with a judge's scores (key, metric, score) as columns, 0 where there is none, where it isn't a number or isn't from 0 to 1, and everywhere if the judge is skipped: an optional
    instrument that is down never takes a case away. Of repeated scores the last by score counts."""
    if skip:
        return cases.withColumns({m: F.lit(0.0) for m in metrics})
    own = F.nanvl(F.col("score"), F.lit(None).cast("double"))
    wide = scores.groupBy(key).agg(*[F.max(F.when((F.col("metric") == m) & own.between(0, 1), own)).alias(m) for m in metrics])
    return cases.join(wide, key, "left").withColumns({m: F.coalesce(m, F.lit(0.0)) for m in metrics})
