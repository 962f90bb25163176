"""Verdicts from citations up: findings, answers, panels of judges, documents.

Verdicts are pass, block and requires_human_review. Each level is one grouping whose partial counts combine before
the shuffle; ordered texts are put in order after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, BLOCK, REVIEW = "pass", "block", "requires_human_review"


def findings(audited: DataFrame) -> DataFrame:
    """answer_id, finding_ix, passed (any citation validated), n, n_invalid, paraphrase_only (every invalid citation fails check 3) and reasons, of audited citations."""
    bad = ~F.col("validated")
    invalid = F.sort_array(F.collect_list(F.when(bad, F.struct("citation_ix", F.coalesce("reason", F.lit("no-reason")).alias("reason")))))
    return audited.groupBy("answer_id", "finding_ix").agg(
        F.bool_or("validated").alias("passed"),
        F.count("*").alias("n"),
        F.count_if(bad).alias("n_invalid"),
        F.coalesce(F.every(F.when(bad, F.coalesce(F.col("failed_check") == 3, F.lit(False)))), F.lit(True)).alias("paraphrase_only"),
        F.array_join(F.transform(invalid, lambda x: x["reason"]), " | ").alias("reasons"),
    )


def answers(of_findings: DataFrame) -> DataFrame:
    """answer_id, verdict, reason (null for pass), n_findings, n_citations and n_invalid.

    Without blocked findings two invalid citations ask for review; where findings are blocked by paraphrases
    alone the answer passes, else it is blocked if all are and reviewed if some are.
    """
    notes = F.sort_array(F.collect_list(F.when(F.col("n_invalid") > 0, F.struct("finding_ix", "n_invalid", "n", "reasons"))))
    text = lambda x: F.format_string("Finding #%d: %d of %d citations invalid (%s).", x["finding_ix"], x["n_invalid"], x["n"], x["reasons"])
    out = of_findings.groupBy("answer_id").agg(
        F.count("*").alias("n_findings"),
        F.sum("n").alias("n_citations"),
        F.sum("n_invalid").alias("n_invalid"),
        F.count_if(~F.col("passed")).alias("n_blocked"),
        F.coalesce(F.every(F.when(~F.col("passed"), F.col("paraphrase_only"))), F.lit(True)).alias("soft"),
        notes.alias("notes"),
    )
    verdict = (
        F.when(F.col("n_blocked") == 0, F.when(F.col("n_invalid") >= 2, REVIEW).otherwise(PASS))
        .when(F.col("soft"), PASS)
        .when(F.col("n_blocked") == F.col("n_findings"), BLOCK)
        .otherwise(REVIEW)
    )
    out = out.withColumn("verdict", verdict)
    head = F.format_string("%s: %d of %d citations invalid.", F.upper("verdict"), F.col("n_invalid"), F.col("n_citations"))
    reason = F.when(F.col("verdict") != PASS, F.array_join(F.concat(F.array(head), F.transform("notes", text)), " "))
    return out.select("answer_id", "verdict", reason.alias("reason"), "n_findings", "n_citations", "n_invalid")


def council(votes: DataFrame) -> DataFrame:
    """case_id, verdict, agreement, n_ok and n_ok_block, of votes (case_id, vote, ok). Two equal votes that are ok decide; fewer ask for review."""
    ok = F.col("ok")
    counts = votes.groupBy("case_id").agg(F.count_if(ok).alias("n_ok"), *[F.count_if(ok & (F.col("vote") == v)).alias(v) for v in (PASS, BLOCK, REVIEW)])
    top = F.greatest(PASS, BLOCK, REVIEW)
    verdict = F.when(top < 2, REVIEW).when(F.col(PASS) == top, PASS).when(F.col(BLOCK) == top, BLOCK).otherwise(REVIEW)
    agreement = F.when(F.col("n_ok") < 3, "degraded").when(top >= 3, "unanimous").when(top == 2, "majority").otherwise("split")
    return counts.select("case_id", verdict.alias("verdict"), agreement.alias("agreement"), "n_ok", F.col(BLOCK).alias("n_ok_block"))


def votes(cases: DataFrame, judges: DataFrame, replies: DataFrame) -> DataFrame:
    """case_id, mode, provider, vote, reason, ok and error, a row for each case and judge, whatever came back.

    judges: mode, provider, has_key, the panel's few rows; replies: case_id, mode and reply, JSON of vote (PASS, BLOCK or REQUIRES_HUMAN_REVIEW in any case)
    and reason, null where the call failed. A judge without a key isn't asked; repeated replies are votes of their own; it, a failed call and a reply without a valid vote ask for review and aren't ok.
    """
    asked = cases.select("case_id").join(F.broadcast(judges), F.lit(True))  # a panel's few rows
    met = asked.join(replies.select("case_id", "mode", "reply"), ["case_id", "mode"], "left")
    read = F.from_json("reply", "struct<vote:string,reason:string>", {"mode": "PERMISSIVE"})
    vote = F.lower(read["vote"])
    error = F.when(~F.col("has_key"), "provider_key_absent").when(F.col("reply").isNull(), "failed").when(~F.coalesce(vote.isin(PASS, BLOCK, REVIEW), F.lit(False)), "no_valid_vote")
    reason = F.when(~F.col("has_key"), F.concat(F.lit("judge_skipped_no_key:"), F.col("provider"))).when(error.isNotNull(), "judge_failed").otherwise(F.left(F.coalesce(read["reason"], F.lit("")), F.lit(500)))
    return met.select("case_id", "mode", "provider", F.when(error.isNull(), vote).otherwise(REVIEW).alias("vote"), reason.alias("reason"), error.isNull().alias("ok"), error.alias("error"))


def review(of_judges: DataFrame, answer_verdicts: DataFrame) -> DataFrame:
    """What council gives for votes, with diverges (from the answer's verdict) and reason."""
    met = council(of_judges).join(answer_verdicts.select("case_id", F.col("verdict").alias("__own")), "case_id")
    reason = F.when(F.col("n_ok") == 0, "council_unavailable: 0/3 judges responded").otherwise(F.format_string("%d/3 judges ok; %s -> %s", "n_ok", "agreement", "verdict"))
    return met.withColumns({"diverges": F.col("verdict") != F.col("__own"), "reason": reason}).drop("__own")


def bind(answer_verdicts: DataFrame, panels: DataFrame) -> DataFrame:
    """Verdict and reason after the panel (case_id, n_ok, n_ok_block): a pass that three or more judges block without exception is reviewed; nothing is ever relaxed."""
    fires = (F.col("verdict") == PASS) & F.coalesce((F.col("n_ok") >= 3) & (F.col("n_ok") == F.col("n_ok_block")), F.lit(False))
    text = F.format_string("COUNCIL_BIND: %d/%d judges voted BLOCK; promoted pass -> requires_human_review. Original auditor reason: %s.", F.col("n_ok_block"), F.col("n_ok"), F.coalesce("reason", F.lit("None")))
    met = answer_verdicts.join(panels.select("case_id", "n_ok", "n_ok_block"), "case_id", "left")
    return met.select("case_id", F.when(fires, REVIEW).otherwise(F.col("verdict")).alias("verdict"), F.when(fires, text).otherwise(F.col("reason")).alias("reason"), fires.alias("bound"))


def trigger(verdict: Column, any_high: Column, injected: Column, override: Column) -> Column:
    """Why a panel is called, or not_triggered: the first of these that holds."""
    return (
        F.when(verdict.isNull() | injected, "not_triggered")
        .when(F.coalesce(~override, F.lit(False)), "not_triggered")
        .when(F.coalesce(override, F.lit(False)), "api_override")
        .when(verdict == REVIEW, "auditor_rhr")
        .when(any_high, "high_severity")
        .otherwise("not_triggered")
    )


def documents(segments: DataFrame) -> DataFrame:
    """doc_id, verdict, reason and counts, of segments (doc_id, segment_id, skipped, verdict). Skipped segments count as blocked by an instruction, segments without a verdict as reviewed."""
    skipped = F.coalesce("skipped", F.lit(False))
    kinds = {"block": ~skipped & F.coalesce(F.col("verdict") == BLOCK, F.lit(False)), "inj": skipped, "review": ~skipped & ~F.coalesce(F.col("verdict").isin(PASS, BLOCK), F.lit(False))}
    ids = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("segment_id")))), ", ")
    out = segments.groupBy("doc_id").agg(F.count_if(~skipped & F.coalesce(F.col("verdict") == PASS, F.lit(False))).alias("n_pass"), *[F.count_if(c).alias(f"n_{k}") for k, c in kinds.items()], *[ids(c).alias(f"{k}_ids") for k, c in kinds.items()])
    hard = (F.col("n_block") > 0) | (F.col("n_inj") > 0)
    part = lambda label, k, when: F.when(when, F.concat(F.lit(f"{label}:["), F.col(f"{k}_ids"), F.lit("]")))
    reason = F.concat_ws(" | ", part("block_in_segments", "block", F.col("n_block") > 0), part("injection_skipped", "inj", F.col("n_inj") > 0), part("review_in_segments", "review", (F.col("n_review") > 0) & ~hard))
    return out.select("doc_id", F.when(hard, BLOCK).when(F.col("n_review") > 0, REVIEW).otherwise(PASS).alias("verdict"), F.nullif(reason, F.lit("")).alias("reason"), "n_pass", "n_block", "n_review", "n_inj")


def divergence(panels: DataFrame) -> DataFrame:
    """One row over panels (verdict, agreement): how many there are, disagree with a pass, block without exception, or lacked a judge."""
    return panels.agg(F.count("*").alias("n_total"), F.count_if(F.col("verdict") != PASS).alias("n_diverged"), F.count_if((F.col("verdict") == BLOCK) & (F.col("agreement") == "unanimous")).alias("n_unanimous_block"), F.count_if(F.col("agreement") == "degraded").alias("n_degraded"))
