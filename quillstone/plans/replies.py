"""Queries on replies: rounds of retries with feedback, and cases that fail without ending a run. Conversations stand for cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import replies
from quillstone.sources import tables

from .catalog import query

#: What the stand-in for a model does by the case's number: attempts until the case ends, feedback on the way, what ends it.
_COURSE = """(VALUES (0, 1, '', NULL), (1, 2, 'findings', NULL), (2, 3, 'citations,text', NULL), (3, 3, 'findings,findings', 'malformed after 2 retries: 1 faults, the first missing at findings'), (4, 1, '', 'no answer in attempt 1'),
              (5, 2, 'other', NULL), (6, 3, 'other,other', 'malformed after 2 retries: 2 faults, the first literal_error at language'), (7, 2, 'other', NULL), (8, 2, 'citations', 'no answer in attempt 2'), (9, 2, 'text', NULL))"""


def _reply():
    """Replies of a stand-in: a valid one with the case's text, and faults by the case's number that some feedback mends."""
    k, attempt, kind = F.col("k"), F.col("attempt"), F.col("kind")
    said = F.left(F.concat(F.lit("x"), F.col("text")), F.lit(40))

    def answer(language="en", text=said, findings=True, quote=said, severity="low"):
        cited = F.array(F.struct(F.lit("rgpd").alias("norma"), F.col("turn").cast("string").alias("articulo"), F.lit("es").alias("language"), quote.alias("text")))
        found = F.array(F.struct(said.alias("text"), F.lit(severity).alias("severity"), cited.alias("citations")))
        return F.to_json(F.struct(F.lit("q").alias("query"), F.lit(language).alias("language"), text.alias("text"), *([(found if findings else F.expr("slice(array(1), 1, 0)")).alias("findings")] if findings is not None else [])))

    good, says = answer(), lambda *kinds: F.coalesce(kind.isin(*kinds), F.lit(False))
    return (
        F.when(k == 1, F.when(says("findings"), good).otherwise(answer(findings=False)))
        .when(k == 2, F.when(says("text"), good).when(says("citations"), answer(text=F.lit(""))).otherwise(answer(quote=F.lit(" \t"))))
        .when(k == 3, answer(findings=None))
        .when(k == 4, F.concat(F.lit("I can't say: "), said))
        .when(k == 5, F.when(says("other"), good).otherwise(answer(severity="severe")))
        .when(k == 6, answer(language="fr", findings=None))
        .when(k == 7, F.when(says("other"), good).otherwise(F.lit('{"query": "q", "language": "en", "text": "t", "findings": "none"}')))
        .when(k == 8, F.when(attempt == 1, answer(quote=F.lit(""))).otherwise(F.lit('["no", "object"]')))
        .when(k == 9, F.when(says("text"), good).otherwise(answer(text=F.lit(None).cast("string"), findings=True)))
        .otherwise(good)
    )


@query(f"""
    SELECT conv_id, turn, CAST(attempts AS INTEGER) AS attempts, kinds, error, CASE WHEN error IS NULL THEN left('x' || coalesce(text, ''), 40) END AS quote
    FROM (SELECT *, (conv_id * 7 + turn) % 10 AS k FROM conversations) JOIN {_COURSE} c(k, attempts, kinds, error) USING (k)
""")
def retry_rounds(table):
    """At most three rounds, in which only failing cases go on; feedback decides what the stand-in does next."""
    cases = table("conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), ((F.col("conv_id") * 7 + F.col("turn")) % 10).alias("k"))
    out = replies.ask_again(cases, _reply(), normas=["rgpd"])
    return out.select("conv_id", "turn", "attempts", F.array_join("kinds", ",").alias("kinds"), "error", F.col("answer.findings")[0]["citations"][0]["text"].alias("quote"))


_RECORDS = """
    r AS (SELECT conv_id, turn, 'c' || (conv_id * 10 + turn) AS case_id, (conv_id * 3 + turn) % 9 AS k, length(text) AS n FROM conversations),
    rec AS (SELECT *, '{"expected":"' || CASE k WHEN 3 THEN 'maybe' ELSE ['pass', 'block', 'requires_human_review'][n % 3 + 1] END || '","actual":"' || ['pass', 'block', 'requires_human_review'][n % 2 + 1] || '","good":' || (n % 7) || ',"emitted":' || CASE k WHEN 5 THEN '0' ELSE CAST(n % 7 + 1 AS VARCHAR) END
                   || ',"cost":"' || CASE k WHEN 6 THEN 'free' ELSE CAST(n / 100.0 AS VARCHAR) END || '"' || CASE k WHEN 1 THEN '' WHEN 2 THEN ',"extra":[1,' ELSE '}' END AS record FROM r)
"""


def _records(table):
    c, word = table("conversations"), lambda i: F.element_at(F.array(F.lit("pass"), F.lit("block"), F.lit("requires_human_review")), (i + 1).cast("int"))
    n, k = F.length("text"), (F.col("conv_id") * 3 + F.col("turn")) % 9
    record = F.concat(
        F.lit('{"expected":"'), F.when(k == 3, "maybe").otherwise(word(n % 3)), F.lit('","actual":"'), word(n % 2), F.lit('","good":'), (n % 7).cast("string"), F.lit(',"emitted":'), F.when(k == 5, "0").otherwise((n % 7 + 1).cast("string")),
        F.lit(',"cost":"'), F.when(k == 6, "free").otherwise((n / 100).cast("string")), F.lit('"'), F.when(k == 1, "").when(k == 2, ',"extra":[1,').otherwise("}"),
    )
    return c.select("conv_id", "turn", record.alias("record"))


@query(f"""
    WITH {_RECORDS}, p AS (SELECT *, json_valid(record) AS ok, CASE WHEN json_valid(record) THEN record END AS j FROM rec),
         v AS (SELECT *, j->>'expected' AS expected, j->>'actual' AS actual, TRY_CAST(j->>'good' AS DOUBLE) AS good, TRY_CAST(j->>'emitted' AS DOUBLE) AS emitted, TRY_CAST(j->>'cost' AS DOUBLE) AS cost FROM p),
         e AS (SELECT *, CASE WHEN NOT ok THEN 'verdict_match: unreadable record' WHEN expected NOT IN ('pass', 'block', 'requires_human_review') THEN 'verdict_match: no such verdict: ' || expected WHEN emitted = 0 THEN 'precision: nothing emitted' WHEN cost IS NULL THEN 'cost: not a number: ' || (j->>'cost') END AS error FROM v)
    SELECT conv_id, turn, CASE WHEN error IS NULL THEN expected = actual ELSE coalesce(expected = 'requires_human_review', false) END AS verdict_match, CASE WHEN error IS NULL THEN round(good / emitted, 9) ELSE 0 END AS precision, CASE WHEN error IS NULL THEN round(cost, 6) ELSE 0 END AS cost, error, error IS NOT NULL AS failed, CASE WHEN error IS NOT NULL THEN record END AS failed_record FROM e
""")
def case_errors(table):
    """A run of cases in which some records are cut off or wrong: each keeps its row, with its error and the record, and the run goes on. Failed rows are written apart."""
    verdicts = ["pass", "block", "requires_human_review"]
    rows = _records(table).withColumn("r", F.from_json("record", "struct<expected:string,actual:string,good:double,emitted:double,cost:string,bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    r = F.col("r")
    fallback = F.coalesce((r["expected"] == "requires_human_review") & r["bad"].isNull(), F.lit(False))
    wrong = F.when(r["bad"].isNotNull(), "unreadable record").when(~r["expected"].isin(verdicts), F.concat(F.lit("no such verdict: "), r["expected"]))
    steps = {
        "verdict_match": (r["expected"] == r["actual"], wrong, fallback),
        "precision": (F.round(F.try_divide(r["good"], r["emitted"]), 9), F.when(F.try_divide(r["good"], r["emitted"]).isNull(), "nothing emitted"), F.lit(0.0)),
        "cost": (F.round(r["cost"].try_cast("double"), 6), F.when(r["cost"].try_cast("double").isNull(), F.concat(F.lit("not a number: "), r["cost"])), F.lit(0.0)),
    }
    captured = replies.capture(rows, steps, F.col("record")).drop("r", "record")
    good, failed = replies.write_apart(captured, tables.fresh(rows.sparkSession, "cases"))
    return good.withColumn("failed", F.lit(False)).unionByName(failed.withColumn("failed", F.lit(True)))
