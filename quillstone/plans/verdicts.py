"""Queries on citations, verdicts and measures. Benchmark items stand for citations of documents; conversations, labels, orders and events stand for runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import citation, evaluation, verdict

from .catalog import query
from .texts import _NORM


def _audited(table):
    """Each document is cited by one item, that of its number modulo the number of items. Items by their number modulo 6: 0 quotes documents, 1 names articles
    that don't exist, 2 paraphrases; of the others' citations those of documents divisible by 7 name an article that doesn't exist, by 11 a paragraph."""
    docs, items = table("documents"), table("benchmark")
    n, d, m = items.agg(F.count("*").alias("n_items")), F.col("doc_id"), F.col("item_id") % 6
    keyed = docs.join(F.broadcast(n), F.lit(True)).withColumn("item_id", d % F.col("n_items"))  # one row with a count
    cites = keyed.select("doc_id", "item_id", F.col("text").alias("whole")).join(items.select("item_id", "text"), "item_id")
    gone = F.when(m == 0, False).when(m == 1, True).when(m == 2, False).otherwise(d % 7 == 0)
    paragraph = F.when(m.isin(0, 2), F.when(d % 5 == 0, "1")).otherwise(F.when(d % 11 == 0, "9").when(d % 5 == 0, "1"))
    own = F.when(~gone, F.substring("whole", 5, 40))
    quote = F.when(m == 0, own).when(m == 2, F.col("text")).when(d % 13 == 0, F.left("text", F.lit(12))).when(d % 3 == 0, own).otherwise(F.col("text"))
    cites = cites.select("item_id", "doc_id", F.lit("docs").alias("norma"), F.when(gone, F.concat(F.lit("x"), d.cast("string"))).otherwise(d.cast("string")).alias("articulo"), paragraph.alias("apartado"), F.lit("en").alias("language"), quote.alias("text"))
    articles = docs.select(F.lit("docs").alias("norma"), d.cast("string").alias("articulo"), F.lit("en").alias("language"), "text")
    return citation.audit(cites, articles, articles.withColumn("apartado", F.lit("1")))


_AUDIT_SQL = f"""
    linked AS (SELECT b.item_id, d.doc_id, b.item_id % 6 AS m, b.text AS said, d.text, CASE b.item_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE d.doc_id % 7 <> 0 END AS there FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
    cites AS (SELECT item_id, doc_id, there, CASE WHEN m IN (0, 2) THEN CASE WHEN doc_id % 5 = 0 THEN '1' END WHEN doc_id % 11 = 0 THEN '9' WHEN doc_id % 5 = 0 THEN '1' END AS apartado, {_NORM.format("text")} AS t,
                     {_NORM.format("CASE WHEN m = 0 THEN substr(text, 5, 40) WHEN m = 2 THEN said WHEN doc_id % 13 = 0 THEN left(said, 12) WHEN doc_id % 3 = 0 THEN CASE WHEN there THEN substr(text, 5, 40) END ELSE said END")} AS c FROM linked),
    audited AS (SELECT item_id, doc_id, CASE WHEN NOT there THEN 1 WHEN apartado = '9' THEN 2 WHEN length(c) < 20 THEN 4 WHEN NOT coalesce(contains(t, c), false) THEN 3 END AS failed_check, there, apartado FROM cites)
"""


@query(f"WITH {_AUDIT_SQL} SELECT item_id, doc_id, failed_check IS NULL AS validated, there AS article_exists, CASE WHEN apartado IS NOT NULL THEN there AND apartado = '1' END AS apartado_exists, failed_check FROM audited")
def citation_audit(table):
    return _audited(table).select("item_id", "doc_id", "validated", "article_exists", "apartado_exists", "failed_check")


_FINDINGS = """
    f AS (SELECT item_id AS answer_id, doc_id // 200 AS finding_ix, bool_or(failed_check IS NULL) AS passed, count(*) AS n, count(failed_check) AS n_invalid, coalesce(bool_and(failed_check = 3) FILTER (failed_check IS NOT NULL), true) AS soft FROM audited GROUP BY ALL)
"""


def _findings(table):
    own = _audited(table).select(F.col("item_id").alias("answer_id"), F.floor(F.col("doc_id") / 200).alias("finding_ix"), F.col("doc_id").alias("citation_ix"), "validated", "failed_check", F.concat(F.lit("check_"), F.col("failed_check").cast("string")).alias("reason"))
    return verdict.findings(own)


@query(f"WITH {_AUDIT_SQL}, {_FINDINGS} SELECT answer_id, finding_ix, passed, n, n_invalid, soft AS paraphrase_only FROM f")
def finding_verdicts(table):
    return _findings(table).select("answer_id", "finding_ix", "passed", "n", "n_invalid", "paraphrase_only")


@query(f"""
    WITH {_AUDIT_SQL}, {_FINDINGS}, a AS (SELECT answer_id, count(*) AS n_findings, CAST(sum(n) AS BIGINT) AS n_citations, CAST(sum(n_invalid) AS BIGINT) AS n_invalid, count(*) FILTER (NOT passed) AS n_blocked, coalesce(bool_and(soft) FILTER (NOT passed), true) AS soft FROM f GROUP BY ALL)
    SELECT answer_id, CASE WHEN n_blocked = 0 THEN CASE WHEN n_invalid >= 2 THEN 'requires_human_review' ELSE 'pass' END WHEN soft THEN 'pass' WHEN n_blocked = n_findings THEN 'block' ELSE 'requires_human_review' END AS verdict, n_findings, n_citations, n_invalid FROM a
""")
def answer_verdicts(table):
    return verdict.answers(_findings(table)).drop("reason")


def _segments(table):
    c = table("conversations")
    v = F.when(F.length("text") % 5 == 0, "block").when(F.length("text") % 3 == 0, "requires_human_review").when(F.length("text") % 7 != 0, "pass")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("segment_id"), (F.length("text") % 11 == 0).alias("skipped"), v.alias("verdict"))


@query("""
    WITH s AS (SELECT conv_id AS doc_id, turn, length(text) % 11 = 0 AS skipped, CASE WHEN length(text) % 5 = 0 THEN 'block' WHEN length(text) % 3 = 0 THEN 'requires_human_review' WHEN length(text) % 7 <> 0 THEN 'pass' END AS v FROM conversations),
         d AS (SELECT doc_id, count(*) FILTER (NOT skipped AND v = 'pass') AS n_pass, count(*) FILTER (NOT skipped AND v = 'block') AS n_block, count(*) FILTER (NOT skipped AND (v IS NULL OR v = 'requires_human_review')) AS n_review, count(*) FILTER (skipped) AS n_inj,
                      string_agg(turn, ', ' ORDER BY turn) FILTER (NOT skipped AND v = 'block') AS b, string_agg(turn, ', ' ORDER BY turn) FILTER (skipped) AS i, string_agg(turn, ', ' ORDER BY turn) FILTER (NOT skipped AND (v IS NULL OR v = 'requires_human_review')) AS r FROM s GROUP BY doc_id)
    SELECT doc_id, CASE WHEN n_block + n_inj > 0 THEN 'block' WHEN n_review > 0 THEN 'requires_human_review' ELSE 'pass' END AS verdict,
           nullif(concat_ws(' | ', 'block_in_segments:[' || b || ']', 'injection_skipped:[' || i || ']', CASE WHEN n_block + n_inj = 0 THEN 'review_in_segments:[' || r || ']' END), '') AS reason, n_pass, n_block, n_review, n_inj FROM d
""")
def document_verdicts(table):
    return verdict.documents(_segments(table))


_VOTES = "SELECT order_id AS case_id, CASE p % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'block' ELSE 'requires_human_review' END AS vote, q > 5 AS ok FROM (SELECT l_orderkey AS order_id, l_partkey AS p, l_quantity AS q FROM lineitem WHERE l_linenumber <= 3)"


def _votes(table):
    li = table("lineitem").where("l_linenumber <= 3")
    return li.select(F.col("l_orderkey").alias("case_id"), F.element_at(F.array(F.lit("pass"), F.lit("block"), F.lit("requires_human_review")), (F.col("l_partkey") % 3).cast("int") + 1).alias("vote"), (F.col("l_quantity") > 5).alias("ok"))


_PANEL = f"""
    v AS ({_VOTES}), c AS (SELECT case_id, count(*) FILTER (ok) AS n_ok, count(*) FILTER (ok AND vote = 'pass') AS p, count(*) FILTER (ok AND vote = 'block') AS b, count(*) FILTER (ok AND vote = 'requires_human_review') AS r FROM v GROUP BY case_id),
    panel AS (SELECT case_id, CASE WHEN greatest(p, b, r) < 2 THEN 'requires_human_review' WHEN p = greatest(p, b, r) THEN 'pass' WHEN b = greatest(p, b, r) THEN 'block' ELSE 'requires_human_review' END AS verdict,
              CASE WHEN n_ok < 3 THEN 'degraded' WHEN greatest(p, b, r) >= 3 THEN 'unanimous' WHEN greatest(p, b, r) = 2 THEN 'majority' ELSE 'split' END AS agreement, n_ok, b AS n_ok_block FROM c)
"""


@query(f"WITH {_PANEL} SELECT * FROM panel")
def council_vote(table):
    return verdict.council(_votes(table))


@query(f"WITH {_PANEL}, a AS (SELECT o_orderkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'pass' ELSE 'block' END AS verdict FROM orders) SELECT a.case_id, CASE WHEN a.verdict = 'pass' AND n_ok >= 3 AND n_ok = n_ok_block THEN 'requires_human_review' ELSE a.verdict END AS verdict, coalesce(a.verdict = 'pass' AND n_ok >= 3 AND n_ok = n_ok_block, false) AS bound FROM a LEFT JOIN panel USING (case_id)")
def council_bind(table):
    own = table("orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus").isin("F", "O"), "pass").otherwise("block").alias("verdict"), F.lit(None).cast("string").alias("reason"))
    return verdict.bind(own, verdict.council(_votes(table))).drop("reason")


@query("""
    WITH j AS (SELECT * FROM (VALUES ('a', 'one', true), ('b', 'two', true), ('c', 'three', false)) t(mode, provider, has_key)),
         r AS (SELECT l_orderkey AS case_id, ['a', 'b', 'c'][l_linenumber] AS mode, CASE l_partkey % 7 WHEN 0 THEN 'maybe' WHEN 1 THEN NULL WHEN 2 THEN 'broken' WHEN 3 THEN 'block' WHEN 4 THEN 'requires_human_review' ELSE 'pass' END AS said FROM lineitem WHERE l_linenumber <= 3),
         v AS (SELECT o_orderkey AS case_id, j.mode, provider, coalesce(has_key AND said IN ('pass', 'block', 'requires_human_review'), false) AS ok, said, CASE WHEN NOT has_key THEN 'provider_key_absent' WHEN r.case_id IS NULL OR said IS NULL THEN 'failed' WHEN said IN ('maybe', 'broken') THEN 'no_valid_vote' END AS error FROM orders, j LEFT JOIN r ON r.case_id = o_orderkey AND r.mode = j.mode)
    SELECT case_id, mode, CASE WHEN ok THEN said ELSE 'requires_human_review' END AS vote, CASE error WHEN 'provider_key_absent' THEN 'judge_skipped_no_key:' || provider WHEN NULL THEN NULL ELSE CASE WHEN error IS NULL THEN 'because ' || said ELSE 'judge_failed' END END AS reason, ok, error FROM v
""")
def council_votes(table):
    """Each judge's vote on each case: one lacks a key, some calls fail, some replies are broken or vote for what isn't known."""
    p, spark = F.col("l_partkey") % 7, table("orders").sparkSession
    said = lambda vote: F.to_json(F.struct(F.lit(vote.upper()).alias("vote"), F.lit(f"because {vote}").alias("reason")))
    reply = F.when(p == 0, said("maybe")).when(p == 2, "{broken").when(p == 3, said("block")).when(p == 4, said("requires_human_review")).when(p > 4, said("pass"))
    replies = table("lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("case_id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("l_linenumber").cast("int")).alias("mode"), reply.alias("reply"))
    judges = spark.createDataFrame([("a", "one", True), ("b", "two", True), ("c", "three", False)], "mode string, provider string, has_key boolean")
    return verdict.votes(table("orders").select(F.col("o_orderkey").alias("case_id")), judges, replies).drop("provider")


@query(f"""
    WITH {_PANEL}, a AS (SELECT o_orderkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'pass' ELSE 'block' END AS own FROM orders)
    SELECT case_id, verdict, agreement, n_ok, n_ok_block, verdict <> own AS diverges, CASE WHEN n_ok = 0 THEN 'council_unavailable: 0/3 judges responded' ELSE n_ok || '/3 judges ok; ' || agreement || ' -> ' || verdict END AS reason FROM panel JOIN a USING (case_id)
""")
def council_review(table):
    own = table("orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus").isin("F", "O"), "pass").otherwise("block").alias("verdict"))
    return verdict.review(_votes(table), own)


@query(f"WITH {_PANEL} SELECT count(*) AS n_total, count(*) FILTER (verdict <> 'pass') AS n_diverged, count(*) FILTER (verdict = 'block' AND agreement = 'unanimous') AS n_unanimous_block, count(*) FILTER (agreement = 'degraded') AS n_degraded FROM panel")
def council_divergence(table):
    return verdict.divergence(verdict.council(_votes(table)))


_CASES = """
    k AS (SELECT l_orderkey AS case_id, list(DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_partkey % 9 AS VARCHAR) ELSE (l_partkey % 9) || '.' || (l_suppkey % 3) END) FILTER (l_linenumber > 2) AS e, list(DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_partkey % 8 AS VARCHAR) ELSE (l_partkey % 8) || '.' || (l_suppkey % 2) END) FILTER (l_linenumber <= 2) AS x FROM lineitem GROUP BY ALL),
    pr AS (SELECT case_id, coalesce(len(e), 0) AS n_emitted, coalesce(len(x), 0) AS n_expected,
                  CASE WHEN coalesce(len(e), 0) = 0 OR coalesce(len(x), 0) = 0 THEN 0.0 ELSE len(list_filter(e, lambda a: len(list_filter(x, lambda b: a = b OR (NOT contains(b, '.') AND starts_with(a, b || '.')))) > 0)) / len(e) END AS precision,
                  CASE WHEN coalesce(len(e), 0) = 0 OR coalesce(len(x), 0) = 0 THEN 0.0 ELSE len(list_filter(x, lambda b: len(list_filter(e, lambda a: a = b OR (NOT contains(b, '.') AND starts_with(a, b || '.')))) > 0)) / len(x) END AS recall FROM k)
"""


def _cases(table):
    li = table("lineitem")
    key = lambda n, m, s: F.when(F.col("l_suppkey") % m == 0, (F.col("l_partkey") % n).cast("string")).otherwise(F.concat_ws(".", (F.col("l_partkey") % n).cast("string"), (F.col("l_suppkey") % s).cast("string")))
    cases = li.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set(F.when(F.col("l_linenumber") > 2, key(9, 2, 3))).alias("e"), F.collect_set(F.when(F.col("l_linenumber") <= 2, key(8, 3, 2))).alias("x"))
    p, r = evaluation.precision_recall(F.col("e"), F.col("x"))
    return cases.select("case_id", F.size("e").cast("long").alias("n_emitted"), F.size("x").cast("long").alias("n_expected"), F.col("x").alias("expected"), p.alias("precision"), r.alias("recall"))


@query(f"WITH {_CASES} SELECT case_id, n_emitted, n_expected, round(precision, 9) AS precision, round(recall, 9) AS recall FROM pr")
def citation_precision_recall(table):
    return _cases(table).select("case_id", "n_emitted", "n_expected", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


_RUN = """
    r AS (SELECT pr.*, o_orderstatus = 'F' AS verdict_match, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority LIKE '2%' END AS severity_match, o_totalprice / 1000 AS cost, CASE WHEN o_orderkey % 4 = 0 THEN 'doc' ELSE 'chat' END AS mode FROM pr JOIN orders ON o_orderkey = case_id)
"""


def _run(table):
    o = table("orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") == "F").alias("verdict_match"), F.when(~F.col("o_orderpriority").like("1%"), F.col("o_orderpriority").like("2%")).alias("severity_match"), (F.col("o_totalprice") / 1000).alias("cost"), F.when(F.col("o_orderkey") % 4 == 0, "doc").otherwise("chat").alias("mode"))
    return _cases(table).join(o, "case_id").withColumnsRenamed({"precision": "citation_precision", "recall": "citation_recall"})


@query(f"""
    WITH {_CASES}, {_RUN} SELECT count(*) AS n_cases, round(avg(precision) FILTER (n_expected > 0), 6) AS citation_precision, round(avg(recall) FILTER (n_expected > 0), 6) AS citation_recall, round(avg(CAST(verdict_match AS INT)), 6) AS verdict_match, round(coalesce(avg(CAST(severity_match AS INT)), 0), 6) AS severity_match, round(sum(cost), 2) AS total_cost,
           round(avg(cost) FILTER (mode = 'chat'), 6) AS cost_per_chat, round(avg(cost) FILTER (mode = 'doc'), 6) AS cost_per_doc FROM r
""")
def aggregate_metrics(table):
    out = evaluation.headline(_run(table))
    return out.select("n_cases", *[F.round(c, 2 if c == "total_cost" else 6).alias(c) for c in out.columns[1:]])


@query(f"WITH {_CASES}, {_RUN} SELECT CASE WHEN verdict_match THEN 'other' WHEN n_emitted = 0 THEN 'no_answer' WHEN recall > 0 THEN 'over_citation' ELSE 'wrong_article' END AS class, count(*) AS n FROM r GROUP BY ALL")
def failure_taxonomy(table):
    r = _run(table)
    name = evaluation.taxonomy(F.when(F.col("verdict_match"), "pass").otherwise("block"), F.lit("pass"), F.col("n_emitted"), F.col("citation_recall"))
    return r.groupBy(name.alias("class")).agg(F.count("*").alias("n"))


@query(f"""
    WITH {_CASES}, {_RUN}, m AS (SELECT CASE WHEN verdict_match THEN 'requires_human_review' WHEN n_expected > 1 THEN 'block' ELSE 'pass' END AS v, n_emitted AS e, CASE WHEN case_id % 6 = 0 THEN NULL ELSE case_id % 4 END AS i FROM r)
    SELECT CASE WHEN v = 'block' AND coalesce(i, 0) >= 1 THEN 'B' WHEN v <> 'requires_human_review' THEN 'E' WHEN e >= 1 AND coalesce(i, 0) >= 2 THEN 'C' WHEN e = 0 THEN 'A' WHEN coalesce(i, 0) = 1 THEN 'D' ELSE 'E' END AS bucket, count(*) AS n FROM m GROUP BY ALL
""")
def mechanism_buckets(table):
    r = _run(table)
    v = F.when(F.col("verdict_match"), "requires_human_review").when(F.col("n_expected") > 1, "block").otherwise("pass")
    return r.groupBy(evaluation.mechanism(v, F.col("n_emitted"), F.when(F.col("case_id") % 6 != 0, F.col("case_id") % 4)).alias("bucket")).agg(F.count("*").alias("n"))


@query("""
    WITH s AS (SELECT event_type, list_sort(list(CAST(value AS DOUBLE))) AS x FROM events WHERE value IS NOT NULL GROUP BY event_type),
         j AS (SELECT *, len(x) AS n, greatest(1, least((len(x) + 1) * 19 // 20, len(x) - 1)) AS j FROM s)
    SELECT event_type, CAST(trunc(CASE WHEN n = 1 THEN x[1] ELSE (x[j] * (20 - ((n + 1) * 19 - j * 20)) + x[j + 1] * ((n + 1) * 19 - j * 20)) / 20 END) AS BIGINT) AS p95 FROM j
""")
def p95_exclusive(table):
    return evaluation.p95(table("events"), "value", ["event_type"])


_AB = "SELECT 'm' || (o_custkey % 12) AS metric, o_orderdate < TIMESTAMP '1995-06-01' AS old, avg(o_totalprice) AS value FROM orders GROUP BY ALL"


@query(f"WITH m AS ({_AB}), d AS (SELECT a.metric, a.value AS a, b.value AS b, b.value - a.value AS delta FROM m a JOIN m b USING (metric) WHERE a.old AND NOT b.old) SELECT metric, round(delta, 2) AS delta, CASE WHEN delta > 0.005 THEN 'improved' WHEN delta < -0.005 THEN 'regressed' ELSE 'flat' END AS change FROM d")
def ab_delta(table):
    m = table("orders").groupBy(F.concat(F.lit("m"), (F.col("o_custkey") % 12).cast("string")).alias("metric"), (F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz")).alias("old")).agg(F.avg("o_totalprice").alias("value"))
    d = evaluation.ab_delta(m.where("old"), m.where("not old"))
    return d.select("metric", F.round("delta", 2).alias("delta"), evaluation.change(F.col("delta")).alias("change"))


_FLIP = "list_value('pass', 'block', 'requires_human_review')"


@query(f"WITH f AS (SELECT {_FLIP}[o_custkey % 3 + 1] AS old, {_FLIP}[o_orderkey % 3 + 1] AS new FROM orders) SELECT old, new, CASE WHEN old = new THEN 'unchanged' WHEN old = 'requires_human_review' AND new = 'pass' THEN 'predicted' ELSE 'unexpected' END AS outcome, count(*) AS n FROM f GROUP BY ALL")
def verdict_flips(table):
    v = lambda c: F.element_at(F.array(F.lit("pass"), F.lit("block"), F.lit("requires_human_review")), (F.col(c) % 3).cast("int") + 1).alias("verdict")
    o = table("orders")
    return evaluation.flips(o.select(F.col("o_orderkey").alias("case_id"), v("o_custkey")), o.select(F.col("o_orderkey").alias("case_id"), v("o_orderkey"))).groupBy("old", "new", "outcome").agg(F.count("*").alias("n"))


def _outcomes(table):
    return table("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("scenario"), (F.col("value") > 10).alias("blocked"), F.col("event_type").alias("layer"))


_LAYERS = ["click", "error", "purchase", "signup", "view", "never"]


@query(f"SELECT l AS layer, coalesce(n, 0) AS n FROM (SELECT unnest({_LAYERS}) AS l) LEFT JOIN (SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY ALL) ON event_type = l")
def layer_counts_zero_filled(table):
    events = _outcomes(table)
    layers = events.sparkSession.createDataFrame([(x,) for x in _LAYERS], "layer string")
    return evaluation.attacks(events, layers)[0]


@query("SELECT user_id % 10 AS scenario, count(*) AS n, count(*) FILTER (value > 10) AS n_blocked, round(avg(CASE WHEN value > 10 THEN 1.0 WHEN value <= 10 THEN 0.0 END), 6) AS block_rate FROM events GROUP BY ALL")
def scenario_block_rate(table):
    events = _outcomes(table)
    out = evaluation.attacks(events, events.select("layer").distinct())[1]
    return out.select("scenario", "n", "n_blocked", F.round("block_rate", 6).alias("block_rate"))


@query("SELECT user_id % 10 AS scenario, event_id AS id FROM events WHERE NOT value > 10")
def escaped_attacks(table):
    events = _outcomes(table)
    return evaluation.attacks(events, events.select("layer").distinct())[2]
