"""Queries on what surrounds the operators: guards, projections, look-ups, tenants. The driver's tables stand for requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.operators import access, corpus, service, verdict

from .catalog import query


def _pick(k, *words):
    """One of the words, by k; None is null."""
    return F.element_at(F.array(*[F.lit(w) for w in words]).cast("array<string>"), (k % len(words) + 1).cast("int"))


@query("SELECT page_id, page_id % 4 = 0 AS allowed FROM pages")
def fetch_allowlist(table):
    url = F.concat(_pick(F.col("page_id"), "https://eur-lex.europa.eu/x?", "https://eur-lex.europa.eu.evil.org/", "https://www.eur-lex.europa.eu/", "no url "), F.col("page_id").cast("string"))
    return table("pages").select("page_id", service.fetch_allowed(url).alias("allowed"))


@query("""
    WITH u AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '%PDF-1.7 ' ELSE '' END || CASE WHEN doc_id % 25 = 0 THEN '' ELSE text END AS content, ['a.pdf', 'b.MD', 'c.markdown', 'd.txt'][doc_id % 4 + 1] AS name FROM documents),
         m AS (SELECT *, CASE WHEN starts_with(content, '%PDF-') THEN 'application/pdf' WHEN regexp_matches(lower(name), '[.](md|markdown)$') THEN 'text/markdown' END AS mime FROM u)
    SELECT doc_id, mime, CASE WHEN content = '' THEN 'empty' WHEN coalesce(mime, 'application/pdf') = 'application/pdf' AND doc_id % 10 < 9 AND mime IS NULL THEN 'unsupported_type' WHEN mime IS NULL AND doc_id % 10 = 9 THEN 'not_a_pdf' WHEN doc_id % 7 = 0 THEN 'unsupported_language' WHEN doc_id % 11 = 0 THEN 'unknown_corpus' END AS fault,
           CASE WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime IS NOT NULL THEN 'markdown' END AS reader FROM m
""")
def upload_faults(table):
    k = F.col("doc_id")
    content = F.concat(F.when(k % 6 == 0, "%PDF-1.7 ").otherwise(""), F.when(k % 25 == 0, "").otherwise(F.col("text"))).cast("binary")
    own = table("documents").select("doc_id", content.alias("content"), _pick(k, "a.pdf", "b.MD", "c.markdown", "d.txt").alias("name"))
    own = own.withColumn("found", service.mime_of(F.col("content"), F.col("name")))
    own = own.withColumns({"mime": F.when(F.col("found").isNull() & (k % 10 == 9), "application/pdf").otherwise(F.col("found")), "language": F.when(k % 7 == 0, "fr").otherwise("es"), "corpus": F.when(k % 11 == 0, F.array(F.lit("gdpr"), F.lit("none"))).otherwise(F.array(F.lit("gdpr")))})
    reader = F.when(F.col("found").isNotNull(), service.dispatch(F.col("found")))
    return own.select("doc_id", F.col("found").alias("mime"), service.upload_fault(own, ["gdpr", "dora"]).alias("fault"), reader.alias("reader"))


@query("""
    WITH e AS (SELECT event_id, user_id % 4 > 0 AS skipped, [NULL, 'injection: x', 'parse error', 'fake-tag'][event_id % 4 + 1] AS reason FROM events)
    SELECT event_id, CASE WHEN NOT skipped THEN 'clean' WHEN reason IS NOT NULL AND NOT contains(lower(reason), 'error') THEN 'injection_blocked' ELSE 'internal_error' END AS category, CASE WHEN NOT skipped THEN 'clean' WHEN coalesce(contains(reason, 'injection'), false) THEN 'injection_blocked' ELSE 'internal_error' END AS strict FROM e
""")
def skip_categories(table):
    reason = _pick(F.col("event_id"), None, "injection: x", "parse error", "fake-tag")
    skipped = F.col("user_id") % 4 > 0
    return table("events").select("event_id", service.skip_category(skipped, reason).alias("category"), service.skip_category(skipped, reason, True).alias("strict"))


def _findings(table):
    """Lines of an order as findings, each with a citation."""
    li = table("lineitem")
    of = F.struct("l_linenumber", F.when(F.col("l_partkey") % 9 == 0, "high").otherwise("low").alias("severity"), _pick(F.col("l_suppkey"), "pass", "block", "requires_human_review").alias("verdict"), F.array(F.struct((F.col("l_quantity") > 10).alias("validated"), (F.col("l_partkey") % 5).cast("string").alias("key"))).alias("citations"))
    return li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(of)).alias("findings"))


_LINES = "x AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey % 9 = 0 AS high, ['pass', 'block', 'requires_human_review'][l_suppkey % 3 + 1] AS v, l_quantity > 10 AS ok, CAST(l_partkey % 5 AS VARCHAR) AS norma FROM lineitem), l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i, NOT high, v, ok, norma) AS pos FROM x)"


@query(f"""
    WITH {_LINES}, n AS (SELECT k, count(*) AS n, count(*) FILTER (high OR (v <> 'pass' AND NOT ok)) AS s FROM l GROUP BY k), f AS (SELECT k, CASE WHEN high THEN 'high' ELSE 'low' END AS first FROM l WHERE pos = 1)
    SELECT k, CASE WHEN s > 0 THEN s ELSE n END AS n_review, first AS first_severity FROM n JOIN f USING (k)
""")
def findings_under_review(table):
    from quillstone.operators import evaluation

    return _findings(table).select("k", F.size(service.under_review(F.col("findings"))).cast("long").alias("n_review"), evaluation.first_severity(F.col("findings")).alias("first_severity"))


@query(f"""
    WITH {_LINES}, t AS (SELECT k, count(*) AS n, count(*) FILTER (ok) AS good, count(*) FILTER (v = 'block') AS b FROM l GROUP BY k)
    SELECT k, CASE WHEN k % 4 = 0 THEN 'no_answer' ELSE 'pass' END AS verdict, n AS n_findings, n AS n_citations, good AS n_validated, b AS n_blocked FROM t
""")
def verdict_trace(table):
    own = _findings(table).withColumn("verdict", F.when(F.col("k") % 4 > 0, "pass"))
    return access.trace(own).select("k", "verdict", *[F.col(c).cast("long").alias(c) for c in ("n_findings", "n_citations", "n_validated", "n_blocked")])


@query(f"""
    WITH {_LINES}, f AS (SELECT k, norma, min(pos) AS i FROM l GROUP BY ALL), s AS (SELECT k, string_agg(norma, ',' ORDER BY i) AS sources FROM f GROUP BY k), n AS (SELECT k, count(*) AS n, count(*) FILTER (ok) AS good FROM l GROUP BY k)
    SELECT k, CASE WHEN k % 4 > 0 THEN 'block' WHEN k % 8 = 0 THEN 'blocked_injection' ELSE 'no_answer' END AS status, n AS n_citations, good AS n_validated, sources FROM n JOIN s USING (k)
""")
def turn_states(table):
    """Answers as they are shown, with their sources in the order in which they come."""
    own = _findings(table).select("k", F.when(F.col("k") % 4 > 0, "block").alias("verdict"), (F.col("k") % 8 == 0).alias("injected"), F.flatten(F.transform("findings", lambda f: f["citations"])).alias("citations"))
    out = service.state(own)
    return out.select("k", "status", F.col("n_citations").cast("long").alias("n_citations"), F.col("n_validated").cast("long").alias("n_validated"), F.array_join(service.first_sources(F.transform("citations", lambda c: c["key"])), ",").alias("sources"))


@query(f"WITH {_LINES} SELECT k, 'k,segments' AS columns, string_agg(i || ':' || v, ',' ORDER BY pos) AS segments FROM l GROUP BY k")
def redacted_payload(table):
    segments = F.transform("findings", lambda f: F.struct(f["l_linenumber"].alias("segment_id"), F.lit("t").alias("title"), f["verdict"].alias("verdict"), F.lit(False).alias("skipped"), F.lit(1).alias("n_citations"), F.lit(0).alias("n_invalid"), F.lit("secret").alias("raw_text")))
    out = access.payload(_findings(table).select("k", segments.alias("segments"), F.lit("log").alias("sanitizer_log")))
    assert "raw_text" not in str(out.schema)
    return out.select("k", F.lit(",".join(out.columns)).alias("columns"), F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["segment_id"].cast("string"), s["verdict"])), ",").alias("segments"))


@query("""
    SELECT doc_id, 'https://eur-lex.europa.eu/legal-content/' || upper(lang) || '/TXT/?uri=CELEX:' || doc_id AS url, 'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:' || doc_id AS url_en, CASE WHEN doc_id % 3 = 0 THEN source || chr(10) ELSE '' END || lang AS question, CASE WHEN length(source) < 50 THEN rpad(source, 50, ' ') ELSE source END AS padded,
           lang || '-doc-' || doc_id AS slug, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '.' || doc_id % 4 END AS key, doc_id % 4 > 0 AND doc_id % 5 > 0 OR doc_id % 4 = 0 AND doc_id % 5 > 0 AS part_of, CASE WHEN doc_id % 6 < 4 THEN NULL ELSE 't' || doc_id END AS tenant, doc_id % 7 IN (0, 1, 2) AS limit_ok, printf('%+.2f', doc_id / 7.0 - 20) AS delta FROM documents
""")
def request_fields(table):
    k, lang = F.col("doc_id"), F.col("lang")
    id_ = k.cast("string")
    paragraph = F.when(k % 4 > 0, (k % 4).cast("string")).otherwise(F.when(k % 8 == 0, "").otherwise(None))
    key = text.citation_key(id_, paragraph)
    limits = _pick(k, "10/minute", " 5 per hour", "007/2 days", "0/minute", "x/minute", "10/fortnight", "-1/day")
    return table("documents").select(
        "doc_id", service.source_url(id_, lang).alias("url"), service.source_url(id_).alias("url_en"), service.question(F.when(k % 3 == 0, F.col("source")).otherwise(F.when(k % 3 == 1, "")), lang).alias("question"), service.padded(F.col("source")).alias("padded"),
        text.slug(F.concat(F.lit("  "), F.upper(lang), F.lit(" — Dóc. "), id_)).alias("slug"), key.alias("key"), text.article_matches(key, F.when(k % 5 > 0, id_).otherwise(F.concat(id_, F.lit("0")))).alias("part_of"),
        _tenant(k, id_).alias("tenant"), service.rate_limit_ok(limits).alias("limit_ok"), text.signed(k / 7 - 20).alias("delta"),
    )


def _tenant(k, id_):
    from quillstone.operators import audit

    return audit.dsr_tenant(F.when(k % 6 == 0, "").when(k % 6 == 1, "default").when(k % 6 == 2, "-").when(k % 6 > 3, F.concat(F.lit("t"), id_)))


@query("""
    SELECT event_id, CASE WHEN user_id % 5 = 0 OR event_type = 'error' THEN 'not_triggered' WHEN event_id % 3 = 1 THEN 'not_triggered' WHEN event_id % 3 = 2 THEN 'api_override' WHEN user_id % 5 = 1 THEN 'auditor_rhr' WHEN user_id % 7 = 0 THEN 'high_severity' ELSE 'not_triggered' END AS reason,
           CASE WHEN user_id % 2 = 0 AND event_id % 4 > 0 THEN CASE WHEN event_id % 8 = 1 THEN 'The panel changed this verdict (split).' ELSE 'The panel disagrees with this verdict (split).' END END AS notice FROM events
""")
def council_triggers(table):
    k, u = F.col("event_id"), F.col("user_id")
    why = verdict.trigger(F.when(u % 5 > 0, F.when(u % 5 == 1, "requires_human_review").otherwise("pass")), u % 7 == 0, F.col("event_type") == "error", F.when(k % 3 == 1, False).when(k % 3 == 2, True))
    notice = service.council_notice(F.lit("split"), u % 2 == 0, k % 4, F.when(k % 8 == 1, "COUNCIL_BIND: x"))
    return table("events").select("event_id", why.alias("reason"), notice.alias("notice"))


@query("""
    SELECT event_id, CAST(CASE WHEN k IN (1, 8) THEN user_id ELSE 50 END AS INTEGER) AS pre_rerank, CAST(CASE WHEN k = 1 THEN 3 ELSE 5 END AS INTEGER) AS top_k, CASE WHEN k = 2 THEN user_id / 1000.0::DOUBLE ELSE 0.6 END AS purity_threshold, CAST(CASE WHEN k = 8 THEN NULL ELSE 2 END AS INTEGER) AS max_per_group
    FROM (SELECT event_id, user_id, event_id % 10 AS k FROM events)
""")
def config_overrides(table):
    """Settings as JSON text: known keys of the right kind, or the defaults for all of them."""
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 10
    said = (
        F.when(k == 1, F.concat(F.lit('{"pre_rerank": '), u, F.lit(', "top_k": 3}'))).when(k == 2, F.concat(F.lit('{"purity_threshold": '), (F.col("user_id") / 1000).cast("string"), F.lit("}")))
        .when(k == 3, F.concat(F.lit('{"top_k": 3, "unknown": '), u, F.lit("}"))).when(k == 4, F.concat(F.lit('{"top_k": "'), u, F.lit('"}'))).when(k == 5, F.concat(F.lit("{not json "), u))
        .when(k == 6, F.lit('{"top_k": true}')).when(k == 7, F.lit("[1]")).when(k == 8, F.concat(F.lit('{"pre_rerank": '), u, F.lit(', "max_per_group": null}'))).when(k == 9, "")
    )
    own = table("events").select("event_id", service.config_columns(said).alias("c"))
    return own.select("event_id", "c.pre_rerank", "c.top_k", "c.purity_threshold", "c.max_per_group")


@query("""
    WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'en' END AS language, ['docs', ' ', NULL][doc_id % 8 // 3 + 1] AS norma, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'x' END AS articulo, CASE WHEN doc_id % 17 = 0 THEN chr(9) || ' ' ELSE text END AS text FROM documents)
    SELECT coalesce(language IN ('es', 'en') AND trim(norma) <> '' AND articulo <> '' AND regexp_replace(text, '\\s', '', 'g') <> '', false) AS valid, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM c GROUP BY ALL
""")
def citation_quarantine(table):
    k = F.col("doc_id")
    c = table("documents").select("doc_id", F.when(k % 3 == 0, F.col("lang")).otherwise("en").alias("language"), F.when(k % 8 < 3, "docs").when(k % 8 < 6, " ").alias("norma"), F.when(k % 13 == 0, "").otherwise("x").alias("articulo"), F.when(k % 17 == 0, "\t ").otherwise(F.col("text")).alias("text"))
    good, bad = service.quarantine(c, service.valid_citation())
    return good.select("doc_id", F.lit(True).alias("valid")).unionByName(bad.select("doc_id", F.lit(False).alias("valid"))).groupBy("valid").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("""
    SELECT event_id, coalesce(p, m) AS provider, coalesce(p, m) <> 'b' AS has_key FROM (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'other' WHEN user_id % 3 = 1 THEN 'b' END AS p, CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS m FROM events)
""")
def provider_keys(table):
    e = table("events")
    calls = e.select("event_id", F.when(F.col("event_id") % 2 == 0, "main").otherwise("spare").alias("mode"), F.when(F.col("user_id") % 3 == 0, "other").when(F.col("user_id") % 3 == 1, "b").alias("provider"))
    providers = e.sparkSession.createDataFrame([("main", "a", True), ("spare", "b", False)], "mode string, provider string, has_key boolean")
    return access.key_present(calls, providers).select("event_id", "provider", "has_key")


@query("""
    SELECT event_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 't' || user_id % 4 END AS tenant_id, user_id % 4 > 0 AS known, user_id % 4 = 2 OR (user_id % 4 = 1 AND event_type = 'view') AS allowed FROM events
""")
def tenant_requests(table):
    """Requests with their token's tenant, and whether it may ask about the corpus."""
    from quillstone.operators import audit

    e = table("events")
    inline = '[{"id": "t1", "token": "token-number-one-1", "corpora": ["view"]}, {"id": "t2", "token": "token-number-two-2"}, {"id": "t3", "token": "token-number-three", "corpora": []}]'
    token = F.when(F.col("user_id") % 4 == 0, "unknown").otherwise(_pick(F.col("user_id") % 4 - 1 + 3, "token-number-one-1", "token-number-two-2", "token-number-three"))
    met = access.with_tenant(e.select("event_id", "event_type", token.alias("token")), access.tenants(e.sparkSession, inline))
    return met.select("event_id", "tenant_id", "known", (F.col("known") & audit.allowed(F.array("event_type"), F.col("corpora"))).alias("allowed"))


@query("""
    WITH n AS (SELECT n_nationkey AS k, 'n' || n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ['BUILDING', 'MACHINERY'] ELSE [] END AS corpora, CASE WHEN n_nationkey % 2 = 0 THEN '5/minute' END AS rate_limit FROM nation)
    SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN id END AS tenant_id, c_custkey % 5 > 0 AND (k % 3 = 0 OR coalesce(list_contains(corpora, c_mktsegment), false)) AS allowed, CASE WHEN c_custkey % 5 > 0 THEN rate_limit END AS rate_limit, CASE WHEN c_custkey % 2 = 0 THEN 'default' END AS single FROM customer JOIN n ON k = c_nationkey
""")
def tenants_of_file(table):
    """A registry from a JSON file, and one of a single token, for the same requests."""
    from quillstone.operators import audit
    from quillstone.sources import tables

    n = F.col("n_nationkey")
    corpora = F.when(n % 3 == 1, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).when(n % 3 == 2, F.array().cast("array<string>"))
    own = F.struct(F.concat(F.lit("n"), n.cast("string")).alias("id"), F.format_string("token-of-nation-%d", n).alias("token"), corpora.alias("corpora"), F.when(n % 2 == 0, "5/minute").alias("rate_limit"))
    spark, path = table("nation").sparkSession, tables.fresh(table("nation").sparkSession, "tenants")
    table("nation").agg(F.to_json(F.collect_list(own)).alias("value")).coalesce(1).write.text(path)  # a registry is one file
    k = F.col("c_custkey")
    requests = table("customer").select(k, "c_mktsegment", F.when(k % 5 > 0, F.format_string("token-of-nation-%d", "c_nationkey")).otherwise("nobody").alias("token"))
    met = access.with_tenant(requests, access.tenants(spark, path=path))
    met = met.select("c_custkey", "tenant_id", (F.col("known") & audit.allowed(F.array("c_mktsegment"), F.col("corpora"))).alias("allowed"), "rate_limit")
    alone = access.with_tenant(table("customer").select(k, F.when(k % 2 == 0, "the-only-token-there-is").otherwise("another").alias("token")), access.tenants(spark, token="the-only-token-there-is"))
    return met.join(alone.select("c_custkey", F.col("tenant_id").alias("single")), "c_custkey")


def _articles(table):
    k = F.col("doc_id")
    return table("documents").select((k % 3).cast("string").alias("norma"), k.cast("string").alias("articulo"), F.col("lang").alias("language"), F.col("source").alias("title"), F.concat(F.lit("t"), k.cast("string")).alias("text"))


_ARTICLES = "a AS (SELECT CAST(doc_id % 3 AS VARCHAR) AS norma, CAST(doc_id AS VARCHAR) AS articulo, lang AS language, source AS title, 't' || doc_id AS text FROM documents)"


@query(f"""
    WITH {_ARTICLES}, h AS (SELECT norma, language, list_sort(list(articulo)) AS ids FROM a GROUP BY ALL), w AS (SELECT CAST(c_custkey % 3 AS VARCHAR) AS norma, CAST(c_custkey AS VARCHAR) AS articulo, 'en' AS language FROM customer)
    SELECT norma, articulo, language, title, text, CASE WHEN text IS NULL THEN 'not found; there are: ' || array_to_string(ids[1:10], ', ') || CASE WHEN len(ids) > 10 THEN '...' ELSE '' END END AS fault FROM w LEFT JOIN a USING (norma, articulo, language) JOIN h USING (norma, language)
""")
def fetch_articles(table):
    k = F.col("c_custkey")
    wanted = table("customer").select((k % 3).cast("string").alias("norma"), k.cast("string").alias("articulo"), F.lit("en").alias("language"))
    return access.fetch(wanted, _articles(table))


@query(f"WITH {_ARTICLES} SELECT norma, language, string_agg(articulo, ',' ORDER BY articulo) AS lexical, string_agg(articulo, ',' ORDER BY CAST(articulo AS INT)) AS numeric_order FROM a GROUP BY ALL")
def article_lists(table):
    own = _articles(table)
    number = [c.alias(f"o{i}") for i, c in enumerate(corpus.numeric_first("articulo"))]
    in_order = own.groupBy("norma", "language").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*number))), lambda s: s["o1"]), ",").alias("numeric_order"))
    return access.article_ids(own).join(in_order, ["norma", "language"]).select("norma", "language", F.array_join("articulos", ",").alias("lexical"), "numeric_order")


@query("SELECT doc_id, string_agg(k || ':', ',' ORDER BY k DESC) AS apartados, '[1] docs: ' || lang || chr(10) || '[2] more: ' || source AS context FROM (SELECT doc_id, lang, source, unnest(range(1, doc_id % 4 + 2)) AS k FROM documents) GROUP BY doc_id, lang, source")
def paragraph_lists(table):
    parts = F.transform(F.reverse(F.sequence(F.lit(1), F.col("doc_id") % 4 + 1)), lambda i: F.struct(F.concat(i.cast("string"), F.lit(":")).alias("apartado"), F.lit("x").alias("text")))
    chunks = F.array(F.struct(F.lit("docs").alias("article_id"), F.col("lang").alias("text")), F.struct(F.lit("more").alias("article_id"), F.col("source").alias("text")))
    return table("documents").select("doc_id", F.array_join(access.paragraph_ids(parts), ",").alias("apartados"), service.numbered_context(chunks).alias("context"))


@query("SELECT doc_id, greatest(0, len(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS n_tokens FROM documents")
def exact_token_count(table):
    """Counts of a tokenizer that is loaded from outside, here one of a pattern."""

    def load():
        import re

        return lambda texts: [len(re.findall("[A-Za-z0-9]+", t)) for t in texts]

    return table("documents").select("doc_id", text.exact_tokens(load)(F.col("text")).alias("n_tokens"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '2001:db8:' || (user_id % 9 + 1) || '::/48' WHEN user_id % 3 = 1 THEN (user_id % 256) || '.1.2.0/24' END AS net FROM events")
def redacted_addresses(table):
    u = F.col("user_id")
    octet = lambda n: (u % n).cast("string")
    ip = F.when(u % 3 == 0, F.concat(F.lit("2001:db8:"), (u % 9 + 1).cast("string"), F.lit("::9"))).when(u % 3 == 1, F.concat(octet(256), F.lit(".1.2.9"))).otherwise("no address")
    return table("events").select("event_id", text.redact_ip6(ip).alias("net"))
