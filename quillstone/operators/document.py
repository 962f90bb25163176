"""Documents: sanitizing, segments, chunks, and the flow over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import screening, text
from quillstone.sources.tables import stored

#: The least content of a document, and the most segments one may have.
MIN_CONTENT, MAX_SEGMENTS = 50, 500


def block_reason(raw: DataFrame) -> Column:
    """Why a document (has_javascript, attachments, has_form_actions, uri_actions, metadata map) is blocked: the first that holds, null for none."""
    values = F.map_values("metadata")
    bad_url = lambda v: F.exists(text.urls_in(v), lambda u: ~text.url_allowed(u))
    entry = F.coalesce(F.transform(values, lambda v: F.coalesce(F.when(screening.injection(v, "document").isNotNull(), "metadata_injection_blocked"), F.when(bad_url(v), "metadata_url_blocked"))), F.array())
    return F.coalesce(
        F.when(F.col("has_javascript"), "javascript_blocked"),
        F.when(F.size("attachments") > 0, "attachment_blocked"),
        F.when(F.col("has_form_actions"), "form_action_blocked"),
        F.when(F.exists("uri_actions", lambda u: ~text.url_allowed(u)), "uri_action_blocked"),
        F.try_element_at(F.filter(entry, lambda e: e.isNotNull()), F.lit(1)),
    )


def sanitize(raw: DataFrame) -> DataFrame:
    """doc_id, clean_text, block_reason and hidden_pages, of raw documents (doc_id, pages array<struct<number, text>>, and what block_reason reads).

    clean_text has a line with its number before each page, hidden characters gone; content below MIN_CONTENT blocks too."""
    pages = raw.select("doc_id", F.posexplode_outer("pages").alias("ix", "page"), block_reason(raw).alias("reason"))
    cleaned = pages.select("doc_id", "ix", "reason", F.col("page.number").alias("number"), F.coalesce(text.has_hidden(F.col("page.text")), F.lit(False)).alias("hidden"), F.coalesce(text.strip_hidden_nfkc(F.col("page.text")), F.lit("")).alias("clean"))
    content = F.length(F.regexp_replace("clean", r"(?U)^\s+|\s+$", ""))
    out = cleaned.groupBy("doc_id").agg(F.first("reason").alias("reason"), F.sum(content).alias("content"), F.count_if("hidden").alias("hidden_pages"), F.sort_array(F.collect_list(F.struct("ix", "number", "clean"))).alias("pages"))
    whole = F.array_join(F.transform("pages", lambda p: F.concat(F.lit("\n\n--- p"), p["number"].cast("string"), F.lit(" ---\n\n"), p["clean"])), "")
    reason = F.coalesce("reason", F.when(F.col("content") < MIN_CONTENT, "document_empty_after_sanitization"))
    return out.select("doc_id", F.when(reason.isNull(), F.regexp_replace(whole, r"(?U)^\s+|\s+$", "")).alias("clean_text"), reason.alias("block_reason"), "hidden_pages")


def events(raw: DataFrame) -> DataFrame:
    """doc_id, severity, category, location and content_hash of what sanitizing finds, one row a finding; only hashes leave."""
    event = lambda severity, category, location, content: F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), location.alias("location"), text.short_hash(content).alias("content_hash"))
    js = F.when(F.col("has_javascript"), F.array(event("critical", "javascript_blocked", F.lit("document.catalog"), F.lit("javascript"))))
    form = F.when(F.col("has_form_actions"), F.array(event("critical", "form_action_blocked", F.lit("document.catalog"), F.lit("form_actions"))))
    attached = F.transform("attachments", lambda a: event("critical", "attachment_blocked", F.concat(F.lit("attachment:"), a["name"]), a["hash"]))
    links = F.slice(F.transform(F.filter("uri_actions", lambda u: ~text.url_allowed(u)), lambda u: event("critical", "uri_action_blocked", F.concat(F.lit("uri_action:"), text.short_hash(u)), u)), 1, 1)
    meta = F.transform(F.map_entries("metadata"), lambda e: event("warning", "metadata_stripped", F.concat(F.lit("metadata."), e["key"]), e["value"]))
    pages = F.transform(F.filter("pages", lambda p: text.has_hidden(p["text"])), lambda p: event("warning", "unicode_trick_stripped", F.concat(F.lit("page="), p["number"].cast("string")), p["text"]))
    first = lambda x: F.when(F.size(x) > 0, x)
    every = F.coalesce(js, first(attached), form, first(links), F.concat(meta, pages))
    return raw.select("doc_id", F.explode(every).alias("e")).select("doc_id", "e.*")


def segments(docs: DataFrame, max_tokens: int = 1500, body: str = "clean_text", outline: str | None = None, units: str = r"\n\s*\n", detect: bool = True) -> DataFrame:
    """doc_id, segment_id from 1, title, text, token_count, is_continuation.

    Sections begin at the titles of the outline (an array of strings), else, with detect, of two or more heading lines, else there is one without a title; text
    before the first located title is left out. A section's units (paragraphs, by the pattern between them) are packed under
    max_tokens.
    """
    titles = text.headings(F.col(body))
    own = F.when(F.size(titles) >= 2, titles) if detect else F.expr("cast(null as array<string>)")
    if outline:
        own = F.when(F.size(outline) >= 1, F.col(outline)).otherwise(own)
    found = docs.select("doc_id", F.col(body).alias("__text"), F.coalesce(text.located(F.col(body), own), F.array()).alias("__at"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.lit(1).alias("at"), (F.length("__text") + 1).alias("to")))
    ends = F.transform("__at", lambda s, i: F.struct(s["title"].alias("title"), s["at"].alias("at"), F.coalesce(F.try_element_at("__at", i + 2)["at"], F.length("__text") + 1).alias("to")))
    parts = found.select("doc_id", "__text", F.posexplode(F.when(F.size("__at") > 0, ends).otherwise(none)).alias("__section", "s"))
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    section = F.substring("__text", F.col("s.at"), F.col("s.to") - F.col("s.at"))
    paragraphs = F.filter(F.transform(F.split(section, units), bare), lambda p: p != "")
    packs = parts.select("doc_id", "__section", "s.title", F.posexplode(text.packed(paragraphs, max_tokens)).alias("__part", "p"))
    numbered = packs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("__section", "__part", "title", "p"))).alias("all")).select("doc_id", F.posexplode("all").alias("ix", "x"))
    return numbered.select("doc_id", (F.col("ix") + 1).alias("segment_id"), "x.title", F.array_join("x.p.units", "\n\n").alias("text"), F.col("x.p.tokens").alias("token_count"), (F.col("x.__part") > 0).alias("is_continuation"))


def chunks(articles: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """chunk_id, article_id, apartado, text, token_count, of articles (norma, articulo, language, text, paragraphs array<struct<apartado, text>>):
    the whole article if it is short or has no paragraphs, else a chunk for each paragraph."""
    whole = (text.token_count(F.col("text")) <= max_tokens) | (F.size("paragraphs") == 0)
    parts = F.when(whole, F.array(F.struct(F.lit(None).cast("string").alias("apartado"), F.col("text")))).otherwise(F.transform("paragraphs", lambda p: F.struct(p["apartado"].alias("apartado"), p["text"].alias("text"))))
    cut = articles.select("norma", "articulo", "language", F.explode(parts).alias("p"))
    article_id = F.concat_ws(".", "norma", "articulo", "p.apartado")
    return cut.select(F.concat_ws(".", article_id, "language").alias("chunk_id"), article_id.alias("article_id"), "norma", "articulo", "p.apartado", "language", "p.text", text.token_count(F.col("p.text")).alias("token_count"))


def analyze(raw: DataFrame, verdicts: DataFrame, max_tokens: int = 1500) -> DataFrame:
    """A report for each document: sanitized, cut into segments, those with instructions skipped, verdicts
    (doc_id, segment_id, verdict) rolled up, personal data counted. Blocked documents and those of too many segments are reviewed.

    Clean texts, and segments without their texts, are stored on the way, as more than one step reads them."""
    from quillstone.operators import verdict

    clean = stored(sanitize(raw), "clean")
    cut = segments(clean.where("block_reason is null"), max_tokens)
    cut = stored(cut.select("doc_id", "segment_id", screening.injection(F.col("text"), "document").isNotNull().alias("skipped")), "segments")
    judged = cut.join(verdicts, ["doc_id", "segment_id"], "left")
    reports = verdict.documents(judged)
    n = cut.groupBy("doc_id").agg(F.count("*").alias("n_segments"))
    out = clean.join(n, "doc_id", "left").join(reports, "doc_id", "left")
    over = F.coalesce(F.col("n_segments") > MAX_SEGMENTS, F.lit(False))
    held = F.col("block_reason").isNotNull() | over
    return out.select(
        "doc_id",
        F.when(held, verdict.REVIEW).otherwise(F.coalesce("verdict", F.lit(verdict.PASS))).alias("verdict"),
        F.coalesce("block_reason", F.when(over, "too_many_segments"), "reason").alias("reason"),
        F.coalesce("n_segments", F.lit(0)).alias("n_segments"),
        *[F.when(~held, F.coalesce(c, F.lit(0))).alias(c) for c in ("n_pass", "n_block", "n_review", "n_inj")],
        screening.pii_counts(screening.pii_spans(F.coalesce("clean_text", F.lit("")))).alias("pii"),
    )


def category_counts(found: DataFrame) -> DataFrame:
    """doc_id, category and n, of what events() finds."""
    return found.groupBy("doc_id", "category").agg(F.count("*").alias("n"))
