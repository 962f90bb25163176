"""The composed flows: retrieval in a stated corpus, and a question's way from screening to a verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import screening
from quillstone.operators import citation, retrieval, verdict
from quillstone.operators.retrieval import RetrievalConfig
from quillstone.operators.trace import Trace
from quillstone.sources.tables import stored


def retrieve(queries: DataFrame, rows: DataFrame, headers: DataFrame, score: Column, cfg: RetrievalConfig | None = None) -> DataFrame:
    """The best rows of a query's own corpus and language, best first, with their header: the nearest cfg.pre_rerank, of these the cfg.top_k of
    highest score. queries: query_id, query, norma, language; rows: id, vector, grp, lang; headers: grp and more. No caps, no gate."""
    cfg = cfg or RetrievalConfig()
    pool = retrieval.knn(queries, rows, cfg.pre_rerank, {"grp": "norma", "lang": "language"})
    return retrieval.with_header(retrieval.rerank(pool.drop("norma", "language"), score, cfg.top_k), headers)


def screened_questions(questions: DataFrame) -> DataFrame:
    """questions with pattern: which instruction is in the text, null without one."""
    return questions.withColumn("pattern", screening.injection(F.col("text")))


def ask_with_retrieval(questions: DataFrame, rows: DataFrame, headers: DataFrame, score: Column, answer: Callable[[DataFrame], DataFrame], paragraphs: DataFrame, votes: DataFrame, cfg: RetrievalConfig | None = None, trace: Trace | None = None) -> DataFrame:
    """ask, with what retrieval finds as the context of each answer: also n_chunks and sources (the retrieved articles in order, each once).

    questions: case_id, text, query, norma, language; rows: id, vector, grp, lang, articulo, text; headers as in retrieve. Only questions without
    instructions are looked up. answer: from contexts (answer_id, question, chunks: an array of rank, norma, articulo, language and text, cfg.top_k at most) to the
    citations of a model from outside. Citations are checked against rows and paragraphs (norma, articulo, language, apartado, text), whatever was retrieved.
    """
    screened = screened_questions(questions)
    asked = screened.where("pattern is null").select(F.col("case_id").alias("query_id"), F.col("text").alias("question"), "query", "norma", "language")
    hits = retrieve(asked, rows, headers, score, cfg)
    hits = trace.step("retrieved", hits) if trace else hits
    chunk = F.struct("rank", F.col("grp").alias("norma"), "articulo", F.col("lang").alias("language"), "text")
    contexts = stored(hits.groupBy(F.col("query_id").alias("answer_id")).agg(F.first("question").alias("question"), F.array_sort(F.collect_list(chunk)).alias("chunks")), "contexts")
    articles = rows.select(F.col("grp").alias("norma"), "articulo", F.col("lang").alias("language"), "text")
    out = ask(questions.select("case_id", "text"), answer(contexts), articles, paragraphs, votes, trace)
    facts = contexts.select(F.col("answer_id").alias("case_id"), F.size("chunks").alias("n_chunks"), F.array_distinct(F.transform("chunks", lambda c: c["articulo"])).alias("sources"))
    return out.join(facts, "case_id", "left").withColumns({"n_chunks": F.coalesce("n_chunks", F.lit(0)), "sources": F.coalesce("sources", F.array().cast("array<string>"))})


def ask(questions: DataFrame, citations: DataFrame, articles: DataFrame, paragraphs: DataFrame, votes: DataFrame, trace: Trace | None = None) -> DataFrame:
    """A row a question (case_id, text): status (blocked_injection, no_answer or the verdict), reason, counts, why a panel was called and whether it
    changed the verdict.

    citations (answer_id, finding_ix, citation_ix, severity, and what citation.audit reads) are the answers of a model from outside; those
    of questions with instructions in them go no further. votes (case_id, vote, ok) count where a panel is called. trace gets the rows of each step.
    """
    seen = trace.step if trace else lambda name, rows, **metrics: rows
    screened = screened_questions(seen("questions", questions))
    screened = seen("screened", screened, n_blocked=F.count_if(F.col("pattern").isNotNull()))
    clean = screened.where("pattern is null").select(F.col("case_id").alias("answer_id"))
    audited = citation.audit(citations.join(clean, "answer_id", "left_semi"), articles, paragraphs)
    audited = seen("audited", audited, n_validated=F.count_if("validated"))
    audited = audited.withColumn("reason", F.concat(F.lit("check_"), F.col("failed_check").cast("string")))
    answers = verdict.answers(verdict.findings(audited))
    high = audited.groupBy("answer_id").agg(F.bool_or(F.col("severity") == "high").alias("any_high"), F.count_if("validated").alias("n_validated"))
    judged = answers.join(high, "answer_id").withColumn("trigger", verdict.trigger(F.col("verdict"), F.col("any_high"), F.lit(False), F.lit(None).cast("boolean")))
    judged = seen("judged", judged, n_called=F.count_if(F.col("trigger") != "not_triggered"))
    panels = verdict.council(votes.join(judged.where("trigger <> 'not_triggered'").select(F.col("answer_id").alias("case_id")), "case_id", "left_semi"))
    bound = verdict.bind(judged.withColumnRenamed("answer_id", "case_id").select("case_id", "verdict", "reason"), panels)
    facts = judged.select(F.col("answer_id").alias("case_id"), "trigger", "n_findings", "n_citations", "n_validated")
    out = screened.select("case_id", "pattern").join(bound, "case_id", "left").join(facts, "case_id", "left")
    status = F.when(F.col("pattern").isNotNull(), "blocked_injection").otherwise(F.coalesce("verdict", F.lit("no_answer")))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_findings", "n_citations", "n_validated")}
    out = seen("answered", out, n_bound=F.count_if("bound"))
    return out.select("case_id", status.alias("status"), "reason", F.coalesce("trigger", F.lit("not_triggered")).alias("trigger"), F.coalesce("bound", F.lit(False)).alias("bound"), *[c.alias(k) for k, c in zero.items()])


def process_segments(cut: DataFrame, rows: DataFrame, headers: DataFrame, score: Column, answer: Callable[[DataFrame], DataFrame], paragraphs: DataFrame, embed: Column, cfg: RetrievalConfig | None = None) -> DataFrame:
    """Each segment of cut (doc_id, segment_id, title, text, norma, language and what embed reads) with skipped and skip_reason (an instruction in it), else n_chunks, verdict and reason of
    the answer about it: a segment is looked up by its title and text, whose vector embed gives of the column query_text, and answered and audited as a question is."""
    screened = cut.withColumn("skip_reason", screening.injection(F.col("text"), "document"))
    case = F.concat_ws("-", "doc_id", "segment_id")
    looked_up = screened.where("skip_reason is null").withColumn("query_text", F.concat_ws("\n", F.nullif("title", F.lit("")), "text"))
    hits = retrieve(looked_up.select(case.alias("query_id"), F.col("text").alias("question"), embed.alias("query"), "norma", "language"), rows, headers, score, cfg)
    chunk = F.struct("rank", F.col("grp").alias("norma"), "articulo", F.col("lang").alias("language"), "text")
    contexts = stored(hits.groupBy(F.col("query_id").alias("answer_id")).agg(F.first("question").alias("question"), F.array_sort(F.collect_list(chunk)).alias("chunks")), "contexts")
    articles = rows.select(F.col("grp").alias("norma"), "articulo", F.col("lang").alias("language"), "text")
    audited = citation.audit(answer(contexts), articles, paragraphs).withColumn("reason", F.concat(F.lit("check_"), F.col("failed_check").cast("string")))
    answers = verdict.answers(verdict.findings(audited)).select("answer_id", "verdict", "reason")
    facts = contexts.select("answer_id", F.size("chunks").alias("n_chunks")).join(answers, "answer_id", "left")
    out = screened.select("doc_id", "segment_id", "title", F.col("skip_reason").isNotNull().alias("skipped"), "skip_reason", case.alias("answer_id")).join(facts, "answer_id", "left")
    return out.drop("answer_id").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
