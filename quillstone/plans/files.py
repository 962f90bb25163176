"""Queries on sources and sinks: files are made from the driver's tables, read by the readers, and tables written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions.text import collapse
from quillstone.operators import corpus, evaluation, service
from quillstone.sources import articles, tables, versions

from .catalog import query

_FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query("""
    WITH f AS (SELECT 'c' || c_nationkey AS corpus, CASE c_custkey % 2 WHEN 0 THEN 'es' ELSE 'en' END AS language, 'f' || c_custkey || ['.pdf', '.html', '.xml', '.txt', '.PDF'][c_custkey % 5 + 1] AS path, [3, 2, 1, 0, 3][c_custkey % 5 + 1] AS r FROM customer)
    SELECT corpus, language, path, ['xml', 'html', 'pdf'][r] AS format FROM f WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY corpus, language ORDER BY r, path) = 1
""")
def preferred_files(table):
    k = F.col("c_custkey")
    ends = F.element_at(F.array(*map(F.lit, [".pdf", ".html", ".xml", ".txt", ".PDF"])), (k % 5 + 1).cast("int"))
    files = table("customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("corpus"), F.when(k % 2 == 0, "es").otherwise("en").alias("language"), F.concat(F.lit("f"), k.cast("string"), ends).alias("path"), F.col("c_name").alias("content"))
    return articles.preferred(files).select("corpus", "language", "path", "format")


def _escaped(text):
    for c, name in (("&", "amp"), ("<", "lt"), (">", "gt")):
        text = F.replace(text, F.lit(c), F.lit(f"&{name};"))
    return text


@query(f"""
    SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'Article ' || doc_id END AS articulo, lang || ' ' || source AS title, md5({_FLAT.format("text")}) AS text_md5, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS n_paragraphs,
           CASE WHEN doc_id % 7 = 0 THEN 'unexpected_root' WHEN doc_id % 11 = 0 THEN 'empty_number' WHEN {_FLAT.format("text")} = '' THEN 'empty_text' END AS fault FROM documents
""")
def xml_articles(table):
    """Acts of one article; some of another root, some without a number, some whose paragraph has none."""
    k = F.col("doc_id")
    root = F.when(k % 7 == 0, "OTHER").otherwise("ACT")
    number = F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit(" Article  "), k.cast("string")))
    parag = F.concat(F.when(k % 5 == 0, "").otherwise("<NO.P>1.</NO.P>"), F.lit("<TXT>"), _escaped(F.col("text")), F.lit("</TXT>"))
    xml = F.concat(F.lit('<?xml version="1.0"?>\n<!-- act -->\n<'), root, F.lit("><ARTICLE><NO.ARTICLE>"), number, F.lit("</NO.ARTICLE><TI.ART> "), F.col("lang"), F.lit("\n"), F.col("source"), F.lit("</TI.ART><PARAG>"), parag, F.lit("</PARAG></ARTICLE></"), root, F.lit(">"))
    return articles.from_xml(table("documents").select("doc_id", xml.alias("content"))).select("doc_id", "articulo", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("paragraphs").alias("n_paragraphs"), "fault")


@query(f"""
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS articulo, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'Article 5 of ' || lang ELSE 'about ' || lang END AS title, md5({_FLAT.format("text")}) AS text_md5 FROM documents WHERE doc_id % 9 <> 0
""")
def html_articles(table):
    """A div for each article; some with titles, some without marked paragraphs, some with another id."""
    k = F.col("doc_id")
    title = F.concat(F.lit("Article "), F.when(k % 3 == 0, "5 of ").otherwise(" about "), F.col("lang"))
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda s: F.concat(F.lit('<p class="x oj-normal">'), _escaped(s), F.lit("</p>"))), "\n")
    inside = F.when(k % 4 == 0, F.concat(F.lit("<span>"), _escaped(F.col("text")), F.lit("</span>"))).otherwise(F.concat(F.lit('<p class="oj-ti-art">Article</p><p class="oj-sti-art"><b>'), title, F.lit("</b></p><br>"), lines))
    html = F.concat(F.lit("<html><body><p>before</p><div id="), F.when(k % 9 == 0, '"par_').otherwise('"art_'), k.cast("string"), F.lit('">'), inside, F.lit("</div></body></html>"))
    return articles.from_html(table("documents").select("doc_id", html.alias("content")), "doc_id").select("doc_id", "articulo", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""
    WITH d AS (SELECT doc_id, lang, source, CAST(doc_id % 3 + 1 AS VARCHAR) AS a, CAST(doc_id % 2 + 1 AS VARCHAR) AS b FROM documents), t AS (SELECT *, 'lost' || chr(10) || '1.  alpha ' || source || chr(10) || '2. beta' AS x FROM d)
    SELECT doc_id, a AS articulo, 'Heading ' || lang AS title, x || CASE WHEN a = b THEN chr(10) || 'Article ' || b || chr(10) || 'Single ' || doc_id ELSE '' END AS text, '1:alpha ' || source || '|2:beta' || CASE WHEN a = b THEN chr(10) || 'Article ' || b || chr(10) || 'Single ' || doc_id ELSE '' END AS paragraphs FROM t
    UNION ALL SELECT doc_id, b, NULL, 'Single ' || doc_id, '1:Single ' || doc_id FROM t WHERE a <> b
""")
def pdf_articles(table):
    """Text of PDF files: the first header of a number begins its article, a later one of the same number is text."""
    k = F.col("doc_id")
    head = lambda n: F.concat(F.lit("\n  Article "), (k % n + 1).cast("string"), F.lit("  \n"))
    content = F.concat(F.lit("Intro"), head(3), F.lit("Heading "), F.col("lang"), F.lit("\n lost\n1.  alpha "), F.col("source"), F.lit("\n\n2. beta"), head(2), F.lit("Single "), k.cast("string"), F.lit("\n"))
    found = articles.from_pdf_text(table("documents").select("doc_id", content.alias("content")))
    return found.select("doc_id", "articulo", "title", "text", F.array_join(F.transform("paragraphs", lambda p: F.concat_ws(":", p["apartado"], p["text"])), "|").alias("paragraphs"))


@query("""
    SELECT doc_id, '1:Top ' || doc_id || '|2:Sub ' || lang || '|3:Deep' || CASE WHEN doc_id % 2 = 0 THEN '|1:Again' ELSE '' END AS outline FROM documents
""")
def markdown_outline(table):
    k = F.col("doc_id")
    md = F.concat(F.lit("# Top "), k.cast("string"), F.lit(" #\n\ntext\n\nSub "), F.col("lang"), F.lit("\n-----\n\nwords\n### Deep\n#none\n- item\n---\n"), F.when(k % 2 == 0, "Again\n=\n").otherwise(""))
    own = table("documents").select("doc_id", articles.outline(md).alias("o"))
    return own.select("doc_id", F.array_join(F.transform("o", lambda h: F.concat_ws(":", h["level"].cast("string"), h["title"])), "|").alias("outline"))


@query("SELECT CAST(doc_id AS VARCHAR) AS articulo, CASE WHEN doc_id % 3 > 0 THEN source END AS title, md5(text) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN lang END AS first FROM documents")
def processed_articles(table):
    """Articles written as JSON and read back."""
    docs = table("documents")
    k = F.col("doc_id")
    parts = F.when(k % 2 == 0, F.array(F.struct(F.lit("1").alias("apartado"), F.col("lang").alias("text")))).otherwise(F.expr("cast(array() as array<struct<apartado:string,text:string>>)"))
    path = tables.fresh(docs.sparkSession, "articles")
    tables.write_articles(docs.select(k.cast("string").alias("articulo"), F.when(k % 3 > 0, F.col("source")).alias("title"), "text", parts.alias("paragraphs")), path)
    return tables.read_articles(docs.sparkSession, path).select("articulo", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.try_element_at("paragraphs", F.lit(1))["text"].alias("first"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM customer UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0 AND c_custkey > 0")
def table_upsert(table):
    """A table that isn't there is loaded as none, made, and brought up to date by a version that writes touched buckets only."""
    c = table("customer").select(F.col("c_custkey").alias("k"))
    spark, path = c.sparkSession, tables.fresh(c.sparkSession, "manifest")
    assert versions.read(spark, path) is None
    versions.create(c.withColumn("v", F.lit("old")), path, "k")
    new = c.where("k % 3 = 0")
    new = new.unionByName(new.where("k % 2 = 0").select((-F.col("k")).alias("k"))).withColumn("v", F.lit("new"))
    versions.upsert(path, new, "v")
    return versions.read(spark, path)


@query("SELECT 'docs.' || (doc_id % 90) || '.' || doc_id || '.' || lang AS chunk_id, (SELECT count(*) FROM documents WHERE doc_id % 90 = 12 AND lang = 'en') AS n_deleted, TRUE AS others_as_they_were FROM documents WHERE NOT (doc_id % 90 = 12 AND lang = 'en')")
def table_delete(table):
    """An article's chunks are deleted: its bucket alone is written again, all other folders are those of the version before."""
    chunks = table("documents").select(F.concat_ws(".", F.lit("docs"), (F.col("doc_id") % 90).cast("string"), F.col("doc_id").cast("string"), "lang").alias("chunk_id"))
    spark, path = chunks.sparkSession, tables.fresh(chunks.sparkSession, "chunks")
    before = versions.create(chunks, path, "substring_index(chunk_id, '.', 2)")
    n = versions.delete(spark, path, ["docs.12"], corpus.of_article("docs.12", "en"))
    after = versions.current(spark, path)
    changed = [b for b in before.folders if after.folders.get(b) != before.folders[b]]
    return versions.read(spark, path).select("chunk_id", F.lit(n).cast("long").alias("n_deleted"), F.lit(len(changed) == 1).alias("others_as_they_were"))


@query("""
    WITH c AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END AS arm FROM conversations)
    SELECT arm, count(*) AS n_cases, CAST(sum(CASE WHEN arm = 'b' THEN n + 1 ELSE n END) AS BIGINT) AS total, arm = 'a' AS same_files FROM c GROUP BY arm
""")
def run_scopes(table):
    """Two arms of a run, of which one is run again: its cases are replaced, and the other's files are those of the first run."""
    c = table("conversations").select("conv_id", "turn", F.length("text").alias("n"), F.when(F.col("turn") % 2 == 0, "a").otherwise("b").alias("arm"), F.lit("r1").alias("run_id"))
    spark, path = c.sparkSession, tables.fresh(c.sparkSession, "runs")
    written = lambda: spark.read.parquet(path)
    files = lambda: {r.f for r in written().select(F.input_file_name().alias("f")).distinct().collect()}
    versions.write_scopes(c, path, "run_id", "arm")
    first = files()
    versions.write_scopes(c.where("arm = 'b'").withColumn("n", F.col("n") + 1), path, "run_id", "arm")
    kept = sorted(f for f in files() if f in first)
    out = written().withColumn("kept", F.input_file_name().isin(kept) if kept else F.lit(False))
    return out.groupBy("arm").agg(F.count("*").alias("n_cases"), F.sum("n").cast("long").alias("total"), F.every("kept").alias("same_files"))


@query("SELECT page_id, 'https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:' || page_id AS source_url FROM pages")
def column_rewrite(table):
    p = table("pages").select("page_id", F.col("url").alias("source_url"))
    return tables.checked(p, tables.fresh(p.sparkSession, "pages"), "source_url", service.source_url(F.col("page_id").cast("string")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 4 > 1")
def id_list(table):
    k = F.col("c_custkey")
    c = table("customer").select(F.when(k % 4 == 0, F.concat(F.lit("# "), k.cast("string"))).when(k % 4 == 1, "  ").when(k % 4 == 2, F.concat(F.lit("  "), k.cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("﻿"), k.cast("string"))).alias("value"))
    path = tables.fresh(c.sparkSession, "ids")
    c.write.text(path)
    return articles.id_list(c.sparkSession, path)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text AS entrada, lang AS corpus FROM documents WHERE doc_id % 5 = 0")
def gold_cases(table):
    """Cases written as JSON lines, read with a list of ids."""
    d = table("documents")
    path = tables.fresh(d.sparkSession, "gold")
    d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("entrada"), F.col("lang").alias("corpus_esperado")).write.json(path)
    return service.gold_cases(d.sparkSession, path, d.where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("id"))).select("id", "entrada", F.col("corpus_esperado").alias("corpus"))


@query("""
    WITH a AS (SELECT 'a' || event_id AS id, CASE event_id % 2 WHEN 0 THEN 'document' ELSE 'chat' END AS mode, event_id % 4 = 0 AS e2e, event_type AS layer, user_id FROM events),
         o AS (SELECT *, user_id % 5 = 0 AS sanitizer, user_id % 3 = 0 AS injection, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'pass' ELSE 'block' END AS verdict, layer = 'error' AS failed FROM a)
    SELECT id, mode = 'document' AND NOT e2e AS smoke, CASE WHEN sanitizer THEN 'sanitizer' WHEN injection THEN 'injection' ELSE 'none' END AS layer,
           CASE WHEN failed OR (mode = 'chat' AND verdict IS NULL) THEN false ELSE sanitizer OR injection OR coalesce(verdict = 'block', false) END AS blocked FROM o
""")
def attack_outcomes(table):
    """Attacks written as JSON lines and read back, those of the smoke test, and which layer stopped each."""
    e = table("events")
    k, u = F.col("event_id"), F.col("user_id")
    path = tables.fresh(e.sparkSession, "attacks")
    e.select(F.concat(F.lit("a"), k.cast("string")).alias("id"), F.when(k % 2 == 0, "document").otherwise("chat").alias("mode"), (k % 4 == 0).alias("requires_e2e")).write.json(path)
    attacks = service.attack_cases(e.sparkSession, path)
    runs = e.select(F.concat(F.lit("a"), k.cast("string")).alias("id"), (u % 5 == 0).alias("sanitizer"), (u % 3 == 0).alias("injection"), F.lit(None).cast("boolean").alias("validator"), F.lit(False).alias("council"), F.when(u % 7 != 0, F.when(u % 2 == 0, "pass").otherwise("block")).alias("verdict"), F.when(F.col("event_type") == "error", "timeout").alias("error"))
    out = service.attack_outcome(attacks.select("id", "mode").join(runs, "id"))
    smoke = service.smoke(attacks).select("id", F.lit(True).alias("smoke"))
    return out.join(smoke, "id", "left").select("id", F.coalesce("smoke", F.lit(False)).alias("smoke"), "layer", "blocked")


@query("""
    WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'chat' ELSE 'doc' END AS kind, text FROM conversations)
    SELECT kind, conv_id, max(turn) AS turn, max_by(length(text), turn) AS size FROM l GROUP BY ALL
""")
def case_checkpoint(table):
    """Tagged lines of a run, by kind, the last of each case."""
    c = table("conversations")
    data = F.struct("conv_id", "turn", F.length("text").cast("long").alias("size"))
    lines = c.select(F.to_json(F.struct(F.when(F.col("turn") % 2 == 0, "chat").otherwise("doc").alias("kind"), data.alias("data"))).alias("value"))
    of = service.tagged(lines, {k: "conv_id long, turn long, size long" for k in ("chat", "doc")})
    parts = [service.latest(df, "conv_id", "turn").withColumn("kind", F.lit(k)) for k, df in of.items()]
    return parts[0].unionByName(parts[1])


@query("""
    WITH c AS (SELECT 'f' || lpad(CAST(turn AS VARCHAR), 4, '0') || '-' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS file, text AS query, length(text) AS n, turn FROM conversations), k AS (SELECT query, min_by(n, file) AS n, min(file) AS file FROM c WHERE turn % 3 > 0 AND n % 4 > 0 GROUP BY query)
    SELECT role, count(*) AS cases, count(k.file) AS hits, min(k.file) AS first_file, CAST(sum(k.n) AS BIGINT) AS total FROM (SELECT role, text AS query FROM conversations) q LEFT JOIN k USING (query) GROUP BY role
""")
def judge_cache_join(table):
    """Calls of a judge, some not JSON and some without an answer, mined for the first answer to each question, and joined to cases."""
    c = table("conversations").select("*", F.col("text").alias("q"), F.length("text").alias("n"))
    user = F.to_json(F.struct(F.col("q").alias("query"), F.when(F.col("n") % 4 > 0, F.col("n").cast("string")).alias("actual_answer")))
    value = F.when(F.col("turn") % 3 > 0, F.to_json(F.struct(F.struct(user.alias("user")).alias("request")))).otherwise("{not json")
    file = F.concat(F.lit("f"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit("-"), F.lpad(F.col("conv_id").cast("string"), 6, "0"))
    mined = service.judge_cache(c.select(value.alias("value"), file.alias("file")))
    met = evaluation.cached_answers(c.select("role", F.col("q").alias("query")), mined)
    return met.groupBy("role").agg(F.count("*").alias("cases"), F.count("file").alias("hits"), F.min("file").alias("first_file"), F.sum(F.col("actual_answer").cast("long")).alias("total"))


_REPORT = """
    c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderkey % 5 || ', ' || o_orderkey % 7 END AS emitted, CASE WHEN o_custkey % 2 = 0 THEN 'pass' ELSE 'block' END AS verdict, o_orderkey % 7 || CASE WHEN o_orderkey % 2 = 0 THEN '.1' ELSE '' END AS expected FROM orders)
"""


@query(f"""
    WITH {_REPORT}
    SELECT 'case-' || k AS case_id, verdict, expected, CASE WHEN emitted = '' THEN 0 WHEN k % 5 = k % 7 THEN 1 ELSE 2 END AS n_emitted, k % 10 / 10.0::DOUBLE AS recall, CASE WHEN emitted = '' OR k % 2 = 0 THEN 0.0::DOUBLE WHEN k % 5 = k % 7 THEN 1 ELSE 0.5 END AS precision FROM c
""")
def report_sources(table):
    """Blocks of cases as reports have them, read back, with precision worked out anew: where a paragraph is expected, articles alone don't match it."""
    k = F.col("o_orderkey")
    o = table("orders")
    n = lambda m: (k % m).cast("string")
    block = F.concat(F.lit("### case-"), k.cast("string"), F.lit(" (chat)\n- verdict: "), F.when(F.col("o_custkey") % 2 == 0, "pass").otherwise("block"), F.lit("\n- expected: "), n(7), F.when(k % 2 == 0, ".1").otherwise(""), F.lit("\n- emitted: "), F.when(k % 3 == 0, "").otherwise(F.concat(n(5), F.lit(", "), n(7))), F.lit("\n- recall: "), (k % 10 / 10).cast("string"), F.lit("\n"))
    reports = o.groupBy("o_custkey").agg(F.concat(F.lit("# Report\n\n"), F.array_join(F.array_sort(F.collect_list(block)), "\n")).alias("value"))
    found = service.from_markdown(reports)
    precision, _ = evaluation.precision_recall(F.col("emitted"), F.array("expected"))
    return found.select("case_id", "verdict", "expected", F.size(F.array_distinct("emitted")).alias("n_emitted"), "recall", precision.alias("precision"))


@query("""
    SELECT 0 AS report, o_orderkey AS case_id, o_totalprice AS cost, NULL AS note, (SELECT max(o_orderdate) FROM orders) AS run_at FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT 1, o_orderkey, NULL, o_comment_, (SELECT max(o_orderdate) FROM orders) FROM (SELECT *, o_orderpriority AS o_comment_ FROM orders) WHERE o_orderkey % 2 = 1
""")
def merged_reports(table):
    o = table("orders")
    a = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("cost"))
    b = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("note"))
    return evaluation.merged(o.agg(F.max("o_orderdate").alias("run_at")), a, b)


@query("WITH t AS (SELECT event_id, user_id, event_type, value FROM events) SELECT event_id, '{\"n\":' || user_id || ',\"verdict\":\"' || event_type || '\",\"text_hash\":\"' || left(sha256(event_type), 12) || '\"}' AS line FROM t")
def log_lines(table):
    e = table("events").select("event_id", F.col("user_id").alias("n"), F.col("event_type").alias("verdict"))
    return service.assert_safe_columns(e.select("event_id", service.log_line(["n", "verdict"], "verdict").alias("line")), {"line"})


@query(f"SELECT doc_id, md5({_FLAT.format("text || '  ' || chr(9) || lang || ' '")}) AS flat_md5 FROM documents")
def whitespace(table):
    return table("documents").select("doc_id", F.md5(collapse(F.concat("text", F.lit("  \t"), "lang", F.lit(" "))).cast("binary")).alias("flat_md5"))
