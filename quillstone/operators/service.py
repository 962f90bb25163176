"""What surrounds the operators: guards and projections of requests and answers, loaders of cases and attacks, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from quillstone.operators.retrieval import RetrievalConfig

#: Bytes of an upload at most, kinds of files, languages.
MAX_UPLOAD, MIMES, LANGUAGES = 10 * 1024 * 1024, ["application/pdf", "text/markdown"], ["es", "en"]


def fetch_allowed(url: Column, hosts: tuple[str, ...] = ("eur-lex.europa.eu",)) -> Column:
    """Whether texts of law may be fetched from there: the exact host."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin(*hosts), F.lit(False))


def mime_of(content: Column, name: Column) -> Column:
    """By the first bytes, else by the name; null for neither."""
    return F.when(F.substring(content, 1, 5).cast("string") == "%PDF-", "application/pdf").when(F.lower(name).rlike(r"\.(md|markdown)$"), "text/markdown")


def upload_fault(uploads: DataFrame, corpora: list[str]) -> Column:
    """Why an upload (content, name, mime, language, corpus array) is refused: the first that holds, null for none."""
    size = F.length("content")
    return (
        F.when(size > MAX_UPLOAD, "too_large").when(size == 0, "empty").when(~F.coalesce(F.col("mime").isin(MIMES), F.lit(False)), "unsupported_type")
        .when((F.col("mime") == "application/pdf") & (F.substring("content", 1, 5).cast("string") != "%PDF-"), "not_a_pdf")
        .when(~F.col("language").isin(LANGUAGES), "unsupported_language").when((F.size("corpus") < 1) | F.exists("corpus", lambda c: ~c.isin(corpora)), "unknown_corpus")
    )


def dispatch(mime: Column) -> Column:
    """The reader for a type; an error for others."""
    return F.when(mime == "application/pdf", "pdf").when(mime.isin("text/markdown", "text/x-markdown"), "markdown").otherwise(F.raise_error(F.concat(F.lit("unsupported type: "), F.coalesce(mime, F.lit("null")))))


def skip_category(skipped: Column, reason: Column, strict_compat: bool = False) -> Column:
    """clean, injection_blocked or internal_error of a segment. Reasons are names of patterns, which don't say injection; strict_compat looks for that word alone."""
    injected = F.lower(reason).contains("injection") if strict_compat else reason.isNotNull() & ~F.lower(reason).contains("error")
    return F.when(~F.coalesce(skipped, F.lit(False)), "clean").when(F.coalesce(injected, F.lit(False)), "injection_blocked").otherwise("internal_error")


def under_review(findings: Column) -> Column:
    """Of findings (severity, verdict, citations with validated) those of high severity or with an invalid citation and not passed; all if there are none."""
    some = F.filter(findings, lambda f: (f["severity"] == "high") | ((f["verdict"] != "pass") & F.exists(f["citations"], lambda c: ~c["validated"])))
    return F.when(F.size(some) > 0, some).otherwise(findings)


def source_url(celex: Column, language: Column | None = None) -> Column:
    """Where a text of law is published: in a language, or in English for all."""
    part = F.upper(language) if language is not None else F.lit("EN")
    return F.concat(F.lit("https://eur-lex.europa.eu/legal-content/"), part, F.lit("/TXT/?uri=CELEX:"), celex)


def state(turns: DataFrame) -> DataFrame:
    """turns (injected, verdict or null, citations array with validated) with status, n_citations and n_validated."""
    status = F.when(F.col("verdict").isNull(), F.when(F.col("injected"), "blocked_injection").otherwise("no_answer")).otherwise(F.col("verdict"))
    return turns.withColumns({"status": status, "n_citations": F.coalesce(F.size("citations"), F.lit(0)), "n_validated": F.coalesce(F.size(F.filter("citations", lambda c: c["validated"])), F.lit(0))})


def question(title: Column, body: Column) -> Column:
    """What a segment is looked up by: title and body, or the body alone."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat_ws("\n", title, body)).otherwise(body)


def numbered_context(chunks: Column) -> Column:
    """Chunks (article_id, text) as a numbered list."""
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["article_id"], F.lit(": "), c["text"])), "\n")


def padded(text: Column, least: int = 50) -> Column:
    """Texts shorter than what a document must hold, filled with spaces."""
    return F.when(F.length(text) < least, F.rpad(text, least, " ")).otherwise(text)


def council_notice(agreement: Column, diverges: Column, n_ok: Column, reason: Column) -> Column:
    """A note on a diverging panel; null if it agrees or no judge answered."""
    bound = F.coalesce(reason, F.lit("")).startswith("COUNCIL_BIND:")
    return F.when(diverges & (n_ok > 0), F.when(bound, F.concat(F.lit("The panel changed this verdict ("), agreement, F.lit(")."))).otherwise(F.concat(F.lit("The panel disagrees with this verdict ("), agreement, F.lit(")."))))


def case_id(prefix: str, day: Column) -> Column:
    """Not the same twice: keep it out of what is compared."""
    return F.concat_ws("-", F.lit(prefix), F.date_format(day, "yyyyMMdd"), F.left(F.uuid(), F.lit(8)))


def rate_limit_ok(rule: Column) -> Column:
    """An amount above 0 per second, minute, hour or day."""
    return F.coalesce(rule.rlike(r"^\s*0*[1-9][0-9]*\s*(/|per)\s*([0-9]+\s+)?(second|minute|hour|day)s?\s*$"), F.lit(False))


def first_sources(normas: Column) -> Column:
    """Distinct sources in the order in which they come."""
    return F.array_distinct(normas)


def log_line(row: list[str], text: str) -> Column:
    """Counts and a hash of the text as JSON, never the text."""
    return F.to_json(F.struct(*row, F.left(F.sha2(F.col(text).cast("binary"), 256), F.lit(12)).alias("text_hash")))


def assert_safe_columns(df: DataFrame, allowed: set[str], suffixes: tuple[str, ...] = ("_id", "_hash", "_ms", "_count", "_eur", "_code", "_label", "_rate", "_ts")) -> DataFrame:
    """df, if its columns are counts, hashes and the like; else an error that names the others."""
    bad = [c for c in df.columns if c not in allowed and not c.startswith("n_") and not c.endswith(suffixes)]
    if bad:
        raise ValueError(f"columns that may not leave: {bad}")
    return df


def config_of(text: str | None) -> RetrievalConfig:
    """A configuration from a JSON object of known keys of the right kinds; any fault gives the defaults."""
    kinds = {"pre_rerank": int, "top_k": int, "purity_threshold": (int, float), "max_per_article": (int, type(None)), "max_per_group": (int, type(None)), "top_k_auto": int}
    try:
        own = json.loads(text or "{}")
        if not isinstance(own, dict) or any(k not in kinds or isinstance(v, bool) or not isinstance(v, kinds[k]) for k, v in own.items()):
            return RetrievalConfig()
        return RetrievalConfig(**own)
    except ValueError:
        return RetrievalConfig()


def config_columns(text: Column) -> Column:
    """config_of as a column: pre_rerank, top_k, purity_threshold, max_per_article, max_per_group and top_k_auto of a JSON text."""
    default = RetrievalConfig()
    whole = {"pre_rerank", "top_k", "max_per_article", "max_per_group", "top_k_auto"}
    v = F.try_parse_json(F.when(F.coalesce(text, F.lit("")) == "", F.lit("{}")).otherwise(text))
    names = [*whole, "purity_threshold"]
    kind = lambda name: F.schema_of_variant(F.variant_get(v, f"$.{name}", "variant"))
    fits = lambda name: kind(name).isin("BIGINT", "VOID") if name.startswith("max_") else kind(name) == "BIGINT" if name in whole else kind(name).rlike("^(BIGINT|DECIMAL|DOUBLE)")
    given = lambda name: F.array_contains(F.json_object_keys(text), name)
    known = F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, names)))) == 0
    good = F.schema_of_variant(v).startswith("OBJECT") & known
    for name in names:
        good = good & (~given(name) | fits(name))
    good = F.coalesce(good, F.lit(False))

    def of(name: str) -> Column:
        type_ = "double" if name == "purity_threshold" else "int"
        own = F.lit(getattr(default, name)).cast(type_)
        return F.when(good & given(name), F.try_variant_get(v, f"$.{name}", type_)).otherwise(own).alias(name)

    return F.struct(*[of(n) for n in ("pre_rerank", "top_k", "purity_threshold", "max_per_article", "max_per_group", "top_k_auto")])


def quarantine(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that hold, and those that don't or whose answer is null."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def valid_citation() -> Column:
    """Of norma, articulo, apartado, language and text: what a citation must be."""
    return F.col("language").isin(LANGUAGES) & (F.trim("norma") != "") & (F.trim("articulo") != "") & (F.regexp_replace("text", r"(?U)\s", "") != "")


CASE = "id string, tipo string, entrada string, corpus_esperado string, articulos_esperados array<string>, severidad_esperada string, criterios_evaluacion array<string>, salida_esperada string, requiere_revision_humana boolean, expected_verdict string, acceptable_verdicts array<string>"
ATTACK = "id string, scenario int, scenario_name string, mode string, payload string, expected_block_layer string, expected_verdict string, requires_e2e boolean, description string, rationale string"


def gold_cases(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Cases of JSON lines; only those of ids (id) if given."""
    cases = spark.read.schema(CASE).json(path).where("id is not null")
    return cases.join(ids, "id", "left_semi") if ids is not None else cases


def attack_cases(spark: SparkSession, path: str) -> DataFrame:
    """Attacks of JSON lines. Repeated ids, and chat attacks that need the whole system, are errors."""
    own = spark.read.schema(ATTACK).json(path).where("id is not null")
    repeated = own.groupBy("id").count().where("count > 1").limit(1).collect()
    wrong = own.where("mode = 'chat' and requires_e2e").limit(1).collect()
    if repeated or wrong:
        raise ValueError(f"repeated id {repeated[0].id!r}" if repeated else f"chat attack {wrong[0].id!r} can't need the whole system")
    return own


def smoke(attacks: DataFrame) -> DataFrame:
    return attacks.where("mode = 'document' and not requires_e2e")


def attack_outcome(attacks: DataFrame) -> DataFrame:
    """attacks with layer flags (sanitizer, injection, validator, council; null where a layer did not run), verdict and error, with layer and blocked.
    The first layer that stops one has it; a chat attack stopped before there is an answer counts as not blocked."""
    layer = F.coalesce(*[F.when(F.coalesce(name, F.lit(False)), name) for name in ("sanitizer", "injection", "validator", "council")], F.lit("none"))
    blocked = F.when(F.col("error").isNotNull(), False).when((F.col("mode") == "chat") & F.col("verdict").isNull(), False).otherwise((layer != "none") | F.col("verdict").isin("block", "requires_human_review"))
    return attacks.withColumns({"layer": layer, "blocked": F.coalesce(blocked, F.lit(False))})


def all_safe(cases: DataFrame, *by: str) -> DataFrame:
    """A row for each run (by) that has cases: whether every one is blocked or emits nothing. Without by one row for all, and an error where there are none."""
    return cases.groupBy(*by).agg(F.when(F.count("*") == 0, F.raise_error(F.lit("no cases"))).otherwise(F.every(F.col("blocked") | (F.size("emitted") == 0))).alias("safe"))


def judge_cache(lines: DataFrame) -> DataFrame:
    """query, actual_answer and file of cached judge calls (value: JSON, file), the first by file for each query; others fall away."""
    user = F.get_json_object("value", "$.request.user")
    own = lines.select("file", F.get_json_object(user, "$.query").alias("query"), F.get_json_object(user, "$.actual_answer").alias("actual_answer")).where("query is not null and actual_answer is not null")
    return own.groupBy("query").agg(F.min_by("actual_answer", "file").alias("actual_answer"), F.min("file").alias("file"))


def latest(runs: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last by order."""
    return runs.groupBy(key).agg(F.max_by(F.struct(*runs.columns), order).alias("r")).select("r.*")


def tagged(lines: DataFrame, kinds: dict[str, str]) -> dict[str, DataFrame]:
    """Of lines {kind, data} (value) the data by kind, with its schema; another kind is an error when it is read."""
    known = F.when(F.get_json_object("value", "$.kind").isin(*kinds), F.get_json_object("value", "$.kind")).otherwise(F.raise_error(F.lit("unknown kind")))
    own = lines.select(known.alias("kind"), F.get_json_object("value", "$.data").alias("data"))
    return {k: own.where(F.col("kind") == k).select(F.from_json("data", schema).alias("d")).select("d.*") for k, schema in kinds.items()}


def report(headline: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metric, value, bar, delta and met, of a one-row headline against bars (metric, bar)."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in headline.columns]))
    return headline.select(values.alias("m")).select("m.*").join(thresholds, "metric").select("metric", "value", "bar", F.round(F.col("value") - F.col("bar"), 6).alias("delta"), (F.col("value") >= F.col("bar")).alias("met"))


def markdown(rows: DataFrame, title: str) -> str:
    """A Markdown table of an aggregate's few rows."""
    lines = [f"# {title}", "", f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}"]
    return "\n".join([*lines, *(f"| {' | '.join(str(v) for v in r)} |" for r in rows.collect())]) + "\n"


def to_markdown(cases: DataFrame) -> Column:
    """A case's block of a report, which from_markdown reads: of case_id, mode, verdict, expected, emitted (array) and recall."""
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), F.coalesce(value, F.lit("")))
    head = F.format_string("### %s (%s)", F.col("case_id"), F.col("mode"))
    return F.concat(F.concat_ws("\n", head, line("verdict", cases["verdict"]), line("expected", cases["expected"]), line("emitted", F.array_join(cases["emitted"], ", ")), line("recall", cases["recall"].cast("string"))), F.lit("\n"))


def write_report(headline: DataFrame, cases: DataFrame, path: str, title: str, by: str) -> None:
    """A report in Markdown: summary.md, a table of the headline's few rows, and cases, a table of text with the blocks of each part (by) of the cases, in their order."""
    spark = headline.sparkSession
    spark.createDataFrame([(markdown(headline, title).rstrip("\n"),)], "value string").coalesce(1).write.text(f"{path}/summary.md")
    cases.select(F.col(by).alias("part"), F.col("case_id"), to_markdown(cases).alias("value")).repartition("part").sortWithinPartitions("part", "case_id").write.parquet(f"{path}/cases")


def read_report(spark, path: str) -> tuple[str, DataFrame]:
    """The summary and the cases of a report."""
    summary = "".join(r.value for r in spark.read.text(f"{path}/summary.md", wholetext=True).collect())
    return summary, from_markdown(spark.read.parquet(f"{path}/cases"))


def from_markdown(texts: DataFrame) -> DataFrame:
    """case_id, verdict, expected, emitted (array) and recall of per-case blocks (### id, then - name: value) of reports (value)."""
    blocks = F.regexp_extract_all("value", F.lit(r"(?ms)^### (.*?)(?=^### |\z)"), F.lit(1))
    field = lambda name: F.nullif(F.regexp_extract("b", rf"(?m)^- {name}: (.*)$", 1), F.lit(""))
    own = texts.select(F.explode(blocks).alias("b"))
    return own.select(F.regexp_extract("b", r"^(\S+)", 1).alias("case_id"), field("verdict").alias("verdict"), field("expected").alias("expected"), F.filter(F.split(F.coalesce(field("emitted"), F.lit("")), r",\s*"), lambda x: x != "").alias("emitted"), field("recall").cast("double").alias("recall"))
