"""Replies of a model from outside: parsed, judged field by field, asked for again with feedback that fits the fault.

A reply is JSON text of an answer: query, language, text and findings (text, severity, citations of norma, articulo, apartado, language,
text). What a model says is a column from outside; this is what is done about it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.corpus import LANGUAGES, REGISTRY
from quillstone.sources.tables import stored

_CITATION = "struct<norma:string,articulo:string,apartado:string,language:string,text:string>"
ANSWER = f"struct<query:string,language:string,text:string,findings:array<struct<text:string,severity:string,citations:array<{_CITATION}>>>>"
_READ = ANSWER[len("struct<") : -1] + ",_malformed:string"

#: Fixed values.
SEVERITIES = ["info", "low", "medium", "high"]
ROUNDS = 3
_QUOTED = 200


def parsed(reply: Column) -> Column:
    """The answer as a struct with _malformed, the text of a reply that has other types than an answer's; null where there is no JSON object at all."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(reply)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.from_json(reply, f"struct<{_READ}>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}))


def _fault(when: Column, place, kind: str, says: str) -> Column:
    place = F.lit(place) if isinstance(place, str) else place
    return F.when(when, F.struct(place.alias("place"), F.lit(kind).alias("type"), F.lit(says).alias("msg")))


def _text(value: Column, place) -> list[Column]:
    return [_fault(value.isNull(), place, "missing", "Field required"), _fault(value == "", place, "string_too_short", "A character at least")]


def _one_of(value: Column, place, options: list[str], required: bool = True) -> list[Column]:
    wrong = _fault(~value.isin(options), place, "literal_error", "One of " + ", ".join(options))
    return [_fault(value.isNull(), place, "missing", "Field required"), wrong] if required else [wrong]


def _list(value: Column, place) -> list[Column]:
    return [_fault(value.isNull(), place, "missing", "Field required"), _fault(F.size(value) == 0, place, "too_short", "An item at least")]


def faults(answer: Column, normas: list[str] | None = None, languages: list[str] = LANGUAGES) -> Column:
    """What is wrong with a parsed answer, field by field in order: an array of place (like findings.0.citations.1.text), type and msg."""
    normas = normas or sorted({r[0] for r in REGISTRY})

    def of_citation(c: Column, place: Column) -> Column:
        at = lambda name: F.concat(place, F.lit(f".{name}"))
        blank = _fault((c["text"] != "") & (F.trim(F.regexp_replace(c["text"], r"(?U)\s+", " ")) == ""), at("text"), "value_error", "White space is no quote")
        return F.array(*_one_of(c["norma"], at("norma"), normas), *_text(c["articulo"], at("articulo")), *_one_of(c["language"], at("language"), languages), *_text(c["text"], at("text")), blank)

    def of_finding(f: Column, i: Column) -> Column:
        at = lambda name: F.concat(F.lit("findings."), i.cast("string"), F.lit(f".{name}"))
        cited = F.flatten(F.transform(F.coalesce(f["citations"], F.array()), lambda c, j: of_citation(c, F.concat(at("citations."), j.cast("string")))))
        return F.concat(F.array(*_text(f["text"], at("text")), *_list(f["citations"], at("citations"))), cited, F.array(*_one_of(f["severity"], at("severity"), SEVERITIES, required=False)))

    head = F.array(_fault(answer["query"].isNull(), "query", "missing", "Field required"), *_one_of(answer["language"], "language", languages), *_text(answer["text"], "text"), *_list(answer["findings"], "findings"))
    found = F.array_compact(F.concat(head, F.flatten(F.transform(F.coalesce(answer["findings"], F.array()), of_finding))))
    malformed = F.array(F.struct(F.lit("").alias("place"), F.lit("type_error").alias("type"), F.lit("Other types than an answer's").alias("msg")))
    return F.when(answer["_malformed"].isNotNull(), malformed).otherwise(found)


def feedback(found: Column, text: Column) -> Column:
    """kind and message for a model whose answer has these faults; the first kind that fits: findings (nothing else is wrong than that they are missing or empty),
    citations, text, other."""
    every = F.forall(found, lambda x: x["place"].isin("findings", "findings.0"))
    cited = F.exists(found, lambda x: x["place"].rlike(r"^findings\.[0-9]+\.citations"))
    texts = F.exists(found, lambda x: x["place"] == "text")
    kind = F.when(every, "findings").when(cited, "citations").when(texts, "text").otherwise("other")
    first = found[0]
    says = (
        F.when(every, F.concat(F.lit("There are no findings, but the text says: '"), F.left(F.coalesce(text, F.lit("")), F.lit(_QUOTED)), F.lit("'. Give each claim as a finding with a citation, or leave it out of the text.")))
        .when(cited, F.concat(F.lit("A citation is malformed ("), first["msg"], F.lit("). Each needs a norm, an article, a language and a quote from the context.")))
        .when(texts, F.lit("The text is missing or empty. Sum the answer up in it."))
        .otherwise(F.format_string("%d faults, the first: %s at %s (%s). Keep to the schema.", F.size(found), first["type"], first["place"], first["msg"]))
    )
    return F.struct(kind.alias("kind"), says.alias("message"))


def ask_again(cases: DataFrame, attempt: Column, rounds: int = ROUNDS, normas: list[str] | None = None) -> DataFrame:
    """cases with answer (null without a valid one), attempts, kinds (of the feedback that was sent, in order) and error (null if all is well).

    attempt: what the model replies to a row, of its own columns and attempt (from 1), kind and message (of the last feedback, null at first). Each round is
    stored, so that no reply is asked for twice, and only the rows that fail go on to the next one. A reply that is no JSON object ends a
    case at once: there is nothing to give feedback on.
    """
    own = cases.columns
    open_ = cases.withColumns({"kind": F.lit(None).cast("string"), "message": F.lit(None).cast("string"), "kinds": F.array().cast("array<string>")})
    ended = []
    for k in range(1, rounds + 1):
        told = open_.withColumn("attempt", F.lit(k)).withColumn("__reply", attempt)
        judged = told.withColumn("__answer", parsed(F.col("__reply"))).withColumn("__faults", faults(F.col("__answer"), normas))
        state = F.when(F.col("__answer").isNull(), "none").when(F.size("__faults") == 0, "good").otherwise("bad")
        judged = stored(judged.select(*own, "kinds", "attempt", "__answer", "__faults", state.alias("__state")), f"round-{k}")
        n = F.lit(k)
        ended.append(judged.where("__state = 'good'").select(*own, F.col("__answer").dropFields("_malformed").alias("answer"), n.alias("attempts"), "kinds", F.lit(None).cast("string").alias("error")))
        ended.append(judged.where("__state = 'none'").select(*own, F.lit(None).cast(ANSWER).alias("answer"), n.alias("attempts"), "kinds", F.format_string("no answer in attempt %d", n).alias("error")))
        failing = judged.where("__state = 'bad'")
        if k == rounds:
            after = F.format_string("malformed after %d retries: %d faults, the first %s at %s", F.lit(k - 1), F.size("__faults"), F.col("__faults")[0]["type"], F.col("__faults")[0]["place"])
            ended.append(failing.select(*own, F.lit(None).cast(ANSWER).alias("answer"), n.alias("attempts"), "kinds", after.alias("error")))
        elif failing.isEmpty():
            break
        else:
            told = failing.withColumn("__told", feedback(F.col("__faults"), F.col("__answer.text")))
            open_ = told.select(*own, F.col("__told.kind").alias("kind"), F.col("__told.message").alias("message"), F.concat("kinds", F.array("__told.kind")).alias("kinds"))
    return reduce(DataFrame.unionByName, ended)


def capture(rows: DataFrame, steps: dict[str, tuple[Column, Column, Column]], record: Column) -> DataFrame:
    """rows with a column for each step, error and failed_record: a row whose step fails stays, with the fallbacks of all steps, the first fault as its error and its record as it came.

    steps: name to (value, fault, fallback), in order; value must not raise (use try_ functions and PERMISSIVE parsing), fault is null or says what is wrong.
    """
    error = F.coalesce(*[F.concat(F.lit(f"{name}: "), fault) for name, (_, fault, _) in steps.items()])
    marked = rows.withColumns({"error": error, "failed_record": F.when(error.isNotNull(), record)})
    return marked.withColumns({name: F.when(F.col("error").isNull(), value).otherwise(fallback) for name, (value, _, fallback) in steps.items()})


def write_apart(captured: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The rows that went well and those that failed, written to path once in a folder each and read from there."""
    captured.withColumn("failed", F.col("error").isNotNull()).write.partitionBy("failed").parquet(path)
    spark = captured.sparkSession
    every = spark.read.schema(captured.schema.add("failed", "boolean")).parquet(path)
    return every.where("not failed").drop("failed"), every.where("failed").drop("failed")
