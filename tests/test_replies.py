"""Replies, messages and schemas, traces and versions in literal cases."""

import json

import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.functions import text
from quillstone.operators import messages, replies
from quillstone.operators.trace import Trace
from quillstone.sources import versions

CITE = {"norma": "gdpr", "articulo": "5", "language": "es", "text": "a quote"}
GOOD = {"query": "q", "language": "es", "text": "t", "findings": [{"text": "f", "citations": [CITE]}]}


def with_(path, value):
    own = json.loads(json.dumps(GOOD))
    at = own
    for p in path[:-1]:
        at = at[p]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(own)


CASES = [
    (json.dumps(GOOD), [], None), (with_(["query"], ""), [], None), (with_(["findings"], []), ["findings too_short"], "findings"), (with_(["findings"], None), ["findings missing"], "findings"),
    (with_(["text"], ""), ["text string_too_short"], "text"), (with_(["text"], None), ["text missing"], "text"), (with_(["language"], "fr"), ["language literal_error"], "other"),
    (with_(["findings", 0, "citations"], []), ["findings.0.citations too_short"], "citations"), (with_(["findings", 0, "severity"], "dire"), ["findings.0.severity literal_error"], "other"), (with_(["findings", 0, "severity"], "high"), [], None),
    (with_(["findings", 0, "citations", 0, "text"], " \t"), ["findings.0.citations.0.text value_error"], "citations"), (with_(["findings", 0, "citations", 0, "text"], ""), ["findings.0.citations.0.text string_too_short"], "citations"),
    (with_(["findings", 0, "citations", 0, "norma"], "none"), ["findings.0.citations.0.norma literal_error"], "citations"), (with_(["findings"], "x"), [" type_error"], "other"), ("{}", ["query missing", "language missing", "text missing", "findings missing"], "text"),
    ("no json", None, None), ("[1]", None, None), (None, None, None),
]


def test_faults_and_feedback(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, *_) in enumerate(CASES)], "i int, reply string").withColumn("a", replies.parsed(F.col("reply")))
    rows = rows.withColumn("f", F.when(F.col("a").isNotNull(), replies.faults(F.col("a")))).withColumn("told", F.when(F.size("f") > 0, replies.feedback(F.col("f"), F.col("a.text"))))
    got = {r.i: r for r in rows.collect()}
    for i, (reply, want, kind) in enumerate(CASES):
        assert (None if got[i].f is None else [f"{x.place} {x.type}" for x in got[i].f]) == want, reply
        assert (got[i].told.kind if got[i].told else None) == kind, reply
    assert "'t'" in got[2].told.message


def test_only_failing_cases_go_on(spark):
    cases = spark.createDataFrame([(0,), (1,), (2,)], "i int")
    fixed = F.when((F.col("i") == 0) | ((F.col("i") == 1) & (F.col("kind") == "findings")), json.dumps(GOOD)).otherwise(with_(["findings"], []))
    got = {r.i: r for r in replies.ask_again(cases, fixed).collect()}
    assert [(got[i].attempts, got[i].kinds) for i in range(3)] == [(1, []), (2, ["findings"]), (3, ["findings", "findings"])]
    assert got[0].error is got[1].error is None and "after 2 retries" in got[2].error and got[2].answer is None and got[1].answer.findings[0].citations[0].text == "a quote"
    assert replies.ask_again(cases.limit(0), fixed).count() == 0


def test_capture_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "4", 2), (2, "x", 2), (3, "4", 0), (4, None, 0)], "i int, a string, b int")
    a = F.col("a").try_cast("int")
    steps = {"number": (a, F.when(a.isNull(), "no number"), F.lit(-1)), "share": (F.try_divide(a, F.col("b")), F.when(F.col("b") == 0, "by zero"), F.lit(0.0))}
    got = sorted((r.i, r.number, r.share, r.error, r.failed_record) for r in replies.capture(rows, steps, F.coalesce("a", F.lit("-"))).collect())
    assert got == [(1, 4, 2.0, None, None), (2, -1, 0.0, "number: no number", "x"), (3, -1, 0.0, "share: by zero", "4"), (4, -1, 0.0, "number: no number", "-")]


def test_unknown_blocks_are_errors(spark):
    block = {"type": "image", **dict.fromkeys(("text", "id", "name", "input", "tool_use_id", "content"))}
    rows = spark.createDataFrame([([("user", None, [tuple(block.values())])],)], f"messages array<{messages.MESSAGE}>")
    with pytest.raises(Exception, match="unknown type of block: image"):
        rows.select(messages.to_chat(F.col("messages"), F.lit("s"))).collect()


def test_tools_and_choices(spark):
    row = spark.range(1).select(
        messages.tools(F.array(F.struct(F.lit("f").alias("name"), F.lit(None).cast("string").alias("description"), F.lit("{}").alias("input_schema")))).alias("tools"),
        *[messages.tool_choice(F.struct(F.lit(t).alias("type"), F.lit(n).cast("string").alias("name"))).alias(t) for t, n in (("tool", "f"), ("auto", None))],
    ).first()
    assert row.tools[0].function.asDict() == {"name": "f", "description": "", "parameters": "{}"} and row.tools[0].type == "function"
    assert json.loads(row.tool) == {"type": "function", "function": {"name": "f"}} and json.loads(row.auto) == {"type": "auto"}


def strict(node):
    if isinstance(node, dict):
        out = {k: strict(v) for k, v in node.items()}
        return out | {"additionalProperties": False} if out.get("type") == "object" else out
    return [strict(x) for x in node] if isinstance(node, list) else node


KEYS = st.sampled_from(["type", "properties", "findings", "items", "é\"k", "a", "additionalProperties", "0"])
SCHEMAS = st.recursive(st.sampled_from(["object", "array", None, True, 3, "s\n"]), lambda inner: st.lists(inner, max_size=3) | st.dictionaries(KEYS, inner, max_size=4), max_leaves=12)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(SCHEMAS, min_size=8, max_size=8))
def test_strict_schemas_of_any_shape(spark, schemas):
    rows = [(i, json.dumps(s)) for i, s in enumerate(schemas)] + [(8, "{bad"), (9, None)]
    got = {r.i: r.s for r in messages.strict(spark.createDataFrame(rows, "i int, s string"), "i", "s", "findings").collect()}
    for i, s in enumerate(schemas):
        want = strict(s)
        found = want.get("properties") if isinstance(want, dict) else None
        if isinstance(found, dict) and isinstance(found.get("findings"), dict):
            found["findings"]["minItems"] = 1
        assert json.loads(got[i]) == want
    assert got[8] is None and got[9] is None and len(got) == 10


def test_trace_sees_rows_without_another_pass(spark):
    trace = Trace()
    rows = trace.step("all", spark.range(100), even=F.count_if(F.col("id") % 2 == 0))
    rows = trace.step("some", rows.where("id < 30"))
    rows.write.format("noop").mode("overwrite").save()
    assert trace.values() == [(1, "all", "n", 100.0), (1, "all", "even", 50.0), (2, "some", "n", 30.0)]


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versions.current(spark, path) is None and versions.read(spark, path) is None
    first = versions.create(spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v")), path, "k", 8)
    reader = versions.read(spark, path)
    second = versions.upsert(path, spark.createDataFrame([("a", 3), ("b", 3), ("c", 1000)], "v string, k long"), "v")
    assert 1 <= sum(second.folders[b] != first.folders.get(b) for b in second.folders) <= 2
    got = {r.k: r.v for r in versions.read(spark, path).collect()}
    assert len(got) == 101 and got[3] == "b" and got[1000] == "c" and got[4] == "old"
    assert {r.v for r in reader.collect()} == {"old"}  # an older version's reader goes on
    assert versions.delete(spark, path, ["3", "5"], F.col("v") != "old") == 1
    assert versions.delete(spark, path, ["no such"], F.lit(True)) == 0
    assert versions.read(spark, path).count() == 100
    with pytest.raises(LookupError):
        versions.read(spark, path, 1)
    assert versions.vacuum(spark, path) > 0 and versions.read(spark, path).count() == 100 and versions.vacuum(spark, path) == 0
    with pytest.raises(LookupError):
        versions.upsert(f"{path}-none", spark.range(1).select(F.col("id").alias("k"), F.lit(1).alias("v")), "v")
    versions.upsert(f"{path}-none", spark.range(3).select(F.col("id").alias("k"), F.lit(1).alias("v")), "v", key="k")
    assert versions.read(spark, f"{path}-none").count() == 3


def test_vocabulary_counts(spark):
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), ["", "a b", "wörd " * 100, None, "日本\n\n x"]
    own = Tokenizer.from_file(path)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.exact_tokens(text.vocabulary(path))(F.col("t")).alias("n"))
    assert {r.i: r.n for r in rows.collect()} == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
