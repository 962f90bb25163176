"""Literal cases of guards, projections, loaders and reports."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import corpus, evaluation, service, verdict
from quillstone.operators.retrieval import RetrievalConfig
from quillstone.sources import tables


def values(spark, rows, schema, column):
    return [r.v for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", column.alias("v")).orderBy("i").collect()]


def test_guards(spark):
    rows = [(b"%PDF-1", "a.pdf", "application/pdf", "es", ["gdpr"]), (b"", "a.md", "text/markdown", "es", ["gdpr"]), (b"x", "a", "image/png", "es", ["gdpr"]), (b"x", "a", "application/pdf", "es", ["gdpr"]), (b"x", "a", "text/markdown", "fr", ["gdpr"]), (b"x", "a", "text/markdown", "en", ["no"])]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, content binary, name string, mime string, language string, corpus array<string>")
    assert [r.f for r in frame.select("i", service.upload_fault(frame, ["gdpr"]).alias("f")).orderBy("i").collect()] == [None, "empty", "unsupported_type", "not_a_pdf", "unsupported_language", "unknown_corpus"]
    assert values(spark, [(b"%PDF-", "x"), (b"x", "a.MD"), (b"x", "a.txt")], "c binary, n string", service.mime_of(F.col("c"), F.col("n"))) == ["application/pdf", "text/markdown", None]
    assert values(spark, [("https://eur-lex.europa.eu/a",), ("https://eur-lex.europa.eu.evil.com/",), (None,), ("::",)], "u string", service.fetch_allowed(F.col("u"))) == [True, False, False, False]
    assert values(spark, [("5/minute",), ("0/minute",), ("10 per 2 hours",), ("x",), (None,)], "r string", service.rate_limit_ok(F.col("r"))) == [True, False, True, False, False]
    with pytest.raises(Exception, match="unsupported type"):
        values(spark, [("x/y",)], "m string", service.dispatch(F.col("m")))


def test_projections(spark):
    rows = [(False, None), (True, "ignore-previous"), (True, "internal_error: x"), (True, None)]
    assert values(spark, rows, "s boolean, r string", service.skip_category(F.col("s"), F.col("r"))) == ["clean", "injection_blocked", "internal_error", "internal_error"]
    assert values(spark, rows, "s boolean, r string", service.skip_category(F.col("s"), F.col("r"), strict_compat=True)) == ["clean", "internal_error", "internal_error", "internal_error"]
    assert values(spark, [("T", "b"), ("", "b"), (None, "b")], "t string, b string", service.question(F.col("t"), F.col("b"))) == ["T\nb", "b", "b"]
    assert values(spark, [("ab",), ("x" * 60,)], "t string", F.length(service.padded(F.col("t")))) == [50, 60]
    assert values(spark, [([("a.1", "x"), ("a.2", "y")],)], "c array<struct<article_id:string,text:string>>", service.numbered_context(F.col("c"))) == ["[1] a.1: x\n[2] a.2: y"]
    finding = "f array<struct<severity:string,verdict:string,citations:array<struct<validated:boolean>>>>"
    cases = [([("high", "pass", [(True,)]), ("low", "pass", [(True,)])],), ([("low", "blocked", [(False,)]), ("low", "pass", [(False,)])],), ([("low", "pass", [(True,)])] * 2,)]
    assert values(spark, cases, finding, F.size(service.under_review(F.col("f")))) == [1, 1, 2]
    state = service.state(spark.createDataFrame([(True, None, None), (False, None, None), (False, "pass", [(True,), (False,)])], "injected boolean, verdict string, citations array<struct<validated:boolean>>"))
    assert [(r.status, r.n_citations, r.n_validated) for r in state.collect()] == [("blocked_injection", 0, 0), ("no_answer", 0, 0), ("pass", 2, 1)]
    with pytest.raises(ValueError, match="query"):
        service.assert_safe_columns(spark.createDataFrame([(1, "x")], "n_x int, query string"), set())
    assert values(spark, [("c1", "es")], "c string, l string", service.source_url(F.col("c"), F.col("l"))) == ["https://eur-lex.europa.eu/legal-content/ES/TXT/?uri=CELEX:c1"]


def test_configuration():
    default = RetrievalConfig()
    assert service.config_of('{"top_k": 7, "max_per_group": null}') == RetrievalConfig(top_k=7, max_per_group=None)
    for bad in (None, "", "[]", "{", '{"no": 1}', '{"top_k": "7"}', '{"top_k": true}'):
        assert service.config_of(bad) == default


def test_attacks(spark, tmp_path):
    line = lambda **x: json.dumps({"mode": "document", "requires_e2e": False, **x})
    (tmp_path / "a.jsonl").write_text("\n".join([line(id="a"), "", line(id="b", mode="chat")]))
    own = service.attack_cases(spark, str(tmp_path / "a.jsonl"))
    assert own.count() == 2 and service.smoke(own).count() == 1
    for bad in ([line(id="a")] * 2, [line(id="a", mode="chat", requires_e2e=True)]):
        (tmp_path / "b.jsonl").write_text("\n".join(bad))
        with pytest.raises(ValueError):
            service.attack_cases(spark, str(tmp_path / "b.jsonl"))
    rows = [("document", True, None, None, None, None, None), ("chat", None, True, None, None, None, None), ("chat", None, False, True, None, "block", None), ("chat", None, False, False, False, "pass", None), ("document", True, None, None, None, None, "timeout")]
    got = service.attack_outcome(spark.createDataFrame(rows, "mode string, sanitizer boolean, injection boolean, validator boolean, council boolean, verdict string, error string"))
    assert [(r.layer, r.blocked) for r in got.collect()] == [("sanitizer", True), ("injection", False), ("validator", True), ("none", False), ("sanitizer", False)]
    assert service.all_safe(spark.createDataFrame([(True, ["x"]), (False, [])], "blocked boolean, emitted array<string>")).first().safe
    with pytest.raises(Exception, match="no cases"):
        service.all_safe(spark.createDataFrame([], "blocked boolean, emitted array<string>")).collect()


def test_caches_and_reports(spark, tmp_path):
    entry = lambda q, a: json.dumps({"request": {"user": json.dumps({"query": q, "actual_answer": a})}})
    lines = spark.createDataFrame([("2", entry("q", "later")), ("1", entry("q", "first")), ("3", "no json"), ("4", json.dumps({"request": {"user": "text"}}))], "file string, value string")
    assert [tuple(r) for r in service.judge_cache(lines).collect()] == [("q", "first", "1")]
    kinds = service.tagged(spark.createDataFrame([('{"kind": "chat", "data": {"id": "a"}}',), ('{"kind": "doc", "data": {"id": "b"}}',)], "value string"), {"chat": "id string", "doc": "id string"})
    assert [r.id for r in kinds["doc"].collect()] == ["b"]
    with pytest.raises(Exception, match="unknown kind"):
        service.tagged(spark.createDataFrame([('{"kind": "x"}',)], "value string"), {"chat": "id string"})["chat"].collect()
    made = service.report(spark.createDataFrame([(0.8, 0.2)], "a double, b double"), spark.createDataFrame([("a", 0.7), ("b", 0.5)], "metric string, bar double"))
    assert {r.metric: (r.delta, r.met) for r in made.collect()} == {"a": (0.1, True), "b": (-0.3, False)}
    assert "| a | 0.8 | 0.7 | 0.1 | True |" in service.markdown(made, "Run")
    text = "# Run\n### c1 (chat)\n- verdict: pass\n- expected: block\n- emitted: 6.1, 7\n- recall: 0.5\n### c2\n- verdict: block\n"
    got = service.from_markdown(spark.createDataFrame([(text,)], "value string")).collect()
    assert [tuple(r) for r in got] == [("c1", "pass", "block", ["6.1", "7"], 0.5), ("c2", "block", None, [], None)]
    runs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    assert sorted(r.v for r in service.latest(runs, "k", "n").collect()) == ["y", "z"]
    assert [r.v for r in tables.checked(runs, str(tmp_path / "t"), "v", F.lit("w")).collect()] == ["w"] * 3
    good, bad = service.quarantine(spark.createDataFrame([("n", "1", None, "es", "t"), ("n", "1", None, "xx", "t"), ("n", "1", None, None, "t"), ("n", "1", None, "en", " \t")], "norma string, articulo string, apartado string, language string, text string"), service.valid_citation())
    assert (good.count(), bad.count()) == (1, 3)
    (tmp_path / "g.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    assert service.gold_cases(spark, str(tmp_path / "g.jsonl")).count() == 2
    assert [r.id for r in service.gold_cases(spark, str(tmp_path / "g.jsonl"), spark.createDataFrame([("b",)], "id string")).collect()] == ["b"]


def test_index_is_built_for_what_changed(spark, tmp_path):
    from quillstone.operators import index

    embed = index.embedder(lambda: lambda texts: [[float(len(t))] for t in texts], batch=2)
    schema = "norma string, articulo string, language string, text string, paragraphs array<struct<apartado:string,text:string>>"
    articles = spark.createDataFrame([("n", str(i), "en", "w " * (i + 1), [("1", "a b"), ("2", "c")]) for i in range(5)], schema)
    entries = lambda done: spark.createDataFrame([("n", str(i), "en", ["x"] if i in done else [], "m" if i in done else None) for i in range(5)], "norma string, articulo string, language string, chunks array<string>, embedding_model string")
    empty = spark.createDataFrame([], "chunk_id string, article_id string, norma string, articulo string, apartado string, language string, text string, token_count int, content_hash string, vector array<float>, model string")
    made, summary = index.build(articles, entries(set()), empty, embed, "m", max_tokens=3)
    assert {r.chunk_id: r.vector for r in made.collect()} == {"n.0.en": [2.0], "n.1.en": [4.0], "n.2.en": [6.0], "n.3.1.en": [3.0], "n.3.2.en": [1.0], "n.4.1.en": [3.0], "n.4.2.en": [1.0]}
    assert summary.first().added == 7
    _, again = index.build(articles, entries({0, 1, 2, 3, 4}), made, embed, "m", max_tokens=3)
    assert (again.first().added, again.first().recomputed, again.first().unchanged) == (0, 0, 7)
    _, part = index.build(articles, entries({0, 1, 2, 3}), made, embed, "m", max_tokens=3)
    assert (part.first().recomputed, part.first().unchanged) == (2, 5)
    with pytest.raises(FileNotFoundError):
        index.open_index(spark, str(tmp_path / "i"))
    assert index.open_index(spark, str(tmp_path / "i"), empty).count() == 0


def test_settings_as_a_column(spark):
    given = [None, "", "{}", '{"pre_rerank": 20, "top_k": 3}', '{"purity_threshold": 0.75}', '{"purity_threshold": 1}', '{"top_k": 3, "unknown": 1}', '{"top_k": "3"}', "{not json", '{"top_k": true}', '{"top_k": null}', '{"max_per_group": null}', '{"max_per_article": 2, "top_k_auto": 7}', "[1]", "3", "null", '{"top_k": 2.5}', '{"purity_threshold": false}']
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", service.config_columns(F.col("t")).alias("c")).collect()
    for i, c in rows:
        want = service.config_of(given[i])
        assert c.asDict() == {n: getattr(want, n) for n in c.__fields__}, given[i]


def test_reports_are_read_back(spark, tmp_path):
    cases = spark.createDataFrame([("c-2", "chat", "pass", "6.1", ["6.1", "7"], 0.5, 1), ("c-1", "doc", None, None, [], None, 1), ("c-3", "chat", "block", "x", ["y"], 0.0, 2)], "case_id string, mode string, verdict string, expected string, emitted array<string>, recall double, part int")
    service.write_report(spark.createDataFrame([(3, 0.5)], "n int, share double"), cases, f"file://{tmp_path}/r", "Title", "part")
    summary, found = service.read_report(spark, f"file://{tmp_path}/r")
    assert summary.splitlines() == ["# Title", "", "| n | share |", "|---|---|", "| 3 | 0.5 |"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("c-2", "pass", "6.1", ["6.1", "7"], 0.5), ("c-1", None, None, [], None), ("c-3", "block", "x", ["y"], 0.0)]))


def test_votes_of_failing_judges(spark):
    judges = spark.createDataFrame([("a", "one", True), ("b", "two", True), ("c", "three", False)], "mode string, provider string, has_key boolean")
    replies = spark.createDataFrame([(1, "a", '{"vote": "BLOCK", "reason": "r"}'), (1, "b", "{"), (1, "c", '{"vote": "PASS"}'), (2, "a", None), (2, "b", '{"vote": "maybe"}')], "case_id int, mode string, reply string")
    got = {(r.case_id, r.mode): (r.vote, r.reason, r.ok, r.error) for r in verdict.votes(spark.range(1, 4).select(F.col("id").cast("int").alias("case_id")), judges, replies).collect()}
    review = "requires_human_review"
    assert got[1, "a"] == ("block", "r", True, None) and got[1, "b"] == (review, "judge_failed", False, "no_valid_vote") and got[1, "c"] == (review, "judge_skipped_no_key:three", False, "provider_key_absent")
    assert got[2, "a"][3] == "failed" and got[2, "b"][3] == "no_valid_vote" and got[3, "a"][3] == "failed" and len(got) == 9


def test_targets_and_judged_scores(spark):
    asked = spark.createDataFrame([(1, "all", None), (2, "gdpr", ["en"]), (3, "none", None), (4, "gdpr", [])], "i int, wanted string, languages array<string>")
    got = corpus.targets_of(asked).collect()
    assert len([r for r in got if r.i == 1]) == 2 * len(corpus.REGISTRY) and [(r.corpus, r.language) for r in got if r.i == 2] == [("gdpr", "en")] and {r.i for r in got} == {1, 2}
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", float("nan")), (2, "a", 7.0)], "case_id int, metric string, score double")
    cases = spark.range(1, 4).select(F.col("id").cast("int").alias("case_id"))
    assert sorted(map(tuple, evaluation.with_judged(cases, scores, ["a", "b"]).collect())) == [(1, 0.5, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)]
    assert {r.a for r in evaluation.with_judged(cases, scores, ["a", "b"], skip=True).collect()} == {0.0}
