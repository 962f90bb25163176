"""Cases in which a cap, a clip or a bound once changed a result."""

from types import SimpleNamespace

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstone.llm import langid, near, pii, token_store, topk, toxicity
from quillstone.llm.common import first_by_hash

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_scores_beyond_62_bits_are_exact(spark):
    big = 2**31
    vectors = [(0, [big, big]), (1, [big // 2, big // 2]), (2, [big - 1, big - 1]), (3, [big // 2 + 5, big // 2]), (4, [-big, -big]), (5, [big // 2, big // 2]), (6, [0, 0])]
    got = topk.search(spark.createDataFrame(vectors, "vec_id long, vector array<long>"), F.col("vec_id") == 0, k=4).collect()
    want = sorted(((-(a * big + b * big), i) for i, (a, b) in vectors if i))[:4]
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    with pytest.raises(Exception, match="Overflow|too (big|large)|int64|out of"):
        topk.search(spark.createDataFrame([(0, [2**62]), (1, [2**62])], "vec_id long, vector array<long>"), F.col("vec_id") == 0).collect()


def test_large_scores_in_several_waves(spark):
    vectors = [(i, [2**31 - 1 - (i * 7919) % 1000, 2**30 + (i * 104729) % 1000]) for i in range(300)]
    got = topk.search(spark.createDataFrame(vectors, "vec_id long, vector array<long>"), F.col("vec_id") % 50 == 0, per_shard=40, per_block=4).collect()
    for q in range(0, 300, 50):
        own = sorted((-sum(a * b for a, b in zip(vectors[q][1], v)), i) for i, v in vectors if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in own]


def test_samples_despite_copies(spark):
    copies = spark.range(100_000).select("id", F.concat(F.lit("text "), F.col("id") % 5).alias("t"))
    assert sorted(r.t for r in first_by_hash(copies.select("t"), F.col("t"), 512)) == [f"text {k}" for k in range(5)]
    mixed = spark.range(50_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("t"))
    got = [r.t for r in first_by_hash(mixed, F.col("t"), 100)]
    assert len(set(got)) == 100


def test_dictionary_of_copies_and_of_long_texts(spark):
    few = spark.range(20_000).select(F.concat(F.lit("the quick brown fox number "), F.col("id") % 40, F.lit(" jumps over the lazy dog again")).alias("text"))
    assert token_store.train_dictionary(few, WORDS)
    long = spark.range(60).select(F.concat_ws(" ", F.lit("number"), "id", F.repeat(F.lit("the quick brown fox jumps over the lazy dog "), 500)).alias("text"))
    assert long.where("length(text) <= 16384").count() == 0
    assert token_store.train_dictionary(long, WORDS)


def test_toxicity_takes_one_text_of_an_id(spark):
    docs = spark.range(40_000).select(F.when(F.col("id") < 39_980, 0).otherwise(F.col("id") - 39_979).alias("doc_id"), F.concat(F.lit("words of text "), F.col("id")).alias("text"))
    labels = spark.range(21).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    seen = []
    fit = toxicity.fit
    try:
        toxicity.fit = lambda texts, y, **how: seen.append(len(texts)) or fit(texts, y, **how)
        toxicity.train(docs, labels, F.lit(True))
    finally:
        toxicity.fit = fit
    assert seen and seen[0] <= 21


def test_languages_share_a_bounded_sample(spark):
    docs = spark.range(3_000).select("id", F.concat(F.lit("l"), F.col("id") % 2_500).alias("lang"), F.concat(F.lit("text "), F.repeat(F.lit("abc "), 400), F.col("id")).alias("text"))
    got = langid.sample(docs, F.lit(True), total=100_000, languages=500)
    assert len(got) == 500 and sum(len(t) for own in got.values() for t in own) <= 100_000 + 500
    assert {f"l{k}" for k in range(500)} == set(got)  # those with two texts


PROBES = {
    "Ref AB12 4111 1111 1111 1111 paid": ["4111 1111"],
    "联系john@example.com谢谢": ["john", "example.com"],
    "ü@x.de": ["ü", "x.de"],
    "müller@firma.de": ["mü", "ller", "firma"],
    "Иван@почта.example.com": ["Иван"],
    "Mr J. Smith": ["Smith", "J."],
    "Dr. Anna-Maria O'Neil came": ["Anna", "Maria", "Neil", "O'"],
    "Mrs John F. Kennedy's dog, Kennedy": ["John", "F.", "Kennedy"],
    "Mr McDonald": ["Mc", "Donald"],
    "x" * 100 + " Mr A" + "a" * 50_000: ["Aaaa"],
}


def test_no_personal_data_is_left(spark):
    got = {r.text: r for r in pii.replace(spark.createDataFrame([(t,) for t in PROBES], "text string"), "k").collect()}
    for text, values in PROBES.items():
        if "почта" in text:  # domains are ASCII
            continue
        assert got[text].n_entities > 0, text
        assert not [v for v in values if v in got[text].surrogate_text], (text, got[text].surrogate_text)
    assert got["联系john@example.com谢谢"].surrogate_text.startswith("联系") and got["Ref AB12 4111 1111 1111 1111 paid"].surrogate_text.startswith("Ref AB12 9")


def test_one_key_for_query_and_pipeline(spark):
    assert pii.configured_key(spark) == "pipeline-key"
    spark.conf.set("spark.quillstone.pii.key", "secret")
    try:
        assert pii.configured_key(spark) == "secret"
    finally:
        spark.conf.unset("spark.quillstone.pii.key")


def test_a_cluster_without_a_key_gets_a_secret_one():
    """An application on a cluster whose key isn't set has one of its own, the same for query and pipeline; others have others."""
    on = lambda app, **conf: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId=app))
    first, again, other = (pii.configured_key(on(app)) for app in ("app-1", "app-1", "app-2"))
    assert first == again != other and "pipeline-key" not in (first, other) and len(first) == len(other) == 64
    assert pii.configured_key(on("app-1", **{"spark.quillstone.pii.key": "secret"})) == "secret"


def test_ids_that_are_no_numbers_are_named(spark, tmp_path):
    docs = spark.createDataFrame([("a", "text", [1])], "doc_id string, text string, vector array<long>")
    with pytest.raises(TypeError, match="doc_id"):
        near.join(docs)
    with pytest.raises(TypeError, match="doc_id"):
        token_store.write(docs, f"file://{tmp_path}/x", WORDS)
    with pytest.raises(TypeError, match="doc_id"):
        topk.search(docs, F.lit(True), vec_id="doc_id")


def test_keep_one_judges_rows_of_one_id_apart(spark):
    alpha, other, third = "alpha beta gamma delta epsilon zeta", "totally different words are in this one", "and a third text of some more words here"
    rows = [(1, alpha), (1, other), (2, alpha), (3, third), (3, third), (4, None), (4, None), (None, alpha), (5, other), (5, "something that nothing else is like at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.keep_one(docs, near.join(docs, digests=True)).collect()
    want = [(1, alpha), (1, other), (3, third), (4, None), (None, alpha), (5, "something that nothing else is like at all")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
