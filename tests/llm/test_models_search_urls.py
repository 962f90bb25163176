import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.llm import langid, near, topk, toxicity, urls
from quillstone.llm.automaton import SuffixAutomaton
from quillstone.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

SF = "/root/testdata/sf0.01"


def test_automaton_matches_as_search():
    rng = random.Random(6)
    for _ in range(60):
        items = [[rng.randint(0, 2) for _ in range(rng.randint(1, 12))] for _ in range(4)]
        a = SuffixAutomaton(items)
        stream, state, matched = [rng.randint(0, 3) for _ in range(40)], 0, 0
        inside = lambda s: any(s == x[i : i + len(s)] for x in items for i in range(len(x) - len(s) + 1))  # noqa: E731, B023
        for i, c in enumerate(stream):
            state, matched = a.step(state, matched, c)
            want = max(n for n in range(i + 2) if inside(stream[i + 1 - n : i + 1]))
            assert matched == want
            for n in range(1, matched + 1):
                u = a.suffix(state, n)
                assert u == a.walk(stream[i + 1 - n : i + 1])


# top-k


def brute(vectors, k, every):
    good = [(i, v) for i, v in vectors if i is not None and v and all(x is not None for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            found = sorted((-int(np.dot(a, b)), i) for i, b in good if i != q and len(b) == len(a))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("per_shard", [10_000, 150])
def test_top_k_as_brute_force(spark, per_shard):
    rng = np.random.default_rng(2)
    vectors = [(i, [int(x) for x in rng.integers(-3, 4, 6)]) for i in range(700)]  # many ties
    vectors += [(700, None), (701, [1, None, 2]), (702, []), (710, [1, 2]), (711, [3, 4]), (720, [0] * 6), (None, [1] * 6)]
    frame = spark.createDataFrame(vectors, "vec_id long, vector array<long>").withColumn("shard", F.lit("x"))
    got = topk.search(frame, F.col("vec_id") % 10 == 0, 5, per_shard=per_shard, per_block=30)
    assert sorted(map(tuple, got.collect())) == brute(vectors, 5, 10)
    assert topk.search(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_of_large_components_and_repeated_ids(spark):
    """Scores beyond what doubles hold, and one id that a third of all rows have."""
    rng = random.Random(12)
    for most in (1 << 20, 1 << 27, 1 << 29):
        rows = [(i if i % 3 else 7, [rng.randint(-most, most) for _ in range(16)]) for i in range(300)]
        own = min(v for i, v in rows if i == 7)
        got = [(r["rank"], r.vec_id, r.score) for r in topk.search(spark.createDataFrame(rows, "vec_id long, vector array<long>"), F.col("vec_id") == 7, per_shard=50).orderBy("rank").collect()]
        want = sorted(((sum(a * b for a, b in zip(own, v)), -i) for i, v in rows if i != 7), reverse=True)[:5]
        assert got == [(k + 1, -i, s) for k, (s, i) in enumerate(want)]


def test_tree_leaves_nodes_alone():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c * 40, 1, (500, 4)) for c in range(8)]).round()
    tree, opened = topk.BallTree(np.arange(len(x)), x), []
    q = x[-3:]
    tree.nodes = [tuple(n) for n in tree.nodes]
    inner = topk._best
    topk._best = lambda s, i, k: opened.append(s.size) or inner(s, i, k)
    try:
        row, ids, score = tree.search(np.array([-1, -2, -3]), q, 5, np.full(3, topk._NEVER))
    finally:
        topk._best = inner
    assert sum(opened) < 0.5 * 3 * len(x)
    for r in range(3):
        assert sorted(score[row == r]) == sorted((x @ q[r]).astype(int))[-5:]


# toxicity


def labelled(rng, n, insults, lengths=(3, 200)):
    plain = ["".join(rng.choice(["ta", "ro", "mi", "ken", "sul", "va"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(*lengths))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(insults)
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_unseen_misspellings_are_toxic(spark):
    rng = random.Random(8)
    rows = labelled(rng, 700, ["blorgheap", "grumbface", "wuzzlehead"])
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 > 0)
    held = [r for r in rows if r[0] % 5 == 0]
    extra = [(-1, None, 0), (-2, "", 0), (-3, "... 😀", 0), (-4, "ta ro blorghheap mi", 1), (-5, "ta ro grumbfacee ken", 1), (-6, "ta ro " * 30_000, 0), (-6, "ta ro " * 30_000, 0)]
    frame = spark.createDataFrame([(d, t) for d, t, _ in held + extra], "doc_id long, text string").withColumn("Score", F.lit("x"))
    got = toxicity.score(frame, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    scores = {r.doc_id: (r.score, r.predicted) for r in got.collect()}
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in scores.values())
    assert np.mean([scores[d][1] == y for d, _, y in held]) >= 0.95
    assert [scores[d][1] for d, _, _ in extra] == [y for *_, y in extra]
    assert toxicity.score(frame.limit(0), model).count() == 0


def test_without_both_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"), F.lit(True))
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0, 0]


def test_held_out_toxicity(spark):
    """The query on a table of words of two kinds: labels of the fold that isn't learned from."""
    rng = random.Random(8)
    good, bad = ([f"{p}{rng.choice('aeiou')}{c}{rng.choice('aeiou')}" for c in "bdfgklmnprst" for _ in range(12)] for p in ("w", "zzq"))
    docs, labels = [], []
    for i in range(600):
        own = [rng.choice(good) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.3
        if toxic:
            k = rng.randrange(len(own))
            own[k:k] = [rng.choice(bad) for _ in range(6)]
        docs.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), ~held)
    got = {r.doc_id: r.predicted for r in toxicity.score(frame.where(held), model).collect()}
    assert len(got) > 80 and np.mean([labels[d][1] == p for d, p in got.items()]) >= 0.97


def test_windows_begin_anywhere():
    rng = random.Random(3)
    model = toxicity.Model(np.array([rng.uniform(-1, 1) for _ in range(1 << 10)], np.float32), 0.1)
    texts = [" ".join(rng.choice(["ab", "cde", "fghi", "é", "x1"]) + str(rng.randint(0, 30)) for _ in range(n)) for n in (1, 3, 9, 10, 11, 35, 200)]
    for t, z in zip(texts, model.logits(pa.array(texts))):
        own = t.split(" ")
        of_word = [(model.logits(pa.array([w]))[0] - model.bias) for w in own]
        ends = range(10, len(own) + 1) if len(own) > 10 else [len(own)]
        assert abs(z - model.bias - max(np.mean(of_word[max(0, e - 10) : e]) for e in ends)) < 1e-6


def test_classes_of_long_texts_are_learned(spark):
    docs = [(i, "kind word here " * 20) for i in range(20)] + [(100 + i, "kind word here " * 200 + "vile slur " * 5) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d >= 100)) for d, _ in docs], "doc_id long, toxic int")
    model = toxicity.train(frame, labels, F.lit(True), max_chars=1000)
    assert [r.predicted for r in toxicity.score(frame, model).orderBy("doc_id").collect()] == [0] * 20 + [1] * 20


# language


SAMPLE = {"aa": ["banana bandana cabana " * 20], "bb": ["street strength stretch " * 20], "cc": ["ßüß öäü äöü"]}


def test_phrases_as_brute_force():
    parser = langid.CrossParser(SAMPLE)
    rng = random.Random(9)
    texts = ["".join(rng.choice("banasterghc ßü日.1") for _ in range(rng.randint(0, 700))) for _ in range(20)]
    symbols = [langid._joined(parser.symbol[langid._code_points(t)]) for t in texts]
    got = parser.phrases(symbols)
    for i, s in enumerate(symbols):
        for j, language in enumerate(parser.languages):
            parts, n = [bytes(langid._joined(parser.symbol[langid._code_points(t)])) for t in SAMPLE[language]], 0
            for k in range(0, len(s), langid.LANE):
                lane, at = bytes(s[k : k + langid.LANE]), 0
                while at < len(lane):
                    end = at
                    while end < len(lane) and lane[end] != 1 and any(lane[at : end + 1] in p for p in parts):
                        end += 1
                    at, n = max(end, at + 1), n + 1
            assert got[i, j] == n


def test_languages(spark):
    rows = [(1, "a banana in cabanas"), (2, "STRENGTH of streets"), (3, None), (4, ""), (5, "123 !!"), (6, "ßüß"), (7, "日本"), (8, "banana " * 30_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("LANG_PRED", F.lit(1))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame, SAMPLE).collect()}
    assert [got[i][0] for i in range(1, 9)] == ["aa", "bb", "und", "und", "und", "cc", "cc", "aa"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0
    assert {r.lang_pred for r in langid.identify(frame, {}).collect()} == {"und"}
    assert langid.identify(frame.limit(0), SAMPLE).count() == 0


def test_all_letters_and_symbols_are_learned():
    rng = random.Random(4)
    word = lambda first, n: "".join(chr(rng.randint(first, first + n)) for _ in range(rng.randint(2, 6)))
    words = {f"l{i:02}": [word(0x4E00, 1500) for _ in range(500)] for i in range(6)}  # six languages of the same 1500 letters
    sample = {k: [" ".join(rng.choice(v) for _ in range(400)) for _ in range(12)] for k, v in words.items()}
    parser = langid.CrossParser(sample)
    known = {c for v in sample.values() for t in v for c in t if c.isalpha()}
    assert len(known) > 1000 and len({int(parser.symbol[ord(c)]) for c in known}) == len(known)
    whole = [langid._joined(parser.symbol[langid._code_points(v[-1][: langid.LANE])]) for _, v in sorted(sample.items())]
    assert [int(n) for n in parser.phrases(whole).diagonal()] == [1] * 6  # the last text is learned whole
    texts = [" ".join(rng.choice(v) for _ in range(6)) for v in words.values() for _ in range(5)]
    assert parser.predict(texts)[0] == [k for k in words for _ in range(5)]


def test_long_texts_are_learned_where_others_are_few(spark):
    rows = [("aa", "banana " * 2000), ("bb", "street " * 2000), ("bb", "strength")] + [("cc", f"word {i}") for i in range(70)] + [("cc", "word " * 2000)]
    got = langid.sample(spark.createDataFrame(rows, "lang string, text string"), F.lit(True))
    assert got["aa"] == [("banana " * 2000)[:8000]] and got["bb"] == ["strength", ("street " * 2000)[:8000]]
    assert len(got["cc"]) == 60 and max(map(len, got["cc"])) < 10


def test_copies_do_not_displace_other_texts(spark):
    few = [("aa", f"banana bandana {c}") for c in "bcdfg"] + [("bb", f"street strength {c}") for c in "bcdfg"]
    rows = few + [("aa", "cabana")] * 1000 + [("bb", "stretch")] * 1000 + [("cc", "ßüß")] * 1000
    got = langid.sample(spark.createDataFrame(rows, "lang string, text string"), F.lit(True))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted({t for x, t in rows if x == k}) for k in ("aa", "bb", "cc")}


@pytest.mark.parametrize("limit", ["hash_limit", "none below it"])
def test_sample_is_the_first_by_hash(spark, monkeypatch, limit):
    if limit != "hash_limit":  # hashes so uneven that nothing is below the limit
        monkeypatch.setattr(langid, "hash_limit", lambda n, of: -(2**63))
    frame = spark.createDataFrame([("aa", f"word {i % 900}") for i in range(2000)], "lang string, text string")
    want = [r.text for r in frame.distinct().orderBy(F.xxhash64("text"), "text").limit(60).collect()]
    assert langid.sample(frame, F.lit(True)) == {"aa": want}


def test_scripts_and_many_languages(spark):
    """Scripts with thousands of letters, and more languages than share the sample at its full size."""
    rng = random.Random(6)
    pools = {"zh": [chr(0x4E00 + k) for k in range(0, 3000, 2)], "ja": [chr(0x4E01 + k) for k in range(0, 3000, 2)] + [chr(0x3042 + k) for k in range(60)], "ko": [chr(0xAC00 + 5 * k) for k in range(2000)]}
    pools = {k: ["".join(rng.choice(v) for _ in range(3)) for _ in range(600)] for k, v in pools.items()}  # words of rare letters
    pools |= {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(30)] for k in range(70)}
    make = lambda k: ("" if k in ("zh", "ja", "ko") else " ").join(rng.choice(pools[k]) for _ in range(120))
    rows = [(k, make(k)) for k in pools for _ in range(12)]
    model = langid.sample(spark.createDataFrame(rows, "lang string, text string"), F.lit(True), total=73 * 4_000)
    assert sorted(model) == sorted(pools)
    assert all(sum(map(len, t[:-1])) < 4_000 for t in model.values())
    test = [(k, make(k)) for k in pools for _ in range(2)]
    got = langid.identify(spark.createDataFrame(test, "want string, text string"), model).collect()
    assert np.mean([r.want == r.lang_pred for r in got]) > 0.98


def test_held_out_languages(spark):
    got = QUERIES["op9_language_id"](spark, SF)
    met = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert met.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("a")).first().a > 0.95


# URLs


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_duckdb(spark, name):
    duck = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    value = lambda x: None if x is None or x is pd.NA or x != x else int(x) if isinstance(x, float) and x == int(x) else x
    plain = lambda df: sorted(str([value(x) for x in r]) for r in df[columns].astype(object).values.tolist())
    assert columns == sorted(want.columns) and plain(got) == plain(want)


def test_odd_urls(spark):
    cases = [
        (1, None, "", "", None), (2, "", "", "", None), (3, "no scheme/com/en/", "", "", None), (4, "http://WWW.Example.COM/en/77?x#y", "www.example.com", "/en/77", "example.com/en/7"), (5, "x://a.com/en/?q=://b.net/de/", "a.com", "/en/", "com/en/"),
        (6, "http://com/en/", "com", "/en/", "com/en/"), (7, "http://notcom/en/", "notcom", "/en/", None), (8, "http://example.net/de/81", "example.net", "/de/81", "example.net/de/8"), (9, "http://example.net/de/7", "example.net", "/de/7", "net/de/"), (10, "http://h#/org/es/", "h", "", None), (11, "http://é.org/es/\nx", "é.org", "/es/\nx", "org/es/"), (11, "http://é.org/es/\nx", "é.org", "/es/\nx", "org/es/"), (12, "http://" + "a" * 30_000 + ".net/de/", "a" * 30_000 + ".net", "/de/", "net/de/"),
    ]
    frame = spark.createDataFrame([c[:2] for c in cases], "page_id long, url string").selectExpr("*", "'x' as Host", "1 as n", "'z' as u")
    got = urls.judge(frame, URL_RULES)
    assert got.columns == ["page_id", "url", "n", "u", "host", "path", "rule", "verdict", "score"]
    rows = sorted(got.collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.url, r.host, r.path, r.rule) for r in rows] == cases
    says = {rule: v for v, rule in URL_RULES}
    assert all(r.verdict == says[r.rule] if r.rule else r.verdict in ("allow", "block") for r in rows)
    assert {r.verdict for r in urls.judge(frame.where("page_id in (1, 5)"), URL_RULES).collect()} == {"allow", "block"}  # only one kind to learn from
    assert urls.judge(frame.limit(0), URL_RULES).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1040)]
    label = {n: n for e in edges for n in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = near.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == {n: x for n, x in label.items() if any(n in e and e[0] != e[1] for e in edges)}
