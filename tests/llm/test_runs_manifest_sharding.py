import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import manifest, queries, runs, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# periodic runs


def brute_runs(words, least=12):
    """Every period and every stretch of it."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_as_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        words = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 90))]
        if len(words) > 20:
            s, p = rng.randrange(len(words)), rng.randint(1, 12)
            for i in range(s + p, len(words)):
                words[i] = words[i - p]
        got = runs.find_runs(np.array(words, np.int64), 12, rng.choice([5, 50, runs.PAIRS]))
        assert [tuple(r) for r in got.tolist()] == brute_runs(words)


def test_runs_despite_hashes_that_collide():
    words = np.array([int(c) for c in "0110100110010110" * 4 + "01" * 30], np.int64)
    want = brute_runs(words.tolist())
    for bases in [(1, 48_271), (0, 48_271)]:  # with these the hash forgets the order, or all words but the first
        assert [tuple(r) for r in runs.find_runs(words, bases=bases).tolist()] == want
    with pytest.raises(ArithmeticError):
        runs.find_runs(words, bases=(0,))


def test_runs_of_long_texts_in_bounded_steps():
    words = np.arange(200_000) % 7
    assert runs.find_runs(words).tolist() == [[0, 200_000, 7]]
    assert runs.find_runs(np.arange(200_000)).tolist() == []


TEXTS = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b " * 8), (4, "a b " * 8), (None, "x " * 12), (5, "x " * 11), (6, "a b\x85c " * 12 + "퟿"), (7, " ".join(map(str, range(300))) + " tail" * 40)]


def test_find_in_edge_cases(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("Runs", F.lit("old")).withColumn("n_words_", F.lit(1))
    rows = runs.find(docs).collect()
    assert rows[0].__fields__ == ["doc_id", "text", "n_words_", "n_words", "runs", "collapsed_text"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))]
    twice = (4, 16, [(0, 16, 2)], "a b")
    assert got[:5] == [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), twice, twice]
    assert got[5] == (5, 11, [], " ".join(["x"] * 11))
    assert got[6] == (6, 13, [(0, 12, 1)], "a b\x85c ퟿")  # other white space is part of words
    assert got[7] == (7, 340, [(300, 40, 1)], " ".join(map(str, range(300))) + " tail")
    assert got[8] == (None, 12, [(0, 12, 1)], "x")
    assert runs.find(docs.limit(0)).collect() == []


def test_periodic_runs_query_as_brute_force(spark, tmp_path):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) if i % 7 else None) for i in range(120)]
    spark.createDataFrame([(d, t, None, None, None) for d, t in texts], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got, planted = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}, 0
    for d, t in texts:
        words = (t or "").split()
        n, h = len(words), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        own = brute_runs(words)
        gone = {i for s, n_, q in own for i in range(s + q, s + n_)}
        best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(own), *(best or (None, None, None)))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n_},{q}\n" for s, n_, q in own).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert planted > 3 and len(got) == 120


# Merkle manifest


def tree(leaves):
    """All levels of nodes."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([manifest.digest(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 3 * 3
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
        at //= 3
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100, 243, 244])
def test_traversal_as_whole_trees(n):
    leaves = [manifest.digest([str(i)]) for i in range(n)]
    levels = tree(leaves)
    tall = [*levels, [manifest.digest(levels[-1])]]  # a block of a larger tree is as high as the others
    for of in (levels, tall):
        assert list(manifest.traverse(leaves, len(of) - 1)) == [way(of, i) for i in range(n)]
        assert manifest.Treehash(leaves, len(of) - 1, 0).finish() == of[-1][0]


def test_traversal_holds_few_nodes():
    leaves = [str(i) for i in range(729)]
    hash_ = manifest.Treehash(leaves, 6, 0)
    while hash_.open:
        hash_.update()
        assert sum(map(len, hash_.waiting)) <= 2 * 6


ROWS = [(3, "c\n", "en", "b", 2), (1, "a", None, "b", 1), (1, "a", None, "b", 1), (1, None, "en", "b", None), (None, "", "de", "b", 0), (9, "lone\n\n", "de", "ä", 4), (5, "no source", None, None, 9), (7, "é" * 5000, "fr", "", 5000)]


def brute_manifest(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    of = lambda d, t, lang, s, n: h(*map(field, (d, s, lang, n, t)))
    sources = {}
    for d, t, lang, s, n in rows:
        cut = t.replace("\n", "") if t is not None and (d is None or zlib.crc32(str(d).encode()) % 2 == 0) else t
        sources.setdefault(s, []).append((d is not None, d or 0, of(d, t, lang, s, n), of(d, cut, lang, s, n)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for *_, leaf, _ in sorted(sources[s])]) for s in order}
    top, out = tree([trees[s][-1][0] for s in order]), []
    for k, s in enumerate(order):
        for i, (known, d, leaf, tampered) in enumerate(sorted(sources[s])):
            path, node = way(trees[s], i) + way(top, k), tampered
            for left, right in path:
                node = h(left, node, right)
            out.append((d if known else None, leaf, trees[s][-1][0], top[-1][0], h(*(a + b for a, b in path)), node, node == top[-1][0]))
    return out


def by_text(rows):
    return sorted(map(str, rows))


def test_merkle_manifest_query_as_brute_force(spark, tmp_path):
    rng = random.Random(4)
    more = [(i, rng.choice(["x\ny", "z", ""]), "en", rng.choice(["hot"] * 5 + [f"s{k}" for k in range(15)]), i) for i in range(300)]
    for name, rows in (("few", ROWS), ("more", ROWS + more), ("one", ROWS[:1]), ("none", [])):
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = queries.op12_merkle_manifest(spark, f"{tmp_path}/{name}").collect()
        assert by_text(map(tuple, got)) == by_text(brute_manifest(rows))


@pytest.mark.parametrize("tall", [1, 2, 3])
def test_small_blocks_change_nothing(spark, tall):
    docs = spark.createDataFrame([(i, f"t{i}", "a" if i % 3 else f"s{i}") for i in range(150)], "doc_id long, text string, source string").withColumn("root", F.lit("old"))
    of = lambda height: manifest.build(docs, manifest.leaf(F.col("doc_id"), F.col("text")), keep=("text",), tall=height)
    made = of(tall)
    assert made.columns == ["doc_id", "source", "text", "leaf", "subroot", "path", "root"]
    assert by_text(made.collect()) == by_text(of(7).collect())
    assert made.where(manifest.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


# sharding


def test_differencing():
    assert sharding.difference([], 3) == [] and sharding.difference([5, 1], 1) == [0, 0]
    # 8 and 7 leave 1, 6 and 5 leave 1, then 4: 8 5 and 7 6 4 of 30, as differencing does
    parts = sharding.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum(n for n, p in zip([8, 7, 6, 5, 4], parts) if p == k) for k in (0, 1)) == [14, 16]
    rng = random.Random(5)
    for _ in range(40):
        sizes, shards = [int(rng.paretovariate(1) * 100) for _ in range(rng.randint(1, 400))], rng.randint(2, 9)
        got = sharding.difference(sizes, shards)
        sums = [sum(n for n, p in zip(sizes, got) if p == k) for k in range(shards)]
        assert max(sums) <= max(max(sizes), sum(sizes) / shards) + max(sizes)
        assert sums == naive_differencing(sizes, shards)


def naive_differencing(sizes, shards):
    """The sums of the shards, by lists that are searched anew in every step."""
    left = [(k, sorted([n] + [0] * (shards - 1), reverse=True)) for k, n in enumerate(sizes)]
    age = len(left)
    while len(left) > 1:
        left.sort(key=lambda x: (x[1][-1] - x[1][0], x[0]))
        (_, a), (_, b) = left[:2]
        left = [*left[2:], (age, sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))]
        age += 1
    return left[0][1]


@pytest.mark.parametrize("items", [4096, 40])
def test_shards(spark, items):
    rng = random.Random(6)
    texts = [f"text {k} " + "é" * int(rng.paretovariate(1) * 20) for k in range(500)] + ["", None]
    rows = [(None if i % 400 == 0 else i // 2, rng.choice(texts[:20] if i % 3 == 0 else texts)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("Size", F.lit("old")).withColumn("kept", F.lit(1))
    placed = sharding.assign(docs, 8, items=items)
    assert placed.columns == ["doc_id", "kept", "size", "text_crc32", "group", "shard", "slot"]
    got = placed.collect()
    facts = lambda d, t: (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), hashlib.sha256((t or "").encode()).digest())
    assert by_text((r.doc_id, r.size, r.text_crc32, bytes(r.group)) for r in got) == by_text(facts(*r) for r in rows)
    assert len({(bytes(r.group), r.shard) for r in got}) == len({bytes(r.group) for r in got})
    for s in range(8):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert [r.doc_id or -1 for r in own] == sorted(r.doc_id or -1 for r in own)
    sums = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sums) - min(sums) <= (2 if items == 4096 else sum(sums) * 0.05)
    # all items by brute force
    groups = {}
    for d, t in rows:
        _, n, _, key = facts(d, t)
        groups[key] = groups.get(key, 0) + n
    if items == 4096 and all(n * items > sum(groups.values()) for n in groups.values()):
        assert sorted(sums) == sorted(naive_differencing([groups[k] for k in sorted(groups, key=lambda k: (-groups[k], k))], 8))


def test_shards_of_copies_and_of_nothing(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(30)], "doc_id string, text string")
    got = sharding.assign(docs, 4).collect()
    assert len({r.shard for r in got if r.size == 5}) == 1 and len(got) == 30
    assert sharding.assign(docs.limit(0), 4).collect() == []
