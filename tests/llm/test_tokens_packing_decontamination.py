import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from quillstone.llm import decontamination, packing, token_store
from quillstone.llm.tokens import Ids

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [(3, "of the thing, of the thing"), (1, None), (2, ""), (4, "wörd " * 5000), (4, "a b"), (None, "no id"), (5, "a b"), (6, " lead  two\n\n x \t y ")]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_cached_ids_are_the_tokenizers(path):
    rng = random.Random(3)
    alphabet = ["a", "b", "É", " ", " ", "\n", "\t", "'s", ".", "..", "\x1c", "\xa0", "12", "-", "!", "  ", "the", "Ω", "́", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    ids = Ids(path, keep=50)
    for i in range(0, len(texts), 100):
        assert ids.encode_all(texts[i : i + 100]) == [ids.encode(t) for t in texts[i : i + 100]]


def test_store_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("block", docs_col())
    path = f"file://{tmp_path}/ids"
    token_store.write(docs, path, WORDS, block_docs=3)
    got = token_store.read(spark, path).orderBy("start").collect()
    ids, at = Ids(WORDS), 0
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    for row, (d, t) in zip(got, order, strict=True):
        want = ids.encode(t or "") + b"\x02\x00\x00\x00"
        assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids)) == (d, at, len(want) // 4, want)
        at += len(want) // 4
    assert sorted(r.doc_id for r in token_store.read_documents(spark, path, [4, 6, 99]).collect()) == [4, 4, 6]


def test_ids_at_the_ends_of_their_range(spark, tmp_path):
    least, most = -(1 << 63), (1 << 63) - 1
    docs = spark.createDataFrame([(None, "a"), (least, "b"), (None, "c"), (most, "d"), (0, "e")], "doc_id long, text string")
    path = f"file://{tmp_path}/ends"
    token_store.write(docs, path, WORDS, block_docs=2)
    assert sorted((str(r.doc_id) for r in token_store.read(spark, path).collect())) == sorted(map(str, [None, None, least, most, 0]))
    assert [r.doc_id for r in token_store.read_documents(spark, path, [0, most]).orderBy("doc_id").collect()] == [0, most]


def docs_col():
    from pyspark.sql import functions as F

    return F.lit("an extra column")


def test_store_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    token_store.write(spark.createDataFrame([], "doc_id long, text string"), path, WORDS)
    assert token_store.read(spark, path).count() == 0


def test_packing_places_everything_once(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("offset", docs_col())
    capacity = 16
    cut = packing.pieces(docs, BYTES, capacity=capacity)
    rows = packing.place(cut, capacity).collect()
    ids, want = Ids(BYTES), []
    for d, t in TEXTS:
        b = ids.encode(t or "") + bytes(4)
        n = len(b) // 4
        bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
        want += [(d if d is not None else -1, k, x, y - x, b[4 * x : 4 * y]) for k, (x, y) in enumerate(zip(bounds, bounds[1:]))]
    got = [(r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, bytes(r.ids)) for r in rows]
    assert sorted(got) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.place(packing.pieces(docs.limit(0), BYTES)).count() == 0


def test_fullest_is_best():
    rng = random.Random(5)
    for _ in range(300):
        left = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 30)
        reach = {0}
        for n, k in left.items():
            reach = {a + n * i for a in reach for i in range(k + 1) if a + n * i <= room}
        got = packing.fullest(left, room)
        assert sum(n * k for n, k in got.items()) == max(reach)
        assert all(k <= left[n] for n, k in got.items())


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.clip(rng.lognormal(5.5, 1, 20000).astype(int) + 1, 1, 2048), return_counts=True)
    used = {}
    bins = 0
    for times, bin_ in packing.plan(dict(zip(lengths.tolist(), counts.tolist())), 2048):
        bins += times
        for n, k in bin_.items():
            used[n] = used.get(n, 0) + k * times
    assert used == dict(zip(lengths.tolist(), counts.tolist()))
    assert bins <= 1.002 * -(-int((lengths * counts).sum()) // 2048) + 1


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(docs, items, window):
    out = []
    for d, t in docs:
        w = WORD.findall(lowered(t or ""))
        hit, found = set(), set()
        for i, text in items:
            q = WORD.findall(lowered(text or ""))
            n = min(window, len(q))
            for k in range(len(q) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == q[k : k + n]:
                        hit |= set(range(j, j + n))
                        if i is not None:
                            found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_chars", [10_000, 40])
def test_hits_as_brute_force(spark, block_chars):
    rng = random.Random(7)
    alphabet = ["a", "b", "C", "é1", "dd"]
    text = lambda n: rng.choice(["", "  "]) + "".join(rng.choice(alphabet) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.randint(1, 9))) for i in range(12)] + [(None, text(5)), (3, "b b"), (50, None), (51, "..")]
    items = [x for x in items if x[1] is None or len(WORD.findall(x[1])) != 1]
    docs = [(i, text(rng.randint(0, 30))) for i in range(60)] + [(100, None), (100, ""), (101, "A" * 50_000 + " " + items[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as n_words", "'y' as Hit_Spans")
    hits = decontamination.find_hits(frame, spark.createDataFrame(items, "item_id long, text string"), window=4, block_chars=block_chars)
    got = decontamination.clean(hits).collect()
    key = lambda x: (x[0], x[1], x[2])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in got], key=key) == sorted(brute(docs, items, 4), key=key)
    for r in got:
        kept, at = "", 0
        for s in r.hit_spans:
            assert WORD.findall(lowered(r.text[s.start : s.end])) == WORD.findall(lowered(r.text))[s.word : s.word_end]
            kept, at = kept + r.text[at : s.start], s.end
        assert r.clean_text == (None if r.text is None else kept + r.text[at:])


def test_items_of_one_word_and_no_items(spark):
    docs = [(1, "a b c a"), (2, "c"), (3, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = [(1, "a"), (2, "c a"), (3, "b c")]
    got = decontamination.clean(decontamination.find_hits(frame, spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in got) == brute(docs, items, 10)
    none = decontamination.clean(decontamination.find_hits(frame, spark.createDataFrame([], "item_id long, text string")))
    assert [r.n_hit for r in none.collect()] == [0, 0, 0]
    assert decontamination.clean(decontamination.find_hits(frame.limit(0), spark.createDataFrame(items, "item_id long, text string"))).count() == 0


def test_crc_of_ids(spark):
    assert spark.sql("select crc32(unhex('0100000002000000')) as c").first().c == zlib.crc32(np.array([1, 2], "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_odd_texts(name):
    """Letters that become a letter and a mark, newlines and other white space between parts: as the tokenizer has them."""
    ids = Ids(public_tokenizers.path(name))
    texts = ["İ. İ.", "x क़. y", "a\nb c\nd.\ne", "\na\n b", "a \nb", "'s\n's it'\n's", "a\t b\t\nc d", "x\x1c y\x85z", "", " ", "a ", " a", "a  b \n", "one\ntwo\nthree!\n!four", "中文\né ß!\n"]
    for some in (texts, [" ".join(texts)], texts[::-1]):
        assert ids.encode_all(some) == [ids.encode(t) for t in some]


def test_words_are_not_searched_for_tails_they_lack(monkeypatch):
    """Only parts that end in a mark meet the pattern for it; ids are the tokenizer's."""
    from quillstone.llm import tokens

    tried, tail = [], tokens._TAIL

    class Tail:
        def fullmatch(self, part):
            tried.append(part)
            return tail.fullmatch(part)

    monkeypatch.setattr(tokens, "_TAIL", Tail())
    texts = ["first wordle, wordle zürich. züri! 12; a1 ?? ...", "", "no end\nof line. x  y", "wordle² ½ straße:   é!"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        ids = tokens.Ids(public_tokenizers.path(name))
        assert ids.encode_all(texts) == [ids.encode(t) for t in texts]
    assert tried and all(p[-1] in ".,;:!?" for p in tried)
