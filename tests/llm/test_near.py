import random
import re

from quillstone.llm import near

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def gram_set(t, n=5):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def brute(docs, threshold=0.8):
    sets = [gram_set(t) for _, t in docs]
    links = [[j for j in range(len(docs)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(docs))]
    label = [d for d, _ in docs]
    for _ in docs:
        for i, js in enumerate(links):
            for j in js:
                label[i] = min(label[i], label[j])
    return sorted((d, label[i], len(links[i])) for i, (d, _) in enumerate(docs))


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 90))] for _ in range(25)]
    base.append([rng.choice(vocabulary) for _ in range(60)])
    docs = [(0, ""), (1, "..."), (2, "a b"), (3, "A  b!"), (4, "a b c")]
    for k, words in enumerate(base):
        for _ in range(40 if k == 25 else rng.randint(1, 4)):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(own)))
    rng.shuffle(docs)
    return docs


def test_as_brute_force(spark):
    docs = corpus(random.Random(11))
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as label", "1 as copies")
    want = brute(docs)
    assert sum(n for _, _, n in want) > 500
    assert sorted(map(tuple, near.join(frame).collect())) == want
    assert sorted(map(tuple, near.join(frame, block_docs=7).collect())) == want  # groups over several blocks
    kept = near.keep_one(frame, near.join(frame, digests=True))
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in want})


def test_odd_rows(spark):
    docs = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, None), (3, "A b c d e f " + "x y " * 20000), (4, "x y " * 20000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in near.join(frame).collect()), key=str)
    assert got == sorted([(None, None, 0), (1, 1, 1), (1, 1, 1), (2, 2, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0)], key=str)
    kept = near.keep_one(frame, near.join(frame, digests=True))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, None]
    assert near.join(frame.limit(0)).count() == 0


def test_posterior_bounds_are_loose_enough():
    need = near.least_matches(0.8, 1e-6, 16)
    assert need == sorted(need)
    assert need[0] <= 6 and need[-1] < 0.8 * 128


def test_rows_of_one_id(spark):
    docs = [(1, "b c d e f g", "x"), (1, "a b c d e f", "y"), (2, "q r s t u v", "z")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert sorted(map(tuple, near.keep_one(frame, near.join(frame, digests=True)).collect())) == sorted(docs)


def test_recall_of_near_copies(spark):
    """All pairs of 0.8 or more among edited copies, over many sizes of text."""
    rng = random.Random(21)
    docs = []
    for size in (6, 12, 30, 80, 300, 1500):
        for _ in range(12):
            own = [f"w{rng.randrange(5000)}" for _ in range(size)]
            docs.append((len(docs), " ".join(own)))
            for _ in range(2):
                edited = list(own)
                for _ in range(max(1, size // 60)):
                    edited[rng.randrange(size)] = f"w{rng.randrange(5000)}"
                docs.append((len(docs), " ".join(edited)))
    got = {r.doc_id: r.n_links for r in near.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {d: n for d, _, n in brute(docs)}
    assert sum(want.values()) > 100 and got == want
