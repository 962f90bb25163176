import hashlib
import hmac
import random
import re

import regex
from pyspark.sql import functions as F

from quillstone.llm import pii

DOCS = [
    (1, "Write to anna.Q7@mail.shop.example.com or ANNA@x.org; card 4111 1111 1111 1111, not 4111 1111 1111 1112."),
    (2, "anna.Q7@mail.shop.example.com from 8.196.197.208, 8.196.197.20 and 1.2.3.4.5, +1 (988) 555-2485 or 988-555-2485."),
    (3, "Mr. John Smith met Mrs Smith and Herr Öztürk; Госпожа Анна Иванова and Κύριος Νίκος."),
    (4, None),
    (5, ""),
    (6, "nothing here, Version 3. 17 4041894974608795"),
    (6, "nothing here, Version 3. 17 4041894974608795"),
    (8, "+1 (906) 555-7738 42.144.35.254 +1 (269) 555-3296 4524132264652876 +49 30 1234 567."),
    (7, "GB82 WEST 1234 5698 7654 32 and GB83WEST12345698765432, 123-45-6789. " + "x " * 50000 + "4041894974608795"),
]


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def result(spark, key="k"):
    frame = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' as N_Entities", "1 as kind")
    out = pii.replace(frame, key)
    assert out.columns == ["doc_id", "text", "kind", "surrogate_text", "n_entities"]
    return sorted(out.collect(), key=lambda r: r.doc_id)


def test_surrogates(spark):
    rows = result(spark)
    one, two, three, null, empty, six, again, seven, eight = [r.surrogate_text for r in rows]
    assert (null, empty) == (None, "")
    assert [r.n_entities for r in rows] == [3, 5, 5, 0, 0, 1, 1, 3, 5]
    mail = re.search(r"Write to (\S+) or (\S+);", one)
    assert re.fullmatch(r"[a-z]{4}\.[A-Z][0-9]@[a-z]{6}[0-9]{2}\.example\.org", mail[1]) and re.fullmatch(r"[A-Z]{4}@\S+\.example\.org", mail[2])
    assert mail[1] != mail[2] and two.startswith(mail[1])
    card = re.search(r"card ((?:9\d{3})(?: \d{4}){3}), not 4111 1111 1111 1112", one)[1]
    assert luhn(card.replace(" ", ""))
    ips = re.search(r"from (2[45]\d\.\d+\.\d+\.\d+), (2[45]\d\.\d+\.\d+\.\d+) and 1\.2\.3\.4\.5, (\+1 \(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})\.", two)
    assert ips[1] != ips[2]
    names = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) and Herr (\w+); Госпожа ([А-Яа-я]+) ([А-Яа-я]+) and Κύριος ([Α-Ωα-ως]+)\.", three)
    assert names[2] == names[3] != "Smith" and names[1].endswith("n") and names[5].endswith("на")
    assert six == again and re.fullmatch(r"nothing here, Version 3\. 17 9\d{15}", six)
    assert seven.endswith(six[-16:]) and " and GB83WEST12345698765432, 9" in seven
    iban = re.match(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", seven)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} 2[45]\d\.\d+\.\d+\.\d+ \+1 \(\d{3}\) \d{3}-\d{4} 9\d{15} \+49 \d\d \d{4} \d{3}\.", eight)
    assert not any(x in eight for x in ("906", "42.144", "4524132264652876", "1234 567"))
    assert "x " * 50000 in seven
    assert result(spark)[0].surrogate_text == one
    assert result(spark, "other key")[0].surrogate_text != one


def test_collisions_are_settled(spark, monkeypatch):
    # a format with few surrogates: two digits after a fixed country code, and originals among them
    monkeypatch.setattr(pii, "surrogate", lambda kind, value, attempt, key: F.lpad(F.pmod(F.xxhash64(F.lit(key), value, attempt), F.lit(60)).cast("string"), 2, "0"))
    own = [("phone", f"{i:02}") for i in range(25)]
    got = pii.assign(spark.createDataFrame(own, "kind string, value string"), "k").collect()
    assert len(got) == 25 == len({r.surrogate for r in got})
    assert not {r.surrogate for r in got} & {v for _, v in own}


def test_short_formats_do_not_run_out(spark):
    letters, few = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    odd = ["-@x.org", "...@x.org", "_@x.org"]
    mails = odd + [f"{c}@x.org" for c in letters + few]
    phones = [f"+123-{i:02}" for i in range(100)]
    frame = spark.createDataFrame([(i, f"To {x} now") for i, x in enumerate(mails + phones)], "doc_id long, text string")
    got = [r.surrogate_text[3:-4] for r in sorted(pii.replace(frame, "k").collect(), key=lambda r: r.doc_id)]
    assert len(set(got)) == len(got) and not set(got) & set(mails + phones)
    local, domain = zip(*(x.split("@") for x in got[: len(mails)]))
    assert len(set(domain)) == 1 and not set(local) & {x.split("@")[0] for x in mails}
    assert all(re.fullmatch(re.escape(x.split("@")[0]) + r"([a-z]\d)+", s) for x, s in zip(odd, local))
    assert all(re.fullmatch(r"[a-z]([a-z]\d)+", s) for s in local[3:29]) and all(re.fullmatch(r"\d([a-z]\d)+", s) for s in local[29:])
    assert all(re.fullmatch(r"\+123-\d\d(-\d{4})+", s) for s in got[len(mails) :])


def test_longer_draws_keep_their_type(spark):
    own = [("card", "4111 1111 1111 1111"), ("ssn", "123-45-6789"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ip", "8.8.8.8"), ("domain", "x.org")]
    frame = spark.createDataFrame(own, "kind string, value string")
    for n in range(3):
        rows = frame.select("kind", pii.surrogate(F.col("kind"), F.col("value"), F.lit(pii.EXACT + n), "k").alias("s")).collect()
        got = {r.kind: r.s for r in rows}
        assert re.fullmatch(rf"9\d{{3}}( \d{{4}}){{3}}\d{{{4 * n + 4}}}", got["card"]) and luhn(got["card"].replace(" ", ""))
        assert re.fullmatch(rf"9\d\d-\d\d-\d{{4}}(-\d{{4}}){{{n + 1}}}", got["ssn"])
        iban = got["iban"].replace(" ", "")
        assert len(iban) == 22 + 4 * n + 4 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
        assert re.fullmatch(r"2001:db8(:[0-9a-f]{1,4}){6}", got["ip"])
        assert re.fullmatch(rf"[a-z]{{6}}\d\d([a-z]\d){{{n + 1}}}\.example\.org", got["domain"])


def test_empty_table(spark):
    assert pii.replace(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def found(text):
    """Entities of a text as (start, end, parts), in plain Python; a part is (kind or None, value)."""
    out = []
    for m in regex.finditer(pii.ENTITY, text or ""):
        v = m[0]
        kind = next((k for k, p in pii.KINDS.items() if regex.fullmatch(p, v) and {"card": lambda: luhn(re.sub("[^0-9]", "", v)), "iban": lambda: mod97(v.replace(" ", "")) == 1}.get(k, lambda: True)()), None)
        if kind == "email":
            local, domain = v.split("@")
            parts = [("local", local), (None, "@"), ("domain", domain)]
        elif kind == "name":
            title, *names = v.split(" ")
            gender = "f" if title.strip(".") in pii.FEMALE else "m" if title.strip(".") in pii.MALE else "n"
            parts = [(None, title + " "), *(part for w in names[:-1] for part in ((f"given-{gender}", w), (None, " "))), ("surname", names[-1])]
        elif kind is None and (card := regex.search(rf"(?<![A-Za-z0-9])(?:{pii.KINDS['card']})", v)) and card[0] != v and luhn(re.sub("[^0-9]", "", card[0])):
            parts = [(None, v[: card.start()]), ("card", card[0]), (None, v[card.end() :])]
        else:
            parts = [(kind, v)]
        out.append((m.start(), m.end(), parts))
    return out


def mod97(v):
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97


def expected(text, named):
    at, out, n, spans = 0, [], 0, found(text)
    names = {}
    for _, _, parts in spans:
        for k, v in sorted((p for p in parts if p[0] and (p[0] == "surname" or p[0].startswith("given"))), key=lambda p: named[p]):
            names[v] = min(names.get(v, named[k, v]), named[k, v])

    def around(gap):
        nonlocal n
        words = regex.findall(r"[\p{L}\p{M}0-9_]+|[^\p{L}\p{M}0-9_]+", gap)
        n += sum(w in names for w in words)
        return "".join(names.get(w, w) for w in words)

    for a, b, parts in spans:
        out += [around(text[at:a]), *(named[p] if p[0] else p[1] for p in parts)]
        n += any(k for k, _ in parts)
        at = b
    return "".join([*out, around((text or "")[at:])]) if text is not None else None, n


def test_as_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    pieces = ["a.b@x.org", "Q7@mail.shop.example.com", "@", "4111 1111 1111 1111", "4111111111111112", "AT61 1904 3002 3457 3201", "BE68539007547034", "XX12 ABCD 1234", "123-45-6789", "8.8.8.8", "1.2.3.4.5", "+1 (906) 555-7738", "1-800-555-1234", "988.555.2485", "Mr John Smith", "Mrs Smith", "Dr. Ann Smith", "Smith", "John", "Smithson", "Herr Öztürk", "Öztürk", "Госпожа Анна Иванова", "Иванова", "EUR", "\n", ",", ". ", " ", " ", " ", "é"]
    docs = list(enumerate(["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, ""]))
    named = {}
    own = pii.assign

    def assign(parts, key):
        out = own(parts, key)
        named.update({(r.kind, r.value): r.surrogate for r in out.collect()})
        return out

    monkeypatch.setattr(pii, "assign", assign)
    got = {r.doc_id: (r.surrogate_text, r.n_entities) for r in pii.replace(spark.createDataFrame(docs, "doc_id long, text string"), "k").collect()}
    assert len(set(named.values())) == len(named) and not set(named.values()) & {v for _, v in named}
    assert {p for _, t in docs for *_, parts in found(t) for p in parts if p[0]} == set(named)
    for d, t in docs:
        assert got[d] == expected(t, named), t


def test_lengths_of_ibans_and_long_texts(spark):
    docs = [(0, "pay AT61 1904 3002 3457 3201 EUR now"), (1, "BE68 5390 0754 7034 BIC"), (2, "x@" + "a." * 100_000 + "com "), (3, "a." * 100_000 + "@x.org y"), (4, "@" * 100_000 + "1" * 100_000), (5, "Mr John Smith left. Smith came back.")]
    got = {r.doc_id: (r.surrogate_text, r.n_entities) for r in pii.replace(spark.createDataFrame(docs, "doc_id long, text string"), "k").collect()}
    assert re.fullmatch(r"pay AT\d\d( \d{4}){4} EUR now", got[0][0]) and "1904" not in got[0][0]
    assert re.fullmatch(r"BE\d\d( \d{4}){3} BIC", got[1][0]) and "5390" not in got[1][0]
    assert got[2][1] == got[3][1] == 1 and got[2][0].endswith(".example.org ") and got[3][0].endswith(".example.org y")
    assert got[4] == (docs[4][1], 0)
    name = re.fullmatch(r"Mr (\w+) (\w+) left\. (\w+) came back\.", got[5][0])
    assert name[2] == name[3] != "Smith" and got[5][1] == 2


def test_keys_are_hmacs(spark):
    for key in ("k", "long " * 30):
        assert spark.range(1).select(pii.keyed(key, F.lit("hé"))).first()[0] == hmac.new(key.encode(), "hé".encode(), hashlib.sha256).hexdigest()
