"""Surrogates for personal data, in SQL expressions only.

Entities are found by one pattern with an alternative for each kind, leftmost first: e-mail addresses, IBANs, payment
cards (by their check digit), social security numbers, IPv4 addresses, telephone numbers, and names after a title.
Each falls into parts: an address into its local part and its domain, a name into its words. A distinct part gets one
surrogate throughout the corpus, so that what was one person or one host stays one; the words of a text's names get theirs
wherever they stand alone in it, before or after. A surrogate is drawn with HMAC-SHA-256 of the part and an attempt, and keeps the part's type: letters stay letters and digits digits of the same
case and number, check digits fit, a name keeps its gender (by its title; none for those that don't tell) and its script. Then collisions are looked
for: of parts with the same surrogate all but the first, and parts whose surrogate occurs in the corpus as an original,
try again with the next attempt until none is left. Formats with few surrogates run out, as those of one-letter local
parts do: after `EXACT` attempts a draw is longer than its part by `PADS` once more with each attempt, so that every
part finds one. A local part without a letter or digit is longer from the first attempt on, as nothing else in
it can change; an IPv4 address moves from 240.0.0.0/4 to the IPv6 addresses for documentation, 2001:db8::/32.

Edge cases: null and empty texts stay as they are, as do texts without entities; digits that fail their check are no
cards or IBANs (a card inside of what looked like an IBAN is one); an IBAN has its country's length, so that what follows it isn't taken in (only those of countries
without a known length are tried at their longest); repeated texts get equal results; very long texts are searched in full,
and no pattern recurses on them. Input columns stay; a result
column replaces one of its name.

What isn't found: names without one of the titles below (two words after it, with initials, hyphens and apostrophes, are taken), names
with a hyphen or an apostrophe where they stand alone, addresses of houses, dates of birth, numbers of other kinds. Initials become whole names.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stored, without

# Titles that give a gender and some that don't, by language, and syllables of names, by script.
MALE = ["Mr", "Herr", "Señor", "Don", "Monsieur", "Signor", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Doña", "Madame", "Mme", "Signora", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof"]
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va"],
    "cyrillic": ["ба", "бе", "бо", "ва", "ве", "во", "га", "го", "да", "де", "до", "за", "зо", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "се", "со", "та"],
    "greek": ["βα", "βε", "βο", "γα", "γε", "γο", "δα", "δε", "δο", "ζα", "ζε", "ζο", "κα", "κε", "κο", "λα", "λε", "λο", "μα", "με", "μο", "να", "νε", "νο", "ρα", "ρε", "ρο", "σα", "σε", "σο", "τα", "τε"],
}
ENDINGS = {"latin": ("n", "a"), "cyrillic": ("н", "на"), "greek": ("ς", "α")}

#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(length: int, countries: str) -> str:
    rest = (length - 4) % 4
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(length - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


_TITLES = "|".join(sorted([*MALE, *FEMALE, *NEUTRAL], key=len, reverse=True))
#: A name's word: letters with hyphens and apostrophes, initials before it.
_NAME = r"(?:\p{Lu}\. ?){0,3}(?=\p{Lu}['’\p{L}])\p{Lu}[\p{L}\p{M}]*+(?:['’]\p{Lu}[\p{L}\p{M}]*+|-[\p{L}\p{M}]++){0,4}"
#: In order of precedence at one place.
KINDS = {
    "email": r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "iban": r"(?=[A-Z]{2}[0-9]{2})(?:(?:" + "|".join(_iban(*x) for x in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[.-][0-9]{2,4}){1,4}|\+[0-9]{1,3}(?: [0-9]{2,4}){2,5}(?![0-9.@-])|(?:1[ .-])?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?:1[ .-])?[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.)[0-9]{4})(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? {_NAME}(?: {_NAME})?",
}
#: Letters of scripts that put no space between words may stand before an entity.
ENTITY = r"(?<![\p{IsLatin}\p{IsCyrillic}\p{IsGreek}0-9._%+-])(?:" + "|".join(KINDS.values()) + ")"
#: Words and what lies between them.
WORDS = r"[\p{L}\p{M}0-9_]+|[^\p{L}\p{M}0-9_]+"
#: A text without any of these has no entity.
HINT = rf"@|[0-9]|{_TITLES}"

#: Attempts that keep the length; what a draw is longer by after them, an attempt. Names grow by a syllable anyway.
EXACT = 6
PADS = {"local": "a0", "domain": "x0", "card": "0000", "ssn": "-0000", "iban": "0000", "phone": "-0000"}

_PART = "struct<kind:string,value:string>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The sum whose last digit is 0 where a number of digits passes its check."""

    def total(number: Column) -> Column:
        n = F.length(number)

        def at(i: Column) -> Column:
            return let(F.substring(number, n - i + 1, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))

        return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)")), F.lit(0), lambda a, i: a + at(i))

    return let(number, total)


def mod97(iban: Column) -> Column:
    """What ISO 7064 asks to be 1, of an IBAN without spaces."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).when(c == "", a).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def kind_of(value: Column) -> Column:
    """The kind of an entity; null where a check fails or other kinds of number only look alike."""
    checks = {"iban": lambda v: mod97(F.regexp_replace(v, " ", "")) == 1, "card": lambda v: luhn(digits(v)) % 10 == 0}
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        is_kind = value.rlike(f"^(?:{pattern})$")
        if kind in checks:
            is_kind = F.when(is_kind, checks[kind](value)).otherwise(F.lit(False))
        out = F.when(is_kind, F.lit(kind)).otherwise(out)
    return out


def parts_of(value: Column) -> Column:
    """An entity as an array of parts; those with a null kind stay as they are."""
    part = lambda kind, v: F.struct((F.lit(kind) if isinstance(kind, str) or kind is None else kind).cast("string").alias("kind"), v.cast("string").alias("value"))
    title = F.regexp_extract(value, rf"^(?:{_TITLES})\.? ", 0)
    said = F.regexp_replace(title, "[. ]", "")
    gender = F.when(said.isin(FEMALE), "f").when(said.isin(MALE), "m").otherwise("n")
    names = F.split(F.substring(value, F.length(title) + 1, F.length(value)), " ")
    given = F.flatten(F.transform(F.slice(names, F.lit(1), F.size(names) - 1), lambda w: F.array(part(F.concat(F.lit("given-"), gender), w), part(None, F.lit(" ")))))
    kind = kind_of(value)
    # what looked like an IBAN and fails its check may hold a card that doesn't
    inner = F.regexp_extract(value, rf"(?<![A-Za-z0-9])(?:{KINDS['card']})", 0)
    before = F.instr(value, inner) - 1
    return (
        F.when(kind == "email", F.array(part("local", F.substring_index(value, "@", 1)), part(None, F.lit("@")), part("domain", F.substring_index(value, "@", -1))))
        .when(kind == "name", F.concat(F.array(part(None, title)), given, F.array(part("surname", F.element_at(names, -1)))))
        .when(kind.isNull() & (inner != "") & (F.length(inner) < F.length(value)) & (luhn(digits(inner)) % 10 == 0), F.array(part(None, F.substring(value, F.lit(1), before)), part("card", inner), part(None, F.substring(value, before + F.length(inner) + 1, F.length(value)))))
        .otherwise(F.array(part(kind, value)))
    )


def _drawn(seed: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _alike(value: Column, seed: Column) -> Column:
    """The same string with other letters and digits in place of its own."""

    def one(c, i):
        letter = lambda base: F.char(F.lit(base) + _drawn(seed, i, 26))
        of = lambda letters: F.substring(F.lit(letters), _drawn(seed, i, len(letters)) + 1, F.lit(1))
        other = F.when(c.rlike(r"\p{IsCyrillic}"), of("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"\p{IsGreek}"), of("αβγδεζηθικλμνξοπρστυφχψω")).otherwise(letter(97))
        other = F.when(c.rlike(r"\p{Lu}"), F.upper(other)).otherwise(other)
        return F.when(c.rlike("[0-9]"), _drawn(seed, i, 10).cast("string")).when(c.rlike("[a-z]"), letter(97)).when(c.rlike("[A-Z]"), letter(65)).when(c.rlike(r"\p{L}"), other).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _refilled(value: Column, number: Column, own: str) -> Column:
    """value with its characters of the pattern own, one after the other, from number."""

    def filled(number: Column) -> Column:
        begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
        taken = lambda a, c: F.struct(F.concat(a["out"], F.substring(number, a["n"] + 1, F.lit(1))).alias("out"), (a["n"] + 1).alias("n"))
        add = lambda a, c: F.when(c.rlike(own), taken(a, c)).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n")))
        return F.aggregate(F.split(value, ""), begin, add, lambda a: a["out"])

    return let(number, filled)


def _name(value: Column, seed: Column, gender: str, attempt: Column) -> Column:
    def in_script(script):
        table = F.array(*map(F.lit, SYLLABLES[script]))
        syllables = F.transform(F.sequence(F.lit(1), F.lit(3) + attempt), lambda i: F.element_at(table, _drawn(seed, i, len(SYLLABLES[script])) + 1))
        ending = F.lit({"m": ENDINGS[script][0], "f": ENDINGS[script][1]}.get(gender, ""))
        return F.initcap(F.concat(F.array_join(syllables, ""), ending))
    return F.when(value.rlike(r"\p{IsCyrillic}"), in_script("cyrillic")).when(value.rlike(r"\p{IsGreek}"), in_script("greek")).otherwise(in_script("latin"))


def keyed(key: str, message: Column) -> Column:
    """HMAC-SHA-256 in hex."""
    own = key.encode()
    own = (hashlib.sha256(own).digest() if len(own) > 64 else own).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in own)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """A draw for a part. IPv4 addresses come from the reserved 240.0.0.0/4, card numbers begin with 9, social security numbers too, as no issued ones do, and domains end in .example.org. From attempt EXACT on it is longer than the part."""
    return let(keyed(key, F.concat_ws("\x1f", kind, value, attempt.cast("string"))), lambda seed: _drawn_as(kind, value, attempt, seed))


def _longer(pad: str, attempt: Column) -> Column:
    return F.repeat(F.lit(pad), F.greatest(attempt - (EXACT - 1), F.lit(0)))


def _drawn_as(kind: Column, value: Column, attempt: Column, seed: Column) -> Column:
    octet = lambda i, n: _drawn(seed, F.lit(i), n).cast("string")
    pad = {k: _longer(v, attempt) for k, v in PADS.items()}
    local = F.concat(value, F.when(value.rlike(r"[\p{L}0-9]"), pad["local"]).otherwise(F.repeat(F.lit(PADS["local"]), attempt + 1)))
    ip = F.concat_ws(".", (_drawn(seed, F.lit(0), 15) + 240).cast("string"), octet(1, 256), octet(2, 256), octet(3, 256))
    documentation = F.concat_ws(":", F.lit("2001:db8"), *(F.lower(F.hex(_drawn(seed, F.lit(i), 1 << 16))) for i in range(6)))
    checked = lambda n: F.concat(n, F.pmod(F.lit(10) - luhn(F.concat(n, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    card = let(_alike(digits(F.concat(value, pad["card"])), seed), lambda n: let(F.concat(F.lit("9"), F.substring(n, F.lit(2), F.length(n) - 2)), checked))
    bare = F.concat(F.regexp_replace(value, " ", ""), pad["iban"])
    country_code = F.substring(bare, 1, 2)
    check = lambda body: F.lpad((F.lit(98) - mod97(F.concat(country_code, F.lit("00"), body))).cast("string"), 2, "0")
    iban = let(_alike(F.substring(bare, F.lit(5), F.length(bare)), seed), lambda body: F.concat(country_code, check(body), body))
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = _alike(F.concat(F.substring(value, F.length(country) + 1, F.length(value)), pad["phone"]), seed)
    return (
        F.when(kind == "local", _alike(local, seed))
        .when(kind == "domain", F.concat(_alike(F.concat(F.lit("xxxxxx00"), pad["domain"]), seed), F.lit(".example.org")))
        .when(kind == "ip", F.when(attempt < EXACT, ip).otherwise(documentation))
        .when(kind == "card", _refilled(F.concat(value, pad["card"]), card, "[0-9]"))
        .when(kind == "ssn", F.concat(F.lit("9"), let(_alike(F.concat(value, pad["ssn"]), seed), lambda v: F.substring(v, F.lit(2), F.length(v)))))
        .when(kind == "iban", _refilled(F.concat(value, pad["iban"]), iban, "[^ ]"))
        .when(kind == "phone", F.concat(country, rest))
        .when(kind == "given-m", _name(value, seed, "m", attempt))
        .when(kind == "given-f", _name(value, seed, "f", attempt))
        .otherwise(_name(value, seed, "", attempt))
    )


_drawn_keys: dict[str, str] = {}


def configured_key(spark: SparkSession) -> str:
    """The setting spark.quillstone.pii.key. A local master, as in tests, does without; elsewhere surrogates that anyone can compute would hide nothing: a secret is drawn, which query and
    pipeline share as long as the application runs. Only with the setting do the same parts get the same surrogates in the next application."""
    own = spark.conf.get("spark.quillstone.pii.key", None)
    if own is None and not spark.sparkContext.master.startswith("local"):
        own = _drawn_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return own or "pipeline-key"


def assign(parts: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """kind, value and surrogate of distinct parts (kind, value): surrogates are distinct, and none is an original. Draws get longer, so that `rounds` only ends a draw that doesn't."""
    original = parts.select(F.col("value").alias("s")).distinct()
    settled, waiting, attempt = None, parts, 0
    while True:
        drawn = stored(waiting.withColumn("s", surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key)), "drawn")
        taken = original if settled is None else original.unionByName(settled.select("s"))
        first = drawn.groupBy("s").agg(F.min(F.struct("kind", "value")).alias("first"))
        good = drawn.join(first, "s").where((F.col("kind") == F.col("first.kind")) & (F.col("value") == F.col("first.value"))).drop("first").join(taken, "s", "left_anti")
        good = stored(good.select("kind", "value", "s"), "surrogates")
        settled = good if settled is None else settled.unionByName(good)
        waiting = stored(drawn.select("kind", "value").join(good.select("kind", "value"), ["kind", "value"], "left_anti"), "waiting")
        if waiting.isEmpty():
            return settled.withColumnRenamed("s", "surrogate")
        attempt += 1
        if attempt == rounds:
            raise RuntimeError("surrogates collide although they get longer")


def replace(docs: DataFrame, key: str = "surrogates", text: str = "text") -> DataFrame:
    """docs with surrogate_text and n_entities, the number replaced. What is found is stored with the texts, which are searched once."""
    kept = without(docs, ["surrogate_text", "n_entities"])
    of = F.col(f"`{text}`")
    found = stored(kept.withColumn("__q_found", F.when(of.rlike(HINT), F.regexp_extract_all(of, F.lit(ENTITY), F.lit(0)))), "searched")
    some, none = F.size("__q_found") > 0, F.coalesce(F.size("__q_found") <= 0, F.lit(True))
    with_id = found.where(some).withColumns({"__q_a": F.xxhash64(of), "__q_b": F.xxhash64(F.lit(1), of)})
    each = with_id.select("__q_a", "__q_b", "__q_found").distinct().select("__q_a", "__q_b", F.posexplode("__q_found").alias("n", "entity"))
    parts = each.select("__q_a", "__q_b", "n", F.posexplode(parts_of(F.col("entity"))).alias("m", "part")).select("__q_a", "__q_b", "n", "m", "part.kind", "part.value")
    parts = stored(parts, "parts")
    named = assign(parts.where("kind is not null").select("kind", "value").distinct(), key)
    with_names = parts.where("kind is not null").join(named, ["kind", "value"])
    written = with_names.unionByName(parts.where("kind is null").withColumn("surrogate", F.col("value")))
    of_name = F.coalesce(F.col("kind").startswith("given") | (F.col("kind") == "surname"), F.lit(False))
    whole = written.groupBy("__q_a", "__q_b").agg(
        F.array_sort(F.collect_list(F.struct("n", "m", "surrogate", F.col("kind").isNotNull().alias("new")))).alias("__q_parts"),
        F.array_sort(F.collect_set(F.when(of_name, F.struct("value", "surrogate")))).alias("__q_names"),
    )
    # stored, so that both sides of the join are dealt out for it and Spark can split a text that a third of all rows have
    done = with_id.join(stored(whole, "assembled"), ["__q_a", "__q_b"])
    replaced, n = _assembled(of)
    done = done.select(*[F.col(f"`{c}`") for c in kept.columns], replaced.alias("surrogate_text"), n.cast("long").alias("n_entities"))
    return done.unionByName(found.where(none).select(*[F.col(f"`{c}`") for c in kept.columns], of.alias("surrogate_text"), F.lit(0).cast("long").alias("n_entities")))


def _assembled(of: Column) -> tuple[Column, Column]:
    """The text with __q_parts between what lies around its entities, where words of __q_names get their surrogates too; and how much is new."""
    first_of = F.filter("__q_names", lambda x, i: F.coalesce(x["value"] != F.get("__q_names", i - 1)["value"], F.lit(True)))
    names = F.map_from_entries(first_of)
    words = F.transform(F.split(of, ENTITY), lambda g: F.regexp_extract_all(g, F.lit(WORDS), F.lit(0)))

    def around(gaps: Column, names: Column) -> Column:
        said = F.transform(gaps, lambda g: F.array_join(F.transform(g, lambda w: F.coalesce(F.try_element_at(names, w), w)), ""))
        count = F.aggregate(gaps, F.lit(0), lambda a, g: a + F.size(F.filter(g, lambda w: F.map_contains_key(names, w))))
        return F.struct(said.alias("gaps"), count.alias("n"))

    plain = F.struct(F.split(of, ENTITY).alias("gaps"), F.lit(0).alias("n"))
    gaps = F.when(F.size("__q_names") > 0, let(words, lambda g: let(names, lambda m: around(g, m)))).otherwise(plain)
    pieces = lambda g: F.transform("__q_parts", lambda p: F.concat(F.when(p["m"] == 0, F.element_at(g, p["n"] + 1)).otherwise(F.lit("")), p["surrogate"]))
    n = F.size(F.array_distinct(F.transform(F.filter("__q_parts", lambda p: p["new"]), lambda p: p["n"])))
    whole = let(gaps, lambda x: F.struct(F.concat(F.array_join(pieces(x["gaps"]), ""), F.element_at(x["gaps"], -1)).alias("text"), (n + x["n"]).alias("n")))
    return whole["text"], whole["n"]
