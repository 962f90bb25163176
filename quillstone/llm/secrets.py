"""Secret scans in SQL expressions only: fixed patterns, and windows of high entropy over candidate strings.

Base spans are the leftmost matches of three patterns, one after the other for each kind; matches that are too
short are dropped afterwards. Entropy spans are candidates: runs of at least 20 of the characters that keys are
written in, with a letter and a digit. A window slides over a candidate; counts of its characters are kept, of
which a step changes those of the two characters that enter and leave, and with them the sum of n * log2(n), so that a step
costs the same however long window and candidate are. A candidate counts as a secret of its class (hexadecimal, or base64 and the like) if some window reaches the class's
entropy in bits a character and no allow-list pattern takes it for something known: UUIDs, numbers and dates, URLs'
hosts and paths, repeated characters.

A span is where a match begins and ends, in code points. Positions come from what lies between matches: splitting a text
by a pattern gives the gaps between the matches that extracting gives.

Edge cases: a null text is an empty one; a text without a span has empty lists and the hash of an empty string;
repeated rows get equal results; candidates of any length are scanned in full, and no pattern recurses on long ones. Input columns stay; a result column
replaces one of its name.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, without

#: Kinds of base spans, their patterns, the group that has the secret, and its least length.
BASE = [
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: What a text must hold for a pattern to match at all, cheaper to look for.
HINTS = {"assign": r"""[dDtTnNyY]["']?\x20*[:=]""", "access": r"AKIA", "hex": r"[0-9a-f]{32}"}

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9/_.=+-]*$",
    r"^[A-Za-z/_.=+-]*$",
    r"^(.)\1*$",
    r"^/?(?:[a-z]++[/_.-])++[a-z]*+[0-9]{0,4}/?$",
]
CLASSES = {"hex_entropy": (r"^[0-9a-fA-F]+$", 3.0), "text_entropy": (r"^", 3.6)}
WINDOW = 20

_BLOCK = 64
_SPANS = "array<struct<start:int,kind:string,end:int,value:string>>"
NONE = f"cast(array() as {_SPANS})"


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, value>> of the matches whose group has at least so many characters."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    return let(found, lambda f: F.when(F.size(f) > 0, _placed(f, gaps, kind, (lambda m: F.length(F.regexp_extract(m, pattern, group))) if group else F.length, least)).otherwise(F.expr(NONE)))


def _placed(found: Column, gaps: Column, kind: str, size, least: int) -> Column:
    """Matches with their places: an end is the sum of what comes before, which sums of `_BLOCK` lengths make short."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))

    def sums(lengths: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))))
        return let(blocks, lambda each: F.transform(each, lambda _, b: total(F.slice(each, F.lit(1), b))))

    def ends(lengths: Column) -> Column:
        own = lambda i: total(F.slice(lengths, i - i % _BLOCK + 1, i % _BLOCK + 1))
        return let(sums(lengths), lambda before: F.transform(found, lambda m, i: F.struct((F.element_at(before, F.floor(i / _BLOCK).cast("int") + 1) + own(i)).alias("end"), m.alias("value"))))

    some = F.filter(let(lengths, ends), lambda s: size(s["value"]) >= least)
    return F.transform(some, lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def highest_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of the windows of a string of ASCII characters; 0 for one shorter than a window.

    The counts of a window's characters are a string with a place for each of the 128 characters, where a count n is
    the character after n others from A on: a step reads and writes the places of the two characters that it changes.
    """
    cost = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    begin = F.struct(F.repeat(F.lit("A"), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    count = lambda counts, code: F.ascii(F.substring(counts, code + 1, F.lit(1))) - 65
    put = lambda counts, code, n: F.overlay(counts, F.char(n + 65), code + 1, F.lit(1))
    codes = F.filter(F.transform(F.split(value, ""), lambda c: F.ascii(c)), lambda c: c > 0)

    def out(a: Column, old: Column) -> Column:
        return let(count(a["counts"], old), lambda n: F.struct(put(a["counts"], old, n - 1).alias("counts"), (a["sum"] - F.element_at(cost, n + 1) + F.element_at(cost, n)).alias("sum")))

    def into(a: Column, new: Column) -> Column:
        return let(count(a["counts"], new), lambda n: F.struct(put(a["counts"], new, n + 1).alias("counts"), (a["sum"] - F.element_at(cost, n + 1) + F.element_at(cost, n + 2)).alias("sum")))

    def step(a: Column, p: Column) -> Column:
        left = F.when(p["old"].isNotNull(), out(a, p["old"])).otherwise(F.struct(a["counts"].alias("counts"), a["sum"].alias("sum")))
        # a window of w characters has an entropy of log2(w) - sum(n log2 n) / w
        best = lambda s: F.when(p["whole"], F.greatest(a["best"], math.log2(window) - s["sum"] / window)).otherwise(a["best"])
        return let(left, lambda s: let(into(s, p["new"]), lambda t: F.struct(t["counts"].alias("counts"), t["sum"].alias("sum"), best(t).alias("best"))))

    def whole(codes: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(None).cast("int"), window), codes)
        steps = F.transform(F.arrays_zip(codes.alias("new"), F.slice(before, F.lit(1), F.size(codes)).alias("old")), lambda p, i: F.struct(p["new"].alias("new"), p["old"].alias("old"), (i >= window - 1).alias("whole")))
        return F.aggregate(steps, begin, step, lambda a: a["best"])

    return F.when(F.length(value) >= window, let(codes, whole)).otherwise(F.lit(0.0))


def entropy_spans(text: Column, allow: list[str]) -> Column:
    """array<struct<start, kind, end>> of candidates that some window's entropy gives away."""
    at = spans(text, "candidate", CANDIDATE, 0, WINDOW)

    def judged(s: Column) -> Column:
        value = s["value"]
        known = reduce(Column.__or__, [value.rlike(p) for p in allow], F.lit(False))
        kind = F.lit(None).cast("string")
        for name, (pattern, _) in reversed(CLASSES.items()):
            kind = F.when(value.rlike(pattern), F.lit(name)).otherwise(kind)
        return F.struct(s["start"].alias("start"), F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~known, kind).alias("kind"), s["end"].alias("end"), value.alias("value"))

    bits = F.create_map(*[F.lit(x) for name, (_, least) in CLASSES.items() for x in (name, least)])
    some = F.filter(F.transform(at, judged), lambda s: s["kind"].isNotNull())
    return bare(F.filter(some, lambda s: highest_entropy(s["value"]) >= F.element_at(bits, s["kind"])))


def bare(found: Column) -> Column:
    """Spans without their values."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def ordered(found: Column) -> Column:
    """Spans by start, then by kind as listed, those of entropy last."""
    kinds = [kind for kind, *_ in BASE] + sorted(CLASSES)
    place = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).cast("int")
    return F.array_sort(found, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(place(x) - place(y)))


def scan(docs: DataFrame, text: str = "text", allow: tuple[str, ...] = ()) -> DataFrame:
    """docs with base_spans and entropy_spans: arrays of (start, kind, end), by start. allow: more patterns of harmless candidates."""
    kept = without(docs, ["base_spans", "entropy_spans"])
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.expr(NONE)
    base = [F.when(whole.rlike(HINTS[kind]), spans(whole, kind, pattern, group, least)).otherwise(none) for kind, pattern, group, least in BASE]
    more = F.when(whole.rlike(CANDIDATE), entropy_spans(whole, [*ALLOW, *allow])).otherwise(bare(none))
    return kept.select("*", ordered(bare(F.concat(*base))).alias("base_spans"), more.alias("entropy_spans"))


def written(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
