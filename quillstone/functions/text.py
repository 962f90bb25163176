"""Text expressions: normal forms, hashes, counts, language, hidden characters, headings, units of packing."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bases() -> tuple[str, str]:
    """Letters that canonically decompose into one base character and marks, and those base characters."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _BARE = _bases()
#: Dashes that count as a hyphen, and hidden characters that carry instructions unseen.
DASHES = "–—−―"
HIDDEN = "​‌‍‮⁠﻿"


def collapse(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Lower case without accents, dashes as hyphens, white space collapsed: the form in which quotes are compared.
    Covers Latin, Greek and Cyrillic letters and all nonspacing marks; other scripts keep their composed letters."""
    bare = F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _BARE), r"\p{Mn}+", "")
    return collapse(F.regexp_replace(bare, f"[{DASHES}]", "-"))


@F.pandas_udf(T.StringType())
def normalize_any(text: pd.Series) -> pd.Series:
    """normalize for every script, in Python: the reference for its tests, and for texts beyond its letters."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
        return " ".join("".join("-" if c in DASHES else c for c in bare).split())

    return text.map(one)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def short_hash(text: Column, n: int = 12) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(n))


def cache_key(model: Column, prompt: Column, temperature: Column) -> Column:
    return F.sha2(F.concat_ws("|", model, prompt, temperature).cast("binary"), 256)


def token_count(text: Column) -> Column:
    """Words between white space, 1 at least: the estimate that segments are packed by."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")))


def detect_language(text: Column) -> Column:
    """es if any of a few Spanish characters occurs, else en."""
    return F.when(text.rlike("[áéíóúñ¿¡]"), "es").otherwise("en")


def has_hidden(text: Column) -> Column:
    return text.rlike(f"[{HIDDEN}]")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def strip_hidden(text: Column) -> Column:
    """Without hidden characters."""
    return F.translate(text, HIDDEN, "")


def strip_hidden_nfkc(text: Column) -> Column:
    """Without hidden characters, and in NFKC where there were any. Python sees only texts that had some: others are null to it."""
    return F.coalesce(_nfkc(F.when(has_hidden(text), strip_hidden(text))), text)


def urls_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"""(?i)https?://[^\s"'<>]+"""), F.lit(0))


#: Official domains that links may lead to.
ALLOWED_DOMAINS = ["eur-lex.europa.eu", "boe.es", "digital-strategy.ec.europa.eu", "edpb.europa.eu", "data.europa.eu"]


def url_allowed(url: Column) -> Column:
    """http or https to one of ALLOWED_DOMAINS, www. aside; a port or user makes it another place. Null and malformed: false."""
    authority = F.lower(F.regexp_extract(url, r"^(?i)https?://([^/?#]*)", 1))
    return F.coalesce(F.regexp_replace(authority, r"^www\.", "").isin(ALLOWED_DOMAINS), F.lit(False))


def redact_ip(ip: Column) -> Column:
    """The /24 of an IPv4 address; null for what is none."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return F.when(ip.rlike(rf"^(?:{octet}\.){{3}}{octet}$"), F.concat(F.regexp_extract(ip, r"^(.*)\.[0-9]+$", 1), F.lit(".0/24")))


@F.pandas_udf(T.StringType())
def redact_ip6(ip: pd.Series) -> pd.Series:
    """The /48 of an IPv6 address, the /24 of an IPv4 one; null for what is neither."""
    import ipaddress

    def one(t: str | None) -> str | None:
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return None
        return str(ipaddress.ip_network((a, 24 if a.version == 4 else 48), strict=False))

    return ip.map(one)


def citation_key(article: Column, paragraph: Column) -> Column:
    """article.paragraph, or article where there is no paragraph."""
    return F.when(F.coalesce(paragraph, F.lit("")) == "", article).otherwise(F.concat_ws(".", article, paragraph))


def key_matches(emitted: Column, expected: Column) -> Column:
    """Equal, or expected is a whole article and emitted a paragraph of it."""
    return (emitted == expected) | (~expected.contains(".") & emitted.startswith(F.concat(expected, F.lit("."))))


def strip_fence(text: Column) -> Column:
    """Without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def safe_score(score: Column) -> Column:
    return F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))


def slug(text: Column, longest: int = 40) -> Column:
    bare = F.translate(F.lower(text), _ACCENTED, _BARE)
    return F.rtrim(F.left(F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\x00-\x7F]", ""), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(longest)), F.lit("-"))


def reason_code(reason: Column) -> Column:
    return F.substring_index(reason, ":", 1)


#: Fixed value: a line that looks like a heading: all capitals, Markdown, or numbered.
HEADING = r"^(?:[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ \-]{2,80}|#{1,6}\s+\S.{0,80}|\d+(?:\.\d+)*\.?\s+\S.{2,100})$"
#: Fixed value: what ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def headings(text: Column) -> Column:
    """Titles of heading lines, in order; a line that ends in a full stop is a sentence."""
    lines = F.transform(F.split(text, LINE_END), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    found = F.filter(lines, lambda s: (s != "") & s.rlike(HEADING) & ~s.endswith("."))
    return F.transform(found, lambda s: F.regexp_replace(s, r"^[# ]+", ""))


def located(text: Column, titles: Column) -> Column:
    """array<struct<title, at>> (at from 1): each title where it next occurs after the one before; those that don't are left out."""
    none = F.expr("cast(array() as array<struct<title:string,at:int>>)")

    def find(a: Column, t: Column) -> Column:
        at = F.call_function("locate", t, text, a["from"])
        found = F.struct(t.alias("title"), at.alias("at"))
        return F.when(at > 0, F.struct((at + F.length(t)).alias("from"), F.concat(a["out"], F.array(found)).alias("out"))).otherwise(a)

    return F.aggregate(titles, F.struct(F.lit(1).alias("from"), none.alias("out")), find, lambda a: a["out"])


def packed(units: Column, cap: int) -> Column:
    """array<struct<units, tokens>>: consecutive units together while their tokens don't pass cap; a longer unit alone stays whole."""
    none = F.expr("cast(array() as array<struct<units:array<string>,tokens:int>>)")
    begin = F.struct(none.alias("done"), F.expr("cast(array() as array<string>)").alias("held"), F.lit(0).alias("tokens"))
    flushed = lambda a: F.concat(a["done"], F.array(F.struct(a["held"].alias("units"), a["tokens"].alias("tokens"))))

    def add(a: Column, u: Column) -> Column:
        n = token_count(u)
        full = (F.size(a["held"]) > 0) & (a["tokens"] + n > cap)
        return F.struct(
            F.when(full, flushed(a)).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(u)).otherwise(F.concat(a["held"], F.array(u))).alias("held"),
            F.when(full, n).otherwise(a["tokens"] + n).alias("tokens"),
        )

    return F.aggregate(units, begin, add, lambda a: F.when(F.size(a["held"]) > 0, flushed(a)).otherwise(a["done"]))


#: Characters of texts that a tokenizer gets at once, and one text more: what it makes of them is held until they are counted.
AT_ONCE = 1 << 20


def exact_tokens(load) -> Callable[[Column], Column]:
    """A column function from a loader of tokenizers: load() gives a function from a list of texts to their counts, once a task. It gets some of a batch's texts at a time."""
    most = AT_ONCE

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = load()
        for part in texts:
            part = part.fillna("")
            counts = [n for _, own in part.groupby(part.str.len().cumsum().to_numpy() // most) for n in of(own.tolist())]
            yield pd.Series(counts, index=part.index, dtype="int64")

    return count


def vocabulary(path: str):
    """A loader for exact_tokens: counts by a vocabulary file of the tokenizers library, without special tokens. Every executor must be able to read the path."""

    def load():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda texts: [len(e.ids) for e in own.encode_batch_fast(texts, add_special_tokens=False)]

    return load


def article_matches(article_id: Column, expected: Column) -> Column:
    """Equal, or a part of the expected article."""
    return (article_id == expected) | article_id.startswith(F.concat(expected, F.lit(".")))


def signed(delta: Column) -> Column:
    """A difference with its sign and two places."""
    return F.format_string("%+.2f", delta)
