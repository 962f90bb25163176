"""Articles (articulo, title, text, paragraphs array<struct<apartado, text>>) from XML, HTML and the text of PDF files.

XML is read with xpath and regular expressions in SQL, text of PDF files with array functions; HTML has no parser in SQL and
goes through mapInPandas with the standard library's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import LINE_END, collapse

#: Root elements of acts; formats in order of preference.
ROOTS = ["CONS.ACT", "ACT"]
PREFERENCE = ["xml", "html", "pdf"]


def preferred(files: DataFrame) -> DataFrame:
    """Of files (corpus, language, path, content) the one of the best format for each corpus and language, with format."""
    rank = F.array_position(F.array(*map(F.lit, PREFERENCE)), F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))).cast("int")
    best = files.withColumn("__r", rank).where("__r > 0").withColumn("__p", F.min_by("path", F.struct("__r", "path")).over(_of("corpus", "language"))).where("path = __p")
    return best.withColumn("format", F.element_at(F.array(*map(F.lit, PREFERENCE)), F.col("__r"))).drop("__r", "__p")


def _of(*by: str):
    from pyspark.sql import Window

    return Window.partitionBy(*by)


def _inside(node: Column) -> Column:
    """The text of an element's markup, without tags, entities resolved, white space collapsed."""
    bare = F.regexp_replace(node, "<[^>]*>", "")
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(c))
    return collapse(bare)


def from_xml(files: DataFrame, content: str = "content") -> DataFrame:
    """The columns of files but content, articulo, title, text, paragraphs and fault (why an article is refused, else null).

    The root is CONS.ACT or ACT. A paragraph needs a number and text; an article's text is its paragraphs', or else all TXT of its PARAG.
    """
    xml = F.col(content).cast("string")
    root = F.regexp_extract(F.regexp_replace(xml, r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*", ""), r"^<([A-Za-z0-9_.:-]+)", 1)
    tag = lambda name: rf"(?s)<{re.escape(name)}(?:\s[^>]*)?>(.*?)</{re.escape(name)}>"
    first = lambda x, name: F.when(x.rlike(tag(name)), _inside(F.regexp_extract(x, tag(name), 1)))
    keep = [c for c in files.columns if c != content]
    cut = files.select(*keep, root.alias("__root"), F.explode_outer(F.regexp_extract_all(xml, F.lit(tag("ARTICLE")), F.lit(1))).alias("a"))
    parags = F.regexp_extract_all("a", F.lit(tag("PARAG")), F.lit(1))
    pairs = F.transform(parags, lambda p: F.struct(F.coalesce(first(p, "NO.P"), F.lit("")).alias("apartado"), F.coalesce(first(p, "TXT"), F.lit("")).alias("text")))
    paragraphs = F.filter(pairs, lambda p: (p["apartado"] != "") & (p["text"] != ""))
    every = F.filter(F.transform(F.flatten(F.transform(parags, lambda p: F.regexp_extract_all(p, F.lit(tag("TXT")), F.lit(1)))), _inside), lambda t: t != "")
    out = cut.select(*keep, "__root", "a", first(F.col("a"), "NO.ARTICLE").alias("articulo"), F.nullif(first(F.col("a"), "TI.ART"), F.lit("")).alias("title"), paragraphs.alias("paragraphs"), every.alias("__every"))
    body = F.when(F.size("paragraphs") > 0, F.array_join(F.transform("paragraphs", lambda p: p["text"]), " ")).otherwise(F.array_join("__every", " "))
    out = out.withColumn("text", F.coalesce(body, F.lit("")))
    fault = (
        F.when(~F.col("__root").isin(ROOTS), "unexpected_root").when(F.col("a").isNull(), "no_articles")
        .when(F.col("articulo").isNull(), "no_number").when(F.col("articulo") == "", "empty_number").when(F.col("text") == "", "empty_text")
    )
    return out.select(*keep, "articulo", "title", "text", "paragraphs", fault.alias("fault"))


class _Articles(HTMLParser):
    """Text of div#art_N blocks: of subtitles, of body paragraphs, of everything."""

    def __init__(self):
        super().__init__()
        self.done: list[tuple[str, str | None, str]] = []
        self.open: list[dict] = []
        self.tags: list[tuple[str, bool]] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "meta", "link", "input"):
            return
        own = dict(attrs)
        begins = tag == "div" and re.fullmatch(r"art_\d+", own.get("id") or "")
        if begins:
            self.open.append({"id": own["id"][4:], "title": None, "body": [], "all": [], "depth": len(self.tags)})
        kinds = (own.get("class") or "").split() if tag == "p" else []
        for x in self.open:
            if "p" not in x and kinds:
                if {"sti-art", "oj-sti-art"} & set(kinds) and x["title"] is None:
                    x["title"], x["p"] = [], ("title", len(self.tags))
                elif {"normal", "oj-normal"} & set(kinds):
                    x["body"].append("")
                    x["p"] = ("body", len(self.tags))
        self.tags.append((tag, bool(begins)))

    def handle_endtag(self, tag):
        while any(t == tag for t, _ in self.tags):
            last, began = self.tags.pop()
            for x in self.open:
                if x.get("p", ("", -1))[1] == len(self.tags):
                    del x["p"]
            if began:
                self._finish(self.open.pop())
            if last == tag:
                break

    def handle_data(self, data):
        for x in self.open:
            x["all"].append(data)
            if "p" in x:
                if x["p"][0] == "title":
                    x["title"].append(data)
                else:
                    x["body"][-1] += data

    def _finish(self, x):
        clean = lambda t: " ".join(t.split())
        title = clean("".join(x["title"])) if x["title"] is not None else None
        title = re.sub(r"^(?:Art[íi]culo|Article|Artigo)\s+(?=\D)", "", title) if title else None
        self.done.append((x["id"], title or None, clean(" ".join(x["body"])) or clean("".join(x["all"]))))

    def close(self):
        super().close()
        while self.open:
            self._finish(self.open.pop())


def from_html(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, articulo, title, text and paragraphs (one, numbered 1, if there is text) of div#art_N blocks; a file without any has no rows."""
    schema = f"{key} {files.schema[key].dataType.simpleString()}, articulo string, title string, text string, paragraphs array<struct<apartado:string,text:string>>"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, html in zip(batch[key], batch[content], strict=True):
                parser = _Articles()
                parser.feed(html or "")
                parser.close()
                rows += [(k, a, title, text, [{"apartado": "1", "text": text}] if text else []) for a, title, text in parser.done]
            yield pd.DataFrame(rows, columns=[key, "articulo", "title", "text", "paragraphs"])

    return files.select(key, F.col(content).cast("string").alias(content)).mapInPandas(parse, schema)


_HEADER = r"(?m)^\s*(?:Article|Art[íi]culo)\s+(\d+)\s*$"
_MARK = r"(?m)^\s*(\d+)\.\s+"


def _slices(text: Column, pattern: str) -> Column:
    """array<struct<number, body>>: what follows each match of a pattern up to the next; number is its first group."""
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    bodies = F.slice(F.split(text, pattern), F.lit(2), F.size(numbers))
    return F.arrays_zip(numbers.alias("number"), bodies.alias("body"))


def from_pdf_text(files: DataFrame, content: str = "content") -> DataFrame:
    """The columns of files but content, articulo, title, text, paragraphs: of text with lines Article N. The first header of a number
    begins its article, later ones are text; the first line is the title unless it is all there is. Text before the first
    numbered paragraph belongs to none; without numbers all is paragraph 1."""
    keep = [c for c in files.columns if c != content]
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    begin = F.expr("cast(array() as array<struct<number:string,body:string>>)")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        again = F.exists(done, lambda d: d["number"] == s["number"])
        longer = F.struct(last["number"].alias("number"), F.concat(last["body"], F.lit("\nArticle "), s["number"], F.lit("\n"), s["body"]).alias("body"))
        return F.when(again, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    cut = files.select(*keep, F.explode(F.aggregate(_slices(F.col(content), _HEADER), begin, add)).alias("s"))
    lines = F.filter(F.transform(F.split("s.body", LINE_END), bare), lambda x: x != "")
    out = cut.select(*keep, F.col("s.number").alias("articulo"), lines.alias("l"))
    out = out.select(*keep, "articulo", F.when(F.size("l") > 1, F.element_at("l", 1)).alias("title"), F.when(F.size("l") > 1, F.array_join(F.slice("l", F.lit(2), F.size("l")), "\n")).otherwise(F.coalesce(F.try_element_at("l", F.lit(1)), F.lit(""))).alias("text"))
    marks = F.filter(F.transform(_slices(F.col("text"), _MARK), lambda s: F.struct(s["number"].alias("apartado"), bare(s["body"]).alias("text"))), lambda p: p["text"] != "")
    sole = F.when(F.col("text") != "", F.array(F.struct(F.lit("1").alias("apartado"), F.col("text").alias("text")))).otherwise(F.expr("cast(array() as array<struct<apartado:string,text:string>>)"))
    return out.select("*", F.when(F.col("text").rlike(_MARK), marks).otherwise(sole).alias("paragraphs"))


def outline(text: Column) -> Column:
    """array<struct<level, title>> of Markdown headings: lines that begin with #, and lines underlined with = (level 1) or - (level 2), in order."""
    lines = F.split(text, LINE_END)
    bare = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    hashed = lambda s: F.struct(F.length(F.regexp_extract(s, "^ *(#+)", 1)).alias("level"), F.trim(F.regexp_replace(s, r"^ *#+\s+|\s+#+\s*$", "")).alias("title"))
    under = lambda s, i: F.coalesce(F.get(lines, i + 1), F.lit(""))
    is_hashed = lambda s: s.rlike(r"^ {0,3}#{1,6}\s+\S")
    is_under = lambda s, i: (bare(s) != "") & ~s.rlike(r"^ {4}|^ {0,3}(?:#{1,6}\s|[-=]+\s*$|>|[*+-]\s)") & under(s, i).rlike(r"^ {0,3}(?:=+|-+)\s*$")

    def heading(s: Column, i: Column) -> Column:
        of_two = F.struct(F.when(under(s, i).rlike("="), 1).otherwise(2).alias("level"), bare(s).alias("title"))
        return F.when(is_hashed(s), hashed(s)).when(is_under(s, i), of_two)

    return F.filter(F.transform(lines, heading), lambda h: h.isNotNull())


def processed_json(spark, path: str) -> DataFrame:
    """Articles of JSON arrays."""
    return spark.read.json(path, multiLine=True, schema="articulo string, title string, text string, paragraphs array<struct<apartado:string,text:string>>")


def id_list(spark, path: str) -> DataFrame:
    """id of the lines of a text file; comments and blank lines are left out, a byte order mark too."""
    line = F.trim(F.regexp_replace("value", "^﻿", ""))
    return spark.read.text(path).select(line.alias("id")).where("id <> '' and not startswith(id, '#')")
