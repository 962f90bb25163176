"""A pipeline over documents: language, near duplicates, benchmark passages, personal data, packing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame. run() applies
them to the documents table, each stage's rows written to the cluster's shared folder and read again by the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontamination, langid, near, packing, pii
from quillstone.llm.common import fold, stored


#: Columns that stages read or change; all others pass through them under names that no operator uses.
OWN = ("doc_id", "text", "lang", "n_chars")


def _apart(stage: Callable) -> Callable:
    """The stage with the columns of docs that it doesn't read out of its way, so that none clashes with its own."""

    @wraps(stage)
    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in OWN else f"__q_own_{i}" for i, c in enumerate(docs.columns)}
        return stage(spark, docs.withColumnsRenamed(names), sf_dir).withColumnsRenamed({v: k for k, v in names.items()})

    return run_apart


def _with_text(docs: DataFrame, made: DataFrame, text: str) -> DataFrame:
    """The columns of docs, text being the named column of made; n_chars follows where the text has changed."""
    new, old = F.col(f"`{text}`"), F.col("text")
    columns = {"text": new.alias("text"), "n_chars": F.when(new.eqNullSafe(old), F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType)).alias("n_chars")} if "n_chars" in docs.columns else {"text": new.alias("text")}
    return made.select(*[columns.get(c, F.col(f"`{c}`")) for c in docs.columns])


@_apart
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go. Without labelled text nothing has a language, and letters alone decide."""
    model = langid.sample(docs, fold("doc_id", 4) != 2)
    found = langid.identify(docs, model)
    return found.where(F.col("lang_pred") != "und" if model else F.col("text").rlike(r"\p{L}")).select(*[F.col(f"`{c}`") for c in docs.columns])


@_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similarities of 0.8 or more of word 5-grams, the one with the smallest id stays.

    Null and empty texts, and texts without words, have no copies and stay, as do rows without an id. Rows that share an id are judged by their own words: of those whose
    grams are equal the first in order of its columns stays. Texts of any length count whole; equal texts are copies; no rows give no rows. Ids must be whole numbers."""
    return near.keep_one(docs, near.join(docs, digests=True))


@_apart
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go; so do documents with more than half of their words in such passages.

    Null and empty texts stay as they are; repeated rows are judged alike; texts of any length are searched whole; n_chars follows where a text has changed; without items
    or rows nothing changes."""
    hits = decontamination.find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _with_text(docs, decontamination.clean(hits).where("keep"), "clean_text")


@_apart
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates, under the session's key.

    Null and empty texts and those without entities stay as they are; equal texts get equal surrogates; texts of any length are searched whole; n_chars follows where a
    text has changed; no rows give no rows."""
    return _with_text(docs, pii.replace(docs, pii.configured_key(spark)), "surrogate_text")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence of at most 2048 ids and its place there.

    Null and empty texts are a piece of the end id alone; longer documents are cut, others never; repeated rows are documents of their own; no rows give no rows."""
    cut = packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), keep=200_000)
    placed = packing.place(cut.drop("ids"))
    return placed.select("doc_id", F.col("piece").cast("int"), "start", "length", "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: Suffix automata, MinHash joins and bin plans have no SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
