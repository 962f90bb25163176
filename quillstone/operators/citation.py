"""Citation checks, in order, the first failure decides: the article exists, the paragraph exists, the quote
is long enough (code 4), the quote is in the text (code 3). Both sides are compared in normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import normalize

#: Fixed value: the least length of a quote in normal form.
MIN_CHARS = 20


def audit(citations: DataFrame, articles: DataFrame, paragraphs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """citations (norma, articulo, apartado or null, language, text, …) with validated, article_exists,
    apartado_exists (null where no paragraph is cited), text_normalized_match and failed_check (1 to 4 or null).

    articles: norma, articulo, language, text; paragraphs: the same and apartado. A null paragraph is checked against
    the article; an empty one is looked up. Joins are on keys, containment comes after them, and targets are put in normal
    form once per target.
    """
    keys = ["norma", "articulo", "language"]
    of_article = articles.select(*keys, normalize(F.col("text")).alias("__article"), F.lit(True).alias("__a"))
    of_paragraph = paragraphs.select(*keys, F.col("apartado").alias("__apartado"), normalize(F.col("text")).alias("__paragraph"), F.lit(True).alias("__p"))
    met = citations.join(of_article, keys, "left")
    met = met.join(of_paragraph.withColumnsRenamed({k: f"__{k}" for k in keys}), (F.col("apartado") == F.col("__apartado")) & (F.col("norma") == F.col("__norma")) & (F.col("articulo") == F.col("__articulo")) & (F.col("language") == F.col("__language")), "left")
    met = met.withColumn("__quote", normalize(F.col("text")))  # once, for its length and for the match
    quote = F.col("__quote")
    article = F.coalesce("__a", F.lit(False))
    paragraph = F.when(F.col("apartado").isNotNull(), article & F.coalesce("__p", F.lit(False)))
    match = F.coalesce(F.contains(F.when(F.col("apartado").isNull(), F.col("__article")).otherwise(F.col("__paragraph")), quote), F.lit(False))
    failed = F.when(~article, 1).when(~F.coalesce(paragraph, F.lit(True)), 2).when(F.length(quote) < min_chars, 4).when(~match, 3)
    return met.select(*citations.columns, failed.isNull().alias("validated"), article.alias("article_exists"), paragraph.alias("apartado_exists"), failed.isNull().alias("text_normalized_match"), failed.alias("failed_check"))


def fabrications(audited: DataFrame, by: list[str]) -> DataFrame:
    """How many citations name an article or a paragraph that doesn't exist."""
    return audited.groupBy(*by).agg(F.count_if(F.col("failed_check").isin(1, 2)).alias("n_fabrications"))
