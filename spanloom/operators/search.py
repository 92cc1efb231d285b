"""Full-text search over labelled texts by an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.stems import porter, stem

#: A word is a run of letters and digits; index, query and snippet all cut texts by it.
_WORD = r"[\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), 1)


def inverted_index(texts: DataFrame, text_id: str, text: str, stemmed: bool = True) -> DataFrame:
    """J-18: (text_id, term, n, first_pos): occurrences and first 1-based position per term (Porter's stem, or the word)."""
    flat = texts.select(F.col(text_id).alias("text_id"), F.posexplode(_words(F.col(text))).alias("pos", "w"))
    # words are counted before they are stemmed: few distinct ones pass through Python
    counted = flat.groupBy("text_id", "w").agg(F.count("*").alias("n"), (F.min("pos") + 1).alias("first_pos"))
    if not stemmed:
        return counted.withColumnRenamed("w", "term")
    return counted.withColumn("term", stem(F.col("w"))).groupBy("text_id", "term").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))


def search_all(index: DataFrame, terms: list[str]) -> DataFrame:
    """Texts holding every term, with their occurrences and first position."""
    hits = index.where(F.col("term").isin(terms))
    return hits.groupBy("text_id").agg(F.count("*").alias("n_terms"), F.sum("n").alias("n_hits"), F.min("first_pos").alias("first_pos")).where(F.col("n_terms") == len(set(terms))).drop("n_terms")


def search_words(index: DataFrame, words: list[str]) -> DataFrame:
    """``search_all`` of a stemmed index for words as a reader types them."""
    return search_all(index, [porter(w.lower()) for w in words])


def snippets(found: DataFrame, texts: DataFrame, text_id: str, text: str, width: int = 20) -> DataFrame:
    """The ``width`` words around the first hit of each found text, as they stand in it.

    A word takes what follows it up to the next word along, so positions are
    those of the index whatever stands between words.
    """
    met = found.join(texts.select(F.col(text_id).alias("text_id"), F.col(text).alias("t")), "text_id").withColumn("w", F.regexp_extract_all(F.col("t"), F.lit(rf"({_WORD}[^\p{{L}}\p{{N}}]*)"), 1))
    return met.select("text_id", "n_hits", F.trim(F.regexp_replace(F.array_join(F.slice("w", F.greatest(F.lit(1), F.col("first_pos") - 2), width), ""), r"\s+", " ")).alias("snippet"))


def labels_of(resolutions: DataFrame, labels: DataFrame, most: int = 50) -> DataFrame:
    """J-16/J-17/U-07: labels by set id, never by code: own ids first, each once, at most ``most``.

    ``resolutions`` has mention_id, own_ids, product_ids (arrays).  The first
    ``most`` are the feature: a resolution cites a handful of labels.
    """
    ids = F.slice(F.array_distinct(F.concat(F.coalesce("own_ids", F.array().cast("array<string>")), F.coalesce("product_ids", F.array().cast("array<string>")))), 1, most)
    return resolutions.select("mention_id", F.posexplode(ids).alias("pos", "spl_set_id")).join(labels, "spl_set_id")
