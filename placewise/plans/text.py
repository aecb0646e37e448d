"""Terms that set low-rated texts apart from high-rated ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.runtime import stored

TOKEN = r"(?U)\b\w\w+\b"
MIN_DOCUMENTS = 8


def english_stop_words() -> list[str]:
    """Spark's own English list (181 words); other libraries' lists are longer."""
    return StopWordsRemover.loadDefaultStopWords("english")


def term_counts(docs: DataFrame, key: str, text: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """(doc, term, tf) of one- and two-word terms: lower case, tokens of two or more word characters,
    stop words removed before pairs are formed. Whole texts are read.

    The texts travel to their document's task; their terms, several times as large, are counted there."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    split = docs.select(key, text).repartition(key).select(key, words.alias("w"))
    n = F.size("w")
    pairs = F.when(
        n > 1,
        F.zip_with(F.slice("w", 1, n - 1), F.slice("w", F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b)),
    ).otherwise(F.array().cast("array<string>"))
    return split.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


def tfidf(docs: DataFrame, key: str, text: str, stop_words: Sequence[str] = (), min_df: int = MIN_DOCUMENTS, max_terms: int | None = None) -> DataFrame:
    """(doc, term, weight) with smooth idf and unit-length rows.

    The vocabulary is every term found in ``min_df`` documents or more, or the ``max_terms`` most counted of
    them; ties go by term. Counts per document and the vocabulary are written as tables: a vocabulary that Spark finds
    small enough to broadcast spares the counts a shuffle.
    """
    tf = stored(term_counts(docs, key, text, stop_words), "terms")
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    vocabulary = (
        tf.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        .filter(F.col("df") >= min_df)
    )
    if max_terms is not None:
        vocabulary = vocabulary.orderBy(F.col("total").desc(), "term").limit(max_terms)
    vocabulary = vocabulary.crossJoin(F.broadcast(n_docs)).select(
        "term", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")
    )
    vocabulary = stored(vocabulary, "vocabulary")
    raw = tf.join(vocabulary, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    # a document's terms come together once, with their norm; there are as many as its text has words and pairs
    rows = raw.groupBy(key).agg(F.collect_list(F.struct("term", "raw")).alias("_terms"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return rows.select(key, "norm", F.explode("_terms").alias("_t")).select(key, "_t.term", (F.col("_t.raw") / F.col("norm")).alias("weight"))


def contrast_terms(reviews: DataFrame, key: str, text: str, rating: str, stop_words: Sequence[str] = (), low: float = 4, high: float = 8, **limits) -> DataFrame:
    """Mean weight per term in low- and high-rated texts and their gap; a term a text lacks counts as zero."""
    rated = reviews.filter(F.col(rating).isNotNull())
    side = F.when(F.col(rating) <= low, "low").when(F.col(rating) >= high, "high")
    sides = rated.select(key, side.alias("side"))
    sizes = sides.agg(F.count_if(F.col("side") == "low").alias("n_low"), F.count_if(F.col("side") == "high").alias("n_high"))
    weights = tfidf(rated, key, text, stop_words, **limits).join(sides, key)
    sums = weights.groupBy("term").agg(
        F.coalesce(F.sum(F.when(F.col("side") == "low", F.col("weight"))), F.lit(0.0)).alias("s_low"),
        F.coalesce(F.sum(F.when(F.col("side") == "high", F.col("weight"))), F.lit(0.0)).alias("s_high"),
    )
    return (
        sums.crossJoin(F.broadcast(sizes))
        .select(
            "term",
            (F.col("s_low") / F.nullif("n_low", F.lit(0))).alias("low_score"),
            (F.col("s_high") / F.nullif("n_high", F.lit(0))).alias("high_score"),
        )
        .withColumn("tfidf_gap", F.col("low_score") - F.col("high_score"))
    )


def top_contrast(terms: DataFrame, n: int = 30) -> DataFrame:
    """The n terms most typical of each side."""
    low = terms.orderBy(F.col("tfidf_gap").desc(), "term").limit(n).withColumn("side", F.lit("low"))
    high = terms.orderBy(F.col("tfidf_gap").asc(), "term").limit(n).withColumn("tfidf_gap", -F.col("tfidf_gap"))
    return low.unionByName(high.withColumn("side", F.lit("high")))
