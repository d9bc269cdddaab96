"""Term weights of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.session import stored

#: A term: two or more letters, digits or underscores.
TERM = r"[\p{L}\p{N}_]{2,}"


def terms(text: str | Column, pattern: str = TERM) -> Column:
    """Lower-cased terms of a text in their order; NULL has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def term_counts(df: DataFrame, key: str, text: str, pattern: str = TERM) -> DataFrame:
    """``(key, term, n)`` per document; the texts are shuffled by their key, so that their terms need not be."""
    together = df.select(F.col(key), F.col(text).alias("_text")).repartition(key)
    return together.select(key, F.explode(terms("_text", pattern)).alias("term")).groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("n"))


def document_frequencies(df: DataFrame, key: str, text: str, pattern: str = TERM) -> tuple[DataFrame, DataFrame]:
    """``(key, term, n)`` per document and ``(term, df)`` over the whole table."""
    counted = stored(term_counts(df, key, text, pattern), "terms")
    return counted, counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf_terms(df: DataFrame, key: str, text: str, min_df: int = 1, max_share: float = 1.0, pattern: str = TERM) -> DataFrame:
    """Sparse term vectors in long form: ``(key, term, n, df, idf, weight)``.

    ``n`` counts the term in the document, ``df`` the documents with it; ``idf`` is ``ln((1 + documents) / (1 + df)) + 1``.  The
    weights ``n * idf`` of a document have length one.  ``min_df`` and ``max_share`` leave out terms of few documents or of
    more than that share of all.  ``key`` must be unique; documents without a term give no rows, but count as documents.
    """
    documents = df.agg(F.count(F.lit(1)).alias("d"))
    counted, frequencies = document_frequencies(df, key, text, pattern)
    known = frequencies.withColumn("_d", documents.scalar()).where(
        (F.col("df") >= min_df) & (F.col("df") <= F.col("_d") * F.lit(float(max_share))))
    # Written before it is joined on the term, so that Spark can split the terms of very many documents.
    known = stored(known.select("term", "df", (F.log((1 + F.col("_d")) / (1 + F.col("df"))) + 1).alias("idf")), "known")
    raw = F.col("n") * F.col("idf")
    length = F.sqrt(F.sum(raw * raw).over(W.partitionBy(key)))
    return counted.join(known, "term").select(key, "term", "n", "df", "idf", (raw / length).alias("weight"))


def term_statistics(df: DataFrame, key: str, text: str, pattern: str = TERM) -> DataFrame:
    """``(term, df, n)`` of the whole table: documents and occurrences of each term."""
    counted, _ = document_frequencies(df, key, text, pattern)
    return counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n"))


# Words of praise and of complaint, and words that turn the next one round.
POSITIVE = ("amazing", "awesome", "beautiful", "best", "better", "brilliant", "clean", "clear", "easy", "enjoy", "excellent", "fast", "fine",
            "free", "good", "great", "happy", "helpful", "love", "nice", "perfect", "pleasant", "safe", "simple", "strong", "useful", "well",
            "win", "wonderful", "worth")
NEGATIVE = ("angry", "awful", "bad", "boring", "broken", "bug", "cheap", "dirty", "error", "fail", "fake", "hate", "hard", "horrible", "lost",
            "poor", "problem", "sad", "scam", "sick", "slow", "spam", "stupid", "terrible", "ugly", "useless", "weak", "worse", "worst", "wrong")
NEGATIONS = ("no", "not", "never", "without")


def sentiment(df: DataFrame, text: str, positive=POSITIVE, negative=NEGATIVE, negations=NEGATIONS) -> DataFrame:
    """Add ``{text}_positive``, ``{text}_negative`` (counts of words of the lists) and ``{text}_sentiment`` in -1 to 1.

    A word right after a negation counts for the other side.  Texts without a word of the lists, and NULL, have 0.
    """
    words = terms(text)
    listed = lambda names: F.array(*[F.lit(w) for w in names])
    turned = lambda i: (i > 0) & F.array_contains(listed(negations), F.get("_words", i - 1))
    signs = F.transform("_words", lambda w, i: F.when(F.array_contains(listed(positive), w), F.when(turned(i), -1).otherwise(1)).when(
        F.array_contains(listed(negative), w), F.when(turned(i), 1).otherwise(-1)).otherwise(0))
    rows = df.withColumn("_words", words).withColumn("_signs", signs)
    up, down = F.size(F.filter("_signs", lambda s: s > 0)), F.size(F.filter("_signs", lambda s: s < 0))
    score = F.when(up + down > 0, (up - down) / (up + down)).otherwise(0.0)
    return rows.withColumns({f"{text}_positive": up, f"{text}_negative": down, f"{text}_sentiment": score}).drop("_words", "_signs")
