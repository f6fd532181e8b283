"""Pattern counts over a stream of documents (an extension: the counts are sums, so they stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidrift.functions import text as T


def document_ngrams(stream: DataFrame, text: str = "text") -> DataFrame:
    """`stream` with one row for each n-gram of a document and its number `n` there.

    Grouping happens within the row, so a document that arrives whole counts once and no state is kept.
    """
    grams = F.flatten(F.transform(F.flatten(T.document_sentences(F.col(text))), lambda s: T.ngrams(s)))
    rest = [c for c in stream.columns if c != text]
    return stream.select(*rest, F.explode(T.tallied(grams)).alias("p")).select(*rest, "p.pattern", "p.n")


def windowed_counts(stream: DataFrame, time: str = "doc_ts", length: str = "1 day", late: str = "2 days") -> DataFrame:
    """`(window_start, pattern, occurrences, documents_with)`, closed when the watermark passes the window."""
    rows = document_ngrams(stream.withWatermark(time, late))
    return rows.groupBy(F.window(time, length), "pattern").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents_with")).select(F.col("window.start").alias("window_start"), "pattern", "occurrences", "documents_with")
