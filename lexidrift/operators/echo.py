"""Patterns that a document takes over from the prompt and title of its source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidrift.functions import constants as K
from lexidrift.functions import text as T
from lexidrift.functions.metrics import echo_columns

LEXICAL, STRUCTURAL = "lexical", "structural"


def echo_sets(sources: DataFrame) -> DataFrame:
    """`(source_id, level, pattern)`: what title and prompt, read as one text, hold.

    N-grams of function words count too, and cross the seam and sentence ends; skeleton
    spans come from the whole text as one.
    """
    material = sources.select("source_id", T.strip_space(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("prompt", F.lit("")))).alias("m"))
    lexical = material.select("source_id", F.lit(LEXICAL).alias("level"), F.explode(T.ngrams(F.col("m"), every=True)).alias("pattern"))
    skel = material.select("source_id", T.nfkc(F.col("m")).alias("m")).select("source_id", T.skeleton(F.col("m")).alias("k"))
    structural = skel.select("source_id", F.lit(STRUCTURAL).alias("level"), F.explode(T.spans(F.col("k"))).alias("pattern"))
    return lexical.unionByName(structural).distinct()


def mark_echoes(patterns: DataFrame, echoes: DataFrame) -> DataFrame:
    """`patterns(…, source_id, kind, pattern, n)` with `echoing`: all of `n` where the source's echo set holds the pattern, else 0.

    Both skeleton families share one echo set.
    """
    level = F.when(F.col("kind") == K.NGRAM, LEXICAL).otherwise(STRUCTURAL)
    marked = patterns.withColumn("level", level).join(echoes.withColumn("hit", F.lit(True)), ["source_id", "level", "pattern"], "left")
    return marked.withColumn("echoing", F.when(F.col("hit"), F.col("n")).otherwise(F.lit(0).cast("long"))).drop("level", "hit")


def echo_counts(marked: DataFrame, by: Sequence[str]) -> DataFrame:
    """`(by…, total, echoing, primary, echo_fraction, prompt_derived)`."""
    sums = marked.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("echoing").alias("echoing"))
    return sums.withColumns(echo_columns(F.col("total"), F.col("echoing"), K.PROMPT_DERIVED_ABOVE))
