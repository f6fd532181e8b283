"""Rates, prevalences and smoothed lifts over counts and their denominators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexidrift.functions.constants import CROSS, NGRAM, SMOOTHING, WITHIN


def ratio(n: Column, of: Column) -> Column:
    """`n / of` as a double; 0 where `of` is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), of.cast("double")), F.lit(0.0))


def per_10k(n: Column, of: Column) -> Column:
    """`n` for each ten thousand of `of`."""
    return ratio(n, of) * 10_000


def smoothed_rate(n: Column, of: Column, add: float = SMOOTHING) -> Column:
    """`(n + add) / (of + 1)`; a negative denominator is an error."""
    return F.when(of < 0, F.raise_error(F.lit("a denominator must not be negative"))).otherwise((n + F.lit(add)) / (of + F.lit(1.0)))


def smoothed_lift(n: Column, of: Column, n_ref: Column, of_ref: Column, add: float = SMOOTHING) -> Column:
    """Smoothed rate of a corpus over that of its reference."""
    return smoothed_rate(n, of, add) / smoothed_rate(n_ref, of_ref, add)


def denominator(kind: Column, sentences: Column, pairs: Column) -> Column:
    """What patterns of a kind are counted against: sentences, or pairs of neighbouring sentences."""
    return F.when(kind.isin(NGRAM, WITHIN), sentences).when(kind == CROSS, pairs).otherwise(F.raise_error(F.concat(F.lit("no such family: "), kind)).cast("bigint"))


def echo_columns(total: Column, echoing: Column, limit: float) -> dict[str, Column]:
    """Primary count, echo fraction and whether the pattern comes from its prompts."""
    fraction = ratio(echoing, total)
    return {"primary": total - echoing, "echo_fraction": fraction, "prompt_derived": fraction > limit}
