"""Problem 5: a sample that is the same on every run and only grows as data grows.

The stable key is hashed with a fixed salt to the unit interval; a record is in the
sample when its value lies below the rate. Nothing depends on order, partitioning or
the number of rows, so rows that arrive later never push out one already chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexidrift.llm.keys import canonical_id

SALT = "sample-1"
#: 13 hexadecimal digits are 52 bits: every value is exact in a double.
HEX_DIGITS = 13


def unit_interval(key: Column, salt: str = SALT) -> Column:
    """A number in [0, 1) that depends on `salt` and `key` only; null for a null key."""
    digest = F.md5(F.concat(F.lit(salt + "|"), key))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long") / F.lit(float(16**HEX_DIGITS))


def stable_sample(records: DataFrame, rate: float, by: str = "id", salt: str = SALT) -> DataFrame:
    """`(id, source_id, sample_key, u, loaded_at)` of the sampled ids, each once.

    `by="id"` draws records one by one, `by="source_id"` whole sources however their
    identifier is written; a record without a usable source is then drawn by its id.
    Of an id delivered again the first delivery stands, so later rows change nothing;
    among deliveries at the same time the smallest source value stands. Rows with a
    null id are never drawn. A rate of 0 gives no row, a rate of 1 every id.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie in [0, 1]")
    if by not in ("id", "source_id"):
        raise ValueError("by must be 'id' or 'source_id'")
    own = canonical_id(F.col("id"))
    key = F.coalesce(own, F.col("id")) if by == "id" else F.coalesce(canonical_id(F.col("source_id")), own, F.col("id"))
    drawn = records.where("id is not null").select("id", "source_id", "loaded_at", key.alias("sample_key")).withColumn("u", unit_interval(F.col("sample_key"), salt)).where(F.col("u") < F.lit(float(rate)))
    first = F.struct(F.col("loaded_at").isNull().alias("late"), "loaded_at", F.col("source_id").isNull().alias("none"), "source_id", "sample_key", "u")
    return drawn.groupBy("id").agg(F.min(first).alias("r")).select("id", "r.source_id", "r.sample_key", "r.u", "r.loaded_at")
