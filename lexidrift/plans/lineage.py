"""Cutting lineage in iterative plans with reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexidrift.session import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and stored in the shared checkpoint folder, so lost executors don't lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
