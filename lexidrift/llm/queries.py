"""The pN_ queries over the test tables and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexidrift.llm import encoding, leakage, mixing, overlap, pairs, repetition, sampling, sentences, splits, sql, truncation
from lexidrift.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _raid(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return table(spark, root, "raid_train").select(*columns)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["p1_found"] = lambda s, d: splits.related_sources(_raid(s, d, "id", "source_id"))
    q["p1_families"] = lambda s, d: splits.source_families(_raid(s, d, "id", "source_id"))
    q["p1_split_records"] = lambda s, d: splits.split_records(_raid(s, d, "id", "source_id"))
    q["p1_split_shares"] = lambda s, d: splits.split_shares(_raid(s, d, "id", "source_id", "model", "domain"))
    q["p2_found"] = lambda s, d: repetition.repetitive_ids(_raid(s, d, "id", "generation"))
    q["p2_scores"] = lambda s, d: repetition.repetition_by_record(_raid(s, d, "id", "generation"))
    q["p2_by_penalty"] = lambda s, d: repetition.repetition_by_penalty(_raid(s, d, "id", "generation", "repetition_penalty"))
    q["p3_found"] = lambda s, d: sentences.probe_sentences(_raid(s, d, "id", "generation"), table(s, d, "segmentation_probe"))
    q["p3_sentences"] = lambda s, d: sentences.sentences(_raid(s, d, "id", "generation"))
    q["p3_by_domain"] = lambda s, d: sentences.sentence_report(_raid(s, d, "id", "domain", "generation"))
    q["p4_found"] = lambda s, d: overlap.overlapping_records(_raid(s, d, "id", "split_name", "source_id", "generation"))
    q["p4_classes"] = lambda s, d: overlap.overlap_classes(_raid(s, d, "id", "split_name", "source_id", "generation"))
    q["p4_report"] = lambda s, d: overlap.overlap_report(_raid(s, d, "id", "split_name", "source_id", "generation"))
    q["p5_sample_by_id"] = lambda s, d: sampling.stable_sample(_raid(s, d, "id", "source_id", "loaded_at"), 0.1).drop("loaded_at")
    q["p5_sample_by_source"] = lambda s, d: sampling.stable_sample(_raid(s, d, "id", "source_id", "loaded_at"), 0.1, by="source_id").drop("loaded_at")
    q["p6_found"] = lambda s, d: truncation.truncated(_raid(s, d, "id", "prompt", "generation")).select("id")
    q["p6_by_model"] = lambda s, d: truncation.truncation_by_model(_raid(s, d, "id", "model", "prompt", "generation"))
    q["p7_found"] = lambda s, d: pairs.defective_pairs(_raid(s, d, "id", "prompt", "generation"), table(s, d, "hc3_answers"))
    q["p7_by_side"] = lambda s, d: pairs.defects_by_source(_raid(s, d, "id", "prompt", "generation"), table(s, d, "hc3_answers"))
    q["p8_found"] = lambda s, d: leakage.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id")
    q["p8_by_item"] = lambda s, d: leakage.leak_report(table(s, d, "documents"), table(s, d, "eval_items"))
    q["p9_mix"] = lambda s, d: mixing.mixture(table(s, d, "documents").select("doc_id", "source", "text"), table(s, d, "mix_targets"))
    q["p9_shares"] = lambda s, d: mixing.mixture_shares(table(s, d, "documents").select("doc_id", "source", "text"), table(s, d, "mix_targets"))
    q["p10_found"] = lambda s, d: encoding.garbled_documents(table(s, d, "documents")).select("doc_id")
    q["p10_restored"] = lambda s, d: encoding.garbled_documents(table(s, d, "documents"))
    q["p10_learned"] = lambda s, d: encoding.learned_transformations(table(s, d, "documents"))
    return q


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
