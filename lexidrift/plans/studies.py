"""The two studies and the three-corpus comparison over the test tables, end to end."""

from __future__ import annotations

from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidrift.functions import constants as K
from lexidrift.functions.integrity import anchors_sha256
from lexidrift.operators import cells as C
from lexidrift.operators import comparison as M
from lexidrift.operators import echo as E
from lexidrift.operators import patterns as P
from lexidrift.operators import records as R
from lexidrift.operators import resampling as S
from lexidrift.sources import writers

#: The test tables hold few sources with all seven documents; there a human document is enough.
SMALL_DESIGN = ("human",)
#: With invented texts, whose lifts lie near 1, floors are lowered so that candidates appear.
SMALL_RULES = C.SecondStudyRules(min_lift=1.05, min_occurrences=2, min_doc_prevalence=0.05, min_passing_models=1, no_reversal_lift=0.2, min_domains=2)


def three_corpora(raid: DataFrame, hc3: DataFrame) -> DataFrame:
    """`(corpus, doc_id, text)`: discovery models as `ai`, human records as `pre`, human answers as `contemporary`."""
    rows = R.records(raid, ("model", "generation"))
    ai = rows.where(F.col("model").isin(*K.DISCOVERY_MODELS)).select(F.lit("ai").alias("corpus"), F.col("id").alias("doc_id"), F.col("generation").alias("text"))
    pre = rows.where("model = 'human'").select(F.lit("pre").alias("corpus"), F.col("id").alias("doc_id"), F.col("generation").alias("text"))
    contemporary = R.answers(hc3).where("side = 'human'").select(F.lit("contemporary").alias("corpus"), F.concat_ws(":", "q_id", "answer_no").alias("doc_id"), "text")
    return ai.unionByName(pre).unionByName(contemporary)


def small_study(raid: DataFrame, excluded: DataFrame) -> DataFrame:
    """The second study's documents drawn from the test tables."""
    return R.second_study(raid, excluded, per_domain=None, required=SMALL_DESIGN)


class SecondStudy:
    """The stages of the second study over stored intermediate tables."""

    def __init__(self, study: DataFrame, sources: DataFrame, rules: C.SecondStudyRules = C.SecondStudyRules()) -> None:
        self.study, self.rules = C.cut(study), rules
        self.counts = C.document_counts(self.study, sources)
        self.cells = C.cut(C.cell_counts(self.counts))
        self.seen = C.cut(C.cell_exposure(self.study))

    @cached_property
    def _candidates(self) -> DataFrame:
        return C.frozen(C.candidates(self.cells, self.seen, self.rules))

    @cached_property
    def _replication(self) -> DataFrame:
        return C.cut(C.replication(self.cells, self.seen, self._candidates, self.rules))

    def candidates(self) -> DataFrame:
        return self._candidates

    def replication(self) -> DataFrame:
        return self._replication

    def intervals(self, resamples: int = S.RESAMPLES) -> DataFrame:
        replicated = self.replication().where("replicated").select("kind", "pattern")
        sizes = P.exposure(self.study, C.KEYS)
        return S.bootstrap_intervals(self.counts, sizes, replicated, resamples)

    def lift_matrix(self, resamples: int = S.RESAMPLES) -> DataFrame:
        return C.lift_matrix(self.cells, self.seen, self.candidates(), self.intervals(resamples), self.rules)

    def write(self, excluded: DataFrame, folder: str | Path, resamples: int = S.RESAMPLES) -> dict:
        """The frozen candidates, the lift matrix and the summary as files of a folder; returns the summary.

        What reaches the driver are candidates, replicated patterns and matrix rows, all of which the thresholds bound.
        """
        folder = Path(folder)
        digest = writers.frozen_candidates(self.candidates(), folder / "candidates.json")
        matrix = C.cut(self.lift_matrix(resamples))
        rounded = matrix.withColumns({c: F.round(c, 4) for c in ("lift", "doc_prevalence", "bootstrap_ci_lo", "bootstrap_ci_hi")})
        rows = writers.result_csv(rounded.drop("total", "prompt_derived").orderBy("kind", "pattern", "phase", "domain", "model"), folder / "lift_matrix.csv")
        kinds = {r["kind"]: r["candidates"] for r in C.candidate_kinds(self.candidates()).collect()}
        echo = {r["phase"]: r for r in E.echo_counts(self.counts, ["phase"]).collect()}
        replicated = [{"kind": r["kind"], "pattern": r["pattern"]} for r in self.replication().where("replicated").orderBy("kind", "pattern").collect()]
        summary = {
            "anchor_sha256": anchors_sha256(),
            "calibration_sources_excluded": excluded.select(R.tidy_source(F.col("source_id")).alias("s")).where("s is not null").distinct().count(),
            "discovery_candidate_artifact_sha256": digest,
            "discovery_candidates": sum(kinds.values()),
            "candidates_by_kind": kinds,
            "replicated_patterns": len(replicated),
            "replicated": replicated,
            "echo": {f"{phase}_{name}": r[column] if r else 0 for phase, r in ((p, echo.get(p)) for p in ("discovery", "validation")) for name, column in (("total_occurrences", "total"), ("echoing_occurrences", "echoing"), ("echo_fraction", "echo_fraction"))},
            "bootstrap": {"resamples": resamples, "cells": matrix.where("bootstrap_ci_lo is not null").count(), "unit": "source clusters; models fixed, never resampled", "interval": "95% percentile", "p_values": None},
            "lift_matrix_rows": rows,
        }
        writers.summary_json(summary, folder / "summary.json")
        return summary


def write_first_study(raid: DataFrame, hc3: DataFrame, path: str | Path) -> int:
    """The first study from records and answers to its table of results; returns the number of candidates."""
    judged = M.judged(M.nominated(M.study_counts(R.first_study(raid, hc3))))
    return writers.result_csv(M.in_study_order(judged), path)
