"""The core queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidrift.functions import constants as K
from lexidrift.functions import text as T
from lexidrift.functions.integrity import canonical_text_sha256
from lexidrift.operators import cells as C
from lexidrift.operators import comparison as M
from lexidrift.operators import echo as E
from lexidrift.operators import patterns as P
from lexidrift.operators import records as R
from lexidrift.operators import resampling as S
from lexidrift.plans import studies
from lexidrift.sources.tables import table
from lexidrift.streaming.counts import document_ngrams

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["corpus", "doc_id"]

#: Measured parameters for simulated power.
MEASURED = S.ClusterParams(0.0132, 15.0, 1.476, 0.026, "published estimates of the calibration set")
#: A spread around them for the gate query, as wide as the estimates of a small calibration set.
SPREAD = {"source_dispersion_q1": 1.0, "source_dispersion_q3": 2.0, "model_dispersion_q1": 0.01, "model_dispersion_q3": 0.06, "base_rate_per_unit_q1": 0.010, "base_rate_per_unit_q3": 0.020}


def _three(s: SparkSession, d: str) -> DataFrame:
    return studies.three_corpora(table(s, d, "raid_train"), table(s, d, "hc3_answers"))


def _records(s: SparkSession, d: str, fields: tuple[str, ...] = R.CELL_FIELDS) -> DataFrame:
    return R.records(table(s, d, "raid_train"), fields)


def _first(s: SparkSession, d: str) -> DataFrame:
    return R.first_study(table(s, d, "raid_train"), table(s, d, "hc3_answers"))


def _echo_sources(s: SparkSession, d: str) -> DataFrame:
    return R.sources(table(s, d, "echo_sources"))


def _second(s: SparkSession, d: str) -> studies.SecondStudy:
    study = studies.small_study(table(s, d, "raid_train"), table(s, d, "calibration_sources"))
    return studies.SecondStudy(study, _echo_sources(s, d), studies.SMALL_RULES)


def _token_counts(s: SparkSession, d: str) -> DataFrame:
    rows = P.sentence_rows(_three(s, d), KEYS).select(*KEYS, F.explode(T.tokens(F.col("sentence"))).alias("token"))
    per = rows.groupBy(*KEYS, "token").agg(F.count("*").alias("n"))
    return P.pattern_counts(per, ["corpus", "token"])


def _dispersion(s: SparkSession, d: str) -> DataFrame:
    docs = _three(s, d)
    rows = P.sentence_rows(docs, KEYS).select(*KEYS, F.explode(T.tokens(F.col("sentence"))).alias("token"))
    sums = rows.groupBy(*KEYS, "token").agg(F.count("*").alias("n")).groupBy("corpus", "token").agg(F.sum("n").cast("double").alias("total"), F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"))
    sized = docs.groupBy("corpus").agg(F.count("*").cast("double").alias("docs"))
    return sums.join(sized, "corpus").select("corpus", "token", S.moment_dispersion(F.col("total"), F.col("squares"), F.col("docs")).alias("dispersion"))


def _quartiles(s: SparkSession, d: str) -> DataFrame:
    """Quartiles by nearest rank of sentences in a document, from the documents of each number."""
    sized = P.segmented(_three(s, d)).select("corpus", F.aggregate("paras", F.lit(0), lambda a, x: a + F.size(x)).cast("long").alias("k"))
    tally = sized.groupBy("corpus", "k").agg(F.count("*").alias("n"))
    return S.ranked_quantiles(tally, ["corpus"], "k", "n", {"q1": 0.25, "median": 0.5, "q3": 0.75})


def _hashes(s: SparkSession, d: str) -> DataFrame:
    return _first(s, d).select("partition", "doc_id", canonical_text_sha256(F.col("text")).alias("sha256"))


def _complete(s: SparkSession, d: str, models: tuple[str, ...]) -> DataFrame:
    return R.complete_sources(_records(s, d), models)


def _params(s: SparkSession, d: str) -> DataFrame:
    rows = R.cell_rows(_records(s, d)).select(F.col("id").alias("doc_id"), "model", F.col("generation").alias("text"))
    return S.document_params(rows)


def _selected(s: SparkSession, scenarios: list[tuple[str, S.ClusterParams]], params: S.ClusterParams) -> DataFrame:
    """The smallest number of sources at which all scenarios reach the target, null if none does; with the parameters."""
    row = (S.select_sources(s, scenarios), S.MIN_REPLICATES, params.base_rate_per_unit, params.exposure_per_doc, params.source_dispersion, params.model_dispersion)
    return s.createDataFrame([row], "sources int, replicates int, base_rate_per_unit double, exposure_per_doc double, source_dispersion double, model_dispersion double")


def _selected_measured(s: SparkSession, d: str) -> DataFrame:
    """The same from the parameters that the tables themselves show."""
    params, quartiles = S.measured({k: v for k, v in _params(s, d).first().asDict().items() if k != "skeletons"}, "the tables' human and model documents")
    return _selected(s, S.sensitivity(params, quartiles), params)


def queries() -> dict[str, Query]:
    human = studies.SMALL_DESIGN
    lexical = lambda s, d: M.nominated(M.study_counts(_first(s, d), frames=False))
    return {
        "doc_exposure": lambda s, d: P.exposure(_three(s, d), ["corpus"]),
        "sentence_units": lambda s, d: P.sentence_rows(_three(s, d), KEYS),
        "adjacent_pairs": lambda s, d: P.adjacent_pairs(_three(s, d), KEYS),
        "token_counts": _token_counts,
        "ngram_counts": lambda s, d: P.pattern_counts(P.ngram_rows(_three(s, d), KEYS), ["corpus", "pattern"]),
        "pattern_lift_3way": lambda s, d: M.compared(_three(s, d), frames=False),
        "pattern_report": lambda s, d: M.ranked(M.compared(_three(s, d))),
        "frame_counts": lambda s, d: P.pattern_counts(P.frame_rows(_three(s, d), KEYS), ["corpus", "kind", "pattern"]),
        "skeleton_tokens": lambda s, d: P.skeleton_rows(_three(s, d), KEYS).select(*KEYS, "para_idx", "sent_idx", F.array_join("skel", " ").alias("skeleton")),
        "skeleton_rates": lambda s, d: P.structural_rates(_three(s, d), ["corpus"], "doc_id"),
        "skeleton_types": lambda s, d: P.skeleton_types(P.structural_rates(_three(s, d), ["corpus"], "doc_id"), ["corpus"]),
        "skeleton_top": lambda s, d: P.ranked_families(P.structural_rates(_three(s, d), ["corpus"], "doc_id"), ["corpus"], 50),
        "strata_survey": lambda s, d: R.survey(_records(s, d, ("model", "domain", "attack", "decoding"))),
        "sampled_models": lambda s, d: R.sampled_models(_records(s, d)).select("partition", "domain", "model", "rank", "id"),
        "matched_humans": lambda s, d: R.matched_humans(_records(s, d), R.sampled_models(_records(s, d))).select("domain", "rank", "id"),
        "sampled_answers": lambda s, d: R.sampled_answers(table(s, d, "hc3_answers")).select("source", "side", "rank", "key"),
        "study_partitions": lambda s, d: R.partition_lists(_first(s, d)),
        "complete_sources": lambda s, d: _complete(s, d, ("human", "chatgpt")),
        "calibration_exclusion": lambda s, d: R.without_excluded(_complete(s, d, human), table(s, d, "calibration_sources")),
        "calibration_rows": lambda s, d: R.calibration_rows(_records(s, d), table(s, d, "calibration_sources")).select("domain", "source_id", "model", "id"),
        "phase_split": lambda s, d: R.phases(R.without_excluded(_complete(s, d, human), table(s, d, "calibration_sources")), None),
        "echo_sets_lexical": lambda s, d: E.echo_sets(_echo_sources(s, d)).where(F.col("level") == E.LEXICAL),
        "echo_sets": lambda s, d: E.echo_sets(_echo_sources(s, d)),
        "echo_diagnostics": lambda s, d: E.echo_counts(_second(s, d).counts, ["phase", "kind"]),
        "echo_patterns": lambda s, d: E.echo_counts(_second(s, d).counts, ["kind", "pattern"]),
        "study_nomination_lexical": lambda s, d: lexical(s, d).select("pattern", "ai_discovery_occurrences", "ai_discovery_documents_with", "candidate_set"),
        "study_verdicts_lexical": lambda s, d: M.judged(lexical(s, d)).select("pattern", "candidate_set", "discovery_occurrences", "validation_occurrences", "human_occurrences", "hc3_ai_occurrences", "hc3_human_occurrences", "elevated_in_discovery", "replicated", "verdict"),
        "study_verdicts": lambda s, d: M.judged(M.nominated(M.study_counts(_first(s, d)))),
        "study_verdict_counts": lambda s, d: M.verdict_counts(M.judged(M.nominated(M.study_counts(_first(s, d))))),
        "cell_counts": lambda s, d: _second(s, d).cells,
        "cell_candidates": lambda s, d: _second(s, d).candidates(),
        "cell_candidate_kinds": lambda s, d: C.candidate_kinds(_second(s, d).candidates()),
        "cell_replication": lambda s, d: _second(s, d).replication(),
        "cell_intervals": lambda s, d: _second(s, d).intervals(),
        "cell_lift_matrix": lambda s, d: _second(s, d).lift_matrix(),
        "cluster_params": _params,
        "power_curve": lambda s, d: S.power_curve(s, MEASURED, S.GRID),
        "power_selected": lambda s, d: _selected(s, S.sensitivity(MEASURED, SPREAD), MEASURED),
        "power_selected_measured": _selected_measured,
        "power_stress": lambda s, d: s.createDataFrame([(x.name, S.simulated_power(s, MEASURED, S.MAX_SOURCES, 1.0, 120, S.SEED, x)) for x in S.ASYMMETRIES], "scenario string, qualifying double"),
        "power_gate": lambda s, d: S.gate_report(s, MEASURED, SPREAD),
        "word_dispersion": _dispersion,
        "sentence_quartiles": _quartiles,
        "content_hashes": _hashes,
        "content_digest": lambda s, d: R.corpus_digest(_hashes(s, d)),
        "document_ngrams": lambda s, d: P.pattern_counts(document_ngrams(_three(s, d).select("corpus", "text")), ["corpus", "pattern"]),
    }
