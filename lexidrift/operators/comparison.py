"""Three corpora compared, and the first study: nomination, replication, verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexidrift.functions import constants as K
from lexidrift.functions.metrics import per_10k, ratio, smoothed_lift
from lexidrift.operators import patterns as P
from lexidrift.plans.lineage import cut


@dataclass(frozen=True)
class FirstStudyRules:
    """Floors of nomination and replication of the first study."""

    preregistered_floor: float = 0.25
    exploratory_floor: float = 0.05
    min_occurrences: int = 5
    max_lexical: int = 300
    min_lift: float = 1.5
    min_doc_prevalence: float = 0.10
    replication_occurrences: int = 5


PARTITIONS = ("ai_discovery", "ai_validation", "human_baseline", "hc3_ai", "hc3_human")
_SHORT = {"ai_discovery": "discovery", "ai_validation": "validation", "human_baseline": "human", "hc3_ai": "hc3_ai", "hc3_human": "hc3_human"}


def pivoted(counts: DataFrame, corpora: tuple[str, ...], column: str = "corpus") -> DataFrame:
    """`(kind, pattern, <corpus>_occurrences, <corpus>_documents_with…)`, 0 where a corpus lacks the pattern; one shuffle for all."""

    def of(c: str, value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(column) == c, F.col(value))), F.lit(0)).cast("long")

    return counts.groupBy("kind", "pattern").agg(*(of(c, v).alias(f"{c}_{v}") for c in corpora for v in ("occurrences", "documents_with")))


def _sizes(documents: DataFrame, corpora: tuple[str, ...], column: str = "corpus") -> DataFrame:
    """One row with `<corpus>_documents` and `<corpus>_sentences`, 0 for a corpus without documents."""
    seen = P.exposure(documents, [column])
    return seen.agg(*(F.coalesce(F.sum(F.when(F.col(column) == c, F.col(v))), F.lit(0)).alias(f"{c}_{v}") for c in corpora for v in ("documents", "sentences")))


def counted(documents: DataFrame, frames: bool = True) -> DataFrame:
    """`(corpus, kind, pattern, occurrences, documents_with)` of `documents(corpus, doc_id, text)`."""
    keys = ["corpus", "doc_id"]
    rows = P.all_patterns(documents, keys) if frames else P.ngram_rows(documents, keys).select(*keys, F.lit(K.NGRAM).alias("kind"), "pattern", "n")
    return P.pattern_counts(rows, ["corpus", "kind", "pattern"])


def compared(documents: DataFrame, min_documents: int = 2, min_occurrences: int = 2, frames: bool = True) -> DataFrame:
    """Patterns of corpus `ai` against `pre` and `contemporary`, unrounded.

    `documents(corpus, doc_id, text)` holds the three. A pattern takes part from so many
    documents and occurrences in `ai` on.
    """
    three = ("ai", "pre", "contemporary")
    documents = cut(P.segmented(documents))
    wide = pivoted(counted(documents, frames), three).where((F.col("ai_documents_with") >= min_documents) & (F.col("ai_occurrences") >= min_occurrences))
    # the sizes are one row by construction
    joined = wide.crossJoin(F.broadcast(_sizes(documents, three)))
    lift = {c: smoothed_lift(F.col("ai_occurrences"), F.col("ai_sentences"), F.col(f"{c}_occurrences"), F.col(f"{c}_sentences")) for c in three[1:]}
    return joined.select(
        F.col("kind").alias("pattern_kind"),
        "pattern",
        "ai_occurrences",
        "ai_documents_with",
        per_10k(F.col("ai_occurrences"), F.col("ai_sentences")).alias("ai_rate_per_10k_sentences"),
        ratio(F.col("ai_documents_with"), F.col("ai_documents")).alias("ai_document_prevalence"),
        F.col("pre_occurrences").alias("pre_human_occurrences"),
        per_10k(F.col("pre_occurrences"), F.col("pre_sentences")).alias("pre_human_rate_per_10k_sentences"),
        F.col("contemporary_occurrences").alias("contemporary_human_occurrences"),
        per_10k(F.col("contemporary_occurrences"), F.col("contemporary_sentences")).alias("contemporary_human_rate_per_10k_sentences"),
        lift["pre"].alias("lift_vs_pre_human_smoothed"),
        lift["contemporary"].alias("lift_vs_contemporary_human_smoothed"),
    )


def ranked(rows: DataFrame) -> DataFrame:
    """The comparison as published: lifts rounded to 4 places, best smaller lift first; ties by kind and pattern."""
    out = rows.withColumns({c: F.round(c, 4) for c in rows.columns if "rate" in c or "lift" in c} | {"ai_document_prevalence": F.round("ai_document_prevalence", 6)})
    return out.orderBy(F.least("lift_vs_pre_human_smoothed", "lift_vs_contemporary_human_smoothed").desc(), F.desc("ai_documents_with"), F.desc("ai_occurrences"), "pattern_kind", "pattern")


# ---- first study -------------------------------------------------------------------


def study_counts(study: DataFrame, frames: bool = True) -> DataFrame:
    """Wide counts of the study's five partitions with their sizes on each row."""
    documents = cut(P.segmented(study.select(F.col("partition").alias("corpus"), "doc_id", "text")))
    return pivoted(counted(documents, frames), PARTITIONS).crossJoin(F.broadcast(_sizes(documents, PARTITIONS)))


def nominated(counts: DataFrame, rules: FirstStudyRules = FirstStudyRules()) -> DataFrame:
    """`counts` of the candidates with `candidate_set`; only discovery columns decide.

    Lexical ones reach a prevalence floor and the occurrences, the first 300 by prevalence,
    occurrences and pattern; frames seen at all are structural candidates. A candidate of
    the preregistered floor is in that set, not in the exploratory one.
    """
    prevalence = ratio(F.col("ai_discovery_documents_with"), F.col("ai_discovery_documents"))
    lexical = counts.where((F.col("kind") == K.NGRAM) & (F.col("ai_discovery_occurrences") >= rules.min_occurrences)).withColumn("prevalence", prevalence)
    top = lexical.where(F.col("prevalence") >= rules.exploratory_floor).orderBy(F.desc("prevalence"), F.desc("ai_discovery_occurrences"), "pattern").limit(rules.max_lexical)
    named = top.withColumn("candidate_set", F.when(F.col("prevalence") >= rules.preregistered_floor, "preregistered").otherwise("exploratory")).drop("prevalence")
    frames = counts.where((F.col("kind") != K.NGRAM) & (F.col("ai_discovery_occurrences") > 0)).withColumn("candidate_set", F.lit("structural"))
    return named.unionByName(frames)


def judged(candidates: DataFrame, rules: FirstStudyRules = FirstStudyRules()) -> DataFrame:
    """Rates, lifts and verdict of each candidate; thresholds are applied to rounded values."""

    def of(p: str, v: str) -> Column:
        return F.col(f"{p}_{v}")

    columns = {}
    for p in PARTITIONS:
        columns[f"{_SHORT[p]}_occurrences"] = of(p, "occurrences")
        columns[f"{_SHORT[p]}_documents_with"] = of(p, "documents_with")
        columns[f"{_SHORT[p]}_doc_prevalence"] = F.round(ratio(of(p, "documents_with"), of(p, "documents")), 4)
        columns[f"{_SHORT[p]}_per_10k_sentences"] = F.round(per_10k(of(p, "occurrences"), of(p, "sentences")), 3)
    for name, a, b in (("discovery_vs_human", "ai_discovery", "human_baseline"), ("validation_vs_human", "ai_validation", "human_baseline"), ("hc3_ai_vs_hc3_human", "hc3_ai", "hc3_human")):
        columns[f"lift_{name}"] = F.round(smoothed_lift(of(a, "occurrences"), of(a, "sentences"), of(b, "occurrences"), of(b, "sentences")), 4)
    out = candidates.select(F.col("kind").alias("pattern_kind"), "pattern", "candidate_set", *(c.alias(n) for n, c in columns.items()))
    return with_verdicts(out, rules)


def with_verdicts(rows: DataFrame, rules: FirstStudyRules = FirstStudyRules()) -> DataFrame:
    """`rows` with `elevated_in_discovery`, `replicated` and `verdict`."""
    replicated = (F.col("lift_validation_vs_human") >= rules.min_lift) & (F.col("validation_doc_prevalence") >= rules.min_doc_prevalence) & (F.col("validation_occurrences") >= rules.replication_occurrences)
    out = rows.withColumns({"elevated_in_discovery": F.col("lift_discovery_vs_human") >= rules.min_lift, "replicated": replicated})
    verdict = F.when(F.col("replicated"), "REPLICATED").when(F.col("elevated_in_discovery"), "FAILED_VALIDATION").otherwise("NOT_ELEVATED")
    return out.withColumn("verdict", verdict)


def in_study_order(rows: DataFrame) -> DataFrame:
    """Candidates as published: by set, best lift in validation first, then its prevalence; ties by kind and pattern."""
    return rows.orderBy("candidate_set", F.desc("lift_validation_vs_human"), F.desc("validation_doc_prevalence"), "pattern_kind", "pattern")


def verdict_counts(rows: DataFrame) -> DataFrame:
    """Candidates of each set and verdict."""
    return rows.groupBy("candidate_set", "verdict").agg(F.count("*").alias("candidates"))
