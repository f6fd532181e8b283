"""The second study: cells of domain and model, candidates, frozen replication, lift matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidrift.functions import constants as K
from lexidrift.functions.metrics import denominator, ratio, smoothed_lift
from lexidrift.operators import echo as E
from lexidrift.operators import patterns as P
from lexidrift.plans.lineage import cut


@dataclass(frozen=True)
class SecondStudyRules:
    """Tests of a cell, a domain and a pattern of the second study."""

    min_lift: float = 1.5
    min_occurrences: int = 10
    min_doc_prevalence: float = 0.10
    min_passing_models: int = 2
    no_reversal_lift: float = 0.8
    min_domains: int = 3


KEYS = ["phase", "domain", "source_id", "model", "doc_id"]
CELL = ["phase", "domain", "model"]


def document_counts(study: DataFrame, sources: DataFrame) -> DataFrame:
    """`(phase, domain, source_id, model, doc_id, kind, pattern, n, echoing)`, stored for all later steps."""
    return cut(E.mark_echoes(P.document_patterns(study, KEYS), E.echo_sets(sources)))


def cell_counts(counts: DataFrame) -> DataFrame:
    """`(phase, domain, model, kind, pattern, total, primary, documents_with)`; a document counts if its primary count does."""
    primary = F.col("n") - F.col("echoing")
    return counts.groupBy(*CELL, "kind", "pattern").agg(F.sum("n").alias("total"), F.sum(primary).alias("primary"), F.count_if(primary > 0).alias("documents_with"))


def cell_exposure(study: DataFrame) -> DataFrame:
    """Documents, sentences and pairs of each cell; echoes don't reduce them."""
    return P.exposure(study, CELL).select(*CELL, "documents", "sentences", "adjacent_pairs")


def matrix(cells: DataFrame, seen: DataFrame, wanted: DataFrame, rules: SecondStudyRules = SecondStudyRules()) -> DataFrame:
    """Lift of every wanted `(kind, pattern)` in every model cell against the human cell of its domain and phase.

    Cells without the pattern, human ones too, count as zeros, so each pattern has a row
    for each model cell that has documents.
    """
    human = seen.where("model = 'human'").select("phase", "domain", F.col("documents").alias("h_documents"), F.col("sentences").alias("h_sentences"), F.col("adjacent_pairs").alias("h_pairs"))
    models = seen.where("model <> 'human'").join(human, ["phase", "domain"], "left")
    # the scaffold multiplies patterns by cells, whose number the design bounds (phases x domains x models)
    scaffold = wanted.select("kind", "pattern").distinct().crossJoin(models)
    own = cells.where("model <> 'human'").select(*CELL, "kind", "pattern", "total", "primary", "documents_with")
    base = cells.where("model = 'human'").select("phase", "domain", "kind", "pattern", F.col("primary").alias("h_primary"))
    joined = scaffold.join(own, [*CELL, "kind", "pattern"], "left").join(base, ["phase", "domain", "kind", "pattern"], "left")
    zero = F.lit(0).cast("long")
    filled = joined.withColumns({c: F.coalesce(c, zero) for c in ("total", "primary", "documents_with", "h_primary", "h_documents", "h_sentences", "h_pairs")})
    units = denominator(F.col("kind"), F.col("sentences"), F.col("adjacent_pairs"))
    h_units = denominator(F.col("kind"), F.col("h_sentences"), F.col("h_pairs"))
    lifted = filled.withColumns({"lift": smoothed_lift(F.col("primary"), units, F.col("h_primary"), h_units), "doc_prevalence": ratio(F.col("documents_with"), F.col("documents"))})
    passes = (F.col("lift") >= rules.min_lift) & (F.col("primary") >= rules.min_occurrences) & (F.col("doc_prevalence") >= rules.min_doc_prevalence)
    return lifted.select("kind", "pattern", *CELL, "lift", F.col("primary").alias("occurrences"), "total", E.echo_columns(F.col("total"), F.col("total") - F.col("primary"), K.PROMPT_DERIVED_ABOVE)["prompt_derived"].alias("prompt_derived"), "doc_prevalence", passes.alias("cell_pass"))


def universe(cells: DataFrame, seen: DataFrame, phase: str = "discovery", rules: SecondStudyRules = SecondStudyRules()) -> DataFrame:
    """`(kind, pattern)` that reach the occurrence and prevalence floors in a model cell of the phase: no other can qualify."""
    floors = (F.col("primary") >= rules.min_occurrences) & (ratio(F.col("documents_with"), F.col("documents")) >= rules.min_doc_prevalence)
    return cells.where((F.col("phase") == phase) & (F.col("model") != "human")).join(seen, CELL).where(floors).select("kind", "pattern").distinct()


def qualifying_domains(rows: DataFrame, rules: SecondStudyRules = SecondStudyRules()) -> DataFrame:
    """`(kind, pattern, phase, domains)`: domains where enough models pass and none reverses."""
    domains = rows.groupBy("kind", "pattern", "phase", "domain").agg(F.count_if("cell_pass").alias("passing"), F.min("lift").alias("least"))
    good = (F.col("passing") >= rules.min_passing_models) & (F.col("least") >= rules.no_reversal_lift)
    return domains.groupBy("kind", "pattern", "phase").agg(F.count_if(good).alias("domains"))


def candidates(cells: DataFrame, seen: DataFrame, rules: SecondStudyRules = SecondStudyRules()) -> DataFrame:
    """`(kind, pattern, domains)` that qualify in discovery."""
    found = qualifying_domains(matrix(cells.where("phase = 'discovery'"), seen.where("phase = 'discovery'"), universe(cells, seen, rules=rules), rules), rules)
    return found.where(F.col("domains") >= rules.min_domains).select("kind", "pattern", "domains")


def frozen(found: DataFrame) -> DataFrame:
    """The candidates as a stored table in code-point order: later steps see nothing else of discovery."""
    return cut(found.orderBy("kind", "pattern"))


def replication(cells: DataFrame, seen: DataFrame, fixed: DataFrame, rules: SecondStudyRules = SecondStudyRules()) -> DataFrame:
    """`(kind, pattern, discovery_domains, validation_domains, replicated)` of the frozen candidates."""
    both = qualifying_domains(matrix(cells, seen, fixed, rules), rules)
    wide = both.groupBy("kind", "pattern").agg(*(F.coalesce(F.max(F.when(F.col("phase") == p, F.col("domains"))), F.lit(0)).alias(f"{p}_domains") for p in ("discovery", "validation")))
    return wide.withColumn("replicated", (F.col("discovery_domains") >= rules.min_domains) & (F.col("validation_domains") >= rules.min_domains))


def lift_matrix(cells: DataFrame, seen: DataFrame, fixed: DataFrame, intervals: DataFrame | None = None, rules: SecondStudyRules = SecondStudyRules()) -> DataFrame:
    """Rows as published: every frozen candidate in every model cell, with its interval where there is one."""
    verdicts = replication(cells, seen, fixed, rules).select("kind", "pattern", F.col("replicated").alias("replicated_pattern"))
    rows = matrix(cells, seen, fixed, rules).join(verdicts, ["kind", "pattern"])
    if intervals is None:
        none = F.lit(None).cast("double")
        rows = rows.withColumns({"bootstrap_ci_lo": none, "bootstrap_ci_hi": none})
    else:
        rows = rows.join(intervals.select("kind", "pattern", *CELL, "bootstrap_ci_lo", "bootstrap_ci_hi"), ["kind", "pattern", *CELL], "left")
    return rows.select("kind", "pattern", *CELL, "lift", "occurrences", "total", "prompt_derived", "doc_prevalence", "cell_pass", "bootstrap_ci_lo", "bootstrap_ci_hi", "replicated_pattern")


def candidate_kinds(found: DataFrame) -> DataFrame:
    """Candidates of each kind."""
    return found.groupBy("kind").agg(F.count("*").alias("candidates"))
