"""Records, sources and answers: one row each, labels tidied, selection rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexidrift.functions import constants as K
from lexidrift.functions.text import strip_space
from lexidrift.plans.lineage import cut

FIELDS = ("id", "source_id", "model", "domain", "attack", "decoding", "repetition_penalty", "prompt", "title", "generation")


def tidy_label(label: Column) -> Column:
    """Lower case, no outer blanks, dashes for inner blanks and underscores; null for blank."""
    bare = F.regexp_replace(F.lower(F.trim(label)), r"[ _]+", "-")
    return F.when(bare != "", bare)


def tidy_source(value: Column) -> Column:
    """The 32 hexadecimal digits of an identifier however written; null for anything else."""
    bare = F.regexp_replace(F.lower(value), r"urn:uuid:|[^0-9a-f]", "")
    return F.when(F.length(bare) == 32, bare)


#: What the cell rules need; the prompt and title come from the sources.
CELL_FIELDS = ("source_id", "model", "domain", "attack", "decoding", "repetition_penalty", "generation")


def records(raid: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row for each id with `fields`; `source_id`, `model` and `domain` are tidied.

    Of several deliveries the greatest stands, so the last where `loaded_at` is named first; null ids drop out. Name few fields: the
    columns travel through the shuffle that finds repeated ids.
    """
    named = [f for f in fields if f != "id"]
    one = raid.where("id is not null").select("id", *named).groupBy("id").agg(F.max(F.struct(*named)).alias("r")).select("id", "r.*")
    tidy = {"source_id": tidy_source, "model": tidy_label, "domain": tidy_label}
    return one.withColumns({f: tidy[f](F.col(f)) for f in named if f in tidy})


def sources(echo_sources: DataFrame) -> DataFrame:
    """`(source_id, title, prompt)`, one row a source: its last title and its last prompt that are not empty, each by itself.

    Rows have no time, so the last is the greatest in code-point order; a source without any has an empty one.
    """
    rows = echo_sources.select(tidy_source(F.col("source_id")).alias("source_id"), "title", "prompt").where("source_id is not null")
    return rows.groupBy("source_id").agg(*(F.coalesce(F.max(F.nullif(F.col(c), F.lit(""))), F.lit("")).alias(c) for c in ("title", "prompt")))


def answers(hc3: DataFrame) -> DataFrame:
    """`(q_id, source, side, answer_no, text)`: single non-null answers, each question once."""
    one = hc3.where("q_id is not null").select("q_id", "source", "human_answers", "chatgpt_answers").groupBy("q_id").agg(F.min(F.struct("source", "human_answers", "chatgpt_answers")).alias("r")).select("q_id", "r.*")
    sides = [one.select("q_id", "source", F.lit(name).alias("side"), F.posexplode(column).alias("answer_no", "text")) for name, column in (("human", "human_answers"), ("chatgpt", "chatgpt_answers"))]
    return sides[0].unionByName(sides[1]).where("text is not null")


def rank_key(value: Column) -> Column:
    """The order in which records are drawn: their SHA-256 as hexadecimal digits."""
    return F.sha2(value, 256)


def model_partition(model: Column) -> Column:
    """Discovery or validation by model; null for others."""
    return F.when(model.isin(*K.DISCOVERY_MODELS), "ai_discovery").when(model.isin(*K.VALIDATION_MODELS), "ai_validation")


def long_enough(text: Column, least: int = K.MIN_CHARS) -> Column:
    """At least so many code points without outer white space; null counts as empty."""
    return F.length(strip_space(F.coalesce(text, F.lit("")))) >= least


def prose_rows(rows: DataFrame) -> DataFrame:
    """Unaltered records of prose domains that are long enough."""
    return rows.where((F.col("attack") == "none") & F.col("domain").isin(*K.PROSE_DOMAINS) & long_enough(F.col("generation")))


def cell_rows(rows: DataFrame) -> DataFrame:
    """Unaltered records of the cell domains; of models only greedy ones without repetition penalty."""
    plain = (F.col("model") == "human") | ((F.col("decoding") == "greedy") & (F.col("repetition_penalty") == "no"))
    return rows.where((F.col("attack") == "none") & F.col("domain").isin(*K.CELL_DOMAINS) & plain & F.col("source_id").isNotNull() & long_enough(F.col("generation")))


def lowest(rows: DataFrame, by: Sequence[str], n: int, key: str = "id") -> DataFrame:
    """The `n` rows of each group whose key ranks lowest, with their `rank` from 1; ties go by key."""
    order = Window.partitionBy(*by).orderBy(rank_key(F.col(key)), F.col(key))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def sampled_models(rows: DataFrame, n: int = K.DOCS_PER_STRATUM) -> DataFrame:
    """Of each partition, domain and model the `n` lowest-ranked prose records."""
    kept = prose_rows(rows).withColumn("partition", model_partition(F.col("model"))).where("partition is not null")
    return lowest(kept, ["partition", "domain", "model"], n)


def matched_humans(rows: DataFrame, drawn: DataFrame, n: int = K.HUMAN_PER_DOMAIN) -> DataFrame:
    """Human prose records of the sources of `drawn`, by their id or source, the `n` lowest-ranked of each domain."""
    human = prose_rows(rows).where("model = 'human'")
    wanted = drawn.where("source_id is not null").select("domain", F.col("source_id").alias("wanted")).distinct()
    by_id = human.withColumn("wanted", tidy_source(F.col("id"))).join(wanted, ["domain", "wanted"], "left_semi").drop("wanted")
    by_source = human.withColumn("wanted", F.col("source_id")).join(wanted, ["domain", "wanted"], "left_semi").drop("wanted")
    every = by_id.unionByName(by_source).dropDuplicates(["id"])
    return lowest(every, ["domain"], n)


def sampled_answers(hc3: DataFrame, n: int = K.HC3_PER_STRATUM) -> DataFrame:
    """Of each HC3 source and side the `n` lowest-ranked answers that are long enough."""
    kept = answers(hc3).where(F.col("source").isNotNull() & long_enough(F.col("text"))).withColumn("key", F.concat_ws(":", "q_id", "side", "answer_no"))
    return lowest(kept, ["source", "side"], n, "key")


def first_study(raid: DataFrame, hc3: DataFrame) -> DataFrame:
    """`(partition, doc_id, domain, model, source_id, text)` of the first study's five partitions."""
    rows = records(raid, ("source_id", "model", "domain", "attack", "generation"))
    models = sampled_models(rows)
    human = matched_humans(rows, models)
    parts = [
        models.select("partition", F.col("id").alias("doc_id"), "domain", "model", "source_id", F.col("generation").alias("text")),
        human.select(F.lit("human_baseline").alias("partition"), F.col("id").alias("doc_id"), "domain", "model", "source_id", F.col("generation").alias("text")),
        sampled_answers(hc3).select(F.when(F.col("side") == "human", "hc3_human").otherwise("hc3_ai").alias("partition"), F.col("key").alias("doc_id"), F.col("source").alias("domain"), F.col("side").alias("model"), F.lit(None).cast("string").alias("source_id"), "text"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def survey(rows: DataFrame) -> DataFrame:
    """`(field, value, rows)`: records by model, domain, attack and decoding, by model and domain of unaltered ones, and in all."""
    one = rows.sparkSession.sql(
        """select case grouping_id(model, domain, attack, decoding) when 7 then 'model' when 11 then 'domain' when 13 then 'attack' when 14 then 'decoding' else 'all' end as field,
                  coalesce(model, domain, attack, decoding) as value, count(*) as rows
           from {rows} group by grouping sets ((model), (domain), (attack), (decoding), ())""",
        rows=rows.select("model", "domain", "attack", "decoding"),
    )
    both = rows.where("attack = 'none'").groupBy(F.concat_ws("/", F.coalesce("model", F.lit("")), F.coalesce("domain", F.lit(""))).alias("value")).agg(F.count("*").alias("rows")).select(F.lit("model/domain").alias("field"), "value", "rows")
    return one.unionByName(both)


def partition_lists(study: DataFrame) -> DataFrame:
    """Documents, models and domains of each partition, the lists sorted."""
    return study.groupBy("partition").agg(F.count("*").alias("documents"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"), F.array_join(F.sort_array(F.collect_set("domain")), ",").alias("domains"))


ARMS = ("human", *K.DISCOVERY_MODELS, *K.VALIDATION_MODELS)


def complete_sources(rows: DataFrame, required: Sequence[str] = ARMS) -> DataFrame:
    """`(domain, source_id)`, each source once, with a document of every required model.

    A source recorded under several domains has that of its record with the greatest id.
    """
    models = F.collect_set(F.when(F.col("model").isin(*required), F.col("model")))
    found = cell_rows(rows).where(F.col("model").isin(*ARMS)).groupBy("source_id").agg(F.max_by("domain", "id").alias("domain"), F.size(models).alias("n"))
    return found.where(F.col("n") == len(set(required))).select("domain", "source_id")


def without_excluded(found: DataFrame, excluded: DataFrame) -> DataFrame:
    """Sources that the exclusion list doesn't name, however it writes them."""
    named = excluded.select(tidy_source(F.col("source_id")).alias("source_id")).where("source_id is not null").distinct()
    return found.join(named, "source_id", "left_anti")


def ranked_within(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """`rows` with `rank`, from 1 by hash of the key, and `have`, the size of the group.

    Groups are ranked in buckets of the hash's first digits, whose offsets come from counts, so
    no task sorts a whole group.
    """
    hashed = rows.withColumn("_hash", rank_key(F.col(key))).withColumn("_bucket", F.substring("_hash", 1, 3))
    sizes = hashed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumns({"_before": before, "have": F.sum("_n").over(Window.partitionBy(*by))}).drop("_n")
    own = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_hash", key))
    return hashed.withColumn("_own", own).join(offsets, [*by, "_bucket"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_hash", "_bucket", "_own", "_before")


def phases(found: DataFrame, per_domain: int | None = K.SOURCES_PER_PHASE) -> DataFrame:
    """`(domain, source_id, phase)`: in each domain ranks 1 to N are discovery, N+1 to 2N validation.

    A domain with fewer than 2N sources is an error. With None, N is half of what each domain has.
    """
    ranked = ranked_within(found, ["domain"], "source_id")
    if per_domain is None:
        n = F.floor(F.col("have") / 2)
    else:
        n = F.when(F.col("have") >= 2 * per_domain, F.lit(per_domain)).otherwise(F.raise_error(F.concat(F.lit("too few sources in "), F.col("domain"))).cast("int"))
    return ranked.withColumn("n", n).where(F.col("rank") <= 2 * F.col("n")).select("domain", "source_id", F.when(F.col("rank") <= F.col("n"), "discovery").otherwise("validation").alias("phase"))


def check_phases(split: DataFrame, excluded: DataFrame) -> None:
    """Raises unless the phases share no source and hold none that is excluded."""
    shared = split.where("phase = 'discovery'").select("source_id").intersect(split.where("phase = 'validation'").select("source_id"))
    if shared.limit(1).count():
        raise ValueError("a source is in both phases")
    if split.select("source_id").exceptAll(without_excluded(split.select("source_id"), excluded)).limit(1).count():
        raise ValueError("an excluded source is in a phase")


def second_study(raid: DataFrame, excluded: DataFrame, per_domain: int | None = K.SOURCES_PER_PHASE, required: Sequence[str] = ARMS) -> DataFrame:
    """`(phase, domain, source_id, model, doc_id, text)`: human and phase models of the drawn sources.

    Of several documents of a source and model the one loaded last stands (where `loaded_at` is known), and of those the greatest id.
    A source in both phases or excluded is an error.
    """
    timed = ("loaded_at",) if "loaded_at" in raid.columns else ()
    rows = records(raid, (*timed, *CELL_FIELDS))
    split = cut(phases(without_excluded(complete_sources(rows, required), excluded), per_domain))
    check_phases(split, excluded)
    of_phase = ((F.col("phase") == "discovery") & F.col("model").isin("human", *K.DISCOVERY_MODELS)) | ((F.col("phase") == "validation") & F.col("model").isin("human", *K.VALIDATION_MODELS))
    arms = cell_rows(rows).drop("domain").join(split, "source_id").where(of_phase)
    return arms.groupBy("phase", "domain", "source_id", "model").agg(F.max(F.struct(*timed, "id", "generation")).alias("d")).select("phase", "domain", "source_id", "model", F.col("d.id").alias("doc_id"), F.col("d.generation").alias("text"))


def wanted_sources(metadata: DataFrame) -> DataFrame:
    """Source ids named by the first study's metadata: the matched one where given, and that of human rows."""
    raid = metadata.where("source = 'raid'")
    matched = raid.where("matched_source_id <> ''").select(F.col("matched_source_id").alias("source_id"))
    human = raid.where("model = 'human'").select("source_id")
    return matched.unionByName(human).where("source_id is not null and source_id <> ''").distinct()


def calibration_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cell records whose source is wanted."""
    named = wanted.select(tidy_source(F.col("source_id")).alias("source_id")).where("source_id is not null").distinct()
    return cell_rows(rows).join(named, "source_id", "left_semi")


def corpus_digest(hashes: DataFrame, column: str = "sha256") -> DataFrame:
    """`(documents, digest)`: hash of the sorted document hashes, one on a line.

    The hashes are gathered in one row, so this is for drawn corpora, whose size their
    parameters bound (64 bytes a document), not for a whole table.
    """
    joined = F.concat(F.array_join(F.array_sort(F.collect_list(column)), "\n"), F.lit("\n"))
    return hashes.agg(F.count(column).alias("documents"), F.sha2(joined, 256).alias("digest"))
