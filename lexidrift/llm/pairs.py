"""Problem 7: prompt and response pairs that are no proper answer, each with its kind of defect."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidrift.llm.defects import cut_state, in_other_language, is_copy, is_empty, is_refusal, visible
from lexidrift.llm.language import LetterModel
from lexidrift.llm.truncation import judge, vocabulary
from lexidrift.plans.lineage import cut

KEYS = ("rec_id", "side", "answer_no")


def raid_pairs(records: DataFrame) -> DataFrame:
    """`(rec_id, side, answer_no, prompt, answer)` of the records with a non-blank prompt."""
    return records.where(F.col("id").isNotNull() & F.col("prompt").rlike(r"[\p{L}\p{N}]")).select(F.col("id").alias("rec_id"), F.lit("generation").alias("side"), F.lit(0).alias("answer_no"), "prompt", F.col("generation").alias("answer"))


def hc3_pairs(answers: DataFrame) -> DataFrame:
    """The same of single answers; a null or empty array is one case numbered -1."""
    sides = [answers.where("q_id is not null").select(F.col("q_id").cast("string").alias("rec_id"), F.lit(side).alias("side"), F.col("question").alias("prompt"), F.posexplode_outer(side).alias("answer_no", "answer")) for side in ("human_answers", "chatgpt_answers")]
    return sides[0].unionByName(sides[1]).withColumn("answer_no", F.coalesce("answer_no", F.lit(-1))).select(*KEYS, "prompt", "answer")


#: Answers on which the letter model is trained (those of the lowest hash), and their length at most.
SAMPLE, SAMPLE_CHARS = 3000, 20_000


def letter_model(pairs: DataFrame) -> LetterModel:
    """The model of letter triples, from a bounded sample of different answers that is the same each time.

    A first cut by hash leaves about twice as many, so no task sends more than its part of them.
    """
    u = F.pmod(F.xxhash64("answer"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    answers = pairs.where(F.length("answer").between(100, SAMPLE_CHARS)).select("answer", u.alias("u"))
    rate = min(1.0, (2 * SAMPLE + 50) / max(1, answers.count()))
    few = answers.where(F.col("u") < rate).dropDuplicates(["answer"]).orderBy("u", "answer").limit(SAMPLE)
    return LetterModel(r["answer"] for r in few.collect())


def first_look(pairs: DataFrame) -> DataFrame:
    """`(rec_id, side, answer_no, defect, state, word)`: what each pair shows by itself.

    A pair with a defect has it in `defect`; one that may be cut off has `state` and `word`
    for the vocabulary (and in `defect` what it is otherwise). Sound pairs give no row.
    """

    shared = pairs.sparkSession.sparkContext.broadcast(letter_model(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, defects, states, words = [], [], [], []
            for i, (p, t) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                prompt, text = visible(p), visible(t)
                defect, state, word = None, None, None
                if is_empty(text):
                    defect = "empty"
                elif is_refusal(text):
                    defect = "refusal"
                elif prompt and is_copy(prompt, text):
                    defect = "copy"
                else:
                    if prompt and in_other_language(prompt, text, shared.value):
                        defect = "other_language"
                    state, word = cut_state(text)
                    if state == "closed":
                        state = word = None
                if defect or state:
                    keep.append(i)
                    defects.append(defect)
                    states.append(state)
                    words.append(word)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *(pa.array(x, pa.string()) for x in (defects, states, words))], names=[*KEYS, "defect", "state", "word"])

    return pairs.mapInArrow(run, "rec_id string, side string, answer_no int, defect string, state string, word string")


def defective(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """`(rec_id, side, answer_no, defect)`, at most one defect each; `texts(text)` gives the vocabulary.

    A missing text counts as empty. Truncation comes before another language. Pairs
    delivered again count once.
    """
    seen = cut(first_look(pairs))
    plain = seen.where("state is null").select(*KEYS, "defect")
    ends = seen.where("state is not null")
    cuts = judge(ends.select(*KEYS, "state", "word"), vocabulary(texts), KEYS).select(*KEYS, F.lit("truncated").alias("defect"))
    other = ends.where("defect is not null").select(*KEYS, F.col("defect"))
    every = plain.unionByName(cuts).unionByName(other)
    order = F.array_position(F.array(*map(F.lit, ("empty", "refusal", "copy", "truncated", "other_language"))), F.col("defect"))
    return every.groupBy(*KEYS).agg(F.min_by("defect", order).alias("defect"))


def defective_pairs(records: DataFrame, answers: DataFrame) -> DataFrame:
    """The defective pairs of both tables."""
    pairs = raid_pairs(records).unionByName(hc3_pairs(answers))
    return defective(pairs, pairs.select(F.col("answer").alias("text")))


def defects_by_source(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Pairs and defective pairs of each side and defect, over both tables."""
    pairs = raid_pairs(records).unionByName(hc3_pairs(answers))
    sizes = pairs.groupBy(*KEYS).agg(F.lit(1).alias("one")).groupBy("side").agg(F.count("*").alias("pairs"))
    found = defective_pairs(records, answers).groupBy("side", "defect").agg(F.count("*").alias("defective"))
    return found.join(sizes, "side").select("side", "defect", "pairs", "defective", (F.col("defective") / F.col("pairs")).alias("share"))
