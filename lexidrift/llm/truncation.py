"""Problem 6: texts cut off before their end.

A vocabulary of the whole corpus with its trie, both kept as tables (word, and prefix of
a word), says how likely the last word of a text without a closing mark is in either case:
a text cut at any character ends in a word as frequent as it is anywhere, or in a proper
prefix of known words as frequent as those are; a complete text ends in a word as often as
that word closes sentences. Lengths at which more texts stop openly than lengths of complete
texts let expect speak for a cut as well. The share of cut texts among the open ends is
fitted to all of them, apart for each way of ending, so no threshold has to be chosen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexidrift.llm.defects import cut_state, is_copy, is_empty, is_refusal, visible
from lexidrift.plans.lineage import cut

#: A word is known when it occurs so often away from an open end.
KNOWN = 2
#: Texts that weigh as much as what is counted at one length.
PRIOR_TEXTS = 5.0
#: Standard deviations that chance may add to the number of texts suspended after a word.
DEVIATIONS = 3.0
#: Steps of a doubling in which likelihood ratios are tallied to fit the share of cut texts, their bound, and rounds of the fit.
STEPS, BOUND, ROUNDS = 4, 160, 200
_RUN = re.compile(r"[^\s\d.,;:!?…\"“”„«»()\[\]<>{}—–/\\।。！？，、「」《》]+[\"”’»)\]]*[.!?…।\n]?")
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_ENDS = frozenset(".!?…।\n")


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """`(word, n, final, dots)` over all texts: uses of a lower-case word, those that close a
    sentence or line, and the texts that end with it and suspension points.

    The last word of a text that ends with suspension points or without a mark is not in
    `n`: it may be a fragment. Each Arrow batch is counted before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, suspended = [], Counter()
            for t in batch.column(0).to_pylist():
                t = _INVISIBLE.sub("", t or "").rstrip()
                if t.endswith(("…", "...")):
                    t = t.rstrip(".…")
                    cut = max(t.rfind(" "), t.rfind("\n"), 0)
                    suspended[t[cut:].strip().strip("\"'“”„«»()").lower()] += 1
                    t = t[:cut]
                elif t and t[-1] not in ".!?।؟\"”)]":
                    t = t[: max(t.rfind(" "), t.rfind("\n"), 0)]
                if t:
                    parts.append(t)
            counted: dict[str, list[int]] = {}
            for run_, n in Counter(_RUN.findall("\n \n".join(parts).lower())).items():
                word = run_.rstrip("\"”’»)].!?…।\n")
                slot = counted.setdefault(word, [0, 0, 0])
                slot[0] += n
                slot[1] += n * (run_[-1] in _ENDS)
            for word, n in suspended.items():
                counted.setdefault(word, [0, 0, 0])[2] += n
            counted.pop("", None)
            yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), *(pa.array([v[k] for v in counted.values()], pa.int64()) for k in range(3))], names=["word", "n", "final", "dots"])

    parts = texts.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "word string, n long, final long, dots long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("final").alias("final"), F.sum("dots").alias("dots"))


def maybe_open(text: Column) -> Column:
    """Whether `text` may end openly; cheap, and never false for a text that does."""
    return ~F.coalesce(F.rtrim(text), F.lit("")).rlike(r"(?<!\.\.)[.!?。！？।؟]$") | text.rlike(r"[​-‏﻿]\s*$")


def open_ends(rows: DataFrame, keys: Sequence[str], text: str, prompt: str | None) -> DataFrame:
    """`(keys…, state, word)` for rows that may be cut off; copies, refusals and placeholders are none."""
    kept = rows.select(*keys, F.col(text).alias("_text"), (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("_prompt")).where(F.col("_text").isNotNull() & maybe_open(F.col("_text")))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in keys) + ", state string, word string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, state, word = [], [], []
            for i, (t, p) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)):
                s, w = cut_state(t)
                body = visible(t)
                if s == "closed" or is_empty(body) or is_refusal(body) or (p and visible(p) and is_copy(visible(p), body)):
                    continue
                keep.append(i)
                state.append(s)
                word.append(w)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), pa.array(state, pa.string()), pa.array(word, pa.string())], names=[*keys, "state", "word"])

    return kept.mapInArrow(run, ddl)


def word_facts(asked: DataFrame, words: DataFrame) -> DataFrame:
    """`(word, n, longer, ratio)` of the asked words: uses, uses of known words that begin with it, and how much
    likelier the word is at a cut than at the end of a complete text. Without any known word there is no row.

    A cut falls inside a word in proportion to the letters there. What a complete text's
    last word may be beyond those seen to close a sentence follows from the number of
    words that close one only once.
    """
    known = words.where(F.col("n") >= KNOWN)
    sums = known.agg(F.sum("n").alias("uses"), F.sum(F.col("n") * (F.length("word") - 1)).alias("inner"), F.sum("final").alias("closing"), F.sum("dots").alias("suspended"), F.count_if(F.col("final") == 1).alias("once"), F.count("*").alias("types")).where("uses > 0")
    lengths = F.filter(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda i: i < F.length("word"))
    node = F.explode(F.transform(lengths, lambda i: F.col("word").substr(F.lit(1), i))).alias("word")
    trie = known.select(node, "n").join(asked, "word").groupBy("word").agg(F.sum("n").alias("longer"))
    told = asked.join(known, "word", "left").join(trie, "word", "left").na.fill(0, ["n", "final", "dots", "longer"]).crossJoin(F.broadcast(sums))
    whole = (F.col("n") + 1) / (F.col("uses") + F.col("types"))
    inside = F.col("longer") / F.greatest(F.col("inner"), F.lit(1))
    within = F.col("inner") / (F.col("inner") + 2 * F.col("uses"))
    cut_here = (1 - within) * whole + within * inside
    unseen = F.col("once") + 1
    closes = (F.col("final") + unseen * whole) / (F.col("closing") + unseen)
    # before suspension points also words that other texts suspend more often than cuts (and chance) would
    expected = cut_here * F.col("suspended")
    suspends = F.greatest(F.col("dots") - 1 - expected - DEVIATIONS * F.sqrt(expected), F.lit(0)) / F.greatest(F.col("suspended"), F.lit(1))
    return told.select("word", "n", "longer", (cut_here / closes).alias("ratio"), (cut_here / F.greatest(closes, suspends)).alias("dots_ratio"))


def judge(ends: DataFrame, words: DataFrame, keys: Sequence[str], lengths: DataFrame | None = None) -> DataFrame:
    """`(keys…, evidence)` of the open ends that are cuts.

    `inside_word`: the last word is no known one and a proper prefix of known words (found by
    joining on the trie's nodes); `inside_sentence`: the text stops where no sentence does;
    `inside_character`, `mark` and `delimiter` speak for themselves. `lengths(length, ratio)`
    tells how much likelier a length is for a cut text; `keys` then hold `length`. Where the
    vocabulary is empty nothing speaks for a cut. To the driver come tallies of bounded size.
    """
    ends, words = cut(ends), cut(words)
    facts = word_facts(ends.where("state <> 'cut'").select("word").distinct(), words)
    told = ends.join(facts, "word", "left")
    ratio = F.when(F.col("state") == "dots", F.col("dots_ratio")).otherwise(F.col("ratio"))
    if lengths is not None:
        told = told.join(lengths.withColumnRenamed("ratio", "length_ratio"), "length", "left")
        ratio = ratio * F.coalesce("length_ratio", F.lit(1.0))
    step = F.when(ratio.isNotNull(), F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.round(F.log2(ratio) * STEPS)))).cast("int")
    told = cut(told.select(*keys, "state", "word", "n", "longer", step.alias("step")))
    tally: dict[str, dict[int, int]] = {}
    for r in told.where("state <> 'cut' and step is not null").groupBy("state", "step").count().collect():
        tally.setdefault(r["state"], {})[r["step"]] = r["count"]
    limits = {state: _least_step(counts) for state, counts in tally.items()}
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("state")] if limits else F.lit(None).cast("int")
    fragment = (F.col("n") < KNOWN) & (F.col("longer") > 0)
    evidence = F.when(F.col("state") == "cut", F.col("word")).when(F.col("step") >= limit, F.when(fragment, "inside_word").otherwise("inside_sentence"))
    return told.select(*keys, evidence.alias("evidence")).where("evidence is not null")


def _least_step(counts: dict[int, int]) -> int:
    """The least tallied ratio at which a text is more likely cut than complete, for the share of cut texts that fits best.

    Expectation and maximisation over the tally; one text of each kind is taken for granted.
    """
    step = np.array(sorted(counts), dtype=float)
    n = np.array([counts[int(s)] for s in step], dtype=float)
    ratio = 2.0 ** (step / STEPS)
    share = 0.5
    for _ in range(ROUNDS):
        cuts = float((n * share * ratio / (share * ratio + 1 - share)).sum())
        share = (cuts + 1) / (n.sum() + 2)
    good = step[share * ratio > 1 - share]
    return int(good.min()) if len(good) else BOUND + 1


def length_ratios(records: DataFrame, ends: DataFrame, text: str) -> DataFrame:
    """`(length, ratio)`: open ends at a length against what the lengths of all other texts let expect."""
    closed = cut(records.where(~maybe_open(F.col(text))).groupBy(F.length(text).alias("length")).agg(F.count("*").alias("closed")))
    opened = ends.groupBy("length").agg(F.count("*").alias("opened"))
    sums = closed.agg(F.sum("closed").alias("c")).crossJoin(opened.agg(F.sum("opened").alias("o")))
    at = opened.join(closed, "length", "left").crossJoin(F.broadcast(sums))
    expected = F.coalesce("closed", F.lit(0)) * F.col("o") / F.greatest(F.coalesce("c", F.lit(0)), F.lit(1))
    return at.select("length", ((F.col("opened") + PRIOR_TEXTS) / (expected + PRIOR_TEXTS)).alias("ratio"))


def truncated(records: DataFrame) -> DataFrame:
    """`(id, evidence, length)` of the records whose generation was cut off, each id once."""
    rows = records.select("id", "generation", "prompt").where("id is not null").withColumn("length", F.length("generation"))
    ends = cut(open_ends(rows, ["id", "length"], "generation", "prompt").dropDuplicates(["id", "length"]))
    cuts = judge(ends, vocabulary(records, "generation"), ["id", "length"], length_ratios(records, ends, "generation"))
    return cuts.groupBy("id").agg(F.min("evidence").alias("evidence"), F.min("length").alias("length"))


def truncation_by_model(records: DataFrame) -> DataFrame:
    """Share of cut-off records by tidied model, with the most frequent length of the cut ones."""
    model = F.coalesce(F.regexp_replace(F.lower(F.trim("model")), r"[\s_]+", "-"), F.lit("unknown"))
    cuts = truncated(records)
    whole = records.where("id is not null").groupBy("id").agg(F.min(model).alias("model")).join(cuts, "id", "left")
    lengths = whole.where("length is not null").groupBy("model", "length").agg(F.count("*").alias("at")).groupBy("model").agg(F.max(F.struct("at", "length")).alias("top"))
    shares = whole.groupBy("model").agg(F.count("*").alias("records"), F.count("length").alias("truncated"), F.sum((F.col("evidence") == "inside_word").cast("long")).alias("inside_word"))
    return shares.join(lengths, "model", "left").select("model", "records", "truncated", (F.col("truncated") / F.col("records")).alias("share"), F.coalesce("inside_word", F.lit(0)).alias("inside_word"), F.col("top.length").alias("usual_length"), F.coalesce("top.at", F.lit(0)).alias("at_usual_length"))
