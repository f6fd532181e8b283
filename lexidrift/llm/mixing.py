"""Problem 9: combining sources to target weights, with soft membership.

A classifier, fitted on a bounded labelled sample with as many rows of each source, gives
every text a posterior over the sources. Held-out rows of the sample set its temperature
and tell how much of the labels it explains; by that share a text's membership moves from
its stored label to the posterior. Non-negative rates, at most a text's repeat cap, are then
fitted by projected gradient descent from one rate for all, on two sums of squares of equal
weight: token totals by stored label, and expected totals under the memberships, against the
targets. A step only needs the totals of the step before, so each is one aggregation over
the units; rates are stored every few steps.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexidrift.plans.lineage import cut

#: Labelled rows of each source on which the classifier is fitted (those of the lowest hash), one in so many of them held out; feature buckets.
SAMPLE, HELD_OUT, BUCKETS = 400, 4, 1 << 13
#: Temperatures tried; the largest makes all sources alike.
TEMPERATURES = (1, 2, 4, 8, 16, 32, 64, 1024)
#: Step for each of the two sums; steps at most, and how many are replayed before rates are stored.
STEP, STEPS, REPLAYED = 0.45, 200, 12
#: The descent, which looks ahead by its momentum, ends when every share lies this near, or when so many steps better
#: the sum of squares by less than this part.
NEAR, PATIENCE, GAIN = 2e-4, 10, 1e-2
#: Share of the largest mixture that the caps allow, so that rates keep some room.
ROOM = 0.95
TOKENIZER = "byte_bpe_50k.tiktoken"
_WORD = re.compile(r"\w+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed public tokenizer file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def units(documents: DataFrame) -> DataFrame:
    """`(doc_id, source, text)`: each text once, under its smallest doc_id.

    A text that occurs again, under whatever source, is one unit. Null and blank texts
    and rows without a source are left out.
    """
    kept = documents.where(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S")).select("doc_id", "source", "text")
    return kept.groupBy(F.sha2("text", 256).alias("text_key")).agg(F.min(F.struct("doc_id", "source", "text")).alias("d")).select("d.doc_id", "d.source", "d.text")


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        self[word] = b = xxhash.xxh32_intdigest(word) % BUCKETS
        if len(self) > 1_000_000:
            self.clear()
        return b


_BUCKET = _Buckets()


def features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and buckets of their words, each bucket of a text once, in order."""
    words = [set(_WORD.findall(t.lower())) or {""} for t in texts]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    bucket = np.fromiter((_BUCKET[x] for w in words for x in w), dtype=np.int64, count=len(row))
    both = np.unique(row * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


class Classifier:
    """Multinomial naive Bayes over hashed words, with the temperature that held-out rows ask for.

    `trust` is the share of the uncertainty about a held-out label that the posterior takes
    away: 1 for a perfect classifier, 0 for one that knows no more than chance.
    """

    def __init__(self, texts: Sequence[str], labels: Sequence[str], classes: list[str]) -> None:
        self.classes = classes
        at = {c: i for i, c in enumerate(classes)}
        known = np.array([at[x] for x in labels], dtype=np.int64)
        held = np.arange(len(texts)) % HELD_OUT == HELD_OUT - 1
        counts, seen = np.full((len(classes), BUCKETS), 0.5), np.ones(len(classes))
        fitted = [t for t, h in zip(texts, held, strict=True) if not h]
        row, bucket = features(fitted)
        np.add.at(counts, (known[~held][row], bucket), 1)
        seen += np.bincount(known[~held], minlength=len(classes))
        self.weights = (np.log(counts) - np.log(seen + 1)[:, None]).astype(np.float32).T.copy()
        self.temperature, self.trust = float(TEMPERATURES[-1]), 0.0
        checked = [t for t, h in zip(texts, held, strict=True) if h]
        if checked and len(classes) > 1:
            losses = [-np.log(np.maximum(self.posterior(checked, x)[np.arange(len(checked)), known[held]], 1e-12)).mean() for x in TEMPERATURES]
            best = int(np.argmin(losses))
            self.temperature, self.trust = float(TEMPERATURES[best]), max(0.0, 1 - losses[best] / np.log(len(classes)))

    def posterior(self, texts: Sequence[str], temperature: float | None = None) -> np.ndarray:
        """Probabilities of the sources, a row a text; sources count as equally frequent."""
        row, bucket = features(texts)
        score = np.add.reduceat(self.weights[bucket], np.flatnonzero(np.append(True, row[1:] != row[:-1])), axis=0) if len(texts) else np.zeros((0, len(self.classes)))
        score = score / (temperature or self.temperature)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit_classifier(documents: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fitted on the `sample` labelled rows of the lowest hash of each source, so on the same ones each time.

    A first cut by hash leaves about twice as many, so no source is sorted whole.
    """
    rows = documents.where(F.col("source").isNotNull() & F.col("text").rlike(r"\S"))
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Classifier([], [], [])
    rate = F.create_map(*(F.lit(x) for s, n in sizes.items() for x in (s, min(1.0, (2 * sample + 50) / n))))
    u = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = rows.select("source", "text", "doc_id", u.alias("u")).where(F.col("u") < rate[F.col("source")])
    order = Window.partitionBy("source").orderBy("u", "doc_id")
    kept = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).orderBy("u", "doc_id", "text").select("source", "text").collect()
    return Classifier([r["text"] for r in kept], [r["source"] for r in kept], sorted(sizes))


def goals(targets: DataFrame, available: dict[str, int], total: int | None = None) -> tuple[dict[str, float], dict[str, int], int]:
    """Goal share and repeat cap of each available source, and the size of the mixture in tokens.

    Sources without a target get none of it; the targets of sources without documents are
    spread over the others in proportion. Without `total`, the mixture is nearly as large as
    the caps let every goal be met.
    """
    rows = {r["source"]: r for r in targets.collect()}
    wanted = {s: float(r["target_share"]) for s, r in rows.items() if s in available and available[s] and r["target_share"]}
    caps = {s: int(rows[s]["max_repeats"] or 1) if s in rows else 1 for s in available}
    whole = sum(wanted.values())
    shares = {s: w / whole for s, w in wanted.items()} if whole else {}
    fits = min((caps[s] * available[s] / shares[s] for s in shares), default=0)
    return shares, caps, int(ROOM * fits) if total is None else total


def _rates(history: list[tuple[float, np.ndarray, np.ndarray]], rate: np.ndarray, last: np.ndarray, owner: np.ndarray, soft: np.ndarray, caps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`rate`, and the rate before it, after the steps of `history`: each its momentum and the scaled gaps, by label and expected."""
    for momentum, hard_gap, soft_gap in history:
        moved = np.clip(rate + momentum * (rate - last) - STEP * (hard_gap[owner] + soft @ soft_gap), 0, caps[owner])
        rate, last = moved, rate
    return rate, last


def fit_mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Units with their rates, `(doc_id, source, tokens, rate)`, and a row of totals per source.

    An error is raised when the descent has not come to rest after `STEPS` steps.
    """
    model = fit_classifier(documents)
    classes = model.classes
    at = {c: i for i, c in enumerate(classes)}
    known = documents.sparkSession.sparkContext.broadcast(model)
    where = path or tokenizer_path()

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            tokens = [len(x) for x in _encoding(where).encode_ordinary_batch(texts, num_threads=1)]
            soft = known.value.posterior(texts) * known.value.trust
            soft[np.arange(len(texts)), [at[s] for s in batch.column(1).to_pylist()]] += 1 - known.value.trust
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, soft.size + 1, len(classes), dtype=np.int32)), pa.array(soft.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), lists], names=["doc_id", "source", "tokens", "soft"])

    once = units(documents)
    kind = once.schema["doc_id"].dataType.simpleString()
    base = cut(once.mapInArrow(described, f"doc_id {kind}, source string, tokens long, soft array<float>"))
    available = {r["source"]: r["n"] for r in base.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    shares, caps, size = goals(targets, available, total)
    goal = np.array([shares.get(c, 0.0) * size for c in classes])
    have = np.array([max(available.get(c, 0), 1) for c in classes], dtype=float)
    limit = np.array([caps.get(c, 1) if shares.get(c) else 0 for c in classes], dtype=float)
    start = size / max(1, sum(n for s, n in available.items() if shares.get(s)))
    base = base.withColumns({"rate": F.lit(float(start)), "last": F.lit(float(start))})

    def rows_of(batch: pa.RecordBatch, steps: list) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        owner = np.array([at[s] for s in batch.column(1).to_pylist()], dtype=np.int64)
        soft = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(owner), len(classes)).astype(float)
        return owner, soft, _rates(steps, *(np.minimum(batch.column(k).to_numpy(), limit[owner]) for k in (4, 5)), owner, soft, limit)

    def totals(steps: list) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hard, expected = np.zeros(len(classes)), np.zeros(len(classes))
            for batch in batches:
                if batch.num_rows:
                    owner, soft, (rate, _) = rows_of(batch, steps)
                    used = rate * batch.column(2).to_numpy()
                    hard += np.bincount(owner, used, len(classes))
                    expected += used @ soft
            yield pa.RecordBatch.from_arrays([pa.array(range(len(classes)), pa.int32()), pa.array(hard), pa.array(expected)], names=["k", "hard", "expected"])

        hard, expected = np.zeros(len(classes)), np.zeros(len(classes))
        for r in base.mapInArrow(run, "k int, hard double, expected double").groupBy("k").agg(F.sum("hard").alias("hard"), F.sum("expected").alias("expected")).collect():
            hard[r["k"]], expected[r["k"]] = r["hard"], r["expected"]
        return hard, expected

    def moved(steps: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *map(pa.array, rows_of(batch, steps)[2])], names=["doc_id", "source", "tokens", "soft", "rate", "last"])

        return base.mapInArrow(run, f"doc_id {kind}, source string, tokens long, soft array<float>, rate double, last double")

    history: list[tuple[float, np.ndarray, np.ndarray]] = []
    losses: list[float] = []
    earlier, age = None, 1.0
    for step in range(STEPS + 1):
        hard, expected = now = totals(history)
        losses.append(float((((hard - goal) ** 2 + (expected - goal) ** 2) / have).sum()))
        near = max(np.abs(hard - goal).max(initial=0), np.abs(expected - goal).max(initial=0)) <= NEAR * max(size, 1)
        if near or len(losses) > PATIENCE and losses[-1] > (1 - GAIN) * losses[-1 - PATIENCE]:
            break
        if step == STEPS:
            raise RuntimeError(f"the rates did not settle in {STEPS} steps")
        older, age = age, (1 + (1 + 4 * age * age) ** 0.5) / 2
        momentum = (older - 1) / age
        # totals are linear in the rates, so those of the point ahead follow from the last two
        ahead = [x + momentum * (x - y) for x, y in zip(now, earlier or now, strict=True)]
        history.append((momentum, (ahead[0] - goal) / have, (ahead[1] - goal) / have))
        earlier = now
        if len(history) == REPLAYED:
            base, history = cut(moved(history)), []
    fitted = moved(history).select("doc_id", "source", "tokens", "rate")
    report = [{"source": c, "goal_share": shares.get(c, 0.0), "available": int(available.get(c, 0)), "cap": caps.get(c, 1), "expected": float(expected[at[c]]), "labelled_gap": float(hard[at[c]] - goal[at[c]]) / max(size, 1), "expected_gap": float(expected[at[c]] - goal[at[c]]) / max(size, 1), "trust": float(model.trust)} for c in classes]
    return fitted, report


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str | None = None) -> DataFrame:
    """`(doc_id, source, tokens, rate, copies)` of the texts in the mixture, each text once.

    `copies` is the rate, rounded up or down by a hash of the document so that the mean
    stays; it never exceeds the repeat cap of the source.
    """
    fitted, _ = fit_mixture(documents, targets, total, path)
    u = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return fitted.withColumn("copies", copies).where("copies > 0")


def mixture_shares(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str | None = None) -> DataFrame:
    """One row per source of documents or targets: target, goal and actual share, tokens and most copies of a text.

    `labelled_gap` and `expected_gap` are what the fitted totals miss of the goals, as shares
    of the mixture; `trust` is how far memberships follow the classifier.
    """
    fitted, report = fit_mixture(documents, targets, total, path)
    u = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")
    used = fitted.withColumn("copies", copies).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"), F.sum((F.col("copies") > 0).cast("long")).alias("texts"))
    spark = documents.sparkSession
    facts = spark.createDataFrame(report or [], "source string, goal_share double, available long, cap int, expected double, labelled_gap double, expected_gap double, trust double")
    every = targets.select("source", "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"]).join(facts, "source", "full").join(used, "source", "left")
    sums = every.agg(F.sum("used").alias("all_used"), F.sum("expected").alias("all_expected"))
    return every.crossJoin(F.broadcast(sums)).select("source", "target_share", "max_repeats", F.coalesce("goal_share", F.lit(0.0)).alias("goal_share"), F.coalesce("available", F.lit(0)).alias("tokens_available"), F.coalesce("texts", F.lit(0)).alias("texts_used"), F.coalesce("used", F.lit(0)).cast("long").alias("tokens_used"), F.coalesce(F.try_divide("used", "all_used"), F.lit(0.0)).alias("share"), F.coalesce(F.try_divide("expected", "all_expected"), F.lit(0.0)).alias("expected_share"), F.coalesce("most_copies", F.lit(0)).cast("int").alias("most_copies"), "labelled_gap", "expected_gap", "trust")
