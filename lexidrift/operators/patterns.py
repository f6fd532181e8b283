"""Patterns of documents: n-grams, rhetorical frames, sentence skeletons, and their exposure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexidrift.functions import constants as K
from lexidrift.functions import text as T
from lexidrift.functions.metrics import denominator, ratio
from lexidrift.plans.lineage import cut


def segmented(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with `paras`, an array of paragraphs of sentences, instead of its text.

    Null, empty and blank texts have no paragraph. The column is computed once, before
    anything explodes it. Documents that have `paras` already stay as they are.
    """
    if "paras" in documents.columns:
        return documents
    return documents.withColumn("paras", T.document_sentences(F.col(text))).drop(text)


def _parts(documents: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """`(keys…, paras)`; nothing else of the documents is carried on."""
    return segmented(documents.select(*keys, "paras" if "paras" in documents.columns else text), text)


def sentence_rows(documents: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """`(keys…, para_idx, sent_idx, sentence)`, counted from 0."""
    paras = _parts(documents, keys, text).select(*keys, F.posexplode("paras").alias("para_idx", "sents"))
    return paras.select(*keys, "para_idx", F.posexplode("sents").alias("sent_idx", "sentence"))


def adjacent_pairs(documents: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """`(keys…, para_idx, sent_idx, first, second)`: neighbours within a paragraph, by array position."""
    paras = _parts(documents, keys, text).select(*keys, F.posexplode("paras").alias("para_idx", "sents"))
    pairs = F.transform(F.filter("sents", lambda s, i: i > 0), lambda s, i: F.struct(F.get("sents", i).alias("first"), s.alias("second")))
    return paras.select(*keys, "para_idx", F.posexplode(pairs).alias("sent_idx", "p")).select(*keys, "para_idx", "sent_idx", "p.first", "p.second")


def exposure(documents: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Documents, paragraphs, sentences, neighbouring pairs and tokens of each group.

    Documents without a sentence count as documents.
    """
    sized = _parts(documents, by, text).select(
        *by,
        F.size("paras").alias("p"),
        F.aggregate("paras", F.lit(0), lambda a, x: a + F.size(x)).alias("s"),
        F.aggregate("paras", F.lit(0), lambda a, x: a + F.greatest(F.lit(0), F.size(x) - 1)).alias("pairs"),
        F.aggregate("paras", F.lit(0), lambda a, x: a + F.aggregate(x, F.lit(0), lambda b, y: b + F.size(T.tokens(y)))).alias("t"),
    )
    return sized.groupBy(*by).agg(F.count("*").alias("documents"), F.sum("p").alias("paragraphs"), F.sum("s").alias("sentences"), F.sum("pairs").alias("adjacent_pairs"), F.sum("t").alias("tokens"))


def ngram_rows(documents: DataFrame, keys: Sequence[str], text: str = "text", lo: int = K.MIN_N, hi: int = K.MAX_N) -> DataFrame:
    """`(keys…, pattern, n)`: n-grams of each document, never across sentences, with their number in it.

    A document is one row, so its n-grams are counted within the row and nothing is shuffled.
    """
    grams = F.flatten(F.transform(F.flatten("paras"), lambda s: T.ngrams(s, lo, hi)))
    return _parts(documents, keys, text).select(*keys, F.explode(T.tallied(grams)).alias("p")).select(*keys, "p.pattern", "p.n")


def pattern_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """`(by…, occurrences, documents_with)` from rows with one document's count `n` each."""
    return rows.groupBy(*by).agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents_with"))


# ---- rhetorical frames -------------------------------------------------------------


def units(sents: Column) -> Column:
    """What frames are looked for in: each sentence, then each pair of neighbours, with its offset in the paragraph."""

    def of(x: Column) -> Column:
        # a running sum: the array grows by one offset a sentence
        def offsets(upto: Column) -> Column:
            single = F.transform(x, lambda s, i: F.struct(s.alias("unit"), F.get(upto, i).alias("at")))
            pairs = F.transform(F.filter(x, lambda s, i: i > 0), lambda s, i: F.struct(F.concat(F.get(x, i), F.lit(" "), s).alias("unit"), F.get(upto, i).alias("at")))
            return F.concat(single, pairs)

        return T.bound(F.aggregate(x, F.array(F.lit(0)), lambda a, s: F.array_append(a, F.element_at(a, -1) + F.length(s) + 1)), offsets)

    return T.bound(sents, of)


def frame_spans(unit: Column, at: Column, pattern: str) -> Column:
    """Array of `(start, end)` of a frame's matches, from the gaps between them and their lengths."""
    java = "(?iU)" + pattern

    def of(found: Column, gaps: Column) -> Column:
        # ends of the matches so far, each after the gap before it
        ends = F.aggregate(found, F.array().cast("array<int>"), lambda a, m: F.array_append(a, F.coalesce(F.element_at(F.concat(F.array(at), a), -1), at) + F.length(F.get(gaps, F.size(a))) + F.length(m)))
        return T.bound(ends, lambda e: F.transform(found, lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"))))

    none = F.array().cast("array<struct<start:int,end:int>>")
    matches = F.regexp_extract_all(unit, F.lit(java), F.lit(0))
    # most units hold no frame, so the gaps are cut only where there is one
    return T.bound(matches, lambda found: F.when(F.size(found) > 0, T.bound(F.split(unit, java, -1), lambda gaps: of(found, gaps))).otherwise(none))


def kept_spans(spans: Column) -> Column:
    """How many spans remain when, from the left and the longest first, overlapping ones are dropped."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"))))
    fold = F.aggregate(
        order,
        F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")),
        lambda a, s: F.when(s["start"] >= a["last"], F.struct((-s["back"]).alias("last"), (a["n"] + 1).alias("n"))).otherwise(a),
    )
    return fold["n"]


def frame_rows(documents: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """`(keys…, kind, pattern, n)`: frames of each document; one seen in a sentence and in a pair counts once."""
    paras = _parts(documents, keys, text).select(*keys, F.explode("paras").alias("sents")).select(*keys, units(F.transform("sents", T.fold_apostrophes)).alias("units"))

    def found(pattern: str) -> Column:
        return kept_spans(F.flatten(F.transform("units", lambda u: frame_spans(u["unit"], u["at"], pattern))))

    counts = [F.struct(F.lit(kind).alias("kind"), F.lit(template).alias("pattern"), found(pattern).alias("n")) for kind, pattern, template in K.FRAMES]
    rows = paras.select(*keys, F.explode(F.array(*counts)).alias("f")).select(*keys, "f.kind", "f.pattern", "f.n").where("n > 0")
    return rows.groupBy(*keys, "kind", "pattern").agg(F.sum("n").alias("n"))


def all_patterns(documents: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """`(keys…, kind, pattern, n)`: n-grams and frames of each document."""
    return ngram_rows(documents, keys, text).select(*keys, F.lit(K.NGRAM).alias("kind"), "pattern", "n").unionByName(frame_rows(documents, keys, text).select(*keys, "kind", "pattern", F.col("n").cast("long").alias("n")))


# ---- skeletons ---------------------------------------------------------------------


def skeleton_rows(documents: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """`(keys…, para_idx, sent_idx, skel, next)`: skeleton tokens of each sentence and of its right neighbour.

    Sentences are cut first and normalised then, as normalising may create new tokens.
    Neighbours come from their places in the paragraph's array, so nothing is shuffled.
    """
    paras = _parts(documents, keys, text).select(*keys, F.posexplode("paras").alias("para_idx", "sents"))
    normal = paras.select(*keys, "para_idx", T.nfkc_all(F.col("sents")).alias("sents"))
    skels = normal.select(*keys, "para_idx", F.transform("sents", T.skeleton).alias("skels"))
    placed = F.transform("skels", lambda s, i: F.struct(s.alias("skel"), F.get("skels", i + 1).alias("next")))
    return skels.select(*keys, "para_idx", F.posexplode(placed).alias("sent_idx", "s")).select(*keys, "para_idx", "sent_idx", "s.skel", "s.next")


def skeleton_counts(documents: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """`(keys…, kind, pattern, n)`: spans within sentences and spans that cross a boundary, by document.

    The sentences of a pair are skeletonised each by itself, so slots never merge across
    their boundary; an empty left skeleton crosses nothing. A document is one row, so its
    spans are counted within the row, with one letter before each that tells the family.
    """
    last = F.flatten(F.transform("paras", lambda p: F.transform(p, lambda s, i: i + 1 == F.size(p))))
    rows = _parts(documents, keys, text).select(*keys, last.alias("last"), T.nfkc_all(F.flatten("paras")).alias("sents"))
    rows = rows.select(*keys, "last", F.transform("sents", T.skeleton).alias("skels"))

    def of(skel: Column, i: Column) -> Column:
        within = F.transform(T.spans(skel), lambda p: F.concat(F.lit("w"), p))
        right = F.get("skels", i + 1)
        cross = F.when(~F.get("last", i) & (F.size(skel) > 0), F.transform(T.spans(F.concat(skel, right), F.size(skel)), lambda p: F.concat(F.lit("c"), p))).otherwise(F.array().cast("array<string>"))
        return F.concat(within, cross)

    tallied = rows.select(*keys, F.explode(T.tallied(F.flatten(F.transform("skels", of)))).alias("s"))
    kind = F.when(F.substring("s.pattern", 1, 1) == "w", K.WITHIN).otherwise(K.CROSS)
    return tallied.select(*keys, kind.alias("kind"), F.expr("substring(s.pattern, 2)").alias("pattern"), "s.n")


def structural_rates(documents: DataFrame, by: Sequence[str], key: str, text: str = "text") -> DataFrame:
    """`(by…, kind, pattern, occurrences, documents_with, per_10k, combined_per_10k, doc_prevalence)` of skeletons.

    Each family is counted against its own exposure; the combined rate against both.
    """
    documents = cut(_parts(documents, [*by, key], text))
    counts = pattern_counts(skeleton_counts(documents, [*by, key], text), [*by, "kind", "pattern"])
    seen = exposure(documents, by, text).select(*by, "documents", "sentences", "adjacent_pairs")
    joined = counts.join(seen, list(by))
    units_ = denominator(F.col("kind"), F.col("sentences"), F.col("adjacent_pairs"))
    return joined.select(*by, "kind", "pattern", "occurrences", "documents_with", (ratio(F.col("occurrences"), units_) * 10_000).alias("per_10k"), (ratio(F.col("occurrences"), F.col("sentences") + F.col("adjacent_pairs")) * 10_000).alias("combined_per_10k"), ratio(F.col("documents_with"), F.col("documents")).alias("doc_prevalence"))


def skeleton_types(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """`(by…, kind, types, occurrences)`: distinct skeletons and their occurrences, from `structural_rates`."""
    return rows.groupBy(*by, "kind").agg(F.count("*").alias("types"), F.sum("occurrences").alias("occurrences"))


def ranked_families(rows: DataFrame, by: Sequence[str], top: int) -> DataFrame:
    """The `top` most frequent skeletons of each family with their `rank`; the families are never in one ranking."""
    order = Window.partitionBy(*by, "kind").orderBy(F.desc("occurrences"), "pattern")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def document_patterns(documents: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """`(keys…, kind, pattern, n)`: n-grams and skeletons of each document."""
    return ngram_rows(documents, keys, text).select(*keys, F.lit(K.NGRAM).alias("kind"), "pattern", "n").unionByName(skeleton_counts(documents, keys, text))
