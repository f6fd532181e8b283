"""Text segmentation, tokens, n-grams and skeletons as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexidrift.functions import constants as K

_STRINGS = "array<string>"


def _lit_array(values) -> Column:
    return F.array(*map(F.lit, values))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def fold_apostrophes(text: Column) -> Column:
    """Typographic single quotes become straight ones."""
    return F.translate(text, "’‘", "''")


def strip_space(text: Column) -> Column:
    """`text` without white space, in the Unicode sense, at either end."""
    return F.regexp_replace(F.regexp_replace(text, f"^{K.SPACE}+", ""), f"{K.SPACE}+$", "")


def collapse_space(text: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{K.SPACE}+", " "))


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, white space collapsed, blank ones dropped; empty for null."""
    parts = F.split(F.coalesce(text, F.lit("")), K.PARAGRAPH_BOUNDARY, -1)
    return F.filter(F.transform(parts, collapse_space), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Sentences of a paragraph; closing quotes and brackets at a boundary are dropped."""
    parts = F.split(collapse_space(F.coalesce(text, F.lit(""))), K.SENTENCE_BOUNDARY, -1)
    return F.filter(F.transform(parts, strip_space), lambda s: s != "")


def document_sentences(text: Column) -> Column:
    """An array of paragraphs, each an array of sentences."""
    return F.transform(paragraphs(text), sentences)


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters (one inner apostrophe) and numerals."""
    return F.regexp_extract_all(F.lower(fold_apostrophes(text)), F.lit(K.TOKEN), F.lit(0))


def windows(items: Column, n: int) -> Column:
    """All runs of `n` items; none when n is not positive or the list is shorter."""
    if n <= 0:
        return F.array().cast("array<array<string>>")
    every = bound(items, lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - F.lit(n - 1)), lambda i: F.slice(x, i, n)))
    return F.when(F.size(items) >= n, every).otherwise(F.array().cast("array<array<string>>"))


def ngrams(text: Column, lo: int = K.MIN_N, hi: int = K.MAX_N, every: bool = False) -> Column:
    """N-grams of `text` as strings, repeats kept; with `every`, those of function words or digits only too.

    Function words and digits are marked once, a byte a token; an n-gram is tested on its bytes.
    """
    none = F.array().cast(_STRINGS)

    def of(items: Column) -> Column:
        def grams(marked: Column) -> Column:
            def at(i: Column) -> Column:
                def lexical(n: Column) -> Column:
                    part = F.substring(marked, i, n).cast("string")
                    return (F.translate(part, "f", "") != "") & (F.translate(part, "d", "") != "")

                lengths = F.sequence(F.lit(lo), F.least(F.lit(hi), F.size(items) - i + 1))
                return F.transform(lengths if every else F.filter(lengths, lexical), lambda n: F.array_join(F.slice(items, i, n), " "))

            return F.flatten(F.transform(F.sequence(F.lit(1), F.size(items) - (lo - 1)), at))

        marks = F.transform(items, lambda t: F.when(t.isin(*K.FUNCTION_WORDS), "f").when(t.rlike(r"^\p{Nd}+$"), "d").otherwise("."))
        return F.when(F.size(items) >= lo, bound(F.encode(F.array_join(marks, ""), "us-ascii"), grams)).otherwise(none)

    return bound(tokens(text), of)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda xs: None if xs is None else [x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in xs])


def nfkc_all(texts: Column) -> Column:
    """The same for every text of an array."""
    return _nfkc_all(texts)


def nfkc(text: Column) -> Column:
    """Compatibility normalisation; Spark has no expression for it."""
    return _nfkc(text)


def structural_tokens(text: Column) -> Column:
    """Words, numerals and kept punctuation of NFKC text, in lower case."""
    return F.regexp_extract_all(F.lower(fold_apostrophes(text)), F.lit(K.STRUCTURAL_TOKEN), F.lit(0))


def expand_negatives(items: Column) -> Column:
    """Negative contractions as two tokens; ambiguous ones stay."""
    table = F.create_map(*(c for k, v in K.CONTRACTIONS.items() for c in (F.lit(k), _lit_array(v))))
    return F.flatten(F.transform(items, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t))))


def is_anchor(token: Column) -> Column:
    """Whether a skeleton keeps the word; punctuation is no anchor."""
    return token.isin(*K.ANCHORS)


def collapse_slots(items: Column) -> Column:
    """Runs of the same slot become one; different slots side by side stay."""
    return bound(items, lambda x: F.filter(x, lambda t, i: ~(t.isin(K.SLOT, K.NUMBER_SLOT) & (i > 0) & (t == F.get(x, i - 1)))))


def skeleton(normalised: Column) -> Column:
    """Skeleton tokens of text already in NFKC: anchors and punctuation stay, the rest becomes slots."""
    mapped = F.transform(
        expand_negatives(structural_tokens(normalised)),
        lambda t: F.when(t.isin(*K.PUNCTUATION), t).when(t.rlike(r"^\p{Nd}"), F.lit(K.NUMBER_SLOT)).when(is_anchor(t), t).otherwise(F.lit(K.SLOT)),
    )
    return collapse_slots(mapped)


def spans(items: Column, boundary: Column | None = None) -> Column:
    """All qualifying spans of a skeleton, joined by blanks; with `boundary`, only those that cross it.

    Slots and anchors are marked once, a byte a token; a span is tested on its bytes, and
    only those that qualify are joined.
    """
    none = F.array().cast(_STRINGS)

    def of(tokens_: Column) -> Column:
        def marked_spans(marked: Column) -> Column:
            def from_start(i: Column) -> Column:
                def good(n: Column) -> Column:
                    part = F.substring(marked, i, n).cast("string")
                    crossing = F.lit(True) if boundary is None else (i - 1 < boundary) & (boundary < i + n - 1)
                    return crossing & F.length(F.translate(part, "a.", "")).between(K.MIN_SLOTS, K.MAX_SLOTS) & (F.length(F.translate(part, "x.", "")) >= K.MIN_ANCHORS)

                lengths = F.sequence(F.lit(K.MIN_SPAN), F.least(F.lit(K.MAX_SPAN), F.size(tokens_) - i + 1))
                return F.transform(F.filter(lengths, good), lambda n: F.array_join(F.slice(tokens_, i, n), " "))

            # a span that crosses the boundary starts near it
            first, last = F.lit(1), F.size(tokens_) - (K.MIN_SPAN - 1)
            if boundary is not None:
                first, last = F.greatest(first, boundary - (K.MAX_SPAN - 2)), F.least(last, boundary)
            return F.flatten(F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), from_start))

        marks = F.transform(tokens_, lambda t: F.when(t.isin(K.SLOT, K.NUMBER_SLOT), "x").when(is_anchor(t), "a").otherwise("."))
        return F.when(F.size(tokens_) >= K.MIN_SPAN, bound(F.encode(F.array_join(marks, ""), "us-ascii"), marked_spans)).otherwise(none)

    return bound(items, of)


def tallied(values: Column) -> Column:
    """Array of `(pattern, n)`: the different strings of an array and their numbers, by sorting it."""

    def runs(ordered: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == F.size(ordered)) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return bound(ends, lambda e: F.transform(e, lambda at, k: F.struct(F.get(ordered, at - 1).alias("pattern"), (at - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("long").alias("n"))))

    none = F.array().cast("array<struct<pattern:string,n:bigint>>")
    return F.when(F.size(values) > 0, bound(F.sort_array(values), runs)).otherwise(none)
