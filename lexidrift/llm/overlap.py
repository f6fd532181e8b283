"""Problem 4: records of evaluation splits whose text also stands in the training split.

Texts are reduced to comparable words. Identical reductions form one class, numbered by
its hash. Classes get a minwise signature of their bag of words in which rare words weigh
more, as the corpus counts them; bands of it are joined between the two sides only, so no
pair inside a side ever arises, and a sketch of the signature drops most chance hits inside
the join. What is left goes, without the texts, to the tiles of a grid of both sides, where
one byte a word bounds the words in common and then their longest common subsequence.
Every pair that remains is verified exactly on its texts. Pairs of classes are expanded to
records only where a query asks for it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexidrift.llm.repetition import letter_table
from lexidrift.llm.screen import bits_for, passes, screen
from lexidrift.plans.lineage import cut

#: Words of a shingle of the reported similarity.
SHINGLE = 5
#: Bands, and minima of a band. Agreement a means a similarity of the bags of words of a / (2 - a): at 0.70 a band
#: is shared with probability 0.15, so that of 24 bands at least one is in 98 of 100 pairs.
BANDS, ROWS = 24, 3
#: Minima of the signature, each with one bit in the sketch, and standard deviations by which a true pair's sketch may fall short.
SKETCH, SLACK = 117, 2.2
#: Steps of a factor e in which a text's length stands beside its sketch.
STEPS = 50
#: Buckets of word hashes in which the corpus counts words, so a table of fixed size holds the weights.
COUNTERS = 1 << 18
#: Uses below which a word counts as having so many.
SELDOM = 8
#: Texts whose minima are taken together, so that they stay in the cache.
AT_A_TIME = 1000
#: Texts of a side in one tile of the grid at most; a byte a word, so some ten megabytes.
TILE = 50_000
MIN_LETTERS = 300
MIN_AGREEMENT = 0.70

# Letters of other scripts that look like Latin ones, and what they look like.
_LOOKALIKES = ("аеорсухіјѕԁһӏԛԝкмтвнгпиԍьАВЕКМНОРСТУХІЈЅԌ" "αεορυχικντηρβγωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ıȷɡɑʟ", "aeopcyxijsdhlqwkmtbhrnngbABEKMHOPCTYXIJSG" "aeopuxikvtnpbywABEZHIKMNOPTYX" "ijgal")
_SAME = {ord(a): b.lower() for a, b in zip(*_LOOKALIKES, strict=True)}
_DROP = dict.fromkeys([*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, 0xAD, 0x34F, 0x27, 0x2019, 0x2018, 0x2BC, 0x60, 0xB4])
_DROP_CHARACTERS = [chr(c) for c in _DROP]
# the ranges of `_TOKEN`: characters that are words, and what is in words besides letters and digits
_UNSPACED = ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0x0E00, 0x0E7F))
_MARKS = ((0x0300, 0x065F), (0x0900, 0x0DFF))
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|(?:[^\W_぀-ヿ㐀-鿿฀-๿]|[̀-ًͯ-ٟऀ-෿])+")
_DROPPED = re.compile("[" + "".join(map(re.escape, map(chr, _DROP))) + "]+")
_ALIKE = re.compile("[" + "".join(map(re.escape, map(chr, _SAME))) + "]")
#: ASCII letters and digits in lower case, blanks for the rest.
_ASCII_FOLD = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def _ascii_words(text: str) -> list[str]:
    return text.encode().translate(_ASCII_FOLD, b"'`").decode().split()


def comparable_words(text: str) -> list[str]:
    """Words without case, spacing, punctuation, invisible characters and look-alike letters.

    Characters stand for words where a script sets no blanks.
    """
    if text.isascii():
        return _ascii_words(text)
    folded = _DROPPED.sub("", text)
    if not unicodedata.is_normalized("NFKC", folded):
        folded = _DROPPED.sub("", unicodedata.normalize("NFKC", folded))
    folded = folded.casefold()
    return _TOKEN.findall(folded.translate(_SAME) if _ALIKE.search(folded) else folded)


@lru_cache(1)
def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point what it looks like, a blank if it is in no word; and whether it is a word of its own."""
    points = np.arange(0x110000, dtype=np.uint32)
    held = np.zeros(0x110000, dtype=bool)
    held[:0x40000] = [chr(c).isalnum() for c in range(0x40000)]  # none beyond
    for lo, hi in _MARKS:
        held[lo : hi + 1] = True
    alone = np.zeros(0x110000, dtype=bool)
    for lo, hi in _UNSPACED:
        alone[lo : hi + 1] = True
    looks = np.where(held | alone, points, np.uint32(32))
    for c, like in _SAME.items():
        looks[c] = ord(like)
    return looks, alone


#: Characters of texts outside ASCII that are looked up together.
LOOKED_UP = 1 << 20


def all_comparable_words(texts: list[str]) -> list[list[str]]:
    """`comparable_words` of each text; those outside ASCII are looked up by character, many texts at once."""
    out = [_ascii_words(text) if text.isascii() else [] for text in texts]
    others = [i for i, text in enumerate(texts) if not text.isascii()]
    if not others:
        return out
    looks, alone = _character_tables()
    at = 0
    while at < len(others):
        some, folds, size = [], [], 0
        while at < len(others) and size < LOOKED_UP:
            folded = texts[others[at]]
            for c in _DROP_CHARACTERS:
                folded = folded.replace(c, "")
            if not unicodedata.is_normalized("NFKC", folded):
                folded = _DROPPED.sub("", unicodedata.normalize("NFKC", folded))
            some.append(others[at])
            folds.append(folded.casefold())
            size += len(folds[-1])
            at += 1
        points = np.frombuffer("".join(folds).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(np.array([len(x) for x in folds]))
        # a character that is a word gets blanks around it
        single = np.flatnonzero(alone[points])
        spaced = np.insert(looks[points], np.concatenate([single, single + 1]), np.uint32(32)) if len(single) else looks[points]
        ends = ends + 2 * np.searchsorted(single, ends, side="left")
        begin = 0
        for i, end in zip(some, ends.tolist(), strict=True):
            out[i] = spaced[begin:end].tobytes().decode("utf-32-le", "surrogatepass").split()
            begin = end
    return out


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        if len(self) > 1_000_000:
            self.clear()
        return h


_WORDS = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` words of a stream of word hashes."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return out


def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _numbered(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of words with the number of their occurrence in the text, so that sets of them are bags of words."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((words, owner))
    w, o = words[order], owner[order]
    first = np.ones(len(w), dtype=bool)
    first[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    at = np.arange(len(w))
    rank = np.empty(len(w), dtype=np.uint64)
    rank[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return _mixed(words + rank * np.uint64(0x9E3779B97F4A7C15))


#: Bits of the sketch in the number that also holds the length.
_LOW = SKETCH - 64


def unlike(marks: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many bits the sketches differ, row by row."""
    return np.bitwise_count((marks[:, 0] ^ others[:, 0]) & np.uint64((1 << _LOW) - 1)).astype(int) + np.bitwise_count(marks[:, 1] ^ others[:, 1])


def word_weights(uses: np.ndarray, texts: int) -> np.ndarray:
    """Weight of each bucket of words: the root of one, and one more for each halving of its uses below one a text.

    Below `SELDOM` uses all weigh the same, so what only a few copies share weighs no less than what one of them changed.
    The root keeps rare words from outweighing all else, as they may be what a copy exchanged.
    """
    return np.sqrt(np.floor(np.log2(np.maximum(texts // np.maximum(uses, SELDOM), 1) + 0.5)) + 1)


def word_codes(uses: np.ndarray) -> np.ndarray:
    """A byte for each bucket of words, dealt round by rank of use, so that the frequent ones have bytes of their own."""
    out = np.empty(len(uses), dtype=np.uint8)
    out[np.argsort(-uses, kind="stable")] = np.arange(len(uses)) % 256
    return out


def signatures(counts: np.ndarray, words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and marks of each text, a row each; `counts` words of each, one after another in `words`.

    Two numbers mark a text: they hold the sketch and, above its first `_LOW` bits, the length in steps. A minimum is taken of hashes
    divided by their word's weight, so two texts share it in proportion to the weight of
    what they share.
    """
    with np.errstate(over="ignore"):
        starts = np.cumsum(counts) - counts
        single = _numbered(counts, words)
        scale = 1.0 / weights[(words & np.uint64(COUNTERS - 1)).astype(np.int64)]
        minima = np.empty((SKETCH, len(counts)), dtype=np.uint64)
        drawn, scaled = np.empty_like(single), np.empty(len(single))
        for k, f in enumerate(_factors(SKETCH, 20240229)):
            np.multiply(single, f, out=drawn)
            np.right_shift(drawn, np.uint64(11), out=drawn)
            np.multiply(drawn.view(np.int64), scale, out=scaled)
            minima[k] = np.minimum.reduceat(scaled, starts).view(np.uint64)
        minima = _mixed(minima)
        bands = np.empty((len(counts), BANDS), dtype=np.uint32)
        for b in range(BANDS):  # no minimum is in two bands
            key = np.uint64(b + 1)
            for k in range(b * ROWS, (b + 1) * ROWS):
                key = _mixed(key * np.uint64(0x2545F4914F6CDD1D) + minima[k])
            bands[:, b] = key >> np.uint64(32)
        marks = np.zeros((len(counts), 2), dtype=np.uint64)
        marks[:, 0] = np.floor(np.log(np.maximum(counts, 1)) * STEPS).astype(np.uint64) << np.uint64(_LOW)
        for k in range(SKETCH):
            word, bit = (0, k) if k < _LOW else (1, k - _LOW)
            marks[:, word] |= (minima[k] >> np.uint64(63)) << np.uint64(bit)
    return bands, marks


def most_unlike(least: float) -> int:
    """Bits in which the sketches of two texts with that agreement differ at most, almost surely."""
    p = (1 - least / (2 - least)) / 2
    return int(SKETCH * p + SLACK * (SKETCH * p * (1 - p)) ** 0.5)


def _number(cls: Column) -> Column:
    """The number of a class: the first 64 bits of its hash."""
    return F.conv(F.hex(F.substring(cls, 1, 8)), 16, -10).cast("long")


def _reduced(records: DataFrame) -> DataFrame:
    split = F.lower(F.trim("split_name"))
    return records.where(F.col("id").isNotNull() & split.isin("train", "validation", "test") & (F.length("generation") >= MIN_LETTERS)).select("id", (split != "train").alias("evaluation"), "generation")


def _letters(texts: list[str]) -> np.ndarray:
    """Letters and digits of each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([0, *map(len, texts)])
    counted = np.concatenate([[0], np.cumsum(letter_table()[points] != 0)])
    return counted[ends[1:]] - counted[ends[:-1]]


def _stream(texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of the texts with enough letters their places, numbers of words, and hashes of all words."""
    keep, counts, stream = [], [], []
    others = [i for i, text in enumerate(texts) if not text.isascii()]
    enough = dict(zip(others, _letters([texts[i] for i in others]) >= MIN_LETTERS, strict=True))
    for i, found in enumerate(all_comparable_words(texts)):
        words = found or [""] if enough.get(i, True) else []
        # words of ASCII texts hold all their letters
        if not words or i not in enough and len("".join(words)) < MIN_LETTERS:
            continue
        keep.append(i)
        counts.append(len(words))
        stream.extend(words)
    return keep, np.array(counts, dtype=np.int64), np.fromiter(map(_WORDS.__getitem__, stream), dtype=np.uint64, count=len(stream))


def _classes(counts: np.ndarray, words: np.ndarray) -> list[bytes]:
    ends = np.cumsum(counts)
    return [xxhash.xxh3_128_digest(words[e - c : e].tobytes()) for c, e in zip(counts, ends, strict=True)]


def _described(records: DataFrame) -> DataFrame:
    """Rows `(id, evaluation, cls)` of the records of a split with enough letters, and, of each task, rows
    `(buckets, uses)` that count its words by bucket; one pass gives both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, dtype=np.int64)
        names = ["id", "evaluation", "cls", "buckets", "uses"]
        for batch in batches:
            keep, counts, words = _stream(batch.column(2).to_pylist())
            seen += np.bincount((words & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            part = batch.take(pa.array(keep, pa.int64()))
            none = pa.nulls(len(keep), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_classes(counts, words), pa.binary()), none, none], names=names)
        held = np.flatnonzero(seen)
        if len(held):
            told = [pa.array([x], pa.list_(pa.int32())) for x in (held.astype(np.int32), np.minimum(seen[held], 2**31 - 1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), *told], names=names)

    return _reduced(records).mapInArrow(run, "id string, evaluation boolean, cls binary, buckets array<int>, uses array<int>")


def features(records: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """`(id, evaluation, cls, n)` of records of a split with enough letters, stored, and weights and bytes of words.

    They count every text; to the driver come at most `COUNTERS` sums.
    """
    both = cut(_described(records))
    told = both.where("cls is not null").select("id", "evaluation", "cls", _number(F.col("cls")).alias("n"))
    sums = both.where("cls is null").select(F.explode(F.arrays_zip("buckets", "uses")).alias("x")).groupBy("x.buckets").agg(F.sum("x.uses").alias("uses")).toPandas()
    uses = np.zeros(COUNTERS, dtype=np.int64)
    uses[sums["buckets"].to_numpy(dtype=np.int64)] = sums["uses"].to_numpy(dtype=np.int64)
    return told, (word_weights(uses, told.count()), word_codes(uses))


def banded(records: DataFrame, words_known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """`(n, evaluation, mark, mark2, code, bands)` of each class and side; `code` has a byte for each word.

    A task leaves out the copies of a text it has seen, so of a text with many copies a row a task remains.
    """
    shared = records.sparkSession.sparkContext.broadcast(words_known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[bytes, bool]] = set()
        weights, codes = shared.value
        for batch in batches:
            keep, counts, words = _stream(batch.column(1).to_pylist())
            sides = batch.column(0).to_pylist()
            names = _classes(counts, words)
            fresh = [k for k, cls in enumerate(names) if (cls, sides[keep[k]]) not in seen and not seen.add((cls, sides[keep[k]]))]
            if not fresh:
                continue
            parts = np.split(words, np.cumsum(counts)[:-1])
            counts, parts = counts[fresh], [parts[k] for k in fresh]
            bands, marks = map(np.concatenate, zip(*(signatures(counts[k : k + AT_A_TIME], np.concatenate(parts[k : k + AT_A_TIME]), weights) for k in range(0, len(parts), AT_A_TIME)), strict=True))
            numbers = np.array([int.from_bytes(names[k][:8], "big") for k in fresh], dtype=np.uint64).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers), pa.array([sides[keep[k]] for k in fresh], pa.bool_()), *(pa.array(np.ascontiguousarray(marks[:, k]).view(np.int64)) for k in (0, 1)), pa.array([codes[(x & np.uint64(COUNTERS - 1)).astype(np.int64)].tobytes() for x in parts], pa.binary()), bands],
                names=["n", "evaluation", "mark", "mark2", "code", "bands"],
            )

    return _reduced(records).select("evaluation", "generation").mapInArrow(run, "n long, evaluation boolean, mark long, mark2 long, code binary, bands array<int>")


def band_matches(keys: DataFrame, least: float) -> DataFrame:
    """`(train_n, eval_n)` of different classes that share a band, are of like length, and whose sketches are alike; repeats kept."""
    train, evaluation = (keys.where(F.col("evaluation") == side).select(F.col("n").alias(f"{name}_n"), *(F.col(m).alias(f"{name}_{m}") for m in ("mark", "mark2")), F.explode("bands").alias("band")) for name, side in (("train", False), ("eval", True)))
    differ = F.bit_count(F.col("train_mark").bitwiseXOR(F.col("eval_mark")).bitwiseAND(F.lit((1 << _LOW) - 1))) + F.bit_count(F.col("train_mark2").bitwiseXOR(F.col("eval_mark2")))
    apart = F.abs(F.shiftright("train_mark", _LOW) - F.shiftright("eval_mark", _LOW))
    near = (F.col("train_n") != F.col("eval_n")) & (apart <= int(STEPS * -np.log(least)) + 1) & (differ <= most_unlike(least))
    return train.join(evaluation, "band").where(near).select("train_n", "eval_n")


#: Words of 64 bits for which vectors of many pairs side by side are faster than one long integer a pair.
MOST_LANES = 32
#: Bits of a word that hold places; the one above them takes the carry.
LANE = 63
_FULL, _CARRIED = np.uint64(2**LANE - 1), np.uint64(LANE)


def _columns(strings: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Byte strings as columns, zeros after their ends."""
    out = np.zeros((len(strings), int(sizes.max(initial=0))), dtype=np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(strings)
    return np.ascontiguousarray(out.T)


def subsequences(a: list[np.ndarray], b: list[np.ndarray], need: np.ndarray | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of byte strings, all pairs side by side, by bit vectors.

    With `need`, a pair that can no longer reach its length is given up, with a length below it.
    """
    if max(map(len, [*a, *b])) > 64 * MOST_LANES:
        return np.array([common_words(x.tobytes(), y.tobytes()) for x, y in zip(a, b, strict=True)])
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True)
    bits, steps = np.array([len(x) for x in short]), np.array([len(x) for x in long])
    least = np.zeros(len(bits)) if need is None else need
    rows, lanes = np.argsort(-steps, kind="stable"), max(1, -(-int(bits.max()) // LANE))
    base = np.arange(len(rows)) * 256
    # a row for each pair and byte, as all its lanes are read at once; what is set after a string's end is masked below
    where = np.zeros((len(rows) * 256, lanes), dtype=np.uint64)
    for i, column in enumerate(_columns([short[i] for i in rows], bits[rows])):
        where[base + column, i // LANE] |= np.uint64(1 << i % LANE)
    text = _columns([long[i] for i in rows], steps[rows])
    v = np.full((lanes, len(rows)), _FULL)
    mask = (np.uint64(1) << np.clip(bits[rows][None, :] - LANE * np.arange(lanes)[:, None], 0, LANE).astype(np.uint64)) - np.uint64(1)
    read, turned, buffers = np.empty((len(rows), lanes), dtype=np.uint64), np.empty((lanes, len(rows)), dtype=np.uint64), np.empty((2, len(rows)), dtype=np.uint64)
    out = np.zeros(len(rows), dtype=np.int64)
    apart = int((steps - least).max())  # words further apart are in no subsequence of the length needed
    for i in range(len(text)):
        if i % 16 == 0:
            done = np.bitwise_count(~v & mask).sum(axis=0, dtype=np.int64)
            out[rows] = done
            open_ = np.flatnonzero(done + np.minimum(steps[rows] - i, bits[rows] - done) >= least[rows])
            if len(open_) < 0.8 * len(rows):
                rows, v, mask, base, text = rows[open_], v[:, open_], mask[:, open_], base[open_], text[:, open_]
            if not len(rows):
                break
        active = int(np.searchsorted(-steps[rows], -i, side="left"))
        first, last = max(0, i - apart) // LANE, min(lanes, (i + apart) // LANE + 1) - 1
        np.take(where, base[:active] + text[i, :active], axis=0, out=read[:active], mode="clip")
        turned[first : last + 1, :active] = read[:active, first : last + 1].T
        total, carry = buffers[:, :active]
        for lane in range(first, last + 1):
            old, met = v[lane, :active], turned[lane, :active]
            met &= old
            np.add(old, met, out=total)
            if lane > first:
                total += carry
            if lane < last:
                np.right_shift(total, _CARRIED, out=carry)
            met ^= old  # what is left of the ones where nothing was met
            total |= met
            np.bitwise_and(total, _FULL, out=old)
    if len(rows):
        out[rows] = np.bitwise_count(~v & mask).sum(axis=0, dtype=np.int64)
    return out


class _Side:
    """The codes of one side of a tile, by number."""

    def __init__(self) -> None:
        self.numbers: list[np.ndarray] = []
        self.codes: list[bytes] = []
        self.ready = False

    def add(self, rows: pa.RecordBatch) -> None:
        self.numbers.append(rows.column(1).to_numpy())
        self.codes += rows.column(3).to_pylist()

    def close(self) -> None:
        if not self.ready:
            numbers = np.concatenate(self.numbers) if self.numbers else np.zeros(0, dtype=np.int64)
            order = np.argsort(numbers)
            self.sorted, self.arrays = numbers[order], [np.frombuffer(self.codes[i], np.uint8) for i in order]
            self.size = np.array([len(x) for x in self.arrays], dtype=np.int64)
            flat = np.repeat(np.arange(len(order)) * 256, self.size) + (np.concatenate(self.arrays) if self.arrays else np.zeros(0, dtype=np.int64))
            self.bags = np.minimum(np.bincount(flat, minlength=256 * len(order)), 65535).astype(np.uint16).reshape(-1, 256)
            self.codes, self.ready = [], True

    def find(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.sorted, numbers)


#: Pairs of a tile that are looked at together, repeats once; those whose bags are, and whose subsequences are computed side by side.
AT_ONCE, BAGS_AT_ONCE, ABREAST = 1 << 20, 1024, 2048


def in_order(matches: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """The matches whose codes agree: no fewer than those whose words do, without moving the texts.

    Both sides are dealt to a grid of tiles by number, so a tile holds a bounded part of each
    side once, whatever pairs there are, and a frequent text's pairs spread over many tiles.
    A text as long as 65,535 uses of one word is compared without the bag bound.
    """
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    sizes = {r["evaluation"]: r["n"] for r in keys.groupBy("evaluation").agg(F.count("*").alias("n")).collect()}
    train, evaluation = max(1, sizes.get(False, 0)), max(1, sizes.get(True, 0))
    down = max(-(-evaluation // TILE), min(parts, round((parts * evaluation / train) ** 0.5)), 1)
    across = max(-(-train // TILE), -(-parts // down), 1)

    def tile(of_train: Column, of_eval: Column) -> Column:
        return (of_train * down + of_eval).cast("int")

    def of(n: str, parts_: int) -> Column:
        return F.pmod(F.col(n), F.lit(parts_))

    none = F.lit(None)
    dealt = keys.where("not evaluation").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda k: tile(of("n", across), k))).alias("tile"), F.lit(0).alias("kind"), "n", none.cast("long").alias("m"), "code")
    dealt = dealt.unionByName(keys.where("evaluation").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda k: tile(k, of("n", down)))).alias("tile"), F.lit(1).alias("kind"), "n", none.cast("long").alias("m"), "code"))
    dealt = dealt.unionByName(matches.select(tile(of("train_n", across), of("eval_n", down)).alias("tile"), F.lit(2).alias("kind"), F.col("train_n").alias("n"), F.col("eval_n").alias("m"), none.cast("binary").alias("code")))

    def agreeing(one: _Side, other: _Side, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        i, j = one.find(n), other.find(m)
        need = np.maximum(one.size[i], other.size[j]) * least - 1e-9
        shared = np.concatenate([np.minimum(one.bags[i[k : k + BAGS_AT_ONCE]], other.bags[j[k : k + BAGS_AT_ONCE]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), BAGS_AT_ONCE)])
        open_ = np.flatnonzero((shared >= need) | (need > 65535))
        open_ = open_[np.argsort(np.minimum(one.size[i[open_]], other.size[j[open_]]), kind="stable")]
        good, k = [open_[:0]], 0
        while k < len(open_):
            widest = int(np.maximum(one.size[i[open_[k : k + ABREAST]]], other.size[j[open_[k : k + ABREAST]]]).max())
            some = open_[k : k + max(1, min(ABREAST, ABREAST * 512 // max(widest, 1)))]
            k += len(some)
            good.append(some[subsequences([one.arrays[x] for x in i[some]], [other.arrays[x] for x in j[some]], need[some]) >= need[some]])
        return np.concatenate(good)

    def checked(sides: tuple[_Side, _Side], held: list[np.ndarray]) -> pa.RecordBatch:
        for side in sides:
            side.close()
        pairs = np.concatenate(held)
        pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))]
        pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))]
        n, m = pairs[:, 0], pairs[:, 1]
        good = agreeing(*sides, n, m)
        return pa.RecordBatch.from_arrays([pa.array(n[good]), pa.array(m[good])], names=["train_n", "eval_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition is one tile: both sides come first, then the pairs
        sides, held = (_Side(), _Side()), []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            edges = np.searchsorted(kinds, [0, 1, 2, 3])
            for kind in (0, 1):
                if edges[kind] < edges[kind + 1]:
                    sides[kind].add(batch.slice(edges[kind], edges[kind + 1] - edges[kind]))
            if edges[2] < edges[3]:
                pairs = batch.slice(edges[2], edges[3] - edges[2])
                held.append(np.stack([pairs.column(1).to_numpy(), pairs.column(2).to_numpy()], axis=1))
                if sum(map(len, held)) >= AT_ONCE:
                    yield checked(sides, held)
                    held = []
        if held:
            yield checked(sides, held)

    return dealt.repartitionById(across * down, F.col("tile")).sortWithinPartitions("kind").select("kind", "n", "m", "code").mapInArrow(run, "train_n long, eval_n long").distinct()


def common_words(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if len(a) < len(b):
        a, b = b, a
    where: dict = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for w in a:
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def agreement(a: Sequence, b: Sequence) -> float:
    """Share of the longer text's words that the other has in the same order."""
    return common_words(a, b) / max(len(a), len(b), 1)


def jaccard(a: list[str], b: list[str], size: int = SHINGLE) -> float:
    """Exact similarity of the shingle sets."""
    left = {tuple(a[i : i + size]) for i in range(len(a) - size + 1)}
    right = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)}
    return len(left & right) / max(1, len(left | right))


def _same_words(a: list[str], b: list[str]) -> float:
    """A bound on the agreement: words in common, whatever their order."""
    return (Counter(a) & Counter(b)).total() / max(len(a), len(b), 1)


def _named(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """`texts(id, text)` of the wanted ids; a screen lets few others through to the join."""
    keyed = wanted.withColumn("key", F.xxhash64("id"))
    bits = screen(keyed, "key", bits_for(wanted.count()))
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = batch.filter(pa.array(passes(shared.value, batch.column(2).to_numpy())))
            if few.num_rows:
                yield few.select([0, 1])

    return texts.withColumn("key", F.xxhash64("id")).mapInArrow(run, "id string, text string").join(wanted, "id")


def overlapping_classes(records: DataFrame, described: DataFrame, words_known: tuple[np.ndarray, np.ndarray], least: float = MIN_AGREEMENT) -> DataFrame:
    """`(train_cls, eval_cls, agreement, jaccard)` of confirmed pairs, identical texts included.

    `described` and `words_known` come from `features`. Each class is represented by its smallest id.
    """
    classes = described.groupBy("cls", "n").agg(F.min("id").alias("id"), F.max("evaluation").alias("in_eval"), (~F.min("evaluation")).alias("in_train"))
    same = classes.where("in_eval and in_train").select(F.col("cls").alias("train_cls"), F.col("cls").alias("eval_cls"), F.lit(1.0).alias("agreement"), F.lit(1.0).alias("jaccard"))
    keys = cut(banded(records, words_known))
    candidates = cut(in_order(band_matches(keys, least), keys.select("n", "evaluation", "code"), least))
    named = candidates.select(F.col("train_n").alias("n")).unionByName(candidates.select(F.col("eval_n").alias("n"))).distinct()
    wanted = cut(classes.join(named, "n", "left_semi").select("id", "n", "cls"))
    texts = _reduced(records).select("id", F.col("generation").alias("text"))
    found = cut(_named(texts, wanted).groupBy("n", "cls").agg(F.min("text").alias("text")))
    paired = candidates.join(found.withColumnsRenamed({"n": "eval_n", "text": "eval_text", "cls": "eval_cls"}), "eval_n").join(found.withColumnsRenamed({"n": "train_n", "text": "train_text", "cls": "train_cls"}), "train_n").select("train_cls", "eval_cls", "train_text", "eval_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduced = lru_cache(4096)(comparable_words)
        for batch in batches:
            keep, shares, similar = [], [], []
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                left, right = reduced(a), reduced(b)
                if _same_words(left, right) < least - 1e-9:
                    continue
                share = agreement(left, right)
                if share >= least - 1e-9:
                    keep.append(i)
                    shares.append(share)
                    similar.append(jaccard(left, right))
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shares, pa.float64()), pa.array(similar, pa.float64())], names=["train_cls", "eval_cls", "agreement", "jaccard"])

    near = paired.mapInArrow(verify, "train_cls binary, eval_cls binary, agreement double, jaccard double")
    return same.unionByName(near.where("train_cls <> eval_cls"))


def overlapping_records(records: DataFrame, least: float = MIN_AGREEMENT) -> DataFrame:
    """`(id_1, id_2)`: every pair of a training and an evaluation record that agree, the smaller id first.

    Null, empty and short texts are in no pair; a repeated delivery counts once.
    """
    described, words_known = features(records)
    pairs = cut(overlapping_classes(records, described, words_known, least))
    members = described.select("id", "cls", "evaluation").distinct()
    train = members.where("not evaluation").select(F.col("cls").alias("train_cls"), F.col("id").alias("train_id"))
    evaluation = members.where("evaluation").select(F.col("cls").alias("eval_cls"), F.col("id").alias("eval_id"))
    return pairs.select("train_cls", "eval_cls").join(train, "train_cls").join(evaluation, "eval_cls").where("train_id <> eval_id").select(F.least("train_id", "eval_id").alias("id_1"), F.greatest("train_id", "eval_id").alias("id_2")).distinct()


def overlap_classes(records: DataFrame, least: float = MIN_AGREEMENT) -> DataFrame:
    """One row per evaluation record in an overlap: `(id, split_name, source_id, cls, linked_classes, linked_records)`."""
    described, words_known = features(records)
    pairs = cut(overlapping_classes(records, described, words_known, least))
    sizes = described.where("not evaluation").groupBy("cls").agg(F.countDistinct("id").alias("n")).withColumnRenamed("cls", "train_cls")
    linked = pairs.join(sizes, "train_cls").groupBy("eval_cls").agg(F.count("*").alias("linked_classes"), F.sum("n").alias("linked_records")).withColumnRenamed("eval_cls", "cls")
    split = F.lower(F.trim("split_name"))
    labels = records.where(F.col("id").isNotNull() & split.isin("validation", "test")).groupBy("id").agg(F.min(split).alias("split_name"), F.min("source_id").alias("source_id"))
    once = described.where("evaluation").groupBy("id").agg(F.min("cls").alias("cls"))
    return once.join(linked, "cls").join(labels, "id").select("id", "split_name", "source_id", F.lower(F.hex("cls")).alias("cls"), "linked_classes", "linked_records")


def overlap_report(records: DataFrame, least: float = MIN_AGREEMENT) -> DataFrame:
    """Overlapping evaluation records and their pairs by split and source; a missing source is null."""
    return overlap_classes(records, least).groupBy("split_name", "source_id").agg(F.count("*").alias("records"), F.sum("linked_records").alias("pairs"))
