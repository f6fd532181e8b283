"""Problem 8: passages of evaluation items inside a training corpus.

A passage of thirty words of which one in ten is replaced keeps a run of seven words, as
does every longer one, so all runs of seven words of an item are its seeds, whatever their
frequency. Documents pass a screen built from the items' seeds (of bounded size, whatever
the items); around each hit a passage is cut out, and hits are joined with the items
exactly. Passage and item are then aligned by Smith-Waterman over words, many pairs side by
side; where the score is that of a sound passage, the stretch is measured.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidrift.llm.overlap import shingle_hashes
from lexidrift.llm.screen import bits_for, passes, screen
from lexidrift.plans.lineage import cut

#: Words of an item that must be found, and the share of them that may differ.
MIN_WORDS, MAX_DIFFERENT = 30, 0.10
#: The longest run that every such passage keeps: of n words with m replaced one of m + 1 runs has (n - m) / (m + 1) of them.
SEED = min(-(-(n - int(n * MAX_DIFFERENT)) // (int(n * MAX_DIFFERENT) + 1)) for n in range(MIN_WORDS, 40 * MIN_WORDS))
#: Places of such a passage, at least, where a clean run of that length begins.
MIN_HITS = min(n - int(n * MAX_DIFFERENT) - (SEED - 1) * (int(n * MAX_DIFFERENT) + 1) for n in range(MIN_WORDS, 40 * MIN_WORDS))
#: The least score of such a passage: one for each equal word, two off for each other.
MIN_SCORE = MIN_WORDS - 3 * int(MIN_WORDS * MAX_DIFFERENT)
#: A longer passage halves into ones that qualify, so this many words on either side of a hit decide.
AROUND = 2 * MIN_WORDS
#: Texts are aligned in pieces of so many words, which overlap by twice that reach.
PIECE = 512
#: Bits of a seed's hash that are looked up in the screen, each in a part of its own.
LOOKS = 3
#: Cells of the score tables that are filled side by side.
CELLS = 4_000_000

# Labels that may stand between passages; at the start of a line any single word before a colon is one.
_LABEL = re.compile(r"^[ \t>|*•\"“„«'-]*[^\W\d_]{1,12}\s?\d{0,3}\s?:(?=\s)|(?:(?<=\s)|(?<=>)|^)(?:Q|A|Question|Answer|Quote|Source|Text|Passage|Frage|Antwort|Réponse|Pregunta|Respuesta|Zitat|Citation|Cita)\s?\d{0,3}\s?[:)](?=\s)", re.M)
_DECIMAL = re.compile(r"(?<=\d)[.,](?=\d)")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|(?:[^\W_぀-ヿ㐀-鿿฀-๿]|[̀-ͯऀ-෿])+")
_ASCII_TOKEN = re.compile("[a-z0-9]+")
#: Marks that join the parts of a word vanish; a doubled hyphen and other frequent marks part words.
_VANISH = ("'", "’", "‘", "`", "´", "-", "‐", "‑", "\u200b", "\u200c", "\u200d", "\u200e", "\u200f", "\u2060", "\ufeff", "\xad")
_PART = ("--", "“", "”", "–", "—", "…", "«", "»", "„")


def passage_words(text: str) -> list[str]:
    """Words in lower case without punctuation, apostrophes, quote marks, labels or line breaks."""
    for mark in _PART if not text.isascii() else _PART[:1]:
        if mark in text:
            text = text.replace(mark, " ")
    text = _LABEL.sub(" ", text)
    for mark in _VANISH if not text.isascii() else ("'", "`", "-"):
        if mark in text:
            text = text.replace(mark, "")
    text = _DECIMAL.sub("", text)
    if text.isascii():
        return _ASCII_TOKEN.findall(text.lower())
    return _TOKEN.findall(unicodedata.normalize("NFKC", text).lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        if len(self) > 1_000_000:
            self.clear()
        return h


_WORDS = _Hashes()


def _seeds(words: Sequence[str]) -> np.ndarray:
    return shingle_hashes(np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words)), SEED).view(np.int64)


def _pieces(size: int) -> list[tuple[int, int]]:
    """Where the pieces of a text of `size` words begin and end; neighbours share twice the reach of a hit."""
    step = PIECE - 2 * (AROUND + SEED)
    return [(lo, min(size, lo + PIECE)) for lo in range(0, max(1, size - (PIECE - step)), step)]


def item_pieces(items: DataFrame) -> DataFrame:
    """`(item_id, item_part, item_words, seed)`: a row for each different seed of each piece of each item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, texts, seeds = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = passage_words(t)
                for k, (lo, hi) in enumerate(_pieces(len(words))):
                    own = np.unique(_seeds(words[lo:hi]))
                    rows += [i] * len(own)
                    parts += [k] * len(own)
                    texts += [" ".join(words[lo:hi])] * len(own)
                    seeds.append(own)
            flat = np.concatenate(seeds) if seeds else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(parts, pa.int32()), pa.array(texts, pa.string()), pa.array(flat)], names=["item_id", "item_part", "item_words", "seed"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, item_part int, item_words string, seed long")


def _looks(seeds: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where a seed is looked up: one place in each of as many equal parts of the screen."""
    return [((seeds.view(np.uint64) >> np.uint64(20 * k)) % np.uint64(bits // 4) + np.uint64(k * (bits // 4))).view(np.int64) for k in range(LOOKS)]


def seed_screen(seeds: DataFrame) -> np.ndarray:
    """The screen of the items' seeds, with `LOOKS` bits each."""
    bits = bits_for(4 * seeds.count())
    quarter = bits // 4
    unsigned = [F.pmod(F.shiftrightunsigned("seed", 20 * k), F.lit(quarter)) + k * quarter for k in range(LOOKS)]
    return screen(seeds.select(F.explode(F.array(*unsigned)).alias("at")), "at", bits)


def passages(documents: DataFrame, bits: np.ndarray) -> DataFrame:
    """`(doc_id, part, words, seeds, places)`: what stands around the hits of each document, with the seeds that hit and how often.

    Passages that touch are one, and long ones are cut into pieces that overlap.
    """
    kept = documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    kind = kept.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value) * 8
        for batch in batches:
            rows, parts, texts, held = [], [], [], []
            long = [(i, w) for i, t in enumerate(batch.column(1).to_pylist()) if len(w := passage_words(t)) >= MIN_WORDS]
            seeds = _seeds([x for _, w in long for x in w])
            hit = np.ones(len(seeds), dtype=bool)
            for at in _looks(seeds, size):
                hit &= passes(shared.value, at)
            every = np.flatnonzero(hit)
            ends = np.cumsum([len(w) for _, w in long])
            bounds = np.searchsorted(every, np.concatenate([ends - [len(w) for _, w in long], ends - SEED + 1])) if long else np.zeros(0, dtype=np.int64)
            for k, (i, words) in enumerate(long):
                first = int(ends[k]) - len(words)
                hits = every[bounds[k] : bounds[len(long) + k]] - first  # runs that go on into the next text are none
                if not len(hits):
                    continue
                breaks = np.flatnonzero(np.diff(hits) > 2 * AROUND + SEED) + 1
                no = 0
                for group in np.split(hits, breaks):
                    begin, end = max(0, group[0] - AROUND), min(len(words), group[-1] + SEED + AROUND)
                    for lo, hi in _pieces(end - begin):
                        inside = group[(group >= begin + lo) & (group + SEED <= begin + hi)]
                        if len(inside):
                            rows.append(i)
                            parts.append(no)
                            texts.append(" ".join(words[begin + lo : begin + hi]))
                            held.append(np.unique(seeds[first + inside], return_counts=True))
                            no += 1
            offsets = pa.array(np.cumsum([0, *(len(x) for x, _ in held)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in held]) if held else np.zeros(0, dtype=np.int64))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(parts, pa.int32()), pa.array(texts, pa.string()), *lists], names=["doc_id", "part", "words", "seeds", "places"])

    return kept.mapInArrow(run, f"doc_id {kind}, part int, words string, seeds array<long>, places array<long>")


def scores(docs: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores (1, else -2, gap -2) of all pairs, `(pair, word of the document, word of the item)` from 0."""
    n, m = max(map(len, docs)), max(map(len, items))
    a = np.full((len(docs), n), -1, dtype=np.int32)
    b = np.full((len(docs), m), -2, dtype=np.int32)
    for k, (x, y) in enumerate(zip(docs, items, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    out = np.zeros((n + 1, len(docs), m + 1), dtype=np.int16)
    slope = 2 * np.arange(m + 1, dtype=np.int16)
    for i in range(1, n + 1):
        step = np.where(b == a[:, i - 1 : i], np.int16(1), np.int16(-2))
        row = out[i]
        np.maximum(out[i - 1, :, :-1] + step, out[i - 1, :, 1:] - np.int16(2), out=row[:, 1:])
        np.maximum(row, 0, out=row)
        np.maximum.accumulate(row + slope, axis=1, out=row)
        row -= slope
    return out.transpose(1, 0, 2)


def _longest(words: np.ndarray, bad: np.ndarray) -> int:
    """Item words of the longest run of columns of which the share that may differ differs at most."""
    w, x = np.concatenate([[0], np.cumsum(words)]), np.concatenate([[0], np.cumsum(bad)])
    length, wrong = w[None, :] - w[:, None], x[None, :] - x[:, None]
    return int(length[(wrong <= length * MAX_DIFFERENT + 1e-9) & (length > 0)].max(initial=0))


def _measured(score: np.ndarray, a: np.ndarray, b: np.ndarray) -> int:
    """Longest stretch along the alignments of sufficient score, and along the diagonals that hold as many equal words."""
    if score.max() < MIN_SCORE:
        return 0
    best = 0
    equal = a[:, None] == b[None, :]
    at, of = np.nonzero(equal)
    shifts, n = np.unique(at - of, return_counts=True)
    straight = 0
    for shift in shifts[n >= MIN_WORDS - int(MIN_WORDS * MAX_DIFFERENT)]:
        good = np.diagonal(equal, -int(shift))
        best = max(best, _longest(np.ones(len(good), dtype=np.int64), ~good))
        sums = np.concatenate([[0], np.cumsum(np.where(good, 1, -2))])
        straight = max(straight, int((sums - np.minimum.accumulate(sums)).max()))
    if straight == score.max() and len(shifts[n >= MIN_WORDS // 2]) == 1:
        return best  # one alignment, without gaps
    left = score.copy()
    while (peak := int(left.argmax())) and left.flat[peak] >= MIN_SCORE:
        i, j = np.unravel_index(peak, left.shape)
        columns = []
        while score[i, j] > 0:
            seen = left[i, j] < 0
            left[i, j] = -1
            if seen:
                break
            same = a[i - 1] == b[j - 1]
            if score[i, j] == score[i - 1, j - 1] + (1 if same else -2):
                columns.append((1, not same))
                i, j = i - 1, j - 1
            elif score[i, j] == score[i - 1, j] - 2:
                columns.append((0, True))
                i -= 1
            else:
                columns.append((1, True))
                j -= 1
        if len(columns) >= MIN_WORDS:
            c = np.array(columns, dtype=np.int64)
            best = max(best, _longest(c[:, 0], c[:, 1]))
        # what only decays from the path leads back into it
        left[max(0, i) :, max(0, j) :] = np.where(_led(score, left, i, j), -1, left[max(0, i) :, max(0, j) :])
    return best


def _led(score: np.ndarray, left: np.ndarray, i: int, j: int) -> np.ndarray:
    """Cells below and to the right of `(i, j)` that lie within the decay of a used cell."""
    used = left[i:, j:] < 0
    reach = np.where(used, score[i:, j:], 0).astype(np.int32)
    down, right = 2 * np.arange(reach.shape[0])[:, None], 2 * np.arange(reach.shape[1])[None, :]
    reach = np.maximum.accumulate(reach + down, axis=0) - down
    reach = np.maximum.accumulate(reach + right, axis=1) - right
    return ~used & (reach >= score[i:, j:]) & (score[i:, j:] > 0)


def longest_passages(docs: list[list[str]], items: list[list[str]]) -> list[int]:
    """For each pair the words of the longest stretch of the item found in the document, at most one in ten different.

    Differing, missing and extra words count against the stretch. Pairs are aligned side by
    side, as many as their longest allow.
    """
    ids: dict[str, int] = {}
    coded = [[np.array([ids.setdefault(w, len(ids)) for w in t], dtype=np.int32) for t in side] for side in (docs, items)]
    order = sorted(range(len(docs)), key=lambda k: len(docs[k]) * len(items[k]))
    out, lo = [0] * len(docs), 0
    while lo < len(order):
        hi, n, m = lo, 1, 1
        while hi < len(order):
            n, m = max(n, len(docs[order[hi]])), max(m, len(items[order[hi]]))
            if hi > lo and n * m * (hi - lo + 1) > CELLS:
                break
            hi += 1
        some = order[lo:hi]
        table = scores([coded[0][k] for k in some], [coded[1][k] for k in some])
        for score, k in zip(table, some, strict=True):
            out[k] = _measured(score[: len(docs[k]) + 1, : len(items[k]) + 1], coded[0][k], coded[1][k])
        lo = hi
    return out


def longest_passage(doc: list[str], item: list[str]) -> int:
    """The same for one pair."""
    return longest_passages([doc], [item])[0] if doc and item else 0


def leaked_items(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """`(doc_id, item_id, words)`: documents that hold at least `least` (30 or more) consecutive words of an item.

    Null, empty and short texts leak nothing; repeated rows of a document count once. A
    document or item longer than `PIECE` words is compared in pieces, so `words` never
    exceeds that. In how many documents a seed occurs plays no part, so more documents never hide one.
    """
    once = items.where("text is not null and item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    pieces = cut(item_pieces(once))
    found = cut(passages(documents, seed_screen(pieces)))
    seeds = found.select("doc_id", "part", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("doc_id", "part", F.col("s.seeds").alias("seed"), F.col("s.places").alias("places"))
    met = seeds.join(pieces.select("item_id", "item_part", "seed"), "seed").groupBy("doc_id", "part", "item_id", "item_part").agg(F.sum("places").alias("places")).where(F.col("places") >= MIN_HITS).drop("places")
    texts = pieces.groupBy("item_id", "item_part").agg(F.first("item_words").alias("item_words"))
    pairs = met.join(found.select("doc_id", "part", "words"), ["doc_id", "part"]).join(texts, ["item_id", "item_part"]).select("doc_id", "item_id", "words", "item_words")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = longest_passages(*([t.split(" ") for t in batch.column(c).to_pylist()] for c in (2, 3)))
            keep = [k for k, n in enumerate(longest) if n >= least]
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([longest[k] for k in keep], pa.int32())], names=["doc_id", "item_id", "words"])

    kinds = [pairs.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")]
    aligned = pairs.repartition(F.col("doc_id"), F.col("item_id")).mapInArrow(align, f"doc_id {kinds[0]}, item_id {kinds[1]}, words int")
    return aligned.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with the number of documents that hold a passage of it, leaked or not."""
    found = leaked_items(documents, items).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))
    known = items.groupBy("item_id").agg(F.min("item_set").alias("item_set"), F.min("lang").alias("lang"))
    return known.join(found, "item_id", "left").select("item_id", "item_set", "lang", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("longest", F.lit(0)).alias("longest"))
