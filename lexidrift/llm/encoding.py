"""Problem 10: texts decoded with the wrong character encoding.

Sentences are twins if their ASCII parts are equal, and, where these hold little, the lengths
of the rest too; texts of other scripts are compared also as a whole. Aligning the
characters between equal ASCII parts shows which transformation (text in one encoding read
in another) turns the one into the other. Only sentences of which one holds, at the same places, what
transformations make of the other's characters are compared, so a group of sentences is looked at whole
without comparing all its pairs. The transformations so learned are applied to all records, down to
single characters. What no twin shows is taken for garbled only where whole
passages turn from unlike the corpus to like it; such rows are marked as resting on likeness.

How a corpus looks is kept in two tables whose size the alphabets bound: counts of
neighbouring characters for alphabets, of single characters for ideographs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexidrift.plans.lineage import cut

# Encodings by which UTF-8 is often misread, and pairs (read as, written in) of other mistakes.
MISREAD = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac-roman", "cp1255", "cp1256", "cp1257", "cp874", "iso8859-15")
WIDE = ("cp932", "gbk", "big5", "euc-kr", "euc-jp")
SWAPS = tuple((a, b) for a in ("cp1252", "latin-1") for b in ("cp1253", "iso8859-7", "cp1251", "koi8-r", "cp1250", "iso8859-2", "cp932", "gbk", "euc-jp", "big5", "cp437", "cp850", "cp852", "mac-roman", "cp866", "cp874", "cp1256", "iso8859-6")) + (("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8-r", "cp866"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1253", "cp1252"), ("mac-roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "mac-cyrillic"), ("mac-cyrillic", "cp1251"), ("gbk", "cp932"), ("cp932", "gbk"), ("cp932", "euc-jp"), ("gbk", "euc-jp"), ("big5", "gbk"), ("gbk", "big5"), ("cp1251", "iso8859-5"), ("iso8859-5", "cp1251"))
#: A transformation that no twin shows counts in a document from this gain on (mean of the logarithms of counts) over so many characters.
GAIN, CHARACTERS = 1.6, 6
#: The same for one that twins show; and how much less like the corpus a result may be where twins show the misreading.
SHOWN_GAIN, SHOWN_CHARACTERS, SHOWN_LOSS = 0.8, 2, 1.0
#: Share of a sentence's non-ASCII characters in misread sequences from which on it says nothing about the corpus.
STRANGE_SHARE = 0.8
#: Times that one sentence counts at most in the character counts.
COPIES = 100
#: Twins that must show a transformation.
TWINS = 1
#: Share of the places where twins differ that one transformation must explain.
LIKELY = 0.5
#: Letters and digits that a sentence must keep to have twins, or runs of other characters whose lengths stand in for them.
SKELETON, RUNS = 12, 4


def _byte_chars(codec: str) -> dict[int, str]:
    """What each byte from 0x80 on reads as; undefined ones read as control characters."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


class Misread:
    """UTF-8 read in a single-byte encoding."""

    def __init__(self, codec: str) -> None:
        self.name = f"utf-8 as {codec}"
        chars = _byte_chars(codec)
        self.back = {c: bytes([b]) for b, c in chars.items()}

        def group(lo: int, hi: int) -> str:
            return "[" + "".join(re.escape(chars[b]) for b in range(lo, hi + 1) if len(chars[b]) == 1) + "]"

        rest = group(0x80, 0xBF)
        self.pattern = re.compile(f"(?:{group(0xC2, 0xDF)}{rest}|{group(0xE0, 0xEF)}{rest}{{2}}|{group(0xF0, 0xF4)}{rest}{{3}})+")

    def _decode(self, m: re.Match) -> str:
        try:
            return b"".join(self.back[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    def restore(self, text: str) -> str:
        return self.pattern.sub(self._decode, text)


class WideMisread:
    """UTF-8 read in a multi-byte encoding; what was lost stays lost."""

    def __init__(self, codec: str) -> None:
        self.name, self.codec = f"utf-8 as {codec}", codec
        self.pattern = re.compile("[⁐-￿]{3,}")

    def _decode(self, m: re.Match) -> str:
        raw = m[0].encode(self.codec, "ignore")
        good = raw.decode("utf-8", "ignore")
        kept = len(good.encode())
        strange = sum(1 for c in good if c.isalpha()) < 0.5 * len(good)
        return good if len(raw) >= 6 and kept >= 0.72 * len(raw) and not strange and len(good) < len(m[0]) else m[0]

    def restore(self, text: str) -> str:
        return self.pattern.sub(self._decode, text)


class Swap:
    """Text of one legacy encoding read in another; only the corpus can tell whether it was."""

    def __init__(self, read: str, written: str) -> None:
        self.name, self.read, self.written = f"{written} as {read}", read, written
        if read in WIDE:
            self.pattern = re.compile("[⁐-￿]{3,}")
            self.back = None
        else:
            chars = _byte_chars(read)
            self.back = {c: bytes([b]) for b, c in chars.items()}
            self.pattern = re.compile("(?:[\x00-\x7f]*[" + "".join(re.escape(c) for c in chars.values() if len(c) == 1) + "])+[\x40-\x7e]?")

    def _decode(self, m: re.Match) -> str:
        try:
            raw = m[0].encode(self.read) if self.back is None else b"".join(self.back.get(c) or c.encode("ascii") for c in m[0])
        except UnicodeEncodeError:
            return m[0]
        good = raw.decode(self.written, "replace")
        return m[0] if good.count("�") > 0.05 * len(good) else good

    def restore(self, text: str) -> str:
        return self.pattern.sub(self._decode, text)


_ALL: dict[str, Misread | WideMisread | Swap] | None = None


def transformations() -> dict[str, Misread | WideMisread | Swap]:
    """Every transformation that can be inferred, by name."""
    global _ALL
    if _ALL is None:
        every = [*map(Misread, MISREAD), *map(WideMisread, WIDE), *(Swap(a, b) for a, b in SWAPS)]
        _ALL = {t.name: t for t in every}
    return _ALL


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_ASCII_ONLY = re.compile("[^A-Za-z0-9]+")
_NON_ASCII = re.compile("[^\x00-\x7f]+")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f\ufffd]")


@lru_cache(1)
def _any_misread() -> tuple[re.Pattern, list[re.Pattern]]:
    """A pattern that any misread sequence of some encoding fits, which most sentences are done with, and the exact ones."""
    chars = [_byte_chars(codec) for codec in MISREAD]

    def group(lo: int, hi: int) -> str:
        return "[" + "".join(sorted({re.escape(c[b]) for c in chars for b in range(lo, hi + 1) if len(c[b]) == 1})) + "]"

    rest = group(0x80, 0xBF)
    return re.compile(f"{group(0xC2, 0xDF)}{rest}|{group(0xE0, 0xEF)}{rest}{{2}}|{group(0xF0, 0xF4)}{rest}{{3}}"), [t.pattern for t in transformations().values() if isinstance(t, Misread)]


def is_strange(sentence: str) -> bool:
    """Holds controls, the replacement character, or a sequence that UTF-8 misread would give."""
    if _CONTROL.search(sentence):
        return True
    some, exact = _any_misread()
    return bool(some.search(sentence)) and any(p.search(sentence) for p in exact)


def is_mostly_strange(sentence: str) -> bool:
    """Nearly all that isn't ASCII in it could be UTF-8 misread in one encoding."""
    if not is_strange(sentence):
        return False
    least = STRANGE_SHARE * (len(sentence) - sum(map(str.isascii, sentence)))
    return any(sum(map(len, t.pattern.findall(sentence))) >= least for t in transformations().values() if isinstance(t, Misread))


def skeleton(sentence: str) -> str:
    """What a wrong encoding leaves alone."""
    return _ASCII_ONLY.sub("", sentence).lower()


def twin_keys(sentence: str) -> list[str]:
    """What a sentence has in common with its twins, whatever encoding it was read in: its ASCII parts; if these are short,
    with the lengths of the runs between them (equal in single-byte encodings)."""
    parts = _NON_ASCII.sub("\x80", sentence)
    if len(skeleton(sentence)) >= SKELETON:
        return [parts]
    runs = _NON_ASCII.findall(sentence)
    return [parts + "\0\0" + " ".join(str(len(r)) for r in runs)] if len(runs) >= RUNS else []


def text_key(text: str) -> str | None:
    """For a text mostly outside ASCII its ASCII parts, if they hold letters or digits."""
    parts = _NON_ASCII.split(text)
    rest = sum(map(len, parts))
    return "\0\0\0" + "\x80".join(parts) if rest < 0.5 * len(text) and len(skeleton(text)) >= 3 and len(parts) > RUNS else None


def keyed_sentences(documents: DataFrame) -> DataFrame:
    """`(key, sentence)`, each once: the sentences outside ASCII, and texts mostly outside it, by what they share with their twins."""
    kept = documents.select("text").where(F.col("text").rlike(r"[^\x00-\x7f]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[str, str], None] = {}
            for text in batch.column(0).to_pylist():
                whole = text_key(text)
                if whole:
                    rows[whole, text] = None
                for s in _SENTENCE.split(text):
                    if not s.isascii():
                        for key in twin_keys(s):
                            rows[key, s] = None
            keys = [xxhash.xxh3_128_hexdigest(k) for k, _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([s for _, s in rows], pa.string())], names=["key", "sentence"])

    return kept.mapInArrow(run, "key string, sentence string").distinct()


def changed_runs(runs: DataFrame) -> DataFrame:
    """`(bad, right)`: of all runs of characters, those of which some transformation makes another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(bad, right) for bad in batch.column(0).to_pylist() for right in restorations(bad)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["bad", "right"])

    return runs.mapInArrow(run, "bad string, right string").join(runs.withColumnRenamed("run", "right"), "right").select("bad", "right")


def sentence_twins(documents: DataFrame) -> DataFrame:
    """`(garbled, clean)`: all sentences with a key in common of which one holds, at as many places as `explain` asks for, what
    transformations make of the characters that the other has there; which of them is garbled is for `explain` to say.
    """
    found = cut(keyed_sentences(documents))
    several = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    # the numbers are stored with the rows, so they stay what they are
    grouped = cut(found.join(several, "key").withColumn("n", F.monotonically_increasing_id()))
    runs = F.regexp_extract_all("sentence", F.lit(r"([^\x00-\x7f]+)"), 1)
    places = grouped.select("key", "n", F.posexplode(runs).alias("place", "run"))
    changed = cut(changed_runs(places.select("run").distinct()))
    bad = places.withColumnsRenamed({"run": "bad", "n": "garbled_n"}).join(changed, "bad").select("key", "place", "right", "garbled_n")
    met = bad.join(places.withColumnsRenamed({"run": "right", "n": "clean_n"}), ["key", "place", "right"]).groupBy("garbled_n", "clean_n").agg(F.count("*").alias("restored"))
    garbled, clean = (grouped.select(F.col("n").alias(f"{side}_n"), F.col("sentence").alias(side), runs.alias(f"{side}_runs")) for side in ("garbled", "clean"))
    differ = F.size(F.filter(F.zip_with("garbled_runs", "clean_runs", lambda x, y: x != y), lambda x: x))
    return met.join(garbled, "garbled_n").join(clean, "clean_n").where(F.col("restored") >= LIKELY * differ).select("garbled", "clean")


def aligned(garbled: str, clean: str) -> list[tuple[str, str]] | None:
    """Non-ASCII runs of both sentences side by side, where all ASCII parts between them are equal."""
    if [x for x in _NON_ASCII.split(garbled)] != [x for x in _NON_ASCII.split(clean)]:
        return None
    return list(zip(_NON_ASCII.findall(garbled), _NON_ASCII.findall(clean), strict=True))


def explain(garbled: str, clean: str, likeness: Callable[[str], float]) -> list[str]:
    """The transformations (one, or one applied twice) under which the aligned characters differ as they do.

    Swaps work both ways, so the clean sentence must be more like the corpus.
    """
    runs = aligned(garbled, clean)
    if runs is None:
        return []
    runs = [r for r in runs if r[0] != r[1]]
    out = []
    if not runs:
        return out
    good = Counter(name for bad, right in runs for name in restoring(bad, right))
    likely = [name for name, n in good.items() if n >= LIKELY * len(runs)]
    if any(isinstance(transformations()[name], Swap) for name in likely) and not likeness(clean) > likeness(garbled):
        likely = [name for name in likely if not isinstance(transformations()[name], Swap)]
    return out + likely


@lru_cache(100_000)
def restoring(bad: str, right: str) -> tuple[str, ...]:
    """The transformations that turn one run of characters, by one or two applications, into another."""
    found = []
    for name, t in transformations().items():
        once = t.restore(bad)
        if once != bad and (once == right or t.restore(once) == right):
            found.append(name)
    return tuple(found)


def restorations(bad: str) -> set[str]:
    """All that transformations make of one run of characters, by one or two applications."""
    found = set()
    for t in transformations().values():
        once = t.restore(bad)
        if once != bad:
            found.update((once, t.restore(once)))
    return found - {bad}


def learned_transformations(documents: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """`(transformation, twins)`: transformations that aligned twins show, with the number of them."""
    shared = documents.sparkSession.sparkContext.broadcast(Detector(collected_counts(documents) if counts is None else counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for bad, clean in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update(explain(bad, clean, shared.value.likeness))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["transformation", "twins"])

    return sentence_twins(documents).mapInArrow(run, "transformation string, twins long").groupBy("transformation").agg(F.sum("twins").alias("twins"))


def _is_ideograph(c: str) -> bool:
    return c >= "⁐"


def _grams(text: str) -> list[str]:
    """Neighbouring characters with a non-ASCII one among them; an ideograph stands alone."""
    out = []
    before = " "
    for c in text:
        if _is_ideograph(c):
            out.append(c)
            before = " "
        else:
            if c > "\x7f" or before > "\x7f":
                out.append(before + c)
            before = c
    return out


_AROUND = re.compile("[\x00-\x7f]?[^\x00-\x7f]+(?:[\x00-\x7f][^\x00-\x7f]+)*[\x00-\x7f]?")


def character_counts(documents: DataFrame) -> DataFrame:
    """`(gram, n)` over the sentences that aren't mostly strange, each counted `COPIES` times at most.

    So neither copies nor a large garbled source make garbled sequences look usual.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(s for text in batch.column(0).to_pylist() for s in _SENTENCE.split(text) if not s.isascii())
            kept = [s for s in found if not is_mostly_strange(s)]
            keys = [xxhash.xxh3_128_hexdigest(s) for s in kept]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kept, pa.string()), pa.array([found[s] for s in kept], pa.int64())], names=["key", "sentence", "copies"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for s, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for m in _AROUND.findall(s):
                    for g in _grams(m):
                        seen[g] += copies
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])

    texts = documents.select("text").where(F.col("text").rlike(r"[^\x00-\x7f]"))
    once = texts.mapInArrow(split, "key string, sentence string, copies long").groupBy("key").agg(F.first("sentence").alias("sentence"), F.least(F.sum("copies"), F.lit(COPIES)).alias("copies")).select("sentence", "copies")
    return once.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def collected_counts(documents: DataFrame) -> dict[str, int]:
    return {r["gram"]: r["n"] for r in character_counts(documents).collect()}


#: A word, or a sequence, alone between intact quotation marks or brackets.
_CITED = re.compile("^[\"'“«‹(\\[`‘]+[^\"'“”«»\\s]{1,40}[\"'”»›)\\]`’]+[.,;:!?]*$")
#: Blanks; runs of scripts that set none; other words.
_PIECES = re.compile("[ \t\r\n]+|[\u0e00-\u0e7f\u2e80-\uffff]+|[^ \t\r\n\u0e00-\u0e7f\u2e80-\uffff]+")
_LOST = re.compile("\ufffd")
_CONTROLS = re.compile("[\x80-\x84\x86-\x9f]")
#: Restorations of single words that a worker remembers.
REMEMBERED = 400_000


class Detector:
    """Restores the words of single texts, given how the corpus looks and which transformations twins show."""

    def __init__(self, counts: dict[str, int], learned: frozenset[str] = frozenset()) -> None:
        self.learned = learned
        self.log = {g: math.log1p(n) for g, n in counts.items()}
        self.words: dict[str, tuple] = {}

    def likeness(self, text: str) -> float:
        """Mean of the logarithms of its grams' counts."""
        grams = _grams(f" {text} ")
        return sum(self.log.get(g, 0.0) for g in grams) / max(len(grams), 1)

    def knows(self, text: str) -> bool:
        """All of its grams stand in the corpus."""
        return all(g in self.log for g in _grams(f" {text} "))

    def _misread(self, word: str) -> tuple[str, str] | None:
        """The best restoration of a word as UTF-8 misread: every sequence decodes, and the corpus knows the result better.

        Where twins show the misreading, it is enough that the corpus knows the result.
        """
        best = None
        before = self.likeness(word)
        outside = len(word) - sum(map(str.isascii, word))
        for t in transformations().values():
            if isinstance(t, Swap):
                continue
            found = t.pattern.findall(word)
            if not found or isinstance(t, Misread) and sum(map(len, found)) < 0.8 * outside:
                continue
            good = t.restore(word)
            if good == word:
                continue
            gain = self.likeness(good) - before
            shown = t.name in self.learned and gain > -SHOWN_LOSS and self.knows(good)
            if (gain > 0 or shown) and (best is None or gain > best[0] + 1e-9):
                best = (gain, t.name, good)
        return best and best[1:]

    def _swapped(self, word: str) -> list[tuple[str, float, int, str]]:
        """Restorations of a word as another encoding, by name: gain, characters, result."""
        out = []
        before = self.likeness(word)
        size = len(word) - sum(map(str.isascii, word))
        for t in transformations().values():
            if isinstance(t, Swap):
                good = t.restore(word)
                if good != word and "\ufffd" not in good and (len(good) < len(word) or sum(map(str.isalpha, good)) >= sum(map(str.isalpha, word))):
                    gain = self.likeness(good) - before
                    if gain >= GAIN or gain >= SHOWN_GAIN and t.name in self.learned and self.knows(good):
                        out.append((t.name, gain, size, good))
        return out

    def word(self, word: str) -> tuple:
        """`(names, restored, swaps)` of one word, remembered."""
        known = self.words.get(word)
        if known is None:
            names, good = [], word
            if not _CITED.match(word):
                # every step shortens the word, so the layers come to an end
                while (step := self._misread(good)) and len(step[1]) < len(good):
                    names.append(step[0])
                    good = step[1]
            if len(self.words) > REMEMBERED:
                self.words.clear()
            known = self.words[word] = (tuple(names), good, () if names or _CITED.match(word) else tuple(self._swapped(word)))
        return known

    def look(self, text: str) -> tuple[list[str], str, bool, str] | None:
        """`(transformations, restored text, whole, evidence)` of a garbled text, or None.

        A word that stands alone between intact quotation marks is only cited. `whole` is
        false where characters were lost for good. Evidence is `twins`, `lost` (a
        replacement or control character stands in the text), or else `likeness`.
        """
        if text.isascii():
            return None
        parts = _PIECES.findall(text)
        names: set[str] = set()
        unshown: dict[str, list] = {}
        swaps: dict[str, list] = {}
        lost = False
        for i, w in enumerate(parts):
            if w.isascii():
                continue
            steps, good, swapped = self.word(w)
            if steps and self.learned.intersection(steps):
                names.update(steps)
                parts[i] = good
            elif steps:
                size = len(w) - sum(map(str.isascii, w))
                slot = unshown.setdefault(steps[0], [0.0, 0, []])
                slot[0] += (self.likeness(good) - self.likeness(w)) * size
                slot[1] += size
                slot[2].append((i, good, steps))
            for name, gain, size, better in swapped:
                slot = swaps.setdefault(name, [0.0, 0, []])
                slot[0] += gain * size
                slot[1] += size
                slot[2].append((i, better, (name,)))
            if not _CITED.match(w):
                lost = lost or bool(_LOST.search(w))
        for found, gain in ((unshown, GAIN), (swaps, 0.0)):
            enough = [(total, name) for name, (total, size, _) in found.items() if size >= (SHOWN_CHARACTERS if name in self.learned else CHARACTERS) and total >= gain * size]
            if enough:
                for i, better, steps in found[max(enough)[1]][2]:
                    names.update(steps)
                    parts[i] = better
        restored = "".join(parts)
        controls = bool(_CONTROLS.search(text))
        if not names and not lost and not controls:
            return None
        evidence = "twins" if self.learned.intersection(names) else "lost" if lost or controls else "likeness"
        return sorted(names), restored, not lost and not _CONTROLS.search(restored) and "\ufffd" not in restored, evidence


def garbled_documents(documents: DataFrame) -> DataFrame:
    """`(doc_id, transformations, restored, whole, evidence)` of the documents with garbled text.

    A transformation that aligned twins show is applied wherever the corpus knows the
    result; another one only to whole passages that become like the corpus by it, which
    `evidence` marks. Null, empty and ASCII texts are never garbled; a repeated row comes
    once. `restored` holds the right text as far as it can be had, `whole` tells whether
    that is all of it. To the driver come the character counts, bounded by the alphabets,
    and at most one row per transformation.
    """
    counts = collected_counts(documents)
    learned = {r["transformation"] for r in learned_transformations(documents, counts).where(F.col("twins") >= TWINS).collect()}
    shared = documents.sparkSession.sparkContext.broadcast(Detector(counts, frozenset(learned)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, r) for i, t in enumerate(batch.column(1).to_pylist()) if (r := shared.value.look(t))]
            part = batch.take(pa.array([i for i, _ in found], pa.int64()))
            told = [pa.array([r[k] for _, r in found], kind) for k, kind in enumerate((pa.list_(pa.string()), pa.string(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *told], names=["doc_id", "transformations", "restored", "whole", "evidence"])

    rows = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, transformations array<string>, restored string, whole boolean, evidence string").dropDuplicates(["doc_id"])
