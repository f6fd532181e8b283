"""Problem 2: the share of each document that repeats what it said before.

Letters are letters and digits in lower case; all else is left out. Rolling hashes of
every window of n letters are compared within a document: a window whose content began
earlier in it is repeated, and every letter under such a window counts once. All
documents of an Arrow batch are hashed together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Window lengths, in letters, that the general report measures.
LENGTHS = (30, 60, 120)
#: A record is repetitive from this share on.
MIN_SHARE = 0.30
#: Letters hashed together; bounds a worker's memory, not what is read.
CHUNK = 4_000_000

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_TABLE: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point its lower-case form, or 0 where it is no letter or digit."""
    global _TABLE
    if _TABLE is None:
        table = np.zeros(0x110000, dtype=np.uint32)
        for cp in range(0x20000):
            c = chr(cp)
            if c.isalnum():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        table[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)  # ideographs beyond the basic plane
        _TABLE = table
    return _TABLE


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points and text numbers of all characters, then of the letters alone, in lower case."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    low = letter_table()[points]
    keep = low != 0
    return points, owner, low[keep], owner[keep]


def repeated_letters(letters: np.ndarray, owner: np.ndarray, n: int, texts: int) -> np.ndarray:
    """For each text the number of its letters under windows of `n` that began earlier in it."""
    out = np.zeros(texts, dtype=np.int64)
    size = len(letters)
    if size < 2 * 1 or size <= n:
        return out
    with np.errstate(over="ignore"):
        powers = np.full(size, _BASE, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        inverse = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_mix(letters.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
        starts = np.flatnonzero(owner[: size - n + 1] == owner[n - 1 :])
        if not len(starts):
            return out
        hashes = _mix((sums[starts + n] - sums[starts]) * inverse[starts]) ^ _mix(owner[starts].astype(np.uint64) + np.uint64(77))
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    where = np.searchsorted(twice, hashes)
    where[where == len(twice)] = 0
    many = np.flatnonzero(twice[where] == hashes)  # windows, in order of position, whose hash occurs again
    first = np.full(len(twice), -1, dtype=np.int64)
    group = where[many]
    first[group[::-1]] = starts[many[::-1]]
    later = starts[many]
    source = first[group]
    later, source = later[later > source], source[later > source]
    # an exact look at every window found equal, so that no hash collision counts
    same = np.ones(len(later), dtype=bool)
    for k in range(0, n):
        same &= letters[later + k] == letters[source + k]
    later = later[same]
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, later, 1)
    np.add.at(steps, later + n, -1)
    covered = np.cumsum(steps[:size]) > 0
    return np.bincount(owner[covered], minlength=texts)


def _line_repeats(text: str) -> int:
    """Letters in lines that stood, word for word, in an earlier line of the text."""
    seen: set[str] = set()
    total = 0
    for line in text.split("\n"):
        bare = "".join(filter(str.isalnum, line.lower()))
        if bare:
            total += len(bare) * (bare in seen)
            seen.add(bare)
    return total


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def repetition_scores(records: DataFrame, key: str = "id", text: str = "generation", carry: Sequence[str] = (), lengths: Sequence[int] = LENGTHS, lines: bool = True, least: float = 0.0) -> DataFrame:
    """`(key, *carry, letters, repeated_<n>…, share_<n>…, repeated_lines, share_lines)` per row.

    Null and empty texts have no letters and shares of 0. With `least`, only rows whose
    share at the first length reaches it come out. Repeated rows give repeated results.
    Texts of any length are read whole.
    """
    carry = [c for c in carry if c not in (key, text)]
    kept = records.select(key, *carry, F.col(text).alias("_text"))
    fields = [f for f in kept.schema.fields if f.name != "_text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    ddl += ", letters long" + "".join(f", repeated_{n} long, share_{n} double" for n in lengths) + (", repeated_lines long, share_lines double" if lines else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for lo, hi in _chunks(values):
                texts = values[lo:hi]
                _, _, letters, owner = letters_of(texts)
                total = np.bincount(owner, minlength=len(texts))
                cols, shares = [pa.array(total)], []
                for n in lengths:
                    got = repeated_letters(letters, owner, n, len(texts))
                    shares.append(got / np.maximum(total, 1))
                    cols += [pa.array(got), pa.array(shares[-1])]
                if lines:
                    got = np.array([_line_repeats(t) if "\n" in t else 0 for t in texts], dtype=np.int64)
                    cols += [pa.array(got), pa.array(got / np.maximum(total, 1))]
                part = batch.slice(lo, hi - lo)
                arrays = [part.column(i) for i in range(part.num_columns - 1)] + cols
                names = [*part.schema.names[:-1], "letters", *(x for n in lengths for x in (f"repeated_{n}", f"share_{n}")), *(["repeated_lines", "share_lines"] if lines else [])]
                out = pa.RecordBatch.from_arrays(arrays, names=names)
                if least > 0:
                    out = out.filter(pa.array(shares[0] >= least - 1e-12))
                if out.num_rows:
                    yield out

    return kept.mapInArrow(run, ddl)


def repetitive_ids(records: DataFrame, n: int = LENGTHS[0], least: float = MIN_SHARE) -> DataFrame:
    """`(id)` of the records of whose letters at least `least` are repeated; each id once."""
    return repetition_scores(records, lengths=(n,), lines=False, least=least).select("id").distinct()


def repetition_by_record(records: DataFrame) -> DataFrame:
    """The scores of each id, once; of an id delivered with several texts the smallest scores stand."""
    scored = repetition_scores(records.where("id is not null"))
    rest = [c for c in scored.columns if c != "id"]
    return scored.groupBy("id").agg(F.min(F.struct(*rest)).alias("s")).select("id", *(F.col(f"s.{c}") for c in rest))


def repetition_by_penalty(records: DataFrame) -> DataFrame:
    """Mean repeated share and share of repetitive records for each setting of the penalty.

    Each id counts once; null and blank settings are one group, `none`.
    """
    scored = repetition_scores(records, carry=["repetition_penalty"], lines=True)
    once = scored.groupBy("id").agg(F.min(F.struct("repetition_penalty", "share_30", "share_60", "share_120", "share_lines")).alias("s")).select("s.*")
    setting = F.coalesce(F.nullif(F.trim(F.lower("repetition_penalty")), F.lit("")), F.lit("none"))
    return once.groupBy(setting.alias("repetition_penalty")).agg(F.count("*").alias("records"), F.avg("share_30").alias("mean_share_30"), F.avg("share_60").alias("mean_share_60"), F.avg("share_120").alias("mean_share_120"), F.avg("share_lines").alias("mean_share_lines"), F.avg((F.col("share_30") >= MIN_SHARE).cast("double")).alias("repetitive_share"))
