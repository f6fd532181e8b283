"""Problem 1: train, validation and test splits that keep related records together.

Records are related when their `source_id` values denote the same identifier, or when
one denotes the `id` of another record. Families are connected components over
identifiers, found by parallel hooking and shortcutting on a parent table; a subset-sum
over the family sizes then picks the families of each split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexidrift.llm.keys import canonical_id
from lexidrift.plans.lineage import cut

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Records by which the subset sum may depart from the greedy choice on either side; all that can matter up to families of 1,400.
REACH = 1 << 22
#: Families of one size that are numbered in one task, on average, at most.
BUCKET = 50_000


def identifier_edges(records: DataFrame) -> DataFrame:
    """Pairs `(a, b)` of canonical identifiers tied by a record: its id and its source, or two sources of one id.

    An id takes part only when some source value denotes it, or by tying the sources it was
    delivered under, so the graph has as many nodes as there are sources, not records. A
    null id ties nothing.
    """
    told = records.select("id", canonical_id(F.col("source_id")).alias("b")).where("id is not null and b is not null")
    pairs = told.select(canonical_id(F.col("id")).alias("a"), "b").where("a is not null and a <> b")
    denoted = records.select(canonical_id(F.col("source_id")).alias("a")).where("a is not null").distinct()
    several = told.groupBy("id").agg(F.min("b").alias("a"), F.max("b").alias("last")).where("a < last").select("id", "a")
    return pairs.join(denoted, "a", "left_semi").unionByName(told.join(several, "id").where("a <> b").select("a", "b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`(node, root)` for every node of `edges(a, b)`; the root is the smallest node reached.

    Each round hooks the root of the one end of an edge onto the smaller root of the
    other and then halves all paths. Edges inside a component are dropped as they
    arise, so later rounds shrink. An empty edge table gives an empty result.
    """
    edges = cut(edges)
    parent = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
    for _ in range(max_rounds):
        # shortcut until every parent is a root
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            halved = cut(parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")))
            parent = halved.select("node", "root")
            if not halved.where("moved").limit(1).count():
                break
        # hook: an edge between two trees makes the larger root a child of the smaller
        edges = cut(
            edges.join(parent.withColumnsRenamed({"node": "a", "root": "ra"}), "a")
            .join(parent.withColumnsRenamed({"node": "b", "root": "rb"}), "b")
            .where("ra <> rb")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            .distinct()
        )
        if not edges.limit(1).count():
            return parent
        hooks = edges.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("hook"))
        parent = cut(parent.join(hooks, "node", "left").select("node", F.coalesce("hook", "root").alias("root")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def source_families(records: DataFrame) -> DataFrame:
    """`(source_id, family)`: every stored source value that denotes something, with its family."""
    values = records.select("source_id").where("source_id is not null").distinct().withColumn("node", canonical_id(F.col("source_id"))).where("node is not null")
    roots = connected_components(identifier_edges(records))
    return values.join(roots, "node", "left").select("source_id", F.coalesce("root", "node").alias("family"))


def related_sources(records: DataFrame) -> DataFrame:
    """Pairs of different stored source values of one family, the smaller first."""
    families = cut(source_families(records))
    left = families.select("family", F.col("source_id").alias("source_id_1"))
    right = families.select("family", F.col("source_id").alias("source_id_2"))
    return left.join(right, "family").where("source_id_1 < source_id_2").select("source_id_1", "source_id_2")


def record_families(records: DataFrame) -> DataFrame:
    """`(id, family)`, one row per id. A record without a usable source stands by its own id."""
    roots = connected_components(identifier_edges(records))
    keyed = records.where("id is not null").groupBy("id").agg(F.min(canonical_id(F.col("source_id"))).alias("src")).select("id", F.coalesce("src", canonical_id(F.col("id")), "id").alias("node"))
    return keyed.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("family"))


def choose_counts(sizes: dict[int, int], target: int, reach: int = REACH) -> dict[int, int]:
    """How many families of each size to take so that their total comes closest to `target`.

    `sizes` maps a size to the number of families of it. A greedy choice, large families
    first, is a corner of the relaxed problem; some best choice differs from it in at most
    2m + 1 families, m being the largest size, so only totals within m (2m + 1) of it
    matter. Bit s of a Python integer says that the greedy total can be changed by s;
    multiplicities are split into powers of two. Totals beyond `reach` are not looked at, so
    the result is the closest for families of up to sqrt(reach / 2) records at any number of
    records, and for any families when all of them together stay within `reach`.
    """
    order = sorted((s for s, n in sizes.items() if n > 0), reverse=True)
    if not order:
        return {}
    taken, rest = {}, target
    for s in order:
        taken[s] = min(sizes[s], rest // s)
        rest -= taken[s] * s
    most = 2 * order[0] + 1
    width = max(1, min(order[0] * most, sum(s * sizes[s] for s in order), reach))
    middle = 2 * width
    window = ((1 << (2 * width + 1)) - 1) << width
    states, ranges = [1 << middle], []
    for s in order:
        fewer, more = (min(x, most, middle // s) for x in (taken[s], sizes[s] - taken[s]))
        bits, left, k = states[-1] >> fewer * s, fewer + more, 1
        while left:
            part = min(k, left)
            bits |= bits << part * s
            left, k = left - part, 2 * k
        states.append(bits & window)
        ranges.append((s, fewer, more))
    at = next(middle + d for gap in range(2 * width + rest + 1) for d in (rest - gap, rest + gap) if -width <= d <= width and states[-1] >> middle + d & 1)
    for (s, fewer, more), before in zip(reversed(ranges), reversed(states[:-1]), strict=True):
        d = next(d for k in range(max(fewer, more) + 1) for d in (k, -k) if -fewer <= d <= more and at >= d * s and before >> at - d * s & 1)
        taken[s] += d
        at -= d * s
    return {s: n for s, n in taken.items() if n}


def assign_splits(families: DataFrame, shares: Sequence[tuple[str, float]] = SHARES, salt: str = "split") -> DataFrame:
    """`(family, split)` from `(id, family)`: whole families, totals as near the shares as can be.

    Only the histogram of family sizes comes to the driver: at most sqrt(2n) rows for n
    records. Within a size, families are numbered by a salted hash in buckets, as many as
    keep each small, whose offsets come from per-bucket counts.
    """
    if abs(sum(s for _, s in shares) - 1) > 1e-9 or any(s < 0 for _, s in shares):
        raise ValueError("shares must be non-negative and add up to 1")
    spark = families.sparkSession
    sized = cut(families.groupBy("family").agg(F.count("*").alias("size")).withColumn("key", F.sha2(F.concat(F.lit(salt + ":"), "family"), 256)))
    histogram = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, -(-max(histogram.values(), default=0) // BUCKET))
    sized = sized.withColumn("bucket", F.conv(F.substring("key", 1, 12), 16, 10).cast("long") % buckets)
    per_bucket = sized.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    total = sum(s * n for s, n in histogram.items())
    rows, start, left = [], dict.fromkeys(histogram, 0), dict(histogram)
    for name, share in list(shares)[1:]:
        for size, n in choose_counts({s: n for s, n in left.items() if n}, round(total * share)).items():
            rows.append((size, start[size], start[size] + n, name))
            start[size] += n
            left[size] -= n
    first = shares[0][0]
    ranges = spark.createDataFrame(rows or [(0, 0, 0, first)], "size long, lo long, hi long, split string")
    offsets = per_bucket.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("size", "bucket", "before")
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("key", "family")) - 1).join(offsets, ["size", "bucket"]).select("family", "size", (F.col("rank") + F.col("before")).alias("rank"))
    hit = (ranked["size"] == ranges["size"]) & (ranked["rank"] >= ranges["lo"]) & (ranked["rank"] < ranges["hi"])
    return ranked.join(ranges, hit, "left").select("family", F.coalesce("split", F.lit(first)).alias("split"))


def split_records(records: DataFrame, shares: Sequence[tuple[str, float]] = SHARES) -> DataFrame:
    """`(id, family, split)`, one row per id; repeated deliveries of an id count once."""
    families = cut(record_families(records))
    return families.join(assign_splits(families, shares), "family").select("id", "family", "split")


def split_shares(records: DataFrame, shares: Sequence[tuple[str, float]] = SHARES) -> DataFrame:
    """Records and share of each split, over all and by tidied model and domain."""

    def tidy(c: str):
        return F.coalesce(F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "-"), F.lit("unknown"))

    labels = records.groupBy("id").agg(F.min(tidy("model")).alias("model"), F.min(tidy("domain")).alias("domain"))
    counts = split_records(records, shares).join(labels, "id").groupBy("model", "domain", "split").agg(F.count("*").alias("records"))
    whole = Window.partitionBy("model", "domain")
    return counts.withColumn("share", F.col("records") / F.sum("records").over(whole))
