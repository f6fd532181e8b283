"""Writers of result tables, study corpora and provenance files."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidrift.functions.constants import MIN_CHARS
from lexidrift.functions.integrity import canonical_text_sha256, json_sha256


def result_csv(rows: DataFrame, path: str | Path) -> int:
    """One CSV file with a header, rows streamed in their order; no rows give a file of zero bytes. Returns the number of rows."""
    import csv

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with target.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        for row in rows.toLocalIterator():
            if not n:
                out.writerow(rows.columns)
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def partitioned(rows: DataFrame, path: str, *by: str) -> None:
    """Parquet partitioned by columns, replacing what was there."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def numbered_study(study: DataFrame) -> DataFrame:
    """`study` with `file`, its name within the partition, numbered by domain and rank of the id."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("partition").orderBy("domain", F.sha2("doc_id", 256), "doc_id")
    return study.withColumn("file", F.format_string("doc%04d.txt", F.row_number().over(order)))


def study_corpus(study: DataFrame, path: str) -> None:
    """The first study's corpus: parquet by partition, and metadata beside it."""
    named = numbered_study(study)
    partitioned(named, f"{path}/documents", "partition")
    named.select("file", "partition", "domain", "model", "source_id", F.length("text").alias("chars")).write.mode("overwrite").csv(f"{path}/metadata", header=True)


def cell_corpus(study: DataFrame, path: str) -> None:
    """The second study's corpus by phase and domain, with each document's canonical hash."""
    hashed = study.withColumns({"sha256": canonical_text_sha256(F.col("text")), "chars": F.length("text")})
    partitioned(hashed, f"{path}/documents", "phase", "domain")
    hashed.select("phase", "domain", "source_id", "model", "chars", "sha256").write.mode("overwrite").csv(f"{path}/metadata", header=True)


def exclusion_file(sources: DataFrame, path: str | Path) -> int:
    """The list of sources, sorted, one on a line."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with target.open("w", encoding="utf-8") as f:
        for row in sources.select("source_id").distinct().orderBy("source_id").toLocalIterator():
            f.write(row["source_id"] + "\n")
            n += 1
    return n


def summary_json(values: dict[str, Any], path: str | Path) -> None:
    """A JSON file of aggregates, keys in order."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(values, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def calibration(rows: DataFrame, wanted: int, path: str) -> dict[str, Any]:
    """The calibration documents `(domain, source_id, model, text)` as parquet by domain, the exclusion list, and the summary, which is returned."""
    partitioned(rows, f"{path}/documents", "domain")
    listed = exclusion_file(rows, f"{path}/exclusions.txt")
    domains = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.countDistinct("source_id").alias("n")).collect()}
    models = sorted(r["model"] for r in rows.select("model").distinct().collect())
    summary = {"first_study_sources": wanted, "complete_clusters": listed, "by_domain": domains, "models": models, "filters": {"attack": "none", "decoding": "greedy", "repetition_penalty": "no", "min_chars": MIN_CHARS}}
    summary_json(summary, f"{path}/summary.json")
    return summary


def provenance(values: dict[str, Any], path: str | Path) -> str:
    """A JSON file of aggregates with its own canonical hash in it; returns the hash."""
    digest = json_sha256(values)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(values | {"self_sha256": digest}, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    return digest


def frozen_candidates(found: DataFrame, path: str | Path) -> str:
    """The candidates as JSON in code-point order, and a `.sha256` file beside it; returns the hash.

    Candidates are what the thresholds leave; they reach the driver row by row.
    """
    import hashlib

    rows = [r.asDict() for r in found.orderBy("kind", "pattern").toLocalIterator()]
    payload = json.dumps(rows, ensure_ascii=False, indent=1).encode()
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(payload)
    digest = hashlib.sha256(payload).hexdigest()
    target.with_suffix(".sha256").write_text(f"{digest}  {target.name}\n", encoding="utf-8")
    return digest


def document_counts(sizes: DataFrame, skeletons: DataFrame, path: str) -> None:
    """Counts by document as parquet: sentences, pairs, and a list of (kind, pattern, n), so no family hides another."""
    listed = skeletons.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "pattern", "n")).alias("skeletons"))
    sizes.join(listed, "doc_id", "left").write.mode("overwrite").parquet(path)


def summary(rows: DataFrame, columns: tuple[str, ...]) -> str:
    """Lines of a small result for the console."""
    return "\n".join("  ".join(f"{c}={row[c]}" for c in columns) for row in rows.toLocalIterator())
