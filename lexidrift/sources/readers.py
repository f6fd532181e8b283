"""Readers of text folders, CSV and JSON lines exports, lists and study folders. Paths may be anything Spark reads."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexidrift.operators.resampling import ClusterParams

RECORDS = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "source_id", "model", "domain", "attack", "decoding", "repetition_penalty", "prompt", "title", "generation")])
ANSWERS = T.StructType([T.StructField("question", T.StringType()), T.StructField("human_answers", T.ArrayType(T.StringType())), T.StructField("chatgpt_answers", T.ArrayType(T.StringType())), T.StructField("source", T.StringType())])
METADATA = T.StructType([T.StructField(c, T.StringType()) for c in ("file", "partition", "source", "source_id", "matched_source_id", "model", "domain", "chars")])
COUNTS = T.StructType([T.StructField("domain", T.StringType()), T.StructField("source", T.StringType()), T.StructField("model", T.StringType()), T.StructField("S", T.LongType()), T.StructField("P", T.LongType()), T.StructField("skeletons", T.MapType(T.StringType(), T.LongType()))])


def text_folder(spark: SparkSession, path: str, corpus: str | None = None) -> DataFrame:
    """`(doc_id, text)`, and `corpus` if named: every `.txt` file below `path` is a document; none is an error.

    Line ends become LF; the file's path is the document's id.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("doc_id"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))
    if not files.limit(1).count():
        raise FileNotFoundError(f"no .txt file below {path}")
    return files.select(F.lit(corpus).alias("corpus"), "doc_id", "text") if corpus else files


def texts(spark: SparkSession, values: list[str], corpus: str = "texts") -> DataFrame:
    """`(corpus, doc_id, text)` of texts in memory."""
    return spark.createDataFrame([(corpus, i, v) for i, v in enumerate(values)], "corpus string, doc_id long, text string")


def records_csv(spark: SparkSession, path: str) -> DataFrame:
    """The records export: quoted fields of any length with line ends and doubled quotes in them; further columns are dropped."""
    names = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, samplingRatio=0.000001, enforceSchema=False).columns
    whole = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, schema=whole)
    return rows.select(*(F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in RECORDS.names))


def answers_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """`(file, line_no, question, human_answers, chatgpt_answers, source)`; blank lines are skipped but numbered, from 0."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "line"))
    return files.where("trim(line) <> ''").select("file", "line_no", F.from_json("line", ANSWERS).alias("r")).select("file", "line_no", "r.*")


def cluster_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents `(phase, domain, source_id, model, text)` and sources `(source_id, title, prompt)` of `phase/domain/source/*.txt`."""
    part = F.split("doc_id", "/")
    files = text_folder(spark, path).select(F.element_at(part, -4).alias("phase"), F.element_at(part, -3).alias("domain"), F.element_at(part, -2).alias("source_id"), F.regexp_replace(F.element_at(part, -1), r"\.txt$", "").alias("model"), "text")
    named = files.where(F.col("model").isin("title", "prompt"))
    sources = named.groupBy("source_id").agg(*(F.coalesce(F.max(F.when(F.col("model") == c, F.col("text"))), F.lit("")).alias(c) for c in ("title", "prompt")))
    return files.where(~F.col("model").isin("title", "prompt")), sources


def calibration_folder(spark: SparkSession, path: str) -> DataFrame:
    """`(domain, source_id, model, text)` of `domain/source/model.txt`."""
    part = F.split("doc_id", "/")
    return text_folder(spark, path).select(F.element_at(part, -3).alias("domain"), F.element_at(part, -2).alias("source_id"), F.regexp_replace(F.element_at(part, -1), r"\.txt$", "").alias("model"), "text").where(~F.col("model").isin("title", "prompt"))


def anchor_list(path: str | Path) -> list[str]:
    """Anchors of a file, one on a line, blank lines dropped, sorted, each once."""
    return sorted({x.strip() for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip()})


def exclusion_list(spark: SparkSession, path: str) -> DataFrame:
    """`(source_id)` of a list with one id on a line; blank lines and those that begin with # are dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("source_id"))
    return lines.where("source_id <> '' and not startswith(source_id, '#')").distinct()


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """The first study's metadata."""
    return spark.read.csv(path, header=True, schema=METADATA)


def counts_json(spark: SparkSession, path: str) -> DataFrame:
    """`(doc_id, domain, source, model, S, P, skeletons)` of a file of counts by document."""
    return spark.read.json(path, schema=COUNTS, multiLine=True).withColumn("doc_id", F.monotonically_increasing_id())


def params_json(path: str | Path) -> ClusterParams:
    """Simulation parameters of a JSON file, checked."""
    params = ClusterParams(**json.loads(Path(path).read_text(encoding="utf-8")))
    params.validate()
    return params


def verified(path: str | Path, expected: str) -> Path:
    """`path`, once its SHA-256 is the expected one; there is no download, data is local."""
    from lexidrift.functions.integrity import file_sha256

    found = file_sha256(path)
    if found != expected:
        raise ValueError(f"{path} has the hash {found}, not {expected}")
    return Path(path)
