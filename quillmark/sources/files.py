"""Corpora from files and tables, and JSON output."""

from __future__ import annotations

import json
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.masking import lang_column, resolve_lang

DOCUMENT = "doc_id long, path string, text string, lang string"


def read_files(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """One row per file under ``path``: DOCUMENT. Bytes that are no UTF-8 become replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.coalesce(F.expr("try_validate_utf8(cast(content as string))"), F.expr("make_valid_utf8(cast(content as string))"))
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", text.alias("text"), lang_column(F.col("path"), lang).alias("lang"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"file://{tempfile.mkdtemp(prefix='quillmark-')}").rstrip("/")


def read_table(spark: SparkSession, path: str, key: str, text: str, lang: str = "text", format: str = "parquet", **options) -> DataFrame:
    """A column of a table as documents; any format that Spark reads."""
    df = spark.read.format(format).options(**options).load(path)
    return df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.lit(resolve_lang(lang, None)).alias("lang"))


def read_input(path: str | None) -> str:
    """A file, or standard input for no path or '-'."""
    if not path or path == "-":
        return sys.stdin.buffer.read().decode("utf-8", "replace")
    with open(path, "rb") as f:
        return f.read().decode("utf-8", "replace")


def one_document(spark: SparkSession, text: str, path: str | None, lang: str | None = None) -> DataFrame:
    return spark.createDataFrame([(0, path, text, resolve_lang(lang, path))], DOCUMENT)


def to_text(value, pretty: bool = False) -> str:
    """JSON with a final newline; characters stay as they are."""
    return json.dumps(value, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":")) + "\n"


def write_reports(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Reports as JSON lines."""
    from quillmark.operators.report import report_json

    report_json(df).select("value").write.mode(mode).text(path)


def spread(df: DataFrame, per_core: int = 4) -> DataFrame:
    """Deal the rows of a small input over all cores.

    A Parquet file is split at row groups only, so a few files may hold all rows in fewer tasks than there are
    cores. Inputs of as many splits as there are cores are returned as they are: no shuffle, whatever their size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(per_core * cores)
