"""A training corpus from ``documents``: filter, deduplicate, redact, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept, and returns the columns of ``documents``; the last returns packed pieces.
Every result is written as Parquet and read again, so a lost executor repeats
part of one stage at most.

Rows with a null doc_id can't be grouped with others: they pass the
deduplication. A null text counts as an empty one everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import jaccard, mixing, packing, pii, quality
from quillmark.llm.common import scratch, table


def _apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, list]:
    """``docs`` with all columns but the needed ones under names that no operator uses, and the columns that put them back."""
    inner = [c if c in needed else f"in_{i}__" for i, c in enumerate(docs.columns)]
    return docs.toDF(*inner), [F.col(n).alias(c) for n, c in zip(inner, docs.columns, strict=True)]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; all columns as they came, whatever their names.

    A null text is scored as an empty one. Repeated rows go or stay together. Without labels every text scores
    the same constant, and all stay. No rows give none.
    """
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    inner, back = _apart(docs, "text")
    return quality.score(inner, net).where(F.col("score") >= quality.THRESHOLD).select(*back)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 80 percent, directly or through others, the one with the smallest doc_id.

    Rows of one doc_id are one document for the links: if it is kept, so is one row of each different text it has
    (null and empty are one text). Rows without a doc_id all stay. Texts without words link with nothing. All columns
    as they came, whatever their names; of rows that repeat a doc_id and text, any one's.
    """
    found = jaccard.jaccard_components(spark, docs, words=5, percent=80)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    inner, back = _apart(docs, "doc_id", "text")
    named = inner.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    named = named.withColumn("_text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).dropDuplicates(["doc_id", "_text"])
    return named.select(*back).unionByName(docs.where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text where that changes.

    Every row stays, repeated ones alike; a null text stays null, an empty one empty. All other columns as they came,
    whatever their names.
    """
    inner, back = _apart(docs, "text", "n_chars")
    clean = pii.redacted(pii.spans(inner))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to weights in proportion to the square root of their rows, in one global random order.

    Rows of a null source are a source of their own; rows of one doc_id are drawn alike, a null doc_id counts as ''.
    All columns as they came, whatever their names; the number of a copy isn't kept.
    """
    inner, back = _apart(docs, "doc_id", "source")
    return mixing.poisson_mix(inner).select(*back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; of a null or empty text, its end mark alone. Repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("jaccard", deduplicate),
    ("pii", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier's and the tokenizer's rows can't be had in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
