"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from quillmark.operators.detectors import detect
    from quillmark.operators.masking import mask
    from quillmark.operators.report import check, corpus_counts
    from quillmark.sources.files import spread

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = lambda: spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    pages = lambda: spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.lit("html").alias("lang")))
    runs = {
        "check_report": lambda: check(docs()),
        "word_lists": lambda: detect(docs(), rules=["overused-intensifiers", "elevated-register", "filler-adverbs", "metaphor-crutch"]),
        "sentence_rules": lambda: detect(docs(), rules=["staccato-burst", "hedge-stack", "anaphora-abuse", "gerund-litany"]),
        "html_report": lambda: check(mask(pages()), lang="lang", masked="masked"),
        "corpus_by_source": lambda: corpus_counts(detect(docs()), "source"),
    }
    spark.range(1).count()
    took = {}
    for name, run in runs.items():
        t = time.time()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    n_bytes = docs().agg(F.sum(F.octet_length("text"))).first()[0]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2],
        "mb_per_second_check_report": round(n_bytes / 1e6 / took["check_report"], 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
