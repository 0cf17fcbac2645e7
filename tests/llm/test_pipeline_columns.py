"""Every stage hands on the input's columns as they came, also where they bear names that operators use."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

CLASH = ["spans", "base", "score", "copy", "copies", "rate", "shuffle_key", "_text", "_t", "_g", "_cdf", "_more", "_email", "component_id", "n_shingles", "quality", "in_3__", "With.Dot", "a b"]
ROWS = [
    (1, "Mail joe@example.org or not, " + " ".join(f"w{i}" for i in range(30)), "s1", 5), (1, "Mail joe@example.org or not, " + " ".join(f"w{i}" for i in range(30)), "s1", 5),
    (2, None, "s1", None), (3, "", None, 0), (None, "no id here", "s2", 10), (4, "x" * 50_000 + " +1 202 555 0147", "s2", 50_016), (None, None, None, None),
]


def documents(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, n_chars long")
    for c in CLASH:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return docs


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, i % 2, 0) for i in (1, 2, 3, 4)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_stay(spark, labels, name):
    docs = documents(spark)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, labels)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    for r in rows:
        for c in CLASH:
            assert r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}", (name, c)
    ids = [r["doc_id"] for r in rows]
    if name == "jaccard":
        assert sorted(map(str, ids)) == ["1", "2", "3", "4", "None", "None"]
    if name == "pii":
        texts = {r["doc_id"]: r["text"] for r in rows if r["doc_id"]}
        sizes = {r["doc_id"]: r["n_chars"] for r in rows if r["doc_id"]}
        assert len(rows) == len(ROWS) and "joe@" not in texts[1] and "555 0147" not in texts[4] and texts[3] == ""
        assert sizes[1] == len(texts[1]) and sizes[4] == len(texts[4]) and sizes[2] is None and sizes[3] == 0
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), labels).columns == docs.columns


def test_packing_ignores_them(spark):
    pieces = corpus_pipeline.pack(spark, documents(spark), "").collect()
    assert sum(p["start"] == 0 for p in pieces) == len(ROWS)


def test_null_texts_in_redaction(spark):
    out = corpus_pipeline.redact(spark, spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), "").orderBy("doc_id").collect()
    assert [r["text"] for r in out] == [None, ""]
