"""The filter audit against a plain loop over every order, and its edges."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quillmark.llm.filter_audit import audit, op13_filters, shapley, survivors

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """By row, the letters of the filters that it fails."""
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            t = text or ""
            least[t] = min(least.get(t, doc_id), doc_id)
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(words) < 200:
            f.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            f.add("C")
        if re.search("[#$%&*|]", t):
            f.add("D")
        if doc_id is not None and doc_id > least[t]:
            f.add("E")
        out.append(f)
    return out


def plain(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    failed = fails(rows)
    out, shares = {}, {}
    parts = {r[2] or "" for r in rows}
    for part in parts:
        mine = [(r[0], f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                all_fail = sum(name in f for _, f in mine)
                out[part, "".join(order), step] = [
                    len(left), len(gone), all_fail - len(gone), sum(f == {name} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), (part, name)
                ]
                shares[part, name] = shares.get((part, name), 0) + len(gone)
    return {k: (*v[:-1], shares[v[-1]]) for k, v in out.items()}


def got(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


LONG = " ".join(f"word{i}" for i in range(230))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, LONG, "fr"), (4, "a b c", None), (5, "a b c", ""), (6, None, "en"), (7, "", "en"), (8, "", "de"),
    (9, LONG + " #", "en"), (10, LONG.upper(), "en"), (11, "same " * 300, "de"), (12, "same " * 300, "de"), (13, "SAME| " * 300, "fr"), (None, LONG, "en"), (None, None, None),
    (14, "x" * 300_000 + " y" * 400, "en"), (15, "é è " * 250, "fr"), (16, "A\x0bB\x1cC " * 70, "en"), (17, LONG, None), (-3, LONG + "$", "en"), (9, LONG + "$", "en"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (7, 1, None), (7, None, 1), (11, 1, 0), (12, 1, 1), (99, 1, 1), (None, 1, 1), (10, 0, 0)]


def test_every_order_as_a_plain_loop(spark):
    docs, labels = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(MARKS, LABELS)
    assert got(audit(docs, labels)) == plain(ROWS, MARKS)


@pytest.mark.parametrize("parts", [1, 7])
def test_hot_text_and_clashing_columns(spark, parts):
    rows = [(i, LONG if i % 3 else f"only {i} #", "en" if i % 2 else "de") for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(parts)
    for name in ("n", "part", "h", "id", "good", "copies", "least", "A", "step", "shares"):
        docs = docs.withColumn(name, F.lit("clash"))
    labels = spark.createDataFrame(MARKS, LABELS).withColumn("n", F.lit(5)).withColumn("text", F.lit("?"))
    assert got(audit(docs, labels)) == plain(rows, MARKS)


def test_no_documents_and_no_labels(spark):
    none = spark.createDataFrame([], DOCS)
    assert audit(none, spark.createDataFrame(MARKS, LABELS)).collect() == []
    found = got(audit(spark.createDataFrame(ROWS, DOCS), spark.createDataFrame([], LABELS)))
    assert found == plain(ROWS, [])


def test_shares_add_up_and_survivors_invert(spark):
    counts = [1000 - 30 * s.bit_count() ** 2 if s else 1000 for s in range(32)]
    row = spark.createDataFrame([(counts,)], "c array<long>").select(survivors(F.col("c")).alias("s"), F.array(*(shapley(F.col("c"), i) for i in range(5))).alias("v")).first()
    assert row["s"][0] == 1000 and row["s"][1] == 1000 - counts[1] and row["s"][3] == 1000 - counts[1] - counts[2] + counts[3]
    assert sum(row["v"]) == 120 * (1000 - row["s"][31])


def test_query_covers_every_language(spark):
    rows = op13_filters(spark, "/root/testdata/sf0.001")
    langs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.coalesce("lang", F.lit(""))).distinct().count()
    assert rows.count() == 600 * langs
