"""Interval counts and restored texts against plain loops, and their time."""

import random
import time

from pyspark.sql import functions as F

from quillmark.functions.spans import count_overlapping, once, overlaps, ranks, restore
from quillmark.operators.report import suppressed

RANGES = "array<struct<start:int,end:int,kind:string>>"


def test_counts_as_in_a_plain_loop(spark):
    r = random.Random(3)
    rows = []
    for i in range(60):
        spans = [(a, a + r.choice([0, 1, 5, 30])) for a in (r.randint(0, 60) for _ in range(r.randint(0, 9)))]
        ranges = [(a, a + r.choice([0, 1, 4, 40]), r.choice(["heading", "list-item"])) for a in (r.randint(0, 60) for _ in range(r.randint(0, 9)))]
        rows.append((i, [s for s, _ in spans], [e for _, e in spans], ranges))
    df = spark.createDataFrame(rows, f"i int, s array<int>, e array<int>, r {RANGES}")
    c = [F.col(x) for x in ("s", "e", "r")]
    for row in df.select("*", count_overlapping(*c, "list-item").alias("n"), overlaps(*c, "heading").alias("y")).collect():
        meets = lambda s, e, kind: sum(k == kind and a < e and b > s for a, b, k in row["r"])  # noqa: B023, E731
        assert row["n"] == [meets(s, e, "list-item") for s, e in zip(row["s"], row["e"], strict=True)]
        assert row["y"] == [meets(s, e, "heading") > 0 for s, e in zip(row["s"], row["e"], strict=True)]


def test_ranks_of_ties(spark):
    row = spark.range(1).select(ranks(F.array(*map(F.lit, [5, 1, 5, 9])), F.array(*map(F.lit, [5, 6, 0, 10, 5]))).alias("r")).first()
    assert row["r"] == [1, 3, 0, 4, 1]


def test_restored_between_characters_only(spark):
    df = spark.createDataFrame([(1, "aé😀z")], "i int, t string").withColumn("raw", F.col("t").cast("binary"))
    at = [(0, 1), (1, 3), (2, 3), (1, 2), (3, 7), (3, 5), (7, 8), (7, 9), (-1, 2), (3, 1), (8, 8), (0, 8)]
    every = lambda raw: F.array(*(restore(raw, F.lit(a), F.lit(b), F.lit("?")) for a, b in at))
    got = df.select(once(F.col("raw"), every).alias("x")).first()["x"]
    assert got == ["a", "é", "?", "?", "😀", "?", "z", "?", "?", "?", "", "aé😀z"]


def test_many_violations_by_many_ranges_take_linear_time(spark):
    """10,000 of each: no violation looks at all ranges, none encodes the text."""

    def took(n):
        violation = "struct<rule_id:string,start_index:int,end_index:int,matched_text:string>"
        df = spark.range(1).select(
            F.lit("markdown").alias("lang"), F.repeat(F.lit("é words "), n).alias("text"),
            F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.when(i % 2 == 0, "dramatic-fragment").otherwise("staccato-burst").alias("rule_id"), (i * 9).alias("start_index"), (i * 9 + 8).alias("end_index"), F.lit(" ").alias("matched_text"))).cast(f"array<{violation}>").alias("violations"),
            F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 9 + 4).alias("start"), (i * 9 + 5).alias("end"), F.when(i % 3 == 0, "heading").otherwise("list-item").alias("kind"))).cast(RANGES).alias("ranges"),
        ).repartition(1)
        t = time.time()
        row = suppressed(df, "lang").select(F.size("violations"), F.expr("violations[0].matched_text")).first()
        assert row[0] > n / 2 and row[1] == "é words"
        return time.time() - t

    took(10)
    small, large = took(2_500), took(10_000)
    assert large < 6 * small + 2, (small, large)
