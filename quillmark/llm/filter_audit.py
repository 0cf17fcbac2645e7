"""Filter interaction audit by inclusion-exclusion.

Every document gets a flag for each filter it fails. For each of the 32 sets of
filters, the documents that fail all of the set are counted as a sum of flag
products: one aggregate with a map-side combine, whatever the number of rows.
All else follows from these 32 joint-failure counts by signed sums over subsets
(Moebius inversion): survivors of any prefix of any order, what a step removes,
unique failures, redundancy, and Shapley values from the Harsanyi dividends,
which here are the joint counts themselves with alternating sign.

The filter of exact copies needs one look across the table: rows meet by a
sha256 of their text, after they are combined by text, part and label, so a text
that a third of the table repeats is a handful of rows by then.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import table

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def flags(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text alone, as 0 or 1."""
    words = F.array_remove(F.split(text, SEPARATORS), "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PERCENT,
        "C": upper * 100 > F.length(text) * UPPER_PERCENT,
        "D": text.rlike(SYMBOLS),
    }
    return {k: v.cast("int") for k, v in fails.items()}


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, A to D, good, toxic, n, copies: documents combined where all but the number is the same; ``copies`` of ``n`` fail E.

    Two groups and a join of narrow rows; the join is by key, after rows of one key and text are one.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(key).alias("id"), t.alias("t"))
    narrow = base.select("part", "id", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("h"), *(v.alias(k) for k, v in flags(F.col("t")).items()))
    rows = narrow.groupBy("id", "part", "h", *"ABCD").agg(F.count("*").alias("m"))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # rows without a key find no label; they are dealt out by their text
    deal = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("h"), F.lit(1 << 16))).otherwise(F.lit(0).cast("long"))
    named = rows.withColumn("deal", deal).join(marks.withColumn("deal", F.lit(0).cast("long")), ["id", "deal"], "left")
    named = named.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("good", "toxic")})
    # of a text: how many rows, and how many of them bear its smallest id; ids that are null are smaller than none
    known = F.col("id").isNotNull()
    texts = named.groupBy("h", "part", *"ABCD", "good", "toxic").agg(
        F.sum("m").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("m"))), F.lit(0)).alias("unknown"), F.min(F.when(known, F.struct("id", "m"))).alias("least")
    )
    first = F.min("least.id").over(Window.partitionBy("h"))  # rows of one text: parts by labels at most
    spared = F.when(F.col("least.id") == first, F.col("least.m")).otherwise(0) + F.col("unknown")
    return texts.select("part", *"ABCD", "good", "toxic", "n", (F.col("n") - spared).alias("copies"))


def joint_counts(failed: DataFrame) -> DataFrame:
    """A row for each part with the arrays ``n``, ``good`` and ``toxic``: entry s counts the documents that fail every filter of the bit set s."""

    def product(s: int, weight: Column | None) -> Column:
        bits = [F.col(f) for i, f in enumerate("ABCD") if s >> i & 1]
        rows = F.col("copies") if s >> 4 & 1 else F.col("n")
        return F.sum(reduce(lambda a, b: a * b, bits, rows if weight is None else rows * weight))

    weights = {"n": None, "good": F.col("good"), "toxic": F.col("toxic")}
    sums = [product(s, w).alias(f"{k}{s}") for k, w in weights.items() for s in range(SETS)]
    wide = failed.groupBy("part").agg(*sums)
    return wide.select("part", *(F.array(*(F.col(f"{k}{s}") for s in range(SETS))).alias(k) for k in COUNTS))


def survivors(counts: Column) -> Column:
    """array<long>: entry p counts the documents that fail no filter of the bit set p, the signed sum over its subsets."""
    at = F.sequence(F.lit(0), F.lit(SETS - 1))
    signed = F.transform(counts, lambda c, s: F.when(F.bit_count(s) % 2 == 0, c).otherwise(-c))
    inside = lambda p: F.zip_with(at, signed, lambda s, c: F.when(s.bitwiseAND(p) == s, c).otherwise(0))
    return F.transform(at, lambda p: F.aggregate(inside(p), F.lit(0).cast("long"), lambda a, c: a + c))


def shapley(counts: Column, i: int) -> Column:
    """What filter i removes, summed over all orders: each set's dividend (its joint count with sign) in equal shares among its filters."""
    holding = [s for s in range(SETS) if s >> i & 1]
    return reduce(lambda a, b: a + b, (counts[s] * ((1 if s.bit_count() % 2 else -1) * len(ORDERS) // s.bit_count()) for s in holding))


def _steps() -> Column:
    """array<struct<filter_order, step, f, before, bit>>: every step of every order, with the filters before it as a bit set."""
    rows = []
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            f = FILTERS.index(name)
            rows.append(f"named_struct('filter_order', '{order}', 'step', {step}, 'f', {f}, 'before', {before}, 'bit', {1 << f})")
            before |= 1 << f
    return F.expr(f"array({', '.join(rows)})")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; 600 rows a part.

    A null text is empty and fails A only (and E, as a copy of other empty ones). A null part and '' are one part.
    Repeated rows of one key and text are no copies of each other; a null key is compared with none. Of several
    label rows of a key, any 1 counts; labels of no document count nowhere. No documents give no rows. Further
    columns, whatever their names, are not looked at.
    """
    j = joint_counts(failures(docs, labels, key, text, part))
    j = j.withColumns({f"s_{k}": survivors(F.col(k)) for k in COUNTS} | {"shares": F.array(*(shapley(F.col("n"), i) for i in range(len(FILTERS))))})
    steps = j.withColumn("x", F.explode(_steps())).select("*", "x.*")
    after = F.col("before") + F.col("bit")
    lost = lambda k: F.get(f"s_{k}", F.col("before")) - F.get(f"s_{k}", after)
    return steps.select(
        "part", "filter_order", "step",
        F.get("s_n", after).alias("kept"),
        lost("n").alias("removed"),
        (F.get("n", F.col("bit")) - lost("n")).alias("redundant"),
        (F.get("s_n", F.lit(SETS - 1) - F.col("bit")) - F.get("s_n", F.lit(SETS - 1))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shares", F.col("f")).alias("shapley"),
    )


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the five filters over all ``documents``, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same rows by going through every order step by step over the failure patterns.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS (SELECT doc_id, part, (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::int
             + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first_id, false)::int AS fails FROM w),
l AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
p AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, list_reduce(list_transform(o, lambda v: substr('ABCDE', v::int + 1, 1)), lambda a, b: a || b) AS filter_order, k::int AS step, 1 << o[k] AS bit,
             coalesce(list_sum(list_transform(o[1:k - 1], lambda v: 1 << v)), 0)::bigint AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT p.part, s.filter_order, s.step, s.bit, sum(n) FILTER (fails & (before + bit) = 0) AS kept, sum(n) FILTER (fails & before = 0 AND fails & bit > 0) AS removed,
             sum(n) FILTER (fails & before > 0 AND fails & bit > 0) AS redundant, sum(n) FILTER (fails = bit) AS unique_fails,
             sum(good) FILTER (fails & before = 0 AND fails & bit > 0) AS good_lost, sum(toxic) FILTER (fails & before = 0 AND fails & bit > 0) AS toxic_lost
      FROM p, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant,
       coalesce(unique_fails, 0)::bigint AS unique_fails, coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::bigint AS shapley
FROM r
"""
