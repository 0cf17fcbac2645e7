"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate ``weight * target / rows``. A row's
number of copies is a Poisson variable with that mean, found by inverting the
distribution at a hash of seed and row key, so a rerun, another partitioning
or a lost executor gives the same copies. The copies are then put in one
global order by another hash. Everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A mean above this is drawn as a sum of independent Poisson variables, so exp(-mean) can't underflow.
STEP = 16.0
#: Terms of the distribution function for one such part; P(more) is below 1e-20 at STEP.
TERMS = 70


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of md5 over the parts, joined by ':'."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _cdf(mean: Column) -> Column:
    """Partial sums P(X <= k) for k < TERMS."""
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        zero,
        lambda s, k: F.struct(
            (s["p"] * mean / k).alias("p"),
            F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c"),
        ),
    )
    return grown["c"]


def rates(docs: DataFrame, group: str, weights: dict | None, alpha: float, target: float | None) -> DataFrame:
    """One row per source: its rate, its number of parts and the distribution function of a part."""
    n = docs.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    if weights is None:
        w = F.pow(F.col("_n").cast("double"), F.lit(alpha))
    else:
        w = F.lit(0.0)
        for k, v in weights.items():
            w = F.when(F.col("_g") == k, F.lit(float(v))).otherwise(w)
    n = n.withColumn("_w", w)
    total = n.agg(F.sum("_w").alias("_tw"), F.sum("_n").alias("_tn"))
    want = F.col("_tn").cast("double") if target is None else F.lit(float(target))
    rate = F.when(F.col("_tw") > 0, F.col("_w") / F.col("_tw") * want / F.col("_n")).otherwise(F.lit(0.0))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP).cast("int"))
    return (
        n.join(F.broadcast(total))  # one row
        .withColumn("rate", rate)
        .withColumn("_parts", parts)
        .select("_g", "rate", "_parts", _cdf(F.col("rate") / F.col("_parts")).alias("_cdf"))
    )


def poisson_mix(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    weights: dict | None = None,
    alpha: float = 0.5,
    target: float | None = None,
    seed: str = "mix-1",
) -> DataFrame:
    """Rows of ``docs``, each repeated as drawn, in a global random order.

    Adds ``copy`` (from 1), ``copies``, ``rate`` and ``shuffle_key``. Weights by
    source; those not named get none. Without weights a source of n rows gets
    weight n**alpha. ``target`` is the wanted number of rows (default: as many as there are).
    A null source is a source of its own (weight by alpha only), a null key counts as
    the empty string, repeated rows draw alike, an empty table gives an empty one.
    Texts are never looked at. Columns of ``docs`` that bear an added name are replaced.
    """
    docs = docs.drop("copy", "copies", "rate", "shuffle_key", "_g", "_parts", "_cdf")
    r = rates(docs, group, weights, alpha, target)
    key_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    draws = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda j: uniform(seed, key_text, j.cast("string")))
    copies = F.aggregate(draws, F.lit(0), lambda a, u: a + F.size(F.filter("_cdf", lambda c: c <= u)))
    shuffle_key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), key_text, F.col("copy").cast("string")).cast("binary"))
    return (
        docs.join(r, docs[group].eqNullSafe(r["_g"]), "inner")
        .withColumn("copies", copies)
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .withColumn("shuffle_key", shuffle_key)
        .drop("_g", "_parts", "_cdf")
        .orderBy("shuffle_key", key, "copy")
    )


def op10_mixing(spark, sf_dir):
    """Sources of ``documents`` mixed to weights in proportion to the square root of their rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    return poisson_mix(docs).select(
        "doc_id", "source", "n_chars", "copy", "copies", F.round("rate", 6).alias("rate"), "shuffle_key"
    )


def mix_sql(table: str = "documents", columns: str = "doc_id, source, n_chars", alpha: float = 0.5, seed: str = "mix-1") -> str:
    """DuckDB SQL for the same rows (weights by alpha, target as many rows as there are)."""
    u = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '') || ':' || j::varchar), 1, 13))::bigint / {1 << 52}.0::double"
    return f"""
WITH RECURSIVE n AS (SELECT source AS g, count(*) AS n, pow(count(*)::double, {alpha}) AS w FROM {table} GROUP BY source),
r AS (SELECT g, w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n)::double / n AS rate FROM n),
p AS (SELECT g, rate, greatest(1, ceil(rate / {STEP}))::int AS parts FROM r),
c AS (SELECT g, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS c, rate / parts AS m FROM p
      UNION ALL SELECT g, k + 1, p * m / (k + 1), c + p * m / (k + 1), m FROM c WHERE k < {TERMS - 1}),
d AS (SELECT {', '.join('t.' + x.strip() for x in columns.split(','))}, p.rate, p.parts, p.g FROM {table} t JOIN p ON t.source IS NOT DISTINCT FROM p.g),
u AS (SELECT d.*, j, {u} AS u FROM d, LATERAL (SELECT unnest(range(1, parts + 1)) AS j)),
k AS (SELECT u.*, (SELECT count(*) FROM c WHERE c.g IS NOT DISTINCT FROM u.g AND c.c <= u.u) AS k FROM u),
s AS (SELECT {columns}, rate, sum(k)::int AS copies FROM k GROUP BY {columns}, rate)
SELECT {columns}, copy::int AS copy, copies, round(rate, 6) AS rate,
       md5('{seed}:order:' || coalesce(doc_id::varchar, '') || ':' || copy::varchar) AS shuffle_key
FROM s, LATERAL (SELECT unnest(range(1, copies + 1)) AS copy) WHERE copies > 0
"""


OP10_SQL = mix_sql()
