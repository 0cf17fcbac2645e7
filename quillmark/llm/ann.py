"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors less the mean, turned by learned rotations (iterative
quantization on a bounded sample; several independently started ones), one bit
a coordinate. A code is split into substrings, each with an index from
substring to rows. Two codes within Hamming distance r agree within r // m on
at least one of m substrings, so probing every index entry within r // m and
then counting bits retrieves *all* codes within r. Those are ranked by their
float distance in double precision.

The radius is measured, not guessed: the true neighbours of CALIBRATION queries,
found among all rows, tell how many bits apart neighbours are. Queries that get
fewer than k answers within it are searched again with a larger one.

Rows stay where they are stored: a task indexes its rows, SHARD by SHARD, and
answers a block of queries (broadcast, of bounded size) from the index. More
queries than a block holds take more passes over the table, not more copies of it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import written

FOUND = "query_id long, vec_id long, score double, apart int"
#: Queries whose true neighbours set the radius, and the share of these neighbours that it must hold.
CALIBRATION, HELD = 64, 0.99


class Codes:
    """Mean and rotations; pickles small (a few tens of KB)."""

    def __init__(self, mean: np.ndarray, turns: np.ndarray, substring: int):
        self.mean, self.turns, self.substring = mean, turns, substring

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Packed codes, one row of bytes a vector."""
        return np.packbits((x - self.mean) @ self.turns >= 0, axis=1)


def _itq(v: np.ndarray, r: np.random.Generator, rounds: int = 25) -> np.ndarray:
    turn = np.linalg.qr(r.normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = w.T @ u.T
    return turn


def learn(x: np.ndarray, bits: int = 256, substring: int = 16, seed: int = 5) -> Codes:
    """Rotations from a sample; a whole number of substrings, one at least."""
    r = np.random.default_rng(seed)
    mean = x.mean(0)
    turns = np.concatenate([_itq(x - mean, r) for _ in range(max(1, -(-max(bits, substring) // x.shape[1])))], axis=1)
    return Codes(mean, turns[:, : max(bits, substring) // substring * substring], substring)


@lru_cache(maxsize=4)
def ball(width: int, reach: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``reach`` bits set, fewest first."""
    every = np.arange(1 << width, dtype=np.uint32)
    weight = np.bitwise_count(every)
    return every[np.argsort(weight, kind="stable")][: int((weight <= reach).sum())]


class Index:
    """Multi-index over one shard: by substring, a table from its value to the rows that have it."""

    def __init__(self, codes: np.ndarray, substring: int):
        self.codes, self.width = codes, substring
        size = substring // 8
        self.keys = [self._value(codes[:, lo : lo + size]) for lo in range(0, codes.shape[1] - codes.shape[1] % size, size)]
        self.parts = []
        for keys in self.keys:
            begin = np.zeros((1 << substring) + 1, np.int32)
            np.cumsum(np.bincount(keys, minlength=1 << substring), out=begin[1:])
            self.parts.append((begin, np.argsort(keys, kind="stable").astype(np.int32)))
        self.probed = 0

    @staticmethod
    def _value(part: np.ndarray) -> np.ndarray:
        value = np.zeros(len(part), np.uint32)
        for column in part.T:
            value = value << np.uint32(8) | column
        return value

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows whose code is within ``radius`` bits, and how many bits each is away: by probing every
        substring's table at each value within radius // substrings bits of the query's, then a full count."""
        size = self.width // 8
        masks = ball(self.width, min(self.width, radius // max(1, len(self.parts))))
        hit = np.zeros(len(self.codes), bool)
        for i, (begin, order) in enumerate(self.parts):
            at = masks ^ self._value(code[None, i * size : (i + 1) * size])[0]
            lo, n = begin[at], begin[at + 1] - begin[at]
            lo, n = lo[n > 0], n[n > 0]
            hit[order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        rows = np.flatnonzero(hit)
        self.probed += len(rows)
        c, pad = self.codes[rows], -self.codes.shape[1] % 8
        if pad:
            c, code = np.pad(c, ((0, 0), (0, pad))), np.pad(code, (0, pad))
        far = np.bitwise_count(np.ascontiguousarray(c).view(np.uint64) ^ np.ascontiguousarray(code).view(np.uint64)).sum(1, dtype=np.int64)
        return rows[far <= radius], far[far <= radius]


def usable(embedding: str = "embedding"):
    """Not null, not empty, every component finite, not all zero."""
    e = F.col(embedding)
    ok = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & ok & F.exists(e, lambda v: v != 0)


def search(
    spark: SparkSession,
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    key: str = "vec_id",
    embedding: str = "embedding",
    sample: int = 4096,
    shard_rows: int = 65_536,
    block_rows: int = 32_768,
    bits: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by Euclidean distance.

    Ties go to the smaller id; a row is no candidate of a query of the same id. Vectors that are
    null, zero or hold null or non-finite components, and rows with a null id, take no part;
    a vector whose length differs from the first sampled one's takes none either. A query gets k
    answers if there are k candidates: where the radius holds fewer, it grows for that query, to all
    bits in the end. Repeated rows of one id count once, by the nearest; a repeated query is asked once.
    ``sample`` bounds the vectors that the rotations are learned from (the first in hash order).
    """
    base = vectors.where(F.col(key).isNotNull() & usable(embedding)).select(
        F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")
    )
    few = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not few:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(few[0]["e"])
    codes = learn(np.array([r["e"] for r in few if len(r["e"]) == dim]), bits=bits)
    base = base.where(F.size("e") == dim)
    asked = queries.where(F.col(key).isNotNull() & usable(embedding)).select(
        F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")
    ).where(F.size("e") == dim).dropDuplicates(["vec_id"])
    blocks = max(1, -(-asked.count() // block_rows))
    asked = written(spark, asked.withColumn("block", F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.lit(blocks)).cast("int")), "ann-queries")
    bits = codes.turns.shape[1]
    every = base.agg(F.count_distinct("vec_id")).first()[0] <= k + 1

    def answers(some: DataFrame, radius: int, name: str) -> DataFrame:
        """The k nearest within ``radius`` bits of each query in ``some``, one pass over the rows by block."""
        found = None
        for block in range(blocks):
            rows = some.where(F.col("block") == block).select("vec_id", "e").collect()  # block_rows or few more
            if rows:
                got = base.mapInArrow(_answering(codes, [r["vec_id"] for r in rows], np.array([r["e"] for r in rows]), radius, k, shard_rows), FOUND)
                found = got if found is None else found.unionByName(got)
        if found is None:
            return spark.createDataFrame([], FOUND)
        near = Window.partitionBy("query_id").orderBy("score", "vec_id")
        one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.min("apart").alias("apart"))
        return written(spark, one.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k), f"ann-{name}")

    # every query's neighbours in a table of k candidates are all of them
    radius = bits
    if not every:
        few = asked.orderBy(F.xxhash64(F.lit("c"), "vec_id"), "vec_id").limit(CALIBRATION)
        apart = answers(few, bits, "calibration").agg(F.percentile("apart", F.lit(HELD))).first()[0]
        radius = bits if apart is None else int(np.ceil(apart))
    best, left = None, asked
    while True:
        got = answers(left, radius, "answers")
        full = got.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
        if radius < bits:
            left = written(spark, left.join(full, "vec_id", "left_anti"), "ann-left")
            again = left.count()
        else:
            again = 0
        done = got if not again else got.join(left.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
        best = done if best is None else best.unionByName(done)
        if not again:
            break
        radius = min(bits, radius + 2 * bits // codes.substring)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _answering(codes: Codes, asked: list[int], q: np.ndarray, radius: int, k: int, shard_rows: int):
    """A function over Arrow batches of (vec_id, e): by shard, each query's k nearest rows within the radius."""
    q_codes = codes.encode(q)

    def shard(parts: list):
        import pyarrow as pa

        ids = np.concatenate([p.column(0).to_numpy() for p in parts])
        x = np.concatenate([p.column(1).flatten().to_numpy() for p in parts]).reshape(len(ids), -1)
        index, out = Index(codes.encode(x), codes.substring), []
        for i, qid in enumerate(asked):
            near, apart = index.within(q_codes[i], radius)
            other = ids[near] != qid
            near, apart = near[other], apart[other]
            far = ((x[near] - q[i]) ** 2).sum(1)
            if len(near) > k:  # repeated ids may take k places: as many more
                most = k + len(near) - len(np.unique(ids[near]))
                if len(near) > most:
                    few = np.flatnonzero(far <= np.partition(far, most - 1)[most - 1] * (1 + 1e-12))
                    near, apart = near[few], apart[few]
            score = np.sqrt(np.cumsum((x[near] - q[i]) ** 2, axis=1)[:, -1])  # added in order, as a plain loop does
            order = np.lexsort((ids[near], score))
            _, once = np.unique(ids[near][order], return_index=True)
            order = order[np.sort(once)][:k]  # each id by its nearest row
            out.append((np.full(len(order), qid), ids[near][order], score[order], apart[order].astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score", "apart"])

    def work(batches):
        parts, held = [], 0
        for b in batches:
            parts.append(b)
            held += b.num_rows
            if held >= shard_rows:
                yield shard(parts)
                parts, held = [], 0
        if held:
            yield shard(parts)

    return work


def op1_ann(spark, sf_dir):
    """The 10 nearest of every row whose vec_id is divisible by 100, among all rows of ``embeddings``."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(spark, v, v.where("vec_id % 100 = 0"))
