"""Embedding near-duplicates by cross-polytope hashing.

Fast pseudo-random rotations (three rounds of random signs and a Walsh-Hadamard
transform) turn the unit vectors; a hash is the index and sign of the largest
coordinate, a table's bucket is ``length`` such hashes and the label. Each row
is filed in its own bucket of every table and also looks into the next best ones
(multiprobe). Pairs that meet are candidates; only pairs whose cosine, in double
precision, reaches the threshold are links.

Equal vectors of a label are one node with a weight, so copies are never
expanded into pairs. A bucket with many visitors is dealt into blocks of about
BLOCK, and every two blocks meet in a cell of their own, so no bucket is one
task's work. Inside a cell pairs exist as numpy indices only: what leaves it is a
count by node and a spanning forest of its links. A pair that meets in several
buckets counts in the first alone, which both nodes' codes tell.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.ann import usable
from quillmark.llm.common import mix, written
from quillmark.llm.components import components

#: Share of pairs right at the threshold that may meet in no table, at any hash length.
MISS = 5e-4
#: A length that would need more tables than this gives way to a shorter one, which finds as much in larger buckets.
MOST_TABLES = 64

#: Visitors of a block, and pairs whose cosines are taken at once.
BLOCK, PAIRS = 256, 1 << 15
HASHES = "node long, w long, label string, dims int, vec binary, codes binary, visits array<struct<t:int,code:int,own:boolean>>"
VISITS = ("cell", "side", "same", "t", "code", "own", "node", "w", "label", "dims", "vec", "codes")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def cross_polytope(u: np.ndarray, table: int, place: int, seed: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """By row, the ``most`` best hash values in one rotation and how much worse each is than the first."""
    width = 1 << max(1, (u.shape[1] - 1).bit_length())
    r = np.random.default_rng([seed, table, place])
    x = np.zeros((len(u), width))
    x[:, : u.shape[1]] = u
    for _ in range(3):
        x = hadamard(x * r.choice([-1.0, 1.0], width))
    size = np.abs(x)
    top = np.argsort(-size, axis=1, kind="stable")[:, :most]
    best = np.take_along_axis(size, top, 1)
    return top * 2 + (np.take_along_axis(x, top, 1) < 0), (best[:, :1] - best) ** 2


def table_codes(u: np.ndarray, tables: int, length: int, probes: int, seed: int) -> tuple[np.ndarray, list]:
    """codes[row, table], and by table the probed codes [row, probe] (the first is the row's own)."""
    own, probed = [], []
    for t in range(tables):
        parts = [cross_polytope(u, t, j, seed, 2) for j in range(length)]
        base = 4 * u.shape[1] + 8
        code = sum(p[0][:, 0] * base**j for j, p in enumerate(parts))
        moves = np.stack([(p[0][:, 1] - p[0][:, 0]) * base**j for j, p in enumerate(parts)], 1)
        costs = np.stack([p[1][:, 1] for p in parts], 1)
        cheap = np.argsort(costs, axis=1, kind="stable")[:, : max(0, probes - 1)]
        own.append(code)
        probed.append(np.concatenate([code[:, None], code[:, None] + np.take_along_axis(moves, cheap, 1)], 1))
    return np.stack(own, 1).astype(np.int64), probed


@lru_cache(maxsize=64)
def tables_needed(dims: int, length: int, probes: int, least: float, seed: int) -> int:
    """Tables after which at most MISS of random pairs of cosine ``least`` have met in none, by one table's rate on drawn pairs."""
    dims, r = max(2, dims), np.random.default_rng([seed, dims])
    a, z = (r.normal(size=(max(128, 65536 // dims), dims)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    tried = 20
    (own_a, probed_a), (own_b, probed_b) = (table_codes(u, tried, length, probes, seed) for u in (a, least * a + math.sqrt(max(0.0, 1 - least * least)) * z))
    met = [(probed_a[t] == own_b[:, t, None]).any(1) | (probed_b[t] == own_a[:, t, None]).any(1) for t in range(tried)]
    rate = max(float(np.mean(met)), 1 / np.size(met))
    return 1 if rate >= 1 else math.ceil(math.log(MISS) / math.log1p(-rate))


def hashing(n: int, dims: int, tables: int, probes: int, least: float, seed: int) -> tuple[int, int]:
    """(length, tables) for ``n`` vectors of at most ``dims`` components: the length follows n, the tables follow the length."""
    length = max(2, round(math.log(max(n, 2)) / math.log(128)))
    while length > 1 and tables_needed(dims, length, probes, least, seed) > MOST_TABLES:
        length -= 1
    return length, max(tables, tables_needed(dims, length, probes, least, seed))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def folded(probed: list) -> np.ndarray:
    """codes[row, table, probe] in 32 bits; the first probe is the row's own bucket."""
    return (mix(np.stack(probed, 1).astype(np.uint64)) >> np.uint64(33)).astype(np.int32)


def pairs_of(side: np.ndarray, same: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that meet: within a cell of one block all, within one of two blocks those of different sides. ``first``: each cell's first row, and the end."""
    end = np.repeat(first[1:], np.diff(first))
    at = np.arange(len(side))
    n = end - at - 1
    a = np.repeat(at, n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1
    keep = same[a] | (side[a] != side[b])
    return a[keep], b[keep]


def meetings(t, least: float, tables: int, kind):
    """Batches (a, b, n): by node the weight of its new links (b null), and (node, root) of a spanning forest of the links (n null)."""
    import pyarrow as pa

    col = {k: t.column(i) for i, k in enumerate(VISITS)}
    plain = {k: col[k].to_numpy() for k in ("cell", "side", "same", "t", "code", "own", "node", "w", "dims")}
    label = col["label"].combine_chunks().dictionary_encode()
    label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy(zero_copy_only=False)
    for d in np.unique(plain["dims"]):
        rows = np.flatnonzero(plain["dims"] == d)
        x = {k: v[rows] for k, v in plain.items()}
        name, take = label[rows], pa.array(rows)
        vec = unit(np.frombuffer(b"".join(col["vec"].take(take).to_pylist()), kind).reshape(len(rows), d))
        codes = np.frombuffer(b"".join(col["codes"].take(take).to_pylist()), np.int32).reshape(len(rows), tables, -1)
        cell = x["cell"]
        first = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        lo = 0
        while lo < len(first) - 1:  # cells with together about PAIRS pairs
            size = np.cumsum(np.diff(first[lo:]) ** 2)
            hi = lo + max(1, int(np.searchsorted(size, PAIRS, "right")))
            begin = first[lo]
            a, b = (i + begin for i in pairs_of(x["side"][begin : first[hi]], x["same"][begin : first[hi]], first[lo : hi + 1] - begin))
            ok = (x["own"][a] | x["own"][b]) & (x["node"][a] != x["node"][b]) & (name[a] == name[b]) & (x["t"][a] == x["t"][b]) & (x["code"][a] == x["code"][b])
            a, b = a[ok], b[ok]
            a, b = np.where(x["node"][a] < x["node"][b], a, b), np.where(x["node"][a] < x["node"][b], b, a)
            for k in range(0, len(a), PAIRS):
                yield linked(x, vec, codes, a[k : k + PAIRS], b[k : k + PAIRS], least)
            lo = hi


def linked(x: dict, vec: np.ndarray, codes: np.ndarray, a: np.ndarray, b: np.ndarray, least: float):
    import pyarrow as pa

    near = np.einsum("ij,ij->i", vec[a], vec[b]) >= least
    a, b = a[near], b[near]
    own_a, own_b = codes[a, :, :1], codes[b, :, :1]
    a_in_b, b_in_a = (own_a == codes[b]).any(2), (own_b == codes[a]).any(2)
    table, at = x["t"][a], np.arange(len(a))
    earlier = ((a_in_b | b_in_a) & (np.arange(codes.shape[1]) < table[:, None])).any(1)
    twice = a_in_b[at, table] & b_in_a[at, table] & (x["code"][a] != own_a[at, table, 0])  # they also meet in a's own bucket
    a, b = a[~(earlier | twice)], b[~(earlier | twice)]
    ids, back = np.unique(np.concatenate([x["node"][a], x["node"][b]]), return_inverse=True)
    weight = np.bincount(back, np.concatenate([x["w"][b], x["w"][a]]).astype(np.float64), len(ids)).astype(np.int64)
    i, j, root = back[: len(a)], back[len(a) :], np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    tied = np.flatnonzero(root != np.arange(len(ids)))
    none = lambda n: pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([ids, ids[tied]])), pa.concat_arrays([none(len(ids)), pa.array(ids[root[tied]])]),
            pa.concat_arrays([pa.array(weight), none(len(tied))]),
        ],
        ["a", "b", "n"],
    )


def near_duplicates(
    spark: SparkSession,
    vectors: DataFrame,
    least: float = 0.93,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str | None = "label",
    tables: int = 10,
    probes: int = 3,
    seed: int = 11,
    length: int | None = None,
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    n_links counts the other rows linked directly; component_id is the smallest key reachable, itself
    included; kept tells whether that is the row's own. Rows compare only where labels are equal and
    not null. Vectors that are null, zero or hold null or non-finite components, and rows with a null
    key, link with nothing (a null key has a null component and isn't kept). A repeated row of one key is
    a copy like any other. Lengths may differ; vectors of different lengths never link.
    The hash length grows with the logarithm of the number of rows, so buckets don't. A longer hash meets
    less often, so ``tables`` is the least number of tables: it is raised with the length (a length given
    is kept) until a pair right at the threshold is missed with probability MISS at most.
    """
    group = F.col(label).cast("string") if label else F.lit("")
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    base = vectors.select(F.col(key).cast("long").alias("k"), group.alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    # rows are one node by 128 bits of label and vector, so that no two of some 10**12 vectors are mistaken for one
    same = F.struct(F.xxhash64("label", "e").alias("one"), F.xxhash64(F.lit("other"), "label", "e").alias("two"))
    good = base.where(F.col("k").isNotNull() & F.col("label").isNotNull() & usable("e")).withColumn("h", same)
    nodes = good.groupBy("h").agg(F.min("k").alias("node"), F.count("*").alias("w"), F.any_value("e").alias("e"), F.any_value("label").alias("label"))
    n, dims = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("e")), F.lit(1))).first()
    if length is None:
        length, tables = hashing(n, dims, tables, probes, least, seed)
    else:
        tables = max(tables, tables_needed(dims, length, probes, least, seed))

    def work(batches):
        import pyarrow as pa

        for b in batches:
            vec = b.column(3).to_pylist()
            sizes = np.array([len(v) for v in vec])
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = np.array([vec[i] for i in at], kind)
                codes = folded(table_codes(unit(x), tables, length, probes, seed)[1])
                fresh = np.stack([(codes[:, :, :j] != codes[:, :, j : j + 1]).all(2) for j in range(codes.shape[2])], 2)
                table, place = (np.broadcast_to(v, codes.shape)[fresh] for v in (np.arange(tables)[:, None], np.arange(codes.shape[2])))
                visits = pa.StructArray.from_arrays([pa.array(table.astype(np.int32)), pa.array(codes[fresh]), pa.array(place == 0)], ["t", "code", "own"])
                visits = pa.ListArray.from_arrays(np.append(0, np.cumsum(fresh.sum((1, 2)))).astype(np.int32), visits)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(i).take(pa.array(at)) for i in range(3)), pa.array(np.full(len(at), d, np.int32)),
                        pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()),
                        visits,
                    ],
                    ["node", "w", "label", "dims", "vec", "codes", "visits"],
                )

    kind = np.float32 if single else np.float64
    hashed = written(spark, nodes.select("node", "w", "label", "e").mapInArrow(work, HASHES), "vector-codes")
    bucket = F.xxhash64("label", "dims", "v.t", "v.code").alias("bucket")
    met = hashed.select("label", "dims", F.explode("visits").alias("v")).groupBy(bucket).agg(F.count("*").alias("n"), F.max("v.own").alias("any_own"))
    met = written(spark, met.where("n > 1 and any_own").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "vector-buckets")
    visits = hashed.select("node", "label", "dims", F.explode("visits").alias("v")).select("node", bucket, "v").join(met, "bucket")  # no vector moves yet
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = visits.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    dealt = dealt.select("node", "v", "mine", "other", cell.alias("cell")).join(hashed.drop("visits"), "node").select(
        "cell", (F.col("mine") > F.col("other")).alias("side"), (F.col("mine") == F.col("other")).alias("same"), "v.t", "v.code", "v.own",
        "node", "w", "label", "dims", "vec", "codes",
    )

    def settle(batches):
        import pyarrow as pa

        kept = None
        for b in batches:
            t = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            cells = t.column(0).to_numpy()
            whole = int(np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))[-1]) if len(cells) else 0
            kept = t.slice(whole)
            if whole:
                yield from meetings(t.slice(0, whole), least, tables, kind)
        if kept is not None and kept.num_rows:
            yield from meetings(kept, least, tables, kind)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    found = written(spark, dealt.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(settle, "a long, b long, n long"), "vector-links")
    degree = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(spark, found.where("b is not null"))
    by_hash = (
        nodes.select("h", "node", "w").join(degree, "node", "left").join(roots, "node", "left")
        .select("h", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("root", "node").alias("root"))
    )
    able = F.when(F.col("k").isNotNull() & F.col("label").isNotNull() & usable("e"), same)
    return (
        base.select("k", able.alias("h"))
        .join(by_hash, "h", "left")
        .select(
            F.col("k").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("root", "k").alias("component_id"), F.coalesce(F.coalesce("root", "k") == F.col("k"), F.lit(False)).alias("kept"),
        )
    )


def op8_vectors(spark, sf_dir):
    """Near-duplicates among all rows of ``embeddings`` with equal labels."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings),
ok AS MATERIALIZED (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS m FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.m * b.m) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id AND r.root < l.b)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.root AS component_id, c.root = v.vec_id AS kept
FROM v JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) c ON c.id = v.vec_id
"""
