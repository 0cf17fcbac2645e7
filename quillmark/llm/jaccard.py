"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set is its distinct word shingles as 64-bit hashes. Shingles have one
global order, rare ones first. Of two sets that reach the threshold, the first
``n - ceil(t n) + l`` shingles (the l-prefix) of each share at least l, so sets
with prefixes of l1 and l2 are compared only if these share min(l1, l2). Each
set takes the l for which its estimated cost is least: postings to read, plus
candidates to verify, which need more and more matches as the prefix grows.

Sets that share l shingles of their l-prefixes still share one when each leaves
out its l - 1 most frequent ones, so only the rest makes candidates; the full
prefixes then decide whether a candidate shares enough.

Frequencies come from a count sketch over all texts: about one counter for
BYTES_A_COUNTER bytes of text, 2**MOST_COUNTERS (64 MB where it is broadcast) at
most. Any order gives right results, so the sketch's errors cost time only.

Equal sets are one node. Candidates are settled in two steps, so a group of
near copies never becomes all its pairs: first, in a few rounds, each node is
verified against the one partner outside its component that it shares most
prefix shingles with, of those that lead their postings; then pairs of nodes that these links leave in different components
are verified exactly. No pair that could still join two components is skipped.

A parity sketch of 512 bits (each shingle flips one) goes with each node into
that last join: two sketches differ in no more bits than their sets differ in
shingles, so pairs whose sketches are too far apart can't link, whatever their
texts, and never become rows. Verification is a join of the sets of the texts
that stand in a pair, intersected in the JVM: no text goes to Python twice for it.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import LOWER, buffers, drop, mix, runs, scratch, word_hashes, words_of, written
from quillmark.llm.components import components

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_A = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]

#: Bytes of text for each counter of the sketch, the least and the greatest number of counters (powers of two); blocks of it that are summed apart.
BYTES_A_COUNTER, LEAST_COUNTERS, MOST_COUNTERS, BLOCKS = 2048, 12, 24, 64
#: Values of l that a set may take (a set that can't share so many takes all it must share);
#: cost of a verification in postings read; star rounds before the exact step.
LEVELS, VERIFY_COST, ROUNDS = (8, 16, 32), 400.0, 2
#: Bytes of text whose shingles are made together: a worker holds some ten arrays with a long for each.
TOGETHER = 1 << 19
#: Longs of the parity sketch.
PARITY = 8
_BITS = [f"p{i}" for i in range(PARITY)]


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """By row, the sorted distinct hashes of its n-word shingles (with fewer words, of the whole sequence)."""
    low = LOWER[data]
    starts, ends, first = words_of(low, off, SPACE)
    h = word_hashes(low, starts, ends)
    total = np.zeros(len(h), np.uint64)
    full = max(0, len(h) - n + 1)
    for j in range(n):
        total[:full] += h[j : full + j] * _A[j % len(_A)] * np.uint64(2 * (j // len(_A)) + 1)
    total = mix(total)
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(total[lo : hi - n + 1]))
        elif hi > lo:
            short = np.array([hi - lo], np.uint64)
            for x in h[lo:hi]:
                short = mix(short * _A[0] + x)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parity(s: np.ndarray) -> np.ndarray:
    """Parities of a set's counts by 64 * PARITY hash values, as longs; the sketches of two sets
    differ in at most as many bits as there are members of one set only."""
    odd = np.bincount(((s >> np.uint64(32)) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(batch, column: str, n: int):
    """(row, set) over a batch, a bounded number of bytes at a time."""
    data, off = buffers(batch.column(batch.schema.get_field_index(column)))
    for lo, hi in runs(off, TOGETHER):
        yield from enumerate(shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n), lo)


def counters(n_bytes: int) -> int:
    """Size of the count sketch for so many bytes of text."""
    return 1 << min(MOST_COUNTERS, max(LEAST_COUNTERS, (n_bytes // BYTES_A_COUNTER).bit_length()))


def prefix(s: np.ndarray, counts: np.ndarray, floor: float, percent: int) -> tuple[np.ndarray, int]:
    """The adaptive prefix of a set and its l."""
    n = len(s)
    at = s & np.uint64(len(counts) - 1)
    over = np.maximum(counts[at] - floor, 1.0)
    rank = np.floor(np.log2(over))
    order = np.lexsort((mix(s), rank))
    need = -(-percent * n // 100)
    least = n - need + 1
    if need < LEVELS[0]:
        return s[order], need
    fit = [x for x in LEVELS if x <= need]
    read = np.cumsum(over[order[: least + fit[-1] - 1]])
    best = min(fit, key=lambda x: read[least + x - 2] * (1 + VERIFY_COST / x**2))
    return s[order[: least + best - 1]], best


def jaccard_components(
    spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """(key, n_shingles, component_id) for every row.

    Two rows link when 100 * intersection >= percent * union of their sets. component_id is the
    smallest key reachable by links, the row's own included. Texts without words (null, empty) have
    0 shingles and link with nothing. A null key has a null component and links nothing. Rows of one
    key are one node of the graph, each with its own set; repeated rows simply repeat.
    """
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    size = counters(base.agg(F.sum(F.octet_length("t"))).first()[0] or 0)

    def scan(batches):
        import pyarrow as pa

        counts = np.zeros(size, np.int32)
        for b in batches:
            n, dig, bits = np.zeros(b.num_rows, np.int64), [None] * b.num_rows, np.zeros((PARITY, b.num_rows), np.int64)
            for i, s in _sets(b, "t", words):
                n[i] = len(s)
                if len(s):
                    dig[i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    bits[:, i] = parity(s)
                    _bump(counts, s)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(dig, pa.binary()), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary()), *map(pa.array, bits)],
                ["id", "n", "set", "block", "counts", *_BITS],
            )
        if counts.any():
            parts = np.split(counts, BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.binary()), pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), *[pa.nulls(BLOCKS, pa.int64())] * PARITY],
                ["id", "n", "set", "block", "counts", *_BITS],
            )

    paths = [scratch(spark, f"jaccard-{x}") for x in ("sets", "postings")]
    of_scan = ", ".join(["id long, n long, set binary, block int, counts binary", *(f"{x} long" for x in _BITS)])
    base.mapInArrow(scan, of_scan).write.parquet(paths[0])
    seen = spark.read.schema(of_scan).parquet(paths[0])
    sets = seen.where("block is null").select("id", "n", "set", *_BITS)

    def add_up(key_, rows):
        import pandas as pd

        total = np.zeros(size // BLOCKS, np.int64)
        for b in rows.counts:
            total += np.frombuffer(b, np.int32)
        return pd.DataFrame({"block": [key_[0]], "counts": [total.tobytes()]})

    summed = seen.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(add_up, "block int, counts binary").collect()
    counts = np.zeros(size, np.int64)
    for r in summed:
        w = size // BLOCKS
        counts[r["block"] * w : (r["block"] + 1) * w] = np.frombuffer(r["counts"], np.int64)
    floor = float(np.median(counts))
    shared = spark.sparkContext.broadcast(counts.astype(np.float32))

    ids = sets.where("set is not null and id is not null")
    nodes = ids.groupBy("set").agg(F.min("id").alias("node"), F.min("n").cast("int").alias("n"), *(F.min(x).alias(x) for x in _BITS))  # one value by set
    copies = written(spark, ids.select("id", "set").join(nodes, "set").where("id <> node").select("id").distinct(), "jaccard-copies")
    firsts = nodes.select(F.col("node").alias("id"))
    copies = written(spark, copies.join(firsts, "id", "left_anti"), "jaccard-copies")
    rows = base.where("id is not null").join(copies, "id", "left_anti")  # a few ids mostly: then no text is moved

    def post(batches):
        import pyarrow as pa

        weights = shared.value
        for b in batches:
            tok, ids, l1, ns = [], [], [], []
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for i, s in _sets(b, "t", words):
                if not len(s):
                    continue
                p, m = prefix(s, weights, floor, percent)
                tok.append(p.view(np.int64))
                ids.append(np.full(len(p), keys[i], np.int64))
                l1.append(np.full(len(p), m, np.int8))
                ns.append(np.full(len(p), len(s), np.int32))
            if tok:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tok, ids, l1, ns)], ["tok", "node", "l", "n"])

    rows.mapInArrow(post, "tok long, node long, l byte, n int").write.parquet(paths[1])
    postings = spark.read.schema("tok long, node long, l byte, n int").parquet(paths[1])
    often = postings.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
    met_path = scratch(spark, "jaccard-live")
    postings.join(often, "tok").write.parquet(met_path)  # postings of shingles in two or more prefixes
    live = spark.read.schema("tok long, node long, l byte, n int, c long").parquet(met_path)
    # the original of many copies shares most: it leads the first round
    weight = live.groupBy("node").agg(F.sum("c").alias("weight"))
    drop(spark, paths[1])

    fits = f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"

    def partners(placed: DataFrame, round_: int) -> DataFrame:
        """(a, b): by node the leader outside its component with which it shares most."""
        first = -F.col("weight") if round_ == 0 else F.xxhash64(F.lit(round_), "node")
        lead = placed.groupBy("tok").agg(F.min(F.struct(first.alias("o"), "node", "l", "n", "comp")).alias("lead"))
        met = placed.join(lead, "tok").where("comp <> lead.comp").select(
            F.col("node").alias("a"), F.col("lead.node").alias("b"), F.least("l", "lead.l").alias("need"), F.col("n").alias("a_n"), F.col("lead.n").alias("b_n")
        )
        shared_ = met.where(fits).groupBy("a", "b").agg(F.count("*").alias("c"), F.min("need").alias("need")).where("c >= need")
        return shared_.groupBy("a").agg(F.max(F.struct("c", F.xxhash64("b").alias("o"), "b")).alias("m")).select("a", F.col("m.b").alias("b"))

    def members(batches):
        import pyarrow as pa

        for b in batches:
            ids, data_off = b.column(0), buffers(b.column(1))
            data, off = data_off
            for lo, hi in runs(off, TOGETHER):
                sets_ = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets_])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.ListArray.from_arrays(ends, np.concatenate(sets_).view(np.int64))], ["id", "s"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that reach the threshold; only sets that are in a pair are moved on."""
        at = {x: scratch(spark, f"jaccard-{x}-{name}") for x in ("pairs", "members", "links")}
        pairs.write.parquet(at["pairs"])
        pairs = spark.read.schema("a long, b long").parquet(at["pairs"])
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        rows.join(ids, "id", "left_semi").mapInArrow(members, "id long, s array<long>").write.parquet(at["members"])
        held = spark.read.schema("id long, s array<long>").parquet(at["members"])
        both = pairs.join(held.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(held.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("c"))
        both.where(f"100L * c >= {percent} * (n - c)").select("a", "b").distinct().write.parquet(at["links"])
        drop(spark, at["pairs"])
        drop(spark, at["members"])
        return spark.read.schema("a long, b long").parquet(at["links"])

    def placed_by(links: DataFrame | None) -> DataFrame:
        if links is None:
            return live.withColumn("comp", F.col("node"))
        return live.join(components(spark, links), "node", "left").select(*live.columns, F.coalesce("root", "node").alias("comp"))

    near = None
    for round_ in range(ROUNDS):
        placed = placed_by(near)
        more = verified(partners(placed.join(weight, "node") if round_ == 0 else placed, round_), f"near{round_}")
        near = more if near is None else near.unionByName(more)
    placed = placed_by(near)
    mixed = placed.groupBy("tok").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("tok")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "tok"))  # a node has a prefix at most
    small = F.sequence(F.lit(1), F.lit(LEVELS[0] - 1))
    # sets that need fewer than LEVELS[0] matches, and all sets that can link with one of those
    tiny = F.col("n").cast("long") * (percent * percent) <= (LEVELS[0] - 1) * 10000
    ranked = placed.withColumn("rank", rank).join(mixed, "tok").withColumn(
        "level", F.explode(F.filter(F.when(tiny, F.concat(small, F.array(*map(F.lit, LEVELS)))).otherwise(F.array(*map(F.lit, LEVELS))), lambda x: (x <= F.col("l")) & (x <= F.col("rank"))))
    )
    ranked = ranked.join(nodes.select("node", "n", *_BITS), ["node", "n"])
    sides = [ranked.select("tok", "level", *(F.col(x).alias(f"{p}_{x}") for x in ("node", "l", "n", "comp", *_BITS))) for p in "ab"]
    apart = " + ".join(f"bit_count(a_{x} ^ b_{x})" for x in _BITS)
    near_enough = f"{100 + percent} * ({apart}) <= {100 - percent} * (a_n + b_n)"
    pairs = (
        sides[0].join(sides[1], ["tok", "level"])
        .where("a_node < b_node and a_comp <> b_comp and level = least(a_l, b_l)").where(fits).where(near_enough)
        .select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("level").alias("need")).distinct()
    )
    pairs = written(spark, pairs, "jaccard-candidates")
    few = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    tokens = live.join(few, "node", "left_semi").groupBy("node").agg(F.collect_list("tok").alias("toks"))
    both = pairs.join(tokens.select(F.col("node").alias("a"), F.col("toks").alias("ta")), "a").join(tokens.select(F.col("node").alias("b"), F.col("toks").alias("tb")), "b")
    pairs = both.where(F.size(F.array_intersect("ta", "tb")) >= F.col("need")).select("a", "b")
    links = verified(pairs, "rest")
    if near is not None:
        links = near.unionByName(links)
    final = components(spark, links)
    named = nodes.select("set", "node").join(final, "node", "left").select("set", F.coalesce("root", "node").alias("c"))
    # rows of one key may hold several sets: their classes are one component
    several = sets.where("set is not null and id is not null").select("id", "set").distinct().groupBy("id").agg(F.count("*").alias("k"), F.min("set").alias("set0"))
    several = several.where("k > 1").select("id")
    if several.limit(1).count():
        tied = sets.join(several, "id", "left_semi").where("set is not null").join(named, "set").select("id", "c").distinct()
        up = components(spark, tied.select(F.col("id").alias("a"), F.col("c").alias("b")))
        named = named.join(up, named["c"] == up["node"], "left").select("set", F.coalesce("root", "c").alias("c"))
    return sets.select("id", "n", "set").join(named, "set", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id")
    )


def _bump(counts: np.ndarray, s: np.ndarray) -> None:
    """Add one for each hash: few fall on the same counter, and those are added in turn."""
    at, k = np.unique((s & np.uint64(len(counts) - 1)).astype(np.int64), return_counts=True)
    counts[at] += k


def op5_jaccard(spark, sf_dir):
    """Whole texts of ``documents`` joined on 4-word shingles at 85 percent."""
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id AND r.root < e.b)
SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, c.root AS component_id FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) c ON c.id = d.doc_id
"""
