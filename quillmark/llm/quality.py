"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes in blocks of STRIDE. A chunk is SPAN neighbouring
blocks, so chunks overlap in all but one and together cover every byte of the
text, however long. Each byte has a learned vector; each filter is a learned
weight over a chunk. A filter's largest response over the whole text is all that
is kept of it, and a small learned layer combines these into one probability.

The network is fitted on the driver, on a bounded sample of labelled rows
(``sample`` rows at most); scoring is one pass over the texts without shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import buffers, runs

STRIDE, SPAN, DIM, FILTERS, HIDDEN = 2, 6, 6, 32, 12
PAD = 256
WIDTH = STRIDE * DIM
#: Bytes that are scored together (a longer text by itself, part by part).
PART = 1 << 17
THRESHOLD = 0.3


def blocks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padded blocks (n, STRIDE) of the rows' bytes and each row's first block; a row ends with SPAN - 1 blocks of padding."""
    size = np.diff(off)
    n = (size + STRIDE - 1) // STRIDE + SPAN - 1
    first = np.concatenate([[0], np.cumsum(n)])
    flat = np.full(int(first[-1]) * STRIDE, PAD, np.int16)
    flat[np.arange(len(data)) + np.repeat(first[:-1] * STRIDE - off[:-1], size)] = data
    return flat.reshape(-1, STRIDE), first


class Network:
    """Parameters and the two passes; float32 throughout."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.5, (257, DIM)),
            "w": r.normal(0, (SPAN * WIDTH) ** -0.5, (SPAN, WIDTH, FILTERS)),
            "b": np.zeros(FILTERS),
            "u": r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)),
            "d": np.zeros(HIDDEN),
            "v": r.normal(0, 0.3, HIDDEN),
            "c": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["emb"][PAD] = 0

    def responses(self, blk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs by block, and each filter's response to the chunk that begins there (the last SPAN - 1 blocks begin none)."""
        x = self.p["emb"][blk].reshape(len(blk), WIDTH)
        n = len(blk) - SPAN + 1
        y = x[:n] @ self.p["w"][0]
        for j in range(1, SPAN):
            y += x[j : n + j] @ self.p["w"][j]
        return x, y

    def largest(self, blk: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, responses, and by row each filter's largest response (0 at least)."""
        x, y = self.responses(blk)
        for j in range(1, SPAN):  # a chunk doesn't reach into the next row
            y[first[1:-1] - j] = -np.inf
        begin = np.minimum(first[:-1], len(y) - 1)
        top = np.maximum.reduceat(y, begin, axis=0) if len(y) else np.zeros((len(begin), FILTERS), np.float32)
        return x, y, np.maximum(top + self.p["b"], 0)

    def combine(self, top: np.ndarray) -> np.ndarray:
        h = np.maximum(top.astype(np.float64) @ self.p["u"] + self.p["d"], 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.p["v"] + float(self.p["c"][0]), -60, 60)))

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """By row, the probability of label 1. A long row is taken part by part; the largest of its parts' responses count."""
        tops = np.zeros((len(off) - 1, FILTERS), np.float32)
        for lo, hi in runs(off, PART):
            if off[hi] - off[lo] <= 2 * PART:
                tops[lo:hi] = self.largest(*blocks(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))[2]
                continue
            for at in range(off[lo], off[hi], PART):  # parts overlap by a chunk
                part = data[at : min(off[hi], at + PART + STRIDE * (SPAN - 1))]
                blk, first = blocks(part, np.array([0, len(part)]))
                inner = len(blk) if at + PART >= off[hi] else PART // STRIDE + SPAN - 1
                tops[lo] = np.maximum(tops[lo], self.largest(blk[:inner], np.minimum(first, inner))[2][0])
        return self.combine(tops)

    def grads(self, blk, first, target, weight):
        x, y, top = self.largest(blk, first)
        h = top @ self.p["u"] + self.p["d"]
        live = np.maximum(h, 0)
        s = 1 / (1 + np.exp(-np.clip(live @ self.p["v"] + self.p["c"][0], -60, 60)))
        d = ((s - target) * weight / weight.sum()).astype(np.float32)
        dh = d[:, None] * self.p["v"] * (h > 0)
        g = {"v": live.T @ d, "c": np.array([d.sum()], np.float32), "u": top.T @ dh, "d": dh.sum(0)}
        dtop = (dh @ self.p["u"].T) * (top > 0)
        g["b"] = dtop.sum(0)
        # only the chunk with a filter's largest response has a gradient
        row, f = np.nonzero(dtop)
        at = np.array([first[i] + np.argmax(y[first[i] : first[i + 1] - SPAN + 1, k]) for i, k in zip(row, f, strict=True)], np.int64)
        pull = dtop[row, f]
        g["w"] = np.zeros_like(self.p["w"])
        g["emb"] = np.zeros_like(self.p["emb"])
        for j in range(SPAN):
            part = np.zeros((FILTERS, WIDTH), np.float32)
            np.add.at(part, f, x[at + j] * pull[:, None])
            g["w"][j] = part.T
            back = (self.p["w"][j][:, f].T * pull[:, None]).reshape(-1, DIM)
            np.add.at(g["emb"], blk[at + j].ravel(), back)
        g["emb"][PAD] = 0
        return g


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 16, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the log loss; both labels weigh the same in sum. One label alone gives its constant."""
    net, r = Network(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        net.p["v"][:] = 0
        net.p["c"][:] = 0 if not len(labels) else (4 if share else -4)
        return net
    weights = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    u = {k: np.zeros_like(v) for k, v in net.p.items()}
    t = 0
    for e in range(epochs):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), batch):
            ids = order[lo : lo + batch]
            data = np.frombuffer(b"".join(texts[i] for i in ids), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in ids])]).astype(np.int64)
            g = net.grads(*blocks(data, off), labels[ids], weights[ids])
            t += 1
            lr = rate * 0.5 * (1 + np.cos(np.pi * t / (epochs * (len(texts) / batch + 1))))
            for k, v in net.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                u[k] += 0.01 * (g[k] ** 2 - u[k])
                v -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(u[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def held_out(key: str = "doc_id"):
    """crc32 of the key as text, modulo 5, is 0; a null key isn't held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, most_bytes: int = 24 << 20, key: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """Fit on labelled rows that aren't held out: the ``sample`` first in hash order of the key, half of each label.

    ``most_bytes`` bounds what the driver holds of them. A row that doesn't fit is left out whole, and those after
    it are taken on; a label with a text of at most half of the bound keeps a row: each label has half of the bound.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).select(key, F.col(label).alias("_y"))
    order = F.xxhash64(F.lit("quality"), key)
    picked = [known.where(F.col("_y") == y).dropDuplicates([key]).orderBy(order, key).limit(sample // 2) for y in (0, 1)]
    few = picked[0].unionByName(picked[1])
    rows = docs.select(key, text).join(F.broadcast(few), key).select(key, F.col(text).cast("binary").alias("_b"), "_y")
    rows = rows.where(F.coalesce(F.length("_b"), F.lit(0)) <= most_bytes // 2)
    got, held = [], {0: 0, 1: 0}
    for r in rows.orderBy(order, key).toLocalIterator():
        size = len(r["_b"] or b"")
        if held[r["_y"]] + size <= most_bytes // 2:
            held[r["_y"]] += size
            got.append((bytes(r["_b"] or b""), r["_y"]))
    return fit([b for b, _ in got], np.array([y for _, y in got]))


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` and a column ``score`` (0 to 1) from the whole text; a null text counts as empty. A column named score is replaced."""
    kept = docs.drop("score") if "score" in docs.columns else docs
    from pyspark.sql import types as T

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    params = net.p

    def work(batches):
        import pyarrow as pa

        net = Network()
        net.p = params
        for b in batches:
            data, off = buffers(b.column(b.schema.get_field_index(text)))
            out = net.score(data, off)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "score"])

    return kept.mapInArrow(work, schema)


def op2_quality(spark: SparkSession, sf_dir: str):
    """Every whole text of ``documents`` scored by a network fitted on ``labels`` (held-out fifth never seen)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, net).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
