"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes, with the counts
of the bytes that followed. A byte is coded from the longest context that knows
it: a context seen T times with D different bytes gives c / (T + D) to a byte seen
c times, and hands the rest down, as the escape, to the bytes it has not seen, in
proportion to what the context shorter by one byte gives them. So every context's
probabilities add up to one, and the sum of -log2 over a text is an exact code
length. The language with the shortest code is the answer. Nothing adapts while a
text is scored: the statistics are frozen.

Counts are taken over all training texts, on executors, and grow with them. A tree
keeps a byte in a context if it makes 1 / ``edges`` of its language's bytes or more,
so no order has more than ``edges`` entries, however much text there is; what was
not kept counts into the escape. Only this bounded tree comes to the driver. With L
languages each gets ``edges`` / L, and the table takes L numbers an entry.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import buffers, runs, table, written

ORDER = 4
EDGES = 1 << 19
#: Bytes that are counted or scored together, and counts that a task holds before it hands them on.
PART, HELD = 1 << 18, 1 << 22
UNKNOWN = "und"


def grams(data: np.ndarray, since: np.ndarray, lo: int) -> np.ndarray:
    """The last ORDER + 1 bytes at each position of data[lo:] as one number; bytes before a text's start are 0."""
    out = np.zeros(len(data) - lo, np.int64)
    for j in range(ORDER + 1):
        here = np.zeros(len(out), np.int64)
        skip = min(max(0, j - lo), len(out))
        here[skip:] = data[lo + skip - j :][: len(out) - skip]
        here[since < j] = 0
        out |= here << (8 * j)
    return out


def parts(data: np.ndarray, off: np.ndarray, size: int):
    """(first row, row starts within the part, grams): whole rows up to ``size`` bytes, or parts of one longer row from its start."""
    for lo, hi in runs(off, size):
        if hi == lo + 1:
            for a in range(int(off[lo]), int(off[hi]), size):
                b, back = min(a + size, int(off[hi])), max(int(off[lo]), a - ORDER)
                yield lo, np.zeros(1, np.int64), grams(data[back:b], np.arange(a, b) - off[lo], a - back)
        elif off[hi] > off[lo]:
            starts = off[lo:hi] - off[lo]
            since = np.arange(off[hi] - off[lo]) - np.repeat(starts, np.diff(off[lo : hi + 1]))
            yield lo, starts, grams(data[off[lo] : off[hi]], since, 0)


# ---------------------------------------------------------------- counting


def _merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def _count(batches):
    """(lang, gram, c): each task's counts, combined while they fit."""
    import pyarrow as pa

    codes: dict[str, int] = {}
    keys, counts, pending = [], [], 0

    def flush():
        k, c = _merged(keys, counts)
        names = list(codes)
        for lo in range(0, len(k), 1 << 16):
            some = k[lo : lo + (1 << 16)]
            lang = pa.DictionaryArray.from_arrays(pa.array((some >> 40).astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array(some & ((1 << 40) - 1)), pa.array(c[lo : lo + (1 << 16)])], ["lang", "gram", "c"])

    for b in batches:
        lang = np.array([codes.setdefault(x, len(codes)) for x in b.column(0).to_pylist()], np.int64)
        data, off = buffers(b.column(1))
        for row, starts, g in parts(data, off, PART):
            sizes = np.diff(np.append(starts, len(g)))
            k, c = np.unique(g | (np.repeat(lang[row : row + len(starts)], sizes) << 40), return_counts=True)
            keys.append(k)
            counts.append(c.astype(np.int64))
            pending += len(k)
            if pending > HELD:
                k, c = _merged(keys, counts)
                keys, counts, pending = [k], [c], len(k)
                if pending > HELD // 2:
                    yield from flush()
                    keys, counts, pending = [], [], 0
    if keys:
        yield from flush()


def held_out(key: str = "doc_id", fold: int = 1, folds: int = 3) -> Column:
    """crc32 of the key as text leaves ``fold``; a null key isn't held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def statistics(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, k, key, c: how often each run of k + 1 bytes occurs in all texts of a language, for every k up to ORDER."""
    known = docs.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(F.col(lang).cast("string"), F.col(text).cast("binary"))
    longest = known.mapInArrow(_count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")) for k in range(ORDER + 1)))
    return longest.select("lang", "c", F.inline(each)).groupBy("lang", "k", "key").agg(F.sum("c").alias("c"))


# ---------------------------------------------------------------- trees


class Lookup:
    """Row numbers of int64 keys: open addressing, a quarter full at most."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 4 - 1).bit_length()) if len(keys) else 4
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.row = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int64), self.slot(keys)
        while len(todo):
            free = np.flatnonzero(self.key[at] == -1)
            here, first = np.unique(at[free], return_index=True)
            self.key[here], self.row[here] = keys[todo[free[first]]], todo[free[first]]
            left = np.ones(len(todo), bool)
            left[free[first]] = False
            todo, at = todo[left], (at[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self.slot(keys)
        have = self.key[at]
        out = np.where(have == keys, self.row[at], -1)
        open_ = np.flatnonzero((have != keys) & (have != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            have = self.key[at[open_]]
            hit = have == keys[open_]
            out[open_[hit]] = self.row[at[open_[hit]]]
            open_ = open_[~hit & (have != -1)]
        return out


class Trees:
    """All languages' context trees in one table an order: log probabilities of known bytes and logarithms of escapes.

    ``known[k]`` and ``passed[k]`` have a row for each run of k + 1 bytes, or context of k, that any language
    holds, and a number for each language; a language that lacks it has there what its shorter contexts give.
    """

    def __init__(self, langs: list[str], k: np.ndarray, lang: np.ndarray, key: np.ndarray, c: np.ndarray, total: np.ndarray):
        self.langs, n = langs, len(langs)
        self.keys, self.contexts, self.known, self.passed = [], [], [], []
        low_keys = low = None
        for order in range(ORDER + 1):
            on = k == order
            keys, row = np.unique(key[on], return_inverse=True)
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            count = np.zeros((len(keys), n))
            count[row, lang[on]] = c[on]
            seen, kept, different, covered = (np.zeros((len(contexts), n)) for _ in range(4))
            seen[of[row], lang[on]] = total[on]
            np.add.at(kept, of, count)
            np.add.at(different, of, count > 0)
            shorter = np.full((len(keys), n), -np.log(256.0)) if low is None else low[np.searchsorted(low_keys, keys & ((1 << 8 * order) - 1))]
            np.add.at(covered, of, np.where(count > 0, np.exp(shorter), 0))
            whole = different == 256
            room = np.where(whole, kept, seen + different)
            escape = np.where(whole, 1.0, (seen - kept + different) / np.maximum(room, 1) / np.maximum(1 - covered, 1e-12))
            escape = np.log(np.where(different > 0, escape, 1.0))
            with np.errstate(divide="ignore"):
                found = np.where(count > 0, np.log(count / np.maximum(room[of], 1)), escape[of] + shorter)
            self.keys.append(keys)
            self.contexts.append(contexts)
            self.known.append(found)
            self.passed.append(escape)
            low_keys, low = keys, found

    def __getstate__(self):
        return {a: getattr(self, a) for a in ("langs", "keys", "contexts", "known", "passed")}

    def ready(self) -> Trees:
        """With the tables to look things up in, which aren't shipped."""
        if not hasattr(self, "at"):
            self.at = [Lookup(k) for k in self.keys]
            self.under = [Lookup(k) for k in self.contexts]
        return self

    def log_probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """By row and language, the natural logarithm of the text's probability: its code length, but for sign and unit."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        for row, starts, g in parts(data, off, max(1 << 12, (PART << 2) // max(4, len(self.langs)))):
            got, rest = np.zeros((len(g), len(self.langs))), np.arange(len(g))
            for k in range(ORDER, -1, -1):
                key = g & ((1 << 8 * (k + 1)) - 1)
                at = self.at[k].find(key)
                hit = at >= 0
                got[rest[hit]] += self.known[k][at[hit]]
                rest, g = rest[~hit], g[~hit]
                if not len(rest):
                    break
                ctx = self.under[k].find(key[~hit] >> 8)
                got[rest[ctx >= 0]] += self.passed[k][ctx[ctx >= 0]]
            got[rest] -= np.log(256.0)
            full = np.diff(np.append(starts, len(got))) > 0
            out[row + np.flatnonzero(full)] += np.add.reduceat(got, starts[full], axis=0)
        return out


def train(spark: SparkSession, docs: DataFrame, edges: int = EDGES, text: str = "text", lang: str = "lang") -> Trees:
    """Trees of every language that has a non-empty text among ``docs``; null texts and null languages teach nothing."""
    counts = written(spark, statistics(docs, text, lang), "language-counts")
    sizes = counts.where("k = 0").groupBy("lang").agg(F.sum("c").alias("n")).orderBy("lang").collect()  # a row for each language
    langs = [r["lang"] for r in sizes]
    if not langs:
        none = np.zeros(0, np.int64)
        return Trees([], none, none, none, none, none)
    least = F.element_at(F.array(*(F.lit(r["n"] * len(langs) / edges) for r in sizes)), F.col("li") + 1)
    # a context has 256 rows at most
    total = F.expr("sum(c) OVER (PARTITION BY lang, k, shiftright(key, 8))")
    placed = counts.withColumn("total", total).withColumn("li", (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int"))
    kept = placed.where(F.col("c") >= least).select("k", "li", "key", "c", "total").toArrow()
    k, li, key, c, t = (kept.column(i).to_numpy().astype(np.int64) for i in range(5))
    return Trees(langs, k, li, key, c, t)


def predict(spark: SparkSession, docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits``.

    ``bits`` is the whole text's code length in the language found, ``score`` that language's share of the probability
    with equal priors. Of equal lengths the smaller name wins. A null text, one without a letter, and any text if
    nothing was learned gives 'und', score 0 and null bits. Columns of these names are replaced; all others stay.
    Repeated rows each get the same answer; no rows give none.
    """
    kept = docs.drop("lang_pred", "score", "bits", "_letters")
    found = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
    shared = spark.sparkContext.broadcast(trees)  # its size is bounded by ``edges``

    def work(batches):
        import pyarrow as pa

        known = shared.value.ready()
        for b in batches:
            at = b.schema.get_field_index(text)
            letters = np.array(b.column(b.num_columns - 1).to_pylist(), bool)
            if known.langs and b.num_rows:
                got = known.log_probabilities(*buffers(b.column(at)))
                best = got.argmax(1)
                top = got[np.arange(len(best)), best]
                score, bits = 1 / np.exp(got - top[:, None]).sum(1), -top / np.log(2) + 0.0
            else:
                letters, best = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, int)
                score = bits = np.zeros(b.num_rows)
            names = [known.langs[i] if y else UNKNOWN for i, y in zip(best, letters, strict=True)]
            new = [pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(bits, mask=~letters)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], "lang_pred", "score", "bits"])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return kept.withColumn("_letters", letters).mapInArrow(work, found)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``; two thirds of the rows, by crc32, teach the trees."""
    docs = table(spark, sf_dir, "documents")
    trees = train(spark, docs.where(~held_out()).select("text", "lang"))
    return predict(spark, docs.select("doc_id", "text"), trees).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits")
