"""Context trees against dictionaries built from plain substrings, held-out accuracy, and edges."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import language as L

WORDS = {"en": "the of and to in that was with for which on are this".split(), "de": "der die und das ist nicht für mit über eine auch größe".split(), "fr": "le la les été où être dans une qui que pour ça".split()}


def sentence(lang, r, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def corpus(n=60, seed=1):
    r = random.Random(seed)
    return [(i, sentence(lang, r, r.randint(5, 40)), lang) for i in range(n) for lang in [r.choice(list(WORDS))]]


class Plain:
    """The coder from its definition: contexts and counts of whole texts, longest context first."""

    def __init__(self, texts, least=1.0):
        runs = Counter()
        for t in texts:
            b = bytes(L.ORDER) + t.encode()
            for i in range(L.ORDER, len(b)):
                for k in range(L.ORDER + 1):
                    runs[b[i - k : i + 1]] += 1
        self.total = Counter()
        for g, c in runs.items():
            self.total[g[:-1], len(g)] += c
        self.next = {}
        for g, c in runs.items():
            if c >= least:
                self.next.setdefault((g[:-1], len(g)), {})[g[-1]] = c

    def p(self, ctx, sym):
        if ctx is None:
            return 1 / 256
        seen = self.next.get((ctx, len(ctx) + 1))
        shorter = ctx[1:] if ctx else None
        if not seen:
            return self.p(shorter, sym)
        total, d = self.total[ctx, len(ctx) + 1], len(seen)
        if sym in seen:
            return seen[sym] / (total + d)
        escape = (total - sum(seen.values()) + d) / (total + d)
        return escape * self.p(shorter, sym) / (1 - sum(self.p(shorter, s) for s in seen))

    def bits(self, text):
        b = bytes(L.ORDER) + text.encode()
        return -sum(math.log2(self.p(b[i - L.ORDER : i], b[i])) for i in range(L.ORDER, len(b)))


def trained(spark, rows, **more):
    return L.train(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), **more)


@pytest.mark.parametrize("edges", [1 << 19, 120])
def test_code_lengths_as_from_dictionaries(spark, edges):
    rows = corpus()
    trees = trained(spark, rows, edges=edges)
    assert trees.langs == sorted(WORDS)
    texts = ["the größe of être", "", "x", "über über über", "\x00\x00odd\x00", "日本", sentence("en", random.Random(3), 50)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = -trees.ready().log_probabilities(data, off) / math.log(2)
    for i, lang in enumerate(trees.langs):
        mine = [t for _, t, x in rows if x == lang]
        plain = Plain(mine, max(1.0, sum(len(t.encode()) for t in mine) * len(WORDS) / edges))
        assert np.allclose(got[:, i], [plain.bits(t) for t in texts], rtol=1e-9, atol=1e-9)


def test_every_context_codes_whole_probability(spark):
    trees = trained(spark, corpus(), edges=200).ready()
    for context in ("", "the ", "xyz", "eine", "über"[:2]):
        raw = context.encode()
        data = np.frombuffer(b"".join(raw + bytes([s]) for s in range(256)), np.uint8)
        off = np.arange(257) * (len(raw) + 1)
        base = trees.log_probabilities(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert np.allclose(np.exp(trees.log_probabilities(data, off) - base).sum(0), 1.0)


def test_long_texts_in_parts_and_counts_handed_on_early(spark, monkeypatch):
    rows = [*corpus(40, 2), (99, sentence("de", random.Random(5), 900), "de")]
    whole = trained(spark, rows)
    monkeypatch.setattr(L, "PART", 64)
    small = list(L.parts(np.frombuffer(b"abcdefgh" * 20, np.uint8), np.array([0, 3, 3, 160]), 50))
    assert np.array_equal(np.concatenate([g for _, _, g in small]), np.concatenate([g for _, _, g in L.parts(np.frombuffer(b"abcdefgh" * 20, np.uint8), np.array([0, 3, 3, 160]), 1000)]))
    text = rows[-1][1].encode()
    part = whole.ready().log_probabilities(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    monkeypatch.undo()
    assert np.allclose(part, whole.log_probabilities(np.frombuffer(text, np.uint8), np.array([0, len(text)])))


def test_counts_do_not_depend_on_where_tasks_flush(monkeypatch):
    import pyarrow as pa

    rows = corpus(50, 4)
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([r[2] for r in some]), pa.array([r[1].encode() for r in some])], ["lang", "b"])

    def totals():
        out = Counter()
        for b in L._count(iter([batch(rows[:20]), batch(rows[20:])])):
            for lang, g, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                out[lang, g] += c
        return out

    one = totals()
    monkeypatch.setattr(L, "HELD", 50)
    monkeypatch.setattr(L, "PART", 128)
    assert totals() == one and sum(one.values()) == sum(len(r[1].encode()) for r in rows)


def test_lookup_finds_all_and_nothing_else():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 40, 5000))
    at = L.Lookup(keys)
    assert np.array_equal(at.find(keys), np.arange(len(keys)))
    assert (at.find(np.setdiff1d(r.integers(0, 1 << 40, 5000), keys)) == -1).all() and (L.Lookup(keys[:0]).find(keys) == -1).all()


def test_nulls_empty_texts_ties_repeats_and_clashing_columns(spark):
    trees = trained(spark, [*corpus(), (500, None, "xx"), (501, "orphan", None), (502, "", "yy")])
    assert trees.langs == sorted(WORDS)
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, "the which are"), (4, "the which are"), (None, "für die größe"), (5, "é" * 200_000 + " où être"), (6, "\U0001f600")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("old"), "lang_pred": F.lit(7), "k": F.lit(1), "lang": F.lit("zz"), "_letters": F.lit(3)})
    got = L.predict(spark, docs, trees)
    assert got.columns == ["doc_id", "text", "k", "lang", "lang_pred", "score", "bits"]
    found = got.collect()
    assert [r["lang_pred"] for r in found] == ["und", "und", "und", "en", "en", "de", "fr", "und"]
    assert all(0 <= r["score"] <= 1 for r in found) and all((r["bits"] is None) == (r["lang_pred"] == "und") for r in found)
    same = L.Trees(["a", "b"], *(np.array(x, np.int64) for x in ([0, 0], [0, 1], [97, 97], [5, 5], [5, 5])))
    assert L.predict(spark, spark.createDataFrame([("aaa",)], "text string"), same).first()["lang_pred"] == "a"


def test_nothing_learned_and_no_rows(spark):
    trees = trained(spark, [(1, None, "en"), (2, "text", None)])
    assert trees.langs == []
    docs = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    assert L.predict(spark, docs, trees).first()["lang_pred"] == "und"
    assert L.predict(spark, docs.limit(0), trained(spark, corpus())).collect() == []


def test_query_is_right_on_languages_it_did_not_learn_from(spark):
    found = L.op11_language(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).alias("ok")).collect()
    assert len(rows) > 250 and sum(r["ok"] for r in rows) >= 0.99 * len(rows)
