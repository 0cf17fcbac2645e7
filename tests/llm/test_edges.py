"""Nulls, repeated rows, empty tables, very long texts and clashing columns, operator by operator; the pipeline's stages against plain loops."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_operators import plain_score, plain_spans, words

from quillmark.llm import licenses, mixing, neardup_vectors, packing, pii, quality, warc


def test_packing_null_keys_and_repeated_rows(spark):
    rows = [(1, "one two three", "x"), (1, "one two three", "x"), (None, "four", "x"), (None, None, "x"), (2, "", "x"), (3, "five six " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(2)
    out = packing.pack(df, with_ids=True).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in out if r.start == 0) == Counter({(1, 4): 2, (None, 2): 1, (None, 1): 1, (2, 1): 1, (3, max(r.doc_tokens for r in out)): 1})
    whole = [r for r in out if r.doc_id == 3]
    assert sum(r.length for r in whole) == whole[0].doc_tokens > 6000 and sorted(r.start for r in whole)[0] == 0
    room = {}
    for r in out:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in room.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 1024


def test_licenses_empty_repeated_and_long(spark):
    long = "word " * 200_000 + "CC  by " + "word " * 200_000 + "all rights reserved"
    df = spark.createDataFrame([(1, long, 7), (1, long, 7), (None, "cc by", 7), (2, None, 7)], "doc_id long, text string, n_words int")
    got = licenses.scan(df).collect()
    assert len(got) == 4 and {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == {
        (1, 400_005, 2, 200_000, 400_002, "cc-by,reserved"), (None, 2, 1, 0, 0, "cc-by"), (2, 0, 0, None, None, "")}
    assert licenses.scan(df.limit(0)).count() == 0


def test_near_vectors_components_against_brute_force(spark):
    r = np.random.default_rng(12)
    centres = r.normal(size=(12, 24))
    x = np.concatenate([c + r.normal(size=(k, 24)) * 0.22 for c, k in zip(centres, (1, 2, 3, 5, 8, 13, 21, 30, 2, 2, 40, 25), strict=True)])
    labels = r.integers(0, 2, len(x))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    assert np.abs(unit @ unit.T - 0.93).min() > 1e-9 and near.any()
    want = np.arange(len(x))
    while True:
        least = np.array([min([want[i], *want[near[i]]]) for i in range(len(x))])
        if (least == want).all():
            break
        want = least
    rows = [(i, v.tolist(), int(k), "clash") for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component_id string").repartition(3)
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in neardup_vectors.near_duplicates(spark, df).collect()}
    assert got == {i: (int(near[i].sum()), int(want[i]), bool(want[i] == i)) for i in range(len(x))}
    assert neardup_vectors.near_duplicates(spark, df.limit(0)).count() == 0


def test_warc_repeated_rows_and_other_columns(spark, tmp_path):
    rows = [(1, "u", "a", "x"), (1, "u", "a", "x"), (3, "v", "a", "y"), (3, "v", "a", "y"), (None, "w", "a", "z"), (None, "w", "lone", "z"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    warc.write_archives(df, str(tmp_path / "w"), spark)
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert got == {(1, "revisit", 3): 2, (3, "response", None): 2, (None, "revisit", 3): 1, (None, "response", None): 1, (4, "response", None): 1}


def test_pipeline_stages_against_plain_loops(spark):
    """Each stage but the deduplication (in test_operators): what it keeps, changes, repeats and cuts."""
    import corpus_pipeline

    r = random.Random(21)
    texts = [None, "", "mail a@b.co or 1.2.3.4"] + [words(r, r.randrange(1, 60)) + r.choice(["", " x.y@d.org", " 4111 1111 1111 1111"]) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")

    net = quality.train(docs, labels)
    scores = {i: plain_score(net, t or "") for i, t in enumerate(texts)}
    good = {x.doc_id for x in quality.score(docs, net).where(F.col("score") >= quality.THRESHOLD).collect()}
    assert {i for i, s in scores.items() if s >= quality.THRESHOLD + 1e-3} <= good <= {i for i, s in scores.items() if s >= quality.THRESHOLD - 1e-3}

    clean = {x.doc_id: x for x in corpus_pipeline.redact(spark, docs, "").collect()}
    assert len(clean) == len(texts)
    for i, t in enumerate(texts):
        want, last = "", 0
        for kind, a, b in sorted((s.split(":") for s in plain_spans(t or "").split(",") if s), key=lambda s: int(s[1])):
            want, last = want + (t or "")[last : int(a)] + f"[{kind.upper()}]", int(b)
        assert clean[i].text == (t if t is None else want + t[last:]), i
        assert clean[i].n_chars == len(clean[i].text or "")

    mixed = Counter(x.doc_id for x in corpus_pipeline.mix(spark, docs, "").collect())
    copies = {x.doc_id: x.copies for x in mixing.poisson_mix(docs).collect()}
    assert mixed == Counter(copies)

    pieces = corpus_pipeline.pack(spark, docs, "").collect()
    assert {p.doc_id for p in pieces} == set(range(len(texts)))
    for i in range(len(texts)):
        own = sorted((p.start, p.length, p.doc_tokens) for p in pieces if p.doc_id == i)
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:], strict=False)) and own[-1][0] + own[-1][1] == own[0][2]
    assert zlib.crc32(np.array([0], "<u4").tobytes()) in {p.ids_crc32 for p in pieces if p.doc_id in (0, 1)}
    assert pii.spans(docs.limit(0)).count() == 0
