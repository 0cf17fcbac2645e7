"""Different texts and vectors are told apart whatever their bytes."""

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import neardup_vectors
from quillmark.llm.common import word_hashes
from quillmark.llm.jaccard import jaccard_components


def thue_morse(order):
    word = "a"
    for _ in range(order):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_with_equal_polynomials_do_not_link(spark):
    w = thue_morse(10)
    other = w.translate(str.maketrans("ab", "ba"))
    long = f"{w} one two three"
    rows = [(1, w), (2, other), (3, w), (4, long), (5, f"{other} one two three"), (6, long.upper()), (7, thue_morse(12)), (8, thue_morse(12).translate(str.maketrans("ab", "ba")))]
    found = jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 4, 7: 7, 8: 8}


def test_word_hashes_depend_on_bytes_alone():
    words = [b"x" * n for n in (1, 64, 65, 66, 2000)] + [b"y" + b"x" * 64, b"x" * 64 + b"y"]
    data = np.frombuffer(b" ".join(words + words[::-1]), np.uint8)
    sizes = np.array([len(x) for x in words + words[::-1]])
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    h = word_hashes(data, starts, starts + sizes)
    assert np.array_equal(h[: len(words)], h[len(words) :][::-1]) and len(set(h.tolist())) == len(words)


def test_vectors_with_one_hash_stay_apart(spark, monkeypatch):
    """The first of the two hashes made equal for all: nodes are told apart by the other."""
    real, calls = F.xxhash64, []

    def hashed(*cols):
        calls.append(cols)
        return F.lit(1).cast("long") if all(isinstance(c, str) for c in cols) and cols == ("label", "e") else real(*cols)

    monkeypatch.setattr(neardup_vectors.F, "xxhash64", hashed)
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "a", [1.0, 0.0]), (4, "b", [1.0, 0.0])]
    found = neardup_vectors.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4)} and calls
