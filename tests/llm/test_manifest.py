"""The manifest against a tree built by hand, leaf by leaf, and its edges."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillmark.llm.manifest import COLUMNS, LOWER, UPPER, field, group_key, manifest, op12_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The last node of a run of digests and, for each, its sibling lists (left, right) from below."""
    ways = [[] for _ in nodes]
    level, where = list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, at in enumerate(where):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            ways[i].append((run[: at % 8], run[at % 8 + 1 :]))
        level = [sha("".join(level[j : j + 8])) for j in range(0, len(level), 8)]
        where = [at // 8 for at in where]
    return level[0], ways


def fold(h, way):
    for left, right in way:
        h = sha("".join([*left, h, *right]))
    return h


def plain(rows):
    rows = list(rows)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, ways = {}, {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[g], ways[g] = climb([leaf(r) for r in groups[g]])
    root, upper = climb([subs[g] for g in names])
    out = []
    for i, g in enumerate(names):
        for r, way in zip(groups[g], ways[g], strict=True):
            way = way + upper[i]
            other = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                other = (*r[:4], r[4].translate(str.maketrans(UPPER, LOWER)))
            proof = sha("".join(h for left, right in way for h in [*left, *right]))
            folded = fold(leaf(other), way)
            out.append((r[0], leaf(r), subs[g], root, proof, folded, folded == root))
    return out


def check(spark, rows, parts=3, docs=None):
    docs = docs if docs is not None else spark.createDataFrame(rows, SCHEMA).repartition(parts)
    due = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = [tuple(r) for r in manifest(spark, docs, COLUMNS, {"text": F.translate("text", UPPER, LOWER)}, checked=due).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(plain(rows), key=key)
    return found


def doc(i, lang="en", text=None):
    return (i, f"src{i % 3}", lang, 10 * i, text if text is not None else f"Text Number {i}")


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_one_language_of_every_height(spark, n):
    found = check(spark, [doc(i) for i in range(n)])
    assert any(not r[-1] for r in found) or n == 1


def test_nulls_ties_repeats_and_many_languages(spark):
    rows = [doc(i, "en", f"Mixed {i}") for i in range(20)] + [doc(100 + i, f"l{i:02d}") for i in range(11)]
    rows += [doc(5, "en", "Another Text of 5"), doc(5, "en", "Another Text of 5"), doc(5, "fr"), (None, None, None, None, None), (None, None, None, None, None), (None, "s", "en", 3, "No Id")]
    rows += [(7, None, "", 0, ""), (8, None, None, None, ""), (9, "", "é", -5, "É" * 70_000 + "Z"), (-3, "s", "-", 1, "Minus"), (12, "a", "=", 1, "lower only")]
    check(spark, rows)


def test_a_third_of_all_rows_is_one_row_and_columns_clash(spark):
    rows = [doc(1)] * 40 + [doc(i, "en" if i % 5 else "de") for i in range(2, 82)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("g", "h", "id", "idx", "n", "pre", "leaf", "root", "other", "_tie", "_pid"):
        docs = docs.withColumn(name, F.lit("clash"))
    check(spark, rows, docs=docs)


def test_no_rows(spark):
    assert manifest(spark, spark.createDataFrame([], SCHEMA), COLUMNS).collect() == []


def test_fields_and_group_order(spark):
    row = spark.createDataFrame([("é", None, 12)], "a string, b string, c int").select(field(F.col("a")), field(F.col("b")), field(F.col("c"))).first()
    assert list(row) == ["2:é", "-", "2:12"]
    names = spark.createDataFrame([(x,) for x in (None, "", "-", "=", "a", "é", "Z")], "g string").orderBy(group_key(F.col("g"))).collect()
    assert [r[0] for r in names] == [None, "", "-", "=", "Z", "a", "é"]


def test_query_finds_what_was_changed(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*COLUMNS).collect()]
    found = [tuple(r) for r in op12_manifest(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(map(str, found)) == sorted(map(str, plain(docs)))
