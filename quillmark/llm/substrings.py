"""Removal of repeated substrings, exact, by distributed suffix arrays.

Every window of ``length`` bytes belongs to the group of its minimizer, the
least hash of the K-byte strings in it; equal windows have equal minimizers, so
groups can be settled apart. Neighbouring windows of one group make a piece.
Groups that occur once hold no repeat and go no further. Copies of a piece are
one piece with a count: all its windows repeat. The distinct pieces of a group
go into a suffix array (linear grouping construction), whose neighbours with
``length`` common bytes are the repeats; windows that no other piece can hold,
by a hash of their common part, are left out of it beforehand.

A group with more than GROUP_PIECES distinct pieces (a passage that very many
texts share, each in other company) would be one task's work, so it is split.
Equal windows hold their minimizer at the same place, so windows go into blocks
of neighbouring places, and what all windows of a block have in common must be
equal too: place and common part name a smaller group. Its pieces, cut to the
block, are again copies (equal byte by byte) or go into a suffix array. Groups
still too large are split by the next smaller block of SPLITS; at one window a
block, a group is one string.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import BYTE_CODE, buffers, mix, powers, runs, written
from quillmark.llm.suffixes import suffix_array

K = 64
MOST_WINDOWS = 512
#: Bytes of a text that are looked at together (longer texts by overlapping segments).
SEGMENT = 1 << 23
GROUP_PIECES, SPLITS = 1024, (64, 8, 1)
#: Windows that are judged together before the suffix array.
BLOCK = 8
#: Bytes of pieces that one suffix array takes; a group is never split.
ARRAY_BYTES = 1 << 15


def sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix((total[hi] - total[lo]) * powers(len(total), True)[lo] + (hi - lo).astype(np.uint64))


def window_pieces(data: np.ndarray, off: np.ndarray, length: int):
    """(row, start in row, windows, minimizer, digest, own) of all pieces of the rows.

    The minimizer is the least by its hash's upper bits, the leftmost of equals. ``own`` tells that it
    stands at several places of the piece; only then can the piece hold two equal windows itself.
    """
    k = min(K, length)
    size = np.diff(off)
    n = len(data) - k + 1
    if n <= 0 or (size < length).all():
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, bool)]
    total = sums(data)
    hashes = mix((total[k:] - total[:-k]) * powers(len(data), True)[:n])
    low = hashes & ~np.uint64(SEGMENT * 2 - 1) | np.arange(n, dtype=np.uint64)
    reach, width = 1, length - k + 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    # low[p] has the place of the minimizer of the window at p, where the window fits its row
    row = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    if not len(row):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, bool)]
    many = np.maximum(size - length + 1, 0)
    first = np.cumsum(many) - many
    at = np.arange(len(row)) - first[row]
    pos = off[row] + at
    least = (low[pos] & np.uint64(SEGMENT * 2 - 1)).astype(np.int64)
    value = hashes[least]
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(row)))
    if run.max() > MOST_WINDOWS:
        cut = [np.arange(b, b + r, MOST_WINDOWS) for b, r in zip(begin, run, strict=True)]
        begin = np.concatenate(cut)
        run = np.minimum(np.diff(np.append(begin, len(row))), MOST_WINDOWS)
    lo = pos[begin]
    return row[begin], at[begin], run, value[begin], span_hashes(total, lo, lo + run + length - 1), least[begin] != least[begin + run - 1]


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """By piece, the starts of the windows that occur anywhere else in the pieces, from one suffix array."""
    text = np.zeros(sum(map(len, pieces)) + len(pieces), np.int64)
    first, at = [], 0
    for p in pieces:
        first.append(at)
        text[at : at + len(p)] = np.frombuffer(p, np.uint8)
        text[at : at + len(p)] += 1
        at += len(p) + 1
    order = np.array(suffix_array(text), np.int64)
    room = np.full(len(text), False)
    for f, p in zip(first, pieces, strict=True):
        room[f : f + max(0, len(p) - length + 1)] = True
    a, b = order[:-1], order[1:]
    near = room[a] & room[b]
    a, b = a[near], b[near]
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(mix(text.astype(np.uint64)) * powers(len(text)), out=total[1:])
    inv = powers(len(text), True)
    same = (total[a + length] - total[a]) * inv[a] == (total[b + length] - total[b]) * inv[b]
    a, b = a[same], b[same]
    hit = np.zeros(len(text), bool)
    step = np.arange(length)
    for lo in range(0, len(a), 4096):  # equal hashes are checked byte by byte
        x, y = a[lo : lo + 4096], b[lo : lo + 4096]
        ok = (text[x[:, None] + step] == text[y[:, None] + step]).all(1)
        hit[x[ok]] = hit[y[ok]] = True
    return [np.flatnonzero(hit[f : f + len(p)]) for f, p in zip(first, pieces, strict=True)]


def blocks_of(pieces: list[bytes], minis: np.ndarray, length: int, width: int):
    """(piece, first window, last window + 1, key): windows by their minimizer's place, ``width`` neighbouring places together.

    Equal windows of one group have equal keys: the place, and a hash of what all windows of the block have in
    common. A piece may hold its minimizer several times; the leftmost in a window is the window's own.
    """
    k, width = min(K, length), min(width, length)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    off = np.concatenate([[0], np.cumsum(size)])
    total, inv = sums(data), powers(len(data) + 1, True)
    row = np.repeat(np.arange(len(pieces)), size)[: max(0, len(data) - k + 1)]
    there = mix((total[k:] - total[:-k]) * inv[: len(row)]) == minis[row]
    there &= np.arange(len(row)) + k <= off[row + 1]
    at = np.flatnonzero(there)
    row = row[at]
    place = at - off[row]
    first = np.zeros(len(at), np.int64)  # the first window whose minimizer stands here
    first[1:] = np.where(row[1:] == row[:-1], place[:-1] + 1, 0)
    last = np.minimum(place, size[row] - length)
    row, place, first, last = (x[first <= last] for x in (row, place, first, last))
    low, high = (place - last) // width, (place - first) // width
    many = high - low + 1
    who = np.repeat(np.arange(len(row)), many)
    block = high[who] - (np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many))
    begin = off[row][who] + place[who] - width * block
    core = length - width + 1
    key = mix(mix((total[begin + core] - total[begin]) * inv[begin] + minis[row][who]) + block.astype(np.uint64))
    return row[who], np.maximum(first[who], place[who] - width * block - width + 1), np.minimum(last[who], place[who] - width * block) + 1, key


def shared_parts(pieces: list[bytes], minis: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(piece, first window, last window + 1): windows that can repeat within their groups, those of blocks whose key another block has."""
    row, first, last, key = blocks_of(pieces, minis, length, BLOCK)
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    keep = counts[back] > 1
    out: list[tuple[int, int, int]] = []
    for i, x, y in zip(row[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
        if out and out[-1][0] == i and out[-1][2] == x:
            out[-1] = (i, out[-1][1], y)
        else:
            out.append((i, x, y))
    return out


def islands(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs [lo, hi) of consecutive sorted numbers."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) > 1)
    return at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1


def repeats(spark: SparkSession, docs: DataFrame, length: int) -> DataFrame:
    """(rid, spans array<struct<lo,hi>>): by row identity, ranges of window starts that repeat. ``docs``: rid, t."""

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            data, off = buffers(b.column(1))
            rid = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in runs(off, 1 << 19):
                for begin in range(off[lo], max(off[lo] + 1, off[hi] - length + 1), SEGMENT):  # more than one for a long text alone
                    end = min(off[hi], begin + SEGMENT + length - 1)
                    row, at, run, mini, dig, own = window_pieces(data[begin:end], np.clip(off[lo : hi + 1], begin, end) - begin, length)
                    if len(row):
                        cols = [rid[lo + row], at + (begin - off[lo]), run.astype(np.int32), mini.view(np.int64), dig.view(np.int64), own.astype(np.int8)]
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["rid", "start", "windows", "mini", "dig", "own"])

    pieces = written(spark, docs.mapInArrow(cut, "rid long, start long, windows int, mini long, dig long, own byte"), "pieces")
    often = pieces.groupBy("mini").agg(F.count("*").alias("c"), F.max("own").alias("own")).where("c > 1 or own = 1").select("mini")
    live = written(spark, pieces.join(often, "mini", "left_semi"), "live-pieces")
    kinds = live.groupBy("mini", "dig").agg(F.count("*").alias("n"), F.max("own").alias("own"), F.min(F.struct("rid", "start", "windows")).alias("at"))
    kinds = written(spark, kinds, "piece-kinds")
    several = (
        kinds.groupBy("mini").agg(F.count("*").alias("d"), F.min("n").alias("least"), F.max("own").alias("own"))
        .where("least = 1 and (d > 1 or own = 1)").select("mini", "d")
    )
    open_ = kinds.join(several, "mini").select("mini", "dig", "d", "n", "at.rid", "at.start", "at.windows")

    by_row = open_.groupBy("rid").agg(F.collect_set(F.struct("mini", "dig", "d", "n", "start", "windows")).alias("want"))
    held = docs.join(by_row, "rid")

    def fetch(batches):
        import pyarrow as pa

        for b in batches:
            texts, want, rid = b.column(b.schema.get_field_index("t")), b.column(b.schema.get_field_index("want")), b.column(b.schema.get_field_index("rid"))
            for i in range(b.num_rows):
                raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                rows = want[i].as_py()
                cols = [[r[c] for r in rows] for c in ("mini", "dig", "d", "n", "start", "windows")]
                spans = [raw[r["start"] : r["start"] + r["windows"] + length - 1] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid[i].as_py()] * len(rows), pa.int64()), *(pa.array(c, pa.int64()) for c in cols), pa.array(spans, pa.binary())],
                    ["rid", "mini", "dig", "d", "n", "start", "windows", "piece"],
                )

    fetched = written(spark, held.mapInArrow(fetch, "rid long, mini long, dig long, d long, n long, start long, windows long, piece binary"), "piece-bytes")

    def sort_groups(batches):
        import pyarrow as pa

        names = ["rid", "lo", "hi"]

        def settle(rows):
            rid, lo, hi = [], [], []
            minis = np.array([r[1] for r in rows], np.int64).view(np.uint64)
            parts = shared_parts([r[5] for r in rows], minis, length)
            for (i, x, y), at in zip(parts, repeated_windows([rows[i][5][x : y + length - 1] for i, x, y in parts], length), strict=True):
                r = rows[i]
                if r[4] == 1 and len(at):
                    a, b = islands(at)
                    rid += [r[2]] * len(a)
                    lo += (a + r[3] + x).tolist()
                    hi += (b + r[3] + x).tolist()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rid, lo, hi)], names)

        rows, held, last = [], 0, None
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if r[0] != last and held >= ARRAY_BYTES:
                    yield settle(rows)
                    rows, held = [], 0
                last = r[0]
                rows.append(r)
                held += len(r[5])
        if rows:
            yield settle(rows)

    def split(width: int):
        def work(batches):
            import pyarrow as pa

            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    mini, rid, start, n, piece = (b.column(i).slice(lo, 1024) for i in range(5))
                    raw = piece.to_pylist()
                    row, first, last, key = blocks_of(raw, mini.to_numpy().view(np.uint64), length, width)
                    cut = [raw[i][x : y + length - 1] for i, x, y in zip(row.tolist(), first.tolist(), last.tolist(), strict=True)]
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), mini.take(at), rid.take(at), pa.array(start.to_numpy()[row] + first), n.take(at), pa.array(cut, pa.binary())],
                        ["key", "mini", "rid", "start", "n", "piece"],
                    )

        return work

    whole = F.col("mini").alias("key")
    groups = fetched.where(f"d <= {GROUP_PIECES}").select(whole, "mini", "rid", "start", "n", "piece")
    large = fetched.where(f"d > {GROUP_PIECES}").select("mini", "rid", "start", "n", "piece")
    ends = (F.col("start") + F.octet_length("piece") - length + 1).alias("hi")
    alike = []
    for width in SPLITS:
        if not large.limit(1).count():
            break
        cuts = written(spark, large.mapInArrow(split(width), "key long, mini long, rid long, start long, n long, piece binary"), f"blocks-{width}")
        kinds_ = cuts.groupBy("key", "piece").agg(F.sum("n").alias("n"), F.min(F.struct("mini", "rid", "start")).alias("at"))
        kinds_ = written(spark, kinds_.select("key", "at.*", "n", "piece"), f"block-kinds-{width}")
        again = kinds_.where("n > 1").select("key", "piece")
        alike.append(cuts.where("n = 1").join(again, ["key", "piece"], "left_semi").select("rid", F.col("start").alias("lo"), ends))
        sized = kinds_.groupBy("key").agg(F.count("*").alias("d"), F.min("n").alias("least")).where("d > 1 and least = 1").select("key", "d")
        sized = kinds_.join(sized, "key")
        fits = sized if width == SPLITS[-1] else sized.where(f"d <= {GROUP_PIECES}")
        groups = groups.unionByName(fits.select("key", "mini", "rid", "start", "n", "piece"))
        large = sized.where(f"d > {GROUP_PIECES}").select("mini", "rid", "start", "n", "piece")

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    sorted_ = groups.repartition(parts, "key").sortWithinPartitions("key", "rid", "start").mapInArrow(sort_groups, "rid long, lo long, hi long")
    copied = live.join(kinds.where("n > 1").select("mini", "dig"), ["mini", "dig"], "left_semi").select(
        "rid", F.col("start").alias("lo"), (F.col("start") + F.col("windows")).alias("hi")
    )
    found = copied.unionByName(sorted_)
    for more in alike:
        found = found.unionByName(more)
    return found.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(
    spark: SparkSession, docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", with_text: bool = False
) -> DataFrame:
    """One row per row of ``docs``: key, RESULT (and ``kept``, the remaining bytes, if asked for).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else: in another row or the
    same one, overlapping or not; judged on the input. Null texts are empty: nothing to remove. Repeated
    rows are copies of each other and lose all that is ``length`` bytes or longer. Rows with a null key
    are treated like any other. Memory of a task: one text, or one group of at most GROUP_PIECES pieces
    (ARRAY_BYTES of smaller ones).
    """
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).select(
        "k", F.xxhash64("k", "t").alias("rid"), "t"
    )
    spans = repeats(spark, base.select("rid", "t"), length)
    kind = docs.schema[key].dataType.simpleString()

    def finish(batches):
        import pyarrow as pa

        for b in batches:
            texts, found = b.column(1), b.column(2)
            rows = []
            for i in range(b.num_rows):
                raw = texts[i].as_buffer().to_pybytes()
                n = removed = 0
                kept = raw
                if found[i].is_valid:
                    parts, end, hi = [], 0, -1
                    for s in sorted((x["lo"], x["hi"] - 1 + length) for x in found[i].as_py()):
                        if s[0] > hi:
                            if hi > 0:
                                end = hi
                            parts.append(raw[end : s[0]])
                            n += 1
                        hi = max(hi, s[1])
                    parts.append(raw[hi:])
                    kept = b"".join(parts)
                    removed = len(raw) - len(kept)
                rows.append((len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 if with_text else 4]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names)

    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    joined = base.join(spans, "rid", "left").select(F.col("k").alias(key), "t", "spans")
    return joined.mapInArrow(finish, f"`{key}` {kind}, {RESULT}" + ", kept binary" * with_text)


def op3_substrings(spark, sf_dir):
    """200-byte strings that repeat anywhere in ``documents`` removed from every whole text."""
    return without_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Texts as hexadecimal digits, so that places are bytes.
OP3_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT r, i, substr(h, 2 * i + 1, 400) AS s FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
hit AS (SELECT r, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
run AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT r, i, sum(step) OVER (PARTITION BY r ORDER BY i) AS g FROM
  (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS step FROM hit)) GROUP BY r, g),
cut AS (SELECT d.r, lo, hi, substr(h, 2 * coalesce(lag(hi) OVER (PARTITION BY d.r ORDER BY lo), 0) + 1, 2 * (lo - coalesce(lag(hi) OVER (PARTITION BY d.r ORDER BY lo), 0))) AS part FROM run JOIN d USING (r)),
kept AS (SELECT r, count(*) AS n, sum(hi - lo) AS gone, max(hi) AS last, string_agg(part, '' ORDER BY lo) AS head FROM cut GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0)::bigint AS n_removed, coalesce(n, 0)::bigint AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
