"""Packing token sequences by vector bin packing.

Every piece has a vector: tokens, segments (1) and loss-bearing tokens. A bin
has a limit in each. The dot-product heuristic fills one bin at a time: of the
pieces that still fit it places the one whose vector, scaled by the limits,
has the largest dot product with what the bin has left. Where cutting is
allowed and nothing fits, the best piece is cut to what is left.

A partition packs its own documents, a bounded pool at a time, in input order:
no shuffle, and a task that is run again gives the same sequences.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END_ID = 0
#: Pieces that wait for a bin at once in each task.
POOL = 4096
#: Characters of white space at a stretch that the fast encoder isn't given; it fails at some 1,000,000.
LONG_BLANK = 100_000
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Encoder:
    """Ids of the byte-level BPE in ``file``: the same merges from ``ranks`` in a faster encoder, text by text.

    Nothing is kept between texts: most words of a large corpus are rare, so finding a word's
    ids among those kept costs more than to merge it again, and its ids would fill the worker.
    Texts that hold a special token's string go to the encoder of ``file``, and so do those
    with a run of white space at which the fast one's splitter runs out of stack.
    """

    def __init__(self, file: str | None = None, ranks: str | None = None):
        import base64
        import re

        import public_tokenizers
        import tiktoken

        with open(ranks or public_tokenizers.path(RANKS), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.file, self.full = file or public_tokenizers.path(TOKENIZER), None
        with open(self.file, encoding="utf-8") as f:
            self.special = sorted(x["content"] for x in json.load(f)["added_tokens"])
        self.blank = re.compile(rf"(?<!\s)\s{{{LONG_BLANK}}}").search

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(x in text for x in self.special) or len(text) > LONG_BLANK and self.blank(text):
            if self.full is None:  # large, and rarely needed
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.file)
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.plain.encode_ordinary(text), "<u4").tobytes()


class Packer:
    """Bins for pieces given one by one; ``out`` gets (item, start, length, sequence, offset)."""

    def __init__(self, limits: tuple[int, int, int], cut: bool, first_id: int, pool: int = POOL):
        self.limits, self.cut, self.pool, self.next = np.array(limits, np.float64), cut, pool, first_id
        self.waiting: dict[tuple[int, int], list] = {}
        self.n = 0

    def add(self, item, tokens: int, loss: int, out: list) -> None:
        """``loss`` of the piece's tokens bear loss; they count as spread evenly over it."""
        size, start, most = int(self.limits[0]), 0, int(self.limits[2])
        if not self.cut and (tokens > size or loss > most):
            raise ValueError("a piece beyond the limits can't be packed without cutting")
        while self.cut and tokens - start > size or self.cut and self._loss(tokens, loss, start, tokens) > most:
            n = size
            while self._loss(tokens, loss, start, start + n) > most:
                n -= 1
            out.append((item, start, n, self.next, 0))
            self.next += 1
            start += n
        if tokens - start == size:
            out.append((item, start, size, self.next, 0))
            self.next += 1
        elif tokens > start:
            self._wait(item, tokens, loss, start)
            if self.n >= self.pool:
                self.pack(out, self.pool // 4)

    @staticmethod
    def _loss(tokens: int, loss: int, lo: int, hi: int) -> int:
        return loss if tokens == hi - lo else hi * loss // tokens - lo * loss // tokens

    def _wait(self, item, tokens: int, loss: int, start: int) -> tuple[int, int]:
        kind = (tokens - start, self._loss(tokens, loss, start, tokens))
        self.waiting.setdefault(kind, []).append((item, tokens, loss, start))
        self.n += 1
        return kind

    def pack(self, out: list, leave: int = 0) -> None:
        """Fill bins until at most ``leave`` pieces wait."""
        row = {k: i for i, k in enumerate(self.waiting)}
        size, bearing = np.array([*self.waiting, (0, 0)], np.float64).T.copy()  # of each kind; a kind without pieces stays
        alive = np.arange(len(size)) < len(row)
        by_size, by_loss = self.limits[[0, 2]] ** -2
        while self.n > leave:
            left, at = self.limits.tolist(), 0
            while self.n and min(left) > 0:
                usable = alive & (size <= left[0]) & (bearing <= left[2])
                cutting = not usable.any()
                if cutting and not self.cut:
                    break
                # every piece is one segment, which adds the same to each product
                score = np.where(alive if cutting else usable, size * (left[0] * by_size) + bearing * (left[2] * by_loss), -1.0)
                best = int(score.argmax())
                kind = (int(size[best]), int(bearing[best]))
                same = self.waiting[kind]
                item, tokens, loss, start = same[-1]
                n = kind[0]
                if cutting:
                    n = min(n - 1, int(left[0]))
                    while n and self._loss(tokens, loss, start, start + n) > left[2]:
                        n -= 1
                    if not n:
                        break
                same.pop()
                self.n -= 1
                if not same:
                    del self.waiting[kind]
                    alive[best] = False
                if cutting:
                    rest = self._wait(item, tokens, loss, start + n)
                    if rest not in row:
                        row[rest] = len(row)
                        if len(row) > len(size):
                            size, bearing, alive = (np.concatenate([x, np.zeros_like(x)]) for x in (size, bearing, alive))
                        size[row[rest]], bearing[row[rest]] = rest
                    alive[row[rest]] = True
                out.append((item, start, n, self.next, at))
                at += n
                left = [left[0] - n, left[1] - 1, left[2] - self._loss(tokens, loss, start, start + n)]
            self.next += 1


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 1024,
    segments: int = 256,
    loss_tokens: int | None = None,
    loss_share: str | None = None,
    cut: bool = True,
    file: str | None = None,
    ranks: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of each document: key, PIECES (and the piece's ids, if asked for).

    A document is its ids and then END_ID; a null or empty text is END_ID alone. Limits of a
    sequence: ``size`` tokens, ``segments`` pieces, ``loss_tokens`` loss-bearing tokens (default:
    ``size``). ``loss_share`` names a column with the share of a document's tokens that bear loss
    (0 to 1, null or none: 1). Repeated rows are packed each by itself. sequence_id is unique
    over all partitions, not gapless; no rows give no rows. Sequences are meant to be padded to
    ``size``: only the last of each partition has room left to speak of. Other columns are not kept.
    """
    limits = (size, segments, size if loss_tokens is None else loss_tokens)
    kind = docs.schema[key].dataType.simpleString()
    chosen = [key, text] + ([loss_share] if loss_share else [])

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = Encoder(file, ranks)  # of this task: a worker that goes on to other work holds none
        packer = Packer(limits, cut, TaskContext.get().partitionId() << 33)
        end = np.array([END_ID], "<u4").tobytes()
        key_type = [None]

        def rows(out):
            if not out:
                return None
            parts = [ids[4 * s : 4 * (s + n)] for (_, ids, _), s, n, _, _ in out]
            total = [len(ids) // 4 for (_, ids, _), *_ in out]
            cols = [
                pa.array([i[0] for i, *_ in out], key_type[0]),
                *(pa.array(x, pa.int64()) for x in (
                    [s for _, s, *_ in out], [n for _, _, n, *_ in out], [zlib.crc32(p) for p in parts], total,
                    [q for *_, q, _ in out], [o for *_, o in out],
                    [Packer._loss(t, i[2], s, s + n) for t, (i, s, n, _, _) in zip(total, out, strict=True)],
                )),
            ]
            if with_ids:
                cols.append(pa.array([np.frombuffer(p, "<u4").astype("i4") for p in parts], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, names)

        names = [key] + [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
        out: list = []
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            key_type[0] = keys.type
            shares = batch.column(2).to_pylist() if loss_share else None
            keys = keys.to_pylist()
            for i in range(len(keys)):
                ids = encode(texts[i].as_py() or "") + end
                n = len(ids) // 4
                share = 1.0 if shares is None or shares[i] is None else min(1.0, max(0.0, shares[i]))
                loss = n if share == 1.0 else round(n * share)
                packer.add((keys[i], ids, loss), n, loss, out)
                if len(out) >= 2048:
                    yield rows(out)
                    out = []
        packer.pack(out)
        if (last := rows(out)) is not None:
            yield last

    schema = f"`{key}` {kind}, {PIECES}" + ", ids array<int>" * with_ids
    return docs.select(*chosen).mapInArrow(work, schema)


def op4_packing(spark, sf_dir):
    """All ``documents`` packed into sequences of at most 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
