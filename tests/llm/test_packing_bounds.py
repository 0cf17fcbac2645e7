"""What packing holds and how long it takes: nothing is kept of words, bins are filled without a new table each."""

import random
import time
import tracemalloc
import zlib

import numpy as np
from tokenizers import Tokenizer

from quillmark.llm import packing


def rare_words(n: int, seed: int = 1) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(6, 12))) for _ in range(n))


def test_encoder_keeps_nothing():
    encode = packing.Encoder()
    texts = [rare_words(5000, i) for i in range(20)]
    encode(texts[0])
    tracemalloc.start()
    for x in texts:
        encode(x)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1 << 20


def test_rare_words_cost_no_more_than_the_encoder():
    encode, texts = packing.Encoder(), [rare_words(3000, i) for i in range(10)]

    def seconds(f):
        begin = time.process_time()
        for x in texts:
            f(x)
        return time.process_time() - begin

    seconds(encode.plain.encode_ordinary)
    plain = min(seconds(encode.plain.encode_ordinary) for _ in range(3))
    assert min(seconds(f) for f in (packing.Encoder(), packing.Encoder(), packing.Encoder())) < 2 * plain


def test_long_blank_runs(spark):
    x = "lead " + " " * 1_200_000 + "x"
    out = packing.pack(spark.createDataFrame([(1, x)], "doc_id long, text string"), with_ids=True).orderBy("start").collect()
    ids = Tokenizer.from_file(packing.Encoder().file).encode(x, add_special_tokens=False).ids
    assert [i for r in out for i in r.ids] == [*ids, 0]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in out)


def test_remainders_are_packed_in_later_bins():
    """More kinds of pieces come up by cutting than there were at first."""
    r = random.Random(3)
    for limits in ((64, 256, 64), (64, 5, 20)):
        packer, out, items = packing.Packer(limits, True, 0, pool=1000), [], {}
        for i in range(300):
            items[i] = n, loss = r.choice([(60, 20), (61, 7)])
            packer.add(i, n, loss, out)
        packer.pack(out)
        for i, (n, _) in items.items():
            mine = sorted((s, k) for j, s, k, _, _ in out if j == i)
            assert [s for s, _ in mine] == [sum(k for _, k in mine[:m]) for m in range(len(mine))] and sum(k for _, k in mine) == n
        assert packer.n == 0 and not packer.waiting
        filled = {}
        for _, _, k, q, _ in out:
            filled[q] = filled.get(q, 0) + k
        if limits[1] == 256:
            assert all(filled[q] == 64 for q in sorted(filled)[:-1])


def test_shingles_are_made_of_bounded_bytes():
    """Workers of the pipeline stay alive from stage to stage, so what one holds at most counts in packing too."""
    import pyarrow as pa

    from quillmark.llm import jaccard

    batch = pa.RecordBatch.from_arrays([pa.array([rare_words(300, i) for i in range(1000)])], ["t"])
    for _ in jaccard._sets(batch, "t", 5):  # powers are kept
        pass
    tracemalloc.start()
    n = sum(len(s) for _, s in jaccard._sets(batch, "t", 5))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1000 * 296
    assert most < 14 << 20
