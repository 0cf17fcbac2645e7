"""Places of many findings in one search, answers that survive a lost pass, texts that aren't carried with chunks."""

import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.operators import judge as J


class Counting:
    """A judge that leaves a file for each call; its process dies at the given one."""

    def __init__(self, folder, dies_at=None):
        self.folder, self.dies_at = str(folder), dies_at

    def __call__(self, system, prompt, schema):
        n = len(os.listdir(self.folder))
        if self.dies_at is not None and n >= self.dies_at:
            os._exit(1)
        open(os.path.join(self.folder, f"{n}-{random.random()}"), "w").close()
        word = prompt.split("Text to analyze:\n\n", 1)[1].split(" ")[0]
        if word == "fails":
            raise RuntimeError("down")
        return {"violations": [{"ruleId": "throat-clearing", "matchedText": word, "explanation": "first", "suggestedChange": ""}]}


def calls(folder):
    return len(os.listdir(folder))


def test_a_lost_pass_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "CALLS_A_TASK", 5)
    seen, path = tmp_path / "calls", f"file://{tmp_path}/answers"
    seen.mkdir()
    docs = spark.createDataFrame([(i, f"word{i} é stands here. WORD{i} again") for i in range(60)] + [(100, "word1 é stands here. WORD1 again")], "doc_id int, text string")
    with pytest.raises(Exception):  # noqa: B017
        J.judged(docs, Counting(seen, dies_at=33), "document", parallel=2, path=path).count()
    kept = J.answers(spark, path).count()
    assert 20 <= kept <= 33  # whole rounds of 2 by 5
    before = calls(seen)
    found = {r["doc_id"]: r["found"] for r in J.judged(docs, Counting(seen), "document", parallel=2, path=path).collect()}
    assert calls(seen) - before == 60 - kept and J.answers(spark, path).count() == 60
    assert all(found[i][0]["matched_text"] == f"word{i}" for i in range(60)) and found[100] == found[1]
    again = J.judged(docs, Counting(seen), "document", parallel=2, path=path).count()
    assert again == 61 and calls(seen) - before == 60 - kept  # nothing is asked twice


def test_failures_are_asked_again(spark, tmp_path):
    seen, path = tmp_path / "calls", f"file://{tmp_path}/answers"
    seen.mkdir()
    docs = spark.createDataFrame([(1, "fails now"), (2, "fine now")], "doc_id int, text string")
    for n in (2, 3):
        errors = {r["doc_id"]: r["error"] for r in J.judged(docs, Counting(seen), "sentence", path=path).collect()}
        assert errors == {1: "down", 2: None} and calls(seen) == n
    with pytest.raises(J.JudgeError):
        J.with_model(docs, Counting(seen), "low", False, path=path)
    out = J.with_model(docs.where("doc_id = 2"), Counting(seen), "low", False, path=path).first()
    assert out["llm"]["sentence"]["ran"] and len(out["extra"]) == 1


def test_another_tier_or_text_is_another_question(spark):
    row = spark.range(1).select(J.asked("sentence", F.lit("a")), J.asked("document", F.lit("a")), J.asked("sentence", F.lit("b"))).first()
    assert len(set(row)) == 3


def test_places_as_by_plain_search():
    r = random.Random(5)
    texts, needles = [], []
    for _ in range(200):
        t = "".join(r.choice("aAbBé€😀 ") for _ in range(r.randint(0, 40)))
        texts.append(t or None if r.random() < 0.1 else t)
        needles.append([r.choice([t[i : i + r.randint(0, 4)].swapcase() if r.random() < 0.5 else t[i : i + r.randint(0, 4)], "zz", "", "É"]) for i in (r.randint(0, 40) for _ in range(r.choice([0, 3, 20])))])
    got = J.first_places(pd.Series(texts), pd.Series(needles))
    low = lambda x: x.translate(J._ASCII_LOWER)
    for t, words, out in zip(texts, needles, got, strict=True):
        for w, p in zip(words, out, strict=True):
            at = -1 if not w or not t else t.find(w) if w in t else low(t).find(low(w))
            assert p == (None if at < 0 else {"start": len(t[:at].encode()), "end": len(t[: at + len(w)].encode()), "m": t[at : at + len(w)]})


def test_many_findings_in_a_long_text_take_linear_time():
    def took(n):
        text = " ".join(f"Wörd{i}" for i in range(n))
        t = time.process_time()
        out = J.first_places(pd.Series([text]), pd.Series([[f"wörd{i}" for i in range(n)]]))
        assert out[0][n - 1]["m"] == f"Wörd{n - 1}"
        return time.process_time() - t

    took(100)
    assert took(40_000) < 8 * took(10_000) + 0.3


def test_a_long_text_is_not_carried_with_its_chunks(spark):
    text = "\n\n".join(f"Start{i} of a paragraph. " + "word " * 150 for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, "Start0 short")], "doc_id int, text string")

    def echo(system, prompt, schema):
        word = prompt.split("Text to analyze:\n\n", 1)[1].split(" ")[0]
        return {"violations": [{"ruleId": "throat-clearing", "matchedText": word.upper(), "explanation": "x", "suggestedChange": ""}] * 2}

    found = {r["doc_id"]: r["found"] for r in J.judged(docs, echo, "sentence").collect()}
    first = [c.split(" ")[0] for c in J.chunked(docs.where("doc_id = 1")).orderBy("chunk_id").toPandas()["chunk"]]
    assert [v["matched_text"] for v in found[1]] == first and len(first) > 50 and len(found[2]) == 2
    plan = J.judged(docs, echo, "sentence")._jdf.queryExecution().optimizedPlan().toString()
    asked = next(line for line in plan.split("\n") if "MapInPandas" in line)
    assert "_t" not in asked
