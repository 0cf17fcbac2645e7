import json

import pytest
from pyspark.sql import functions as F

from quillmark.cli import check_payload, main, rules_payload
from quillmark.operators import judge as J
from quillmark.operators.masking import UsageError


def good(system, prompt, schema):
    if "rewritten" in schema["properties"]:
        return {"rewritten": " plain \n"}
    return {"violations": [{"ruleId": "throat-clearing", "matchedText": "LATE", "explanation": "x", "suggestedChange": "remove this whole sentence now"}, {"ruleId": "", "matchedText": "a"}, {"ruleId": "balanced-take", "matchedText": "nowhere to be found"}]}


def bad(system, prompt, schema):
    raise RuntimeError("down")


def patchy(system, prompt, schema):
    if "marker" in prompt:
        raise RuntimeError("down")
    return good(system, prompt, schema)


def python_chunks(text):
    import re

    if len(text.encode()) <= 4000:
        return [text]
    ps, out, cur, n = re.split("\n\n+", text), [], [], 0
    for i, p in enumerate(ps):
        cur.append(p)
        n += len(p.encode()) + 2
        if n >= 3500 and i < len(ps) - 1:
            out.append("\n\n".join(cur))
            cur, n = [p], len(p.encode()) + 2
    return out + ["\n\n".join(cur)]


def test_chunks(spark):
    texts = ["", "short", "é" * 2001, "\n\n".join("word " * k for k in range(1, 90)), ("x" * 3600 + "\n\n") * 3 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = J.chunked(df).orderBy("doc_id", "chunk_id").collect()
    for i, t in enumerate(texts):
        assert [r.chunk for r in rows if r.doc_id == i] == python_chunks(t)


def test_passes(spark):
    long = "\n\n".join(["It was late and cold é."] * 300)
    df = spark.createDataFrame([(1, "é It was late."), (2, long), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in J.judged(df, good, "sentence").collect()}
    assert [(v.start_index, v.end_index, v.matched_text, v.suggested_change) for v in got[1].found] == [(10, 14, "late", "")]
    assert len(got[2].found) == 1 and got[3].found == [] and got[1].error is None
    assert J.judged(df, bad, "document").where("error is not null").count() == 3
    part = spark.createDataFrame([(1, "marker\n\n" + long), (2, "marker")], "doc_id int, text string")
    errors = {r.doc_id: r.error for r in J.judged(part, patchy, "sentence").collect()}
    assert errors[1] is None and errors[2] == "down"
    auto = J.with_model(df, bad, "high", True).select(F.col("llm.sentence.error").alias("e"), F.col("llm.document.ran").alias("r")).collect()
    assert all(r.e == "down" and not r.r for r in auto)
    with pytest.raises(J.JudgeError):
        J.with_model(df, bad, "low", False)


def test_payload_and_rewrite(spark):
    out = check_payload(spark, "It was late. A crucial day.", "x.txt", "auto", "low", True, good)
    assert out["counts_by_rule"] == {"overused-intensifiers": 1, "throat-clearing": 1} and out["llm"]["sentence"]["ran"]
    r = J.rewritten(spark.createDataFrame([(1, "t")], "doc_id int, text string"), good, ["hedge-stack"]).first()
    assert (r.rewritten, r.applied_rules) == ("plain", ["hedge-stack"])
    assert J.rewritten(spark.createDataFrame([(1, "t")], "doc_id int, text string"), good).first().applied_rules is None


def test_effort():
    assert J.resolve_effort() == ("off", True) and J.resolve_effort(auto=True) == ("high", True)
    assert J.resolve_effort(llm=True) == ("low", False) and J.resolve_effort(llm=True, deep=False) == ("off", False)
    assert J.resolve_effort("LOW", deep=True) == ("low", False) and J.resolve_effort("auto", llm=True, auto=True) == ("high", True)
    with pytest.raises(UsageError):
        J.resolve_effort("some")
    assert J.auto_enabled("x", {"JUDGE_PLUGIN_ROOT": "1"}, lambda b: "/x") and not J.auto_enabled("x", {}, lambda b: "/x") and not J.auto_enabled("x", {"JUDGE_PLUGIN_ROOT": "1"}, lambda b: None)


def test_decode():
    assert J.decode('{"structured_result": {"a": 1}, "result": "{}"}') == {"a": 1}
    assert J.decode('{"result": "{\\"a\\": 2}"}') == {"a": 2}
    for wrong in ("no", "[]", "{}", '{"is_error": true, "result": "x"}', '{"result": "plain"}'):
        with pytest.raises(J.JudgeError):
            J.decode(wrong)


def test_cli(tmp_path, capsys):
    assert rules_payload(llm_only=True)["count"] == 13 and rules_payload()["count"] == 48 and rules_payload("none")["count"] == 0
    assert main(["rules", "--category", "framing"]) == 0 and json.loads(capsys.readouterr().out)["count"] == 5
    assert main(["version"]) == 0
    assert main(["check", str(tmp_path / "missing"), "--lang", "cobol"]) == 2
    (tmp_path / "a").write_text("x")
    assert main(["check", str(tmp_path / "a"), "--lang", "cobol"]) == 4
    assert main(["rewrite", str(tmp_path / "a"), "--rules", "nope"]) == 4
    assert main(["rewrite", str(tmp_path / "a"), "--judge-bin", "/no/such/program"]) == 3
