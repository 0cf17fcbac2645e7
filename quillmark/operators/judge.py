"""Model-backed passes around an injected callable.

A judge is ``judge(system, prompt, schema) -> dict or str``; it runs inside
``mapInPandas`` on executors and must be importable there. Nothing here knows
which model answers. ``CommandJudge`` wraps a command-line program.

Only chunks go to the judge and only answers come back; a document's text meets
its answers once, by key, and all places are found in one search of it. Answers
can be kept in a Parquet table by a hash of all that was asked (``ask_all``): a
rerun, or a pass that goes on after a lost one, asks only what has no answer yet.
"""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import patterns as P
from quillmark.functions.catalogue import BY_ID, REWRITE_DEFAULTS, RULES
from quillmark.functions.spans import java, once, trim
from quillmark.operators.detectors import VIOLATION
from quillmark.operators.masking import UsageError

#: Bytes above which a text is cut, bytes that close a chunk, seconds a call may take.
CHUNK_ABOVE, CHUNK_SIZE = 4000, 3500
TIMEOUTS = {"sentence": 30, "document": 60, "rewrite": 20}
ITEMS = "array<struct<ruleId:string,matchedText:string,explanation:string,suggestedChange:string>>"

SYSTEM = {
    "sentence": "You edit prose. Find the listed habits of machine-written text in the passage you get. Report an instance only when it is beyond doubt.",
    "document": "You edit prose. Read the whole piece for the listed faults of structure, which show only over its full length. Report a fault only when it is beyond doubt.",
}
_FRAME = {
    "sentence": ("Look for these patterns:", "suggestedChange rewrites the matched words alone, plainly and concretely."),
    "document": ("Read the piece from start to end. Look for these patterns:", "Report clear cases only; for a short or well-built piece return an empty list."),
}
SCHEMA = {
    "type": "object",
    "properties": {
        "violations": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {k: {"type": "string"} for k in ("ruleId", "matchedText", "explanation", "suggestedChange")},
                "required": ["ruleId", "matchedText", "explanation"],
            },
        }
    },
    "required": ["violations"],
}
REWRITE_SCHEMA = {"type": "object", "properties": {"rewritten": {"type": "string"}}, "required": ["rewritten"]}
_PRINCIPLES = ("Say it directly, without a run-up.", "Add no explanation and no transition that was not there.", "Keep every fact and the meaning as they are.")


class JudgeError(RuntimeError):
    """The model could not be asked, or its answer not be read."""


# ---------------------------------------------------------------- effort


def auto_enabled(binary: str, env=None, which=shutil.which, variables: tuple[str, ...] = ("JUDGE_PLUGIN_ROOT",)) -> bool:
    """A plugin variable is set and the judge's program can be found."""
    env = os.environ if env is None else env
    return any(env.get(v) for v in variables) and which(binary) is not None


def resolve_effort(effort: str | None = None, llm: bool | None = None, deep: bool | None = None, auto: bool = False) -> tuple[str, bool]:
    """(effort, chosen automatically): the effort flag, then deep, then llm, then automatic. None means that a flag isn't given."""
    default = ("high" if auto else "off", True)
    if effort is not None:
        pick = effort.lower()
        if pick in ("off", "low", "high"):
            return pick, False
        if pick in ("", "auto"):
            return default
        raise UsageError(f"invalid effort {effort!r} (want off|low|high|auto)")
    if deep is not None:
        return ("high" if deep else "off"), False
    if llm is not None:
        return ("low" if llm else "off"), False
    return default


# ---------------------------------------------------------------- prompts


def rule_prompt(tier: str) -> str:
    """The rules of a tier, numbered in catalogue order."""
    head, tail = _FRAME[tier]
    chosen = [r for r in RULES if r["llm_tier"] == tier]
    return "\n\n".join([head, *(f'{i}. "{r["id"]}": {r["llm_detection_hint"] or r["description"]}' for i, r in enumerate(chosen, 1)), tail])


def detection_prompt(tier: str, passage: str) -> str:
    return f"{rule_prompt(tier)}\n\nText to analyze:\n\n{passage}"


def rewrite_hints(ids: list[str]) -> list[tuple[str, str]]:
    """(rule, hint) in the given order, repeats kept; blanks are skipped, unknown rules are an error."""
    out = []
    for raw in ids:
        rule = raw.strip()
        if not rule:
            continue
        if rule not in BY_ID:
            raise UsageError(f"unknown rule {rule!r}")
        if BY_ID[rule]["rewrite_hint"]:
            out.append((rule, BY_ID[rule]["rewrite_hint"]))
    return out


def rewrite_prompt(hints: list[str] = ()) -> str:
    lines = [BY_ID[r]["llm_directive"] for r in REWRITE_DEFAULTS] + list(_PRINCIPLES)
    text = "You edit prose. Rewrite the text so that it reads like plain human writing. Follow all of these:\n" + "\n".join(f"- {x}" for x in lines)
    return text + ("\n\nFaults found in this text:\n" + "\n".join(f"- {h}" for h in hints) if hints else "")


# ---------------------------------------------------------------- column expressions


def chunks(text: Column) -> Column:
    """array<string>: a text of up to CHUNK_ABOVE bytes whole, a longer one by paragraphs, neighbours sharing one paragraph."""
    paras = F.split(text, "\n\n+", -1)
    empty = F.expr("cast(array() as array<string>)")

    def step(s: Column, x: Column) -> Column:
        now = F.concat(s["now"], F.array(x["p"]))
        size = s["size"] + F.octet_length(x["p"]) + 2
        closes = (size >= CHUNK_SIZE) & ~x["last"]
        return F.struct(
            F.when(closes, F.concat(s["out"], F.array(F.array_join(now, "\n\n")))).otherwise(s["out"]).alias("out"),
            F.when(closes, F.array(x["p"])).otherwise(now).alias("now"),
            F.when(closes, F.octet_length(x["p"]) + 2).otherwise(size).alias("size"),
        )

    def fold(z: Column) -> Column:
        marked = F.transform(z, lambda p, i: F.struct(p.alias("p"), (i == F.size(z) - 1).alias("last")))
        return F.aggregate(
            marked,
            F.struct(empty.alias("out"), empty.alias("now"), F.lit(0).alias("size")),
            step,
            lambda s: F.concat(s["out"], F.array(F.array_join(s["now"], "\n\n"))),
        )

    long = F.element_at(F.transform(F.array(paras), fold), 1)
    return F.when(F.octet_length(text) <= CHUNK_ABOVE, F.array(text)).otherwise(long)


def chunked(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per chunk: the columns of ``docs``, chunk_id, chunk."""
    return docs.select("*", F.posexplode(chunks(F.coalesce(F.col(text), F.lit("")))).alias("chunk_id", "chunk"))


def sanitized(suggestion: Column, matched: Column) -> Column:
    """An instruction in place of a replacement, longer than one and a half times the match, becomes empty."""
    instruction = trim(suggestion).rlike(java(P.INSTRUCTION)) & (F.octet_length(suggestion) > F.floor(F.octet_length(matched) * 1.5))
    return F.when(instruction, F.lit("")).otherwise(F.coalesce(suggestion, F.lit("")))


PLACES = "array<struct<start:int,end:int,m:string>>"
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: More needles than this are looked for by one automaton, fewer one by one.
FEW = 8


def _first(text: str, needles: set[str]) -> dict[str, int]:
    """The first place of each needle that the text holds; many needles in one pass over it."""
    if len(needles) <= FEW:
        return {w: at for w in needles if (at := text.find(w)) >= 0}
    try:
        from ahocorasick import Automaton
    except ImportError:
        return {w: at for w in needles if (at := text.find(w)) >= 0}
    seeker, found = Automaton(), {}
    for w in needles:
        seeker.add_word(w, w)
    seeker.make_automaton()
    for last, w in seeker.iter(text):
        if w not in found:
            found[w] = last + 1 - len(w)
            if len(found) == len(needles):
                break
    return found


def _bytes_before(text: str) -> np.ndarray | None:
    """UTF-8 bytes before each character and at the end; None where these are the characters themselves."""
    if text.isascii():
        return None
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))])


def first_places(texts: pd.Series, needles: pd.Series) -> pd.Series:
    """By row, for each needle its first place as written, else in any (ASCII) case, in bytes; None where it is nowhere or empty."""
    out = []
    for t, words in zip(texts, needles, strict=True):
        words = [] if words is None else list(words)
        wanted = {w for w in words if w}
        at = _first(t, wanted) if t and wanted else {}
        if t and len(at) < len(wanted):
            lower = {w: w.translate(_ASCII_LOWER) for w in wanted - at.keys()}
            near = _first(t.translate(_ASCII_LOWER), set(lower.values()))
            at |= {w: near[x] for w, x in lower.items() if x in near}
        size = _bytes_before(t) if at else None
        byte = (lambda i: i) if size is None else (lambda i, size=size: int(size[i]))
        out.append([{"start": byte(at[w]), "end": byte(at[w] + len(w)), "m": t[at[w] : at[w] + len(w)]} if w in at else None for w in words])
    return pd.Series(out)


def _first_places(texts: pd.Series, needles: pd.Series) -> pd.Series:
    return first_places(texts, needles)


def located(text: Column, items: Column) -> Column:
    """array<VIOLATION> of a model's items in the full text: first place as written, else in any (ASCII) case; the rest is dropped.

    One search of the text for all items together.
    """
    good = F.filter(items, lambda x: (F.coalesce(x["ruleId"], F.lit("")) != "") & (F.coalesce(x["matchedText"], F.lit("")) != ""))
    places = F.pandas_udf(_first_places, PLACES)(text, F.transform(good, lambda x: x["matchedText"]))

    def violation(z: Column) -> Column:
        x, p = z["x"], z["p"]
        return F.struct(
            x["ruleId"].alias("rule_id"), p["start"].alias("start_index"), p["end"].alias("end_index"), p["m"].alias("matched_text"), x["explanation"].alias("explanation"),
            sanitized(x["suggestedChange"], x["matchedText"]).alias("suggested_change"), F.lit(len(P.ORDER)).alias("ord"),
        )

    both = F.zip_with(good, places, lambda x, p: F.struct(x.alias("x"), p.alias("p")))
    return F.transform(F.filter(both, lambda z: z["p"].isNotNull()), violation).cast(f"array<{VIOLATION}>")


def first_by_match(violations: Column) -> Column:
    """The first per (rule, matched text), in order: of equal neighbours in sorted order the first stays."""
    placed = F.array_sort(F.transform(violations, lambda v, i: F.struct(v["rule_id"].alias("r"), v["matched_text"].alias("m"), i.alias("i"))))
    same = lambda a, b: a["r"].eqNullSafe(b["r"]) & a["m"].eqNullSafe(b["m"])
    fresh = once(placed, lambda s: F.filter(s, lambda x, j: (j == 0) | ~same(F.get(s, j - 1), x)))
    kept = F.array_sort(F.transform(fresh, lambda x: x["i"]))
    return once(F.struct(violations.alias("v"), kept.alias("k")), lambda z: F.transform(z["k"], lambda i: z["v"][i]))


# ---------------------------------------------------------------- judges


def decode(payload: str) -> dict:
    """The result inside a command's JSON envelope: structured first, then plain, which may itself be a JSON string."""
    try:
        env = json.loads(payload)
    except ValueError as e:
        raise JudgeError(f"the answer is no JSON: {payload[:400]}") from e
    if not isinstance(env, dict):
        raise JudgeError(f"the answer is no object: {payload[:400]}")
    if env.get("is_error"):
        raise JudgeError(str(env.get("result") or env.get("error") or "the model reported an error")[:400])
    for key in ("structured_result", "structured_output", "result"):
        got = env.get(key)
        if isinstance(got, str) and got.strip():
            try:
                got = json.loads(got)
            except ValueError as e:
                raise JudgeError(f"the result is no JSON: {got[:400]}") from e
        if isinstance(got, dict):
            return got
    raise JudgeError(f"the answer holds no result: {payload[:400]}")


@dataclass(frozen=True)
class CommandJudge:
    """A program that takes the prompt on standard input and answers in JSON."""

    binary: str
    model: str = ""
    timeout: float = 60
    arguments: tuple[str, ...] = field(default_factory=tuple)

    def argv(self, system: str, schema: dict) -> list[str]:
        model = ["--model", self.model] if self.model else []
        return [self.binary, "-p", "--output-format", "json", *model, "--system-prompt", system, "--json-schema", json.dumps(schema), *self.arguments]

    def __call__(self, system: str, prompt: str, schema: dict) -> dict:
        try:
            done = subprocess.run(self.argv(system, schema), input=prompt, capture_output=True, text=True, timeout=self.timeout)
        except (OSError, subprocess.TimeoutExpired) as e:
            raise JudgeError(str(e)[:400]) from e
        if done.returncode:
            raise JudgeError((done.stderr or done.stdout).strip()[:400] or f"exit code {done.returncode}")
        return decode(done.stdout)


def _ask(judge, tier: str, passage: str) -> tuple[list[dict], str | None]:
    try:
        got = judge(SYSTEM[tier], detection_prompt(tier, passage), SCHEMA)
        got = decode(json.dumps({"result": got})) if isinstance(got, str) else got
        rows = got.get("violations") or []
        return [{k: r.get(k) for k in ("ruleId", "matchedText", "explanation", "suggestedChange")} for r in rows if isinstance(r, dict)], None
    except Exception as e:  # a failed call is a row's error, not the job's
        return [], str(e)[:400] or type(e).__name__


ANSWERS = f"ask string, items {ITEMS}, error string"
#: Calls of one task between two commits of the answer table.
CALLS_A_TASK = 64


def asked(tier: str, passage: Column) -> Column:
    """A hash of all that a call depends on: instructions, rules, schema and passage."""
    fixed = "\0".join([SYSTEM[tier], rule_prompt(tier), json.dumps(SCHEMA, sort_keys=True)])
    return F.sha2(F.concat(F.lit(fixed + "\0"), passage), 256)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """The table of answers at a path: one row for each thing asked, an answer before an error; empty where there is no table yet."""
    try:
        found = spark.read.schema(ANSWERS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ANSWERS)
    best = F.min(F.struct(F.col("error").isNotNull().alias("bad"), "items", "error"))
    return found.groupBy("ask").agg(best.alias("b")).select("ask", "b.items", "b.error")


def ask_all(spark: SparkSession, passages: DataFrame, judge, tier: str, path: str, parallel: int | None = None) -> DataFrame:
    """The answers to all ``passages`` (column ``chunk``), from the table at ``path`` or asked now and added to it.

    Equal passages are asked once. What is missing is asked in rounds of ``parallel`` tasks (so many calls at a time over
    the cluster, by default one for each core) of CALLS_A_TASK calls, and every round is committed: a pass that is lost
    loses one round. What failed is asked again by the next pass.
    """
    parallel = parallel or spark.sparkContext.defaultParallelism
    due = passages.select(asked(tier, F.col("chunk")).alias("ask"), "chunk").dropDuplicates(["ask"])
    due = due.join(answers(spark, path).where("error is null").select("ask"), "ask", "left_anti")
    todo = f"{path.rstrip('/')}-todo/{uuid.uuid4().hex[:12]}"  # so that rounds don't cut the documents anew
    due.write.parquet(todo)
    rows = spark.read.schema("ask string, chunk string").parquet(todo)
    rounds = -(-rows.count() // (parallel * CALLS_A_TASK))

    def call(frames):
        for f in frames:
            got = [_ask(judge, tier, c) for c in f["chunk"]]
            yield pd.DataFrame({"ask": f["ask"], "items": [a for a, _ in got], "error": [e for _, e in got]})

    for k in range(rounds):
        mine = rows.where(F.pmod(F.xxhash64("ask"), F.lit(rounds)) == k).repartition(parallel, "ask")
        mine.mapInPandas(call, ANSWERS).write.mode("append").parquet(path)
    return answers(spark, path)


def judged(docs: DataFrame, judge, tier: str, key: str = "doc_id", text: str = "text", parallel: int | None = None, path: str | None = None) -> DataFrame:
    """(key, found array<VIOLATION>, error): model findings per document.

    The sentence tier asks chunk by chunk; its error is null unless all chunks fail, and repeats over chunks
    are dropped by rule and matched text. The document tier asks once. ``parallel`` bounds the calls at a time.
    Keys must be unique and not null. With ``path``, answers are kept in a table there and asked for once (this
    runs the calls); without it they are asked for whenever the result is computed.
    """
    spark = docs.sparkSession
    base = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    parts = chunked(base, "_t").drop("_t") if tier == "sentence" else base.select(key, F.lit(0).alias("chunk_id"), F.col("_t").alias("chunk"))
    kind = base.schema[key].dataType.simpleString()

    def call(frames):
        for f in frames:
            got = [_ask(judge, tier, c) for c in f["chunk"]]
            yield pd.DataFrame({key: f[key], "chunk_id": f["chunk_id"], "items": [a for a, _ in got], "error": [e for _, e in got]})

    if path:
        known = ask_all(spark, parts, judge, tier, path, parallel)
        answered = parts.select(key, "chunk_id", asked(tier, F.col("chunk")).alias("ask")).join(known, "ask", "left").drop("ask")
        answered = answered.withColumn("items", F.coalesce("items", F.expr(f"cast(array() as {ITEMS})")))
    else:
        spread = parts.repartition(parallel) if parallel else parts
        answered = spread.mapInPandas(call, f"`{key}` {kind}, chunk_id int, items {ITEMS}, error string")
    whole = answered.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("chunk_id", "items", "error"))).alias("parts"), F.count("*").alias("_n"), F.count("error").alias("_bad")
    )
    # the texts come to their answers, each once
    placed = base.join(whole, key).select(key, "parts", "_n", "_bad", located(F.col("_t"), F.flatten(F.transform("parts", lambda p: p["items"]))).alias("found"))
    return placed.select(
        key, F.when(F.col("_n") > 1, first_by_match(F.col("found"))).otherwise(F.col("found")).alias("found"),
        F.when(F.col("_n") == F.col("_bad"), F.col("parts")[0]["error"]).alias("error"),
    )


def _settled(df: DataFrame) -> DataFrame:
    """Computed once: by a checkpoint in the shared folder, or in memory where none is set (a local session)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()


def with_model(docs: DataFrame, judge, effort: str, auto: bool, key: str = "doc_id", text: str = "text", parallel: int | None = None, path: str | None = None) -> DataFrame:
    """``docs`` with ``extra`` (findings of all tiers) and ``llm``: by tier auto, ran, error.

    An automatically chosen pass that fails is recorded; one that was asked for raises JudgeError (this runs the calls).
    With ``path`` answers are kept in a table there.
    """
    tiers = {"off": (), "low": ("sentence",), "high": ("sentence", "document")}[effort]
    out = docs.withColumn("extra", F.expr(f"cast(array() as array<{VIOLATION}>)"))
    status = []
    for tier in tiers:
        got = judged(docs, judge, tier, key, text, parallel, path).withColumnsRenamed({"found": "_f", "error": "_e"})
        if not auto:
            got = got if path else _settled(got)
            bad = got.where("_e is not null").select(key, "_e").first()
            if bad:
                raise JudgeError(f"{tier} pass: {bad['_e']}")
        out = out.join(got, key, "left").withColumn("extra", F.concat("extra", F.coalesce("_f", F.expr("array()"))))
        out = out.withColumn(f"_{tier}", F.struct(F.lit(auto).alias("auto"), F.col("_e").isNull().alias("ran"), F.col("_e").alias("error"))).drop("_f", "_e")
        status.append(f"_{tier}")
    if status:
        out = out.withColumn("llm", F.struct(*(F.col(c).alias(c[1:]) for c in status))).drop(*status)
    return out


def rewritten(docs: DataFrame, judge, ids: list[str] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rewritten, error, applied_rules): each text rewritten, outer white space removed. No rules applied gives a null list."""
    hints = rewrite_hints(list(ids))
    system = rewrite_prompt([h for _, h in hints])
    kind = docs.schema[key].dataType.simpleString()

    def call(frames):
        for f in frames:
            texts, errors = [], []
            for t in f["_t"]:
                try:
                    got = judge(system, t, REWRITE_SCHEMA)
                    got = json.loads(got) if isinstance(got, str) else got
                    texts.append(got.get("rewritten") or "")
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(str(e)[:400] or type(e).__name__)
            yield pd.DataFrame({key: f[key], "rewritten": texts, "error": errors})

    asked = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInPandas(call, f"`{key}` {kind}, rewritten string, error string")
    applied = F.array(*(F.lit(r) for r, _ in hints)) if hints else F.lit(None).cast("array<string>")
    return asked.select(key, trim(F.col("rewritten")).alias("rewritten"), "error", applied.alias("applied_rules"))
