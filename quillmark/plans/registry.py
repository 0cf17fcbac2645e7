"""All queries of the engine, with their DuckDB counterparts."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import patterns as P
from quillmark.functions.catalogue import CATEGORIES, HIGH_SIGNAL, REWRITE_DEFAULTS, RULES, rules, values_sql
from quillmark.functions.spans import count_overlapping, overlaps, paragraphs, restore, sentences
from quillmark.operators import judge as J
from quillmark.operators.detectors import deduplicated, detect, openers, prepared
from quillmark.operators.masking import LANGUAGES, lang_column, mask
from quillmark.operators.report import check, corpus_counts, exploded, report_json
from quillmark.operators.table_functions import register
from quillmark.plans import oracle as O
from quillmark.plans import raw_masks
from quillmark.plans.seeds import CARRIERS, seeded, seeded_sql
from quillmark.sources.files import shared_folder


def _docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(_docs(spark, sf_dir).select("doc_id", "text", "lang", "source"))


def _rows(df: DataFrame) -> DataFrame:
    return exploded(df).select("doc_id", "start_index", "end_index", "matched_text", "explanation")


def _flat(column: str):
    """A count map as text: key=value, by key."""
    e = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(e, lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias(column)


def _rule_query(rule: str):
    return lambda spark, sf: _rows(detect(_seeded(spark, sf).select("doc_id", "text"), rules=[rule]))


def _report(spark, sf):
    r = check(_seeded(spark, sf).select("doc_id", "text"))
    return r.select("doc_id", "text_length", F.size("violations").alias("n_violations"), _flat("counts_by_rule"), _flat("counts_by_category"))


_ALL = O.everything()
_CATS = values_sql("id", "category")
_REPORT_SQL = O.over(
    f"""SELECT s.doc_id, strlen(s.text)::int AS text_length, coalesce(n, 0)::int AS n_violations, coalesce(r.counts_by_rule, '') AS counts_by_rule, coalesce(c.counts_by_category, '') AS counts_by_category
FROM src s LEFT JOIN (SELECT doc_id, sum(n) AS n, string_agg(rule_id || '=' || n, ',' ORDER BY rule_id) AS counts_by_rule FROM (SELECT doc_id, rule_id, count(*) AS n FROM found GROUP BY 1, 2) GROUP BY 1) r USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(category || '=' || n, ',' ORDER BY category) AS counts_by_category FROM (SELECT doc_id, category, count(*) AS n FROM found JOIN {_CATS} ON id = rule_id GROUP BY 1, 2) GROUP BY 1) c USING (doc_id)"""
).replace("WITH src AS (", "WITH src AS MATERIALIZED (", 1).replace(") SELECT s.doc_id", f"), found AS MATERIALIZED ({_ALL}) SELECT s.doc_id", 1)


def _found(select: str, src: str | None = None) -> str:
    src = src or f"SELECT doc_id, text FROM ({seeded_sql()})"
    return f"WITH src AS MATERIALIZED ({src}), found AS MATERIALIZED ({_ALL}) {select}"


def _grouped(spark, df: DataFrame, group: str) -> DataFrame:
    return corpus_counts(detect(df), group)


def _grouped_sql(table: str, group: str) -> str:
    return f"""WITH t AS MATERIALIZED ({table}), src AS MATERIALIZED (SELECT doc_id, text FROM t), found AS MATERIALIZED ({_ALL}),
d AS (SELECT t.doc_id, {group} AS grp, strlen(t.text) AS bytes, (SELECT count(*) FROM found WHERE found.doc_id = t.doc_id) AS n FROM t)
SELECT grp AS {group}, count(*) AS n_docs, sum(n)::bigint AS n_violations, sum(bytes)::bigint AS n_bytes, round(1000.0 * sum(n) / greatest(sum(bytes), 1), 6)::double AS per_1000_bytes FROM d GROUP BY grp"""


_TURNS = "SELECT conv_id * 1000 + turn AS doc_id, role, text FROM conversations"
_LABELLED = f"SELECT doc_id, quality, text FROM ({seeded_sql()}) JOIN labels USING (doc_id)"


def _labelled(spark, sf):
    known = _docs(spark, sf, "labels").select("doc_id", "quality")
    return _seeded(spark, sf).select("doc_id", "text").join(known, "doc_id").select("doc_id", "quality", "text")


def _rule_rows(df: DataFrame) -> DataFrame:
    return df.select("ord", "id", "category", "can_remove", "requires_llm", "llm_tier", "color", "bg_color", "name", "tip")


def _rules_sql(where: str = "") -> str:
    return f"SELECT * FROM {values_sql('ord', 'id', 'category', 'can_remove', 'requires_llm', 'llm_tier', 'color', 'bg_color', 'name', 'tip')} {where}"


# ---------------------------------------------------------------- small inputs

_PATHS = ["a.md", "b.MARKDOWN", "c.mdx", "d.html", "e.HTM", "f.js", "g.mjs", "h.cjs", "i.jsx", "j.ts", "k.mts", "l.cts", "m.tsx", "n.txt", "noext", "dir.md/plain", "x.tar.html"]
_EFFORTS = [(None, None, None, False), (None, None, None, True), (None, True, None, False), (None, False, None, True), (None, None, True, False), (None, None, False, True), (None, True, False, True), ("off", True, True, True), ("LOW", None, True, True), ("high", None, None, False), ("auto", True, None, True), ("auto", None, None, False), ("", None, None, True)]
_ANSWERS = [("hedge-stack", "the", "common", "a"), ("throat-clearing", "THE", "case", "remove all of this now"), ("", "the", "no rule", ""), ("dead-metaphor", "no such words anywhere", "lost", ""), ("balanced-take", "", "no match", ""), ("hedge-stack", "the", "again", "b"), ("pivot-paragraph", "of", "short", "omit"), ("sycophantic-frame", "is", "other", "plain words")]


def _sql_values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else O.lit(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


def _resolve_lang(spark, sf):
    return spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", lang_column(F.col("path")).alias("lang"))


def _lang_sql() -> str:
    cases = " ".join(f"WHEN ext = '{e}' THEN '{n}'" for e, n in sorted(LANGUAGES.by_extension.items()))
    return f"SELECT path, CASE {cases} ELSE 'text' END AS lang FROM (SELECT path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM {_sql_values([(p,) for p in _PATHS], 'path')})"


def _effort(spark, sf):
    rows = [(i, *J.resolve_effort(*e)) for i, e in enumerate(_EFFORTS)]
    return spark.createDataFrame(rows, "id int, effort string, auto boolean")


def _effort_sql() -> str:
    default = "CASE WHEN plugin THEN 'high' ELSE 'off' END"
    return f"""SELECT id::int AS id, CASE WHEN flag IN ('', 'auto') OR (flag IS NULL AND deep IS NULL AND llm IS NULL) THEN {default} WHEN flag IS NOT NULL THEN flag
WHEN deep IS NOT NULL THEN CASE WHEN deep THEN 'high' ELSE 'off' END ELSE CASE WHEN llm THEN 'low' ELSE 'off' END END AS effort,
coalesce(flag IN ('', 'auto'), deep IS NULL AND llm IS NULL) AS auto FROM (SELECT id, lower(f) AS flag, llm, deep, plugin FROM {_sql_values([(i, *e) for i, e in enumerate(_EFFORTS)], 'id, f, llm, deep, plugin')})"""


def _overlap(kind: str):
    """Sentences of every document against its paragraphs, every second of them as a range of the kind looked for."""

    def run(spark, sf):
        d = prepared(_seeded(spark, sf).select("doc_id", "text"))
        ranges = F.transform("_paras", lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.when(i % 2 == 0, "heading").otherwise("list-item").alias("kind")))
        at = lambda name: F.transform("_sents", lambda s: s[name])
        of = (overlaps, "heading") if kind == "any" else (count_overlapping, "list-item")
        found = d.select("doc_id", "_sents", of[0](at("start"), at("end"), ranges, of[1]).alias("found"))
        rows = found.select("doc_id", F.posexplode(F.arrays_zip("_sents", "found")).alias("pos", "z"))
        return rows.select("doc_id", "pos", F.col("z._sents.start").alias("s"), F.col("z._sents.end").alias("e"), F.col("z.found").alias("found"))

    return run


def _overlap_sql(kind: str) -> str:
    odd, out = (0, "count(r.a) > 0") if kind == "any" else (1, "count(r.a)::int")
    numbered = lambda of: f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS i, a, b FROM ({of})"
    return O.over(f"""SELECT v.doc_id, v.i::int AS pos, v.a AS s, v.b AS e, {out} AS found FROM ({numbered(O.SENTS)}) v
LEFT JOIN ({numbered(O.PARAS)}) r ON r.doc_id = v.doc_id AND r.i % 2 = {odd} AND r.a < v.b AND r.b > v.a GROUP BY v.doc_id, v.i, v.a, v.b""")


def _restore(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.col("text").cast("binary").alias("raw"), "text")
    start, end = F.lit(0), F.octet_length(F.substring("text", 1, 9)).cast("int")
    # to the text's end for even ids, one byte beyond it for all others
    last = F.octet_length("text") + F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1)
    got = lambda a, b: restore(F.col("raw"), a, b, F.lit("?"))
    return d.select("doc_id", got(start, end).alias("inside"), got(F.lit(5), last).alias("beyond"))


def _chunks(spark, sf):
    d = _seeded(spark, sf).select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return J.chunked(d).select("doc_id", "chunk_id", F.octet_length("chunk").alias("bytes"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


def _chunk_tables(src: str) -> str:
    """src(doc_id, text) and f, whose ``done`` are the chunks of the long texts."""
    return f"""RECURSIVE src AS MATERIALIZED (SELECT doc_id, text FROM ({src})),
p AS MATERIALIZED (SELECT doc_id, string_split_regex(text, '\\n\\n+') AS ps FROM src WHERE strlen(text) > {J.CHUNK_ABOVE}),
f AS (SELECT doc_id, 0 AS i, ''::varchar AS now, 0 AS size, 0 AS chunk_id, NULL::varchar AS done, NULL::int AS done_id FROM p
UNION ALL SELECT doc_id, i + 1,
 CASE WHEN shut THEN para ELSE joined END, CASE WHEN shut THEN strlen(para) + 2 ELSE grown END, chunk_id + shut::int, CASE WHEN shut OR i + 1 = n THEN joined END, chunk_id
 FROM (SELECT *, (grown >= {J.CHUNK_SIZE} AND i + 1 < n) AS shut FROM (SELECT f.doc_id, f.i, f.chunk_id, ps[i + 1] AS para, len(ps) AS n,
   CASE WHEN f.i = 0 THEN ps[i + 1] ELSE now || chr(10) || chr(10) || ps[i + 1] END AS joined, (size + strlen(ps[i + 1]) + 2)::int AS grown FROM f JOIN p USING (doc_id) WHERE i < len(ps))))"""


_CHUNK_SQL = f"""WITH {_chunk_tables(f"SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM ({seeded_sql()})")}
SELECT doc_id, done_id AS chunk_id, strlen(done)::int AS bytes, md5(done) AS digest FROM f WHERE done IS NOT NULL
UNION ALL SELECT doc_id, 0, strlen(text)::int, md5(text) FROM src WHERE strlen(text) <= {J.CHUNK_ABOVE}"""


def _answers():
    return F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(a, ("ruleId", "matchedText", "explanation", "suggestedChange"), strict=True))) for a in _ANSWERS))


def _located(spark, sf):
    d = _seeded(spark, sf).select("doc_id", "text")
    return exploded(d.select("doc_id", J.located(F.col("text"), _answers()).alias("violations"))).select("doc_id", "rule_id", "start_index", "end_index", "matched_text", "explanation", "suggested_change")


_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_LOCATED_SQL = f"""WITH src AS (SELECT doc_id, text, translate(text, {_UP}, {_LOW}) AS plain FROM ({seeded_sql()})),
p AS (SELECT doc_id, text, v.*, CASE WHEN instr(text, m) > 0 THEN instr(text, m) ELSE instr(plain, translate(m, {_UP}, {_LOW})) END AS spot FROM src, {_sql_values(_ANSWERS, 'r, m, x, g')} WHERE r <> '' AND m <> '')
SELECT doc_id, r AS rule_id, strlen(substr(text, 1, spot - 1))::int AS start_index, (strlen(substr(text, 1, spot - 1)) + strlen(substr(text, spot, length(m))))::int AS end_index, substr(text, spot, length(m)) AS matched_text,
x AS explanation, CASE WHEN regexp_matches(trim(g), {O.lit(P.INSTRUCTION)}) AND strlen(g) > floor(1.5 * strlen(m)) THEN '' ELSE g END AS suggested_change FROM p WHERE spot > 0"""


def _first_by_match(spark, sf):
    d = _seeded(spark, sf).select("doc_id", "text")
    found = J.first_by_match(J.located(F.col("text"), _answers()))
    return exploded(d.select("doc_id", found.alias("violations"))).select("doc_id", "rule_id", "matched_text", "explanation")


_FIRST_SQL = f"""SELECT doc_id, rule_id, matched_text, explanation FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id, matched_text ORDER BY n) AS q FROM (
SELECT doc_id, r AS rule_id, substr(text, spot, length(m)) AS matched_text, x AS explanation, n FROM (SELECT doc_id, text, r, m, x, n, CASE WHEN instr(text, m) > 0 THEN instr(text, m) ELSE instr(translate(text, {_UP}, {_LOW}), translate(m, {_UP}, {_LOW})) END AS spot
FROM ({seeded_sql()}), {_sql_values([(i, *a[:3]) for i, a in enumerate(_ANSWERS)], 'n, r, m, x')} WHERE r <> '' AND m <> '') WHERE spot > 0)) WHERE q = 1"""


def _fixed_judge(system, prompt, schema):
    """Stands in for a model: finds the first word, fails on texts about rivers, rewrites backwards."""
    if "rewritten" in schema["properties"]:
        return {"rewritten": f"  {prompt[::-1]}\n"}
    passage = prompt.split("Text to analyze:\n\n", 1)[1]
    if "the river rose" in passage:
        raise RuntimeError("no answer")
    word = passage.split(" ")[0] if passage else ""
    return json.dumps({"violations": [{"ruleId": "throat-clearing", "matchedText": word, "explanation": "first word", "suggestedChange": ""}]})


def _status(tier: str):
    def run(spark, sf):
        d = _seeded(spark, sf).select("doc_id", "text")
        return J.judged(d, _fixed_judge, tier).select("doc_id", F.size("found").alias("n_found"), F.col("error").isNull().alias("ran"))

    return run


def _fail_open(spark, sf):
    """Both tiers, chosen automatically: a failed one is recorded and adds nothing."""
    d = J.with_model(_seeded(spark, sf).select("doc_id", "text"), _fixed_judge, "high", True)
    return d.select("doc_id", F.size("extra").alias("n_found"), F.col("llm.sentence.ran").alias("sentence_ran"), F.col("llm.document.ran").alias("document_ran"))


def _fail_closed(spark, sf):
    """A tier that was asked for and fails raises: by tier, whether it did, over all documents and over those that don't fail."""
    d = _seeded(spark, sf).select("doc_id", "text")

    def raises(docs, effort):
        try:
            J.with_model(docs, _fixed_judge, effort, False)
        except J.JudgeError:
            return True
        return False

    calm = d.where(~F.col("text").contains("the river rose"))
    return spark.createDataFrame([(e, raises(d, e), raises(calm, e)) for e in ("off", "low")], "effort string, all_docs boolean, calm_docs boolean")


#: What the fixed judge finds: the first word of each chunk that isn't about rivers.
_STATUS_SQL = f"""WITH {_chunk_tables(seeded_sql())}, c AS (SELECT doc_id, done AS chunk FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, text FROM src WHERE strlen(text) <= {J.CHUNK_ABOVE})"""
_STATUS_COLUMNS = """count(DISTINCT CASE WHEN NOT contains(chunk, 'the river rose') AND string_split(chunk, ' ')[1] <> '' THEN string_split(chunk, ' ')[1] END)::int AS n_found, bool_or(NOT contains(chunk, 'the river rose')) AS ran"""


def _rewrite(spark, sf):
    d = _seeded(spark, sf).select("doc_id", "text")
    return J.rewritten(d, _fixed_judge, ["hedge-stack", "em-dash-pivot"]).select("doc_id", F.octet_length("rewritten").alias("bytes"), F.array_join("applied_rules", ",").alias("applied"))


def _prompts(spark, sf):
    rows = [("sentence", J.rule_prompt("sentence")), ("document", J.rule_prompt("document")), ("rewrite", J.rewrite_prompt([h for _, h in J.rewrite_hints(["hedge-stack"])]))]
    return spark.createDataFrame(rows, "name string, prompt string")


def _prompt_rules(spark, sf):
    return rules(spark).where("llm_tier is not null").select("llm_tier", "id", "llm_detection_hint", "ord")


def _hints(spark, sf):
    return spark.createDataFrame([(i, *h) for i, h in enumerate(J.rewrite_hints([" hedge-stack", "", "almost-hedge", "hedge-stack "]))], "pos int, id string, rewrite_hint string")


#: Source around each whole seeded text, by hand: pieces of prose (kept) and of markup or code (blanked), the expected ranges
#: (n in all; those that suppression looks at: kind, first and last byte from the frame's or, after the text, from the text's end).
_FRAMES = {
    "markdown": {
        "before": [("---\ntitle: x\n---\n", 0), ("# Very crucial ", 1), ("`code`", 0), ("\n\n", 1)],
        "after": [
            ("\n\n- First item here. Two words. All short.\n- Next one. And more. So short.\n\nSee [the link]", 1), ("(http://a.b/c(d) \"robust\")", 0), (" and ", 1), ("`vital`", 0), (".\n\n", 1),
            ("```\ncrucial code\n```\n\n    robust code\n\n<div>vital</div>\n", 0),
        ],
        "n": 5, "ranges": [("heading", 17, 39, False), ("list-item", 2, 43, True), ("list-item", 43, 75, True)],
    },
    "html": {
        "before": [
            ("<!doctype html>\n<html><head><title>Very crucial page</title><script>let crucial = 1;</script></head>\n<body><!-- vital --><h1 class=\"robust\">", 0), ("Really? Yes!", 1), ("</h1>\n<p>\n\n", 0),
        ],
        "after": [
            ("\n\n</p><ul><li>", 0), ("First item here. Two words. All short.", 1), ("</li>\n<li>", 0), ("Next one. And more. So short.", 1), ("</li></ul><pre>robust</pre> <code>vital</code>\n<p title='crucial'>", 0),
            ("The end &amp; more.", 1), ("</p></body></html>\n", 0),
        ],
        "n": 7, "ranges": [("heading", 140, 152, False), ("list-item", 14, 52, True), ("list-item", 62, 91, True)],
    },
    "js": {
        "before": [("// A note.\n\n/** Doc line. */\n", 1), ("const a = '", 0), ("It is crucial.", 1), ("'; const b = /vital/; const c = `", 0), ("robust ", 1), ("${vital}", 0), (" end", 1), ("`;\n", 0)],
        "after": [("\nlet d = crucial;\n", 0)], "n": 6, "ranges": [("jsdoc", 12, 28, False)],
    },
    "jsx": {
        "before": [("/** Doc. */", 1), (" export const A = () => <p title=\"", 0), ("robust", 1), ("\">", 0), ("It is vital. ", 1), ("{crucial}</p>;\n", 0)],
        "after": [("\n", 0)], "n": 4, "ranges": [("jsdoc", 0, 11, False)],
    },
    "ts": {"before": [("const x: Array<string> = ['", 0), ("crucial", 1), ("'];\n", 0)], "after": [], "n": 2, "ranges": []},
    "tsx": {"before": [("const f = <T,>(x: T) => x; const y = <b>", 0), ("robust", 1), ("</b>;\n", 0)], "after": [], "n": 2, "ranges": []},
}


MARKUP = ("markdown", "html")


def _frame(kind: str, side: str, blank: bool = False) -> str:
    return "".join(re.sub(r"[^\n]", " ", t) if blank and not kept else t for t, kept in _FRAMES[kind][side])


def _marked_text(kind: str):
    """Every whole seeded text inside a frame: as a comment (of documentation, for odd ids), or as plain paragraphs of Markdown or HTML."""

    def docs(spark, sf):
        d = _seeded(spark, sf).select("doc_id", "text")
        if kind in MARKUP:
            text = F.ltrim(F.regexp_replace(F.regexp_replace("text", r"[^\p{L} .,;:?!\n]", ""), "\n +", "\n"))
        else:
            text = F.concat(F.when(F.col("doc_id") % 2 == 1, "/** ").otherwise("/* "), F.regexp_replace("text", r"\*/", "* /"), F.lit(" */"))
        return d.select("doc_id", F.concat(F.lit(_frame(kind, "before")), text, F.lit(_frame(kind, "after"))).alias("text"), F.lit(kind).alias("lang"))

    return docs


def _marked(kind: str):
    return lambda spark, sf: mask(_marked_text(kind)(spark, sf))


def _framed_sql(kind: str) -> str:
    """raw(doc_id, t), src (masked) and orig (as it is), the masks as they are marked in _FRAMES."""
    nl = lambda x: " || chr(10) || ".join(O.lit(part) for part in x.split("\n"))
    if kind in MARKUP:
        t = r"ltrim(regexp_replace(regexp_replace(text, '[^\p{L} .,;:?!\n]', '', 'g'), '\n +', chr(10), 'g'))"
    else:
        t = "CASE WHEN doc_id % 2 = 1 THEN '/** ' ELSE '/* ' END || replace(text, '*/', '* /') || ' */'"
    side = lambda blank: f"{nl(_frame(kind, 'before', blank))} || t || {nl(_frame(kind, 'after', blank))}"
    return f"raw AS MATERIALIZED (SELECT doc_id, {t} AS t FROM ({seeded_sql()})), src AS MATERIALIZED (SELECT doc_id, {side(True)} AS text FROM raw), orig AS (SELECT doc_id, {side(False)} AS text, strlen(t) AS n FROM raw)"


def _mask_query(kind: str):
    return lambda spark, sf: _marked(kind)(spark, sf).select("doc_id", F.md5(F.col("masked").cast("binary")).alias("masked"), F.size("ranges").alias("n_ranges"))


def _mask_sql(kind: str) -> str:
    return f"WITH {_framed_sql(kind)} SELECT doc_id, md5(text) AS masked, {_FRAMES[kind]['n']}::int AS n_ranges FROM src"


def _suppress_query(kind: str):
    return lambda spark, sf: _rows_rule(check(_marked(kind)(spark, sf), lang="lang", masked="masked"))


def _suppress_sql(kind: str) -> str:
    at = len(_frame(kind, "before"))
    places = [(k, f"{a} + n + {at}" if after else str(a), f"{b} + n + {at}" if after else str(b), "true") for k, a, b, after in _FRAMES[kind]["ranges"]]
    if kind not in MARKUP:
        places.append(("jsdoc", str(at), f"{at} + n", "doc_id % 2 = 1"))
    meets = lambda k: " + ".join(f"(({a}) < end_index AND ({b}) > start_index AND {when})::int" for x, a, b, when in places if x == k)
    if kind in MARKUP:
        drop = f"(rule_id = 'dramatic-fragment' AND {meets('heading')} > 0) OR (rule_id = 'staccato-burst' AND {meets('list-item')} >= 2)"
    else:
        drop = f"rule_id = 'dramatic-fragment' AND {meets('jsdoc')} > 0"
    return f"""WITH {_framed_sql(kind)}, found AS MATERIALIZED ({_ALL})
SELECT doc_id, rule_id, start_index, end_index, decode(encode(orig.text)[start_index + 1:end_index]) AS matched_text FROM found JOIN orig USING (doc_id) WHERE NOT ({drop})"""


def _rows_rule(df: DataFrame) -> DataFrame:
    return exploded(df).select("doc_id", "rule_id", "start_index", "end_index", "matched_text")


def _lateral(spark, sf):
    """Headings and list items of every framed document, by SQL alone."""
    register(spark, "quillmark_")
    _marked_text("markdown")(spark, sf).createOrReplaceTempView("quillmark_framed")
    return spark.sql("""SELECT f.doc_id, r.kind, r.start_index, r.end_index, md5(r.content) AS digest
FROM quillmark_framed f, LATERAL quillmark_mask_ranges(f.text, 'markdown') r WHERE r.kind <> 'code-block'""")


def _lateral_sql() -> str:
    at = len(_frame("markdown", "before"))
    rows = [f"({O.lit(k)}, {f'{a} + n + {at}' if after else a}, {f'{b} + n + {at}' if after else b})" for k, a, b, after in _FRAMES["markdown"]["ranges"]]
    each = " UNION ALL ".join(f"SELECT doc_id, text, v.* FROM orig, LATERAL (SELECT * FROM (VALUES {r}) AS v(kind, a, b)) v" for r in rows)
    return f"WITH {_framed_sql('markdown')} SELECT doc_id, kind, a::int AS start_index, b::int AS end_index, md5(decode(encode(text)[a + 1:b])) AS digest FROM ({each})"


def _lateral_pages(spark, sf):
    """Pages by SQL alone: bytes of prose that stay, and ranges."""
    register(spark, "quillmark_")
    _docs(spark, sf, "pages").createOrReplaceTempView("quillmark_pages")
    return spark.sql("""SELECT p.page_id, octet_length(p.html) AS n_bytes, octet_length(m.masked) AS masked_bytes, m.n_ranges,
octet_length(regexp_replace(m.masked, '[ \\n]+', '')) AS prose_bytes FROM quillmark_pages p, LATERAL quillmark_mask(p.html, 'html') m""")


_EXTENSIONS = [(".md", "markdown"), (".HTML", "html"), (".js", "js"), (".tsx", "tsx"), (".txt", "text"), ("", "text")]


def _files(spark, sf):
    """Every document written to a file of its own, every seventh with a byte that is no UTF-8, and the folder read back."""
    from quillmark.sources import prose

    prose.register(spark)
    folder = f"{shared_folder(spark)}/prose-{uuid.uuid4().hex[:12]}"
    d = _docs(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    ext = F.element_at(F.array(*(F.lit(e) for e, _ in _EXTENSIONS)), (F.pmod("doc_id", F.lit(len(_EXTENSIONS))) + 1).cast("int"))
    name = F.concat((F.col("doc_id") % 10).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), ext)
    content = F.when(F.col("doc_id") % 7 == 0, F.concat("b", F.lit(b"\xff"))).otherwise(F.col("b"))
    d.select(name.alias("path"), content.alias("content")).write.format("prose").mode("append").save(folder)
    back = spark.read.format("prose").load(folder)
    return back.select(F.regexp_extract("path", r"(\d+)(\.\w+)?$", 1).cast("long").alias("doc_id"), "lang", F.md5(F.col("text").cast("binary")).alias("digest"))


_FILES_SQL = f"""SELECT doc_id, ([{', '.join(O.lit(name) for _, name in _EXTENSIONS)}])[(doc_id % {len(_EXTENSIONS)})::int + 1] AS lang,
md5(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN chr(65533) ELSE '' END) AS digest FROM documents"""


def _pages(spark, sf):
    p = _docs(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.lit("html").alias("lang"))
    return mask(p)


def _paragraphs(spark, sf):
    d = _seeded(spark, sf).select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("pos", "p"))
    return d.select("doc_id", "pos", F.col("p.start").alias("start_index"), F.octet_length("p.text").alias("bytes"))


def _sentences(spark, sf):
    d = _seeded(spark, sf).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "p"))
    return d.select("doc_id", "pos", F.col("p.start").alias("start_index"), F.octet_length("p.text").alias("bytes"))


def _openers(spark, sf):
    d = prepared(_seeded(spark, sf).select("doc_id", "text")).select("doc_id", F.posexplode(openers()).alias("pos", "o"))
    return d.select("doc_id", "pos", F.col("o.two").alias("two"), F.col("o.one").alias("one"))


def _dedup(spark, sf):
    """Every violation twice, the copy with another explanation: the first stays."""
    d = detect(_seeded(spark, sf).select("doc_id", "text"), rules=["overused-intensifiers", "hedge-stack"])
    twice = d.withColumn("violations", F.concat("violations", F.transform("violations", lambda v: v.withField("explanation", F.lit("copy")))))
    return exploded(deduplicated(twice)).select("doc_id", "rule_id", "start_index", "end_index", "matched_text", "explanation")


def queries() -> dict:
    q = {f"rule_{r.replace('-', '_')}": _rule_query(r) for r in P.ORDER}
    q |= {
        "split_paragraphs": _paragraphs,
        "split_sentences": _sentences,
        "anaphora_openers": _openers,
        "run_client": lambda s, d: exploded(detect(_seeded(s, d).select("doc_id", "text"))).select("doc_id", "rule_id", "start_index", "end_index", "matched_text", "explanation"),
        "dedup": _dedup,
        "sort_violations": lambda s, d: exploded(check(_seeded(s, d).select("doc_id", "text"))).select("doc_id", "pos", "rule_id", "start_index", "end_index"),
        "check_report": _report,
        "counts_by_rule": lambda s, d: exploded(detect(_seeded(s, d).select("doc_id", "text"))).groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")),
        "counts_by_category": lambda s, d: exploded(detect(_seeded(s, d).select("doc_id", "text"))).join(F.broadcast(rules(s).select(F.col("id").alias("rule_id"), "category")), "rule_id").groupBy("category").agg(F.count("*").alias("n")),
        "report_json": lambda s, d: report_json(check(_docs(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))).select(F.md5(F.col("value").cast("binary")).alias("digest")),
        "corpus_by_source": lambda s, d: _grouped(s, _seeded(s, d), "source"),
        "corpus_by_lang": lambda s, d: _grouped(s, _seeded(s, d), "lang"),
        "turns_by_role": lambda s, d: _grouped(s, _docs(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "role", "text"), "role"),
        "density_by_quality": lambda s, d: _grouped(s, _labelled(s, d), "quality"),
        "rules_all": lambda s, d: _rule_rows(rules(s)),
        "rules_by_category": lambda s, d: _rule_rows(rules(s, category="framing")),
        "rules_llm_only": lambda s, d: _rule_rows(rules(s, llm_only=True)),
        "rules_high_signal": lambda s, d: s.createDataFrame([(i, r) for i, r in enumerate(HIGH_SIGNAL)], "pos int, id string"),
        "prompt_rules": _prompt_rules,
        "prompts": _prompts,
        "rewrite_hints": _hints,
        "rewrite_defaults": lambda s, d: s.createDataFrame([(i, r) for i, r in enumerate(REWRITE_DEFAULTS)], "pos int, id string"),
        "resolve_lang": _resolve_lang,
        "resolve_effort": _effort,
        "overlaps": _overlap("any"),
        "count_overlapping": _overlap("count"),
        "restore_matched_text": _restore,
        "mask_pages": lambda s, d: _pages(s, d).select("doc_id", F.md5(F.col("masked").cast("binary")).alias("masked"), F.size("ranges").alias("n_ranges")),
        "html_violations": lambda s, d: _rows_rule(check(_pages(s, d).drop("lang").withColumn("lang", F.lit("text")), lang="lang", masked="masked")),
        "suppress_pages": lambda s, d: _rows_rule(check(_pages(s, d), lang="lang", masked="masked")),
        "read_files": _files,
        "mask_lateral": _lateral,
        "mask_lateral_pages": _lateral_pages,
        "chunk_text": _chunks,
        "resolve_llm_matches": _located,
        "dedupe_rule_match": _first_by_match,
        "llm_status": _status("sentence"),
        "llm_document": _status("document"),
        "llm_fail_open": _fail_open,
        "llm_fail_closed": _fail_closed,
        "rewrite": _rewrite,
    }
    for kind in _FRAMES:
        q[f"mask_{kind}"] = _mask_query(kind)
        q[f"suppress_{kind}"] = _suppress_query(kind)
    return q | raw_masks.QUERIES


def oracle_sql() -> dict[str, str]:
    o = {f"rule_{r.replace('-', '_')}": O.over(O.rule(r)) for r in P.ORDER}
    o["rule_anaphora_abuse"] = O.over("SELECT * FROM (" + O.rule("anaphora-abuse") + ")")
    o |= {
        "split_paragraphs": O.over(f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::int AS pos, a AS start_index, (b - a)::int AS bytes FROM ({O.PARAS})"),
        "split_sentences": O.over(f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::int AS pos, a AS start_index, (b - a)::int AS bytes FROM ({O.SENTS})"),
        "anaphora_openers": O.over(f"SELECT doc_id, i::int AS pos, two, one FROM ({O.openers()})"),
        "run_client": _found("SELECT * FROM found"),
        "dedup": _found("SELECT * FROM found WHERE rule_id IN ('overused-intensifiers', 'hedge-stack')"),
        "sort_violations": _found("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_index, end_index, rule_id) - 1)::int AS pos, rule_id, start_index, end_index FROM found"),
        "check_report": _REPORT_SQL,
        "counts_by_rule": _found("SELECT rule_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY rule_id"),
        "counts_by_category": _found(f"SELECT category, count(*) AS n FROM found JOIN {_CATS} ON id = rule_id GROUP BY category"),
        "corpus_by_source": _grouped_sql(seeded_sql(), "source"),
        "corpus_by_lang": _grouped_sql(seeded_sql(), "lang"),
        "turns_by_role": _grouped_sql(_TURNS, "role"),
        "density_by_quality": _grouped_sql(_LABELLED, "quality"),
        "rules_all": _rules_sql(),
        "rules_by_category": _rules_sql("WHERE category = 'framing'"),
        "rules_llm_only": _rules_sql("WHERE requires_llm"),
        "rules_high_signal": f"SELECT pos::int AS pos, id FROM {_sql_values([(i, r) for i, r in enumerate(HIGH_SIGNAL)], 'pos, id')}",
        "prompt_rules": f"SELECT * FROM {values_sql('llm_tier', 'id', 'llm_detection_hint', 'ord')} WHERE llm_tier IS NOT NULL",
        "rewrite_hints": f"SELECT pos::int AS pos, id, rewrite_hint FROM {_sql_values([(0, 'hedge-stack'), (1, 'almost-hedge'), (2, 'hedge-stack')], 'pos, rid')} JOIN {values_sql('id', 'rewrite_hint')} ON id = rid",
        "rewrite_defaults": f"SELECT pos::int AS pos, id FROM {_sql_values([(i, r) for i, r in enumerate(REWRITE_DEFAULTS)], 'pos, id')}",
        "resolve_lang": _lang_sql(),
        "resolve_effort": _effort_sql(),
        "overlaps": _overlap_sql("any"),
        "count_overlapping": _overlap_sql("count"),
        "restore_matched_text": """SELECT doc_id, substr(text, 1, 9) AS inside, CASE WHEN doc_id % 2 = 0 AND strlen(text) >= 5 AND NOT hex(encode(text)[6:6]) BETWEEN '80' AND 'BF' THEN decode(encode(text)[6:]) ELSE '?' END AS beyond FROM documents""",
        "read_files": _FILES_SQL,
        "mask_lateral": _lateral_sql(),
        "chunk_text": _CHUNK_SQL,
        "resolve_llm_matches": _LOCATED_SQL,
        "dedupe_rule_match": _FIRST_SQL,
        "llm_status": f"{_STATUS_SQL} SELECT doc_id, {_STATUS_COLUMNS} FROM c GROUP BY doc_id",
        "llm_document": f"SELECT doc_id, {_STATUS_COLUMNS} FROM (SELECT doc_id, text AS chunk FROM ({seeded_sql()})) GROUP BY doc_id",
        "llm_fail_open": f"""{_STATUS_SQL}, a AS (SELECT doc_id, {_STATUS_COLUMNS} FROM c GROUP BY doc_id), b AS (SELECT doc_id, {_STATUS_COLUMNS} FROM (SELECT doc_id, text AS chunk FROM src) GROUP BY doc_id)
SELECT doc_id, (a.n_found + b.n_found)::int AS n_found, a.ran AS sentence_ran, b.ran AS document_ran FROM a JOIN b USING (doc_id)""",
        "llm_fail_closed": f"SELECT e AS effort, e = 'low' AND (SELECT bool_or(contains(text, 'the river rose') AND strlen(text) <= {J.CHUNK_ABOVE}) FROM ({seeded_sql()})) AS all_docs, false AS calm_docs FROM (VALUES ('off'), ('low')) v(e)",
        "rewrite": f"SELECT doc_id, strlen({O._trim('text')})::int AS bytes, 'hedge-stack,em-dash-pivot' AS applied FROM ({seeded_sql()})",
    }
    for kind in _FRAMES:
        o[f"mask_{kind}"] = _mask_sql(kind)
        o[f"suppress_{kind}"] = _suppress_sql(kind)
    return o | raw_masks.SQL


assert len(RULES) == 48 and len(CATEGORIES) == 5
