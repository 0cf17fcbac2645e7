"""The detectors in DuckDB SQL, written independently of the column expressions.

Each builder gives a query with doc_id, start_index, end_index, matched_text and
explanation over a relation ``src(doc_id, text)``.
"""

from __future__ import annotations

from quillmark.functions import patterns as P
from quillmark.plans.seeds import seeded_sql

_SP = P.SPACES.replace(r"\x{0B}", r"\v")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(pattern: str, src: str = "src", text: str = "text", base: str = "0", more: str = "") -> str:
    p = lit(pattern)
    return f"""SELECT doc_id{more}, ({base} + strlen(array_to_string(gs[1:i], '') || array_to_string(ms[1:i - 1], '')))::int AS start_index,
  ({base} + strlen(array_to_string(gs[1:i], '') || array_to_string(ms[1:i], '')))::int AS end_index, ms[i] AS matched_text
  FROM (SELECT *, regexp_extract_all({text}, {p}) AS ms, string_split_regex({text}, {p}) AS gs FROM {src} WHERE regexp_matches({text}, {p})),
  LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i)"""


def _plain(pattern: str) -> str:
    return f"SELECT *, NULL::varchar AS explanation FROM ({_spans(pattern)})"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SP}]+|[{_SP}]+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{_SP}]+'), lambda w: w <> '')"


def _pieces(pattern: str, keep: bool, src: str, base: str = "0", more: str = "") -> str:
    """doc_id, pos, s (the piece), a and b (its byte offsets); blank pieces dropped."""
    p = lit(pattern)
    body = "gs[i] || coalesce(ms[i], '')" if keep else "gs[i]"
    return f"""SELECT doc_id{more}, i AS pos, {body} AS s, ({base} + strlen(array_to_string(gs[1:i - 1], '') || array_to_string(ms[1:i - 1], '')))::int AS a,
  ({base} + strlen(array_to_string(gs[1:i - 1], '') || array_to_string(ms[1:i - 1], '')) + strlen({body}))::int AS b
  FROM (SELECT *, string_split_regex(text, {p}) AS gs, regexp_extract_all(text, {p}) AS ms FROM {src}), LATERAL (SELECT unnest(range(1, len(gs) + 1)) AS i)
  WHERE regexp_matches({body}, '[^{_SP}]')"""


SENTS = _pieces(P.SENTENCE_END, True, "src")
PARAS = _pieces(P.PARAGRAPH_END, False, "src")
PSENTS = _pieces(P.SENTENCE_END, True, f"(SELECT doc_id, pos AS para, a AS at0, s AS text FROM ({PARAS}))", "at0", ", para")
_CUT = "(SELECT decode(encode(text)[x.start_index + 1:x.end_index]) FROM src WHERE src.doc_id = x.doc_id)"


def _runs(items: str, holds: str, least: int, explain: str = "NULL::varchar", part: str = "doc_id") -> str:
    return f"""SELECT doc_id, min(a)::int AS start_index, max(b)::int AS end_index, string_agg(s, '' ORDER BY a) AS matched_text, {explain} AS explanation FROM (
  SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY a) - row_number() OVER (PARTITION BY {part}, ok ORDER BY a) AS g FROM (SELECT *, ({holds}) AS ok FROM ({items})))
  WHERE ok GROUP BY {part}, g HAVING count(*) >= {least}"""


def _em_dash() -> str:
    return f"""SELECT x.doc_id, start_index, end_index, matched_text, NULL::varchar AS explanation FROM ({_spans(P.DASH, more=', text')}) x
  WHERE {_trim(f"regexp_replace(list_last(string_split(decode(encode(text)[1:start_index]), chr(10))) || string_split(decode(encode(text)[end_index + 1:]), chr(10))[1], '{P.DASH}', '', 'g')")} <> ''"""


def _negation() -> str:
    first = _spans(P.PIVOT_FIRST, more=", text")
    return f"""{_plain(P.PIVOT_COMMA)} UNION ALL {_plain(P.PIVOT_DASH)} UNION ALL
  SELECT doc_id, start_index, (end_index + strlen(more))::int, matched_text || more, NULL FROM (SELECT *,
    regexp_extract(decode(encode(text)[end_index + 1:]), '^[ \\t]+' || regexp_escape(regexp_extract(matched_text, {lit(P.PIVOT_FIRST)}, 1)) || {lit(P.PIVOT_SECOND)}) AS more FROM ({first})) WHERE more <> ''"""


def _colon() -> str:
    at = "start_index + strlen(string_split(matched_text, ':')[1])"
    return f"SELECT doc_id, ({at})::int AS start_index, ({at} + 1)::int AS end_index, ':' AS matched_text, NULL::varchar AS explanation FROM ({_spans(P.COLON)})"


def _question() -> str:
    paras = f"(SELECT doc_id, pos AS para, a AS at0, s AS text FROM ({PARAS}))"
    segs = _spans(P.SEGMENT, paras, base="at0", more=", para")
    return f"""SELECT doc_id, start_index, nb::int AS end_index, matched_text || nm AS matched_text, NULL::varchar AS explanation FROM (
  SELECT *, lead(matched_text) OVER w AS nm, lead(end_index) OVER w AS nb FROM ({segs}) WINDOW w AS (PARTITION BY doc_id, para ORDER BY start_index))
  WHERE nm IS NOT NULL AND ends_with({_trim('matched_text')}, '?') AND NOT ends_with({_trim('nm')}, '?') AND strlen({_trim('nm')}) <= 120"""


def _hedges() -> str:
    words = ", ".join(f"CASE WHEN contains(l, {lit(h)}) THEN {lit(h)} END" for h in P.HEDGES)
    modals = ", ".join(f"CASE WHEN regexp_matches(l, '\\b{m}\\b') THEN {lit(m)} END" for m in P.MODALS)
    return f"""SELECT doc_id, a AS start_index, b AS end_index, s AS matched_text, 'Contains ' || len(f) || ' hedges: ' || array_to_string(f[1:4], ', ') AS explanation FROM (
  SELECT *, list_filter([{words}, {modals}], lambda x: x IS NOT NULL) AS f FROM (SELECT *, lower(s) AS l FROM ({SENTS}))) WHERE len(f) >= 2"""


def _listicle() -> str:
    one = lambda p, item, name: f"""SELECT doc_id, start_index, end_index, matched_text, '{name} list with exactly ' || n || ' items' AS explanation FROM (
  SELECT *, len(list_filter(string_split({_trim('matched_text')}, chr(10)), lambda x: regexp_matches(x, {lit(item)}))) AS n FROM ({_spans(p)})) WHERE n IN {P.ROUND_COUNTS}"""  # noqa: E731
    return one(P.NUMBERED, P.NUMBERED_ITEM, "Numbered") + " UNION ALL " + one(P.BULLETED, P.BULLETED_ITEM, "Bullet")


def _trench() -> str:
    lead = f"regexp_extract(matched_text, {lit(P.TRENCH)}, 1)"
    return f"""SELECT doc_id, (start_index + strlen({lead}))::int AS start_index, end_index, substr(matched_text, length({lead}) + 1) AS matched_text, NULL::varchar AS explanation
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_spans(P.TRENCH)})) WHERE n >= 2"""


def openers() -> str:
    """doc_id, i (from 0), a, b, s, two, one: what each sentence opens with."""
    letters = lambda w: f"lower(regexp_replace(coalesce({w}, ''), '[^\\p{{L}}]', '', 'g'))"
    skip = lambda xs: "(" + ", ".join(map(lit, xs)) + ")"
    return f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS i, a, b, s,
  CASE WHEN len(w) >= 2 AND strlen(f) >= 2 AND f NOT IN {skip(P.SKIP_TWO)} THEN f || ' ' || {letters('w[2]')} ELSE '' END AS two,
  CASE WHEN len(w) >= 2 AND strlen(f) >= 2 AND f NOT IN {skip(P.SKIP_ONE)} THEN f ELSE '' END AS one
  FROM (SELECT *, {letters('w[1]')} AS f FROM (SELECT *, CASE WHEN len(v) > 1 AND {letters('v[1]')} IN {skip(P.CONJUNCTIONS)} THEN v[2:] ELSE v END AS w FROM (SELECT *, {_words('s')} AS v FROM ({SENTS}))))"""


def _anaphora() -> str:
    run = lambda k: f"count(*) OVER (PARTITION BY doc_id, {k}, g_{k} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""WITH RECURSIVE o AS MATERIALIZED ({openers()}),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, two ORDER BY i) AS g_two, i - row_number() OVER (PARTITION BY doc_id, one ORDER BY i) AS g_one FROM o),
n AS (SELECT *, CASE WHEN two <> '' THEN {run('two')} ELSE 0 END AS n_two, CASE WHEN one <> '' THEN {run('one')} ELSE 0 END AS n_one FROM g),
c AS MATERIALIZED (SELECT doc_id, i, CASE WHEN n_two >= 3 THEN n_two ELSE n_one END AS n, CASE WHEN n_two >= 3 THEN two ELSE one END AS k FROM n WHERE n_two >= 3 OR n_one >= 3),
r AS (SELECT doc_id, i, n, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS q FROM c) WHERE q = 1
  UNION ALL SELECT doc_id, i, n, k FROM (SELECT c.*, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.i) AS q FROM r JOIN c ON c.doc_id = r.doc_id AND c.i >= r.i + r.n) WHERE q = 1)
SELECT r.doc_id, min(a)::int AS start_index, max(b)::int AS end_index, string_agg(s, '' ORDER BY a) AS matched_text, '"' || any_value(r.k) || '..." repeated ' || any_value(r.n) || ' times' AS explanation
FROM r JOIN o ON o.doc_id = r.doc_id AND o.i >= r.i AND o.i < r.i + r.n GROUP BY r.doc_id, r.i"""


def _fragments() -> str:
    return f"""SELECT doc_id, a AS start_index, b AS end_index, t AS matched_text, NULL::varchar AS explanation FROM (
  SELECT *, {_trim('s')} AS t, {_words('s')} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY a) = 1 AS first FROM ({PARAS}))
  WHERE len(w) BETWEEN 1 AND 4 AND NOT ends_with(t, ':') AND (regexp_matches(t, '[.!?]') OR NOT (first OR
    len(list_filter(w, lambda x: NOT regexp_matches(x, '^[\\p{{Lu}}\\p{{Nd}}\\-\\x{{2013}}\\x{{2014}}"''\\x{{2018}}\\x{{2019}}\\x{{201C}}\\x{{201D}}\\[]'))) = 0))"""


_SPECIAL = {
    "em-dash-pivot": _em_dash, "negation-pivot": _negation, "colon-elaboration": _colon, "question-then-answer": _question, "hedge-stack": _hedges,
    "staccato-burst": lambda: _runs(PSENTS, f"len({_words('s')}) <= 8", 3, "count(*) || ' consecutive short sentences'", "doc_id, para"),
    "listicle-instinct": _listicle,
    "negation-countdown": lambda: _runs(SENTS, f"regexp_matches({_trim('s')}, {lit(P.NOT_START)})", 2),
    "anaphora-abuse": _anaphora,
    "gerund-litany": lambda: _runs(SENTS, f"len({_words('s')}) <= 8 AND regexp_matches({_trim('s')}, {lit(P.GERUND)})", 2),
    "listicle-trench-coat": _trench, "dramatic-fragment": _fragments,
}


def rule(name: str) -> str:
    """Rows of one rule over src, without repeats."""
    if name in _SPECIAL:
        body = _SPECIAL[name]()
    elif name == "parenthetical-qualifier":
        body = " UNION ALL ".join(_plain(p) for p in [P.PARENTHESIS, *(p for _, p in P.list_passes(name))])
    elif name in P.SINGLE or P.word_list(name):
        body = _plain(P.SINGLE.get(name) or P.word_list(name))
    else:
        body = " UNION ALL ".join(_plain(p) for _, p in P.list_passes(name))
    return f"SELECT DISTINCT doc_id, start_index, end_index, matched_text, explanation FROM ({body})"


def over(query: str, src: str | None = None) -> str:
    return f"WITH src AS ({src or 'SELECT doc_id, text FROM (' + seeded_sql() + ')'}) {query}"


def everything() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {lit(r)} AS rule_id, start_index, end_index, matched_text, explanation FROM ({rule(r)})" for r in P.ORDER)
