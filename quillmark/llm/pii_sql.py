"""The rows of ``op7_pii`` in DuckDB SQL.

RE2 has no lookaround and no possessive runs, so the generators are restated:
texts get a line feed in front (in no pattern's alphabet), a leading character
that must not be part of a span is matched and cut off, an underscore becomes
a full stop where a word boundary stands for "no letter or digit here". Of an
``address`` the labels are plain greedy: where a label with a digit and more
labels follow (x.com.212.555), it ends at the last whole one, the operator at the first.
"""

from __future__ import annotations

from quillmark.llm.pii_model import CUES, FEATURES, KINDS, WINDOW, fitted

_RUN = "[A-Za-z0-9+/_-]{16,}"
_DOT = r"(?:\.|\(dot\)|\[dot\])"
_JOIN = r"(?:\.| \. | ?(?:\(dot\)|\[dot\]) ?)"
_END = r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?$"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MORE = {
    "secret": rf"{_RUN}(?:\.{_RUN})*",
    "account": r"\b[0-9](?:[ -]?[0-9]){8,18}\b",
    "address": rf"[^A-Za-z0-9._-][A-Za-z0-9._-]+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+ ?{_DOT} ?(?:[A-Za-z0-9-]+{_JOIN})*[A-Za-z]{{2,}}",
    "local_phone": r"[^0-9+(]\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4,}",
}
#: What of a match stands before the span: leading runs without a digit; the character before an address or a number.
_CUT = {"secret": r"^(?:[A-Za-z+/_-]{16,}\.)*", "address": r"^[^A-Za-z0-9._-]", "local_phone": r"^[^0-9(]"}
#: What a span must match: the generator's own condition at its start or end.
_HOLDS = {"secret": r"^[A-Za-z+/_-]*[0-9]", "local_phone": r"[^0-9][0-9]{4}$"}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits(kind: str, pattern: str) -> str:
    p, src = _lit(pattern), "translate(t, '_', '.')" if kind == "account" else "t"
    cut = f"regexp_extract(hit, {_lit(_CUT[kind])})" if kind in _CUT else "''"
    holds = f"regexp_matches(m, {_lit(_HOLDS[kind])})" if kind in _HOLDS else "true"
    return f"""SELECT * FROM (SELECT rid, t, '{kind}' AS kind, place + length({cut}) AS a, substr(hit, length({cut}) + 1) AS m
  FROM (SELECT rid, t, length(array_to_string(gs[1:i], '') || array_to_string(ms[1:i - 1], '')) - 1 AS place, ms[i] AS hit
    FROM (SELECT rid, t, regexp_extract_all({src}, {p}) AS ms, string_split_regex({src}, {p}) AS gs FROM d WHERE regexp_matches({src}, {p})), LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i)))
  WHERE {holds}"""


def _luhn(d: str) -> str:
    digit = f"substr(reverse({d}), i, 1)::int"
    return f"({d} <> '' AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} ELSE {digit} * 2 - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"


def _features() -> dict[str, str]:
    flag = lambda c: f"({c})::int::double"
    found = {
        "kind": f"(list_position([{', '.join(map(_lit, KINDS))}], kind) - 1)::double", "size": "length(m)::double", "digits": "length(g)::double / length(m)",
        "uppers": "length(regexp_replace(m, '[^A-Z]', '', 'g'))::double / length(m)", "distinct": "len(list_distinct(string_split(m, '')))::double",
        "hex": flag("regexp_matches(m, '^[0-9A-Fa-f]+$')"), "luhn": flag(_luhn("g")), "quoted": flag(f"regexp_matches(before, {_lit(chr(91) + chr(34) + chr(39) + '`]' + _END)})"),
        "assigned": flag(f"regexp_matches(before, {_lit('[=:] ?[' + chr(34) + chr(39) + '`]?' + _END)})"), "separators": "length(regexp_replace(m, '[^ .()-]', '', 'g'))::double",
    } | {k: flag(f"regexp_matches(before, {_lit(v)})") for k, v in CUES.items()}
    return {k: found[k] for k in FEATURES}


def op7_sql(table: str = "documents") -> str:
    model = fitted()
    leaf = lambda s: f"CASE WHEN f_{FEATURES[s[0]]} < {s[1]!r} THEN {s[2]!r} ELSE {s[3]!r} END"
    trees = " + ".join([f"{float(model.bias)!r}::double"] + [f"(CASE WHEN f_{FEATURES[f]} < {cut!r} THEN {leaf(low)} ELSE {leaf(high)} END)::double" for f, cut, low, high in model.trees])
    limit = "CASE kind " + " ".join(f"WHEN '{k}' THEN {x!r}" for k, x in zip(KINDS, model.thresholds, strict=True)) + " END"
    order = f"list_position([{', '.join(map(_lit, [*BASE, *KINDS]))}], kind)"
    text = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a)"
    bad_part = "length(ltrim(p, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(p, '0'), '') AS int), 0) > 255"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, chr(10) || coalesce(text, '') AS t FROM {table}),
hits AS MATERIALIZED (SELECT *, a + length(m) AS b, {order} AS o, regexp_replace(m, '[^0-9]', '', 'g') AS g, lower(substr(t, greatest(a - {WINDOW}, 0) + 2, least(a, {WINDOW}))) AS before FROM (
{' UNION ALL '.join(_hits(k, p) for k, p in (BASE | MORE).items())})),
base AS MATERIALIZED (SELECT rid, kind, o, a, b FROM hits WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: {bad_part})) = 0
  WHEN 'card' THEN length(g) BETWEEN 16 AND 19 AND {_luhn('g')} WHEN 'phone' THEN length(g) BETWEEN 8 AND 15 ELSE false END),
f AS (SELECT rid, kind, o, a, b, {', '.join(f'{v} AS f_{k}' for k, v in _features().items())} FROM hits WHERE kind IN ({', '.join(map(_lit, KINDS))})),
p AS (SELECT rid, kind, o, a, b, 1 / (1 + exp(-({model.a!r}::double * ({trees}) + {model.b!r}::double))) AS p FROM f),
more AS MATERIALIZED (SELECT * FROM p WHERE p >= {limit} AND NOT EXISTS (SELECT 1 FROM base WHERE base.rid = p.rid AND base.a < p.b AND p.a < base.b)),
kept AS (SELECT rid, kind, o, a, b FROM more x WHERE NOT EXISTS (SELECT 1 FROM more y WHERE y.rid = x.rid AND y.a < x.b AND x.a < y.b AND (-y.p, y.a, y.kind) < (-x.p, x.a, x.kind))),
n AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, {text} AS listed FROM base GROUP BY rid),
s AS (SELECT rid, {text} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM kept) GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::bigint AS n_{k}' for k in BASE)}, sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid)
"""


OP7_SQL = op7_sql()
