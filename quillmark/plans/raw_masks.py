"""Whole documents as they are, marks and all, inside constructs that decide what stays of them.

Each document goes into one of several frames by its number, so that every mark that a document holds meets
every construct. A frame guards its text against the one thing that would end it. Whether all goes, all stays
or escapes alone go follows from the construct, so SQL knows the masked text without a masker.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.masking import mask


def _blank(t: str) -> str:
    """SQL: spaces for all bytes but line ends."""
    return f"array_to_string(list_transform(string_split({t}, chr(10)), lambda l: repeat(' ', strlen(l))), chr(10))"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if "\n" not in text else " || chr(10) || ".join(_sql(x) for x in text.split("\n"))


def _parts(side: str) -> tuple[str, str]:
    """One side of a frame, where what stays stands in white brackets: its text, and its text masked."""
    pieces = re.split("⟦(.*?)⟧", side, flags=re.S)
    return "".join(pieces), "".join(p if i % 2 else re.sub(r"[^\n]", " ", p) for i, p in enumerate(pieces))


class Frame:
    """What stands before and after a text, whether the text stays, replacements that guard, and escapes, which go."""

    def __init__(self, before: str, after: str, stays: bool, guard: list[tuple[str, str]], escapes: list[tuple[str, str]] = ()):
        self.sides, self.stays, self.guard, self.escapes = (_parts(before), _parts(after)), stays, guard, list(escapes)

    def text(self, t: Column) -> Column:
        for old, new in [*self.guard, *self.escapes]:
            t = F.replace(t, F.lit(old), F.lit(new))
        return F.concat(F.lit(self.sides[0][0]), t, F.lit(self.sides[1][0]))

    def sql(self, t: str, masked: bool) -> str:
        for old, new in self.guard if masked else [*self.guard, *self.escapes]:
            t = f"replace({t}, {_sql(old)}, {_sql(new)})"
        if masked:
            for i, (old, _) in enumerate(self.escapes):  # first to marks of their own, so that no blank is escaped again
                t = f"replace({t}, {_sql(old)}, chr({57344 + i}))"
            for i, (_, new) in enumerate(self.escapes):
                t = f"replace({t}, chr({57344 + i}), {_sql(' ' * len(new))})"
            t = t if self.stays else _blank(t)
        return f"{_sql(self.sides[0][masked])} || {t} || {_sql(self.sides[1][masked])}"


_FENCE = "~" * 60
_ESCAPES = [("\\", "\\\\")]
FRAMES = {
    "markdown": [
        Frame(f"⟦Set\n===\n\n⟧> {_FENCE} info\n> ", f"\n> {_FENCE}\n⟦\nEnd ⟧<x@y.zz>⟦ ⟧<b>⟦in⟧</b>", False, [("\n", "\n> ")]),
        Frame("<!-- ", " -->\n", False, [("-->", "-- >")]),
        Frame("⟦- a\n  - b [l]⟧(u 't')\n\n<?", "?>\n⟦end\n⟧", False, [("?>", "? >")]),
        Frame("<textarea>\n", "\n</textarea>\n", False, [("</", "< /")]),
        Frame("⟦x ⟧`` ", " ``⟦ y\n⟧", False, [("`", "'"), ("\n", " ")]),
    ],
    "html": [
        Frame("<!-- ", " -->", False, [("-->", "-- >"), ("--!>", "--! >")]),
        Frame("<p>⟦a⟧</p><script>", "</script><b>⟦b⟧</b>", False, [("</", "< /")]),
        Frame('<p title="', '">⟦in⟧</p>', False, [('"', "'")]),
        Frame("<li>", "</li>", True, [("<", "(")]),
        Frame("<pre>", "</pre>⟦out⟧", False, [("<", "(")]),
    ],
}
_SCRIPT = [
    Frame("⟦/* ⟧", "⟦ */⟧ f(/it's/, b / c)", True, [("*/", "* /")]),
    Frame("x = `", "` + `⟦a⟧${'⟦b⟧'}`", True, [], [*_ESCAPES, ("`", "\\`"), ("$", "\\$")]),
    Frame('s = "', '"; y = z++ / 2', True, [("\r", " ")], [*_ESCAPES, ('"', '\\"'), ("\n", "\\n")]),
    Frame("⟦// ⟧", "\nz = '⟦kept⟧'", True, [("\n", "\n// ")]),
]
_JSX = [*_SCRIPT, Frame("e = <P a={1}>⟦|⟧", "⟦|⟧</P>;", True, [("<", "("), ("{", "("), ("&", "+")])]
_GENERIC = Frame("g = <T extends U>(a: T) => '", "'", True, [("\r", " ")], [*_ESCAPES, ("'", "\\'"), ("\n", "\\n")])
FRAMES |= {"js": _SCRIPT, "ts": [*_SCRIPT, _GENERIC], "jsx": _JSX, "tsx": [*_JSX, _GENERIC]}


def framed(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, text, lang: each document in a frame of the kind."""
    t, n = F.coalesce("text", F.lit("")), len(FRAMES[kind])
    text = F.element_at(F.array(*(F.when(F.pmod("doc_id", F.lit(n)) == i, f.text(t)) for i, f in enumerate(FRAMES[kind]))), (F.pmod("doc_id", F.lit(n)) + 1).cast("int"))
    return docs.select("doc_id", text.alias("text"), F.lit(kind).alias("lang"))


def raw_query(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        masked = mask(framed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), kind))
        return masked.select("doc_id", F.md5(F.col("text").cast("binary")).alias("framed"), F.md5(F.col("masked").cast("binary")).alias("masked"))

    return run


def raw_sql(kind: str) -> str:
    frames = FRAMES[kind]

    pick = lambda of: "CASE " + " ".join(f"WHEN doc_id % {len(frames)} = {i} THEN {of(f)}" for i, f in enumerate(frames)) + " END"
    return f"SELECT doc_id, md5({pick(lambda f: f.sql('t', False))}) AS framed, md5({pick(lambda f: f.sql('t', True))}) AS masked FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


QUERIES = {f"mask_{kind}_raw": raw_query(kind) for kind in FRAMES}
SQL = {f"mask_{kind}_raw": raw_sql(kind) for kind in FRAMES}
