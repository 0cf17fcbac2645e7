"""Span primitives as column expressions. Offsets are UTF-8 bytes, half-open.

Patterns are written in RE2 syntax and translated for Java: ``\\s`` without the
vertical tab, ``\\b`` by ASCII word characters, full case folding, ``\\n`` as the
only line end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.patterns import PARAGRAPH_END, SPACES

_WORD = "[A-Za-z0-9_]"
EDGE = f"(?-iu:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
SPAN = "struct<start:int,end:int,m:string>"
SENT = "struct<text:string,start:int,end:int>"
#: Unicode white space and all else, in classes that settle ASCII first: the long list of blanks is slow to look through.
BLANK = f"[ [{SPACES}]]"
INK = f"[!-~[^{SPACES}]]"
#: The same in a text that is all ASCII.
ASCII_BLANK = r"[ \t-\r]"
ASCII_INK = r"[!-\x7F\x00-\x08\x0E-\x1F]"
#: A sentence with the blanks behind it, or what is left of the text; one after the other they are the whole text.
SENTENCE = r"[^.!?]*+(?:[.!?]++(?!\s)[^.!?]*+)*+(?:[.!?]++\s++)?"
#: Letters outside ASCII that case-insensitive patterns take for ASCII ones.
ODD = {"\u017f": "s", "\u212a": "k", "\u0130": "i"}


def java(pattern: str) -> str:
    """An RE2 pattern in Java's dialect."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(r"\t\n\f\r " if inside else r"[\t\n\f\r ]")
            i += 2
        elif two == r"\b" and not inside:
            out.append(EDGE)
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        elif not inside and pattern.startswith("(?i)", i):
            out.append("(?iu)")
            i += 4
        elif not inside and pattern.startswith("(?m)", i):
            out.append("(?md)")
            i += 4
        else:
            inside = two[0] == "[" if not inside else two[0] != "]"
            out.append(two[0])
            i += 1
    return "".join(out)


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends; a run of blanks inside is passed once."""
    return F.regexp_replace(c, rf"^{BLANK}++|(?<!{BLANK}){BLANK}++\z", "")


def fields(c: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def at_most(c: Column, n: int) -> Column:
    """Whether there are 1 to n words; looks no further than word n + 1."""

    def some(blank: str, ink: str) -> Column:
        return c.rlike(rf"\A{blank}*+{ink}++(?:{blank}++{ink}++){{0,{n - 1}}}+{blank}*+\z")

    return F.when(F.octet_length(c) == F.length(c), some(ASCII_BLANK, ASCII_INK)).otherwise(some(BLANK, INK))


def first_words(c: Column) -> Column:
    """The first three words, or as many as there are; the rest of the text isn't split."""
    return F.slice(F.filter(F.split(c, f"{BLANK}+", 5), lambda w: w != ""), 1, 3)


def odd(c: Column) -> Column:
    """Whether a text holds one of the ODD letters."""
    return reduce(lambda a, b: a | b, (c.contains(x) for x in ODD))


def fold(c: Column) -> Column:
    """Lower case for gates: folds also the letters outside ASCII that match s, k and i."""
    return F.lower(F.when(odd(c), F.translate(c, "".join(ODD), "".join(ODD.values()))).otherwise(c))


def cut(raw: Column, start: Column, end: Column) -> Column:
    """Bytes between two character edges as a string; ``raw`` is binary, bound by ``once`` so that a cut costs its own length."""
    return F.substring(raw, start + 1, end - start).cast("string")


#: Items that a fold takes together: results are appended to arrays no longer than this, and these to one another.
FOLD = 64


def folded(n: Column, first: Column, kind: str, step) -> Column:
    """array<kind>: ``step(pos, i)`` for i < n gives (next pos, array to append); time in proportion to n but for a 64th of its square."""
    empty = F.expr(f"cast(array() as array<{kind}>)")
    start = lambda pos, out: F.struct(pos.cast("int").alias("pos"), out.alias("out"))

    def one(s: Column, i: Column) -> Column:
        pos, more = step(s["pos"], i)
        return start(pos, F.concat(s["out"], more))

    def block(s: Column, b: Column) -> Column:
        part = F.aggregate(F.sequence(b * FOLD, F.least(b * FOLD + (FOLD - 1), n - 1)), start(s["pos"], empty), one)
        return once(part, lambda x: start(x["pos"], F.concat(s["out"], F.array(x["out"]))))

    none = F.expr(f"cast(array() as array<array<{kind}>>)")
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / FOLD).cast("int"))
    return F.when(n > 0, F.flatten(F.aggregate(blocks, start(first, none), block, lambda s: s["out"]))).otherwise(empty)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for several uses inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Long runs that a pattern may pass over where it doesn't match: a match inside one would have begun with it.
LONG_BLANKS = r"\n[\t\n\f\r ]{32,}+"
LONG_NAME = r"[A-Z][\w\x{2019}']{64,}+"


def passing(pattern: str, over: str) -> str:
    """Java's dialect of an RE2 pattern that also matches what it may pass over, so that no run is scanned from each of its places."""
    return f"(?:{java(pattern)})|{over}"


def find_all(text: Column, pattern: str | Column, base: Column | None = None) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches of a (non-empty) RE2 pattern.

    A pattern given as a column is in Java's dialect already.
    """
    p = F.lit(java(pattern)) if isinstance(pattern, str) else pattern
    both = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("ms"), F.call_function("split", text, p, F.lit(-1)).alias("gs"))
    first = F.lit(0) if base is None else base

    def walk(z: Column) -> Column:
        def step(pos: Column, i: Column):
            at = pos + F.octet_length(z["gs"][i])
            to = at + F.octet_length(z["ms"][i])
            return to, F.array(F.struct(at.cast("int").alias("start"), to.cast("int").alias("end"), z["ms"][i].alias("m")))

        return folded(F.size(z["ms"]), first, SPAN, step)

    return once(both, walk)


def paragraphs(text: Column) -> Column:
    """array<SENT>: text between blank lines. Blank pieces are dropped."""
    p = java(PARAGRAPH_END)
    both = F.struct(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("ms"), F.split(text, p, -1).alias("gs"))

    def walk(z: Column) -> Column:
        def step(pos: Column, i: Column):
            to = pos + F.octet_length(z["gs"][i])
            piece = F.struct(z["gs"][i].alias("text"), pos.alias("start"), to.cast("int").alias("end"))
            return to + F.coalesce(F.octet_length(F.get(z["ms"], i)), F.lit(0)), F.array(piece)

        return F.filter(folded(F.size(z["gs"]), F.lit(0), SENT, step), lambda x: x["text"].rlike(INK))

    return once(both, walk)


def tiles(text: Column) -> Column:
    """array<string>: the sentences of a text, which are all of it, and perhaps blank ones at its end."""
    return F.regexp_extract_all(text, F.lit(java(SENTENCE)), F.lit(0))


def placed(parts: Column, base: Column | None = None) -> Column:
    """array<SENT>: strings that lie side by side, with their offsets; ``parts`` is bound by ``once``."""
    starts = folded(F.size(parts), F.lit(0) if base is None else base, "int", lambda pos, i: (pos + F.octet_length(parts[i]), F.array(pos)))
    return F.zip_with(parts, starts, lambda s, at: F.struct(s.alias("text"), at.alias("start"), (at + F.octet_length(s)).alias("end")))


def sentences(text: Column, base: Column | None = None) -> Column:
    """array<SENT>: text cut behind the blanks after ``.!?``. Blank pieces are dropped: all but the last two end in a mark."""
    return once(tiles(text), lambda z: F.filter(placed(z, base), lambda x, i: (i < F.size(z) - 2) | x["text"].rlike(INK)))


def neighbours(flag: Column, least: int) -> Column:
    """array<struct<i,j>>: maximal runs i..j (inclusive) of at least ``least`` true flags; ``flag`` is bound by ``once``."""
    n = F.size(flag)
    at = F.sequence(F.lit(0), n - 1)
    begin = F.filter(at, lambda i: flag[i] & ((i == 0) | ~F.coalesce(F.get(flag, i - 1), F.lit(False))))
    end = F.filter(at, lambda i: flag[i] & ((i == n - 1) | ~F.coalesce(F.get(flag, i + 1), F.lit(False))))
    both = F.zip_with(begin, end, lambda i, j: F.struct(i.alias("i"), j.alias("j")))
    enough = F.array_join(F.transform(flag, lambda x: F.when(x, "1").otherwise("0")), "").contains("1" * least)
    return F.when(enough, F.filter(both, lambda r: r["j"] - r["i"] + 1 >= least)).otherwise(F.expr("cast(array() as array<struct<i:int,j:int>>)"))


def islands(items: Column, holds, least: int) -> Column:
    """array<struct<i,j>>: maximal runs items[i..j] (inclusive) of at least ``least`` for which ``holds``."""
    return once(F.transform(items, holds), lambda flag: neighbours(flag, least))


def ranks(points: Column, queries: Column) -> Column:
    """array<int>: for each query, how many points lie below it. One sort of both together: a query's rank is its place less the queries before it."""
    at = lambda xs, kind: F.transform(xs, lambda x, i: F.struct(x.alias("at"), F.lit(kind).alias("kind"), i.alias("i")))
    both = F.array_sort(F.concat(at(queries, 0), at(points, 1)))  # of equal places the query comes first
    asked = F.filter(F.transform(both, lambda x, j: F.struct(x["kind"].alias("kind"), x["i"].alias("i"), j.alias("j"))), lambda x: x["kind"] == 0)
    placed = F.array_sort(F.transform(asked, lambda x, q: F.struct(x["i"].alias("i"), (x["j"] - q).alias("rank"))))
    return F.transform(placed, lambda x: x["rank"])


def count_overlapping(starts: Column, ends: Column, ranges: Column, kind: str) -> Column:
    """array<int>: for each span [start, end), how many ranges of the kind meet it; all that begin before its end, less those that end by its start."""
    own = F.filter(ranges, lambda r: r["kind"] == kind)
    begun = ranks(F.transform(own, lambda r: r["start"]), ends)
    over = ranks(F.transform(own, lambda r: r["end"]), F.transform(starts, lambda s: s + 1))
    return F.zip_with(begun, over, lambda a, b: a - b)


def overlaps(starts: Column, ends: Column, ranges: Column, kind: str) -> Column:
    """array<boolean>: for each span, whether a range of the kind meets it."""
    return F.transform(count_overlapping(starts, ends, ranges, kind), lambda n: n > 0)


def restore(raw: Column, start: Column, end: Column, otherwise: Column) -> Column:
    """The original bytes of a span where its offsets are valid: in order, inside the text and between characters. ``raw`` is binary, bound by ``once``."""
    inside = lambda at: (F.substring(raw, at + 1, 1) >= F.lit(b"\x80")) & (F.substring(raw, at + 1, 1) < F.lit(b"\xc0"))
    ok = (start >= 0) & (start <= end) & (end <= F.octet_length(raw)) & ~inside(start) & ~inside(end)
    return F.when(ok, cut(raw, start, end)).otherwise(otherwise)
