"""The 35 detectors as array columns over one text column.

``detect`` adds one array column per rule in a single projection; nothing is
scanned twice, nothing is shuffled. Every detector is gated by a cheap test so
that most texts never meet the costly expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import automata
from quillmark.functions import patterns as P
from quillmark.functions.spans import BLANK, INK, LONG_BLANKS, LONG_NAME, at_most, cut, fields, find_all, first_words, fold, folded, islands, java, neighbours, odd, once, paragraphs, passing, placed, sentences, tiles, trim

VIOLATION = "struct<rule_id:string,start_index:int,end_index:int,matched_text:string,explanation:string,suggested_change:string,ord:int>"


def _c(name: str) -> Column:
    """A shared column that ``prepared`` adds."""
    return F.col(name)


def _v(rule: str, start: Column, end: Column, text: Column, explanation: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(rule).alias("rule_id"), start.cast("int").alias("start_index"), end.cast("int").alias("end_index"), text.alias("matched_text"),
        (none if explanation is None else explanation).alias("explanation"), none.alias("suggested_change"), F.lit(P.ORDER.index(rule)).alias("ord"),
    )


def _empty() -> Column:
    return F.expr(f"cast(array() as array<{VIOLATION}>)")


def _any(words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (_c("_fold").contains(w) for w in words))


def _holds(words: list[str]) -> Column:
    """Whether the text holds one of these words of ``P.GATE_WORDS``."""
    return F.arrays_overlap(_c("_words"), F.array(*map(F.lit, words)))


def _gate(rule: str) -> Column:
    words = P.word_gates(rule)
    return _holds(words) if words else _any(P.GATES[rule])


def _when(gate: Column, found: Column) -> Column:
    return F.when(gate, found).otherwise(_empty())


def _hits(rule: str, pattern: str | Column) -> Column:
    return F.transform(find_all(_c("_text"), pattern), lambda s: _v(rule, s["start"], s["end"], s["m"]))


def _slice(rule: str, items: Column, runs: Column, explain=None) -> Column:
    """Violations for runs of sentences."""

    def one(raw: Column, r: Column) -> Column:
        start, end = items[r["i"]]["start"], items[r["j"]]["end"]
        return _v(rule, start, end, cut(raw, start, end), explain(r["j"] - r["i"] + 1) if explain else None)

    some = lambda rs: once(_c("_raw"), lambda raw: F.transform(rs, lambda r: one(raw, r)))
    return once(runs, lambda rs: F.when(F.size(rs) > 0, some(rs)).otherwise(_empty()))


def single(rule: str) -> Column:
    """One expression; a list of phrases is one automaton."""
    gate, phrases = _gate(rule), automata.word_list(rule)
    if rule in P.SECOND_GATES:
        gate = gate & _c("_fold").rlike(java(P.SECOND_GATES[rule]))
    return _when(gate, _hits(rule, F.lit(phrases) if phrases else P.SINGLE[rule]))


def solid(found: Column) -> Column:
    """Without the runs of blanks that a pattern passed over."""
    return F.filter(found, lambda s: s["m"].rlike(r"[^\t\n\f\r ]"))


def listed(rule: str) -> Column:
    """One pass per entry, and only for entries whose gate the text holds."""
    passes = P.list_passes(rule)
    each = F.array(*(F.struct(F.lit(gate).alias("gate"), F.lit(passing(p, LONG_BLANKS) if r"\n\s*" in p else java(p)).alias("p")) for gate, p in passes))
    due = F.filter(each, lambda x: F.contains(_c("_fold"), x["gate"]))
    found = solid(F.flatten(F.transform(due, lambda x: find_all(_c("_text"), x["p"]))))
    return _when(_gate(rule), F.transform(found, lambda s: _v(rule, s["start"], s["end"], s["m"])))


def parenthetical() -> Column:
    rule = "parenthetical-qualifier"
    # nothing after the last bracket can match, however many open there
    closed = F.left(_c("_text"), F.length(_c("_text")) - F.length(F.substring_index(_c("_text"), ")", -1)))
    inside = F.transform(find_all(closed, P.PARENTHESIS), lambda s: _v(rule, s["start"], s["end"], s["m"]))
    return F.concat(_when(_c("_text").contains("(") & _c("_text").contains(")"), inside), listed(rule))


def em_dash() -> Column:
    """A dash counts unless its line holds nothing else: such a line is one match, told apart by its size or, if it is one dash, by what stands beside it."""
    rule = "em-dash-pivot"
    blank = P.SPACES.replace(r"\n", "")
    found = find_all(_c("_text"), rf"(?m)^(?=[{blank}\x{{2014}}\x{{2013}}]++$)[{blank}]*+{P.DASH}[{blank}\x{{2014}}\x{{2013}}]*+|{P.DASH}")
    edge = lambda raw, at: (at < 0) | (at >= F.octet_length(raw)) | (cut(raw, at, at + 1) == "\n")

    def counts(raw: Column, s: Column) -> Column:
        return (F.length(s["m"]) == 1) & ~(edge(raw, s["start"] - 1) & edge(raw, s["end"]))

    some = once(_c("_raw"), lambda raw: F.filter(found, lambda s: counts(raw, s)))
    return _when(_c("_text").contains("—") | _c("_text").contains("–"), F.transform(some, lambda s: _v(rule, s["start"], s["end"], s["m"])))


def negation_pivot() -> Column:
    rule = "negation-pivot"
    # the blanks after a first sentence go with it: no match begins with one
    first = F.filter(find_all(_c("_text"), F.lit(passing(P.PIVOT_FIRST + r"[ \t]*+", LONG_NAME))), lambda s: s["m"].rlike("[.!?]"))

    def second(raw: Column, s: Column) -> Column:
        subject = F.regexp_extract(s["m"], java(P.PIVOT_FIRST), 1)
        again = F.concat(F.lit(r"^\Q"), subject, F.lit(r"\E" + java(P.PIVOT_SECOND)))
        rest = cut(raw, s["end"], s["end"] + F.octet_length(subject) + 4 * 124)  # as far as the pattern can reach
        more = F.when(s["m"].rlike(r"[ \t]$"), F.call_function("regexp_extract", rest, again, F.lit(0))).otherwise("")
        return F.struct(s["start"].alias("start"), (s["end"] + F.octet_length(more)).alias("end"), F.concat(s["m"], more).alias("m"), (more != "").alias("ok"))

    both = once(_c("_raw"), lambda raw: F.transform(first, lambda s: second(raw, s)))
    stitched = F.transform(F.filter(both, lambda s: s["ok"]), lambda s: _v(rule, s["start"], s["end"], s["m"]))
    return _when(
        _gate(rule) | (_holds(["t"]) & _holds(P.WITH_T)),
        F.concat(
            _when(_holds(["but"]), _hits(rule, P.PIVOT_COMMA)), _when(_c("_text").contains("—") | _c("_text").contains("–"), _hits(rule, P.PIVOT_DASH)),
            _when(_c("_text").rlike("[A-Z]"), stitched),
        ),
    )


def colon() -> Column:
    rule = "colon-elaboration"

    def one(s: Column) -> Column:
        at = s["start"] + F.octet_length(F.substring_index(s["m"], ":", 1))
        return _v(rule, at, at + 1, F.lit(":"))

    # before the first colon of its line no match begins where a mark comes first: such a run is passed over
    found = F.filter(find_all(_c("_text"), F.lit(rf"[^.!?\n:]*+[.!?\n]++|{java(P.COLON)}")), lambda s: s["m"].contains(":"))
    return _when(_c("_text").rlike(r":(?<=[^.!?\n]{5}:)[^:\n]{20}"), F.transform(found, one))


def question() -> Column:
    """Within a paragraph, a segment that asks and a next one, of 120 bytes at most, that doesn't."""
    rule = "question-then-answer"

    def in_paragraph(p: Column) -> Column:
        # segments lie side by side: one that doesn't end is not looked for again further on
        found = find_all(p["text"], F.lit(r"\G" + java(P.SEGMENT)), p["start"])
        pairs = once(found, lambda segs: F.zip_with(segs, F.slice(segs, 2, F.greatest(F.size(segs), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))

        def answered(x: Column) -> Column:
            a, b = trim(x["a"]["m"]), trim(x["b"]["m"])
            return F.coalesce(a.endswith("?") & ~b.endswith("?") & (F.octet_length(b) <= 120), F.lit(False))

        return F.transform(F.filter(pairs, answered), lambda x: _v(rule, x["a"]["start"], x["b"]["end"], F.concat(x["a"]["m"], x["b"]["m"])))

    return _when(_c("_text").contains("?"), F.flatten(F.transform(F.filter(_c("_paras"), lambda p: p["text"].contains("?")), in_paragraph)))


def hedges() -> Column:
    rule = "hedge-stack"

    any_of = automata.expression(automata.tree([list(w) for w in (*P.HEDGES, *P.MODALS)]))
    lower = lambda s: F.lower(F.translate(s["text"], "\u0130", "i"))  # noqa: E731  # one letter for one

    def found(low: Column) -> Column:
        words = F.filter(F.array(*map(F.lit, P.HEDGES)), lambda h: F.contains(low, h))
        modals = F.filter(F.array(*(F.struct(F.lit(m).alias("w"), low.rlike(java(rf"\b{m}\b")).alias("y")) for m in P.MODALS)), lambda m: m["y"])
        return F.concat(words, F.transform(modals, lambda m: m["w"]))

    some = F.filter(_c("_sents"), lambda s: lower(s).rlike(any_of))
    with_found = F.filter(
        F.transform(some, lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), once(lower(s), found).alias("f"))),
        lambda s: F.size(s["f"]) >= 2,
    )
    return _when(
        _any([*(h for h in P.HEDGES if "kind of" not in h), " kind of", *P.MODALS]),
        F.transform(
            with_found,
            lambda s: _v(rule, s["start"], s["end"], s["text"], F.concat(F.lit("Contains "), F.size(s["f"]).cast("string"), F.lit(" hedges: "), F.array_join(F.slice(s["f"], 1, 4), ", "))),
        ),
    )


def staccato() -> Column:
    rule = "staccato-burst"
    explain = lambda n: F.concat(n.cast("string"), F.lit(" consecutive short sentences"))

    def in_paragraph(p: Column) -> Column:
        # offsets are counted only where a run is found
        runs = lambda z: once(F.transform(z, lambda s: at_most(s, 8)), lambda flag: neighbours(flag, 3))
        some = lambda z, rs: once(placed(z, p["start"]), lambda ss: _slice(rule, ss, rs, explain))
        each = lambda z: once(runs(z), lambda rs: _when(F.size(rs) > 0, some(z, rs)))
        return once(tiles(p["text"]), lambda z: _when(F.size(z) >= 3, each(z)))

    return F.flatten(F.transform(_c("_paras"), in_paragraph))


def listicle() -> Column:
    rule = "listicle-instinct"

    def of(pattern: str, item: str, name: str) -> Column:
        def count(s: Column) -> Column:
            return F.size(F.filter(F.split(trim(s["m"]), "\n"), lambda line: line.rlike(java(item))))

        # first with items that aren't given back, which take no stack; a text where that fails has few of them
        whole = F.lit(passing(f"{pattern}+|{pattern}", LONG_BLANKS))
        counted = F.transform(solid(find_all(_c("_text"), whole)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), count(s).alias("n")))
        return F.transform(
            F.filter(counted, lambda s: s["n"].isin(*P.ROUND_COUNTS)),
            lambda s: _v(rule, s["start"], s["end"], s["m"], F.concat(F.lit(f"{name} list with exactly "), s["n"].cast("string"), F.lit(" items"))),
        )

    return F.concat(
        _when(_c("_text").rlike(r"(?md)^[\t\f\r ]*+[0-9]++[.)][\t\n\f\r ]"), of(P.NUMBERED, P.NUMBERED_ITEM, "Numbered")), _when(_c("_text").rlike(r"(?md)^[\t\f\r ]*+[-*\x{2022}][\t\n\f\r ]"), of(P.BULLETED, P.BULLETED_ITEM, "Bullet"))
    )


def countdown() -> Column:
    rule = "negation-countdown"
    # NOT_START of the trimmed sentence
    starts = rf"\A{BLANK}*+(?iu:not)[\t\n\f\r ]{BLANK}*+{INK}"
    return _when(_gate(rule), _slice(rule, _c("_sents"), islands(_c("_sents"), lambda s: s["text"].rlike(starts), 2)))


def gerunds() -> Column:
    rule = "gerund-litany"
    start = rf"\A{BLANK}*+{java(P.GERUND.lstrip('^'))}"
    holds = lambda s: s["text"].rlike(start) & at_most(s["text"], 8)
    return _when(_c("_text").rlike(r"[A-Z][a-z]++(?<=[a-z]ing)(?![A-Za-z0-9_])"), _slice(rule, _c("_sents"), islands(_c("_sents"), holds, 2)))


def letters(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^a-zA-Z\p{L}]+", ""))


def openers() -> Column:
    """array<struct<two,one>> by sentence: its two-word and one-word opening, '' where it has none that counts."""

    def of(l: Column) -> Column:
        # a conjunction before other words doesn't count
        return once(F.when((F.size(l) > 1) & F.get(l, F.lit(0)).isin(*P.CONJUNCTIONS), F.slice(l, 2, 2)).otherwise(F.slice(l, 1, 2)), opening)

    def opening(l: Column) -> Column:
        enough = (F.size(l) >= 2) & (F.octet_length(F.get(l, F.lit(0))) >= 2)
        return F.struct(
            F.when(enough & ~F.get(l, F.lit(0)).isin(*P.SKIP_TWO), F.concat_ws(" ", F.get(l, F.lit(0)), F.get(l, F.lit(1)))).otherwise("").alias("two"),
            F.when(enough & ~F.get(l, F.lit(0)).isin(*P.SKIP_ONE), F.get(l, F.lit(0))).otherwise("").alias("one"),
        )

    # the letters of the first three words decide everything
    few = lambda s: F.transform(first_words(s["text"]), letters)
    return F.transform(F.transform(_c("_sents"), few), of)


def anaphora() -> Column:
    """Runs of three or more sentences with one opening; two-word openings first, scanning on after a run."""
    rule = "anaphora-abuse"

    def ends(o: Column, k: str) -> Column:
        """By sentence, the end of the run of equal openings that it stands in, from the last sentence to the first."""
        n = F.size(o)

        def step(pos: Column, i: Column):
            at = n - 1 - i
            end = F.when((i > 0) & (F.get(o, at + 1)[k] == o[at][k]), pos).otherwise(at + 1)
            return end, F.array(end.cast("int"))

        return F.reverse(folded(n, F.lit(0), "int", step))

    def scan(o: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(o) - 1)
        both = F.zip_with(once(ends(o, "two"), lambda x: x), once(ends(o, "one"), lambda x: x), lambda x, y: F.struct(x.alias("two"), y.alias("one")))
        return once(both, lambda e: runs(o, e, F.filter(at, lambda i: long(o, e, i, "two") | long(o, e, i, "one"))))

    def long(o: Column, e: Column, i: Column, k: str) -> Column:
        return (o[i][k] != "") & (e[i][k] - i >= 3)

    def runs(o: Column, e: Column, begins: Column) -> Column:
        def step(raw: Column, b: Column, pos: Column, j: Column):
            i = b[j]
            two = long(o, e, i, "two")
            end, key = F.when(two, e[i]["two"]).otherwise(e[i]["one"]), F.when(two, o[i]["two"]).otherwise(o[i]["one"])
            start, stop = _c("_sents")[i]["start"], _c("_sents")[end - 1]["end"]
            v = _v(rule, start, stop, cut(raw, start, stop), F.concat(F.lit('"'), key, F.lit('..." repeated '), (end - i).cast("string"), F.lit(" times")))
            return F.when(i < pos, pos).otherwise(end), F.when(i < pos, _empty()).otherwise(F.array(v))

        found = once(begins, lambda b: once(_c("_raw"), lambda raw: folded(F.size(b), F.lit(0), VIOLATION, lambda pos, j: step(raw, b, pos, j))))
        return found

    def thrice(o: Column) -> Column:
        """Whether three neighbours have one opening; most texts end here."""
        same = lambda i, k: (o[i][k] != "") & (o[i][k] == o[i + 1][k]) & (o[i][k] == o[i + 2][k])
        return F.exists(F.sequence(F.lit(0), F.size(o) - 3), lambda i: same(i, "one") | same(i, "two"))

    def likely(w: Column) -> Column:
        """Whether three neighbours may open alike, by the letters of their first words; behind a conjunction anything may come."""
        alike = lambda a, b: (a == b) | a.isin(*P.CONJUNCTIONS) | b.isin(*P.CONJUNCTIONS)
        near = lambda i: (w[i] != "") & alike(w[i], w[i + 1])
        return F.exists(F.sequence(F.lit(0), F.size(w) - 3), lambda i: near(i) & near(i + 1) & alike(w[i], w[i + 2]))

    firsts = F.transform(_c("_sents"), lambda s: letters(F.regexp_extract(s["text"], rf"\A{BLANK}*+({INK}++)", 1)))
    return _when(F.size(_c("_sents")) >= 3, once(firsts, lambda w: _when(likely(w), once(openers(), lambda o: _when(thrice(o), scan(o))))))


def trench() -> Column:
    """Ordinals at sentence starts, two or more in a text; the lead-in is no part of the span."""
    rule = "listicle-trench-coat"

    def stripped(s: Column) -> Column:
        lead = F.regexp_extract(s["m"], java(P.TRENCH), 1)
        body = F.substring(s["m"], F.length(lead) + 1, F.length(s["m"]))
        return _v(rule, s["start"] + F.octet_length(lead), s["end"], body)

    found = F.transform(solid(find_all(_c("_text"), F.lit(passing(P.TRENCH, LONG_BLANKS)))), stripped)
    return F.element_at(F.transform(F.array(_when(_gate(rule), found)), lambda v: F.when(F.size(v) >= 2, v).otherwise(_empty())), 1)


def fragments() -> Column:
    rule = "dramatic-fragment"

    def holds(p: Column) -> Column:
        t = trim(p["text"])
        words = fields(t)
        capped = F.forall(words, lambda w: w.rlike(r"^[\p{Lu}\p{Nd}\-\x{2013}\x{2014}\"'\x{2018}\x{2019}\x{201C}\x{201D}\[]"))
        first = p["start"] == F.element_at(_c("_paras"), 1)["start"]
        return ~t.endswith(":") & (t.rlike("[.!?]") | ~(first | capped))

    short = F.filter(_c("_paras"), lambda p: at_most(p["text"], 4))
    return F.transform(F.filter(short, holds), lambda p: _v(rule, p["start"], p["end"], trim(p["text"])))


SPECIAL = {
    "em-dash-pivot": em_dash, "negation-pivot": negation_pivot, "colon-elaboration": colon, "parenthetical-qualifier": parenthetical,
    "question-then-answer": question, "hedge-stack": hedges, "staccato-burst": staccato, "listicle-instinct": listicle,
    "negation-countdown": countdown, "anaphora-abuse": anaphora, "gerund-litany": gerunds, "listicle-trench-coat": trench, "dramatic-fragment": fragments,
}


#: Expressions by rule. They name columns only, so any plan of the same JVM can use them; building one takes many calls into it.
_BUILT: dict[tuple, Column] = {}


def column(rule: str) -> Column:
    """array<VIOLATION> of one rule; needs the columns that ``prepared`` adds."""
    from pyspark import SparkContext

    at = (id(SparkContext._active_spark_context), rule)
    if at not in _BUILT:
        _BUILT[at] = _build(rule)
    return _BUILT[at]


def _build(rule: str) -> Column:
    if rule in SPECIAL:
        return SPECIAL[rule]()
    if rule in P.SINGLE or P.word_list(rule):
        return single(rule)
    if P.list_passes(rule):
        return listed(rule)
    raise KeyError(rule)


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the shared columns: text without nulls, folded text, paragraphs, sentences, the gates' words."""
    t = docs.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    t = t.withColumns({"_raw": F.col("_text").cast("binary"), "_fold": fold(F.col("_text")), "_paras": paragraphs(F.col("_text")), "_sents": sentences(F.col("_text"))})
    # beside the odd letters lie other word edges than in the folded text: such a text may hold any word
    every = F.array(*map(F.lit, P.GATE_WORDS))
    words = F.array_intersect(F.regexp_extract_all("_fold", F.lit("[a-z0-9_]++"), F.lit(0)), every)
    return t.withColumn("_words", F.when(odd(F.col("_text")), every).otherwise(words))


def detect(docs: DataFrame, text: str = "text", rules: list[str] | None = None) -> DataFrame:
    """``docs`` and ``violations``: array<VIOLATION> in detector order, duplicates by (rule, start, end) removed, first kept."""
    wanted = [r for r in P.ORDER if rules is None or r in rules]
    found = prepared(docs, text).withColumn("violations", F.concat(*(column(r) for r in wanted)))
    return deduplicated(found.drop("_text", "_raw", "_fold", "_paras", "_sents", "_words"))


def deduplicated(df: DataFrame, column_: str = "violations") -> DataFrame:
    """Keep the first violation per (rule, start, end), in order: of equal neighbours in sorted order the first stays."""
    key = lambda v: F.concat_ws(":", v["start_index"].cast("string"), v["end_index"].cast("string"), v["rule_id"])
    placed = F.array_sort(F.transform(column_, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"))))
    fresh = once(placed, lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["k"] != x["k"])))
    kept = once(F.array_sort(F.transform(fresh, lambda x: x["i"])), lambda at: F.transform(at, lambda i: F.col(column_)[i]))
    distinct = F.size(F.array_distinct(F.transform(column_, key))) == F.size(column_)
    return df.withColumn(column_, F.when(distinct, F.col(column_)).otherwise(kept))
