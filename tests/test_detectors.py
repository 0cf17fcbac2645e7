"""Fires / doesn't fire by rule, offsets, edge cases. The sentences are this library's own."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions import patterns as P
from quillmark.functions.spans import find_all, java
from quillmark.operators.detectors import detect
from quillmark.operators.report import check, exploded, report_json
from quillmark.plans.seeds import CARRIERS

CASES = [
    ("overused-intensifiers", "A Crucial step and two paradigms.", 2), ("overused-intensifiers", "A crucially small step.", 0),
    ("elevated-register", "We utilize it in terms of cost.", 2), ("elevated-register", "We use it.", 0),
    ("filler-adverbs", "It is very, really good.", 2), ("filler-adverbs", "The every day of averyone.", 0),
    ("almost-hedge", "It is almost\nalways so.", 1), ("almost-hedge", "It is almost done.", 0),
    ("era-opener", "Late in an era of change.", 1), ("era-opener", "In an area of change.", 0),
    ("metaphor-crutch", "A game-changer, a game changer and low hanging fruit.", 3), ("metaphor-crutch", "A changed game.", 0),
    ("important-to-note", "It's worth noting. Note that it is so.", 2), ("important-to-note", "A note for you.", 0),
    ("broader-implications", "Its implications for the wider world.", 1), ("broader-implications", "Its implications.", 0),
    ("false-conclusion", "It ran. In conclusion it ended. To conclude, yes.", 2), ("false-conclusion", "Overall, this was fine.", 0), ("false-conclusion", "So in conclusion it ended.", 0),
    ("connector-addiction", "However, no.\nThus it was. Yes! Hence\tthis.", 3), ("connector-addiction", "It was, however, late.", 0),
    ("unnecessary-contrast", "Unlike him, whereas she left.", 2), ("unnecessary-contrast", "Likely so.", 0),
    ("em-dash-pivot", "One — two – three.\n———", 2), ("em-dash-pivot", "One - two.", 0),
    ("negation-pivot", "It is not a hill in the north, but a tower.", 1), ("negation-pivot", "It was never about gold — silver.", 1),
    ("negation-pivot", "Ann doesn't sing in church. Ann plays the old organ.", 1), ("negation-pivot", "Ann doesn't sing in church. Bob plays the old organ.", 0),
    ("colon-elaboration", "Here is the rule: nobody may enter the yard today", 1), ("colon-elaboration", "Time: noon", 0),
    ("parenthetical-qualifier", "It is (as far as anyone can tell) so, of course, it is.", 2), ("parenthetical-qualifier", "It is (so).", 0),
    ("question-then-answer", "Why? It rained. Who? Where?", 1), ("question-then-answer", "Why? Who?", 0),
    ("hedge-stack", "Perhaps it might rain.", 1), ("hedge-stack", "Perhaps it rains.", 0),
    ("staccato-burst", "He ran. She hid. All slept.", 1), ("staccato-burst", "He ran. She hid.\n\nAll slept.", 0),
    ("listicle-instinct", "x\n\n1. a\n2. b\n3. c\n", 1), ("listicle-instinct", "x\n\n- a\n- b\n- c\n- d\n", 0),
    ("serves-as", "It serves  as a door.", 1), ("serves-as", "It served as a door.", 0),
    ("negation-countdown", "Not red. Not blue. Just green.", 1), ("negation-countdown", "Not red. Just green.", 0),
    ("anaphora-abuse", "Ships carry salt. Ships carry wine. And ships carry oil.", 1), ("anaphora-abuse", "The man ran. The dog ran. The cat ran.", 0),
    ("gerund-litany", "Walking home. Singing loud. We slept.", 1), ("gerund-litany", "Walking home. We slept.", 0),
    ("heres-the-kicker", "HERE'S THE THING: it works.", 1), ("heres-the-kicker", "Here is the thing.", 0),
    ("pedagogical-aside", "Let's unpack it. Think of it as air.", 2), ("pedagogical-aside", "Unpack it.", 0),
    ("imagine-world", "Imagine a world of ice.", 1), ("imagine-world", "I imagine so.", 0),
    ("listicle-trench-coat", "The first is big. The second is small.", 2), ("listicle-trench-coat", "The first is big.", 0),
    ("vague-attribution", "Many experts argue it.", 2), ("vague-attribution", "Dr. Lee argues it.", 0),
    ("bold-first-bullets", "- **Big** one\n* **Two** x", 2), ("bold-first-bullets", "- Big **one**", 0),
    ("unicode-arrows", "a → b → c", 2), ("unicode-arrows", "a -> b", 0),
    ("despite-challenges", "Despite its many challenges, it stood.", 1), ("despite-challenges", "Despite rain it stood.", 0),
    ("dramatic-fragment", "A long first paragraph stands here.\n\nThen silence.", 1), ("dramatic-fragment", "Title Here\n\nA long paragraph follows here now.", 0),
    ("concept-label", "The growth paradox.", 1), ("concept-label", "A paradoxical thing.", 0),
    ("superficial-analysis", "It stood, reflecting its importance.", 1), ("superficial-analysis", "It stood, reflecting light.", 0),
    ("false-range", "It didn't come from nowhere.", 1), ("false-range", "It came from Rome.", 0),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t) for i, (_, t, _) in enumerate(CASES)] + [(1000 + i, c) for i, c in enumerate(CARRIERS)] + [(2000, None), (2001, ""), (2002, " \n\t\n "), (2003, "é" * 50 + " — très crucial é. " * 3)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    return dict(rows), exploded(detect(df)).collect()


def test_fires_and_does_not(found):
    _, rows = found
    assert {r for r, _, _ in CASES} == set(P.ORDER)
    for i, (rule, text, n) in enumerate(CASES):
        got = [r for r in rows if r.doc_id == i and r.rule_id == rule]
        assert len(got) == n, (rule, text, got)


def test_offsets_are_bytes(found):
    texts, rows = found
    for r in rows:
        cut = texts[r.doc_id].encode()[r.start_index : r.end_index].decode()
        assert cut == r.matched_text or (r.rule_id == "dramatic-fragment" and cut.strip() == r.matched_text)
    assert not [r for r in rows if r.doc_id in (2000, 2001, 2002)]
    assert len({(r.doc_id, r.rule_id, r.start_index, r.end_index) for r in rows}) == len(rows)


def test_explanations(found):
    _, rows = found
    by = {(r.doc_id, r.rule_id): r.explanation for r in rows}
    at = {rule: i for i, (rule, _, n) in reversed(list(enumerate(CASES))) if n}
    assert by[at["staccato-burst"], "staccato-burst"] == "3 consecutive short sentences"
    assert by[at["hedge-stack"], "hedge-stack"] == "Contains 2 hedges: perhaps, might"
    assert by[at["listicle-instinct"], "listicle-instinct"] == "Numbered list with exactly 3 items"
    assert by[at["anaphora-abuse"], "anaphora-abuse"] == '"ships carry..." repeated 3 times'


def test_report_and_suppression(spark):
    from quillmark.operators.masking import mask

    src = "# Why Now\n\nA plain and rather long paragraph stands here, `crucial` and robust.\n\n- He ran. She hid.\n- All slept. It ended.\n\nThen silence.\n"
    df = mask(spark.createDataFrame([(1, "a.md", src, "markdown"), (2, "b.txt", src, "text"), (3, "c", None, "text")], "doc_id int, path string, text string, lang string"))
    out = {r.doc_id: r for r in check(df, lang="lang", masked="masked").collect()}
    assert out[1].counts_by_rule == {"dramatic-fragment": 1, "filler-adverbs": 1, "overused-intensifiers": 1}
    assert out[2].counts_by_rule["overused-intensifiers"] == 2 and "staccato-burst" in out[2].counts_by_rule
    assert out[1].text_length == len(src.encode()) and out[3].violations == [] and out[3].text_length == 0
    for v in out[1].violations:
        assert src.encode()[v.start_index : v.end_index].decode() == v.matched_text
    order = [(v.start_index, v.end_index, v.rule_id) for v in out[2].violations]
    assert order == sorted(order)
    assert '"ruleId":"overused-intensifiers"' in report_json(check(df, lang="lang", masked="masked")).where("path = 'a.md'").first()["value"]


def test_translation():
    assert java(r"(?i)\ba\s[\s.]") .startswith("(?iu)(?-iu:") and "[\\t\\n\\f\\r .]" in java(r"[\s.]")


def test_find_all_matches_python(spark):
    import re

    texts = ["", "aa bb", "é a— b a", "xaax" * 20, "ab" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (r"a+", r"[^a]+", r"(^|\n)a", r"foo|b"):
        got = [[(s.start, s.end, s.m) for s in r.f] for r in df.select("t", find_all(F.col("t"), p).alias("f")).collect()]
        want = [[(len(t[: m.start()].encode()), len(t[: m.end()].encode()), m.group()) for m in re.finditer(p, t)] for t in texts]
        assert got == want


@pytest.mark.parametrize("rule,unit", [
    ("anaphora-abuse", "Water moves on. Water moves by. Water moves up. Birds sing now. Trees grow tall here. "),
    ("heres-the-kicker", "Here's the kicker. It ran. "),
    ("em-dash-pivot", "A word — and more.\n—\n"),
    ("negation-pivot", "Mayor doesn't walk in town anymore. Mayor rides a tall grey horse now. "),
    ("staccato-burst", "We ran. We hid. They came. Then it was over and everyone in the whole town went home to sleep for a while. "),
])
def test_long_hostile_documents(spark, rule, unit):
    """Twice the text takes about twice the time (with room for a busy machine), and gives twice the rows."""
    import time

    from quillmark.operators.detectors import detect

    took, rows = [], []
    for kb in (1, 256, 512):
        df = spark.createDataFrame([(1, unit * (kb * 1024 // len(unit.encode())))], "doc_id int, text string")
        t = time.time()
        rows.append(detect(df, rules=[rule]).select(F.size("violations")).first()[0])
        took.append(time.time() - t)
    assert rows[1] > 100 and abs(rows[2] - 2 * rows[1]) <= 3
    assert took[2] < 3.2 * took[1] + 2


def test_duplicates_in_long_lists(spark):
    from quillmark.operators.detectors import deduplicated, detect

    df = detect(spark.createDataFrame([(1, "A word — and more. " * 20_000)], "doc_id int, text string"), rules=["em-dash-pivot"])
    twice = df.withColumn("violations", F.concat("violations", F.reverse("violations")))
    assert deduplicated(twice).select(F.size("violations")).first()[0] == 20_000
    few = deduplicated(detect(spark.createDataFrame([(1, "A — b — c")], "doc_id int, text string"), rules=["em-dash-pivot"]).withColumn("violations", F.flatten(F.array("violations", F.reverse("violations")))))
    assert [v.start_index for v in few.first().violations] == [2, 8]


FILLERS = [" ", "\n", " \n", "\t", ".", "(", "A’", "1) a\n", "- a\n", "a", "not ", ", ", "Ab doesn't ", "\xa0"]


def test_padding_takes_no_time_in_any_rule(spark):
    """200,000 characters of one filler between words: no rule looks at a run from each of its places, and no list is too long for the stack."""
    import time

    row = lambda i, n: (i, "Why so? A fine day\n\nShort one.\n\nx" + FILLERS[i] * (n // len(FILLERS[i])) + "y is here. Not now. Not then.")
    took = []
    for n in (1000, 200_000):
        df = spark.createDataFrame([row(i, n) for i in range(len(FILLERS))], "doc_id int, text string").repartition(len(FILLERS), "doc_id")
        for _ in range(2 if n == 1000 else 1):
            t = time.time()
            rows = detect(df).select("doc_id", F.size("violations").alias("n")).collect()
            spent = time.time() - t
        took.append(spent)
        assert len(rows) == len(FILLERS)
    assert took[1] < took[0] + 1.5 * len(FILLERS), took


@pytest.mark.parametrize("text,rule,spans", [
    ("1.  \n2. b\n3. c\n4. d\n5. e", "listicle-instinct", [(0, 24)]),
    ("- a\n-  \n- c\n- d\n", "listicle-instinct", []),
    ("\n" * 40 + "The first. \n" + " \n" * 40 + "the second is it.", "listicle-trench-coat", [(40, 49), (132, 142)]),
    ("end.\n" + "\n" * 50 + "However, no.", "connector-addiction", [(3, 63)]),
    ("A (one bracket that is open ((((( and long) b ( open at the end of it all", "parenthetical-qualifier", [(2, 43)]),
    ("X’" + "AB" * 40 + " doesn't sing in church. X’" + "AB" * 40 + " plays the old organ.", "negation-pivot", [(0, 214)]),
    ("Hm... so? it rains. Why?? tail without an end", "question-then-answer", [(5, 19)]),
])
def test_runs_and_lists_as_before(spark, text, rule, spans):
    found = detect(spark.createDataFrame([(1, text)], "doc_id int, text string"), rules=[rule]).first()["violations"]
    assert [(v.start_index, v.end_index) for v in found] == spans


def test_letters_whose_lower_case_is_shorter(spark):
    """Long phrases fold every letter; offsets stay those of the original bytes, also behind letters that shrink."""
    text = "\u0130\u0130\u212a\u212a Here's the \u212aicker. Th\u0130nk of it as air. Let's unpac\u212a it. STUD\u0130ES SHOW it. It m\u0130ght, perhaps, wor\u212a."
    rules = ["heres-the-kicker", "pedagogical-aside", "vague-attribution", "hedge-stack"]
    found = detect(spark.createDataFrame([(1, text)], "doc_id int, text string"), rules=rules).first()["violations"]
    raw = text.encode()
    assert [(v.rule_id, v.matched_text) for v in found if v.rule_id != "hedge-stack"] == [
        ("heres-the-kicker", "Here's the \u212aicker"), ("pedagogical-aside", "Let's unpac\u212a"), ("pedagogical-aside", "Th\u0130nk of it as"), ("vague-attribution", "STUD\u0130ES SHOW"),
    ]
    assert all(raw[v.start_index : v.end_index].decode() == v.matched_text for v in found)
    assert [v.explanation for v in found if v.rule_id == "hedge-stack"] == ["Contains 2 hedges: perhaps, might"]


def test_sentences_of_the_only_paragraph_leave_out_blank_lines(spark):
    burst = "We ran. We hid. They came."
    rows = [(1, "\n\n" + burst), (2, " \n \n" + burst + "\n\n"), (3, burst + "\n\n \n"), (4, burst), (5, "\n" + burst + "\n")]
    found = detect(spark.createDataFrame(rows, "doc_id int, text string"), rules=["staccato-burst"]).collect()
    assert {r.doc_id: [(v.start_index, v.end_index) for v in r.violations] for r in found} == {1: [(2, 28)], 2: [(4, 30)], 3: [(0, 26)], 4: [(0, 26)], 5: [(0, 28)]}


def test_gates_let_every_entry_through(spark):
    """One word of each entry is looked for before its expression; beside a letter outside ASCII that patterns take for one of ASCII, any may stand."""
    lists = {"overused-intensifiers": P.INTENSIFIERS, "elevated-register": P.ELEVATED, "filler-adverbs": P.FILLERS, "unnecessary-contrast": P.CONTRASTS, "false-conclusion": [c for c in P.CONCLUSIONS if c != "overall,"],
             "connector-addiction": P.CONNECTORS, "heres-the-kicker": P.KICKERS, "pedagogical-aside": P.LESSONS, "vague-attribution": P.AUTHORITIES}
    rows = [(r, f"It ran. {e.capitalize()} it was so.") for r, entries in lists.items() for e in entries]
    rows += [("metaphor-crutch", f"A {m.replace('.', gap)}.") for m in P.METAPHORS for gap in ("", " ", "-")] + [("parenthetical-qualifier", f"So,\n{a}, it was.") for a in P.ASIDES]
    rows += [("false-conclusion", "Overall,so it was."), ("almost-hedge", "ſalmost always"), ("serves-as", "KKserves as"), ("filler-adverbs", "ſvery"), ("negation-pivot", "It isn’t all that far but late."), ("negation-pivot", "Ann can't sing in church. Ann plays the old organ.")]
    found = detect(spark.createDataFrame([(i, r, t) for i, (r, t) in enumerate(rows)], "doc_id int, rule string, text string")).collect()
    assert not [(r.rule, r.text) for r in found if r.rule not in {v.rule_id for v in r.violations}]


def test_lines_without_colon_are_passed_over(spark):
    """Less than half the time of one plain pass of the pattern, with the same matches."""
    import time

    text = ("Many words stand here in a row, and no mark ends them until the end of it. " * 40 + "Here is the rule: nobody may enter the yard today.\n") * 30
    df = spark.createDataFrame([(i, text) for i in range(40)], "doc_id int, text string").repartition(4).cache()
    plain = df.select(F.regexp_extract_all("text", F.lit(java(P.COLON)), F.lit(0)).alias("n"))
    rule = detect(df, rules=["colon-elaboration"]).select("violations")
    took = []
    for q in (plain, rule):
        best = 1e9
        for _ in range(3):
            t = time.time()
            q.write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - t)
        took.append(best)
    assert rule.select(F.sum(F.size("violations"))).first()[0] == plain.select(F.sum(F.size("n"))).first()[0] == 1200
    assert took[1] < 0.5 * took[0], took
