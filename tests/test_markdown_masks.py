"""Markdown masks: containers, lazy lines, brackets against definitions, the golden file, time on hostile sources."""

import json
import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.functions.markdown_mask import mask

GOLDEN = os.path.join(os.path.dirname(__file__), "golden")
PARTS = [*"ab1 \n\t<>/\\`*-_#[](){}!\"'é=:;.>+~|", "```", "~~~", "\n\n", "    ", "> ", "- ", "1. ", "](", "](u)", "[a]", "[a]: /u\n", "---\n", "===\n", "<!--", "-->", "<div>\n", "<b x='y'>", "\r\n", "\n> ", "\n  ", "😀"]


@settings(max_examples=3000, deadline=None)
@given(text=st.lists(st.sampled_from(PARTS), max_size=50).map("".join))
def test_contract(text):
    masked, ranges = mask(text)
    src, out = text.encode(), masked.encode()
    assert len(src) == len(out)
    for a, b in zip(src, out, strict=True):
        assert b == a or (b == 0x20 and a != 0x0A)
    for lo, hi, kind in ranges:
        assert 0 <= lo < hi <= len(src) and kind in ("heading", "list-item", "code-block")
    assert ranges == sorted(ranges, key=lambda r: (r[0], r[1]))


#: source, words that stay, words that go
CASES = [
    ("> > deep quote\nlazy one\n>     lazy two\n", "deep lazy one two", ""),
    ("> ```\n> gone\nstays\n", "stays", "gone"),
    ("> para\n\n    gone\n", "para", "gone"),
    ("- item\n\n      gone\n\n  stays\n", "item stays", "gone"),
    ("- item\nlazy\n\n  more\n", "item lazy more", ""),
    ("-\n\n  stays\n", "stays", ""),
    ("-\n  stays\n", "stays", ""),
    ("1. a\n\n       gone\n", "a", "gone"),
    ("1) one\n   - two\n     > three\n     > ```\n     > gone\n     > ```\n     > four\n", "one two three four", "gone"),
    ("- ```\n  gone\n  ```\n  stays\n", "stays", "gone"),
    ("para\n2. stays in it\n-\n", "para stays in it", ""),
    ("> <div>\n> gone\nstays\n", "stays", "gone"),
    ("<div>\ngone\n\nstays\n", "stays", "gone"),
    ("<script>\ngone\n\nalso\n</script> too\nstays\n", "stays", "gone also too"),
    ("<b>\ngone\n\npara\n<b>\nstays\n", "para stays", "gone"),
    ("\tgone\n\n \tgone2\n", "", "gone gone2"),
    ("-\tone\n\n\ttwo\n\n\t\tgone\n", "one two", "gone"),
    ("> [a]: /gone\n> 'gone2'\n\n[x][a] stays\n", "x stays", "gone gone2"),
    ("[a]: /gone\n[b]: /gone2 \"t\nu\"\nstays\n", "stays", "gone gone2"),
    ("[a]: /gone 'bad' word\n", "gone bad word", ""),
    ("[x [y](gone) z](stays)\n", "x y z stays", "gone"),
    ("[x ![y](gone) z](gone2)\n", "x y z", "gone gone2"),
    ("![x [y](gone) z](gone2)\n", "x y z", "gone gone2"),
    ("[x [Y] z](stays)\n\n[y]: /gone\n", "x Y z stays", "gone"),
    ("[x [y] z](gone)\n", "x y z", "gone"),
    ("[a][b](stays)\n\n[b]: /gone\n", "a b stays", "gone"),
    ("[a][b](gone)\n", "a b", "gone"),
    ("[a `](stays)` b](gone)\n", "a b", "gone stays"),
    ("[a <http://x.y/](z)> b](gone)\n", "a b", "gone x.y"),
    ("[a](b (c (d) e)\n", "a b c d e", ""),
    ("[a](<gone it> 'gone2') [b](un closed\n", "a b un closed", "gone gone2"),
    ("[a](\nstays) [b](gone 'over\nlines')\n", "a stays b", "gone over lines"),
    ("\\[a](stays) \\`b\\` [c\\](stays2)\n", "a stays b c stays2", ""),
    ("a `b``c` d ``e` f``\n", "a d", "b c e f"),
    ("> a `gone\n> gone2` b\n", "a b", "gone gone2"),
    ("<a@b.cc> <xx:y> <not auto link> <b c='d'>e</b> <!-- g --> <? h ?> f\n", "e f", "a@b.cc xx:y"),
    ("a <b\nc='gone'> d\n", "a d", "gone"),
    ("# [a](gone) `gone2` #\n\nb\n===\n", "a b", "gone gone2"),
    ("a\n---\n***\n- - -\n_ _ _\nb\n", "a b", ""),
    ("~~~ info\ngone ```\n~~~~\nstays\n", "stays", "info gone"),
    ("``` a`b\nstays\n", "stays a", ""),
    ("---\na: gone\n---\nstays\n", "stays", "gone"),
    ("a\r\n\r\n```\r\ngone\r\n```\r\n\r\n> [b](gone2)\r\n", "a b", "gone gone2"),
]


@pytest.mark.parametrize("src,stays,goes", CASES)
def test_what_stays(src, stays, goes):
    masked = mask(src)[0]
    for w in stays.split():
        assert w in masked, (w, masked)
    for w in goes.split():
        assert w not in masked, (w, masked)


def test_ranges_of_containers():
    src = "> - a\n>   b\n> - c\n\n# H\n\nT\nU\n---\n- x\n  1. y\n\n- \n"
    found = [(src[lo:hi], kind) for lo, hi, kind in mask(src)[1]]
    assert found == [("> - a\n>   b\n", "list-item"), ("> - c\n", "list-item"), ("# H\n", "heading"), ("T\nU\n---\n", "heading"), ("- x\n  1. y\n", "list-item"), ("  1. y\n", "list-item")]


def test_golden(spark):
    """The report of the sample in markdown mode, as committed; rewrite it with REWRITE_GOLDEN=1 and read the difference."""
    from quillmark.operators.masking import mask as masked
    from quillmark.operators.report import check, exploded

    src = open(f"{GOLDEN}/sample.md", encoding="utf-8").read()
    df = check(masked(spark.createDataFrame([(1, src, "markdown")], "doc_id int, text string, lang string")), lang="lang", masked="masked")
    got = [r.asDict() for r in exploded(df).orderBy("pos").collect()]
    assert all(src.encode()[r["start_index"] : r["end_index"]].decode() == r["matched_text"] for r in got)
    path = f"{GOLDEN}/sample.json"
    if os.environ.get("REWRITE_GOLDEN"):
        with open(path, "w", encoding="utf-8") as f:
            json.dump(got, f, indent=1, ensure_ascii=False)
            f.write("\n")
    assert got == json.load(open(path, encoding="utf-8"))


HOSTILE = ["> ", "- ", "[", "[a](", "[a](b ", "![", "[a][b]", "`" "a``", "<!-- ", "<a ", "<a b='", "[a](b)", "[" * 9 + "]", "[a]: /u\n", "    a\n", "> a\n", "1. a\n", "```\n", "<?x ", "\\[", "a\n===\n", "[a](<", "\t"]


@pytest.mark.parametrize("unit", HOSTILE)
def test_hostile_sources_take_linear_time(unit):
    def took(n):
        t = time.process_time()
        mask(unit * n + "]end")
        return time.process_time() - t

    deep = unit in ("> ", "- ")  # containers: a line's time is its depth
    took(50)
    small, large = (min(took(n), took(n)) for n in (1000, 4000))  # the better of two: the machine may be busy
    assert large < (20 if deep else 8) * small + 0.5, (small, large)
