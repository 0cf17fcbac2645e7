"""Script masks: bytes kept, escapes whole, generics against elements, and time on hostile sources."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.functions.script_mask import DIALECTS, mask

PARTS = [
    *"ab1 \n\t<>/\\`*(){}[]!\"'=:;,.$&é€😀", "/*", "*/", "/**", "//", "${", "=>", "<p>", "</p>", "<T>", "<T,>", "<T extends U>", "(x: T) =>", "</T>", "<A b=", "/>", "<>", "</>", "\\u00e9", "\\x41",
    "\\é", "\\😀", "&amp;", "return ", "if (", "++", "?.", "\r\n", " ", "class ", "function ",
]


@pytest.mark.parametrize("dialect", sorted(DIALECTS))
@settings(max_examples=5000, deadline=None)
@given(text=st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_contract(dialect, text):
    masked, ranges = mask(text, dialect)
    src, out = text.encode(), masked.encode()
    assert len(src) == len(out)
    kept = bytearray(len(src))
    for lo, hi, kind in ranges:
        assert 0 <= lo < hi <= len(src) and kind in ("comment", "jsdoc", "string-literal", "jsx-text")
        kept[lo:hi] = b"\1" * (hi - lo)
    for a, b, k in zip(src, out, kept, strict=True):
        assert b == (a if k or a == 0x0A else 0x20)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))


#: dialects, source, all that is kept
CASES = [
    ("js jsx ts tsx", "x='caf\\é lait';", ["caf", " lait"]),
    ("js jsx ts tsx", "x=`a\\€b\\😀c`;", ["a", "b", "c"]),
    ("js jsx ts tsx", 'x="a\\' + r'u0041b\x41c\u{1F600}d\101e\nf\\";', list("abcdef")),
    ("js jsx ts tsx", "x = 'one\\\ntwo\\\r\nthree';", ["one", "two", "three"]),
    ("js ts", "a = b++ / 2; s = 'in'; c = d / 3;", ["in"]),
    ("js ts", "if (a) /it's/.test(b); s = 'in';", ["in"]),
    ("js ts", "x = (a + b) / c; s = 'in'; y = 1 / 2;", ["in"]),
    ("js ts", "x = {a: 1} / 2; s = 'in' / 3;", ["in"]),
    ("js ts", "function f() {} /it's/.exec(s); t = 'in';", ["in"]),
    ("js ts", "x = o.return / 2; s = 'in'; y = 3 / 4;", ["in"]),
    ("js ts", "x = o?.delete / 2; s = 'in'; y = 3 / 4;", ["in"]),
    ("js", "x = `a ${ {b: `c ${d}`} } e`;", ["a ", "c ", " e"]),
    ("js", "<!-- it's old\nx = 'in';", ["in"]),
    ("js jsx", "x = /[/'\"]/g; s = 'in';", ["in"]),
    ("jsx tsx", "x = <p title=\"a &amp; b\">one &nbsp;two</p>;", ["a ", " b", "one ", "two"]),
    ("jsx tsx", "x = <p>\n  <b>one</b>\n  two\n</p>;", ["one", "\n  two\n"]),
    ("jsx tsx", "x = <A.B c={<d>e</d>} f='g'>{h ? <i>j</i> : 'k'}</A.B>;", ["e", "g", "j", "k"]),
    ("jsx tsx", "x = a < b && <p>in</p>;", ["in"]),
    ("jsx tsx", "const f = () => { return <><p>a</p>b</>; }; // c", ["a", "b", "// c"]),
    ("jsx tsx", "if (a) <p>it's</p>; x = 'in';", ["it's", "in"]),
    ("jsx tsx", "x = <p>don't <b>/* text */</b> // text</p>;", ["don't ", "/* text */", " // text"]),
    ("tsx", "const f = <T,>(x: T) => <p>in</p>;", ["in"]),
    ("tsx", "const f = <T>(x: T): Array<T> => { return 'in'; };", ["in"]),
    ("tsx", "const f = <T extends { a: 'lit' }>(x: T) => x; const s = 'in';", ["lit", "in"]),
    ("tsx", "const f = <const T, U = string>(x: T, y: U): x is T => 'in';", ["in"]),
    ("tsx", "const f = <K extends keyof T & string, T = Map<K, (a: K) => void>>(x: T) => 'in'; g = <p>out</p>;", ["in", "out"]),
    ("tsx", "interface A { <T>(x: T): T; b: 'in' }", ["in"]),
    ("tsx", "type F = new <T>(x: T) => T; const s = 'in';", ["in"]),
    ("tsx", "x = <Foo<string> a='in'>text</Foo>;", ["in", "text"]),
    ("tsx", "x = <T>shown</T>; y = <T,>(a: T) => 'in';", ["shown", "in"]),
    ("tsx", "x = <b>(note): hello</b>;", ["(note): hello"]),
    ("ts", "function identity<T>(x: T): T { return x; } const a: Array<string> = [];", []),
    ("ts", "let a: Foo<'lit'> = <Bar>b; // n", ["lit", "// n"]),
    ("ts", "const f = async <T>(x: T) => /'/.test(x) ? 'a' : 'b';", ["a", "b"]),
    ("tsx", "function broken( { const x = `foo ${ <Bar>", ["foo "]),
]


@pytest.mark.parametrize("dialect,src,kept", [(d, s, k) for ds, s, k in CASES for d in ds.split()])
def test_what_stays(dialect, src, kept):
    masked, ranges = mask(src, dialect)
    raw = src.encode()
    assert [raw[a:b].decode() for a, b, _ in ranges] == kept
    assert masked.split() == " ".join(k.replace("\n", " ") for k in kept).split()


HOSTILE = {
    "open tags": "x = " + "(<a{0}>" * 1, "tags in attributes": "<a b={", "type lists": "(<T extends A<", "result types": "=<T>(x):a", "arrows": "=<T,>(x: T) =>", "generic in union": "|<T>(x):a",
    "brackets": "`${((((", "braces": "{(", "unclosed": "x=<p>{", "comparisons": "(a<b,", "escapes": "'\\", "amps": "x=<p>&a;", "slashes": "/", "closings": "x=<p></b>",
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
@pytest.mark.parametrize("dialect", ["jsx", "tsx"])
def test_hostile_sources_take_linear_time(name, dialect):
    def took(n):
        src = HOSTILE[name] * n + " </a></p></T> /> 'end"
        t = time.process_time()
        mask(src, dialect)
        return time.process_time() - t

    took(50)
    small, large = (min(took(n), took(n)) for n in (3000, 12_000))  # the better of two: the machine may be busy
    assert large < 8 * small + 0.5, (small, large)
