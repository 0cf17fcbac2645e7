from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from quillmark.functions import html_mask, markdown_mask, script_mask
from quillmark.operators.masking import LANGUAGES, Registry, UsageError, resolve_lang

MASKS = {"markdown": markdown_mask.mask, "html": html_mask.mask, **{d: (lambda t, d=d: script_mask.mask(t, d)) for d in script_mask.DIALECTS}}
BITS = st.lists(st.sampled_from(list("ab \n\t<>/\\`*-_#[](){}!\"'é=:;$1.") + ["```", "<li>", "</li>", "<script>", "<!--", "-->", "/*", "*/", "//", "${", "\n\n", "    ", "](", "---"]), max_size=60).map("".join)


@pytest.mark.parametrize("name", sorted(MASKS))
@settings(max_examples=120, deadline=None)
@given(text=BITS)
def test_mask_contract(name, text):
    masked, ranges = MASKS[name](text)
    src, out = text.encode(), masked.encode()
    assert len(src) == len(out)
    for a, b in zip(src, out):
        assert b == a or (b == 0x20 and a != 0x0A)
    for lo, hi, kind in ranges:
        assert 0 <= lo <= hi <= len(src) and kind


def _check(mask, src, keep, gone):
    masked, ranges = mask(src)
    for k in keep:
        assert k in masked, (k, masked)
    for g in gone:
        assert g not in masked, (g, masked)
    return [(src.encode()[a:b].decode(), k) for a, b, k in ranges]


def test_markdown():
    src = "---\ntitle: hidden\n---\n# Head\n\nProse with [label](http://x.y/z(1) \"tip\") and `span`, <http://auto.link> <b>bold</b>.\n\n```py\nfenced\n```\n\n- one\n- two\n  - three\n\nSetext\n---\n\n    indented\n\n[ref]: http://def.inition\n\n<div>\nblock\n</div>\n\n![alt text](img.png)\n"
    r = _check(markdown_mask.mask, src, ["Head", "label", "bold", "alt text", "three"], ["hidden", "x.y", "tip", "span", "auto", "fenced", "indented", "def.inition", "block", "img.png"])
    kinds = [k for _, k in r]
    assert kinds.count("heading") == 2 and kinds.count("list-item") == 3 and kinds.count("code-block") == 2
    assert ("# Head\n", "heading") in r


def test_markdown_unclosed_and_nested():
    _check(markdown_mask.mask, "text\n\n~~~\ncode to the end", ["text"], ["code to the end"])
    _check(markdown_mask.mask, "a `b and [c](", ["b and"], [])
    _check(markdown_mask.mask, "> quote `x`\n> more", ["quote", "more"], ["x"])


def test_html():
    r = _check(html_mask.mask, "<!DOCTYPE html><title>t1</title><h2 class='a>b'>Head</h2><ul><li>x<li>y</ul><script>if (a < b) '</p>'</script><pre>code</pre><!-- note -->A &amp; B <br/> end", ["Head", "x", "A &amp; B", "end"], ["t1", "class", "if (a", "</p>", "code", "note"])
    assert ("Head", "heading") in r and [k for _, k in r].count("list-item") >= 2 and ("code", "code-block") in r


def test_scripts():
    r = _check(lambda t: script_mask.mask(t, "js"), "/** doc */ // note\nconst a = 'str' + `t ${x + 'in'} u`; const b = /re'g/.test(y) / 2;", ["doc", "note", "str", "in"], ["const", "re", "test"])
    assert r[0][1] == "jsdoc" and r[1][1] == "comment"
    r = _check(lambda t: script_mask.mask(t, "jsx"), "const e = <A b=\"attr\" c={d}>Hello <i>you</i> {name}</A>; f();", ["attr", "Hello", "you"], ["name", "f();"])
    assert ("Hello ", "jsx-text") in r
    _check(lambda t: script_mask.mask(t, "ts"), "const m: Map<string, Array<number>> = f<T>('kept');", ["kept"], ["string", "number"])
    _check(lambda t: script_mask.mask(t, "tsx"), "const g = <T,>(x: T) => x; const h = <p>shown</p>;", ["shown"], ["=>"])
    for broken in ("'open", "`open ${", "/* open", "<a", "<a>open", "{{{", "/"):
        for d in script_mask.DIALECTS:
            script_mask.mask(broken, d)


def test_registry_and_languages():
    r = Registry()
    r.register("one", lambda t: (t, []), ".a")
    for bad in (("", ".b"), ("one", ".b"), ("two", "b"), ("two", ".A")):
        with pytest.raises(ValueError):
            r.register(bad[0], None, bad[1])
    assert LANGUAGES.names() == ["html", "js", "jsx", "markdown", "text", "ts", "tsx"]
    for flag, path, want in [(None, None, "text"), ("auto", "-", "text"), ("auto", "A.MD", "markdown"), ("", "x.htm", "html"), ("TSX", "x.md", "tsx"), ("text", "x.md", "text"), (None, "x.unknown", "text"), (None, "d.md/x", "text"), (None, ".md", "markdown")]:
        assert resolve_lang(flag, path) == want, (flag, path)
    with pytest.raises(UsageError):
        resolve_lang("cobol", None)


def test_deep_nesting_is_no_limit():
    from quillmark.functions.script_mask import mask as script

    n = 10_000
    for src, kept in [
        ("const a = " + "<b>in" * n + "</b>" * n + "; // the end", "in"), ("let t = " + "`x${" * n + "1" + "}`" * n + "; // the end", "x"), ("f = <p a={" * n + "1" + "}>t</p>" * n + "; // the end", "t"),
    ]:
        masked, ranges = script(src, "jsx")
        assert masked.endswith("// the end") and masked.count(kept) >= n and "const" not in masked and "let" not in masked
        assert len(masked) == len(src) and ranges[-1][2] == "comment"


def test_unclosed_backticks_take_linear_time():
    import time

    from quillmark.functions.markdown_mask import mask as markdown

    def took(n):
        t = time.process_time()
        markdown("word `` and ` more ``` x\n".replace("` ", "`") * 1 + "a ``` b " * n)
        return time.process_time() - t

    took(100)
    assert took(20_000) < 8 * took(5_000) + 0.5


#: name, mask, source, what stays, what goes
CASES = [
    ('def2', 'markdown', "[ref]:\n  http://far.away\n  'Old title'\n\nText stays.\n", ['Text stays'], ['far.away', 'Old title']),
    ('def-title-next', 'markdown', '[ref]: http://far.away\n"Old title"\n\nText stays.\n', ['Text stays'], ['far.away', 'Old title']),
    ('ref link', 'markdown', 'See [the words][ref] now.\n\n[ref]: /u\n', ['the words', 'now'], ['/u']),
    ('double tick', 'markdown', 'A ``code ` more`` b.\n', ['A ', 'b.'], ['code', 'more']),
    ('esc tick', 'markdown', 'A \\`not code\\` b.\n', ['not code'], []),
    ('fence info', 'markdown', '~~~js title\nx\n~~~\nafter\n', ['after'], ['x\n', 'js title']),
    ('fence longer', 'markdown', '````\n```\ninner\n````\nafter\n', ['after'], ['inner']),
    ('fence in list', 'markdown', '- item\n\n  ```\n  code\n  ```\n\n  tail\n', ['item', 'tail'], ['code']),
    ('quote fence', 'markdown', '> ```\n> code\n> ```\n> tail\n', ['tail'], ['code']),
    ('tilde not closed by tick', 'markdown', '~~~\na\n```\nb\n~~~\nafter\n', ['after'], ['a\n', 'b\n']),
    ('indent not in para', 'markdown', 'para\n    lazy words\n', ['lazy words'], []),
    ('setext1', 'markdown', 'Title\n=====\n\nbody\n', ['Title', 'body'], []),
    ('html comment', 'markdown', 'a\n\n<!-- gone\n\nstill -->\n\nkept\n', ['kept'], ['gone', 'still']),
    ('inline html', 'markdown', 'x <span class="robust">in</span> y\n', ['in', 'x ', 'y'], ['robust']),
    ('image', 'markdown', '![alt](a.png "tip") end\n', ['alt', 'end'], ['a.png', 'tip']),
    ('angle dest', 'markdown', "[l](<a b> 't') end\n", ['l', 'end'], ['a b']),
    ('nested brackets', 'markdown', '[a [b] c](dest) end\n', ['a [b] c', 'end'], ['dest']),
    ('email auto', 'markdown', '<me@x.org> kept\n', ['kept'], ['me@x.org']),
    ('crlf', 'markdown', '# H\r\n\r\n```\r\ncode\r\n```\r\nkept\r\n', ['H', 'kept'], ['code']),
    ('ordered', 'markdown', '1. one\n2) two\n', ['one', 'two'], []),
    ('front matter not first', 'markdown', 'x\n\n---\ny: z\n---\n', ['y: z'], []),
    ('table', 'markdown', '| a | b |\n|---|---|\n| c | d |\n', ['a', 'd'], []),
    ('html style', 'html', '<style>p{}</style><p>in</p>', ['in'], ['p{}']),
    ('html attr gt', 'html', '<a title="x>y">in</a>', ['in'], ['x>y']),
    ('html textarea', 'html', '<textarea>ta</textarea><kbd>k1</kbd><samp>s1</samp>', ['k1', 's1'], ['ta<', 'kbd']),
    ('html nested code', 'html', '<pre><b>b1</b></pre> out <code>c1<i>c2</i></code> end', ['out', 'end'], ['b1', 'c1', 'c2']),
    ('html unclosed', 'html', 'a < b and c > d', ['a', 'b and c'], []),
    ('html upper', 'html', '<SCRIPT>x1</SCRIPT><P>in</P>', ['in'], ['x1']),
    ('js regex', 'js', "a = b / c / d; // note\nx = /it's/; y = 'str';", ['note', 'str'], ["it's", ' c ']),
    ('js tpl nest', 'js', '`a ${`b ${c1} d`} e`', ['a ', 'b ', ' d', ' e'], ['c1']),
    ('js str esc', 'js', "x = 'don\\'t stop'; y1()", ['stop'], ['y1']),
    ('js import', 'js', "import a from 'mod-path'; x = 'kept';", ['kept'], []),
    ('jsx attr', 'jsx', "x = <A b='q1' {...c1}>t1 {'s1'} <B/>t2</A>;", ['q1', 't1', 's1', 't2'], ['c1']),
    ('jsx frag', 'jsx', 'x = <>t1<p>t2</p></>;', ['t1', 't2'], []),
    ('jsx cmp', 'jsx', "if (a<b && c>d) { e('k1') }", ['k1'], ['a<b']),
    ('ts gen', 'ts', "let a: Foo<'lit'> = b as Bar<string>; // n1", ['n1'], ['Bar']),
    ('tsx gen', 'tsx', 'const f = <T extends U>(a: T) => <p>t1</p>;', ['t1'], ['extends']),
    ('js hashbang', 'js', '#!/usr/bin/env node\n// n1\n', ['n1'], []),
    ('two definitions', 'markdown', '[a]: /u1\n[b]:\n/u2 (long\ntitle)\nwords [a]\n', ['words'], ['/u1', '/u2', 'long', 'title']),
    ('text after a title', 'markdown', '[a]: /u1\n"not a title" here\n', ['not a title', 'here'], ['/u1']),
    ('no destination', 'markdown', '[a]:\n\nkept [b]: inside\n', ['kept', 'inside'], []),
    ('definition in a quote', 'markdown', '> [a]:\n> /u1\n> kept\n', ['kept'], ['/u1']),
]


@pytest.mark.parametrize("name,mask,src,keep,gone", CASES, ids=[c[0] for c in CASES])
def test_cases(name, mask, src, keep, gone):
    _check(MASKS[mask], src, keep, gone)


def test_definitions_take_linear_time():
    import time

    def seconds(n):
        src = "[a]: /u (x\n" * n
        t = time.perf_counter()
        markdown_mask.mask(src)
        return time.perf_counter() - t

    seconds(1000)
    assert seconds(40_000) < 5 * max(seconds(20_000), 0.01)
