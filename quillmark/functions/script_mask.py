"""JavaScript-family masking: only comments, string contents and JSX text stay.

A lexer that tells division from regular expressions and blocks from objects by
the tokens before, follows template literals into their substitutions, and in the
jsx dialects reads elements. What `<` begins in tsx is found by trying: a list of
type parameters up to its own `>` and the arrow after its parameters, then a tag.
What was tried at an offset is remembered, so nothing is tried twice; a tag that
turns out to be none is taken back with all it kept. Malformed source ends a token
at the end of the text. What nests (templates, elements, tags, substitutions) are
generators that yield the part inside them to ``lex``, which keeps the stack, so
no depth is too deep.
"""

from __future__ import annotations

import re
from collections.abc import Generator

from quillmark.functions.html_mask import blank

DIALECTS = {"js": (True, False), "jsx": (True, False), "ts": (False, True), "tsx": (True, True)}
_SPACE = re.compile(rb"(?:\s|\xc2\xa0|\xef\xbb\xbf|\xe2\x80[\xa8\xa9])+")
_WORD = re.compile(rb"[A-Za-z0-9_$\x80-\xff]+")
_NAME = re.compile(rb"<(?:\s*(>)|\s*([A-Za-z_$\x80-\xff][\w$.:\x80-\xff-]*))")
_CLOSING = re.compile(rb"</\s*([\w$.:\x80-\xff-]*)")
#: A backslash and all that it escapes; a lone backslash at the end of the text is one too.
_ESCAPE = re.compile(rb"\\(?:[0-7]{1,3}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]+\}|\r\n|[\xc0-\xff][\x80-\xbf]*|[\x00-\x7f])?")
_PLAIN = {34: re.compile(rb'[^"\\\r\n]*'), 39: re.compile(rb"[^'\\\r\n]*"), 96: re.compile(rb"(?:[^`\\$]|\$(?!\{))*")}
_REFERENCE = re.compile(rb"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_JSX_TEXT = re.compile(rb"[^<{]*")
#: Text of an element counts unless it is blank but for what follows a line's end.
_BLANK = re.compile(rb"(?:\n\s*)?\Z")
#: Words after which an expression begins, so '/' is a regular expression and '<' an element.
_BEFORE_VALUE = set(b"return typeof instanceof in of new delete void throw case do else yield await default extends".split())
#: Words whose parentheses are followed by a statement.
_HEADS = set(b"if while for with".split())
#: Tokens after which '{' begins a block.
_BEFORE_BLOCK = {b"", b";", b"{", b"}", b")", b"=>", *b"else do try finally".split()}
_OPEN, _CLOSE = b"([{<", {41: 40, 93: 91, 125: 123}


#: Yields the steps of a nested part and is sent its result.
Steps = Generator["Steps", object, object]


def lex(steps: Steps) -> object:
    """The result of ``steps``, nested ones on a stack of their own."""
    stack, result = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(result))
            result = None
        except StopIteration as end:
            stack.pop()
            result = end.value
    return result


class Lexer:
    def __init__(self, src: bytes, jsx: bool, typed: bool):
        self.s, self.n, self.jsx, self.typed = src, len(src), jsx, typed
        self.spans: list[tuple[int, int, str]] = []
        self.value_next = True  # an expression may begin here
        self.before = b""  # the last token: a word or a mark
        self.types: dict[int, int] = {}  # by offset of '<', the offset after its '>', or -1
        self.arrows: dict[int, bool] = {-1: False}  # by offset in a result type, whether an arrow ends it
        self.no_element: set[int] = set()
        self.closings: dict[bytes, int] | None = None

    def keep(self, lo: int, hi: int, kind: str) -> None:
        if hi > lo:
            self.spans.append((lo, hi, kind))

    def comment(self, i: int) -> int:
        if self.s.startswith((b"//", b"#!"), i):
            e = self.s.find(b"\n", i)
            e = self.n if e < 0 else e
            self.keep(i, e, "comment")
            return e
        e = self.s.find(b"*/", i + 2)
        e = self.n if e < 0 else e + 2
        self.keep(i, e, "jsdoc" if self.s.startswith(b"/**", i) else "comment")
        return e

    def string(self, i: int) -> int:
        """An escape, whole, is no part of a fragment."""
        q, j = self.s[i], i + 1
        while True:
            e = _PLAIN[q].match(self.s, j).end()
            self.keep(j, e, "string-literal")
            if self.s[e : e + 1] != b"\\":
                return e + 1 if e < self.n and self.s[e] == q else e
            j = _ESCAPE.match(self.s, e).end()

    def template(self, i: int) -> Steps:
        j = i + 1
        while True:
            e = _PLAIN[96].match(self.s, j).end()
            self.keep(j, e, "string-literal")
            if e >= self.n or self.s[e] == 96:
                return min(self.n, e + 1)
            if self.s[e] == 92:
                j = _ESCAPE.match(self.s, e).end()
            else:
                self.value_next, self.before = True, b"("
                j = yield self.code(e + 2, b"}")

    def regexp(self, i: int) -> int:
        j, inside = i + 1, False
        while j < self.n and self.s[j] != 10:
            c = self.s[j]
            if c == 92:
                j += 1
            elif c == 91:
                inside = True
            elif c == 93:
                inside = False
            elif c == 47 and not inside:
                m = _WORD.match(self.s, j + 1)
                return m.end() if m else j + 1
            j += 1
        return i + 1  # no end on this line: a division after all

    def skip(self, i: int) -> int:
        """Past white space and comments, which aren't kept."""
        while i < self.n:
            if m := _SPACE.match(self.s, i):
                i = m.end()
            elif self.s.startswith(b"//", i):
                i = self.s.find(b"\n", i) % (self.n + 1)
            elif self.s.startswith(b"/*", i):
                e = self.s.find(b"*/", i + 2)
                i = self.n if e < 0 else e + 2
            else:
                break
        return i

    def balanced(self, i: int) -> int:
        """The offset after the bracket that closes the one at i, or -1; what '<' inside close is remembered as well."""
        if i in self.types:
            return self.types[i]
        stack, j = [], i
        while j < self.n:
            j = self.skip(j)
            if j >= self.n:
                break
            c = self.s[j]
            if c in (34, 39, 96):
                e = self.s.find(bytes([c]), j + 1)
                j = self.n if e < 0 else e + 1
                continue
            if self.s.startswith(b"=>", j):
                j += 2
                continue
            if c in _OPEN:
                stack.append((c, j))
            elif c == 62 or c in _CLOSE:
                # a bracket other than '>' closes its like: any '<' since was no bracket
                while stack and c != 62 and stack[-1][0] == 60:
                    self.types[stack.pop()[1]] = -1
                if not stack or stack[-1][0] != _CLOSE.get(c, 60):
                    if c == 62:  # a comparison
                        j += 1
                        continue
                    break
                at = stack.pop()[1]
                self.types[at] = j + 1
                if not stack:
                    return j + 1
            elif c == 59 and stack and stack[-1][0] == 60:
                break
            j += 1
        for _, at in stack:
            self.types[at] = -1
        return self.types.setdefault(i, -1)

    def generic_arrow(self, i: int) -> bool:
        """Whether type parameters begin at '<', then parameters, a result type perhaps, and an arrow."""
        e = self.balanced(i)
        if e < 0:
            return False
        j = self.skip(e)
        if self.s[j : j + 1] != b"(" or (j := self.balanced(j)) < 0:
            return False
        j = self.skip(j)
        return self.result_type(self.skip(j + 1)) if self.s[j : j + 1] == b":" else self.s.startswith(b"=>", j)

    def result_type(self, j: int) -> bool:
        """Whether an arrow follows the type at j."""
        passed = []
        while j not in self.arrows:
            passed.append(j)
            if j >= self.n or self.s.startswith((b"=>", b"</", b";", b",", b"="), j):
                self.arrows[j] = self.s.startswith(b"=>", j)
                break
            j = self.balanced(j) if self.s[j] in _OPEN else j + 1
            j = self.skip(j) if j > 0 else -1
        self.arrows.update(dict.fromkeys(passed, self.arrows[j]))
        return self.arrows[j]

    def closed_later(self, name: bytes, i: int) -> bool:
        """Whether a closing tag of the name stands after i."""
        if self.closings is None:
            self.closings = {m.group(1): m.start() for m in _CLOSING.finditer(self.s)}
        return self.closings.get(name, -1) > i

    def element_begins(self, i: int) -> bytes | None:
        """The name of the element that begins at '<' ('' for a fragment), if one can."""
        if not self.jsx or not self.value_next or i in self.no_element:
            return None
        m = _NAME.match(self.s, i)
        if not m:
            return None
        name = m.group(2) or b""
        if self.typed and name:
            after = self.skip(m.end())
            plain = self.s[after : after + 1] == b">" and self.closed_later(name, i)
            if self.s[after : after + 1] in (b",", b"=") or (not plain and self.generic_arrow(i)):
                return None
        return name

    def element(self, i: int, name: bytes, sure: bool = False) -> Steps:
        """From '<' to the end of the element, or None if there is none after all; within another element one is sure."""
        kept, state = len(self.spans), (self.value_next, self.before)
        j, closed = yield self.tag(i, name)
        if closed:
            return j
        if self.typed and not sure and j < self.n and not self.closed_later(name, i):
            self.no_element.add(i)
            del self.spans[kept:]
            self.value_next, self.before = state
            return None
        while j < self.n:
            e = _JSX_TEXT.match(self.s, j).end()
            self.text(j, e)
            if e >= self.n:
                break
            if self.s[e] == 123:
                self.value_next, self.before = True, b"("
                j = yield self.code(e + 1, b"}")
            elif _CLOSING.match(self.s, e):
                e = self.s.find(b">", e)
                return self.n if e < 0 else e + 1
            else:
                m = _NAME.match(self.s, e)
                j = (yield self.element(e, m.group(2) or b"", sure=True)) if m else e + 1
        return self.n

    def text(self, lo: int, hi: int, kind: str = "jsx-text") -> None:
        """Text without its character references."""
        for m in _REFERENCE.finditer(self.s, lo, hi):
            self.piece(lo, m.start(), kind)
            lo = m.end()
        self.piece(lo, hi, kind)

    def piece(self, lo: int, hi: int, kind: str) -> None:
        if kind != "jsx-text" or not _BLANK.match(self.s[lo:hi]):
            self.keep(lo, hi, kind)

    def tag(self, i: int, name: bytes) -> Steps:
        """The offset after an opening tag and whether it closes itself."""
        j = self.s.find(name, i) + len(name) if name else i + 1
        if self.typed and self.s[j : j + 1] == b"<" and (e := self.balanced(j)) > 0:
            j = e
        while j < self.n:
            c = self.s[j]
            if c == 62:
                return j + 1, self.s[j - 1] == 47
            if c in (34, 39):
                e = self.s.find(bytes([c]), j + 1)
                e = self.n if e < 0 else e
                self.text(j + 1, e, "string-literal")
                j = min(self.n, e + 1)
            elif c == 123:
                self.value_next, self.before = True, b"("
                j = yield self.code(j + 1, b"}")
            elif self.s.startswith((b"//", b"/*"), j):
                j = self.comment(j)
            else:
                j += 1
        return self.n, True

    def code(self, i: int, until: bytes = b"") -> Steps:
        """Code up to the bracket that closes it (its offset plus one), or to the end."""
        brackets: list[tuple[bytes, bool]] = []  # and whether an expression may begin after each
        s, depth = self.s, 0
        while i < self.n:
            if m := _SPACE.match(s, i):
                i = m.end()
                continue
            c = s[i : i + 1]
            if s.startswith((b"//", b"/*"), i) or (i == 0 and s.startswith(b"#!")):
                i = self.comment(i)
                continue
            token, value = c, False
            if c in b"\"'":
                i = self.string(i)
            elif c == b"`":
                i = yield self.template(i)
            elif c == b"/" and self.value_next:
                i = self.regexp(i)
            elif m := _WORD.match(s, i):
                token, i = m.group(), m.end()
                value = token in _BEFORE_VALUE and self.before not in (b".", b"?.")
            elif c == b"<" and (name := self.element_begins(i)) is not None:
                e = yield self.element(i, name)
                i, value = (i + 1, True) if e is None else (e, False)
            elif s.startswith(b"<!--", i):
                e = s.find(b"\n", i)
                i = self.n if e < 0 else e
                continue
            elif s.startswith((b"++", b"--"), i):
                token, value, i = s[i : i + 2], self.value_next, i + 2
            elif s.startswith((b"=>", b"?."), i):
                token, value, i = s[i : i + 2], True, i + 2
            else:
                value = c not in b")]"
                if c == b"(":
                    brackets.append((c, self.before in _HEADS))
                elif c == b"{":
                    brackets.append((c, not self.value_next or self.before in _BEFORE_BLOCK))
                    depth += 1
                elif c == b")" and brackets and brackets[-1][0] == b"(":
                    value = brackets.pop()[1]
                elif c == b"}" and depth:
                    depth -= 1
                    while brackets[-1][0] != b"{":
                        brackets.pop()
                    value = brackets.pop()[1]
                elif c == b"}" and until:
                    self.value_next, self.before = False, c
                    return i + 1
                i += 1
            self.value_next, self.before = value, token
        return self.n


def mask(text: str, dialect: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The masked text and its ranges (start, end, kind) in bytes, in document order."""
    src = text.encode("utf-8", "surrogatepass")
    lexer = Lexer(src, *DIALECTS[dialect])
    lex(lexer.code(0))
    buf = bytearray(src)
    blank(buf, 0, len(buf))
    spans = sorted(lexer.spans)
    for lo, hi, _ in spans:
        buf[lo:hi] = src[lo:hi]
    return buf.decode("utf-8", "surrogatepass"), spans
