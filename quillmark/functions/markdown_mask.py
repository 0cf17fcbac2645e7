"""Markdown masking after CommonMark: code, markup and link targets become spaces.

Two passes. Blocks are read line by line with a stack of containers (block
quotes, list items), lazy continuation lines, and one open leaf: a paragraph,
code, a fence or an HTML block. Then the inline structure of paragraphs and
headings, over their lines without what the containers put before them: code
spans, autolinks and inline HTML first come, brackets on a stack of their own
against the table of all reference definitions, since a link holds no other link.

What goes is front matter, code, HTML, autolinks, definitions and the targets of
inline links and images; a target that runs over lines outside its title stays.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from quillmark.functions.html_mask import blank

_FRONT = re.compile(rb"\A---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_FENCE = re.compile(rb"(`{3,}(?=[^`\n]*$)|~{3,})", re.M)
_ATX = re.compile(rb"#{1,6}(?:[ \t]|\r?$)")
_SETEXT = re.compile(rb"(?:=+|-+)[ \t]*\r?$")
_RULE = re.compile(rb"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\r?$")
_ITEM = re.compile(rb"([-+*]|\d{1,9}[.)])(?=[ \t\r]|$)")
_TICKS = re.compile(rb"`+")
_LABEL = re.compile(rb"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
_PUNCTUATION = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SPECIAL = re.compile(rb"[\\`<\[\]]")
#: Brackets that may be open within a bare link target.
_DEEP = 32
#: A definition; its destination and its title may each begin on a line of their own, and a title may run over lines.
_DEF = re.compile(rb"\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|\Z)", re.S)
#: Names that begin an HTML block of the sixth kind.
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section "
    "summary table tbody td tfoot th thead title tr track ul"
).split()
_HTML = [
    (re.compile(rb"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(rb"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(rb"<!--"), re.compile(rb"-->")),
    (re.compile(rb"<\?"), re.compile(rb"\?>")),
    (re.compile(rb"<![A-Za-z]"), re.compile(rb">")),
    (re.compile(rb"<!\[CDATA\["), re.compile(rb"\]\]>")),
    (re.compile(rb"</?(?:" + "|".join(_BLOCK_TAGS).encode() + rb")(?:[\s>]|/>|$)", re.I), None),
]
_ATTR = rb"(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
_TAG = re.compile(rb"<(?:[A-Za-z][A-Za-z0-9-]*" + _ATTR + rb"*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*)>")
_INLINE_HTML = re.compile(_TAG.pattern + rb"|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_AUTO = re.compile(rb"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?)>")


class _Line:
    """A line without its end, and how far into it, in bytes and in columns, containers reach."""

    def __init__(self, body: bytes):
        self.body, self.pos, self.col = body, 0, 0

    def indent(self) -> int:
        """Columns of white space from here on."""
        i, c = self.pos, self.col
        while i < len(self.body) and self.body[i] in b" \t":
            c += 4 - c % 4 if self.body[i] == 9 else 1
            i += 1
        return c - self.col

    def advance(self, columns: int) -> None:
        """Past so many columns of white space; a tab may be passed in part."""
        end = self.col + columns
        while self.pos < len(self.body) and self.col < end and self.body[self.pos] in b" \t":
            wide = 4 - self.col % 4 if self.body[self.pos] == 9 else 1
            if self.col + wide > end:
                self.col = end
                return
            self.col, self.pos = self.col + wide, self.pos + 1

    def mark(self, size: int) -> None:
        self.pos, self.col = self.pos + size, self.col + size

    def rest(self) -> bytes:
        return self.body[self.pos :].lstrip(b" \t")

    def quote(self) -> bool:
        """Past a block quote's mark, if one stands here."""
        deep = self.indent()
        if deep > 3 or not self.rest().startswith(b">"):
            return False
        self.advance(deep)
        self.mark(1)
        self.advance(1)
        return True


class _Reader:
    def __init__(self, src: bytes):
        self.src, self.masks, self.ranges = src, [], []
        self.inline: list[list[tuple[int, int]]] = []  # lines of each paragraph or heading
        self.references: set[bytes] = set()
        self.containers: list[dict] = []  # a quote has no width; an item has that of its content's indent
        self.para: list[tuple[int, int]] = []
        self.indented: list[int] | None = None
        self.open: dict | None = None  # a fence or an HTML block

    def code(self, lo: int, hi: int) -> None:
        if hi > lo:
            self.masks.append((lo, hi))
            self.ranges.append((lo, hi, "code-block"))

    # ------------------------------------------------------------ blocks

    def lines(self):
        at = 0
        for x in self.src.splitlines(keepends=True) if not re.search(rb"[\r\x0b\x0c]", self.src) else re.findall(rb"[^\n]*\n|[^\n]+", self.src):
            yield at, at + len(x)
            at += len(x)

    def reach(self, hi: int) -> None:
        for c in self.containers:
            c["hi"] = hi

    def close_leaf(self) -> None:
        if self.para:
            rest = self.definitions(self.para)
            if rest:
                self.inline.append(rest)
            self.para = []
        if self.indented:
            self.code(*self.indented)
            self.indented = None
        if self.open:
            if "mark" in self.open:
                self.code(self.open["lo"], self.open["hi"])
            else:
                self.masks.append((self.open["lo"], self.open["hi"]))
            self.open = None

    def close_to(self, depth: int) -> None:
        if len(self.containers) > depth:
            self.close_leaf()
        while len(self.containers) > depth:
            c = self.containers.pop()
            if "width" in c and c["hi"] is not None:
                self.ranges.append((c["lo"], c["hi"], "list-item"))

    def goes_on(self, line: _Line, c: dict, lo: int) -> bool:
        if "width" not in c:
            return line.quote()
        if not line.rest().strip():
            return c["hi"] is not None  # an item that began with a blank line has one at most
        if line.indent() < c["width"]:
            return False
        line.advance(c["width"])
        return True

    def read(self, start: int) -> None:
        for lo, hi in self.lines():
            if hi > start:
                line, depth = _Line(self.src[lo:hi].rstrip(b"\n")), 0
                while depth < len(self.containers) and self.goes_on(line, self.containers[depth], lo):
                    depth += 1
                self.line(line, depth, lo, hi)
        self.close_leaf()
        self.close_to(0)

    def line(self, line: _Line, depth: int, lo: int, hi: int) -> None:
        """A line in the containers up to ``depth``."""
        here, whole = line.rest(), depth == len(self.containers)
        if self.open and whole:
            if self.leaf_goes_on(line, here, hi):
                return
        elif self.open:
            self.close_leaf()
        if not here.strip():
            if self.para:
                self.close_leaf()
            self.close_to(depth)
            return
        fresh = False  # a container began on this line
        while True:
            deep, here = line.indent(), line.rest()
            if deep >= 4:
                if self.para:
                    break
                if not (self.indented and whole and not fresh):
                    self.close_to(depth)
                    self.close_leaf()
                    line.advance(4)
                    self.indented = [lo + line.pos, hi]
                self.indented[1] = hi
                self.reach(hi)
                return
            begins = self.para and whole and not fresh  # what begins here would interrupt a paragraph
            if here[:1] == b">":
                self.close_to(depth)
                self.close_leaf()
                line.quote()
                self.containers.append({"hi": None})
            elif begins and _SETEXT.match(here) and (rest := self.definitions(self.para)):
                self.inline.append(rest)
                self.ranges.append((self.src.rfind(b"\n", 0, rest[0][0]) + 1, hi, "heading"))
                self.para = []
                self.reach(hi)
                return
            elif self.starts_leaf(line, here, depth, lo, hi, begins):
                return
            elif (m := _ITEM.match(here)) and not _RULE.match(here) and not (begins and (not here[m.end() :].strip() or (m.group(1)[:1].isdigit() and m.group(1)[:-1] != b"1"))):
                self.close_to(depth)
                self.close_leaf()
                line.advance(deep)
                line.mark(m.end())
                pad = line.indent()
                empty = not line.rest().strip()
                line.advance(1 if pad > 4 or empty else pad)
                self.containers.append({"hi": None, "lo": lo, "width": deep + m.end() + (1 if pad > 4 or empty else pad)})
                if empty:
                    return
            else:
                break
            depth, fresh = len(self.containers), True
            if not line.rest().strip():
                return
        if not (self.para and not fresh):  # else it goes on, lazily perhaps
            self.close_to(depth)
            self.close_leaf()
        self.para.append((hi - len(self.src[lo + line.pos : hi].lstrip(b" \t")), hi))
        self.reach(hi)

    def leaf_goes_on(self, line: _Line, here: bytes, hi: int) -> bool:
        """A line of an open fence or HTML block; False where the line isn't part of it."""
        leaf = self.open
        if "mark" in leaf:
            leaf["hi"] = hi
            closing = re.compile(rb"(?:" + re.escape(leaf["mark"][:1]) + rb"){%d,}[ \t]*\r?$" % len(leaf["mark"])).match(here)
            if closing and line.indent() <= 3:
                self.close_leaf()
        elif leaf["end"] is None and not here.strip():
            self.close_leaf()
            return False
        else:
            leaf["hi"] = hi
            if leaf["end"] is not None and leaf["end"].search(line.body, line.pos):
                self.close_leaf()
        self.reach(hi)
        return True

    def starts_leaf(self, line: _Line, here: bytes, depth: int, lo: int, hi: int, begins: bool) -> bool:
        """Opens a fence, an HTML block, a heading or a break, if one begins here."""
        at = hi - len(self.src[lo + line.pos : hi].lstrip(b" \t"))
        kind = None
        if here[:1] == b"<":
            kind = next(((a, e) for a, e in _HTML if a.match(here)), None)
            if kind is None and not self.para and (m := _TAG.match(here)) and not here[m.end() :].strip():
                kind = (None, None)
        m = _FENCE.match(here)
        if not (kind or m or _ATX.match(here) or _RULE.match(here)):
            return False
        self.close_to(depth)
        self.close_leaf()
        self.reach(hi)
        if kind:
            self.open = {"lo": at, "hi": hi, "end": kind[1]}
            if kind[1] is not None and kind[1].search(here):
                self.close_leaf()
        elif m:
            self.open = {"mark": m.group(1), "lo": lo, "hi": hi}
        elif _ATX.match(here):
            self.inline.append([(at, hi)])
            self.ranges.append((lo, hi, "heading"))
        return True

    def definitions(self, para: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The lines after the reference definitions that a paragraph begins with; these go."""
        done = at = 0
        body = b"\n".join(self.src[lo:hi].strip() for lo, hi in para) if self.src[para[0][0] : para[0][0] + 1] == b"[" else b""
        while done < len(para) and (m := _DEF.match(body, at)):
            lines = body.count(b"\n", at, m.end()) + (body[m.end() - 1 : m.end()] != b"\n")
            self.masks.append((para[done][0], para[done + lines - 1][1]))
            self.references.add(_label(m.group(1)))
            done, at = done + lines, m.end()
        return para[done:]

    # ------------------------------------------------------------ inlines

    def inlines(self) -> None:
        for lines in self.inline:
            starts, at = [], 0
            for lo, hi in lines:
                starts.append(at)
                at += hi - lo
            text = b"".join(self.src[lo:hi] for lo, hi in lines)

            def source(i: int, starts=starts, lines=lines) -> int:
                k = bisect_right(starts, i) - 1
                return lines[k][0] + i - starts[k]

            self.masks += [(source(a), source(b - 1) + 1) for a, b in _inline(text, self.references)]


def _label(raw: bytes) -> bytes:
    return b" ".join(raw.decode("utf-8", "replace").casefold().encode().split())


def _inline(s: bytes, references: set[bytes]) -> list[tuple[int, int]]:
    """What goes of a paragraph's or heading's text."""
    out: list[tuple[int, int]] = []
    opened: list[tuple[int, bool]] = []  # offset and whether it is an image's
    dead = 0  # so many of them can't begin a link, since one stands inside
    newest = -1  # the last bracket that opened
    unclosed: set[int] = set()  # sizes of backtick runs that nothing closes in the rest of the text
    shut: dict[bytes, bool] = {}  # by what begins inline HTML, whether its end still comes
    i, n = 0, len(s)
    while (m := _SPECIAL.search(s, i)) is not None:
        i = m.start()
        c = m.group()
        if c == b"\\":
            i += 2 if i + 1 < n and s[i + 1] in _PUNCTUATION else 1
        elif c == b"`":
            run = _TICKS.match(s, i).end() - i
            m = None if run in unclosed else re.compile(rb"(?<!`)`{%d}(?!`)" % run).search(s, i + run)
            if m is None:
                unclosed.add(run)
            else:
                out.append((i, m.end()))
            i = m.end() if m else i + run
        elif c == b"<":
            m = _AUTO.match(s, i) or _html(s, i, shut)
            if m:
                out.append((i, m.end()))
            i = m.end() if m else i + 1
        elif c == b"[":
            opened.append((i, i > 0 and s[i - 1] == 33 and (i < 2 or s[i - 2] != 92)))
            newest = i
            i += 1
        else:
            i += 1
            if not opened:
                continue
            at, image = opened.pop()
            alive = image or len(opened) >= dead
            dead = min(dead, len(opened))
            if not alive:
                continue
            found = None
            if s[i : i + 1] == b"(" and (e := _target(s, i)) is not None:
                found = e
                if e > 0:
                    out.append((i, e))
                found = abs(e)
            elif (m := _LABEL.match(s, i)) is not None and m.group(1).strip():
                found = m.end() if _label(m.group(1)) in references else None
            elif newest <= at and i - at < 1002 and _label(s[at + 1 : i - 1]) in references:
                found = m.end() if m else i
            if found is not None:
                i = found
                if not image:
                    dead = len(opened)
    return out


def _html(s: bytes, i: int, shut: dict[bytes, bool]):
    """Inline HTML at i; an end that doesn't come is looked for once."""
    for begin, end in ((b"<!--", b"-->"), (b"<?", b"?>"), (b"<![CDATA[", b"]]>"), (b"<!", b">")):
        if s.startswith(begin, i):
            if shut.setdefault(begin, True) and s.find(end, i) < 0:
                shut[begin] = False
            return _INLINE_HTML.match(s, i) if shut[begin] else None
    return _TAG.match(s, i)


def _target(s: bytes, i: int) -> int | None:
    """The offset after '(destination "title")' that begins at i, negative if it runs over lines outside the title; None if there is none."""
    n, broken = len(s), False

    def space(j: int) -> int:
        nonlocal broken
        while j < n and s[j] in b" \t\r\n":
            broken |= s[j] == 10
            j += 1
        return j

    j = space(i + 1)
    if s[j : j + 1] == b"<":
        m = re.compile(rb"<(?:[^<>\n\\]|\\.)*>").match(s, j)
        if not m:
            return None
        j = m.end()
    else:
        depth = 0
        while j < n and s[j] not in b" \t\r\n":
            if s[j] == 92 and j + 1 < n and s[j + 1] in _PUNCTUATION:
                j += 1
            elif s[j] == 40:
                depth += 1
                if depth > _DEEP:
                    return None
            elif s[j] == 41:
                if not depth:
                    break
                depth -= 1
            j += 1
        if depth:
            return None
    after = space(j)
    if after > j and s[after : after + 1] in (b'"', b"'", b"("):
        q = s[after : after + 1]
        end = b"\\)" if q == b"(" else q
        m = re.compile(re.escape(q) + rb"(?:[^\\" + (b"()" if q == b"(" else q) + rb"]|\\.)*" + end, re.S).match(s, after)
        if not m:
            return None
        after = space(m.end())
    if s[after : after + 1] != b")":
        return None
    return -(after + 1) if broken else after + 1


def mask(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The masked text and its ranges (start, end, kind) in bytes, by position."""
    raw = text.encode("utf-8", "surrogatepass")
    buf, start = bytearray(raw), 0
    front = _FRONT.match(raw)
    if front:
        start = front.end()
        blank(buf, 0, start)
    reader = _Reader(raw)
    reader.read(start)
    reader.inlines()
    for lo, hi in reader.masks:
        blank(buf, lo, hi)
    return buf.decode("utf-8", "surrogatepass"), sorted(reader.ranges, key=lambda r: (r[0], r[1]))
