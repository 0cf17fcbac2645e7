"""HTML masking: tags, comments and raw text become spaces; offsets stay.

A tokenizer over bytes in the manner of the HTML standard's tokenization: text,
start tags with quoted attributes, end tags, comments, declarations, and
elements whose content is raw. Depth counters decide what a text token belongs to.
"""

from __future__ import annotations

import re

#: Elements whose text is no prose, and elements whose content the tokenizer doesn't parse.
NOT_PROSE = {"script", "style", "pre", "code", "template", "textarea", "title"}
RAW = {"iframe", "noembed", "noframes", "noscript", "plaintext", "script", "style", "textarea", "title", "xmp"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_OPEN = re.compile(rb"<(?:[A-Za-z]|/[A-Za-z]|!|\?|/)")
_NAME = re.compile(rb"[^\t\n\f\r />]*")


def blank(buf: bytearray, lo: int, hi: int) -> None:
    """Spaces in place of all bytes but newlines."""
    lo, hi = max(0, lo), min(hi, len(buf))
    if hi > lo:
        buf[lo:hi] = b"\n".join(b" " * len(x) for x in bytes(buf[lo:hi]).split(b"\n"))


def _tag_end(src: bytes, at: int) -> int:
    """The offset after the '>' that closes a tag, quotes respected; -1 if there is none."""
    i, n = at, len(src)
    value = False  # just after '='
    while i < n:
        c = src[i]
        if c == 0x3E:
            return i + 1
        if value and c in (0x22, 0x27):
            i = src.find(bytes([c]), i + 1)
            if i < 0:
                return -1
            value = False
        elif c == 0x3D:
            value = True
        elif c not in b"\t\n\f\r ":
            value = False
        i += 1
    return -1


def tokens(src: bytes):
    """(kind, name, lo, hi): kind is text, start, self, end, comment or rest."""
    at, n, raw = 0, len(src), None
    while at < n:
        if raw is not None:
            if raw == "plaintext":
                yield "text", "", at, n
                return
            m = re.compile(rb"</" + raw.encode() + rb"(?=[\t\n\f\r />])", re.I).search(src, at)
            stop = m.start() if m else n
            if stop > at:
                yield "text", "", at, stop
            at, raw = stop, None
            continue
        m = _OPEN.search(src, at)
        if not m:
            yield "text", "", at, n
            return
        if m.start() > at:
            yield "text", "", at, m.start()
        at = m.start()
        c = src[at + 1 : at + 2]
        if c == b"!":
            if src.startswith(b"<!--", at):
                # <!--> and <!---> close at once; --!> closes as well
                e = re.compile(rb"(?<=<!)--?-?>|--!?>").search(src, at + 2)
                hi = e.end() if e else n
            else:
                e = src.find(b">", at)
                hi = e + 1 if e >= 0 else n
            yield "comment", "", at, hi
        elif c == b"?" or (c == b"/" and not src[at + 2 : at + 3].isalpha()):
            e = src.find(b">", at)
            hi = e + 1 if e >= 0 else n
            yield "comment", "", at, hi
        else:
            end = c == b"/"
            name = _NAME.match(src, at + 1 + end).group().lower().decode("latin-1")
            hi = _tag_end(src, at + 1 + end + len(name))
            if hi < 0:
                yield "rest", "", at, n
                return
            if end:
                yield "end", name, at, hi
            else:
                alone = src[hi - 2 : hi] == b"/>"
                yield ("self" if alone else "start"), name, at, hi
                if name in RAW:
                    raw = name
        at = hi


def mask(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The masked text and its ranges (start, end, kind) in bytes, in document order."""
    src = text.encode("utf-8", "surrogatepass")
    buf, ranges = bytearray(src), []
    raw = heading = item = 0
    for kind, name, lo, hi in tokens(src):
        if kind == "text":
            if raw:
                blank(buf, lo, hi)
                ranges.append((lo, hi, "code-block"))
                continue
            if heading:
                ranges.append((lo, hi, "heading"))
            if item:
                ranges.append((lo, hi, "list-item"))
            continue
        blank(buf, lo, hi)
        if kind == "start":
            raw += name in NOT_PROSE
            heading += name in HEADINGS
            item += name == "li"
        elif kind == "end":
            raw -= name in NOT_PROSE and raw > 0
            heading -= name in HEADINGS and heading > 0
            item -= name == "li" and item > 0
    return buf.decode("utf-8", "replace"), ranges
