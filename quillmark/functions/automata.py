"""A list of phrases as one automaton: an expression that reads the phrases' shared beginnings once.

A word edge and the set of first letters are looked at before anything else, so most places of a text
cost one look into a bit set; then each letter leads into the phrases that go on with it. Where
one phrase begins another, the one that the list names first is tried first, as in a plain alternation.
"""

from __future__ import annotations

from quillmark.functions import patterns as P
from quillmark.functions.spans import EDGE, java

_WORD = "[A-Za-z0-9_]"
#: Letters that case-insensitive patterns take for s and k; they are no word characters.
_ALSO = {"s": "ſ", "k": "K"}


def tree(phrases: list[list[str]]) -> dict:
    """Nested by step; '' holds the place in the list of a phrase that ends here."""
    root: dict = {}
    for i, steps in enumerate(phrases):
        node = root
        for step in steps:
            node = node.setdefault(step, {})
        node.setdefault("", i)
    return root


def _first(node: dict) -> int:
    return min(n if step == "" else _first(n) for step, n in node.items())


def expression(node: dict) -> str:
    """Java's dialect of what follows a node, ends and branches in the order of the list."""
    ways = sorted((n if step == "" else _first(n), step) for step, n in node.items())
    parts = ["" if step == "" else step + expression(node[step]) for _, step in ways]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def lead(letters: str) -> str:
    """A word edge before one of the letters."""
    plain = "".join(sorted({c for x in letters for c in (x.lower(), x.upper())}))
    odd = "".join(_ALSO[c] for c in "sk" if c in letters.lower())
    before = f"(?=[{plain}])(?<!{_WORD})"
    return f"(?:{before}|(?=[{odd}])(?<={_WORD}))" if odd else before


def word_list(rule: str) -> str | None:
    """The automaton of a list rule whose entries can't overlap, in Java's dialect; the same matches as ``patterns.word_list``."""
    entries = {
        "overused-intensifiers": P.INTENSIFIERS, "metaphor-crutch": P.METAPHORS, "elevated-register": P.ELEVATED, "filler-adverbs": P.FILLERS, "unnecessary-contrast": P.CONTRASTS,
    }.get(rule)
    if entries is None:
        return None
    gap = "[- ]?" if rule == "metaphor-crutch" else None
    steps = [[gap if gap and c == "." else java(P.quoted(c)) for c in e] for e in entries]
    tail = "s?" if rule == "overused-intensifiers" else ""
    return f"{lead(''.join(e[0] for e in entries))}(?iu:{expression(tree(steps))}{tail}){EDGE}"
