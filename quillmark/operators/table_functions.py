"""Maskers as table functions for SQL: ``FROM docs, LATERAL mask(text, lang)``.

``mask`` gives one row for a text: its masked form and how many ranges of structure it has; ``mask_ranges`` gives a
row for each range, with the text inside. Arrow moves the batches. A null text is empty; a null language is text,
which is not masked and has no ranges; a language that nobody registered fails the query.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillmark.operators.masking import LANGUAGES, UsageError


def _analyzed(text: str | None, lang: str | None) -> tuple[str, list[tuple[int, int, str]]]:
    mask, known = LANGUAGES.get(lang or "text")
    if not known:
        raise UsageError(f"invalid language {lang!r} (want {'|'.join(LANGUAGES.names())})")
    return mask(text or "") if mask else (text or "", [])


class Mask:
    def eval(self, text: str, lang: str) -> Iterator[tuple]:
        masked, ranges = _analyzed(text, lang)
        yield masked, len(ranges)


class MaskRanges:
    def eval(self, text: str, lang: str) -> Iterator[tuple]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        for pos, (start, end, kind) in enumerate(_analyzed(text, lang)[1]):
            yield pos, start, end, kind, raw[start:end].decode("utf-8", "replace")


FUNCTIONS = {
    "mask": (Mask, "masked string, n_ranges int"),
    "mask_ranges": (MaskRanges, "pos int, start_index int, end_index int, kind string, content string"),
}
#: By session, the names under which they are registered.
_REGISTERED: dict[str, set[str]] = {}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Registers all table functions under ``prefix`` and their names, and returns these.

    Doing so again for one session changes nothing; a name that some other function bears is an error, and
    then none is registered.
    """
    session = spark._jsparkSession.sessionUUID()
    mine = _REGISTERED.setdefault(session, set())
    names = {prefix + name: made for name, made in FUNCTIONS.items() if prefix + name not in mine}
    for name in names:
        if spark.catalog.functionExists(name):
            raise ValueError(f"a function named {name!r} exists already")
    for name, (cls, returns) in names.items():
        spark.udtf.register(name, udtf(cls, returnType=returns, useArrow=True))
        mine.add(name)
    return sorted(prefix + name for name in FUNCTIONS)
