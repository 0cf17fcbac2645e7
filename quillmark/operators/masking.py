"""Maskers as Arrow UDFs, the registry of languages, and language resolution."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import html_mask, markdown_mask, script_mask

MASKED = "struct<masked:string,ranges:array<struct<start:int,end:int,kind:string>>>"


class Registry:
    """Maskers by name and by file extension; names and extensions are compared in lower case."""

    def __init__(self):
        self.by_name: dict[str, object] = {}
        self.by_extension: dict[str, str] = {}

    def register(self, name: str, mask, *extensions: str) -> None:
        name = name.lower()
        if not name or name == "text":
            raise ValueError("a masker needs a name of its own")
        if name in self.by_name:
            raise ValueError(f"masker {name!r} is registered already")
        for e in map(str.lower, extensions):
            if not e.startswith("."):
                raise ValueError(f"extension {e!r} lacks its dot")
            if e in self.by_extension:
                raise ValueError(f"extension {e!r} is registered already")
        self.by_name[name] = mask
        self.by_extension |= dict.fromkeys(map(str.lower, extensions), name)

    def get(self, name: str):
        """(masker or None for text, known)."""
        name = name.lower()
        return (None, True) if name == "text" else (self.by_name.get(name), name in self.by_name)

    def names(self) -> list[str]:
        return sorted([*self.by_name, "text"])


LANGUAGES = Registry()
LANGUAGES.register("markdown", markdown_mask.mask, ".md", ".markdown", ".mdx")
LANGUAGES.register("html", html_mask.mask, ".html", ".htm")
for _name, _ext in (("js", (".js", ".mjs", ".cjs")), ("jsx", (".jsx",)), ("ts", (".ts", ".mts", ".cts")), ("tsx", (".tsx",))):
    LANGUAGES.register(_name, lambda t, d=_name: script_mask.mask(t, d), *_ext)


class UsageError(ValueError):
    """A wrong flag value."""


def resolve_lang(flag: str | None, path: str | None) -> str:
    """The language for a flag and a path: auto goes by extension, standard input and unknown extensions are text."""
    pick = (flag or "auto").lower()
    if pick == "auto":
        if not path or path == "-":
            return "text"
        return LANGUAGES.by_extension.get(posixpath.splitext(posixpath.basename("x" + path.replace("\\", "/").rsplit("/", 1)[-1]))[1].lower(), "text")
    if not LANGUAGES.get(pick)[1]:
        raise UsageError(f"invalid language {flag!r} (want auto|{'|'.join(LANGUAGES.names())})")
    return pick


def lang_column(path: Column, flag: str | None = None) -> Column:
    """``resolve_lang`` over a column of paths; a wrong flag fails on the driver."""
    if (flag or "auto").lower() != "auto":
        return F.lit(resolve_lang(flag, None))
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    names = F.create_map(*(F.lit(x) for pair in sorted(LANGUAGES.by_extension.items()) for x in pair))
    return F.coalesce(F.try_element_at(names, ext), F.lit("text"))


def _masked(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
    masked, ranges = [], []
    for t, name in zip(texts, langs, strict=True):
        t = t or ""
        f = LANGUAGES.get(name or "text")[0]
        m, r = f(t) if f else (t, [])
        masked.append(m)
        ranges.append([{"start": a, "end": b, "kind": k} for a, b, k in r])
    return pd.DataFrame({"masked": masked, "ranges": ranges})


def mask(docs: DataFrame, text: str = "text", lang: Column | str = "lang") -> DataFrame:
    """Adds ``masked`` (same length in bytes, newlines kept, other masked bytes spaces) and ``ranges``. Null texts count as empty."""
    f = F.pandas_udf(_typed, MASKED)
    name = F.col(lang) if isinstance(lang, str) else lang
    return docs.withColumn("_m", f(F.coalesce(F.col(text), F.lit("")), name)).withColumns({"masked": F.col("_m.masked"), "ranges": F.col("_m.ranges")}).drop("_m")


def _typed(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
    return _masked(texts, langs)
