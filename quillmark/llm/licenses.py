"""License scans by template markup compiled into token automata.

A template is a line of words with two kinds of regions::

    <<opt>> words <</opt>>      words that may be missing (regions nest)
    <<any 0 4>>                 0 to 4 words of any kind (a replaceable region)
    word|word                   one of several words

It becomes an automaton over words. A text holds the template where the
automaton accepts a run of consecutive words: all mandatory wording exactly as
written, in order, optional and replaceable regions as allowed. Case,
punctuation and layout don't count, since words are compared.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from quillmark.llm.common import LOWER, buffers, runs, words_of

#: Fixed phrases: label by phrase.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<opt>> 1|a <</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
<<opt>> 2|b <</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution {} this software is provided by <<any 1 12>> as is and any express or implied warranties
including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
in no event shall <<any 1 12>> be liable for any direct indirect incidental special exemplary or consequential damages
including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption
however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
arising in any way out of the use of this software even if advised of the possibility of such damage"""
_NO_NAMES = """<<opt>> 3|c <</opt>> neither the name of <<any 1 12>> nor the names of its|any contributors may be used to endorse or promote products
derived from this software without specific prior written permission"""

#: The library of templates: label by markup. Lines that name a license, and whole license texts and notices
#: (fixed values: public wording) with their optional words and replaceable names.
TEMPLATES = {
    "apache-2.0": "licensed under <<opt>> the <</opt>> apache license <<opt>> version <</opt>> 2 0",
    "apache-2.0-notice": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
<<opt>> you may obtain a copy of the license at <<opt>> http|https www apache org licenses license 2 0 <</opt>> <</opt>>
unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license""",
    "bsd-2-clause": _BSD.format(""),
    "bsd-3-clause": _BSD.format(_NO_NAMES),
    "cc-by-nc-4.0": "licensed under <<opt>> a|the <</opt>> cc by nc 4 0",
    "cc-by-4.0": "licensed under <<opt>> a|the <</opt>> <<opt>> creative commons attribution <</opt>> cc by 4 0",
    "copyright-notice": "copyright <<opt>> c <</opt>> <<any 1 8>> all rights reserved",
    "gpl-3.0": "<<opt>> this work is <</opt>> licensed under the gnu general public license <<opt>> version <</opt>> 3",
    "gpl-3.0-notice": """<<opt>> this program is <</opt>> free software you can redistribute it and or modify it under the terms of the gnu general public license
as published by the free software foundation either version 3 of the license or <<opt>> at your option <</opt>> any later version
this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
merchantability or fitness for a particular purpose see the gnu general public license for more details""",
    "isc": """permission to use copy modify and <<opt>> or <</opt>> distribute this software for any purpose with or without fee is hereby granted
provided that the above copyright notice and this permission notice appear in all copies
the software is provided as is and <<any 1 8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
in no event shall <<any 1 8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "mit": "<<opt>> this <<any 0 3>> is <</opt>> released|licensed|distributed under <<opt>> the terms of <</opt>> the mit license",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
<<opt>> the software <</opt>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice <<opt>> including the next paragraph <</opt>> shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall <<any 1 8>> be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
subject to the following restrictions <<opt>> 1 <</opt>> the origin of this software must not be misrepresented you must not claim that you wrote the original software
if you use this software in a product an acknowledgment|acknowledgement in the product documentation would be appreciated but is not required
<<opt>> 2 <</opt>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software
<<opt>> 3 <</opt>> this notice may not be removed or altered from any source distribution""",
}

SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:int,end:int>>"
_SEP = np.ones(256, bool)
_SEP[48:58] = _SEP[97:123] = False
_SEP[128:] = False


class Automaton:
    """States are integers; ``moves[s]`` holds (word or None for any, next)."""

    def __init__(self, markup: str):
        self.moves: list[list[tuple[str | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.accept = self._sequence(re.findall(r"<<[^>]*>>|\S+", markup), 0)
        self.sure = self._sure(markup)
        self.starts = {w for s in self._closure({0}) for w, _ in self.moves[s]}
        if None in self.starts or self.accept in self._closure({0}):
            raise ValueError("a template must begin with a mandatory word")

    @staticmethod
    def _sure(markup: str) -> list[str]:
        """Words of which every accepted text holds one: the longest mandatory word, or its alternatives."""
        depth, found = 0, []
        for t in re.findall(r"<<[^>]*>>|\S+", markup):
            depth += (t == "<<opt>>") - (t == "<</opt>>")
            if not depth and not t.startswith("<<"):
                found.append(t.split("|"))
        return max(found, key=lambda x: min(map(len, x)))

    def _state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _sequence(self, tokens: list[str], at: int) -> int:
        opened: list[int] = []
        for t in tokens:
            if t == "<<opt>>":
                opened.append(at)
                nxt = self._state()
                self.free[at].append(nxt)
                at = nxt
            elif t == "<</opt>>":
                nxt = self._state()
                self.free[at].append(nxt)
                self.free[opened.pop()].append(nxt)
                at = nxt
            elif t.startswith("<<any"):
                least, most = map(int, t[5:-2].split())
                end = None
                for k in range(most):
                    nxt = self._state()
                    self.moves[at].append((None, nxt))
                    if k >= least:
                        end = self._state() if end is None else end
                        self.free[at].append(end)
                    at = nxt
                if end is not None:
                    self.free[at].append(end)
                    at = end
            else:
                nxt = self._state()
                for w in t.split("|"):
                    self.moves[at].append((w, nxt))
                at = nxt
        if opened:
            raise ValueError("an optional region isn't closed")
        return at

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    def match(self, words: list[str], at: int) -> int | None:
        """The end of the longest accepted run that begins at ``at``."""
        now, best = self._closure({0}), None
        for i in range(at, len(words)):
            w = words[i]
            now = self._closure({n for s in now for x, n in self.moves[s] if x is None or x == w})
            if not now:
                break
            if self.accept in now:
                best = i + 1
        return best


@lru_cache(maxsize=8)
def compiled(templates: tuple) -> dict[str, Automaton]:
    return {label: Automaton(markup) for label, markup in templates}


def scan_words(words: list[str], phrases: dict[str, str], automata: dict[str, Automaton]):
    """(base places, template places), each (label, start, end) in words."""
    base, more = [], []
    split = {tuple(p.split()): label for p, label in phrases.items()}
    heads: dict[str, list] = {}
    for p, label in split.items():
        heads.setdefault(p[0], []).append((p, label))
    for i, w in enumerate(words):
        for p, label in heads.get(w, ()):
            if tuple(words[i : i + len(p)]) == p:
                base.append((label, i, i + len(p)))
        for label, a in automata.items():
            if w in a.starts and (end := a.match(words, i)) is not None:
                more.append((label, i, end))
    return base, more


def _needles(phrases: dict, automata: dict) -> list[bytes]:
    """Byte strings of which any text with a hit holds one."""
    out = {max(p.split(), key=len) for p in phrases}
    for a in automata.values():
        out |= set(a.sure)
    return sorted((w.encode() for w in out), key=len)


def scan(docs: DataFrame, text: str = "text", phrases: dict | None = None, templates: dict | None = None) -> DataFrame:
    """``docs`` with the columns of SCAN in place of the text.

    n_base, first_word, last_word and base_labels count the fixed phrases (word numbers
    from 0), labels adds the templates accepted (whole license texts count only
    whole: a changed or missing mandatory word rejects them), ``places`` lists all hits. score is 1 where a
    template is accepted, 0.5 with fixed phrases alone, 0 without a hit. Null texts are
    empty: no words, null places of first and last word, empty label strings. Columns of the
    input that bear a name of the result are replaced.
    """
    phrases = PHRASES if phrases is None else phrases
    wanted = tuple(sorted((TEMPLATES if templates is None else templates).items()))
    made = [x.split()[0] for x in re.sub(r"<[^>]*>*", "", SCAN).split(", ")]
    keep = [c for c in docs.columns if c != text and c not in made]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)

    def work(batches):
        import pyarrow as pa

        automata = compiled(wanted)
        needles = _needles(phrases, automata)
        place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            data, off = buffers(batch.column(batch.schema.get_field_index(text)))
            n = np.zeros(len(off) - 1, np.int64)
            rows = [(0, None, None, "", "", 0.0, [])] * (len(off) - 1)
            for lo, hi in runs(off):
                low = LOWER[data[off[lo] : off[hi]]]
                o = off[lo : hi + 1] - off[lo]
                starts, ends, first = words_of(low, o, _SEP)
                n[lo:hi] = np.diff(first)
                raw = low.tobytes()
                held = np.zeros(hi - lo, bool)
                for needle in needles:
                    at = raw.find(needle)
                    while at >= 0:
                        r = int(np.searchsorted(o, at, "right")) - 1
                        held[r] = True
                        at = raw.find(needle, int(o[r + 1]) if r + 1 < len(o) else len(raw))
                for r in np.flatnonzero(held):
                    words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]], strict=True)]
                    base, more = scan_words(words, phrases, automata)
                    if base or more:
                        at = [p[1] for p in base]
                        b = sorted({p[0] for p in base})
                        rows[lo + r] = (
                            len(base), min(at) if at else None, max(at) if at else None, ",".join(b),
                            ",".join(sorted({*b, *(p[0] for p in more)})), 1.0 if more else 0.5,
                            [dict(zip(("label", "start", "end"), p, strict=True)) for p in base + more],
                        )
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), place]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(k)) for k in keep] + [pa.array(n)] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                keep + made,
            )

    return docs.select(*keep, text).mapInArrow(work, f"{fields}, {SCAN}" if fields else SCAN)


def op6_licenses(spark, sf_dir):
    """License phrases and templates in every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).drop("places")


def _pattern(markup: str) -> str:
    """The same template as a regular expression over words that each end in a space."""
    out = ""
    for t in re.findall(r"<<[^>]*>>|\S+", markup):
        if t == "<<opt>>":
            out += "(?:"
        elif t == "<</opt>>":
            out += ")?"
        elif t.startswith("<<any"):
            out += "(?:[^ ]+ ){%s,%s}" % tuple(t[5:-2].split())
        else:
            out += f"(?:{t}) "
    return f" {out}"


def _sql() -> str:
    labels = ", ".join(f"CASE WHEN regexp_matches(j, '{_pattern(m)}') THEN '{k}' END" for k, m in sorted(TEMPLATES.items()))
    places = ", ".join(
        f"list_transform(list_filter(range(1, len(w) + 1), lambda i: list_aggregate(w[i:i + {len(p.split()) - 1}], 'string_agg', ' ') = '{p}'), lambda i: i - 1)"
        for p in PHRASES
    )
    base = ", ".join(f"CASE WHEN contains(j, ' {p} ') THEN '{label}' END" for p, label in PHRASES.items())
    join = "coalesce(list_aggregate(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), 'string_agg', ','), '')"
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
j AS (SELECT *, ' ' || coalesce(list_aggregate(w, 'string_agg', ' '), '') || ' ' AS j FROM w),
p AS (SELECT *, CASE WHEN {' OR '.join(f"contains(j, ' {p} ')" for p in PHRASES)} THEN flatten([{places}]) ELSE [] END AS places,
  [{base}] AS b, [{labels}] AS t FROM j)
SELECT doc_id, len(w)::bigint AS n_words, len(places)::bigint AS n_base, list_min(places)::bigint AS first_word, list_max(places)::bigint AS last_word,
  {join.format('b')} AS base_labels, {join.format('list_concat(b, t)')} AS labels,
  CASE WHEN len(list_filter(t, lambda x: x IS NOT NULL)) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END::double AS score
FROM p
"""


OP6_SQL = _sql()
