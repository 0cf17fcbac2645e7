"""Personal data: fixed formats, and candidates judged by boosted trees.

All column expressions: regular expressions propose spans, higher-order
functions validate them, nested CASE expressions are the trees of
``pii_model``. Offsets count code points, ends are exclusive.

Patterns are written so that a long run of digits or letters costs linear time
and no deep recursion: matches may begin only at the start of a run, or where
the match before ended, which leaves the matches the same, and runs of any
length are possessive. Credentials and addresses have no longest size; parts of
16 characters or more joined by dots (JWT) are one candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.spans import folded
from quillmark.llm.pii_model import CUES, FEATURES, KINDS, WINDOW, fitted

BASE = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_DOT = r"(?:\.|\(dot\)|\[dot\])"
#: Labels between the first and the last. A plain dot joins labels only without spaces or with one on either side: "x.com. And so" ends at com.
_JOIN = r"(?:\.| \. | ?(?:\(dot\)|\[dot\]) ?)"
_LABELS = rf"(?:[A-Za-z0-9-]++{_JOIN}(?=[A-Za-z]{{2}}|[A-Za-z0-9-]++{_JOIN}[A-Za-z0-9]))*+"
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+(?:\.[A-Za-z0-9+/_-]{16,}+)*+",
    "account": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){8,18}(?![0-9A-Za-z])",
    "address": rf"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++ ?{_DOT} ?(?:{_LABELS}[A-Za-z]{{2,}}+|[A-Za-z]{{2,}}+)",
    "local_phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda s, i: s
        + F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(d, i, F.lit(1)).cast("int") * 2).cast("int")
            - F.when(F.substring(d, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return (F.length(d) > 0) & (F.coalesce(total, F.lit(1)) % 10 == 0)


def _parts_ok(m: Column) -> Column:
    return F.forall(
        F.split(m, "\\."),
        lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.ltrim(p, F.lit("0")), F.lit("999")).cast("int"), F.lit(0)) <= 255),
    )


VALID = {
    "email": lambda m: F.lit(True),
    "ip": _parts_ok,
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def find(text: Column, pattern: str) -> Column:
    """array<struct<start,end,m>> of the leftmost non-overlapping matches."""
    both = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms"), F.split(text, pattern, -1).alias("gs")))
    kind = "struct<start:int,end:int,m:string>"
    empty = F.expr(f"cast(array() as array<{kind}>)")

    def places(z: Column) -> Column:
        def step(pos: Column, i: Column):
            at = pos + F.length(z["gs"][i])
            to = at + F.length(z["ms"][i])
            return to, F.array(F.struct(at.cast("int").alias("start"), to.cast("int").alias("end"), z["ms"][i].alias("m")))

        return folded(F.size(z["ms"]), F.lit(0), kind, step)

    return F.flatten(F.transform(both, lambda z: F.when(F.size(z["ms"]) > 0, places(z)).otherwise(empty)))


def _tag(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def feature_struct(kind: int, m: Column, before: Column) -> Column:
    """The numbers of ``pii_model.features`` as a struct of doubles; before: lower-case context."""
    n = F.length(m).cast("double")
    flag = lambda c: c.cast("double")
    values = [
        F.lit(float(kind)), n, F.length(_digits(m)) / n, F.length(F.regexp_replace(m, "[^A-Z]", "")) / n,
        F.size(F.array_distinct(F.filter(F.split(m, ""), lambda c: c != ""))).cast("double"), flag(m.rlike("^[0-9A-Fa-f]+$")), flag(_luhn(m)),
        flag(before.rlike("[\"'`]$")), flag(before.rlike("[=:] ?[\"'`]?$")), F.length(F.regexp_replace(m, "[^ .()-]", "")).cast("double"),
        *(flag(before.rlike(c)) for c in CUES.values()),
    ]
    return F.struct(*(v.alias(f) for f, v in zip(FEATURES, values, strict=True)))


def probability(x: Column) -> Column:
    """The boosted trees over a feature struct, calibrated."""
    model = fitted()
    leaf = lambda s: F.when(x[FEATURES[s[0]]] < s[1], F.lit(s[2])).otherwise(F.lit(s[3]))
    total = F.lit(model.bias)
    for f, cut, low, high in model.trees:
        total = total + F.when(x[FEATURES[f]] < cut, leaf(low)).otherwise(leaf(high))
    return 1 / (1 + F.exp(-(F.lit(model.a) * total + F.lit(model.b))))


def _judged(text: Column, kind: str) -> Column:
    """Candidates of a kind whose probability reaches the kind's threshold: array<struct<kind,start,end,p>>."""
    k = KINDS.index(kind)
    at_least = fitted().thresholds[k]

    def judge(s: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(s["start"] - WINDOW, F.lit(0)) + 1, F.least(s["start"], F.lit(WINDOW))))
        x = F.array(feature_struct(k, s["m"], before))
        p = F.transform(x, lambda f: probability(f))[0]
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), p.alias("p"))

    return F.filter(F.transform(find(text, GENERATORS[kind]), judge), lambda s: s["p"] >= at_least)


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (SPANS each), kinds in the listed order, then by start.

    ``base`` holds the fixed formats. ``spans`` adds candidates that the trees select: those that meet a
    base span give way, of two that meet the more probable stays (then the earlier start, then kind).
    Null and empty texts have none. Columns named base or spans are replaced; all others, repeated rows
    included, pass through unchanged.
    """
    t = F.col("_t")
    gates = {
        "email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), "phone": t.contains("+"),
        "secret": t.rlike("[0-9]"), "account": t.rlike(r"[0-9][ -]?[0-9][ -]?[0-9]"), "address": t.contains("(at)") | t.contains("[at]"), "local_phone": t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
    }
    none, none_p = F.expr(f"cast(array() as {SPANS})"), F.expr("cast(array() as array<struct<kind:string,start:int,end:int,p:double>>)")
    df = docs.drop("base", "spans").withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    for kind in BASE:
        valid = VALID[kind]
        good = F.filter(find(t, PATTERNS[kind]), lambda s: valid(s["m"]))  # noqa: B023
        df = df.withColumn(f"_{kind}", F.when(gates[kind], _tag(good, kind)).otherwise(none))
    df = df.withColumn("base", F.concat(*(f"_{k}" for k in BASE))).drop(*(f"_{k}" for k in BASE))
    more = F.concat(*(F.when(gates[k], _judged(t, k)).otherwise(none_p) for k in KINDS))
    df = df.withColumn("_more", F.filter(more, lambda s: ~F.exists("base", lambda b: _meets(s, b))))

    def beaten(s: Column) -> Column:
        rank = lambda c: F.struct((-c["p"]).alias("p"), c["start"].alias("start"), c["kind"].alias("kind"))
        return F.exists("_more", lambda o: _meets(s, o) & (rank(o) < rank(s)))

    place = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    kept = F.filter("_more", lambda s: ~beaten(s))
    kept = F.array_sort(F.transform(kept, lambda s: F.struct(place[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    kept = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return df.withColumn("spans", F.concat("base", F.when(F.size("_more") > 0, kept).otherwise(none))).drop("_t", "_more")


def redacted(found: DataFrame, text: str = "text") -> DataFrame:
    """The result of ``spans`` with every span of ``text`` replaced by its kind in brackets; meeting spans become one. Null stays null."""
    t = F.col(text)
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    clean = F.aggregate(
        order,
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda s, x: F.when(
            x["start"] >= s["pos"],
            F.struct(
                x["end"].alias("pos"),
                F.concat(s["out"], F.substring(t, s["pos"] + 1, x["start"] - s["pos"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(s["pos"], x["end"]).alias("pos"), s["out"].alias("out"))),
        lambda s: F.concat(s["out"], F.substring(t, s["pos"] + 1, F.length(t))),
    )
    return found.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(t))


def joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark, sf_dir):
    """Personal data in every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = spans(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
