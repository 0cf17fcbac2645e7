"""Per-document reports and corpus aggregates over violation arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.catalogue import RULES, rules
from quillmark.functions.spans import count_overlapping, once, restore
from quillmark.operators.detectors import deduplicated, detect


def by_position(column: str = "violations") -> Column:
    """The array in the order (start, end, rule), which is total after deduplication."""
    keyed = F.array_sort(F.transform(column, lambda v: F.struct(v["start_index"], v["end_index"], v["rule_id"], v.alias("v"))))
    return F.transform(keyed, lambda k: k["v"])


def exploded(df: DataFrame, key: str = "doc_id", column: str = "violations") -> DataFrame:
    """One row per violation: key, pos and the violation's fields.

    The outer form, because the inner one makes the optimizer repeat the whole array expression in a filter.
    """
    return df.select(key, F.posexplode_outer(column).alias("pos", "v")).where("pos is not null").select(
        key, "pos", "v.rule_id", "v.start_index", "v.end_index", "v.matched_text", "v.explanation", "v.suggested_change"
    )


def _map(keys: list[str], of) -> Column:
    """Counts of those keys that occur, as a map."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), of(k).alias("value")) for k in keys))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))


def counts_by_rule(column: str = "violations") -> Column:
    """map<string,int>; an identifier that isn't in the catalogue counts as well."""
    ids = F.transform(column, lambda v: v["rule_id"])
    entries = F.transform(F.array_sort(F.array_distinct(ids)), lambda k: F.struct(k.alias("key"), F.size(F.filter(ids, lambda x: x == k)).alias("value")))
    return F.map_from_entries(entries)


def counts_by_category(column: str = "violations") -> Column:
    """map<string,int>; identifiers that aren't in the catalogue are left out."""
    names = F.create_map(*(F.lit(x) for r in RULES for x in (r["id"], r["category"])))
    cats = F.filter(F.transform(column, lambda v: F.try_element_at(names, v["rule_id"])), lambda c: c.isNotNull())
    entries = F.transform(F.array_sort(F.array_distinct(cats)), lambda k: F.struct(k.alias("key"), F.size(F.filter(cats, lambda x: x == k)).alias("value")))
    return F.map_from_entries(entries)


def suppressed(df: DataFrame, family: Column | str, original: str = "text", ranges: str = "ranges", column: str = "violations") -> DataFrame:
    """Drop structural false positives and restore the matched text from the original.

    Markup (markdown, html): fragments that meet a heading, short-sentence runs that meet two list items or
    more. Script languages: fragments that meet a documentation comment. Plain text passes unchanged.
    """
    lang = F.col(family) if isinstance(family, str) else family
    markup, script = lang.isin("markdown", "html"), lang.isin("js", "jsx", "ts", "tsx")
    fragment, burst = lambda v: v["rule_id"] == "dramatic-fragment", lambda v: v["rule_id"] == "staccato-burst"

    def met(kind: str, due: Column) -> Column:
        """By violation, how many ranges of the kind it meets; counted in one sweep, and only where that matters."""
        at = lambda name: F.transform(column, lambda v: v[name])
        return F.when(due, count_overlapping(at("start_index"), at("end_index"), F.col(ranges), kind)).alias(kind.replace("-", "_"))

    fragments, bursts = F.exists(column, fragment), F.exists(column, burst)
    meets = F.struct(met("heading", markup & fragments), met("list-item", markup & bursts), met("jsdoc", script & fragments))

    def keep(m: Column, v: Column, i: Column) -> Column:
        drop = (fragment(v) & ((F.get(m["heading"], i) > 0) | (F.get(m["jsdoc"], i) > 0))) | (burst(v) & (F.get(m["list_item"], i) >= 2))
        return ~F.coalesce(drop, F.lit(False))

    def whole(raw: Column, v: Column) -> Column:
        return v.withField("matched_text", restore(raw, v["start_index"], v["end_index"], v["matched_text"]))

    kept = once(meets, lambda m: F.filter(column, lambda v, i: keep(m, v, i)))
    restored = once(F.col(original).cast("binary"), lambda raw: F.transform(kept, lambda v: whole(raw, v)))
    return df.withColumn(column, F.when(markup | script, restored).otherwise(F.col(column)))


def report(df: DataFrame, text: str = "text", column: str = "violations") -> DataFrame:
    """Adds text_length, violations by position, both count maps; violations are never null."""
    sorted_ = df.withColumn(column, F.coalesce(by_position(column), F.expr("array()")))
    return sorted_.withColumns(
        {"text_length": F.octet_length(F.coalesce(F.col(text), F.lit(""))), "counts_by_rule": counts_by_rule(column), "counts_by_category": counts_by_category(column)}
    )


def check(docs: DataFrame, text: str = "text", lang: str | None = None, masked: str | None = None, ranges: str = "ranges", extra: str | None = None) -> DataFrame:
    """Detect, add model findings (array column ``extra``), suppress, sort and count.

    ``lang``, ``masked`` and ``ranges`` name the columns that the maskers add; without them the text is scanned as it is.
    """
    found = detect(docs, masked or text)
    if extra:
        found = deduplicated(found.withColumn("violations", F.concat("violations", F.coalesce(F.col(extra), F.expr("array()")))))
    if lang:
        found = suppressed(found, lang, text, ranges)
    return report(found, text)


def report_json(df: DataFrame, path: str = "path", lang: str = "lang") -> DataFrame:
    """One JSON string per row with the field names of the report; absent explanations and changes are left out."""
    violations = F.transform(
        "violations",
        lambda v: F.struct(
            v["rule_id"].alias("ruleId"), v["start_index"].alias("startIndex"), v["end_index"].alias("endIndex"), v["matched_text"].alias("matchedText"),
            F.nullif(v["explanation"], F.lit("")).alias("explanation"), F.nullif(v["suggested_change"], F.lit("")).alias("suggestedChange"),
        ),
    )
    head = [F.col(c).alias(c) for c in (path, lang) if c in df.columns]
    return df.select(*head, F.to_json(F.struct(*head, "text_length", "counts_by_rule", "counts_by_category", violations.alias("violations"))).alias("value"))


def corpus_counts(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """By group: documents, violations, bytes, violations per 1,000 bytes."""
    return df.groupBy(group).agg(
        F.count("*").alias("n_docs"), F.sum(F.size("violations")).alias("n_violations"), F.sum(F.octet_length(F.coalesce(F.col(text), F.lit("")))).alias("n_bytes")
    ).withColumn("per_1000_bytes", F.round(1000.0 * F.col("n_violations") / F.greatest(F.col("n_bytes"), F.lit(1)), 6))


def rule_totals(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Over a corpus: violations and documents by rule, with the rule's category (null if unknown)."""
    rows = exploded(df)
    known = F.broadcast(rules(spark).select(F.col("id").alias("rule_id"), "category"))  # 48 rows
    return rows.groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).join(known, "rule_id", "left")
