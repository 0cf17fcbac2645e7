"""Merkle manifest of a dataset, with proofs that are read off parents' preimages.

Rows are leaves; by group they are put in order, and every ``ARITY`` neighbours
become a parent: the sha256 of its *preimage*, the children's digests one after
the other. A parent keeps that preimage. What a leaf needs is the preimages of
its ancestors, and its place in each: its siblings are the preimage without its
own 64 characters, and a changed leaf is folded up by splicing the new digest
into each preimage in turn. No sibling is ever looked up by itself.

Places in the order come from a range partitioned sort and the partitions' counts,
so a group of any size is ranked without passing through one task. Leaves meet
by parent once (8 rows each); levels above are an eighth of the one below, each
a written table, and the ancestors' preimages are handed down from the top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import table, written

ARITY = 8
DIGEST = 64
#: Rows of a file of the levels above the leaves; a table of fewer is one file, however many partitions the shuffle has.
FILE_ROWS = 50_000
PATH = "array<struct<pre:string,slot:int>>"


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def field(c: Column) -> Column:
    """'-' for null, else the UTF-8 byte count, ':' and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return sha(F.concat(*map(field, columns)))


def group_key(c: Column) -> Column:
    """A non-null string that sorts null first, then values bytewise."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def ranked(spark: SparkSession, nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` (with a column g) and ``idx``, its place from 0 among the rows of g in ``order``, and ``n``, their number.

    Rows equal in all of ``order`` are told apart by where they stand, so that repeats don't fill one partition.
    """
    sort = ["g", *order, "_tie"]
    parts = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    seq = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(spark, parts.withColumns({"_pid": F.spark_partition_id(), "_seq": seq}).drop("_tie"), name)
    runs = placed.groupBy("g", "_pid").agg(F.count("*").alias("_c"), F.min("_seq").alias("_lo"))  # partitions and groups at most
    by = Window.partitionBy("g").orderBy("_pid")
    starts = runs.select("g", "_pid", "_lo", (F.sum("_c").over(by) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy("g")).alias("n"))
    starts = written(spark, starts, f"{name}-starts")  # its size is then known before the join is planned
    found = placed.join(starts, ["g", "_pid"]).withColumn("idx", F.col("_before") + F.col("_seq") - F.col("_lo"))
    return found.drop("_pid", "_seq", "_lo", "_before")


def parents(nodes: DataFrame, *carried: str) -> DataFrame:
    """g, n, idx, pre, h and ``members`` (h and the carried columns, in order) of the level above; groups of one node have none."""
    kids = F.array_sort(F.collect_list(F.struct("idx", "h", *carried)))
    up = nodes.where("n > 1").groupBy("g", "n", F.floor(F.col("idx") / ARITY).alias("p")).agg(kids.alias("members"))
    pre = F.array_join(F.transform("members", lambda m: m["h"]), "")
    up = up.select("g", F.ceil(F.col("n") / ARITY).alias("n"), F.col("p").alias("idx"), pre.alias("pre"), "members")
    return up.withColumn("h", sha(F.col("pre")))


def place(pre: str, at: Column) -> Column:
    """A path of one step: a preimage and the slot in it."""
    return F.array(F.struct(F.col(pre).alias("pre"), at.cast("int").alias("slot")))


def ladder(spark: SparkSession, first: DataFrame, name: str) -> tuple[list[DataFrame], list[int]]:
    """Levels from the ``first`` parents up to one node in every group, each above them a written table (g, n, idx, pre, h), and how many files suit each."""
    most, rows, groups = first.agg(F.max("n"), F.count("*"), F.count_if(F.col("idx") == 0)).first()
    most, levels, files = most or 1, [first.select("g", "n", "idx", "pre", "h")], [_files(rows)]
    while most > 1:
        most, rows = -(-most // ARITY), rows // ARITY + groups
        levels.append(written(spark, parents(levels[-1]).drop("members").coalesce(_files(rows)), f"{name}-{len(levels)}"))
        files.append(_files(rows))
    return levels, files


def _files(rows: int) -> int:
    return rows // FILE_ROWS + 1


def tops(levels: list[DataFrame], alone: DataFrame) -> DataFrame:
    """g, h of every group's last node; ``alone`` are the first nodes of groups of one."""
    found = alone.where("n = 1").select("g", "h")
    for level in levels:
        found = found.unionByName(level.where("n = 1").select("g", "h"))
    return found


def handed_down(spark: SparkSession, levels: list[DataFrame], files: list[int], above: DataFrame, name: str) -> DataFrame:
    """g, idx, pre, up, sub of the lowest level: ``up`` holds the preimages over that node and its places in them.

    ``above`` (g, up, sub) has those over each group's last node, and that node's digest.
    """
    down = None
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k]
        found = here.where("n = 1").join(above, "g").select("g", "idx", "pre", "up", "sub")
        if down is not None:
            over = down.select("g", F.col("idx").alias("_p"), F.col("pre").alias("_pre"), "up", "sub")
            lower = here.where("n > 1").withColumn("_p", F.floor(F.col("idx") / ARITY)).join(over, ["g", "_p"])
            found = found.unionByName(lower.select("g", "idx", "pre", F.concat(place("_pre", F.col("idx") % ARITY), "up").alias("up"), "sub"))
        down = written(spark, found.coalesce(files[k]), f"{name}-down{k}") if k else found
    return down


def under(parents_: DataFrame, over: DataFrame, *carried: str) -> DataFrame:
    """Members of the lowest parents, each with ``path``: its parent's preimage and those above, with its places."""
    kids = parents_.select("g", "idx", F.posexplode("members").alias("at", "m")).join(over, ["g", "idx"])
    return kids.select("g", F.col("m.h").alias("h"), *(F.col(f"m.{c}").alias(c) for c in carried), "sub", F.concat(place("pre", F.col("at")), "up").alias("path"))


def siblings(path: Column) -> Column:
    """All siblings' digests, level by level: each preimage without the own slot."""
    left = lambda x: F.substring(x["pre"], F.lit(1), x["slot"] * DIGEST)
    right = lambda x: F.substring(x["pre"], x["slot"] * DIGEST + DIGEST + 1, F.length(x["pre"]))
    return F.array_join(F.transform(path, lambda x: F.concat(left(x), right(x))), "")


def fold(start: Column, path: Column) -> Column:
    """The root from a leaf's digest: spliced into its slot of each preimage, hashed, and on."""
    return F.aggregate(path, start, lambda h, x: sha(F.overlay(x["pre"], h, x["slot"] * DIGEST + 1, F.lit(DIGEST))))


def manifest(
    spark: SparkSession, rows: DataFrame, columns: list[str], changed: dict[str, Column] | None = None, key: str = "doc_id", group: str = "lang", checked: Column | None = None
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each of ``rows``.

    A leaf is the digest of ``columns`` (null: '-', else byte count, ':', value), a group's leaves ascend by ``key``
    (null first), equal keys by digest. ``folded_root`` starts from the row as ``changed`` has it where ``checked``
    holds (null: not), else from the row itself. A group of one leaf has that leaf as its subroot; one group alone has
    its subroot as root, and a single row an empty proof. No rows give no rows. A null group comes before '' and all
    others. Columns outside ``columns`` aren't read, whatever their names.
    """
    now = leaf([F.col(c) for c in columns])
    then = leaf([(changed or {}).get(c, F.col(c)) for c in columns])
    other = F.when(F.coalesce(checked, F.lit(False)), then) if checked is not None else F.lit(None).cast("string")
    leaves = written(spark, rows.select(F.col(key).alias("id"), group_key(F.col(group)).alias("g"), now.alias("h"), other.alias("other")), "manifest-leaves")
    placed = ranked(spark, leaves, ["id", "h"], "manifest-order")
    first = written(spark, parents(placed, "id", "other"), "manifest-runs")
    alone = placed.where("n = 1")
    levels, files = ladder(spark, first, "manifest")
    none = F.expr(f"cast(array() as {PATH})")
    # the groups' last nodes are the leaves of a tree of their own
    subs = written(spark, tops(levels, alone), "manifest-subroots")
    top = ranked(spark, subs.select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), ["name"], "manifest-suborder")
    head = written(spark, parents(top, "name"), "manifest-head")
    head_levels, head_files = ladder(spark, head, "manifest-head")
    root = tops(head_levels, top).first()  # one digest, or none of no rows
    root = F.lit(root["h"] if root else None).cast("string")
    over = handed_down(spark, head_levels, head_files, tops(head_levels, top).select("g", none.alias("up"), root.alias("sub")), "manifest-head")
    above = under(head, over, "name").select(F.col("name").alias("g"), F.col("path").alias("up"), F.col("h").alias("sub"))
    above = written(spark, above.unionByName(top.where("n = 1").select(F.col("name").alias("g"), none.alias("up"), F.col("h").alias("sub"))), "manifest-above")
    # every leaf with the preimages over it
    paths = under(first, handed_down(spark, levels, files, above, "manifest"), "id", "other")
    paths = paths.unionByName(alone.join(above, "g").select("g", "h", "id", "other", "sub", F.col("up").alias("path")))
    folded = fold(F.coalesce("other", "h"), F.col("path"))
    found = paths.select(F.col("id").alias(key), F.col("h").alias("leaf"), F.col("sub").alias("subroot"), root.alias("root"), sha(siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` as a leaf; of a third of the rows, by crc32, a lower-cased text is held against the root."""
    docs = table(spark, sf_dir, "documents")
    due = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(spark, docs, COLUMNS, {"text": F.translate("text", UPPER, LOWER)}, checked=due)


def _tree_sql(start: str, levels: int, name: str) -> tuple[str, str]:
    """Common tables that bring ``start`` (g, idx, n, h) up to one node a group, and what a leaf meets on its way."""
    out, cur = [], start
    for k in range(levels):
        out.append(f"""{name}_s{k} AS (SELECT a.g, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
    FROM {cur} a JOIN {cur} b ON a.g = b.g AND a.idx // {ARITY} = b.idx // {ARITY} WHERE a.n > 1 GROUP BY a.g, a.idx)""")
        out.append(f"""{name}_t{k} AS (SELECT g, idx // {ARITY} AS idx, (any_value(n) + {ARITY - 1}) // {ARITY} AS n,
    CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h FROM {cur} GROUP BY g, idx // {ARITY})""")
        cur = f"{name}_t{k}"
    return ",\n".join(out), cur


def _climb_sql(start: str, levels: int, name: str, tree: str) -> tuple[str, str]:
    """Common tables that fold ``start`` (doc, g, idx, f, proof) level by level."""
    out, cur = [], start
    for k in range(levels):
        out.append(f"""{name}{k} AS (SELECT c.doc, c.g, c.idx // {ARITY} AS idx, CASE WHEN s.l IS NULL THEN c.f ELSE sha256(s.l || c.f || s.r) END AS f,
    c.proof || coalesce(s.l || s.r, '') AS proof FROM {cur} c LEFT JOIN {tree}_s{k} s ON c.g = s.g AND c.idx = s.idx)""")
        cur = f"{name}{k}"
    return ",\n".join(out), cur


def manifest_sql(levels: int = 7, group_levels: int = 3) -> str:
    """DuckDB SQL for the query's rows, for up to 8**levels rows of a language and 8**group_levels languages; doc_ids differ."""
    value = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf_of = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in COLUMNS) + ")"
    tree, last = _tree_sql("placed", levels, "d")
    tree2, last2 = _tree_sql("subs", group_levels, "g")
    climb, up = _climb_sql("start", levels, "c", "d")
    climb2, up2 = _climb_sql("mid", group_levels, "e", "g")
    return f"""
WITH RECURSIVE crc_t(i, k, c) AS (SELECT i, 0, i::bigint FROM range(256) r(i) UNION ALL
    SELECT i, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM crc_t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM crc_t WHERE k = 8),
docs AS (SELECT d.*, row_number() OVER () AS doc, coalesce('=' || lang, '-') AS g, {leaf_of("text")} AS leaf,
    {leaf_of(f"translate(text, '{UPPER}', '{LOWER}')")} AS other,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc32 FROM documents d, crc),
ordered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM docs),
placed AS (SELECT g, idx, n, leaf AS h FROM ordered),
{tree},
subs AS (SELECT '' AS g, row_number() OVER (ORDER BY t.g) - 1 AS idx, count(*) OVER () AS n, h, t.g AS name FROM {last} t),
{tree2},
start AS (SELECT doc, g, idx, CASE WHEN crc32 % 3 = 0 THEN other ELSE leaf END AS f, '' AS proof FROM ordered),
{climb},
mid AS (SELECT c.doc, '' AS g, s.idx, c.f, c.proof FROM {up} c JOIN subs s ON c.g = s.name),
{climb2}
SELECT o.doc_id, o.leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.f AS folded_root, e.f = r.h AS verified
FROM ordered o JOIN {up2} e USING (doc) JOIN subs s ON o.g = s.name, {last2} r
"""


OP12_SQL = manifest_sql()
