"""Merkle manifest of a dataset: one hash tree per group of rows, one over the groups' roots, and every row's proof.

Slot pivot: the children of a parent are spread into ``fanout`` columns by conditional aggregates, one per
slot. Concatenating the columns and hashing gives the parent; the columns other than a row's own are its
siblings. A block of up to ``BLOCK`` leaves stays together for all its levels, so one exchange serves ten
binary levels; then the block roots are the leaves of the next round. No task holds more than a block of a
group, however many rows the group has, and the rows of a block are told by their position in the group.

Positions come from one range sort of (group, order, leaf) and prefix sums of the counts per (group,
partition): no window over a whole group. Rows equal in all of these are told apart by their place in the input.

Defined results: a null group is a group of its own and comes first; groups follow by their UTF-8 bytes. Null
order keys come first; equal keys are ordered by leaf. A lone leaf is its group's subroot, a lone subroot the
root. Repeated rows each have a leaf. A text is hashed whole and leaves its task as a digest, whatever its length. Columns named like an output are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.common import quoted, stored

BLOCK = 1024  # leaves that climb together
OUTPUTS = ("leaf", "subroot", "root", "path")


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and the value's text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings along ``path`` lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``i`` (place in the group ``g``, from 0) and ``n`` (rows of the group)."""
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(count, *keys, F.col("tie")).sortWithinPartitions(*keys, F.col("tie")).drop("tie")
    placed = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    group = Window.partitionBy("g")  # one row per partition of the range sort
    parts = parts.select("g", "part", "first", F.sum("here").over(group).alias("n"), F.coalesce(F.sum("here").over(
        group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(parts, ["g", "part"]).withColumn("i", F.col("at") - F.col("first") + F.col("before")) \
        .drop("part", "at", "first", "before")


def _climb(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (g, i, n, node, ...) with ``block``, ``path`` within it and ``node`` = the block's root."""
    out = nodes.withColumns({"block": F.expr(f"i div {fanout ** levels}"),
                             "path": F.expr("cast(array() AS array<struct<before: string, after: string>>)")})
    out = out.repartition("g", "block")
    for k in range(levels):
        width = fanout ** k
        out = out.withColumns({"parent": F.expr(f"i div {width * fanout}"), "slot": F.expr(f"i div {width} % {fanout}")})
        family = Window.partitionBy("g", "block", "parent")
        slots = [f"s{j}" for j in range(fanout)]
        out = out.withColumns({s: F.max(F.when(F.col("slot") == j, F.col("node"))).over(family) for j, s in enumerate(slots)})
        before = F.concat_ws("", *[F.when(F.col("slot") > j, F.col(s)) for j, s in enumerate(slots)])
        after = F.concat_ws("", *[F.when(F.col("slot") < j, F.col(s)) for j, s in enumerate(slots)])
        several = F.col("n") > width  # nodes of the group are left to be hashed together at this level
        out = out.withColumns({
            "path": F.when(several, F.concat("path", F.array(F.struct(before.alias("before"), after.alias("after")))))
            .otherwise(F.col("path")),
            "node": F.when(several, F.sha2(F.concat_ws("", *slots), 256)).otherwise(F.col("node"))}).drop("parent", "slot", *slots)
    return out


def _trees(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` (g, i, n, node, carried columns) with ``path`` up to the group's root and ``top``, that root."""
    levels = max(k for k in range(1, 11) if fanout ** k <= BLOCK or k == 1)
    size = fanout ** levels
    rounds, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        climbed = stored(_climb(nodes, fanout, levels), "merkle-round")
        rounds.append(climbed)
        if most <= size:
            break
        most = -(-most // size)
        nodes = climbed.filter(F.col("i") % size == 0).select(
            "g", F.col("block").alias("i"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), "node")
    done = rounds.pop().drop("block").withColumnRenamed("node", "top")
    for climbed in reversed(rounds):  # a block's rows share the path above it
        above = done.select("g", F.col("i").alias("block"), F.col("path").alias("above"), "top")
        done = climbed.drop("node").join(above, ["g", "block"]).withColumn("path", F.concat("path", "above")).drop("above", "block")
    return done


def manifest(df: DataFrame, fields: list[str], order: list[str], group: str, fanout: int = 2,
             carried: dict[str, Column] | None = None) -> DataFrame:
    """``order`` and ``group`` of each row of ``df``, the ``carried`` expressions, ``leaf`` (hash of ``fields``), ``subroot``
    (of its group), ``root`` and ``path``: per level from the leaf to the root the digests before and after its own."""
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    keys = [f"k{j}" for j in range(len(order))]
    extra = {f"x{j}": (name, c) for j, (name, c) in enumerate((carried or {}).items())}
    text = quoted(group).cast("string")
    rows = stored(df.select(
        F.coalesce(F.concat(F.lit("="), text), F.lit("")).alias("g"), quoted(group).alias("named"),
        *[quoted(c).alias(k) for c, k in zip(order, keys)], *[c.alias(x) for x, (_, c) in extra.items()],
        leaf_hash(quoted(c) for c in fields).alias("leaf")), "merkle-leaves")
    nodes = _positions(rows, [*keys, "leaf"]).withColumn("node", F.col("leaf"))
    leaves = stored(_trees(nodes, fanout).withColumnRenamed("top", "subroot").drop("n"), "merkle-trees")

    groups = leaves.filter("i = 0").select(F.col("g").alias("name"), F.col("subroot").alias("node"), F.lit("").alias("g"))
    tops = _trees(_positions(groups, ["name"]), fanout).select(
        F.col("name").alias("g"), F.col("path").alias("above"), F.col("top").alias("root"))
    out = leaves.join(tops, "g").withColumn("path", F.concat("path", "above"))
    shown = [F.col(k).alias(c) for c, k in zip(order, keys)] + [F.col("named").alias(group)]
    taken = {*(c.lower() for c in [*order, group]), *OUTPUTS}
    return out.select(*[c for name, c in zip([*order, group], shown) if name.lower() not in OUTPUTS],
                      *[F.col(x).alias(name) for x, (name, _) in extra.items() if name.lower() not in taken], *OUTPUTS)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered_leaf() -> Column:
    """The leaf of a document whose n_chars grew by one where 7 divides the checksum of its id; else its own."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    counted = F.col("n_chars") + F.when(hit, F.lit(1)).otherwise(F.lit(0))
    return leaf_hash(counted if f == "n_chars" else F.col(f) for f in FIELDS)


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` and, per document, whether the possibly tampered row still proves the root."""
    made = manifest(docs.select(*FIELDS), FIELDS, ["doc_id"], "lang", carried={"tampered": tampered_leaf()})
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                       fold(F.col("tampered"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def duckdb_sql() -> str:
    """The audit with recursive levels and a bitwise checksum, independent of the slot pivot."""
    def field(name: str) -> str:
        text = f"CAST({name} AS VARCHAR)"
        return f"coalesce(strlen({text}) || ':' || {text}, '-')"

    def leaf(count: str) -> str:
        return "sha256(" + " || ".join(field(count if f == "n_chars" else f) for f in FIELDS) + ")"
    crc = ("xor(list_reduce([4294967295::BIGINT] || list_transform(str_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), "
           "lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
    changed = f"(n_chars + CASE WHEN {crc} % 7 = 0 THEN 1 ELSE 0 END)"

    def levels(name: str, base: str) -> str:
        return f"""{name}(level, g, i, n, h) AS (
  SELECT 0, g, i, n, h FROM {base}
  UNION ALL
  SELECT level + 1, g, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM {name} WHERE n > 1 GROUP BY level, g, i // 2)"""
    return f"""
WITH RECURSIVE
docs AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('n_chars')} AS h, {leaf(changed)} AS changed FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM docs),
{levels('low', 'leaves')},
subs AS MATERIALIZED (SELECT g AS name, '' AS g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
{levels('high', 'subs')},
steps AS (
  SELECT v.g, v.i, x.level, x.i % 2 AS side, x.h FROM leaves v JOIN low x ON x.g = v.g AND x.i = xor(v.i >> x.level, 1)
  UNION ALL
  SELECT v.g, v.i, 100 + x.level, x.i % 2, x.h FROM leaves v JOIN subs s ON s.name = v.g JOIN high x ON x.i = xor(s.i >> x.level, 1)),
lone AS (
  SELECT v.g, v.i, x.level FROM leaves v JOIN low x ON x.g = v.g AND x.i = v.i >> x.level AND x.n > 1
  UNION ALL
  SELECT v.g, v.i, 100 + x.level FROM leaves v JOIN subs s ON s.name = v.g JOIN high x ON x.i = s.i >> x.level AND x.n > 1),
paths AS (
  SELECT lone.g, lone.i, list({{'side': side, 'h': coalesce(h, '')}} ORDER BY level) AS path
  FROM lone LEFT JOIN steps USING (g, i, level) GROUP BY lone.g, lone.i),
folded AS (
  SELECT v.*, s.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(path, []) AS path
  FROM leaves v JOIN subs s ON s.name = v.g LEFT JOIN paths p ON p.g = v.g AND p.i = v.i),
done AS (
  SELECT doc_id, h AS leaf, subroot, root, sha256(list_aggregate(list_transform(path, lambda x: x.h) || [''], 'string_agg', '')) AS proof_sha256,
         list_reduce([changed] || list_transform(path, lambda x: coalesce(x.side, 1) || x.h),
                     lambda node, x: CASE WHEN x[1] = '0' THEN sha256(x[2:] || node) ELSE sha256(node || x[2:]) END) AS folded_root
  FROM folded)
SELECT *, folded_root = root AS verified FROM done
"""
