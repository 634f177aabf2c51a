"""Merkle manifest of a table: a digest for each row, a tree of digests for each group, one root over the groups.

Levels are built by windows: nodes are partitioned by group and parent index, and a full-frame
``collect_list`` in order of place gives each parent's children, which are its preimage and, for
each child, its siblings.  One row a parent goes on to the next level, so a level has a sixteenth
of the rows of the one before.  Proofs go down again: each level joins its parents' paths, and a
leaf meets its parent's path in one join.

Places within a group come from a range partitioning of all rows by (group, key), numbered range
by range, so a group of any share of the rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timbrel.llm.rows import quoted
from timbrel.llm.textkit import crc32_sql
from timbrel.sources.tables import forget, settle

#: Children of a node.
FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests of the siblings to the left and right of a node, level by level.
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def spelled(value: Column) -> Column:
    """A value that cannot run into the next one: ``-`` for null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` (a settled table) with place (from 0, by ``order``, nulls first) and n (rows) within each group.

    Rows are sorted by ranges of (group, order); equal rows are dealt apart by where they lie in the
    table.  Only each range's sizes meet, one row for each group in it.
    """
    keys = [quoted(group), *map(quoted, order), F.col("lies")]
    spread = rows.withColumn("lies", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = settle(spread.drop("lies").withColumn("at", F.monotonically_increasing_id()))  # range << 33 | row in the range
    of_range = F.shiftright("at", 33)
    sizes = ranged.groupBy(quoted(group).alias("own"), of_range.alias("range")).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    earlier = W.partitionBy("own").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    starts = settle(sizes.select("own", "range", (before - F.col("first")).alias("shift"), F.sum("size").over(W.partitionBy("own")).alias("n")))
    met = ranged.join(starts, quoted(group).eqNullSafe(F.col("own")) & (of_range == F.col("range")))
    return met.select(*[quoted(c) for c in rows.columns], (F.col("at") + F.col("shift")).alias("place"), "n")


def levels(nodes: DataFrame, group: str, most: int) -> list[DataFrame]:
    """The levels over ``nodes`` (group, place, n, digest), lowest first: (group, place, n, digest, run).

    ``run`` has the digests of a node's children; ``most`` is the largest group's size.  A group
    that is down to one node is not carried further.
    """
    out, below = [], nodes
    while most > 1:
        family = W.partitionBy(group, "parent").orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        children = below.where("n > 1").select(group, "place", "n", "digest", F.floor(F.col("place") / FANOUT).alias("parent"))
        parents = children.withColumn("run", F.collect_list("digest").over(family)).dropDuplicates([group, "parent"])
        below = settle(parents.select(group, F.col("parent").alias("place"), F.ceil(F.col("n") / FANOUT).alias("n"), digest(F.array_join("run", "")).alias("digest"), "run"))
        out.append(below)
        most = -(-most // FANOUT)
    return out


def tops(nodes: DataFrame, above: list[DataFrame], group: str) -> DataFrame:
    """(group, digest): the last node of each group."""
    out = nodes.where("n = 1").select(group, "digest")
    for level in above:
        out = out.unionByName(level.where("n = 1").select(group, "digest"))
    return out


def downward(nodes: DataFrame, above: list[DataFrame], group: str, crown: Callable[[DataFrame], DataFrame], carried: Sequence[str]) -> DataFrame:
    """``nodes`` with path and the ``carried`` columns that ``crown`` gives each group's last node, together with its path."""
    known = None
    for level in [*reversed(above), nodes]:
        found = crown(level.where("n = 1"))
        if known is not None:
            up = known.select(F.col(group).alias("up_group"), F.col("place").alias("up_place"), F.col("run").alias("up_run"), F.col("path").alias("up_path"), *carried)
            mine = F.pmod("place", F.lit(FANOUT)).cast("int")
            step = F.struct(F.array_join(F.slice("up_run", F.lit(1), mine), "").alias("left"), F.array_join(F.slice("up_run", mine + 2, F.lit(FANOUT)), "").alias("right"))
            met = level.where("n > 1").join(up, F.col(group).eqNullSafe(F.col("up_group")) & (F.floor(F.col("place") / FANOUT) == F.col("up_place")))
            found = found.unionByName(met.select(*[quoted(c) for c in level.columns], F.concat(F.array(step), "up_path").alias("path"), *carried))
        known = found
    return known


@dataclass
class Manifest:
    """leaves (group, key, leaf, place, n and what else was carried), the levels of all groups' trees, the groups'
    last nodes (group, place, n, digest), the levels over them, and the root (None of an empty table)."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top_levels: list[DataFrame]
    root: str | None

    def nodes(self) -> DataFrame:
        """(tree, level, group, place, digest): all nodes, leaves at level 0 of tree ``rows``, the subroots at level 0 of tree ``groups``."""
        out = None
        for tree, bottom, above in (("rows", self.leaves.withColumnRenamed("leaf", "digest"), self.levels), ("groups", self.subroots, self.top_levels)):
            for k, level in enumerate([bottom, *above]):
                part = level.select(F.lit(tree).alias("tree"), F.lit(k).alias("level"), "group", "place", "digest")
                out = part if out is None else out.unionByName(part)
        return out

    def prove(self) -> DataFrame:
        """The leaves with subroot, root and path: the digests left and right of each node from the leaf to the root."""
        none = F.array().cast(PATH)
        subroots = downward(self.subroots.withColumn("all", F.lit(0)), [level.withColumn("all", F.lit(0)) for level in self.top_levels], "all", lambda last: last.withColumn("path", none), ())
        crown = subroots.select(F.col("group").alias("own"), F.col("digest").alias("subroot"), "path")
        met = downward(self.leaves, self.levels, "group", lambda last: last.join(crown, F.col("group").eqNullSafe(F.col("own"))).drop("own"), ("subroot",))
        return met.withColumn("root", F.lit(self.root).cast("string"))


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, also: dict[str, Column] | None = None) -> Manifest:
    """The trees over ``rows``: by ``key`` within each ``group``, then over the groups in order, null first.

    A leaf is the digest of the ``fields`` in order, so nulls, empty and very long texts each have one.  Leaves ascend
    by key (null first), ties by digest; repeated rows are leaves side by side.  ``also`` names expressions over
    the rows that the leaves carry.  Columns besides these are ignored whatever their names; an empty table has no
    leaves and no root.
    """
    also = also or {}
    picked = rows.select(quoted(group).alias("group"), quoted(key).alias("key"), digest(*[spelled(quoted(f)) for f in fields]).alias("leaf"), *[c.alias(n) for n, c in also.items()])
    table = settle(picked)
    leaves = settle(numbered(table, "group", ["key", "leaf"]))
    forget(table)
    most = leaves.agg(F.max("n")).first()[0] or 0
    above = levels(leaves.withColumnRenamed("leaf", "digest"), "group", most)
    last = settle(tops(leaves.withColumnRenamed("leaf", "digest"), above, "group").withColumn("all", F.lit(0)))
    subroots = settle(numbered(last, "all", ["group"]).drop("all"))
    n_groups = subroots.count()
    over = levels(subroots.withColumn("all", F.lit(0)), "all", n_groups)
    root = tops(subroots.withColumn("all", F.lit(0)), over, "all").first()
    # of the levels over the groups, the place is the group's number
    over = [level.drop("all").withColumn("group", F.lit(None).cast(subroots.schema["group"].dataType)) for level in over]
    return Manifest(leaves, above, subroots, over, root["digest"] if root else None)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf leads to by its path."""
    return F.aggregate(path, start, lambda node, step: digest(step["left"], node, step["right"]))


def proof(path: Column) -> Column:
    """One digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def query(spark, sf_dir: str) -> DataFrame:
    """Every fifth document by checksum is tampered with after the tree is built: its capitals are lowered."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lowered = F.translate("text", UPPER, LOWER)
    shown = {"shown": F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, digest(*[spelled(lowered if f == "text" else F.col(f)) for f in FIELDS]))}
    told = manifest(docs, also=shown).prove()
    told = told.withColumn("folded_root", fold(F.coalesce("shown", "leaf"), F.col("path")))
    return told.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(text if f == "text" else f) for f in FIELDS) + ")"


def _runs(table: str, group: str) -> str:
    return f"SELECT k, {group}, place // 16 AS parent, list(digest ORDER BY place) AS run FROM {table} WHERE n > 1 GROUP BY ALL"


_STEP = "array_to_string(run[1:m], '') || '|' || array_to_string(run[m + 2:], '')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS shown FROM documents),
p AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM d),
v AS (SELECT 0 AS k, source, place, n, leaf AS digest FROM p
      UNION ALL SELECT k + 1, source, place // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM v WHERE n > 1 GROUP BY k, source, place // 16),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM v WHERE n = 1),
t AS (SELECT 0 AS k, place, n, subroot AS digest FROM s
      UNION ALL SELECT k + 1, place // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM t WHERE n > 1 GROUP BY k, place // 16),
rv AS ({_runs("v", "source")}), rt AS ({_runs("t", "0 AS none")}),
a AS (SELECT p.r, rv.k, rv.run, (p.place // CAST(16 ** rv.k AS BIGINT)) % 16 AS m FROM p JOIN rv ON rv.source IS NOT DISTINCT FROM p.source AND rv.parent = p.place // CAST(16 ** (rv.k + 1) AS BIGINT)
      UNION ALL SELECT p.r, 100 + rt.k, rt.run, (s.place // CAST(16 ** rt.k AS BIGINT)) % 16 FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN rt ON rt.parent = s.place // CAST(16 ** (rt.k + 1) AS BIGINT)),
w AS (SELECT r, list({_STEP} ORDER BY k) AS steps FROM a GROUP BY r),
o AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM t WHERE n = 1) AS root, coalesce(w.steps, []) AS steps, coalesce(p.shown, p.leaf) AS shown FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN w ON w.r = p.r),
f AS (SELECT *, list_reduce(list_prepend(shown, steps), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM o)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
