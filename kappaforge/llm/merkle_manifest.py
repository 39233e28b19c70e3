"""Merkle manifest of a dataset, with nested-interval labels.

Every row is a leaf. The leaves of a group (a source) have ranks, and every node
carries the interval [lo, hi) of ranks that it covers: 16 neighbours of a level
become one node of the next, until a group has one node, its subroot. Subroots
in the order of their groups are the leaves of a last tree, whose node is the
root.

Ancestors are attached from the root down, one join a level: a node and its
parent meet in the bucket of the level, ``lo`` divided by the parent's width, if
the parent's interval contains the node's. What the parent's interval has beside
the node's own are the siblings: those that end before it and those that begin
after it. A bucket holds 16 nodes at most, so a group of any size has no hot key.

Ranks come from rows dealt by ranges of group and order: a task needs of the
others one count a group only.

Defined cases: a null group is a group, first in order; null fields are ``-``;
rows without an order value come first, rows of equal order by digest; equal
rows are leaves each. An empty table has no root and no proofs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kappaforge.llm.store import dropped, written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: every ``TAMPERED``-th id, by its checksum, is altered in a drill
TAMPERED = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest_of(*values: Column) -> Column:
    """Lowercase hex SHA-256 of fields: ``-`` for null, else byte count, colon, value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def ascii_lower(text: Column) -> Column:
    """Only A-Z lower-cased."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with lo (rank in the group, from 0), hi (lo + 1) and size of the group; nulls first."""
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    # where a task begins depends on a sample, so that numbers must be written down once
    dealt = written(dealt.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)
    tasks = dealt.groupBy(*by, "_task").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    group = W.partitionBy(*by)
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_task").alias("_of"), (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("size"))
    tasks = written(tasks, f"{name}-tasks")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    lo = F.col("_at") + F.col("_shift")
    return dealt.join(tasks, [*same, F.col("_task") == F.col("_of")]).select(*rows.columns, lo.alias("lo"), (lo + 1).alias("hi"), "size")


@dataclass
class Tree:
    """Levels of the trees of all groups: (grp, size, lo, hi, digest), and children above the leaves."""

    levels: list[DataFrame]
    fan: int

    def roots(self) -> DataFrame:
        """(grp, subroot) of every group."""
        found = [self._of_root(k).select("grp", F.col("digest").alias("subroot")) for k in range(len(self.levels))]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def _of_root(self, k: int) -> DataFrame:
        """The nodes of level ``k`` that are their group's last: no group has more levels than its size asks for."""
        return self.levels[k].where((F.col("size") <= self.fan**k) & (F.lit(k == 0) | (F.col("size") > self.fan ** max(k - 1, 0))))

    def _inner(self, k: int) -> DataFrame:
        return self.levels[k].where(F.col("size") > self.fan**k)

    def paths(self, tops: DataFrame | None = None) -> DataFrame:
        """The leaves with ``path`` (before, after: siblings' digests of every level up) and the columns of ``tops``.

        ``tops`` has grp, path (of the group's subroot, upwards) and columns that leaves take along; without it, roots have no path.
        """
        extra, above = [], None
        if tops is not None:
            extra = [c for c in tops.columns if c not in ("grp", "path")]
            tops = tops.select(F.col("grp").alias("_grp"), "path", *extra)
        for k in reversed(range(len(self.levels))):
            own = self._of_root(k)
            own = own.withColumn("path", F.array().cast("array<struct<before:string,after:string>>")) if tops is None else own.join(tops, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")
            if above is not None:
                own = own.unionByName(self._under(self._inner(k), above, k + 1, extra))
            above = own
        return above

    def _under(self, nodes: DataFrame, above: DataFrame, level: int, extra: list[str]) -> DataFrame:
        """``nodes`` with the path of their parents, to which the nodes' own siblings are added."""
        width = self.fan**level
        parent = above.select(F.col("grp").alias("_grp"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("children").alias("_children"), F.col("path").alias("_path"), *extra)
        bucket = F.floor(F.col("lo") / width) == F.floor(F.col("_lo") / width)
        inside = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
        met = nodes.join(parent, F.col("grp").eqNullSafe(F.col("_grp")) & bucket & inside)
        joined = lambda keep: F.array_join(F.transform(F.filter("_children", keep), lambda c: c.digest), "")
        siblings = F.struct(joined(lambda c: c.hi <= F.col("lo")).alias("before"), joined(lambda c: c.lo >= F.col("hi")).alias("after"))
        return met.withColumn("path", F.concat(F.array(siblings), F.col("_path"))).drop("_grp", "_lo", "_hi", "_children", "_path")

    def nodes(self) -> DataFrame:
        """(level, grp, lo, hi, digest) of every node."""
        found = [x.select(F.lit(k).alias("level"), "grp", "lo", "hi", "digest") for k, x in enumerate(self.levels)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def grown(leaves: DataFrame, fan: int = FAN) -> Tree:
    """The trees over ranked leaves (grp, size, lo, hi, digest and others)."""
    levels = [leaves]
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > fan ** (len(levels) - 1):
        k = len(levels)
        below = levels[-1].where(F.col("size") > fan ** (k - 1)).select("grp", "size", "lo", "hi", "digest")
        nodes = below.groupBy("grp", "size", F.floor(F.col("lo") / fan**k).alias("_bucket")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        digest = F.sha2(F.array_join(F.transform("children", lambda c: c.digest), ""), 256)
        levels.append(written(nodes.select("grp", "size", F.get("children", F.lit(0)).lo.alias("lo"), F.element_at("children", -1).hi.alias("hi"), digest.alias("digest"), "children"), "level"))
    return Tree(levels, fan)


@dataclass
class Manifest:
    """The tree of every group, the tree over the groups' subroots, and the root (none for an empty table)."""

    groups: Tree
    top: Tree
    root: str | None

    def nodes(self) -> DataFrame:
        """(tree, level, grp, lo, hi, digest): what a manifest on disk lists. Leaves of ``top`` are the groups' subroots."""
        return self.groups.nodes().withColumn("tree", F.lit("group")).unionByName(self.top.nodes().withColumn("tree", F.lit("top")).withColumn("grp", F.lit(None).cast("string"))).select("tree", "level", "grp", "lo", "hi", "digest")

    def proofs(self) -> DataFrame:
        """The leaves with grp, digest, subroot and path."""
        tops = self.top.paths().select(F.col("own").alias("grp"), "path", F.col("digest").alias("subroot"))
        return self.groups.paths(written(tops, "tops"))


def build(leaves: DataFrame, fan: int = FAN) -> Manifest:
    """The manifest of leaves (grp, key, digest and others): groups in bytewise order, leaves by key."""
    groups = grown(ranked(leaves, ["grp"], ["key", "digest"], "leaves").drop("key"), fan)
    subroots = groups.roots().select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("own"), F.col("subroot").alias("digest"))
    top = grown(ranked(subroots, ["grp"], ["own"], "subroots"), fan)
    last = top.roots().first()
    return Manifest(groups, top, last.subroot if last else None)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x.before, acc, x.after), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings' digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x.before, x.after)), ""), 256)


def drill(docs: DataFrame, text: str = "text", fields: tuple[str, ...] = FIELDS, by: str = "source", order: str = "doc_id", every: int = TAMPERED) -> DataFrame:
    """The proof of every row, and whether it tells the rows whose text was altered.

    Rows whose checksum of ``order`` ``every`` divides lose their text's upper case
    (A-Z); rows without an id and null texts stay as they are. Returns the order
    column, leaf, subroot, root, proof_sha256, folded_root and verified.
    """
    altered = F.coalesce(F.crc32(F.col(order).cast("string").cast("binary")) % every == 0, F.lit(False))
    forged = F.when(altered, digest_of(*(ascii_lower(F.col(c)) if c == text else F.col(c) for c in fields)))
    leaves = docs.select(F.col(by).cast("string").alias("grp"), F.col(order).alias("key"), F.col(order).alias("id"), digest_of(*map(F.col, fields)).alias("digest"), forged.alias("forged"))
    leaves = written(leaves, "digests")
    found = build(leaves)
    dropped(leaves)
    root = F.lit(found.root).cast("string")
    rows = found.proofs().withColumn("folded", fold(F.coalesce("forged", "digest"), F.col("path")))
    return rows.select(F.col("id").alias(order), F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))
