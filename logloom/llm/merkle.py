"""A Merkle manifest of a table: one tree for each group, one over the groups' roots, proofs by octopus multiproof.

A leaf is the hash of a row's fields. In each group leaves ascend by id; while several nodes
remain, every ``fan`` consecutive ones become their hash. Groups' roots, in the order of the
groups, become the root in the same way.

Rows are numbered by one range shuffle: a range of rows holds, in every tree it touches, one
run of consecutive leaves. What such a range needs for the proofs of all its leaves is the
union of the siblings on their paths less what it can hash itself; that follows from the ends of its
runs alone, a few coordinates for each level. These are fetched once by a join; the task derives the
inner nodes its leaves share, spells out the proof of every leaf and folds it.

A hot group is many ranges; no task sees more than a range and its missing nodes, and the driver only
counts.

Defined results: null fields are ``-``, null groups come first and are a group of their own;
rows equal in group and id are ordered by their hash, repeated rows stay repeated; null ids come first;
an empty table gives no rows; very long texts are hashed whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.session import stage, unstage

_TOP = -1  # the tree over the groups' roots


def field(value: str | Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*fields: str | Column) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def _numbered(leaves: DataFrame, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``part, tree, i`` and the runs ``part, tree, a, b, n`` of each range.

    ``tree`` numbers the groups in their order, ``i`` the leaves of one. Equal rows are told apart by
    ``m``, so that they can lie in several ranges.
    """
    parts = max(2 * leaves.sparkSession.sparkContext.defaultParallelism, -(-leaves.count() // range_rows))
    order = ["grp", "id", "leaf", "m"]
    laid = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = stage(laid.drop("m").withColumn("at", at).withColumn("part", F.shiftright("at", 33).cast("int")))
    of_group = Window.partitionBy("grp")
    runs = rows.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("len"))
    runs = runs.select(
        "*",
        F.coalesce(F.sum("len").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("a"),
        F.sum("len").over(of_group).alias("n"),
    )
    runs = stage(runs.withColumn("new", (F.col("a") == 0).cast("long")))
    # one row for each range: how many groups begin in earlier ones
    begun = runs.groupBy("part").agg(F.sum("new").alias("begun"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select("part", F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("before"))
    in_part = Window.partitionBy("part").orderBy("grp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = runs.withColumn("own", F.sum("new").over(in_part) - 1).join(begun, "part")
    tree = F.max(F.when(F.col("new") == 1, F.col("before") + F.col("own"))).over(of_group)
    named = stage(named.select("part", "grp", tree.alias("tree"), "first", "a", (F.col("a") + F.col("len")).alias("b"), "n"))
    here = named.select(F.col("part").alias("__part"), F.col("grp").alias("__grp"), "tree", "first", "a", "n")
    same = (F.col("part") == F.col("__part")) & F.col("grp").eqNullSafe(F.col("__grp"))
    placed = rows.join(here, same).withColumn("i", F.col("at") - F.col("first") + F.col("a"))
    placed = stage(placed.drop("__part", "__grp", "at", "first", "a"))
    unstage(rows, runs)
    return placed, named


def grow(level: DataFrame, fan: int) -> list[DataFrame]:
    """Staged levels ``tree, level, i, n, h`` over the nodes ``tree, i, n, h`` of level 0; ``n`` is the length of the level."""
    levels = [stage(level.select("tree", F.lit(0).alias("level"), "i", "n", "h"))]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        at = len(levels)
        above = levels[-1].filter("n > 1").groupBy("tree", F.floor(F.col("i") / fan).alias("i"))
        kids = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])  # at most ``fan``
        above = above.agg(F.ceil(F.min("n") / fan).cast("long").alias("n"), F.sha2(F.array_join(kids, ""), 256).alias("h"))
        levels.append(stage(above.select("tree", F.lit(at).alias("level"), "i", "n", "h")))
        most = -(-most // fan)
    return levels


def _missing(runs: DataFrame, fan: int) -> DataFrame:
    """``part, tree, level, i`` that a range with leaves ``a .. b - 1`` of a tree of ``n`` can't hash itself, with the tree's root."""
    kind = "array<struct<level:int,i:bigint>>"
    start = F.struct(
        F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("n").cast("long").alias("n"),
        F.lit(0).alias("level"), F.array().cast(kind).alias("out"),
    )

    def row(level: Column, begin: Column, end: Column) -> Column:
        """Coordinates ``begin .. end - 1``."""
        made = F.transform(F.sequence(begin, end - 1), lambda i: F.struct(level.alias("level"), i.alias("i")))
        return F.when(begin < end, made).otherwise(F.array().cast(kind))

    def step(s: Column, _: Column) -> Column:
        low, high = F.floor(s["a"] / fan), F.floor((s["b"] - 1) / fan) + 1
        near = F.concat(row(s["level"], low * fan, s["a"]), row(s["level"], s["b"], F.least(high * fan, s["n"])))
        up = F.struct(
            low.alias("a"), high.alias("b"), F.ceil(s["n"] / fan).cast("long").alias("n"),
            (s["level"] + 1).alias("level"), F.concat(s["out"], near).alias("out"),
        )
        return F.when(s["n"] > 1, up).otherwise(s)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.col("n").cast("double"))).cast("int"))
    end = F.aggregate(steps, start, step)
    root = F.array(F.struct(end["level"].alias("level"), F.lit(0).cast("long").alias("i")))
    found = runs.select("part", "tree", F.explode(F.array_union(end["out"], root)).alias("c"))
    return found.select("part", "tree", F.col("c.level").alias("level"), F.col("c.i").alias("i"))


def _hash(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class _Run:
    """Consecutive leaves of one tree, joined by fetched nodes: inner nodes once for all of them."""

    def __init__(self, first: int, leaves: list[str], n: int, fetched: dict[tuple[int, int], str], fan: int):
        self.fan, self.levels, self.memo = fan, [], {}
        level = 0
        while n > 1:
            low, high = first // fan, (first + len(leaves) - 1) // fan + 1
            begin, end = low * fan, min(high * fan, n)
            left = [fetched[level, i] for i in range(begin, first)]
            whole = left + leaves + [fetched[level, i] for i in range(first + len(leaves), end)]
            self.levels.append((begin, whole))
            leaves = [_hash(whole[j : j + fan]) for j in range(0, len(whole), fan)]
            first, n, level = low, -(-n // fan), level + 1
        self.root = leaves[0]

    def siblings(self, i: int, level: int = 0) -> tuple[str, ...]:
        """For each level from ``level`` on what stands left and right of the node on the path of ``i``."""
        if level == len(self.levels):
            return ()
        if level and (level, i) in self.memo:
            return self.memo[level, i]
        begin, whole = self.levels[level]
        low = i // self.fan * self.fan - begin
        here = i - begin
        near = ("".join(whole[low:here]), "".join(whole[here + 1 : low + self.fan]))
        out = (*near, *self.siblings(i // self.fan, level + 1))
        if level:
            self.memo[level, i] = out
        return out


def fold(leaf: str, siblings: Sequence[str]) -> str:
    """The root that a leaf gives with what stands left and right of its path."""
    for j in range(0, len(siblings), 2):
        leaf = _hash((siblings[j], leaf, siblings[j + 1]))
    return leaf


_OUT = "leaf string, subroot string, root string, proof string, folded string"


def manifest(
    df: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_column: str = "doc_id",
    group_column: str = "source",
    shown: Sequence[Column] | None = None,
    changed: Column | None = None,
    fan: int = 16,
    range_rows: int = 16384,
) -> DataFrame:
    """One row per row of ``df``: ``id, leaf, subroot, root, proof, folded``.

    ``proof`` is the hash of the siblings on the leaf's path, level by level. ``folded`` is the root that the
    path gives; where ``changed`` holds, it starts from the leaf of the fields ``shown`` instead, as a reader of a
    changed table would compute it.
    """
    other = leaf_hash(*shown) if shown is not None else F.lit(None).cast("string")
    other = F.when(changed, other) if changed is not None else other
    leaves = df.select(
        F.col(group_column).alias("grp"), F.col(id_column).alias("id"), leaf_hash(*fields).alias("leaf"), other.alias("other")
    )
    leaves = stage(leaves.withColumn("m", F.monotonically_increasing_id()))
    rows, runs = _numbered(leaves, range_rows)
    trees = grow(rows.select("tree", "i", "n", F.col("leaf").alias("h")), fan)
    roots = [t.filter("n = 1").select(F.col("tree").alias("i"), "h") for t in trees]
    subroots = roots[0]
    for r in roots[1:]:
        subroots = subroots.unionByName(r)
    groups = runs.agg(F.max("tree")).first()[0]
    groups = 0 if groups is None else groups + 1
    top = grow(subroots.select(F.lit(_TOP).cast("long").alias("tree"), "i", F.lit(groups).cast("long").alias("n"), "h"), fan)

    touched = runs.groupBy("part").agg(F.min("tree").alias("a"), (F.max("tree") + 1).alias("b"))
    touched = touched.select("part", F.lit(_TOP).cast("long").alias("tree"), "a", "b", F.lit(groups).cast("long").alias("n"))
    wanted = stage(_missing(runs.select("part", "tree", "a", "b", "n").unionByName(touched), fan))
    fetched = None
    for level in [*trees, *top]:
        got = wanted.join(level.select("tree", "level", "i", "h"), ["tree", "level", "i"])
        fetched = got if fetched is None else fetched.unionByName(got)

    def expand(own: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        nodes: dict[int, dict[tuple[int, int], str]] = {}
        for tree, level, i, h in zip(*(far[c].tolist() for c in ("tree", "level", "i", "h"))):
            nodes.setdefault(tree, {})[level, i] = h
        own = own.sort_values(["tree", "i"], kind="stable")
        found = {}
        for tree, g in own.groupby("tree", sort=True):
            found[tree] = _Run(int(g["i"].iloc[0]), g["leaf"].tolist(), int(g["n"].iloc[0]), nodes.get(tree, {}), fan)
        above = nodes[_TOP]
        over = _Run(min(found), [found[t].root for t in sorted(found)], groups, above, fan)
        root = above[max(level for level, _ in above), 0]
        ends = {}
        for tree, run in found.items():
            known = nodes[tree]
            ends[tree] = known[max(level for level, _ in known), 0], over.siblings(tree)
        out = {c: [] for c in ("subroot", "root", "proof", "folded")}
        for tree, i, leaf, changed_to in zip(*(own[c].tolist() for c in ("tree", "i", "leaf", "other"))):
            subroot, rest = ends[tree]
            path = (*found[tree].siblings(i), *rest)
            out["subroot"].append(subroot), out["root"].append(root), out["proof"].append(_hash(path))
            out["folded"].append(fold(changed_to if isinstance(changed_to, str) else leaf, path))
        return own[["id", "leaf"]].assign(**out)

    kind = df.schema[id_column].dataType
    dealt = rows.select("part", F.col("id").cast("string").alias("id"), "tree", "i", "n", "leaf", "other").groupBy("part")
    found = dealt.cogroup(fetched.groupBy("part")).applyInPandas(expand, f"id string, {_OUT}")
    result = stage(found.withColumn("id", F.col("id").cast(kind)))
    unstage(leaves, rows, runs, wanted, *trees, *top)
    return result
