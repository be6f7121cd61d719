"""Consolidating pairwise matches into groups (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_alias
from ..operators.skew import hot_keys, salted_join
from ..session import discard, materialize, materialize_counted


#: Rows of edges from which hot nodes are looked for and salted; below it one task holds any of them.
SALT_FROM = 1_000_000


def _jump(parents: DataFrame, label: str) -> DataFrame:
    """Pointer jumping: every node takes its parent's parent, twice a step, until no label changes; each step is
    written out. Many nodes may share one parent: its one row is on the other side, so the engine splits the nodes'
    partition where it is skewed."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        one = parents.select("node", "parent").join(up, "parent", "left").select("node", F.coalesce("up", "parent").alias("parent"),
            (F.coalesce("up", "parent") != F.col("parent")).alias("moved"))
        two = one.join(up, "parent", "left").select("node", F.coalesce("up", "parent").alias("parent"),
            (F.col("moved") | (F.coalesce("up", "parent") != F.col("parent"))).alias("moved"))
        step, seen = materialize_counted(two, f"{label}-jump", moved=F.count_if("moved"))
        discard(parents)
        parents = step
        if not seen["moved"]:
            return parents


def connected_groups(edges: DataFrame, a: str = "a", b: str = "b", label: str = "groups") -> DataFrame:
    """node, group_id for every node of an edge between two different nodes; group_id is the smallest node it reaches.

    Each round every node takes the smallest label among itself and its neighbours (a combined minimum, so a hub with
    any number of edges is never gathered), pointer jumping flattens the resulting forest to its roots, and the edges
    are rewritten between roots; each round at least halves the roots that are left, whatever the diameter. All steps
    are written to the shared folder and deleted when nothing needs them. Nulls are no nodes; repeated edges and loops
    change nothing; no edges, no rows."""
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e, seen = materialize_counted(e.distinct(), f"{label}-edges", n=F.count(F.lit(1)))
    rounds: list[DataFrame] = []
    while seen["n"]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        forest = _jump(materialize(hook.select("node", F.least("node", "low").alias("parent")), f"{label}-hook"), label)
        rounds.append(forest)
        root = forest.select("node", "parent")
        hot_a, hot_b = (hot_keys(e, "a"), hot_keys(e, "b")) if seen["n"] >= SALT_FROM else ([], [])
        left = salted_join(e, root.toDF("a", "ra"), "a", F.col("b"), hot=hot_a)
        pair = salted_join(left.select("ra", "b"), root.toDF("b", "rb"), "b", F.col("ra"), hot=hot_b).where("ra <> rb")
        nxt, seen = materialize_counted(pair.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            f"{label}-edges", n=F.count(F.lit(1)))
        discard(e)
        e = nxt
    discard(e)
    if not rounds:
        # keeps the type of the nodes
        return edges.select(F.col(a).alias("node"), F.col(a).alias("group_id")).where("false")
    done = rounds[-1]
    top = done.select("node", F.col("parent").alias("group_id"))
    for forest in reversed(rounds[:-1]):
        above = top.select(F.col("node").alias("parent"), "group_id")
        step = materialize(forest.select("node", "parent").join(above, "parent", "left").select("node",
            F.coalesce("group_id", "parent").alias("group_id")), f"{label}-compose")
        discard(done, forest)
        done = top = step
    out = top.select("node", "group_id")
    out._kgloom_path = done._kgloom_path
    return out


def alias_groups(aliases: DataFrame) -> DataFrame:
    """alias_id, group_id for every row: the smallest alias_id of all rows that share a name with it, directly or not.

    Names are equal when entity_type is (null equals null) and the names are after trimming, collapsing white space
    and case folding. A missing or blank name connects nothing; a row that shares none is its own group. Repeated
    rows share a group; an empty table gives no rows; further columns are ignored."""

    def name(c: str):
        k = norm_alias(F.col(c))
        return F.when(k != "", F.concat(F.coalesce(F.concat(F.lit("="), F.col("entity_type")), F.lit("")), F.lit("\u0001"), k))

    rows = aliases.select("alias_id", F.array_distinct(F.array_compact(F.array(name("alias"), name("canonical_name")))).alias("names"))
    uses, seen = materialize_counted(rows.select("alias_id", F.explode("names").alias("name")), "alias-uses", n=F.count(F.lit(1)))
    first = uses.groupBy("name").agg(F.min("alias_id").alias("first"))
    hot = None if seen["n"] >= SALT_FROM else []
    stars = salted_join(uses, first, "name", F.col("alias_id"), hot=hot).where("alias_id <> first").select("alias_id", "first")
    groups = connected_groups(stars, "alias_id", "first", "aliases")
    discard(uses)
    return aliases.select("alias_id").join(groups.withColumnRenamed("node", "alias_id"), "alias_id", "left").select("alias_id",
        F.coalesce("group_id", "alias_id").alias("group_id"))
