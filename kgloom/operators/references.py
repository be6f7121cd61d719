"""References to records that do not exist: direct orphans, and those inherited down the foreign-key graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_alias, strip_space
from ..session import discard, materialize, materialize_counted
from .skew import salted_join


def id_key(c: Column) -> Column:
    """Ids as compared: trimmed, lower case; blank is no reference."""
    k = F.lower(strip_space(c))
    return F.when(k != "", k)


def name_key(c: Column) -> Column:
    """Names as compared: trimmed, white space collapsed, case folded; blank is no reference."""
    k = norm_alias(c)
    return F.when(k != "", k)


@dataclass(frozen=True)
class Reference:
    """``child.column`` refers to ``parent.parent_key``. ``row_id`` identifies a child row, ``time`` and
    ``parent_time`` order the two; without them a late parent is not looked for. ``skewed``: one key may hold a
    large share of the child's rows. ``inherit_only``: a missing parent is no case here, only orphaned ones pass on."""

    child: str
    row_id: str
    column: str
    parent: str
    parent_key: str
    time: str | None = None
    parent_time: str | None = None
    key: Callable[[Column], Column] = id_key
    skewed: bool = False
    inherit_only: bool = False


#: The four references of the project's link tables.
LINK_REFERENCES = (
    Reference("document_sources", "link_id", "document_id", "documents", "id", "first_seen_at", "created_at"),
    Reference("entity_sources", "link_id", "document_id", "documents", "id", "recorded_at", "created_at"),
    Reference("document_entities", "link_id", "entity_name", "entities", "name", "recorded_at", "created_at", key=name_key, skewed=True),
    Reference("entity_vocabulary_links", "link_id", "vocabulary_id", "vocabularies", "id", "recorded_at", "created_at"),
)


def live_documents(documents: DataFrame) -> DataFrame:
    """Documents that still count as a parent: any status but deleted."""
    return documents.where(F.coalesce(F.lower(F.trim("status")), F.lit("")) != "deleted")


def _parents(parent: DataFrame, ref: Reference) -> DataFrame:
    made = F.min(ref.parent_time) if ref.parent_time else F.lit(None).cast("timestamp")
    return parent.select(ref.key(F.col(ref.parent_key)).alias("__key"),
        *([ref.parent_time] if ref.parent_time else [])).where("__key is not null").groupBy("__key").agg(made.alias("__made"),
            F.lit(True).alias("__there"))


def _children(child: DataFrame, ref: Reference) -> DataFrame:
    own = F.col(ref.time) if ref.time else F.lit(None).cast("timestamp")
    return child.select(F.col(ref.row_id).alias("link_id"), own.alias("__at"),
        ref.key(F.col(ref.column)).alias("__key")).where("__key is not null")


def direct_orphans(child: DataFrame, parent: DataFrame, ref: Reference) -> DataFrame:
    """Rows of ``child`` whose reference has no parent row or only one made later than the row's own time.

    Null or blank references are no case; an unknown time on either side is not late. Repeated rows each come out.
    Columns: link_id, ref_month (null without a time), reason (missing or late)."""
    rows, keys = _children(child, ref), _parents(parent, ref)
    joined = salted_join(rows, keys, "__key", F.col("link_id")) if ref.skewed else rows.join(keys, "__key", "left")
    late = F.coalesce(F.col("__made") > F.col("__at"), F.lit(False))
    return joined.where(F.col("__there").isNull() | late).select(
        "link_id", F.date_format("__at", "yyyy-MM").alias("ref_month"),
            F.when(F.col("__there").isNull(), "missing").otherwise("late").alias("reason")
    )


def orphan_references(tables: dict[str, DataFrame], references: tuple[Reference, ...] = LINK_REFERENCES) -> DataFrame:
    """Every orphan row of every reference: ref_table, ref_column, link_id, ref_month, reason, depth.

    Depth 1 are direct orphans. A record whose parents are all orphaned is an inherited orphan one level deeper:
    semi-joins run down the foreign-key graph until a round finds none; every round finds rows not found before, so
    cyclic data end too. Tables that are nobody's parent take no part in those rounds. Empty tables give no rows; other columns are ignored.
    ``documents`` with status deleted are no parents."""
    live = {n: live_documents(df) if n == "documents" and "status" in df.columns else df for n, df in tables.items()}

    def tag(df: DataFrame, ref: Reference, depth: int) -> DataFrame:
        return df.select(F.lit(ref.child).alias("ref_table"), F.lit(ref.column).alias("ref_column"), "link_id", "ref_month", "reason",
            F.lit(depth).alias("depth"))

    direct = [tag(direct_orphans(live[r.child], live[r.parent], r), r, 1) for r in references if not r.inherit_only]
    found = reduce(DataFrame.unionByName, direct)
    row_ids = {r.child: r.row_id for r in references}
    inner = [r for r in references if r.parent in row_ids]
    if not inner:
        return found
    # the keys as compared are worked out once for all rounds
    sides = {}
    for i, r in enumerate(inner):
        parent = live[r.parent].select(F.col(row_ids[r.parent]).alias("rid"),
            r.key(F.col(r.parent_key)).alias("__key")).where("__key is not null")
        sides[i] = materialize(parent, f"parents{i}"), materialize(_children(live[r.child], r), f"children{i}")
    level = materialize(found, "orphans")
    levels = [level]
    tables_ = sorted({r.parent for r in inner} | {r.child for r in inner})
    # the rows lost so far of the tables that take part, replaced round by round
    dead = materialize(level.where(F.col("ref_table").isin(tables_)).select("ref_table", "link_id").distinct(), "lost")
    while True:
        fresh = []
        for i, r in enumerate(inner):
            parent, rows = sides[i]
            gone = dead.where(F.col("ref_table") == r.parent).select(F.col("link_id").alias("rid"))
            new = level.where(F.col("ref_table") == r.parent).select(F.col("link_id").alias("rid")).distinct()
            sound = parent.join(gone, "rid", "left_anti").select("__key").distinct()
            keys = parent.join(new, "rid", "left_semi").select("__key").distinct().join(sound, "__key", "left_anti")
            hit = salted_join(rows, keys, "__key", F.col("link_id"), "left_semi") if r.skewed else rows.join(keys, "__key", "left_semi")
            known = dead.where(F.col("ref_table") == r.child).select("link_id")
            hit = hit.join(known, "link_id", "left_anti")
            fresh.append(tag(hit.select("link_id", F.date_format("__at", "yyyy-MM").alias("ref_month"), F.lit("inherited").alias("reason")),
                r, len(levels) + 1))
        level, seen = materialize_counted(reduce(DataFrame.unionByName, fresh), f"orphans{len(levels) + 1}", n=F.count(F.lit(1)))
        if not seen["n"]:
            discard(level, dead, *[x for pair in sides.values() for x in pair])
            break
        levels.append(level)
        more = materialize(dead.unionByName(level.select("ref_table", "link_id")).distinct(), "lost")
        discard(dead)
        dead = more
    return reduce(DataFrame.unionByName, levels)


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, column, month and kind (direct or inherited)."""
    kind = F.when(F.col("depth") == 1, "direct").otherwise("inherited")
    return orphans.groupBy("ref_table", "ref_column", "ref_month", kind.alias("kind"), "reason").agg(F.count("*").alias("orphans"))
