"""Normalization by fixed tables: entity types, relation names, source priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ENTITY_TYPES, LEGACY_TYPES, OTHER_PRIORITY, RELATION_TYPES, TYPE_WORDS, UNKNOWN_PRIORITY
from .text import strip_space


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def entity_type(c: Column) -> Column:
    """The canonical type a word stands for; anything else is a concept."""
    return F.coalesce(_map(TYPE_WORDS)[F.lower(strip_space(c))], F.lit("Concepts"))


def relation_type(c: Column) -> Column:
    """Lower case with underscores if that is a known relation, else the trimmed original."""
    key = F.translate(F.lower(strip_space(c)), " -", "__")
    return F.when(key.isin(RELATION_TYPES), key).otherwise(strip_space(F.coalesce(c, F.lit(""))))


def migrated_type(c: Column) -> Column:
    return F.coalesce(_map(LEGACY_TYPES)[c], c)


def known_type(c: Column) -> Column:
    """Legacy types mapped, then only canonical ones; else null."""
    m = migrated_type(c)
    return F.when(m.isin(ENTITY_TYPES), m)


def source_priority(c: Column, priorities: dict[str, int]) -> Column:
    s = F.lower(strip_space(c))
    known = _map({k.lower(): v for k, v in priorities.items()} | {"unknown": UNKNOWN_PRIORITY, "": UNKNOWN_PRIORITY})[s]
    return F.when(s.isNull(), UNKNOWN_PRIORITY).otherwise(F.coalesce(known, F.lit(OTHER_PRIORITY)))


def compare_priority(a: Column, b: Column, priorities: dict[str, int]) -> Column:
    """-1, 0 or 1 as ``a`` ranks below, with or above ``b``."""
    return F.signum((source_priority(a, priorities) - source_priority(b, priorities)).cast("double")).cast("int")
