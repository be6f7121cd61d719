"""Queries of this package and the SQL they are held against."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_name
from ..session import materialize, table
from . import canon, fusion, groups, markup, mixing, packing, subjects, variants


def _entities(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, root, n) for n in ("entities", "source_list", "entity_type_list"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return fusion.supplying_rows(*_entities(spark, root))


def p1_fused(spark: SparkSession, root: str) -> DataFrame:
    return fusion.fuse(*_entities(spark, root))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    t = partial(table, spark, root)
    return variants.variant_pairs(t("entities"), t("entity_aliases"), t("entity_type_list"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    t = partial(table, spark, root)
    return canon.map_entity_types(t("export_records"), t("entity_type_list"), entities=t("entities"))


def p1_groups(spark: SparkSession, root: str) -> DataFrame:
    """Every group comes out once with all its rows, and a posterior is a probability."""
    f = p1_fused(spark, root)
    ok = [F.coalesce(F.col(c).between(0, 1), F.lit(True)) for c in ("type_posterior", "confidence_posterior", "confidence")]
    return f.select("group_id", "n_rows", (ok[0] & ok[1] & ok[2]).alias("in_range"))


def p2_faults(spark: SparkSession, root: str) -> DataFrame:
    """Pairs in the wrong order, of equal folded names, or twice: none."""
    pairs = materialize(p2_found(spark, root), "pairs")
    form = table(spark, root, "entities").select("entity_id", norm_name("name").alias("form"))
    both = pairs.join(form.toDF("entity_id_a", "fa"), "entity_id_a").join(form.toDF("entity_id_b", "fb"), "entity_id_b")
    kinds = both.agg(F.count_if(F.col("entity_id_a") >= F.col("entity_id_b")).alias("unordered"),
        F.count_if(F.col("fa") == F.col("fb")).alias("equal_names"))
    twice = pairs.groupBy("entity_id_a", "entity_id_b").count().agg(F.count_if(F.col("count") > 1).alias("repeated"))
    return kinds.crossJoin(F.broadcast(twice))


def p3_rows(spark: SparkSession, root: str) -> DataFrame:
    """Every typed value is mapped or reported, to an entry of the list or to none."""
    known = table(spark, root, "entity_type_list").select("type_id", F.lit(True).alias("known"))
    found = p3_found(spark, root).join(F.broadcast(known), "type_id", "left")
    return found.select("record_id", "entity_pos", ((F.col("type_id") == 0) | F.coalesce("known", F.lit(False))).alias("valid"))


def _cleaned(spark: SparkSession, root: str) -> DataFrame:
    return markup.clean_markup(table(spark, root, "export_records").select("record_id", "content", "source"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return markup.markup_rows(_cleaned(spark, root))


def p6_clean(spark: SparkSession, root: str) -> DataFrame:
    return _cleaned(spark, root).select("record_id", "marked", "clean")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    found = groups.alias_groups(table(spark, root, "entity_aliases"))
    return found.where("group_id < alias_id").select("group_id", "alias_id")


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"), table(spark, root, "container_list"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.container_fill(p8_containers(spark, root), table(spark, root, "container_list"))


def _extremes(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """The least trusted listed source must not share a container with the most trusted ones."""
    rank = table(spark, root, "source_list").orderBy("priority", "source").select(F.lower(F.trim("source")).alias("s")).collect()
    return [(rank[0].s, r.s) for r in rank[-2:] if r.s != rank[0].s]


def p8_apart(spark: SparkSession, root: str) -> DataFrame:
    """Containers with sources kept apart, and what would be wrong with them."""
    docs, kinds, apart = table(spark, root, "documents"), table(spark, root, "container_list"), _extremes(spark, root)
    return packing.container_faults(materialize(packing.pack(docs, kinds, apart), "packed"), docs, kinds, apart)


def p8_faults(spark: SparkSession, root: str) -> DataFrame:
    docs, kinds = table(spark, root, "documents"), table(spark, root, "container_list")
    return packing.container_faults(materialize(packing.pack(docs, kinds), "packed"), docs, kinds)


def p9_faults(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_faults(materialize(p9_mix(spark, root), "mixed"), table(spark, root, "source_list"))


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "source_list"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_shares(p9_mix(spark, root), table(spark, root, "source_list"))


def _subjects(spark: SparkSession, root: str) -> DataFrame:
    return subjects.assign_subjects(table(spark, root, "documents"), table(spark, root, "subject_list"),
        table(spark, root, "subject_labels"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return _subjects(spark, root).select("doc_id", "subject_id")


def p10_composition(spark: SparkSession, root: str) -> DataFrame:
    """Documents per subject of the list, those without any included as null."""
    found = _subjects(spark, root)
    some = found.groupBy("subject_id").agg(F.countDistinct("doc_id").alias("documents"))
    return table(spark, root, "subject_list").select("subject_id", "subject_name").join(some, "subject_id", "left").select("subject_id",
        "subject_name", F.coalesce("documents", F.lit(0)).alias("documents"))


QUERIES = {
    "p1_found": p1_found, "p1_fused": p1_fused, "p1_groups": p1_groups, "p2_found": p2_found, "p2_faults": p2_faults, "p3_found": p3_found,
        "p3_rows": p3_rows, "p6_found": p6_found, "p6_clean": p6_clean,
        "p7_found": p7_found,
    "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_faults": p8_faults, "p8_apart": p8_apart, "p9_mix": p9_mix,
        "p9_faults": p9_faults, "p9_shares": p9_shares, "p10_found": p10_found, "p10_composition": p10_composition,
}

_WS = r"[\x1c-\x1f\x09-\x0d \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NAME = f"nullif(trim(regexp_replace(replace(lower(@), 'ß', 'ss'), '{_WS}+', ' ', 'g')), '')"

# Full-width forms to their plain ones, the part of NFKC that these names need.
_WIDE = "translate(§, '" + "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'",
    "''") + "\u3000', '" + "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''") + " ')"
_FOLD = f"trim(regexp_replace(replace(lower({_WIDE}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

_P1 = f"""
    with base as (
      select entity_id, {_FOLD.replace('§', 'name')} as k, entity_type, confidence, updated_at, aliases,
             coalesce((select max(priority) from source_list s where s.source = lower(trim(e.source))), 0) as prio
      from entities e where name is not null),
    kept as (select *, count(*) over (partition by k) as n, min(entity_id) over (partition by k) as g from base where k <> ''),
    dup as (select * from kept where n > 1),
    al as (
      select entity_id, count(distinct a) as m from (
        select entity_id, k, {_FOLD.replace('§', 'raw')} as a from (
          select entity_id, k, unnest(case when ltrim(aliases)[1] = '[' then cast(json(aliases) as varchar[])
                   when contains(aliases, '|') then string_split(aliases, '|') else string_split(aliases, ',') end) as raw
          from dup where aliases is not null and trim(aliases) <> '')) where a <> '' and a <> k group by 1)
    select g as group_id,
      coalesce(first(entity_id order by prio desc, updated_at desc nulls last, entity_id) filter (where entity_type in (select type_name
        from entity_type_list)), 0) as type_from,
      coalesce(first(entity_id order by m desc, updated_at desc nulls last, entity_id) filter (where m > 0), 0) as aliases_from,
      coalesce(first(entity_id order by updated_at desc nulls last, prio desc, entity_id) filter (where confidence >= 0 and confidence <=
        1), 0) as confidence_from
    from dup left join al using (entity_id) group by g"""

_FAULTS = "select container_kind, (select count(distinct doc_id) from documents) as documents, 0::bigint as overfull, 0::bigint as copies_together, 0::bigint as conflicts, 0::bigint as split_in_vain, 0::bigint as pieces_wrong from container_list"

_BLANK = f"regexp_replace(e.entity_type, '^{_WS}+|{_WS}+$', '', 'g')"

ORACLE = {
    "p1_found": _P1,
    "p1_groups": f"""select min(entity_id) as group_id, count(*) as n_rows, true as in_range
        from (select entity_id, {_FOLD.replace('§', 'name')} as k from entities where name is not null) where k <> '' group by k having count(*) > 1""",
    "p2_faults": "select 0::bigint as unordered, 0::bigint as equal_names, 0::bigint as repeated",
    "p3_rows": f"""select record_id, cast(p - 1 as integer) as entity_pos, true as valid
        from (select record_id, unnest(entities) as e, generate_subscripts(entities, 1) as p from export_records)
        where {_BLANK} <> '' and e.entity_type not in (select type_name from entity_type_list)""",
    "p8_faults": _FAULTS,
    "p8_apart": _FAULTS,
    "p9_faults": "select lower(trim(source)) as source, false as too_often, 0::bigint as used_twice_in_a_pass, 0::bigint as short_blocks, 0::bigint as pieces_wrong, false as share_off from source_list where target_share > 0",
    "p7_found": f"""
        with recursive uses as (
          select alias_id, entity_type as t, {_NAME.replace('@', 'alias')} as k from entity_aliases
          union select alias_id, entity_type, {_NAME.replace('@', 'canonical_name')} from entity_aliases),
        star as (select alias_id as a, min(alias_id) over (partition by t, k) as b from uses where k is not null),
        edge as (select a, b from star where a <> b union select b, a from star where a <> b),
        walk(id, low) as (select alias_id, alias_id from entity_aliases union select e.b, w.low from walk w join edge e on e.a = w.id where
        w.low < e.b)
        select min(low) as group_id, id as alias_id from walk group by id having min(low) < id""",
}
