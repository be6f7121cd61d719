"""Queries of the core's data operators (problems 4 and 5)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import refresh
from ..operators.references import LINK_REFERENCES, Reference, name_key, orphan_counts, orphan_references
from ..session import scratch_path, table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Two runs over one state: up to the last but one succeeded run, then with the last one, which recomputes only the
    partitions whose fingerprints it changed and keeps what the first found for the others."""
    t = partial(table, spark, root)
    documents, runs, items = t("documents"), t("run_log"), t("run_items")
    state = scratch_path(spark, "p4state")
    last = runs.where("status = 'succeeded'").agg(F.max_by("run_id", F.struct("finished_at", "run_id")).alias("run_id"))
    refresh(spark, documents, runs, items.join(F.broadcast(last), "run_id", "left_anti"), state)
    return refresh(spark, documents, runs, items, state)


def _links(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {n: table(spark, root, n) for n in ("documents", "entities", "vocabularies", "document_sources", "entity_sources",
        "document_entities", "entity_vocabulary_links")}


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return orphan_references(_links(spark, root)).where("depth = 1").select("ref_table", "link_id", "ref_month")


def p5_counts(spark: SparkSession, root: str) -> DataFrame:
    return orphan_counts(orphan_references(_links(spark, root)))


#: Adds what a lost document takes with it: an entity all of whose source rows are orphans, and the links that name it.
CASCADE = LINK_REFERENCES + (
    Reference("entities", "entity_id", "name", "entity_sources", "entity_name", key=name_key, inherit_only=True),
    Reference("entity_vocabulary_links", "link_id", "entity_name", "entities", "name", "recorded_at", key=name_key, inherit_only=True),
)


def p5_cascade(spark: SparkSession, root: str) -> DataFrame:
    found = orphan_references(_links(spark, root), CASCADE)
    return found.select("ref_table", "link_id", "ref_month", "reason", F.col("depth").cast("int").alias("depth"))


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p5_counts": p5_counts, "p5_cascade": p5_cascade}

_WS = r"[\x1c-\x1f\x09-\x0d \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ID = f"nullif(lower(regexp_replace(@, '^{_WS}+|{_WS}+$', '', 'g')), '')"
_NAME = f"nullif(trim(regexp_replace(replace(lower(@), 'ß', 'ss'), '{_WS}+', ' ', 'g')), '')"


def _found_sql(child: str, column: str, time: str, parent: str, key: str, norm: str, where: str = "true") -> str:
    return f"""
    select '{child}' as ref_table, c.link_id, strftime(c.at at time zone 'UTC', '%Y-%m') as ref_month,
           case when p.k is null then 'missing' else 'late' end as reason, '{column}' as ref_column
    from (select link_id, {time} as at, {norm.replace('@', column)} as k from {child}) c
    left join (select {norm.replace('@', key)} as k, min(created_at) as made from {parent} where {where} group by 1) p on c.k = p.k
    where c.k is not null and (p.k is null or p.made > c.at)"""


_P5 = " union all ".join((
    _found_sql("document_sources", "document_id", "first_seen_at", "documents", "id", _ID,
        "coalesce(lower(trim(status)), '') <> 'deleted'"),
    _found_sql("entity_sources", "document_id", "recorded_at", "documents", "id", _ID, "coalesce(lower(trim(status)), '') <> 'deleted'"),
    _found_sql("document_entities", "entity_name", "recorded_at", "entities", "name", _NAME),
    _found_sql("entity_vocabulary_links", "vocabulary_id", "recorded_at", "vocabularies", "id", _ID),
))

_CASCADE_SQL = f"""
with direct as ({_P5}),
es as (select entity_name, link_id in (select link_id from direct where ref_table = 'entity_sources') as lost,
  {_NAME.replace('@', 'entity_name')} as k from entity_sources),
gone as (select k from es where k is not null group by k having bool_and(lost)),
ent as (select entity_id, name, {_NAME.replace('@', 'name')} as k from entities),
ent_lost as (select entity_id, k from ent where k in (select k from gone)),
ent_gone as (select k from ent where k is not null group by k having bool_and(k in (select k from gone))),
de as (select link_id, recorded_at, {_NAME.replace('@', 'entity_name')} as k from document_entities),
ev as (select link_id, recorded_at, {_NAME.replace('@', 'entity_name')} as k from entity_vocabulary_links)
select ref_table, link_id, ref_month, reason, 1 as depth from direct
union all select 'entities', entity_id, null, 'inherited', 2 from ent_lost
union all select 'document_entities', link_id, strftime(recorded_at at time zone 'UTC', '%Y-%m'), 'inherited', 3 from de
  semi join ent_gone using (k) anti join (select link_id from direct where ref_table = 'document_entities') using (link_id)
union all select 'entity_vocabulary_links', link_id, strftime(recorded_at at time zone 'UTC', '%Y-%m'), 'inherited', 3 from ev
  semi join ent_gone using (k) anti join (select link_id from direct where ref_table = 'entity_vocabulary_links') using (link_id)"""

ORACLE = {
    "p4_found": r"""
        with last as (
          select lower(trim(i.document_id)) as k, arg_max(lower(trim(i.content_hash)), (i.finished_at, i.item_id)) as h
          from run_items i join (select distinct run_id from run_log where status = 'succeeded') r using (run_id)
          where i.outcome = 'done' and i.document_id is not null group by 1)
        select d.doc_id from documents d left join last l on l.k = lower(trim(d.id))
        where coalesce(lower(trim(d.status)), '') <> 'deleted' and (l.h is null or l.h <> sha256(coalesce(d.text, '')))""",
    "p5_found": f"select ref_table, link_id, ref_month from ({_P5})",
    "p5_counts": f"select ref_table, ref_column, ref_month, 'direct' as kind, reason, count(*) as orphans from ({_P5}) group by all",
    "p5_cascade": _CASCADE_SQL,
}
