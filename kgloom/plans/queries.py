"""Queries over the test tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import engine
from ..functions import lookup, text
from ..operators import canonical, graph, inference, qa, upsert, vocabulary
from ..schemas import EVIDENCE_STATUS, RELATION_TYPES, TYPE_WORDS, empty
from ..session import table
from ..sources import readers, sinks
from ..vault import notes
from . import reconcile

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

WS = r"[\x1c-\x1f\x09-\x0d \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WIDE = "translate(§, '" + "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'",
    "''") + "　', '" + "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''") + " ')"


def low(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def alias_sql(c: str) -> str:
    return f"trim(regexp_replace({low(c)}, '{WS}+', ' ', 'g'))"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def name_sql(c: str) -> str:
    return f"trim(regexp_replace({low(WIDE.replace('§', c))}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


#: The aliases of a row of entities as a list.
ALIASES_SQL = f"""list_filter(list_transform(case when aliases is null then [] when ltrim(aliases)[1] = '[' then cast(json(aliases) as
    varchar[]) when contains(aliases, '|') then string_split(aliases, '|')
    else string_split(aliases, ',') end, lambda x: {strip_sql('x')}), lambda x: x is not null and x <> '')"""
HALF_TIME = "2024-07-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def T(spark: SparkSession, root: str, *names: str):
    got = [table(spark, root, n) for n in names]
    return got[0] if len(got) == 1 else got


# --- text functions -----------------------------------------------------------------------------------------------


@query("select doc_id, sha256(text) as content_hash from documents")
def content_hash(spark, root):
    return T(spark, root, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("select sha256(text) as hash, count(*) as n, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")
def duplicate_content(spark, root):
    d = T(spark, root, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))
    return d.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""select d.id, case when h.n = 1 then 'unique' else 'ambiguous' end as identity from documents d
          join (select sha256(text) as h, count(distinct id) as n from documents group by 1) h on h.h = sha256(d.text)""")
def identity_class(spark, root):
    d = T(spark, root, "documents").select("id", text.content_hash(F.col("text")).alias("content_hash"))
    return d.join(reconcile.identity_classes(d), F.col("content_hash") == F.col("hash")).select("id", "identity")


def _generic(spark, root) -> DataFrame:
    d = T(spark, root, "documents")
    return engine.extract_generic(d.select(F.col("doc_id").alias("seq"), "id", F.coalesce("title", F.lit("")).alias("title"),
        F.col("text").alias("content"), "source", F.coalesce("metadata", F.lit("{}")).alias("metadata")))


@query(rf"""
    with m as (select doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}\p{{M}}]', '_', 'g'),
      '\b[A-Z][A-Za-z]{{2,}}(?:{WS}+[A-Z][A-Za-z]{{2,}})*\b') as l from documents),
    u as (select doc_id, unnest(l) as name, generate_subscripts(l, 1) as p from m),
    f as (select doc_id, name, min(p) as p from u group by 1, 2)
    select doc_id, name, cast(row_number() over (partition by doc_id order by p) as integer) as pos from f qualify row_number() over
      (partition by doc_id order by p) <= 30""")
def extract_entities(spark, root):
    return _generic(spark, root).select(F.col("seq").alias("doc_id"), F.posexplode("entities").alias("pos", "e")).select("doc_id",
        F.col("e.name").alias("name"), (F.col("pos") + 1).alias("pos"))


@query(f"select doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> ''), 1, 120), ' ') as summary from documents")
def summary_120(spark, root):
    return _generic(spark, root).select(F.col("seq").alias("doc_id"), "summary")


@query(f"select entity_id, {name_sql('name')} as key from entities")
def normalize_name(spark, root):
    return T(spark, root, "entities").select("entity_id", text.norm_name("name").alias("key"))


@query(f"select alias_id, {alias_sql('alias')} as key from entity_aliases")
def normalize_alias(spark, root):
    return T(spark, root, "entity_aliases").select("alias_id", text.norm_alias(F.col("alias")).alias("key"))


_KEPT = r"regexp_replace(title, '[^\p{L}\p{N} _-]', '_', 'g')"


@query(f"select doc_id, coalesce(nullif(substr({strip_sql(_KEPT)}, 1, 120), ''), 'untitled') as file from documents")
def safe_filename(spark, root):
    return T(spark, root, "documents").select("doc_id", text.safe_filename(F.col("title")).alias("file"))


@query("select doc_id, substr(sha256('document:' || id), 1, 32) as page from documents")
def page_id(spark, root):
    return T(spark, root, "documents").select("doc_id", text.page_id("document", F.col("id")).alias("page"))


def _types_case(c: str) -> str:
    return f"case lower({strip_sql(c)}) " + " ".join(f"when '{k}' then '{v}'" for k, v in TYPE_WORDS.items()) + " else 'Concepts' end"


@query(f"select {_types_case('e.entity_type')} as entity_type, count(*) as n from (select unnest(entities) as e from export_records) group by 1")
def type_ontology(spark, root):
    e = T(spark, root, "export_records").select(F.explode("entities").alias("e"))
    return e.groupBy(lookup.entity_type(F.col("e.entity_type")).alias("entity_type")).agg(F.count("*").alias("n"))


def _relation_case(c: str) -> str:
    key = f"translate(lower({strip_sql(c)}), ' -', '__')"
    return f"case when {key} in ({', '.join(repr(r) for r in RELATION_TYPES)}) then {key} else {strip_sql(f'coalesce({c}, {chr(39)}{chr(39)})')} end"


@query(f"select {_relation_case('r.relation')} as relation, count(*) as n from (select unnest(relations) as r from export_records) group by 1")
def relation_name_norm(spark, root):
    r = T(spark, root, "export_records").select(F.explode("relations").alias("r"))
    return r.groupBy(lookup.relation_type(F.col("r.relation")).alias("relation")).agg(F.count("*").alias("n"))


def _priorities(spark, root) -> dict[str, int]:
    return {r.source: r.priority for r in T(spark, root, "source_list").collect()}


def _prio(c: str) -> str:
    k = f"lower({strip_sql(c)})"
    return f"case when {c} is null or {k} in ('', 'unknown') then 0 else coalesce((select priority from source_list s where s.source = {k}), 10) end"


@query(f"select d.link_id, cast(sign({_prio('d.source')} - {_prio('o.source')}) as integer) as cmp from document_sources d join documents o on o.id = d.document_id")
def source_priority_cmp(spark, root):
    d, o = T(spark, root, "document_sources", "documents")
    p = _priorities(spark, root)
    j = d.select("link_id", "source", F.col("document_id").alias("id")).join(o.select("id", F.col("source").alias("other")), "id")
    return j.select("link_id", lookup.compare_priority(F.col("source"), F.col("other"), p).alias("cmp"))


@query("select entity_id, greatest(0, least(1, coalesce(confidence, 1))) as confidence from entities")
def confidence_clamp(spark, root):
    return T(spark, root, "entities").select("entity_id", text.confidence(F.col("confidence")).alias("confidence"))


@query(f"""select record_id, cast(len(list_filter(coalesce(entities, []), lambda e: coalesce({strip_sql('e.name')}, '') <> '')) as integer)
    as entities,
    cast(len(list_filter(coalesce(relations, []), lambda r: coalesce({strip_sql('r.source')}, '') <> '' and
      coalesce({strip_sql('r.relation')}, '') <> '' and coalesce({strip_sql('r.target')}, '') <> '')) as integer) as relations,
    greatest(0, least(1, coalesce(importance, 0.5))) as importance, coalesce(nullif({strip_sql('document_type')}, ''), 'note') as
      document_type from export_records""")
def enriched_records(spark, root):
    raw = T(spark, root, "export_records").withColumn("seq", F.col("record_id"))
    return readers.parse_enriched(raw, "enriched").select(F.col("seq").alias("record_id"), F.size("entities").alias("entities"),
        F.size("relations").alias("relations"), "importance", "document_type")


@query()
def wikilinks(spark, root):
    return T(spark, root, "export_records").select("record_id", F.explode(notes.find_links("content")).alias("l")).select("record_id",
        F.col("l.start").alias("at"), F.col("l.raw").alias("raw"))


# --- stateful writes ----------------------------------------------------------------------------------------------


@query("select distinct entity_name, entity_type, source, document_id from entity_sources where document_id is not null")
def entity_source_set(spark, root):
    return T(spark, root, "entity_sources").where("document_id is not null").select("entity_name", "entity_type", "source",
        "document_id").distinct()


def _incoming(spark, root) -> DataFrame:
    raw = T(spark, root, "export_records").withColumn("seq", F.col("record_id"))
    e = readers.parse_enriched(raw, "enriched").select("seq", "id", F.posexplode("entities").alias("pos", "e"))
    return e.select(F.struct("seq", "pos").alias("seq"), F.col("id").alias("document_id"), "e.*")


_INCOMING = f"""(select record_id * 4096 + p - 1 as seq, id as document_id, {strip_sql('e.name')} as name, {_types_case('e.entity_type')} as
    entity_type,
    greatest(0, least(1, coalesce(e.confidence, 1))) as confidence, e.aliases as aliases
    from (select record_id, id, unnest(entities) as e, generate_subscripts(entities, 1) as p from export_records) where
      {strip_sql('e.name')} <> '')"""


@query(f"""with i as (select name, entity_type, confidence, aliases from {_INCOMING} union all select name, entity_type, case when
    isnan(confidence) then null else confidence end, {ALIASES_SQL} from entities where name is not null and entity_type is not null),
    a as (select distinct name, entity_type, {strip_sql('x')} as a from (select name, entity_type, unnest(aliases) as x from i) where
      {strip_sql('x')} <> '' and {strip_sql('x')} <> name),
    l as (select name, entity_type, string_agg(a, '|' order by {alias_sql('a')}, a) as aliases from a group by 1, 2)
    select i.name, i.entity_type, max(i.confidence) as confidence, coalesce(any_value(l.aliases), '') as aliases from i left join l on
      l.name = i.name and l.entity_type = i.entity_type group by 1, 2""")
def entity_upsert(spark, root):
    i = _incoming(spark, root).select("name", "entity_type", "aliases", "confidence")
    return upsert.merge_entities(_listed_entities(spark, root).where("entity_type is not null"), i).withColumn("aliases",
        F.array_join("aliases", "|"))


@query("""with old as (select l_suppkey, l_partkey, max(l_quantity) as q from lineitem where l_returnflag = 'R' group by 1, 2),
    new as (select l_suppkey, l_partkey, arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity)) as q from lineitem where l_returnflag
      <> 'R' group by 1, 2)
    select l_suppkey, l_partkey, coalesce(new.q, old.q) as l_quantity from old full join new using (l_suppkey, l_partkey)""")
def last_writer_relation(spark, root):
    old, new = T(spark, root, "lineitem").where("l_returnflag = 'R'"), T(spark, root, "lineitem").where("l_returnflag <> 'R'")
    seq = F.struct("l_orderkey", "l_linenumber").alias("seq")
    old = old.groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("l_quantity"))
    return upsert.last_wins(old, new.select("l_suppkey", "l_partkey", "l_quantity", seq), ["l_suppkey", "l_partkey"])


_HALF = "recorded_at < timestamptz '2024-07-01 00:00:00+00'"


@query(f"""with a as (select {alias_sql('alias')} as alias, entity_type, coalesce(canonical_name, '?') as c, alias_id, coalesce({_HALF},
    false) as old from entity_aliases where {alias_sql('alias')} <> ''),
    o as (select alias, entity_type, max(c) as c from a where old group by 1, 2), n as (select alias, entity_type, arg_min(c, alias_id) as c
      from a where not old group by 1, 2)
    select * from (select alias, entity_type, c as canonical_name from o union all select alias, entity_type, c from n where not exists
      (select 1 from o where o.alias = n.alias and o.entity_type is not distinct from n.entity_type))""")
def first_writer_alias(spark, root):
    a = T(spark, root, "entity_aliases").select(text.norm_alias(F.col("alias")).alias("alias"), "entity_type",
        F.coalesce("canonical_name", F.lit("?")).alias("canonical_name"), F.col("alias_id").alias("seq"),
            F.coalesce(F.col("recorded_at") < F.lit(HALF_TIME).cast("timestamp"), F.lit(False)).alias("old")).where("alias <> ''")
    old = a.where("old").groupBy("alias", "entity_type").agg(F.max("canonical_name").alias("canonical_name")).select("alias", "entity_type",
        "canonical_name")
    return upsert.first_wins(old, a.where("not old").drop("old"), ["alias", "entity_type"])


def _sources(spark, root):
    """Identities of the first half of the time as they stand in the table, those of the second arriving."""
    d = T(spark, root, "document_sources").withColumn("old",
        F.coalesce(F.col("first_seen_at") < F.lit(HALF_TIME).cast("timestamp"), F.lit(False)))
    cols = ["source", "source_id", "document_id", "metadata", F.col("first_seen_at").alias("seen_at"), F.col("link_id").alias("seq")]
    none = d.select(*cols[:4], F.col("first_seen_at"), F.col("first_seen_at").alias("last_seen_at")).limit(0)
    return upsert.register_sources(upsert.register_sources(none, d.where("old").select(*cols))[0], d.where("not old").select(*cols))


_SRC = f"""with b as (select lower({strip_sql('source')}) as source, {strip_sql('source_id')} as source_id, document_id, metadata,
    first_seen_at as s, link_id, coalesce(first_seen_at < timestamptz '2024-07-01 00:00:00+00', false) as old from document_sources),
    k as (select * from b where source <> '' and source_id <> '' and document_id is not null), o as (select *, first(document_id) over
      (partition by source, source_id order by not old, link_id) as owner from k)"""


@query(_SRC + " select source, source_id, owner as document_id, arg_max(metadata, (not old, link_id)) as metadata, epoch_us(min(s)) as first_seen, epoch_us(max(s)) as last_seen from o where document_id = owner group by 1, 2, 3")
def identity_owner(spark, root):
    return _sources(spark, root)[0].withColumn("first_seen", F.unix_micros("first_seen_at")).withColumn("last_seen",
        F.unix_micros("last_seen_at")).drop("first_seen_at", "last_seen_at")


@query(_SRC + " select document_id, source as existing_source, owner as existing_value, 'review' as resolution from o where document_id <> owner and not old")
def identity_conflicts(spark, root):
    return _sources(spark, root)[1].select("document_id", "existing_source", "existing_value", "resolution")


@query("""select id, case when content_hash is null then 'changed' when regexp_replace(lower(trim(content_hash)), '^sha-?256:', '') =
    sha256(text) then 'unchanged' else 'changed' end as change from documents""")
def document_changes(spark, root):
    d = T(spark, root, "documents")
    old = d.select("id", text.clean_hash(F.col("content_hash")).alias("content_hash"))
    return upsert.document_changes(old, d.select("id", text.content_hash(F.col("text")).alias("content_hash"))).select("id", "change")


@query("""with old as (select * from document_entities where recorded_at < timestamptz '2024-07-01 00:00:00+00'), new as (select * from
    document_entities where recorded_at >= timestamptz '2024-07-01 00:00:00+00')
    select document_id, entity_name, link_id from old where document_id not in (select document_id from new where document_id is not null)
      union all select document_id, entity_name, link_id from new""")
def delete_then_insert(spark, root):
    d = T(spark, root, "document_entities").select("document_id", "entity_name", "link_id", "recorded_at")
    cut = F.lit("2024-07-01 00:00:00").cast("timestamp")
    return upsert.replace_groups(d.where(F.col("recorded_at") < cut), d.where(F.col("recorded_at") >= cut),
        ["document_id"]).drop("recorded_at")


def _failures(spark, root) -> DataFrame:
    """Errors of the first half of the time as they stand in the table, those of the second arriving."""
    i = T(spark, root, "run_items").where("outcome = 'error'").select(F.lower("document_id").alias("document_id"),
        F.concat_ws(":", "run_id", "item_id").alias("error"), F.col("finished_at").alias("at"), F.col("item_id").alias("seq"))
    old = F.coalesce(F.col("at") < F.lit(HALF_TIME).cast("timestamp"), F.lit(False))
    return upsert.record_failures(upsert.record_failures(empty(spark, "processing_failures"), i.where(old)), i.where(~old))


_FAIL = """(with e as (select lower(document_id) as document_id, run_id || ':' || item_id as error, item_id, finished_at,
    coalesce(finished_at < timestamptz '2024-07-01 00:00:00+00', false) as old from run_items where outcome = 'error')
    select document_id, cast(least(least(count(*) filter (where old), 5) + count(*) filter (where not old), 5) as integer) as attempts,
      arg_max(error, (not old, item_id)) as last_error,
    coalesce(epoch_us(max(finished_at) filter (where not old)), epoch_us(max(finished_at))) as updated from e group by 1)"""


@query(f"select * from {_FAIL}")
def failure_queue(spark, root):
    return _failures(spark, root).select("document_id", "attempts", "last_error", F.unix_micros("updated_at").alias("updated"))


@query(f"select document_id, attempts from {_FAIL} where attempts < 5")
def retry_list(spark, root):
    return upsert.retryable(_failures(spark, root)).select("document_id", "attempts")


def _relations(spark, root) -> DataFrame:
    raw = T(spark, root, "export_records").withColumn("seq", F.col("record_id"))
    r = readers.parse_enriched(raw, "enriched").select("seq", "id", F.explode("relations").alias("r"))
    return r.select("seq", F.col("id").alias("document_id"), F.col("r.source").alias("source_name"), "r.relation",
        F.col("r.target").alias("target_name"), "r.confidence")


_REL = f"""(select record_id as seq, id as document_id, {strip_sql('r.source')} as source_name, {strip_sql('r.relation')} as relation,
    {strip_sql('r.target')} as target_name, greatest(0, least(1, coalesce(r.confidence, 1))) as confidence
    from (select record_id, id, unnest(relations) as r from export_records) where {strip_sql('r.source')} <> '' and
      {strip_sql('r.relation')} <> '' and {strip_sql('r.target')} <> '')"""


@query(f"""with r as {_REL} select entity_id, name from entities e where not exists (select 1 from document_entities d where d.entity_name =
    e.name and d.entity_type = e.entity_type)
    and not exists (select 1 from r where r.source_name = e.name) and not exists (select 1 from r where r.target_name = e.name)""")
def prune_orphans(spark, root):
    e, d = T(spark, root, "entities", "document_entities")
    return upsert.orphan_entities(e, d, _relations(spark, root)).select("entity_id", "name")


@query("""select distinct a.l_suppkey as source_name, 'performed' as relation, a.l_partkey as target_name from lineitem a
    where exists (select 1 from lineitem b where b.l_suppkey = a.l_suppkey and b.l_partkey = a.l_partkey and b.l_returnflag = 'R')""")
def relation_gc(spark, root):
    li = T(spark, root, "lineitem").select(F.col("l_suppkey").alias("source_name"), F.lit("performed").alias("relation"),
        F.col("l_partkey").alias("target_name"), "l_returnflag")
    return upsert.collect_relations(li.drop("l_returnflag").distinct(), li.where("l_returnflag = 'R'"))


_MAP = "(select alias as duplicate, entity_type, min(canonical_name) as canonical from entity_aliases where canonical_name is not null and alias is not null group by 1, 2 having count(distinct canonical_name) = 1)"


@query(f"""select d.document_id, coalesce(m.canonical, d.entity_name) as entity_name, d.entity_type, max(coalesce(d.confidence, -1)) as
    confidence from document_entities d
    left join {_MAP} m on m.duplicate = d.entity_name and m.entity_type = d.entity_type group by 1, 2, 3""")
def entity_merge_rewire(spark, root):
    a, d = T(spark, root, "entity_aliases", "document_entities")
    m = a.where("canonical_name is not null and alias is not null").groupBy(F.col("alias").alias("duplicate"),
        "entity_type").agg(F.min("canonical_name").alias("canonical"),
            F.countDistinct("canonical_name").alias("n")).where("n = 1").drop("n")
    rows = d.select("document_id", "entity_name", "entity_type", F.coalesce("confidence", F.lit(-1.0)).alias("confidence"))
    return upsert.rewire(rows, m, "entity_name", ["document_id", "entity_name", "entity_type"], ["entity_type"])


def _vocab(spark, root) -> DataFrame:
    v = T(spark, root, "vocabularies")
    cut = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")
    return v.select("id", "word", "traditional", "pinyin", "pos", "meaning_ko", cut("hsk_levels").alias("hsk_levels"),
        cut("wordbooks").alias("wordbooks"), "source", "metadata", "updated_at")


@query("""with m as (select id, min(id) over (partition by word) as c from vocabularies), j as (select m.c, v.* from vocabularies v join m
    using (id)),
    l as (select c, string_agg(distinct x, '|' order by x) as levels from (select c, unnest(string_split(coalesce(hsk_levels, ''), '|')) as
      x from j) where x <> '' group by 1)
    select j.c as id, first(word order by id) as word, coalesce(first(pinyin order by id) filter (where trim(pinyin) <> ''), '') as pinyin,
      coalesce(first(pos order by id) filter (where trim(pos) <> ''), '') as pos, coalesce(any_value(l.levels), '') as levels from j left
        join l using (c) group by 1""")
def vocabulary_merge(spark, root):
    v = _vocab(spark, root)
    m = v.select("word", "id").join(v.groupBy("word").agg(F.min("id").alias("canonical_id")),
        "word").select(F.col("id").alias("duplicate_id"), "canonical_id")
    out = upsert.merge_vocabulary(v, m)
    return out.select("id", "word", F.coalesce("pinyin", F.lit("")).alias("pinyin"), F.coalesce("pos", F.lit("")).alias("pos"),
        F.array_join("hsk_levels", "|").alias("levels"))


@query(f"""with e as (select name, case when entity_type in ('Companies', 'Brands') then 'Organizations' else entity_type end as t, case
    when isnan(confidence) then null else confidence end as c, {ALIASES_SQL} as l from entities where entity_type is not null),
    a as (select distinct name, t, {strip_sql('x')} as a from (select name, t, unnest(l) as x from e) where {strip_sql('x')} <> '' and
      {strip_sql('x')} <> name),
    l as (select name, t, string_agg(a, '|' order by {alias_sql('a')}, a) as aliases from a group by 1, 2)
    select e.name, e.t as entity_type, max(e.c) as confidence, coalesce(any_value(l.aliases), '') as aliases from e left join l on l.name =
      e.name and l.t = e.t group by 1, 2""")
def legacy_type_migration(spark, root):
    return upsert.migrate_types(_listed_entities(spark, root).where("entity_type is not null")).withColumn("aliases",
        F.array_join("aliases", "|"))


# --- canonicalization and vocabulary ------------------------------------------------------------------------------


@query("select alias, entity_type, string_agg(distinct canonical_name, '|' order by canonical_name) as names from entity_aliases where canonical_name is not null group by 1, 2 having count(distinct canonical_name) > 1")
def alias_ambiguous(spark, root):
    a = T(spark, root, "entity_aliases").where("canonical_name is not null")
    return a.groupBy("alias", "entity_type").agg(F.array_sort(F.collect_set("canonical_name")).alias("n")).where(F.size("n") > 1).select(
        "alias", "entity_type", F.array_join("n", "|").alias("names"))


def _claims(spark, root) -> DataFrame:
    a = T(spark, root, "entity_aliases").where("canonical_name is not null")
    return a.select(text.norm_alias(F.col("alias")).alias("alias"), "canonical_name", "entity_type").where("alias <> ''").distinct()


_UNIQUE = f"""(with a as (select distinct {alias_sql('alias')} as alias, canonical_name as n, entity_type as t from entity_aliases where
    canonical_name is not null and {alias_sql('alias')} <> ''),
    e as (select distinct {alias_sql('name')} as alias, name as n, entity_type as t from entities where entity_type is not null)
    select alias, min(n) as name from a group by 1 having count(*) = 1 union all select alias, min(n) from e where alias not in (select
      alias from a) group by 1 having count(*) = 1)"""


@query(f"select alias, name from {_UNIQUE}")
def unique_names(spark, root):
    e = T(spark, root, "entities").where("entity_type is not null")
    return canonical.unique_names(e, _claims(spark, root).where("entity_type is not null"))


@query(f"""with r as {_REL}, o as (select seq // 4096 as rec, seq, document_id, name, upper(name) as canonical from {_INCOMING}),
    ex as (select document_id, name, arg_max(canonical, seq) as c from o group by 1, 2), lo as (select document_id, {alias_sql('name')} as
      alias, arg_min(canonical, seq) as c from o group by 1, 2)
    select r.seq as record_id, r.source_name, coalesce(ex.c, lo.c, u.name, r.source_name) as canonical from r left join ex on ex.document_id
      = r.document_id and ex.name = r.source_name
    left join lo on lo.document_id = r.document_id and lo.alias = {alias_sql('r.source_name')} left join {_UNIQUE} u on u.alias =
      {alias_sql('r.source_name')}""")
def endpoint_resolution(spark, root):
    """Ends of relations by the entities of their own record (here known by upper case), then by the tables."""
    e = T(spark, root, "entities").where("entity_type is not null")
    names = canonical.unique_names(e, _claims(spark, root).where("entity_type is not null"))
    r = _relations(spark, root).select("seq", "document_id", F.col("source_name").alias("name"))
    own = _incoming(spark, root).select("document_id", "name", F.upper("name").alias("canonical"), "seq")
    return canonical.resolve_endpoints(r, own, names).select(F.col("seq").alias("record_id"), F.col("name").alias("source_name"),
        "canonical")


@query()
def resolve_entities(spark, root):
    """Order-dependent; held against a sequential model in the tests."""
    i = _incoming(spark, root)
    e = T(spark, root, "entities").where("name is not null and entity_type is not null").select("name", "entity_type",
        F.array().cast("array<string>").alias("aliases"), "confidence").dropDuplicates(["name", "entity_type"])
    claims = T(spark, root, "entity_aliases").where("canonical_name is not null and entity_type is not null").select(
        text.norm_alias(F.col("alias")).alias("alias"), "canonical_name", "entity_type",
            F.col("alias_id").alias("seq")).where("alias <> ''")
    first = upsert.first_wins(claims.drop("seq").limit(0), claims, ["alias", "entity_type"])
    return canonical.resolve_entities(i.select("seq", "name", "entity_type", "aliases", "confidence"), e, first).select("seq", "name",
        "entity_type", "canonical")


_FORMS = f"""(select distinct id as vocabulary_id, f as form from (select id, {alias_sql('word')} as f from vocabularies union all select
    id, {alias_sql('traditional')} from vocabularies)
    where f <> '' and length(f) >= case when regexp_matches(f, '[\\x{{4e00}}-\\x{{9fff}}]') then 2 else 3 end)"""
_MATCH = f"""(select d.doc_id, f.vocabulary_id, sum(len(list_filter(range(1, length(d.t) + 1), lambda i: substr(d.t, i, length(f.form)) =
    f.form))) as matches
    from (select doc_id, {alias_sql('text')} as t from documents) d join {_FORMS} f on contains(d.t, f.form) group by 1, 2)"""


@query(f"select doc_id, vocabulary_id, cast(matches as bigint) as matches, round(least(1.0, 0.8 + least(matches, 4) * 0.05), 6) as confidence from {_MATCH}")
def vocabulary_match(spark, root):
    m = vocabulary.match_counts(T(spark, root, "documents"), T(spark, root, "vocabularies"))
    return m.withColumn("confidence", vocabulary.match_confidence(F.col("matches")))


@query(f"""select distinct d.doc_id, v.id as vocabulary_id from (select doc_id, {alias_sql('text')} as t from documents) d
    join (select id, {alias_sql('word')} as f from vocabularies union select id, {alias_sql('traditional')} from vocabularies) v on v.f <>
      '' and contains(d.t, v.f)""")
def vocabulary_contains(spark, root):
    return vocabulary.contains_links(T(spark, root, "documents"), T(spark, root, "vocabularies")).select("doc_id", "vocabulary_id")


_TITLED = "(select distinct title as name, coalesce(document_type, '') as entity_type from documents where title is not null union select name, entity_type from entities where name is not null)"


@query(f"""select e.name as entity_name, e.entity_type, v.id as vocabulary_id from {_TITLED} e join vocabularies v on e.name = v.word
    union select e.name, e.entity_type, v.id from {_TITLED} e join vocabularies v on e.name = v.traditional""")
def entity_vocabulary_exact(spark, root):
    """Titles of vocabulary cards and names of entities that are a word."""
    d = T(spark, root, "documents").where("title is not null").select(F.col("title").alias("name"),
        F.coalesce("document_type", F.lit("")).alias("entity_type"))
    e = d.unionByName(T(spark, root, "entities").where("name is not null").select("name", "entity_type"))
    return vocabulary.link_entities(e, T(spark, root, "vocabularies")).select("entity_name", "entity_type", "vocabulary_id")


# --- inference and graph ------------------------------------------------------------------------------------------


def _chain_input(spark, root):
    li, p = T(spark, root, "lineitem", "part")
    made = li.groupBy("l_suppkey", "l_partkey").agg(F.max(1 - F.col("l_discount")).alias("confidence"))
    made = made.select(F.col("l_suppkey").cast("string").alias("source_name"), F.lit("performed").alias("relation"),
        F.format_string("part-%012d", "l_partkey").alias("target_name"), "confidence")
    of = p.select(F.format_string("part-%012d", "p_partkey").alias("source_name"), F.lit("part_of").alias("relation"),
        F.col("p_brand").alias("target_name"), F.lit(0.97).alias("confidence"))
    return made.unionByName(of), li.select(F.col("l_orderkey").cast("string").alias("document_id"),
        F.col("l_suppkey").cast("string").alias("source_name"), F.lit("performed").alias("relation"),
            F.format_string("part-%012d", "l_partkey").alias("target_name")).distinct()


@query("""with r as (select l_suppkey as s, l_partkey as b, max(1 - l_discount) as c from lineitem group by 1, 2)
    select cast(s as varchar) as source_name, p_brand as target_name, round(least(arg_max(c, b), 0.97) * 0.95, 6) as confidence, 'part-' ||
      lpad(cast(max(b) as varchar), 12, '0') as through, count(*) as paths from r join part on p_partkey = b group by 1, 2""")
def relation_chain(spark, root):
    rel, doc = _chain_input(spark, root)
    return inference.relation_chains(rel, doc).select("source_name", "target_name", "confidence", "through", "paths")


def _roles(spark, root) -> tuple[str, str]:
    """The most trusted listed source, and the one that most tracks come from."""
    s, d = T(spark, root, "source_list", "documents")
    top = s.orderBy(F.desc("priority"), "source").first()
    music = d.where("document_type = 'track'").groupBy(F.lower(F.trim("source")).alias("s")).count().orderBy(F.desc("count"), "s").first()
    return top.source if top else "", music.s if music else ""


def _sourced(spark, root) -> DataFrame:
    return T(spark, root, "documents").withColumn("source", F.lower(F.trim("source")))


_TOP = "(select source from source_list order by priority desc, source limit 1)"
_MUSIC = "(select lower(trim(source)) from documents where document_type = 'track' group by 1 order by count(*) desc, 1 limit 1)"


def _doc_links(spark, root) -> DataFrame:
    """Words of documents: those their texts hold, and those an alias of one of their entities stands for."""
    d = T(spark, root, "documents").select("id", "text")
    m = vocabulary.match_counts(d, T(spark, root, "vocabularies"), "text", "id")
    m = m.select(F.col("id").alias("document_id"), "vocabulary_id", vocabulary.match_confidence(F.col("matches")).alias("confidence"))
    v = T(spark, root, "entity_vocabulary_links").where("match_type = 'alias' and vocabulary_id is not null").select("entity_name",
        "vocabulary_id").distinct()
    e = T(spark, root, "document_entities").where("document_id is not null").select("document_id", "entity_name").distinct()
    return m.unionByName(e.join(v, "entity_name").select("document_id", "vocabulary_id", F.lit(0.8).alias("confidence")))


_LINKS = f"""(select document_id, vocabulary_id, max(cv) as cv from (select o.id as document_id, m.vocabulary_id, round(least(1.0, 0.8 +
    least(m.matches, 4) * 0.05), 6) as cv from {_MATCH} m join documents o using (doc_id)
    union all select e.document_id, v.vocabulary_id, 0.8 from (select distinct document_id, entity_name from document_entities where
      document_id is not null) e
    join (select distinct entity_name, vocabulary_id from entity_vocabulary_links where match_type = 'alias' and vocabulary_id is not null)
      v using (entity_name)) group by 1, 2)"""


@query(f"""with e as (select d.document_id, d.entity_name, d.entity_type, max(coalesce(d.confidence, 0)) as c from document_entities d join
    documents o on o.id = d.document_id where lower(trim(o.source)) = {_TOP} group by 1, 2, 3),
    j as (select e.*, v.vocabulary_id, v.cv from e join {_LINKS} v using (document_id))
    select entity_name as left_name, entity_type as left_type, vocabulary_id as right_id, round(least(arg_max(c, document_id), arg_max(cv,
      document_id)) * 0.9, 6) as confidence, max(document_id) as document_id from j group by 1, 2, 3""")
def same_document_link(spark, root):
    de, d = T(spark, root, "document_entities"), _sourced(spark, root)
    de = de.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return inference.same_document_links(de, d, _doc_links(spark, root), _roles(spark, root)[0]).select("left_name", "left_type",
        "right_id", "confidence", "document_id")


def _tracks(spark, root) -> DataFrame:
    """Relations that the lines of track documents state: artists performed the title, the title is part of the album."""
    d = T(spark, root, "documents").where("document_type = 'track'").select("id", F.split("text", "\n").alias("l")).where(F.size("l") >= 3)
    p = d.select(F.col("id").alias("document_id"), F.explode(F.split(F.col("l")[1], ", ")).alias("source_name"),
        F.lit("performed").alias("relation"), F.col("l")[0].alias("target_name"))
    return p.unionByName(d.select(F.col("id").alias("document_id"), F.col("l")[0].alias("source_name"), F.lit("part_of").alias("relation"),
        F.col("l")[2].alias("target_name"))).withColumn("confidence", F.lit(1.0))


_TRACKS = "(select id as document_id, string_split(text, chr(10)) as l from documents where document_type = 'track' and len(string_split(text, chr(10))) >= 3)"


def _bridges(spark, root) -> DataFrame:
    de, d = T(spark, root, "document_entities"), _sourced(spark, root)
    top, music = _roles(spark, root)
    de = de.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    t = _tracks(spark, root)
    titles = t.where("relation = 'part_of'").select(F.col("source_name").alias("name")).distinct().withColumn("entity_type",
        F.lit("MusicTracks"))
    return inference.three_way_links(de, d, _doc_links(spark, root), t, titles, top, music)


_BRIDGE = f"""e as (select d.document_id, d.entity_name, d.entity_type, max(coalesce(d.confidence, 0)) as c,
    any_value(lower(trim(o.source))) as s from document_entities d join documents o on o.id = d.document_id group by 1, 2, 3),
    l as (select e.entity_name, e.entity_type, v.vocabulary_id, e.document_id as d1, e.c as c1, v.cv from e join {_LINKS} v using
      (document_id) where e.s = {_TOP}),
    p as (select document_id, unnest(string_split(l[2], ', ')) as entity_name, l[1] as track from {_TRACKS}),
    r as (select e.entity_name, e.entity_type, p.track, e.document_id as d2, e.c as c3 from e join p using (document_id, entity_name) where
      e.s = {_MUSIC}),
    j as (select l.*, r.track, r.d2, r.c3, least(c1, cv, c3) as low from l join r using (entity_name, entity_type))"""


@query(f"""with {_BRIDGE} select entity_name as left_name, vocabulary_id as right_id, 'vocabulary' as right_kind, round(arg_max(low, (d1,
    d2, track)) * 0.9, 6) as confidence from j group by entity_name, entity_type, vocabulary_id
    union all select vocabulary_id, track, 'music_track', round(arg_max(low, (d1, d2, entity_name, low)) * 0.81, 6) from j group by 1, 2""")
def three_way_bridge(spark, root):
    return _bridges(spark, root).select("left_name", "right_id", "right_kind", "confidence")


@query(f"""with {_BRIDGE}, b as (select vocabulary_id, track, round(arg_max(low, (d1, d2, entity_name, low)) * 0.81, 6) as c from j group by
    1, 2), a as (select distinct l[1] as track, l[3] as album from {_TRACKS})
    select vocabulary_id as left_name, album as right_id, cast(round(cast(cast(least(arg_max(c, (track, c)), 1.0) * 0.95 as varchar) as
      decimal(30, 20)), 6) as double) as confidence from b join a using (track) group by 1, 2""")
def album_extension(spark, root):
    t = _tracks(spark, root)
    rel = t.select("source_name", "relation", "target_name", "confidence").distinct()
    return inference.album_links(_bridges(spark, root), rel, t).select("left_name", "right_id", "confidence")


_PER = """(select entity_name, entity_type, source, count(distinct document_id) as n from entity_sources
    where document_id is not null and source is not null and entity_name is not null group by 1, 2, 3)"""
_PAIRED = f"""(select a.entity_name, a.entity_type, a.source as source_a, b.source as source_b, a.n as documents_a, b.n as documents_b from
    {_PER} a
    join {_PER} b on a.entity_name = b.entity_name and a.entity_type is not distinct from b.entity_type and a.source < b.source)"""


@query(f"select * from {_PAIRED}")
def source_bridges(spark, root):
    return inference.source_bridges(T(spark, root, "entity_sources")).drop("confidence", "rule")


@query("""select distinct entity_name, entity_type, source, document_id from (select *, min(source) over (partition by entity_name,
    entity_type) as lo, max(source) over (partition by entity_name, entity_type) as hi
    from entity_sources where document_id is not null and source is not null and entity_name is not null) where lo < hi""")
def bridge_documents(spark, root):
    return inference.bridge_documents(T(spark, root, "entity_sources"))


@query("""with p as (select distinct entity_name, entity_type, source from entity_sources where source is not null)
    select a.source as source_a, b.source as source_b, count(*) as entities from p a join p b on a.entity_name is not distinct from
      b.entity_name and a.entity_type is not distinct from b.entity_type and a.source < b.source group by 1, 2""")
def bridge_pair_counts(spark, root):
    return inference.bridge_pairs(T(spark, root, "entity_sources"))


def unpacked(c) -> "F.Column":
    """Alias lists as the tables pack them: a JSON array, with pipes or with commas; blanks are left out."""
    plain = F.when(F.contains(c, F.lit("|")), F.split(c, r"\|")).otherwise(F.split(c, ","))
    parts = F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(plain)
    parts = F.coalesce(parts, F.array().cast("array<string>"))
    return F.filter(F.transform(parts, lambda x: text.strip_space(x)), lambda x: x.isNotNull() & (x != ""))


def _listed_entities(spark, root) -> DataFrame:
    return T(spark, root, "entities").where("name is not null").select("name", "entity_type", unpacked(F.col("aliases")).alias("aliases"),
        F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"))


@query("""select coalesce(entity_type, '') || ':' || name as id, name as label, max(case when isnan(confidence) then null else confidence
    end) as confidence from entities where name is not null group by entity_type, name
    union all select 'Vocabulary:' || id, word, 1.0 from vocabularies
    union all select 'SourceBridge:' || source_a || '|' || source_b, source_a || ' / ' || source_b, 1.0 from (select distinct a.source as
      source_a, b.source as source_b from entity_sources a join entity_sources b
      on a.entity_name = b.entity_name and a.entity_type is not distinct from b.entity_type and a.source < b.source and a.document_id is not
        null and b.document_id is not null)""")
def graph_nodes(spark, root):
    s = T(spark, root, "entity_sources")
    return graph.nodes(_listed_entities(spark, root), _vocab(spark, root), inference.source_bridges(s), s).select("id", "label",
        "confidence")


_INDEX = f"""(select key, min(id) as id from (select name as key, coalesce(entity_type, '') || ':' || name as id from entities where name is
    not null
    union select unnest({ALIASES_SQL}), coalesce(entity_type, '') || ':' || name from entities where name is not null
    union select alias, coalesce(entity_type, '') || ':' || canonical_name from entity_aliases where canonical_name is not null and alias is
      not null) group by 1 having count(distinct id) = 1)"""


@query(f"select key, id from {_INDEX}")
def name_index(spark, root):
    return graph.name_index(_listed_entities(spark, root), T(spark, root, "entity_aliases"))


def _evidence(spark, root) -> DataFrame:
    """One piece of evidence for each stated relation, by the record that states it."""
    status = F.element_at(F.array(*[F.lit(x) for x in EVIDENCE_STATUS]), (F.col("seq") % 3 + 1).cast("int"))
    return _relations(spark, root).select("document_id", "source_name", "relation", "target_name",
        F.concat(F.lit("ev-"), F.col("seq").cast("string")).alias("evidence_document_id"), status.alias("status"), "seq")


_EVID = f"(select document_id, source_name, relation, target_name, 'ev-' || seq as evidence_document_id, ['checked', 'contradicted', 'unverified'][cast(seq % 3 + 1 as integer)] as status, seq from {_REL})"


@query(f"""with r as {_REL}, v as (select source_name, relation, target_name, string_agg(distinct status || ':' || evidence_document_id, '|'
    order by status || ':' || evidence_document_id) as ev from {_EVID} group by 1, 2, 3),
    d as (select source_name, relation, target_name, max(confidence) as confidence, string_agg(distinct document_id, '|' order by
      document_id) as docs from r group by 1, 2, 3),
    x as (select a.id as source, relation, b.id as target, confidence, docs, ev, row_number() over (partition by a.id, relation, b.id order
      by source_name, target_name) as k from d join v using (source_name, relation, target_name) join {_INDEX} a on a.key = source_name join
        {_INDEX} b on b.key = target_name)
    select source, relation, target, confidence, docs as documents, ev as evidence from x where k = 1""")
def graph_edges(spark, root):
    r = _relations(spark, root)
    one = r.groupBy("source_name", "relation", "target_name").agg(F.max("confidence").alias("confidence"))
    index = graph.name_index(_listed_entities(spark, root), T(spark, root, "entity_aliases"))
    e = graph.relation_edges(one, index, _evidence(spark, root), r)
    return e.select("source", "relation", "target", "confidence", F.array_join("documents", "|").alias("documents"),
        F.array_join("evidence", "|").alias("evidence"))


@query("""select 'document' as kind, substr(sha256('document:' || id), 1, 32) as page_id, coalesce(title, id) as title from documents
    union all select 'entity', substr(sha256('entity:' || case when entity_type is null then '' else entity_type || ':' end || name), 1,
      32), name from (select distinct name, entity_type from entities where name is not null)
    union all select 'vocabulary', substr(sha256('vocabulary:' || id), 1, 32), word from vocabularies""")
def page_manifest(spark, root):
    d, v = T(spark, root, "documents", "vocabularies")
    return graph.manifest(d, _listed_entities(spark, root), v).select("kind", "page_id", "title")


# --- indexes, audit, reconciliation -------------------------------------------------------------------------------


@query("""select 'type' as kind, coalesce(entity_type, '') as key, count(*) as n from entities group by 2 union all select 'source',
    coalesce(source, ''), count(*) from documents group by 2
    union all select 'total', 'entities', count(*) from entities union all select 'total', 'documents', count(*) from documents union all
      select 'total', 'sources', count(distinct source) from documents""")
def index_counts(spark, root):
    e, d = T(spark, root, "entities", "documents")
    return sinks.knowledge_index(e, d)


@query("""with v as (select id, list_transform(string_split(coalesce(hsk_levels, ''), '|'), lambda x: regexp_replace(upper(trim(x)),
    '^HSK *', '')) as l from vocabularies)
    select id, list_has_any(l, ['6']) as hsk6, list_has_any(l, ['7', '8', '9', '7-9']) as hsk79 from v""")
def level_buckets(spark, root):
    v = _vocab(spark, root)
    return v.select("id", sinks.level_bucket(F.col("hsk_levels"), sinks.LEVELS["HSK6"]).alias("hsk6"),
        sinks.level_bucket(F.col("hsk_levels"), sinks.LEVELS["HSK7-9"]).alias("hsk79"))


@query("select link_id, entity_name, coalesce(confidence, 0) as confidence from entity_vocabulary_links order by coalesce(confidence, 0) desc, entity_name, link_id limit 100")
def top_links(spark, root):
    v = T(spark, root, "entity_vocabulary_links").select("link_id", "entity_name", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return v.orderBy(F.desc("confidence"), "entity_name", "link_id").limit(100)


@query("select doc_id, id from documents order by doc_id limit 250 offset 100")
def offset_limit(spark, root):
    return engine.select_slice(T(spark, root, "documents").select("doc_id", "id", F.col("doc_id").alias("seq")), 100, 250).drop("seq")


def _audit_tables(spark, root) -> dict[str, DataFrame]:
    names = ["documents", "document_sources", "entities", "document_entities", "entity_aliases", "entity_sources", "vocabularies",
        "entity_vocabulary_links"]
    t = dict(zip(names, T(spark, root, *names)))
    t["relations"] = _relations(spark, root).select("source_name", "relation", "target_name", "confidence").distinct()
    return t


_TYPES = "('People','Organizations','Countries','Places','Products','Technologies','Concepts','Events','Institutions','MusicTracks','MusicAlbums')"
_OK = "coalesce(confidence >= 0 and confidence <= 1 and not isnan(confidence), false)"
_HAS = "exists (select 1 from entities e where e.name = x.{0} and e.entity_type = x.entity_type)"
_ENT, _CAN = _HAS.format("entity_name"), _HAS.format("canonical_name")
_DOC = "exists (select 1 from documents d where d.id = x.document_id)"


@query(f"""with r as (select distinct source_name, relation, target_name, confidence from {_REL}), f as (
    select 'document_source.orphan' as rule, 'error' as severity from document_sources x where not {_DOC}
    union all select 'entity.invalid_type', 'error' from entities where coalesce(entity_type, '') not in {_TYPES}
    union all select 'entity.duplicate_pk', 'error' from (select 1 from entities group by name, entity_type having count(*) > 1)
    union all select 'entity.confidence_range', 'error' from entities where not {_OK}
    union all select 'alias.ambiguous', 'warning' from (select 1 from entity_aliases group by alias, entity_type having count(distinct
      canonical_name) > 1)
    union all select 'alias.orphan', 'error' from entity_aliases x where not {_CAN}
    union all select 'document_entity.orphan', 'error' from (select distinct * from document_entities) x where not {_DOC} or not {_ENT}
    union all select 'relation.orphan_endpoint', 'error' from r where source_name not in (select name from entities where name is not null)
      or target_name not in (select name from entities where name is not null)
    union all select 'relation.confidence_range', 'error' from r where not {_OK}
    union all select 'relation.self_loop', 'warning' from r where source_name = target_name
    union all select 'relation.invalid_name', 'error' from r where not regexp_matches(relation, '^[a-z][a-z0-9_]*$')
    union all select 'entity_source.orphan', 'error' from (select distinct * from entity_sources) x where not {_DOC} or not {_ENT}
    union all select 'entity_vocabulary.orphan', 'error' from (select distinct * from entity_vocabulary_links) x where not {_ENT} or not
      exists (select 1 from vocabularies v where v.id = x.vocabulary_id)
    union all select 'entity_vocabulary.confidence_range', 'error' from entity_vocabulary_links where not {_OK})
    select rule, severity, count(*) as findings from f group by 1, 2""")
def qa_report(spark, root):
    return qa.counts(qa.findings(_audit_tables(spark, root)))


def _snapshots(spark, root):
    d = T(spark, root, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce(F.lower(F.trim("status")), F.lit("none")),
        F.concat("id", F.lit(".md")))
    before = d.select(path.alias("path"), F.coalesce(text.clean_hash(F.col("content_hash")), F.lit("none")).alias("hash"))
    gone = F.coalesce(F.lower(F.trim("status")), F.lit("")) == "deleted"
    now = F.when(gone, F.concat(F.lit("trash/"), F.col("id"), F.lit(".md"))).otherwise(path)
    return before, d.select(now.alias("path"), text.content_hash(F.col("text")).alias("hash"))


_DIFF = """b as (select coalesce(source, 'none') || '/' || coalesce(lower(trim(status)), 'none') || '/' || id || '.md' as path,
    coalesce(regexp_replace(lower(trim(content_hash)), '^sha-?256:', ''), 'none') as hash from documents),
    a as (select case when lower(trim(status)) = 'deleted' then 'trash/' || id || '.md' else coalesce(source, 'none') || '/' ||
      coalesce(lower(trim(status)), 'none') || '/' || id || '.md' end as path, sha256(text) as hash from documents),
    gone as (select * from b where path not in (select path from a)), came as (select * from a where path not in (select path from b)),
    mv as (select g.path, c.path as target, g.hash from (select hash, min(path) as path from gone group by 1 having count(*) = 1) g join
      (select hash, min(path) as path from came group by 1 having count(*) = 1) c using (hash)),
    x as (select 'moved' as change, path, target, hash, null as old from mv union all select 'deleted', path, null, hash, null from gone
      where path not in (select path from mv) union all select 'added', path, null, hash, null from came where path not in (select target
        from mv)
      union all select 'modified', a.path, null, a.hash, b.hash from a join b using (path) where a.hash <> b.hash)"""


@query(f"with {_DIFF} select change, path, target, hash from x")
def snapshot_diff(spark, root):
    return notes.diff(*_snapshots(spark, root)).select("change", "path", "target", "hash")


@query(f"""with {_DIFF}, h as (select sha256(text) as hash, count(distinct id) as n, min(id) as id from documents group by 1)
    select case when change = 'moved' and h.n = 1 then 'AUTO' else 'REVIEW' end as action, change as kind, path as source, case when change
      = 'modified' then p.id when h.n = 1 then h.id end as document_id, case when h.n = 1 then 'unique' when h.n > 1 then 'ambiguous' else
        'unknown' end as identity,
      case when change <> 'modified' then null when p.n is null then 'unknown' when p.n > 1 then 'ambiguous' when h.n is null then 'stale'
        when h.n > 1 then 'ambiguous' when h.id = p.id then 'stable' else 'conflict' end as identity_status
    from x left join h on x.hash = h.hash left join (select hash, n, case when n = 1 then id end as id from h) p on p.hash = x.old""")
def reconcile_plan(spark, root):
    d = T(spark, root, "documents").select("id", text.content_hash(F.col("text")).alias("content_hash"))
    return reconcile.classify(notes.diff(*_snapshots(spark, root)), d).select("action", "kind", "source", "document_id", "identity",
        "identity_status")


def _vault(spark, root) -> DataFrame:
    """Entity rows as notes of a vault."""
    e = T(spark, root, "entities").where("name is not null")
    path = F.concat(F.lit("entities/"), F.coalesce(F.when(F.trim("entity_type") != "", F.trim("entity_type")), F.lit("Unsorted")),
        F.lit("/"), F.regexp_replace("name", "/", "-"), F.lit(" "), F.col("entity_id").cast("string"), F.lit(".md"))
    body = F.concat(F.lit("---\nname: "), "name", F.lit("\nrating: "), F.coalesce("source", F.lit("")), F.lit("\n---\nSee [["), "name",
        F.lit(" "), F.col("entity_id").cast("string"), F.lit("]] and [[nowhere]].\n"))
    return e.select(path.alias("path"), body.alias("text")).withColumn("hash", F.sha2("text", 256)).withColumn("size", F.length("text"))


@query()
def vault_audit(spark, root):
    return notes.audit(_vault(spark, root)).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query()
def merge_plan(spark, root):
    e = T(spark, root, "entities").where("name is not null")
    n = e.select(F.concat_ws("/", F.lit("entities"), "entity_type", F.col("entity_id").cast("string")).alias("relative"),
        lookup.known_type(F.col("entity_type")).alias("domain"), "name", text.norm_name("name").alias("normalized"),
            F.create_map(F.lit("source"), F.coalesce("source", F.lit(""))).alias("fields"),
                F.array().cast("array<string>").alias("aliases"))
    return notes.merge_plan(n)


@query()
def organization_plan(spark, root):
    return notes.organization_plan(_vault(spark, root)).select("action", "source", "target", "reason")


@query(f"""with v as (select distinct entity_type as domain, {name_sql('entity_name')} as key from document_entities where entity_type in
    {_TYPES} and entity_name is not null),
    t as (select distinct case when entity_type in ('Companies', 'Brands') then 'Organizations' else entity_type end as domain,
      {name_sql('name')} as key from entities where name is not null and case when entity_type in ('Companies', 'Brands') then
        'Organizations' else entity_type end in {_TYPES})
    select case when t.key is null then 'vault_only' when v.key is null then 'table_only' else 'both' end as class, coalesce(v.domain,
      t.domain) as domain, coalesce(v.key, t.key) as key from v full join t on v.domain = t.domain and v.key = t.key""")
def consistency_classes(spark, root):
    de = T(spark, root, "document_entities").where("entity_name is not null")
    n = de.select(F.when(F.col("entity_type").isin(engine.qa.ENTITY_TYPES), F.col("entity_type")).alias("domain"),
        text.norm_name("entity_name").alias("normalized")).distinct()
    out = notes.consistency(n, T(spark, root, "entities").where("name is not null"))
    return out.where(F.col("class").isin("vault_only", "table_only", "both"))


@query("""select 'entities_not_linked' as side, count(*) as n from (select name, entity_type from entities except all select entity_name,
    entity_type from document_entities)
    union all select 'links_not_entities', count(*) from (select entity_name, entity_type from document_entities except all select name,
      entity_type from entities)""")
def multiset_difference(spark, root):
    e, d = T(spark, root, "entities", "document_entities")
    a, b = e.select("name", "entity_type"), d.select(F.col("entity_name").alias("name"), "entity_type")
    one = lambda df, s: df.agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n")
    return one(a.exceptAll(b), "entities_not_linked").unionByName(one(b.exceptAll(a), "links_not_entities"))


#: All tables of the data.
EVERY = "documents entities entity_aliases document_entities entity_sources document_sources entity_vocabulary_links vocabularies export_records entity_type_list source_list container_list run_log run_items subject_list subject_labels lineitem orders part supplier customer nation region events embeddings".split()


@query(" union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in EVERY))
def table_status(spark, root):
    out = None
    for n in EVERY:
        one = T(spark, root, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
