"""Further queries over the test tables, each with the SQL it is held against: files read back, indexes and notes,
merges over all tables, evidence and answers, the vault and its reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import engine
from ..functions import text
from ..operators import canonical, enrich, graph, inference, qa, upsert, vocabulary
from ..schemas import EVIDENCE_STATUS, empty
from ..session import scratch_path
from ..sources import readers, sinks
from ..vault import notes
from . import queries as base
from . import reconcile
from .queries import ALIASES_SQL, T, alias_sql, name_sql, strip_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def filled_sql(c: str) -> str:
    """The trimmed text, or the empty one."""
    return f"coalesce({strip_sql(c)}, '')"


def three_sql(c: str) -> str:
    """A number with three decimals, halves up."""
    return f"cast(cast(round(cast(cast(coalesce({c}, 0.0) as varchar) as decimal(30, 20)), 3) as decimal(12, 3)) as varchar)"


def yaml_sql(c: str) -> str:
    return f"""('"' || replace(replace(replace(coalesce({c}, ''), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"')"""


def section_sql(title: str, lines: str) -> str:
    return f"""case when {lines} is null or {lines} = '' then '' else chr(10) || '## {title}' || chr(10) || chr(10) || {lines} || chr(10)
    end"""


# --- files read back ----------------------------------------------------------------------------------------------


@query("""select id, coalesce(title, '') as title, coalesce(source, 'unknown') as source, sha256(text) as hash,
    json_extract_string(metadata, '$.source_id') as source_id from documents""")
def read_documents_file(spark, root):
    path = scratch_path(spark, "documents.jsonl")
    d = T(spark, root, "documents").select("id", F.coalesce("title", F.lit("")).alias("title"), F.col("text").alias("content"), "source",
        F.from_json("metadata", "map<string,string>").alias("metadata"))
    d.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    got = readers.read_documents(spark, path)
    return got.select("id", "title", "source", text.content_hash(F.col("content")).alias("hash"),
        F.get_json_object("metadata", "$.source_id").alias("source_id"))


@query(f"""select id, coalesce(nullif({strip_sql('title')}, ''), id) as title, coalesce(nullif({strip_sql('summary')}, ''), substr(content,
    1, 500)) as summary, greatest(0, least(1, coalesce(importance, 0.5))) as importance,
    len(list_filter(coalesce(entities, []), lambda e: coalesce({strip_sql('e.name')}, '') <> ''))::integer as entities,
      coalesce(array_to_string(tags, '|'), '') as tags, coalesce(metadata, '{{}}') as metadata from export_records""")
def read_enriched_file(spark, root):
    path = scratch_path(spark, "records.jsonl")
    r = T(spark, root, "export_records").drop("received_at")
    r.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return readers.read_enriched(spark, path).select("id", "title", "summary", "importance", F.size("entities").alias("entities"),
        F.array_join("tags", "|").alias("tags"), "metadata")


def _levels_sql(c: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split(coalesce({c}, ''), '|'), lambda x: {strip_sql('x')}), lambda x: x <> ''), '|')"


_WORDS = f"""select '§' as kind, id, {filled_sql('word')} as word, {filled_sql('traditional')} as traditional, {filled_sql('pinyin')} as
    pinyin, {filled_sql('pos')} as pos, {filled_sql('meaning_ko')} as meaning_ko,
    {_levels_sql('hsk_levels')} as levels, {_levels_sql('wordbooks')} as books from vocabularies"""


@query(f"{_WORDS.replace('§', 'csv')} union all {_WORDS.replace('§', 'jsonl')}")
def read_vocabulary_files(spark, root):
    v = T(spark, root, "vocabularies")
    v = v.select("id", F.col("word").alias("simplified"), F.col("traditional").alias("繁体"), F.col("pinyin").alias("拼音"),
        F.col("pos").alias("part_of_speech"), F.col("meaning_ko").alias("meaning"), "hsk_levels", "wordbooks", "source")
    csv, lines = scratch_path(spark, "words") + ".csv", scratch_path(spark, "words.jsonl")
    v.write.csv(csv, header=True, escape='"')
    v.select(F.to_json(F.struct("*")).alias("value")).write.text(lines)
    cols = ["id", "word", "traditional", "pinyin", "pos", "meaning_ko", F.array_join("hsk_levels", "|").alias("levels"),
        F.array_join("wordbooks", "|").alias("books")]
    return readers.read_vocabulary(spark, csv).select(F.lit("csv").alias("kind"),
        *cols).unionByName(readers.read_vocabulary(spark, lines).select(F.lit("jsonl").alias("kind"), *cols))


@query(f"""with t as (select document_id as id, {strip_sql('l[1]')} as title, list_filter(list_transform(string_split(l[2], ','), lambda x:
    {strip_sql('x')}), lambda x: x <> '') as a, {strip_sql('l[3]')} as album from {base._TRACKS})
    select id, title, title || chr(10) || array_to_string(a, ', ') || chr(10) || album as content, array_to_string(a, '|') || '|' || title
      || '|' || album as entities, (len(a) + 1)::integer as relations from t""")
def read_track_files(spark, root):
    """Track lists, one file for each group of some hundred tracks."""
    d = T(spark, root, "documents").where("document_type = 'track'").select("id", "doc_id",
        F.split("text", "\n").alias("l")).where(F.size("l") >= 3)
    t = d.select(F.floor(F.col("doc_id") / 5_000).alias("part"),
        F.struct(F.col("id").alias("track_id"), F.col("l")[0].alias("title"), F.col("l")[1].alias("artists"),
            F.col("l")[2].alias("album")).alias("t"))
    path = scratch_path(spark, "tracks")
    files = t.groupBy("part").agg(F.to_json(F.struct(F.collect_list("t").alias("tracks"))).alias("value"))
    files.write.partitionBy("part").text(path)
    got = readers.read_tracks(spark, path)
    return got.select("id", "title", "content", F.array_join(F.transform("entities", lambda e: e["name"]), "|").alias("entities"),
        F.size("relations").alias("relations"))


@query("""select 'documents/' || id || '.md' as path, sha256(text) as hash, strlen(text)::bigint as size from documents""")
def vault_snapshot(spark, root):
    path = scratch_path(spark, "vault")
    n = T(spark, root, "documents").select(F.concat(F.lit("documents/"), "id", F.lit(".md")).alias("path"), "text")
    sinks.write_notes(n, path.removeprefix("file://"))
    return readers.snapshot(readers.read_vault(spark, path.removeprefix("file://")))


@query(f"""select id as document_id, lower({strip_sql('source')}) as source,
    coalesce(nullif({strip_sql("json_extract_string(metadata, '$.source_id')")}, ''),
      nullif({strip_sql("json_extract_string(metadata, '$.external_id')")}, ''), {strip_sql('id')}) as source_id from documents""")
def source_identity(spark, root):
    d = T(spark, root, "documents").withColumn("seq", F.col("doc_id"))
    return engine.source_identity(d).select("document_id", "source", "source_id")


@query(f"""select document_id, least(n, 5)::integer as attempts, 'invalid source identity: no source' as last_error from (
    select id as document_id, count(*) as n from (select id, case when doc_id % 7 = 0 then ' ' else source end as source from documents)
      where {filled_sql('source')} = '' and {filled_sql('id')} <> '' group by 1)""")
def ingest_failures(spark, root):
    """Documents that arrive with a blank source (here every seventh) fail by themselves."""
    d = T(spark, root, "documents").withColumn("seq", F.col("doc_id")).withColumn("source",
        F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("source")))
    return upsert.record_failures(empty(spark, "processing_failures"), engine.faults(d)).select("document_id", "attempts", "last_error")


# --- answers of a model, evidence ---------------------------------------------------------------------------------


def echo(title: str, content: str):
    """A provider for queries and tests: says how much it was sent; it fails on untitled documents."""
    if not title:
        raise ValueError("untitled")
    return '```json\n{"summary": "answered", "sent": %d}\n```' % len(content)


@query("""with d as (select id, coalesce(title, '') as title, text, coalesce(lower(trim(status)), '') = 'done' as done from documents), k as
    (select title, text, bool_or(done) as cached from d group by 1, 2)
    select id, cached, case when cached then 'stored' when title = '' then null else 'answered' end as summary, case when not cached and
      title <> '' then least(length(text), 20000) end::integer as sent, not cached and title = '' as failed
    from d join k using (title, text)""")
def model_answers(spark, root):
    d = T(spark, root, "documents").select("id", F.coalesce("title", F.lit("")).alias("title"), F.col("text").alias("content"),
        F.lower(F.trim("status")).alias("status"))
    known = d.where("status = 'done'").select(enrich.cache_key("m").alias("cache_key"), F.lit('{"summary": "stored"}').alias("payload"),
        F.lit(1).alias("seq"))
    cache = upsert.cache_put(empty(spark, "llm_cache"), known)
    got = enrich.answers(d.select("id", "title", "content"), cache, echo, "m", wait=0.0)
    return got.select("id", "cached", F.get_json_object("payload", "$.summary").alias("summary"),
        F.get_json_object("payload", "$.sent").cast("int").alias("sent"), F.col("error").isNotNull().alias("failed"))


_REL_NAME = base._relation_case("r.relation")


@query(f"""select record_id, greatest(0, least(1, coalesce(importance, 0.5))) as importance, coalesce({strip_sql('summary')},
    substr(content, 1, 500)) as summary, coalesce({strip_sql('document_type')}, 'note') as document_type,
      coalesce({strip_sql('translation_ko')}, '') as translation_ko,
    array_to_string(list_transform(list_filter(coalesce(entities, []), lambda e: coalesce({strip_sql('e.name')}, '') <> ''), lambda e:
      {strip_sql('e.name')} || '=' || {base._types_case('e.entity_type')}), '|') as entities,
    array_to_string(list_transform(list_filter(coalesce(relations, []), lambda r: coalesce({strip_sql('r.source')}, '') <> '' and
      {_REL_NAME} <> '' and coalesce({strip_sql('r.target')}, '') <> ''), lambda r: {_REL_NAME}), '|') as relations,
    case when len(list_filter(coalesce(tags, []), lambda t: coalesce({strip_sql('t')}, '') <> '')) = 0 then 'source/' || coalesce(source,
      'unknown') else array_to_string(list_filter(list_transform(tags, lambda t: {strip_sql('t')}), lambda t: t <> ''), '|') end as tags
        from export_records""")
def model_payload(spark, root):
    """The records as a model's answers, taken in by the strict rules."""
    r = T(spark, root, "export_records")
    answer = F.to_json(F.struct("summary", "importance", "document_type", "translation_ko", "entities", "relations", "tags", "related_ids"))
    p = enrich.parse_payload(r.select("record_id", "content", "source", answer.alias("payload")))
    return p.select("record_id", "importance", "summary", "document_type", "translation_ko",
        F.array_join(F.transform("entities", lambda e: F.concat(e["name"], F.lit("="), e["entity_type"])), "|").alias("entities"),
        F.array_join(F.transform("relations", lambda x: x["relation"]), "|").alias("relations"),
            F.array_join("tags", "|").alias("tags"))


@query(f"""with e as {base._EVID}, l as (select document_id, source_name, relation, target_name, 'ev-' || (seq % 5) as evidence_document_id,
    status, seq from e)
    select document_id, source_name, relation, target_name, evidence_document_id, arg_max(status, (seq % 2 = 1, case when seq % 2 = 1 then
      seq else -1 end, status)) as status from l group by 1, 2, 3, 4, 5""")
def evidence_links(spark, root):
    """Evidence of even records stands in the table, that of odd ones arrives."""
    e = base._evidence(spark, root).withColumn("evidence_document_id",
        F.concat(F.lit("ev-"), (F.col("seq") % 5).cast("string"))).withColumn("checked_at", F.lit(None).cast("timestamp"))
    keys = ["document_id", "source_name", "relation", "target_name", "evidence_document_id"]
    old = e.where("seq % 2 = 0").groupBy(*keys).agg(F.max("status").alias("status"), F.max("checked_at").alias("checked_at"))
    return upsert.link_evidence(old, e.where("seq % 2 = 1")).select(*keys, "status")


@query("""select document_id, arg_max(title, (n, seq)) as title from (
    select id as document_id, coalesce(title, '') as title, 1 as n, doc_id as seq from documents union all select document_id, 'checked', 2,
      link_id from entity_sources where document_id is not null and link_id % 3 = 0) group by 1""")
def evidence_saved(spark, root):
    d = T(spark, root, "documents").select(F.col("id").alias("document_id"), F.lit("s").alias("source"),
        F.coalesce("title", F.lit("")).alias("title"), F.lit("").alias("content"), F.lit("").alias("url"),
            F.lit(None).cast("timestamp").alias("checked_at"))
    n = T(spark, root, "entity_sources").where("document_id is not null and link_id % 3 = 0").select("document_id",
        F.lit("s").alias("source"), F.lit("checked").alias("title"), F.lit("").alias("content"), F.lit("").alias("url"),
            F.lit(None).cast("timestamp").alias("checked_at"), F.col("link_id").alias("seq"))
    return upsert.save_evidence(d, n).select("document_id", "title")


@query(f"""with a as (select {alias_sql('alias')} as alias, entity_type, coalesce(canonical_name, '?') as c, alias_id,
    coalesce({base._HALF}, false) as old from entity_aliases where {alias_sql('alias')} <> '')
    select alias, entity_type, coalesce(arg_max(c, (alias_id, c)) filter (where not old), max(c)) as canonical_name from a group by 1, 2""")
def aliases_set(spark, root):
    """Aliases of the first half of the time are claimed, those of the second are stated by hand."""
    a = T(spark, root, "entity_aliases").select(text.norm_alias(F.col("alias")).alias("alias"), "entity_type",
        F.coalesce("canonical_name", F.lit("?")).alias("canonical_name"), F.col("alias_id").alias("seq"),
            F.coalesce(F.col("recorded_at") < F.lit(base.HALF_TIME).cast("timestamp"), F.lit(False)).alias("old")).where("alias <> ''")
    old = a.where("old").groupBy("alias", "entity_type").agg(F.max("canonical_name").alias("canonical_name")).select("alias",
        "canonical_name", "entity_type")
    return upsert.set_aliases(old, a.where("not old").drop("old"))


@query(f"""with i as {base._INCOMING}, c as (select {alias_sql('name')} as alias, entity_type, name as canonical_name, (seq, 0) as o from i
    union all select {alias_sql('a')}, entity_type, name, (seq, p) from (select *, unnest(aliases) as a, generate_subscripts(aliases, 1) as
      p from i)),
    k as (select {alias_sql('alias')} as alias, entity_type, min(canonical_name) as canonical_name from entity_aliases where canonical_name
      is not null and entity_type is not null and {alias_sql('alias')} <> '' group by 1, 2)
    select alias, entity_type, canonical_name from k union all select alias, entity_type, arg_min(canonical_name, o) from c where alias <>
      '' and not exists (select 1 from k where k.alias = c.alias and k.entity_type = c.entity_type) group by 1, 2""")
def alias_claims(spark, root):
    """What the entities of the records claim for their own name, after what the table has."""
    i = base._incoming(spark, root).withColumn("canonical", F.col("name"))
    old = base._claims(spark, root).where("entity_type is not null").groupBy("alias",
        "entity_type").agg(F.min("canonical_name").alias("canonical_name"))
    return canonical.alias_claims(i, old.select("alias", "canonical_name", "entity_type")).select("alias", "entity_type", "canonical_name")


# --- merges over all tables ---------------------------------------------------------------------------------------

# What the merges do to each table: the mapping of aliases to the end of their chain, where the duplicate is an entity.
_MERGES = f"""m0 as (select m.* from {base._MAP} m where duplicate <> '' and canonical <> '' and entity_type <> '' and duplicate <>
    canonical
      and exists (select 1 from entities e where e.name = m.duplicate and e.entity_type = m.entity_type)),
    walk(d, t, c, n) as (select duplicate, entity_type, canonical, 1 from m0 union all select w.d, w.t, m0.canonical, n + 1 from walk w join
      m0 on m0.duplicate = w.c and m0.entity_type = w.t where n < 40),
    m as (select d as duplicate, t as entity_type, c as canonical from walk where not exists (select 1 from m0 where m0.duplicate = c and
      m0.entity_type = t)),
    p as (select duplicate, min(canonical) as canonical from m group by 1)"""


def _merged(spark, root) -> dict[str, DataFrame]:
    a, de, es = T(spark, root, "entity_aliases", "document_entities", "entity_sources")
    m = a.where("canonical_name is not null and alias is not null").groupBy(F.col("alias").alias("duplicate"),
        "entity_type").agg(F.min("canonical_name").alias("canonical"), F.countDistinct("canonical_name").alias("n"))
    m = m.where("n = 1").select("duplicate", "canonical", "entity_type", F.lit("explicit_alias").alias("reason"))
    r = base._relations(spark, root)
    t = {
        "entities": base._listed_entities(spark, root).where("entity_type is not null"),
            "entity_sources": es.select("entity_name", "entity_type", "source", "document_id"),
        "document_entities": de.select("document_id", "entity_name", "entity_type",
            F.coalesce("confidence", F.lit(-1.0)).alias("confidence")),
        "relations": r.groupBy("source_name", "relation", "target_name").agg(F.max("confidence").alias("confidence")),
        "document_relations": r.select("document_id", "source_name", "relation", "target_name", "confidence"),
        "relation_evidence": base._evidence(spark, root).select("document_id", "source_name", "relation", "target_name",
            "evidence_document_id", "status"),
        "entity_aliases": base._claims(spark, root).where("entity_type is not null").select("alias", "canonical_name", "entity_type"),
    }
    return upsert.merge_entities_everywhere(t, m)


_MOVED_ENDS = "coalesce(a.canonical, x.source_name) as source_name, relation, coalesce(b.canonical, x.target_name) as target_name"
_ENDS = "left join p a on a.duplicate = x.source_name left join p b on b.duplicate = x.target_name"
_MOVED_ENTITIES = f"""mv as (select coalesce(m.canonical, e.name) as name, e.entity_type, case when isnan(confidence) then null else
    confidence end as confidence, case when m.canonical is null then {ALIASES_SQL} else list_append({ALIASES_SQL}, e.name) end as aliases
      from entities e left join m on m.duplicate = e.name and m.entity_type = e.entity_type where e.name is not null and e.entity_type is
        not null),
    al as (select distinct name, entity_type, {strip_sql('x')} as a from (select name, entity_type, unnest(aliases) as x from mv) where
      {strip_sql('x')} <> '' and {strip_sql('x')} <> name)"""


@query(f"""with recursive {_MERGES}, {_MOVED_ENTITIES}, l as (select name, entity_type, string_agg(a, '|' order by {alias_sql('a')}, a) as
    aliases from al group by 1, 2)
    select mv.name, mv.entity_type, max(mv.confidence) as confidence, coalesce(any_value(l.aliases), '') as aliases from mv left join l on
      l.name = mv.name and l.entity_type = mv.entity_type group by 1, 2""")
def merged_entities(spark, root):
    return _merged(spark, root)["entities"].withColumn("aliases", F.array_join("aliases", "|"))


@query(f"""with recursive {_MERGES} select document_id, coalesce(m.canonical, x.entity_name) as entity_name, x.entity_type,
    max(coalesce(confidence, -1)) as confidence from document_entities x
    left join m on m.duplicate = x.entity_name and m.entity_type = x.entity_type group by 1, 2, 3""")
def merged_document_entities(spark, root):
    return _merged(spark, root)["document_entities"]


@query(f"with recursive {_MERGES} select distinct coalesce(m.canonical, x.entity_name) as entity_name, x.entity_type, source, document_id from entity_sources x left join m on m.duplicate = x.entity_name and m.entity_type = x.entity_type")
def merged_entity_sources(spark, root):
    return _merged(spark, root)["entity_sources"]


@query(f"with recursive {_MERGES}, x as {base._REL} select {_MOVED_ENDS}, max(confidence) as confidence from x {_ENDS} group by 1, 2, 3")
def merged_relations(spark, root):
    return _merged(spark, root)["relations"]


@query(f"with recursive {_MERGES}, x as {base._REL} select document_id, {_MOVED_ENDS}, max(confidence) as confidence from x {_ENDS} group by 1, 2, 3, 4")
def merged_document_relations(spark, root):
    return _merged(spark, root)["document_relations"]


@query(f"with recursive {_MERGES}, x as {base._EVID} select document_id, {_MOVED_ENDS}, evidence_document_id, max(status) as status from x {_ENDS} group by 1, 2, 3, 4, 5")
def merged_evidence(spark, root):
    return _merged(spark, root)["relation_evidence"]


@query(f"""with recursive {_MERGES}, {_MOVED_ENTITIES}, k0 as (select distinct {alias_sql('alias')} as alias, canonical_name, entity_type
    from entity_aliases where canonical_name is not null and entity_type is not null and {alias_sql('alias')} <> ''),
    k as (select alias, entity_type, min(canonical_name) as canonical_name from k0 where not exists (select 1 from m where m.duplicate =
      k0.canonical_name and m.entity_type = k0.entity_type) group by 1, 2),
    n as (select {base.low('a')} as alias, entity_type, min(name) as canonical_name from al where exists (select 1 from m where m.canonical
      = al.name and m.entity_type = al.entity_type) group by 1, 2)
    select * from k union all select * from n where not exists (select 1 from k where k.alias = n.alias and k.entity_type =
      n.entity_type)""")
def merged_aliases(spark, root):
    return _merged(spark, root)["entity_aliases"]


@query(f"with recursive {_MERGES} select canonical as canonical_name, duplicate as duplicate_name, entity_type, 'explicit_alias' as reason from m")
def merge_log(spark, root):
    return _merged(spark, root)["entity_merge_log"].drop("id", "created_at")


@query("""with w as (select id, min(id) over (partition by word) as c from vocabularies)
    select entity_name, entity_type, coalesce(w.c, l.vocabulary_id) as vocabulary_id, max(coalesce(confidence, 0)) as confidence from
      entity_vocabulary_links l left join w on w.id = l.vocabulary_id group by 1, 2, 3""")
def rewired_vocabulary(spark, root):
    v, ln = T(spark, root, "vocabularies", "entity_vocabulary_links")
    m = v.select("word", F.col("id").alias("duplicate_id")).join(v.groupBy("word").agg(F.min("id").alias("canonical_id")), "word")
    links = ln.select("entity_name", "entity_type", "vocabulary_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return upsert.rewire_vocabulary({"entity_vocabulary_links": links}, m)["entity_vocabulary_links"]


_LEGACY = "case when entity_type in ('Companies', 'Brands') then 'Organizations' else entity_type end"


@query(f"""select 'document_entities' as name, document_id as a, entity_name as b, {_LEGACY} as entity_type, max(coalesce(confidence, -1))
    as confidence from document_entities group by 2, 3, 4
    union all select 'entity_sources', document_id || '|' || source, entity_name, {_LEGACY}, 0 from entity_sources where document_id is not
      null and source is not null group by 2, 3, 4""")
def migrated_links(spark, root):
    de, es = T(spark, root, "document_entities", "entity_sources")
    t = upsert.migrate_links({
        "document_entities": de.select("document_id", "entity_name", "entity_type",
            F.coalesce("confidence", F.lit(-1.0)).alias("confidence")),
        "entity_sources": es.where("document_id is not null and source is not null").select("entity_name", "entity_type", "source",
            "document_id")})
    one = t["document_entities"].select(F.lit("document_entities").alias("name"), F.col("document_id").alias("a"),
        F.col("entity_name").alias("b"), "entity_type", "confidence")
    return one.unionByName(t["entity_sources"].select(F.lit("entity_sources").alias("name"),
        F.concat_ws("|", "document_id", "source").alias("a"), F.col("entity_name").alias("b"), "entity_type",
            F.lit(0.0).alias("confidence")))


@query(f"""with r as {base._REL}, gone as (select distinct name, entity_type from entities e where not exists (select 1 from
    document_entities d where d.entity_name = e.name and d.entity_type = e.entity_type)
      and not exists (select 1 from r where r.source_name = e.name) and not exists (select 1 from r where r.target_name = e.name))
    select alias_id, alias from entity_aliases a where not exists (select 1 from gone g where g.name = a.canonical_name and g.entity_type =
      a.entity_type)""")
def pruned_aliases(spark, root):
    e, d, a = T(spark, root, "entities", "document_entities", "entity_aliases")
    return upsert.prune_orphans(e, a, d, base._relations(spark, root))[1].select("alias_id", "alias")


# --- indexes and notes --------------------------------------------------------------------------------------------

_ENTITY_LINE = f"'- [[' || name || ']] — confidence: ' || {three_sql('case when isnan(confidence) then null else confidence end')}"


@query(f"""select 'entities/_Entity Index.md' as file, coalesce(entity_type, '') as section, {_ENTITY_LINE} as line from entities where name
    is not null
    union all select 'entities/' || entity_type || '/_Index.md', '', {_ENTITY_LINE} from entities where name is not null and entity_type in
      ('MusicTracks', 'MusicAlbums')""")
def entity_indexes(spark, root):
    e = base._listed_entities(spark, root)
    return sinks.entity_index(e).unionByName(sinks.domain_index(e)).drop("sort")


_PINYIN = "coalesce(nullif(pinyin, ''), '-')"
_LEVEL_LIST = "list_filter(string_split(coalesce(hsk_levels, ''), '|'), lambda x: x <> '')"
_PLAIN_LEVELS = f"list_transform({_LEVEL_LIST}, lambda x: regexp_replace(upper(trim(x)), '^HSK *', ''))"


@query(f"""select 'vocabulary/_Vocabulary Index.md' as file, '- [[' || word || ']] — ' || {_PINYIN} || ' — ' ||
    coalesce(nullif(array_to_string({_LEVEL_LIST}, ', '), ''), 'unclassified') as line from vocabularies
    union all select 'vocabulary/HSK6/_Index.md', '- [[' || word || ']] — ' || {_PINYIN} from vocabularies where
      list_has_any({_PLAIN_LEVELS}, ['6'])
    union all select 'vocabulary/HSK7-9/_Index.md', '- [[' || word || ']] — ' || {_PINYIN} from vocabularies where
      list_has_any({_PLAIN_LEVELS}, ['7', '8', '9', '7-9'])""")
def vocabulary_indexes(spark, root):
    v = base._vocab(spark, root)
    return sinks.vocabulary_index(v).unionByName(sinks.level_index(v)).select("file", "line")


def _cross(spark, root) -> DataFrame:
    de, d = T(spark, root, "document_entities").withColumn("confidence", F.coalesce("confidence", F.lit(0.0))), base._sourced(spark, root)
    one = inference.same_document_links(de.where("entity_type is not null"), d, base._doc_links(spark, root),
        base._roles(spark, root)[0]).drop("document_id")
    two = base._bridges(spark, root).where("right_kind = 'music_track'").drop("document_ids")
    return one.unionByName(two)


_TAIL = f"' — ' || {three_sql('confidence')} || ' — `' || rule || '`'"


@query(f"""with d as (select *, 'performed+part_of' as rule from ({base.ORACLE['relation_chain']})), s as (select *, 'same_source_document'
    as rule from ({base.ORACLE['same_document_link']}) where left_type is not null),
    t as (select *, 'entity+vocabulary+track' as rule from ({base.ORACLE['three_way_bridge']}) where right_kind = 'music_track'), b as
      (select *, 1.0 as confidence, 'shared_canonical_entity' as rule from {base._PAIRED})
    select 'Entity Graph' as section, '- [[' || source_name || ']] — **contributed_to** → [[' || target_name || ']]' || {_TAIL} as line from
      d
    union all select 'Entities and Vocabulary', '- [[' || left_name || ']] (' || left_type || ') ↔ [[' || word || ']]' ||
      {_TAIL.replace('confidence', 's.confidence')} from s join vocabularies on id = right_id
    union all select 'Entities, Vocabulary and Music', '- [[' || coalesce(word, left_name) || ']] ↔ [[' || right_id || ']] (Track)' ||
      {_TAIL} from t left join vocabularies on id = left_name
    union all select 'By Source Pair', '- **' || source_a || ' ↔ ' || source_b || '** — ' || count(*) || ' canonical entities' from b group
      by source_a, source_b
    union all select 'Canonical Entity Bridges', '- [[' || entity_name || ']] (' || coalesce(entity_type, '') || ') — **' || source_a ||
      ' ↔ ' || source_b || '**' || {_TAIL} || ' — docs: ' || documents_a || '; ' || documents_b from b""")
def cross_domain_index(spark, root):
    rel, doc = base._chain_input(spark, root)
    derived = inference.relation_chains(rel, doc)
    return sinks.cross_domain_index(derived, _cross(spark, root), base._vocab(spark, root),
        inference.source_bridges(T(spark, root, "entity_sources"))).select("section", "line")


@query(f"""select 'Entity Domains' as section, '- [[entities/' || coalesce(entity_type, '') || '/_Index]] — ' || count(*) || ' entities' as
    line from entities group by coalesce(entity_type, '')
    union all select 'Sources', '- **' || coalesce(source, '') || '** — ' || count(*) || ' documents' from documents group by
      coalesce(source, '')
    union all select 'Cross-Domain Graph', '- ' || k || ': **' || n || '**' from (select 'Entities' as k, count(*) as n from entities union
      all select 'Documents', count(*) from documents union all select 'Sources', count(distinct source) from documents
      union all select 'Vocabularies', count(*) from vocabularies)""")
def knowledge_index(spark, root):
    e, d, v = T(spark, root, "entities", "documents", "vocabularies")
    return sinks.knowledge_lines(sinks.knowledge_index(e, d), {"vocabularies": v}).select("section", "line")


@query(f"""select id, array_to_string(list_sort(list(distinct word || ' (exact)')), '|') as words from (select o.id, v.word from
    {base._MATCH} m join documents o using (doc_id) join vocabularies v on v.id = m.vocabulary_id) group by 1""")
def document_words(spark, root):
    d, v = T(spark, root, "documents", "vocabularies")
    m = vocabulary.match_counts(d.select("id", "text"), v, "text", "id").select(F.col("id").alias("document_id"), "vocabulary_id",
        F.lit("exact").alias("match_type"))
    return sinks.vocabulary_lines(m, v).select("id", F.array_join("words", "|").alias("words"))


_FRONT = "'---' || chr(10) || 'name: ' || " + yaml_sql("name") + " || chr(10) || 'type: ' || " + yaml_sql(
    "entity_type") + " || chr(10) || 'confidence: ' || " + three_sql(
        "confidence") + " || chr(10) || '---' || chr(10) || chr(10) || '# ' || name || chr(10)"


def bullets_sql(list_: str) -> str:
    return f"array_to_string(list_transform({list_}, lambda x: '- ' || x), chr(10))"


@query(f"""with i as (select name, entity_type, arg_max(confidence, seq) as confidence, arg_max_null(list_filter(list_transform(aliases,
    lambda x: {strip_sql('x')}), lambda x: x <> ''), seq) as l from {base._INCOMING} group by 1, 2)
    select 'entities/' || entity_type as dir, name, {_FRONT} || {section_sql('Aliases', bullets_sql('l'))} as text from i""")
def record_entity_notes(spark, root):
    raw = T(spark, root, "export_records").withColumn("seq", F.col("record_id"))
    return sinks.record_entity_notes(readers.parse_enriched(raw, "enriched"))


def _lines_sql(df: str, key: str, value: str) -> str:
    return f"(select {key} as k, string_agg(distinct '- ' || {value}, chr(10) order by '- ' || {value}) as l from {df} group by 1)"


@query(f"""with e as (select name, entity_type, case when isnan(confidence) then null else confidence end as confidence, {ALIASES_SQL} as l
    from entities where name is not null),
    s as (select entity_name, entity_type, string_agg(distinct '- ' || source, chr(10) order by '- ' || source) as l from entity_sources
      group by 1, 2), d as (select entity_name, entity_type, string_agg(distinct '- ' || document_id, chr(10) order by '- ' || document_id)
        as l from document_entities group by 1, 2),
    r as {_lines_sql(base._REL, 'source_name', "(relation || ' [[' || target_name || ']]')")}
    select 'entities/' || coalesce(e.entity_type, 'Concepts') as dir, name, {_FRONT.replace('entity_type', 'e.entity_type')} ||
      {section_sql('Aliases', bullets_sql('e.l'))} || {section_sql('Sources', 's.l')} || {section_sql('Documents', 'd.l')} ||
        {section_sql('Relations', 'r.l')} as text
    from e left join s on s.entity_name = e.name and s.entity_type = e.entity_type left join d on d.entity_name = e.name and d.entity_type =
      e.entity_type left join r on r.k = e.name""")
def entity_notes(spark, root):
    es, de = T(spark, root, "entity_sources", "document_entities")
    r = base._relations(spark, root)
    return sinks.entity_notes(base._listed_entities(spark, root), es, de, r, r.limit(0))


@query(f"""with e as (select vocabulary_id as id, string_agg(distinct '- [[' || entity_name || ']]', chr(10) order by '- [[' || entity_name
    || ']]') as l from entity_vocabulary_links group by 1),
    d as (select vocabulary_id as id, string_agg(distinct '- ' || document_id, chr(10) order by '- ' || document_id) as l from {base._LINKS}
      group by 1)
    select v.id as name, '---' || chr(10) || 'id: ' || {yaml_sql('v.id')} || chr(10) || 'word: ' || {yaml_sql('word')} || chr(10) ||
      'level: ' || {yaml_sql(f"coalesce(nullif(array_to_string({_LEVEL_LIST}, ', '), ''), 'unclassified')")} || chr(10) || '---' || chr(10)
        || chr(10) || '# ' || word || chr(10) || chr(10)
      || concat_ws(' · ', pinyin, pos, meaning_ko) || chr(10) || {section_sql('Entities', 'e.l')} || {section_sql('Documents', 'd.l')} as
        text from vocabularies v left join e on e.id = v.id left join d on d.id = v.id""")
def vocabulary_notes(spark, root):
    links = T(spark, root, "entity_vocabulary_links")
    return sinks.vocabulary_notes(base._vocab(spark, root), links, base._doc_links(spark, root)).select("name", "text")


_OK_E = f"list_filter(coalesce(entities, []), lambda e: coalesce({strip_sql('e.name')}, '') <> '')"
_OK_R = f"list_filter(coalesce(relations, []), lambda r: coalesce({strip_sql('r.source')}, '') <> '' and coalesce({strip_sql('r.relation')}, '') <> '' and coalesce({strip_sql('r.target')}, '') <> '')"


@query(f"""with r as (select record_id, id, coalesce(nullif({strip_sql('title')}, ''), id) as title, coalesce(nullif({strip_sql('source')},
    ''), 'enriched') as source, coalesce(nullif({strip_sql('document_type')}, ''), 'note') as kind, coalesce(nullif({strip_sql('summary')},
      ''), substr(content, 1, 500)) as summary, coalesce(translation_ko, '') as ko,
      array_to_string(list_transform({_OK_E}, lambda e: '- [[' || {strip_sql('e.name')} || ']] (' || {base._types_case('e.entity_type')} ||
        ')'), chr(10)) as e,
      array_to_string(list_transform({_OK_R}, lambda r: '- [[' || {strip_sql('r.source')} || ']] ' || {strip_sql('r.relation')} || ' [[' ||
        {strip_sql('r.target')} || ']]'), chr(10)) as rel from export_records)
    select id as name, '---' || chr(10) || 'id: ' || {yaml_sql('id')} || chr(10) || 'title: ' || {yaml_sql('title')} || chr(10) ||
      'source: ' || {yaml_sql('source')} || chr(10) || 'type: ' || {yaml_sql('kind')} || chr(10) || '---' || chr(10) || chr(10) || '# ' ||
        title || chr(10) || chr(10) || summary || chr(10)
      || case when ko <> '' then chr(10) || ko || chr(10) else '' end || {section_sql('Entities', 'e')} || {section_sql('Relations', 'rel')}
        as text from r""")
def document_notes(spark, root):
    raw = T(spark, root, "export_records").withColumn("seq", F.col("record_id"))
    return sinks.document_notes(readers.parse_enriched(raw, "enriched")).select("name", "text")


# --- edges --------------------------------------------------------------------------------------------------------


@query(f"""select 'People:' || source_name as source, 'contributed_to' as relation, 'MusicAlbums:' || target_name as target, confidence,
    'derived' as kind from ({base.ORACLE['relation_chain']})""")
def derived_edges(spark, root):
    rel, doc = base._chain_input(spark, root)
    li, p = T(spark, root, "lineitem", "part")
    e = li.select(F.col("l_suppkey").cast("string").alias("name"),
        F.lit("People").alias("entity_type")).distinct().unionByName(
            p.select(F.col("p_brand").alias("name"), F.lit("MusicAlbums").alias("entity_type")).distinct())
    e = e.select("name", "entity_type", F.array().cast("array<string>").alias("aliases"), F.lit(1.0).alias("confidence"))
    edges = graph.relation_edges(inference.relation_chains(rel, doc), graph.name_index(e, empty(spark, "entity_aliases")), kind="derived")
    return edges.select("source", "relation", "target", "confidence", "kind")


@query(f"""with s as (select left_name, right_id, arg_min((left_type, confidence), left_type) as x from
    ({base.ORACLE['same_document_link']}) where left_type is not null group by 1, 2)
    select x[1] || ':' || left_name as source, 'same_source_document' as relation, 'Vocabulary:' || right_id as target, x[2] as confidence
      from s
    union all select 'Vocabulary:' || left_name, 'entity+vocabulary+track', 'MusicTracks:' || right_id, confidence from
      ({base.ORACLE['three_way_bridge']}) where right_kind =
        'music_track'""".replace("(left_type, confidence), left_type) as x", "{'t': left_type, 'c': confidence}, left_type) as x").replace("x[1]", "x.t").replace("x[2]", "x.c"))
def cross_edges(spark, root):
    return graph.cross_edges(_cross(spark, root)).drop("kind")


@query(f"""select distinct coalesce(entity_type, '') || ':' || entity_name as source, 'shared_canonical_entity' as relation, 'SourceBridge:'
    || source_a || '|' || source_b as target, 1.0::double as confidence from {base._PAIRED}""")
def bridge_edges(spark, root):
    """Half of the edges stand in the graph already; each comes out once."""
    b = graph.bridge_edges(inference.source_bridges(T(spark, root, "entity_sources")))
    return graph.add_edges(b.where(F.xxhash64("source", "target") % 2 == 0), b.unionByName(b)).select("source", "relation", "target",
        "confidence")


# --- audit --------------------------------------------------------------------------------------------------------


def _audit_tables(spark, root) -> dict[str, DataFrame]:
    """Every table of the audit: those of the data, and those derived from them, with some rows spoilt by rule."""
    t = base._audit_tables(spark, root)
    r = base._relations(spark, root)
    third, fifth = F.col("seq") % 3 == 0, F.col("seq") % 5 == 0
    t["document_relations"] = r.select(F.when(third, F.lit("no such document")).otherwise(F.col("document_id")).alias("document_id"),
        "source_name", "relation", F.when(fifth, F.lit("nobody")).otherwise(F.col("target_name")).alias("target_name"))
    t["relation_evidence"] = base._evidence(spark, root).withColumn("status", F.when(fifth, "guessed").otherwise(F.col("status")))
    rel, doc = base._chain_input(spark, root)
    t["derived_relations"] = inference.relation_chains(rel, doc).select("source_name", "relation", "target_name",
        (F.col("confidence") * 1.1).alias("confidence"))
    t["cross_domain_links"] = _cross(spark, root).withColumn("confidence", F.col("confidence") * 1.2)
    b = inference.source_bridges(T(spark, root, "entity_sources"))
    t["source_bridge_links"] = b.withColumn("source_b", F.when(F.col("documents_a") % 2 == 0,
        F.col("source_a")).otherwise(F.col("source_b"))).withColumn("confidence", F.col("confidence") + F.col("documents_b") % 2)
    v = T(spark, root, "entity_vocabulary_links")
    d = T(spark, root, "document_entities").select("document_id", "entity_name").join(v.select("entity_name", "vocabulary_id").distinct(),
        "entity_name").select("document_id", "vocabulary_id").distinct()
    t["document_vocabulary_links"] = d.withColumn("confidence", F.length("document_id") / 13.0)
    t["vocabulary_sources"] = v.select("vocabulary_id", F.col("link_id").cast("string").alias("source_id"))
    t["results"] = T(spark, root, "run_items").select(F.lower("document_id").alias("document_id")).distinct()
    t["processing_failures"] = base._failures(spark, root)
    m = T(spark, root, "entity_aliases").where("canonical_name is not null")
    t["entity_merge_log"] = m.select("canonical_name", F.col("alias").alias("duplicate_name"), "entity_type")
    return t


_EXTRA = f"""dr as (select case when seq % 3 = 0 then 'no such document' else document_id end as document_id, source_name, relation, case
    when seq % 5 = 0 then 'nobody' else target_name end as target_name from {base._REL}),
    ev as (select document_id, source_name, relation, target_name, case when seq % 5 = 0 then 'guessed' else status end as status from
      {base._EVID}),
    de as (select source_name, target_name, confidence * 1.1 as confidence from ({base.ORACLE['relation_chain']})),
    cd as (select left_type, left_name, right_id, 'vocabulary' as right_kind, confidence * 1.2 as confidence from
      ({base.ORACLE['same_document_link']}) where left_type is not null
      union all select 'Vocabulary', left_name, right_id, right_kind, confidence * 1.2 from ({base.ORACLE['three_way_bridge']}) where
        right_kind = 'music_track'),
    sb as (select entity_name, entity_type, source_a, case when documents_a % 2 = 0 then source_a else source_b end as source_b, 1.0::double
      + documents_b % 2 as confidence, documents_a, documents_b from {base._PAIRED}),
    dv as (select distinct document_id, vocabulary_id, length(document_id) / 13.0 as confidence from document_entities join (select distinct
      entity_name, vocabulary_id from entity_vocabulary_links) using (entity_name)),
    keys as (select coalesce(entity_type || ':', '') || name as k from entities where name is not null union select 'Vocabulary:' || id from
      vocabularies)"""
_NAMED = "(select name from entities where name is not null)"
_TRIPLE = "x.source_name = y.source_name and x.relation = y.relation and x.target_name = y.target_name"
_SIDE = "case right_kind when 'music_track' then 'MusicTracks' when 'music_album' then 'MusicAlbums' else 'Vocabulary' end || ':' || right_id"
_VOCAB = "exists (select 1 from vocabularies v where v.id = x.vocabulary_id)"


@query(base.ORACLE["qa_report"].replace("with r as", f"with {_EXTRA}, r as", 1).replace("    select rule, severity, count(*) as findings from f group by 1, 2", f""",
    more as (select 'document_relation.orphan' as rule, 'error' as severity from (select distinct * from dr) x where not {base._DOC} or not
      exists (select 1 from r y where {_TRIPLE})
    union all select 'relation_evidence.orphan', 'error' from ev x where not exists (select 1 from dr y where x.document_id = y.document_id
      and {_TRIPLE})
    union all select 'relation_evidence.invalid_status', 'error' from ev where status not in ('checked', 'contradicted', 'unverified')
    union all select 'derived_relation.orphan_endpoint', 'error' from (select distinct * from de) where source_name not in {_NAMED} or
      target_name not in {_NAMED}
    union all select 'derived_relation.confidence_range', 'error' from de where not {base._OK}
    union all select 'cross_domain_link.orphan_endpoint', 'error' from (select distinct * from cd) where (left_type || ':' || left_name) not
      in (select k from keys) or ({_SIDE}) not in (select k from keys)
    union all select 'cross_domain_link.confidence_range', 'error' from cd where not {base._OK}
    union all select 'source_bridge.invalid_endpoint', 'error' from (select distinct * from sb) x where not {base._ENT} or source_a =
      source_b
    union all select 'source_bridge.confidence_range', 'error' from sb where not {base._OK}
    union all select 'document_vocabulary.orphan', 'error' from dv x where not {base._DOC} or not {_VOCAB}
    union all select 'document_vocabulary.confidence_range', 'error' from dv where not {base._OK}
    union all select 'vocabulary_source.orphan', 'error' from entity_vocabulary_links x where not {_VOCAB}
    union all select 'result.orphan', 'error' from (select distinct lower(document_id) as document_id from run_items) x where not
      {base._DOC}
    union all select 'processing.failures', 'warning' from (select 1 from run_items where outcome = 'error' limit 1)
    union all select 'merge.invalid_self_merge', 'error' from entity_aliases where canonical_name = alias)
    select rule, severity, count(*) as findings from (select * from f union all select * from more) group by 1, 2"""))
def qa_report_all(spark, root):
    """Every rule of the audit over its table."""
    return qa.counts(qa.findings(_audit_tables(spark, root)))


# --- the vault and its reconciliation -----------------------------------------------------------------------------

_PATH = "'entities/' || coalesce(nullif(trim(entity_type), ''), 'Unsorted') || '/' || replace(name, '/', '-') || ' ' || entity_id || '.md'"
_STEM = "replace(name, '/', '-') || ' ' || entity_id"
_VAULT = f"(select entity_id, name, source, entity_type, {_PATH} as path, {_STEM} as stem, coalesce(nullif(trim(entity_type), ''), 'Unsorted') as folder from entities where name is not null)"
_DOMAIN = "case when folder in ('Companies', 'Brands') then 'Organizations' when folder in " + base._TYPES + " then folder end"


@query(f"""select distinct {name_sql('k')} as key, path from (select stem as k, path from {_VAULT} union all select left(path, length(path)
    - 3), path from {_VAULT}) where {name_sql('k')} <> ''""")
def link_targets(spark, root):
    return notes.target_index(base._vault(spark, root))


@query(f"""select path as file, {strip_sql("(name || ' ' || entity_id)")} as target, '' as heading, '' as display from {_VAULT} where not
    regexp_matches(name, '[\\[\\]|#\\r\\n`]')
    union all select path, 'nowhere', '', '' from {_VAULT} where not regexp_matches(name, '[\\[\\]|#\\r\\n`]')""")
def vault_links(spark, root):
    """Links of all notes; names with marks that belong to links or code are held against fixtures in the tests."""
    v = base._vault(spark, root)
    marks = T(spark, root, "entities").where(F.col("name").rlike(r"[\[\]|#\r\n`]")).select(F.col("entity_id").cast("string").alias("i"))
    out = notes.link_rows(v).withColumn("i", F.regexp_extract("file", r" (\d+)\.md$", 1)).join(marks, "i", "left_anti")
    return out.select("file", "target", F.coalesce("heading", F.lit("")).alias("heading"),
        F.coalesce("display", F.lit("")).alias("display"))


@query(f"""select entity_id, {strip_sql("split_part(l, '#', 1)")} as target, case when contains(l, '#') then
    {strip_sql("substr(l, instr(l, '#') + 1)")} end as heading, case when contains(raw, '|') then substr(raw, instr(raw, '|') + 1) end as
      display
    from (select entity_id, raw, split_part(raw, '|', 1) as l from (select entity_id, coalesce(name, '') || case when entity_id % 2 = 0 then
      '#' || coalesce(entity_type, '') else '' end || case when entity_id % 3 = 0 then '|' || coalesce(source, '') else '' end as raw from
        entities))""")
def wikilink_parts(spark, root):
    e = T(spark, root, "entities")
    none = lambda c: F.coalesce(c, F.lit(""))
    raw = F.concat(none("name"), F.when(F.col("entity_id") % 2 == 0, F.concat(F.lit("#"), none("entity_type"))).otherwise(""),
        F.when(F.col("entity_id") % 3 == 0, F.concat(F.lit("|"), none("source"))).otherwise(""))
    return e.select("entity_id", text.parse_wikilink(raw).alias("l")).select("entity_id", "l.target", "l.heading", "l.display")


@query("""select entity_id, '[[' || name || case when entity_id % 2 = 0 and coalesce(entity_type, '') <> '' then '#' || entity_type else ''
    end || case when entity_id % 3 = 0 and coalesce(source, '') <> '' then '|' || source else '' end || ']]' as link from entities where
      name is not null""")
def wikilink_format(spark, root):
    e = T(spark, root, "entities").where("name is not null")
    return e.select("entity_id", text.format_wikilink(F.col("name"), F.when(F.col("entity_id") % 2 == 0, F.col("entity_type")),
        F.when(F.col("entity_id") % 3 == 0, F.col("source"))).alias("link"))


@query("""select doc_id, coalesce(trim(lang), '') as lang, status, n_chars::varchar as size from documents""")
def front_matter(spark, root):
    """Fields written as the leading block of a note and read back."""
    d = T(spark, root, "documents")
    note = F.concat(F.lit("---\nlang: "), F.coalesce(F.trim("lang"), F.lit("")), F.lit("\nstatus: \""), "status", F.lit("\"\nsize: '"),
        F.col("n_chars").cast("string"), F.lit("'\n---\n"), "text")
    f = d.select("doc_id", notes.read_front(note).alias("f"))
    return f.select("doc_id", F.col("f")["lang"].alias("lang"), F.col("f")["status"].alias("status"), F.col("f")["size"].alias("size"))


@query(f"""with v as (select *, {_DOMAIN} as domain from {_VAULT}), k as (select *, '20_Entities/' || domain || '/' || stem || '.md' as
    target from v where domain is not null)
    select 'AUTO' as action, path as source, target, 'move' as reason from k""")
def organization_plan(spark, root):
    return notes.organization_plan(base._vault(spark, root)).select("action", "source", "target", "reason")


@query(f"""with n as (select concat_ws('/', 'entities', entity_type, entity_id::varchar) as relative, case when entity_type in ('Companies',
    'Brands') then 'Organizations' when entity_type in {base._TYPES} then entity_type end as domain, name, {name_sql('name')} as key,
      coalesce(source, '') as source from entities where name is not null),
    e as (select * from n where domain is not null and key <> ''),
    g as (select domain, key, list_sort(list(distinct relative)) as l, count(distinct source) as kinds from e group by 1, 2 having
      count(distinct relative) > 1),
    x as (select key, list_sort(list(distinct domain)) as d, list_sort(list(distinct relative)) as l from e group by 1 having count(distinct
      domain) > 1)
    select case when kinds = 1 then 'AUTO' else 'REVIEW' end as action, domain, key, array_to_string(l, ',') as notes, case when kinds = 1
      then 'same_name' else 'metadata_conflict' end as reason from g
    union all select 'SKIP', array_to_string(d, ','), key, array_to_string(l, ','), 'cross_domain' from x""")
def merge_plan(spark, root):
    m = base.merge_plan(spark, root)
    every = F.when(F.col("reason") == "cross_domain", F.col("duplicates")).otherwise(
        F.array_join(F.array_sort(F.array_append(F.split("duplicates", ","), F.col("canonical"))), ","))
    return m.select("action", "domain", "key", every.alias("notes"), "reason")


@query(f"""with n as (select path as relative, {name_sql('stem')} as key from {_VAULT}), q as (select distinct entity_name as name,
    {name_sql('entity_name')} as key from document_entities where entity_name is not null),
    a as (select distinct {name_sql('alias')} as key, {name_sql('canonical_name')} || ' ' || alias_id as c from entity_aliases where
      canonical_name is not null and alias is not null),
    d as (select key, count(distinct relative) as n, min(relative) as r from n group by 1), t as (select a.key, count(distinct relative) as
      n, min(relative) as r from a join n on n.key = a.c group by 1)
    select q.name, case when d.n is not null then case when d.n = 1 then d.r end when t.n = 1 then t.r end as resolved_to, case when
      coalesce(d.n, t.n) = 1 then case when d.n = 1 then 'direct' else 'table_alias' end when coalesce(d.n, t.n) > 1 then 'ambiguous' else
        'unknown' end as reason
    from q left join d using (key) left join t using (key)""")
def resolved_names(spark, root):
    n = notes.entity_files(base._vault(spark, root).where(~F.col("path").contains("\n")))
    every = base._vault(spark, root).select(F.col("path").alias("relative"), text.norm_name(notes.stem(F.col("path"))).alias("normalized"),
        F.array().cast("array<string>").alias("aliases"))
    a = T(spark, root, "entity_aliases").where("canonical_name is not null and alias is not null").select("alias",
        F.concat_ws(" ", "canonical_name", F.col("alias_id").cast("string")).alias("canonical_name"))
    q = T(spark, root, "document_entities").where("entity_name is not null").select(F.col("entity_name").alias("name")).distinct()
    return reconcile.resolve_names(q, every, a)


@query(f"""with n as (select distinct case when entity_type in ('Companies', 'Brands') then 'Organizations' else coalesce(entity_type, '')
    end as domain, {name_sql('name')} as key, {_PATH} as relative from entities where name is not null),
    q as (select distinct document_id, entity_name as name, case when entity_type in ('Companies', 'Brands') then 'Organizations' else
      coalesce(entity_type, '') end as domain, {name_sql('entity_name')} as key from document_entities where entity_name is not null and
        document_id is not null),
    g as (select domain, key, count(distinct relative) as n, min(relative) as r from n group by 1, 2)
    select document_id, name, domain, case when n = 1 then r end as resolved_to, case when n = 1 then 'direct' when n > 1 then 'ambiguous'
      else 'unknown' end as reason from q left join g using (domain, key)""")
def resolved_entities(spark, root):
    e = T(spark, root, "entities").where("name is not null")
    none = F.array().cast("array<string>")
    n = base._vault(spark, root).select(F.col("path").alias("relative"),
        F.regexp_extract("path", r" (\d+)\.md$", 1).alias("i")).join(
            e.select(F.col("entity_id").cast("string").alias("i"), "entity_type", "name"), "i")
    n = n.select("relative", F.lit(None).cast("string").alias("domain"),
        F.coalesce(base.lookup.migrated_type(F.col("entity_type")), F.lit("")).alias("raw_domain"),
            text.norm_name("name").alias("normalized"), none.alias("aliases"))
    d = T(spark, root, "document_entities").where("entity_name is not null and document_id is not null")
    claims = empty(spark, "entity_aliases")
    return reconcile.resolve_entities(d, n, claims, e.select("name", "entity_type", none.alias("aliases")))


@query("""with a as (select id as document_id, sha256(text) as content_hash, 'old/' || id as old_path, 'new/' || id as new_path from
    documents), o as (select * from a where document_id in (select id from documents where doc_id % 4 = 0))
    select 'added' as side, count(*) as n from (select * from a union select * from o) union all select 'wrong', count(*) from a join
      documents d on d.id = a.document_id where regexp_replace(lower(trim(coalesce(d.content_hash, ''))), '^sha-?256:', '') <>
        a.content_hash""")
def finalized_moves(spark, root):
    """Moves of all documents with the hash of their text: new rows of provenance, and those the stored hash denies."""
    d = T(spark, root, "documents")
    row = [F.col("id").alias("document_id"), text.content_hash(F.col("text")).alias("content_hash"),
        F.concat(F.lit("old/"), "id").alias("old_path"), F.concat(F.lit("new/"), "id").alias("new_path"), F.lit("m").alias("manifest_path"),
            F.lit(None).cast("timestamp").alias("verified_at")]
    table, wrong = reconcile.finalize(d.where("doc_id % 4 = 0").select(*row), d.select(*row),
        d.select("id", F.coalesce(text.clean_hash(F.col("content_hash")), F.lit("")).alias("content_hash")))
    one = lambda df, s: df.agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n")
    return one(table, "added").unionByName(one(wrong, "wrong"))


@query(f"with {base._DIFF} select change, path, case when change = 'moved' then 'AUTO' else 'REVIEW' end as action from x")
def change_plan(spark, root):
    return notes.change_plan(notes.diff(*base._snapshots(spark, root))).select("change", "path", "action")


def _folded_type(c: str = "entity_type") -> str:
    return f"case when {c} in ('Companies', 'Brands') then 'Organizations' else coalesce({c}, '') end"


@query(f"""with t as (select distinct {_folded_type()} as domain, {name_sql('name')} as key from entities where name is not null and
    {_folded_type()} in {base._TYPES}),
    ex as (select distinct name from entities where name is not null), r as {base._REL}, f as (select distinct source_name || '|' ||
      relation || '|' || target_name as fact, unnest([source_name, target_name]) as name from r),
    v as (select distinct entity_type as domain, {name_sql('entity_name')} as key from document_entities where entity_type in {base._TYPES}
      and entity_name is not null),
    de as (select distinct {_folded_type()} as domain, {name_sql('entity_name')} as key, document_id, entity_name from document_entities),
      es as (select distinct {_folded_type()} as domain, {name_sql('entity_name')} as key, document_id, entity_name from entity_sources)
    select 'relation_without_entity' as class, count(distinct fact) as n from f where name not in (select name from ex)
    union all select 'relation_without_note', count(distinct fact) from f where {name_sql('name')} not in (select key from v)
    union all select 'document_entity_without_entity', count(distinct (domain, concat_ws('|', document_id, entity_name))) from de where not
      exists (select 1 from t where t.domain = de.domain and t.key = de.key)
    union all select 'document_entity_without_document', count(distinct (domain, concat_ws('|', document_id, entity_name))) from de where
      not exists (select 1 from documents d where d.id = de.document_id)
    union all select 'entity_source_without_entity', count(distinct (domain, concat_ws('|', document_id, entity_name))) from es where not
      exists (select 1 from t where t.domain = es.domain and t.key = es.key)
    union all select 'entity_source_without_document', count(distinct (domain, concat_ws('|', document_id, entity_name))) from es where not
      exists (select 1 from documents d where d.id = es.document_id)
    union all select 'vault_without_provenance', count(*) from (select * from v intersect select * from t) b where not exists (select 1 from
      es where es.domain = b.domain and es.key = b.key)
    union all select 'vault_only', count(*) from (select * from v except select * from t) union all select 'table_only', count(*) from
      (select * from t except select * from v) union all select 'both', count(*) from (select * from t intersect select * from v)
    union all select 'document_without_hash', count(distinct id) from documents where coalesce(content_hash, '') = ''
    union all select 'alias_without_entity', count(distinct (coalesce(entity_type, ''), {name_sql('canonical_name')})) from entity_aliases
      where {name_sql('canonical_name')} is null or {name_sql('canonical_name')} not in (select {name_sql('name')} from entities where name
        is not null)
    union all select 'table_invalid_type', count(distinct (coalesce(entity_type, ''), name)) from entities where name is not null and
      coalesce(entity_type, '') not in {base._TYPES}
    union all select 'table_without_note', count(*) from (select distinct {_folded_type()} as domain, {name_sql('name')} as key from
      entities where name is not null and coalesce(trim(aliases), '') <> '' and {_folded_type()} in {base._TYPES} except select * from
        v)""")
def consistency_report(spark, root):
    """All classes of disagreement between notes (here the entities that documents name) and tables, counted."""
    t = dict(zip(("entities", "documents", "aliases", "document_entities", "entity_sources"),
        T(spark, root, "entities", "documents", "entity_aliases", "document_entities", "entity_sources")))
    de = t["document_entities"].where("entity_name is not null")
    n = de.select(F.when(F.col("entity_type").isin(qa.ENTITY_TYPES), F.col("entity_type")).alias("domain"),
        text.norm_name("entity_name").alias("normalized")).distinct()
    found = notes.consistency(n, t["entities"].where("name is not null"), t["documents"], t["aliases"], base._relations(spark, root),
        t["document_entities"], t["entity_sources"])
    names = ["relation_without_entity", "relation_without_note", "document_entity_without_entity", "document_entity_without_document",
        "entity_source_without_entity", "entity_source_without_document", "vault_without_provenance",
             "vault_only", "table_only", "both", "document_without_hash", "alias_without_entity", "table_invalid_type",
                 "table_without_note"]
    every = spark.createDataFrame([(c,) for c in names], "class string")
    return every.join(found.groupBy("class").agg(F.count("*").alias("n")), "class", "left").select("class",
        F.coalesce("n", F.lit(0)).alias("n"))


# --- links of words -----------------------------------------------------------------------------------------------


@query(f"""with m as (select o.id as document_id, vocabulary_id, round(least(1.0, 0.8 + least(matches, 4) * 0.05), 6) as c from
    {base._MATCH} join documents o using (doc_id)), e as (select distinct id as document_id, (select min(id) from vocabularies) as
      vocabulary_id from documents where doc_id % 50 = 0)
    select document_id, vocabulary_id, 'explicit' as match_type, 1.0::double as confidence from e union all select document_id,
      vocabulary_id, 'exact', c::double from m where not exists (select 1 from e where e.document_id = m.document_id and e.vocabulary_id =
        m.vocabulary_id)""")
def document_links(spark, root):
    """All documents relinked; every fiftieth names a word itself."""
    d, v = T(spark, root, "documents"), base._vocab(spark, root)
    first = v.agg(F.min("id").alias("vocabulary_id"))
    named = d.where("doc_id % 50 = 0").select(F.col("id").alias("document_id")).crossJoin(F.broadcast(first))
    docs = d.select("id", F.col("text").alias("content"))
    return vocabulary.link_documents(docs, v, named, empty(spark, "document_vocabulary_links"))


@query(f"""select alias, arg_min(canonical_id, (doc, p)) as canonical_id from (select {alias_sql('a')} as alias, id as canonical_id,
    row_number() over (order by id, p) as doc, p from (
    select id, unnest([id, word, traditional]) as a, generate_subscripts([id, word, traditional], 1) as p from vocabularies)) where alias <>
      '' group by 1""")
def vocabulary_claims(spark, root):
    v = base._vocab(spark, root).withColumn("seq", F.struct("id"))
    return vocabulary.vocabulary_aliases(v, empty(spark, "vocabulary_aliases"))


@query(f"""with e as (select distinct vocabulary_id, {alias_sql('entity_name')} as alias from entity_vocabulary_links where entity_name is
    not null and vocabulary_id is not null), a as (select distinct {alias_sql('alias')} as alias, canonical_name, entity_type from
      entity_aliases where canonical_name is not null)
    select distinct canonical_name as entity_name, entity_type, vocabulary_id, 'explicit' as match_type from e join a using (alias) where
      alias <> ''""")
def explicit_word_links(spark, root):
    e = T(spark, root, "entity_vocabulary_links").where("entity_name is not null and vocabulary_id is not null").select("vocabulary_id",
        F.col("entity_name").alias("entity"))
    return vocabulary.explicit_entity_links(e, base._claims(spark, root)).drop("confidence")


_WORD_ALIAS = f"""(select {alias_sql('a')} as alias, min(id) as canonical_id
    from (select id, unnest([id, word, traditional]) as a from vocabularies) where {alias_sql('a')} <> '' group by 1)"""


def _word_aliases(spark, root) -> DataFrame:
    v = base._vocab(spark, root)
    rows = v.select("id", F.explode(F.array("id", "word", "traditional")).alias("a")).select("id",
        text.norm_alias(F.col("a")).alias("alias"))
    return rows.where("alias <> ''").groupBy("alias").agg(F.min("id").alias("canonical_id"))


@query(f"""select v.word as value, l.document_id, l.cv::double as confidence from (select distinct word from vocabularies) v
    join {_WORD_ALIAS} a on a.alias = {alias_sql('v.word')} join {base._LINKS} l on l.vocabulary_id = a.canonical_id""")
def word_documents(spark, root):
    """The documents of every word, named as it is written."""
    links = base._doc_links(spark, root).groupBy("vocabulary_id", "document_id").agg(F.max("confidence").alias("confidence"))
    values = T(spark, root, "vocabularies").select(F.col("word").alias("value"))
    return vocabulary.documents_of(values, links.withColumn("match_type", F.lit("")), _word_aliases(spark, root)).drop("match_type")


@query("""select vocabulary_id, entity_name, entity_type, match_type, coalesce(confidence, 0) as confidence from entity_vocabulary_links
    where vocabulary_id in (select id from vocabularies)""")
def word_entities(spark, root):
    links = T(spark, root, "entity_vocabulary_links").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return vocabulary.entities_of(T(spark, root, "vocabularies").select(F.col("id").alias("value")), links)


@query(f"""with o as (select document_id, vocabulary_id, 'exact' as match_type, cv::double as confidence from {base._LINKS}),
    n as (select d.id as document_id, coalesce(a.canonical_id, d.title) as vocabulary_id, 'explicit' as match_type, 1.0::double as confidence
      from documents d left join {_WORD_ALIAS} a on a.alias = {alias_sql('d.title')} where d.title is not null)
    select distinct * from n union all select * from o where not exists (select 1 from n where n.document_id = o.document_id and n.vocabulary_id = o.vocabulary_id)""")
def words_added(spark, root):
    """Each document's title added as a word by hand."""
    old = base._doc_links(spark, root).groupBy("document_id",
        "vocabulary_id").agg(F.max("confidence").alias("confidence")).withColumn("match_type", F.lit("exact"))
    d = T(spark, root, "documents").where("title is not null")
    new = d.select(F.col("id").alias("document_id"), F.col("title").alias("value"), F.lit("explicit").alias("match_type"),
        F.lit(1.0).alias("confidence"), F.col("doc_id").alias("seq"))
    return vocabulary.add_document_words(old, new, _word_aliases(spark, root))
