"""The engine: table snapshots and the ingest, derive and project steps over them."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.text import first_non_blank, norm_alias, strip_space
from .operators import canonical, enrich, graph, inference, qa, upsert, vocabulary
from .schemas import TABLES, conform, empty
from .session import materialize, path_exists, read_text, remove_path, write_text
from .sources import sinks
from .sources.readers import RELATION, clean_relations


@dataclass
class Settings:
    """Where the state and the projections lie: from the environment unless given."""

    state_path: str = field(default_factory=lambda: os.environ.get("KGLOOM_STATE_PATH", "state"))
    output_path: str = field(default_factory=lambda: os.environ.get("KGLOOM_OUTPUT_PATH", "output"))


class TableStore:
    """Named tables as Parquet snapshots below a folder of any file system Spark knows: a commit writes the new
    versions of the tables it changes, then replaces one pointer file. Readers keep what they read; a commit that dies
    leaves the old state. Tables a commit does not name are not touched."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")

    def _pointer(self) -> dict:
        path = f"{self.root}/current.json"
        return json.loads(read_text(self.spark, path)) if path_exists(self.spark, path) else {"version": 0, "tables": {}}

    def has(self, name: str) -> bool:
        return name in self._pointer()["tables"]

    def read(self, name: str) -> DataFrame:
        at = self._pointer()["tables"].get(name)
        return conform(self.spark.read.parquet(f"{self.root}/{at}"), name) if at else empty(self.spark, name)

    def commit(self, tables: dict[str, DataFrame]) -> None:
        now = self._pointer()
        version = now["version"] + 1
        at = {name: f"{name}/v={version}" for name in tables}
        # the jobs share the cluster; none is long enough to fill it
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda name: conform(tables[name], name).write.mode("overwrite").parquet(f"{self.root}/{at[name]}"), tables))
        now["tables"] |= at
        now["version"] = version
        write_text(self.spark, f"{self.root}/current.json", json.dumps(now))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes table versions older than the last ``keep`` commits that nothing points to."""
        now = self._pointer()
        gone = []
        for name, at in now["tables"].items():
            for v in range(1, now["version"] - keep + 1):
                path = f"{self.root}/{name}/v={v}"
                if f"{name}/v={v}" != at and path_exists(self.spark, path):
                    remove_path(self.spark, path)
                    gone.append(f"{name}/v={v}")
        return gone

    def all(self) -> dict[str, DataFrame]:
        return {n: self.read(n) for n in self._pointer()["tables"]}


def select_slice(df: DataFrame, offset: int = 0, limit: int = 0) -> DataFrame:
    """Records by input order; limit 0 means all that is left."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    if not offset and not limit:
        return df
    out = df.orderBy("seq").offset(offset)
    return out.limit(limit) if limit else out


def extract_generic(documents: DataFrame) -> DataFrame:
    """Rule-based extraction: runs of capitalized words as concepts (first 30), the first 120 words as summary."""
    names = F.slice(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?U)\b([A-Z][A-Za-z]{2,}(?:\s+[A-Z][A-Za-z]{2,})*)\b"),
        F.lit(1))), 1, 30)
    none = F.array().cast("array<string>")
    ents = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("Concepts").alias("entity_type"), F.lit(0.5).alias("confidence"),
        none.alias("aliases")))
    words = F.filter(F.split("content", text.SPACE_CLASS + "+"), lambda w: w != "")
    return documents.select(
        "seq", "id", "title", "content", "source", "metadata", F.array_join(F.slice(words, 1, 120), " ").alias("summary"),
            F.array(F.concat(F.lit("source/"), "source")).alias("tags"), none.alias("related_ids"),
        F.lit(0.5).alias("importance"), F.lit("note").alias("document_type"), F.lit("").alias("translation_ko"), ents.alias("entities"),
            clean_relations(F.lit(None).cast(RELATION)).alias("relations"))


PAYLOAD = ["summary", "tags", "related_ids", "importance", "document_type", "translation_ko", "entities", "relations"]


def payload(records: DataFrame) -> Column:
    """The stored result of a record: its fields in order of their names, as JSON."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(PAYLOAD)]))


def result_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def source_identity(records: DataFrame) -> DataFrame:
    """document_id, source, source_id, metadata, seen_at, seq: who sent a record under which id. The source is compared
    in lower case and trimmed; the id is metadata.source_id, else metadata.external_id, else the record's own."""
    given = [first_non_blank(F.get_json_object("metadata", f"$.{k}")) for k in ("source_id", "external_id")]
    own = F.coalesce(*given, first_non_blank(F.col("id")))
    return records.select(F.col("id").alias("document_id"), F.lower(strip_space(F.col("source"))).alias("source"), own.alias("source_id"),
        "metadata", F.current_timestamp().alias("seen_at"), "seq")


def faults(records: DataFrame) -> DataFrame:
    """document_id, error, at, seq of records that cannot be taken in: their source or id is blank."""
    i = source_identity(records)
    why = F.when(first_non_blank(F.col("document_id")).isNull(),
        "invalid source identity: no document id").when(F.coalesce("source", F.lit("")) == "", "invalid source identity: no source")
    return i.select(F.coalesce("document_id", F.lit("")).alias("document_id"), why.alias("error"), F.col("seen_at").alias("at"),
        "seq").where("error is not null")


def ingest_enriched(spark: SparkSession, store: TableStore, records: DataFrame, force: bool = False, failed: DataFrame | None = None,
    extra: dict[str, DataFrame] | None = None) -> dict:
    """Documents, identities, canonical entities and relations of a batch, in one commit. A document is skipped if its
    content hash and its payload are both unchanged. A record without a valid identity is recorded as a failure (as are
    the rows of ``failed``: document_id, error, at, seq) and does not stop the others. ``extra`` tables go along."""
    every = materialize(records, "records")
    bad = faults(every)
    if failed is not None:
        bad = bad.unionByName(failed.select(F.col("document_id"), "error", "at",
            F.lit(None).cast(every.schema["seq"].dataType).alias("seq")))
    bad = materialize(bad, "faults")
    r = every.where((first_non_blank(F.col("id")).isNotNull()) & (F.coalesce(F.lower(strip_space(F.col("source"))), F.lit("")) != ""))
    r = r.withColumn("content_hash", F.sha2("content", 256)).withColumn("payload", payload(every))
    # of a repeated id the last record counts
    last = r.groupBy("id").agg(F.max("seq").alias("seq"))
    r = r.join(last, ["id", "seq"], "left_semi")
    old_docs, old_results = store.read("documents"), store.read("results")
    known = old_docs.select("id", F.col("content_hash").alias("h")).join(
        old_results.select(F.col("document_id").alias("id"), result_hash(F.col("payload")).alias("p")), "id", "left")
    same = F.coalesce((F.col("h") == F.col("content_hash")) & (F.col("p") == result_hash(F.col("payload"))), F.lit(False)) & ~F.lit(force)
    r = materialize(r.join(known, "id", "left").withColumn("same", same).drop("h", "p"), "known")
    todo = r.where("not same")
    docs = todo.select("id", "title", "content_hash", "source", F.lit("done").alias("status"), F.current_timestamp().alias("updated_at"),
        "content", "metadata", "seq")
    sources, conflicts = upsert.register_sources(store.read("document_sources"), source_identity(todo))
    ents = todo.select(F.col("id").alias("document_id"), "source", F.col("seq").alias("doc_seq"),
        F.posexplode("entities").alias("pos", "e"))
    batch = ents.select(F.struct("doc_seq", "pos").alias("seq"), "doc_seq", "document_id", "source", "e.name", "e.entity_type", "e.aliases",
        "e.confidence")
    full = canonical.resolve_entities(batch, store.read("entities"), store.read("entity_aliases"))
    entities = upsert.merge_entities(store.read("entities"),
        full.select(F.col("canonical").alias("name"), "entity_type", "aliases", "confidence"))
    aliases = canonical.alias_claims(full, store.read("entity_aliases"))
    touched = r.where("not same").select(F.col("id").alias("document_id"))
    key = ["document_id", "entity_name", "entity_type"]
    links = upsert.last_wins(empty(spark, "document_entities"),
        full.select("document_id", F.col("canonical").alias("entity_name"), "entity_type", "confidence", "seq"), key)
    doc_ents = store.read("document_entities").join(touched, "document_id", "left_anti").unionByName(links)
    ent_src = store.read("entity_sources").join(touched, "document_id",
        "left_anti").unionByName(full.select(F.col("canonical").alias("entity_name"), "entity_type", "source", "document_id").distinct())
    words = vocabulary.link_entities(full.select(F.col("canonical").alias("name"), "entity_type"), store.read("vocabularies"))
    ent_words = store.read("entity_vocabulary_links")
    ent_words = ent_words.join(words.select("entity_name", "entity_type", "vocabulary_id"), ["entity_name", "entity_type", "vocabulary_id"],
        "left_anti").unionByName(conform(words, "entity_vocabulary_links"))
    rel = todo.select(F.col("id").alias("document_id"), F.col("seq").alias("doc_seq"),
        F.posexplode("relations").alias("pos", "r")).select("document_id", F.struct("doc_seq", "pos").alias("seq"), "r.*")
    ends = rel.select("document_id", F.explode(F.array("source", "target")).alias("name")).distinct()
    reached = todo.select(F.col("id").alias("document_id"), F.col("seq").alias("doc_seq"))
    ends = materialize(canonical.resolve_endpoints_in_order(ends, full, store.read("entities"), store.read("entity_aliases"), reached),
        "ends")
    rel = rel.join(ends.select("document_id", F.col("name").alias("source"), F.col("canonical").alias("source_name")),
        ["document_id", "source"])
    rel = rel.join(ends.select("document_id", F.col("name").alias("target"), F.col("canonical").alias("target_name")),
        ["document_id", "target"])
    rel = materialize(rel.select("document_id", "source_name", "relation", "target_name", "confidence", "seq"), "stated")
    doc_rel = upsert.last_wins(empty(spark, "document_relations"), rel, ["document_id", "source_name", "relation", "target_name"])
    doc_rel = store.read("document_relations").join(touched, "document_id", "left_anti").unionByName(doc_rel)
    relations = upsert.collect_relations(upsert.last_wins(store.read("relations"), rel.drop("document_id"),
        ["source_name", "relation", "target_name"]), doc_rel)
    all_docs = upsert.last_wins(old_docs, docs, ["id"])
    wrong = bad.where("document_id <> ''").select(F.col("document_id").alias("id"), F.lit(True).alias("wrong")).distinct()
    all_docs = all_docs.join(wrong, "id", "left").withColumn("status",
        F.when(F.col("wrong"), "error").otherwise(F.col("status"))).drop("wrong")
    failures = upsert.clear_failures(store.read("processing_failures"), r.select(F.col("id").alias("document_id")))
    done = {
        "documents": all_docs, "document_sources": sources, "source_conflicts": upsert.record_conflicts(store.read("source_conflicts"),
            conflicts),
        "results": upsert.last_wins(old_results, todo.select(F.col("id").alias("document_id"), "payload", "seq"), ["document_id"]),
            "entities": entities, "entity_aliases": aliases,
        "document_entities": doc_ents, "entity_sources": ent_src, "relations": relations, "document_relations": doc_rel,
            "entity_vocabulary_links": ent_words,
        "processing_failures": upsert.record_failures(failures, bad),
    }
    n = {x["same"]: x["count"] for x in r.groupBy("same").count().collect()}
    errors = bad.count()
    if n.get(False) or errors or extra:
        store.commit(done | (extra or {}))
    return {"processed": n.get(False, 0), "skipped": n.get(True, 0), "errors": errors}


def ingest_generic(spark: SparkSession, store: TableStore, documents: DataFrame, provider: Callable[[str, str], object] | None = None,
    model: str = "", wait: float = 1.0) -> dict:
    """Generic documents: unchanged ones are dropped first. With a ``provider`` the others are enriched by its stored or
    new answers, and by the rule-based extraction where it has none or a wrong one; answers are stored along."""
    changed = upsert.document_changes(store.read("documents"), documents.withColumn("content_hash", F.sha2("content", 256)))
    skipped = changed.where("change = 'unchanged'").count()
    fresh = changed.where("change <> 'unchanged'").drop("change", "content_hash")
    plain = extract_generic(fresh)
    if provider is None:
        out = ingest_enriched(spark, store, plain)
        return out | {"skipped": out["skipped"] + skipped}
    fresh = materialize(fresh, "fresh")
    got = materialize(enrich.answers(fresh, store.read("llm_cache"), provider, model, wait), "answers")
    parsed = enrich.parse_payload(fresh.join(got.where("payload is not null").select("id", "payload"), "id"))
    good = materialize(parsed.where("valid").drop("valid"), "enriched")
    both = good.select(*plain.columns).unionByName(plain.join(good.select("id"), "id", "left_anti"))
    new = got.where("payload is not null and not cached").select("cache_key", "payload", F.lit(0).alias("seq")).distinct()
    out = ingest_enriched(spark, store, both, extra={"llm_cache": upsert.cache_put(store.read("llm_cache"), new)})
    counts = got.agg(F.count_if(F.col("cached")).alias("cache_hits"),
        F.countDistinct(F.when(~F.col("cached"), F.col("cache_key"))).alias("llm_calls"),
            F.count_if(F.col("error").isNotNull()).alias("llm_fallbacks")).first().asDict()
    return out | {"skipped": out["skipped"] + skipped} | counts


def _blank(c: Column) -> Column:
    return F.when(strip_space(c) != "", strip_space(c))


def ingest_vocabulary(spark: SparkSession, store: TableStore, words: DataFrame) -> dict:
    """Words resolved to the canonical row by id, word or traditional form, merged, linked to entities and documents,
    in one commit."""
    words = materialize(words, "words")
    aliases = materialize(vocabulary.vocabulary_aliases(words, store.read("vocabulary_aliases")), "word-aliases")
    hit = words.select("seq", F.col("id").alias("own"), F.posexplode(F.array("id", "word", "traditional")).alias("p", "a")).select("seq",
        "own", "p", norm_alias(_blank(F.col("a"))).alias("alias")).join(aliases, "alias")
    to = hit.groupBy("own").agg(F.min_by("canonical_id", F.struct("p", "seq")).alias("canonical_id"))
    mapping = materialize(to.select(F.col("own").alias("duplicate_id"), "canonical_id"), "word-merges")
    table = words.withColumn("updated_at", F.current_timestamp())
    vocab = upsert.merge_vocabulary(upsert.replace_groups(store.read("vocabularies"), conform(table, "vocabularies"), ["id"]), mapping)
    vocab = materialize(vocab, "vocabularies")
    links = vocabulary.link_entities(store.read("entities"), vocab, folded=True)
    by_id = mapping.withColumnRenamed("duplicate_id", "id")
    named = words.select("id", F.explode(F.from_json(F.get_json_object("metadata", "$.entities"), "array<string>")).alias("entity")).join(
        by_id, "id").select(F.col("canonical_id").alias("vocabulary_id"), "entity")
    explicit = vocabulary.explicit_entity_links(named, store.read("entity_aliases"))
    k = ["entity_name", "entity_type", "vocabulary_id"]
    links = explicit.unionByName(links.join(explicit.select(*k), k, "left_anti"))
    src = words.join(by_id, "id").select(F.col("canonical_id").alias("vocabulary_id"), F.col("id").alias("source_id"), "source", "metadata",
        "seq")
    moved = upsert.rewire_vocabulary({n: store.read(n) for n in ("entity_vocabulary_links", "document_vocabulary_links",
        "vocabulary_sources")}, mapping)
    docs = store.read("documents")
    wanted = docs.select(F.col("id").alias("document_id"), F.explode(
        F.from_json(F.get_json_object("metadata", "$.vocabulary_ids"), "array<string>")).alias("vocabulary_id"))
    store.commit({
        "vocabularies": vocab, "vocabulary_aliases": aliases,
        "entity_vocabulary_links": upsert.replace_groups(moved["entity_vocabulary_links"], conform(links, "entity_vocabulary_links"),
            ["vocabulary_id"]),
        "vocabulary_sources": upsert.last_wins(moved["vocabulary_sources"], src, ["vocabulary_id", "source_id"]),
        "document_vocabulary_links": vocabulary.link_documents(docs, vocab, wanted, moved["document_vocabulary_links"], aliases),
    })
    return {"words": words.count()}


def relink_documents(store: TableStore) -> None:
    """Vocabulary links of all documents with content, as after an ingest."""
    docs = store.read("documents")
    wanted = docs.select(F.col("id").alias("document_id"), F.explode(
        F.from_json(F.get_json_object("metadata", "$.vocabulary_ids"), "array<string>")).alias("vocabulary_id"))
    links = vocabulary.link_documents(docs, store.read("vocabularies"), wanted, store.read("document_vocabulary_links"),
        store.read("vocabulary_aliases"))
    store.commit({"document_vocabulary_links": links})


def merge_entities(store: TableStore, mapping: DataFrame) -> int:
    """All merges of mapping (duplicate, canonical, entity_type, reason) over every table, with log rows, in one
    commit. The number of merges that did something."""
    names = ["entities", "entity_aliases", "entity_merge_log", *upsert.TYPED_LINKS, *upsert.NAMED_ENDS]
    before = store.read("entity_merge_log").count()
    store.commit(upsert.merge_entities_everywhere({n: store.read(n) for n in names}, mapping))
    return store.read("entity_merge_log").count() - before


def set_aliases(store: TableStore, rows: DataFrame) -> None:
    """alias, canonical_name, entity_type, seq, stated by hand."""
    store.commit({"entity_aliases": upsert.set_aliases(store.read("entity_aliases"), rows)})


def save_evidence(store: TableStore, rows: DataFrame) -> None:
    store.commit({"evidence": upsert.save_evidence(store.read("evidence"), rows.withColumn("seq", F.lit(0)))})


def verify_relations(store: TableStore, rows: DataFrame) -> None:
    """relation_evidence rows (document_id, source_name, relation, target_name, evidence_document_id, status)."""
    new = rows.withColumn("checked_at", F.current_timestamp()).withColumn("seq", F.lit(0))
    store.commit({"relation_evidence": upsert.link_evidence(store.read("relation_evidence"), new)})


def derive(store: TableStore, enriched: str, music: str) -> dict[str, int]:
    """Every derived table rebuilt and orphans pruned, in one commit."""
    t = store.read
    ents, aliases = upsert.prune_orphans(t("entities"), t("entity_aliases"), t("document_entities"), t("relations"))
    chains = inference.relation_chains(t("relations"), t("document_relations"))
    one = inference.same_document_links(t("document_entities"), t("documents"), t("document_vocabulary_links"), enriched)
    two = inference.three_way_links(t("document_entities"), t("documents"), t("document_vocabulary_links"), t("document_relations"), ents,
        enriched, music)
    three = inference.album_links(two, t("relations"), t("document_relations"))
    cross = one.withColumn("provenance", F.to_json(F.array("document_id"))).drop("document_id").unionByName(
        two.unionByName(three).withColumn("provenance", F.to_json("document_ids")).drop("document_ids"))
    bridges = inference.source_bridges(t("entity_sources")).withColumn("provenance", F.to_json(F.struct("documents_a", "documents_b")))
    store.commit({"entities": ents, "entity_aliases": aliases, "derived_relations": chains, "cross_domain_links": cross,
        "source_bridge_links": bridges})
    return {n: t(n).count() for n in ("derived_relations", "cross_domain_links", "source_bridge_links")}


def refresh_bridges(store: TableStore, report: str | None = None) -> dict:
    """The source bridges alone rebuilt, with a report."""
    bridges = inference.source_bridges(store.read("entity_sources"))
    store.commit({"source_bridge_links": bridges.withColumn("provenance", F.to_json(F.struct("documents_a", "documents_b")))})
    out = inference.bridge_report(store.read("source_bridge_links"))
    if report:
        sinks.write_report(report, out)
    return out


def result_records(store: TableStore) -> DataFrame:
    """Documents with their stored results as enriched records."""
    kind = f"document_type string, importance double, related_ids array<string>, summary string, tags array<string>, translation_ko string, entities {enrich.ENTITIES}, relations {enrich.RELATIONS}"
    r = store.read("results").select(F.col("document_id").alias("id"), F.from_json("payload", kind).alias("p")).select("id", "p.*")
    return store.read("documents").select("id", "title", "source", "content", "metadata").join(r, "id")


def project(store: TableStore, out: str) -> list[str]:
    """Graph, manifest, notes and indexes below ``out``; the index files written."""
    t = store.read
    counts = F.from_json("provenance", "documents_a long, documents_b long")
    bridges = t("source_bridge_links").withColumn("documents_a", counts["documents_a"]).withColumn("documents_b", counts["documents_b"])
    n = graph.nodes(t("entities"), t("vocabularies"), bridges, t("entity_sources"))
    index = graph.name_index(t("entities"), t("entity_aliases"))
    e = graph.relation_edges(t("relations"), index, t("relation_evidence"),
        t("document_relations")).unionByName(graph.relation_edges(t("derived_relations"), index, kind="derived"))
    e = e.unionByName(graph.cross_edges(t("cross_domain_links")), allowMissingColumns=True)
    e = graph.add_edges(e, graph.bridge_edges(bridges))
    sinks.write_graph(n, e, f"{out}/graph.json", graph.SCHEMA_VERSION)
    graph.manifest(t("documents"), t("entities"), t("vocabularies")).write.mode("overwrite").json(f"{out}/manifest")
    lines = sinks.vocabulary_lines(t("document_vocabulary_links"), t("vocabularies"))
    notes = sinks.document_notes(result_records(store), lines).unionByName(
        sinks.entity_notes(t("entities"), t("entity_sources"), t("document_entities"), t("relations"), t("derived_relations")))
    notes = notes.unionByName(sinks.vocabulary_notes(t("vocabularies"), t("entity_vocabulary_links"), t("document_vocabulary_links")))
    sinks.write_notes(sinks.distinct_paths(notes), out)
    simple = sinks.entity_index(t("entities")).unionByName(sinks.domain_index(t("entities"))).unionByName(
        sinks.vocabulary_index(t("vocabularies"))).unionByName(sinks.level_index(t("vocabularies")))
    done = sinks.write_index(simple, out)
    done += sinks.write_index(sinks.cross_domain_index(t("derived_relations"), t("cross_domain_links"), t("vocabularies"), bridges), out,
        sinks.CROSS_SECTIONS)
    totals = {n: t(n) for n in ("relations", "vocabularies", "source_bridge_links", "entity_merge_log")}
    return done + sinks.write_index(sinks.knowledge_lines(sinks.knowledge_index(t("entities"), t("documents")), totals), out,
        ["Entity Domains", "Sources", "Cross-Domain Graph"])


def status(store: TableStore) -> dict[str, int]:
    return {n: df.count() for n, df in store.all().items()}


def check(spark: SparkSession, store: TableStore) -> dict:
    return qa.audit(spark, {n: store.read(n) for n in TABLES if store.has(n) or n in qa.REQUIRED})


class Engine:
    """One state folder and one output folder with the steps over them."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, provider: Callable[[str, str], object] | None = None,
        model: str = "", enriched: str = "enriched", music: str = "music"):
        self.spark, self.settings = spark, settings or Settings()
        self.provider, self.model, self.roles = provider, model, (enriched, music)
        self.store = TableStore(spark, self.settings.state_path)

    def _finish(self, stats: dict) -> dict:
        stats |= derive(self.store, *self.roles)
        project(self.store, self.settings.output_path)
        self.store.vacuum()
        return stats | {"tables": status(self.store)}

    def run_documents(self, documents: DataFrame, offset: int = 0, limit: int = 0) -> dict:
        return self._finish(ingest_generic(self.spark, self.store, select_slice(documents, offset, limit), self.provider, self.model))

    def run_processed(self, records: DataFrame, offset: int = 0, limit: int = 0) -> dict:
        stats = ingest_enriched(self.spark, self.store, select_slice(records, offset, limit))
        relink_documents(self.store)
        return self._finish(stats)

    def run_vocabulary(self, words: DataFrame, offset: int = 0, limit: int = 0) -> dict:
        return self._finish(ingest_vocabulary(self.spark, self.store, select_slice(words, offset, limit)))

    def retry_failed(self, records: DataFrame, most: int = 5, offset: int = 0, limit: int = 0) -> dict:
        """The records whose documents failed before, fewer than ``most`` times."""
        again = upsert.retryable(self.store.read("processing_failures"), most).select(F.col("document_id").alias("id"))
        return self.run_processed(records.join(again, "id", "left_semi"), offset, limit)
