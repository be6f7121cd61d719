"""The property graph and the page manifest as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_id

SCHEMA_VERSION = "7"
MANIFEST_VERSION = 2


def node_id(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), name)


def nodes(entities: DataFrame, vocabularies: DataFrame, bridges: DataFrame, entity_sources: DataFrame) -> DataFrame:
    """id, label, type, aliases, confidence, sources: entities, vocabulary words and one node per bridged source pair."""
    src = entity_sources.where("source is not null").groupBy(F.col("entity_name").alias("name"),
        "entity_type").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    none = F.array().cast("array<string>")
    e = entities.groupBy("name", "entity_type").agg(F.max("confidence").alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("aliases", none))))).alias("aliases")).join(src,
            ["name", "entity_type"], "left")
    e = e.select(node_id(F.coalesce("entity_type", F.lit("")), F.col("name")).alias("id"), F.col("name").alias("label"),
        F.col("entity_type").alias("type"), "aliases", "confidence", F.coalesce("sources", none).alias("sources"))
    v = vocabularies.select(node_id(F.lit("Vocabulary"), F.col("id")).alias("id"), F.col("word").alias("label"),
        F.lit("Vocabulary").alias("type"), F.array_compact(F.array("traditional", "pinyin")).alias("aliases"),
            F.lit(1.0).alias("confidence"), F.array_compact(F.array("source")).alias("sources"))
    b = bridges.select("source_a", "source_b").distinct().select(
        node_id(F.lit("SourceBridge"), F.concat_ws("|", "source_a", "source_b")).alias("id"),
            F.concat_ws(" / ", "source_a", "source_b").alias("label"), F.lit("SourceBridge").alias("type"), none.alias("aliases"),
                F.lit(1.0).alias("confidence"), F.array("source_a", "source_b").alias("sources"))
    return e.unionByName(v).unionByName(b)


def name_index(entities: DataFrame, entity_aliases: DataFrame) -> DataFrame:
    """key, id: names and aliases that lead to exactly one node; ambiguous ones are left out."""
    own = entities.select(F.col("name").alias("key"), node_id(F.coalesce("entity_type", F.lit("")), F.col("name")).alias("id"))
    packed = entities.select(F.explode("aliases").alias("key"), node_id(F.coalesce("entity_type", F.lit("")), F.col("name")).alias("id"))
    listed = entity_aliases.where("canonical_name is not null").select(F.col("alias").alias("key"),
        node_id(F.coalesce("entity_type", F.lit("")), F.col("canonical_name")).alias("id"))
    every = own.unionByName(packed).unionByName(listed).where("key is not null")
    return every.groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("hi")).where("id = hi").select("key", "id")


def relation_edges(relations: DataFrame, index: DataFrame, evidence: DataFrame | None = None, document_relations: DataFrame | None = None,
    kind: str = "raw") -> DataFrame:
    """Edges whose two ends are unambiguous, one per (source, relation, target): the first by raw names stays.
    Evidence documents and stating documents come along as sorted lists."""
    k = ["source_name", "relation", "target_name"]
    r = relations.join(index.toDF("source_name", "source"), "source_name").join(index.toDF("target_name", "target"), "target_name")
    none = F.array().cast("array<string>")
    if document_relations is not None:
        r = r.join(document_relations.groupBy(*k).agg(F.array_sort(F.collect_set("document_id")).alias("documents")), k, "left")
    else:
        r = r.withColumn("documents", none)
    if evidence is not None:
        r = r.join(evidence.groupBy(*k).agg(F.array_sort(F.collect_set(F.concat_ws(":", "status", "evidence_document_id"))).alias(
            "evidence")), k, "left")
    else:
        r = r.withColumn("evidence", none)
    best = r.groupBy("source", "relation", "target").agg(F.min_by(F.struct("confidence", "documents", "evidence"),
        F.struct("source_name", "target_name")).alias("x"))
    return best.select("source", "relation", "target", F.col("x.confidence").alias("confidence"), F.lit(kind).alias("kind"),
        F.coalesce("x.documents", none).alias("documents"), F.coalesce("x.evidence", none).alias("evidence"))


def cross_edges(links: DataFrame) -> DataFrame:
    """One edge per (left, kind, right): the first rule by name stays."""
    left = F.when(F.col("left_type") == "Vocabulary", node_id(F.lit("Vocabulary"), F.col("left_name"))).otherwise(
        node_id(F.col("left_type"), F.col("left_name")))
    right = node_id(F.when(F.col("right_kind") == "vocabulary", "Vocabulary").when(F.col("right_kind") == "music_track",
        "MusicTracks").otherwise("MusicAlbums"), F.col("right_id"))
    best = links.groupBy("left_name", "right_kind", "right_id").agg(
        F.min_by(F.struct("left_type", "confidence", "rule"), F.struct("left_type", "rule")).alias("x")).select("left_name", "right_kind",
            "right_id", "x.*")
    return best.select(left.alias("source"), F.col("rule").alias("relation"), right.alias("target"), "confidence",
        F.lit("cross_domain").alias("kind"))


def bridge_edges(bridges: DataFrame) -> DataFrame:
    return bridges.select(node_id(F.coalesce("entity_type", F.lit("")), F.col("entity_name")).alias("source"),
        F.col("rule").alias("relation"), node_id(F.lit("SourceBridge"), F.concat_ws("|", "source_a", "source_b")).alias("target"),
            "confidence", F.lit("source_bridge").alias("kind"))


def add_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of ``new`` that ``old`` does not have under the same source, relation, target and kind; adds no nodes."""
    k = ["source", "relation", "target", "kind"]
    return old.unionByName(new.dropDuplicates(k).join(old.select(*k), k, "left_anti"), allowMissingColumns=True)


def manifest(documents: DataFrame, entities: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """page_id, kind, title: the pages to upsert, ids stable over runs."""
    d = documents.select(page_id("document", F.col("id")).alias("page_id"), F.lit("document").alias("kind"),
        F.coalesce("title", F.col("id")).alias("title"))
    e = entities.select("name", "entity_type").distinct().select(
        page_id("entity", F.concat_ws(":", "entity_type", "name")).alias("page_id"), F.lit("entity").alias("kind"),
            F.col("name").alias("title"))
    v = vocabularies.select(page_id("vocabulary", F.col("id")).alias("page_id"), F.lit("vocabulary").alias("kind"),
        F.col("word").alias("title"))
    return d.unionByName(e).unionByName(v)
