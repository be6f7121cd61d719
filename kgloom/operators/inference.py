"""Facts derived by fixed join rules, each table rebuilt whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stated(document_relations: DataFrame) -> DataFrame:
    k = ["source_name", "relation", "target_name"]
    return document_relations.groupBy(*k).agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"))


def _leg(s: str, r: str, t: str, docs: str):
    return F.struct(F.col(s).alias("source"), F.lit(r).alias("relation"), F.col(t).alias("target"),
        F.coalesce(docs, F.array().cast("array<string>")).alias("document_ids"))


def relation_chains(relations: DataFrame, document_relations: DataFrame, first: str = "performed", second: str = "part_of",
    gives: str = "contributed_to", factor: float = 0.95) -> DataFrame:
    """a -first-> b -second-> c gives a -gives-> c with ``factor`` times the lower confidence. Of several middles the
    greatest name stays. Both legs keep the documents that state them."""
    r1 = relations.where(F.col("relation") == first).select(F.col("source_name").alias("a"), F.col("target_name").alias("b"),
        F.col("confidence").alias("c1"))
    r2 = relations.where(F.col("relation") == second).select(F.col("source_name").alias("b"), F.col("target_name").alias("c"),
        F.col("confidence").alias("c2"))
    best = r1.join(r2, "b").groupBy("a", "c").agg(F.max(F.struct("b", "c1", "c2")).alias("x"), F.count("*").alias("paths"))
    best = best.select("a", "c", F.col("x.b").alias("b"), F.round(F.least("x.c1", "x.c2") * factor, 6).alias("confidence"), "paths")
    d = _stated(document_relations)
    d1 = d.where(F.col("relation") == first).select(F.col("source_name").alias("a"), F.col("target_name").alias("b"),
        F.col("document_ids").alias("d1"))
    d2 = d.where(F.col("relation") == second).select(F.col("source_name").alias("b"), F.col("target_name").alias("c"),
        F.col("document_ids").alias("d2"))
    best = best.join(d1, ["a", "b"], "left").join(d2, ["b", "c"], "left")
    return best.select(
        F.col("a").alias("source_name"), F.lit(gives).alias("relation"), F.col("c").alias("target_name"), "confidence",
            F.lit(f"{first}+{second}").alias("rule"),
        F.to_json(F.array(_leg("a", first, "b", "d1"), _leg("b", second, "c", "d2"))).alias("provenance"), F.col("b").alias("through"),
            "paths")


def same_document_links(document_entities: DataFrame, documents: DataFrame, document_vocabulary_links: DataFrame, source: str,
    factor: float = 0.9) -> DataFrame:
    """An entity and a word of one document of ``source`` belong together; of several documents the greatest id stays."""
    docs = documents.where(F.col("source") == source).select(F.col("id").alias("document_id")).distinct()
    e = document_entities.join(docs, "document_id", "left_semi").groupBy("document_id", "entity_name",
        "entity_type").agg(F.max("confidence").alias("c1"))
    v = document_vocabulary_links.groupBy("document_id", "vocabulary_id").agg(F.max("confidence").alias("c2"))
    both = e.join(v, "document_id").groupBy("entity_name", "entity_type",
        "vocabulary_id").agg(F.max(F.struct("document_id", "c1", "c2")).alias("x"))
    return both.select(
        F.col("entity_name").alias("left_name"), F.col("entity_type").alias("left_type"), F.col("vocabulary_id").alias("right_id"),
            F.lit("vocabulary").alias("right_kind"),
        F.round(F.least("x.c1", "x.c2") * factor, 6).alias("confidence"), F.lit("same_source_document").alias("rule"),
            F.col("x.document_id").alias("document_id"))


def three_way_links(
    document_entities: DataFrame, documents: DataFrame, document_vocabulary_links: DataFrame, document_relations: DataFrame,
        entities: DataFrame, source: str, music: str,
    performed: str = "performed", f1: float = 0.9, f2: float = 0.81,
) -> DataFrame:
    """An entity linked to a word in a document of ``source`` that performs a track in a document of ``music``: entity
    to word, and word to track. The row of the greatest (documents, track) stays."""
    base = documents.select(F.col("id").alias("document_id"), "source").distinct()
    e = document_entities.groupBy("document_id", "entity_name", "entity_type").agg(F.max("confidence").alias("c"))
    left = e.join(base.where(F.col("source") == source).select("document_id"), "document_id", "left_semi").join(
        document_vocabulary_links.groupBy("document_id", "vocabulary_id").agg(F.max("confidence").alias("cv")), "document_id")
    left = left.select("entity_name", "entity_type", "vocabulary_id", F.col("document_id").alias("d1"), F.col("c").alias("c1"), "cv")
    tracks = entities.where("entity_type = 'MusicTracks'").select(F.col("name").alias("track")).distinct()
    right = e.join(base.where(F.col("source") == music).select("document_id"), "document_id", "left_semi").withColumnRenamed("c", "c3")
    rel = document_relations.where(F.col("relation") == performed).select("document_id", F.col("source_name").alias("entity_name"),
        F.col("target_name").alias("track"), F.col("confidence").alias("c4"))
    right = right.join(rel, ["document_id", "entity_name"]).join(tracks, "track", "left_semi").select("entity_name", "entity_type", "track",
        F.col("document_id").alias("d2"), "c3", "c4")
    j = left.join(right, ["entity_name", "entity_type"])
    low = F.least("c1", "cv", "c3")
    rule = F.lit("entity+vocabulary+track").alias("rule")
    ev = j.groupBy("entity_name", "entity_type", "vocabulary_id").agg(F.max(F.struct("d1", "d2", "track", "c1", "cv", "c3")).alias("x"))
    ev = ev.select(F.col("entity_name").alias("left_name"), F.col("entity_type").alias("left_type"),
        F.col("vocabulary_id").alias("right_id"), F.lit("vocabulary").alias("right_kind"),
            F.round(F.least("x.c1", "x.cv", "x.c3") * f1, 6).alias("confidence"), rule, F.array("x.d1", "x.d2").alias("document_ids"))
    vt = j.groupBy("vocabulary_id", "track").agg(F.max(F.struct("d1", "d2", "entity_name", low.alias("low"))).alias("x"))
    vt = vt.select(F.col("vocabulary_id").alias("left_name"), F.lit("Vocabulary").alias("left_type"), F.col("track").alias("right_id"),
        F.lit("music_track").alias("right_kind"), F.round(F.col("x.low") * f2, 6).alias("confidence"), rule,
            F.array("x.d1", "x.d2").alias("document_ids"))
    return ev.unionByName(vt)


def album_links(bridges: DataFrame, relations: DataFrame, document_relations: DataFrame, part_of: str = "part_of",
    factor: float = 0.95) -> DataFrame:
    """Words linked to a track go on to its album; the album's documents join the provenance."""
    t = bridges.where("right_kind = 'music_track'").select("left_name", "left_type", F.col("right_id").alias("track"), "confidence",
        "document_ids")
    r = relations.where(F.col("relation") == part_of).select(F.col("source_name").alias("track"), F.col("target_name").alias("album"),
        F.col("confidence").alias("cr"))
    d = _stated(document_relations).where(F.col("relation") == part_of).select(F.col("source_name").alias("track"),
        F.col("target_name").alias("album"), F.col("document_ids").alias("more"))
    j = t.join(r, "track").join(d, ["track", "album"], "left").groupBy("left_name", "left_type",
        "album").agg(F.max(F.struct("track", "confidence", "cr", "document_ids", "more")).alias("x"))
    return j.select(
        "left_name", "left_type", F.col("album").alias("right_id"), F.lit("music_album").alias("right_kind"),
            F.round(F.least("x.confidence", "x.cr") * factor, 6).alias("confidence"),
        F.lit("entity+vocabulary+track+album").alias("rule"),
            F.array_distinct(F.concat("x.document_ids", F.coalesce("x.more", F.array().cast("array<string>")))).alias("document_ids"))


def bridge_documents(entity_sources: DataFrame) -> DataFrame:
    """entity_name, entity_type, source, document_id: the documents behind the bridges, one row each, of the entities
    that have more than one source. However many there are, no row holds a list of them."""
    s = entity_sources.where("document_id is not null and source is not null and entity_name is not null").select("entity_name",
        "entity_type", "source", "document_id").distinct()
    many = s.groupBy("entity_name", "entity_type").agg(F.min("source").alias("lo"), F.max("source").alias("hi")).where("lo < hi")
    many = many.select("entity_name", F.coalesce("entity_type", F.lit("")).alias("__t"), F.col("entity_type").isNull().alias("__n"))
    on = s.withColumn("__t", F.coalesce("entity_type", F.lit(""))).withColumn("__n", F.col("entity_type").isNull())
    return on.join(many, ["entity_name", "__t", "__n"], "left_semi").select(*s.columns)


def source_bridges(entity_sources: DataFrame) -> DataFrame:
    """Unordered pairs of sources that share an entity, with the number of its documents in either. Documents are
    counted before anything is grouped by entity; its sources are few, so the pairs are formed within its one row."""
    s = entity_sources.where("document_id is not null and source is not null and entity_name is not null")
    per = s.groupBy("entity_name", "entity_type", "source").agg(F.countDistinct("document_id").alias("n"))
    per = per.groupBy("entity_name", "entity_type").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("s")).where(
        F.size("s") > 1)
    pair = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")),
        lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return per.select("entity_name", "entity_type", F.explode(pair).alias("p")).select(
        "entity_name", "entity_type", F.col("p.a.source").alias("source_a"), F.col("p.b.source").alias("source_b"),
            F.lit(1.0).alias("confidence"),
        F.lit("shared_canonical_entity").alias("rule"), F.col("p.a.n").alias("documents_a"), F.col("p.b.n").alias("documents_b"))


def bridge_pairs(entity_sources: DataFrame) -> DataFrame:
    """Pairs per source pair, counted from each entity's set of sources alone."""
    s = entity_sources.where("source is not null").groupBy("entity_name",
        "entity_type").agg(F.array_sort(F.collect_set("source")).alias("s"))
    pair = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")),
        lambda y: F.struct(x.alias("source_a"), y.alias("source_b")))))
    return s.where(F.size("s") > 1).select(F.explode(pair).alias("p")).groupBy("p.source_a",
        "p.source_b").agg(F.count("*").alias("entities"))


def bridge_report(bridges: DataFrame) -> dict:
    """What a rebuild of the bridges gave."""
    return {"status": "OK", "source_bridge_links": bridges.count(), "rule": "shared_canonical_entity"}
