"""Integrity rules over the tables. Every rule is one DataFrame of findings; the report is one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import valid_confidence
from ..schemas import ENTITY_TYPES, EVIDENCE_STATUS

# What the audit needs, and the shape of a relation name.
REQUIRED = "documents document_sources results entities document_entities relations document_relations relation_evidence entity_aliases entity_sources entity_merge_log processing_failures vocabularies entity_vocabulary_links document_vocabulary_links vocabulary_sources".split()
RELATION_NAME = "^[a-z][a-z0-9_]*$"
CAP = 100  # orphan findings shown per rule, in order of their text


def _found(df: DataFrame, rule: str, severity: str, *cols: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
        F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("context"))


def missing(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``child`` without a row of ``parent`` under the same values; a null value has none."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct()
    return child.join(keys, list(on), "left_anti")


def findings(t: dict[str, DataFrame]) -> DataFrame:
    """rule, severity, context for every rule whose tables are given."""
    out: list[DataFrame] = []

    def rule(name: str, severity: str, df: DataFrame, *cols: str) -> None:
        out.append(_found(df, name, severity, *cols))

    names = t["entities"].select("name").distinct() if "entities" in t else None
    ent = {"entity_name": "name", "entity_type": "entity_type"}

    def has(*need: str) -> bool:
        return all(n in t for n in need)

    if has("document_sources", "documents"):
        rule("document_source.orphan", "error", missing(t["document_sources"], t["documents"], {"document_id": "id"}), "source",
            "source_id", "document_id")
    if has("entities"):
        e = t["entities"]
        rule("entity.invalid_type", "error", e.where(~F.coalesce(F.col("entity_type"), F.lit("")).isin(ENTITY_TYPES)), "name",
            "entity_type")
        rule("entity.duplicate_pk", "error", e.groupBy("name", "entity_type").count().where("count > 1"), "name", "entity_type")
        rule("entity.confidence_range", "error", e.where(~valid_confidence(F.col("confidence"))), "name", "entity_type", "confidence")
    if has("entity_aliases", "entities"):
        a = t["entity_aliases"]
        many = a.groupBy("alias", "entity_type").agg(F.array_sort(F.collect_set("canonical_name")).alias("c")).where(F.size("c") > 1)
        rule("alias.ambiguous", "warning", many.withColumn("c", F.array_join("c", ",")), "alias", "entity_type", "c")
        rule("alias.orphan", "error", missing(a, t["entities"], {"canonical_name": "name", "entity_type": "entity_type"}), "alias",
            "canonical_name", "entity_type")
    if has("document_entities", "documents", "entities"):
        d = t["document_entities"]
        lost = missing(d, t["documents"], {"document_id": "id"}).unionByName(missing(d, t["entities"], ent)).distinct()
        rule("document_entity.orphan", "error", lost, "document_id", "entity_name", "entity_type")
    for table, prefix, least in (("relations", "relation", True), ("derived_relations", "derived_relation", False)):
        if has(table, "entities"):
            r = t[table]
            ends = r.join(names.withColumnRenamed("name", "source_name"), "source_name",
                "left_anti").select(*r.columns).unionByName(r.join(names.withColumnRenamed("name", "target_name"), "target_name",
                    "left_anti").select(*r.columns)).distinct()
            rule(f"{prefix}.orphan_endpoint", "error", ends, "source_name", "relation", "target_name")
            rule(f"{prefix}.confidence_range", "error", r.where(~valid_confidence(F.col("confidence"))), "source_name", "relation",
                "target_name", "confidence")
            if least:
                rule("relation.self_loop", "warning", r.where("source_name = target_name"), "source_name", "relation")
                rule("relation.invalid_name", "error", r.where(~F.coalesce(F.col("relation"), F.lit("")).rlike(RELATION_NAME)),
                    "source_name", "relation", "target_name")
    if has("document_relations", "documents", "relations"):
        d, k = t["document_relations"], ["source_name", "relation", "target_name"]
        rule("document_relation.orphan", "error", missing(d, t["documents"],
            {"document_id": "id"}).unionByName(missing(d, t["relations"], {c: c for c in k}).select(*d.columns)).distinct(), "document_id",
                *k)
    if has("relation_evidence"):
        e, k = t["relation_evidence"], ["document_id", "source_name", "relation", "target_name"]
        if has("document_relations"):
            rule("relation_evidence.orphan", "error", missing(e, t["document_relations"], {c: c for c in k}), *k)
        rule("relation_evidence.invalid_status", "error", e.where(~F.coalesce(F.col("status"), F.lit("")).isin(EVIDENCE_STATUS)), *k,
            "status")
    if has("entity_sources", "entities", "documents"):
        s = t["entity_sources"]
        rule("entity_source.orphan", "error", missing(s, t["entities"],
            ent).select(*s.columns).unionByName(missing(s, t["documents"], {"document_id": "id"}).select(*s.columns)).distinct(),
                "entity_name", "entity_type", "source", "document_id")
    if has("entity_vocabulary_links", "entities", "vocabularies"):
        v = t["entity_vocabulary_links"]
        rule("entity_vocabulary.orphan", "error", missing(v, t["entities"],
            ent).select(*v.columns).unionByName(missing(v, t["vocabularies"], {"vocabulary_id": "id"}).select(*v.columns)).distinct(),
                "entity_name", "entity_type", "vocabulary_id")
        rule("entity_vocabulary.confidence_range", "error", v.where(~valid_confidence(F.col("confidence"))), "entity_name", "vocabulary_id",
            "confidence")
    if has("document_vocabulary_links", "documents", "vocabularies"):
        v = t["document_vocabulary_links"]
        rule("document_vocabulary.orphan", "error", missing(v, t["documents"],
            {"document_id": "id"}).select(*v.columns).unionByName(
                missing(v, t["vocabularies"], {"vocabulary_id": "id"}).select(*v.columns)).distinct(), "document_id", "vocabulary_id")
        rule("document_vocabulary.confidence_range", "error", v.where(~valid_confidence(F.col("confidence"))), "document_id",
            "vocabulary_id", "confidence")
    if has("vocabulary_sources", "vocabularies"):
        rule("vocabulary_source.orphan", "error", missing(t["vocabulary_sources"], t["vocabularies"], {"vocabulary_id": "id"}),
            "vocabulary_id", "source_id")
    if has("cross_domain_links", "entities", "vocabularies"):
        c = t["cross_domain_links"]
        known = t["entities"].select(F.concat_ws(":", "entity_type", "name").alias("key")).unionByName(
            t["vocabularies"].select(F.concat(F.lit("Vocabulary:"), "id").alias("key"))).distinct()
        side = F.when(F.col("right_kind") == "music_track", "MusicTracks").when(F.col("right_kind") == "music_album",
            "MusicAlbums").otherwise("Vocabulary")
        lost = c.withColumn("key", F.concat_ws(":", "left_type", "left_name")).join(known, "key",
            "left_anti").unionByName(c.withColumn("key", F.concat_ws(":", side, "right_id")).join(known, "key", "left_anti")).drop(
                "key").distinct()
        rule("cross_domain_link.orphan_endpoint", "error", lost, "left_name", "left_type", "right_id", "right_kind")
        rule("cross_domain_link.confidence_range", "error", c.where(~valid_confidence(F.col("confidence"))), "left_name", "right_id",
            "confidence")
    if has("source_bridge_links", "entities"):
        b = t["source_bridge_links"]
        rule("source_bridge.invalid_endpoint", "error", missing(b, t["entities"],
            ent).select(*b.columns).unionByName(b.where("source_a = source_b")).distinct(), "entity_name", "entity_type", "source_a",
                "source_b")
        rule("source_bridge.confidence_range", "error", b.where(~valid_confidence(F.col("confidence"))), "entity_name", "source_a",
            "source_b", "confidence")
    if has("results", "documents"):
        rule("result.orphan", "error", missing(t["results"], t["documents"], {"document_id": "id"}), "document_id")
    if has("processing_failures"):
        rule("processing.failures", "warning", t["processing_failures"].agg(F.count("*").alias("n")).where("n > 0"), "n")
    if has("entity_merge_log"):
        rule("merge.invalid_self_merge", "error", t["entity_merge_log"].where("canonical_name = duplicate_name"), "canonical_name",
            "entity_type")
    return reduce(DataFrame.unionByName, out)


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "severity").agg(F.count("*").alias("findings"))


def audit(spark: SparkSession, t: dict[str, DataFrame]) -> dict:
    """The report: FAIL if there is an error or a table is missing; at most ``CAP`` findings shown per rule, errors first."""
    absent = [n for n in REQUIRED if n not in t]
    if absent:
        return {"status": "FAIL", "errors": len(absent), "warnings": 0,
            "findings": [{"rule": "schema.required_tables", "severity": "error", "context": n} for n in absent]}
    found = findings(t).cache()
    total = {r.rule: (r.severity, r.findings) for r in counts(found).collect()}
    # the first findings of each rule by a bounded pick per task, then per rule: no rule is gathered in one task
    top = F.slice(F.array_sort(F.collect_list(F.struct("context", "severity"))), 1, CAP)
    spread = found.withColumn("deal", F.pmod(F.xxhash64("context"), F.lit(64)))
    spread = spread.withColumn("k", F.row_number().over(Window.partitionBy("rule", "deal").orderBy("context"))).where(F.col("k") <= CAP)
    few = spread.groupBy("rule").agg(top.alias("top")).select("rule", F.posexplode("top").alias("n", "x"))
    shown = few.select("rule", "n", "x.*").orderBy(F.col("severity") != "error", "rule", "n").collect()
    found.unpersist()
    errors = sum(n for s, n in total.values() if s == "error")
    return {"status": "FAIL" if errors else "PASS", "errors": errors, "warnings": sum(n for s, n in total.values() if s == "warning"),
        "counts": {k: n for k, (_, n) in sorted(total.items())},
            "findings": [{k: r[k] for k in ("rule", "severity", "context")} for r in shown]}
