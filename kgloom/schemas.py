"""Table schemas, keys and the fixed vocabularies of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Column lists and primary keys of the tables.
TABLES = {
    "documents": "id string, title string, content_hash string, source string, status string, updated_at timestamp, content string, metadata string",
    "document_sources": "source string, source_id string, document_id string, metadata string, first_seen_at timestamp, last_seen_at timestamp",
    "results": "document_id string, payload string",
    "entities": "name string, entity_type string, aliases array<string>, confidence double",
    "document_entities": "document_id string, entity_name string, entity_type string, confidence double",
    "relations": "source_name string, relation string, target_name string, confidence double",
    "document_relations": "document_id string, source_name string, relation string, target_name string, confidence double",
    "evidence": "document_id string, source string, title string, content string, url string, checked_at timestamp",
    "relation_evidence": "document_id string, source_name string, relation string, target_name string, evidence_document_id string, status string, checked_at timestamp",
    "llm_cache": "cache_key string, payload string",
    "entity_aliases": "alias string, canonical_name string, entity_type string",
    "entity_sources": "entity_name string, entity_type string, source string, document_id string",
    "entity_merge_log": "id long, canonical_name string, duplicate_name string, entity_type string, reason string, created_at timestamp",
    "source_conflicts": "id long, document_id string, field string, existing_source string, incoming_source string, existing_value string, incoming_value string, resolution string, created_at timestamp",
    "processing_failures": "document_id string, attempts int, last_error string, next_retry_at timestamp, updated_at timestamp",
    "vocabularies": "id string, word string, traditional string, pinyin string, pos string, meaning_ko string, hsk_levels array<string>, wordbooks array<string>, source string, metadata string, updated_at timestamp",
    "vocabulary_aliases": "alias string, canonical_id string",
    "entity_vocabulary_links": "entity_name string, entity_type string, vocabulary_id string, match_type string, confidence double",
    "document_vocabulary_links": "document_id string, vocabulary_id string, match_type string, confidence double",
    "vocabulary_sources": "vocabulary_id string, source_id string, source string, metadata string",
    "derived_relations": "source_name string, relation string, target_name string, confidence double, rule string, provenance string",
    "cross_domain_links": "left_name string, left_type string, right_id string, right_kind string, confidence double, rule string, provenance string",
    "source_bridge_links": "entity_name string, entity_type string, source_a string, source_b string, confidence double, rule string, provenance string",
    "reconciliation_provenance": "document_id string, content_hash string, old_path string, new_path string, manifest_path string, verified_at timestamp",
}
KEYS = {
    "documents": ["id"], "document_sources": ["source", "source_id"], "results": ["document_id"], "entities": ["name", "entity_type"],
    "document_entities": ["document_id", "entity_name", "entity_type"], "relations": ["source_name", "relation", "target_name"],
    "document_relations": ["document_id", "source_name", "relation", "target_name"], "evidence": ["document_id"],
    "relation_evidence": ["document_id", "source_name", "relation", "target_name", "evidence_document_id"], "llm_cache": ["cache_key"],
    "entity_aliases": ["alias", "entity_type"], "entity_sources": ["entity_name", "entity_type", "source", "document_id"],
        "entity_merge_log": ["id"], "source_conflicts": ["id"],
    "processing_failures": ["document_id"], "vocabularies": ["id"], "vocabulary_aliases": ["alias"],
        "entity_vocabulary_links": ["entity_name", "entity_type", "vocabulary_id"],
    "document_vocabulary_links": ["document_id", "vocabulary_id"], "vocabulary_sources": ["vocabulary_id", "source_id"],
    "derived_relations": ["source_name", "relation", "target_name", "rule"],
        "cross_domain_links": ["left_name", "left_type", "right_id", "right_kind", "rule"],
    "source_bridge_links": ["entity_name", "entity_type", "source_a", "source_b", "rule"],
        "reconciliation_provenance": ["document_id", "content_hash", "old_path", "new_path"],
}

# The ontology.
ENTITY_TYPES = ["People", "Organizations", "Countries", "Places", "Products", "Technologies", "Concepts", "Events", "Institutions",
    "MusicTracks", "MusicAlbums"]
TYPE_WORDS = {
    "person": "People", "people": "People", "organization": "Organizations", "organizations": "Organizations", "company": "Organizations",
        "companies": "Organizations",
    "brand": "Organizations", "brands": "Organizations", "country": "Countries", "countries": "Countries", "place": "Places",
        "places": "Places",
    "product": "Products", "products": "Products", "technology": "Technologies", "technologies": "Technologies", "concept": "Concepts",
        "concepts": "Concepts",
    "event": "Events", "events": "Events", "institution": "Institutions", "institutions": "Institutions", "musictrack": "MusicTracks",
        "musictracks": "MusicTracks",
    "track": "MusicTracks", "tracks": "MusicTracks", "musicalbum": "MusicAlbums", "musicalbums": "MusicAlbums", "album": "MusicAlbums",
        "albums": "MusicAlbums",
}
RELATION_TYPES = ["owns", "owned_by", "operates", "operated_by", "brand_of", "subsidiary_of", "parent_of", "acquired", "acquired_by"]
LEGACY_TYPES = {"Companies": "Organizations", "Brands": "Organizations"}
EVIDENCE_STATUS = ["checked", "contradicted", "unverified"]
RESOLUTIONS = ["review", "existing", "incoming", "merged"]
MERGE_REASONS = ["explicit", "exact_name", "explicit_alias", "provenance_alias"]
PROTECTED_DIRS = ["00_Inbox", "90_Dashboard", ".obsidian"]
UNKNOWN_PRIORITY, OTHER_PRIORITY = 0, 10


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The declared columns of a table; those that are missing become null (additive migration)."""
    want = StructType.fromDDL(TABLES[name])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
