"""Sources: JSON lines, vocabulary tables, music lists and directories of Markdown notes."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookup import entity_type
from ..functions.text import confidence, first_non_blank, strip_space


class InputError(ValueError):
    """A record that makes the whole load fail."""


ENTITY = "array<struct<name:string,entity_type:string,confidence:string,aliases:array<string>>>"
RELATION = "array<struct<source:string,relation:string,target:string,confidence:string>>"
# Other names of the vocabulary columns.
SYNONYMS = {"id": ["id", "word_id"], "word": ["word", "simplified", "词"], "traditional": ["traditional", "繁体"], "pinyin": ["pinyin", "拼音"],
    "pos": ["pos", "part_of_speech"], "meaning_ko": ["meaning_ko", "meaning", "definition_ko"]}


ORDER = "struct<file:string,block:bigint,line:bigint>"


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))
    return spark.read.option("wholetext", False).text(path).select("value", place.alias("seq"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """seq, value: the non-blank lines. seq sorts them by file, then by their place in it, however files are split."""
    out = _raw_lines(spark, path).where(strip_space(F.col("value")) != "")
    out._kgloom_source = path
    return out


def line_number(spark: SparkSession, path: str, seq) -> int:
    """The number in its file of the line at ``seq``, blank ones counted: lines up to it are counted, only when asked."""
    s = F.col("seq")
    before = (s.block < seq.block) | ((s.block == seq.block) & (s.line <= seq.line))
    return _raw_lines(spark, path).where((s.file == seq.file) & before).count()


def _fail_if(df: DataFrame, what: str, column: str = "seq", path: str | None = None) -> None:
    bad = df.orderBy(column).select(column).first()
    if bad is None:
        return
    at = bad[0]
    if path is not None and hasattr(at, "block"):
        at = f"{Path(at.file).name}:{line_number(df.sparkSession, path, at)}"
    raise InputError(f"{what}: record {at}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Generic documents: id, title, content, source, metadata, seq. Bad JSON, a missing field, blank content or a
    repeated id fails the whole load and names the record."""
    rows = _lines(spark, path).withColumn("j", F.from_json("value",
        "id string, title string, content string, source string, metadata map<string,string>, _corrupt string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    meta = F.get_json_object("value", "$.metadata")
    d = rows.select("seq", "j.id", "j.title", "j.content", F.coalesce("j.source", F.lit("unknown")).alias("source"),
        F.coalesce(meta, F.lit("{}")).alias("metadata"), F.col("j._corrupt").alias("bad"))
    _fail_if(d.where("bad is not null and id is null"), "not a JSON object", path=path)
    _fail_if(d.where("id is null or title is null or content is null"), "id, title or content missing", path=path)
    _fail_if(d.where(strip_space(F.col("content")) == ""), "blank content", path=path)
    _fail_if(d.groupBy("id").count().where("count > 1"), "repeated id", "id")
    return d.drop("bad")


def clean_entities(c: Column) -> Column:
    """Entities with a name: trimmed, type mapped, confidence clamped, aliases trimmed and without blanks."""
    made = F.transform(c, lambda e: F.struct(
        strip_space(e["name"]).alias("name"), entity_type(e["entity_type"]).alias("entity_type"),
            confidence(e["confidence"]).alias("confidence"),
        F.filter(F.transform(F.coalesce(e["aliases"], F.array().cast("array<string>")), lambda a: strip_space(a)),
            lambda a: a != "").alias("aliases")))
    return F.coalesce(F.filter(made, lambda e: e["name"] != ""),
        F.from_json(F.lit("[]"), "array<struct<name:string,entity_type:string,confidence:double,aliases:array<string>>>"))


def clean_relations(c: Column) -> Column:
    """Relations with all three parts; the relation name is trimmed only."""
    made = F.transform(c, lambda r: F.struct(strip_space(r["source"]).alias("source"), strip_space(r["relation"]).alias("relation"),
        strip_space(r["target"]).alias("target"), confidence(r["confidence"]).alias("confidence")))
    return F.coalesce(F.filter(made, lambda r: (r["source"] != "") & (r["relation"] != "") & (r["target"] != "")),
        F.from_json(F.lit("[]"), "array<struct<source:string,relation:string,target:string,confidence:double>>"))


def parse_enriched(raw: DataFrame, default_source: str) -> DataFrame:
    """The enriched record's fields by their rules, from columns that hold them untyped or typed."""
    def c(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast(kind)

    none = F.array().cast("array<string>")
    text = F.coalesce(c("content"), F.lit(""))
    return raw.select(
        *(["seq"] if "seq" in raw.columns else []), c("id").alias("id"), F.coalesce(first_non_blank(c("title")), c("id")).alias("title"),
            text.alias("content"),
        F.coalesce(first_non_blank(c("source")), F.lit(default_source)).alias("source"),
            F.coalesce(c("metadata"), F.lit("{}")).alias("metadata"),
        F.coalesce(first_non_blank(c("summary")), F.substring(text, 1, 500)).alias("summary"),
            F.coalesce(c("tags", "array<string>"), none).alias("tags"),
                F.coalesce(c("related_ids", "array<string>"), none).alias("related_ids"),
        confidence(c("importance"), 0.5).alias("importance"),
            F.coalesce(first_non_blank(c("document_type")), F.lit("note")).alias("document_type"),
                F.coalesce(c("translation_ko"), F.lit("")).alias("translation_ko"),
        clean_entities(c("entities", ENTITY).cast(ENTITY)).alias("entities"),
            clean_relations(c("relations", RELATION).cast(RELATION)).alias("relations"))


def read_enriched(spark: SparkSession, path: str, default_source: str = "enriched") -> DataFrame:
    """Enriched documents; a repeated id is no error (later rows overwrite). Fields of the wrong shape count as missing."""
    kind = f"id string, title string, content string, source string, summary string, translation_ko string, document_type string, importance string, tags array<string>, related_ids array<string>, entities {ENTITY}, relations {RELATION}"
    rows = _lines(spark, path)
    _fail_if(rows.where(F.try_parse_json("value").isNull() | (F.substring(F.trim("value"), 1, 1) != "{")), "not a JSON object", path=path)
    j = rows.select("seq", F.get_json_object("value", "$.metadata").alias("metadata"), F.from_json("value", kind).alias("j")).select("seq",
        "metadata", "j.*")
    _fail_if(j.where(first_non_blank(F.col("id")).isNull() | first_non_blank(F.col("content")).isNull()), "id or content missing",
        path=path)
    return parse_enriched(j, default_source)


def _levels(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.array().cast("array<string>")
    c = F.col(name)
    if dict(df.dtypes)[name].startswith("array"):
        parts = c.cast("array<string>")
    else:
        text = c.cast("string")
        parts = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, r"[|]"))
    return F.coalesce(F.filter(F.transform(parts, lambda x: strip_space(x)), lambda x: x != ""), F.array().cast("array<string>"))


def parse_vocabulary(raw: DataFrame, default_source: str = "vocabulary") -> DataFrame:
    """Column synonyms resolved, one level or book promoted to a list, id defaulting to the word."""
    def pick(name: str) -> Column:
        have = [F.col(f"`{s}`").cast("string") for s in SYNONYMS[name] if s in raw.columns]
        return first_non_blank(*have) if have else F.lit(None).cast("string")

    word = pick("word")
    out = raw.select(
        *(["seq"] if "seq" in raw.columns else []), F.coalesce(pick("id"), word).alias("id"), word.alias("word"),
            *[F.coalesce(pick(c), F.lit("")).alias(c) for c in ("traditional", "pinyin", "pos", "meaning_ko")],
        _levels(raw, "hsk_levels").alias("hsk_levels"), _levels(raw, "wordbooks").alias("wordbooks"),
            F.coalesce(first_non_blank(F.col("source")) if "source" in raw.columns else F.lit(None), F.lit(default_source)).alias("source"),
        F.coalesce(F.col("metadata").cast("string") if "metadata" in raw.columns else F.lit(None),
            F.lit("{}")).alias("metadata"))
    _fail_if(out.where("word is null"), "word missing", "seq" if "seq" in out.columns else "id")
    return out


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary CSV (byte order mark tolerated) or, by any other suffix, JSON lines."""
    if str(path).lower().endswith(".csv"):
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
        raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
        return parse_vocabulary(raw.withColumn("seq", F.monotonically_increasing_id()))
    names = sorted({s for v in SYNONYMS.values() for s in v} | {"source"})
    rows = _lines(spark, path)
    _fail_if(rows.where(F.try_parse_json("value").isNull() | (F.substring(F.trim("value"), 1, 1) != "{")), "not a JSON object", path=path)
    j = rows.select("seq", F.from_json("value", ", ".join(f"`{n}` string" for n in names)).alias("j"),
        *[F.get_json_object("value", f"$.{n}").alias(n) for n in ("hsk_levels", "wordbooks", "metadata")])
    return parse_vocabulary(j.select("seq", "hsk_levels", "wordbooks", "metadata", "j.*"))


TRACK = "array<struct<track_id:string,title:string,artists:string,album:string,release_date:string,spotify_url:string,audio_features:string,enrichment:string,analysis:string,editorial:string>>"


def parse_tracks(tracks: DataFrame, source: str) -> DataFrame:
    """Tracks as enriched records: artists (comma list) are people, the album and the title their own entities; an
    artist performed the title, the title is part of the album; the left-over fields stay in metadata."""
    artists = F.filter(F.transform(F.split(F.coalesce("artists", F.lit("")), ","), lambda a: strip_space(a)), lambda a: a != "")
    album, title = F.coalesce(strip_space(F.col("album")), F.lit("")), strip_space(F.col("title"))
    none = F.array().cast("array<string>")

    def ent(n: Column, kind: str) -> Column:
        return F.struct(n.alias("name"), F.lit(kind).alias("entity_type"), F.lit(1.0).alias("confidence"), none.alias("aliases"))

    def rel(a: Column, r: str, b: Column) -> Column:
        return F.struct(a.alias("source"), F.lit(r).alias("relation"), b.alias("target"), F.lit(1.0).alias("confidence"))

    t = tracks.withColumn("artists_", artists).withColumn("album_", album).withColumn("title_", title)
    a, al, ti = F.col("artists_"), F.col("album_"), F.col("title_")
    ents = F.concat(F.transform(a, lambda x: ent(x, "People")), F.array(ent(ti, "MusicTracks")),
        F.when(al != "", F.array(ent(al, "MusicAlbums"))).otherwise(F.slice(F.array(ent(al, "MusicAlbums")), 1, 0)))
    rels = F.concat(F.transform(a, lambda x: rel(x, "performed", ti)),
        F.when(al != "", F.array(rel(ti, "part_of", al))).otherwise(F.slice(F.array(rel(ti, "part_of", al)), 1, 0)))
    extra = F.struct(*[F.col(c) for c in ("release_date", "spotify_url", "audio_features", "enrichment", "analysis",
        "editorial") if c in tracks.columns])
    return t.select(
        *(["seq"] if "seq" in tracks.columns else []), F.col("track_id").alias("id"), ti.alias("title"),
            F.concat_ws("\n", ti, F.when(F.size(a) > 0, F.array_join(a, ", ")), F.when(al != "", al)).alias("content"),
        F.lit(source).alias("source"), F.to_json(F.struct(F.col("track_id").alias("source_id"), extra.alias("music"))).alias("metadata"),
            F.concat_ws(" - ", F.array_join(a, ", "), ti).alias("summary"),
        none.alias("tags"), none.alias("related_ids"), F.lit(0.5).alias("importance"), F.lit("track").alias("document_type"),
            F.lit("").alias("translation_ko"), ents.alias("entities"), rels.alias("relations"))


def read_tracks(spark: SparkSession, path: str, source: str = "music") -> DataFrame:
    """A JSON object with a list ``tracks``, or the bare list."""
    raw = spark.read.text(path, wholetext=True)
    both = F.coalesce(F.get_json_object("value", "$.tracks"), F.col("value"))
    rows = raw.select(F.posexplode(F.from_json(both, TRACK)).alias("seq", "t")).select(F.col("seq").cast("long").alias("seq"), "t.*")
    _fail_if(rows.where(first_non_blank(F.col("track_id")).isNull() | first_non_blank(F.col("title")).isNull()),
        "track_id or title missing")
    return parse_tracks(rows, source)


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), text, hash, size of every Markdown note below ``root``; hidden parts and links are left out."""
    base = Path(root).resolve()
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(base.as_uri())
    full = F.url_decode(F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), r"\+", "%2B"))
    rel = F.expr(f"substr(full, {len(str(base)) + 2})")
    links = [str(p.relative_to(base)) for p in base.rglob("*") if p.is_symlink()] if base.exists() else []
    out = raw.select(full.alias("full"), "content", "length").select(rel.alias("path"),
        F.decode(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content")).otherwise(F.lit(b"")), "UTF-8").alias("text"),
            F.sha2("content", 256).alias("hash"), F.col("length").alias("size"),
                F.is_valid_utf8(F.col("content").cast("string")).alias("readable"))
    out = out.where(~F.col("path").rlike(r"(^|/)\."))
    for p in links:
        out = out.where((F.col("path") != p) & ~F.col("path").startswith(p + "/"))
    return out


def snapshot(vault: DataFrame) -> DataFrame:
    return vault.select("path", "hash", "size")


class Adapter(Protocol):
    """What brings records in: a frame of generic documents, enriched records or words."""

    def load(self, spark: SparkSession) -> DataFrame: ...


@dataclass(frozen=True)
class DocumentFile:
    path: str

    def load(self, spark: SparkSession) -> DataFrame:
        return read_documents(spark, self.path)


@dataclass(frozen=True)
class EnrichedFile:
    path: str
    source: str = "enriched"

    def load(self, spark: SparkSession) -> DataFrame:
        return read_enriched(spark, self.path, self.source)


@dataclass(frozen=True)
class VocabularyFile:
    path: str

    def load(self, spark: SparkSession) -> DataFrame:
        return read_vocabulary(spark, self.path)


@dataclass(frozen=True)
class TrackFile:
    path: str
    source: str = "music"

    def load(self, spark: SparkSession) -> DataFrame:
        return read_tracks(spark, self.path, self.source)


#: The adapter of each kind of input.
ADAPTERS: dict[str, type] = {"jsonl": DocumentFile, "enriched": EnrichedFile, "vocabulary": VocabularyFile, "music": TrackFile}
