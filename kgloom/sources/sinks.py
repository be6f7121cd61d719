"""Sinks: Markdown notes and indexes as text columns, graph and manifest files, reports."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_filename, yaml_scalar


def write_atomic(path: str | Path, text: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(f".{path.name}.tmp")
    tmp.write_text(text, encoding="utf-8")
    os.replace(tmp, path)


def write_report(path: str | Path, report: dict) -> None:
    write_atomic(path, json.dumps(report, ensure_ascii=False, indent=2, default=str) + "\n")


def _front(**fields: Column) -> Column:
    return F.concat(F.lit("---\n"), *[x for k, v in fields.items() for x in (F.lit(f"{k}: "), v, F.lit("\n"))], F.lit("---\n"))


def _list(title: str, items: Column) -> Column:
    """A section with one bullet an item; empty lists leave no section."""
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n## {title}\n\n"),
        F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))).otherwise(F.lit(""))


def distinct_paths(notes: DataFrame) -> DataFrame:
    """path, text: file names from ``dir`` and ``name``; names that meet after sanitizing take a short hash of the name."""
    n = notes.withColumn("file", safe_filename(F.col("name")))
    meet = n.groupBy("dir", F.lower("file").alias("low")).agg(F.countDistinct("name").alias("k"))
    n = n.withColumn("low", F.lower("file")).join(meet, ["dir", "low"])
    file = F.when(F.col("k") > 1, F.concat("file", F.lit(" "), F.substring(F.sha2("name", 256), 1, 8))).otherwise(F.col("file"))
    return n.select(F.concat("dir", F.lit("/"), file, F.lit(".md")).alias("path"), "text")


def write_notes(notes: DataFrame, root: str) -> None:
    """Writes path/text rows below ``root`` (a shared folder), each file atomically, from the executors."""
    def save(rows) -> None:
        for r in rows:
            p = Path(root) / r.path
            p.parent.mkdir(parents=True, exist_ok=True)
            tmp = p.with_name(f".{p.name}.tmp")
            tmp.write_text(r.text, encoding="utf-8")
            os.replace(tmp, p)

    notes.select("path", "text").foreachPartition(save)


def document_notes(documents: DataFrame, vocabulary_lines: DataFrame | None = None) -> DataFrame:
    """dir, name, text of each enriched document: front matter, summary, translation, entities, relations, vocabulary."""
    d = documents
    if vocabulary_lines is not None:
        d = d.join(vocabulary_lines, "id", "left")
    words = F.coalesce("words", F.array().cast("array<string>")) if vocabulary_lines is not None else F.array().cast("array<string>")
    ents = F.transform("entities", lambda e: F.concat(F.lit("[["), e["name"], F.lit("]] ("), e["entity_type"], F.lit(")")))
    rels = F.transform("relations", lambda r: F.concat(F.lit("[["), r["source"], F.lit("]] "), r["relation"], F.lit(" [["), r["target"],
        F.lit("]]")))
    text = F.concat(
        _front(id=yaml_scalar(F.col("id")), title=yaml_scalar(F.col("title")), source=yaml_scalar(F.col("source")),
            type=yaml_scalar(F.col("document_type"))),
        F.lit("\n# "), F.col("title"), F.lit("\n\n"), F.col("summary"), F.lit("\n"),
        F.when(F.col("translation_ko") != "", F.concat(F.lit("\n"), F.col("translation_ko"), F.lit("\n"))).otherwise(F.lit("")),
            _list("Entities", ents), _list("Relations", rels), _list("Vocabulary", words))
    return d.select(F.lit("documents").alias("dir"), F.col("id").alias("name"), text.alias("text"))


def vocabulary_lines(links: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """id, words: the sorted vocabulary of each document."""
    v = vocabularies.select(F.col("id").alias("vocabulary_id"), "word")
    return links.join(v, "vocabulary_id").groupBy(F.col("document_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.concat("word", F.lit(" ("), "match_type", F.lit(")")))).alias("words"))


def record_entity_notes(records: DataFrame) -> DataFrame:
    """dir, name, text of the entities of enriched records, as soon as they arrive: the last statement of each stays."""
    e = records.select("seq", F.posexplode("entities").alias("pos", "e")).groupBy(F.col("e.name").alias("name"),
        F.col("e.entity_type").alias("entity_type"))
    e = e.agg(F.max_by("e", F.struct("seq", "pos")).alias("e"))
    alias = F.coalesce("e.aliases", F.array().cast("array<string>"))
    text = F.concat(_front(name=yaml_scalar(F.col("name")), type=yaml_scalar(F.col("entity_type")), confidence=_conf("e.confidence")),
        F.lit("\n# "), F.col("name"), F.lit("\n"), _list("Aliases", alias))
    return e.select(F.concat(F.lit("entities/"), "entity_type").alias("dir"), "name", text.alias("text"))


def entity_notes(entities: DataFrame, entity_sources: DataFrame, document_entities: DataFrame, relations: DataFrame,
    derived: DataFrame) -> DataFrame:
    """dir, name, text per entity: aliases, sources, documents, relations and derived relations, pre-aggregated by key."""
    k = ["name", "entity_type"]
    src = entity_sources.groupBy(F.col("entity_name").alias("name"), "entity_type").agg(F.array_sort(F.collect_set("source")).alias("srcs"))
    docs = document_entities.groupBy(F.col("entity_name").alias("name"),
        "entity_type").agg(F.array_sort(F.collect_set("document_id")).alias("docs"))

    def lines(r: DataFrame, name: str) -> DataFrame:
        return r.groupBy(F.col("source_name").alias("name")).agg(
            F.array_sort(F.collect_set(F.concat("relation", F.lit(" [["), "target_name", F.lit("]]")))).alias(name))

    e = entities.join(src, k, "left").join(docs, k, "left").join(lines(relations, "rels"), "name", "left").join(lines(derived, "more"),
        "name", "left")
    none = F.array().cast("array<string>")
    text = F.concat(
        _front(name=yaml_scalar(F.col("name")), type=yaml_scalar(F.col("entity_type")),
            confidence=F.format_string("%.3f", F.coalesce("confidence", F.lit(0.0)))), F.lit("\n# "), F.col("name"), F.lit("\n"),
        _list("Aliases", F.coalesce("aliases", none)), _list("Sources", F.coalesce("srcs", none)),
            _list("Documents", F.coalesce("docs", none)), _list("Relations", F.coalesce("rels", none)),
                _list("Derived", F.coalesce("more", none)))
    return e.select(F.concat(F.lit("entities/"), F.coalesce("entity_type", F.lit("Concepts"))).alias("dir"), "name", text.alias("text"))


def vocabulary_notes(vocabularies: DataFrame, entity_links: DataFrame, document_links: DataFrame) -> DataFrame:
    ents = entity_links.groupBy(F.col("vocabulary_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("[["), "entity_name", F.lit("]]")))).alias("ents"))
    docs = document_links.groupBy(F.col("vocabulary_id").alias("id")).agg(F.array_sort(F.collect_set("document_id")).alias("docs"))
    none = F.array().cast("array<string>")
    v = vocabularies.join(ents, "id", "left").join(docs, "id", "left")
    level = F.coalesce(F.when(F.size("hsk_levels") > 0, F.array_join("hsk_levels", ", ")), F.lit("unclassified"))
    text = F.concat(_front(id=yaml_scalar(F.col("id")), word=yaml_scalar(F.col("word")), level=yaml_scalar(level)), F.lit("\n# "),
        F.col("word"), F.lit("\n\n"), F.concat_ws(" · ", "pinyin", "pos", "meaning_ko"), F.lit("\n"),
            _list("Entities", F.coalesce("ents", none)), _list("Documents", F.coalesce("docs", none)))
    return v.select(F.lit("vocabulary").alias("dir"), F.col("id").alias("name"), text.alias("text"))


# --- indexes ------------------------------------------------------------------------------------------------------
# An index is rows of (file, section, sort, line): lines of a section stand in the order of ``sort``. Each is one file
# by nature; it is written from the sorted rows, partition by partition.

NO_TEXT = "-"


def _conf(c: str = "confidence") -> Column:
    return F.format_string("%.3f", F.coalesce(c, F.lit(0.0)))


def _rows(df: DataFrame, file: Column, section: Column, sort: list[str], line: Column) -> DataFrame:
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sort]
    return df.select(file.alias("file"), section.alias("section"), F.array(*keys).alias("sort"), line.alias("line"))


def entity_index(entities: DataFrame) -> DataFrame:
    """All entities by type and name."""
    line = F.concat(F.lit("- [["), "name", F.lit("]] — confidence: "), _conf())
    return _rows(entities, F.lit("entities/_Entity Index.md"), F.coalesce("entity_type", F.lit("")), ["name"], line)


def domain_index(entities: DataFrame, types: tuple[str, ...] = ("MusicTracks", "MusicAlbums")) -> DataFrame:
    """One index per given type."""
    line = F.concat(F.lit("- [["), "name", F.lit("]] — confidence: "), _conf())
    some = entities.where(F.col("entity_type").isin(list(types)))
    return _rows(some, F.concat(F.lit("entities/"), "entity_type", F.lit("/_Index.md")), F.lit(""), ["name"], line)


def _filled(c: str, default: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.col(c)).otherwise(default)


def vocabulary_index(vocabularies: DataFrame) -> DataFrame:
    levels = F.filter(F.coalesce("hsk_levels", F.array().cast("array<string>")), lambda x: x != "")
    level = F.when(F.size(levels) > 0, F.array_join(levels, ", ")).otherwise(F.lit("unclassified"))
    line = F.concat(F.lit("- [["), "word", F.lit("]] — "), _filled("pinyin", F.lit(NO_TEXT)), F.lit(" — "), level)
    return _rows(vocabularies, F.lit("vocabulary/_Vocabulary Index.md"), F.lit(""), ["word", "id"], line)


def level_index(vocabularies: DataFrame) -> DataFrame:
    """One index per bucket of levels."""
    line = F.concat(F.lit("- [["), "word", F.lit("]] — "), _filled("pinyin", F.lit(NO_TEXT)))
    out = None
    for label, wanted in LEVELS.items():
        some = _rows(vocabularies.where(level_bucket(F.col("hsk_levels"), wanted)), F.lit(f"vocabulary/{label}/_Index.md"), F.lit(""),
            ["word", "id"], line)
        out = some if out is None else out.unionByName(some)
    return out


#: Sections of the cross-domain index, in order.
CROSS_SECTIONS = ["Entity Graph", "Entities and Vocabulary", "Entities, Vocabulary and Music", "By Source Pair", "Canonical Entity Bridges"]


def cross_domain_index(derived: DataFrame, cross: DataFrame, vocabularies: DataFrame, bridges: DataFrame) -> DataFrame:
    """Derived relations, entity to word, word to track and album, source pairs with the number of their entities, and
    every bridge with the number of documents on either side."""
    file = F.lit("_Cross-Domain Connections.md")
    at = [F.lit(s) for s in CROSS_SECTIONS]
    tail = F.concat(F.lit(" — "), _conf(), F.lit(" — `"), "rule", F.lit("`"))
    d = _rows(derived, file, at[0], ["source_name", "target_name", "relation"],
        F.concat(F.lit("- [["), "source_name", F.lit("]] — **"), "relation", F.lit("** → [["), "target_name", F.lit("]]"), tail))
    v = vocabularies.select(F.col("id").alias("vid"), "word")
    e = cross.where("right_kind = 'vocabulary' and left_type <> 'Vocabulary'").join(v, F.col("right_id") == F.col("vid"))
    e = _rows(e, file, at[1], ["left_name", "word"], F.concat(F.lit("- [["), "left_name", F.lit("]] ("), "left_type", F.lit(") ↔ [["),
        "word", F.lit("]]"), tail))
    m = cross.where("left_type = 'Vocabulary' and right_kind in ('music_track', 'music_album')").join(v, F.col("left_name") == F.col("vid"),
        "left")
    kind = F.when(F.col("right_kind") == "music_track", "Track").otherwise("Album")
    m = _rows(m, file, at[2], ["right_kind", "right_id", "left_name"],
        F.concat(F.lit("- [["), F.coalesce("word", "left_name"), F.lit("]] ↔ [["), "right_id", F.lit("]] ("), kind, F.lit(")"), tail))
    pair = F.concat("source_a", F.lit(" ↔ "), "source_b")
    n = bridges.groupBy("source_a", "source_b").agg(F.count("*").alias("n"))
    n = _rows(n, file, at[3], ["source_a", "source_b"], F.concat(F.lit("- **"), pair, F.lit("** — "), F.col("n").cast("string"),
        F.lit(" canonical entities")))
    count = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    b = F.concat(F.lit("- [["), "entity_name", F.lit("]] ("), F.coalesce("entity_type", F.lit("")), F.lit(") — **"), pair, F.lit("**"),
        tail, F.lit(" — docs: "), count("documents_a"), F.lit("; "), count("documents_b"))
    b = _rows(bridges, file, at[4], ["source_a", "source_b", "entity_type", "entity_name"], b)
    return d.unionByName(e).unionByName(m).unionByName(n).unionByName(b)


def knowledge_index(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """kind, key, n: counts by entity type and by source, totals, and distinct sources."""
    def by(df: DataFrame, c: str, kind: str) -> DataFrame:
        return df.groupBy(F.coalesce(c, F.lit("")).alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")

    def total(df: DataFrame, key: str, n: Column) -> DataFrame:
        return df.agg(n.alias("n")).select(F.lit("total").alias("kind"), F.lit(key).alias("key"), "n")

    out = by(entities, "entity_type", "type").unionByName(by(documents, "source", "source"))
    every = F.count("*")
    return out.unionByName(total(entities, "entities", every)).unionByName(total(documents, "documents", every)).unionByName(
        total(documents, "sources", F.countDistinct("source")))


def knowledge_lines(counts: DataFrame, totals: dict[str, DataFrame]) -> DataFrame:
    """The knowledge index from ``knowledge_index`` and further tables whose rows are counted."""
    file = F.lit("_Knowledge Index.md")
    n = F.col("n").cast("string")
    types = _rows(counts.where("kind = 'type'"), file, F.lit("Entity Domains"), ["key"],
        F.concat(F.lit("- [[entities/"), "key", F.lit("/_Index]] — "), n, F.lit(" entities")))
    sources = _rows(counts.where("kind = 'source'"), file, F.lit("Sources"), ["key"],
        F.concat(F.lit("- **"), "key", F.lit("** — "), n, F.lit(" documents")))
    graph = counts.where("kind = 'total'").select("key", "n")
    for label, df in totals.items():
        graph = graph.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(label).alias("key"), "n"))
    return types.unionByName(sources).unionByName(_rows(graph, file, F.lit("Cross-Domain Graph"), ["key"],
        F.concat(F.lit("- "), F.initcap("key"), F.lit(": **"), n, F.lit("**"))))


#: Titles of index files that are not their own name.
TITLES = {"entities/MusicTracks/_Index.md": "Music Tracks", "entities/MusicAlbums/_Index.md": "Music Albums"}


def write_index(rows: DataFrame, root: str, sections: list[str] | None = None) -> list[str]:
    """Writes index rows below ``root``, each file atomically; rows come sorted, a partition at a time. Sections stand
    in the given order, else by name; an empty section name has no heading. The files written."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section")), F.lit(0)) if sections else F.lit(0)
    ordered = rows.withColumn("place", place).orderBy("file", "place", "section", "sort", "line")
    done: list[str] = []
    out = tmp = path = None
    section = None

    def close() -> None:
        if out is not None:
            out.close()
            os.replace(tmp, path)

    for r in ordered.select("file", "section", "line").toLocalIterator():
        if not done or done[-1] != r.file:
            close()
            path = Path(root) / r.file
            path.parent.mkdir(parents=True, exist_ok=True)
            tmp = path.with_name(f".{path.name}.tmp")
            out = tmp.open("w", encoding="utf-8")
            title = TITLES.get(r.file) or (path.stem.lstrip("_") if path.stem != "_Index" else f"{path.parent.name} Vocabulary")
            out.write(f'---\ntitle: "{title}"\ntype: "MOC"\n---\n\n# {title}\n\n')
            done.append(r.file)
            section = ""
        if r.section != section:
            section = r.section
            out.write(f"\n## {section}\n\n")
        out.write(r.line + "\n")
    close()
    return done


def level_bucket(levels: Column, wanted: list[str]) -> Column:
    """Whether a level list meets a bucket; an ``HSK`` prefix is taken off first."""
    plain = F.transform(levels, lambda x: F.regexp_replace(F.upper(F.trim(x)), "^HSK *", ""))
    return F.coalesce(F.arrays_overlap(plain, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


LEVELS = {"HSK6": ["6"], "HSK7-9": ["7", "8", "9", "7-9"]}


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, version: str) -> None:
    """One JSON document by nature; rows stream to it partition by partition, never all at once."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    tmp = p.with_name(f".{p.name}.tmp")
    with tmp.open("w", encoding="utf-8") as f:
        f.write(f'{{"schema_version": {json.dumps(version)}')
        for name, df in (("nodes", nodes.orderBy("id")), ("edges", edges.orderBy("source", "relation", "target"))):
            f.write(f', "{name}": [')
            for i, r in enumerate(df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
                f.write((",\n" if i else "\n") + r.j)
            f.write("]")
        f.write("}\n")
    os.replace(tmp, p)
