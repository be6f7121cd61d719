"""Vocabulary forms and their links to texts and entities."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, norm_alias
from .upsert import first_wins, last_wins, replace_groups

CJK = "[\\x{4e00}-\\x{9fff}]"


def vocabulary_forms(vocabularies: DataFrame, least: bool = True) -> DataFrame:
    """vocabulary_id, form: folded word and traditional form; with ``least`` at least two characters if any is Han, else three."""
    forms = vocabularies.select(F.col("id").alias("vocabulary_id"),
        F.explode(F.array_distinct(F.array_compact(F.array(norm_alias(F.col("word")), norm_alias(F.col("traditional")))))).alias(
            "form")).where("form <> ''")
    if least:
        forms = forms.where(F.length("form") >= F.when(F.col("form").rlike(CJK), 2).otherwise(3))
    return forms.distinct()


def _automaton(words: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a


def form_counts(texts: DataFrame, forms: DataFrame, key: str, chunk: int = 200_000) -> DataFrame:
    """key, form, matches: overlapping occurrences of each form in the column ``t``.

    One linear scan of each text with a multi-pattern automaton. The forms are dealt by hash into chunks of about
    ``chunk``, so what is sent to the executors has a fixed size; a larger vocabulary takes more scans, not more memory."""
    distinct = forms.select("form").distinct()
    n = distinct.count()
    parts = max(1, -(-n // chunk))
    out = texts.select(key, F.lit("").alias("form"), F.lit(0).cast("long").alias("matches")).where("false")
    kind = texts.schema[key].dataType.simpleString()
    for i in range(parts if n else 0):
        mine = distinct if parts == 1 else distinct.where(F.pmod(F.xxhash64("form"), F.lit(parts)) == i)
        sent = texts.sparkSession.sparkContext.broadcast([r.form for r in mine.collect()])

        def scan(batches, sent=sent):
            a = _automaton(sent.value)
            for b in batches:
                rows = []
                for k, t in zip(b[key], b["t"]):
                    rows += [(k, w, c) for w, c in Counter(w for _, w in a.iter(t)).items()]
                yield pd.DataFrame(rows, columns=[key, "form", "matches"])

        out = out.unionByName(texts.select(key, "t").mapInPandas(scan, f"`{key}` {kind}, form string, matches long"))
    return out


def match_counts(documents: DataFrame, vocabularies: DataFrame, text: str = "text", key: str = "doc_id", least: bool = True) -> DataFrame:
    """key, vocabulary_id, matches: overlapping occurrences of a word's forms in the folded text."""
    forms = vocabulary_forms(vocabularies, least)
    texts = documents.select(key, norm_alias(F.col(text)).alias("t")).where("t <> ''")
    return form_counts(texts, forms, key).join(forms, "form").groupBy(key, "vocabulary_id").agg(F.sum("matches").alias("matches"))


def match_confidence(n):
    return F.least(F.lit(1.0), F.round(0.8 + F.least(n, F.lit(4)) * 0.05, 6))


def link_documents(documents: DataFrame, vocabularies: DataFrame, explicit: DataFrame, old: DataFrame,
    aliases: DataFrame | None = None) -> DataFrame:
    """document_vocabulary_links after relinking all documents with content: explicit ids (through vocabulary aliases
    if given) with confidence 1, matched ones by count; documents without content keep their links."""
    filled = documents.where(F.coalesce(F.col("content"), F.lit("")) != "")
    named = explicit.select("document_id", norm_alias(F.col("vocabulary_id")).alias("alias"), "vocabulary_id")
    if aliases is not None:
        named = named.join(aliases, "alias").select("document_id", F.col("canonical_id").alias("vocabulary_id"))
    named = named.select("document_id", "vocabulary_id").distinct().join(filled.select(F.col("id").alias("document_id")), "document_id",
        "left_semi")
    found = match_counts(filled, vocabularies, "content", "id").withColumnRenamed("id", "document_id").join(named,
        ["document_id", "vocabulary_id"], "left_anti")
    rows = named.select("document_id", "vocabulary_id", F.lit("explicit").alias("match_type"), F.lit(1.0).alias("confidence")).unionByName(
        found.select("document_id", "vocabulary_id", F.lit("exact").alias("match_type"),
            match_confidence(F.col("matches")).alias("confidence")))
    keep = old.join(filled.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    return keep.unionByName(rows.select(*old.columns))


def contains_links(documents: DataFrame, vocabularies: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The plain linker: any form of any length within the folded text, confidence 1."""
    return match_counts(documents, vocabularies, text, key, least=False).select(key, "vocabulary_id", F.lit("exact").alias("match_type"),
        F.lit(1.0).alias("confidence"))


def link_entities(entities: DataFrame, vocabularies: DataFrame, folded: bool = False) -> DataFrame:
    """entity_name, entity_type, vocabulary_id, match_type, confidence: names equal to a word or traditional form,
    as two equi-joins; case-sensitive, or folded on both sides."""
    name = norm_alias(F.col("name")) if folded else F.col("name")
    e = entities.select("name", "entity_type", name.alias("k")).distinct()
    side = [vocabularies.select(F.col("id").alias("vocabulary_id"),
        (norm_alias(F.col(c)) if folded else F.col(c)).alias("k")).where("k <> ''") for c in ("word", "traditional")]
    return e.join(side[0].unionByName(side[1]).distinct(), "k").select(F.col("name").alias("entity_name"), "entity_type", "vocabulary_id",
        F.lit("exact").alias("match_type"), F.lit(1.0).alias("confidence")).distinct()


def explicit_entity_links(explicit: DataFrame, aliases: DataFrame) -> DataFrame:
    """explicit: vocabulary_id, entity. Named entities through the alias table."""
    e = explicit.select("vocabulary_id", norm_alias(F.col("entity")).alias("alias")).where("alias <> ''").distinct()
    return e.join(aliases, "alias").select(F.col("canonical_name").alias("entity_name"), "entity_type", "vocabulary_id",
        F.lit("explicit").alias("match_type"), F.lit(1.0).alias("confidence")).distinct()


def vocabulary_aliases(vocabularies: DataFrame, old: DataFrame, seq: str = "seq") -> DataFrame:
    """Folded id, word and traditional form, each claimed by the first vocabulary that has it."""
    rows = vocabularies.select(F.col(seq).alias("s"), F.col("id").alias("canonical_id"),
        F.posexplode(F.array("id", "word", "traditional")).alias("p", "a"))
    rows = rows.select(norm_alias(blank_to_null(F.col("a"))).alias("alias"), "canonical_id",
        F.struct("s", "p").alias("seq")).where("alias is not null")
    return first_wins(old, rows, ["alias"])


def resolve_vocabulary(values: DataFrame, aliases: DataFrame, column: str = "value") -> DataFrame:
    return values.withColumn("alias", norm_alias(F.col(column))).join(aliases, "alias", "left").drop("alias")


def replace_entity_links(old: DataFrame, batch: DataFrame) -> DataFrame:
    return replace_groups(old, batch, ["vocabulary_id"])


# --- reading the links --------------------------------------------------------------------------------------------


def words_of_documents(links: DataFrame) -> DataFrame:
    """All document links, by document and word."""
    return links.select("document_id", "vocabulary_id", "match_type", "confidence").orderBy("document_id", "vocabulary_id")


def documents_of(values: DataFrame, links: DataFrame, aliases: DataFrame) -> DataFrame:
    """value, document_id, match_type, confidence: the documents of words named by id, word or traditional form; a value
    that is no alias counts as an id."""
    named = resolve_vocabulary(values.select("value").distinct(), aliases)
    named = named.select("value", F.coalesce("canonical_id", "value").alias("vocabulary_id"))
    return named.join(links, "vocabulary_id").select("value", "document_id", "match_type", "confidence").orderBy("value", "document_id")


def entities_of(values: DataFrame, links: DataFrame) -> DataFrame:
    """The entity links of words, the surest first."""
    found = values.select(F.col("value").alias("vocabulary_id")).distinct().join(links, "vocabulary_id")
    return found.select("vocabulary_id", "entity_name", "entity_type", "match_type", "confidence").orderBy("vocabulary_id",
        F.desc("confidence"), "entity_name")


def add_document_words(old: DataFrame, batch: DataFrame, aliases: DataFrame, seq: str = "seq") -> DataFrame:
    """document_vocabulary_links with words added by hand (document_id, value, match_type, confidence, seq)."""
    rows = resolve_vocabulary(batch, aliases).withColumn("vocabulary_id", F.coalesce("canonical_id", "value"))
    return last_wins(old, rows, ["document_id", "vocabulary_id"], seq)
