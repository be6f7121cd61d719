"""Enrichment of documents by an outside model, and evidence for relations: both through callables that the caller
gives, so that nothing here reaches a network by itself."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import entity_type, relation_type
from ..functions.text import confidence, strip_space

# What goes into the key of a stored answer, and how much of a text is sent.
PAYLOAD_VERSION, SENT_CHARACTERS, ATTEMPTS = "v5", 20_000, 3

ENTITIES = "array<struct<name:string,entity_type:string,confidence:double,aliases:array<string>>>"
RELATIONS = "array<struct<source:string,relation:string,target:string,confidence:double>>"


def cache_key(model: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(PAYLOAD_VERSION), "title", "content"), 256)


def unfenced(text: str) -> str:
    """The answer without a code fence around it."""
    text = text.strip()
    return text.split("```")[1].removeprefix("json").strip() if text.startswith("```") else text


def ask(documents: DataFrame, provider: Callable[[str, str], object], model: str, wait: float = 1.0) -> DataFrame:
    """id, cache_key, payload, error for each document (id, title, content): the provider's answer as JSON text, asked
    on the executors with the first characters of the text, up to three times with growing pauses. An answer of none
    gives null and no error; a failing document never fails the others."""

    def one(title: str, content: str) -> tuple[str | None, str | None]:
        for k in range(ATTEMPTS):
            try:
                got = provider(title or "", (content or "")[:SENT_CHARACTERS])
                if got is None:
                    return None, None
                return (json.dumps(json.loads(unfenced(got)) if isinstance(got, str) else got, ensure_ascii=False)), None
            except (OSError, TimeoutError) as x:
                if k == ATTEMPTS - 1:
                    return None, f"{type(x).__name__}: {x}"
                time.sleep(wait * 2**k)
            except Exception as x:  # noqa: BLE001 - an answer that is no JSON concerns its document only
                return None, f"{type(x).__name__}: {x}"
        return None, None

    def run(batches):
        for b in batches:
            got = [one(t, c) for t, c in zip(b.title, b.content)]
            yield pd.DataFrame({"id": b.id, "cache_key": b.cache_key, "payload": [p for p, _ in got], "error": [e for _, e in got]})

    keyed = documents.select("id", "title", "content", cache_key(model).alias("cache_key"))
    return keyed.mapInPandas(run, "id string, cache_key string, payload string, error string")


def answers(documents: DataFrame, cache: DataFrame, provider: Callable[[str, str], object], model: str, wait: float = 1.0) -> DataFrame:
    """id, cache_key, payload, error, cached: stored answers where there are any, else the provider's. Documents with
    equal title and text are asked once."""
    keyed = documents.withColumn("cache_key", cache_key(model))
    known = cache.select("cache_key", F.col("payload").alias("stored"))
    held = keyed.select("id", "cache_key").join(known, "cache_key", "left")
    new = keyed.join(known, "cache_key", "left_anti").groupBy("cache_key").agg(F.min(F.struct("id", "title", "content")).alias("x"))
    asked = ask(new.select("x.*"), provider, model, wait).select("cache_key", "payload", "error")
    both = held.join(asked, "cache_key", "left")
    return both.select("id", "cache_key", F.coalesce("stored", "payload").alias("payload"), "error",
        F.col("stored").isNotNull().alias("cached"))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    """The trimmed string, null for anything that is no string."""
    return F.when(_kind(v) == "STRING", strip_space(F.try_variant_get(v, "$", "string")))


def _get(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "variant")


def _list(v: Column) -> Column:
    got = F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    return F.coalesce(got, F.array().cast("array<variant>"))


def _words(v: Column) -> Column:
    return F.filter(F.transform(_list(v), lambda x: strip_space(F.try_variant_get(x, "$", "string"))), lambda x: x != "")


def _number(v: Column, default: float) -> Column:
    return confidence(F.try_variant_get(v, "$", "double"), default, finite_only=True)


def parse_payload(documents: DataFrame, column: str = "payload") -> DataFrame:
    """Documents with an answer as enriched records, by strict rules: only strings are text, what is no object or list
    is left out, confidences that are no finite number take their default, relation names are normalized. ``valid`` is
    false where the answer is no object; such rows carry empty lists."""
    d = documents.withColumn("__v", F.try_parse_json(column))
    v = F.col("__v")
    valid = F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))
    objects = lambda name: F.filter(_list(_get(v, name)), lambda e: _kind(e).startswith("OBJECT"))
    ents = F.transform(objects("entities"), lambda e: F.struct(
        _text(_get(e, "name")).alias("name"), entity_type(F.try_variant_get(_get(e, "entity_type"), "$", "string")).alias("entity_type"),
        _number(_get(e, "confidence"), 1.0).alias("confidence"), _words(_get(e, "aliases")).alias("aliases")))
    rels = F.transform(objects("relations"), lambda r: F.struct(
        _text(_get(r, "source")).alias("source"), relation_type(F.try_variant_get(_get(r, "relation"), "$", "string")).alias("relation"),
        _text(_get(r, "target")).alias("target"), _number(_get(r, "confidence"), 1.0).alias("confidence")))
    tags = _words(_get(v, "tags"))
    keep = [c for c in documents.columns if c != column]
    return d.select(
        *keep, valid.alias("valid"), F.coalesce(_text(_get(v, "summary")), F.substring("content", 1, 500)).alias("summary"),
        F.when(F.size(tags) > 0, tags).otherwise(F.array(F.concat(F.lit("source/"), F.coalesce("source", F.lit("unknown"))))).alias("tags"),
            _words(_get(v, "related_ids")).alias("related_ids"),
        _number(_get(v, "importance"), 0.5).alias("importance"),
            F.coalesce(_text(_get(v, "document_type")), F.lit("note")).alias("document_type"),
        F.coalesce(_text(_get(v, "translation_ko")), F.lit("")).alias("translation_ko"),
            F.filter(ents, lambda e: e["name"] != "").cast(ENTITIES).alias("entities"),
        F.filter(rels, lambda r: (r["source"] != "") & (r["relation"] != "") & (r["target"] != "")).cast(RELATIONS).alias(
            "relations"))


def fetch_evidence(ids: DataFrame, client: Callable[[str], dict | None], source: str) -> DataFrame:
    """evidence rows for the document ids that ``client`` knows: it takes an id and gives id, title, content and url,
    as far as there are any, or none."""

    def run(batches):
        for b in batches:
            rows = []
            for i in b.document_id:
                got = client(i)
                if got:
                    rows.append((str(got.get("id") or i), source, str(got.get("title") or i), str(got.get("content") or ""),
                        str(got.get("url") or "")))
            yield pd.DataFrame(rows, columns=["document_id", "source", "title", "content", "url"])

    found = ids.select("document_id").distinct().mapInPandas(run,
        "document_id string, source string, title string, content string, url string")
    return found.withColumn("checked_at", F.current_timestamp())
