"""Stateful writes as pure functions (old table, batch) -> new table. Order is an explicit ``seq`` column of any type
that sorts (a number, or a struct such as file, block, line and position).

All policies are combinable aggregates, so a key with any number of rows is reduced before it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import migrated_type
from ..functions.text import casefold, norm_alias, strip_space
from ..schemas import EVIDENCE_STATUS, MERGE_REASONS, RESOLUTIONS
from ..session import discard, materialize_counted


def _pick(df: DataFrame, keys: list[str], order: list[Column], last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and not c.startswith("__")]
    best = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order)) if rest else F.count("*")
    out = df.groupBy(*keys).agg(best.alias("__x"))
    return out.select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])


def _with_order(old: DataFrame, batch: DataFrame, seq: str) -> DataFrame:
    """Both tables with ``__new`` (1 old, 2 batch) and the batch's order; rows of the old table have none."""
    kind = batch.schema[seq].dataType
    cols = old.columns
    return old.withColumn("__new", F.lit(1)).withColumn("__seq",
        F.lit(None).cast(kind)).unionByName(batch.select(*cols, F.lit(2).alias("__new"), F.col(seq).alias("__seq")))


def first_wins(old: DataFrame, batch: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Insert-or-ignore: a row of the old table, else the first of the batch, keeps its key."""
    cols = old.columns
    return _pick(_with_order(old, batch, seq), keys, [F.col("__new"), F.col("__seq"), *[F.col(c) for c in cols if c not in keys]],
        last=False).select(*cols)


def last_wins(old: DataFrame, batch: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Insert-or-replace: the last row of the batch, else the old one."""
    cols = old.columns
    return _pick(_with_order(old, batch, seq), keys, [F.col("__new"), F.col("__seq"), *[F.col(c) for c in cols if c not in keys]],
        last=True).select(*cols)


def replace_groups(old: DataFrame, batch: DataFrame, by: list[str]) -> DataFrame:
    """Delete-then-insert: groups that the batch names are replaced whole."""
    return old.join(batch.select(*by).distinct(), by, "left_anti").unionByName(batch.select(*old.columns))


def document_changes(old: DataFrame, batch: DataFrame, force: bool = False) -> DataFrame:
    """Batch rows with ``change``: new, changed or unchanged by content hash (``force``: never unchanged)."""
    known = old.select("id", F.col("content_hash").alias("__old"), F.lit(True).alias("__known"))
    c = F.when(F.col("__known").isNull(), "new").when(F.lit(force) | ~F.col("__old").eqNullSafe(F.col("content_hash")),
        "changed").otherwise("unchanged")
    return batch.join(known, "id", "left").withColumn("change", c).drop("__old", "__known")


def upsert_documents(old: DataFrame, batch: DataFrame, force: bool = False) -> DataFrame:
    """Unchanged documents stay as they are; others are replaced and pending again."""
    fresh = document_changes(old, batch, force).where("change <> 'unchanged'").withColumn("status", F.lit("pending"))
    return last_wins(old, fresh, ["id"])


def merge_entities(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Highest confidence and the sorted union of aliases without the own name."""
    both = old.unionByName(batch.select(*old.columns))
    rows = both.groupBy("name", "entity_type").agg(F.max("confidence").alias("confidence"))
    al = both.select("name", "entity_type", F.explode("aliases").alias("a")).select("name", "entity_type",
        strip_space(F.col("a")).alias("a")).where("a <> '' and a <> name").distinct()
    al = al.groupBy("name", "entity_type").agg(F.array_sort(
        F.collect_set(F.struct(norm_alias(F.col("a")).alias("n"), F.col("a").alias("a")))).alias("l"))
    out = rows.join(al, ["name", "entity_type"], "left")
    return out.select("name", "entity_type", F.coalesce(F.transform("l", lambda x: x.a), F.array().cast("array<string>")).alias("aliases"),
        "confidence")


def register_sources(old: DataFrame, batch: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The first owner keeps (source, source_id); its replays refresh metadata and last_seen_at. Others become
    conflict rows and change nothing. batch: document_id, source, source_id, metadata, seen_at, seq."""
    b = batch.select(F.lower(strip_space(F.col("source"))).alias("source"), strip_space(F.col("source_id")).alias("source_id"),
        "document_id", "metadata", F.col("seen_at").alias("s0"), F.col("seen_at").alias("s1"), F.col(seq).alias("__seq"),
            F.lit(2).alias("__new"))
    b = b.where("source <> '' and source_id <> '' and document_id is not null")
    o = old.select("source", "source_id", "document_id", "metadata", F.col("first_seen_at").alias("s0"), F.col("last_seen_at").alias("s1"),
        F.lit(None).cast(batch.schema[seq].dataType).alias("__seq"), F.lit(1).alias("__new"))
    both = o.unionByName(b)
    owner = both.groupBy("source", "source_id").agg(F.min_by("document_id", F.struct("__new", "__seq", "document_id")).alias("owner"))
    seen = both.join(owner, ["source", "source_id"])
    mine = seen.where("document_id = owner").groupBy("source", "source_id", "document_id").agg(
        F.max_by("metadata", F.struct("__new", "__seq", "metadata")).alias("metadata"), F.min("s0").alias("first_seen_at"),
            F.max("s1").alias("last_seen_at"))
    lost = seen.where("document_id <> owner").select(
        "document_id", F.lit("source_identity").alias("field"), F.col("source").alias("existing_source"),
            F.col("source").alias("incoming_source"),
        F.col("owner").alias("existing_value"), F.col("document_id").alias("incoming_value"), F.lit("review").alias("resolution"),
            F.col("s1").alias("created_at"))
    return mine.select(*old.columns), lost


def record_failures(old: DataFrame, batch: DataFrame, most: int = 5, seq: str = "seq") -> DataFrame:
    """Attempts counted up to ``most``, the last error cut at 4,000 characters. batch: document_id, error, at, seq."""
    n = batch.groupBy("document_id").agg(F.count("*").alias("__n"), F.max_by(F.substring("error", 1, 4000), F.col(seq)).alias("__e"),
        F.max("at").alias("__at"))
    j = old.join(n, "document_id", "full")
    return j.select(
        "document_id", F.least(F.coalesce("attempts", F.lit(0)) + F.coalesce("__n", F.lit(0)), F.lit(most)).cast("int").alias("attempts"),
        F.coalesce("__e", "last_error").alias("last_error"), "next_retry_at", F.coalesce("__at", "updated_at").alias("updated_at"))


def validated(rows: DataFrame, column: str, allowed: list[str], what: str) -> DataFrame:
    """The rows; one whose ``column`` is none of ``allowed`` stops the job that reads it."""
    ok = F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return rows.withColumn(column, F.when(ok, F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit(f"invalid {what}: "), F.coalesce(F.col(column), F.lit("null")))).cast("string")))


def record_conflicts(old: DataFrame, batch: DataFrame) -> DataFrame:
    """source_conflicts with new rows: document_id, field, existing_source, incoming_source, existing_value,
    incoming_value, resolution, created_at. The resolution must be a known one; the id is a hash of the row."""
    rows = validated(batch, "resolution", RESOLUTIONS, "source conflict resolution")
    rows = rows.withColumn("id", F.xxhash64("document_id", "field", "existing_source", "incoming_source", "existing_value",
        "incoming_value"))
    return old.unionByName(rows.select(*old.columns))


def set_aliases(old: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Aliases stated by hand: they replace what was claimed."""
    return last_wins(old, batch, ["alias", "entity_type"], seq)


def save_evidence(old: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    return last_wins(old, batch, ["document_id"], seq)


def link_evidence(old: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """relation_evidence with new links, of which the last one of a key stays; the status must be a known one."""
    keys = ["document_id", "source_name", "relation", "target_name", "evidence_document_id"]
    return last_wins(old, validated(batch, "status", EVIDENCE_STATUS, "evidence status"), keys, seq)


def cache_put(old: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    return last_wins(old, batch, ["cache_key"], seq)


def clear_failures(old: DataFrame, done: DataFrame) -> DataFrame:
    return old.join(done.select("document_id").distinct(), "document_id", "left_anti")


def retryable(failures: DataFrame, most: int = 5) -> DataFrame:
    return failures.where(F.col("attempts") < most).orderBy("updated_at", "document_id")


def orphan_entities(entities: DataFrame, document_entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities in no document and at no end of a relation."""
    linked = document_entities.select(F.col("entity_name").alias("name"), "entity_type").distinct()
    ends = relations.select(F.col("source_name").alias("name")).union(relations.select("target_name")).distinct()
    return entities.join(linked, ["name", "entity_type"], "left_anti").join(ends, "name", "left_anti")


def prune_orphans(entities: DataFrame, aliases: DataFrame, document_entities: DataFrame, relations: DataFrame) -> tuple[DataFrame,
    DataFrame]:
    gone = orphan_entities(entities, document_entities, relations).select("name", "entity_type")
    return entities.join(gone, ["name", "entity_type"], "left_anti"), aliases.join(gone.withColumnRenamed("name", "canonical_name"),
        ["canonical_name", "entity_type"], "left_anti")


def collect_relations(relations: DataFrame, document_relations: DataFrame) -> DataFrame:
    """Relations that some document still states."""
    k = ["source_name", "relation", "target_name"]
    return relations.join(document_relations.select(*k).distinct(), k, "left_semi")


def _fill(a: str, b: str) -> Column:
    return F.coalesce(F.when(strip_space(F.col(a)) != "", F.col(a)), F.col(b))


def merge_vocabulary(vocabularies: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping: duplicate_id, canonical_id. The canonical row keeps its filled fields, takes blanks, levels and books
    from its duplicates, and their metadata over its own; without a canonical row the duplicates are renamed.
    Duplicates rank by id."""
    m = mapping.where("duplicate_id <> canonical_id").select(F.col("duplicate_id").alias("id"), "canonical_id").distinct()
    rows = vocabularies.join(m, "id", "left").withColumn("__to", F.coalesce("canonical_id", "id")).withColumn("__rank",
        F.struct(F.col("canonical_id").isNotNull(), F.col("id")))
    plain = [c for c in vocabularies.columns if c not in ("id", "hsk_levels", "wordbooks", "metadata")]
    aggs = []
    for c in plain:
        filled = (strip_space(F.col(c)) != "") if dict(vocabularies.dtypes)[c] == "string" else F.col(c).isNotNull()
        aggs.append(F.min_by(F.when(filled, F.col(c)), F.when(filled, F.col("__rank"))).alias(c))
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in (
        "hsk_levels", "wordbooks") if c in vocabularies.columns]
    out = rows.groupBy("__to").agg(*aggs, *sets)
    if "metadata" in vocabularies.columns:
        out = out.join(_merged_metadata(rows), "__to", "left").withColumn("metadata", F.coalesce("metadata", F.lit("{}")))
    return out.withColumnRenamed("__to", "id").select(*vocabularies.columns)


def _merged_metadata(rows: DataFrame) -> DataFrame:
    """__to, metadata: the JSON objects of each group as one, later ranks over earlier ones key by key; values keep
    their JSON form. What is no object counts as empty."""
    keys = F.json_object_keys("metadata")
    each = rows.select("__to", "__rank", "metadata", F.explode(keys).alias("k"))
    value = F.to_json(F.from_json("metadata", "map<string,variant>")[F.col("k")])
    best = each.select("__to", "__rank", "k", value.alias("v")).groupBy("__to", "k").agg(F.max_by("v", "__rank").alias("v"))
    # to_json of one string in a list, without the brackets, is its quoted form
    item = F.concat(F.substring(F.to_json(F.array("k")), F.lit(2), F.length(F.to_json(F.array("k"))) - 2), F.lit(":"),
        F.coalesce("v", F.lit("null")))
    return best.groupBy("__to").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(item)), ","),
        F.lit("}")).alias("metadata"))


def rewire(links: DataFrame, mapping: DataFrame, column: str, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """``column`` rewritten by mapping (duplicate, canonical and the columns ``by``); rows that then share ``keys``
    keep the highest confidence, or one of them."""
    by = by or []
    m = mapping.select(F.col("duplicate").alias(column), *by, F.col("canonical").alias("__to")).distinct()
    moved = links.join(m, [column, *by], "left").withColumn(column, F.coalesce("__to", column)).drop("__to")
    return _strongest(moved, keys).select(*links.columns)


def _strongest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    order = F.struct(*([F.col("confidence")] if "confidence" in rest else []), *[F.col(c) for c in rest if c != "confidence"])
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__x"))
    return best.select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])


def merge_entity_rows(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping: duplicate, canonical, entity_type. Rows move to the canonical name, which takes the duplicate's name
    and aliases and the higher confidence. Mappings to another type, or to the own name, do nothing."""
    m = mapping.where("duplicate <> canonical").select(F.col("duplicate").alias("name"), "canonical", "entity_type").distinct()
    moved = entities.join(m, ["name", "entity_type"], "left")
    al = F.coalesce("aliases", F.array().cast("array<string>"))
    moved = moved.select(F.coalesce("canonical", "name").alias("name"), "entity_type",
        F.when(F.col("canonical").isNotNull(), F.array_union(al, F.array("name"))).otherwise(al).alias("aliases"), "confidence")
    return merge_entities(moved.limit(0), moved)


#: Tables in which an entity goes by name and type, and by name alone, with their keys.
TYPED_LINKS = {"document_entities": ["document_id", "entity_name", "entity_type"],
    "entity_sources": ["entity_name", "entity_type", "source", "document_id"]}
NAMED_ENDS = {
    "relations": ["source_name", "relation", "target_name"],
        "document_relations": ["document_id", "source_name", "relation", "target_name"],
    "relation_evidence": ["document_id", "source_name", "relation", "target_name", "evidence_document_id"],
}


def effective_merges(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """The mappings (duplicate, canonical, entity_type, reason) that do something: complete, to another name, with a
    known reason, of an entity that is there. A chain of merges leads to its last name; merges in a circle, which has
    none, and those that lead into one do nothing."""
    m = mapping.where("duplicate <> '' and canonical <> '' and entity_type <> '' and duplicate <> canonical")
    m = validated(m, "reason", MERGE_REASONS, "entity merge reason")
    m = m.groupBy("duplicate", "entity_type").agg(F.min(F.struct("canonical", "reason")).alias("x")).select("duplicate", "entity_type",
        "x.*")
    m = m.join(entities.select(F.col("name").alias("duplicate"), "entity_type").distinct(), ["duplicate", "entity_type"], "left_semi")
    m, seen = materialize_counted(m.select("duplicate", "entity_type", "canonical", "reason"), "merges", n=F.count(F.lit(1)))
    # pointer jumping doubles the reach each round; what still moves after that many rounds goes round in a circle
    for _ in range(int(seen["n"]).bit_length() + 1):
        up = m.select(F.col("duplicate").alias("canonical"), "entity_type", F.col("canonical").alias("up"))
        step = m.join(up, ["canonical", "entity_type"], "left").withColumn("moved",
            F.coalesce(F.col("up") != F.col("canonical"), F.lit(False)))
        step, seen = materialize_counted(step.select("duplicate", "entity_type", F.coalesce("up", "canonical").alias("canonical"), "reason",
            "moved"), "merges", moved=F.count_if("moved"))
        discard(m)
        m = step.drop("moved")
        m._kgloom_path = step._kgloom_path
        if not seen["moved"]:
            break
    ends = m.select(F.col("duplicate").alias("canonical"), "entity_type")
    return m.join(ends, ["canonical", "entity_type"], "left_anti").select("duplicate", "entity_type", "canonical", "reason")


def merge_entities_everywhere(t: dict[str, DataFrame], mapping: DataFrame, now: Column | None = None) -> dict[str, DataFrame]:
    """The tables after all merges of mapping (duplicate, canonical, entity_type, reason) at once, by joins and
    re-aggregation: entities, links and relations with their documents and evidence, where rows that meet keep the
    higher confidence, aliases (those of the duplicate go, its name and aliases lead to the canonical one unless
    claimed), and a log row for each merge."""
    m = effective_merges(t["entities"], mapping)
    out = {"entities": merge_entity_rows(t["entities"], m)}
    for name, keys in TYPED_LINKS.items():
        if name in t:
            out[name] = rewire(t[name], m, "entity_name", keys, ["entity_type"])
    # relations name their ends without a type: the smallest canonical name of a duplicate counts
    plain = m.groupBy("duplicate").agg(F.min("canonical").alias("canonical"))
    for name, keys in NAMED_ENDS.items():
        if name in t:
            a, b = plain.toDF("source_name", "__s"), plain.toDF("target_name", "__t")
            moved = t[name].join(a, "source_name", "left").join(b, "target_name", "left")
            moved = moved.withColumn("source_name", F.coalesce("__s", "source_name")).withColumn("target_name",
                F.coalesce("__t", "target_name"))
            out[name] = _strongest(moved.select(*t[name].columns), keys).select(*t[name].columns)
    if "entity_aliases" in t:
        gone = m.select(F.col("duplicate").alias("canonical_name"), "entity_type")
        kept = t["entity_aliases"].join(gone, ["canonical_name", "entity_type"], "left_anti").select("alias", "canonical_name",
            "entity_type")
        changed = out["entities"].join(m.select(F.col("canonical").alias("name"), "entity_type").distinct(), ["name", "entity_type"],
            "left_semi")
        new = changed.select(F.explode("aliases").alias("alias"), F.col("name").alias("canonical_name"), "entity_type",
            F.col("name").alias("seq")).withColumn("alias", casefold(F.col("alias")))
        out["entity_aliases"] = first_wins(kept, new, ["alias", "entity_type"])
    log = m.select(F.xxhash64("canonical", "duplicate", "entity_type").alias("id"), F.col("canonical").alias("canonical_name"),
        F.col("duplicate").alias("duplicate_name"), "entity_type", "reason",
            (now if now is not None else F.current_timestamp()).alias("created_at"))
    out["entity_merge_log"] = t["entity_merge_log"].unionByName(log) if "entity_merge_log" in t else log
    return out


def rewire_vocabulary(t: dict[str, DataFrame], mapping: DataFrame) -> dict[str, DataFrame]:
    """Links and aliases of merged words: mapping duplicate_id, canonical_id."""
    m = mapping.where("duplicate_id <> canonical_id").select(F.col("duplicate_id").alias("duplicate"),
        F.col("canonical_id").alias("canonical")).distinct()
    keys = {"entity_vocabulary_links": ["entity_name", "entity_type", "vocabulary_id"],
        "document_vocabulary_links": ["document_id", "vocabulary_id"], "vocabulary_sources": ["vocabulary_id", "source_id"]}
    out = {n: rewire(t[n], m, "vocabulary_id", k) for n, k in keys.items() if n in t}
    if "vocabulary_aliases" in t:
        out["vocabulary_aliases"] = rewire(t["vocabulary_aliases"], m, "canonical_id", ["alias"])
    return out


def migrate_types(entities: DataFrame) -> DataFrame:
    """Legacy types folded into their successor, rows merged."""
    moved = entities.withColumn("entity_type", migrated_type(F.col("entity_type")))
    return merge_entities(moved.limit(0), moved)


def migrate_links(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The typed link tables and aliases with legacy types folded; rows that meet keep the higher confidence, aliases
    the greatest canonical name."""
    keys = TYPED_LINKS | {"entity_aliases": ["alias", "entity_type"]}
    return {n: _strongest(t[n].withColumn("entity_type", migrated_type(F.col("entity_type"))), k).select(*t[n].columns) for n,
        k in keys.items() if n in t}
