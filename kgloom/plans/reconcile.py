"""Reconciling moved notes with the tables: which document a changed note is, and what may be repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import migrated_type
from ..functions.text import norm_name
from ..operators.upsert import first_wins
from ..vault.notes import link_rows


def identity_classes(documents: DataFrame) -> DataFrame:
    """hash, document_id, identity: content hashes with one document (unique) or several (ambiguous)."""
    d = documents.where("content_hash is not null and content_hash <> ''").groupBy(F.col("content_hash").alias("hash")).agg(
        F.countDistinct("id").alias("n"), F.min("id").alias("document_id"))
    return d.select("hash", F.when(F.col("n") == 1, F.col("document_id")).alias("document_id"),
        F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("identity"))


def _unique(df: DataFrame, key: list[str], value: str, label: str) -> DataFrame:
    """Per key the one value, or null if there are several; ``n_label`` counts them."""
    per = df.groupBy(*key).agg(F.countDistinct(value).alias(f"n_{label}"), F.min(value).alias(f"r_{label}"))
    return per.withColumn(f"r_{label}", F.when(F.col(f"n_{label}") == 1, F.col(f"r_{label}")))


def _ladder(rows: DataFrame, steps: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """resolved_to and reason: the first step that knows the key decides, if it knows one note; else it is ambiguous."""
    for label, df in steps:
        rows = rows.join(_unique(df, key, "relative", label), key, "left")
    to, why = F.lit(None).cast("string"), F.lit("unknown")
    for label, _ in reversed(steps):
        n = F.col(f"n_{label}")
        to = F.when(n.isNotNull(), F.col(f"r_{label}")).otherwise(to)
        why = F.when(n == 1, label).when(n > 1, "ambiguous").otherwise(why)
    return rows.withColumn("resolved_to", to).withColumn("reason", why).drop(*[f"{p}_{label}" for label, _ in steps for p in ("n", "r")])


def resolve_names(names: DataFrame, notes: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (name) by the ladder: the note of that name, the note that has it as alias, the table's alias; each step
    must be unique. resolved_to and reason."""
    n = names.select("name", norm_name("name").alias("key")).distinct()
    direct = notes.select(F.col("normalized").alias("key"), "relative")
    al = notes.select("relative", F.explode("aliases").alias("a")).select(norm_name("a").alias("key"), "relative")
    tb = aliases.select(norm_name("alias").alias("key"), norm_name("canonical_name").alias("c")).join(
        notes.select(F.col("normalized").alias("c"), "relative"), "c")
    return _ladder(n, [("direct", direct), ("vault_alias", al), ("table_alias", tb)], ["key"]).select("name", "resolved_to", "reason")


def resolve_entities(document_entities: DataFrame, notes: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """document_id, name, domain, resolved_to, reason: the entities of documents by the same ladder within their type;
    the table step takes stated aliases and those the entities' own rows list."""
    d = document_entities.select("document_id", F.col("entity_name").alias("name"),
        F.coalesce(migrated_type(F.col("entity_type")), F.lit("")).alias("domain"), norm_name("entity_name").alias("key")).distinct()
    n = notes.select(F.coalesce("domain", "raw_domain").alias("domain"), F.col("normalized").alias("key"), "relative", "aliases")
    al = n.select("domain", "relative", F.explode("aliases").alias("a")).select("domain", norm_name("a").alias("key"), "relative")
    own = entities.select("entity_type", "name", F.explode("aliases").alias("alias")) if dict(entities.dtypes).get(
        "aliases") == "array<string>" else entities.select("entity_type", "name", F.col("name").alias("alias")).where("false")
    both = aliases.select("entity_type", F.col("canonical_name").alias("name"), "alias").unionByName(own)
    tb = both.select(F.coalesce(migrated_type(F.col("entity_type")), F.lit("")).alias("domain"), norm_name("alias").alias("key"),
        norm_name("name").alias("c"))
    tb = tb.join(n.select("domain", F.col("key").alias("c"), "relative"), ["domain", "c"])
    return _ladder(d, [("direct", n), ("vault_alias", al), ("table_alias", tb)], ["domain", "key"]).select("document_id", "name", "domain",
        "resolved_to", "reason")


def resolve_links(files: DataFrame, notes: DataFrame) -> DataFrame:
    """file, target, status: unique, ambiguous or none for the entity notes a link may mean, by name, alias or path.
    Links to the web are left out."""
    links = link_rows(files).where((F.col("target") != "") & ~F.col("target").rlike("^https?://")).select("file", "target").distinct()
    keys = notes.select(F.col("normalized").alias("key"), "relative").unionByName(
        notes.select("relative", F.explode("aliases").alias("a")).select(norm_name("a").alias("key"), "relative"))
    bare = lambda c: F.btrim(F.regexp_replace(c, r"\.md$", ""), F.lit("/"))
    by_key = links.withColumn("key", norm_name("target")).join(keys.where("key <> ''"), "key").select("file", "target", "relative")
    by_path = links.withColumn("at", bare(F.col("target"))).join(notes.select(bare(F.col("relative")).alias("at"), "relative"),
        "at").select("file", "target", "relative")
    n = by_key.unionByName(by_path).groupBy("file", "target").agg(F.countDistinct("relative").alias("n"))
    return links.join(n, ["file", "target"], "left").select("file", "target",
        F.when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("status"))


def classify(
    changes: DataFrame, documents: DataFrame, files: DataFrame | None = None, notes: DataFrame | None = None,
        aliases: DataFrame | None = None,
    document_entities: DataFrame | None = None, entities: DataFrame | None = None,
) -> DataFrame:
    """action, kind, source, target, hash, document_id, identity, identity_status, unresolved: a move is AUTO if exactly
    one document has its hash and, when the vault is given, no link of the moved note is ambiguous and all entities of
    the document resolve to a note; all else is REVIEW. A modified note is stable if the hashes before and after are
    one document's, stale if only the one before is, in conflict if they are two documents', ambiguous if several
    documents have either, and unknown if none has the one before."""
    ids = identity_classes(documents)
    c = changes.join(ids, "hash", "left").withColumn("identity", F.coalesce("identity", F.lit("unknown")))
    prior = ids.select(F.col("hash").alias("before"), F.col("document_id").alias("old_document"), F.col("identity").alias("old_identity"))
    c = c.join(prior, "before", "left") if "before" in changes.columns else c.withColumn("old_document",
        F.lit(None).cast("string")).withColumn("old_identity", F.lit(None).cast("string"))
    was, now = F.coalesce("old_identity", F.lit("unknown")), F.col("identity")
    status = F.when(was != "unique", was).when(now == "unknown", "stale").when(now == "ambiguous",
        "ambiguous").when(F.col("document_id") == F.col("old_document"), "stable").otherwise("conflict")
    c = c.withColumn("identity_status", F.when(F.col("change") == "modified", status))
    c = c.withColumn("document_id", F.when(F.col("change") == "modified", F.col("old_document")).otherwise(F.col("document_id")))
    open_ = []
    if files is not None and notes is not None:
        # links are looked up where the note now is
        bad = resolve_links(files, notes).where("status = 'ambiguous'").groupBy(F.col("file").alias("target")).agg(
            F.count("*").alias("open_links"))
        c = c.join(bad, "target", "left")
        open_.append("open_links")
        if document_entities is not None and aliases is not None and entities is not None:
            lost = resolve_entities(document_entities, notes, aliases,
                entities).where("resolved_to is null").groupBy("document_id").agg(F.count("*").alias("open_entities"))
            c = c.join(lost, "document_id", "left")
            open_.append("open_entities")
    total = sum((F.coalesce(F.col(x), F.lit(0)) for x in open_), F.lit(0).cast("long"))
    c = c.withColumn("unresolved", F.when(F.col("change") == "moved", total).otherwise(F.lit(0)))
    auto = (F.col("change") == "moved") & (F.col("identity") == "unique") & (F.col("unresolved") == 0)
    return c.select(F.when(auto, "AUTO").otherwise("REVIEW").alias("action"), F.col("change").alias("kind"), F.col("path").alias("source"),
        "target", "hash", "document_id", "identity", "identity_status", "unresolved")


def finalize(old: DataFrame, applied: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reconciliation_provenance with the applied moves added, moves whose document no longer has that hash). Nothing
    may be committed while the second is not empty. applied: document_id, content_hash, old_path, new_path,
    manifest_path, verified_at."""
    live = documents.select(F.col("id").alias("document_id"), "content_hash").distinct()
    wrong = applied.join(live, ["document_id", "content_hash"], "left_anti")
    rows = applied.withColumn("seq", F.lit(1).cast("long"))
    return first_wins(old, rows, ["document_id", "content_hash", "old_path", "new_path"]), wrong
