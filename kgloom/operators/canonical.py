"""Canonical names of entities and relation endpoints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, norm_alias, norm_name
from ..session import discard, materialize, materialize_counted
from .upsert import first_wins


def _flatten(hooks: DataFrame) -> DataFrame:
    """root, parent with every parent a top: four steps up at a time until none is left."""
    while True:
        one = hooks.join(hooks.toDF("parent", "up"), "parent", "left").select("root", F.coalesce("up", "parent").alias("parent"),
            F.col("up").isNotNull().alias("moved"))
        two = one.join(hooks.toDF("parent", "up"), "parent", "left").select("root", F.coalesce("up", "parent").alias("parent"),
            (F.col("moved") | F.col("up").isNotNull()).alias("moved"))
        step, seen = materialize_counted(two, "hooks", moved=F.count_if("moved"))
        discard(hooks)
        hooks = step.select("root", "parent")
        hooks._kgloom_path = step._kgloom_path
        if not seen["moved"]:
            return hooks


def _spread(keys: DataFrame) -> DataFrame:
    """node, part: nodes that share a key, directly or not, share a part. keys: node, key.

    Every label hooks to the smallest label it meets in a node, the hooks are flattened, and keys take their label's
    top: each round at least halves the labels that still meet others, however long the chains are."""
    low = keys.select("key").distinct().withColumn("low", F.col("key"))
    while True:
        at = keys.join(low, "key").select("node", "low")
        least = at.groupBy("node").agg(F.min("low").alias("parent"))
        hooks, seen = materialize_counted(at.join(least, "node").where("low > parent").groupBy(F.col("low").alias("root")).agg(
            F.min("parent").alias("parent")), "hooks", n=F.count(F.lit(1)))
        if not seen["n"]:
            discard(hooks)
            return least.select("node", F.col("parent").alias("part"))
        tops = _flatten(hooks)
        step = materialize(low.join(tops.toDF("low", "top"), "low", "left").select("key", F.coalesce("top", "low").alias("low")), "parts")
        discard(low, tops)
        low = step


def _alias(s: str | None) -> str:
    return " ".join((s or "").strip().casefold().split())


class _Family:
    """Names and claimed aliases of rows that can meet, as they stand after the rows so far."""

    def __init__(self) -> None:
        self.names: dict[str, set] = {}
        self.have: set[str] = set()
        self.claims: dict[str, str] = {}
        self.folded: dict[str, set] = {}

    def add_name(self, n: str) -> None:
        self.have.add(n)
        self.names.setdefault(folded(n) or "", set()).add(n)

    def add_claim(self, a: str, n: str) -> None:
        if a and a not in self.claims:
            self.claims[a] = n
            self.folded.setdefault(folded(a) or "", set()).add(n)

    def resolve(self, name: str, aliases: list[str]) -> tuple[str, list[str]]:
        to = name
        if name not in self.have:
            spell = [name, *aliases]
            hit = {self.claims[a] for a in map(_alias, spell) if a in self.claims}
            keys = {f for f in map(folded, spell) if f}
            same = {n for k in keys for n in self.names.get(k, ())}
            other = {n for k in keys for n in self.folded.get(k, ())}
            for found in (hit, same, other):
                if found:
                    to = next(iter(found)) if len(found) == 1 else name
                    break
        every = [a for a in [*aliases, *([name] if _alias(name) != _alias(to) else [])] if _alias(a)]
        self.add_name(to)
        for a in [to, *every]:
            self.add_claim(_alias(a), to)
        return to, every


RESOLVED = "node long, canonical string, aliases array<string>"


def resolve_entities(batch: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """The columns of ``batch`` and canonical: each incoming entity with the name it goes by; aliases are those it
    claims.

    Incoming rows (seq of any type that sorts, name, entity_type, aliases, confidence, further columns stay) see what
    earlier ones left. Within a type a name that exists is itself; else the one canonical name its spellings have as
    claimed aliases; else the one existing name equal after folding; else the one claimed alias equal after folding;
    else itself. Only rows that share a folded or alias key can meet, so each such family is resolved in order by
    itself, streaming through one task with its names alone in memory, and the families run in parallel."""
    empty = F.array().cast("array<string>")
    none = F.lit(None)
    order = batch.schema["seq"].dataType
    incoming = materialize(batch.withColumn("node", F.monotonically_increasing_id()), "batch")
    new = incoming.select("node", F.lit(2).alias("kind"), "seq", "name", "entity_type", F.coalesce("aliases", empty).alias("aliases"),
        none.cast("string").alias("to"))
    old = entities.select(F.lit(0).alias("kind"), none.cast(order).alias("seq"), "name", "entity_type",
        F.coalesce("aliases", empty).alias("aliases"), none.cast("string").alias("to"))
    claim = aliases.select(F.lit(1).alias("kind"), none.cast(order).alias("seq"), F.col("alias").alias("name"), "entity_type",
        empty.alias("aliases"), F.col("canonical_name").alias("to"))
    state = old.unionByName(claim).withColumn("node", -1 - F.monotonically_increasing_id())
    rows = materialize(new.unionByName(state.select(*new.columns)), "incoming")
    words = rows.select("node", "entity_type", F.explode(F.concat(F.array("name"), "aliases", F.array_compact(F.array("to")))).alias("w"))
    keys = words.select("node", F.concat_ws("\u0001", "entity_type", norm_name("w")).alias("key")).distinct()
    keys = materialize(keys, "keys")
    part = _spread(keys)

    def resolve(batches):
        # rows arrive family by family, in order; only one family's names are held at a time
        at, family = None, _Family()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.part != at:
                    at, family = r.part, _Family()
                if r.kind == 0:
                    family.add_name(r.name)
                elif r.kind == 1:
                    family.add_claim(r.name, r.to)
                else:
                    out.append((r.node, *family.resolve(r.name, list(r.aliases))))
            yield pd.DataFrame(out, columns=["node", "canonical", "aliases"])

    cols = ["part", "kind", "node", "name", "aliases", "to"]
    done = rows.join(part, "node").repartition("part").sortWithinPartitions("part", "kind", "seq",
        "name").select(*cols).mapInPandas(resolve, RESOLVED)
    out = materialize(incoming.drop("aliases").join(done, "node").drop("node"), "resolved")
    discard(rows, keys, incoming)
    return out


def alias_claims(resolved: DataFrame, old: DataFrame) -> DataFrame:
    """Aliases each first claimed for one name: those of the old table, then in order of the batch."""
    return first_wins(old, claimed(resolved), ["alias", "entity_type"])


def claimed(resolved: DataFrame) -> DataFrame:
    """alias, canonical_name, entity_type, seq: every claim of the batch, the canonical name before its aliases."""
    order = F.posexplode(F.concat(F.array("canonical"), "aliases"))
    rows = resolved.select("seq", "entity_type", F.col("canonical").alias("canonical_name"), order.alias("pos", "a"))
    return rows.select(norm_alias(F.col("a")).alias("alias"), "canonical_name", "entity_type",
        F.struct("seq", "pos").alias("seq")).where("alias <> ''")


def unique_names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """alias, name: keys that lead to exactly one (name, type): by claimed aliases, else by the names themselves."""
    by_alias = aliases.select("alias", F.struct(F.col("canonical_name").alias("n"), F.col("entity_type").alias("t")).alias("x"))
    by_name = entities.select(norm_alias(F.col("name")).alias("alias"),
        F.struct(F.col("name").alias("n"), F.col("entity_type").alias("t")).alias("x"))
    a = by_alias.groupBy("alias").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = by_name.join(a.select("alias"), "alias", "left_anti").groupBy("alias").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return a.unionByName(b).where("lo = hi").select("alias", F.col("lo.n").alias("name"))


def resolve_endpoints(ends: DataFrame, resolved: DataFrame, names: DataFrame) -> DataFrame:
    """ends: document_id, name. The endpoint by the names of its own document (the last entity with that very name,
    else the first with that alias key), else by ``names`` (alias, name), else as it stands. resolved needs
    document_id, name, canonical and seq."""
    e = own_endpoints(ends, resolved).join(names.withColumnRenamed("name", "by_table"), "alias", "left")
    return e.withColumn("canonical", F.coalesce("by_name", "by_alias", "by_table", "name")).drop("alias", "by_name", "by_alias", "by_table")


def own_endpoints(ends: DataFrame, resolved: DataFrame) -> DataFrame:
    exact = resolved.groupBy("document_id", "name").agg(F.max_by("canonical", "seq").alias("by_name"))
    loose = resolved.groupBy("document_id", norm_alias(F.col("name")).alias("alias")).agg(F.min_by("canonical", "seq").alias("by_alias"))
    e = ends.withColumn("alias", norm_alias(F.col("name")))
    return e.join(exact, ["document_id", "name"], "left").join(loose, ["document_id", "alias"], "left")


def resolve_endpoints_in_order(ends: DataFrame, resolved: DataFrame, entities: DataFrame, aliases: DataFrame,
    reached: DataFrame) -> DataFrame:
    """``resolve_endpoints`` as of each document's turn: a claim or a name counts only if it is in the old tables or
    comes from a document up to the end's own. ends: document_id, name; reached: document_id, doc_seq; resolved also
    has doc_seq and entity_type. Each alias keeps its first and its second different (name, type) with the document
    that brought it: what was unique until then is what a later document no longer sees as such."""
    first = F.lit(None).cast(resolved.schema["doc_seq"].dataType)
    keys = ["alias", "entity_type"]
    new = claimed(resolved.withColumn("seq", F.struct("doc_seq", "seq"))).select(*keys, "canonical_name",
        F.col("seq.seq.doc_seq").alias("at"), F.col("seq").alias("order"))
    new = new.groupBy(*keys).agg(F.min_by(F.struct("canonical_name", "at"), "order").alias("x")).select(*keys, "x.canonical_name", "x.at")
    old = aliases.select(*keys, "canonical_name", first.alias("at"))
    claims = old.unionByName(new.join(old.select(*keys), keys, "left_anti"))
    named = entities.select("name", "entity_type", first.alias("at")).unionByName(
        resolved.select(F.col("canonical").alias("name"), "entity_type", F.col("doc_seq").alias("at")))
    named = named.groupBy("name", "entity_type").agg(F.min(F.struct(F.col("at").isNotNull().alias("new"), "at")).getField("at").alias("at"))
    e = own_endpoints(ends, resolved).join(reached, "document_id")

    def seen(rows: DataFrame, value: str, label: str) -> DataFrame:
        hit = e.select("document_id", "name", "alias", "doc_seq").join(rows, "alias").where("at is null or at <= doc_seq")
        per = hit.groupBy("document_id", "name").agg(F.min(F.struct(value, "entity_type")).alias("lo"),
            F.max(F.struct(value, "entity_type")).alias("hi"))
        return per.select("document_id", "name", F.lit(True).alias(f"{label}_any"),
            F.when(F.col("lo") == F.col("hi"), F.col(f"lo.{value}")).alias(label))

    by_claim = seen(claims.select("alias", "canonical_name", "entity_type", "at"), "canonical_name", "claim")
    by_name = seen(named.select(norm_alias(F.col("name")).alias("alias"), F.col("name").alias("other"), "entity_type", "at"), "other",
        "entity")
    e = e.join(by_claim, ["document_id", "name"], "left").join(by_name, ["document_id", "name"], "left")
    late = F.when(F.col("claim_any"), F.col("claim")).otherwise(F.col("entity"))
    return e.select("document_id", "name", F.coalesce("by_name", "by_alias", late, "name").alias("canonical"))
