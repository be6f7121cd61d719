"""Best representative of each duplicate group (problem 1)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_name, strip_space
from ..session import discard, materialize
from .names import alias_keys

OTHER = "(other)"


def keyed_rows(entities: DataFrame, sources: DataFrame, types: DataFrame) -> DataFrame:
    """One slim row per entity: folded name, usable type, aliases and confidence, source with its priority."""
    listed = sources.select(F.lower(strip_space(F.col("source"))).alias("src"),
        F.col("priority").alias("prio")).where("src is not null").groupBy("src").agg(F.max("prio").alias("prio"))
    names = types.select(F.col("type_name").alias("entity_type"), F.lit(True).alias("listed")).where("entity_type is not null").distinct()
    rows = entities.select(
        "entity_id", norm_name("name").alias("key"), "entity_type", alias_keys("name", "aliases").alias("alias_list"),
        F.when((F.col("confidence") >= 0) & (F.col("confidence") <= 1) & ~F.isnan("confidence"), F.col("confidence")).alias("conf"),
        F.lower(strip_space(F.col("source"))).alias("src"), "updated_at",
    ).where("key <> ''")
    rows = rows.join(listed, "src", "left").join(names, "entity_type", "left")
    return rows.select(
        "entity_id", "key", F.when(F.col("listed"), F.col("entity_type")).alias("type"), "alias_list", "conf",
        F.when(F.col("prio").isNotNull(), F.col("src")).otherwise(OTHER).alias("src"), F.coalesce("prio", F.lit(0)).alias("prio"),
            "updated_at",
    )


def supplying_rows(entities: DataFrame, sources: DataFrame, types: DataFrame) -> DataFrame:
    """group_id, type_from, aliases_from, confidence_from for each group of two or more rows with equal folded name.

    Which row supplies a field is fixed by rank, field by field: type by source priority, then updated_at, then the
    smallest entity_id; aliases by the number of distinct ones, then updated_at; confidence by updated_at, then
    priority. All ranks are combined maxima, so a group of any size is never gathered. 0 where no row can supply;
    a missing updated_at is the oldest; names without letter or digit form no group; an empty table gives no rows."""
    rows = keyed_rows(entities, sources, types)
    neg = (-F.col("entity_id")).alias("neg")

    def best(ok, *rank):
        return F.coalesce(-F.max(F.when(ok, F.struct(*rank, neg))).getField("neg"), F.lit(0)).cast("long")

    n = F.size("alias_list").alias("n")
    out = rows.groupBy("key").agg(
        F.count("*").alias("rows"), F.min("entity_id").alias("group_id"),
        best(F.col("type").isNotNull(), F.col("prio"), F.col("updated_at")).alias("type_from"),
        best(F.size("alias_list") > 0, n, F.col("updated_at")).alias("aliases_from"),
        best(F.col("conf").isNotNull(), F.col("updated_at"), F.col("prio")).alias("confidence_from"),
    )
    return out.where("rows > 1").select("group_id", "type_from", "aliases_from", "confidence_from")


# --- Bayesian fusion with copy detection -------------------------------------------------------------------------

#: How many wrong values a field can take, as the model assumes.
FALSE_VALUES = {"type": 10, "confidence": 10, "alias": 1}
COPY_RATE, COPY_PRIOR, START = 0.8, 0.1, 0.8


def _bucket(c: str) -> Column:
    """Confidences that round to one tenth are one claim."""
    return F.format_number(F.round(c, 1), 1)


def votes(rows: DataFrame) -> DataFrame:
    """key, field, item, claims: who claims what. claims holds each (source, value) once, so it is bounded by the
    number of listed sources and of values, however many rows a group has."""
    many = rows.join(rows.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"), "key", "left_semi")
    one = F.struct(F.col("src").alias("s"), F.col("value").alias("v"))
    plain = many.select("key", F.lit("type").alias("field"), "src", F.col("type").alias("value")).unionByName(
        many.select("key", F.lit("confidence").alias("field"), "src", _bucket("conf").alias("value")))
    plain = plain.where("value is not null").groupBy("key", "field").agg(F.collect_set(one).alias("claims")).withColumn("item", F.lit(""))
    given = many.where(F.size("alias_list") > 0)
    who = given.groupBy("key").agg(F.collect_set("src").alias("all"))
    yes = given.select("key", "src", F.explode("alias_list").alias("item")).groupBy("key", "item").agg(F.collect_set("src").alias("yes"))
    alias = yes.join(who, "key").select("key", "item", F.lit("alias").alias("field"), F.concat(
        F.transform("yes", lambda s: F.struct(s.alias("s"), F.lit("yes").alias("v"))),
        F.transform(F.array_except("all", "yes"), lambda s: F.struct(s.alias("s"), F.lit("no").alias("v")))).alias("claims"))
    return plain.unionByName(alias).withColumn("claims", F.array_sort("claims"))


def _posterior(claims: list[tuple[str, str]], n: int, accuracy: dict[str, float], copies: dict[tuple[str, str], float]) -> dict[str, float]:
    """Posterior of each claimed value; a vote counts less the more likely it was copied from a better source."""
    per_source: dict[str, int] = {}
    for s, _ in claims:
        per_source[s] = per_source.get(s, 0) + 1
    score: dict[str, float] = {}
    for v in {v for _, v in claims}:
        voters = sorted((s for s, w in claims if w == v), key=lambda s: (-accuracy[s], s))
        total = 0.0
        for i, s in enumerate(voters):
            alone = math.prod(1 - COPY_RATE * copies.get((s, t), 0.0) for t in voters[:i])
            a = accuracy[s]
            total += alone * math.log(n * a / (1 - a)) / per_source[s]
        score[v] = total
    top = max(max(score.values()), 0.0)
    z = sum(math.exp(x - top) for x in score.values()) + max(0, n + 1 - len(score)) * math.exp(-top)
    return {v: math.exp(x - top) / z for v, x in score.items()}


def _clamp(a: float) -> float:
    return min(0.99, max(0.05, a))


def source_model(patterns: DataFrame, rounds: int = 5) -> tuple[dict[str, dict], dict[str, dict]]:
    """Accuracy of each source and the probability that one copies another, per field, by alternating estimation.

    patterns: field, claims, weight; equal vote patterns are counted once, before anything is shuffled or fitted. The
    state is one number per source and per pair of sources: bounded by the fixed source list."""
    accuracy: dict[str, dict[str, float]] = {f: {} for f in FALSE_VALUES}
    copies: dict[str, dict[tuple[str, str], float]] = {f: {} for f in FALSE_VALUES}

    for _ in range(rounds):
        acc, cop = accuracy, copies

        def stats(batches, acc=acc, cop=cop):
            sums: dict[tuple, list[float]] = {}
            for b in batches:
                for field, claims, w in zip(b.field, b.claims, b.weight):
                    pairs = [(c["s"], c["v"]) for c in claims]
                    known = {s: _clamp(acc[field].get(s, START)) for s, _ in pairs}
                    p = _posterior(pairs, FALSE_VALUES[field], known, cop[field])
                    for i, (s, v) in enumerate(pairs):
                        x = sums.setdefault((field, s, ""), [0.0, 0.0, 0.0])
                        x[0] += w * p[v]
                        x[1] += w
                        for t, u in pairs[i + 1 :]:
                            if s == t:
                                continue
                            y = sums.setdefault((field, min(s, t), max(s, t)), [0.0, 0.0, 0.0])
                            if u == v:
                                y[0] += w * p[v]
                                y[1] += w * (1 - p[v])
                            else:
                                y[2] += w
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["field", "s", "t", "x", "y", "z"])

        got = patterns.mapInPandas(stats, "field string, s string, t string, x double, y double, z double").groupBy("field", "s",
            "t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z")).collect()
        accuracy = {f: {} for f in FALSE_VALUES}
        for r in got:
            if not r.t:
                accuracy[r.field][r.s] = _clamp((r.x + START) / (r.y + 1))
        copies = {f: {} for f in FALSE_VALUES}
        for r in got:
            if r.t:
                a, b, n = accuracy[r.field][r.s], accuracy[r.field][r.t], FALSE_VALUES[r.field]
                pt, pf = a * b, (1 - a) * (1 - b) / n
                pd_ = max(1e-9, 1 - pt - pf)
                free = r.x * math.log(pt) + r.y * math.log(pf) + r.z * math.log(pd_)
                for s, t, own in ((r.s, r.t, b), (r.t, r.s, a)):
                    # s copies from t: with the copy rate it repeats what t says
                    dep = r.x * math.log(own * COPY_RATE + pt * (1 - COPY_RATE)) + r.y * math.log(
                        (1 - own) * COPY_RATE + pf * (1 - COPY_RATE)) + r.z * math.log(pd_ * (1 - COPY_RATE))
                    odds = math.log(COPY_PRIOR / (1 - COPY_PRIOR)) + dep - free
                    copies[r.field][(s, t)] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return accuracy, copies


def fuse(entities: DataFrame, sources: DataFrame, types: DataFrame, rounds: int = 5) -> DataFrame:
    """One fused record per group of two or more rows with equal folded name: group_id, n_rows, entity_type and
    confidence with their posteriors, aliases (pipe-packed, those more likely true than not).

    Bayesian fusion with copy detection: source accuracies and the dependence of sources, seen in shared false values,
    are estimated in turn; copied votes are discounted; each field takes the value of greatest posterior (ties: the
    smaller value). Confidences vote by tenths, and the fused one is a claimed value of the winning tenth: that of the
    most accurate source, then the latest, then the smallest. Fields nobody fills are null, with posterior null. Sources outside the list are one source. Groups
    of any size are reduced to their distinct claims before fitting; an empty table gives no rows."""
    rows = materialize(keyed_rows(entities, sources, types), "keyed")
    claims = materialize(votes(rows), "votes")
    patterns = materialize(claims.groupBy("field", "claims").agg(F.count("*").alias("weight")), "patterns")
    accuracy, copies = source_model(patterns, rounds)

    def decide(batches):
        for b in batches:
            out = []
            for field, claims_ in zip(b.field, b.claims):
                pairs = [(c["s"], c["v"]) for c in claims_]
                known = {s: _clamp(accuracy[field].get(s, START)) for s, _ in pairs}
                p = _posterior(pairs, FALSE_VALUES[field], known, copies[field])
                v = min(p, key=lambda x: (-p[x], x))
                out.append((field, [tuple(c.values()) if isinstance(c, dict) else (c["s"], c["v"]) for c in claims_], v, round(p[v], 6)))
            yield pd.DataFrame(out, columns=["field", "claims", "value", "posterior"])

    made = patterns.select("field", "claims").mapInPandas(decide,
        "field string, claims array<struct<s:string,v:string>>, value string, posterior double")
    won = claims.join(made, ["field", "claims"]).select("key", "field", "item", "value", "posterior")
    base = rows.groupBy("key").agg(F.min("entity_id").alias("group_id"), F.count("*").alias("n_rows")).where("n_rows > 1")
    weigh = F.lit(0.0)
    for s, a in sorted(accuracy["confidence"].items()):
        weigh = F.when(F.col("src") == s, F.lit(a)).otherwise(weigh)
    tenth = won.where("field = 'confidence'").select("key", F.col("value").alias("tenth"))
    told = rows.where("conf is not null").select("key", _bucket("conf").alias("tenth"), weigh.alias("accuracy"), "updated_at",
        (-F.col("conf")).alias("neg"))
    given = told.join(tenth, ["key", "tenth"]).groupBy("key").agg(
        (-F.max(F.struct("accuracy", "updated_at", "neg")).getField("neg")).alias("confidence"))
    # a group has one type row, one confidence row and its distinct aliases
    fields = won.groupBy("key").agg(
        F.max(F.when(F.col("field") == "type", F.col("value"))).alias("entity_type"),
            F.max(F.when(F.col("field") == "type", F.col("posterior"))).alias("type_posterior"),
        F.max(F.when(F.col("field") == "confidence", F.col("posterior"))).alias("confidence_posterior"),
        F.array_join(F.array_sort(F.collect_set(F.when((F.col("field") == "alias") & (F.col("value") == "yes"), F.col("item")))),
            "|").alias("aliases"),
    )
    out = base.join(fields, "key", "left").join(given, "key", "left").withColumn("aliases", F.coalesce("aliases", F.lit("")))
    out = out.select("group_id", "n_rows", "entity_type", "type_posterior", "confidence", "confidence_posterior", "aliases")
    out = materialize(out, "fused")
    discard(rows, claims, patterns)
    return out
