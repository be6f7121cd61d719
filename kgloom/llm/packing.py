"""Filling fixed-capacity containers with items (problem 8)."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import TOKENIZER, token_counts


PACKED = "container_kind string, container_id string, doc_id long, part int, token_start long, n_tokens long"


def best_fit(sizes: list[int], capacity: int, copies: list[int], apart: list[int]) -> list[int]:
    """The bin of each item: largest first, each into the fullest bin that has room and no conflict.

    copies: the item's bit among duplicate clusters (0: none), apart: the bits of what may not share its bin with the
    item's own bit, packed as (own << 64) | others. Bins are kept in order of what is left; the search goes on to the
    next roomier bin until a compatible one is found, else a new bin opens."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[tuple[int, int]] = []  # (left, bin), in order
    held: list[int] = []  # bitmap of clusters
    source: list[int] = []  # bitmap of sources
    where = [0] * len(sizes)
    mask = (1 << 64) - 1
    for i in order:
        size, bit, own, others = sizes[i], copies[i], apart[i] >> 64, apart[i] & mask
        at = bisect_left(bins, (size, -1))
        while at < len(bins):
            left, b = bins[at]
            if not (held[b] & bit) and not (source[b] & others):
                break
            at += 1
        if at < len(bins):
            left, b = bins.pop(at)
        else:
            left, b = capacity, len(held)
            held.append(0)
            source.append(0)
        held[b] |= bit
        source[b] |= own
        where[i] = b
        if left > size:
            insort(bins, (left - size, b))
    return where


def split_items(sized: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """One row per piece and container kind: an item above the capacity is cut into full pieces and a rest."""
    cap = F.col("capacity_tokens")
    kinds = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity_tokens")) for k, c in containers])
    both = sized.withColumn("kind", F.explode(kinds)).select(*sized.columns, "kind.*")
    n = F.greatest(F.ceil(F.col("n_tokens") / cap), F.lit(1)).cast("int")
    return both.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("token_start",
        F.col("part").cast("long") * cap).withColumn("size", F.least(F.col("n_tokens") - F.col("token_start"), cap).cast("long"))


def pack(
    documents: DataFrame, containers: DataFrame, conflicts: list[tuple[str, str]] = (), separate_copies: bool = True,
    tokenizer: str = TOKENIZER, shard_tokens: int = 4_000_000, shard_rows: int = 20_000,
) -> DataFrame:
    """container_kind, container_id, doc_id, part, token_start, n_tokens: every text in containers of each capacity.

    Conflict-constrained best fit: a container never holds two copies of one text (duplicate cluster) unless
    ``separate_copies`` is off, nor texts of two sources listed as a pair in ``conflicts``. No text is split unless it
    exceeds the capacity; then its full pieces stand alone and the rest is packed like an item. Items are dealt by hash
    into shards of bounded size, so any number of rows and any hot cluster spreads; a shard wastes at most its last
    bins. Null and empty texts are items of size 0; repeated rows each get a place; capacities that are null or not
    positive are ignored; no documents, no rows. Documents' further columns are ignored."""
    # a fixed short list
    kinds = [(r.container_kind, r.capacity_tokens) for r in containers.where("capacity_tokens > 0").distinct().collect()]
    rows = documents.select("doc_id", F.lower(F.trim("source")).alias("source"), F.xxhash64("text").alias("cluster"), "text")
    sized = materialize(token_counts(rows, ["doc_id", "source", "cluster"], path=tokenizer), "sized")
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    shards = max(1, -(-total.t // shard_tokens), -(-total.n // shard_rows))
    if not kinds:
        return documents.sparkSession.createDataFrame([], PACKED)
    # repeated rows are counted and numbered, so that they are dealt apart and nothing depends on how files are split
    rows = sized.groupBy("doc_id", "source", "cluster", "n_tokens").agg(F.count("*").cast("int").alias("copies"))
    rows = rows.withColumn("deal", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
    items = split_items(rows, kinds)
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "deal", "part"), F.lit(shards)).cast("int"))
    names = sorted({s for pair in conflicts for s in pair})
    bit = {s: 1 << i for i, s in enumerate(names)}
    against = {s: sum(bit[b if a == s else a] for a, b in conflicts if s in (a, b)) for s in names}

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "part", "cluster"], ascending=[False, True, True, True],
            kind="stable").reset_index(drop=True)
        cap = int(pdf.capacity_tokens.iloc[0])
        count = pdf.cluster.value_counts()
        twice = {c: 1 << k for k, c in enumerate(sorted(count[count > 1].index))} if separate_copies else {}
        copies = [twice.get(c, 0) for c in pdf.cluster]
        apart = [(bit.get(s, 0) << 64) | against.get(s, 0) for s in pdf.source]
        where = best_fit(pdf["size"].tolist(), cap, copies, apart)
        ids = [f"{k}-{s}-{b}" for k, s, b in zip(pdf.container_kind, pdf.shard, where)]
        return pd.DataFrame({"container_kind": pdf.container_kind, "container_id": ids, "doc_id": pdf.doc_id, "part": pdf.part,
            "token_start": pdf.token_start, "n_tokens": pdf["size"]})

    return items.select("container_kind", "capacity_tokens", "shard", "doc_id", "source", "cluster", "part", "token_start",
        "size").groupBy("container_kind", "shard").applyInPandas(fill, PACKED)


def container_faults(packed: DataFrame, documents: DataFrame, containers: DataFrame, conflicts: list[tuple[str, str]] = ()) -> DataFrame:
    """Per kind what a right packing has: the documents placed, and no overfull container, no two copies of a text or
    texts of conflicting sources together, no text in pieces that would fit whole, no piece missing or placed twice."""
    d = documents.select("doc_id", F.lower(F.trim("source")).alias("source"), F.xxhash64("text").alias("cluster"))
    rows = packed.join(d, "doc_id").join(F.broadcast(containers.select("container_kind", "capacity_tokens")), "container_kind")
    pairs = [F.max(F.col("source") == a) & F.max(F.col("source") == b) for a, b in conflicts]
    per = rows.groupBy("container_kind", "container_id", "capacity_tokens").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"), F.countDistinct("cluster").alias("texts"),
            (F.count_if(F.lit(False)) + sum((p.cast("long") for p in pairs), F.lit(0))).alias("conflicts"))
    per = per.groupBy("container_kind").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("overfull"),
        F.count_if(F.col("n") > F.col("texts")).alias("copies_together"), F.sum("conflicts").alias("conflicts"))
    docs = rows.groupBy("container_kind", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"),
        F.countDistinct("part").alias("parts"), F.max("part").alias("last"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    docs = docs.groupBy("container_kind").agg(
        F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias(
            "split_in_vain"),
        F.count_if((F.col("pieces") != F.col("parts")) | (F.col("parts") != F.col("last") + 1) | (F.col("end") != F.col("tokens"))).alias(
            "pieces_wrong"))
    return docs.join(per, "container_kind").select("container_kind", "documents", "overfull", "copies_together", "conflicts",
        "split_in_vain", "pieces_wrong")


def container_fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, unused tokens and the share of capacity that is filled."""
    per = packed.groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    cap = F.col("containers") * F.col("capacity_tokens")
    return per.join(F.broadcast(containers.select("container_kind", "capacity_tokens")), "container_kind").select(
        "container_kind", "containers", "tokens", (cap - F.col("tokens")).alias("unused_tokens"),
            F.round(F.col("tokens") / cap, 6).alias("fill"))
