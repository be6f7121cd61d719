"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize
from .tokens import TOKENIZER, token_ids


def permute(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the places ``k``: a four-round Feistel network with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def mixed(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            h = b * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0x2545F4914F6CDD1D + r * 0x632BE59BD9B4E019 + 1) & (2**64 - 1))
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            a, b = b, (a ^ h) & mask
        return (a << np.uint64(half)) | b

    x = mixed(k.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = mixed(x[out])
    return x.astype(np.int64)


def token_blocks(ids: DataFrame, length: int, bucket_rows: int = 20_000) -> DataFrame:
    """source, block, n_tokens, pieces: the token stream of each source cut into blocks of ``length``; the last block
    of a source may be shorter. pieces lists (pos, doc_id, token_start, tokens) in order.

    The running token count is a two-level prefix sum: per bucket of documents first, so that no source, whatever its
    share, is ordered in one task."""
    rows = ids.count()
    buckets = max(1, -(-rows // bucket_rows))
    placed = ids.where("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash", "row"), F.lit(buckets)).cast("int"))
    per = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    base = per.withColumn("base", F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).select("source", "bucket",
        "base")
    before = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("doc_id", "text_hash",
        "row").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.withColumn("inner", F.coalesce(before, F.lit(0))).join(base, ["source", "bucket"]).withColumn("start",
        F.col("base") + F.col("inner"))
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("n_tokens") - 1) / length)
    cut = starts.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("block") * length - F.col("start"), F.lit(0)).cast("int")
    hi = F.least((F.col("block") + 1) * length - F.col("start"), F.col("n_tokens")).cast("int")
    piece = F.struct(
        (F.col("start") + lo - F.col("block") * length).cast("int").alias("pos"), F.col("doc_id"), lo.alias("token_start"),
            F.slice("tokens", lo + 1, hi - lo).alias("tokens"))
    cut = cut.select("source", "block", piece.alias("piece"))
    # a block holds ``length`` tokens, so its list is bounded
    out = cut.groupBy("source", "block").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return out.withColumn("n_tokens", F.aggregate("pieces", F.lit(0), lambda a, p: a + F.size(p.tokens)))


def plan_size(blocks: dict[str, int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """Slots of the largest mix in which, with a margin for chance, no source needs more than its repeats allow."""
    best = math.inf
    for s, w in shares.items():
        if w <= 0:
            continue
        limit = blocks.get(s, 0) * max(0, repeats.get(s, 1))
        # w*n + 4*sqrt(w*(1-w)*n) <= limit
        b = 4 * math.sqrt(w * (1 - w))
        root = (-b + math.sqrt(b * b + 4 * w * limit)) / (2 * w)
        best = min(best, math.floor(root * root))
    return int(best) if best != math.inf else 0


def draw(spark, n_slots: int, shard_slots: int, shares: dict[str, float], seed: int, buckets: int = 64) -> DataFrame:
    """shard, source, n, first: multinomial source counts of each output shard and each source's running slot number."""
    names = sorted(s for s, w in shares.items() if w > 0)
    weights = np.array([shares[s] for s in names]) / sum(shares[s] for s in names)
    shards = -(-n_slots // shard_slots)

    def counts(batches):
        for b in batches:
            out = []
            for shard in b.id:
                size = min(shard_slots, n_slots - shard * shard_slots)
                got = np.random.Generator(np.random.PCG64([seed, int(shard)])).multinomial(size, weights)
                out += [(int(shard), s, int(c)) for s, c in zip(names, got)]
            yield pd.DataFrame(out, columns=["shard", "source", "n"])

    drawn = spark.range(shards).mapInPandas(counts, "shard long, source string, n long").withColumn("bucket",
        F.floor(F.col("shard") * buckets / max(shards, 1)))
    per = drawn.groupBy("source", "bucket").agg(F.sum("n").alias("t"))
    base = per.withColumn("base", F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).select("source", "bucket",
        "base")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    return drawn.withColumn("inner", before).join(base, ["source", "bucket"]).select("shard", "source", "n",
        (F.col("base") + F.col("inner")).alias("first"))


def mix(documents: DataFrame, sources: DataFrame, length: int = 256, shard_slots: int = 1024, seed: int = 42,
    tokenizer: str = TOKENIZER) -> DataFrame:
    """shard, slot, source, block, use, n_tokens, pieces: a mix of blocks in which each source has its target share.

    The texts of each source form blocks of ``length`` tokens. Every output shard draws its source counts from a
    multinomial of the target shares; the k-th slot of a source takes the block that a pseudorandom permutation of the
    source's block numbers, another for every pass, puts at place k. Each pass uses every block once, so no token is
    used more than max_repeats times, and small sources repeat evenly. The mix is as long as the source that runs out
    first allows (``plan_size``). A source that has no tokens, or may not be used, cannot take part: the others mix in
    proportion without it, and ``mix_shares`` reports what is missing. Blocks are joined to slots by their number.

    Sources are compared trimmed and in lower case; missing or unlisted ones have no share. Null and empty texts give
    no tokens; repeated rows are documents of their own; without documents or shares the result is empty."""
    spark = documents.sparkSession
    listed = {r.s: (float(r.share or 0), int(r.reps if r.reps is not None else 1)) for r in sources.select(
        F.lower(F.trim("source")).alias("s"), F.col("target_share").alias("share"),
            F.col("max_repeats").alias("reps")).where("s is not null").collect()}
    rows = documents.select("doc_id", F.lower(F.trim("source")).alias("source"),
        "text").where(F.col("source").isin([s for s, (w, _) in listed.items() if w > 0]))
    ids = materialize(token_ids(rows.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "source", "text_hash"],
        path=tokenizer).withColumn("row", F.monotonically_increasing_id()), "token-ids")
    # only repeated rows go by their number; for all others nothing depends on how files are split
    same = ["doc_id", "source", "text_hash"]
    twice = materialize(ids.groupBy(*same).agg(F.count("*").alias("copies")).where("copies > 1").select(*same, F.lit(True).alias("twice")),
        "repeated")
    rows = ids.join(twice, same, "left").withColumn("row", F.when(F.col("twice"), F.col("row")).otherwise(F.lit(0))).drop("twice")
    blocks = materialize(token_blocks(rows, length), "blocks")
    discard(ids, twice)
    # one number per listed source
    have = {r.source: r.n for r in blocks.groupBy("source").agg(F.count("*").alias("n")).collect()}
    repeats = {s: r for s, (_, r) in listed.items()}
    shares = {s: w for s, (w, _) in listed.items() if w > 0 and have.get(s, 0) * max(0, repeats[s]) > 0}
    shares = {s: w / sum(shares.values()) for s, w in shares.items()}
    n = plan_size(have, shares, repeats)
    while True:
        drawn = materialize(draw(spark, n, shard_slots, shares, seed), "draw")
        need = {r.source: r.n for r in drawn.groupBy("source").agg(F.sum("n").alias("n")).collect()}
        over = max([need[s] / max(1, have.get(s, 0) * repeats[s]) for s in need if need[s]], default=0)
        if over <= 1:
            break
        discard(drawn)
        n = max(0, min(n - 1, int(n / over)))

    def slots(batches):
        for b in batches:
            out = []
            for shard, source, count, first in zip(b.shard, b.source, b.n, b["first"]):
                if not count:
                    continue
                k = np.arange(first, first + count)
                size = have[source]
                name = int.from_bytes(hashlib.blake2b(source.encode(), digest_size=6).digest(), "big")
                use = k // size
                block = np.empty(len(k), dtype=np.int64)
                for u in np.unique(use):
                    here = use == u
                    block[here] = permute(k[here] % size, size, seed * 1_000_003 + name * 31 + int(u))
                out.append(pd.DataFrame({"shard": shard, "source": source, "block": block, "use": use.astype("int32")}))
            yield pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype=object) for c in ("shard", "source", "block", "use")})

    where = drawn.mapInPandas(slots, "shard long, source string, block long, use int")
    order = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("source", "block", "use", F.lit(seed)), "source", "block",
        "use")) - 1
    where = where.withColumn("slot", order)
    return where.join(blocks, ["source", "block"]).select("shard", "slot", "source", "block", "use", "n_tokens", "pieces")


def mix_shares(mixed: DataFrame, sources: DataFrame) -> DataFrame:
    """Per listed source: target share, tokens, the share reached, blocks used and the most uses of one block."""
    per = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("slots"), (F.max("use") + 1).alias("most_uses"))
    total = per.agg(F.sum("tokens").alias("total"))
    all_ = sources.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").join(per, "source",
        "left").crossJoin(F.broadcast(total))
    zero = F.lit(0)
    return all_.select("source", "target_share", "max_repeats", F.coalesce("tokens", zero).alias("tokens"),
        F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("share"), F.coalesce("slots", zero).alias("slots"),
            F.coalesce("most_uses", zero).alias("most_uses"),
        F.round(F.greatest(F.lit(0.0), F.col("target_share") - F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0))),
            6).alias("shortfall"))


def mix_faults(mixed: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source with a share what a right mix has: no block used more often than allowed or twice in one pass, every
    block full but the last of a source, its pieces as long as the block, and a share within what chance explains."""
    uses = mixed.groupBy("source", "block").agg(F.count("*").alias("n"), F.countDistinct("use").alias("passes"),
        F.first("n_tokens").alias("n_tokens"), F.max(F.aggregate("pieces", F.lit(0), lambda a, p: a + F.size(p.tokens))).alias("held"))
    full = F.max("n_tokens").over(Window.partitionBy("source"))
    last = F.max("block").over(Window.partitionBy("source"))
    per = uses.withColumn("full", full).withColumn("last", last).groupBy("source").agg(
        F.max("n").alias("most"), F.count_if(F.col("n") > F.col("passes")).alias("used_twice_in_a_pass"),
            F.count_if((F.col("n_tokens") < F.col("full")) & (F.col("block") < F.col("last"))).alias("short_blocks"),
        F.count_if(F.col("held") != F.col("n_tokens")).alias("pieces_wrong"), F.sum("n").alias("slots"))
    total = per.agg(F.sum("slots").alias("all"))
    listed = sources.where("target_share > 0").select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    rows = listed.join(per, "source").crossJoin(F.broadcast(total))
    p = F.col("target_share")
    far = F.abs(F.col("slots") / F.col("all") - p) > 4 * F.sqrt(p * (1 - p) / F.col("all")) + 1e-9
    return rows.select("source", (F.col("most") > F.col("max_repeats")).alias("too_often"), "used_twice_in_a_pass", "short_blocks",
        "pieces_wrong", far.alias("share_off"))
