"""Processing only new or changed records.

Records fall into partitions by key, so many that one holds some ten thousand; their number stays with the state. A partition's fingerprint is the number of its rows and the sum
of their hashes, which no order or file layout changes. A run recomputes the partitions whose fingerprint differs from
the stored one and replaces each by dynamic partition overwrite; the fingerprints follow after the results, so a run
that dies in between is repeated in full for those partitions and neither skips nor repeats a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_space
from ..session import discard, materialize, materialize_counted, path_exists


def _part(key: str, partitions: int):
    return F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit(""))), F.lit(partitions)).cast("int")


def fingerprints(rows: DataFrame, part: str = "part", hash_col: str = "row_hash") -> DataFrame:
    """Per partition the row count and the additive hash, exact as a decimal: combined before the shuffle."""
    return rows.groupBy(part).agg(F.count("*").alias("n_rows"), F.sum(F.col(hash_col).cast("decimal(20,0)")).alias("hash_sum"))


def last_processing(run_log: DataFrame, run_items: DataFrame) -> DataFrame:
    """key, last_hash: of each document the item with outcome done, of a succeeded run, with the latest finished_at
    (ties: the greatest item_id). Items without a document id are ignored; item columns of any other name are dropped."""
    good = run_log.where(F.col("status") == "succeeded").select("run_id").distinct()
    items = run_items.where((F.col("outcome") == "done") & F.col("document_id").isNotNull()).join(good, "run_id", "left_semi")
    last = F.max(F.struct(F.col("finished_at"), F.col("item_id"), F.lower(strip_space(F.col("content_hash"))).alias("h")))
    return items.groupBy(F.lower(strip_space(F.col("document_id"))).alias("key")).agg(last.alias("x")).select("key",
        F.col("x.h").alias("last_hash"))


def _pending(docs: DataFrame, items: DataFrame) -> DataFrame:
    joined = docs.where("not deleted").join(items, "key", "left")
    return joined.where(F.coalesce(F.col("sha") != F.col("last_hash"), F.lit(True))).select("doc_id", "part")


def _partitions(spark: SparkSession, seen: str, rows: int, size: int) -> int:
    """The number of partitions of the state, or for a new one as many as hold ``size`` rows each."""
    if path_exists(spark, seen):
        # one row per partition
        return spark.read.parquet(seen).count()
    return max(32, -(-rows // size))


def refresh(spark: SparkSession, documents: DataFrame, run_log: DataFrame, run_items: DataFrame, state: str,
    size: int = 20_000) -> DataFrame:
    """The doc_id of each document that the next run has to process; brings the state under ``state`` up to date.

    A document is due unless its status is deleted or the SHA-256 of its present text equals the content_hash of its
    last processing. A missing text counts as the empty one; a document without id was never processed; a missing hash
    equals none. Stored content_hash and updated_at of documents are not trusted: only the text decides. Repeated rows
    each come out. Empty tables give an empty result. A new state takes partitions of about ``size`` documents; what is
    written for one are the ids that are due, so a partition is small for the one task that writes it."""
    key = F.lower(strip_space(F.col("id")))
    docs = documents.select("doc_id", key.alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"),
        (F.coalesce(F.lower(F.trim("status")), F.lit("")) == "deleted").alias("deleted"))
    seen = f"{state}/fingerprints"
    hashed, found = materialize_counted(docs.withColumn("row_hash", F.xxhash64("doc_id", "key", "sha", "deleted")), "docs",
        n=F.count(F.lit(1)))
    partitions = _partitions(spark, seen, found["n"], size)
    docs = hashed.withColumn("part", _part("key", partitions))
    items = last_processing(run_log, run_items)
    items = materialize(items.withColumn("part", _part("key", partitions)).withColumn("row_hash", F.xxhash64("key", "last_hash")), "items")

    now = fingerprints(docs).select("part", F.col("n_rows").alias("doc_rows"), F.col("hash_sum").alias("doc_hash"))
    now = now.join(fingerprints(items).select("part", F.col("n_rows").alias("item_rows"), F.col("hash_sum").alias("item_hash")), "part",
        "full")
    every = spark.range(partitions).select(F.col("id").cast("int").alias("part"))
    # one row per partition of the state, also for those that lost their last row
    now = materialize(every.join(now, "part", "left"), "fingerprints")
    changed = now
    if path_exists(spark, seen):
        old = spark.read.parquet(seen).select("part", *[F.col(c).alias(f"old_{c}") for c in now.columns if c != "part"])
        same = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in now.columns if c != "part"]
        differs = ~(same[0] & same[1] & same[2] & same[3])
        changed = now.join(old.withColumn("known", F.lit(True)), "part", "left").where(F.col("known").isNull() | differs)
    changed = materialize(changed.select(*now.columns), "changed")

    # one number per ``size`` documents
    only = changed.select("part")
    due = _pending(docs.join(only, "part", "left_semi"), items.join(only, "part", "left_semi").drop("part", "row_hash"))
    # an empty row per partition lets the overwrite clear partitions that have nothing due any more
    rows = due.unionByName(changed.select(F.lit(None).cast("long").alias("doc_id"), "part"))
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{state}/due")
    changed.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(seen)
    discard(hashed, items, now, changed)
    return spark.read.schema("doc_id long, part int").parquet(f"{state}/due").where("doc_id is not null").select("doc_id")
