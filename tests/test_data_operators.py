import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from kgloom.operators.incremental import refresh
from kgloom.operators.references import LINK_REFERENCES, Reference, name_key, orphan_counts, orphan_references
from kgloom.operators.skew import hot_keys, salted_join

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
D = lambda n: datetime(2024, 1, n)
DOCS = "doc_id long, id string, text string, status string, updated_at timestamp, part string, key string"
LOG, ITEMS = "run_id long, status string", "item_id long, run_id long, document_id string, content_hash string, outcome string, finished_at timestamp"


def frames(spark, docs, items):
    d = spark.createDataFrame([(*x, D(1), "clash", "clash") for x in docs], DOCS)
    log = spark.createDataFrame([(1, "succeeded"), (2, "failed"), (None, "succeeded")], LOG)
    return d, log, spark.createDataFrame(items, ITEMS)


def test_refresh_finds_what_is_due_and_only_changed_partitions(spark, rows, tmp_path):
    docs = [(1, "A", "one", "done"), (2, "b", "two", "done"), (3, "c", "x", "deleted"), (4, "d", None, None), (5, None, "q", "done"),
        (6, "e", "", "error"), (7, "f", "L" * 300_000, "done"), (1, "A", "one", "done")]
    items = [(1, 1, "a ", H("one").upper(), "done", D(5)), (2, 2, "b", H("two"), "done", D(9)), (3, 1, "b", H("old"), "done", D(2)),
        (4, 1, "b", H("two"), "error", D(8)), (5, 1, "e", H(""), "done", D(1)), (6, 1, "e", H("z"), "done", D(1)),
            (7, 1, "f", H("L" * 300_000), "done", None), (8, 1, None, None, "done", D(3))]
    state = str(tmp_path / "state")
    d, log, it = frames(spark, docs, items)
    # ties of finished_at go to the greatest item_id, so e is due; a missing text is the empty one and was never processed
    assert rows(refresh(spark, d, log, it, state, 4)) == [(2,), (4,), (5,), (6,)]
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert rows(refresh(spark, d, log, it, state, 4)) == [(2,), (4,), (5,), (6,)]
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == before
    it2 = it.unionByName(spark.createDataFrame([(9, 1, "B", H("two"), "done", D(11))], ITEMS))
    assert rows(refresh(spark, d, log, it2, state, 4)) == [(4,), (5,), (6,)]
    kept = [p for p in tmp_path.rglob("*.parquet") if p in before and p.stat().st_mtime_ns == before[p]]
    assert kept, "partitions that did not change are left alone"
    assert rows(refresh(spark, d.where("doc_id = 2"), log, it2, state, 4)) == []


def test_refresh_after_a_run_that_died_between_results_and_fingerprints(spark, rows, tmp_path):
    import shutil

    d, log, it = frames(spark, [(1, "a", "new", "done")], [(1, 1, "a", H("old"), "done", D(1))])
    state = tmp_path / "s"
    refresh(spark, d, log, it, str(state), 2).count()
    shutil.rmtree(state / "fingerprints")
    assert rows(refresh(spark, d, log, it, str(state), 2)) == [(1,)]


def test_refresh_of_empty_tables(spark, rows, tmp_path):
    d, log, it = frames(spark, [], [])
    assert rows(refresh(spark, d, log, it, str(tmp_path / "e"), 2)) == []


def link_tables(spark):
    return {
        "documents": spark.createDataFrame([("D1", D(1), "done"), ("d2", D(1), "Deleted"), ("d3", D(20), None), (None, D(1), "done")],
            "id string, created_at timestamp, status string"),
        "entities": spark.createDataFrame([(1, "Big  Name", D(3)), (2, "big name", D(1)), (3, "Lost", D(1)), (4, None, D(1))],
            "entity_id long, name string, created_at timestamp"),
        "vocabularies": spark.createDataFrame([("V1", D(1))], "id string, created_at timestamp"),
        "document_sources": spark.createDataFrame([(1, " d1 ", D(2)), (2, "d2", D(2)), (3, "d3", D(2)), (4, " ", D(2)), (5, "zz", None),
            (5, "zz", None)], "link_id long, document_id string, first_seen_at timestamp"),
        "entity_sources": spark.createDataFrame([(1, "Lost", "d2", D(2)), (2, "Big Name", "d1", D(2)), (3, "Big Name", "d2", D(2))],
            "link_id long, entity_name string, document_id string, recorded_at timestamp"),
        "document_entities": spark.createDataFrame([(i, "BIG name ", D(2)) for i in range(300)] + [(900, "lost", D(2)),
            (901, "nobody", D(2)), (902, None, D(2))], "link_id long, entity_name string, recorded_at timestamp"),
        "entity_vocabulary_links": spark.createDataFrame([(1, "Big Name", "v1", D(2)), (2, "x", "v9", D(2))],
            "link_id long, entity_name string, vocabulary_id string, recorded_at timestamp"),
    }


def test_orphans_direct(spark, rows):
    got = orphan_references(link_tables(spark))
    assert rows(got.select("ref_table", "link_id", "ref_month", "reason")) == [
        ("document_entities", 901, "2024-01", "missing"), ("document_sources", 2, "2024-01", "missing"),
            ("document_sources", 3, "2024-01", "late"), ("document_sources", 5, None, "missing"), ("document_sources", 5, None, "missing"),
        ("entity_sources", 1, "2024-01", "missing"), ("entity_sources", 3, "2024-01", "missing"),
            ("entity_vocabulary_links", 2, "2024-01", "missing")]
    assert sum(r.orphans for r in orphan_counts(got).collect()) == 8


def test_orphans_inherited(spark, rows):
    refs = LINK_REFERENCES + (Reference("entities", "entity_id", "name", "entity_sources", "entity_name", key=name_key, inherit_only=True),)
    got = orphan_references(link_tables(spark), refs).where("depth > 1")
    # Lost has only orphaned sources, Big Name still has a sound one; the link to Lost is lost with it
    assert rows(got.select("ref_table", "link_id", "depth")) == [("document_entities", 900, 3), ("entities", 3, 2)]


def test_orphans_down_a_chain_and_of_empty_tables(spark, rows):
    t = {"a": spark.createDataFrame([(1,)], "k long"), "b": spark.createDataFrame([(10, 1), (11, 2)], "k long, up long"),
        "c": spark.createDataFrame([(100, 10), (101, 11)], "k long, up long"),
            "d": spark.createDataFrame([(7, 101), (8, 100)], "k long, up long")}
    plain = lambda c: c.cast("string")
    refs = tuple(Reference(x, "k", "up", y, "k", key=plain) for x, y in (("b", "a"), ("c", "b"), ("d", "c")))
    assert rows(orphan_references(t, refs).select("ref_table", "link_id", "depth")) == [("b", 11, 1), ("c", 101, 2), ("d", 7, 3)]
    assert orphan_references({n: df.limit(0) for n, df in link_tables(spark).items()}).count() == 0


def test_salted_join_equals_join(spark, rows):
    left = spark.range(5000).select(F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k5", 3), ("none", 4)], "k string, v int")
    assert "hot" in hot_keys(left, "k")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = salted_join(left, right, "k", F.col("id"), how), left.join(right, "k", how)
        assert rows(a.select(*sorted(a.columns))) == rows(b.select(*sorted(b.columns))), how
