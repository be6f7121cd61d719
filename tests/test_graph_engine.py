import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kgloom import engine
from kgloom.functions.text import folded
from kgloom.operators import canonical, graph, inference, qa, upsert, vocabulary
from kgloom.schemas import empty
from kgloom.sources import readers, sinks

E = "seq long, name string, entity_type string, aliases array<string>, confidence double"


def model(batch):
    """The sequential rule, record by record."""
    norm = lambda s: " ".join(s.strip().casefold().split())
    names, claims, out = {}, {}, []
    for seq, name, kind, aliases, _ in sorted(batch):
        to, spell = name, [name, *aliases]
        if (name, kind) not in names:
            hit = {claims[(norm(a), kind)] for a in spell if (norm(a), kind) in claims}
            keys = {folded(a) for a in spell} - {""}
            same = {n for n, k in names if k == kind and folded(n) in keys}
            other = {c for (a, k), c in claims.items() if k == kind and folded(a) in keys}
            for found in (hit, same, other):
                if found:
                    to = next(iter(found)) if len(found) == 1 else name
                    break
        names[(to, kind)] = True
        for a in [to, *aliases, *([name] if norm(name) != norm(to) else [])]:
            if norm(a):
                claims.setdefault((norm(a), kind), to)
        out.append((seq, to))
    return out


def test_resolution_matches_a_sequential_model(spark):
    random.seed(4)
    words = ["Apple", "apple", "Apple Inc.", "APPLE  inc", "Pear", "pear", "Pear-Co", "Fig", "ＦＩＧ", "Plum", "plum tree", "Kiwi"]
    batch = [(i, random.choice(words), random.choice(["Organizations", "Products"]), random.sample(words, random.choice([0, 0, 1, 2])),
        0.5) for i in range(120)]
    got = canonical.resolve_entities(spark.createDataFrame(batch, E), empty(spark, "entities"), empty(spark, "entity_aliases"))
    assert sorted((r.seq, r.canonical) for r in got.collect()) == model(batch)


def test_resolution_sees_the_old_state(spark):
    old = spark.createDataFrame([("David Bowie", "People", [], 1.0)],
        "name string, entity_type string, aliases array<string>, confidence double")
    claims = spark.createDataFrame([("ziggy", "David Bowie", "People")], "alias string, canonical_name string, entity_type string")
    b = spark.createDataFrame([(1, "david  bowie", "People", [], 0.4), (2, "Ziggy", "People", [], 0.9), (3, "Ziggy", "Products", [], 0.9)],
        E)
    assert sorted((r.seq, r.canonical) for r in canonical.resolve_entities(b, old, claims).collect()) == [(1, "David Bowie"),
        (2, "David Bowie"), (3, "Ziggy")]


def test_upserts(spark, rows):
    old = spark.createDataFrame([("a", "t", ["x"], 0.4)], "name string, entity_type string, aliases array<string>, confidence double")
    new = spark.createDataFrame([("a", "t", ["y", "a", " "], 0.8), ("b", "t", None, None)], old.schema)
    assert rows(upsert.merge_entities(old, new)) == [("a", "t", ["x", "y"], 0.8), ("b", "t", [], None)]
    s = "document_id string, source string, source_id string, metadata string, seen_at timestamp, seq long"
    at = datetime(2024, 1, 1)
    b = spark.createDataFrame([("doc-1", "Alpha", "e1", "{}", at, 1), ("doc-1", "alpha", "e1", "{1}", at, 2),
        ("doc-2", "alpha", "e1", "{}", at, 3)], s)
    own, lost = upsert.register_sources(empty(spark, "document_sources"), b)
    assert [(r.document_id, r.metadata) for r in own.collect()] == [("doc-1", "{1}")]
    assert [(r.document_id, r.existing_value, r.resolution) for r in lost.collect()] == [("doc-2", "doc-1", "review")]
    f = spark.createDataFrame([("d", f"e{i}", at, i) for i in range(7)], "document_id string, error string, at timestamp, seq long")
    q = upsert.record_failures(empty(spark, "processing_failures"), f)
    assert [(r.attempts, r.last_error) for r in q.collect()] == [(5, "e6")]
    assert upsert.retryable(q).count() == 0
    m = spark.createDataFrame([("dup", "can", "t")], "duplicate string, canonical string, entity_type string")
    e = spark.createDataFrame([("can", "t", [], 0.4), ("dup", "t", ["z"], 0.9), ("dup", "other", [], 0.1)], old.schema)
    assert rows(upsert.merge_entity_rows(e, m)) == [("can", "t", ["dup", "z"], 0.9), ("dup", "other", [], 0.1)]
    ln = spark.createDataFrame([("d", "can", "t", 0.4), ("d", "dup", "t", 0.8)],
        "document_id string, entity_name string, entity_type string, confidence double")
    assert rows(upsert.rewire(ln, m, "entity_name", ["document_id", "entity_name", "entity_type"], ["entity_type"])) == [
        ("d", "can", "t", 0.8)]


def test_vocabulary(spark, rows):
    v = spark.createDataFrame([("L1", "人工智能", None), ("L2", "人工", ""), ("L3", "a", None), ("L4", "AI", None), ("L5", "发发", None)],
        "id string, word string, traditional string")
    d = spark.createDataFrame([(1, "人工智能 and AI a 发发发"), (2, ""), (3, None)], "doc_id long, text string")
    assert rows(vocabulary.match_counts(d, v)) == [(1, "L1", 1), (1, "L2", 1), (1, "L5", 2)]
    assert {r.vocabulary_id for r in vocabulary.contains_links(d, v).collect()} == {"L1", "L2", "L3", "L4", "L5"}
    assert vocabulary.match_counts(d, v.limit(0)).count() == 0
    e = spark.createDataFrame([("AI", "Concepts"), ("ai", "Concepts")], "name string, entity_type string")
    assert rows(vocabulary.link_entities(e, v).select("entity_name", "vocabulary_id")) == [("AI", "L4")]


R = "source_name string, relation string, target_name string, confidence double"


def test_inference_numbers(spark, rows):
    rel = spark.createDataFrame([("A", "performed", "T", 1.0), ("T", "part_of", "L", 1.0)], R)
    doc = spark.createDataFrame([("d1", "A", "performed", "T", 1.0)], "document_id string, " + R)
    c = inference.relation_chains(rel, doc).collect()
    assert [(r.source_name, r.relation, r.target_name, r.confidence) for r in c] == [("A", "contributed_to", "L", 0.95)]
    legs = json.loads(c[0].provenance)
    assert [x["document_ids"] for x in legs] == [["d1"], []]
    assert inference.relation_chains(rel.where("relation = 'performed'"), doc).count() == 0
    de = spark.createDataFrame([("a1", "A", "People", 1.0), ("j1", "A", "People", 1.0)],
        "document_id string, entity_name string, entity_type string, confidence double")
    docs = spark.createDataFrame([("a1", "first"), ("j1", "tunes")], "id string, source string")
    dv = spark.createDataFrame([("a1", "v1", 0.9)], "document_id string, vocabulary_id string, confidence double")
    ents = spark.createDataFrame([("T", "MusicTracks")], "name string, entity_type string")
    dr = spark.createDataFrame([("j1", "A", "performed", "T", 1.0), ("j1", "T", "part_of", "L", 1.0)], "document_id string, " + R)
    assert [r.confidence for r in inference.same_document_links(de, docs, dv, "first").collect()] == [0.81]
    two = inference.three_way_links(de, docs, dv, dr, ents, "first", "tunes")
    assert rows(two.select("right_kind", "confidence")) == [("music_track", 0.729), ("vocabulary", 0.81)]
    assert [r.confidence for r in inference.album_links(two, rel, dr).collect()] == [0.69255]
    es = spark.createDataFrame([("A", "People", s, d) for s, d in (("a", "a2"), ("a", "a1"), ("j", "j1"), ("v", "v1"))],
        "entity_name string, entity_type string, source string, document_id string")
    b = inference.source_bridges(es)
    assert b.count() == 3 and b.where("source_a = 'a' and source_b = 'j'").first().documents_a == 2
    assert rows(inference.bridge_documents(es).where("source = 'a'").select("document_id")) == [("a1",), ("a2",)]
    assert rows(inference.bridge_pairs(es)) == [("a", "j", 1), ("a", "v", 1), ("j", "v", 1)]


def test_ambiguous_ends_make_no_edge(spark):
    e = spark.createDataFrame([("Apple", "Organizations", [], 1.0), ("Apple", "Products", [], 1.0), ("Jobs", "People", ["SJ"], 1.0),
        ("Pixar", "Organizations", [], 1.0)], "name string, entity_type string, aliases array<string>, confidence double")
    r = spark.createDataFrame([("Jobs", "runs", "Apple", 1.0), ("SJ", "owns", "Pixar", 0.5), ("Jobs", "owns", "Pixar", 0.7)], R)
    got = graph.relation_edges(r, graph.name_index(e, empty(spark, "entity_aliases"))).collect()
    assert [(x.source, x.relation, x.target, x.confidence) for x in got] == [("People:Jobs", "owns", "Organizations:Pixar", 0.7)]


def test_audit(spark):
    t = {n: empty(spark, n) for n in qa.REQUIRED}
    assert qa.audit(spark, t)["status"] == "PASS"
    t["relations"] = spark.createDataFrame([("a", "Bad Name", "a", 1.5)], R)
    t["results"] = spark.createDataFrame([("x", "{}")], "document_id string, payload string")
    rep = qa.audit(spark, t)
    assert rep["status"] == "FAIL" and set(rep["counts"]) == {"relation.orphan_endpoint", "relation.confidence_range", "relation.self_loop",
        "relation.invalid_name", "result.orphan"}
    assert qa.audit(spark, {})["findings"][0]["rule"] == "schema.required_tables"


def test_readers_and_engine(spark, tmp_path):
    doc = {"id": "1", "title": "T", "content": "Alpha Beta met Gamma. alpha", "metadata": {"a": 1}}
    p = tmp_path / "d.jsonl"
    p.write_text(json.dumps(doc) + "\n\n" + json.dumps(doc | {"id": "2"}) + "\n")
    d = readers.read_documents(spark, str(p))
    assert [r.source for r in d.collect()] == ["unknown", "unknown"]
    p2 = tmp_path / "bad.jsonl"
    p2.write_text(json.dumps(doc) + "\n" + json.dumps(doc) + "\n")
    with pytest.raises(readers.InputError, match="repeated id"):
        readers.read_documents(spark, str(p2))
    e = tmp_path / "e.jsonl"
    e.write_text(json.dumps({"id": "7", "content": "c", "entities": [
        {"name": " Apple Inc. ", "entity_type": "company", "confidence": 3, "aliases": ["Apple"]}, {"name": ""}],
            "relations": [{"source": "Apple", "relation": "owns", "target": "Beats"}]}) + "\n")
    en = readers.read_enriched(spark, str(e))
    r = en.first()
    assert [(x.name, x.entity_type, x.confidence) for x in r.entities] == [("Apple Inc.", "Organizations", 1.0)] and r.importance == 0.5
    c = tmp_path / "v.csv"
    c.write_text("﻿id,词,繁体,hsk_levels\nL6-1,挨着,挨著,6|7\n,书,,\n", encoding="utf-8")
    v = readers.read_vocabulary(spark, str(c)).collect()
    assert [(x.id, x.word, x.hsk_levels) for x in v] == [("L6-1", "挨着", ["6", "7"]), ("书", "书", [])]
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"tracks": [{"track_id": "t1", "title": "Song", "artists": "A, B", "album": "LP"}]}))
    t = readers.read_tracks(spark, str(m))
    assert [x.name for x in t.first().entities] == ["A", "B", "Song", "LP"] and len(t.first().relations) == 3

    store = engine.TableStore(spark, str(tmp_path / "db"))
    assert engine.ingest_generic(spark, store, d) == {"processed": 2, "skipped": 0, "errors": 0}
    assert engine.ingest_enriched(spark, store, en) == {"processed": 1, "skipped": 0, "errors": 0}
    assert engine.ingest_enriched(spark, store, en) == {"processed": 0, "skipped": 1, "errors": 0}
    assert engine.ingest_enriched(spark, store, t) == {"processed": 1, "skipped": 0, "errors": 0}
    assert [(x.source_name, x.target_name) for x in store.read("relations").where("relation = 'owns'").collect()] == [
        ("Apple Inc.", "Beats")]
    engine.ingest_vocabulary(spark, store, readers.read_vocabulary(spark, str(c)))
    engine.derive(store, "enriched", "music")
    assert {(x.source_name, x.target_name) for x in store.read("derived_relations").collect()} == {("A", "LP"), ("B", "LP")}
    engine.project(store, str(tmp_path / "out"))
    g = json.loads((tmp_path / "out/graph.json").read_text())
    assert g["schema_version"] == graph.SCHEMA_VERSION and any(x["kind"] == "derived" for x in g["edges"])
    assert (tmp_path / "out/entities/People/A.md").read_text().startswith("---\nname: \"A\"")
    assert engine.check(spark, store)["counts"].get("document_source.orphan") is None


def test_levels_and_file_names(spark, rows):
    df = spark.createDataFrame([(["HSK6"],), (["7-9"],), ([],), (None,)], "l array<string>")
    assert [tuple(r) for r in df.select(*[sinks.level_bucket(F.col("l"), w) for w in sinks.LEVELS.values()]).collect()] == [(True, False),
        (False, True), (False, False), (False, False)]
    n = spark.createDataFrame([("d", "a/b", "1"), ("d", "a:b", "2"), ("d", "c", "3")], "dir string, name string, text string")
    assert len({r.path for r in sinks.distinct_paths(n).collect()}) == 3


def test_stream(spark, tmp_path):
    from kgloom.streaming.ingest import stream_enriched

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"id": "s1", "content": "x",
        "entities": [{"name": "N", "entity_type": "person"}]}) + "\n")
    store = engine.TableStore(spark, str(tmp_path / "db"))
    q = stream_enriched(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [(r.entity_name, r.entity_type) for r in store.read("document_entities").collect()] == [("N", "People")]
