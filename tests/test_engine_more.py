"""Failures and retries, order over splits and batches, merges over all tables, model answers, remote vaults."""

import http.server
import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kgloom import cli, engine
from kgloom.operators import canonical, enrich, references, upsert
from kgloom.schemas import empty
from kgloom.sources import readers, sinks
from kgloom.vault import notes, remote


def record(i, **more):
    return {"id": i, "content": f"text {i}", "source": "s", "entities": [{"name": "N", "entity_type": "person"}]} | more


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_bad_records_fail_alone_and_are_retried(spark, tmp_path):
    store = engine.TableStore(spark, str(tmp_path / "db"))
    good = readers.read_enriched(spark, lines(tmp_path / "a.jsonl", [record("1"), record("2")]))
    bad = good.withColumn("source", F.when(F.col("id") == "2", " ").otherwise(F.col("source")))
    assert engine.ingest_enriched(spark, store, bad) == {"processed": 1, "skipped": 0, "errors": 1}
    assert engine.ingest_enriched(spark, store, bad) == {"processed": 0, "skipped": 1, "errors": 1}
    f = store.read("processing_failures").collect()
    assert [(r.document_id, r.attempts) for r in f] == [("2", 2)] and "invalid source identity" in f[0].last_error
    e = engine.Engine(spark, engine.Settings(str(tmp_path / "db"), str(tmp_path / "out")))
    got = e.retry_failed(good)
    assert got["processed"] == 1 and got["errors"] == 0 and store.read("processing_failures").count() == 0
    assert {r.status for r in store.read("documents").collect()} == {"done"}
    assert (tmp_path / "out/documents/2.md").exists() and (tmp_path / "out/_Knowledge Index.md").exists() and (
        tmp_path / "out/entities/_Entity Index.md").read_text().count("[[N]]") == 1
    # a document that fails later is marked
    assert engine.ingest_enriched(spark, store, bad.where("id = '2'"))["errors"] == 1
    assert {r.id: r.status for r in store.read("documents").collect()} == {"1": "done", "2": "error"}
    assert engine.refresh_bridges(store, str(tmp_path / "bridges.json"))["status"] == "OK" and (tmp_path / "bridges.json").exists()
    assert len(store.vacuum(keep=1)) > 0 and store.read("documents").count() == 2


def test_order_holds_over_many_splits(spark, tmp_path):
    for k in range(8):
        lines(tmp_path / f"in/{k}.jsonl", [record(f"{k}-{j}",
            entities=[{"name": n, "entity_type": "person", "aliases": ["Shared"]} for n in (f"A{k}", f"B{k}")]) for j in range(3)])
    rows = readers.read_enriched(spark, str(tmp_path / "in")).repartition(8)
    store = engine.TableStore(spark, str(tmp_path / "db"))
    assert engine.ingest_enriched(spark, store, rows)["processed"] == 24
    # the first in order of files and lines claims the alias
    assert [r.canonical_name for r in store.read("entity_aliases").where("alias = 'shared'").collect()] == ["A0"]
    with pytest.raises(readers.InputError, match="x.jsonl:3"):
        readers.read_documents(spark, lines(tmp_path / "x.jsonl",
            [{"id": "1", "title": "t", "content": "c"}, {"id": "3", "title": "t", "content": "c"}, {"id": "2"}]))


def test_stream_of_three_batches(spark, tmp_path):
    from kgloom.streaming.ingest import stream_enriched

    store = engine.TableStore(spark, str(tmp_path / "db"))
    for k in range(3):
        lines(tmp_path / f"in/{k}.json", [record(str(k), entities=[{"name": f"N{k}", "entity_type": "person", "aliases": ["Same"]}])])
        stream_enriched(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination(120)
    assert store.read("documents").count() == 3
    assert [r.canonical_name for r in store.read("entity_aliases").where("alias = 'same'").collect()] == ["N0"]


def test_endpoints_see_only_what_came_before(spark):
    e = "doc_seq int, seq int, document_id string, name string, entity_type string, canonical string, aliases array<string>"
    full = spark.createDataFrame([(1, 1, "d1", "Apple", "Organizations", "Apple", ["AP"]),
        (3, 3, "d3", "Apple", "Products", "Apple Pie", ["AP"])], e)
    ends = spark.createDataFrame([(d, "ap") for d in ("d0", "d2", "d4")], "document_id string, name string")
    reached = spark.createDataFrame([(f"d{i}", i) for i in range(5)], "document_id string, doc_seq int")
    got = canonical.resolve_endpoints_in_order(ends, full, empty(spark, "entities"), empty(spark, "entity_aliases"), reached)
    # unknown before, unique in between, ambiguous after
    assert sorted(tuple(r) for r in got.collect()) == [("d0", "ap", "ap"), ("d2", "ap", "Apple"), ("d4", "ap", "ap")]


def test_merges_reach_every_table(spark, tmp_path, rows):
    store = engine.TableStore(spark, str(tmp_path / "db"))
    recs = [record("1", entities=[{"name": "Old", "entity_type": "person", "confidence": 0.9},
        {"name": "New", "entity_type": "person", "confidence": 0.4}],
            relations=[{"source": "Old", "relation": "owns", "target": "Thing", "confidence": 0.7},
                {"source": "New", "relation": "owns", "target": "Thing", "confidence": 0.2}])]
    engine.ingest_enriched(spark, store, readers.read_enriched(spark, lines(tmp_path / "a.jsonl", recs)))
    kind = "duplicate string, canonical string, entity_type string, reason string"
    engine.verify_relations(store, spark.createDataFrame([("1", "Old", "owns", "Thing", "ev", "checked")],
        "document_id string, source_name string, relation string, target_name string, evidence_document_id string, status string"))
    assert engine.merge_entities(store, spark.createDataFrame(
        [("Old", "New", "People", "explicit"), ("Nobody", "New", "People", "explicit"), ("New", "New", "People", "explicit")], kind)) == 1
    assert rows(store.read("entities").select("name", "aliases", "confidence")) == [("New", ["Old"], 0.9)]
    assert rows(store.read("relations")) == [("New", "owns", "Thing", 0.7)] and rows(
        store.read("document_entities").select("entity_name", "confidence")) == [("New", 0.9)]
    assert store.read("relation_evidence").first().source_name == "New" and store.read("entity_sources").first().entity_name == "New"
    assert rows(store.read("entity_aliases").select("alias", "canonical_name")) == [("new", "New"), ("old", "New")]
    assert [(r.duplicate_name, r.reason) for r in store.read("entity_merge_log").collect()] == [("Old", "explicit")]
    with pytest.raises(Exception, match="invalid entity merge reason"):
        engine.merge_entities(store, spark.createDataFrame([("New", "X", "People", "guess")], kind))
    ring = spark.createDataFrame([("a", "b", "T", "explicit"), ("b", "c", "T", "explicit"), ("c", "a", "T", "explicit"),
        ("x", "a", "T", "explicit"), ("p", "q", "T", "explicit"), ("q", "r", "T", "explicit")], kind)
    there = spark.createDataFrame([(n, "T") for n in "abcxpqr"], "name string, entity_type string")
    # merges in a circle have no end; a chain leads to its last name
    assert rows(upsert.effective_merges(there, ring).select("duplicate", "canonical")) == [("p", "r"), ("q", "r")]


def test_model_answers(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def provider(title, content):
        if title == "boom":
            raise OSError("down")
        (calls / title).write_text("x")
        return "[1]" if title == "list" else {"summary": "s", "entities": [{"name": "Model Entity", "entity_type": "person"}]}

    docs = spark.createDataFrame([(i, t, t, "Alpha Beta was here", "src", "{}") for i, t in enumerate(["fine", "boom", "list"])],
        "seq long, id string, title string, content string, source string, metadata string")
    store = engine.TableStore(spark, str(tmp_path / "db"))
    got = engine.ingest_generic(spark, store, docs, provider, "m", wait=0.0)
    assert {k: got[k] for k in ("processed", "llm_calls", "cache_hits", "llm_fallbacks")} == {"processed": 3, "llm_calls": 3,
        "cache_hits": 0, "llm_fallbacks": 1}
    assert {r.entity_name for r in store.read("document_entities").where("document_id = 'fine'").collect()} == {"Model Entity"}
    assert {r.entity_name for r in store.read("document_entities").where("document_id in ('boom', 'list')").collect()} == {"Alpha Beta"}
    assert store.read("llm_cache").count() == 2 and engine.ingest_generic(spark, store, docs, provider, "m")["skipped"] == 3
    again = enrich.answers(docs, store.read("llm_cache"), provider, "m", wait=0.0)
    assert sorted((r.id, r.cached) for r in again.collect()) == [("boom", False), ("fine", True), ("list", True)]
    assert enrich.unfenced("```json\n{}\n```") == "{}"
    found = enrich.fetch_evidence(spark.createDataFrame([("a",), ("b",)], "document_id string"),
        lambda i: {"title": "T"} if i == "a" else None, "lib")
    engine.save_evidence(store, found)
    assert [(r.document_id, r.title) for r in store.read("evidence").collect()] == [("a", "T")]
    with pytest.raises(Exception, match="invalid evidence status"):
        engine.verify_relations(store, spark.createDataFrame([("1", "a", "r", "b", "e", "maybe")],
            "document_id string, source_name string, relation string, target_name string, evidence_document_id string, status string"))


def test_cascade_of_any_depth(spark):
    n = 70
    t = spark.createDataFrame([(i, f"k{i}", f"k{i - 1}" if i else "missing") for i in range(n)] + [(900, "x", "y"), (901, "y", "x")],
        "rid long, key string, up string")
    refs = (references.Reference("t", "rid", "up", "t", "key"),)
    got = {r.link_id: r.depth for r in references.orphan_references({"t": t}, refs).collect()}
    # a chain longer than any fixed depth ends, and a circle without a lost end is none
    assert got == {i: i + 1 for i in range(n)}


def test_index_files(spark, tmp_path):
    v = spark.createDataFrame([("1", "词", "ci", ["6"]), ("2", "书", None, ["7-9"]), ("3", "水", "", [])],
        "id string, word string, pinyin string, hsk_levels array<string>")
    done = sinks.write_index(sinks.vocabulary_index(v).unionByName(sinks.level_index(v)), str(tmp_path))
    assert done == ["vocabulary/HSK6/_Index.md", "vocabulary/HSK7-9/_Index.md", "vocabulary/_Vocabulary Index.md"]
    assert "- [[水]] — - — unclassified\n" in (tmp_path / done[2]).read_text() and "# HSK7-9 Vocabulary" in (tmp_path / done[1]).read_text()


def test_links_and_code():
    t = "`a\nb [[X]]` [[A]] \\\\`[[Y]]` \\`[[B]]\\` ``[[Z]] ` x`` [[C]]"
    assert [r for _, _, r in notes.wikilinks(t)] == ["A", "B", "C"]
    assert [r for _, _, r in notes.wikilinks("`open\n```\ncode\n```\n[[A]]` [[B]]")] == ["A", "B"]
    long = "[[L]] `c` " * 20_000
    assert len(notes.wikilinks(long)) == 20_000


class Server(http.server.BaseHTTPRequestHandler):
    files: dict = {}

    def _send(self, data: bytes, code: int = 200) -> None:
        self.send_response(code)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):  # noqa: N802
        p = self.path.removeprefix("/vault/").replace("%20", " ")
        if p in self.files:
            return self._send(self.files[p])
        names = sorted({k[len(p) :].split("/")[0] + ("/" if "/" in k[len(p) :] else "") for k in self.files if k.startswith(p)})
        self._send(json.dumps({"files": names}).encode())

    def do_PUT(self):  # noqa: N802
        self.files[self.path.removeprefix("/vault/").replace("%20", " ")] = self.rfile.read(int(self.headers["Content-Length"]))
        self._send(b"")

    def do_DELETE(self):  # noqa: N802
        del self.files[self.path.removeprefix("/vault/").replace("%20", " ")]
        self._send(b"")

    def log_message(self, *_):
        pass


def test_remote_vault(spark, tmp_path):
    Server.files = {"entities/People/Ann Lee.md": b"same", "entities/People/ann  lee.md": b"same", "index.md": b"[[ann  lee]]",
        ".hidden/x.md": b"no", "pic.png": b"no"}
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        api = remote.RestRemote(f"http://127.0.0.1:{s.server_port}", "key")
        store = engine.TableStore(spark, str(tmp_path / "db"))
        people = spark.createDataFrame([("Ann Lee", "People", [], 0.4), ("ann  lee", "People", [], 0.9)], store.read("entities").schema)
        store.commit({"entities": people})
        got = remote.reconcile(spark, api, store, tmp_path / "work", "backup")
        assert got["merges"] == "APPLIED" and got["table_merges"] == 1 and got["notes_after"] == 2
        assert Server.files["index.md"] == b"[[Ann Lee]]" and "entities/People/ann  lee.md" not in Server.files and any(
            k.startswith("backup/") for k in Server.files)
        assert [(r.name, r.confidence) for r in store.read("entities").collect()] == [("Ann Lee", 0.9)]
    finally:
        s.shutdown()
    local = remote.DirectoryRemote(tmp_path / "r")
    local.write("a.md", b"1")
    plan = spark.createDataFrame([("a.md", "delete", "wrong", None)], "path string, operation string, before string, after string")
    with pytest.raises(remote.ConflictError):
        remote.write_back(local, plan, tmp_path, "b")
    assert local.list_dir("") == ["a.md"]


def test_command_line(spark, tmp_path, capsys):
    run = lambda *a: cli.main([*a, "--db", str(tmp_path / "db"), "--output", str(tmp_path / "out"), "--snapshot", str(tmp_path / "snap"),
        "--plan", str(tmp_path / "plan.json")])
    assert run("vault-audit") == 1
    src = lines(tmp_path / "a.jsonl", [record("1", relations=[{"source": "N", "relation": "owns", "target": "M"}])])
    assert run("process", "--source", "enriched", "--input", src) == 0
    assert run("process", "--source", "enriched", "--input", src) == 0
    assert '"skipped": 1' in capsys.readouterr().out
    assert run("db-reconcile-plan") == 0 and run("db-reconcile-plan") == 0
    # a clean plan moves the snapshot on
    assert json.loads((tmp_path / "plan.json").read_text())["status"] == "CLEAN"
    (Path(tmp_path) / "out/documents/1.md").rename(tmp_path / "out/documents/one.md")
    assert run("db-reconcile-plan") == 0 and json.loads((tmp_path / "plan.json").read_text())["status"] == "REVIEW"
    assert run("entity-merge-apply", "--apply") == 0 and run("status") == 0
