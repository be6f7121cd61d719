import json
import os
from pathlib import Path

import pytest

from kgloom.plans import reconcile
from kgloom.sources import readers
from kgloom.vault import notes, transactions


def build(root: Path, files: dict[str, str]) -> Path:
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t, encoding="utf-8")
    return root


def test_links_outside_code():
    text = "[[A]] ![[E]] `[[B]]`\n```\n[[C]]\n```\n~~~~\n[[D]]\n~~~\n[[D2]]\n~~~~\n[[F#h|x]] \\`[[G]]\\`\n```\n[[H]]"
    assert [r for _, _, r in notes.wikilinks(text)] == ["A", "F#h|x", "G"]
    assert notes.rewrite_links("[[david  bowie#x|y]] `[[david bowie]]`",
        {"david bowie": "David Bowie"}) == "[[David Bowie#x|y]] `[[david bowie]]`"
    assert notes.front_matter("---\nname: 'X'\naliases: [a, \"b\"]\n---\n") == {"name": "X",
        "aliases": '[a, "b"]'} and notes.listed('[a, "b"]') == ["a", "b"]


def test_vault_scan_and_audit(spark, tmp_path):
    v = build(tmp_path / "v", {
        "entities/People/David Bowie.md": "---\nname: David Bowie\naliases: [Ziggy]\n---\n[[Nobody]] [[Ziggy]]",
            "entities/People/David  Bowie.md": "x", "entities/Companies/Apple.md": "[[entities/Foo/X]]",
        "index.md": "[[Apple]] [[apple]] [[Ziggy]]", ".obsidian/c.md": "no", "image.png": "no"})
    os.symlink(v / "index.md", v / "link.md")
    files = readers.read_vault(spark, str(v))
    assert sorted(r.path for r in files.collect()) == ["entities/Companies/Apple.md", "entities/People/David  Bowie.md",
        "entities/People/David Bowie.md", "index.md"]
    kinds = {(r.kind, r.relative) for r in notes.audit(files).collect()}
    for want in (("legacy_entity_domain", "entities/Companies/Apple.md"), ("unresolved_wikilink", "entities/People/David Bowie.md"),
        ("invalid_entity_domain_link", "entities/Companies/Apple.md"), ("noncanonical_wikilink", "index.md"),
            ("alias_wikilink", "index.md"), ("self_wikilink", "entities/People/David Bowie.md")):
        assert want in kinds, want
    assert any(k in ("duplicate_entity", "case_only_duplicate") for k, _ in kinds)
    plan = notes.merge_plan(notes.entity_files(files)).collect()
    assert [(p.action, p.canonical) for p in plan if p.reason != "alias_names_entity"] == [("REVIEW", "entities/People/David Bowie.md")]


def test_diff(spark, rows):
    s = "path string, hash string"
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "4")], s)
    b = spark.createDataFrame([("a", "1"), ("b", "9"), ("x", "3"), ("f", "4"), ("n", "5")], s)
    assert rows(notes.diff(a, b).select("change", "path", "target")) == [("added", "f", None), ("added", "n", None), ("deleted", "d", None),
        ("deleted", "e", None), ("modified", "b", None), ("moved", "c", "x")]


def test_organize(spark, tmp_path):
    v = build(tmp_path / "v", {"20_Entities/Companies/Acme.md": "a", "Notes/People/Bo.md": "---\ntype: Places\n---",
        "00_Inbox/People/Hid.md": "x"})
    got = {r.source: (r.action, r.target, r.reason) for r in notes.organization_plan(readers.read_vault(spark, str(v))).collect()}
    assert got == {"20_Entities/Companies/Acme.md": ("AUTO", "20_Entities/Organizations/Acme.md", "move"),
        "Notes/People/Bo.md": ("REVIEW", "20_Entities/People/Bo.md", "domain_conflict")}
    moves = [r.asDict() for r in notes.organization_plan(readers.read_vault(spark, str(v))).collect()]
    plan = transactions.sign({"version": 1, "root": str(v), "moves": moves})
    assert transactions.apply_organization(plan, str(v), str(tmp_path / "b"), apply=True)["status"] == "APPLIED"
    assert (v / "20_Entities/Organizations/Acme.md").exists() and (tmp_path / "b/manifest.json").exists()
    with pytest.raises(transactions.PlanError):
        transactions.apply_organization(plan | {"moves": []}, str(v), str(tmp_path / "b"))


def test_reconcile_end_to_end(spark, tmp_path):
    v = build(tmp_path / "v", {"People/New.md": "text [[Old]]", "other.md": "[[New]]"})
    h = transactions.sha256((v / "People/New.md").read_bytes())
    docs = spark.createDataFrame([("doc", h)], "id string, content_hash string")
    ch = spark.createDataFrame([("moved", "People/New.md", "20_Entities/People/Newer.md", h), ("added", "z.md", None, "q")],
        "change string, path string, target string, hash string")
    items = [r.asDict() for r in reconcile.classify(ch, docs).collect()]
    plan = transactions.make_plan(items, str(v), "snap")
    assert transactions.validate(plan, str(v)) == []
    assert transactions.validate(plan | {"root": "/x"}, str(v)) and transactions.apply_plan(plan | {"status": "CLEAN"}, str(v),
        "b")["status"] == "REFUSED"
    done = transactions.apply_plan(plan, str(v), str(tmp_path / "b"), apply=True)
    assert done["status"] == "APPLIED" and transactions.verify_applied(done, str(v)) == []
    assert (v / "other.md").read_text() == "[[Newer]]"
    assert transactions.apply_plan(plan, str(v), str(tmp_path / "b2"))["status"] == "DRY_RUN"
    with pytest.raises(transactions.PlanError):
        transactions.apply_plan(plan, str(v), str(tmp_path / "b2"), apply=True)
    (v / "20_Entities/People/Newer.md").write_text("changed")
    assert transactions.verify_applied(done, str(v))
    a = spark.createDataFrame([("doc", h, "o", "n", "m")],
        "document_id string, content_hash string, old_path string, new_path string, manifest_path string").selectExpr("*",
            "timestamp '2024-01-01' as verified_at")
    table, wrong = reconcile.finalize(a.limit(0), a, docs)
    assert table.count() == 1 and wrong.isEmpty()
    assert not reconcile.finalize(a.limit(0), a, docs.limit(0))[1].isEmpty()
    assert json.loads((tmp_path / "b/manifest.json").read_text())["operations"]


def test_unsafe_paths_are_refused():
    for p in ("/a.md", "../a.md", ".obsidian/a.md", "00_Inbox/a.md", "a.txt", ""):
        with pytest.raises(transactions.PlanError):
            transactions.safe_path(Path("/tmp"), p)
