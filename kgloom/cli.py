"""Command line: python -m kgloom.cli COMMAND [--input F] [--db DIR] [--output DIR] ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .engine import Engine, Settings, TableStore, check, extract_generic, merge_entities, status
from .plans import reconcile
from .session import local_session
from .sources import readers, sinks
from .vault import notes, transactions

COMMANDS = [
    "status", "process", "retry-failed", "qa", "vault-audit", "vault-normalize", "entity-merge-plan", "entity-merge-apply",
        "vault-organization-plan", "vault-organization-apply",
    "db-reconcile-plan", "db-reconcile-verify", "db-reconcile-apply", "db-reconcile-result-verify", "db-reconcile-finalize", "maintenance",
]


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _process(engine: Engine, a) -> dict:
    rows = readers.ADAPTERS[a.source](a.input).load(engine.spark)
    if a.command == "retry-failed":
        return engine.retry_failed(rows if a.source != "jsonl" else extract_generic(rows), a.max_attempts, a.offset, a.limit)
    run = {"vocabulary": engine.run_vocabulary, "jsonl": engine.run_documents}.get(a.source, engine.run_processed)
    return run(rows, a.offset, a.limit)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kgloom")
    p.add_argument("command", choices=COMMANDS)
    for name, default in (("--input", ""), ("--db", Settings().state_path), ("--output", Settings().output_path),
        ("--snapshot", "snapshot"), ("--plan", "plan.json")):
        p.add_argument(name, default=default)
    p.add_argument("--source", choices=["jsonl", "enriched", "vocabulary", "music"], default="jsonl")
    for name, default in (("--offset", 0), ("--limit", 0), ("--max-attempts", 5)):
        p.add_argument(name, type=int, default=default)
    p.add_argument("--apply", action="store_true")
    a = p.parse_args(argv)
    spark = local_session()
    store = TableStore(spark, a.db)
    out: dict = {}
    failed = False
    vault = (lambda: readers.read_vault(spark, a.output))
    backup = str(Path(a.db) / "backup")
    if a.command == "status":
        out = status(store)
    elif a.command in ("process", "retry-failed"):
        out = _process(Engine(spark, Settings(a.db, a.output)), a)
    elif a.command == "qa":
        out = check(spark, store)
        failed = out["status"] == "FAIL"
    elif a.command in ("vault-audit", "maintenance"):
        if not Path(a.output).is_dir():
            print(json.dumps({"status": "FAIL", "errors": 1, "kinds": {"missing_root": 1}}, indent=2))
            return 1
        found = notes.audit(vault())
        by = {(r.severity, r.kind): r.n for r in found.groupBy("severity", "kind").agg(F.count("*").alias("n")).collect()}
        errors = sum(n for (s, _), n in by.items() if s == "error")
        out = {"status": "FAIL" if errors else "PASS", "errors": errors, "kinds": {k: n for (_, k), n in sorted(by.items())}}
        if a.command == "maintenance":
            e = notes.entity_files(vault())
            out["merges"] = {r.action: r.n for r in notes.merge_plan(e).groupBy("action").agg(F.count("*").alias("n")).collect()}
            out["consistency"] = {r[0]: r[1] for r in notes.consistency(e,
                *[store.read(n) for n in ("entities", "documents", "entity_aliases", "relations", "document_entities", "entity_sources")],
                    vault()).groupBy("class").count().collect()}
            out["status"] = "FAIL" if errors else "REVIEW" if out["merges"].get("REVIEW") else "PASS"
        failed = out["status"] == "FAIL"
    elif a.command == "vault-normalize":
        out = transactions.normalize_vault(a.output, backup, a.apply)
    elif a.command in ("entity-merge-plan", "entity-merge-apply"):
        plan = _rows(notes.merge_plan(notes.entity_files(vault())))
        if a.command == "entity-merge-plan":
            out = {"plan": plan}
            sinks.write_report(a.plan, out)
        else:
            root = Path(a.output)
            for x in plan:
                x["duplicates"] = [{"path": d, "hash": transactions.sha256((root / d).read_bytes())} for d in x["duplicates"].split(
                    ",") if d]
            out = transactions.apply_merges(plan, a.output, backup, a.apply)
            pairs = [(Path(d["path"]).stem, Path(x["canonical"]).stem, x["domain"],
                "exact_name") for x in plan if x["action"] == "AUTO" for d in x["duplicates"]]
            if a.apply and pairs:
                # the tables follow the vault, once all its files are in place
                mapping = spark.createDataFrame(pairs, "duplicate string, canonical string, entity_type string, reason string")
                out["table_merges"] = merge_entities(store, mapping)
    elif a.command == "vault-organization-plan":
        out = transactions.sign({"version": 1, "root": a.output, "moves": _rows(notes.organization_plan(vault()))})
        sinks.write_report(a.plan, out)
    elif a.command == "vault-organization-apply":
        out = transactions.apply_organization(json.loads(Path(a.plan).read_text()), a.output, backup, a.apply)
    elif a.command == "db-reconcile-plan":
        snap = readers.snapshot(vault())
        if not Path(a.snapshot).exists():
            snap.write.parquet(a.snapshot)
            out = {"status": "BASELINE"}
        else:
            files = vault()
            c = reconcile.classify(notes.diff(spark.read.parquet(a.snapshot), snap), store.read("documents"), files,
                notes.entity_files(files), *[store.read(n) for n in ("entity_aliases", "document_entities", "entities")])
            out = transactions.make_plan(_rows(c), a.output, a.snapshot)
            sinks.write_report(a.plan, out)
            if out["status"] == "CLEAN":
                # a pending change stays visible until it is finalized
                snap.write.mode("overwrite").parquet(a.snapshot)
    else:
        doc = json.loads(Path(a.plan).read_text())
        if a.command == "db-reconcile-verify":
            bad = transactions.validate(doc, a.output)
            out, failed = {"status": "FAIL" if bad else "VERIFIED", "reasons": bad}, bool(bad)
        elif a.command == "db-reconcile-apply":
            out = transactions.apply_plan(doc, a.output, backup, a.apply)
            sinks.write_report(Path(a.db) / "applied.json", out)
            failed = out["status"] == "REFUSED"
        else:
            done = json.loads((Path(a.db) / "applied.json").read_text())
            bad = transactions.verify_applied(done, a.output)
            out, failed = {"status": "FAIL" if bad else "VERIFIED", "reasons": bad}, bool(bad)
            if a.command == "db-reconcile-finalize" and not bad:
                rows = spark.createDataFrame([(x["document_id"], x["hash"], x["source"], x["target"],
                    done["backup_manifest"]) for x in done["applied"]],
                        "document_id string, content_hash string, old_path string, new_path string, manifest_path string").withColumn(
                            "verified_at", F.current_timestamp())
                table, wrong = reconcile.finalize(store.read("reconciliation_provenance"), rows, store.read("documents"))
                failed = not wrong.isEmpty()
                if not failed and a.apply:
                    store.commit({"reconciliation_provenance": table})
                    readers.snapshot(vault()).write.mode("overwrite").parquet(a.snapshot)
                out = {"status": "REVIEW" if failed else "FINALIZED" if a.apply else "DRY_RUN"}
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
