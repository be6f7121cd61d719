"""File changes on the driver: path safety, backups, hash re-checks, all or nothing."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections import Counter
from datetime import UTC, datetime
from pathlib import Path, PurePosixPath

from ..functions.text import folded
from ..schemas import ENTITY_TYPES, PROTECTED_DIRS
from ..sources.sinks import write_atomic, write_report
from .notes import rewrite_links

PLAN_VERSION = 3
# The parts of a reconciliation plan.
PLAN_FIELDS = "version root status auto review skip diff summary unresolved protected created_from snapshot fingerprint".split()


class PlanError(ValueError):
    """The plan may not be applied; nothing was changed."""


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def fingerprint(plan: dict) -> str:
    return sha256(json.dumps({k: v for k, v in plan.items() if k != "fingerprint"}, sort_keys=True, ensure_ascii=False,
        separators=(",", ":"), default=str))


def sign(plan: dict) -> dict:
    return plan | {"fingerprint": fingerprint(plan)}


def safe_path(root: Path, relative: str) -> Path:
    """The path below ``root``, refusing absolute paths, ``..``, links on the way and protected folders."""
    p = PurePosixPath(relative)
    if not relative or p.is_absolute() or ".." in p.parts or "\\" in relative or p.suffix != ".md":
        raise PlanError(f"unsafe path: {relative!r}")
    if p.parts[0] in PROTECTED_DIRS or any(x.startswith(".") for x in p.parts):
        raise PlanError(f"protected path: {relative!r}")
    at = root
    for part in p.parts:
        at = at / part
        if at.is_symlink():
            raise PlanError(f"symbolic link: {relative!r}")
    return at


class Transaction:
    """Moves, rewrites and deletions that are undone together if one fails; every touched file is backed up."""

    def __init__(self, root: str | Path, backup: str | Path):
        self.root, self.backup = Path(root), Path(backup)
        if self.root.is_symlink() or not self.root.is_dir():
            raise PlanError("the vault root is no plain directory")
        self.operations: list[dict] = []
        self._undo: list = []

    def _keep(self, path: Path) -> str:
        rel = path.relative_to(self.root)
        to = self.backup / f"{len(self.operations):06d}" / rel
        to.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(path, to)
        return str(to)

    def write(self, relative: str, text: str) -> None:
        path = self.root / relative
        old = path.read_bytes()
        kept = self._keep(path)
        self._undo.append(lambda: path.write_bytes(old))
        write_atomic(path, text)
        self.operations.append({"operation": "wikilink_rewrite", "path": relative, "original_path": relative, "new_path": relative,
            "backup_path": kept, "original_hash": sha256(old), "new_hash": sha256(text)})

    def move(self, source: str, target: str, expected: str) -> None:
        a, b = safe_path(self.root, source), safe_path(self.root, target)
        if not a.is_file() or sha256(a.read_bytes()) != expected:
            raise PlanError(f"changed or missing: {source}")
        if b.exists():
            raise PlanError(f"target exists: {target}")
        kept = self._keep(a)
        b.parent.mkdir(parents=True, exist_ok=True)
        self._undo.append(lambda: os.replace(b, a))
        os.replace(a, b)
        self.operations.append({"operation": "move", "path": target, "original_path": source, "new_path": target, "backup_path": kept,
            "original_hash": expected, "new_hash": expected})

    def delete(self, relative: str, expected: str) -> None:
        path = safe_path(self.root, relative)
        data = path.read_bytes() if path.is_file() else None
        if data is None or sha256(data) != expected:
            raise PlanError(f"changed or missing: {relative}")
        kept = self._keep(path)
        self._undo.append(lambda: path.write_bytes(data))
        path.unlink()
        self.operations.append({"operation": "delete", "path": relative, "original_path": relative, "new_path": "", "backup_path": kept,
            "original_hash": expected, "new_hash": ""})

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            for undo in reversed(self._undo):
                undo()
        elif self.operations:
            write_report(self.backup / "manifest.json", {"operations": self.operations, "created_at": datetime.now(UTC).isoformat()})


def notes(root: Path) -> list[Path]:
    return sorted(p for p in root.rglob("*.md") if p.is_file() and not p.is_symlink() and not any(
        x.startswith(".") for x in p.relative_to(root).parts))


def _rewrite_all(tx: Transaction, to: dict[str, str]) -> None:
    for p in notes(tx.root):
        text = p.read_text(encoding="utf-8")
        new = rewrite_links(text, to)
        if new != text:
            tx.write(str(p.relative_to(tx.root)), new)


def normalize_vault(root: str, backup: str, apply: bool = False) -> dict:
    """Link targets rewritten to the canonical spelling of the one note they mean; a dry run by default."""
    base = Path(root)
    keys: dict[str, set[str]] = {}
    for p in notes(base):
        keys.setdefault(folded(p.stem) or "", set()).add(p.stem)
    to = {k: next(iter(v)) for k, v in keys.items() if k and len(v) == 1}
    changed = [str(p.relative_to(base)) for p in notes(base) if rewrite_links(t := p.read_text(encoding="utf-8"), to) != t]
    if apply and changed:
        with Transaction(root, backup) as tx:
            _rewrite_all(tx, to)
    return {"status": "APPLIED" if apply else "DRY_RUN", "changed": changed}


def _moves(root: str, backup: str, moves: list[dict], links: bool = True) -> list[dict]:
    targets = Counter(m["target"] for m in moves)
    if any(n > 1 for n in targets.values()) or len({m["source"] for m in moves}) < len(moves):
        raise PlanError("sources or targets repeat")
    with Transaction(root, backup) as tx:
        for m in moves:
            tx.move(m["source"], m["target"], m["file_hash"])
        if links:
            # a stem keeps its short link; a path in a link follows the note
            to = {folded(m["source"][:-3]) or "": m["target"][:-3] for m in moves}
            to |= {k: PurePosixPath(m["target"]).stem for m in moves if (k := folded(PurePosixPath(m["source"]).stem)) and PurePosixPath(
                m["source"]).stem != PurePosixPath(m["target"]).stem}
            _rewrite_all(tx, to)
        return tx.operations


def apply_organization(plan: dict, root: str, backup: str, apply: bool = False) -> dict:
    if plan.get("fingerprint") != fingerprint(plan) or str(plan.get("root")) != str(root):
        raise PlanError("fingerprint or root differs")
    auto = [m for m in plan.get("moves", []) if m.get("action") == "AUTO"]
    for m in auto:
        parts = PurePosixPath(m["target"]).parts
        if len(parts) != 3 or parts[1] not in ENTITY_TYPES or parts[1] != m["entity_type"]:
            raise PlanError(f"target is not canonical: {m['target']}")
    return {"status": "APPLIED", "operations": _moves(root, backup, auto)} if apply else {"status": "DRY_RUN", "moves": auto}


def apply_merges(plan: list[dict], root: str, backup: str, apply: bool = False) -> dict:
    """AUTO merges: links to duplicates go to the canonical note, duplicates are deleted after a hash check."""
    auto = [p for p in plan if p["action"] == "AUTO"]
    if not apply:
        return {"status": "DRY_RUN", "merges": auto}
    with Transaction(root, backup) as tx:
        to = {}
        for p in auto:
            for d in p["duplicates"]:
                to[folded(PurePosixPath(d["path"]).stem) or ""] = PurePosixPath(p["canonical"]).stem
        _rewrite_all(tx, to)
        touched = {o["path"]: o["new_hash"] for o in tx.operations}
        for p in auto:
            for d in p["duplicates"]:
                tx.delete(d["path"], touched.get(d["path"], d["hash"]))
        return {"status": "APPLIED", "operations": tx.operations}


# --- reconciliation of moved notes with the tables ----------------------------------------------------------------


def validate(plan: dict, root: str | None = None) -> list[str]:
    """What speaks against the plan; an empty list means it may be applied."""
    bad = [f"missing field {f}" for f in PLAN_FIELDS if f not in plan]
    if bad:
        return bad
    if plan["version"] != PLAN_VERSION:
        bad.append("version")
    if plan["fingerprint"] != fingerprint(plan):
        bad.append("fingerprint")
    for f, kind in (("auto", list), ("review", list), ("skip", list), ("diff", dict), ("summary", dict), ("unresolved", list)):
        if not isinstance(plan[f], kind):
            return [*bad, f"type of {f}"]
    if root is not None and str(plan["root"]) != str(root):
        bad.append("root differs")
    if plan["status"] == "CLEAN" and (plan["auto"] or plan["review"]):
        bad.append("clean plan with items")
    for item in plan["auto"]:
        if item.get("action") != "AUTO" or item.get("kind") != "moved" or len(str(item.get("hash", ""))) != 64 or not item.get(
            "document_id"):
            bad.append(f"shape of {item.get('source')}")
            continue
        if item.get("unresolved"):
            bad.append(f"unresolved: {item['source']}")
        for p in (item["source"], item["target"]):
            try:
                safe_path(Path("/nonexistent"), p)
            except PlanError as x:
                bad.append(str(x))
    for side in ("source", "target"):
        if any(n > 1 for n in Counter(i.get(side) for i in plan["auto"]).values()):
            bad.append(f"{side} repeats")
    counts = {"auto": len(plan["auto"]), "review": len(plan["review"]), "skip": len(plan["skip"])}
    if {k: plan["summary"].get(k) for k in counts} != counts:
        bad.append("summary counts")
    moved = {(m["path"], m["target"]) for m in plan["diff"].get("moved", [])}
    if any((i.get("source"), i.get("target")) not in moved for i in plan["auto"]):
        bad.append("item without a diff row")
    return bad


def make_plan(changes: list[dict], root: str, snapshot: str) -> dict:
    """The signed plan from classified changes (see ``plans.reconcile``)."""
    auto = [c for c in changes if c["action"] == "AUTO"]
    review = [c for c in changes if c["action"] == "REVIEW"]
    diff = {k: [c for c in changes if c["kind"] == k] for k in ("added", "deleted", "modified", "moved")}
    diff["moved"] = [{"path": c["source"], "target": c["target"], "hash": c["hash"]} for c in diff["moved"]]
    plan = {
        "version": PLAN_VERSION, "root": str(root), "status": "REVIEW" if review else "PLANNED" if auto else "CLEAN", "auto": auto,
            "review": review, "skip": [], "diff": diff,
        "summary": {"auto": len(auto), "review": len(review), "skip": 0}, "unresolved": [c for c in changes if c.get("unresolved")],
            "protected": PROTECTED_DIRS, "created_from": "snapshot", "snapshot": snapshot,
    }
    return sign(plan)


def apply_plan(plan: dict, root: str, backup: str, apply: bool = False) -> dict:
    """Moves of a valid plan. An invalid one is refused."""
    if bad := validate(plan, root):
        return {"status": "REFUSED", "reasons": bad, "applied": [], "skipped": []}
    moves = [{"source": i["source"], "target": i["target"], "file_hash": i["hash"]} for i in plan["auto"]]
    if not apply:
        return {"status": "DRY_RUN", "applied": [], "skipped": moves}
    operations = _moves(root, backup, moves)
    applied = [{"document_id": i["document_id"], "source": i["source"], "target": i["target"], "hash": i["hash"]} for i in plan["auto"]]
    return {"status": "APPLIED", "applied": applied, "skipped": [], "backup_manifest": str(Path(backup) / "manifest.json"),
        "operations": operations}


def verify_applied(result: dict, root: str) -> list[str]:
    """What the live files and the manifest say against an applied result; empty means verified."""
    if result.get("status") != "APPLIED" or result.get("skipped"):
        return ["not fully applied"]
    path = Path(result.get("backup_manifest", ""))
    if not path.is_file():
        return ["manifest missing"]
    done = json.loads(path.read_text(encoding="utf-8"))["operations"]
    moves = Counter((o["original_path"], o["new_path"], o["original_hash"]) for o in done if o["operation"] == "move")
    bad = [] if moves == Counter((a["source"], a["target"], a["hash"]) for a in result["applied"]) else ["manifest and result differ"]
    rewritten = {o["path"]: o["new_hash"] for o in done if o["operation"] == "wikilink_rewrite"}
    for a in result["applied"]:
        live = Path(root) / a["target"]
        want = rewritten.get(a["target"], a["hash"])
        if not live.is_file() or live.is_symlink() or sha256(live.read_bytes()) != want or (Path(root) / a["source"]).exists():
            bad.append(f"live file differs: {a['target']}")
    for o in done:
        if not o.get("backup_path") or not Path(o["backup_path"]).is_file() or sha256(Path(o["backup_path"]).read_bytes()) != o[
            "original_hash"]:
            bad.append(f"backup differs: {o['original_path']}")
    return bad
