"""A vault behind a remote interface: mirrored to a local folder, changed there, written back with a check that nobody
changed it meanwhile. Transport is the caller's: any object with the five methods of ``Remote`` will do."""

from __future__ import annotations

import hashlib
import json
import shutil
import urllib.parse
import urllib.request
from datetime import UTC, datetime
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import TableStore, merge_entities
from ..sources import readers
from . import notes, transactions


class Remote(Protocol):
    def list_dir(self, directory: str) -> list[str]:
        """Names in a directory; those of directories end with a slash."""

    def read(self, path: str) -> bytes: ...

    def write(self, path: str, data: bytes) -> None: ...

    def delete(self, path: str) -> None: ...

    def copy(self, source: str, target: str) -> None: ...


class ConflictError(RuntimeError):
    """A note changed on the other side while it was being worked on; nothing further is written."""


class DirectoryRemote:
    """A folder in the place of a service."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def list_dir(self, directory: str) -> list[str]:
        return sorted(p.name + ("/" if p.is_dir() else "") for p in (self.root / directory).iterdir())

    def read(self, path: str) -> bytes:
        return (self.root / path).read_bytes()

    def write(self, path: str, data: bytes) -> None:
        (self.root / path).parent.mkdir(parents=True, exist_ok=True)
        (self.root / path).write_bytes(data)

    def delete(self, path: str) -> None:
        (self.root / path).unlink()

    def copy(self, source: str, target: str) -> None:
        self.write(target, self.read(source))


class RestRemote:
    """The same over HTTP: GET lists a directory (``{"files": [...]}``) or gives a note, PUT writes, DELETE removes."""

    def __init__(self, url: str, key: str = "", timeout: float = 60.0):
        self.url, self.key, self.timeout = url.rstrip("/"), key, timeout

    def _ask(self, method: str, path: str, data: bytes | None = None) -> bytes:
        head = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        request = urllib.request.Request(f"{self.url}/vault/{urllib.parse.quote(path)}", data=data, method=method,
            headers=head | ({"Content-Type": "text/markdown"} if data is not None else {}))
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310 - the caller names the service
            return answer.read()

    def list_dir(self, directory: str) -> list[str]:
        return json.loads(self._ask("GET", f"{directory}/" if directory else ""))["files"]

    def read(self, path: str) -> bytes:
        return self._ask("GET", path)

    def write(self, path: str, data: bytes) -> None:
        self._ask("PUT", path, data)

    def delete(self, path: str) -> None:
        self._ask("DELETE", path)

    def copy(self, source: str, target: str) -> None:
        self.write(target, self.read(source))


def mirror(api: Remote, root: str | Path) -> dict[str, str]:
    """Copies all notes below the remote's root, hidden parts left out; path to SHA-256."""
    base, out, todo = Path(root), {}, [""]
    base.mkdir(parents=True, exist_ok=True)
    while todo:
        directory = todo.pop()
        for name in api.list_dir(directory):
            path = f"{directory}/{name}" if directory else name
            if name.startswith("."):
                continue
            if name.endswith("/"):
                todo.append(path.rstrip("/"))
            elif path.lower().endswith(".md"):
                data = api.read(path)
                (base / path).parent.mkdir(parents=True, exist_ok=True)
                (base / path).write_bytes(data)
                out[path] = hashlib.sha256(data).hexdigest()
    return out


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, operation (write or delete), before, after: what differs between two snapshots (path, hash), as one full
    outer join."""
    j = before.select("path", F.col("hash").alias("before")).join(after.select("path", F.col("hash").alias("after")), "path", "full")
    j = j.where(~F.col("before").eqNullSafe(F.col("after")))
    return j.select("path", F.when(F.col("after").isNull(), "delete").otherwise("write").alias("operation"), "before", "after")


def write_back(api: Remote, plan: DataFrame, root: str | Path, backup_root: str) -> list[dict]:
    """Writes the planned changes of the local folder to the remote, in order of path, each after a check that the
    remote note still is what was mirrored and with a copy of it under ``backup_root``."""
    stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    done = []
    for r in plan.orderBy("path").toLocalIterator():
        backup = None
        if r.before is not None:
            if hashlib.sha256(api.read(r.path)).hexdigest() != r.before:
                raise ConflictError(f"remote note changed meanwhile: {r.path}")
            backup = f"{backup_root}/{stamp}/{r.path}"
            api.copy(r.path, backup)
        if r.operation == "delete":
            api.delete(r.path)
        else:
            api.write(r.path, (Path(root) / r.path).read_bytes())
        done.append({"path": r.path, "operation": r.operation, "backup": backup})
    return done


def reconcile(spark: SparkSession, api: Remote, store: TableStore, work: str | Path, backup_root: str) -> dict:
    """Mirror, audit, normalize links, merge equal notes, write back, then merge the tables alike and audit again. The
    tables change only after every note is written."""
    root = Path(work) / "vault"
    mirrored = mirror(api, root)
    before = spark.createDataFrame([(p, h) for p, h in mirrored.items()], "path string, hash string")
    first = notes.audit(readers.read_vault(spark, str(root))).where("severity = 'error'").count()
    normalized = transactions.normalize_vault(str(root), str(Path(work) / "backup-links"), apply=True)
    plan = [r.asDict() for r in notes.merge_plan(notes.entity_files(readers.read_vault(spark, str(root)))).collect()]
    for x in plan:
        x["duplicates"] = [{"path": d, "hash": transactions.sha256((root / d).read_bytes())} for d in x["duplicates"].split(",") if d]
    merged = transactions.apply_merges(plan, str(root), str(Path(work) / "backup-merges"), apply=True)
    written = write_back(api, changes(before, readers.snapshot(readers.read_vault(spark, str(root)))), root, backup_root)
    pairs = [(Path(d["path"]).stem, Path(x["canonical"]).stem, x["domain"],
        "exact_name") for x in plan if x["action"] == "AUTO" for d in x["duplicates"]]
    tables = merge_entities(store, spark.createDataFrame(pairs,
        "duplicate string, canonical string, entity_type string, reason string")) if pairs else 0
    shutil.rmtree(root)
    after = mirror(api, root)
    last = notes.audit(readers.read_vault(spark, str(root))).where("severity = 'error'").count()
    return {
        "status": "FAIL" if last else "PASS", "notes_before": len(mirrored),
            "notes_after": len([p for p in after if not p.startswith(backup_root.rstrip("/") + "/")]),
                "links_changed": len(normalized["changed"]),
        "merges": merged["status"], "remote_changes": written, "table_merges": tables, "errors_before": first, "errors_after": last,
    }
