"""Snapshots: an immutable copy of a loose store, with its hash, that nothing wrote to meanwhile."""

from __future__ import annotations

import hashlib
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from concordat.errors import Refusal, Refused
from concordat.sources.sqlite import connect


@dataclass(frozen=True)
class Snapshot:
    path: str
    sha256: str
    bytes: int

    def dispose(self) -> None:
        shutil.rmtree(os.path.dirname(self.path), ignore_errors=True)


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _stamp(path: str) -> tuple:
    info = os.stat(path)
    wal = f"{path}-wal"
    return info.st_size, info.st_mtime_ns, file_sha256(path), os.path.getsize(wal) if os.path.exists(wal) else 0


def _audit(path: str) -> None:
    db = connect(path)
    try:
        if db.execute("pragma integrity_check").fetchone()[0] != b"ok":
            raise Refused(Refusal("snapshot-integrity-failed"))
        if db.execute("pragma foreign_key_check").fetchone():
            raise Refused(Refusal("snapshot-foreign-key-violation"))
        if db.execute("pragma encoding").fetchone()[0] != b"UTF-8":
            raise Refused(Refusal("snapshot-not-utf8"))
    except sqlite3.DatabaseError:
        raise Refused(Refusal("snapshot-integrity-failed")) from None
    finally:
        db.close()


def take_snapshot(live: str, *, writers_stopped: bool, work_dir: str | None = None, copy_file: Callable[[str, str], object] = shutil.copyfile) -> Snapshot:
    """Checkpoint, hold the write lock, copy, and compare the live file's stamps before and after. The
    folder for the copy has to be one that executors see; ``copy_file`` is a seam."""
    if not writers_stopped:
        raise Refused(Refusal("writers-not-stopped"))
    if not os.path.isfile(live):
        raise Refused(Refusal("live-database-missing"))
    folder = tempfile.mkdtemp(prefix="snapshot-", dir=work_dir)
    copy = os.path.join(folder, "snapshot.db")
    db = sqlite3.connect(live, isolation_level=None, timeout=1)
    try:
        try:
            busy = db.execute("pragma wal_checkpoint(truncate)").fetchone()[0]
        except sqlite3.DatabaseError:
            raise Refused(Refusal("live-checkpoint-blocked")) from None
        if busy:
            raise Refused(Refusal("live-checkpoint-blocked"))
        try:
            db.execute("begin immediate")
        except sqlite3.OperationalError:
            raise Refused(Refusal("live-writer-active")) from None
        before = _stamp(live)
        try:
            copy_file(live, copy)
        except OSError:
            raise Refused(Refusal("snapshot-failed")) from None
        if _stamp(live) != before or file_sha256(copy) != before[2]:
            raise Refused(Refusal("live-changed-during-snapshot"))
        db.execute("rollback")
        _audit(copy)
        return Snapshot(copy, before[2], before[0])
    except BaseException:
        shutil.rmtree(folder, ignore_errors=True)
        raise
    finally:
        db.close()
