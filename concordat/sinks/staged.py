"""Atomic publication of files: write aside, then put in place without ever replacing anything."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from concordat.errors import OutcomeError, Refusal, Refused

SIDECARS = ("-wal", "-shm", "-journal")


def _sync(path: str) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def publish_file(staged: str, target: str) -> None:
    """Hard-link a finished file to its name; refuses if the name or a sidecar of it is taken."""
    if any(os.path.lexists(target + s) for s in ("", *SIDECARS)):
        raise Refused(Refusal("sqlite-target-exists"))
    _sync(staged)
    try:
        os.link(staged, target)
    except FileExistsError:
        raise Refused(Refusal("sqlite-target-exists")) from None
    except OSError:
        raise Refused(Refusal("sqlite-write-failed")) from None
    _sync(os.path.dirname(os.path.abspath(target)))
    os.unlink(staged)


@dataclass
class Receipt:
    """What a run wrote: one digest for each table."""

    run_id: str
    started_at: str
    manifest_sha: str
    per_table: dict[str, dict] = field(default_factory=dict)
    source_sha256: str | None = None
    scheme: str = "concordat row encoding v1"

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if v is not None}, indent=2, sort_keys=True)


def write_receipt(receipt: Receipt, path: str) -> None:
    """A receipt file, never over another one."""
    staged = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(staged, "x", encoding="utf-8") as f:
            f.write(receipt.to_json())
            f.flush()
            os.fsync(f.fileno())
        os.link(staged, path)
    finally:
        with contextlib.suppress(OSError):
            os.unlink(staged)


class StagedFolder:
    """Tables written as Parquet into a folder aside; ``commit`` renames it to its name.

    The rename is the one moment of publication: before it the target is as it was. All of it goes through
    Hadoop's file system of the target, so the folder may be local or on a store that the executors share.
    On stores without an atomic rename of folders the moment is as long as the rename."""

    def __init__(self, spark: SparkSession, target: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.target = target.rstrip("/")
        self.staged = f"{self.target}.staged-{uuid.uuid4().hex}"
        self._files = self._path(self.target).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, table: str) -> str:
        path = f"{self.staged}/{table}.parquet"
        df.write.mode("error").parquet(path)
        return path

    def _there(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def _moved(self, source: str, target: str) -> bool:
        """Never into a folder that is there already, as Hadoop's rename would do."""
        return not self._there(target) and self._files.rename(self._path(source), self._path(target))

    def commit(self, run_id: str, truncate: bool = False) -> str:
        old = f"{self.target}.replaced-{run_id}"
        try:
            replaced = self._there(self.target)
            if replaced:
                if not truncate and len(self._files.listStatus(self._path(self.target))):
                    raise Refused(Refusal("target-not-empty"))
                if not self._moved(self.target, old):
                    raise OSError
            if not self._moved(self.staged, self.target):
                raise OSError
        except Refused:
            raise
        except Exception:
            raise OutcomeError(self._settled(old), run_id) from None
        return "committed"

    def _settled(self, old: str) -> str:
        """After a failed rename: the old folder is put back if the new one is not there."""
        try:
            if self._there(self.target):
                return "unknown" if self._there(old) else "aborted"
            return "aborted" if not self._there(old) or self._moved(old, self.target) else "unknown"
        except Exception:
            return "unknown"

    def abort(self) -> None:
        with contextlib.suppress(Exception):
            self._files.delete(self._path(self.staged), True)
