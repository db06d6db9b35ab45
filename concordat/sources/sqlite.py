"""SQLite files as a Spark data source, read as loose cells, and written as one.

Reading: every column is a loose cell, so storage classes and bytes arrive as they are stored, invalid
UTF-8 included. Partitions are ranges of rowid, and each opens the file read-only. The file has to be
on a path that all executors see.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from concordat.errors import Refusal, Refused
from concordat.functions.cells import CELL


CELL_FIELDS = ["cls", "i", "r", "raw"]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str, readonly: bool = True) -> sqlite3.Connection:
    if readonly:
        db = sqlite3.connect(f"file:{path.replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)
    else:
        db = sqlite3.connect(path)
    db.text_factory = bytes
    return db


def open_configured(path: str, busy_timeout_ms: int = 5000, readonly: bool = False) -> sqlite3.Connection:
    """A connection with WAL, foreign keys and a busy timeout, each read back to be sure it took."""
    db = connect(path, readonly)
    wanted = {"busy_timeout": busy_timeout_ms, "foreign_keys": 1}
    if not readonly and path != ":memory:":
        db.execute("pragma journal_mode = wal")
        wanted |= {"journal_mode": b"wal"}
    db.execute(f"pragma busy_timeout = {int(busy_timeout_ms)}")
    db.execute("pragma foreign_keys = on")
    for name, value in wanted.items():
        if db.execute(f"pragma {name}").fetchone()[0] != value:
            db.close()
            raise Refused(Refusal("snapshot-failed"))
    return db


@dataclass
class RowidRange(InputPartition):
    low: int | None
    high: int | None


class CellReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.table = options["path"], options["table"]
        self.rows_per_partition = int(options.get("rowsperpartition", 200_000))
        self.columns = [f.name for f in schema.fields]

    def partitions(self) -> list[RowidRange]:
        db = connect(self.path)
        try:
            low, high = db.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
            if low is None:
                return [RowidRange(0, -1)]
            n = db.execute(f"select count(*) from {quoted(self.table)}").fetchone()[0]
            if high - low >= 4 * n:  # few rows far apart: ranges end where rows are
                numbered = f"select rowid as at, row_number() over (order by rowid) - 1 as n from {quoted(self.table)}"
                lows = [r[0] for r in db.execute(f"select at from ({numbered}) where n % {self.rows_per_partition} = 0 order by at")]
            else:
                lows = list(range(low, high + 1, self.rows_per_partition))
        except sqlite3.OperationalError:  # a table without rowid is read in one piece
            return [RowidRange(None, None)]
        finally:
            db.close()
        return [RowidRange(a, b) for a, b in zip(lows, [*(x - 1 for x in lows[1:]), high])]

    def read(self, partition: RowidRange) -> Iterator[pa.RecordBatch]:
        parts = ", ".join(f"typeof({quoted(c)}), case when typeof({quoted(c)}) in ('text', 'blob') then cast({quoted(c)} as blob) else {quoted(c)} end" for c in self.columns)
        where = "" if partition.low is None else f" where rowid between {partition.low} and {partition.high}"
        db = connect(self.path)
        try:
            found = db.execute(f"select {parts} from {quoted(self.table)}{where}")
            while rows := found.fetchmany(4096):
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([_cells(columns[k], columns[k + 1]) for k in range(0, len(columns), 2)], names=self.columns)
        finally:
            db.close()


def _cells(classes: tuple, values: tuple) -> pa.Array:
    """Storage classes and stored values of one column as an array of cells."""
    classes = [c.decode() for c in classes]
    pairs = list(zip(classes, values))
    held = {
        "cls": pa.array(classes, pa.string()),
        "i": pa.array([v if c == "integer" else None for c, v in pairs], pa.int64()),
        "r": pa.array([v if c == "real" else None for c, v in pairs], pa.float64()),
        "raw": pa.array([v if c in ("text", "blob") else None for c, v in pairs], pa.binary()),
    }
    return pa.StructArray.from_arrays([held[n] for n in CELL_FIELDS], CELL_FIELDS)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_cells").option("path", ...).option("table", ...).schema(...)``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_cells"

    def schema(self) -> str:
        names = [c["name"] for c in introspect(self.options["path"])[self.options["table"]]]
        return ", ".join(f"`{n.replace('`', '``')}` {CELL}" for n in names)

    def reader(self, schema: StructType) -> CellReader:
        return CellReader({k.lower(): v for k, v in self.options.items()}, schema)


def read_table(spark: SparkSession, path: str, table: str, rows_per_partition: int = 200_000) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_cells").options(path=path, table=table, rowsPerPartition=rows_per_partition).load()


def introspect(path: str) -> dict[str, list[dict]]:
    """User tables with their columns ``(name, type, generated)``, in the order of their declaration."""
    db = connect(path)
    try:
        names = [r[0].decode() for r in db.execute(r"select name from sqlite_master where type = 'table' and name not like 'sqlite\_%' escape '\' order by name")]
        out = {}
        for name in names:
            rows = db.execute("select name, type, hidden from pragma_table_xinfo(?)", (name,)).fetchall()
            out[name] = [{"name": n.decode(), "type": t.decode(), "generated": hidden in (2, 3)} for n, t, hidden in rows if hidden != 1]
        return out
    finally:
        db.close()


def foreign_keys_to_skipped(path: str, copied: set[str], skipped: set[str]) -> list[Refusal]:
    """Keys that the loose schema declares between a copied and a skipped table, in either direction."""
    db = connect(path)
    found = []
    try:
        for name in introspect(path):
            if name not in copied | skipped:
                continue
            for (ref,) in db.execute('select "table" from pragma_foreign_key_list(?)', (name,)):
                ref = ref.decode()
                if name in copied and ref in skipped:
                    found.append(Refusal("foreign-key-to-skipped-table", name, None, f"{name}->{ref}"))
                if name in skipped and ref in copied:
                    found.append(Refusal("foreign-key-to-skipped-table", ref, None, f"{name}->{ref}"))
    finally:
        db.close()
    return found


def high_waters(path: str) -> dict[str, int]:
    """What AUTOINCREMENT tables have issued."""
    db = connect(path)
    try:
        if not db.execute("select 1 from sqlite_master where name = 'sqlite_sequence'").fetchone():
            return {}
        return {n.decode(): seq for n, seq in db.execute("select name, seq from sqlite_sequence")}
    finally:
        db.close()


def schema_model(path: str) -> list[tuple]:
    """Rows of the schema model (``operators.schema_diff``) for this side; classes are added by Spark."""
    from concordat.functions.expressions import check_signatures, index_signature, normalized

    db = connect(path)
    out: list[tuple] = []
    text = lambda x: None if x is None else (x.decode() if isinstance(x, bytes) else x)
    try:
        tables = db.execute(r"select name, sql from sqlite_master where type = 'table' and name not like 'sqlite\_%' escape '\' order by name").fetchall()
        for name, sql in ((text(a), text(b)) for a, b in tables):
            out.append(("sqlite", name, "table", name, name, None, None, None, None))
            columns = db.execute('select name, type, "notnull", dflt_value, pk, hidden from pragma_table_xinfo(?)', (name,)).fetchall()
            for c, kind, not_null, default, pk, hidden in columns:
                if hidden != 1:
                    out.append(("sqlite", name, "column", text(c), text(c), text(kind), None, bool(not_null or pk), hidden < 2 and default is not None))
            out.append(("sqlite", name, "primary-key", name, ",".join(text(c[0]) for c in sorted((c for c in columns if c[4]), key=lambda c: c[4])), None, None, None, None))
            for index, unique, origin in db.execute('select name, "unique", origin from pragma_index_list(?)', (name,)).fetchall():
                if text(origin) == "pk":
                    continue
                row = db.execute("select sql from sqlite_master where type = 'index' and name = ?", (text(index),)).fetchone()
                if row and row[0]:
                    found = index_signature(text(row[0]), unique == 1)
                else:
                    found = ("unique", ",".join(normalized(text(c)) for (c,) in db.execute("select name from pragma_index_info(?) order by seqno", (text(index),))))
                if found:
                    out.append(("sqlite", name, found[0], text(index), found[1], None, None, None, None))
            out += [("sqlite", name, "check", shown, signature, None, None, None, None) for signature, shown in check_signatures(sql or "").items()]
    finally:
        db.close()
    return out


def health(path: str) -> dict:
    """``{"ok": bool}``; never raises."""
    try:
        db = connect(path)
        try:
            return {"ok": db.execute("select 1").fetchone() == (1,)}
        finally:
            db.close()
    except (sqlite3.Error, OSError):
        return {"ok": False}


def exists(path: str) -> bool:
    return os.path.isfile(path)
