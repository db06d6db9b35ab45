"""Applications whose migrations are kept by an ORM, as export apps.

Two public layouts are known: a journal (``meta/_journal.json`` beside numbered SQL files, as Drizzle
keeps it) and a folder for each migration (as Prisma keeps it). In both the empty SQLite file is what the
SQLite migrations make of nothing, and the ids that the store's ledger has to hold are those of the strict
side's migrations.
"""

from __future__ import annotations

import hashlib
import json
import os
import sqlite3
import subprocess
from collections.abc import Callable, Mapping

from concordat.errors import ToolkitError
from concordat.plans.export import ExportApp
from concordat.sinks.jdbc import quoted

#: Between statements of a journal's SQL files (fixed value).
BREAKPOINT = "--> statement-breakpoint"


def _journal(folder: str) -> list[dict]:
    with open(os.path.join(folder, "meta", "_journal.json"), encoding="utf-8") as f:
        return json.load(f)["entries"]


def journal_app(
    manifest: dict,
    sqlite_folder: str,
    strict_folder: str,
    *,
    table: str = "__drizzle_migrations",
    schema: str = "drizzle",
    skip_tables: Mapping[str, str] | None = None,
    smoke: Callable[[str], None] | None = None,
) -> ExportApp:
    """Migrations of a journal. The ledger knows each by the time its entry carries."""

    def build(path: str) -> None:
        db = sqlite3.connect(path, isolation_level=None)
        try:
            db.execute("begin")
            db.execute(f"create table if not exists {quoted(table)} (id integer primary key autoincrement, hash text not null, created_at numeric)")
            for entry in _journal(sqlite_folder):
                with open(os.path.join(sqlite_folder, f"{entry['tag']}.sql"), encoding="utf-8") as f:
                    text = f.read()
                for statement in text.split(BREAKPOINT):
                    if statement.strip():
                        db.execute(statement)
                db.execute(f"insert into {quoted(table)} (hash, created_at) values (?, ?)", (hashlib.sha256(text.encode()).hexdigest(), entry["when"]))
            db.execute("commit")
        finally:
            db.close()

    return ExportApp(
        manifest,
        build,
        [str(e["when"]) for e in _journal(strict_folder)],
        {table: "ledger of migrations, one on each side"} | dict(skip_tables or {}),
        smoke,
        f"select created_at::text as id from {quoted(schema)}.{quoted(table)}",
    )


def _upwards(start: str, relative: str) -> str | None:
    at = os.path.abspath(start)
    while True:
        found = os.path.join(at, relative)
        if os.path.exists(found):
            return found
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def folder_app(
    manifest: dict,
    sqlite_schema: str,
    strict_folder: str,
    *,
    binary: str | None = None,
    url_variable: str = "DATABASE_URL",
    table: str = "_prisma_migrations",
    skip_tables: Mapping[str, str] | None = None,
    smoke: Callable[[str], None] | None = None,
) -> ExportApp:
    """Migrations that are folders with a ``migration.sql``. The empty file is made by the application's own tool."""

    def build(path: str) -> None:
        home = os.path.dirname(os.path.abspath(sqlite_schema))
        tool = binary or _upwards(home, os.path.join("node_modules", ".bin", "prisma"))
        if not tool:
            raise ToolkitError("INVALID_OPTIONS", "the migration tool was not found above the schema; name it")
        package = _upwards(home, "package.json")
        env = os.environ | {url_variable: f"file:{os.path.abspath(path)}", "PRISMA_HIDE_UPDATE_MESSAGE": "1", "CI": "1"}
        done = subprocess.run([tool, "migrate", "deploy", "--schema", os.path.abspath(sqlite_schema)], cwd=os.path.dirname(package) if package else home, env=env, capture_output=True, text=True)
        if done.returncode:
            tail = "\n".join(done.stderr.rstrip().split("\n")[-20:])
            raise ToolkitError("TEMPLATE_FAILED", f"the migrations of the SQLite template failed:\n{tail}")

    def finished() -> list[str]:
        return sorted(e.name for e in os.scandir(strict_folder) if e.is_dir() and os.path.exists(os.path.join(e.path, "migration.sql")))

    return ExportApp(
        manifest,
        build,
        finished(),
        {table: "ledger of migrations, one on each side"} | dict(skip_tables or {}),
        smoke,
        f"select migration_name as id from {quoted(table)} where finished_at is not null and rolled_back_at is null",
    )
