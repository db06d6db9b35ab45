"""Command line.

    python -m concordat plan|dry-run|execute   move a SQLite file into a database or a folder of Parquet tables
    python -m concordat reverse                write a SQLite file from a database or such a folder
    python -m concordat pool plan|render       check or write the files of a connection pool

Database URLs come from the environment only: an argument would stay in process lists and histories.

Exit codes: 0 done, 1 refused or failed with the target unchanged, 2 wrong use, 3 (reverse, export) the file
is in place but a later step warned, 4 commit aborted, 5 outcome unknown: look before trying again.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable, Mapping
from dataclasses import asdict

from pyspark.sql import SparkSession

from concordat.errors import OutcomeError, Refusal, Refused, ToolkitError, to_refusal
from concordat.manifest import Manifest, load_manifest
from concordat.operators.gate import DEFAULT_SLOT_BYTES
from concordat.operators.topology import load_topology
from concordat.plans import render
from concordat.plans.execute import Hooks, execute, execute_into
from concordat.plans.export import ExportApp, build_template, export
from concordat.plans.plan import Options, Target, build_plan, duration
from concordat.plans.pooling import PooledDatabase, render_pool
from concordat.plans.reverse import ReverseResult, reverse
from concordat.plans.target import read_target, session_reader
from concordat.sinks import database, jdbc
from concordat.sources.connect import read_parquet, tls_options
from concordat.sources.snapshot import take_snapshot
from concordat.sources.urls import PostgresConfig, export_source_url, parse_database_url, read_env_file, scrubbed

TARGET_URL, SOURCE_URL = "CONCORDAT_TARGET_URL", "CONCORDAT_SOURCE_URL"
Say = Callable[[str], None]


def _say(text: str) -> None:
    print(text)


def _warn(text: str) -> None:
    print(text, file=sys.stderr)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="concordat", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--manifest", required=True)
    shared.add_argument("--topology")
    shared.add_argument("--confirm-production")
    shared.add_argument("--writers-stopped", action="store_true")
    shared.add_argument("--strict-facts", help="JSON: host, port, database, system_identifier, columns; in place of asking the database")
    shared.add_argument("--folder", help="Parquet tables in place of the database's")
    shared.add_argument("--receipt")
    shared.add_argument("--work-dir")
    shared.add_argument("--json", action="store_true")
    for name in ("plan", "dry-run", "execute"):
        one = commands.add_parser(name, parents=[shared])
        one.add_argument("--source", required=True, help="SQLite file")
        one.add_argument("--truncate", action="store_true")
        one.add_argument("--max-slot-bytes", type=int, default=DEFAULT_SLOT_BYTES)
        one.add_argument("--commit-poll-seconds", type=float, default=30.0)
    back = commands.add_parser("reverse", parents=[shared])
    back.add_argument("--to-sqlite", required=True)
    back.add_argument("--sqlite-template", required=True)
    back.add_argument("--dry-run", action="store_true")
    pool = commands.add_parser("pool")
    pool.add_argument("step", choices=("plan", "render"))
    pool.add_argument("--config", required=True)
    pool.add_argument("--output-dir")
    return p


def strict_config(env: Mapping[str, str], variable: str, side: str) -> PostgresConfig:
    """The strict store of an environment variable; every way of not being one has its code."""
    url = env.get(variable)
    if not url:
        raise Refused(Refusal(f"{side}-url-missing"))
    try:
        config = parse_database_url(url)
    except ToolkitError:
        raise Refused(Refusal(f"{side}-url-invalid")) from None
    if not isinstance(config, PostgresConfig):
        raise Refused(Refusal(f"{side}-not-postgres"))
    return config


def _recorded_target(path: str) -> Target:
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    given["columns"] = [tuple(c) for c in given.get("columns", [])]
    return Target(**given)


def _asked_target(spark: SparkSession, config: PostgresConfig, manifest: Manifest, with_sequences: bool = False) -> Target:
    session = database.JdbcSession.to(spark, config)
    try:
        session.execute("set transaction isolation level repeatable read, read only")
        return read_target(spark, config.host, config.port, manifest.tables, session_reader(spark, session), with_sequences=with_sequences)
    finally:
        session.close()


def _options(args: argparse.Namespace) -> Options:
    duration("commit-poll-seconds", args.commit_poll_seconds)
    return Options(truncate=args.truncate, slot_bytes=args.max_slot_bytes, topology=tuple(load_topology(args.topology)) if args.topology else None, confirm_production=args.confirm_production)


def _forward(args: argparse.Namespace, env: Mapping[str, str], spark: SparkSession, say: Say, warn: Say) -> int:
    options, manifest = _options(args), load_manifest(args.manifest)
    config = None if args.strict_facts else strict_config(env, TARGET_URL, "target")
    snapshot = take_snapshot(args.source, writers_stopped=args.writers_stopped, work_dir=args.work_dir)
    hooks = Hooks(on_progress=None if args.json else lambda step, table: warn(f"{step} {table}"))
    try:
        if config and args.command != "plan" and not args.folder:
            result = execute_into(spark, snapshot.path, manifest, config, options, dry_run=args.command == "dry-run", snapshot_sha256=snapshot.sha256, commit_poll_seconds=args.commit_poll_seconds, hooks=hooks)
            say(render.to_json(result) if args.json else render.result_text(result))
            return 0
        target = _asked_target(spark, config, manifest) if config else _recorded_target(args.strict_facts)
        if args.command == "plan":
            plan = build_plan(spark, snapshot.path, manifest, target, options, {"sha256": snapshot.sha256, "bytes": snapshot.bytes})
            say(render.to_json(plan) if args.json else render.plan_text(plan))
            return 0 if plan.ok else 1
        result = execute(spark, snapshot.path, manifest, target, args.folder, options, dry_run=args.command == "dry-run", snapshot_sha256=snapshot.sha256, receipt_path=args.receipt, hooks=hooks)
        say(render.to_json(result) if args.json else render.result_text(result))
        return 0
    finally:
        snapshot.dispose()


def _backward(args: argparse.Namespace, env: Mapping[str, str], spark: SparkSession, say: Say, warn: Say, run: Callable[..., ReverseResult]) -> int:
    manifest = load_manifest(args.manifest)
    config = None if args.strict_facts else strict_config(env, SOURCE_URL, "source")
    target = _asked_target(spark, config, manifest, True) if config else _recorded_target(args.strict_facts)
    tables = {t: read_parquet(spark, args.folder, t) for t in manifest.tables} if args.folder else jdbc.read_all(spark, manifest, config)
    result = run(spark, tables, manifest, target, args.sqlite_template, args.to_sqlite, sequences=target.sequence_states, dry_run=args.dry_run, receipt_path=args.receipt, work_dir=args.work_dir)
    say(render.to_json(result) if args.json else render.reverse_text(result))
    if result.warnings and not args.json:
        warn(f"IN PLACE WITH WARNINGS: {', '.join(result.warnings)}")
    return 3 if result.warnings else 0


def _pool(args: argparse.Namespace, env: Mapping[str, str], say: Say, warn: Say) -> int:
    """The files of a pool, into a new private folder; nothing of what may be secret is ever printed."""
    try:
        with open(args.config, encoding="utf-8") as f:
            given = json.load(f)
        names = {"name", "urlEnv", "poolSize", "reservePoolSize", "maxServerConnections", "mode"}
        known = {"serverConnectionBudget", "listenPort", "maxClientConnections", "authFile", "socketDirectory", "serverTlsCaFile", "databases"}
        if set(given) - known or any(set(d) - names for d in given["databases"]):
            raise ValueError
        snake = {"poolSize": "pool_size", "reservePoolSize": "reserve_pool_size", "maxServerConnections": "max_server_connections", "mode": "mode"}
        databases = [PooledDatabase(d["name"], env[d["urlEnv"]], **{snake[k]: v for k, v in d.items() if k in snake}) for d in given["databases"]]
        more = {"listenPort": "listen_port", "maxClientConnections": "max_client_connections", "authFile": "auth_file", "socketDirectory": "socket_directory", "serverTlsCaFile": "server_tls_ca_file"}
        files = render_pool(databases, given["serverConnectionBudget"], **{more[k]: v for k, v in given.items() if k in more})
        if args.step == "render":
            os.mkdir(args.output_dir, 0o700)  # a folder that is there already is refused
            for name, text in (("pgbouncer.ini", files.config), ("users.txt", files.auth), ("runtime.json", json.dumps(files.runtime_urls, indent=2))):
                with os.fdopen(os.open(os.path.join(args.output_dir, name), os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as f:
                    f.write(text)
        say(json.dumps({"status": "validated" if args.step == "plan" else "rendered", "databases": len(databases), "server_connection_cap": files.server_connection_cap}))
        return 0
    except Exception:
        warn("the pool could not be configured; check its file, the environment, the budget and the folder")
        return 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None, env: Mapping[str, str] | None = None, say: Say = _say, warn: Say = _warn, run_reverse: Callable[..., ReverseResult] = reverse) -> int:
    env = os.environ if env is None else env
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    if args.command == "pool":
        if args.step == "render" and not args.output_dir:
            warn("--output-dir is required")
            return 2
        return _pool(args, env, say, warn)
    if args.strict_facts and not args.folder and args.command != "plan":
        warn("--folder is required with --strict-facts")
        return 2
    try:
        spark = spark or SparkSession.builder.appName("concordat").getOrCreate()
        return _backward(args, env, spark, say, warn, run_reverse) if args.command == "reverse" else _forward(args, env, spark, say, warn)
    except OutcomeError as e:
        warn(json.dumps({"ok": False, "outcome": e.outcome, "run_id": e.run_id}) if args.json else str(e))
        return 4 if e.outcome == "aborted" else 5
    except ToolkitError as e:
        refusal = e.refusal if isinstance(e, Refused) else Refusal("manifest-invalid")
        warn(json.dumps({"ok": False, "refusals": [asdict(refusal)]}) if args.json else f"REFUSED {e if isinstance(e, Refused) else refusal}")
        return 1
    except Exception as e:
        refusal = to_refusal(e)
        warn(json.dumps({"ok": False, "refusals": [asdict(refusal)]}) if args.json else f"REFUSED {refusal}")
        return 1


# --- an application's own export command ---------------------------------------------------------


def export_main(
    argv: list[str],
    app: ExportApp,
    spark: SparkSession | None = None,
    env: Mapping[str, str] | None = None,
    say: Say = _say,
    warn: Say = _warn,
    *,
    url_variable: str = "DATABASE_URL",
    ca_variable: str | None = None,
    connect: Callable[..., tuple] | None = None,
) -> int:
    """``export-sqlite <out.db>`` and ``sqlite-template <path>`` for an application that brings an ``ExportApp``.
    ``connect`` is a seam: from a config to ``(tables, ledger, target)``."""
    env = os.environ if env is None else env
    p = argparse.ArgumentParser(prog="export")
    commands = p.add_subparsers(dest="command", required=True)
    out = commands.add_parser("export-sqlite")
    out.add_argument("path")
    out.add_argument("--writers-stopped", action="store_true")
    out.add_argument("--dry-run", action="store_true")
    out.add_argument("--confirm-production")
    out.add_argument("--env-file")
    commands.add_parser("sqlite-template").add_argument("path")
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    url = env.get(url_variable)
    try:
        if args.command == "sqlite-template":
            if os.path.lexists(args.path):
                raise Refused(Refusal("sqlite-target-exists"))
            say(json.dumps({"ok": True, "command": args.command, "template_rows_cleared": build_template(app, args.path)}))
            return 0
        ca = env.get(ca_variable) if ca_variable else None
        if args.env_file:  # then the file alone counts
            from_file = read_env_file(args.env_file)
            url, ca = from_file.get(url_variable), from_file.get(ca_variable) if ca_variable else None
        config = strict_config({url_variable: export_source_url(url or "")}, url_variable, "source")
        if not args.writers_stopped:
            raise Refused(Refusal("writers-not-stopped"))
        if ca_variable:
            tls_options(config.sslmode, ca)
        spark = spark or SparkSession.builder.appName("concordat").getOrCreate()
        manifest = app.reverse_manifest()
        if connect:
            tables, ledger, target = connect(spark, config, manifest)
        else:
            target = _asked_target(spark, config, manifest, True)
            tables = jdbc.read_all(spark, manifest, config)
            ledger = spark.read.format("jdbc").options(**config.jdbc, query=app.ledger_query).load()
        done = export(spark, app, tables, ledger, target, args.path, sequences=target.sequence_states, dry_run=args.dry_run)
        say(json.dumps({"ok": True, "command": args.command, "outcome": done.outcome, "path": done.path, "receipt_path": done.receipt_path, "tables": len(done.tables), "rows": done.totals.get("rows", 0), "sequences": done.sequences, "warnings": [scrubbed(w, url) for w in done.warnings]}))
        return 3 if done.warnings else 0
    except Exception as e:
        refusal = {"refusal": asdict(e.refusal)} if isinstance(e, Refused) else {}
        warn(json.dumps({"ok": False, "command": args.command, "error": scrubbed(str(e) if isinstance(e, ToolkitError) else str(to_refusal(e)), url)} | refusal))
        return 1
