"""Spark-native typed-codec conversion, profiling, integrity checks and exact reconciliation.

The names below are the public interface; they are loaded when they are first asked for, so that workers
that need one module do not load all.
"""

from importlib import import_module

_PUBLIC = {
    "concordat.errors": ("OutcomeError", "Refusal", "Refused", "ToolkitError"),
    "concordat.manifest": ("ColumnSpec", "Manifest", "TableSpec", "load_manifest", "parse_manifest"),
    "concordat.sources.urls": ("PostgresConfig", "SSL_MODES", "SqliteConfig", "describe", "parse_database_url", "runtime_database_url"),
    "concordat.sources.connect": ("Store", "open_store", "open_store_from_environment"),
    "concordat.sources.sqlite": ("open_configured", "read_table"),
    "concordat.sources.snapshot": ("Snapshot", "take_snapshot"),
    "concordat.functions.codecs": ("canonical", "error", "to_loose", "to_strict"),
    "concordat.functions.encoding": ("row_digest", "table_digest", "tree_digest"),
    "concordat.operators.reconcile": ("canonical_frame", "codec_errors", "differences", "verified"),
    "concordat.operators.validation": ("validate",),
    "concordat.operators.schema_diff": ("schema_differences", "without_allowed"),
    "concordat.operators.catalog": ("Catalog", "gate_facts"),
    "concordat.plans.plan": ("Options", "Plan", "Target", "build_plan"),
    "concordat.plans.target": ("Identity", "read_identity", "read_target", "session_reader"),
    "concordat.plans.execute": ("Hooks", "Result", "execute", "execute_into"),
    "concordat.plans.reverse": ("ReverseHooks", "ReverseResult", "reverse"),
    "concordat.plans.export": ("ExportApp", "build_template", "export"),
    "concordat.plans.apps": ("folder_app", "journal_app"),
    "concordat.plans.pooling": ("PoolFiles", "PooledDatabase", "render_pool"),
    "concordat.plans.cli": ("export_main", "main"),
    "concordat.testing": ("dialects_from_env", "each_store", "open_test_store"),
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(_HOME[name]), name)
    raise AttributeError(f"module 'concordat' has no attribute {name!r}")
