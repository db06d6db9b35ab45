"""The codec manifest: what every table and column means, declared and never inferred."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from concordat.errors import ToolkitError

#: Options a codec takes, with their defaults. ``nullable`` (required) and ``generated`` go with all.
OPTIONS: dict[str, dict[str, object]] = {
    "text": {},
    "integer": {},
    "bigint": {},
    "real": {},
    "decimal-as-string": {"acceptSqliteNumeric": False},
    "boolean": {},
    "timestamp-iso": {"preserveText": True},
    "timestamp-epoch-s": {"preserveInteger": True, "acceptSqliteDatetimeText": False},
    "timestamp-epoch-ms": {"preserveInteger": True, "acceptSqliteDatetimeText": False},
    "json-text": {"preserveText": None, "pgType": None},
    "timestamp-naive": {},
    "date-text": {},
    "blob": {},
    "uuid-text": {},
}
JSON_TYPES = ("text", "json", "jsonb")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    codec: str
    nullable: bool
    generated: bool = False
    options: tuple[tuple[str, object], ...] = ()

    def option(self, name: str) -> object:
        return dict(self.options)[name]

    @property
    def json_type(self) -> str:
        """The strict type of a JSON column: named, or from whether the text is preserved."""
        return self.option("pgType") or ("jsonb" if self.option("preserveText") is False else "text")

    @property
    def strict_types(self) -> tuple[str, ...]:
        """Accepted types on the strict side, the preferred one first."""
        if self.codec == "timestamp-iso":
            return ("text",) if self.option("preserveText") else ("timestamp with time zone",)
        if self.codec.startswith("timestamp-epoch"):
            return ("bigint",) if self.option("preserveInteger") else ("timestamp with time zone",)
        if self.codec == "json-text":
            return (self.json_type,)
        return {
            "text": ("text", "character varying"),
            "integer": ("bigint", "integer", "smallint"),
            "bigint": ("bigint",),
            "real": ("double precision",),
            "decimal-as-string": ("numeric",),
            "boolean": ("boolean",),
            "timestamp-naive": ("timestamp without time zone",),
            "date-text": ("date",),
            "blob": ("bytea",),
            "uuid-text": ("uuid",),
        }[self.codec]

    @property
    def reorders(self) -> bool:
        """Whether the loose and the strict form sort differently, so the column cannot be a sort key."""
        if self.codec in ("decimal-as-string", "timestamp-naive"):
            return True
        if self.codec == "timestamp-iso":
            return not self.option("preserveText")
        return self.codec == "json-text" and self.json_type != "text"

    @property
    def reads_text(self) -> bool:
        return self.codec in ("text", "decimal-as-string", "timestamp-iso", "json-text", "timestamp-naive", "date-text", "uuid-text")


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...]

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def written(self) -> tuple[ColumnSpec, ...]:
        """Generated columns are verified, never written."""
        return tuple(c for c in self.columns if not c.generated)


@dataclass(frozen=True)
class Manifest:
    tables: dict[str, TableSpec]
    skipped: dict[str, str] = field(default_factory=dict)
    raw: str = ""

    @property
    def sha256(self) -> str:
        return hashlib.sha256(self.raw.encode()).hexdigest()


class _Issues(list):
    def add(self, path: str, message: str) -> None:
        self.append(f"{path}: {message}")


def _column(path: str, name: str, given: object, issues: _Issues) -> ColumnSpec | None:
    if not isinstance(given, Mapping) or given.get("codec") not in OPTIONS:
        issues.add(path, "unknown or missing codec")
        return None
    codec = given["codec"]
    known = OPTIONS[codec]
    before = len(issues)
    for key in given:
        if key not in known and key not in ("codec", "nullable", "generated"):
            issues.add(path, f'unrecognized option "{key}"')
    if not isinstance(given.get("nullable"), bool):
        issues.add(f"{path}.nullable", "is required and must be true or false")
    if not isinstance(given.get("generated", False), bool):
        issues.add(f"{path}.generated", "must be true or false")
    options = {k: given.get(k, v) for k, v in known.items()}
    for key, value in options.items():
        if key == "pgType":
            if value is not None and value not in JSON_TYPES:
                issues.add(f"{path}.pgType", "must be text, json or jsonb")
        elif not isinstance(value, bool) and not (value is None and known[key] is None):
            issues.add(f"{path}.{key}", "must be true or false")
    if options.get("acceptSqliteDatetimeText") and options.get("preserveInteger"):
        issues.add(f"{path}.acceptSqliteDatetimeText", "only makes sense with preserveInteger: false")
    if codec == "json-text" and options["pgType"] and options["preserveText"] is not None:
        if options["pgType"] != ("text" if options["preserveText"] else "jsonb"):
            issues.add(f"{path}.pgType", "disagrees with preserveText; declare only pgType")
    if len(issues) > before:
        return None
    return ColumnSpec(name, codec, given["nullable"], given.get("generated", False), tuple(options.items()))


def parse_manifest(given: object) -> Manifest:
    """Validate and normalise. All issues are reported at once, by path, without quoting a value."""
    issues = _Issues()
    tables: dict[str, TableSpec] = {}
    skipped: dict[str, str] = {}
    if not isinstance(given, Mapping) or set(given) - {"version", "tables"} or given.get("version") != 1 or isinstance(given.get("version"), bool) or not isinstance(given.get("tables"), Mapping):
        raise ToolkitError("INVALID_MANIFEST", "invalid codec manifest: (root): expected version 1 and tables, nothing else")
    for name, entry in given["tables"].items():
        path = f"tables.{name}"
        if not isinstance(entry, Mapping):
            issues.add(path, "expected an object")
        elif "copy" in entry:
            if set(entry) != {"copy", "reason"} or entry["copy"] is not False or not isinstance(entry["reason"], str) or not entry["reason"]:
                issues.add(path, "a skipped table is copy: false with a reason")
            else:
                skipped[name] = entry["reason"]
        elif set(entry) != {"columns", "primaryKey"} or not isinstance(entry["columns"], Mapping) or not isinstance(entry["primaryKey"], list):
            issues.add(path, "expected columns and primaryKey, nothing else")
        else:
            columns = [_column(f"{path}.columns.{c}", c, spec, issues) for c, spec in entry["columns"].items()]
            by_name = {c.name: c for c in columns if c}
            if not entry["primaryKey"]:
                issues.add(f"{path}.primaryKey", "needs at least one column")
            for key in entry["primaryKey"]:
                if key not in entry["columns"]:
                    issues.add(f"{path}.primaryKey", f'column "{key}" is not declared in columns')
                elif key in by_name and by_name[key].nullable:
                    issues.add(f"{path}.primaryKey", f'column "{key}" must not be nullable')
            tables[name] = TableSpec(name, tuple(by_name.values()), tuple(map(str, entry["primaryKey"])))
    if issues:
        raise ToolkitError("INVALID_MANIFEST", "invalid codec manifest: " + "; ".join(issues))
    return Manifest(tables, skipped, json.dumps(given, separators=(",", ":"), ensure_ascii=False))


def load_manifest(path: str) -> Manifest:
    try:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    except (OSError, ValueError):
        raise ToolkitError("INVALID_MANIFEST", "the manifest file is not readable JSON") from None
    return parse_manifest(given)
