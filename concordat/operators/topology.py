"""Which targets are production: all of them, unless every field matches an entry that says otherwise."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.errors import Refusal, Refused

FIELDS = ("host", "port", "system_identifier", "database")


@dataclass(frozen=True)
class Entry:
    host: str
    port: int
    system_identifier: str
    database: str
    production: bool


def _entry(given: object) -> Entry:
    keys = {"host": str, "port": int, "systemIdentifier": str, "database": str, "production": bool}
    if not isinstance(given, dict) or set(given) != set(keys) or any(type(given[k]) is not t for k, t in keys.items()):
        raise ValueError
    if not (given["host"] and given["database"] and 1 <= given["port"] <= 65535 and re.fullmatch("[0-9]+", given["systemIdentifier"])):
        raise ValueError
    return Entry(given["host"], given["port"], given["systemIdentifier"], given["database"], given["production"])


def load_topology(path: str) -> list[Entry]:
    try:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        if isinstance(given, dict):
            if set(given) != {"entries"}:
                raise ValueError
            given = given["entries"]
        if not isinstance(given, list):
            raise ValueError
        return [_entry(e) for e in given]
    except (OSError, ValueError):
        raise Refused(Refusal("topology-invalid")) from None


def confirmation(host: str, port: int, database: str) -> str:
    """What an operator has to type to write to a production target."""
    return f"{host}:{port}/{database}"


def is_production(host: str, port: int, system_identifier: str, database: str, entries: list[Entry] | None) -> bool:
    here = [e for e in entries or [] if (e.host, e.port, e.system_identifier, e.database) == (host, port, system_identifier, database)]
    return not here or any(e.production for e in here)


def production(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """The same for a frame of targets: adds ``production``."""
    known = entries.groupBy(*FIELDS).agg(F.bool_or("production").alias("listed"))
    return targets.join(known, list(FIELDS), "left").withColumn("production", F.coalesce("listed", F.lit(True))).drop("listed")
