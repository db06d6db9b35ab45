"""Everything a move decides before it writes anything."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from concordat.errors import CODEC_REFUSALS, Refusal, Refused
from concordat.manifest import Manifest
from concordat.operators import gate, keys, profile, reconcile, sequences, topology, validation
from concordat.sources import sqlite


def whole(name: str, value: object, least: int = 1) -> None:
    """An option that has to be a whole number, and never a truth value in its place."""
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise Refused(Refusal("invalid-option", None, None, name))


def duration(name: str, value: object) -> None:
    """An option that has to be a finite number of seconds; what is not a number would wait for ever or not at all."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value < float("inf"):
        raise Refused(Refusal("invalid-option", None, None, name))


@dataclass
class Target:
    """The strict side: where it is, what it says of itself, its columns and its catalog facts."""

    host: str
    port: int
    database: str
    system_identifier: str
    columns: list[tuple] = field(default_factory=list)  # (table, column, type, generated, max_length)
    facts: dict[str, DataFrame] = field(default_factory=dict)
    foreign_keys: list[dict] = field(default_factory=list)
    in_recovery: bool = False
    server_version: str = ""
    sequence_states: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class Options:
    truncate: bool = False
    slot_bytes: int = gate.DEFAULT_SLOT_BYTES
    topology: tuple[topology.Entry, ...] | None = None
    confirm_production: str | None = None
    check_codecs: bool = True

    def __post_init__(self):
        whole("slot_bytes", self.slot_bytes, 0)


@dataclass
class Plan:
    ok: bool = False
    source: dict = field(default_factory=dict)
    target: dict | None = None
    tables: list[dict] = field(default_factory=list)
    skipped_tables: list[dict] = field(default_factory=list)
    foreign_keys: list[dict] = field(default_factory=list)
    incoming_references: list[dict] = field(default_factory=list)
    sequences: list[dict] = field(default_factory=list)
    refusals: list[Refusal] = field(default_factory=list)
    skipped_checks: list[dict] = field(default_factory=list)

    def done(self) -> Plan:
        self.ok = not self.refusals
        return self


def source_tables(spark: SparkSession, path: str, manifest: Manifest) -> dict[str, DataFrame]:
    present = sqlite.introspect(path)
    return {t: sqlite.read_table(spark, path, t) for t in manifest.tables if t in present}


def _target_part(spark: SparkSession, plan: Plan, manifest: Manifest, target: Target, options: Options, sides: list[tuple]) -> bool:
    """Identity, production and manifest; False if nothing further can be judged."""
    production = topology.is_production(target.host, target.port, target.system_identifier, target.database, list(options.topology or ()) if options.topology is not None else None)
    confirmation = topology.confirmation(target.host, target.port, target.database)
    plan.target = {"host": target.host, "port": target.port, "database": target.database, "system_identifier": target.system_identifier, "server_version": target.server_version, "in_recovery": target.in_recovery, "production": production, "confirmation": confirmation}
    if target.in_recovery:
        plan.refusals.append(Refusal("target-in-recovery"))
    if production and options.confirm_production != confirmation:
        plan.refusals.append(Refusal("production-unconfirmed"))
    if target.in_recovery:
        return False
    issues = validation.validate(spark, manifest, validation.sides_frame(spark, sides)).collect()
    plan.refusals += [Refusal("manifest-invalid", i["table"], i["column"], f"{i['side']}:{i['code']}") for i in issues]
    return not issues


def sides_of(path: str, target: Target) -> list[tuple]:
    rows = [("sqlite", t, c["name"], c["type"], c["generated"]) for t, cols in sqlite.introspect(path).items() for c in cols]
    return rows + [("postgres", t, c, kind, bool(generated)) for t, c, kind, generated, _ in target.columns]


def build_plan(spark: SparkSession, path: str, manifest: Manifest, target: Target, options: Options = Options(), source: dict | None = None) -> Plan:
    """All refusals of moving a loose file to a strict target. A standby and an invalid manifest stop early;
    otherwise every check runs and all that it finds is reported."""
    plan = Plan(source=source or {}, skipped_tables=[{"table": t, "reason": r} for t, r in manifest.skipped.items()])
    tables = source_tables(spark, path, manifest)
    sizes = {}
    for name, df in tables.items():
        sizes[name], found = profile.source_refusals(df, manifest.tables[name])
        plan.refusals += found
    plan.refusals += sqlite.foreign_keys_to_skipped(path, set(manifest.tables), set(manifest.skipped))
    if not _target_part(spark, plan, manifest, target, options, sides_of(path, target)):
        return plan.done()

    found = gate.in_order(gate.evaluate(spark, target.facts, manifest, truncate=options.truncate, slot_bytes=options.slot_bytes)).collect()
    plan.refusals += [Refusal(r["code"], r["table"], r["column"], r["object"]) for r in found]
    own = {fk["name"] for fk in target.foreign_keys if fk["table"] in manifest.tables}
    plan.foreign_keys = [fk for fk in target.foreign_keys if fk["name"] in own]
    plan.incoming_references = [fk for fk in target.foreign_keys if fk["name"] not in own]
    types = {(t, c): kind for t, c, kind, _, _ in target.columns}
    lengths = {(t, c): n for t, c, _, _, n in target.columns if n is not None}
    for name, df in tables.items():
        spec = manifest.tables[name]
        plan.refusals += profile.limit_refusals(df, spec, {c: k for (t, c), k in types.items() if t == name}, {c: n for (t, c), n in lengths.items() if t == name})
    orphans, skipped = keys.orphan_refusals(tables, manifest, plan.foreign_keys)
    plan.refusals += orphans
    plan.skipped_checks += skipped
    if options.check_codecs:
        for name, df in tables.items():
            for row in reconcile.codec_errors(df, manifest.tables[name], "loose").orderBy("column", "err").collect():
                plan.refusals.append(Refusal(CODEC_REFUSALS[row["err"]], name, row["column"]))
    filled = {r["table"] for r in target.facts["non_empty_tables"].collect()} if "non_empty_tables" in target.facts else set()
    plan.tables = [sizes[t] | {"target_non_empty": t in filled, "will_truncate": t in filled and options.truncate} for t in tables]
    plan.sequences = plan_sequences(spark, path, tables, manifest, target, plan.refusals)
    return plan.done()


def plan_sequences(spark: SparkSession, path: str, tables: dict[str, DataFrame], manifest: Manifest, target: Target, refusals: list[Refusal]) -> list[dict]:
    """Where each owned sequence of a copied table goes on after the load."""
    if "sequence_refs" not in target.facts or "tables" not in target.facts:
        return []
    from pyspark.sql import functions as F

    refs = target.facts["sequence_refs"]
    usable = sequences.classify(refs, target.facts["tables"].select("oid", "name")).filter("verdict = 'usable'")
    owned = usable.join(refs.filter("kind = 'owner'").drop("column"), "sequence_oid").collect()
    water = sqlite.high_waters(path)
    out = []
    for s in owned:
        if s["table"] not in tables:
            continue
        cell = F.col(s["column"])
        top = sequences.extremes(tables[s["table"]].select(cell["i"].alias("v")), "v").first()
        facts = spark.createDataFrame([(top["highest"], top["lowest"], water.get(s["table"]), s["increment"], s["min"], s["max"])], "highest bigint, lowest bigint, high_water bigint, increment bigint, min bigint, max bigint")
        row = sequences.restarts(facts).first()
        if not row["in_range"]:
            refusals.append(Refusal("sequence-out-of-range", s["table"], s["column"], s["object"]))
        out.append({"object": s["object"], "table": s["table"], "column": s["column"], "start": s["start"], "increment": s["increment"], "min": s["min"], "max": s["max"], "restart_with": row["restart_with"]})
    return sorted(out, key=lambda x: x["object"])
