"""What a strict store says of itself: identity, columns and catalog, through one function that runs a query.

Every raw table is one query that leaves to the server what only it can do (rendering expressions and
types, asking for privileges) and nothing else; all joins are in ``operators.catalog``. The function that
runs the queries can be any: that of a session, or one that answers from a recorded catalog.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.errors import Refusal, Refused
from concordat.operators import catalog, gate
from concordat.plans.plan import Target
from concordat.sinks.database import Session
from concordat.sinks.jdbc import quoted

#: Runs a query on the strict store and gives its rows, whose columns are those of the schema text.
Read = Callable[[str, str], DataFrame]

#: Raw tables (fixed values): the relation, then for each column its type and, if it is not the column of that name, its expression.
RAW: dict[str, tuple[str, dict[str, tuple[str, str | None]]]] = {
    "pg_namespace": ("pg_catalog.pg_namespace x", {"oid": ("bigint", None), "nspname": ("string", None), "can_create": ("boolean", "pg_catalog.has_schema_privilege(x.oid, 'CREATE')")}),
    "pg_class": (
        "pg_catalog.pg_class x",
        {"oid": ("bigint", None), "relname": ("string", None), "relnamespace": ("bigint", None), "relkind": ("string", None), "relrowsecurity": ("boolean", None), "relispartition": ("boolean", None), "is_owner": ("boolean", "pg_catalog.pg_has_role(current_user, x.relowner, 'USAGE')")},
    ),
    "pg_inherits": ("pg_catalog.pg_inherits x", {"inhrelid": ("bigint", None), "inhparent": ("bigint", None)}),
    "pg_attribute": (
        "pg_catalog.pg_attribute x",
        {"attrelid": ("bigint", None), "attname": ("string", None), "attnum": ("int", None), "attnotnull": ("boolean", None), "attisdropped": ("boolean", None), "attgenerated": ("string", None), "atttypid": ("bigint", None), "formatted": ("string", "pg_catalog.format_type(x.atttypid, x.atttypmod)")},
    ),
    "pg_type": ("pg_catalog.pg_type x", {"oid": ("bigint", None), "typname": ("string", None), "typtype": ("string", None)}),
    "pg_constraint": (
        "pg_catalog.pg_constraint x",
        {"oid": ("bigint", None), "conname": ("string", None), "conrelid": ("bigint", None), "contypid": ("bigint", None), "contype": ("string", None), "conkey": ("array<int>", "x.conkey::int4[]"), "confrelid": ("bigint", None), "confkey": ("array<int>", "x.confkey::int4[]"), "conpfeqop": ("string", "x.conpfeqop::text"), "confdelsetcols": ("string", "x.confdelsetcols::text")}
        | {"definition": ("string", "pg_catalog.pg_get_constraintdef(x.oid)"), "convalidated": ("boolean", None), "conenforced": ("boolean", None)}
        | {c: ("string", None) for c in ("confupdtype", "confdeltype", "confmatchtype")}
        | {"condeferrable": ("boolean", None), "condeferred": ("boolean", None), "conindid": ("bigint", None), "has_comment": ("boolean", "pg_catalog.obj_description(x.oid, 'pg_constraint') is not null"), "tree": ("string", "x.conbin::text")},
    ),
    "pg_trigger": ("pg_catalog.pg_trigger x", {"tgname": ("string", None), "tgrelid": ("bigint", None), "tgisinternal": ("boolean", None)}),
    "pg_rewrite": ("pg_catalog.pg_rewrite x", {"rulename": ("string", None), "ev_class": ("bigint", None)}),
    "pg_event_trigger": ("pg_catalog.pg_event_trigger x", {"evtname": ("string", None), "evtenabled": ("string", None)}),
    "pg_publication": ("pg_catalog.pg_publication x", {"oid": ("bigint", None), "pubname": ("string", None), "puballtables": ("boolean", None)}),
    "pg_publication_namespace": ("pg_catalog.pg_publication_namespace x", {"pnpubid": ("bigint", None), "pnnspid": ("bigint", None)}),
    "pg_publication_tables": ("pg_catalog.pg_publication_tables x", {"pubname": ("string", None), "schemaname": ("string", None), "tablename": ("string", None)}),
    "pg_subscription": ("pg_catalog.pg_subscription x", {"subdbid": ("bigint", None)}),
    "pg_database": ("pg_catalog.pg_database x", {"oid": ("bigint", None), "datname": ("string", None), "can_create": ("boolean", "pg_catalog.has_database_privilege(x.oid, 'CREATE')")}),
    "pg_depend": (
        "pg_catalog.pg_depend x",
        {"classid": ("string", "replace(x.classid::regclass::text, 'pg_', '')"), "objid": ("bigint", None), "refclassid": ("string", "replace(x.refclassid::regclass::text, 'pg_', '')"), "refobjid": ("bigint", None), "refobjsubid": ("int", None), "deptype": ("string", None)},
    ),
    "pg_attrdef": ("pg_catalog.pg_attrdef x", {"oid": ("bigint", None), "adrelid": ("bigint", None), "adnum": ("int", None), "expr": ("string", "pg_catalog.pg_get_expr(x.adbin, x.adrelid)"), "tree": ("string", "x.adbin::text")}),
    "pg_sequence": ("pg_catalog.pg_sequence x", {c: ("bigint", None) for c in ("seqrelid", "seqstart", "seqincrement", "seqmin", "seqmax")} | {"seqcycle": ("boolean", None)}),
    "pg_index": ("pg_catalog.pg_index x", {"indexrelid": ("bigint", None), "indrelid": ("bigint", None), "exprs_tree": ("string", "x.indexprs::text"), "pred_tree": ("string", "x.indpred::text")}),
    "pg_proc": ("pg_catalog.pg_proc x", {"oid": ("bigint", None), "provolatile": ("string", None)}),
    "pg_stat_archiver": ("pg_catalog.pg_stat_archiver x", {"last_failed_time": ("timestamp", None), "last_archived_time": ("timestamp", None)}),
    "pg_replication_slots": (
        "pg_catalog.pg_replication_slots x",
        {"slot_name": ("string", None), "current_lsn": ("bigint", "pg_catalog.pg_wal_lsn_diff(pg_catalog.pg_current_wal_lsn(), '0/0')::bigint"), "restart_lsn": ("bigint", "pg_catalog.pg_wal_lsn_diff(x.restart_lsn, '0/0')::bigint")},
    ),
    "tables": ("information_schema.tables x", {c: ("string", None) for c in ("table_schema", "table_name", "table_type")}),
    "columns": ("information_schema.columns x", {c: ("string", None) for c in ("table_schema", "table_name", "column_name", "data_type", "is_generated")} | {c: ("int", None) for c in ("character_maximum_length", "ordinal_position")}),
}
#: How a column of each type is asked for, so that drivers give one type.
PLAIN = {"bigint": "x.{}::bigint", "int": "x.{}::int4", "string": "x.{}::text", "boolean": "x.{}", "timestamp": "x.{}"}
IDENTITY = """select (select c.system_identifier::text from pg_catalog.pg_control_system() c) as system_identifier, pg_catalog.current_database()::text as database,
 pg_catalog.inet_server_addr()::text as server_address, pg_catalog.inet_server_port() as server_port, pg_catalog.pg_is_in_recovery() as in_recovery,
 pg_catalog.current_setting('server_version') as server_version, pg_catalog.current_setting('server_version_num')::int4 as version_number"""


@dataclass(frozen=True)
class Identity:
    system_identifier: str
    database: str
    server_address: str | None
    server_port: int | None
    in_recovery: bool
    server_version: str
    version_number: int


IDENTITY_SCHEMA = "system_identifier string, database string, server_address string, server_port int, in_recovery boolean, server_version string, version_number int"


def session_reader(spark: SparkSession, session: Session) -> Read:
    """Queries within the transaction of a session, so that all answers are of one moment and of what its
    locks protect. Rows come as JSON, which the server writes."""

    def read(query: str, schema: str) -> DataFrame:
        rows = session.query(f"select row_to_json(q)::text from ({query}) q")
        return spark.createDataFrame(rows, "row string").select(F.inline(F.array(F.from_json("row", schema))))

    return read


def read_identity(read: Read) -> Identity:
    """Who answers. A store that cannot be reached is told from one that answers nonsense."""
    try:
        read("select 1 as one", "one int").first()
    except Exception:  # driver text may hold the URL
        raise Refused(Refusal("target-connect-failed")) from None
    try:
        return Identity(**read(IDENTITY, IDENTITY_SCHEMA).first().asDict())
    except Exception:
        raise Refused(Refusal("target-identity-unreadable")) from None


def asked_for(name: str, version: int) -> dict[str, str]:
    """The columns of a raw table that a server of this version has, with their types."""
    gates = catalog.GATED.get(name, {})
    return {c: kind for c, (kind, _) in RAW[name][1].items() if c not in gates or version >= gates[c][0]}


def raw_query(name: str, version: int) -> str | None:
    """The query of a raw table; None if the server's version lacks all of it."""
    relation, columns = RAW[name]
    lacks = catalog.GATED.get(name, {}).get(None)
    if lacks and version < lacks[0]:
        return None
    return f"select {', '.join(f'{columns[c][1] or PLAIN[kind].format(c)} as {c}' for c, kind in asked_for(name, version).items())} from {relation}"


def read_catalog(read: Read, identity: Identity, tables: Iterable[str], schema: str = "public", receipt: str = gate.RECEIPT_TABLE) -> catalog.Catalog:
    frames = {}
    for name in RAW:
        query, kinds = raw_query(name, identity.version_number), asked_for(name, identity.version_number)
        if query:
            df = read(query, ", ".join(f"{c} {kind}" for c, kind in kinds.items()))
            frames[name] = df.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    return catalog.Catalog(frames, schema, tuple(tables), identity.version_number, identity.database, tuple(receipt.split(".", 1)))


def non_empty_tables(read: Read, spark: SparkSession, schema: str, tables: Iterable[str]) -> DataFrame:
    """``(table)`` of those that have a row; each is asked for one."""
    parts = [f"select '{t.replace(chr(39), chr(39) * 2)}' as \"table\" where exists (select 1 from {quoted(schema)}.{quoted(t)})" for t in tables]
    return read(" union all ".join(parts), "table string") if parts else spark.createDataFrame([], "table string")


def sequence_states(read: Read, facts: Mapping[str, DataFrame]) -> dict[str, dict]:
    """What the sequences that copied tables own have issued: ``{table: {last_value, called, increment}}``."""
    copied = facts["tables"].select(F.col("oid").alias("table_oid"), F.col("name").alias("table"))
    owned = facts["sequence_refs"].filter("kind = 'owner'").join(copied, "table_oid").orderBy("sequence_oid").collect()
    if not owned:
        return {}
    parts = [f"select {k} as place, last_value::bigint as last_value, is_called as called from {quoted(r['schema'])}.{quoted(r['name'])}" for k, r in enumerate(owned)]
    found = {r["place"]: r for r in read(" union all ".join(parts), "place int, last_value bigint, called boolean").collect()}
    return {r["table"]: {"last_value": found[k]["last_value"], "called": found[k]["called"], "increment": r["increment"]} for k, r in enumerate(owned)}


def read_target(spark: SparkSession, host: str, port: int, tables: Iterable[str], read: Read, schema: str = "public", with_sequences: bool = False) -> Target:
    """Everything a plan asks of the strict side. A standby is not read any further. The way back also asks
    what sequences have issued."""
    names, identity = list(tables), read_identity(read)
    target = Target(host, port, identity.database, identity.system_identifier, in_recovery=identity.in_recovery, server_version=identity.server_version)
    if identity.in_recovery:
        return target
    try:
        facts = read_catalog(read, identity, names, schema)
        target.columns = [tuple(r) for r in catalog.introspected(facts).collect()]
        target.facts = catalog.gate_facts(facts)
        present = [r["name"] for r in target.facts["tables"].collect()]
        target.facts["non_empty_tables"] = non_empty_tables(read, spark, schema, present)
        target.foreign_keys = [r.asDict() for r in target.facts["foreign_keys"].collect()]
        if with_sequences:
            target.sequence_states = sequence_states(read, target.facts)
    except Refused:
        raise
    except Exception:
        raise Refused(Refusal("preflight-failed")) from None
    return target


def recorded(frames: Mapping[str, DataFrame], identity: Identity, filled: Iterable[str] = (), issued: Iterable[tuple] = ()) -> Read:
    """A reader that answers from frames: a catalog that was written down, or a test's."""
    queries = {raw_query(n, identity.version_number): n for n in RAW}
    spark = next(iter(frames.values())).sparkSession

    def read(query: str, schema: str) -> DataFrame:
        if query == IDENTITY:
            return spark.createDataFrame([tuple(vars(identity).values())], schema)
        if query in queries:
            return frames[queries[query]]
        if query.startswith("select 1 "):
            return spark.range(1).withColumnRenamed("id", "one")
        if "last_value" in query:
            return spark.createDataFrame([(k, *r) for k, r in enumerate(issued)], schema)
        return spark.createDataFrame([(t,) for t in filled if f"'{t}'" in query], "table string")

    return read
