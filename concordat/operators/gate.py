"""The gate: every reason not to load, from facts and manifest, as rows in a fixed order.

Each rule is one statement over fact frames and gives ``(code, table, column, object)`` with the position
inside the rule; rules keep the order of the list. Facts are small, so the union of all rules is one
cheap job and reports everything at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.manifest import Manifest
from concordat.operators.sequences import classify

DEFAULT_SLOT_BYTES = 5 << 30
RECEIPT_TABLE = "concordat.receipt"
RECEIPT_COLUMNS = {"run_id": "uuid", "started_at": "timestamp with time zone", "manifest_sha": "text", "per_table": "jsonb"}
RECEIPT_KEY = ["run_id"]

#: Frames that the rules read, with their columns. Missing ones count as empty.
FRAMES = {
    "tables": "name string, oid bigint, kind string, row_security boolean, is_partition boolean, inherits boolean, has_children boolean, is_owner boolean",
    "columns": "table string, column string, not_null boolean",
    "primary_keys": "table string, columns array<string>",
    "triggers": "table string, name string",
    "rules": "table string, name string",
    "foreign_keys": "name string, table_oid bigint, table_schema string, table string, ref_oid bigint, ref_schema string, ref_table string, validated boolean, enforced boolean, has_comment boolean",
    "event_triggers": "name string",
    "publications": "publication string, table string",
    "subscriptions": "n bigint",
    "dynamic_sequence_defaults": "schema string, table string, column string",
    "volatile_expressions": "table string, object string",
    "sequence_refs": "sequence_oid bigint, schema string, name string, cycles boolean, kind string, table_oid bigint, column string",
    "adopting_publications": "publication string",
    "receipt": "exists boolean, kind string, is_owner boolean, row_security boolean, has_trigger boolean, has_rule boolean, published boolean, columns map<string,string>, primary_key array<string>, can_create boolean",
    "non_empty_tables": "table string",
    "archiver": "failing boolean",
    "slots": "name string, retained_bytes bigint",
}
MANIFEST_FRAMES = {
    "m_tables": "table string, primary_key array<string>",
    "m_columns": "table string, column string, nullable boolean, reorders boolean, in_key int",
    "m_skipped": "table string",
}

SHAPE = [
    # Per table, in the order the checks of one table are made.
    """select c.code, t.name as table, c.column, cast(null as string) as object, t.pos, c.sub from {tables} t left join {m_tables} m on m.table = t.name
         left join {primary_keys} k on k.table = t.name
         lateral view inline(array_compact(array(
           case when t.kind = 'p' then struct('partitioned-table' as code, cast(null as string) as column, 0 as sub)
                when t.is_partition or t.inherits or t.has_children then struct('inherited-table' as code, cast(null as string) as column, 0 as sub) end,
           case when t.row_security then struct('row-security-enabled' as code, cast(null as string) as column, 1 as sub) end,
           case when :owned and not t.is_owner then struct('not-owner' as code, cast(null as string) as column, 2 as sub) end,
           case when m.table is not null and coalesce(k.columns, array()) <> m.primary_key then struct('primary-key-mismatch' as code, cast(null as string) as column, 3 as sub) end))) c as code, column, sub
       union all
       select 'primary-key-order-unsupported', t.name, m.column, null, t.pos, 4 + m.in_key from {tables} t join {m_columns} m on m.table = t.name and m.in_key is not null and m.reorders""",
    """select 'nullability-mismatch' as code, c.table, c.column, cast(null as string) as object, c.pos, 0 as sub
         from {columns} c join {m_columns} m on m.table = c.table and m.column = c.column where m.nullable = c.not_null""",
    """select 'foreign-key-to-skipped-table' as code, case when own.oid is not null then f.table else f.ref_table end as table, cast(null as string) as column, f.name as object, f.pos, 0 as sub
         from {foreign_keys} f left join {tables} own on own.oid = f.table_oid left join {tables} ref on ref.oid = f.ref_oid
        where (own.oid is not null and f.ref_schema = :schema and f.ref_table in (select table from {m_skipped}))
           or (ref.oid is not null and f.table_schema = :schema and f.table in (select table from {m_skipped}) and not :skipped_may_refer)""",
]
WRITE = [
    "select 'trigger-present' as code, table, cast(null as string) as column, name as object, pos, 0 as sub from {triggers}",
    "select 'rule-present' as code, table, cast(null as string) as column, name as object, pos, 0 as sub from {rules}",
    """select 'foreign-key-not-valid' as code, concat(table_schema, '.', table) as table, cast(null as string) as column, name as object, pos, 0 as sub
         from {foreign_keys} where not (validated and enforced) and table_oid not in (select oid from {tables})""",
    """select c.code, f.table, cast(null as string) as column, f.name as object, f.pos, c.sub
         from {foreign_keys} f lateral view inline(array_compact(array(
           case when not (f.validated and f.enforced) then struct('foreign-key-not-valid' as code, 0 as sub) end,
           case when f.has_comment then struct('constraint-has-comment' as code, 1 as sub) end))) c as code, sub
        where f.table_oid in (select oid from {tables})""",
    """select 'incoming-reference-from-uncopied-table' as code, ref_table as table, cast(null as string) as column, concat(table_schema, '.', table, '.', name) as object, pos, 0 as sub
         from {foreign_keys} where :truncate and table_oid not in (select oid from {tables})""",
    "select 'event-trigger-present' as code, cast(null as string) as table, cast(null as string) as column, name as object, pos, 0 as sub from {event_triggers}",
    "select 'publication-covers-table' as code, table, cast(null as string) as column, publication as object, pos, 0 as sub from {publications}",
    "select 'subscription-present' as code, cast(null as string) as table, cast(null as string) as column, cast(null as string) as object, pos, 0 as sub from {subscriptions} where n > 0",
    """select 'sequence-dynamic-default' as code, case when schema = :schema then table else concat(schema, '.', table) end as table, column, cast(null as string) as object, pos, 0 as sub from {dynamic_sequence_defaults}""",
    "select 'volatile-expression' as code, table, cast(null as string) as column, object, pos, 0 as sub from {volatile_expressions}",
    "select verdict as code, table, column, object, pos, 0 as sub from {sequences} where verdict like 'sequence-%'",
    "select 'receipt-table-invalid' as code, :receipt_table as table, cast(null as string) as column, publication as object, pos, 0 as sub from {adopting_publications}",
    """select case when exists then 'receipt-table-invalid' else 'no-create-privilege' end as code, case when exists then :receipt_table end as table,
              cast(null as string) as column, case when not exists then split_part(:receipt_table, '.', 1) end as object, pos, 0 as sub
         from {receipt}
        where case when exists then not (kind = 'r' and is_owner and not row_security and not has_trigger and not has_rule and not published
                   and array_sort(map_entries(columns)) = array_sort(map_entries(:receipt_columns)) and primary_key = :receipt_key) else not can_create end""",
    "select 'target-not-empty' as code, table, cast(null as string) as column, cast(null as string) as object, pos, 0 as sub from {non_empty_tables} where not :truncate",
    "select 'archiver-failing' as code, cast(null as string) as table, cast(null as string) as column, cast(null as string) as object, pos, 0 as sub from {archiver} where failing",
    "select 'replication-slot-lag' as code, cast(null as string) as table, cast(null as string) as column, name as object, pos, 0 as sub from {slots} where retained_bytes > :slot_bytes",
]


def frame(spark: SparkSession, name: str, rows: list[tuple] = ()) -> DataFrame:
    """A fact frame from rows in their order."""
    schema = (FRAMES | MANIFEST_FRAMES)[name]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], f"{schema}, pos int")


def placed(df: DataFrame) -> DataFrame:
    """A fact frame that came from a query, with positions in its present order."""
    return df if "pos" in df.columns else df.withColumn("pos", F.monotonically_increasing_id())


def manifest_frames(spark: SparkSession, manifest: Manifest) -> dict[str, DataFrame]:
    columns = [(t.name, c.name, c.nullable, c.reorders, t.primary_key.index(c.name) if c.name in t.primary_key else None) for t in manifest.tables.values() for c in t.columns]
    return {
        "m_tables": frame(spark, "m_tables", [(t.name, list(t.primary_key)) for t in manifest.tables.values()]),
        "m_columns": frame(spark, "m_columns", columns),
        "m_skipped": frame(spark, "m_skipped", [(n,) for n in manifest.skipped]),
    }


def evaluate(
    spark: SparkSession,
    facts: dict[str, DataFrame],
    manifest: Manifest,
    *,
    truncate: bool = False,
    slot_bytes: int = DEFAULT_SLOT_BYTES,
    schema: str = "public",
    shape_only: bool = False,
    owned: bool = True,
    skipped_may_refer: bool = False,
) -> DataFrame:
    """All refusals as ``(code, table, column, object, ord)``. ``shape_only`` leaves out what matters for a
    side that is written; a source need not be owned."""
    frames = {n: placed(facts[n]) if n in facts else frame(spark, n) for n in FRAMES} | manifest_frames(spark, manifest)
    frames["sequences"] = classify(frames["sequence_refs"], frames["tables"].select("oid", "name"))
    given = {"truncate": truncate, "slot_bytes": slot_bytes, "schema": schema, "owned": owned, "skipped_may_refer": skipped_may_refer, "receipt_table": RECEIPT_TABLE, "receipt_columns": RECEIPT_COLUMNS, "receipt_key": RECEIPT_KEY}
    parts = []
    for k, text in enumerate(SHAPE + ([] if shape_only else WRITE)):
        args = {n: (F.create_map(*[F.lit(x) for pair in v.items() for x in pair]) if isinstance(v, dict) else v) for n, v in given.items() if f":{n}" in text}
        used = {n: df for n, df in frames.items() if "{" + n + "}" in text}
        parts.append(spark.sql(text, args=args, **used).select("code", "table", "column", "object", F.struct(F.lit(k).alias("rule"), F.col("pos").cast("long").alias("pos"), F.col("sub").cast("long").alias("sub")).alias("ord")))
    return reduce(DataFrame.unionByName, parts)


def in_order(found: DataFrame) -> DataFrame:
    return found.orderBy("ord").drop("ord")
