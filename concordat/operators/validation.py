"""Manifest against both schemas: nothing is inferred and nothing is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordat.manifest import Manifest

SIDE_SCHEMA = "side string, table string, column string, type string, generated boolean"

#: Issues in the order of severity: undeclared tables, then tables, then columns.
STATEMENT = """
with present as (select distinct side, table from {sides}),
     sides as (select side from values ('sqlite'), ('postgres') as v(side)),
     declared as (select s.side, m.* from {m_columns} m cross join sides s),
     matched as (
       select d.*, x.column as found, x.type, x.generated as is_generated
         from declared d join present p on p.side = d.side and p.table = d.table
         left join {sides} x on x.side = d.side and x.table = d.table and x.column = d.column)
select 'undeclared-table' as code, p.side, p.table, cast(null as string) as column from present p
 where p.table not in (select table from {m_tables}) and p.table not in (select table from {m_skipped})
union all
select 'missing-table', s.side, m.table, null from {m_tables} m cross join sides s
 where not exists (select 1 from present p where p.side = s.side and p.table = m.table)
union all
select 'undeclared-column', x.side, x.table, x.column from {sides} x join {m_tables} m on m.table = x.table
 where x.column is not null and not exists (select 1 from {m_columns} c where c.table = x.table and c.column = x.column)
union all
select 'missing-column', side, table, column from matched where found is null
union all
select case when is_generated then 'generated-undeclared' else 'generated-mismatch' end, side, table, column from matched where found is not null and is_generated <> generated
union all
select 'pg-type-mismatch', side, table, column from matched where found is not null and side = 'postgres' and not array_contains(types, type)
"""


def sides_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``(side, table, column, type, generated)``; a table without columns has one row with null parts."""
    return spark.createDataFrame(rows, SIDE_SCHEMA)


def validate(spark: SparkSession, manifest: Manifest, sides: DataFrame) -> DataFrame:
    """Issues as ``(code, side, table, column)``."""
    columns = [(t.name, c.name, c.generated, list(c.strict_types)) for t in manifest.tables.values() for c in t.columns]
    return spark.sql(
        STATEMENT,
        sides=sides,
        m_tables=spark.createDataFrame([(n,) for n in manifest.tables], "table string"),
        m_skipped=spark.createDataFrame([(n,) for n in manifest.skipped], "table string"),
        m_columns=spark.createDataFrame(columns, "table string, column string, generated boolean, types array<string>"),
    )


def report(manifest: Manifest, issues: list, generated: int) -> str:
    if not issues:
        n = sum(len(t.columns) for t in manifest.tables.values())
        return f"manifest OK: {len(manifest.tables)} tables, {n} columns, {generated} generated (verified, not copied)"
    lines = [f"  FAIL [{i['code']}] {i['side']} {i['table']}{'.' + i['column'] if i['column'] else ''}" for i in issues]
    return "\n".join([f"manifest INVALID: {len(issues)} issue{'s' * (len(issues) != 1)}", *lines])
