"""Difference of two schema models in long form, and intentional differences.

A model is a frame ``(side, table, kind, name, signature, detail)``. Kinds are ``table``, ``column`` (detail is the
class, NOT NULL and default as a map), ``primary-key``, ``unique``, ``index`` and ``check``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions.expressions import check_text, index_signature, loose_class, normalized, strict_class

MODEL = "side string, table string, kind string, name string, signature string, raw string, class string, not_null boolean, has_default boolean"

STATEMENT = """
with l as (select * from {model} where side = 'sqlite'), r as (select * from {model} where side = 'postgres'),
     both as (select l.table from l join r on r.table = l.table and r.kind = 'table' where l.kind = 'table'),
     columns as (
       select coalesce(a.table, b.table) as table, coalesce(a.name, b.name) as name, a.raw as l_raw, b.raw as r_raw, a.class as l_class, b.class as r_class,
              a.not_null as l_nn, b.not_null as r_nn, a.has_default as l_def, b.has_default as r_def, a.name is not null as in_l, b.name is not null as in_r
         from (select * from l where kind = 'column' and table in (select table from both)) a
         full outer join (select * from r where kind = 'column' and table in (select table from both)) b on b.table = a.table and b.name = a.name),
     parts as (
       select coalesce(a.table, b.table) as table, coalesce(a.kind, b.kind) as kind, coalesce(a.name, b.name) as name, coalesce(a.signature, b.signature) as signature, a.name is not null as in_l, b.name is not null as in_r
         from (select * from l where kind in ('unique', 'index', 'check') and table in (select table from both)) a
         full outer join (select * from r where kind in ('unique', 'index', 'check') and table in (select table from both)) b
           on b.table = a.table and b.kind = a.kind and b.signature = a.signature)
select 'table-missing' as kind, coalesce(a.table, b.table) as table, cast(null as string) as name, a.table as sqlite, b.table as postgres
  from (select table from l where kind = 'table') a full outer join (select table from r where kind = 'table') b on b.table = a.table
 where a.table is null or b.table is null
union all
select 'column-missing', table, name, case when in_l then l_raw end, case when in_r then r_raw end from columns where not (in_l and in_r)
union all
select 'column-type', table, name, concat(l_raw, ' (', l_class, ')'), concat(r_raw, ' (', r_class, ')') from columns where in_l and in_r and l_class <> r_class
union all
select 'column-nullability', table, name, case when l_nn then 'not null' else 'nullable' end, case when r_nn then 'not null' else 'nullable' end from columns where in_l and in_r and l_nn <> r_nn
union all
select 'column-default', table, name, case when l_def then 'has default' else 'no default' end, case when r_def then 'has default' else 'no default' end from columns where in_l and in_r and l_def <> r_def
union all
select 'primary-key', t.table, null, coalesce(nullif(a.signature, ''), '(none)'), coalesce(nullif(b.signature, ''), '(none)')
  from both t left join (select * from l where kind = 'primary-key') a on a.table = t.table left join (select * from r where kind = 'primary-key') b on b.table = t.table
 where coalesce(a.signature, '') <> coalesce(b.signature, '')
union all
select kind, table, name, case when in_l then case when kind = 'check' then name else signature end end, case when in_r then case when kind = 'check' then name else signature end end
  from parts where not (in_l and in_r)
"""


def model_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, MODEL)


def schema_differences(spark: SparkSession, model: DataFrame) -> DataFrame:
    """``(kind, table, name, sqlite, postgres)``."""
    return spark.sql(STATEMENT, model=model)


def without_allowed(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Differences that no rule ``(kind, table, name)`` covers; a rule's null fields fit anything."""
    r = rules.select(*[rules[c].alias(f"rule_{c}") for c in ("kind", "table", "name")])
    on = None
    for c in ("kind", "table", "name"):
        fits = r[f"rule_{c}"].isNull() | (r[f"rule_{c}"] == found[c])
        on = fits if on is None else on & fits
    return found.join(r, on, "left_anti")


def strict_model(columns: list[tuple], keys: list[tuple], indexes: list[tuple], checks: list[tuple]) -> list[tuple]:
    """Model rows of the strict side from catalog rows: columns ``(table, name, type, not_null, has_default)``,
    keys ``(table, [column])``, indexes ``(table, name, definition, unique)``, checks ``(table, definition)``."""
    tables = dict.fromkeys([c[0] for c in columns] + [k[0] for k in keys])
    out = [("postgres", t, "table", t, t, None, None, None, None) for t in tables]
    out += [("postgres", t, "column", n, n, kind, None, not_null, default) for t, n, kind, not_null, default in columns]
    out += [("postgres", t, "primary-key", t, ",".join(names), None, None, None, None) for t, names in keys]
    for t, name, definition, unique in indexes:
        if found := index_signature(definition, unique):
            out.append(("postgres", t, found[0], name, found[1], None, None, None, None))
    for t, definition in checks:
        text = check_text(definition)
        out.append(("postgres", t, "check", text, normalized(text), None, None, None, None))
    return out


def with_classes(model: DataFrame) -> DataFrame:
    """The model with the class of every column's type."""
    kind = F.when(F.col("side") == "sqlite", loose_class(F.col("raw"))).otherwise(strict_class(F.col("raw")))
    return model.withColumn("class", F.when(F.col("kind") == "column", kind))


def compare(spark: SparkSession, rows: list[tuple], allow: list[tuple] = ()) -> tuple[list, str]:
    """Differences that no rule allows, and a report."""
    found = schema_differences(spark, with_classes(model_frame(spark, rows)))
    rules = spark.createDataFrame(list(allow), "kind string, table string, name string")
    left = without_allowed(found, rules).orderBy("table", "kind", "name").collect()
    allowed = found.count() - len(left)
    if not left:
        return left, f"schemas match ({allowed} allowed difference{'s' * (allowed != 1)})"
    lines = [f"  [{d['kind']}] {d['table']}{'.' + d['name'] if d['name'] else ''}: {d['sqlite'] or '-'} / {d['postgres'] or '-'}" for d in left]
    return left, "\n".join([f"schemas differ: {len(left)} difference{'s' * (len(left) != 1)}", *lines])
