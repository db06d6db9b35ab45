"""Literal inputs and hand-worked results for operators that no driver table exercises."""

from __future__ import annotations

from concordat.manifest import Manifest, TableSpec, parse_manifest


def _manifest(tables: dict) -> Manifest:
    return parse_manifest({"version": 1, "tables": tables})


def _table(name: str, key: list[str], **columns: str | dict) -> TableSpec:
    given = {c: ({"codec": s} if isinstance(s, str) else s) for c, s in columns.items()}
    return _manifest({name: {"columns": {c: {"nullable": c not in key} | s for c, s in given.items()}, "primaryKey": key}}).tables[name]


ORDERS = _table("orders", ["o_orderkey"], o_orderkey="bigint", o_custkey="bigint", o_orderstatus="text", o_totalprice="real", o_orderdate="timestamp-naive", o_orderpriority="text")
EVENTS = _table("events", ["event_id"], event_id="bigint", ts="timestamp-naive", user_id="bigint", event_type="text", value="real", props={"codec": "json-text", "pgType": "jsonb"})
CONVERSATIONS = _table("conversations", ["doc_id"], doc_id="integer", text="text")

# --- codec rejections: codec, text, error class -------------------------------------------------

REJECTION_OPTIONS = {
    "integer": {},
    "bigint": {},
    "decimal-as-string": {},
    "uuid-text": {},
    "timestamp-iso": {},
    "timestamp-epoch-ms": {"preserveInteger": False, "acceptSqliteDatetimeText": True},
    "timestamp-naive": {},
    "date-text": {},
    "json-text": {"pgType": "jsonb"},
}
_BAD, _LOSSY = "CODEC_INVALID", "CODEC_LOSSY"
_MOMENT = "2033-07-19T16:16:08"
_SPACED = _MOMENT.replace("T", " ")
REJECTIONS = [
    *[("integer", v, e) for v, e in (("604", None), ("-00318", None), ("+604", _BAD), ("604 ", _BAD), ("604\n", _BAD), ("", _BAD), (str(2**53 - 1), None), (str(2**53), _LOSSY), ("8" * 25, _LOSSY))],
    *[("bigint", v, e) for v, e in ((str(2**63 - 1), None), (str(2**63), _LOSSY), (str(-(2**63)), None), ("6.0", _BAD))],
    *[("decimal-as-string", v, e) for v, e in (("-0042.10", None), ("8.", None), (".75", None), ("eight", _BAD), ("2E3", _BAD), ("", _BAD), ("Infinity", _BAD), ("4 2", _BAD), (".", _BAD))],
    *[("uuid-text", v, e) for v, e in (("0B5DA0E6-77C1-4F3B-9D1A-5E2F8C6B4A39", None), ("{0b5da0e6-77c1-4f3b-9d1a-5e2f8c6b4a39}", _BAD), ("0b5da0e6-77c1-4f3b-9d1a-5e2f8c6b4a3x", _BAD))],
    *[("timestamp-iso", v, e) for v, e in ((f"{_MOMENT}+05:30", None), ("2033-07-19 16:16z", None), (_MOMENT, _BAD), ("2035-02-29T16:16:08Z", _BAD), ("2033-07-19T25:16:08Z", _BAD), ("2033-07-19T16:60:08Z", _BAD), (f"{_MOMENT}-31:00", _BAD), (f"{_MOMENT}.0708091Z", _LOSSY), (f"{_MOMENT}.0708090Z", None), ("0000-06-30T00:00:00Z", _LOSSY))],
    *[("timestamp-epoch-ms", v, e) for v, e in (("2005402568045", None), (f"{_SPACED}.045", None), (_MOMENT, _BAD), (f"{_SPACED}+00", _BAD), ("2033-07-19 16", _BAD), (f"{_SPACED}.0450", _BAD), ("8700000000000000", _LOSSY))],
    *[("timestamp-naive", v, e) for v, e in ((_SPACED, None), (f"{_SPACED}.070809", None), (f"{_SPACED}.0708091", _BAD), (_MOMENT, _BAD), (f"{_SPACED}\n", _BAD), ("2035-02-29 16:16:08", _BAD), ("0000-12-31 23:59:59", _LOSSY))],
    *[("date-text", v, e) for v, e in (("2036-02-29", None), ("2035-02-29", _BAD), ("2033-7-19", _BAD), ("19.07.2033", _BAD), ("2033-07-19 ", _BAD))],
    *[("json-text", v, e) for v, e in (('{"k": [7]}', None), ('{"q": 1, "\\u0071": 2}', _BAD), ('["open"', _BAD), ("-Infinity", _BAD), ('{"k": 1,}', _BAD), ("7E500", None), ("[" * 513 + "]" * 513, _BAD))],
]

# --- sequences -----------------------------------------------------------------------------------

_BIG = (1 << 63) - 1
#: name, highest, lowest, high water, increment, min, max, restart value, in range
RESTARTS = [
    ("ascending", 5, 1, None, 1, 1, _BIG, 6, True),
    ("high water wins", 3, 1, 5, 1, 1, _BIG, 6, True),
    ("descending", -1, -5, None, -1, -1000, -1, -6, True),
    ("empty", None, None, None, 3, 7, _BIG, None, True),
    ("empty with high water", None, None, 9, 1, 1, _BIG, 10, True),
    ("over the top", 100, 1, None, 1, 1, 100, 101, False),
    ("below the floor", -1, -1000, None, -1, -1000, -1, -1001, False),
]
COPIED = [(1, "a"), (2, "b")]
#: sequence_oid, schema, name, cycles, kind, table_oid, column
SEQUENCE_REFS = [
    (10, "public", "zulu_id_seq", False, "owner", 1, "id"),
    (11, "public", "loose_seq", False, "default", 1, "n"),
    (12, "public", "shared_seq", False, "owner", 1, "m"),
    (12, "public", "shared_seq", False, "default", 2, "z"),
    (13, "public", "ring_seq", True, "owner", 2, "id"),
    (14, "public", "far_seq", False, "owner", 9, "id"),
    (15, "public", "self_seq", False, "owner", 2, "k"),
    (15, "public", "self_seq", False, "default", 2, "k"),
    (16, "alpha", "late_seq", False, "default", 2, "b"),
    (16, "alpha", "late_seq", False, "default", 9, "a"),
]
#: The place is the first use in the order of kind, relation and column: a default comes before an owner.
SEQUENCE_VERDICTS = [
    (16, "sequence-unowned", "b", "b", "alpha.late_seq"),
    (14, "foreign", None, None, "public.far_seq"),
    (11, "sequence-unowned", "a", "n", "public.loose_seq"),
    (13, "sequence-cycles", "b", "id", "public.ring_seq"),
    (15, "usable", "b", "k", "public.self_seq"),
    (12, "sequence-shared", "b", "z", "public.shared_seq"),
    (10, "usable", "a", "id", "public.zulu_id_seq"),
]

# --- the gate --------------------------------------------------------------------------------------

GATE_MANIFEST = _manifest(
    {
        "a": {"columns": {"id": {"codec": "integer", "nullable": False}, "note": {"codec": "text", "nullable": True}}, "primaryKey": ["id"]},
        "b": {"columns": {"id": {"codec": "integer", "nullable": False}, "price": {"codec": "decimal-as-string", "nullable": False}}, "primaryKey": ["id", "price"]},
        "items": {"columns": {"id": {"codec": "integer", "nullable": False}}, "primaryKey": ["id"]},
        "parent": {"columns": {"id": {"codec": "integer", "nullable": False}}, "primaryKey": ["id"]},
        "log": {"copy": False, "reason": "ledger"},
    }
)
#: One fault of each kind; frames as in ``operators.gate.FRAMES``.
GATE_FACTS = {
    "tables": [("a", 1, "p", True, False, False, False, False), ("b", 2, "r", False, False, True, False, True)],
    "columns": [("a", "id", True), ("a", "note", True), ("b", "id", False)],
    "primary_keys": [("a", ["note"]), ("b", ["id", "price"])],
    "triggers": [("a", "stamp")],
    "rules": [("b", "redirect")],
    "foreign_keys": [("b_a_fk", 2, "public", "b", 1, "public", "a", False, True, True), ("x_a_fk", 9, "other", "x", 1, "public", "a", True, False, False)],
    "event_triggers": [("audit_ddl",)],
    "publications": [("feed", "a")],
    "subscriptions": [(2,)],
    "dynamic_sequence_defaults": [("public", "a", "id"), ("other", "x", "n")],
    "volatile_expressions": [("a", "a_check")],
    "sequence_refs": SEQUENCE_REFS,
    "adopting_publications": [("everything",)],
    "receipt": [(True, "r", True, False, True, False, False, {"run_id": "uuid"}, ["run_id"], True)],
    "non_empty_tables": [("a",)],
    "archiver": [(True,)],
    "slots": [("quick", 10), ("slow", (5 << 30) + 1)],
}
#: With truncation allowed, so a filled table is no reason and an incoming reference is.
GATE_EXPECTED = [
    ("partitioned-table", "a", None, None),
    ("row-security-enabled", "a", None, None),
    ("not-owner", "a", None, None),
    ("primary-key-mismatch", "a", None, None),
    ("inherited-table", "b", None, None),
    ("primary-key-order-unsupported", "b", "price", None),
    ("nullability-mismatch", "a", "note", None),
    ("nullability-mismatch", "b", "id", None),
    ("trigger-present", "a", None, "stamp"),
    ("rule-present", "b", None, "redirect"),
    ("foreign-key-not-valid", "other.x", None, "x_a_fk"),
    ("foreign-key-not-valid", "b", None, "b_a_fk"),
    ("constraint-has-comment", "b", None, "b_a_fk"),
    ("incoming-reference-from-uncopied-table", "a", None, "other.x.x_a_fk"),
    ("event-trigger-present", None, None, "audit_ddl"),
    ("publication-covers-table", "a", None, "feed"),
    ("subscription-present", None, None, None),
    ("sequence-dynamic-default", "a", "id", None),
    ("sequence-dynamic-default", "other.x", "n", None),
    ("volatile-expression", "a", None, "a_check"),
    ("sequence-unowned", "b", "b", "alpha.late_seq"),
    ("sequence-unowned", "a", "n", "public.loose_seq"),
    ("sequence-cycles", "b", "id", "public.ring_seq"),
    ("sequence-shared", "b", "z", "public.shared_seq"),
    ("receipt-table-invalid", "concordat.receipt", None, "everything"),
    ("receipt-table-invalid", "concordat.receipt", None, None),
    ("archiver-failing", None, None, None),
    ("replication-slot-lag", None, None, "slow"),
]
SKIPPED_FACTS = {
    "tables": [("items", 1, "r", False, False, False, False, True), ("parent", 2, "r", False, False, False, False, True)],
    "primary_keys": [("items", ["id"]), ("parent", ["id"])],
    "foreign_keys": [("skipped_log", 1, "public", "items", 7, "public", "log", True, True, False), ("log_parent", 7, "public", "log", 2, "public", "parent", True, True, False), ("far", 1, "public", "items", 8, "other", "log", True, True, False)],
}

# --- manifest validation -----------------------------------------------------------------------------

VALIDATION_MANIFEST = _manifest(
    {
        "items": {
            "columns": {
                "id": {"codec": "integer", "nullable": False},
                "name": {"codec": "text", "nullable": False},
                "qty": {"codec": "integer", "nullable": False},
                "total": {"codec": "integer", "nullable": True, "generated": True},
                "flag": {"codec": "boolean", "nullable": True},
            },
            "primaryKey": ["id"],
        },
        "gone": {"columns": {"id": {"codec": "integer", "nullable": False}}, "primaryKey": ["id"]},
        "ledger": {"copy": False, "reason": "migrations"},
    }
)
VALIDATION_SIDES = [
    ("sqlite", "items", "id", "INTEGER", False),
    ("sqlite", "items", "name", "TEXT", False),
    ("sqlite", "items", "qty", "INTEGER", True),
    ("sqlite", "items", "total", "INTEGER", True),
    ("sqlite", "items", "extra", "TEXT", False),
    ("sqlite", "stray", "id", "INTEGER", False),
    ("sqlite", "ledger", "id", "TEXT", False),
    ("sqlite", "gone", "id", "INTEGER", False),
    ("postgres", "items", "id", "bigint", False),
    ("postgres", "items", "name", "character varying", False),
    ("postgres", "items", "qty", "numeric", False),
    ("postgres", "items", "total", "bigint", False),
    ("postgres", "items", "flag", "boolean", False),
    ("postgres", "bare", None, None, None),
]
VALIDATION_EXPECTED = [
    ("undeclared-table", "sqlite", "stray", None),
    ("undeclared-table", "postgres", "bare", None),
    ("missing-table", "postgres", "gone", None),
    ("undeclared-column", "sqlite", "items", "extra"),
    ("missing-column", "sqlite", "items", "flag"),
    ("generated-undeclared", "sqlite", "items", "qty"),
    ("generated-mismatch", "postgres", "items", "total"),
    ("pg-type-mismatch", "postgres", "items", "qty"),
]
# A table that one side lacks has no columns there, so nothing is said about them.

# --- schema difference ---------------------------------------------------------------------------------


def _column(side: str, table: str, name: str, raw: str, not_null: bool = True, default: bool = False) -> tuple:
    return (side, table, "column", name, name, raw, None, not_null, default)


def _part(side: str, table: str, kind: str, name: str, signature: str) -> tuple:
    return (side, table, kind, name, signature, None, None, None, None)


SCHEMA_MODEL = [
    *[_part(s, t, "table", t, t) for s, t in (("sqlite", "users"), ("postgres", "users"), ("sqlite", "old"), ("postgres", "new"))],
    _column("sqlite", "users", "id", "INTEGER"),
    _column("postgres", "users", "id", "bigint"),
    _column("sqlite", "users", "age", "TEXT", False),
    _column("postgres", "users", "age", "integer", True, True),
    _column("sqlite", "users", "nick", "VARCHAR(20)"),
    _column("postgres", "users", "mail", "text"),
    _part("sqlite", "users", "primary-key", "users", "id"),
    _part("postgres", "users", "primary-key", "users", "id,age"),
    _part("sqlite", "users", "unique", "u1", "nick"),
    _part("postgres", "users", "unique", "users_nick_key", "nick"),
    _part("sqlite", "users", "index", "i1", "unique (lowername) where active=1"),
    _part("postgres", "users", "index", "i1", "unique (lowername)"),
    _part("sqlite", "users", "check", "age > 0", "age>0"),
    _part("postgres", "users", "check", "age >= 0", "age>=0"),
]
SCHEMA_DIFFERENCES = [
    ("table-missing", "old", None, "old", None),
    ("table-missing", "new", None, None, "new"),
    ("column-missing", "users", "nick", "VARCHAR(20)", None),
    ("column-missing", "users", "mail", None, "text"),
    ("column-type", "users", "age", "TEXT (text)", "integer (integer)"),
    ("column-nullability", "users", "age", "nullable", "not null"),
    ("column-default", "users", "age", "no default", "has default"),
    ("primary-key", "users", None, "id", "id,age"),
    ("index", "users", "i1", "unique (lowername) where active=1", None),
    ("index", "users", "i1", None, "unique (lowername)"),
    ("check", "users", "age > 0", "age > 0", None),
    ("check", "users", "age >= 0", None, "age >= 0"),
]

TOPOLOGY = [("db1", 5432, "71", "app", False), ("db2", 5432, "72", "app", True), ("db3", 5432, "73", "app", False), ("db3", 5432, "73", "app", True)]
TOPOLOGY_EXPECTED = [("db1", 5432, "71", "app", False), ("db1", 5432, "99", "app", True), ("db1", 5433, "71", "app", True), ("db2", 5432, "72", "app", True), ("db3", 5432, "73", "app", True), ("db9", 5432, "71", "app", True)]

# --- a small system catalog --------------------------------------------------------------------------------


def _frame(schema: str, *rows: tuple) -> tuple[str, list[tuple]]:
    return schema, list(rows)


def _keyed(schema: str, *rows: dict) -> tuple[str, list[tuple]]:
    """Rows by name; what a row does not name is null."""
    names = [part.split()[0] for part in schema.split(", ")]
    return schema, [tuple(r.get(n) for n in names) for r in rows]


_FALSE = {"relrowsecurity": False, "relispartition": False, "is_owner": True}
_SOUND = {"convalidated": True, "conenforced": True, "condeferrable": False, "condeferred": False, "has_comment": False}
_FK = _SOUND | {"contype": "f", "confrelid": 10, "conkey": [2, 1], "confkey": [2, 1], "confupdtype": "a", "confmatchtype": "s", "conindid": 20, "conpfeqop": "{98,410}"}
_VOLATILE, _IMMUTABLE = "{FUNCEXPR :funcid 1598}", "{OPEXPR :opno 96 :opfuncid 66}"
CATALOG_TABLES = ("orders", "items", "nothing")
#: Of the relations, ``orders`` also exists in another schema, ``nothing`` is a view and ``part`` a piece of ``items``.
CATALOG: dict[str, tuple[str, list[tuple]]] = {
    "pg_namespace": _frame("oid bigint, nspname string, can_create boolean", (1, "public", True), (2, "ops", False), (3, "other", True), (4, "pg_catalog", False)),
    "pg_class": _keyed(
        "oid bigint, relname string, relnamespace bigint, relkind string, relrowsecurity boolean, relispartition boolean, is_owner boolean",
        *[
            _FALSE | {"oid": oid, "relname": name, "relnamespace": schema, "relkind": kind} | more
            for oid, name, schema, kind, more in [
                (10, "orders", 1, "r", {}),
                (11, "items", 1, "p", {"relrowsecurity": True, "is_owner": False}),
                (12, "orders", 3, "r", {}),
                (13, "uncopied", 1, "r", {}),
                (14, "nothing", 1, "v", {}),
                (15, "part", 1, "r", {"relispartition": True}),
                (16, "system_table", 4, "r", {"is_owner": False}),
                (20, "orders_pkey", 1, "i", {}),
                (21, "items_expr", 1, "i", {}),
                (22, "uncopied_expr", 1, "i", {}),
                (30, "orders_id_seq", 1, "S", {}),
                (31, "far_seq", 3, "S", {}),
                (40, "receipt", 2, "r", {}),
            ]
        ],
    ),
    "pg_inherits": _frame("inhrelid bigint, inhparent bigint", (13, 10), (15, 11)),
    "pg_attribute": _keyed(
        "attrelid bigint, attname string, attnum int, attnotnull boolean, attisdropped boolean, attgenerated string, atttypid bigint, formatted string",
        *[
            {"attrelid": rel, "attname": name, "attnum": number, "attnotnull": filled, "attisdropped": False, "attgenerated": "", "atttypid": 20, "formatted": "bigint"} | more
            for rel, name, number, filled, more in [
                (10, "ctid", -1, True, {}),
                (10, "id", 1, True, {}),
                (10, "region", 2, True, {"formatted": "text"}),
                (10, "old", 3, False, {"attisdropped": True}),
                (10, "total", 4, False, {"attgenerated": "s"}),
                (11, "order_id", 1, True, {}),
                (11, "order_region", 2, False, {"formatted": "text"}),
                (11, "n", 3, False, {"atttypid": 90, "formatted": "code"}),
                (11, "m", 4, False, {"atttypid": 91, "formatted": "grade"}),
                (12, "id", 1, True, {}),
                (13, "order_id", 1, True, {}),
                (13, "region", 2, True, {"formatted": "text"}),
                (13, "c", 3, True, {"atttypid": 90, "formatted": "code"}),
                (16, "n", 1, True, {}),
                (40, "run_id", 1, True, {"formatted": "uuid"}),
                (40, "per_table", 2, True, {"formatted": "jsonb"}),
            ]
        ],
    ),
    "pg_type": _frame("oid bigint, typname string, typtype string", (20, "int8", "b"), (90, "code", "d"), (91, "grade", "d")),
    "pg_constraint": _keyed(
        "oid bigint, conname string, conrelid bigint, contypid bigint, contype string, conkey array<int>, confrelid bigint, confkey array<int>, conpfeqop string, confdelsetcols string, definition string, convalidated boolean, conenforced boolean, confupdtype string, confdeltype string, confmatchtype string, condeferrable boolean, condeferred boolean, conindid bigint, has_comment boolean, tree string",
        _SOUND | {"oid": 50, "conname": "orders_pkey", "conrelid": 10, "contype": "p", "conkey": [2, 1], "definition": "PRIMARY KEY (region, id)", "conindid": 20},
        _FK | {"oid": 51, "conname": "items_orders_fk", "conrelid": 11, "confdeltype": "n", "confdelsetcols": "{1}", "definition": "FOREIGN KEY (order_region, order_id) REFERENCES orders(region, id) ON DELETE SET NULL (order_id)"},
        _FK | {"oid": 52, "conname": "uncopied_orders_fk", "conrelid": 13, "confdeltype": "a", "definition": "FOREIGN KEY (region, order_id) REFERENCES orders(region, id) NOT VALID", "convalidated": False, "conenforced": False, "condeferrable": True, "condeferred": True, "has_comment": True},
        _FK | {"oid": 56, "conname": "uncopied_self_fk", "conrelid": 13, "confrelid": 13, "confdeltype": "a", "definition": "FOREIGN KEY (region, order_id) REFERENCES uncopied(region, order_id)"},
        _SOUND | {"oid": 53, "conname": "items_check", "conrelid": 11, "contype": "c", "conkey": [3], "definition": "CHECK (n < random())", "tree": "{OPEXPR :opfuncid 66 :args (" + _VOLATILE + ")}"},
        _SOUND | {"oid": 57, "conname": "orders_check", "conrelid": 10, "contype": "c", "conkey": [1], "definition": "CHECK (id > 0)", "tree": _IMMUTABLE},
        _SOUND | {"oid": 54, "conname": "code_check", "conrelid": 0, "contypid": 90, "contype": "c", "definition": "CHECK (VALUE > random())", "tree": _VOLATILE},
        _SOUND | {"oid": 55, "conname": "grade_check", "conrelid": 0, "contypid": 91, "contype": "c", "definition": "CHECK (VALUE > 0)", "tree": _IMMUTABLE},
        _SOUND | {"oid": 58, "conname": "receipt_pkey", "conrelid": 40, "contype": "p", "conkey": [1], "definition": "PRIMARY KEY (run_id)"},
    ),
    "pg_trigger": _frame("tgname string, tgrelid bigint, tgisinternal boolean", ("stamp", 10, False), ("RI_1", 11, True), ("elsewhere", 12, False), ("watch", 40, False)),
    "pg_rewrite": _frame("rulename string, ev_class bigint", ("redirect", 11), ("far", 12), ("_RETURN", 14)),
    "pg_event_trigger": _frame("evtname string, evtenabled string", ("audit", "O"), ("off", "D")),
    "pg_publication": _frame("oid bigint, pubname string, puballtables boolean", (70, "feed", False), (71, "everything", True), (72, "by_schema", False), (73, "other_schema", False)),
    "pg_publication_namespace": _frame("pnpubid bigint, pnnspid bigint", (72, 2), (73, 3)),
    "pg_publication_tables": _frame("pubname string, schemaname string, tablename string", ("feed", "public", "orders"), ("feed", "other", "orders"), ("feed", "public", "uncopied"), ("by_schema", "ops", "receipt")),
    "pg_subscription": _frame("subdbid bigint", (7,), (7,), (8,)),
    "pg_database": _frame("oid bigint, datname string, can_create boolean", (7, "app", True), (8, "spare", False)),
    "pg_depend": _frame(
        "classid string, objid bigint, refclassid string, refobjid bigint, refobjsubid int, deptype string",
        ("class", 30, "class", 10, 1, "a"),
        ("attrdef", 60, "class", 30, 0, "n"),
        ("attrdef", 61, "class", 30, 0, "n"),
        ("attrdef", 64, "class", 31, 0, "a"),  # not a use: the default itself hangs on something
        ("class", 31, "class", 12, 1, "a"),
        ("class", 31, "class", 3, 0, "n"),
    ),
    "pg_attrdef": _frame(
        "oid bigint, adrelid bigint, adnum int, expr string, tree string",
        (60, 10, 1, "nextval('orders_id_seq'::regclass)", ""),
        (61, 13, 1, "nextval('orders_id_seq'::regclass)", ""),
        (62, 11, 3, "NEXTVAL(('orders' || '_id_seq')::text)", ""),
        (63, 10, 4, "(id * 2)", _IMMUTABLE),
        (64, 12, 1, "nextval('far_seq'::text::regclass)", ""),
        (65, 16, 1, "nextval('hidden')", ""),
    ),
    "pg_sequence": _frame("seqrelid bigint, seqstart bigint, seqincrement bigint, seqmin bigint, seqmax bigint, seqcycle boolean", (30, 1, 1, 1, (1 << 63) - 1, False), (31, 5, -1, -9, 9, True)),
    "pg_index": _frame("indexrelid bigint, indrelid bigint, exprs_tree string, pred_tree string", (20, 10, None, None), (21, 11, None, _VOLATILE), (22, 13, _VOLATILE, None)),
    "pg_proc": _frame("oid bigint, provolatile string", (66, "i"), (1598, "v"), (96, "v")),
    "pg_stat_archiver": _frame("last_failed_time string, last_archived_time string", ("2031-05-06 07:50:00", "2031-05-06 07:58:00")),
    "pg_replication_slots": _frame("slot_name string, current_lsn bigint, restart_lsn bigint", ("a", 500, 100), ("b", 500, None)),
    "tables": _frame("table_schema string, table_name string, table_type string", ("public", "orders", "BASE TABLE"), ("public", "bare", "BASE TABLE"), ("public", "seen", "VIEW"), ("other", "orders", "BASE TABLE")),
    "columns": _frame(
        "table_schema string, table_name string, column_name string, data_type string, is_generated string, character_maximum_length int, ordinal_position int",
        ("public", "orders", "id", "bigint", "NEVER", None, 1),
        ("public", "orders", "code", "character varying", "NEVER", 5, 2),
        ("public", "orders", "total", "bigint", "ALWAYS", None, 3),
    ),
}
#: The server's time at which the facts are read.
CATALOG_NOW = "2031-05-06 08:00:00"
_FK_COLUMNS = 'oid, name, table_oid, table_schema, "table", ref_oid, ref_schema, ref_table, definition, validated, enforced, conkey, confkey, columns, ref_columns, conpfeqop, confdelsetcols, confupdtype, confdeltype, confmatchtype, "deferrable", "deferred", index_name, has_comment'
#: Columns and rows that each fact has for ``CATALOG_TABLES`` of the schema ``public``.
CATALOG_EXPECTED: dict[str, tuple[str, list[tuple]]] = {
    "tables": (
        "oid, name, kind, row_security, is_partition, inherits, has_children, is_owner",
        [(11, "items", "p", True, False, False, True, False), (14, "nothing", "v", False, False, False, False, True), (10, "orders", "r", False, False, False, True, True)],
    ),
    "columns": ('"table", "column", not_null', [("orders", "id", True), ("orders", "region", True), ("orders", "total", False), ("items", "order_id", True), ("items", "order_region", False), ("items", "n", False), ("items", "m", False)]),
    "primary_keys": ('"table", columns', [("orders", "region,id")]),
    "triggers": ('"table", name', [("orders", "stamp")]),
    "rules": ('"table", name', [("items", "redirect"), ("nothing", "_RETURN")]),
    "foreign_keys": (
        _FK_COLUMNS,
        [
            (51, "items_orders_fk", 11, "public", "items", 10, "public", "orders", "FOREIGN KEY (order_region, order_id) REFERENCES orders(region, id) ON DELETE SET NULL (order_id)", True, True, "{2,1}", "{2,1}", "order_region,order_id", "region,id", "{98,410}", "{1}", "a", "n", "s", False, False, "orders_pkey", False),
            (52, "uncopied_orders_fk", 13, "public", "uncopied", 10, "public", "orders", "FOREIGN KEY (region, order_id) REFERENCES orders(region, id) NOT VALID", False, False, "{2,1}", "{2,1}", "region,order_id", "region,id", "{98,410}", None, "a", "a", "s", True, True, "orders_pkey", True),
        ],
    ),
    "event_triggers": ("name", [("audit",), ("off",)]),
    "publications": ('publication, "table"', [("feed", "orders")]),
    "subscription_count": ("n", [(2,)]),
    "sequence_refs": (
        'sequence_oid, schema, name, start, increment, min, max, cycles, kind, table_oid, "column"',
        [(30, "public", "orders_id_seq", 1, 1, 1, (1 << 63) - 1, False, kind, rel, column) for kind, rel, column in (("default", 10, "id"), ("default", 13, "order_id"), ("owner", 10, "id"))],
    ),
    "dynamic_sequence_defaults": ('schema, "table", "column"', [("other", "orders", "id"), ("public", "items", "n")]),
    "volatile_expressions": ('"table", object', [("items", "code"), ("items", "items_check"), ("items", "items_expr")]),
    "adopting_publications": ("publication", [("by_schema",), ("everything",)]),
    "receipt_columns": ("columns", [("per_table=jsonb,run_id=uuid",)]),
    "receipt": ('"exists", kind, is_owner, row_security, has_trigger, has_rule, published, columns, primary_key, can_create', [(True, "r", True, False, True, False, True, "per_table=jsonb,run_id=uuid", "run_id", False)]),
    "archiver": ("failing", [(True,)]),
    "slots": ("name, retained_bytes", [("a", 400)]),
    "introspected": ('"table", "column", type, generated, max_length', [("bare", None, None, False, None), ("orders", "id", "bigint", False, None), ("orders", "code", "character varying", False, 5), ("orders", "total", "bigint", True, None)]),
    "lock_set": ('schema, "table"', [("public", "items"), ("public", "nothing"), ("public", "orders"), ("public", "uncopied")]),
}
#: What the same server would say if it were older: no unenforced keys, no columns of SET NULL, no publications of schemas.
CATALOG_OLD = 140_000
CATALOG_EXPECTED_OLD: dict[str, tuple[str, list[tuple]]] = {
    "foreign_keys": ("name, enforced, confdelsetcols", [("items_orders_fk", True, None), ("uncopied_orders_fk", True, None)]),
    "adopting_publications": ("publication", [("everything",)]),
}

# --- text of schemas ---------------------------------------------------------------------------------------

EXPRESSIONS = [
    ('("Status" = \'on\'::text)', "status='on'"),
    ("lower(name)", "lowername"),
    ("((a > 0) AND (b)::numeric(10,2) > 1)", "a>0andb>1"),
    ("x::timestamp with time zone", "x"),
    ("tags::text[]", "tags"),
]
#: A declared type and its class on the loose and on the strict side.
TYPES = [
    ("INTEGER", "integer", "integer"),
    ("bigint", "integer", "integer"),
    ("BOOLEAN", "boolean", "boolean"),
    ("VARCHAR(20)", "text", "other"),
    ("character varying", "text", "text"),
    ("timestamp with time zone", "datetime", "datetime"),
    ("date", "datetime", "datetime"),
    ("jsonb", "json", "json"),
    ("uuid", "uuid", "uuid"),
    ("", "blob", "other"),
    ("bytea", "numeric", "blob"),
    ("double precision", "real", "real"),
    ("numeric(10,2)", "numeric", "numeric"),
    ("money", "numeric", "numeric"),
    ("citext", "text", "text"),
]
TO_DESCRIBE = [("codec-invalid", "t", "c", None), ("trigger-present", "t", None, "stamp"), ("subscription-present", None, None, None), ("event-trigger-present", None, None, "x")]
DESCRIBED = [("codec-invalid t.c",), ("trigger-present t (stamp)",), ("subscription-present",), ("event-trigger-present (x)",)]
