"""information_schema and pg_catalog, generated from the engine's catalog."""

from __future__ import annotations

from typing import TYPE_CHECKING

from ..dialect.lower import literal

if TYPE_CHECKING:
    from ..catalog import Catalog

#: PostgreSQL's names of Spark types.
NAMES = {"int": "integer", "bigint": "bigint", "smallint": "smallint", "double": "double precision", "float": "real", "string": "text", "boolean": "boolean", "date": "date", "timestamp_ntz": "timestamp without time zone", "timestamp": "timestamp with time zone", "binary": "bytea"}


def type_name(spark: str) -> str:
    return "ARRAY" if spark.startswith("array") else "numeric" if spark.startswith("decimal") else "USER-DEFINED" if spark.startswith("struct") else NAMES.get(spark, spark)


def _rows(catalog: Catalog, name: str) -> tuple[list[str], list[tuple]] | None:
    tables, views = catalog.state.tables.values(), catalog.state.views
    if name == "information_schema.tables":
        rows = [("lodestar", "public", t.name, "BASE TABLE") for t in tables] + [("lodestar", "public", v, "VIEW") for v in views]
        return ["table_catalog", "table_schema", "table_name", "table_type"], rows
    if name == "information_schema.columns":
        rows = [("lodestar", "public", t.name, c.name, i + 1, "NO" if c.not_null else "YES", type_name(c.spark), "YES" if c.identity else "NO", "ALWAYS" if c.generated is not None else "NEVER") for t in tables for i, c in enumerate(t.columns)]
        return ["table_catalog", "table_schema", "table_name", "column_name", "ordinal_position", "is_nullable", "data_type", "is_identity", "is_generated"], rows
    if name == "information_schema.schemata":
        return ["catalog_name", "schema_name"], [("lodestar", s) for s in sorted(catalog.state.schemas)]
    if name == "information_schema.views":
        return ["table_schema", "table_name"], [("public", v) for v in views]
    if name == "information_schema.sequences":
        return ["sequence_schema", "sequence_name", "start_value", "increment"], [("public", n, str(s.start), str(s.increment)) for n, s in catalog.sequences.items()]
    kinds = {"primary": "PRIMARY KEY", "unique": "UNIQUE", "check": "CHECK", "foreign": "FOREIGN KEY"}
    named = constraints(catalog)
    if name == "information_schema.table_constraints":
        return ["table_schema", "table_name", "constraint_name", "constraint_type"], [("public", t, n, kinds[c.kind_]) for t, n, c in named]
    if name == "information_schema.key_column_usage":
        return ["table_schema", "table_name", "constraint_name", "column_name", "ordinal_position"], [("public", t, n, k, i + 1) for t, n, c in named if c.kind_ != "check" for i, k in enumerate(c.columns)]
    if name == "information_schema.referential_constraints":
        return ["constraint_name", "delete_rule", "update_rule"], [(n, c.on_delete.upper(), c.on_update.upper()) for _, n, c in named if c.kind_ == "foreign"]
    if name in ("pg_tables", "pg_catalog.pg_tables"):
        return ["schemaname", "tablename"], [("public", t.name) for t in tables]
    if name in ("pg_views", "pg_catalog.pg_views"):
        return ["schemaname", "viewname"], [("public", v) for v in views]
    if name in ("pg_indexes", "pg_catalog.pg_indexes"):
        return ["schemaname", "tablename", "indexname"], [("public", t.name, i[0]) for t in tables for i in t.indexes]
    if name in ("pg_enum", "pg_catalog.pg_enum"):
        return ["enumtypname", "enumlabel", "enumsortorder"], [(e, label, float(i + 1)) for e, labels in catalog.enums.items() for i, label in enumerate(labels)]
    return _postgres(catalog, name.removeprefix("pg_catalog."), named)


#: Numbers of the system's own objects.
_SCHEMAS = {"pg_catalog": 11, "public": 2200, "information_schema": 13000}
#: PostgreSQL's type names and numbers.
_TYPES = {
    "bool": 16, "bytea": 17, "name": 19, "int8": 20, "int2": 21, "int4": 23, "text": 25, "oid": 26, "json": 114, "float4": 700, "float8": 701, "varchar": 1043, "date": 1082, "time": 1083, "timestamp": 1114,
    "timestamptz": 1184, "interval": 1186, "numeric": 1700, "uuid": 2950, "jsonb": 3802,
}
_SHORT = {"int": "int4", "bigint": "int8", "smallint": "int2", "double": "float8", "float": "float4", "string": "text", "boolean": "bool", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamptz", "binary": "bytea"}


def oids(catalog: Catalog) -> dict[tuple[str, str], int]:
    """A number for each object that users have made, in the order in which they made them."""
    made = [("relation", n) for n in (*catalog.state.tables, *catalog.state.views, *catalog.sequences)]
    made += [("type", n) for n in (*catalog.enums, *catalog.state.domains)]
    made += [("constraint", n) for _, n, _ in constraints(catalog)]
    made += [("index", i[0]) for t in catalog.state.tables.values() for i in t.indexes]
    made += [("function", f.known_as) for fs in catalog.state.functions.values() for f in fs]
    return {x: 16384 + i for i, x in enumerate(made)}


def constraints(catalog: Catalog) -> list[tuple]:
    """Table, name and definition of every constraint."""
    ends = {"primary": "pkey", "unique": "key", "check": "check", "foreign": "fkey"}
    return [(t.name, c.name or "_".join([t.name, *([] if c.kind_ == "primary" else c.columns), ends[c.kind_]]), c) for t in catalog.state.tables.values() for c in t.constraints]


def definitions(catalog: Catalog, function: str) -> dict[int, str]:
    """What pg_get_constraintdef, pg_get_indexdef and pg_get_viewdef say, by the object's number."""
    found, tables = oids(catalog), catalog.state.tables
    listed = lambda names: f"({', '.join(names)})"
    if function == "pg_get_viewdef":
        return {found["relation", n]: catalog.low().query(v.query).replace("`", "") + ";" for n, v in catalog.state.views.items()}
    if function == "pg_get_indexdef":
        return {found["index", i[0]]: f"CREATE {'UNIQUE ' if i[1] else ''}INDEX {i[0]} ON public.{t.name} USING btree {listed(c.replace('`', '') for c in i[2])}" for t in tables.values() for i in t.indexes}
    out = {}
    for table, name, c in constraints(catalog):
        if c.kind_ == "check":
            said = f"CHECK ({catalog._test(tables[table], c.test).replace('`', '')})"
        elif c.kind_ == "foreign":
            keys = c.keys or next((k.columns for k in tables[c.parent].keys() if k.kind_ == "primary"), c.columns)
            said = f"FOREIGN KEY {listed(c.columns)} REFERENCES {c.parent}{listed(keys)}" + "".join(f" ON {what} {how.upper()}" for what, how in (("UPDATE", c.on_update), ("DELETE", c.on_delete)) if how != "no action")
        else:
            said = f"{'PRIMARY KEY' if c.kind_ == 'primary' else 'UNIQUE'} {listed(c.columns)}"
        out[found["constraint", name]] = said
    return out


def _postgres(catalog: Catalog, name: str, named: list[tuple]) -> tuple[list[str], list[tuple]] | None:
    found, tables, views = oids(catalog), catalog.state.tables, catalog.state.views
    relation = lambda n: found["relation", n]
    kind = lambda c: found.get(("type", c.type.name)) or _TYPES.get(_SHORT.get(c.spark, "numeric" if c.spark.startswith("decimal") else "text"), 25)
    letters = {"primary": "p", "unique": "u", "check": "c", "foreign": "f"}
    functions = [f for fs in catalog.state.functions.values() for f in fs]
    triggers = [(t, x) for t, xs in catalog.state.triggers.items() for x in xs]
    if name == "pg_class":
        rows = [(relation(t.name), t.name, 2200, "r", len(t.columns)) for t in tables.values()] + [(relation(v), v, 2200, "v", 0) for v in views] + [(relation(s), s, 2200, "S", 0) for s in catalog.sequences]
        rows += [(found["index", i[0]], i[0], 2200, "i", len(i[2])) for t in tables.values() for i in t.indexes]
        return ["oid", "relname", "relnamespace", "relkind", "relnatts"], rows
    if name == "pg_namespace":
        return ["oid", "nspname"], [*((o, n) for n, o in _SCHEMAS.items()), *((15000 + i, s) for i, s in enumerate(sorted(catalog.state.schemas - _SCHEMAS.keys())))]
    if name == "pg_attribute":
        return ["attrelid", "attname", "atttypid", "attnum", "attnotnull", "atthasdef", "attidentity", "attgenerated"], [
            (relation(t.name), c.name, kind(c), i + 1, c.not_null, c.default is not None or c.generated is not None, "d" if c.identity else "", "s" if c.generated is not None else "") for t in tables.values() for i, c in enumerate(t.columns)
        ]
    if name == "pg_attrdef":
        return ["adrelid", "adnum"], [(relation(t.name), i + 1) for t in tables.values() for i, c in enumerate(t.columns) if c.default is not None or c.generated is not None]
    if name == "pg_type":
        own = [(found["type", n], n, "e") for n in catalog.enums] + [(found["type", n], n, "d") for n in catalog.state.domains]
        return ["oid", "typname", "typtype"], [*((o, n, "b") for n, o in _TYPES.items()), *own]
    if name == "pg_constraint":
        return ["oid", "conname", "contype", "conrelid", "confrelid"], [(found["constraint", n], n, letters[c.kind_], relation(t), relation(c.parent) if c.kind_ == "foreign" else 0) for t, n, c in named]
    if name == "pg_index":
        return ["indexrelid", "indrelid", "indisunique"], [(found["index", i[0]], relation(t.name), i[1]) for t in tables.values() for i in t.indexes]
    if name == "pg_proc":
        return ["oid", "proname", "pronargs", "prolang", "prokind"], [(found["function", f.known_as], f.name, len(f.args), f.language, "f" if f.returns is not None or f.setof else "p") for f in functions]
    if name == "pg_trigger":
        return ["tgname", "tgrelid"], [(x.name, relation(t)) for t, x in triggers]
    if name == "pg_sequences":
        return ["schemaname", "sequencename", "start_value", "increment_by", "last_value"], [("public", n, s.start, s.increment, s.last) for n, s in catalog.sequences.items()]
    if name == "pg_settings":
        return ["name", "setting"], sorted(catalog.settings.items())
    if name == "pg_database":
        return ["oid", "datname"], [(1, "lodestar")]
    if name in ("pg_roles", "pg_user"):
        return (["oid", "rolname"], [(10, "lodestar")]) if name == "pg_roles" else (["usesysid", "usename"], [(10, "lodestar")])
    if name == "pg_description":
        return ["objoid", "description"], []
    if name == "information_schema.check_constraints":
        return ["constraint_schema", "constraint_name", "check_clause"], [("public", n, f"({catalog._test(tables[t], c.test).replace('`', '')})") for t, n, c in named if c.kind_ == "check"]
    if name == "information_schema.constraint_column_usage":
        return ["table_name", "column_name", "constraint_name"], [(t, k, n) for t, n, c in named if c.kind_ in ("primary", "unique") for k in c.columns]
    if name == "information_schema.routines":
        return ["routine_schema", "routine_name", "routine_type", "external_language"], [("public", f.name, "FUNCTION" if f.returns is not None or f.setof else "PROCEDURE", f.language.upper()) for f in functions]
    if name == "information_schema.triggers":
        return ["trigger_name", "event_object_table", "action_timing"], [(x.name, t, x.when.upper()) for t, x in triggers]
    return None


def relation(catalog: Catalog, name: str) -> str | None:
    """A system table's rows as SQL; None if the name is not one."""
    found = _rows(catalog, name)
    if found is None:
        return None
    columns, rows = found
    names = ", ".join(columns)
    if not rows:
        numbers = {"oid", "relnamespace", "conrelid", "confrelid", "indrelid", "indexrelid", "attrelid", "atttypid", "attnum", "adrelid", "adnum", "tgrelid", "objoid", "pronargs"}
        return f"(SELECT * FROM VALUES ({', '.join(f'CAST(NULL AS {"int" if c in numbers else "string"})' for c in columns)}) AS t({names}) WHERE false)"
    return f"(SELECT * FROM VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)} AS t({names}))"
