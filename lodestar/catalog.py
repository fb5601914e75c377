"""Tables, types, sequences, functions and transactions of an engine.

A table is an immutable set of Parquet folders and its metadata; every change makes a new one, so that a
transaction is a stack of copies of the name maps and a rollback restores one.  Inserting adds a folder;
updates and deletes write the remaining and changed rows.  All data work is DataFrame algebra.
"""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dialect.lower import Lowering, Scope, literal, quoted
from .dialect.parser import Node, Parser
from .dialect.views import columns_below, through
from .errors import SqlError
from .procedural import triggers
from .sources import copying, information
from .sources.scratch import new_path, stored

if TYPE_CHECKING:
    from .session import Engine


@dataclass(frozen=True)
class Column:
    name: str
    type: Node
    spark: str
    default: Node | None = None
    not_null: bool = False
    generated: Node | None = None
    identity: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    constraints: tuple[Node, ...] = ()
    files: tuple[str, ...] = ()
    indexes: tuple[tuple[str, bool, tuple[str, ...]], ...] = ()

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise SqlError("42703", f'column "{name}" of relation "{self.name}" does not exist')

    def schema(self) -> str:
        return ", ".join(f"{quoted(c.name)} {c.spark}" for c in self.columns)

    def keys(self) -> list[Node]:
        return [c for c in self.constraints if c.kind_ in ("primary", "unique")]


@dataclass
class Sequence:
    start: int = 1
    increment: int = 1
    least: int = 1
    most: int = 2**63 - 1
    cycle: bool = False
    last: int | None = None  # the last value given out

    def reserve(self, n: int) -> int:
        """The first of ``n`` values in a row."""
        first = self.start if self.last is None else self.last + self.increment
        last = first + self.increment * (n - 1)
        if not self.least <= last <= self.most or not self.least <= first <= self.most:
            if not self.cycle:
                raise SqlError("2200H", "nextval: reached maximum value of sequence" if self.increment > 0 else "nextval: reached minimum value of sequence")
            first = self.least if self.increment > 0 else self.most
            last = first + self.increment * (n - 1)
        self.last = last
        return first


@dataclass
class State:
    """What a transaction can undo."""

    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, Node] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    domains: dict[str, Node] = field(default_factory=dict)
    functions: dict[str, list[Node]] = field(default_factory=dict)
    schemas: set[str] = field(default_factory=lambda: {"public"})
    triggers: dict[str, list[Node]] = field(default_factory=dict)

    def copied(self) -> State:
        return State(*(copy.copy(getattr(self, f)) for f in ("tables", "views", "enums", "domains", "functions", "schemas", "triggers")))


class Catalog:
    def __init__(self, engine: Engine):
        self.engine = engine
        self.state = State()
        self.sequences: dict[str, Sequence] = {}
        self.current: dict[str, int] = {}
        self.last_sequence: str | None = None
        self.prepared: dict[str, Node] = {}
        self.settings: dict[str, str] = {"search_path": "public", "timezone": "UTC", "server_version": "16.0"}
        self.channels: set[str] = set()
        self.aborted = False
        self.saved: list[tuple[str, State]] = []  # the transaction's begin, then its savepoints

    # transactions

    def gate(self, node: Node) -> None:
        if self.aborted and node.kind not in ("rollback", "rollback_to", "commit"):
            raise SqlError("25P02", "current transaction is aborted, commands ignored until end of transaction block")

    def failed(self, node: Node) -> None:
        if self.saved:
            self.aborted = True

    def _restore(self, state: State) -> None:
        self.state = state.copied()
        for name, table in self.state.tables.items():
            self._show(table)
            del name

    def do_begin(self, node, params):
        if not self.saved:
            self.saved = [("", self.state.copied())]

    def do_commit(self, node, params):
        if self.aborted:
            self._restore(self.saved[0][1])
        self.saved, self.aborted = [], False

    def do_rollback(self, node, params):
        if self.saved:
            self._restore(self.saved[0][1])
        self.saved, self.aborted = [], False

    def do_savepoint(self, node, params):
        if not self.saved:
            raise SqlError("25P01", "SAVEPOINT can only be used in transaction blocks")
        self.saved.append((node.name, self.state.copied()))

    def _savepoint(self, name: str) -> int:
        for i in range(len(self.saved) - 1, 0, -1):
            if self.saved[i][0] == name:
                return i
        raise SqlError("3B001", f'savepoint "{name}" does not exist')

    def do_release(self, node, params):
        del self.saved[self._savepoint(node.name) :]

    def do_rollback_to(self, node, params):
        at = self._savepoint(node.name)
        self._restore(self.saved[at][1])
        del self.saved[at + 1 :]
        self.aborted = False

    # names

    @property
    def enums(self) -> dict[str, list[str]]:
        return self.state.enums

    def domain_types(self) -> dict[str, Node]:
        return {name: d.base for name, d in self.state.domains.items()}

    def table(self, name: str) -> Table:
        if name not in self.state.tables:
            raise SqlError("42P01", f'relation "{name}" does not exist')
        return self.state.tables[name]

    def relation(self, what: tuple[str, str]):
        kind, name = what
        if kind == "enum":
            for t in self.state.tables.values():
                for c in t.columns:
                    if c.name == name and c.type.name in self.enums and not c.type.dims:
                        return self.enums[c.type.name]
            return None
        if name in self.state.views:
            view = self.state.views[name]
            columns = f"({', '.join(map(quoted, view.columns))})" if view.columns else ""
            return f"(SELECT * FROM ({self.low().query(view.query)}) AS v{columns})"
        return information.relation(self, name)

    def low(self, params: list | None = None) -> Lowering:
        return self.engine.lowering(params)

    def execute(self, node: Node, params: list) -> DataFrame | None:
        return getattr(self, "do_" + node.kind)(node, params)

    # table contents

    def frame(self, table: Table, rid: bool = False) -> DataFrame:
        spark = self.engine.spark
        if not table.files:
            df = spark.createDataFrame([], table.schema())
            return df.withColumn("__rid", F.lit("")) if rid else df
        df = spark.read.schema(table.schema()).parquet(*table.files)
        return df.select("*", F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias("__rid")) if rid else df

    def _show(self, table: Table) -> None:
        self.frame(table).createOrReplaceTempView(quoted(table.name))
        self.engine._kinds.clear()

    def _put(self, table: Table) -> None:
        self.state.tables[table.name] = table
        self._show(table)

    def _write(self, df: DataFrame, table: Table) -> str:
        path = new_path(self.engine.spark, f"table-{table.name.replace('.', '-')}")
        df.select(*(F.col(quoted(c.name)).cast(c.spark).alias(c.name) for c in table.columns)).write.parquet(path)
        return path

    def _replaced(self, table: Table, gone: DataFrame, rows: DataFrame | None) -> Table:
        """The table without the rows ``gone`` (__rid) and with ``rows``: only files that hold such rows are written anew."""
        file = F.expr("substring(__rid, 1, char_length(__rid) - char_length(substring_index(__rid, ':', -1)) - 1)")
        plain = lambda path: re.sub(":/+", ":/", path, count=1)  # noqa: E731  one spelling of a file system's root
        touched = {plain(r[0]) for r in gone.select(file.alias("file")).distinct().collect()}  # names of files of the table
        kept, changed = [], []
        for path in table.files:
            parts = self.engine.spark.read.schema(table.schema()).parquet(path).inputFiles()
            hit = [f for f in parts if plain(f) in touched]
            kept += [f for f in parts if plain(f) not in touched] if hit else [path]
            changed += hit
        if len(changed) < len(touched):  # names that are spelt in another way: then all is written
            kept, changed = [], list(table.files)
        left = self.frame(replace(table, files=tuple(changed)), rid=True).join(gone.select("__rid"), "__rid", "left_anti").drop("__rid")
        return replace(table, files=(*kept, self._write(left if rows is None else left.unionByName(rows), table)))

    def _checked(self, table: Table, delta: DataFrame) -> None:
        """NOT NULL, CHECK, enum and domain rules of new rows, all in one pass, and their foreign keys."""
        rules: list[tuple[str, SqlError]] = []
        for c in table.columns:
            domain, name = self.state.domains.get(c.type.name), quoted(c.name)
            if c.not_null or (domain and domain.column.not_null):
                rules.append((f"{name} IS NULL", SqlError("23502", f'null value in column "{c.name}" of relation "{table.name}" violates not-null constraint')))
            if c.type.name in self.enums and not c.type.dims:
                labels = ", ".join(map(literal, self.enums[c.type.name]))
                rules.append((f"{name} NOT IN ({labels})", SqlError("22P02", f"invalid input value for enum {c.type.name}")))
        tests = [(c.name or f"{table.name}_check", self._test(table, c.test)) for c in table.constraints if c.kind_ == "check"]
        for c in table.columns:
            domain = self.state.domains.get(c.type.name)
            for x in domain.column.constraints if domain else []:
                tests.append((x.name or f"{c.type.name}_check", self._test(table, x.test).replace(quoted("value"), quoted(c.name))))
        rules += [(f"NOT ({test})", SqlError("23514", f'new row for relation "{table.name}" violates check constraint "{name}"')) for name, test in tests]
        if rules:
            found = delta.selectExpr(*(f"coalesce({test}, false) AS r{i}" for i, (test, _) in enumerate(rules))).selectExpr(*(f"bool_or(r{i}) AS r{i}" for i in range(len(rules)))).first()
            for broken, (_, error) in zip(found, rules, strict=True):
                if broken:
                    raise error
        for c in table.constraints:
            if c.kind_ == "foreign":
                parent = self.table(c.parent) if c.parent != table.name else table
                keys = c.keys or next((k.columns for k in parent.keys() if k.kind_ == "primary"), c.columns)
                have = self.frame(parent).select(*[F.col(quoted(k)).alias(f"__p{i}") for i, k in enumerate(keys)])
                need = delta.select(*[F.col(quoted(k)).alias(f"__c{i}") for i, k in enumerate(c.columns)]).dropna()
                on = [F.col(f"__c{i}") == F.col(f"__p{i}") for i in range(len(keys))]
                if c.parent == table.name:
                    have = have.union(delta.select(*[F.col(quoted(k)) for k in keys]))
                if not need.join(have, on, "left_anti").isEmpty():
                    raise SqlError("23503", f'insert or update on table "{table.name}" violates foreign key constraint')

    def _test(self, table: Table, test: Node) -> str:
        source = ", ".join(f"CAST(NULL AS {c.spark}) AS {quoted(c.name)}" for c in table.columns)
        return self.low().expr(test, Scope(f"(SELECT {source}) AS {quoted(table.name)}"))

    def _unique(self, table: Table, delta: DataFrame | None = None, others: DataFrame | None = None) -> None:
        """Unique keys hold: among all rows, or of ``delta`` against itself and ``others``, whose keys hold already."""
        rows = self.frame(table) if delta is None else delta
        keys = [([quoted(k) for k in key.columns], key.name or f"{table.name}_pkey" if key.kind_ == "primary" else key.name or f"{table.name}_key") for key in table.keys()]
        keys += [(list(columns), name) for name, unique, columns in table.indexes if unique]
        for columns, name in keys:
            named = [f"{c} AS __k{i}" for i, c in enumerate(columns)]
            ours = rows.selectExpr(*named).dropna()
            own = [f"__k{i}" for i in range(len(columns))]
            twice = ours.groupBy(*own).count().filter("count > 1").select(F.lit(1))
            if others is not None:
                twice = twice.unionAll(others.selectExpr(*named).join(ours, own, "left_semi").select(F.lit(1)))
            if not twice.isEmpty():
                raise SqlError("23505", f'duplicate key value violates unique constraint "{name}"')

    def _keyed(self, table: Table) -> set[str]:
        """Columns of unique keys; all columns if an index has expressions."""
        out = {k for key in table.keys() for k in key.columns}
        for _, unique, columns in table.indexes:
            if unique:
                out |= {c.name for c in table.columns if any(quoted(c.name) in x for x in columns)}
        return out

    # changes through views

    def _columns(self, name: str) -> list[str]:
        if name in self.state.views:
            return list(columns_below(self.state.views[name], self._columns)[1])
        return [c.name for c in self.table(name).columns]

    def _through(self, node, params):
        """A change of a view: its INSTEAD OF triggers, or the same change of the table below."""
        view = self.state.views[node.table]
        if self.state.triggers.get(node.table):
            raise SqlError("0A000", "INSTEAD OF triggers are not supported")
        if view.checked and node.kind != "delete":
            raise SqlError("0A000", f'changes through view "{view.name}" WITH CHECK OPTION are not supported')
        return self.execute(through(node, view, self._columns), params)

    # INSERT

    def do_insert(self, node, params):
        if node.table in self.state.views:
            return self._through(node, params)
        table = self.table(node.table)
        targets = node.columns or [c.name for c in table.columns][: self._width(node.source)]
        triggers.statement(self, table, "before", "insert")
        delta = self._incoming(table, node, targets, params)
        if self.state.triggers.get(table.name):
            shown = triggers.before(self, table, "insert", delta.select(F.struct("*").alias("new"), _nothing(table)))
            delta = self._generated(table, shown.select("new.*"))
        delta = stored(delta, "delta")
        self._checked(table, delta)
        if node.conflict:
            return self._upsert(table, node, delta, params)
        self._unique(table, delta, self.frame(table) if table.files else None)
        self._put(replace(table, files=(*table.files, self._write(delta, table))))
        self._fired(table, "insert", delta.select(F.struct("*").alias("new"), _nothing(table)))
        return self._returning(table, node.alias or table.name, node.returning, delta, params)

    def _fired(self, table: Table, event: str, rows: DataFrame, assigned: set[str] | None = None) -> None:
        """AFTER triggers of an event."""
        if self.state.triggers.get(table.name):
            triggers.after(self, table, event, rows, assigned)
            triggers.statement(self, table, "after", event, assigned)

    @staticmethod
    def _width(source: Node | None) -> int | None:
        body = source.body if source is not None and source.kind == "query" else source
        return len(body.rows[0]) if body is not None and body.kind == "values" else None

    def _default(self, table: Table, column: Column) -> Node:
        return column.default if column.default is not None else Node("word", text="null")

    def _serial(self, column: Column) -> str | None:
        """The sequence that numbers a column's new rows."""
        d = column.default
        return d.args[0].value if d is not None and d.kind == "call" and d.name == "nextval" and d.args and d.args[0].kind in ("string", "cast") and hasattr(d.args[0], "value") else None

    def _incoming(self, table: Table, node, targets: list[str], params: list) -> DataFrame:
        low, given = self.low(params), {}
        for t in targets:
            c = table.column(t)
            if c.generated is not None:
                raise SqlError("428C9", f'cannot insert a non-DEFAULT value into column "{t}"')
        source = node.source
        body = source.body if source is not None and source.kind == "query" else source
        numbered: set[str] = set()
        if body is None:
            df = self.engine.frame("SELECT 1 AS __one")
        else:
            if body.kind == "values":
                for i, t in enumerate(targets):
                    column = table.column(t)
                    marks = [row[i].kind == "default" for row in body.rows]
                    if any(marks) and self._serial(column):
                        if not all(marks):
                            raise SqlError("0A000", "DEFAULT of a numbered column must stand in all rows or none")
                        numbered.add(t)
                body = Node("values", rows=[[self._default(table, table.column(t)) if x.kind == "default" and t not in numbered else Node("word", text="null") if x.kind == "default" else x for x, t in zip(row, targets, strict=False)] for row in body.rows])
                if len(body.rows[0]) > len(targets):
                    raise SqlError("42601", "INSERT has more expressions than target columns")
            sql = low.query(Node("query", ctes=[*node.ctes, *(source.ctes if source.kind == "query" else [])], recursive=node.recursive, body=body, order=getattr(source, "order", None), limit=getattr(source, "limit", None), offset=getattr(source, "offset", None)))
            df = self.engine.frame(sql)
            if len(df.columns) > len(targets):
                raise SqlError("42601", "INSERT has more expressions than target columns")
            df = df.toDF(*[f"__v{i}" for i in range(len(df.columns))])
            given = {t: f"__v{i}" for i, t in enumerate(targets[: len(df.columns)]) if t not in numbered}
        serials = {c.name: s for c in table.columns if c.name not in given and (s := self._serial(c))}
        if serials:
            one = body is not None and body.kind == "values"  # rows that are written out are numbered in their order
            df = stored(df.coalesce(1) if one else df, "incoming")
            n = df.count()
            place = _places(df)
            for name, sequence in serials.items():
                first = self._sequence(sequence).reserve(max(n, 1)) if n else 0
                self.current[sequence], self.last_sequence = self._sequence(sequence).last, sequence
                df = df.withColumn(f"__s_{name}", F.lit(first) + place * F.lit(self._sequence(sequence).increment))
        columns = []
        for c in table.columns:
            if c.name in given:
                columns.append(f"{self._coerced(c, given[c.name], df)} AS {quoted(c.name)}")
            elif c.name in serials:
                columns.append(f"CAST({quoted('__s_' + c.name)} AS {c.spark}) AS {quoted(c.name)}")
            elif c.generated is not None:
                columns.append(f"CAST(NULL AS {c.spark}) AS {quoted(c.name)}")
            else:
                columns.append(f"CAST({low.expr(self._default(table, c), Scope())} AS {c.spark}) AS {quoted(c.name)}")
        return self._generated(table, df.selectExpr(*columns))

    def _coerced(self, column: Column, value: str, df: DataFrame) -> str:
        kind = column.type
        base = self.state.domains[kind.name].base if kind.name in self.state.domains else kind
        if base.name in ("varchar", "character varying") and base.args and not base.dims:
            return f"CASE WHEN char_length({value}) > {base.args[0]} THEN raise_error('value too long for type character varying({base.args[0]})') ELSE CAST({value} AS string) END"
        if df.schema[value].dataType.simpleString() == "void":
            return f"CAST(NULL AS {column.spark})"
        return f"CAST({value} AS {column.spark})"

    def _generated(self, table: Table, df: DataFrame) -> DataFrame:
        made = {c.name: f"CAST({self._test(table, c.generated)} AS {c.spark})" for c in table.columns if c.generated is not None}
        return df.selectExpr(*(f"{made.get(c.name, quoted(c.name))} AS {quoted(c.name)}" for c in table.columns)) if made else df

    def _upsert(self, table: Table, node, delta: DataFrame, params: list):
        conflict = node.conflict
        keys = conflict.target
        if conflict.constraint:
            keys = next((k.columns for k in table.keys() if conflict.constraint in (k.name, f"{table.name}_pkey" if k.kind_ == "primary" else f"{table.name}_{'_'.join(k.columns)}_key")), None)
        if keys is None:
            found = table.keys()
            if conflict.assign is not None or not found:
                raise SqlError("42601", "ON CONFLICT DO UPDATE requires inference specification or constraint name")
            keys = found[0].columns
        elif not any(set(k.columns) == set(keys) for k in table.keys()) and not any(unique and set(c.strip("`") for c in columns) == set(keys) for _, unique, columns in table.indexes):
            raise SqlError("42P10", "there is no unique or exclusion constraint matching the ON CONFLICT specification")
        names = [quoted(k) for k in keys]
        there = self.frame(table, rid=True)
        fresh = delta.join(there.select(*names), keys, "left_anti").select(*[quoted(c.name) for c in table.columns])
        repeated = not delta.select(*names).dropna().groupBy(*names).count().filter("count > 1").isEmpty()
        if conflict.assign is None:
            whole = fresh.filter(" AND ".join(f"{n} IS NOT NULL" for n in names))
            fresh = (whole.dropDuplicates(keys) if repeated else whole).unionByName(fresh.filter(" OR ".join(f"{n} IS NULL" for n in names)))
            fresh = stored(fresh, "fresh")
            self._unique(table, fresh, self.frame(table))
            after = replace(table, files=(*table.files, self._write(fresh, table)))
            changed = fresh
        else:
            if repeated:
                raise SqlError("21000", "ON CONFLICT DO UPDATE command cannot affect row a second time")
            alias = node.alias or table.name
            there.createOrReplaceTempView("__upsert_old")
            delta.createOrReplaceTempView("__upsert_new")
            on = " AND ".join(f"{quoted(alias)}.{n} = excluded.{n}" for n in names)
            scope = Scope(f"`__upsert_old` AS {quoted(alias)} JOIN `__upsert_new` AS excluded ON {on}")
            updated = self._changed(table, alias, conflict.assign, scope, conflict.where, params)
            fresh = stored(fresh, "fresh")
            changed = updated.drop("__rid").unionByName(fresh)
            self._checked(table, updated.drop("__rid"))
            self._unique(table, changed, there.join(updated.select("__rid"), "__rid", "left_anti"))
            after = self._replaced(table, updated.select("__rid"), changed)
        self._put(after)
        return self._returning(table, node.alias or table.name, node.returning, changed, params)

    # UPDATE and DELETE

    def _changed(self, table: Table, alias: str, assign: list, scope: Scope, where: Node | None, params: list) -> DataFrame:
        """The new rows (all columns and __rid) of the target's rows that a join and condition pick."""
        low, values = self.low(params), {}
        for columns, value in assign:
            parts = [value]
            if len(columns) > 1:
                if value.kind == "scalar":
                    parts = [self._part(value, i) for i in range(len(columns))]
                elif value.kind == "row" and len(value.items) == len(columns):
                    parts = value.items
                else:
                    raise SqlError("42601", "number of columns does not match number of values")
            for name, part in zip(columns, parts, strict=True):
                column = table.column(name)
                if column.generated is not None:
                    raise SqlError("428C9", f'column "{name}" can only be updated to DEFAULT')
                part = self._default(table, column) if part.kind == "default" else part
                sql = low.expr(self._owned(part, alias, table), scope)
                values[name] = f"CAST({sql} AS {column.spark})" if not (part.kind == "word" and part.text == "null") else f"CAST(NULL AS {column.spark})"
        columns = ", ".join(f"{values.get(c.name, f'{quoted(alias)}.{quoted(c.name)}')} AS {quoted(c.name)}" for c in table.columns)
        test = f" WHERE {low.expr(self._owned(where, alias, table), scope)}" if where is not None else ""
        df = self.engine.frame(f"SELECT {quoted(alias)}.__rid AS __rid, {columns} FROM {scope.source}{test}")
        if "," in scope.source or " JOIN " in scope.source:  # several sources for a row: the least values count
            fields = [quoted(c.name) for c in table.columns]
            df = df.groupBy("__rid").agg(F.min(F.struct(*fields)).alias("__row")).select("__rid", "__row.*")
        rid = df.select("__rid", *[quoted(c.name) for c in table.columns])
        return stored(self._regenerated(table, rid), "changed")

    @staticmethod
    def _part(value: Node, i: int) -> Node:
        query = copy.deepcopy(value.query)
        core = query.body if query.kind == "query" else query
        core.items = [core.items[i]]
        return Node("scalar", query=query)

    def _owned(self, e: Any, alias: str, table: Table) -> Any:
        """Bare column names of the target, written with its alias (so that EXCLUDED or FROM do not clash)."""
        own = {c.name for c in table.columns}

        def walk(x):
            if isinstance(x, Node):
                if x.kind == "column" and len(x.parts) == 1 and x.parts[0] in own:
                    return Node("column", parts=[alias, x.parts[0]])
                if x.kind in ("query", "core", "setop"):
                    return x
                return Node(x.kind, **{k: walk(v) for k, v in x.__dict__.items() if k != "kind"})
            if isinstance(x, list):
                return [walk(v) for v in x]
            return tuple(walk(v) for v in x) if isinstance(x, tuple) else x

        return walk(e)

    def _with(self, node, sql: str) -> str:
        return sql

    def _target(self, table: Table, alias: str, source: list[Node] | None, ctes: list[Node], params: list) -> Scope:
        for cte in ctes:
            self.engine.frame(self.low(params).query(cte.body)).createOrReplaceTempView(cte.name)
        view = f"__rid_{table.name}"
        self.frame(table, rid=True).createOrReplaceTempView(quoted(view))
        self.engine._kinds.clear()
        nodes = [Node("table", name=view, alias=alias, columns=None), *(source or [])]
        return Scope(self.low(params).from_(nodes, None))

    def do_update(self, node, params):
        if node.table in self.state.views:
            return self._through(node, params)
        table = self.table(node.table)
        alias = node.alias or table.name
        assigned = {name for names, _ in node.assign for name in names}
        triggers.statement(self, table, "before", "update", assigned)
        scope = self._target(table, alias, node.source, node.ctes, params)
        changed = self._changed(table, alias, node.assign, scope, node.where, params)
        fields = [quoted(c.name) for c in table.columns]
        both = None
        if self.state.triggers.get(table.name):
            was = self.frame(table, rid=True).select("__rid", F.struct(*fields).alias("old"))
            both = changed.select("__rid", F.struct(*fields).alias("new")).join(was, "__rid")
            both = triggers.before(self, table, "update", both, assigned)
            both = stored(both, "both")
            changed = stored(self._regenerated(table, both.select("__rid", "new.*")), "changed")
        rows = changed.drop("__rid")
        if not changed.isEmpty():
            self._checked(table, rows)
            old = self.frame(table, rid=True)
            if assigned & self._keyed(table) or self.state.triggers.get(table.name) or any(c.generated is not None for c in table.columns):
                self._unique(table, rows, old.join(changed.select("__rid"), "__rid", "left_anti"))
            after = self._replaced(table, changed.select("__rid"), rows)
            before = old.join(changed.withColumnsRenamed({c.name: f"__new_{c.name}" for c in table.columns}), "__rid")
            self._put(after)
            self._referenced(after, before, assigned)
        if both is not None:
            self._fired(table, "update", both.select("new", "old"), assigned)
        return self._returning(table, alias, node.returning, rows, params)

    def _regenerated(self, table: Table, rid: DataFrame) -> DataFrame:
        made = {c.name: f"CAST({self._test(table, c.generated)} AS {c.spark})" for c in table.columns if c.generated is not None}
        return rid.selectExpr("__rid", *(f"{made.get(c.name, quoted(c.name))} AS {quoted(c.name)}" for c in table.columns)) if made else rid

    def do_delete(self, node, params):
        if node.table in self.state.views:
            return self._through(node, params)
        table = self.table(node.table)
        alias = node.alias or table.name
        scope = self._target(table, alias, node.source, node.ctes, params)
        triggers.statement(self, table, "before", "delete")
        low = self.low(params)
        test = f" WHERE {low.expr(node.where, scope)}" if node.where is not None else ""
        gone = stored(self.engine.frame(f"SELECT DISTINCT {quoted(alias)}.__rid AS __rid FROM {scope.source}{test}"), "gone")
        old = self.frame(table, rid=True)
        if self.state.triggers.get(table.name):
            fields = [quoted(c.name) for c in table.columns]
            shown = old.join(gone, "__rid").select("__rid", _nothing(table, "new"), F.struct(*fields).alias("old"))
            gone = stored(triggers.before(self, table, "delete", shown).select("__rid"), "gone")
        rows = stored(old.join(gone, "__rid").drop("__rid"), "deleted")
        self._remove(table, gone)
        self._fired(table, "delete", rows.select(_nothing(table, "new"), F.struct("*").alias("old")))
        return self._returning(table, alias, node.returning, rows, params)

    def _remove(self, table: Table, gone: DataFrame) -> None:
        """Take rows out of a table, with what their deletion asks of tables that refer to them."""
        old = self.frame(table, rid=True)
        removed = stored(old.join(gone, "__rid"), "removed")
        if removed.isEmpty():
            return
        after = self._replaced(table, gone, None)
        self._put(after)
        self._referenced(after, removed, None)

    def _referenced(self, parent: Table, before: DataFrame, updated: set[str] | None) -> None:
        """Foreign-key actions in child tables after parent rows went (or their keys changed)."""
        for child in list(self.state.tables.values()):
            for c in child.constraints:
                if c.kind_ != "foreign" or c.parent != parent.name:
                    continue
                keys = c.keys or next((k.columns for k in parent.keys() if k.kind_ == "primary"), c.columns)
                if updated is not None and not updated & set(keys):
                    continue
                new = [F.col(f"__new_{k}") if updated is not None else F.lit(None) for k in keys]
                lost = before.select(*[F.col(quoted(k)).alias(f"__p{i}") for i, k in enumerate(keys)], *[n.alias(f"__n{i}") for i, n in enumerate(new)])
                still = self.frame(parent).select(*[F.col(quoted(k)).alias(f"__q{i}") for i, k in enumerate(keys)])
                lost = lost.join(still, [F.col(f"__p{i}") == F.col(f"__q{i}") for i in range(len(keys))], "left_anti")
                rows = self.frame(self.table(child.name), rid=True)
                on = [F.col(quoted(k)) == F.col(f"__p{i}") for i, k in enumerate(c.columns)]
                hit = stored(rows.join(lost, on), "referring")
                if hit.isEmpty():
                    continue
                action = c.on_delete if updated is None else c.on_update
                if action in ("no action", "restrict"):
                    raise SqlError("23503", f'update or delete on table "{parent.name}" violates foreign key constraint on table "{child.name}"')
                if action == "cascade" and updated is None:
                    self._remove(self.table(child.name), hit.select("__rid").distinct())
                    continue
                target = self.table(child.name)
                values = {k: F.col(f"__n{i}") if action == "cascade" else F.lit(None) if action == "set null" else F.expr(self.low().expr(self._default(target, target.column(k)), Scope())) for i, k in enumerate(c.columns)}
                fresh = stored(hit.select("__rid", *[values.get(x.name, F.col(quoted(x.name))).cast(x.spark).alias(x.name) for x in target.columns]), "changed")
                self._checked(target, fresh.drop("__rid"))
                self._put(self._replaced(target, fresh.select("__rid"), fresh.drop("__rid")))

    def _returning(self, table: Table, alias: str, items: list | None, rows: DataFrame, params: list) -> DataFrame | None:
        if items is None:
            return None
        view = f"__returned_{table.name}"
        rows.createOrReplaceTempView(quoted(view))
        self.engine._kinds.clear()
        low = self.low(params)
        scope = Scope(f"{quoted(view)} AS {quoted(alias)}")
        return self.engine.frame(f"SELECT {', '.join(low.item(i, scope) for i in items)} FROM {scope.source}")

    def do_truncate(self, node, params):
        names = set(node.names)
        for name in node.names:
            for child in self.state.tables.values():
                if any(c.kind_ == "foreign" and c.parent == name for c in child.constraints) and child.name not in names:
                    if not node.cascade:
                        raise SqlError("0A000", "cannot truncate a table referenced in a foreign key constraint")
                    names.add(child.name)
        for name in names:
            table = self.table(name)
            self._put(replace(table, files=()))
            if node.restart:
                for c in table.columns:
                    if s := self._serial(c):
                        self._sequence(s).last = None

    # definitions

    def _column(self, table: str, c: Node) -> tuple[Column, list[Node]]:
        kind, default, not_null = c.type, c.default, c.not_null
        if kind.name in ("serial", "bigserial", "smallserial", "serial4", "serial8") or c.identity:
            sequence = f"{table}_{c.name}_seq"
            options = getattr(c, "sequence", {}) or {}
            self.sequences[sequence] = Sequence(start=options.get("start") or 1, increment=options.get("increment") or 1)
            default, not_null = Node("call", name="nextval", args=[Node("string", value=sequence)], named={}, star=False, distinct=False, order=None, filter=None, over=None), True
        domain = self.state.domains.get(kind.name)
        if domain and default is None:
            default = domain.column.default
        return Column(c.name, kind, self.low().type_(kind), default, not_null, c.generated, c.identity), list(c.constraints)

    def do_create_table(self, node, params):
        if node.name in self.state.tables or node.name in self.state.views:
            if node.if_not_exists:
                return
            raise SqlError("42P07", f'relation "{node.name}" already exists')
        columns, constraints = [], list(node.constraints)
        for c in node.columns:
            column, own = self._column(node.name, c)
            columns.append(column)
            constraints += own
        primary = {k for c in constraints if c.kind_ == "primary" for k in c.columns}
        columns = [replace(c, not_null=True) if c.name in primary else c for c in columns]
        table = Table(node.name, tuple(columns), tuple(constraints))
        for c in constraints:
            if c.kind_ == "foreign" and c.parent != node.name:
                self.table(c.parent)
            for k in c.columns:
                table.column(k)
        self._put(table)

    def do_create_table_as(self, node, params):
        if node.name in self.state.tables:
            if node.if_not_exists:
                return
            raise SqlError("42P07", f'relation "{node.name}" already exists')
        df = self.engine.frame(self.low(params).query(node.query))
        if node.columns:
            df = df.toDF(*node.columns)
        table = Table(node.name, tuple(Column(f.name, Node("type", name="text", args=[], dims=0), f.dataType.simpleString()) for f in df.schema))
        self._put(replace(table, files=(self._write(df, table),)))

    def load(self, name: str, df: DataFrame, key: list[str] | None = None) -> None:
        """A table with a frame's columns and rows; ``key`` is its primary key."""
        names = {"int": "int", "bigint": "bigint", "double": "double precision", "string": "text", "boolean": "boolean", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamptz"}
        columns = tuple(Column(f.name, Node("type", name=names.get(f.dataType.simpleString(), "text"), args=[], dims=0), f.dataType.simpleString(), not_null=f.name in (key or [])) for f in df.schema)
        constraints = (Node("constraint", kind_="primary", name=None, columns=key),) if key else ()
        table = Table(name, columns, constraints)
        self._put(replace(table, files=(self._write(df, table),)))

    def do_create_view(self, node, params):
        if node.name in self.state.tables or (node.name in self.state.views and not node.replace):
            raise SqlError("42P07", f'relation "{node.name}" already exists')
        self.engine.frame(self.low().query(node.query))  # must be valid
        self.state.views[node.name] = node
        self.engine._kinds.clear()

    def do_create_schema(self, node, params):
        self.state.schemas.add(node.name)

    def do_create_type(self, node, params):
        self.state.enums[node.name] = node.labels

    def do_alter_type(self, node, params):
        labels = list(self.enums[node.name])
        if node.label in labels:
            if node.if_not_exists:
                return
            raise SqlError("42710", f'enum label "{node.label}" already exists')
        at = len(labels) if node.place is None else labels.index(node.place[1]) + (node.place[0] == "after")
        self.state.enums[node.name] = [*labels[:at], node.label, *labels[at:]]

    def do_create_domain(self, node, params):
        self.state.domains[node.name] = node

    def do_create_index(self, node, params):
        table = self.table(node.table)
        low, scope = self.low(), Scope(quoted(table.name))
        columns = tuple(low.expr(c, scope) for c in node.columns)
        after = replace(table, indexes=(*table.indexes, (node.name or f"{table.name}_idx", node.unique, columns)))
        if node.unique:
            self._unique(after)
        self._put(after)

    def do_create_function(self, node, params):
        types = [self.low().type_(a.type) for a in self._takes(node)]
        others = [f for f in self.state.functions.get(node.name, []) if [self.low().type_(a.type) for a in self._takes(f)] != types]
        node.known_as = node.name if not others else f"{node.name}__{'_'.join(re.sub('[^a-z0-9]', '', t) for t in types)}"
        if node.language == "sql":
            self._sql_function(node)
        elif node.language != "plpgsql":
            raise SqlError("42704", f'language "{node.language}" does not exist')
        self.state.functions[node.name] = [*others, node]

    def _sql_function(self, node) -> None:
        """A SQL function as Spark's own: its last query over the arguments."""
        low = self.low()
        args = [a for a in node.args if a.mode in ("in", "inout", "variadic")]
        names = [a.name or f"arg{i + 1}" for i, a in enumerate(args)]
        low.param_names = names
        last = Parser(node.body).statements()[-1]
        declared = ", ".join(f"{quoted(n)} {low.type_(a.type)}{f' DEFAULT {low.expr(a.default, Scope())}' if a.default is not None else ''}" for n, a in zip(names, args, strict=True))
        body = low.query(last, Scope("(SELECT " + ", ".join(f"CAST(NULL AS {low.type_(a.type)}) AS {quoted(n)}" for n, a in zip(names, args, strict=True)) + ")") if names else None)
        if node.setof:
            columns = node.table or [(node.name, node.returns)]
            returns = f"TABLE ({', '.join(f'{quoted(n)} {low.type_(t)}' for n, t in columns)})"
            sql = f"CREATE OR REPLACE TEMPORARY FUNCTION {quoted(node.known_as)}({declared}) RETURNS {returns} RETURN {body}"
        else:
            value = f"({body})"
            if node.strict and names:
                value = f"CASE WHEN {' OR '.join(f'{quoted(n)} IS NULL' for n in names)} THEN NULL ELSE {value} END"
            core = last.body if last.kind == "query" else last
            if core.kind == "core" and not core.source and len(core.items) == 1 and core.where is None:  # a plain expression
                inner = low.expr(core.items[0].expr, Scope())
                value = f"CASE WHEN {' OR '.join(f'{quoted(n)} IS NULL' for n in names)} THEN NULL ELSE {inner} END" if node.strict and names else inner
            sql = f"CREATE OR REPLACE TEMPORARY FUNCTION {quoted(node.known_as)}({declared}) RETURNS {low.type_(node.returns)} RETURN {value}"
        self.engine.frame(sql)

    def do_drop(self, node, params):
        where = {"table": self.state.tables, "view": self.state.views, "sequence": self.sequences, "type": self.state.enums, "domain": self.state.domains, "function": self.state.functions, "procedure": self.state.functions}.get(node.what)
        for name in node.names:
            if node.what == "schema":
                self.state.schemas.discard(name)
            elif node.what == "trigger":
                self.state.triggers[node.table] = [t for t in self.state.triggers.get(node.table, []) if t.name != name]
            elif node.what == "index":
                for t in list(self.state.tables.values()):
                    self.state.tables[t.name] = replace(t, indexes=tuple(i for i in t.indexes if i[0] != name))
            elif where is None or name not in where:
                if not node.if_exists:
                    raise SqlError("42P01" if node.what in ("table", "view") else "42704", f'{node.what} "{name}" does not exist')
            else:
                if node.what == "table":
                    referring = [t for t in self.state.tables.values() if t.name != name and any(c.kind_ == "foreign" and c.parent == name for c in t.constraints)]
                    if referring and not node.cascade:
                        raise SqlError("2BP01", f"cannot drop table {name} because other objects depend on it")
                    for t in referring:
                        self.state.tables[t.name] = replace(t, constraints=tuple(c for c in t.constraints if not (c.kind_ == "foreign" and c.parent == name)))
                    self.engine.spark.catalog.dropTempView(name)
                if node.what in ("function", "procedure"):
                    for f in where[name]:
                        if f.language == "sql":
                            self.engine.frame(f"DROP TEMPORARY FUNCTION IF EXISTS {quoted(f.known_as)}")
                    self.state.triggers.pop(name, None)
                del where[name]
        self.engine._kinds.clear()

    def do_alter_table(self, node, params):
        for a in node.actions:
            table = self.table(node.table)
            getattr(self, "_" + a.kind)(table, a)

    def _rewritten(self, table: Table, after: Table, exprs: dict[str, str]) -> None:
        df = self.frame(table).selectExpr(*(f"{exprs.get(c.name, quoted(c.name))} AS {quoted(c.name)}" for c in after.columns))
        self._put(replace(after, files=(self._write(df, after),) if table.files else ()))

    def _add_column(self, table, a):
        if any(c.name == a.column.name for c in table.columns):
            if a.if_not_exists:
                return
            raise SqlError("42701", f'column "{a.column.name}" of relation "{table.name}" already exists')
        column, own = self._column(table.name, a.column)
        value = "NULL" if column.generated is None and column.default is None else self._test(table, column.generated) if column.generated is not None else self.low().expr(column.default, Scope())
        after = replace(table, columns=(*table.columns, column), constraints=(*table.constraints, *own))
        self._rewritten(table, after, {column.name: f"CAST({value} AS {column.spark})"})
        self._checked(after, self.frame(self.table(table.name)))

    def _drop_column(self, table, a):
        if not any(c.name == a.name for c in table.columns):
            if a.if_exists:
                return
            table.column(a.name)
        after = replace(table, columns=tuple(c for c in table.columns if c.name != a.name), constraints=tuple(c for c in table.constraints if a.name not in c.columns))
        self._put(after)

    def _rename_column(self, table, a):
        table.column(a.name)
        after = replace(table, columns=tuple(replace(c, name=a.to) if c.name == a.name else c for c in table.columns))
        self._rewritten(table, after, {a.to: quoted(a.name)})

    def _rename_table(self, table, a):
        del self.state.tables[table.name]
        self.engine.spark.catalog.dropTempView(table.name)
        self._put(replace(table, name=a.to))

    def _rename_constraint(self, table, a):
        for c in table.constraints:
            if c.name == a.name:
                c.name = a.to

    def _set_default(self, table, a):
        table.column(a.name)
        self._put(replace(table, columns=tuple(replace(c, default=a.default) if c.name == a.name else c for c in table.columns)))

    def _set_not_null(self, table, a):
        after = replace(table, columns=tuple(replace(c, not_null=a.on) if c.name == a.name else c for c in table.columns))
        self._checked(after, self.frame(table))
        self._put(after)

    def _alter_type_of(self, table, a):
        spark = self.low().type_(a.type)
        value = self.low().expr(a.using, Scope(quoted(table.name))) if a.using is not None else quoted(a.name)
        after = replace(table, columns=tuple(replace(c, type=a.type, spark=spark) if c.name == a.name else c for c in table.columns))
        self._rewritten(table, after, {a.name: f"CAST({value} AS {spark})"})

    def _add_constraint(self, table, a):
        after = replace(table, constraints=(*table.constraints, a.constraint))
        self._checked(after, self.frame(after))
        self._unique(after)
        self._put(after)

    def _drop_constraint(self, table, a):
        self._put(replace(table, constraints=tuple(c for c in table.constraints if c.name != a.name)))

    # sequences

    def do_create_sequence(self, node, params):
        o = node.options
        if node.name in self.sequences:
            if node.if_not_exists:
                return
            raise SqlError("42P07", f'relation "{node.name}" already exists')
        step = o.get("increment") or 1
        least = o.get("minvalue") or (1 if step > 0 else -(2**63))
        most = o.get("maxvalue") or (2**63 - 1 if step > 0 else -1)
        self.sequences[node.name] = Sequence(o.get("start") or (least if step > 0 else most), step, least, most, bool(o.get("cycle")))

    def do_alter_sequence(self, node, params):
        s, o = self._sequence(node.name), node.options
        s.increment = o.get("increment") or s.increment
        s.least, s.most = o.get("minvalue") or s.least, o.get("maxvalue") or s.most
        s.cycle = bool(o.get("cycle", s.cycle))
        if "restart" in o:
            s.start, s.last = o["restart"] or s.start, None

    def _sequence(self, name: str) -> Sequence:
        if name not in self.sequences:
            raise SqlError("42P01", f'relation "{name}" does not exist')
        return self.sequences[name]

    def numbered(self, name: str, count: str, uses: int, use: int) -> tuple[int, int, int]:
        """The first of a statement's numbers, the sequence's step, and how many numbers a row takes.

        ``count`` is the query of the number of rows; a row takes a number for each of ``uses`` calls, this is call ``use``.
        """
        sequence = self._sequence(name)
        if use == 0:
            rows = self.engine.frame(count).first()[0]
            self.block = sequence.reserve(rows * uses) if rows else 0
            if rows:
                self.current[name], self.last_sequence = sequence.last, name
        return self.block + use * sequence.increment, sequence.increment, uses

    def call(self, name: str, args: list[str], named: dict[str, str], relation: bool, kinds=None) -> str | None:
        """SQL of a function that lives here: sequences (a value per call in the statement) and user functions."""
        plain = [a.strip("'") for a in args]
        if name == "nextval":
            value = self._sequence(plain[0]).reserve(1)
            self.current[plain[0]], self.last_sequence = value, plain[0]
            return f"CAST({value} AS bigint)"
        if name == "currval":
            if plain[0] not in self.current:
                self._sequence(plain[0])
                raise SqlError("55000", f'currval of sequence "{plain[0]}" is not yet defined in this session')
            return f"CAST({self.current[plain[0]]} AS bigint)"
        if name == "lastval":
            if self.last_sequence is None:
                raise SqlError("55000", "lastval is not yet defined in this session")
            return f"CAST({self.current[self.last_sequence]} AS bigint)"
        if name == "setval":
            s = self._sequence(plain[0])
            value, called = int(plain[1]), len(plain) < 3 or plain[2] != "false"
            s.last = value if called else value - s.increment
            if called:
                self.current[plain[0]] = value
            return f"CAST({value} AS bigint)"
        if name in ("pg_get_constraintdef", "pg_get_indexdef", "pg_get_viewdef"):
            told = information.definitions(self, name)
            if name == "pg_get_viewdef" and plain[0] in self.state.views:
                return literal(told[information.oids(self)["relation", plain[0]]])
            arms = " ".join(f"WHEN {oid} THEN {literal(said)}" for oid, said in told.items())
            return f"CASE CAST({args[0]} AS bigint) {arms} END" if arms else "CAST(NULL AS string)"
        if name == "pg_notify":
            self.engine.bus.send(plain[0], plain[1])
            return "NULL"
        if name == "pg_listening_channels":
            return f"array({', '.join(literal(c) for c in sorted(self.channels))})"
        if name in self.state.functions:
            node = self._overload(name, len(args), named, kinds)
            if node.language == "sql":
                return f"{quoted(node.known_as)}({', '.join([*args, *(f'{k} => {v}' for k, v in named.items())])})"
            from .procedural.interpreter import call_with

            return call_with(self.engine, node, args, named)
        return None

    def _takes(self, node: Node) -> list[Node]:
        return [a for a in node.args if a.mode in ("in", "inout", "variadic")]

    def _overload(self, name: str, n: int, named: dict[str, str], kinds) -> Node:
        """The function of this name whose arguments fit best: equal types first, then wider numbers, then any text."""
        known = self.state.functions[name]
        if len(known) == 1:
            return known[0]
        wider = ["smallint", "int", "bigint", "decimal", "float", "double"]
        have = kinds() if kinds else ["unknown"] * n

        def fits(node: Node) -> int:
            takes = self._takes(node)
            if not n + len(named) <= len(takes) or any(a.default is None for a in takes[n:] if a.name not in named):
                return -1
            total = 0
            for a, kind in zip(takes, have, strict=False):
                want, kind = self.low().type_(a.type).split("(")[0], kind.split("(")[0]
                if kind == want:
                    total += 8
                elif kind in wider and want in wider and wider.index(kind) < wider.index(want):
                    total += 7 - (wider.index(want) - wider.index(kind))
                elif kind in ("unknown", "void", ""):
                    total += 2 if want == "string" else 1
                else:
                    return -1
            return total

        best = max(known, key=fits)
        if fits(best) < 0:
            raise SqlError("42883", f"function {name}({', '.join(have)}) does not exist")
        return best

    # session

    def do_set(self, node, params):
        self.settings[node.name] = node.value
        if node.name == "timezone":
            self.engine.spark.conf.set("spark.sql.session.timeZone", node.value)

    def do_reset(self, node, params):
        self.settings.pop(node.name, None)

    def do_show(self, node, params):
        return self.engine.spark.createDataFrame([(self.settings.get(node.name, ""),)], f"{quoted(node.name)} string")

    def do_nothing(self, node, params):
        return None

    def do_prepare(self, node, params):
        if node.name in self.prepared:
            raise SqlError("42P05", f'prepared statement "{node.name}" already exists')
        self.prepared[node.name] = node.statement

    def do_execute(self, node, params):
        if node.name not in self.prepared:
            raise SqlError("26000", f'prepared statement "{node.name}" does not exist')
        low = self.low(params)
        values = [Raw(low.expr(a, Scope())) for a in node.args]
        return self.engine.run(self.prepared[node.name], values)

    def do_deallocate(self, node, params):
        if node.name == "all":
            self.prepared.clear()
        else:
            self.prepared.pop(node.name, None)

    def do_explain(self, node, params):
        df = self.engine.run(node.statement, params)
        if node.analyze:
            df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        return self.engine.spark.createDataFrame([(line,) for line in plan.split("\n")], "`QUERY PLAN` string")

    def do_copy(self, node, params):
        return copying.run(self, node, params)

    def do_listen(self, node, params):
        self.channels.add(node.channel)
        self.engine.bus.listen(self.engine, node.channel)

    def do_unlisten(self, node, params):
        for channel in [node.channel] if node.channel else list(self.channels):
            self.channels.discard(channel)
            self.engine.bus.unlisten(self.engine, channel)

    def do_notify(self, node, params):
        self.engine.bus.send(node.channel, node.payload)

    def do_do(self, node, params):
        from .procedural.interpreter import run_block

        run_block(self.engine, node.body)

    def do_call_procedure(self, node, params):
        from .procedural.interpreter import call_procedure

        return call_procedure(self.engine, node.call, params)

    def do_create_trigger(self, node, params):
        self.table(node.table)
        if node.when == "instead of":
            raise SqlError("0A000", "INSTEAD OF triggers are not supported")
        self.state.triggers[node.table] = [*(t for t in self.state.triggers.get(node.table, []) if t.name != node.name), node]


class Raw(str):
    """SQL that stands for a parameter as it is."""


def _nothing(table: Table, name: str = "old"):
    """The null struct that stands for the row that an event does not have."""
    return F.lit(None).cast(f"struct<{', '.join(f'{quoted(c.name)}: {c.spark}' for c in table.columns)}>").alias(name)


def _places(df: DataFrame):
    """The place of each row of a stored frame, from 0, without bringing rows together."""
    counts = {r[0]: r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()}  # one number a partition
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    first = F.get(F.array(*map(F.lit, before or [0])), F.spark_partition_id()).cast("long")
    return first + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
