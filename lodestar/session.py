"""The engine: PostgreSQL's dialect over a Spark session."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog
from .dialect.lexer import tokens
from .dialect.lower import Lowering, Scope, quoted
from .dialect.parser import Node, Parser
from .errors import SqlError, translated
from .functions import jsonops
from .operators.recursive import fixpoint
from .sources.copying import insert as copy_rows
from .sources.shipping import importable
from .streaming.notifications import BUS

#: Settings under which Spark's semantics are PostgreSQL's.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.cteRecursionLevelLimit": "10000",
    "spark.sql.cteRecursionRowLimit": "-1",
}


class Engine:
    """One session: its own temporary views, settings, catalog and transaction state."""

    def __init__(self, spark: SparkSession):
        self.spark = importable(spark).newSession()
        for key, value in SETTINGS.items():
            try:
                self.spark.conf.set(key, value)
            except Exception as problem:  # a setting that this Spark does not know or fixes at start
                if "CANNOT_MODIFY" not in str(problem):
                    raise
        self.catalog = Catalog(self)
        self._kinds: dict[str, str | None] = {}
        self._json = False
        self._views = 0
        self.bus = BUS
        self.notices: list[tuple[str, str]] = []  # what RAISE has reported: level and message

    # relations

    def read_parquet(self, name: str, path: str) -> None:
        self.spark.read.parquet(path).createOrReplaceTempView(name)
        self._kinds.clear()

    def _kind_of(self, sql: str) -> str | None:
        if sql not in self._kinds:
            self._use_json(sql)
            try:
                self._kinds[sql] = self.spark.sql(sql).schema[0].dataType.simpleString()
            except Exception:  # an expression that has no type by itself; the caller then takes the plain form
                self._kinds[sql] = None
        return self._kinds[sql]

    def _use_json(self, sql: str) -> None:
        if not self._json and "lodestar_json_" in sql:
            jsonops.register(self.spark)
            self._json = True

    def lowering(self, params: list | None = None) -> Lowering:
        return Lowering(self._kind_of, params, self.catalog.enums, self.catalog.domain_types(), self._fixpoint, self.catalog.call, self.catalog.relation, self.catalog.numbered)

    def _fixpoint(self, low: Lowering, cte: Node, first: str, step: Node, outer: Scope | None) -> str:
        with_ = f"WITH {', '.join(low.ctes)} " if low.ctes else ""
        start = self.spark.sql(with_ + first)
        if cte.columns:
            start = start.toDF(*cte.columns)
        self._views += 1
        name = f"__recursive{self._views}"

        def run(new: DataFrame) -> DataFrame:
            new.createOrReplaceTempView(name)
            low.ctes.append(f"{quoted(cte.name)} AS (SELECT * FROM {name})")
            try:
                return self.spark.sql(f"WITH {', '.join(low.ctes)} {low.query(step, outer)}")
            finally:
                low.ctes.pop()

        fixpoint(start, run).createOrReplaceTempView(f"{name}_all")
        return f"{name}_all"

    # statements

    def to_spark(self, sql: str, params: list | None = None) -> str:
        """The Spark SQL of one query."""
        return self.lowering(params).query(Parser(sql).query())

    def frame(self, spark_sql: str) -> DataFrame:
        self._use_json(spark_sql)
        try:
            return self.spark.sql(spark_sql)
        except Exception as problem:
            known = translated(problem)
            if known is None:
                raise
            raise known from problem

    def sql(self, text: str, params: list | None = None) -> DataFrame:
        """Run statements; the last one's result (an empty frame for those without one)."""
        out: Any = None
        for node in Parser(text).statements():
            out = self.run(node, params)
        if out is None:
            raise SqlError("42601", "no statement")
        return out

    def run(self, node: Node, params: list | None = None) -> DataFrame:
        self.catalog.gate(node)
        try:
            if node.kind in ("query", "core", "setop", "values"):
                return self.frame(self.lowering(params).query(node))
            out = self.catalog.execute(node, params or [])
        except Exception:
            self.catalog.failed(node)
            raise
        return out if out is not None else self.empty()

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "status string")

    def copy_in(self, table: str, lines: list[str], columns: list[str] | None = None, **options: str) -> None:
        """COPY table FROM STDIN with the given lines."""
        from .sources import copying
        from .sources.scratch import new_path

        path = new_path(self.spark, "copy")
        self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
        names = columns or [c.name for c in self.catalog.table(table).columns if c.generated is None]
        copy_rows(self.catalog, table, names, copying.read(self.catalog, path, names, options))

    def notifications(self) -> list[tuple[str, str]]:
        """What has been notified on this engine's channels since the last call."""
        return self.bus.take(self)

    def explain(self, text: str) -> str:
        return self.sql(text)._jdf.queryExecution().toString()

    def collect(self, text: str, params: list | None = None) -> list[tuple]:
        """The rows of a query; runtime errors come with PostgreSQL's SQLSTATE."""
        return self._rows(lambda: self.sql(text, params))

    def collect_frame(self, spark_sql: str) -> list[tuple]:
        """The rows of a lowered query."""
        return self._rows(lambda: self.frame(spark_sql))

    @staticmethod
    def _rows(make) -> list[tuple]:
        try:
            return [tuple(r) for r in make().collect()]
        except SqlError:
            raise
        except Exception as problem:
            known = translated(problem)
            if known is None:
                raise
            raise known from problem


def statements(text: str) -> list[str]:
    """A script cut at its semicolons (not those within strings or bodies)."""
    out, start = [], 0
    for t in tokens(text):
        if t.kind == "op" and t.text == ";" or t.kind == "end":
            if part := re.sub(r"\s+\Z", "", text[start : t.at]).strip():
                out.append(part)
            start = t.end
    return out
