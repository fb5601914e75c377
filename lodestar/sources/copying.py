"""COPY between tables or queries and text or CSV files."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dialect.lower import quoted
from ..dialect.parser import Node
from ..errors import SqlError

if TYPE_CHECKING:
    from ..catalog import Catalog


def _options(options: dict) -> tuple[bool, str, str, bool, str]:
    csv = options.get("format", "text") == "csv"
    delimiter = options.get("delimiter", "," if csv else "\t")
    return csv, delimiter, options.get("null", "" if csv else "\\N"), options.get("header", "false") in ("true", "on"), options.get("quote", '"')


def _unescaped(c: Column) -> Column:
    """The text format's backslash escapes, undone (a doubled backslash is kept apart by a control character)."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\x01"))
    for code, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return F.replace(c, F.lit("\x01"), F.lit("\\"))


def read(catalog: Catalog, path: str, columns: list[str], options: dict) -> DataFrame:
    """A file's rows as text columns."""
    csv, delimiter, null, header, quote = _options(options)
    schema = ", ".join(f"{quoted(c)} string" for c in columns)
    reader = catalog.engine.spark.read.schema(schema).option("sep", delimiter).option("mode", "FAILFAST")
    if csv:
        # an empty field is null and a quoted empty one is not, unless another text stands for null
        return reader.option("header", header).option("quote", quote).option("escape", quote).option("nullValue", null).option("emptyValue", "" if null else "").option("multiLine", True).csv(path)
    lines = catalog.engine.spark.read.text(path).filter("value <> '\\\\.'")
    parts = F.split("value", "\\Q" + delimiter + "\\E", -1)
    fields = [F.when(F.get(parts, F.lit(i)) == null, None).otherwise(_unescaped(F.get(parts, F.lit(i)))).alias(c) for i, c in enumerate(columns)]
    return lines.select(*fields)


def lines(df: DataFrame, options: dict) -> DataFrame:
    """A frame's rows as one column ``data`` of formatted lines."""
    csv, delimiter, null, header, quote = _options(options)
    fields = []
    for f in df.schema:
        c = F.col(quoted(f.name))
        kind = f.dataType.simpleString()
        text = F.when(c, "t").otherwise("f") if kind == "boolean" else F.concat(F.lit("{"), F.array_join(c.cast("array<string>"), ",", "NULL"), F.lit("}")) if kind.startswith("array") else c.cast("string")
        if csv:
            special = text.contains(delimiter) | text.contains(quote) | text.contains("\n") | text.contains("\r") | (text == null)
            text = F.when(special, F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(text)
        else:
            text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
            for code, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
                text = F.replace(text, F.lit(char), F.lit(code))
        fields.append(F.when(c.isNull(), F.lit(null)).otherwise(text))
    out = df.select(F.concat_ws(delimiter, *fields).alias("data"))
    if header:
        out = df.sparkSession.createDataFrame([(delimiter.join(df.columns),)], "data string").union(out)
    return out


def run(catalog: Catalog, node: Node, params: list) -> DataFrame | None:
    if node.way == "from":
        if node.where in ("stdin",):
            raise SqlError("0A000", "COPY FROM STDIN needs Engine.copy_in with the lines")
        table = catalog.table(node.table)
        columns = node.columns or [c.name for c in table.columns if c.generated is None]
        return insert(catalog, node.table, columns, read(catalog, node.where, columns, node.options))
    if node.query is not None:
        df = catalog.engine.frame(catalog.low(params).query(node.query))
    else:
        table = catalog.table(node.table)
        df = catalog.frame(table).select(*[quoted(c) for c in node.columns or [c.name for c in table.columns]])
    out = lines(df, node.options)
    if node.where == "stdout":
        return out
    out.write.mode("overwrite").text(node.where)
    return None


def insert(catalog: Catalog, table: str, columns: list[str], df: DataFrame) -> None:
    """Rows of text columns into a table, by way of INSERT."""
    target = catalog.table(table)
    kinds = {c.name: c for c in target.columns}
    cast = [
        F.when(F.col(quoted(c)).isin("t", "true"), True).when(F.col(quoted(c)).isin("f", "false"), False).alias(c) if kinds[c].spark == "boolean" else F.col(quoted(c)).cast(kinds[c].spark).alias(c)
        for c in columns
    ]
    df.select(*cast).createOrReplaceTempView("__copied")
    catalog.engine._kinds.clear()
    source = _selecting(columns)
    catalog.execute(Node("insert", table=table, alias=None, columns=columns, source=source, conflict=None, returning=None, ctes=[], recursive=False), [])


def _selecting(columns: list[str]) -> Node:
    """SELECT columns FROM __copied as a tree."""
    items = [Node("item", expr=Node("column", parts=[c]), alias=c) for c in columns]
    core = Node("core", distinct=False, on=None, items=items, source=[Node("table", name="__copied", alias=None, columns=None)], where=None, group=None, having=None, windows={})
    return Node("query", ctes=[], recursive=False, body=core, order=None, limit=None, offset=None)
