"""All queries of the library's own operators, with the SQL that an independent engine checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames
from ..session import Engine
from . import changes, groups, relations, scalars, selections

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

Query = Callable[[SparkSession, str], DataFrame]


def engine(spark: SparkSession, sf_dir: str, sql: str = "") -> Engine:
    """An engine over the tables of a folder (only those that ``sql`` names)."""
    out = Engine(spark)
    for name in TABLES:
        if not sql or name in sql:
            out.read_parquet(name, f"{sf_dir}/{name}.parquet")
    return out


def _texts() -> dict[str, str | tuple[str, str]]:
    return selections.QUERIES | relations.QUERIES | groups.QUERIES | scalars.QUERIES


def _query(sql: str) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir, sql).sql(sql)


def _band(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "supplier"))
    ranges = supplier.select(F.col("s_suppkey").alias("s"), F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 20).alias("high"))
    return frames.band_join(part.select(F.col("p_partkey").alias("p"), "p_retailprice"), ranges, "p_retailprice", "low", "high", 20.0).select("p", "s")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderpriority")
    grouped = frames.over_groups(orders, "n", F.count("*"), ["o_custkey"], F.col("o_orderpriority").asc(), 1, 0)
    first = frames.distinct_on(grouped, ["o_custkey"], F.col("o_orderpriority").desc(), F.col("o_orderkey").asc())
    return first.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("k"), "n", frames.call("left", "o_orderpriority", "-2").alias("p"))


#: Queries written with DataFrame operators, and their DuckDB SQL.
_FRAMES: dict[str, tuple[Query, str]] = {
    "frame_band_join": (_band, "SELECT p_partkey AS p, s_suppkey AS s FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 20"),
    "frame_operators": (
        _frames,
        "SELECT cust, k, n, p FROM (SELECT o_custkey AS cust, o_orderkey AS k, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n, left(o_orderpriority, -2) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey) AS place FROM orders) WHERE place = 1",
    ),
}


def queries() -> dict[str, Query]:
    """Name → query over (session, folder of tables)."""
    out: dict[str, Query] = {name: _query(sql if isinstance(sql, str) else sql[0]) for name, sql in _texts().items()}
    out |= {name: f for name, (f, _) in _FRAMES.items()}
    return out | {name: (lambda spark, sf_dir, f=f: f(engine(spark, sf_dir))) for name, (f, _) in changes.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name → DuckDB SQL with the same columns and rows."""
    out = {name: sql if isinstance(sql, str) else sql[1] for name, sql in _texts().items()}
    return out | {name: sql for name, (_, sql) in (changes.QUERIES | _FRAMES).items()}
