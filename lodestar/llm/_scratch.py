"""Stored intermediate tables, joins with key tables that are sent to all executors only below a counted size, and
joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, new_path
from ..sources.scratch import stored as written

#: Rows of at most 16 bytes of key that may be sent to every executor; more rows are joined by a shuffle.
SMALL_ROWS = 500_000
#: A key is hot if more than one in this many rows has it, so that there are fewer hot keys than this.
HOT = 1000


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_enough(keys: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether a stored key table is proven to have at most ``rows`` rows."""
    return keys.count() <= rows


def join_keys(big: DataFrame, keys: DataFrame, on, how: str = "left_semi", rows: int = SMALL_ROWS) -> DataFrame:
    """Join a wide table with a stored key table: broadcast below a counted bound, else by shuffle."""
    return big.join(F.broadcast(keys) if small_enough(keys, rows) else keys.hint("merge"), on, how)


def join_hot(big: DataFrame, keyed: DataFrame, on: list[str], count: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """``big`` joined with ``keyed``, which has one narrow row per key and in ``count`` how many rows of ``big`` the key has.

    Hot keys (fewer than ``HOT``, whatever the data) are sent to all executors, so that their rows stay where they are;
    the rows of all others are shuffled, none of which brings more than a small share of them into one task.  ``big``
    and ``keyed`` are read twice.  ``how`` is inner or left; null keys match nothing.
    """
    if total is None:
        total = keyed.agg(F.sum(count)).first()[0] or 0
    flag = fresh(big, "_hot")
    names = [c for c in keyed.columns if c not in on]
    hot = keyed.filter(F.col(count) * HOT > total).withColumn(flag, F.lit(True))
    cold = keyed.filter(F.col(count) * HOT <= total)
    marked = big.join(F.broadcast(hot), on, "left")
    rest = marked.filter(F.col(flag).isNull()).drop(*names, flag)
    empty = " OR ".join(f"`{c}` IS NULL" for c in on)
    out = marked.filter(flag).drop(flag).unionByName(rest.filter(f"NOT ({empty})").join(cold, on, how))
    if how == "left":
        kinds = {f.name: f.dataType for f in keyed.schema}
        out = out.unionByName(rest.filter(empty).withColumns({c: F.lit(None).cast(kinds[c]) for c in names}))
    return out


__all__ = ["drop", "fresh", "join_hot", "join_keys", "new_path", "small_enough", "written"]
