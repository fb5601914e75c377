"""User-defined aggregates."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

import pandas as pd

if TYPE_CHECKING:
    from ..session import Engine


def register_aggregate(engine: Engine, name: str, function: Callable[..., object], returns: str) -> None:
    """Make an aggregate callable from SQL: ``function`` takes a group's columns as series and gives one value."""
    from pyspark.sql.functions import pandas_udf

    if not function.__annotations__:
        function.__annotations__ = {"values": pd.Series, "return": object}
    engine.spark.udf.register(name, pandas_udf(function, returns, functionType=202))  # 202: grouped aggregate
