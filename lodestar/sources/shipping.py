"""Making this package importable in the Python workers of a running session."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Workers started from now on find the package where the driver found it (clusters ship it with --py-files)."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "")
    if root not in have.split(":"):
        environment["PYTHONPATH"] = f"{root}:{have}" if have else root
    return spark
