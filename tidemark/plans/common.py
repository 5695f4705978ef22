"""What the registered queries share: table access and the derived views that stand in for clients, batches and states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def mixed(key: str) -> list[Column]:
    """An order that any engine can repeat: multiplicative hash of an integer key, then the key."""
    return [(F.col(key) * 7919) % 10007, F.col(key)]


#: The range of that hash.
SPAN = (0.0, 10007.0)
#: The same order in SQL.
MIXED = "(({0}) * 7919) % 10007, {0}"
