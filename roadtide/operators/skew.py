"""Joins and windows in which one key may have a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / HEAVY of all rows, and more than LEAST rows, is dealt to several tasks.
HEAVY, LEAST = 1000, 100_000


def heavy_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, parts: among how many tasks each heavy key is to be dealt. Fewer than HEAVY rows, so it can be broadcast."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    most = max((counts.agg(F.sum("__n")).first()[0] or 0) // HEAVY, LEAST)
    return counts.where(F.col("__n") > most).select(*keys, F.ceil(F.col("__n") / most).cast("int").alias("parts"))


def dealt(df: DataFrame, heavy: DataFrame, keys: list[str], by: list[str], name: str = "__part") -> DataFrame:
    """df with the part that each of its rows falls in, by a hash of other columns."""
    out = df.join(F.broadcast(heavy.withColumnRenamed("parts", "__parts")), keys, "left")
    return out.withColumn(name, F.coalesce(F.pmod(F.xxhash64(*by), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")


def copied(df: DataFrame, heavy: DataFrame, keys: list[str], name: str = "__part") -> DataFrame:
    """df with a copy of each row for every part of its key."""
    out = df.join(F.broadcast(heavy.withColumnRenamed("parts", "__parts")), keys, "left")
    return out.withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts") - 1, F.lit(0))))).drop("__parts")
