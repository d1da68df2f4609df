"""Ranks of rows in the order of their key, of which any may hold most of the rows, and windows over blocks of such ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtide.operators.skew import heavy_keys
from roadtide.session import broadcast_if_small, written

#: Rows of a block.
BLOCK = 4096


def _same(keys: list[str], mark: str):
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{mark}{k}")) for k in keys), F.lit(True))


def ranked(df: DataFrame, keys: list[str], order: list[str], *, rank: str = "rank", size: str = "size") -> DataFrame:
    """df with each row's rank in its key (from 0, nulls first, equal rows in any order) and the number of the key's rows.

    The rows are ranged by key and order, so a key has as many tasks as it needs; a rank is what the ranges before hold of
    the key plus the place in the own range. Null is a key; without keys the whole table is one.
    """
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    salted = df.withColumn("__salt", F.monotonically_increasing_id())  # equal rows can be cut between ranges
    sorted_ = salted.repartitionByRange(*by, "__salt").sortWithinPartitions(*by, "__salt").drop("__salt")
    rows = written(sorted_.withColumn("__at", F.monotonically_increasing_id())).withColumn("__range", F.shiftright("__at", 33))
    of_key = Window.partitionBy(*(f"__of_{k}" for k in keys))
    cuts = rows.groupBy("__range", *(F.col(k).alias(f"__of_{k}") for k in keys)).agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).withColumnRenamed("__range", "__of")
    cuts = written(cuts.select("*", F.sum("__n").over(of_key).alias(size), (F.sum("__n").over(of_key.orderBy("__of")) - F.col("__n")).alias("__before")))
    joined = rows.join(broadcast_if_small(cuts), (F.col("__range") == F.col("__of")) & _same(keys, "__of_"))
    return joined.select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias(rank), size)


def ntile(rank, size, parts: int):
    """Number, from 1, of the part that a rank falls in when size rows are cut into parts as even as can be, larger ones first."""
    least, more = F.floor(size / parts), size % parts
    border = more * (least + 1)
    return (F.when(rank < border, F.floor(rank / (least + 1))).otherwise(more + F.floor((rank - border) / F.greatest(least, F.lit(1)))) + 1).cast("int")


def over_blocks(df: DataFrame, keys: list[str], order: list[str], columns: dict, reach: int, *, block: int = BLOCK) -> DataFrame:
    """df with window columns (name to a function of a window ordered within the key) that look at most reach rows back.

    Long keys are ranked and cut into blocks, each with copies of the last rows of the one before, so that they are spread
    over tasks; other keys are one window each. order must tell a key's rows apart.
    """
    plain = Window.partitionBy(*keys).orderBy(*order)
    heavy = heavy_keys(df, keys).drop("parts")
    if heavy.isEmpty():
        return df.withColumns({n: f(plain) for n, f in columns.items()})
    marked = F.broadcast(heavy.select(*(F.col(k).alias(f"__heavy_{k}") for k in keys)))
    light = df.join(marked, _same(keys, "__heavy_"), "left_anti").withColumns({n: f(plain) for n, f in columns.items()})
    long = ranked(df.join(marked, _same(keys, "__heavy_"), "left_semi"), keys, order, rank="__rank", size="__size")
    size = max(block, reach)
    own = F.floor(F.col("__rank") / size)
    copies = F.when(F.col("__rank") % size >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    w = Window.partitionBy(*keys, "__block").orderBy("__rank")
    done = long.withColumn("__block", F.explode(copies)).withColumns({n: f(w) for n, f in columns.items()}).where(F.col("__block") == own)
    return light.unionByName(done.select(*df.columns, *columns))
