"""Seasonal profiles and causal rolling statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtide.operators.ordered import over_blocks
from roadtide.operators.quantiles import group_quantiles

KEYS = ("station", "dow", "tod")
#: Observations of a rolling window and the fewest that count (fixed values).
WINDOW, LEAST, STATION_LEAST, MIN_OBSERVED = 8, 3, 4, 20


def profile(readings: DataFrame, *, through=None, min_pct_observed: int = MIN_OBSERVED, min_obs: int = STATION_LEAST, only_current: bool = True) -> DataFrame:
    """Mean and population deviation of speed by (station, dow, tod), of keys with enough observations.

    through: first date that is left out. only_current: keep the stations seen on the newest day.
    """
    rows = readings if through is None else readings.where(F.col("date") < F.lit(through))
    if only_current:
        newest = rows.agg(F.max("date").alias("newest"))
        current = rows.join(F.broadcast(newest), F.col("date") == F.col("newest")).select("station").distinct()
        rows = rows.join(current, "station", "left_semi")
    rows = rows.where((F.col("pct_observed") >= min_pct_observed) & F.col("speed").isNotNull())
    grouped = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("speed").alias("seasonal_speed"), F.stddev_pop("speed").alias("seasonal_sd"))
    return grouped.where(F.col("n") >= min_obs)


def partial_sums(readings: DataFrame) -> DataFrame:
    """n, sum and sum of squares by key: a state that days can be merged into."""
    return readings.where("speed is not null").groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("speed").alias("s1"), F.sum(F.col("speed") * F.col("speed")).alias("s2"))


def merge_sums(*parts: DataFrame) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("n", "s1", "s2")))


def finish_sums(sums: DataFrame, min_obs: int = STATION_LEAST) -> DataFrame:
    """The profile that merged sums stand for."""
    mean = F.col("s1") / F.col("n")
    return sums.where(F.col("n") >= min_obs).select(*KEYS, "n", mean.alias("seasonal_speed"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)).alias("seasonal_sd"))


def causal_rolling(df: DataFrame, value: str, keys, order, *, n: int = WINDOW, min_obs: int = LEAST) -> DataFrame:
    """Adds seasonal_median, seasonal_sd (sample) over the n rows before each row of its key, and prev_value.

    The row itself and later ones never count. Null where fewer than min_obs rows precede. A key of any length is spread over tasks.
    """

    def enough(w):
        return F.count(value).over(w.rowsBetween(-n, -1)) >= min_obs

    columns = {
        "seasonal_median": lambda w: F.when(enough(w), F.percentile(value, 0.5).over(w.rowsBetween(-n, -1))),
        "seasonal_sd": lambda w: F.when(enough(w), F.stddev_samp(value).over(w.rowsBetween(-n, -1))),
        "prev_value": lambda w: F.lag(value).over(w),
    }
    return over_blocks(df, list(keys), list(order), columns, n)


def last_n(df: DataFrame, value: str, keys, order, *, n: int = WINDOW) -> DataFrame:
    """Median and sample deviation of the latest n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).groupBy(*keys).agg(F.median(value).alias("median"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))


def freeflow(seasonal: DataFrame, q: float = 0.9) -> DataFrame:
    """station, freeflow: interpolated quantile of its seasonal speeds."""
    return group_quantiles(seasonal, ["station"], F.col("seasonal_speed"), {"freeflow": q}).select("station", "freeflow")


def rolling_sums(df: DataFrame, value: str, keys, order, sums: dict[str, int], *, day: str = "date", block: int = 4096) -> DataFrame:
    """Adds sums of value over so many rows up to each row of its key: result column to number of rows.

    order begins with a time of which `day` is the date. Rows are numbered by what the days before hold, and cut into
    blocks; a block gets copies of the last rows of the one before, so a key of any size is spread over tasks.
    """
    carry = max(sums.values()) - 1
    at = F.row_number().over(Window.partitionBy(*keys, day).orderBy(*order)) - 1
    before = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = df.groupBy(*keys, day).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    numbered = df.withColumn("__at", at).join(days, [*keys, day]).withColumn("__at", F.col("__at") + F.col("__before")).drop("__before")
    own = F.floor(F.col("__at") / block)
    copies = F.when(F.col("__at") % block >= block - carry, F.array(own, own + 1)).otherwise(F.array(own))
    w = Window.partitionBy(*keys, "__block").orderBy("__at")
    out = numbered.withColumn("__block", F.explode(copies)).withColumns({c: F.sum(value).over(w.rowsBetween(1 - n, 0)) for c, n in sums.items()})
    return out.where(F.col("__block") == own).select(*df.columns, *sums)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def yesterday_residual(df: DataFrame, keys=("corridor",)) -> DataFrame:
    """Adds yesterday: the mean of minutes - seasonal_median of the key's day before (null without one)."""
    day = df.groupBy(*keys, "date").agg(F.avg(F.col("minutes") - F.col("seasonal_median")).alias("yesterday")).withColumn("date", F.date_add("date", 1))
    return df.join(day, [*keys, "date"], "left")


def latest_residual(df: DataFrame, keys=("corridor",)) -> DataFrame:
    """Mean residual on the last day of the table, by key; 0 where it has none."""
    last = df.agg(F.max("date").alias("last"))
    rows = df.join(F.broadcast(last), F.col("date") == F.col("last")).groupBy(*keys).agg(F.avg(F.col("minutes") - F.col("seasonal_median")).alias("residual"))
    return df.select(*keys).distinct().join(rows, list(keys), "left").select(*keys, F.coalesce("residual", F.lit(0.0)).alias("residual"))
