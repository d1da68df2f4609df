"""Products: peak summaries, week grids, dense slot arrays and their JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtide.functions.columns import hhmm


def peak_summary(df: DataFrame, low: int, high: int, keys=("corridor", "date")) -> DataFrame:
    """The worst slot of each key within [low, high): worst_tod, at (HH:MM), pred, typical, delta. Ties go to the earlier slot."""
    rows = df.where((F.col("tod") >= low) & (F.col("tod") < high) & F.col("pred").isNotNull())
    top = rows.groupBy(*keys).agg(F.max_by(F.struct("tod", "pred", "typical"), F.struct("pred", -F.col("tod"))).alias("w"))
    return top.select(*keys, F.col("w.tod").alias("worst_tod"), hhmm(F.col("w.tod")).alias("at"), "w.pred", "w.typical", (F.col("w.pred") - F.col("w.typical")).alias("delta"))


def week_grid(series: DataFrame) -> DataFrame:
    """corridor, dow, hour, minutes (most), ratio (the corridor's least cell over this one)."""
    cells = series.groupBy("corridor", "dow", F.floor(F.col("tod") / 60).cast("int").alias("hour")).agg(F.max("minutes").alias("minutes"))
    return cells.withColumn("ratio", F.try_divide(F.min("minutes").over(Window.partitionBy("corridor")), F.col("minutes")))


def dense_slots(df: DataFrame, key: str, slot: str, value: str, slots: int, missing: int = -1) -> DataFrame:
    """key, values: an array of `slots` rounded values, `missing` where there is none."""
    per = df.groupBy(key, slot).agg(F.max(value).alias("v")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(slot, "v"))).alias("m"))
    return per.select(key, F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.rint(F.try_element_at("m", i)).cast("int"), F.lit(missing))).alias("values"))


def week_product(week: DataFrame) -> DataFrame:
    """corridor, at (ISO times), minutes, typical (rounded arrays in order of time) and coverage_pct of the given days.

    week: corridor, ts, minutes, typical, coverage; a week has at most 2,016 times of five minutes.
    """
    settled = lambda c: F.round(F.round(c, 9), 1).alias(c)
    one = F.struct("ts", settled("minutes"), settled("typical"))
    rows = week.groupBy("corridor").agg(F.array_sort(F.collect_list(one)).alias("w"), F.round(F.round(F.avg("coverage") * 100, 9), 1).alias("coverage_pct"))
    return rows.select("corridor", "coverage_pct", F.transform("w", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm:ss")).alias("at"), F.col("w.minutes").alias("minutes"), F.col("w.typical").alias("typical"))


def day_payload(df: DataFrame, keys=("corridor", "date")) -> DataFrame:
    """keys, payload: a day's slots as JSON in order."""
    one = F.struct("tod", F.round("pred", 1).alias("pred"), F.round("typical", 1).alias("typical"))
    return df.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("payload"))


def staleness(df: DataFrame, as_of, hours: float = 36.0, ts: str = "ts") -> DataFrame:
    """newest, age_hours and stale of the data as of a time."""
    age = F.timestamp_diff("SECOND", F.max(ts), F.lit(as_of).cast("timestamp_ntz")) / 3600.0
    return df.agg(F.max(ts).alias("newest"), age.alias("age_hours")).withColumn("stale", F.col("age_hours") > hours)


#: Facilities of the freeway (fixed list).
FREEWAY = ("Mainline", "On Ramp", "Off Ramp", "Connector", "Toll Bridge", "Tunnels/Tubes", "Toll Plaza")


def facility_counts(closures: DataFrame, *keys: str) -> DataFrame:
    """keys, total, freeway and mainline closures."""
    return closures.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("facility").isin(*FREEWAY)).alias("freeway"), F.count_if(F.col("facility") == "Mainline").alias("mainline"))
