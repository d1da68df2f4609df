"""Corridors: membership, travel times, coverage and composition from detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtide.operators.quantiles import group_quantiles

#: Lane types that carry speed; least share observed of a day that was not imputed; least coverage (fixed values).
LANE_TYPES = ("ML", "HV")
IMPUTED_BELOW, MIN_COVERAGE, RELATIVE_COVERAGE, DEFAULT_SPACING = 10.0, 0.90, 0.80, 0.5


def members(stations: DataFrame, corridors: DataFrame) -> DataFrame:
    """Mainline stations of each corridor: slug, sensor_id, abs_pm, length. Equal freeway and direction, postmile in the range."""
    s, c = stations.alias("s"), corridors.alias("c")
    on = (F.col("s.fwy") == F.col("c.fwy")) & (F.col("s.dir") == F.col("c.dir")) & F.col("s.abs_pm").between(F.col("c.pm_min"), F.col("c.pm_max"))
    return s.where("type = 'ML' and abs_pm is not null").join(c, on).select("slug", "sensor_id", "abs_pm", "length")


def spacing(stations: DataFrame, *, keys=("fwy", "dir"), order=("abs_pm", "sensor_id")) -> DataFrame:
    """Adds spacing: miles to the next station of its key; the last takes the gap before it, a lone one its length or 0.5."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead, back = F.lead("abs_pm").over(w) - F.col("abs_pm"), F.col("abs_pm") - F.lag("abs_pm").over(w)
    return stations.withColumn("spacing", F.coalesce(ahead, back, F.col("length"), F.lit(DEFAULT_SPACING)))


def middle_station(stations: DataFrame, *, keys=("fwy", "dir"), order=("abs_pm", "sensor_id")) -> DataFrame:
    """The station in the middle of each key: of n in order, number n // 2 from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    return (
        stations.withColumns({"__at": F.row_number().over(w) - 1, "__mid": F.floor(F.count("*").over(whole) / 2)})
        .where("__at = __mid").drop("__at", "__mid")
    )


def exact_sum(column: str):
    """A sum that the order of the rows does not change: of decimals of 18 places, rounded to a double once. If a value is no such decimal (NaN, infinite, 1e10 or more), it is the sum of the doubles."""
    decimal = F.col(column).try_cast("decimal(28,18)")
    return F.when(F.count(decimal) == F.count(column), F.sum(decimal).cast("double")).otherwise(F.sum(column))


def travel_time(readings: DataFrame, members: DataFrame, *, weight: str = "length", exact: bool = False) -> DataFrame:
    """Travel time of each corridor at each time.

    members: slug, sensor_id and the miles that a station stands for. Returns corridor, ts, raw_minutes, n_stations,
    pct_observed, coverage and minutes, which is raw_minutes scaled up by the coverage.
    Members are a dimension that the planner broadcasts by its size; one shuffle by (corridor, ts).
    exact: the miles are added up by exact_sum(), so that no last bit of the coverage depends on the order of the rows.
    """
    miles = exact_sum if exact else F.sum
    total = members.groupBy("slug").agg(miles(weight).alias("total_mi"))
    live = readings.where("speed > 0").join(members.join(total, "slug"), F.col("station") == F.col("sensor_id"))
    out = live.groupBy(F.col("slug").alias("corridor"), "ts").agg(
        F.sum(F.col(weight) / F.col("speed") * 60.0).alias("raw_minutes"),
        miles(weight).alias("observed_mi"),
        # A set is at most as long as the corridor's list of stations, and needs no shuffle of its own.
        F.size(F.collect_set("station")).alias("n_stations"),
        F.avg("pct_observed").alias("pct_observed"),
        F.max("total_mi").alias("total_mi"),
    )
    coverage = F.try_divide("observed_mi", "total_mi")
    return out.withColumn("coverage", coverage).select("corridor", "ts", "raw_minutes", "n_stations", "pct_observed", "coverage", F.try_divide("raw_minutes", "coverage").alias("minutes"))


def imputed_days(readings: DataFrame, threshold: float = IMPUTED_BELOW) -> DataFrame:
    """date, pct_observed, imputed_day."""
    return readings.groupBy("date").agg(F.avg("pct_observed").alias("pct_observed")).withColumn("imputed_day", F.col("pct_observed") < threshold)


def usable(series: DataFrame, *, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Rows of days that were not imputed, with enough coverage and a positive time."""
    return series.where((~F.col("imputed_day")) & (F.col("coverage") >= min_coverage) & (F.col("minutes") > 0))


def compose(rows: DataFrame, members: DataFrame, measures: dict[str, str], *, weight: str = "spacing", exact: bool = False) -> DataFrame:
    """Corridor minutes of several speed columns at once, by (corridor, ts), with coverage.

    measures: result column to speed column. All share the detectors that report the first of them, and are scaled by
    total over covered miles, so the columns are comparable. exact: as for travel_time().
    """
    miles = exact_sum if exact else F.sum
    first = next(iter(measures.values()))
    total = members.groupBy("slug").agg(miles(weight).alias("total_mi"))
    live = rows.where(F.col(first) > 0).join(members.join(total, "slug"), F.col("station") == F.col("sensor_id"))
    grouped = live.groupBy(F.col("slug").alias("corridor"), "ts").agg(
        *(F.sum(F.col(weight) / F.col(c) * 60.0).alias(m) for m, c in measures.items()), miles(weight).alias("mi"), F.max("total_mi").alias("total_mi")
    )
    scale = F.try_divide("total_mi", "mi")
    return grouped.select("corridor", "ts", *((F.col(m) * scale).alias(m) for m in measures), F.try_divide("mi", "total_mi").alias("coverage"))


def well_covered(df: DataFrame, share: float = RELATIVE_COVERAGE, *, digits: int | None = 9) -> DataFrame:
    """Rows with at least this share of their corridor's median coverage.

    Both are compared at nine digits: sums in another order differ in the last bits, which must not decide of rows at the limit.
    digits=None compares the doubles as they are, for coverages of exact sums.
    """
    typical = group_quantiles(df, ["corridor"], F.col("coverage"), {"__typical": 0.5}).drop("n")
    settled = lambda c: c if digits is None else F.round(c, digits)
    return df.join(typical, "corridor").where(settled(F.col("coverage")) >= settled(share * F.col("__typical"))).drop("__typical")


def reduce_station_day(raw: DataFrame, keep: DataFrame) -> DataFrame:
    """Station readings of known detectors in narrow types: station, date, tod, speed, pct_observed, sorted within partitions."""
    from roadtide.functions.columns import tod

    return (
        raw.where("avg_speed > 0")
        .join(keep.select(F.col("sensor_id").alias("station")).distinct(), "station", "left_semi")
        .select(
            F.col("station").cast("int"), F.to_date("ts").alias("date"), tod(F.col("ts")).cast("smallint").alias("tod"), F.col("avg_speed").cast("float").alias("speed"),
            F.least(F.greatest(F.coalesce("pct_observed", F.lit(0.0)), F.lit(0.0)), F.lit(100.0)).cast("tinyint").alias("pct_observed"),
        )
        .sortWithinPartitions("station", "tod")
    )
