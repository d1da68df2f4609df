"""Context features: calendar, weather, events, splits and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadtide.functions.columns import rain_class
from roadtide.operators.ordered import ranked
from roadtide.operators.quantiles import group_quantiles
from roadtide.session import broadcast_if_small, written

#: Fewest rows of a context factor (fixed value).
FACTOR_LEAST = 20


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """date, name of US holidays with California's own, by rule: fixed days and the nth or last weekday of a month."""
    fixed = [("New Year's Day", 1, 1), ("Juneteenth", 6, 19), ("Independence Day", 7, 4), ("Veterans Day", 11, 11), ("Christmas Day", 12, 25), ("Cesar Chavez Day", 3, 31)]
    # name, month, weekday (Monday 0), nth (-1: last)
    moving = [("Martin Luther King Jr. Day", 1, 0, 3), ("Washington's Birthday", 2, 0, 3), ("Memorial Day", 5, 0, -1), ("Labor Day", 9, 0, 1), ("Thanksgiving", 11, 3, 4), ("Day After Thanksgiving", 11, 4, 0)]
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    rules = [years.select(F.make_date("y", F.lit(m), F.lit(d)).alias("date"), F.lit(n).alias("name")) for n, m, d in fixed]
    for n, m, dow, nth in moving:
        if nth == 0:  # the day after the fourth Thursday
            rules.append(years.select(F.date_add(_nth(F.make_date("y", F.lit(m), F.lit(1)), 3, 4), 1).alias("date"), F.lit(n).alias("name")))
        elif nth < 0:
            last = F.last_day(F.make_date("y", F.lit(m), F.lit(1)))
            rules.append(years.select(F.date_sub(last, F.pmod(F.weekday(last) - dow, F.lit(7))).alias("date"), F.lit(n).alias("name")))
        else:
            rules.append(years.select(_nth(F.make_date("y", F.lit(m), F.lit(1)), dow, nth).alias("date"), F.lit(n).alias("name")))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def _nth(first, dow: int, nth: int):
    return F.date_add(first, F.pmod(dow - F.weekday(first), F.lit(7)) + 7 * (nth - 1))


def holiday_class(df: DataFrame, days: DataFrame) -> DataFrame:
    """Adds holiday_name and holiday_class (holiday, adjacent or none) by date; a day next to a holiday that is none itself is adjacent."""
    real = days.groupBy("date").agg(F.min("name").alias("holiday_name"))
    beside = real.select(F.explode(F.array(F.date_sub("date", 1), F.date_add("date", 1))).alias("date")).distinct().join(real, "date", "left_anti").withColumn("__adjacent", F.lit(True))
    out = df.join(real, "date", "left").join(beside, "date", "left")
    kind = F.when(F.col("holiday_name").isNotNull(), "holiday").when(F.col("__adjacent"), "adjacent").otherwise("none")
    return out.withColumn("holiday_class", kind).drop("__adjacent")


def attach_weather(df: DataFrame, weather: DataFrame, *, cell: str = "cell", ts: str = "ts", hours: int = 3, keep=()) -> DataFrame:
    """Adds rain (sum of the last `hours` hourly rows of the cell), temperature, the columns to keep and rain_class by cell and hour.

    weather: cell, ts (hourly), precipitation, temperature. The first row of a cell and hour counts; sums are made on
    the hourly table, before it fans out. Missing weather is the class unknown.
    """
    hour = F.date_trunc("HOUR", ts).cast("timestamp_ntz")
    w = weather.withColumn("__hour", F.date_trunc("HOUR", "ts").cast("timestamp_ntz"))
    w = w.withColumn("__r", F.row_number().over(Window.partitionBy("cell", "__hour").orderBy("ts", "precipitation"))).where("__r = 1")
    w = w.withColumn("rain", F.sum("precipitation").over(Window.partitionBy("cell").orderBy("__hour").rowsBetween(1 - hours, 0)))
    w = w.select(F.col("cell").alias("__cell"), "__hour", "rain", "temperature", "precipitation", *(F.col(c).alias(f"__keep_{c}") for c in keep))
    out = df.withColumn("__at", hour).join(w, (F.col(cell) == F.col("__cell")) & (F.col("__at") == F.col("__hour")), "left")
    return out.select(*df.columns, "rain", "temperature", *(F.col(f"__keep_{c}").alias(c) for c in keep), rain_class(F.col("precipitation")).alias("rain_class"))


def _context(df: DataFrame, weather: DataFrame, days: DataFrame, cell: str) -> DataFrame:
    """Adds the calendar (month, is_weekend, holiday_class) and the weather (precip_mm, wind_kmh, precip_3h, wx_class) of each row."""
    w = weather.withColumns({"temperature": F.lit(None).cast("double"), "precip_mm": F.col("precipitation"), "wind_kmh": F.col("wind")})
    out = attach_weather(holiday_class(df, days).drop("holiday_name"), w, cell=cell, keep=("precip_mm", "wind_kmh"))
    out = out.withColumns({"month": F.month("date"), "is_weekend": F.weekday("date") >= 5})
    return out.withColumnsRenamed({"rain": "precip_3h", "rain_class": "wx_class"}).drop("temperature")


def corridor_matrix(series: DataFrame, events: DataFrame, weather: DataFrame, points: DataFrame, days: DataFrame, *, order=("ts", "id")) -> DataFrame:
    """The corridor features: seasonal statistics, calendar, yesterday's residual, the nearest event and the events of the day, and weather.

    series: id, corridor, date, dow, tod, ts, minutes; events: corridor, event_id, start, capacity, event_type,
    time_known; weather: cell, ts, precipitation, wind by weather point; points: cell, corridors that it serves;
    days: holidays. Rows without seasonal statistics are left out.
    """
    from roadtide.operators.asof import nearest_event
    from roadtide.operators.seasonal import causal_rolling, yesterday_residual

    rows = yesterday_residual(causal_rolling(series, "minutes", ("corridor", "dow", "tod"), order).where("seasonal_median is not null")).withColumnRenamed("yesterday", "yday_residual")
    today = events.groupBy("corridor", F.to_date("start").alias("date")).agg(F.count("*").alias("events_today"))
    rows = nearest_event(rows, events, key="corridor", row_id="id", keep=("capacity", "event_type", "time_known")).join(today, ["corridor", "date"], "left")
    # The map of points to corridors, turned round: each corridor has one point.
    of = points.select("cell", F.explode("corridors").alias("corridor")).groupBy("corridor").agg(F.min("cell").alias("cell"))
    rows = _context(rows.join(of, "corridor", "left"), weather, days, "cell")
    filled = {"event_capacity": F.coalesce("capacity", F.lit(0)), "event_type": F.coalesce("event_type", F.lit("none")), "event_time_known": F.coalesce("time_known", F.lit(0)), "events_today": F.coalesce("events_today", F.lit(0))}
    return rows.withColumns(filled).drop("capacity", "time_known", "cell", "event_id", "prev_value")


CORRIDOR_NUMERIC = ["seasonal_median", "seasonal_sd", "tod", "dow", "month", "is_weekend", "yday_residual", "hours_since_event", "event_capacity", "event_time_known", "events_today", "precip_mm", "wind_kmh", "precip_3h"]
CORRIDOR_CATEGORICAL = ["corridor", "holiday_class", "wx_class", "event_type"]
NETWORK_NUMERIC = ["seasonal_speed", "seasonal_sd", "tod", "dow", "month", "is_weekend", "lanes", "seg_miles", "lat", "lon", "precip_mm", "wind_kmh", "precip_3h", "hours_since_event", "event_capacity", "event_miles"]
NETWORK_CATEGORICAL = ["freeway", "direction", "holiday_class", "wx_class"]


def network_matrix(rows: DataFrame, seasonal: DataFrame, stations: DataFrame, events: DataFrame, weather: DataFrame, days: DataFrame, *, row_id: str = "row_id") -> DataFrame:
    """The network features of station rows: seasonal statistics, attributes, calendar, weather of the station's cell, and the nearest event at its venue.

    rows: row_id, station, date, dow, tod, ts; stations: sensor_id, fwy, dir, lanes, length, lat, lon, cell, venue and
    event_miles (null beyond reach); events: venue, event_id, start, capacity; weather: cell, ts, precipitation, wind.
    Stations are a dimension that the planner broadcasts by its size.
    """
    from roadtide.operators.asof import nearest_event

    st = stations.select(F.col("sensor_id").alias("station"), F.col("fwy").cast("string").alias("freeway"), F.col("dir").alias("direction"), "lanes", F.col("length").alias("seg_miles"), "lat", "lon", "cell", "venue", "event_miles")
    full = rows.join(seasonal.select("station", "dow", "tod", "seasonal_speed", "seasonal_sd"), ["station", "dow", "tod"]).join(st, "station")
    # The event depends on venue and time alone, so each of these is asked once, however many stations have it.
    moments = rows.select("station", "ts").join(st.select("station", "venue"), "station").where("venue is not null and ts is not null").select("venue", "ts").distinct()
    nearest = broadcast_if_small(written(nearest_event(moments, events, key="venue", row_id="ts", keep=("capacity",))))
    full = full.join(nearest, ["venue", "ts"], "left")
    full = _context(full, weather, days, "cell")
    near = F.col("hours_since_event").isNotNull()
    return full.withColumns({"event_capacity": F.coalesce("capacity", F.lit(0)), "event_miles": F.when(near, F.col("event_miles"))}).drop("capacity", "cell", "venue", "event_id")


def learn_factor(train: DataFrame, keys, *, actual: str = "actual", base: str = "base", least: int = FACTOR_LEAST) -> DataFrame:
    """keys, factor: median of actual over base, of keys with enough rows."""
    return group_quantiles(train, list(keys), F.try_divide(F.col(actual), F.col(base)), {"factor": 0.5}).where(F.col("n") >= least).drop("n")


def apply_factor(df: DataFrame, factor: DataFrame, keys, col: str) -> DataFrame:
    """df with col times the factor of its keys; 1 where there is none."""
    f = factor.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("factor").alias("__factor"))
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = c if on is None else on & c
    return df.join(f, on, "left").select(*(F.col(c) if c != col else (F.col(c) * F.coalesce("__factor", F.lit(1.0))).alias(c) for c in df.columns))


def layer_factors(train: DataFrame, layers: list[tuple[str, list[str], object]], *, actual: str = "actual", base: str = "base") -> list[DataFrame]:
    """The factors of each layer (name, keys, condition), learnt on the plain baseline of the training rows on which the layer is active and the baseline positive."""
    return [learn_factor(train.where(active & (F.col(base) > 0)), keys, actual=actual, base=base) for _, keys, active in layers]


def layered_corrections(train: DataFrame, test: DataFrame, layers: list[tuple[str, list[str], object]], *, actual: str = "actual", base: str = "base") -> DataFrame:
    """test with f_<name>, the factor of each layer (name, keys, condition) where it is active and 1 elsewhere, and corrected: base times all of them.

    No layer sees what another one has corrected: all are learnt on the plain baseline.
    """
    done = test.withColumn("corrected", F.col(base))
    for (name, keys, active), factor in zip(layers, layer_factors(train, layers, actual=actual, base=base), strict=True):
        done = apply_factor(done.withColumn(f"f_{name}", F.lit(1.0)), factor, keys, f"f_{name}")
        done = done.withColumn(f"f_{name}", F.when(active, F.col(f"f_{name}")).otherwise(1.0)).withColumn("corrected", F.col("corrected") * F.col(f"f_{name}"))
    return done


def layer_report(done: DataFrame, layers: list[tuple[str, list[str], object]], *, actual: str = "actual", base: str = "base") -> DataFrame:
    """What each layer of layered_corrections() does alone, and all together, a row for each: layer, rows (active), share_pct, mae_before and
    mae_after of these rows, gain_pct there, global_gain_pct (of the mean error of all rows), error_share_pct (of the baseline's error that these rows have).

    The last row, `all layers`, is about every row. One pass over the data.
    """
    err = lambda c: F.abs(c - F.col(actual))
    plain = err(F.col(base))
    aggs, rows = [F.count("*").alias("n"), F.sum(plain).alias("whole")], []
    parts = [(name, F.coalesce(active, F.lit(False)), F.col(base) * F.col(f"f_{name}")) for name, _, active in layers] + [("all layers", F.lit(True), F.col("corrected"))]
    for i, (name, on, adjusted) in enumerate(parts):
        aggs += [F.count_if(on).alias(f"r{i}"), F.sum(F.when(on, plain)).alias(f"b{i}"), F.sum(F.when(on, err(adjusted))).alias(f"a{i}")]
        r, b, a = (F.col(f"{c}{i}") for c in "rba")
        pct = lambda x, y: F.try_divide(x * 100.0, y)
        rows.append(
            F.struct(
                F.lit(i).alias("no"), F.lit(name).alias("layer"), r.alias("rows"), pct(r, F.col("n")).alias("share_pct"), F.try_divide(b, r).alias("mae_before"), F.try_divide(a, r).alias("mae_after"),
                pct(b - a, b).alias("gain_pct"), pct(b - a, F.col("whole")).alias("global_gain_pct"), pct(b, F.col("whole")).alias("error_share_pct"),
            )
        )
    return done.agg(*aggs).select(F.inline(F.array(*rows)))


def _dealt(seed: int, c: str):
    """32 bits of a hash of a column and a seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(c).cast("string"))), 1, 8), 16, 10).cast("long")


def spatial_holdout(stations: DataFrame, *, share: float = 0.3, seed: int = 7) -> DataFrame:
    """Adds held_out: a deterministic share of the stations by a hash; the same station always falls on the same side."""
    return stations.withColumn("held_out", _dealt(seed, "sensor_id") % 1000 < int(share * 1000))


def station_sample(stations: DataFrame, fraction: float, *, seed: int = 0) -> DataFrame:
    """The fraction of the stations, rounded down to a whole number of them, that come first by a hash."""
    first = ranked(stations.withColumn("__dealt", _dealt(seed, "sensor_id")), [], ["__dealt", "sensor_id"], rank="__rank", size="__size")
    return first.where(F.col("__rank") < F.floor(F.col("__size") * fraction)).drop("__dealt", "__rank", "__size")


def temporal_split(df: DataFrame, train_end, valid_end, test_end) -> DataFrame:
    """Adds split: train, valid or test by half-open date ranges; rows from test_end on are dropped."""
    d = F.col("date")
    label = F.when(d < F.lit(train_end).cast("date"), "train").when(d < F.lit(valid_end).cast("date"), "valid").when(d < F.lit(test_end).cast("date"), "test")
    return df.withColumn("split", label).where("split is not null")


def horizon(seasonal: DataFrame, start_date, days: int, *, slot_min: int = 15) -> DataFrame:
    """Every (station, date, slot) of the coming days that the profile knows."""
    spark = seasonal.sparkSession
    dates = spark.range(days).select(F.date_add(F.lit(start_date).cast("date"), F.col("id").cast("int")).alias("date"))
    dates = dates.withColumn("dow", F.weekday("date"))
    return seasonal.where(F.col("tod") % slot_min == 0).join(F.broadcast(dates), "dow")


def vocabulary(frames: list[tuple[DataFrame, str]], fixed: list[str]) -> DataFrame:
    """Sorted array of all values seen in the columns, with fixed ones."""
    out = None
    for df, c in frames:
        one = df.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct()
        out = one if out is None else out.union(one)
    return out.distinct().agg(F.array_sort(F.array_union(F.collect_set("v"), F.array(*map(F.lit, fixed)) if fixed else F.array().cast("array<string>"))).alias("vocabulary"))


def unseen_values(served: DataFrame, trained: DataFrame, c: str) -> DataFrame:
    """Values that are served but were never trained on, with their rows."""
    seen = trained.select(c).distinct()
    return served.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("rows")).join(seen, c, "left_anti")
