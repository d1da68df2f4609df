"""Registered queries of the forecast chain: feature matrices, the model, its forecasts, and reports by slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from roadtide.functions import columns as fn
from roadtide.operators import asof, evaluate, features, model, publish, seasonal, spatial
from roadtide.plans.demo import cte, frame
from roadtide.plans.queries import _PROFILE, _ROLLED, _VENUES, _profile, query, rounded
from roadtide.session import written
from roadtide.sources import readers

# The holidays of features.holidays by conditions on a calendar of days.
_HOLIDAYS = """hd AS (SELECT CAST(t AS DATE) AS date, month(t) AS m, day(t) AS d, isodow(t) AS w FROM range(TIMESTAMP '1991-01-01', TIMESTAMP '2006-01-01', INTERVAL 1 DAY) r(t)),
hol AS (SELECT date, name FROM (SELECT date, CASE WHEN m = 1 AND d = 1 THEN 'New Year''s Day' WHEN m = 6 AND d = 19 THEN 'Juneteenth' WHEN m = 7 AND d = 4 THEN 'Independence Day' WHEN m = 11 AND d = 11 THEN 'Veterans Day'
  WHEN m = 12 AND d = 25 THEN 'Christmas Day' WHEN m = 3 AND d = 31 THEN 'Cesar Chavez Day' WHEN m = 1 AND w = 1 AND d BETWEEN 15 AND 21 THEN 'Martin Luther King Jr. Day' WHEN m = 2 AND w = 1 AND d BETWEEN 15 AND 21 THEN 'Washington''s Birthday'
  WHEN m = 5 AND w = 1 AND d >= 25 THEN 'Memorial Day' WHEN m = 9 AND w = 1 AND d <= 7 THEN 'Labor Day' WHEN m = 11 AND w = 4 AND d BETWEEN 22 AND 28 THEN 'Thanksgiving' WHEN m = 11 AND w = 5 AND d BETWEEN 23 AND 29 THEN 'Day After Thanksgiving' END AS name FROM hd) WHERE name IS NOT NULL),
hc AS (SELECT hd.date, hol.name, CASE WHEN hol.name IS NOT NULL THEN 'holiday' WHEN EXISTS (SELECT 1 FROM hol h WHERE h.date = hd.date - 1 OR h.date = hd.date + 1) THEN 'adjacent' ELSE 'none' END AS class FROM hd LEFT JOIN hol USING (date))"""


@query("F3_holiday_class", f"{cte('series')}, {_HOLIDAYS} SELECT id, s.date, name AS holiday_name, class AS holiday_class FROM series s JOIN hc USING (date)")
def _(spark, d):
    return features.holiday_class(frame(spark, d, "series").select("id", "date"), features.holidays(spark, 1991, 2005))


# The events of the demo, 28 years back so that they fall among the readings, at the venues of the dimension.
_SHIFT = 10227
_EVENTS = f"""ev AS (SELECT event_id, venue, start - INTERVAL {_SHIFT} DAY AS start, CAST(substr(venue, 2) AS BIGINT) * 1000 + 500 AS capacity, event_id % 2 AS time_known,
  CASE WHEN lower(title) LIKE '%49ers%' THEN 'nfl' WHEN lower(title) LIKE '%fc %' THEN 'soccer' WHEN lower(title) LIKE '%sharks%' THEN 'hockey' WHEN lower(title) LIKE '%warriors%' THEN 'basketball' WHEN lower(title) LIKE '%giants%' THEN 'baseball' ELSE 'concert' END AS event_type FROM venue_events)"""


def _events(spark, d):
    start = F.col("start") - F.make_dt_interval(F.lit(_SHIFT))
    return frame(spark, d, "venue_events").select("event_id", "venue", start.alias("start"), (F.substring("venue", 2, 9).cast("long") * 1000 + 500).alias("capacity"), (F.col("event_id") % 2).alias("time_known"), fn.event_type(F.col("title")).alias("event_type"))


def _corridor_matrix(spark, d):
    pairs = [(f"v{v}", sorted({f"k{i % 9}" for i in range(14) if i % 7 == v})) for v in range(7)]
    reach = F.broadcast(readers.venue_corridors(spark.createDataFrame(pairs, "slug string, corridors array<string>")))
    points = spark.createDataFrame([(f"p{i}", [f"k{k}" for k in range(9) if k % 3 == i]) for i in range(3)], "cell string, corridors array<string>")
    s = frame(spark, d, "series")
    cell = F.concat(F.lit("p"), (F.substring("corridor", 2, 9).cast("int") % 3).cast("string"))
    weather = s.groupBy(cell.alias("cell"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max("precip").alias("precipitation"), (F.max("coverage") * 20).alias("wind"))
    return features.corridor_matrix(s, _events(spark, d).join(reach, "venue"), weather, points, features.holidays(spark, 1991, 2005))


@query("M1_corridor_matrix", f"""{cte('series', 'venue_events')}, {_ROLLED}, rr AS (SELECT * FROM rolled WHERE seasonal_median IS NOT NULL), {_HOLIDAYS}, {_EVENTS},
m AS (SELECT DISTINCT concat('v', i % 7) AS venue, concat('k', i % 9) AS corridor FROM range(0, 14) t(i)), ce AS (SELECT ev.*, corridor FROM ev JOIN m USING (venue)),
y AS (SELECT corridor, date + 1 AS date, avg(minutes - seasonal_median) AS yday FROM rr GROUP BY 1, 2),
h AS (SELECT r.id, c.*, date_sub('microsecond', c.start, r.ts) / 3600000000.0 AS h FROM rr r JOIN ce c ON c.corridor = r.corridor AND r.date BETWEEN CAST(c.start AS DATE) - 1 AND CAST(c.start AS DATE) + 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN h >= 0 THEN 0 ELSE 1 END, abs(h), event_id) AS k FROM h WHERE h BETWEEN -4 AND 6) WHERE k = 1),
n AS (SELECT corridor, CAST(start AS DATE) AS date, count(*) AS events_today FROM ce GROUP BY 1, 2),
w AS (SELECT CAST(substr(corridor, 2) AS BIGINT) % 3 AS p, date_trunc('hour', ts) AS hr, max(precip) AS precip, max(coverage) * 20 AS wind FROM series GROUP BY 1, 2),
ww AS (SELECT *, sum(precip) OVER (PARTITION BY p ORDER BY hr ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p3 FROM w)
SELECT r.id, round(seasonal_median, 4) AS seasonal_median, round(seasonal_sd, 4) AS seasonal_sd, CAST(r.tod AS BIGINT) AS tod, CAST(r.dow AS BIGINT) AS dow, CAST(month(r.date) AS BIGINT) AS month, isodow(r.date) >= 6 AS is_weekend, round(round(yday, 9), 4) AS yday_residual,
  round(b.h, 4) AS hours_since_event, coalesce(b.capacity, 0) AS event_capacity, CAST(coalesce(b.time_known, 0) AS BIGINT) AS event_time_known, coalesce(events_today, 0) AS events_today, round(ww.precip, 4) AS precip_mm, round(ww.wind, 4) AS wind_kmh, round(p3, 4) AS precip_3h,
  r.corridor, hc.class AS holiday_class, CASE WHEN ww.precip IS NULL THEN 'unknown' WHEN ww.precip >= 2.5 THEN 'rain_heavy' WHEN ww.precip >= 0.2 THEN 'rain_light' ELSE 'dry' END AS wx_class, coalesce(b.event_type, 'none') AS event_type
FROM rr r LEFT JOIN y ON y.corridor = r.corridor AND CAST(y.date AS DATE) = r.date LEFT JOIN b ON b.id = r.id LEFT JOIN n ON n.corridor = r.corridor AND n.date = r.date JOIN hc ON hc.date = r.date
LEFT JOIN ww ON ww.p = CAST(substr(r.corridor, 2) AS BIGINT) % 3 AND ww.hr = date_trunc('hour', r.ts)""")
def _(spark, d):
    got = _corridor_matrix(spark, d).withColumn("yday_residual", F.round("yday_residual", 9))
    return rounded(got.select("id", *features.CORRIDOR_NUMERIC, *features.CORRIDOR_CATEGORICAL))


def _stations(spark, d):
    """Stations with their weather cell, and the nearest venue within reach."""
    st = frame(spark, d, "stations")
    cells = spatial.occupied_cells(st).select(F.concat_ws(",", "lat", "lon").alias("right_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    cell = spatial.nearest_in_grid(st.select(F.col("sensor_id").alias("left_id"), "lat", "lon"), cells, 0.25).select(F.col("left_id").alias("sensor_id"), F.col("right_id").alias("cell"))
    dims = spark.createDataFrame([(f"v{i}", v[2], v[3]) for i, v in enumerate(readers.VENUES)], "right_id string, r_lat double, r_lon double")
    near = spatial.nearest(st.select(F.col("sensor_id").alias("left_id"), "lat", "lon"), dims, fn.equirect_miles(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    within = F.col("dist") <= spatial.MAX_EVENT_MI
    venue = near.select(F.col("left_id").alias("sensor_id"), F.when(within, F.col("right_id")).alias("venue"), F.when(within, F.col("dist")).alias("event_miles"))
    return st.join(cell, "sensor_id").join(venue, "sensor_id")


def _network_weather(spark, d, stations):
    r = frame(spark, d, "readings").where("tod <> 600").join(stations.select(F.col("sensor_id").alias("station"), "cell"), "station")
    return r.groupBy("cell", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts")).agg(F.round(F.max("pct_observed") / 20.0, 3).alias("precipitation"), F.max("speed").alias("wind"))


def _network_matrix(spark, d, rows=None):
    st = _stations(spark, d)
    rows = frame(spark, d, "readings") if rows is None else rows
    return features.network_matrix(rows, _profile(spark, d), st, _events(spark, d), _network_weather(spark, d, st), features.holidays(spark, 1991, 2005))


_NETWORK = f"""{cte('readings', 'stations', 'venue_events')}, {_PROFILE}, {_HOLIDAYS}, {_EVENTS},
c AS (SELECT DISTINCT round(floor(lat / 0.25) * 0.25 + 0.125, 3) AS clat, round(floor(lon / 0.25) * 0.25 + 0.125, 3) AS clon FROM stations),
sc AS (SELECT sensor_id, cell FROM (SELECT sensor_id, concat(clat, ',', clon) AS cell, row_number() OVER (PARTITION BY sensor_id ORDER BY round(pow(lat - clat, 2) + pow(lon - clon, 2), 9), concat(clat, ',', clon)) AS k FROM stations, c) WHERE k = 1),
{_VENUES}, vn AS (SELECT concat('v', row_number() OVER () - 1) AS v, vlat, vlon FROM venues),
sv AS (SELECT sensor_id, CASE WHEN miles <= 12 THEN v END AS venue, CASE WHEN miles <= 12 THEN miles END AS event_miles FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY miles, v) AS k FROM (SELECT sensor_id, v, sqrt(pow((vlat - lat) * 69, 2) + pow((vlon - lon) * 69 * cos(radians(lat)), 2)) AS miles FROM stations, vn)) WHERE k = 1),
w AS (SELECT cell, date_trunc('hour', ts) AS hr, round(max(pct_observed) / 20.0, 3) AS precip, max(speed) AS wind FROM readings JOIN sc ON station = sensor_id WHERE tod <> 600 GROUP BY 1, 2),
ww AS (SELECT *, sum(precip) OVER (PARTITION BY cell ORDER BY hr ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p3 FROM w),
x AS (SELECT r.row_id, r.station, r.base, r.pred, r.actual, r.date, r.dow, r.tod, r.ts, seasonal_speed, seasonal_sd, s.*, cell, venue, event_miles FROM readings r JOIN profile p USING (station, dow, tod) JOIN stations s ON s.sensor_id = r.station JOIN sc ON sc.sensor_id = r.station JOIN sv ON sv.sensor_id = r.station),
h AS (SELECT x.row_id, x.sensor_id, x.ts, e.event_id, e.capacity, date_sub('microsecond', e.start, x.ts) / 3600000000.0 AS h FROM x JOIN ev e ON e.venue = x.venue AND x.date BETWEEN CAST(e.start AS DATE) - 1 AND CAST(e.start AS DATE) + 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id, sensor_id, ts ORDER BY CASE WHEN h >= 0 THEN 0 ELSE 1 END, abs(h), event_id) AS k FROM (SELECT DISTINCT * FROM h) WHERE h BETWEEN -4 AND 6) WHERE k = 1)"""


@query("M2_network_matrix", f"""{_NETWORK}
SELECT x.row_id, round(seasonal_speed, 4) AS seasonal_speed, round(seasonal_sd, 4) AS seasonal_sd, CAST(x.tod AS BIGINT) AS tod, CAST(x.dow AS BIGINT) AS dow, CAST(month(x.date) AS BIGINT) AS month, isodow(x.date) >= 6 AS is_weekend, CAST(lanes AS BIGINT) AS lanes, round(length, 4) AS seg_miles,
  round(lat, 4) AS lat, round(lon, 4) AS lon, round(ww.precip, 4) AS precip_mm, round(ww.wind, 4) AS wind_kmh, round(p3, 4) AS precip_3h, round(b.h, 4) AS hours_since_event, coalesce(b.capacity, 0) AS event_capacity, round(CASE WHEN b.h IS NOT NULL THEN event_miles END, 4) AS event_miles,
  CAST(fwy AS STRING) AS freeway, dir AS direction, hc.class AS holiday_class, CASE WHEN ww.precip IS NULL THEN 'unknown' WHEN ww.precip >= 2.5 THEN 'rain_heavy' WHEN ww.precip >= 0.2 THEN 'rain_light' ELSE 'dry' END AS wx_class
FROM x LEFT JOIN b ON b.row_id = x.row_id AND b.sensor_id = x.sensor_id AND b.ts = x.ts JOIN hc ON hc.date = x.date LEFT JOIN ww ON ww.cell = x.cell AND ww.hr = date_trunc('hour', x.ts)""")
def _(spark, d):
    return rounded(_network_matrix(spark, d).select("row_id", *features.NETWORK_NUMERIC, *features.NETWORK_CATEGORICAL))


def _fitted(spark, d):
    """Boosted trees on the network features, stopped early on the year after the training ones."""
    rows = _network_matrix(spark, d).withColumn("is_weekend", F.col("is_weekend").cast("int"))
    split = features.temporal_split(rows, "1997-01-01", "1998-01-01", "1999-01-01").where("split <> 'test'").withColumn("valid", F.col("split") == "valid")
    return model.fit(model.label(split, "ratio"), features.NETWORK_NUMERIC, features.NETWORK_CATEGORICAL, rounds=60, valid="valid")


def _coming(spark, d):
    """Every station and slot of the week from 1996-01-08 with its features, the weather and events of those days included."""
    coming = features.horizon(_profile(spark, d).select("station", "dow", "tod"), "1996-01-08", 7)
    at = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("tod"))
    return _network_matrix(spark, d, coming.withColumns({"ts": at, "row_id": F.xxhash64("station", "date", "tod")})).withColumn("is_weekend", F.col("is_weekend").cast("int"))


@query("M6_forecast_table")
def _(spark, d):
    """The forecast of a week: share of the seasonal speed by the model, with the station's free-flow speed."""
    rows = model.predict(_fitted(spark, d), _coming(spark, d), "ratio")
    free = seasonal.freeflow(_profile(spark, d))
    return rounded(rows.join(free, "station").select("station", "date", "tod", "mph", "seasonal_speed", "seasonal_sd", "freeflow"))


@query("A29_importances")
def _(spark, d):
    return rounded(model.importances(_fitted(spark, d), spark))


@query("M3_cross_fitted_slices")
def _(spark, d):
    """Stations predicted by models that never saw them, learnt before 1997 and stopped on that year: errors by fold and slice on the readings from 1998 on, with totals."""
    rows = written(_network_matrix(spark, d, frame(spark, d, "readings").where("speed > 0")).withColumn("is_weekend", F.col("is_weekend").cast("int")))
    split = features.temporal_split(rows, "1997-01-01", "1998-01-01", "2000-01-01").withColumn("valid", F.col("split") == "valid")

    def learn(some):
        return model.fit(model.label(some.where("split <> 'test'"), "ratio"), features.NETWORK_NUMERIC, features.NETWORK_CATEGORICAL, rounds=20, valid="valid")

    done = model.cross_fitted(split, learn, lambda m, some: model.predict(m, some.where("split = 'test'"), "ratio"), folds=2)
    peak, slow = fn.is_peak(F.col("tod")), F.col("seasonal_speed") < 45
    rows = evaluate.worst(written(done.select("fold", "tod", "speed", "seasonal_speed", "mph", "holiday_class", "precip_mm", "hours_since_event")), "speed", "seasonal_speed")
    slices = {"peak": peak, "congested": slow, "peak+congested": peak & slow, "holiday": F.col("holiday_class") != "none", "rain": F.col("precip_mm") >= fn.RAIN_LIGHT, "near event": F.col("hours_since_event").isNotNull(), "worst": F.col("is_worst")}
    return rounded(evaluate.slice_cube(rows, "speed", "seasonal_speed", {"model": "mph"}, slices, by="fold"))


@query("M5_minutes_model")
def _(spark, d):
    """The corridor model: minutes from the corridor features, and its mean error by corridor on the last year."""
    rows = features.temporal_split(_corridor_matrix(spark, d).withColumn("is_weekend", F.col("is_weekend").cast("int")), "1997-01-01", "1998-01-01", "1999-01-01")
    fitted = model.fit(model.label(rows.where("split <> 'test'").withColumn("valid", F.col("split") == "valid"), "minutes", actual="minutes"), features.CORRIDOR_NUMERIC, features.CORRIDOR_CATEGORICAL, rounds=60, valid="valid")
    done = model.predict(fitted, rows.where("split = 'test'"), "minutes", out="predicted")
    return rounded(done.groupBy("corridor").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("predicted") - F.col("minutes"))).alias("mae_model"), F.avg(F.abs(F.col("seasonal_median") - F.col("minutes"))).alias("mae_seasonal")))


@query("M12_day_ahead", f"""{cte('series', 'venue_events')}, {_ROLLED}, {_HOLIDAYS}, {_EVENTS}, day AS (SELECT max(date) + 1 AS date FROM series),
r AS (SELECT *, row_number() OVER (PARTITION BY corridor, dow, tod ORDER BY ts DESC, id DESC) AS k FROM series), t AS (SELECT corridor, dow, tod, quantile_cont(minutes, 0.5) AS typical FROM r WHERE k <= 8 GROUP BY 1, 2, 3),
l AS (SELECT corridor, avg(minutes - seasonal_median) AS residual FROM rolled WHERE date = (SELECT max(date) FROM rolled) GROUP BY corridor),
p AS (SELECT t.corridor, CAST(day.date AS DATE) AS date, t.tod, typical, typical + 0.5 * coalesce(residual, 0) AS pred FROM t JOIN day ON t.dow = isodow(day.date) - 1 LEFT JOIN l USING (corridor)),
k AS (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY pred DESC, tod) AS q FROM p WHERE tod >= 420 AND tod < 600)
SELECT corridor, k.date, CAST(tod AS BIGINT) AS worst_tod, printf('%02d:%02d', tod // 60, tod % 60) AS at, round(round(pred, 9), 4) AS pred, round(typical, 4) AS typical, round(round(pred - typical, 9), 4) AS delta, hc.class AS holiday_class FROM k JOIN hc ON hc.date = k.date WHERE q = 1""")
def _(spark, d):
    """Each corridor's next day: the latest eight of each slot, half of the last day's residual, the calendar, and the worst morning slot."""
    s = frame(spark, d, "series")
    typical = seasonal.last_n(s, "minutes", ("corridor", "dow", "tod"), ("ts", "id"))
    rolled = seasonal.causal_rolling(s, "minutes", ("corridor", "dow", "tod"), ("ts", "id"))
    day = s.agg(F.date_add(F.max("date"), 1).alias("date")).withColumn("dow", F.weekday("date"))
    rows = typical.join(F.broadcast(day), "dow").join(seasonal.latest_residual(rolled), "corridor")
    top = publish.peak_summary(rows.withColumns({"pred": F.col("median") + 0.5 * F.col("residual"), "typical": F.col("median")}), 420, 600)
    return rounded(rounded(features.holiday_class(top, features.holidays(spark, 1991, 2005)).drop("holiday_name"), 9))


_PEAK = "(tod BETWEEN 420 AND 595 OR tod BETWEEN 900 AND 1135)"


@query("A12_six_slices", f"""{cte('series', 'venue_events')}, {_HOLIDAYS}, {_EVENTS}, m AS (SELECT DISTINCT concat('v', i % 7) AS venue, concat('k', i % 9) AS corridor FROM range(0, 14) t(i)),
ce AS (SELECT corridor, start FROM ev JOIN m USING (venue)), p AS (SELECT s.*, abs(minutes - 25) AS err, hc.class, EXISTS (SELECT 1 FROM ce WHERE ce.corridor = s.corridor AND date_sub('microsecond', ce.start, s.ts) / 3600000000.0 BETWEEN -4 AND 6) AS eventful FROM series s JOIN hc USING (date)), q AS (SELECT quantile_cont(err, 0.95) AS cut FROM p),
s AS (SELECT p.*, unnest(list_filter(['all', CASE WHEN {_PEAK} THEN 'peak' END, CASE WHEN class <> 'none' THEN 'holiday' END, CASE WHEN eventful THEN 'event' END, CASE WHEN precip >= 0.2 THEN 'rain' END, CASE WHEN err > cut THEN 'worst' END], lambda v: v IS NOT NULL)) AS slice FROM p, q)
SELECT slice, count(*) AS n, round(avg(err), 4) AS mae_baseline FROM s GROUP BY slice""")
def _(spark, d):
    pairs = [(f"v{v}", sorted({f"k{i % 9}" for i in range(14) if i % 7 == v})) for v in range(7)]
    reach = F.broadcast(readers.venue_corridors(spark.createDataFrame(pairs, "slug string, corridors array<string>")))
    near = asof.nearest_event(frame(spark, d, "series"), _events(spark, d).join(reach, "venue"), key="corridor", row_id="id")
    rows = features.holiday_class(near, features.holidays(spark, 1991, 2005))
    rows = evaluate.worst(rows.withColumn("guess", F.lit(25.0)), "minutes", "guess")
    slices = {"peak": fn.is_peak(F.col("tod")), "holiday": F.col("holiday_class") != "none", "event": F.col("hours_since_event").isNotNull(), "rain": F.col("precip") >= fn.RAIN_LIGHT, "worst": F.col("is_worst")}
    return rounded(evaluate.slice_report(rows, "minutes", "guess", {}, slices))


@query("A13_eight_slices", f"""{_NETWORK}, f AS (SELECT x.station, x.tod, base, pred, actual, abs(base - actual) AS err, (x.station * 7919) % 1000 < 300 AS held, hc.class, ww.precip, b.h
  FROM x LEFT JOIN b ON b.row_id = x.row_id AND b.sensor_id = x.sensor_id AND b.ts = x.ts JOIN hc ON hc.date = x.date LEFT JOIN ww ON ww.cell = x.cell AND ww.hr = date_trunc('hour', x.ts)),
q AS (SELECT quantile_cont(err, 0.95) AS cut FROM f),
s AS (SELECT f.*, unnest(list_filter(['all', CASE WHEN {_PEAK} THEN 'peak' END, CASE WHEN base < 45 THEN 'congested' END, CASE WHEN base < 45 AND {_PEAK} THEN 'peak+congested' END, CASE WHEN class <> 'none' THEN 'holiday' END,
  CASE WHEN precip >= 0.2 THEN 'rain' END, CASE WHEN h IS NOT NULL THEN 'near event' END, CASE WHEN err > cut THEN 'worst' END], lambda v: v IS NOT NULL)) AS slice FROM f, q),
g AS (SELECT held, slice, 0 AS level, count(*) AS n, avg(err) AS b, avg(abs(pred - actual)) AS m FROM s GROUP BY held, slice UNION ALL SELECT NULL, slice, 2, count(*), avg(err), avg(abs(pred - actual)) FROM s GROUP BY slice
  UNION ALL SELECT NULL, NULL, 3, count(*), avg(err), avg(abs(pred - actual)) FROM f)
SELECT held, slice, CAST(level AS BIGINT) AS level, n, round(round(b, 9), 4) AS mae_baseline, round(round(m, 9), 4) AS mae_model, round(round((b - m) / b * 100, 9), 4) AS gain_pct_model FROM g""")
def _(spark, d):
    """The report by held-out stations with all eight slices, on the network features, with the totals of each slice and of all rows."""
    rows = _network_matrix(spark, d, frame(spark, d, "readings")).withColumn("held", F.pmod(F.col("station").cast("bigint") * 7919, F.lit(1000)) < 300)
    rows = evaluate.worst(written(rows.select("held", "tod", "base", "pred", "actual", "holiday_class", "precip_mm", "hours_since_event")), "actual", "base")
    peak, slow = fn.is_peak(F.col("tod")), F.col("base") < 45
    slices = {"peak": peak, "congested": slow, "peak+congested": peak & slow, "holiday": F.col("holiday_class") != "none", "rain": F.col("precip_mm") >= fn.RAIN_LIGHT, "near event": F.col("hours_since_event").isNotNull(), "worst": F.col("is_worst")}
    return rounded(rounded(evaluate.slice_cube(rows, "actual", "base", {"model": "pred"}, slices, by="held"), 9))
