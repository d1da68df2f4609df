"""The registered queries of the travel-time operators, each with its SQL for the oracle where SQL can express it.

A query reads the given tables through the derivations of demo.py and applies
the operator to all rows. Doubles are rounded in both versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadtide.functions import columns as fn
from roadtide.operators import asof, corridor, evaluate, events, features, publish, quantiles, routing, seasonal, spatial
from roadtide.plans.demo import cte, frame
from roadtide.session import broadcast_if_small, written
from roadtide.sources import readers
from roadtide.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


# Corridors as the demo has them: every freeway and direction, postmiles 2 to 38.
_CORRIDORS = "corridors AS (SELECT DISTINCT concat('c', CAST(fwy AS STRING), dir) AS slug, fwy, dir, 2e0 AS pm_min, 38e0 AS pm_max FROM stations)"
_MEMBERS = "members AS (SELECT c.slug, s.sensor_id, s.abs_pm, coalesce(s.length, 5e-1) AS length FROM stations s JOIN corridors c ON s.fwy = c.fwy AND s.dir = c.dir AND s.abs_pm BETWEEN c.pm_min AND c.pm_max WHERE s.type = 'ML' AND s.abs_pm IS NOT NULL)"


def _members(spark, d):
    st = frame(spark, d, "stations")
    dims = st.select(F.concat(F.lit("c"), F.col("fwy").cast("string"), F.col("dir")).alias("slug"), "fwy", "dir").distinct().withColumns({"pm_min": F.lit(2.0), "pm_max": F.lit(38.0)})
    return corridor.members(st, dims).withColumn("length", F.coalesce("length", F.lit(0.5)))


_TRAVEL = f"""{cte('stations', 'readings')}, {_CORRIDORS}, {_MEMBERS},
total AS (SELECT slug, sum(length) AS total_mi FROM members GROUP BY slug),
tt AS (SELECT m.slug AS corridor, ts, sum(length / speed * 60) AS raw_minutes, sum(length) AS mi, count(DISTINCT station) AS n_stations, avg(pct_observed) AS pct_observed, max(total_mi) AS total_mi
  FROM readings r JOIN members m ON r.station = m.sensor_id JOIN total t ON t.slug = m.slug WHERE speed > 0 GROUP BY 1, 2)"""


@query("P3_corridor_members", f"{cte('stations')}, {_CORRIDORS}, {_MEMBERS} SELECT slug, CAST(sensor_id AS BIGINT) AS sensor_id, round(abs_pm, 4) AS abs_pm, round(length, 4) AS length FROM members")
def _(spark, d):
    return rounded(_members(spark, d))


@query("A1_corridor_travel_time", f"{_TRAVEL} SELECT corridor, ts, round(raw_minutes, 4) AS raw_minutes, n_stations, round(pct_observed, 4) AS pct_observed, round(mi / total_mi, 4) AS coverage, round(raw_minutes / (mi / total_mi), 4) AS minutes FROM tt")
def _(spark, d):
    return rounded(corridor.travel_time(frame(spark, d, "readings"), _members(spark, d)))


@query("A2_imputed_days", f"{cte('readings')} SELECT date, round(avg(pct_observed), 4) AS pct_observed, avg(pct_observed) < 50 AS imputed_day FROM readings GROUP BY date")
def _(spark, d):
    return rounded(corridor.imputed_days(frame(spark, d, "readings"), threshold=50))


@query("A3_seasonal_profile", f"""{cte('readings')}, rows_ AS (SELECT * FROM readings WHERE date < DATE '1998-01-01'),
cur AS (SELECT DISTINCT station FROM rows_ WHERE date = (SELECT max(date) FROM rows_))
SELECT CAST(station AS BIGINT) AS station, CAST(dow AS BIGINT) AS dow, CAST(tod AS BIGINT) AS tod, count(*) AS n, round(avg(speed), 4) AS seasonal_speed, round(stddev_pop(speed), 4) AS seasonal_sd
FROM rows_ WHERE pct_observed >= 20 AND station IN (SELECT station FROM cur) GROUP BY station, dow, tod HAVING count(*) >= 4""")
def _(spark, d):
    return rounded(seasonal.profile(frame(spark, d, "readings"), through="1998-01-01"))


@query("A4_last_n_table", f"""{cte('series')}, r AS (SELECT *, row_number() OVER (PARTITION BY corridor, dow, tod ORDER BY ts DESC, id DESC) AS k FROM series)
SELECT corridor, CAST(dow AS BIGINT) AS dow, CAST(tod AS BIGINT) AS tod, round(quantile_cont(minutes, 0.5), 4) AS median, round(stddev_samp(minutes), 4) AS sd, count(*) AS n FROM r WHERE k <= 8 GROUP BY 1, 2, 3""")
def _(spark, d):
    return rounded(seasonal.last_n(frame(spark, d, "series"), "minutes", ("corridor", "dow", "tod"), ("ts", "id")))


@query("A7_freeflow", f"""{cte('readings')}, p AS (SELECT station, avg(speed) AS s FROM readings WHERE pct_observed >= 20 GROUP BY station, dow, tod HAVING count(*) >= 4)
SELECT CAST(station AS BIGINT) AS station, round(quantile_cont(s, 0.9), 4) AS freeflow FROM p GROUP BY station""")
def _(spark, d):
    return rounded(seasonal.freeflow(seasonal.profile(frame(spark, d, "readings"), only_current=False)))


_ROLL = """PARTITION BY corridor, dow, tod ORDER BY ts, id"""
_ROLLED = f"""rolled AS (SELECT *, CASE WHEN count(minutes) OVER w >= 3 THEN quantile_cont(minutes, 0.5) OVER w END AS seasonal_median, CASE WHEN count(minutes) OVER w >= 3 THEN stddev_samp(minutes) OVER w END AS seasonal_sd,
  lag(minutes) OVER ({_ROLL}) AS prev_value FROM series WINDOW w AS ({_ROLL} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"""


def _rolled(spark, d):
    return seasonal.causal_rolling(frame(spark, d, "series"), "minutes", ("corridor", "dow", "tod"), ("ts", "id"))


@query("W1_causal_rolling", f"{cte('series')}, {_ROLLED} SELECT id, round(seasonal_median, 4) AS seasonal_median, round(seasonal_sd, 4) AS seasonal_sd, round(prev_value, 4) AS prev_value FROM rolled")
def _(spark, d):
    return rounded(_rolled(spark, d).select("id", "seasonal_median", "seasonal_sd", "prev_value"))


@query("M9_backtest", f"""{cte('series')}, {_ROLLED}, o AS (SELECT corridor, quantile_cont(minutes, 0.5) AS overall FROM series WHERE date < DATE '1997-01-01' GROUP BY corridor)
SELECT r.corridor, count(*) AS n, round(avg(abs(seasonal_median - minutes)), 4) AS mae_seasonal, round(avg(abs(prev_value - minutes)), 4) AS mae_last, round(avg(abs(overall - minutes)), 4) AS mae_overall
FROM rolled r JOIN o ON r.corridor = o.corridor WHERE date >= DATE '1997-01-01' AND date < DATE '1998-07-01' AND seasonal_median IS NOT NULL AND prev_value IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return rounded(evaluate.backtest(frame(spark, d, "series"), test_start="1997-01-01", test_end="1998-07-01", order=("ts", "id")))


@query("A11_flagship_corridor_mae", f"""{_TRAVEL}, s AS (SELECT corridor, ts, CAST(ts AS DATE) AS date, raw_minutes / (mi / total_mi) AS minutes FROM tt),
r AS (SELECT *, CASE WHEN count(minutes) OVER w >= 3 THEN quantile_cont(minutes, 0.5) OVER w END AS med FROM s
  WINDOW w AS (PARTITION BY corridor, isodow(date), hour(ts) * 60 + minute(ts) ORDER BY ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT corridor, count(*) AS n, round(avg(abs(med - minutes)), 4) AS mae FROM r WHERE med IS NOT NULL GROUP BY corridor""")
def flagship(spark, d):
    """Corridor travel times, their causal seasonal median, and its mean absolute error by corridor."""
    tt = corridor.travel_time(frame(spark, d, "readings"), _members(spark, d)).select("corridor", "ts", "minutes").withColumns({"date": F.to_date("ts"), "dow": F.weekday("ts"), "tod": fn.tod(F.col("ts"))})
    rolled = seasonal.causal_rolling(tt, "minutes", ("corridor", "dow", "tod"), ("ts",)).where("seasonal_median is not null")
    return rounded(rolled.groupBy("corridor").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("seasonal_median") - F.col("minutes"))).alias("mae")))


@query("P1_usable_rows", f"{cte('series')} SELECT id, corridor, round(minutes, 4) AS minutes FROM series WHERE NOT imputed_day AND coverage >= 0.9 AND minutes > 0")
def _(spark, d):
    return rounded(corridor.usable(frame(spark, d, "series")).select("id", "corridor", "minutes"))


@query("P4_interval_sampling", f"{cte('readings')} SELECT row_id, CAST(tod AS BIGINT) AS tod FROM readings WHERE tod % 180 = 0")
def _(spark, d):
    """Every 36th five-minute interval: the operator samples times of day, alike for all stations and days."""
    return rounded(frame(spark, d, "readings").where(F.pmod("tod", F.lit(5 * 36)) == 0).select("row_id", "tod"))


@query("P5_temporal_split", f"""{cte('series')}, s AS (SELECT CASE WHEN date < DATE '1996-01-01' THEN 'train' WHEN date < DATE '1997-01-01' THEN 'valid' WHEN date < DATE '1998-01-01' THEN 'test' END AS split, minutes FROM series)
SELECT split, count(*) AS n, round(avg(minutes), 4) AS mean FROM s WHERE split IS NOT NULL GROUP BY split""")
def _(spark, d):
    return rounded(features.temporal_split(frame(spark, d, "series"), "1996-01-01", "1997-01-01", "1998-01-01").groupBy("split").agg(F.count("*").alias("n"), F.avg("minutes").alias("mean")))


@query("P6_time_keys", f"{cte('venue_events')} SELECT event_id, CAST(start AS DATE) AS date, isodow(start) - 1 AS dow, hour(start) * 60 + minute(start) AS tod, month(start) AS month, isodow(start) >= 6 AS is_weekend FROM venue_events")
def _(spark, d):
    return rounded(frame(spark, d, "venue_events").select("event_id", *(c.alias(n) for n, c in fn.time_keys(F.col("start")).items())))


@query("P9_plausible_time", f"{cte('venue_events')} SELECT event_id, NOT (hour(start) = 0 AND minute(start) = 0) AND minute(start) % 5 = 0 AS plausible FROM venue_events")
def _(spark, d):
    return frame(spark, d, "venue_events").select("event_id", fn.plausible_time(F.col("start")).alias("plausible"))


@query("P8_in_area", f"{cte('stations')} SELECT CAST(sensor_id AS BIGINT) AS sensor_id, lat BETWEEN 373e-1 AND 377e-1 AND lon BETWEEN -1225e-1 AND -122e0 AS in_area FROM stations")
def _(spark, d):
    return rounded(frame(spark, d, "stations").select("sensor_id", fn.in_box(F.col("lat"), F.col("lon"), 37.3, -122.5, 37.7, -122.0).alias("in_area")))


@query("P14_staleness", f"{cte('venue_events')} SELECT max(start) AS newest, round(date_sub('second', max(start), TIMESTAMP '2024-02-01 00:00:00') / 3600.0, 4) AS age_hours, date_sub('second', max(start), TIMESTAMP '2024-02-01 00:00:00') / 3600.0 > 36 AS stale FROM venue_events")
def _(spark, d):
    return rounded(publish.staleness(frame(spark, d, "venue_events"), "2024-02-01 00:00:00", ts="start"))


@query("P16_peak_share", f"{cte('series')} SELECT corridor, count(*) FILTER (WHERE tod BETWEEN 420 AND 595 OR tod BETWEEN 900 AND 1135) AS peak, count(*) AS n FROM series GROUP BY corridor")
def _(spark, d):
    return frame(spark, d, "series").groupBy("corridor").agg(F.count_if(fn.is_peak(F.col("tod"))).alias("peak"), F.count("*").alias("n"))


@query("F1_event_type", f"""{cte('venue_events')}, t AS (SELECT event_id, lower(title) AS t FROM venue_events)
SELECT event_id, CASE WHEN t LIKE '%49ers%' OR t LIKE '%week-%' THEN 'nfl' WHEN t LIKE '%earthquakes%' OR t LIKE '% sc%' OR t LIKE '%fc %' THEN 'soccer' WHEN t LIKE '%sharks%' OR t LIKE '%barracuda%' THEN 'hockey'
 WHEN t LIKE '%warriors%' OR t LIKE '%nba%' THEN 'basketball' WHEN t LIKE '%giants%' THEN 'baseball' WHEN t LIKE '%stanford%' THEN 'college' ELSE 'concert' END AS event_type FROM t""")
def _(spark, d):
    return frame(spark, d, "venue_events").select("event_id", fn.event_type(F.col("title")).alias("event_type"))


@query("F2_rain_class", f"{cte('series')} SELECT id, CASE WHEN precip IS NULL THEN 'unknown' WHEN precip >= 2.5 THEN 'rain_heavy' WHEN precip >= 0.2 THEN 'rain_light' ELSE 'dry' END AS rain_class FROM series")
def _(spark, d):
    return frame(spark, d, "series").select("id", fn.rain_class(F.col("precip")).alias("rain_class"))


@query("F7_dedupe_key", "SELECT doc_id, left(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 40) AS key FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", fn.dedupe_key(F.col("text")).alias("key"))


@query("F11_maxspeed", f"""{cte('ways')}, w AS (SELECT *, TRY_CAST(regexp_replace(tag, '[^0-9]', '', 'g') AS DOUBLE) AS n FROM ways)
SELECT way_id, round(coalesce(CASE WHEN lower(tag) LIKE '%mph%' THEN n ELSE n * 0.621371 END, CASE highway WHEN 'motorway' THEN 65 WHEN 'trunk' THEN 45 WHEN 'primary' THEN 35 WHEN 'secondary' THEN 35 WHEN 'tertiary' THEN 30 ELSE 30 END), 4) AS mph FROM w""")
def _(spark, d):
    return rounded(frame(spark, d, "ways").select("way_id", fn.maxspeed_mph(F.col("tag"), F.col("highway")).alias("mph")))


@query("F12_bearing", f"""{cte('stations')} SELECT CAST(sensor_id AS BIGINT) AS sensor_id, round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 4) AS bearing, round(sqrt(pow((375e-1 - lat) * 69, 2) + pow((-1222e-1 - lon) * 54.6, 2)), 4) AS planar, round(sqrt(pow((375e-1 - lat) * 69, 2) + pow((-1222e-1 - lon) * 69 * cos(radians(lat)), 2)), 4) AS equirect
FROM (SELECT *, degrees(atan2(sin(radians(-1222e-1 - lon)) * cos(radians(375e-1)), cos(radians(lat)) * sin(radians(375e-1)) - sin(radians(lat)) * cos(radians(375e-1)) * cos(radians(-1222e-1 - lon)))) AS b FROM stations)""")
def _(spark, d):
    lat, lon, a, b = F.col("lat"), F.col("lon"), F.lit(37.5), F.lit(-122.2)
    return rounded(frame(spark, d, "stations").select("sensor_id", fn.bearing(lat, lon, a, b).alias("bearing"), fn.planar_miles(lat, lon, a, b).alias("planar"), fn.equirect_miles(lat, lon, a, b).alias("equirect")))


@query("F16_pace", f"{cte('readings')} SELECT row_id, round(60 / least(greatest(speed, 5), 80), 4) AS pace, round(60 / least(greatest(60 / least(greatest(speed, 5), 80), 0.75), 12), 4) AS mph FROM readings")
def _(spark, d):
    p = fn.pace(F.col("speed"))
    return rounded(frame(spark, d, "readings").select("row_id", p.alias("pace"), fn.mph_of_pace(p).alias("mph")))


@query("F17_service_level", f"""{cte('readings')}, f AS (SELECT station, quantile_cont(speed, 0.9) AS ff FROM readings GROUP BY station), r AS (SELECT row_id, least(greatest(speed / ff, 0.15), 1.05) AS ratio FROM readings JOIN f USING (station))
SELECT row_id, round(ratio, 4) AS ratio, CAST(CASE WHEN ratio >= 0.95 THEN 1 WHEN ratio >= 0.85 THEN 2 WHEN ratio >= 0.7 THEN 3 WHEN ratio >= 0.5 THEN 4 ELSE 5 END AS BIGINT) AS level, round(greatest(least(35 * (1 - 0.5 * (1 - ratio)), 35), 5), 4) AS street_mph FROM r""")
def _(spark, d):
    r = frame(spark, d, "readings")
    ff = quantiles.group_quantiles(r, ["station"], F.col("speed"), {"ff": 0.9}).select("station", "ff")
    ratio = fn.flow_ratio(F.col("speed"), F.col("ff"))
    return rounded(r.join(ff, "station").select("row_id", ratio.alias("ratio"), fn.service_level(ratio).alias("level"), fn.surface_mph(ratio, F.lit(35.0)).alias("street_mph")))


@query("F22_hhmm_slots", f"{cte('series')} SELECT id, printf('%02d:%02d', tod // 60, tod % 60) AS at, CAST(tod // 30 AS BIGINT) AS slot FROM series")
def _(spark, d):
    return rounded(frame(spark, d, "series").select("id", fn.hhmm(F.col("tod")).alias("at"), fn.slot_of(F.col("tod"), 30).alias("slot")))


@query("F27_occupied_cells", f"{cte('stations')} SELECT DISTINCT round(floor(lat / 0.25) * 0.25 + 0.125, 3) AS lat, round(floor(lon / 0.25) * 0.25 + 0.125, 3) AS lon FROM stations")
def _(spark, d):
    return spatial.occupied_cells(frame(spark, d, "stations"))


@query("F30_coordinate_dedupe", f"{cte('ways')} SELECT min(way_id) AS way_id, count(*) AS n FROM ways GROUP BY round(lat, 4), round(lon, 4), lower(left(concat(highway, ' Street Number ', coalesce(tag, '')), 24))")
def _(spark, d):
    """One place of those that agree in rounded coordinates and the first 24 letters of the name."""
    name = F.concat("highway", F.lit(" Street Number "), F.coalesce("tag", F.lit("")))
    key = [c.alias(n) for n, c in fn.place_key(F.col("lat"), F.col("lon"), name).items()]
    return frame(spark, d, "ways").select("way_id", *key).groupBy("key_lat", "key_lon", "key_name").agg(F.min("way_id").alias("way_id"), F.count("*").alias("n")).select("way_id", "n")


_PROFILE = "profile AS (SELECT station, dow, tod, avg(speed) AS seasonal_speed, stddev_pop(speed) AS seasonal_sd FROM readings WHERE pct_observed >= 20 GROUP BY station, dow, tod HAVING count(*) >= 4)"


def _profile(spark, d):
    return seasonal.profile(frame(spark, d, "readings"), only_current=False).drop("n")


@query("J1_readings_seasonal", f"{cte('readings')}, {_PROFILE} SELECT row_id, round(speed - seasonal_speed, 4) AS residual FROM readings JOIN profile USING (station, dow, tod)")
def _(spark, d):
    return rounded(frame(spark, d, "readings").join(_profile(spark, d), ["station", "dow", "tod"]).select("row_id", (F.col("speed") - F.col("seasonal_speed")).alias("residual")))


@query("J2_station_attributes", f"{cte('readings', 'stations')} SELECT row_id, CAST(fwy AS STRING) AS fwy, dir, CAST(lanes AS BIGINT) AS lanes FROM readings JOIN stations ON station = sensor_id")
def _(spark, d):
    st = broadcast_if_small(frame(spark, d, "stations"))
    return rounded(frame(spark, d, "readings").join(st, F.col("station") == F.col("sensor_id")).select("row_id", F.col("fwy").cast("string").alias("fwy"), "dir", "lanes"))


@query("J3_semi_join", f"{cte('readings', 'stations')} SELECT row_id, round(speed, 4) AS speed FROM readings WHERE station IN (SELECT sensor_id FROM stations WHERE type IN ('ML', 'HV') AND fwy = 1)")
def _(spark, d):
    st = frame(spark, d, "stations").where("type in ('ML', 'HV') and fwy = 1").select(F.col("sensor_id").alias("station"))
    return rounded(frame(spark, d, "readings").join(st, "station", "left_semi").select("row_id", "speed"))


@query("J6_yesterday_residual", f"""{cte('series')}, {_ROLLED}, y AS (SELECT corridor, date + 1 AS date, avg(minutes - seasonal_median) AS yesterday FROM rolled GROUP BY 1, 2)
SELECT r.id, round(y.yesterday, 4) AS yesterday FROM rolled r LEFT JOIN y ON r.corridor = y.corridor AND r.date = CAST(y.date AS DATE)""")
def _(spark, d):
    return rounded(seasonal.yesterday_residual(_rolled(spark, d)).select("id", "yesterday"))


@query("A6_latest_residual", f"""{cte('series')}, {_ROLLED}, l AS (SELECT corridor, avg(minutes - seasonal_median) AS residual FROM rolled WHERE date = (SELECT max(date) FROM rolled) GROUP BY corridor)
SELECT c.corridor, round(coalesce(residual, 0), 4) AS residual FROM (SELECT DISTINCT corridor FROM rolled) c LEFT JOIN l USING (corridor)""")
def _(spark, d):
    return rounded(seasonal.latest_residual(_rolled(spark, d)))


def _asof_sql(low: float, high: float) -> str:
    return f"""{cte('probes', 'venue_events')}, h AS (SELECT p.row_id, e.event_id, e.title, date_sub('microsecond', e.start, p.ts) / 3600000000.0 AS h FROM probes p JOIN venue_events e ON p.venue = e.venue),
b AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN h >= 0 THEN 0 ELSE 1 END, abs(h), event_id) AS r FROM h WHERE h BETWEEN {low} AND {high})"""


@query("J7_nearest_event", f"{_asof_sql(-4, 6)} SELECT p.row_id, b.event_id, round(b.h, 4) AS hours_since_event, b.title FROM probes p LEFT JOIN b ON p.row_id = b.row_id AND b.r = 1")
def _(spark, d):
    got = asof.nearest_event(frame(spark, d, "probes"), frame(spark, d, "venue_events"), key="venue", row_id="row_id", keep=("title",))
    return rounded(got.select("row_id", "event_id", "hours_since_event", "title"))


@query("J8_hour_bucket", f"{_asof_sql(-4, 6)} SELECT p.row_id, CASE WHEN floor(b.h) BETWEEN -3 AND 6 THEN CAST(floor(b.h) AS BIGINT) END AS bucket FROM probes p LEFT JOIN b ON p.row_id = b.row_id AND b.r = 1")
def _(spark, d):
    """Hours since the event in reach, before its start too."""
    got = asof.nearest_event(frame(spark, d, "probes"), frame(spark, d, "venue_events"), key="venue", row_id="row_id")
    return rounded(got.select("row_id", asof.hour_bucket(F.col("hours_since_event")).alias("bucket")))


@query("J8_two_sided_bucket", f"{_asof_sql(-4, 6)} SELECT p.row_id, CASE WHEN floor(b.h) BETWEEN -3 AND 6 THEN CAST(floor(b.h) AS BIGINT) END AS bucket FROM probes p LEFT JOIN b ON p.row_id = b.row_id AND b.r = 1")
def _(spark, d):
    got = asof.nearest_event(frame(spark, d, "probes"), frame(spark, d, "venue_events"), key="venue", row_id="row_id")
    return rounded(got.select("row_id", asof.hour_bucket(F.col("hours_since_event")).alias("bucket")))


_KNN = f"""{cte('ways', 'stations')}, k AS (SELECT way_id, sensor_id, sqrt(pow((s.lat - w.lat) * 69, 2) + pow((s.lon - w.lon) * 54.6, 2)) AS dist FROM ways w, stations s),
r AS (SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY dist, sensor_id) AS rank FROM k WHERE dist <= 2),
l AS (SELECT *, 1 / pow(greatest(dist, 0.15), 2) AS w FROM r WHERE rank <= 6), links AS (SELECT *, w / sum(w) OVER (PARTITION BY way_id) AS weight FROM l)"""


@query("J12_knn_idw_links", f"{_KNN} SELECT way_id, CAST(sensor_id AS BIGINT) AS station, round(dist, 4) AS dist_mi, round(weight, 4) AS weight FROM links")
def _(spark, d):
    return rounded(routing.way_links(frame(spark, d, "ways"), frame(spark, d, "stations")))


@query("J9_nearest_cell", f"""{cte('stations')}, c AS (SELECT DISTINCT round(floor(lat / 0.25) * 0.25 + 0.125, 3) AS clat, round(floor(lon / 0.25) * 0.25 + 0.125, 3) AS clon FROM stations),
r AS (SELECT sensor_id, clat, clon, row_number() OVER (PARTITION BY sensor_id ORDER BY round(pow(lat - clat, 2) + pow(lon - clon, 2), 9), concat(clat, ',', clon)) AS k FROM stations, c)
SELECT CAST(sensor_id AS BIGINT) AS sensor_id, clat AS lat, clon AS lon FROM r WHERE k = 1""")
def _(spark, d):
    st = frame(spark, d, "stations")
    cells = spatial.occupied_cells(st).select(F.concat_ws(",", "lat", "lon").alias("right_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    got = spatial.nearest_in_grid(st.select(F.col("sensor_id").alias("left_id"), "lat", "lon"), cells, 0.25)
    at = F.split("right_id", ",")
    return got.select(F.col("left_id").cast("bigint").alias("sensor_id"), at[0].cast("double").alias("lat"), at[1].cast("double").alias("lon"))


_VENUES = "venues(venue, vlat, vlon) AS (VALUES " + ", ".join(f"('{v[0]}', CAST({v[2]} AS DOUBLE), CAST({v[3]} AS DOUBLE))" for v in readers.VENUES) + ")"


@query("J10_nearest_venue", f"""{cte('stations')}, {_VENUES}, m AS (SELECT sensor_id, venue, sqrt(pow((vlat - lat) * 69, 2) + pow((vlon - lon) * 69 * cos(radians(lat)), 2)) AS miles FROM stations, venues),
r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY miles, venue) AS k FROM m) SELECT CAST(sensor_id AS BIGINT) AS sensor_id, CASE WHEN miles <= 12 THEN venue END AS venue, round(miles, 4) AS event_miles FROM r WHERE k = 1""")
def _(spark, d):
    venues = readers.venue_dimension(spark).select(F.col("slug").alias("right_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    got = spatial.nearest(frame(spark, d, "stations").select(F.col("sensor_id").alias("left_id"), "lat", "lon"), venues, fn.equirect_miles(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    return rounded(got.select(F.col("left_id").alias("sensor_id"), F.when(F.col("dist") <= spatial.MAX_EVENT_MI, F.col("right_id")).alias("venue"), F.col("dist").alias("event_miles")))


@query("J14_horizon", f"""{cte('readings')}, {_PROFILE}, days AS (SELECT CAST(DATE '2026-08-01' + CAST(i AS INT) AS DATE) AS date FROM range(0, 7) t(i))
SELECT date, count(*) AS rows, round(sum(seasonal_speed), 2) AS total FROM profile p JOIN days ON p.dow = isodow(date) - 1 WHERE tod % 15 = 0 GROUP BY date""")
def _(spark, d):
    return features.horizon(_profile(spark, d), "2026-08-01", 7).groupBy("date").agg(F.count("*").alias("rows"), F.round(F.sum("seasonal_speed"), 2).alias("total"))


@query("J19_event_fanout", f"""{cte('venue_events')}, m AS (SELECT concat('v', i % 7) AS venue, concat('k', i % 9) AS corridor FROM range(0, 14) t(i))
SELECT corridor, CAST(start AS DATE) AS date, count(*) AS events FROM venue_events e JOIN m USING (venue) GROUP BY 1, 2""")
def _(spark, d):
    pairs = [(f"v{v}", sorted({f"k{i % 9}" for i in range(14) if i % 7 == v})) for v in range(7)]
    dims = readers.venue_corridors(spark.createDataFrame(pairs, "slug string, corridors array<string>"))
    return frame(spark, d, "venue_events").join(F.broadcast(dims), "venue").groupBy("corridor", F.to_date("start").alias("date")).agg(F.count("*").alias("events"))


@query("J20_aligned_measures", f"""{cte('stations', 'readings')}, {_CORRIDORS}, {_MEMBERS}, total AS (SELECT slug, sum(length) AS t FROM members GROUP BY slug)
SELECT m.slug AS corridor, ts, round(round(sum(length / speed * 60) * max(t) / sum(length), 9), 4) AS actual_minutes, round(round(sum(length / base * 60) * max(t) / sum(length), 9), 4) AS base_minutes, round(round(sum(length / pred * 60) * max(t) / sum(length), 9), 4) AS pred_minutes, round(sum(length) / max(t), 4) AS coverage
FROM readings JOIN members m ON station = sensor_id JOIN total ON total.slug = m.slug WHERE speed > 0 GROUP BY 1, 2""")
def _(spark, d):
    """Sums in another order differ in the last bits, so they are rounded to nine digits first, which settles ties."""
    return rounded(rounded(corridor.compose(frame(spark, d, "readings"), _members(spark, d), {"actual_minutes": "speed", "base_minutes": "base", "pred_minutes": "pred"}, weight="length"), 9))


@query("A17_relative_coverage", f"""{_TRAVEL}, c AS (SELECT corridor, ts, mi / total_mi AS coverage FROM tt), t AS (SELECT corridor, quantile_cont(coverage, 0.5) AS typical FROM c GROUP BY corridor)
SELECT corridor, count(*) AS n, round(avg(coverage), 4) AS coverage FROM c JOIN t USING (corridor) WHERE coverage >= 0.8 * typical GROUP BY corridor""")
def _(spark, d):
    """The SQL's own comparison of doubles; of sums it leaves the order open, here they are exact."""
    tt = corridor.travel_time(frame(spark, d, "readings"), _members(spark, d), exact=True)
    return rounded(corridor.well_covered(tt, digits=None).groupBy("corridor").agg(F.count("*").alias("n"), F.avg("coverage").alias("coverage")))


@query("M10_route_validation", f"""{cte('stations', 'readings')}, {_CORRIDORS}, {_MEMBERS}, total AS (SELECT slug, sum(length) AS t FROM members GROUP BY slug),
c AS (SELECT m.slug AS corridor, ts, sum(length / speed * 60) * max(t) / sum(length) AS a, sum(length / base * 60) * max(t) / sum(length) AS b, sum(length / pred * 60) * max(t) / sum(length) AS p, sum(length) / max(t) AS cov
  FROM readings JOIN members m ON station = sensor_id JOIN total ON total.slug = m.slug WHERE speed > 0 GROUP BY 1, 2),
k AS (SELECT corridor, quantile_cont(cov, 0.5) AS typical FROM c GROUP BY corridor),
g AS (SELECT corridor, count(*) AS n, avg(abs(b - a)) AS mb, avg(abs(p - a)) AS mp FROM c JOIN k USING (corridor) WHERE cov >= 0.8 * typical GROUP BY corridor)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(mb * n) / sum(n), 4) AS mae_baseline, round(sum(mp * n) / sum(n), 4) AS mae_model FROM g""")
def _(spark, d):
    """The rows that A17_relative_coverage keeps."""
    rows = corridor.well_covered(corridor.compose(frame(spark, d, "readings"), _members(spark, d), {"a": "speed", "b": "base", "p": "pred"}, weight="length", exact=True), digits=None)
    per = rows.groupBy("corridor").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("b") - F.col("a"))).alias("mae_baseline"), F.avg(F.abs(F.col("p") - F.col("a"))).alias("mae_model"))
    return rounded(evaluate.weighted_overall(per, ["mae_baseline", "mae_model"]))


@query("A13_slice_report", f"""{cte('readings')}, x AS (SELECT *, abs(base - actual) AS err, (hash_ % 1000) < 300 AS held FROM (SELECT *, station * 7919 AS hash_ FROM readings)),
q AS (SELECT quantile_cont(err, 0.95) AS cut FROM x), s AS (SELECT x.*, unnest(list_filter(['all', CASE WHEN tod BETWEEN 420 AND 595 OR tod BETWEEN 900 AND 1135 THEN 'peak' END, CASE WHEN base < 45 THEN 'congested' END, CASE WHEN base < 45 AND (tod BETWEEN 420 AND 595 OR tod BETWEEN 900 AND 1135) THEN 'peak+congested' END, CASE WHEN err > cut THEN 'worst' END], lambda v: v IS NOT NULL)) AS slice FROM x, q)
SELECT held, slice, count(*) AS n, round(avg(err), 4) AS mae_baseline, round(avg(abs(pred - actual)), 4) AS mae_model, round((avg(err) - avg(abs(pred - actual))) / avg(err) * 100, 4) AS gain_pct_model FROM s GROUP BY 1, 2""")
def _(spark, d):
    rows = evaluate.worst(frame(spark, d, "readings").withColumn("held", F.pmod(F.col("station").cast("bigint") * 7919, F.lit(1000)) < 300), "actual", "base")
    peak, slow = fn.is_peak(F.col("tod")), F.col("base") < 45
    return rounded(evaluate.slice_report(rows, "actual", "base", {"model": "pred"}, {"peak": peak, "congested": slow, "peak+congested": peak & slow, "worst": F.col("is_worst")}, by="held"))


@query("A8_context_factor", f"{cte('readings')} SELECT CAST(station AS BIGINT) AS station, CAST(tod AS BIGINT) AS tod, round(quantile_cont(actual / base, 0.5), 4) AS factor FROM readings GROUP BY station, tod HAVING count(*) >= 20")
def _(spark, d):
    return rounded(features.learn_factor(frame(spark, d, "readings"), ["station", "tod"]))


# Layers of the demo: each is learnt on the plain baseline before 1997, of groups with enough rows, and acts on the rows from then on.
_LAYERS = f"""{cte('readings')}, tr AS (SELECT * FROM readings WHERE date < DATE '1997-01-01' AND base > 0), te AS (SELECT * FROM readings WHERE date >= DATE '1997-01-01'),
f1 AS (SELECT dow, quantile_cont(actual / base, 0.5) AS f FROM tr WHERE tod < 600 GROUP BY dow HAVING count(*) >= 20),
f2 AS (SELECT tod, quantile_cont(actual / base, 0.5) AS f FROM tr WHERE pct_observed >= 50 GROUP BY tod HAVING count(*) >= 20),
done AS (SELECT te.*, tod < 600 AS on1, pct_observed >= 50 AS on2, CASE WHEN tod < 600 THEN coalesce(f1.f, 1) ELSE 1 END AS g1, CASE WHEN pct_observed >= 50 THEN coalesce(f2.f, 1) ELSE 1 END AS g2 FROM te LEFT JOIN f1 USING (dow) LEFT JOIN f2 USING (tod))"""


def _layered(spark, d):
    r = frame(spark, d, "readings")
    cut, layers = F.lit("1997-01-01").cast("date"), [("morning", ["dow"], F.col("tod") < 600), ("observed", ["tod"], F.col("pct_observed") >= 50)]
    return features.layered_corrections(r.where(F.col("date") < cut), r.where(F.col("date") >= cut), layers), layers


@query("M8_layered_corrections", f"{_LAYERS} SELECT row_id, round(g1, 4) AS f_morning, round(g2, 4) AS f_observed, round(base * g1 * g2, 4) AS corrected FROM done")
def _(spark, d):
    return rounded(_layered(spark, d)[0].select("row_id", "f_morning", "f_observed", "corrected"))


@query("M13_layer_report", f"""{_LAYERS}, l AS (SELECT 0 AS no, 'morning' AS layer, on1 AS active, base * g1 AS adj, * FROM done UNION ALL SELECT 1, 'observed', on2, base * g2, * FROM done UNION ALL SELECT 2, 'all layers', true, base * g1 * g2, * FROM done),
g AS (SELECT no, layer, count(*) AS n, count(*) FILTER (WHERE active) AS r, sum(abs(base - actual)) AS w, sum(abs(base - actual)) FILTER (WHERE active) AS b, sum(abs(adj - actual)) FILTER (WHERE active) AS a FROM l GROUP BY 1, 2)
SELECT CAST(no AS BIGINT) AS no, layer, r AS rows, round(r * 100 / n, 4) AS share_pct, round(b / r, 4) AS mae_before, round(a / r, 4) AS mae_after, round((b - a) * 100 / b, 4) AS gain_pct, round((b - a) * 100 / w, 4) AS global_gain_pct, round(b * 100 / w, 4) AS error_share_pct FROM g""")
def _(spark, d):
    return rounded(features.layer_report(*_layered(spark, d)))


@query("A21_error_share", f"{cte('readings')} SELECT round(sum(abs(pred - actual)) FILTER (WHERE tod < 600) / sum(abs(pred - actual)), 4) AS error_share, count(*) FILTER (WHERE tod < 600) AS rows FROM readings")
def _(spark, d):
    return rounded(evaluate.error_share(frame(spark, d, "readings"), "actual", "pred", F.col("tod") < 600))


@query("A22_table_distribution", f"{cte('readings')} SELECT round(quantile_cont(pred, 0.05), 4) AS p05, round(quantile_cont(pred, 0.5), 4) AS p50, round(quantile_cont(pred, 0.95), 4) AS p95, count(pred) AS n FROM readings")
def _(spark, d):
    """The quantiles of the whole table."""
    return rounded(quantiles.group_quantiles(frame(spark, d, "readings"), [], F.col("pred"), {"p05": 0.05, "p50": 0.5, "p95": 0.95}))


@query("A22_distribution", f"{cte('readings')} SELECT CAST(station AS BIGINT) AS station, round(quantile_cont(pred, 0.05), 4) AS p05, round(quantile_cont(pred, 0.5), 4) AS p50, round(quantile_cont(pred, 0.95), 4) AS p95 FROM readings GROUP BY station")
def _(spark, d):
    return rounded(quantiles.group_quantiles(frame(spark, d, "readings"), ["station"], F.col("pred"), {"p05": 0.05, "p50": 0.5, "p95": 0.95}).drop("n"))


@query("A18_peak_summary", f"""{cte('readings')}, r AS (SELECT *, row_number() OVER (PARTITION BY station, date ORDER BY pred DESC, tod, base) AS k FROM readings WHERE tod >= 420 AND tod < 600)
SELECT CAST(station AS BIGINT) AS station, date, CAST(tod AS BIGINT) AS worst_tod, printf('%02d:%02d', tod // 60, tod % 60) AS at, round(pred, 4) AS pred FROM r WHERE k = 1""")
def _(spark, d):
    r = frame(spark, d, "readings").withColumn("typical", F.col("base"))
    return rounded(publish.peak_summary(r, 420, 600, keys=("station", "date")).select("station", "date", "worst_tod", "at", "pred"))


@query("A20_rain_hours", f"{cte('series')} SELECT corridor, count(*) FILTER (WHERE precip >= 0.2) AS rain_hours, round(count(*) FILTER (WHERE precip >= 0.2) / count(*), 4) AS share FROM series GROUP BY corridor")
def _(spark, d):
    return rounded(frame(spark, d, "series").groupBy("corridor").agg(F.count_if(F.col("precip") >= fn.RAIN_LIGHT).alias("rain_hours"), (F.count_if(F.col("precip") >= fn.RAIN_LIGHT) / F.count("*")).alias("share")))


@query("A24_week_grid", f"""{cte('series')}, c AS (SELECT corridor, dow, tod // 60 AS hour, max(minutes) AS minutes FROM series GROUP BY 1, 2, 3)
SELECT corridor, CAST(dow AS BIGINT) AS dow, CAST(hour AS BIGINT) AS hour, round(minutes, 4) AS minutes, round(min(minutes) OVER (PARTITION BY corridor) / minutes, 4) AS ratio FROM c""")
def _(spark, d):
    return rounded(publish.week_grid(frame(spark, d, "series")))


@query("A25_dense_slots", f"""{cte('series')}, m AS (SELECT corridor, tod // 15 AS slot, max(minutes) AS v FROM series GROUP BY 1, 2), g AS (SELECT corridor, i AS slot FROM (SELECT DISTINCT corridor FROM series), range(0, 96) t(i))
SELECT g.corridor, list(coalesce(CAST(round_even(v, 0) AS INTEGER), -1) ORDER BY g.slot) AS values FROM g LEFT JOIN m ON g.corridor = m.corridor AND g.slot = m.slot GROUP BY g.corridor""")
def _(spark, d):
    return publish.dense_slots(frame(spark, d, "series").withColumn("slot", fn.slot_of(F.col("tod"))), "corridor", "slot", "minutes", 96)


@query("W5_rolling_rain", f"{cte('series')} SELECT id, round(sum(precip) OVER (PARTITION BY corridor ORDER BY ts, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS rain3, round(sum(precip) OVER (PARTITION BY corridor ORDER BY ts, id ROWS BETWEEN 35 PRECEDING AND CURRENT ROW), 4) AS rain36 FROM series")
def _(spark, d):
    s = seasonal.rolling_sums(frame(spark, d, "series"), "precip", ("corridor",), ("ts", "id"), {"rain3": 3, "rain36": 36})
    return rounded(s.select("id", "rain3", "rain36"))


_W = "OVER (PARTITION BY fwy, dir ORDER BY abs_pm, sensor_id)"


@query("W8_spacing", f"{cte('stations')} SELECT CAST(sensor_id AS BIGINT) AS sensor_id, round(coalesce(lead(abs_pm) {_W} - abs_pm, abs_pm - lag(abs_pm) {_W}, length, 0.5), 4) AS spacing FROM stations")
def _(spark, d):
    return rounded(corridor.spacing(frame(spark, d, "stations")).select("sensor_id", "spacing"))


@query("W13_middle_station", f"{cte('stations')}, r AS (SELECT *, row_number() {_W} - 1 AS k, count(*) OVER (PARTITION BY fwy, dir) // 2 AS mid FROM stations) SELECT CAST(sensor_id AS BIGINT) AS sensor_id, CAST(fwy AS BIGINT) AS fwy, dir FROM r WHERE k = mid")
def _(spark, d):
    return rounded(corridor.middle_station(frame(spark, d, "stations")).select("sensor_id", "fwy", "dir"))


@query("W12_first_per_key", f"{cte('series')}, r AS (SELECT *, row_number() OVER (PARTITION BY corridor, date ORDER BY ts, id) AS k FROM series) SELECT id, corridor, date FROM r WHERE k = 1")
def _(spark, d):
    return seasonal.first_per_key(frame(spark, d, "series"), ("corridor", "date"), ("ts", "id")).select("id", "corridor", "date")


_BEARING = "degrees(atan2(sin(radians(lo2 - lo1)) * cos(radians(la2)), cos(radians(la1)) * sin(radians(la2)) - sin(radians(la1)) * cos(radians(la2)) * cos(radians(lo2 - lo1))))"


@query("R1_station_bearings", f"""{cte('stations')}, n AS (SELECT sensor_id, dir, coalesce(lag(lat) {_W}, lat) AS la1, coalesce(lag(lon) {_W}, lon) AS lo1, coalesce(lead(lat) {_W}, lat) AS la2, coalesce(lead(lon) {_W}, lon) AS lo2 FROM stations),
b AS (SELECT *, {_BEARING} + 720 AS b FROM n)
SELECT CAST(sensor_id AS BIGINT) AS sensor_id, round(CASE WHEN la1 = la2 AND lo1 = lo2 THEN CASE dir WHEN 'N' THEN 0 WHEN 'E' THEN 90 WHEN 'S' THEN 180 ELSE 270 END WHEN dir IN ('S', 'W') THEN (b + 180) % 360 ELSE b % 360 END, 3) AS bearing FROM b""")
def _(spark, d):
    return rounded(spatial.station_bearings(frame(spark, d, "stations")).select("sensor_id", "bearing"), 3)


# Routes of the demo, in 41 steps: every fourth station's leads to the next by number, the others stay near their station, which lies at
# the start or on the way. Each leg has free-flow minutes of its own.
_ENDS = {0: ("lat", "lon", "b", "l"), 1: ("lat", "lon", "lat + 4e-2", "lon + 4e-2"), 2: ("lat - 3e-2", "lon", "lat + 2e-2", "lon"), 3: ("lat", "lon", "lat + 2e-2", "lon + 1e-2")}
_AT = ["CASE sensor_id % 4 " + " ".join(f"WHEN {k} THEN {e[i]}" for k, e in _ENDS.items()) + " END" for i in range(4)]


#: Routes of the demo that a task draws and matches, about.
ROUTES_A_TASK = 1000


def _vertices(spark, d):
    st = frame(spark, d, "stations").select("sensor_id", "lat", "lon")
    ends = st.join(st.select((F.col("sensor_id") - 1).alias("sensor_id"), F.col("lat").alias("b"), F.col("lon").alias("l")), "sensor_id").selectExpr("sensor_id AS route_id", *(f"{e} AS {n}" for e, n in zip(_AT, ("a1", "o1", "a2", "o2"), strict=True)))
    # Dealt by the number of routes: the few bytes of their ends are no measure of the vertices and matches made from them.
    ends = ends.repartition(max(1, -(-st.count() // ROUTES_A_TASK)), "route_id")
    steps = ends.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(41))))
    at = spatial.along(steps.select("route_id", "seq", (F.col("a1") + (F.col("a2") - F.col("a1")) * F.col("seq") / 41).alias("lat"), (F.col("o1") + (F.col("o2") - F.col("o1")) * F.col("seq") / 41).alias("lon")))
    w = Window.partitionBy("route_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("cum_min", F.sum(F.col("leg_mi") / (25 + (F.col("route_id") * 3 + F.col("seq") * 7) % 30) * 60.0).over(w))


_VERTICES = f"""{cte('stations', 'readings')}, ends AS (SELECT sensor_id AS route_id, {', '.join(f'{e} AS {n}' for e, n in zip(_AT, ('a1', 'o1', 'a2', 'o2'), strict=True))} FROM (SELECT a.sensor_id, a.lat, a.lon, b.lat AS b, b.lon AS l FROM stations a JOIN stations b ON b.sensor_id = a.sensor_id + 1)),
v AS (SELECT route_id, i AS seq, a1 + (a2 - a1) * i / 41 AS lat, o1 + (o2 - o1) * i / 41 AS lon FROM ends, range(0, 42) t(i)),
leg AS (SELECT *, coalesce(sqrt(pow((lat - lag(lat) OVER w) * 69, 2) + pow((lon - lag(lon) OVER w) * 54.6, 2)), 0) AS leg_mi, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo, lead(lat) OVER w AS nla, lead(lon) OVER w AS nlo FROM v WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
vert AS (SELECT route_id, seq, lat, lon, sum(leg_mi) OVER (PARTITION BY route_id ORDER BY seq) AS cum_mi, sum(leg_mi / (25 + (route_id * 3 + seq * 7) % 30) * 60) OVER (PARTITION BY route_id ORDER BY seq) AS cum_min FROM leg)"""


@query("W9_cumulative_miles", f"{_VERTICES} SELECT CAST(route_id AS BIGINT) AS route_id, CAST(seq AS BIGINT) AS seq, round(cum_mi, 4) AS cum_mi FROM vert")
def _(spark, d):
    return rounded(_vertices(spark, d).select("route_id", "seq", "cum_mi"))


# In the demo all stations within half a mile of a route match it, whatever their heading.
_MATCH = f"""{_VERTICES}, near AS (SELECT route_id, sensor_id, seq, cum_mi, sqrt(pow((s.lat - vert.lat) * 69, 2) + pow((s.lon - vert.lon) * 54.6, 2)) AS off FROM vert, stations s),
m AS (SELECT *, row_number() OVER (PARTITION BY route_id, sensor_id ORDER BY off, seq) AS k FROM near WHERE off <= 0.5), matched AS (SELECT route_id, sensor_id, cum_mi AS along_mi, off AS off_mi FROM m WHERE k = 1)"""


def _matched(spark, d):
    return spatial.match_routes(_vertices(spark, d), spatial.station_bearings(frame(spark, d, "stations")), tolerance_mi=0.5, max_bearing=180.0)


def _governors(spark, d):
    """Matches of one station for each place, as any heading fits: all that spans, and the question which routes have any, depend on."""
    stations = spatial.governing(spatial.station_bearings(frame(spark, d, "stations")), max_bearing=180.0)
    return spatial.match_routes(_vertices(spark, d), stations, tolerance_mi=0.5, max_bearing=180.0)


@query("J11_match_routes", f"{_MATCH} SELECT CAST(route_id AS BIGINT) AS route_id, CAST(sensor_id AS BIGINT) AS sensor_id, round(along_mi, 4) AS along_mi, round(off_mi, 4) AS off_mi FROM matched")
def _(spark, d):
    return rounded(_matched(spark, d))


@query("J11_heading_matched", f"""{_VERTICES}, ro AS (SELECT route_id, seq, lat, lon, coalesce(nla, lat) AS la2, coalesce(nlo, lon) AS lo2, CASE WHEN nla IS NULL THEN pla ELSE lat END AS la1, CASE WHEN nla IS NULL THEN plo ELSE lon END AS lo1 FROM leg),
rh AS (SELECT route_id, seq, lat, lon, ({_BEARING} + 720) % 360 AS heading FROM ro), n AS (SELECT sensor_id, lat, lon, dir, coalesce(lag(lat) {_W}, lat) AS la1, coalesce(lag(lon) {_W}, lon) AS lo1, coalesce(lead(lat) {_W}, lat) AS la2, coalesce(lead(lon) {_W}, lon) AS lo2 FROM stations),
b AS (SELECT sensor_id, lat, lon, CASE WHEN la1 = la2 AND lo1 = lo2 THEN CASE dir WHEN 'N' THEN 0 WHEN 'E' THEN 90 WHEN 'S' THEN 180 ELSE 270 END WHEN dir IN ('S', 'W') THEN ({_BEARING} + 900) % 360 ELSE ({_BEARING} + 720) % 360 END AS bearing FROM n),
near AS (SELECT v.route_id, sensor_id, v.seq, cum_mi, sqrt(pow((b.lat - v.lat) * 69, 2) + pow((b.lon - v.lon) * 54.6, 2)) AS off, abs(heading - bearing) AS turn FROM vert v JOIN rh ON rh.route_id = v.route_id AND rh.seq = v.seq, b),
m AS (SELECT *, row_number() OVER (PARTITION BY route_id, sensor_id ORDER BY off, seq) AS k FROM near WHERE off <= 0.5 AND least(turn, 360 - turn) <= 65)
SELECT CAST(route_id AS BIGINT) AS route_id, CAST(sensor_id AS BIGINT) AS sensor_id, round(cum_mi, 4) AS along_mi, round(off, 4) AS off_mi FROM m WHERE k = 1""")
def _(spark, d):
    return rounded(spatial.match_routes(_vertices(spark, d), spatial.station_bearings(frame(spark, d, "stations")), tolerance_mi=0.5))


_SPANS = f"""{_MATCH}, routes AS (SELECT route_id, max(cum_mi) AS route_mi FROM vert GROUP BY route_id),
nx AS (SELECT m.route_id, sensor_id, along_mi AS s, coalesce(lead(along_mi) OVER (PARTITION BY m.route_id ORDER BY along_mi, sensor_id), route_mi) AS e FROM matched m JOIN routes USING (route_id)),
al AS (SELECT route_id, CASE WHEN e - s > 2.5 THEN 'surface' ELSE 'freeway' END AS kind, s, e, CASE WHEN e - s <= 2.5 THEN sensor_id END AS sensor_id FROM nx
  UNION ALL SELECT r.route_id, 'surface', 0, coalesce(f, route_mi), NULL FROM routes r LEFT JOIN (SELECT route_id, min(along_mi) AS f FROM matched GROUP BY route_id) x ON r.route_id = x.route_id WHERE f IS NULL OR f > 0.01),
spans AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY s, e, sensor_id NULLS FIRST) - 1 AS span_no FROM al WHERE e > s)"""


def _spans(spark, d):
    v = _vertices(spark, d)
    return written(routing.build_spans(_governors(spark, d), v.groupBy("route_id").agg(F.max("cum_mi").alias("route_mi"))))


@query("R3_build_spans", f"{_SPANS} SELECT CAST(route_id AS BIGINT) AS route_id, CAST(span_no AS BIGINT) AS span_no, kind, round(s, 4) AS start_mi, round(e, 4) AS end_mi, CAST(sensor_id AS BIGINT) AS sensor_id FROM spans")
def _(spark, d):
    return rounded(_spans(spark, d))


def _speeds(spark, d):
    fc = frame(spark, d, "readings").groupBy("station", fn.slot_of(F.col("tod")).alias("slot")).agg(F.round(F.avg("speed"), 3).alias("mph"), F.round(F.stddev_pop("speed"), 3).alias("sd"))
    return routing.slot_speeds(fc, sd="sd")


def _streets(spark, d, spans):
    ff = seasonal.freeflow(frame(spark, d, "readings").select("station", F.col("speed").alias("seasonal_speed")))
    return routing.street_speeds(spans, _vertices(spark, d), frame(spark, d, "stations"), _speeds(spark, d), ff)


def _routes(spark, d, spans=None):
    spans = _spans(spark, d) if spans is None else spans
    return routing.priced_spans(spans, _speeds(spark, d), _streets(spark, d, spans))


# Free-flow minutes between the ends of every span, and what the stations near its middle make of its free speed in each slot.
_STREETS = f"""{_SPANS}, fc AS (SELECT station, tod // 15 AS slot, round(avg(speed), 3) AS mph, round(stddev_pop(speed), 3) AS sd FROM readings GROUP BY 1, 2),
ff AS (SELECT station, quantile_cont(speed, 0.9) AS ff FROM readings GROUP BY station),
sp AS (SELECT route_id, span_no, kind, s, e, e - s AS miles, sensor_id FROM spans),
edge AS (SELECT route_id, span_no, 's' AS side, s AS mile FROM sp UNION ALL SELECT route_id, span_no, 'e', e FROM sp),
mk AS (SELECT n.*, max(seq) FILTER (WHERE cum_mi <= mile) AS lo, min(seq) FILTER (WHERE cum_mi >= mile) AS hi FROM edge n JOIN vert USING (route_id) GROUP BY ALL),
mn AS (SELECT mk.route_id, span_no, side, x.cum_min + CASE WHEN y.cum_mi > x.cum_mi THEN (mile - x.cum_mi) / (y.cum_mi - x.cum_mi) ELSE 0 END * (y.cum_min - x.cum_min) AS m
  FROM mk JOIN vert x ON x.route_id = mk.route_id AND x.seq = coalesce(mk.lo, mk.hi) JOIN vert y ON y.route_id = mk.route_id AND y.seq = coalesce(mk.hi, mk.lo)),
fr AS (SELECT route_id, span_no, max(m) FILTER (WHERE side = 'e') - max(m) FILTER (WHERE side = 's') AS m FROM mn GROUP BY 1, 2),
free AS (SELECT sp.*, CASE WHEN m > 0 THEN miles / m * 60 ELSE 30 END AS free FROM sp JOIN fr USING (route_id, span_no)),
pt AS (SELECT * FROM (SELECT route_id, span_no, lat, lon, row_number() OVER (PARTITION BY route_id, span_no ORDER BY CASE WHEN cum_mi >= mid THEN 0 ELSE 1 END, CASE WHEN cum_mi >= mid THEN seq ELSE -seq END) AS k
  FROM (SELECT route_id, span_no, (s + e) / 2 - 1e-9 AS mid FROM sp) JOIN vert USING (route_id)) WHERE k = 1),
kn AS (SELECT route_id, span_no, sensor_id, sqrt(pow((s.lat - pt.lat) * 69, 2) + pow((s.lon - pt.lon) * 54.6, 2)) AS dist FROM pt, stations s),
ln AS (SELECT * FROM (SELECT *, 1 / pow(greatest(dist, 0.15), 2) AS w, row_number() OVER (PARTITION BY route_id, span_no ORDER BY dist, sensor_id) AS rank FROM kn WHERE dist <= 2) WHERE rank <= 6),
st AS (SELECT route_id, span_no, slot, sum(w * least(greatest(mph / ff, 0.15), 1.05)) / sum(w) AS ratio FROM ln JOIN fc ON station = sensor_id JOIN ff USING (station) GROUP BY 1, 2, 3),
est AS (SELECT st.route_id, st.span_no, slot, greatest(free * (1 - 0.5 * (1 - ratio)), 5) AS mph FROM st JOIN free USING (route_id, span_no))"""


def _price_sql(departures: str) -> str:
    """The fold over a route's spans, one by one: minutes, freeway minutes and miles, deviation, and stations so far."""
    known = "x.kind = 'freeway' AND fc.mph > 0"
    return f"""{_STREETS.replace('WITH ', 'WITH RECURSIVE ', 1)}, dep AS (SELECT route_id, depart FROM routes, ({departures}) t(depart)),
fold AS (SELECT d.route_id, d.depart, CAST(-1 AS BIGINT) AS span_no, CAST(d.depart AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS fw, CAST(0 AS DOUBLE) AS fm, CAST(0 AS DOUBLE) AS sd, CAST(0 AS BIGINT) AS n FROM dep d
  UNION ALL SELECT f.route_id, f.depart, x.span_no, f.t + x.miles / CASE WHEN {known} THEN fc.mph ELSE coalesce(est.mph, greatest(x.free, 5)) END * 60, f.fw + CASE WHEN {known} THEN x.miles / fc.mph * 60 ELSE 0 END,
    f.fm + CASE WHEN {known} THEN x.miles ELSE 0 END, f.sd + CASE WHEN {known} THEN x.miles * 60 * coalesce(fc.sd, 0) / pow(greatest(fc.mph, 5), 2) ELSE 0 END, f.n + CASE WHEN {known} THEN 1 ELSE 0 END
  FROM fold f JOIN free x ON x.route_id = f.route_id AND x.span_no = f.span_no + 1 LEFT JOIN fc ON x.kind = 'freeway' AND fc.station = x.sensor_id AND fc.slot = least(CAST(floor(f.t / 15) AS BIGINT), 95)
  LEFT JOIN est ON est.route_id = x.route_id AND est.span_no = x.span_no AND est.slot = least(CAST(floor(f.t / 15) AS BIGINT), 95)),
mi AS (SELECT route_id, sum(miles) AS mi FROM sp GROUP BY route_id),
priced AS (SELECT f.route_id, depart, max_by(t, span_no) - depart AS total, max_by(fw, span_no) AS fw, max_by(fm, span_no) AS fm, max_by(sd, span_no) AS sd, max_by(n, span_no) AS n, max(mi) AS mi FROM fold f JOIN mi ON mi.route_id = f.route_id GROUP BY 1, 2)"""


_PRICE = _price_sql("SELECT i * 60 FROM range(6, 20) t(i)")
_ALL_DAY = _price_sql("SELECT i * 15 FROM range(0, 96) t(i)")
_PRICED = "CAST(route_id AS BIGINT) AS route_id, CAST(depart AS BIGINT) AS depart, round(total, 3) AS total_minutes, round(fw, 3) AS freeway_minutes, round(round(total - fw, 9), 3) AS surface_minutes, round(fm, 3) AS freeway_mi, round(round(mi - fm, 9), 3) AS surface_mi, n AS stations, round(round(coalesce(fw / nullif(total, 0), 0), 9), 3) AS measured_share, round(round(sd, 9), 3) AS minutes_sd"


def _settled(df, digits=3):
    """Rounded twice, so that sums in another order give the same digits."""
    return rounded(rounded(df, 9), digits)


def _hourly(routes):
    return routes.select("route_id", F.explode(F.sequence(F.lit(360), F.lit(1140), F.lit(60))).alias("depart"))


@query("R4_price_routes", f"{_PRICE} SELECT CAST(route_id AS BIGINT) AS route_id, CAST(depart AS BIGINT) AS depart, round(round(total, 9), 3) AS total_minutes, round(round(fw, 9), 3) AS freeway_minutes FROM priced")
def _(spark, d):
    routes = _routes(spark, d)
    return _settled(routing.price(routes, _hourly(routes)).select("route_id", "depart", "total_minutes", "freeway_minutes"))


@query("R6_band", f"{_ALL_DAY}, b AS (SELECT *, sd * (1 + (total - fw) / nullif(fw, 0)) AS spread FROM priced) SELECT {_PRICED}, CASE WHEN fw > 0 THEN round(round(total + 0.4 * spread, 9), 3) END AS slow_minutes, CASE WHEN fw > 0 THEN round(round(greatest(total - 0.25 * spread, 1), 9), 3) END AS fast_minutes FROM b")
def _(spark, d):
    """Each span's deviation at the slot in which it is reached, added up by the fold."""
    routes = _routes(spark, d)
    return _settled(routing.band(routing.price(routes, routing.all_day(routes))))


@query("R5_street_speeds", f"{_STREETS} SELECT CAST(route_id AS BIGINT) AS route_id, CAST(span_no AS BIGINT) AS span_no, round(round(free, 9), 3) AS free_mph, CAST(slot AS BIGINT) AS slot, round(round(mph, 9), 3) AS mph FROM est JOIN free USING (route_id, span_no)")
def _(spark, d):
    got = _streets(spark, d, _spans(spark, d)).select("route_id", "span_no", "free_mph", F.posexplode("streets").alias("slot", "mph")).where("mph is not null")
    return _settled(got)


@query("R5_priced_streets", f"{_PRICE} SELECT {_PRICED} FROM priced")
def _(spark, d):
    """Routes whose spans without a forecast slow down with the stations near them, with all parts of the price."""
    routes = _routes(spark, d)
    return _settled(routing.price(routes, _hourly(routes)))


@query("R8_arrive_by", f"{_ALL_DAY}, l AS (SELECT p.route_id, deadline, max(depart) AS depart, max_by(total, depart) AS total FROM priced p, (VALUES (540), (1080)) t(deadline) WHERE depart + total <= deadline AND depart <= deadline GROUP BY 1, 2) SELECT CAST(route_id AS BIGINT) AS route_id, CAST(deadline AS BIGINT) AS deadline, CAST(depart AS BIGINT) AS depart, round(depart + total, 3) AS arrive, round(total, 3) AS minutes, round(deadline - (depart + total), 3) AS slack_minutes FROM l")
def _(spark, d):
    routes = _routes(spark, d)
    return _settled(routing.arrive_by(routes, routes.select("route_id", F.explode(F.array(F.lit(540), F.lit(1080))).alias("deadline"))))


@query("R9_surface_minutes", f"""{_KNN.replace("WITH ways AS", cte("readings") + ", ways AS", 1)}, st AS (SELECT station, least(greatest(avg(speed) / 60, 0.15), 1.05) AS ratio FROM readings GROUP BY station),
q AS (SELECT way_id, sum(weight * ratio) / sum(weight) AS ratio FROM links JOIN st ON sensor_id = station GROUP BY way_id),
o AS (SELECT w.way_id, w.miles, coalesce(ratio, 1) AS ratio, greatest(least(35 * (1 - 0.5 * (1 - coalesce(ratio, 1))), 35), 5) AS mph FROM ways w LEFT JOIN q USING (way_id))
SELECT way_id, round(miles, 4) AS miles, round(ratio, 4) AS ratio, round(mph, 4) AS est_mph, round(miles / mph * 60, 4) AS minutes FROM o""")
def _(spark, d):
    ways = frame(spark, d, "ways").withColumn("maxspeed_mph", F.lit(35.0))
    state = frame(spark, d, "readings").groupBy("station").agg(F.avg("speed").alias("mph")).select("station", fn.flow_ratio(F.col("mph"), F.lit(60.0)).alias("ratio"))
    return rounded(routing.surface_minutes(ways, routing.way_links(ways, frame(spark, d, "stations")), state))


@query("J13_chunk_governor", f"""{cte('stations', 'ways')}, n AS (SELECT sensor_id, lat, lon, dir, coalesce(lag(lat) {_W}, lat) AS la1, coalesce(lag(lon) {_W}, lon) AS lo1, coalesce(lead(lat) {_W}, lat) AS la2, coalesce(lead(lon) {_W}, lon) AS lo2 FROM stations),
b AS (SELECT sensor_id, lat, lon, CASE WHEN la1 = la2 AND lo1 = lo2 THEN CASE dir WHEN 'N' THEN 0 WHEN 'E' THEN 90 WHEN 'S' THEN 180 ELSE 270 END WHEN dir IN ('S', 'W') THEN ({_BEARING} + 900) % 360 ELSE ({_BEARING} + 720) % 360 END AS bearing FROM n),
k AS (SELECT way_id, sensor_id, bearing, way_id * 37 % 360 AS heading, sqrt(pow((b.lat - w.lat) * 69, 2) + pow((b.lon - w.lon) * 54.6, 2)) AS dist FROM ways w, b),
r AS (SELECT *, dist <= 4 AND least(abs(heading - bearing), 360 - abs(heading - bearing)) <= 70 AS fits, row_number() OVER (PARTITION BY way_id ORDER BY dist, sensor_id) AS rank FROM k WHERE dist <= 8)
SELECT way_id AS chunk_id, CAST(min_by(sensor_id, dist) FILTER (WHERE fits) AS BIGINT) AS sensor_id, round(min(dist), 4) AS nearest_mi FROM r WHERE rank <= 14 GROUP BY way_id""")
def _(spark, d):
    chunks = frame(spark, d, "ways").select(F.col("way_id").alias("chunk_id"), "lat", "lon", F.pmod(F.col("way_id") * 37, F.lit(360)).cast("double").alias("heading"))
    return rounded(spatial.govern_chunks(chunks, spatial.station_bearings(frame(spark, d, "stations"))))


@query("J24_nearest_slot", f"{cte('series')}, p AS (SELECT DISTINCT tod AS slot FROM series WHERE tod % 60 = 0), r AS (SELECT id, slot, row_number() OVER (PARTITION BY id ORDER BY abs(slot - tod), slot) AS k FROM series, p) SELECT id, CAST(slot AS BIGINT) AS slot FROM r WHERE k = 1")
def _(spark, d):
    s = frame(spark, d, "series")
    hours = s.where(F.col("tod") % 60 == 0).select(F.col("tod").alias("slot")).distinct()
    return rounded(asof.nearest_slot(s.select("id", "tod"), hours, id_col="id", minutes="tod", slot="slot"))


@query("J22_events_on_drive", f"""{cte('venue_events', 'ways')}, e AS (SELECT event_id, start, 372e-1 + (event_id * 37 % 100) / 125.0 AS elat, -1226e-1 + (event_id * 53 % 100) / 110.0 AS elon FROM venue_events),
dr AS (SELECT way_id, lat, lon, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(way_id * 97 % 43200 AS BIGINT)) AS depart FROM ways),
m AS (SELECT way_id, event_id, sqrt(pow((elat - lat) * 69, 2) + pow((elon - lon) * 69 * cos(radians(lat)), 2)) AS miles FROM dr JOIN e ON depart + INTERVAL 1 HOUR >= start - INTERVAL 4 HOUR AND depart <= start + INTERVAL 6 HOUR),
r AS (SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY miles, event_id) AS rank FROM m WHERE miles <= 12) SELECT way_id AS drive_id, event_id, round(miles, 4) AS miles, rank FROM r WHERE rank <= 2""")
def _(spark, d):
    ev = frame(spark, d, "venue_events").select("event_id", "start", (F.lit(37.2) + (F.col("event_id") * 37 % 100) / 125.0).alias("lat"), (F.lit(-122.6) + (F.col("event_id") * 53 % 100) / 110.0).alias("lon"))
    drives = frame(spark, d, "ways").select(F.col("way_id").alias("drive_id"), "lat", "lon", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("way_id") * 97 % 43200).cast("int"))).alias("depart"))
    return rounded(asof.events_on_drive(drives.withColumn("arrive", F.col("depart") + F.make_dt_interval(F.lit(0), F.lit(1))), ev))


_HASH = "('0x' || substr(md5(concat_ws('|', '{seed}', CAST(sensor_id AS VARCHAR))), 1, 8))::BIGINT"


@query("M4_station_sample", f"""{cte('stations')}, h AS (SELECT sensor_id, {_HASH.format(seed=7)} % 1000 < 300 AS held_out, row_number() OVER (ORDER BY {_HASH.format(seed=0)}, sensor_id) AS r, count(*) OVER () AS n FROM stations)
SELECT CAST(sensor_id AS BIGINT) AS sensor_id, held_out FROM h WHERE r <= n // 2""")
def _(spark, d):
    return rounded(features.station_sample(features.spatial_holdout(frame(spark, d, "stations")), 0.5).select("sensor_id", "held_out"))


@query("M7_vocabulary", f"{cte('venue_events')} SELECT list_sort(list_distinct(list_concat(list(DISTINCT venue), ['none']))) AS vocabulary FROM venue_events")
def _(spark, d):
    return features.vocabulary([(frame(spark, d, "venue_events"), "venue")], ["none"])


@query("U7_unseen_values", f"{cte('probes', 'venue_events')} SELECT venue, count(*) AS rows FROM probes WHERE venue NOT IN (SELECT venue FROM venue_events WHERE value > 485) GROUP BY venue")
def _(spark, d):
    return features.unseen_values(frame(spark, d, "probes"), frame(spark, d, "venue_events").where("value > 485"), "venue")


@query("J4_weather", f"""{cte('series', 'probes')}, w AS (SELECT corridor AS cell, date_trunc('hour', ts) AS h, ts, id, precip FROM series), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell, h ORDER BY ts, precip NULLS FIRST) AS k FROM w) WHERE k = 1),
g AS (SELECT *, sum(precip) OVER (PARTITION BY cell ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rain FROM f)
SELECT s.id, round(g.rain, 4) AS rain, CASE WHEN g.precip IS NULL THEN 'unknown' WHEN g.precip >= 2.5 THEN 'rain_heavy' WHEN g.precip >= 0.2 THEN 'rain_light' ELSE 'dry' END AS rain_class FROM series s LEFT JOIN g ON g.cell = s.corridor AND g.h = date_trunc('hour', s.ts)""")
def _(spark, d):
    s = frame(spark, d, "series")
    weather = s.select(F.col("corridor").alias("cell"), "ts", F.col("precip").alias("precipitation"), F.lit(15.0).alias("temperature"))
    return rounded(features.attach_weather(s.select("id", "corridor", "ts"), weather, cell="corridor").select("id", "rain", "rain_class"))


def _raw_events(spark, d):
    e = frame(spark, d, "venue_events")
    timed = F.col("event_id") % 3 == 0
    return e.select(
        "venue", F.when(timed, F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("start", "yyyy-MM-dd")).alias("start"), timed.alias("has_time"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Wednesday April 27 • 07:30 PM • "), F.col("title"))).when(F.col("event_id") % 7 == 0, F.concat(F.lit("Canceled: "), F.col("title"))).when(F.col("event_id") % 11 == 0, F.lit("Season Tickets Wait List")).otherwise(F.col("title")).alias("title"),
        F.date_format(F.col("start") - F.make_dt_interval(F.lit(10)), "yyyy-MM-dd'T'HH:mm:ss").alias("captured_at"),
    )


_RAW = f"""{cte('venue_events')}, raw AS (SELECT event_id, venue, CAST(start AS DATE) AS day, strftime(start, '%Y-%m-%dT%H:%M:%S') AS stamp, event_id % 3 = 0 AS has, title, strftime(start - INTERVAL 10 DAY, '%Y-%m-%dT%H:%M:%S') AS captured_at,
  CASE WHEN event_id % 5 = 0 THEN 'embedded' WHEN event_id % 7 = 0 THEN 'cancelled' WHEN event_id % 11 = 0 THEN 'non_event' ELSE 'plain' END AS what, minute(start) % 5 = 0 AND NOT (hour(start) = 0 AND minute(start) = 0) AS plausible FROM venue_events),
cl AS (SELECT venue, day, title, captured_at, lower(replace(title, ' ', '')) AS key, what = 'embedded' AND NOT has AS recovered, has AND NOT plausible AS demoted, (has AND plausible) OR (what = 'embedded' AND NOT has) AS timed,
  CASE WHEN has AND plausible THEN stamp WHEN what = 'embedded' AND NOT has THEN strftime(day, '%Y-%m-%d') || 'T19:30:00' ELSE strftime(day, '%Y-%m-%d') END AS start FROM raw WHERE what IN ('embedded', 'plain')),
o AS (SELECT *, row_number() OVER (PARTITION BY venue, day, key ORDER BY captured_at, title, start) AS k, count(*) OVER (PARTITION BY venue, day, key) AS n, first_value(CASE WHEN timed THEN start END IGNORE NULLS) OVER (PARTITION BY venue, day, key ORDER BY captured_at, title, start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lent FROM cl),
x3 AS (SELECT venue, title, CASE WHEN NOT timed AND lent IS NOT NULL THEN lent ELSE start END AS start, timed OR lent IS NOT NULL AS has_time, captured_at, n AS observations FROM o WHERE k = 1)"""


@query("X3_normalize_events", f"{_RAW} SELECT * FROM x3")
def _(spark, d):
    return events.normalize(_raw_events(spark, d))[0]


@query("A23_normalizer_reasons", f"""{_RAW} SELECT reason, CAST(rows AS BIGINT) AS rows FROM (VALUES ('in', (SELECT count(*) FROM raw)), ('non_event', (SELECT count(*) FROM raw WHERE what = 'non_event')), ('cancelled', (SELECT count(*) FROM raw WHERE what = 'cancelled')),
('time_recovered', (SELECT count(*) FROM cl WHERE recovered)), ('time_demoted', (SELECT count(*) FROM cl WHERE demoted)), ('deduped', (SELECT sum(observations) - count(*) FROM x3)), ('out', (SELECT count(*) FROM x3))) t(reason, rows)""")
def _(spark, d):
    return events.normalize(_raw_events(spark, d))[1]


@query("J17_merge_league", f"""{_RAW}, g AS (SELECT venue, left(start, 10) AS day, min(start) AS start, min_by(title, (start, title)) AS title FROM (SELECT venue, strftime(date_trunc('hour', start), '%Y-%m-%dT%H:%M:%S') AS start, title FROM venue_events) GROUP BY 1, 2)
SELECT c.venue, c.title, CASE WHEN NOT has_time AND g.start IS NOT NULL THEN g.start ELSE c.start END AS start, has_time OR g.start IS NOT NULL AS has_time, CASE WHEN has_time THEN 'crawl' WHEN g.start IS NOT NULL THEN 'league' END AS time_source FROM x3 c LEFT JOIN g ON g.venue = c.venue AND g.day = left(c.start, 10)
UNION ALL SELECT venue, title, start, true, 'league' FROM g WHERE NOT EXISTS (SELECT 1 FROM x3 c WHERE c.venue = g.venue AND left(c.start, 10) = g.day)""")
def _(spark, d):
    clean, _ = events.normalize(_raw_events(spark, d))
    games = frame(spark, d, "venue_events").select("venue", F.date_format(F.date_trunc("HOUR", "start"), "yyyy-MM-dd'T'HH:mm:ss").alias("start"), F.col("title"))
    return events.merge_league(clean, games)


@query("X1_page_texts", r"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', chr(10), 'g') AS t FROM pages WHERE html IS NOT NULL),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', chr(10), 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' ') AS t FROM b),
d AS (SELECT page_id, list_filter(list_transform(string_split_regex(t, '\s*\n\s*'), lambda x: trim(x)), lambda x: x <> '') AS x FROM c)
SELECT page_id, CAST(unnest(range(len(x))) AS INTEGER) AS pos, unnest(x) AS token FROM d""")
def _(spark, d):
    return events.page_texts(spark.read.parquet(f"{d}/pages.parquet"))


_CALENDAR = f"""{cte('venue_events')}, e AS (SELECT *, CAST(substr(venue, 2) AS BIGINT) * 100 + day(start) AS page_id, day(start) % 2 = 0 AND event_id % 7 <> 3 AS told FROM venue_events),
n AS (SELECT page_id, count(DISTINCT CASE WHEN told THEN (start, title) END) >= 3 AS structured FROM e GROUP BY page_id),
f AS (SELECT page_id, title, CASE WHEN structured THEN strftime(start, '%Y-%m-%dT%H:%M:%S') ELSE strftime(start, '%Y-%m-%dT%H:%M:00') END AS start FROM e JOIN n USING (page_id) WHERE told OR NOT structured)
SELECT page_id, min(start) AS start, title, true AS has_time FROM f GROUP BY page_id, left(start, 16), title"""


def _calendar(spark, d):
    """A calendar page a venue and day: every entry as texts, and on even days as JSON-LD too, in which some events are away."""
    e = frame(spark, d, "venue_events").withColumns({"day": F.dayofmonth("start"), "even": F.dayofmonth("start") % 2 == 0})
    texts = F.concat(*(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in (F.date_format("start", "MMM"), F.date_format("start", "d"), F.when(F.col("event_id") % 2 == 0, F.date_format("start", ", yyyy")).otherwise(F.lit(" ")), F.col("title"), F.date_format("start", "h:mm a"), F.lit("Buy Tickets"), F.lit("Gate B"))))
    place = F.when(F.col("event_id") % 7 == 3, "Some Field, Elsewhere").when(F.col("event_id") % 2 == 0, F.concat(F.lit("Gardens "), F.col("venue")))
    fact = F.struct(F.lit("MusicEvent").alias("@type"), F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss").alias("startDate"), F.col("title").alias("name"), F.when(place.isNotNull(), F.struct(place.alias("name"))).alias("location"))
    page = (F.substring("venue", 2, 9).cast("long") * 100 + F.col("day")).alias("page_id")
    body = e.groupBy(page, "even").agg(F.array_join(F.array_sort(F.collect_list(texts)), "").alias("t"), F.to_json(F.collect_list(fact)).alias("j"))
    html = F.concat(F.lit("<html><script>var jan = 1;</script>"), F.when(F.col("even"), F.concat(F.lit('<script type="application/ld+json">'), F.col("j"), F.lit("</script>"))).otherwise(""), F.lit("<table>"), F.col("t"), F.lit("</table></html>"))
    return body.select("page_id", html.alias("html"), F.lit(2024).alias("year"), F.lit("Gardens Arena").alias("venue_name"))


@query("X1_calendar_pages", _CALENDAR)
def _(spark, d):
    return events.page_events(_calendar(spark, d))


@query("X1_archived_pages", _CALENDAR.replace("SELECT page_id, min(start)", "SELECT -page_id AS page_id, min(start)"))
def _(spark, d):
    """The whole archive: the given pages, of which none lists events, and the calendar pages under negative numbers."""
    given = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html", F.lit(2024).alias("year"), F.lit("Gardens Arena").alias("venue_name"))
    return events.page_events(given.unionByName(_calendar(spark, d).withColumn("page_id", -F.col("page_id"))))


@query("X2_folded_titles", r"SELECT doc_id, left(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]', '', 'g'), 40) AS key FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", events.folded("text").alias("key"))


@query("S11_day_payload", f"""{cte('readings')} SELECT CAST(station AS BIGINT) AS corridor, date, '[' || string_agg('{{"tod":' || tod || ',"pred":' || p || ',"typical":' || t || '}}', ',' ORDER BY tod, p, t) || ']' AS payload FROM (SELECT station, date, tod, round(pred, 1)::DOUBLE AS p, round(base, 1)::DOUBLE AS t FROM readings) GROUP BY 1, 2""")
def _(spark, d):
    return publish.day_payload(frame(spark, d, "readings").select(F.col("station").cast("bigint").alias("corridor"), "date", "tod", "pred", F.col("base").alias("typical")))


@query("T2_mergeable_profile", f"{cte('readings')} SELECT CAST(station AS BIGINT) AS station, CAST(dow AS BIGINT) AS dow, CAST(tod AS BIGINT) AS tod, count(*) AS n, round(avg(speed), 4) AS seasonal_speed, round(stddev_pop(speed), 3) AS sd FROM readings GROUP BY 1, 2, 3 HAVING count(*) >= 4")
def _(spark, d):
    r = frame(spark, d, "readings")
    cut = F.lit("1995-01-01").cast("date")
    merged = seasonal.merge_sums(seasonal.partial_sums(r.where(F.col("date") < cut)), seasonal.partial_sums(r.where(F.col("date") >= cut)))
    return rounded(seasonal.finish_sums(merged).withColumn("sd", F.round("seasonal_sd", 3)).drop("seasonal_sd"))


@query("T3_as_of", f"{cte('venue_events')}, r AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY start DESC) AS k FROM venue_events WHERE start <= TIMESTAMP '2024-01-15 00:00:00') SELECT venue, event_id FROM r WHERE k = 1")
def _(spark, d):
    return ingest.as_of(frame(spark, d, "venue_events"), ["venue"], F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), captured="start").select("venue", "event_id")


@query("T4_tumbling_windows", f"{cte('venue_events')} SELECT venue AS station, time_bucket(INTERVAL 15 MINUTE, start) AS window_start, count(*) AS n, round(avg(value), 4) AS mean FROM venue_events GROUP BY 1, 2")
def _(spark, d):
    return rounded(ingest.windowed(frame(spark, d, "venue_events").select(F.col("venue").alias("station"), F.col("start").alias("ts"), "value")))


@query("J18_uncovered_games", f"{cte('probes', 'venue_events')}, e AS (SELECT DISTINCT venue, CAST(start AS DATE) AS day FROM venue_events WHERE value > 400) SELECT row_id FROM probes p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.venue = p.venue AND e.day = CAST(p.ts AS DATE))")
def _(spark, d):
    e = frame(spark, d, "venue_events").where("value > 400").select("venue", F.to_date("start").alias("day")).distinct()
    return frame(spark, d, "probes").withColumn("day", F.to_date("ts")).join(e, ["venue", "day"], "left_anti").select("row_id")


@query("O4_top_per_day", f"{cte('venue_events')}, r AS (SELECT *, row_number() OVER (PARTITION BY CAST(start AS DATE) ORDER BY value DESC, event_id) AS k FROM venue_events) SELECT CAST(start AS DATE) AS day, event_id, k AS rank FROM r WHERE k <= 3")
def _(spark, d):
    w = Window.partitionBy("day").orderBy(F.desc("value"), "event_id")
    return rounded(frame(spark, d, "venue_events").withColumn("day", F.to_date("start")).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("day", "event_id", "rank"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
