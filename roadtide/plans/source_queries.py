"""Registered queries of readers, writers and incremental jobs, on files that Spark writes from the tables, and of remaining products."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadtide.functions import columns as fn
from roadtide.operators import asof, corridor, events, ordered, publish, routing, seasonal, spatial
from roadtide.plans.demo import cte, frame
from roadtide.plans.queries import _ALL_DAY, _CORRIDORS, _MEMBERS, _PRICE, _PROFILE, _RAW, _W, _governors, _members, _profile, _raw_events, _routes, _settled, _spans, _vertices, query, rounded
from roadtide.session import scratch_dir, written
from roadtide.sources import buckets, commits, readers
from roadtide.streaming import ingest


#: Events of a payload, on average: a day's are sent in pages, as a service does.
PAGE = 500


def _page(rows, *by):
    """Number of the page of its day that a row is on; there are as many as the table needs."""
    return F.pmod(F.xxhash64(*by), F.lit(max(1, -(-rows.count() // PAGE))))


@query("S1_positional_csv", f"{cte('readings', 'stations')} SELECT CAST(station AS BIGINT) AS station, ts, round(speed, 4) AS speed, round(pct_observed, 4)::DOUBLE AS pct_observed FROM readings JOIN stations ON station = sensor_id WHERE type IN ('ML', 'HV') AND pct_observed >= 20")
def _(spark, d):
    path = scratch_dir(spark)
    st = frame(spark, d, "stations").select(F.col("sensor_id").alias("station"), "fwy", "dir", "type", "length")
    raw = frame(spark, d, "readings").join(st, "station")
    cols = [F.date_format("ts", "MM/dd/yyyy HH:mm:ss"), "station", F.lit(4), "fwy", "dir", "type", "length", F.lit(10), "pct_observed", F.lit(100), F.lit(0.1), "speed", F.lit(1), F.lit(2)]
    raw.select(F.concat_ws(",", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols)).alias("value")).write.option("compression", "gzip").text(path)
    return rounded(readers.raw_readings(spark, path, min_pct_observed=20).select("station", "ts", F.col("avg_speed").alias("speed"), "pct_observed"))


@query("S2_station_meta", f"{cte('stations')} SELECT CAST(sensor_id AS BIGINT) AS sensor_id, CAST(fwy AS BIGINT) AS fwy, dir, round(length, 4) AS length, round(lat, 4) AS lat FROM stations")
def _(spark, d):
    path = scratch_dir(spark)
    names = {"sensor_id": "ID", "fwy": "Fwy", "dir": "Dir", "type": "Type", "abs_pm": "Abs_PM", "length": "Length", "lat": "Latitude", "lon": "Longitude", "lanes": "Lanes"}
    frame(spark, d, "stations").select(*(F.col(a).alias(b) for a, b in names.items())).write.option("sep", "\t").option("header", True).csv(path)
    return rounded(readers.station_meta(spark, path).select("sensor_id", "fwy", "dir", "length", "lat"))


@query("S3_day_partitions", f"{cte('series')} SELECT date, count(*) AS n, round(sum(minutes), 2) AS minutes FROM series WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-01-31' GROUP BY date")
def _(spark, d):
    """Days written one partition each, replaced once more, and read over a range that prunes partitions."""
    path = scratch_dir(spark)
    days = frame(spark, d, "series").select("date", "tod", "minutes")
    readers.write_days(days, path)
    readers.write_days(days.where("date = '1996-01-05'"), path)
    return readers.day_readings(spark, path, "1996-01-01", "1996-01-31").groupBy("date").agg(F.count("*").alias("n"), F.round(F.sum("minutes"), 2).alias("minutes"))


@query("S5_events_jsonl", f"{cte('venue_events')} SELECT venue, title, count(*) AS n FROM venue_events GROUP BY 1, 2")
def _(spark, d):
    path = scratch_dir(spark)
    frame(spark, d, "venue_events").select("venue", F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss").alias("start"), F.lit(True).alias("has_time"), "title").write.json(path)
    return readers.events(spark, path).groupBy("venue", "title").agg(F.count("*").alias("n"))


@query("S6_hourly_weather", f"{cte('series')}, g AS (SELECT corridor, date, tod // 60 AS h, round(coalesce(max(precip), 0), 3) AS p FROM series GROUP BY 1, 2, 3) SELECT corridor, CAST(date AS TIMESTAMP) + to_hours(CAST(h AS BIGINT)) AS ts, p AS precipitation FROM g")
def _(spark, d):
    """Each corridor and day as the JSON of parallel arrays that a weather service sends, flattened to hourly rows."""
    hourly = frame(spark, d, "series").groupBy("corridor", "date", F.floor(F.col("tod") / 60).alias("h")).agg(F.round(F.coalesce(F.max("precip"), F.lit(0.0)), 3).alias("p"))
    rows = F.array_sort(F.collect_list(F.struct(F.format_string("%sT%02d:00", F.col("date").cast("string"), F.col("h")).alias("t"), "p")))
    body = hourly.groupBy("corridor", "date").agg(rows.alias("r")).select("corridor", F.to_json(F.struct(F.struct(F.col("r.t").alias("time"), F.col("r.p").alias("precipitation")).alias("hourly"))).alias("body"))
    return readers.hourly_weather(body, keep=("corridor",)).select("corridor", "ts", "precipitation")


@query("S7_closures", f"{cte('venue_events')} SELECT CAST(start AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE event_id % 3 < 2) AS freeway, count(*) FILTER (WHERE event_id % 3 = 0) AS mainline FROM venue_events GROUP BY 1")
def _(spark, d):
    """A day's events as a nested closure snapshot, unwrapped by structure and counted by facility."""
    facility = F.when(F.col("event_id") % 3 == 0, "Mainline").when(F.col("event_id") % 3 == 1, "On Ramp").otherwise("Surface Street")
    one = F.struct(F.struct(F.struct(facility.alias("facility")).alias("closure"), "event_id").alias("lcs"))
    e = frame(spark, d, "venue_events")
    snaps = e.groupBy(F.to_date("start").alias("day"), _page(e, "event_id").alias("part")).agg(F.to_json(F.struct(F.collect_list(one).alias("data"))).alias("payload"))
    c = readers.closures(snaps)
    return publish.facility_counts(c, "day")


@query("S7_closure_shapes", f"""{cte('venue_events')} SELECT CAST(start AS DATE) AS day, CASE event_id % 3 WHEN 0 THEN 'Mainline' WHEN 1 THEN 'On Ramp' ELSE 'Surface Street' END AS facility, CASE WHEN event_id % 5 = 0 THEN NULL ELSE venue END AS place, count(*) AS n, sum(event_id) AS ids FROM venue_events GROUP BY ALL""")
def _(spark, d):
    """A day's events in snapshots of four shapes: a list, a list in an object, a list of wrapped records, and these in two objects; places are texts, objects, or missing."""
    e = frame(spark, d, "venue_events").select("event_id", "venue", F.to_date("start").alias("day"))
    facility = F.when(F.col("event_id") % 3 == 0, "Mainline").when(F.col("event_id") % 3 == 1, "On Ramp").otherwise("Surface Street")
    text = F.to_json(F.struct(F.struct(facility.alias("facility"), F.when(F.col("event_id") % 5 > 2, F.col("venue")).alias("location")).alias("closure"), "event_id"))
    named = F.to_json(F.struct(F.struct(facility.alias("facility"), F.when(F.col("event_id") % 5 > 0, F.struct(F.col("venue").alias("name"), F.lit("CA").alias("state"))).alias("location")).alias("closure"), "event_id"))
    shape = F.pmod(F.xxhash64("event_id"), F.lit(4))
    wrapped = lambda c: F.when(shape >= 2, F.concat(F.lit('{"lcs":'), c, F.lit("}"))).otherwise(c)
    one = wrapped(F.when(F.col("event_id") % 5 > 2, text).otherwise(named))
    pages = e.select("day", shape.alias("shape"), _page(e, "event_id", "day").alias("part"), one.alias("one")).groupBy("day", "shape", "part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("one"), ","), F.lit("]")).alias("l"))
    around = F.when(F.col("shape") == 1, F.concat(F.lit('{"data":'), F.col("l"), F.lit("}"))).when(F.col("shape") == 3, F.concat(F.lit('{"export":{"closures":'), F.col("l"), F.lit("}}"))).otherwise(F.col("l"))
    c = readers.closures(pages.select("day", around.alias("payload")))
    return c.groupBy("day", "facility", "place").agg(F.count("*").alias("n"), F.sum(F.try_variant_get("record", "$.event_id", "long")).alias("ids"))


@query("S16_league_games", f"{cte('venue_events')} SELECT venue, strftime(start, '%Y-%m-%dT%H:%M:%S') AS start, title FROM venue_events WHERE venue = 'v3'")
def _(spark, d):
    """Events as nested schedules, dates[].games[], of which the home games of one venue are kept."""
    game = F.struct(F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss").alias("start"), "venue", "title")
    e = frame(spark, d, "venue_events")
    days = e.groupBy(F.to_date("start").alias("day"), _page(e, "event_id").alias("part")).agg(F.collect_list(game).alias("games"))
    return events.flatten_games(days.select(F.array(F.struct("games")).alias("dates")), "V3").select("venue", "start", "title")


@query("T1_incremental_ingest", f"{cte('readings')} SELECT date_trunc('month', date)::DATE AS month, count(*) AS n FROM readings WHERE speed > 0 GROUP BY 1")
def _(spark, d):
    """Half of the rows land, then the other half; each call takes only what is new."""
    base = scratch_dir(spark)
    src = frame(spark, d, "readings").select("station", "tod", "speed", F.trunc("date", "month").alias("date"))
    odd = F.col("station") % 2 == 1
    for part in (src.where(odd), src.where(~odd)):
        part.write.mode("append").parquet(f"{base}/in")
        ingest.ingest_new_files(spark, f"{base}/in", src.schema, f"{base}/out", f"{base}/check", lambda s: s.where("speed > 0"))
    return readers.day_readings(spark, f"{base}/out").groupBy(F.col("date").alias("month")).agg(F.count("*").alias("n"))


@query("P10_title_filters", f"{cte('venue_events')} SELECT event_id, event_id % 3 = 0 AS cancelled, event_id % 3 = 1 AS non_event FROM venue_events")
def _(spark, d):
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("title"), F.lit(" - POSTPONED"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Parking for "), F.col("title"))).otherwise(F.col("title"))
    return frame(spark, d, "venue_events").select("event_id", fn.is_cancelled(t).alias("cancelled"), fn.is_non_event(t).alias("non_event"))


@query("P15_inside_horizon", f"{cte('probes')} SELECT row_id FROM probes WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'")
def _(spark, d):
    return frame(spark, d, "probes").where("ts between timestamp_ntz'2024-01-05 00:00:00' and timestamp_ntz'2024-01-12 00:00:00'").select("row_id")


@query("P17_segment_projection", _PRICE + """, seg AS (SELECT f.route_id, f.depart, f.span_no, x.kind, x.miles, x.sensor_id, f.t, f.t - p.t AS minutes, f.fm > p.fm AS known FROM fold f JOIN fold p ON p.route_id = f.route_id AND p.depart = f.depart AND p.span_no = f.span_no - 1 JOIN sp x ON x.route_id = f.route_id AND x.span_no = f.span_no)
SELECT CAST(route_id AS BIGINT) AS route_id, CAST(depart AS BIGINT) AS depart, CAST(span_no AS BIGINT) AS span_no, kind, round(miles, 3) AS miles, round(miles / minutes * 60, 3) AS mph, round(minutes, 3) AS minutes, strftime(TIMESTAMP '2026-08-01 00:00:00' + to_seconds(CAST(round(t * 60) AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS arrive,
  NOT known AS estimate, CAST(seg.sensor_id AS BIGINT) AS sensor_id, CAST(fwy AS BIGINT) AS freeway, dir AS direction, round(s.lat, 3) AS lat, round(s.lon, 3) AS lon FROM seg LEFT JOIN stations s ON s.sensor_id = seg.sensor_id""")
def _(spark, d):
    """The segments of every priced route as they are served: nulls kept, arrival as an ISO time."""
    spans = _spans(spark, d)
    routes = _routes(spark, d, spans)
    departures = routes.select("route_id", F.explode(F.sequence(F.lit(360), F.lit(1140), F.lit(60))).alias("depart"))
    st = frame(spark, d, "stations").select("sensor_id", F.col("fwy").alias("freeway"), F.col("dir").alias("direction"), "lat", "lon")
    rows = routing.segments(routes, departures).join(spans.select("route_id", "span_no", "sensor_id"), ["route_id", "span_no"]).join(st, "sensor_id", "left")
    at = F.lit("2026-08-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(F.col("arrive") * 60))
    return _settled(rows.withColumn("arrive", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")))


@query("A16_route_composition", f"""{cte('stations', 'readings')}, s AS (SELECT *, coalesce(lead(abs_pm) {_W} - abs_pm, abs_pm - lag(abs_pm) {_W}, length, 0.5) AS spacing FROM stations), m AS (SELECT concat('c', CAST(fwy AS STRING), dir) AS slug, sensor_id, spacing FROM s WHERE type = 'ML'),
t AS (SELECT slug, sum(spacing) AS total FROM m GROUP BY slug)
SELECT m.slug AS corridor, ts, round(sum(spacing / speed * 60) * max(total) / sum(spacing), 3) AS minutes, round(sum(spacing) / max(total), 4) AS coverage FROM readings JOIN m ON station = sensor_id JOIN t ON t.slug = m.slug WHERE speed > 0 AND spacing > 0 GROUP BY 1, 2""")
def _(spark, d):
    st = corridor.spacing(frame(spark, d, "stations")).where("type = 'ML'").select(F.concat(F.lit("c"), F.col("fwy").cast("string"), F.col("dir")).alias("slug"), "sensor_id", "spacing")
    live = frame(spark, d, "readings").join(st.where("spacing <= 0").select(F.col("sensor_id").alias("station")), "station", "left_anti")
    got = corridor.compose(live, st, {"minutes": "speed"})
    return got.select("corridor", "ts", F.round("minutes", 3).alias("minutes"), F.round("coverage", 4).alias("coverage"))


@query("F10_demoted_times", f"{cte('venue_events')} SELECT event_id, CASE WHEN minute(start) % 5 = 0 AND NOT (hour(start) = 0 AND minute(start) = 0) THEN strftime(start, '%Y-%m-%dT%H:%M:%S') ELSE strftime(start, '%Y-%m-%d') END AS start FROM venue_events")
def _(spark, d):
    raw = frame(spark, d, "venue_events").select("event_id", "venue", F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss").alias("start"), F.lit(True).alias("has_time"), "title", F.lit("2024").alias("captured_at"))
    return events.labelled(raw).select("event_id", "start")


@query("O5_newest_days", f"{cte('series')} SELECT DISTINCT date FROM series ORDER BY date DESC LIMIT 30")
def _(spark, d):
    return frame(spark, d, "series").select("date").distinct().orderBy(F.desc("date")).limit(30)


@query("R12_surface_links", f"""{cte('ways', 'stations', 'readings')}, known AS (SELECT DISTINCT sensor_id, lat, lon FROM stations JOIN readings ON station = sensor_id WHERE speed > 0),
k AS (SELECT way_id, sensor_id, sqrt(pow((s.lat - w.lat) * 69, 2) + pow((s.lon - w.lon) * 54.6, 2)) AS dist FROM ways w, known s), r AS (SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY dist, sensor_id) AS rank FROM k WHERE dist <= 2),
l AS (SELECT *, 1 / pow(greatest(dist, 0.15), 2) AS w FROM r WHERE rank <= 6) SELECT way_id, CAST(sensor_id AS BIGINT) AS station, round(w / sum(w) OVER (PARTITION BY way_id), 3) AS weight FROM l""")
def _(spark, d):
    live = frame(spark, d, "readings").where("speed > 0").select(F.col("station").alias("sensor_id")).distinct()
    known = frame(spark, d, "stations").join(live, "sensor_id", "left_semi")
    return routing.way_links(frame(spark, d, "ways"), known).select("way_id", F.col("station").cast("bigint").alias("station"), F.round("weight", 3).alias("weight"))


_SPACED = f"""s AS (SELECT *, coalesce(lead(abs_pm) {_W} - abs_pm, abs_pm - lag(abs_pm) {_W}, length, 0.5) AS spacing FROM stations), m AS (SELECT concat('c', CAST(fwy AS STRING), dir) AS slug, sensor_id, spacing FROM s WHERE type = 'ML'), t AS (SELECT slug, sum(spacing) AS total FROM m GROUP BY slug)"""


@query("R13_week_product", f"""{cte('stations', 'readings')}, {_SPACED}, c AS (SELECT m.slug AS corridor, ts, sum(spacing / speed * 60) * max(total) / sum(spacing) AS minutes, sum(spacing / base * 60) * max(total) / sum(spacing) AS typical, sum(spacing) / max(total) AS coverage
  FROM readings JOIN m ON station = sensor_id JOIN t ON t.slug = m.slug WHERE speed > 0 AND spacing > 0 AND date >= DATE '1996-01-08' AND date < DATE '1996-01-15' GROUP BY 1, 2)
SELECT corridor, round(max(total), 1) AS miles, round(round(avg(coverage) * 100, 9), 1) AS coverage_pct, list(strftime(ts, '%Y-%m-%dT%H:%M:%S') ORDER BY ts) AS at, list(round(round(minutes, 9), 1) ORDER BY ts) AS minutes, list(round(round(typical, 9), 1) ORDER BY ts) AS typical FROM c JOIN t ON slug = corridor GROUP BY corridor""")
def _(spark, d):
    """A week of each corridor: minutes and typical minutes by time, miles, and the share of it that its detectors cover."""
    st = corridor.spacing(frame(spark, d, "stations")).where("type = 'ML'").select(F.concat(F.lit("c"), F.col("fwy").cast("string"), F.col("dir")).alias("slug"), "sensor_id", "spacing")
    live = frame(spark, d, "readings").where("date >= '1996-01-08' and date < '1996-01-15'").join(st.where("spacing <= 0").select(F.col("sensor_id").alias("station")), "station", "left_anti")
    week = corridor.compose(live, st, {"minutes": "speed", "typical": "base"})
    return publish.week_product(week).join(st.groupBy(F.col("slug").alias("corridor")).agg(F.round(F.sum("spacing"), 1).alias("miles")), "corridor")


@query("R11_governed_chunks")
def _(spark, d):
    """Lines cut into chunks, each with the station that governs it."""
    lines = _vertices(spark, d).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p"))
    chunks = routing.chunk_line(lines.select(F.col("route_id").alias("way_id"), F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points")))
    return rounded(routing.governed_chunks(chunks, spatial.station_bearings(frame(spark, d, "stations"))))


@query("M14_event_labels", f"""{cte('probes', 'venue_events')}, h AS (SELECT p.row_id, p.ts, e.event_id, e.start, e.title, p.venue, date_sub('microsecond', e.start, p.ts) / 3600000000.0 AS h FROM probes p JOIN venue_events e ON p.venue = e.venue),
b AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN h >= 0 THEN 0 ELSE 1 END, abs(h), event_id) AS r FROM h WHERE h BETWEEN -4 AND 6)
SELECT p.row_id, CASE WHEN CAST(b.start AS DATE) = CAST(p.ts AS DATE) THEN concat(p.venue, ': ', b.title) END AS label FROM probes p LEFT JOIN b ON b.row_id = p.row_id AND b.r = 1""")
def _(spark, d):
    got = asof.nearest_event(frame(spark, d, "probes"), frame(spark, d, "venue_events"), key="venue", row_id="row_id", keep=("title", "start"))
    return got.select("row_id", F.when(F.to_date("start") == F.to_date("ts"), F.concat_ws(": ", "venue", "title")).alias("label"))


@query("O8_latest_departure", f"{_ALL_DAY}, l AS (SELECT p.route_id, deadline, max(depart) AS depart, max_by(total, depart) AS total FROM priced p, (SELECT DISTINCT route_id AS r, 1020 AS deadline FROM matched) t WHERE depart + total <= deadline AND depart <= deadline GROUP BY 1, 2) SELECT CAST(route_id AS BIGINT) AS route_id, CAST(deadline AS BIGINT) AS deadline, CAST(depart AS BIGINT) AS depart, round(depart + total, 3) AS arrive, round(total, 3) AS minutes, round(deadline - (depart + total), 3) AS slack_minutes FROM l".replace("depart <= deadline GROUP", "depart <= deadline AND r = p.route_id GROUP"))
def _(spark, d):
    routes = _routes(spark, d)
    asked = _governors(spark, d).select("route_id").distinct().withColumn("deadline", F.lit(1020))
    return _settled(routing.arrive_by(routes, asked))


@query("W7_neighbour_order", f"{cte('stations')} SELECT CAST(sensor_id AS BIGINT) AS sensor_id, CAST(coalesce(lag(sensor_id) {_W}, sensor_id) AS BIGINT) AS before, CAST(coalesce(lead(sensor_id) {_W}, sensor_id) AS BIGINT) AS after FROM stations")
def _(spark, d):
    w = Window.partitionBy("fwy", "dir").orderBy("abs_pm", "sensor_id")
    at = lambda f: F.coalesce(f("sensor_id").over(w), F.col("sensor_id"))
    return rounded(frame(spark, d, "stations").select("sensor_id", at(F.lag).alias("before"), at(F.lead).alias("after")))


@query("J25_weather_points", f"{cte('stations')}, c AS (SELECT round(floor(lat / 0.25) * 0.25 + 0.125, 3) AS lat, round(floor(lon / 0.25) * 0.25 + 0.125, 3) AS lon FROM stations) SELECT lat, lon, count(*) AS stations FROM c GROUP BY 1, 2")
def _(spark, d):
    cells = frame(spark, d, "stations").select(fn.cell_centre(F.col("lat")).alias("lat"), fn.cell_centre(F.col("lon")).alias("lon"))
    return spatial.occupied_cells(frame(spark, d, "stations")).join(cells.groupBy("lat", "lon").agg(F.count("*").alias("stations")), ["lat", "lon"])


@query("S10_profile_files", f"{cte('readings')} SELECT CAST(station AS BIGINT) AS station, count(*) AS cells FROM (SELECT station FROM readings WHERE pct_observed >= 20 GROUP BY station, dow, tod HAVING count(*) >= 4) GROUP BY station")
def _(spark, d):
    path = scratch_dir(spark)
    _profile(spark, d).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("station").cast("bigint").alias("station")).agg(F.count("*").alias("cells"))


@query("S4_file_dates", f"{cte('series')} SELECT CAST(date_trunc('month', date) AS DATE) AS date, count(*) AS n FROM series GROUP BY 1")
def _(spark, d):
    """A folder a month whose name has its first day, read as files alone: each row's date comes from the name."""
    path = scratch_dir(spark)
    s = frame(spark, d, "series").select("id", F.concat(F.lit("d07_text_"), F.date_format(F.trunc("date", "month"), "yyyy_MM_dd")).alias("day"))
    s.repartition("day").write.partitionBy("day").parquet(path)
    return readers.with_file_date(spark.read.schema("id long").option("recursiveFileLookup", True).parquet(path)).groupBy("date").agg(F.count("*").alias("n"))


@query("S15_newest_snapshot", f"{cte('stations')} SELECT CAST(sensor_id AS BIGINT) AS sensor_id, lat FROM stations WHERE sensor_id % 3 < 2")
def _(spark, d):
    """Three snapshots of the station list, of which the last by name is read."""
    path = scratch_dir(spark)
    st = frame(spark, d, "stations")
    for name, rows in (("2026_01_05", st), ("2026_03_01", st.where("sensor_id % 3 < 2")), ("2025_12_31", st.where("sensor_id < 9"))):
        rows.select("sensor_id", "lat").coalesce(1).write.parquet(f"{path}/meta_{name}")
    return spark.read.parquet(readers.newest_snapshot(spark, path)).select(F.col("sensor_id").cast("bigint").alias("sensor_id"), "lat")


@query("S12_metrics", f"{cte('readings')} SELECT CAST(station AS BIGINT) AS station, 'mae' AS metric, round(avg(abs(pred - actual)), 4) AS value, count(*) AS n FROM readings GROUP BY station")
def _(spark, d):
    path = scratch_dir(spark)
    long = frame(spark, d, "readings").groupBy("station").agg(F.lit("mae").alias("metric"), F.avg(F.abs(F.col("pred") - F.col("actual"))).alias("value"), F.count("*").alias("n"))
    readers.write_metrics(long, path)
    return rounded(readers.metrics(spark, path, long.schema))


@query("T3_append_snapshots", f"{cte('venue_events')}, r AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY start DESC, event_id DESC) AS k FROM venue_events WHERE start <= TIMESTAMP '2024-01-15 00:00:00') SELECT venue, event_id FROM r WHERE k = 1")
def _(spark, d):
    """Snapshots that land in two lots are appended by capture date, and asked for as of a time."""
    base = scratch_dir(spark)
    src = frame(spark, d, "venue_events").select("venue", "event_id", F.col("start").alias("captured_at"))
    for part in (0, 1):
        src.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        ingest.append_snapshots(spark.readStream.schema(src.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/check")
    kept = spark.read.parquet(f"{base}/out").drop("capture_date")
    return ingest.as_of(kept, ["venue"], F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("venue", "event_id")


@query("T2_accumulated_profile", f"{cte('readings')} SELECT CAST(station AS BIGINT) AS station, CAST(dow AS BIGINT) AS dow, CAST(tod AS BIGINT) AS tod, count(*) AS n, round(avg(speed), 4) AS seasonal_speed, round(stddev_pop(speed), 3) AS sd FROM readings GROUP BY 1, 2, 3 HAVING count(*) >= 4")
def _(spark, d):
    """Three lots of files, of each of which only the sums are written; two are folded into a base before the third lands."""
    base = scratch_dir(spark)
    src = frame(spark, d, "readings").select("station", "dow", "tod", "speed", "row_id")
    for part in range(3):
        if part == 2:
            ingest.compact_profile(spark, f"{base}/state")
        src.where(F.col("row_id") % 3 == part).drop("row_id").write.mode("append").parquet(f"{base}/in")
        ingest.accumulate_profile(spark, f"{base}/in", src.drop("row_id").schema, f"{base}/state", f"{base}/check")
    return rounded(seasonal.finish_sums(ingest.newest_state(spark, f"{base}/state")).withColumn("sd", F.round("seasonal_sd", 3)).drop("seasonal_sd"))


@query("T3_as_of_each", f"""{cte('probes', 'venue_events')}, v AS (SELECT venue, start, max(event_id) AS event_id FROM venue_events GROUP BY 1, 2),
w AS (SELECT *, lead(start) OVER (PARTITION BY venue ORDER BY start) AS until FROM v)
SELECT p.row_id, w.event_id, w.start AS valid_from, w.until AS valid_to FROM probes p ASOF LEFT JOIN w ON p.venue = w.venue AND p.ts >= w.start""")
def _(spark, d):
    """The version of its venue that holds at each probe's own time, whenever it was captured."""
    versions = frame(spark, d, "venue_events").select("venue", "event_id", F.col("start").alias("captured_at"))
    got = asof.as_of_each(frame(spark, d, "probes"), versions, key="venue", row_id="row_id", version_id="event_id")
    return got.select("row_id", "event_id", "valid_from", "valid_to")


@query("S9_landed_months", f"{cte('series')} SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n, round(sum(minutes), 2) AS minutes FROM series GROUP BY 1")
def _(spark, d):
    """The months before 1995 land, then all; what comes a second time for a finished month changes nothing."""
    root = scratch_dir(spark)
    src = frame(spark, d, "series").select(F.trunc("date", "month").alias("month"), "id", "minutes")
    early = F.col("month") < F.lit("1995-01-01").cast("date")
    commits.land_days(src.where(early), root, "month", ("id",))
    commits.land_days(src.withColumn("minutes", F.when(early, -1.0).otherwise(F.col("minutes"))), root, "month", ("id",))
    rows = commits.read_days(spark, root, "id long, minutes double, month date", "month")
    return rows.groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("minutes"), 2).alias("minutes"))


_DIMENSION = "dims(slug, fwy, dir, pm_min, pm_max) AS (VALUES " + ", ".join(f"('{c[0]}', {c[2]}, '{c[3]}', CAST({c[4]} AS DOUBLE), CAST({c[5]} AS DOUBLE))" for c in readers.CORRIDORS) + ")"
#: Freeway number, and postmile of the first of the demo's 40 miles, of each of its five freeways.
_FREEWAYS = {0: (80, 0), 1: (101, 385), 2: (880, 2), 3: (580, 10), 4: (237, 0)}


@query("S13_corridor_dimension", f"""{cte('stations', 'readings')}, {_DIMENSION}, fw(k, fwy2, first) AS (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in _FREEWAYS.items())}),
m AS (SELECT d.slug, s.sensor_id, coalesce(length, 0.5) AS length FROM stations s JOIN fw ON fw.k = s.fwy JOIN dims d ON d.fwy = fwy2 AND d.dir = s.dir AND abs_pm + first BETWEEN pm_min AND pm_max WHERE type = 'ML'), t AS (SELECT slug, sum(length) AS total FROM m GROUP BY slug),
c AS (SELECT m.slug AS corridor, ts, sum(length / speed * 60) * max(total) / sum(length) AS minutes FROM readings JOIN m ON station = sensor_id JOIN t ON t.slug = m.slug WHERE speed > 0 GROUP BY 1, 2)
SELECT corridor, count(*) AS n, round(round(avg(minutes), 9), 4) AS minutes FROM c GROUP BY corridor""")
def _(spark, d):
    """Corridor times of the nine corridors of the dimension, on stations that are moved to their freeways."""
    moved = spark.createDataFrame([(k, a, float(b)) for k, (a, b) in _FREEWAYS.items()], "fwy int, fwy2 int, first double")
    st = frame(spark, d, "stations").join(F.broadcast(moved), "fwy").withColumns({"fwy": F.col("fwy2"), "abs_pm": F.col("abs_pm") + F.col("first"), "length": F.coalesce("length", F.lit(0.5))})
    times = corridor.travel_time(frame(spark, d, "readings"), corridor.members(st, readers.corridor_dimension(spark)))
    return _settled(times.groupBy("corridor").agg(F.count("*").alias("n"), F.avg("minutes").alias("minutes")), 4)


@query("S14_derived_events", f"{_RAW} SELECT venue, title, start, has_time, row_number() OVER (PARTITION BY venue ORDER BY start, title) AS place FROM x3")
def _(spark, d):
    """Normalised events as a derived file set in the order of venue and start; the raw reader passes it over, the derived one keeps the order."""
    path = scratch_dir(spark)
    readers.write_events(events.normalize(_raw_events(spark, d))[0].select("venue", "start", "has_time", "title", "captured_at"), f"{path}/venues_normalized.jsonl")
    rows = readers.derived_events(spark, f"{path}/venues_normalized.jsonl")
    return rows.select("venue", "title", "start", "has_time", F.row_number().over(Window.partitionBy("venue").orderBy("at")).cast("bigint").alias("place"))


@query("O6_venue_start_order", f"{cte('venue_events')} SELECT event_id, row_number() OVER (ORDER BY venue, start, event_id) AS place FROM venue_events")
def _(spark, d):
    """The place of every event in one order of venue and start, over ranges."""
    return ordered.ranked(frame(spark, d, "venue_events"), [], ["venue", "start", "event_id"]).select("event_id", (F.col("rank") + 1).alias("place"))


#: Buckets of the demo's facts.
BUCKETS = 16


@query("J1_bucketed_seasonal", f"{cte('readings')}, {_PROFILE} SELECT row_id, round(speed - seasonal_speed, 4) AS residual FROM readings JOIN profile USING (station, dow, tod)")
def _(spark, d):
    """Readings in buckets of the profile's keys: the profile is grouped, and joined back, without an exchange."""
    keys = ["station", "dow", "tod"]
    facts = buckets.bucketed(frame(spark, d, "readings"), keys, BUCKETS)
    profile = buckets.bucketed(seasonal.profile(facts, only_current=False).drop("n"), keys, BUCKETS)
    return rounded(facts.join(profile.hint("merge"), keys).select("row_id", (F.col("speed") - F.col("seasonal_speed")).alias("residual")))


@query("J3_bucketed_semi_join", f"{cte('readings', 'stations')} SELECT row_id, round(speed, 4) AS speed FROM readings WHERE station IN (SELECT sensor_id FROM stations WHERE type IN ('ML', 'HV') AND fwy = 1)")
def _(spark, d):
    """Readings and stations in buckets of the station: the semi join needs no exchange."""
    facts = buckets.bucketed(frame(spark, d, "readings"), ["station"], BUCKETS)
    kept = frame(spark, d, "stations").where("type in ('ML', 'HV') and fwy = 1").select(F.col("sensor_id").alias("station"))
    return rounded(facts.join(buckets.bucketed(kept, ["station"], BUCKETS).hint("merge"), "station", "left_semi").select("row_id", "speed"))


#: Borders of the three lots in which the readings of T4 land.
_LOTS = ("1994-06-01", "1996-06-01")
_LIVE = f"""{cte('stations', 'readings')}, {_CORRIDORS}, {_MEMBERS}, total AS (SELECT slug, sum(length) AS total_mi FROM members GROUP BY slug),
lots AS (SELECT station, ts, speed, CASE WHEN ts >= TIMESTAMP '{_LOTS[1]} 00:00:00' THEN 3 WHEN row_id % 10 = 3 THEN 3 WHEN ts >= TIMESTAMP '{_LOTS[0]} 00:00:00' THEN 2 ELSE 1 END AS lot FROM readings WHERE speed > 0),
mark AS (SELECT lot, max(max(ts)) OVER (ORDER BY lot) - INTERVAL 30 MINUTE AS mark FROM lots GROUP BY lot),
kept AS (SELECT l.*, time_bucket(INTERVAL 15 MINUTE, ts) AS w FROM lots l LEFT JOIN mark m ON m.lot = l.lot - 1 WHERE m.mark IS NULL OR time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE > m.mark),
means AS (SELECT station, w, avg(speed) AS mph FROM kept WHERE w + INTERVAL 15 MINUTE <= (SELECT max(mark) FROM mark) GROUP BY 1, 2)
SELECT m.slug AS corridor, w AS window_start, round(round(sum(length / mph * 60), 9), 4) AS raw_minutes, count(*) AS n_stations, round(round(sum(length) / max(total_mi), 9), 4) AS coverage, round(round(sum(length / mph * 60) * max(total_mi) / sum(length), 9), 4) AS minutes
FROM means JOIN members m ON m.sensor_id = station JOIN total t ON t.slug = m.slug GROUP BY 1, 2"""


@query("T4_live_corridors", _LIVE)
def _(spark, d):
    """Readings land in three lots, each followed by a call; a tenth of the older ones come with the last, when most of their windows are over."""
    base = scratch_dir(spark)
    r = frame(spark, d, "readings").select("row_id", "station", F.col("ts").cast("timestamp").alias("ts"), "speed")
    border = [F.lit(x).cast("timestamp") for x in _LOTS]
    lot = F.when(F.col("ts") >= border[1], 3).when(F.col("row_id") % 10 == 3, 3).when(F.col("ts") >= border[0], 2).otherwise(1)
    members = written(_members(spark, d))
    for i in (1, 2, 3):
        r.where(lot == i).drop("row_id").write.mode("append").parquet(f"{base}/in")
        ingest.live_corridors(spark, f"{base}/in", "station int, ts timestamp, speed double", members, f"{base}/out", f"{base}/check")
    return _settled(spark.read.parquet(f"{base}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), 4)
