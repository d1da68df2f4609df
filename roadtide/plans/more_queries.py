"""Further registered queries: single functions, small operators, the model and route products."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadtide.functions import columns as fn
from roadtide.operators import corridor, evaluate, features, geometry, ordered, quantiles, routing, seasonal
from roadtide.plans.demo import cte, frame
from roadtide.plans.queries import _ALL_DAY, _HASH, _PRICED, _PROFILE, _ROLLED, _SPANS, _VERTICES, _governors, _members, _profile, _rolled, _routes, _settled, _spans, _vertices, query, rounded


@query("P2_positive_speed", f"{cte('readings')} SELECT row_id, round(speed, 4) AS speed FROM readings WHERE speed > 0")
def _(spark, d):
    return rounded(frame(spark, d, "readings").where("speed > 0").select("row_id", "speed"))


@query("P7_narrow_types", f"{cte('readings')} SELECT row_id, CAST(least(greatest(coalesce(pct_observed, 0), 0), 100) AS BIGINT) AS pct_observed, round(CAST(speed AS FLOAT), 3)::DOUBLE AS speed FROM readings")
def _(spark, d):
    clipped = F.least(F.greatest(F.coalesce("pct_observed", F.lit(0)), F.lit(0)), F.lit(100)).cast("tinyint")
    return frame(spark, d, "readings").select("row_id", clipped.cast("bigint").alias("pct_observed"), F.round(F.col("speed").cast("float").cast("double"), 3).alias("speed"))


@query("P12_inside_horizon", f"{cte('venue_events', 'probes')} SELECT event_id FROM venue_events WHERE start BETWEEN (SELECT min(ts) FROM probes) AND (SELECT max(ts) FROM probes)")
def _(spark, d):
    ends = frame(spark, d, "probes").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return frame(spark, d, "venue_events").join(F.broadcast(ends), F.col("start").between(F.col("a"), F.col("b"))).select("event_id")


@query("P13_hourly_thinning", f"{cte('series')} SELECT corridor, date, CAST(tod AS BIGINT) AS tod, round(minutes, 4) AS minutes, id FROM series WHERE tod % 60 = 0")
def _(spark, d):
    """The hourly rows of the 15-minute table: the operator thins times of day for publication."""
    return rounded(frame(spark, d, "series").where("minute(ts) = 0").select("corridor", "date", "tod", "minutes", "id"))


@query("F4_event_start", f"{cte('venue_events')} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(start, '%Y-%m-%d') || 'T19:00:00' ELSE strftime(start, '%Y-%m-%dT%H:%M:%S') END AS start FROM venue_events")
def _(spark, d):
    told = F.when(F.col("event_id") % 2 == 0, F.date_format("start", "yyyy-MM-dd")).otherwise(F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss"))
    return frame(spark, d, "venue_events").select("event_id", fn.event_start(told).alias("start"))


@query("F5_embedded_time", f"{cte('venue_events')} SELECT event_id, title AS bare, lpad(CAST((event_id % 12 + 1) % 12 + 12 AS STRING), 2, '0') || ':30' AS at FROM venue_events")
def _(spark, d):
    titled = F.concat(F.lit("Friday May 3 • "), (F.col("event_id") % 12 + 1).cast("string"), F.lit(":30 PM • Arena - "), F.col("title"))
    return frame(spark, d, "venue_events").select("event_id", fn.bare_title(titled).alias("bare"), fn.embedded_time(titled).alias("at"))


@query("F8_clean_title", f"{cte('venue_events')} SELECT event_id, CASE event_id % 4 WHEN 2 THEN title || ' - Aug' WHEN 3 THEN title || ' 21' ELSE title END AS title FROM venue_events")
def _(spark, d):
    """Dates at either end go; a month without a day and a number without a month stay."""
    t = F.col("title")
    wrapped = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("/ 2026 - "), t, F.lit(" - Aug 21 - Aug 22"))).when(F.col("event_id") % 4 == 1, F.concat(t, F.lit(" – September 3"))).when(F.col("event_id") % 4 == 2, F.concat(t, F.lit(" - Aug"))).otherwise(F.concat(t, F.lit(" 21")))
    return frame(spark, d, "venue_events").select("event_id", fn.clean_title(wrapped).alias("title"))


@query("F9_local_time", f"""{cte('venue_events')}, e AS (SELECT event_id, start + to_days(CAST(event_id % 12 * 30 AS INTEGER)) AS s FROM venue_events), z AS (SELECT *, CASE event_id % 4 WHEN 1 THEN s - INTERVAL 2 HOUR WHEN 2 THEN s + INTERVAL 450 MINUTE ELSE s END AS utc FROM e)
SELECT event_id, strftime(CASE WHEN event_id % 4 = 3 THEN s WHEN utc >= TIMESTAMP '2024-03-10 10:00:00' AND utc < TIMESTAMP '2024-11-03 09:00:00' THEN utc - INTERVAL 7 HOUR ELSE utc - INTERVAL 8 HOUR END, '%Y-%m-%dT%H:%M:%S') AS local FROM z""")
def _(spark, d):
    """All months, so summer time too; stamps in UTC, with offsets of either form, and without one."""
    s = F.col("start") + F.make_dt_interval((F.col("event_id") % 12 * 30).cast("int"))
    zone = F.when(F.col("event_id") % 4 == 0, "Z").when(F.col("event_id") % 4 == 1, "+02:00").when(F.col("event_id") % 4 == 2, "-0730").otherwise("")
    return frame(spark, d, "venue_events").select("event_id", fn.to_local(F.concat(F.date_format(s, "yyyy-MM-dd'T'HH:mm:ss"), zone)).alias("local"))


@query("F13_angle_between", f"{cte('stations')} SELECT CAST(sensor_id AS BIGINT) AS sensor_id, round(least(abs(a - b) % 360, 360 - abs(a - b) % 360), 4) AS angle FROM (SELECT sensor_id, CAST(sensor_id * 53 % 360 AS DOUBLE) AS a, CAST(sensor_id * 131 % 360 AS DOUBLE) AS b FROM stations)")
def _(spark, d):
    a, b = (F.pmod(F.col("sensor_id") * k, F.lit(360)).cast("double") for k in (53, 131))
    return rounded(frame(spark, d, "stations").select("sensor_id", fn.angle_between(a, b).alias("angle")))


@query("F21_delta_class", f"{cte('readings')} SELECT row_id, CASE WHEN pred - base > 0.5 THEN 'up' WHEN pred - base < -0.5 THEN 'down' ELSE 'same' END AS delta FROM readings")
def _(spark, d):
    return frame(spark, d, "readings").select("row_id", fn.delta_class(F.col("pred") - F.col("base")).alias("delta"))


@query("F23_line_length", f"{cte('ways')}, p AS (SELECT way_id, lat, lon, lat + miles / 100 AS lat2, lon - miles / 100 AS lon2 FROM ways) SELECT way_id, round(2 * sqrt(pow((lat2 - lat) * 69, 2) + pow((lon2 - lon) * 54.6, 2)), 4) AS miles FROM p")
def _(spark, d):
    a = F.struct("lat", "lon")
    b = F.struct((F.col("lat") + F.col("miles") / 100).alias("lat"), (F.col("lon") - F.col("miles") / 100).alias("lon"))
    return rounded(frame(spark, d, "ways").select("way_id", fn.line_length(F.array(a, b, a)).alias("miles")))


@query("F25_slot_floor", f"{cte('venue_events')} SELECT event_id, time_bucket(INTERVAL 15 MINUTE, start) AS slot FROM venue_events")
def _(spark, d):
    return frame(spark, d, "venue_events").select("event_id", fn.slot_floor(F.col("start")).alias("slot"))


@query("F28_coordinate_key", f"{cte('ways')} SELECT way_id, concat(round(lat, 2), ',', round(lon, 2)) AS key FROM ways")
def _(spark, d):
    return frame(spark, d, "ways").select("way_id", fn.coordinate_key(F.col("lat"), F.col("lon")).alias("key"))


@query("F31_slot_length", f"{cte('series')}, t AS (SELECT DISTINCT corridor, tod FROM series), g AS (SELECT corridor, lead(tod) OVER (PARTITION BY corridor ORDER BY tod) - tod AS gap FROM t) SELECT corridor, CAST(coalesce(min(gap), 15) AS BIGINT) AS slot FROM g GROUP BY corridor")
def _(spark, d):
    w = Window.partitionBy("corridor").orderBy("tod")
    gaps = frame(spark, d, "series").select("corridor", "tod").distinct().withColumn("gap", F.lead("tod").over(w) - F.col("tod"))
    return rounded(gaps.groupBy("corridor").agg(F.coalesce(F.min("gap"), F.lit(15)).alias("slot")))


@query("A5_median_before", f"{cte('series')} SELECT corridor, round(quantile_cont(minutes, 0.5), 4) AS overall FROM series WHERE date < DATE '1996-01-01' GROUP BY corridor")
def _(spark, d):
    return rounded(quantiles.group_quantiles(frame(spark, d, "series").where("date < '1996-01-01'"), ["corridor"], F.col("minutes"), {"overall": 0.5}).drop("n"))


@query("A9_events_per_day", f"{cte('probes', 'venue_events')}, n AS (SELECT venue, CAST(start AS DATE) AS day, count(*) AS events FROM venue_events WHERE value > 300 GROUP BY 1, 2) SELECT row_id, coalesce(events, 0) AS events FROM probes p LEFT JOIN n ON n.venue = p.venue AND n.day = CAST(p.ts AS DATE)")
def _(spark, d):
    n = frame(spark, d, "venue_events").where("value > 300").groupBy("venue", F.to_date("start").alias("day")).agg(F.count("*").alias("events"))
    return frame(spark, d, "probes").withColumn("day", F.to_date("ts")).join(n, ["venue", "day"], "left").select("row_id", F.coalesce("events", F.lit(0)).alias("events"))


@query("A10_weighted_ratio", f"{cte('readings')} SELECT CAST(station AS BIGINT) AS station, round(sum(pct_observed * speed / 60) / sum(pct_observed), 4) AS ratio FROM readings GROUP BY station")
def _(spark, d):
    return rounded(frame(spark, d, "readings").groupBy("station").agg(F.try_divide(F.sum(F.col("pct_observed") * F.col("speed") / 60.0), F.sum("pct_observed")).alias("ratio")))


@query("A14_worst_share", f"{cte('readings')}, e AS (SELECT abs(base - actual) AS err FROM readings) SELECT count(*) FILTER (WHERE err > (SELECT quantile_cont(err, 0.95) FROM e)) AS worst, count(*) AS n FROM e")
def _(spark, d):
    return evaluate.worst(frame(spark, d, "readings"), "actual", "base").agg(F.count_if("is_worst").alias("worst"), F.count("*").alias("n"))


@query("A15_weighted_overall", f"{cte('readings')}, g AS (SELECT station, count(*) AS n, avg(abs(pred - actual)) AS mae FROM readings GROUP BY station) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(mae * n) / sum(n), 4) AS mae FROM g")
def _(spark, d):
    per = frame(spark, d, "readings").groupBy("station").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pred") - F.col("actual"))).alias("mae"))
    return rounded(evaluate.weighted_overall(per, ["mae"]))


@query("A28_touched_share", f"{cte('probes', 'venue_events')}, t AS (SELECT p.row_id, p.venue, max(CASE WHEN e.event_id IS NULL THEN 0 ELSE 1 END) AS hit FROM probes p LEFT JOIN venue_events e ON e.venue = p.venue AND date_sub('microsecond', e.start, p.ts) / 3600000000.0 BETWEEN -4 AND 6 GROUP BY 1, 2) SELECT venue, CAST(sum(hit) AS BIGINT) AS touched, count(*) AS rows FROM t GROUP BY venue")
def _(spark, d):
    from roadtide.operators import asof

    got = asof.nearest_event(frame(spark, d, "probes"), frame(spark, d, "venue_events"), key="venue", row_id="row_id")
    return got.groupBy("venue").agg(F.count("event_id").alias("touched"), F.count("*").alias("rows"))


@query("W4_latest_rows", f"{cte('series')}, r AS (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY ts DESC, id DESC) AS k FROM series) SELECT corridor, id FROM r WHERE k <= 8")
def _(spark, d):
    w = Window.partitionBy("corridor").orderBy(F.desc("ts"), F.desc("id"))
    return frame(spark, d, "series").withColumn("k", F.row_number().over(w)).where("k <= 8").select("corridor", "id")


@query("O7_even_snapshots", f"{cte('venue_events')}, r AS (SELECT venue, event_id, ntile(12) OVER (PARTITION BY venue ORDER BY start, event_id) AS part, start FROM venue_events) SELECT venue, CAST(part AS BIGINT) AS part, min_by(event_id, start) AS event_id FROM r GROUP BY 1, 2")
def _(spark, d):
    rows = ordered.ranked(frame(spark, d, "venue_events"), ["venue"], ["start", "event_id"])
    parts = rows.withColumn("part", ordered.ntile(F.col("rank"), F.col("size"), 12))
    return rounded(parts.groupBy("venue", "part").agg(F.min_by("event_id", "start").alias("event_id")))


@query("U3_union_vocabulary", f"{cte('series', 'probes')} SELECT v, count(*) AS n FROM (SELECT corridor AS v FROM series UNION ALL SELECT venue FROM probes) GROUP BY v")
def _(spark, d):
    both = frame(spark, d, "series").select(F.col("corridor").alias("v")).unionAll(frame(spark, d, "probes").select(F.col("venue").alias("v")))
    return both.groupBy("v").agg(F.count("*").alias("n"))


@query("U5_pending_days", f"{cte('readings', 'series')} SELECT DISTINCT date FROM readings WHERE date NOT IN (SELECT date FROM series)")
def _(spark, d):
    from roadtide.sources.readers import pending_days

    return pending_days(frame(spark, d, "readings"), frame(spark, d, "series"))


@query("U6_word_overlap", "SELECT doc_id, len(list_intersect(string_split(lower(text), ' '), ['the', 'and', 'der', 'que'])) > 0 AS overlaps FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.arrays_overlap(F.split(F.lower("text"), " "), F.array(*map(F.lit, ("the", "and", "der", "que")))).alias("overlaps"))


@query("M1_seasonal_features", f"""{cte('series')}, {_ROLLED}, y AS (SELECT corridor, date + 1 AS date, avg(minutes - seasonal_median) AS yesterday FROM rolled GROUP BY 1, 2)
SELECT r.id, round(seasonal_median, 4) AS seasonal_median, round(seasonal_sd, 4) AS seasonal_sd, round(yesterday, 4) AS yesterday, CAST(month(r.date) AS BIGINT) AS month, isodow(r.date) >= 6 AS is_weekend, r.tod BETWEEN 420 AND 595 OR r.tod BETWEEN 900 AND 1135 AS peak
FROM rolled r LEFT JOIN y ON r.corridor = y.corridor AND r.date = CAST(y.date AS DATE)""")
def _(spark, d):
    f = seasonal.yesterday_residual(_rolled(spark, d))
    return rounded(f.select("id", "seasonal_median", "seasonal_sd", "yesterday", F.month("date").alias("month"), (F.weekday("date") >= 5).alias("is_weekend"), fn.is_peak(F.col("tod")).alias("peak")))


@query("M2_station_features", f"""{cte('readings', 'stations')}, {_PROFILE}
SELECT row_id, round(seasonal_speed, 4) AS seasonal_speed, round(seasonal_sd, 4) AS seasonal_sd, CAST(lanes AS BIGINT) AS lanes, CAST(fwy AS STRING) AS fwy, dir, CAST(month(date) AS BIGINT) AS month FROM readings r JOIN profile p USING (station, dow, tod) JOIN stations s ON s.sensor_id = r.station""")
def _(spark, d):
    st = frame(spark, d, "stations").withColumnRenamed("sensor_id", "station")
    rows = frame(spark, d, "readings").join(_profile(spark, d), ["station", "dow", "tod"]).join(st, "station")
    return rounded(rows.select("row_id", "seasonal_speed", "seasonal_sd", "lanes", F.col("fwy").cast("string").alias("fwy"), "dir", F.month("date").alias("month")))


@query("R14_simplified_lines")
def _(spark, d):
    lines = _vertices(spark, d).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p"))
    bent = F.transform("p", lambda x: F.struct((x["lat"] + F.sin(x["seq"] * 1.0) / 2000).alias("lat"), x["lon"].alias("lon")))
    return geometry.simplify(lines.select(F.col("route_id").alias("way_id"), bent.alias("points"))).select("way_id", F.size("points").alias("points"))


@query("W11_chunks", f"""{_VERTICES.replace('WITH ', 'WITH RECURSIVE ', 1)}, f AS (SELECT route_id, seq, CAST(0 AS DOUBLE) AS mi, 0 AS chunk, CAST(0 AS DOUBLE) AS leg, -1 AS own FROM leg WHERE seq = 0
  UNION ALL SELECT l.route_id, l.seq, CASE WHEN f.mi + leg_mi >= 0.4 THEN 0 ELSE f.mi + leg_mi END, CASE WHEN f.mi + leg_mi >= 0.4 THEN chunk + 1 ELSE chunk END, leg_mi, chunk FROM f JOIN leg l ON l.route_id = f.route_id AND l.seq = f.seq + 1)
SELECT CAST(route_id AS BIGINT) AS way_id, CAST(own AS BIGINT) AS chunk_no, round(round(sum(leg), 9), 4) AS miles FROM f WHERE own >= 0 GROUP BY 1, 2""")
def _(spark, d):
    lines = _vertices(spark, d).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p"))
    chunks = routing.chunk_line(lines.select(F.col("route_id").alias("way_id"), F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points")))
    return _settled(chunks.select("way_id", "chunk_no", fn.line_length(F.col("points")).alias("miles")), 4)


@query("R7_all_day_profile", f"{_ALL_DAY} SELECT {_PRICED} FROM priced")
def _(spark, d):
    routes = _routes(spark, d)
    return _settled(routing.price(routes, routing.all_day(routes)))


@query("F24_minutes_at_mile", f"""{_SPANS}, marks AS (SELECT route_id, seq, cum_mi, cum_mi * 2 + seq * 0.1 AS minutes FROM vert), a AS (SELECT route_id, span_no, (s + e) / 2 AS mile FROM spans),
b AS (SELECT a.*, max(m.seq) FILTER (WHERE cum_mi <= mile) AS lo, min(m.seq) FILTER (WHERE cum_mi >= mile) AS hi FROM a JOIN marks m USING (route_id) GROUP BY ALL)
SELECT CAST(b.route_id AS BIGINT) AS route_id, CAST(span_no AS BIGINT) AS span_no, round(round(x.minutes + CASE WHEN y.cum_mi > x.cum_mi THEN (mile - x.cum_mi) / (y.cum_mi - x.cum_mi) ELSE 0 END * (y.minutes - x.minutes), 9), 4) AS minutes
FROM b JOIN marks x ON x.route_id = b.route_id AND x.seq = b.lo JOIN marks y ON y.route_id = b.route_id AND y.seq = b.hi""")
def _(spark, d):
    """Minutes at the middle of every span, between the marks of the route's vertices."""
    marks = _vertices(spark, d).select("route_id", F.col("cum_mi").alias("mile"), (F.col("cum_mi") * 2 + F.col("seq") * 0.1).alias("minutes"))
    asked = _spans(spark, d).select("route_id", "span_no", ((F.col("start_mi") + F.col("end_mi")) / 2).alias("mile"))
    return _settled(routing.minutes_at(asked, marks).select("route_id", "span_no", "minutes"), 4)


@query("A26_route_coverage", f"{_ALL_DAY} SELECT CAST(route_id AS BIGINT) AS route_id, round(round(avg(coalesce(fw / nullif(total, 0), 0)), 9), 3) AS measured_share, max(n) AS stations, round(avg(total), 3) AS minutes FROM priced WHERE route_id IN (SELECT route_id FROM matched) GROUP BY route_id")
def _(spark, d):
    priced = routing.price(_routes(spark, d), routing.all_day(_governors(spark, d).select("route_id").distinct()))
    return _settled(priced.groupBy("route_id").agg(F.avg("measured_share").alias("measured_share"), F.max("stations").alias("stations"), F.avg("total_minutes").alias("minutes")))


@query("M3_spatial_holdout", f"{cte('readings', 'stations')}, h AS (SELECT sensor_id, {_HASH.format(seed=7)} % 1000 < 300 AS held_out FROM stations) SELECT held_out, count(*) AS rows, count(DISTINCT station) AS stations FROM readings JOIN h ON station = sensor_id GROUP BY 1")
def _(spark, d):
    held = features.spatial_holdout(frame(spark, d, "stations")).withColumnRenamed("sensor_id", "station")
    return frame(spark, d, "readings").join(held, "station").groupBy("held_out").agg(F.count("*").alias("rows"), F.count_distinct("station").alias("stations"))
