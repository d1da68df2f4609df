"""Hand-worked cases and invariants."""

import datetime as dt
import itertools
import json
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadtide.functions import columns as fn
from roadtide.operators import asof, corridor, evaluate, events, features, model, ordered, quantiles, routing, seasonal, spatial
from roadtide.sources import buckets, commits, readers
from roadtide.streaming import ingest
from tests.conftest import TESTDATA
from tests.oracle import oracle_rows, rows_of


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("title", "bare", "time"),
    [
        ("Wednesday April 27 • 07:00 PM • Chase Center - Game 5", "Game 5", "19:00"),
        ("Saturday May 06 - Chase Center - X", "Chase Center - X", None),
        ("Plain", "Plain", None),
    ],
)
def test_embedded_time(spark, title, bare, time):
    assert (value(spark, fn.bare_title(F.lit(title))), value(spark, fn.embedded_time(F.lit(title)))) == (bare, time)


def test_titles(spark):
    assert value(spark, fn.clean_title(F.lit("Karol G - Tour - Aug 21"))) == "Karol G - Tour"
    assert value(spark, fn.clean_title(F.lit("/ 2026 - Oakland Roots"))) == "Oakland Roots"
    assert value(spark, fn.dedupe_key(F.lit("Stanford vs. Hawai'i"))) == "stanfordvshawaii"
    df = spark.createDataFrame([("Hawai'i É",), (None,)], "t string")
    assert [r.k for r in df.select(events.folded("t").alias("k")).collect()] == ["hawaiie", None]
    for title, kind in (("49ers vs Rams", "nfl"), ("Sharks Night", "hockey"), ("Some Band", "concert"), (None, "concert")):
        assert value(spark, fn.event_type(F.lit(title).cast("string"))) == kind
    assert value(spark, fn.is_non_event(F.lit("Season Tickets Wait List"))) and value(spark, fn.is_cancelled(F.lit("Band POSTPONED")))


@pytest.mark.parametrize(("stamp", "local"), [("2025-07-08T01:45:00Z", "2025-07-07T18:45:00"), ("2025-07-08T01:45:00.250-07:00", "2025-07-08T01:45:00"), ("2025-07-08", "2025-07-08"), ("2025-07-08T10:00:00", "2025-07-08T10:00:00")])
def test_to_local(spark, stamp, local):
    assert value(spark, fn.to_local(F.lit(stamp))) == local


def test_speeds(spark):
    assert value(spark, fn.pace(F.lit(20.0))) == 3.0 and value(spark, fn.pace(F.lit(100.0))) == 0.75
    assert value(spark, fn.flow_ratio(F.lit(3.0), F.lit(60.0))) == 0.15
    assert value(spark, fn.surface_mph(F.lit(0.6), F.lit(35.0))) == pytest.approx(28)
    assert value(spark, fn.maxspeed_mph(F.lit("35 mph"), F.lit("primary"))) == 35 and value(spark, fn.maxspeed_mph(F.lit("50"), F.lit("primary"))) == pytest.approx(31.06855)
    assert value(spark, fn.maxspeed_mph(F.lit(None).cast("string"), F.lit("primary"))) == 35
    assert value(spark, fn.angle_between(F.lit(350.0), F.lit(10.0))) == 20
    for ratio, level in ((0.95, 1), (0.84, 3), (0.49, 5)):
        assert value(spark, fn.service_level(F.lit(ratio))) == level
    for mm, kind in ((None, "unknown"), (0.19, "dry"), (0.2, "rain_light"), (2.5, "rain_heavy")):
        assert value(spark, fn.rain_class(F.lit(mm).cast("double"))) == kind


def test_travel_time_is_scaled_by_coverage(spark):
    t = dt.datetime(2024, 1, 1)
    readings = spark.createDataFrame([(1, t, 60.0, 50)], "station int, ts timestamp_ntz, speed double, pct_observed int")
    members = spark.createDataFrame([("c", 1, 1.0), ("c", 2, 1.0)], "slug string, sensor_id int, length double")
    r = corridor.travel_time(readings, members).first()
    assert (r.raw_minutes, r.coverage, r.minutes, r.n_stations) == (1.0, 0.5, 2.0, 1)


def test_rolling_is_causal(spark):
    rows = [(1, i, float(10 + i)) for i in range(6)]
    roll = lambda rs: {r.t: (r.seasonal_median, r.prev_value) for r in seasonal.causal_rolling(spark.createDataFrame(rs, "k int, t int, v double"), "v", ["k"], ["t"]).collect()}
    before = roll(rows)
    assert [before[i][0] for i in range(4)] == [None, None, None, 11.0]
    after = roll([(k, t, v if t < 4 else 999.0) for k, t, v in rows])
    assert all(before[i] == after[i] for i in range(5))


def test_profile_uses_population_deviation(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, day, 0, 0, s, 50) for s in (60.0, 60.0, 50.0, 50.0)] + [(1, day, 0, 5, s, 50) for s in (60.0, 60.0, 50.0)]
    r = seasonal.profile(spark.createDataFrame(rows, "station int, date date, dow int, tod int, speed double, pct_observed int")).collect()
    assert [(x.tod, x.seasonal_speed, round(x.seasonal_sd, 9)) for x in r] == [(0, 55.0, 5.0)]


@pytest.mark.parametrize(("at", "hours"), [("14:59", None), ("15:00", -4.0), ("18:55", -0.0833), ("19:00", 0.0)])
def test_nearest_event(spark, at, hours):
    df = spark.createDataFrame([(1, "v", dt.datetime.fromisoformat(f"2024-01-01T{at}:00"))], "row_id int, venue string, ts timestamp_ntz")
    e = spark.createDataFrame([(7, "v", dt.datetime(2024, 1, 1, 19))], "event_id int, venue string, start timestamp_ntz")
    got = asof.nearest_event(df, e, key="venue", row_id="row_id").first().hours_since_event
    assert got is None if hours is None else got == pytest.approx(hours, abs=1e-3)


def test_idw_weights(spark):
    links = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.3)], "left_id int, right_id int, dist_mi double")
    assert [round(r.weight, 4) for r in spatial.idw(links).orderBy("right_id").collect()] == [0.8, 0.2]


def test_spans(spark):
    matched = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0)], "route_id int, sensor_id int, along_mi double")
    got = routing.build_spans(matched, spark.createDataFrame([(1, 5.0)], "route_id int, route_mi double")).orderBy("span_no").collect()
    assert [(r.kind, r.start_mi, r.end_mi) for r in got] == [("surface", 0.0, 1.0), ("freeway", 1.0, 2.0), ("surface", 2.0, 5.0)]


def test_fold_moves_the_clock(spark):
    spans = spark.createDataFrame([(1, 0, "freeway", 0.0, 20.0, 1), (1, 1, "freeway", 20.0, 40.0, 1)], "route_id int, span_no int, kind string, start_mi double, end_mi double, sensor_id int")
    speeds = spark.createDataFrame([(1, [60.0, 60.0, 30.0])], "station int, speeds array<double>")
    routes = routing.priced_spans(spans, speeds)
    ask = lambda d: routing.price(routes, spark.createDataFrame([(1, d)], "route_id int, depart int")).first().total_minutes
    assert ask(0) == pytest.approx(40.0)
    assert ask(30) == pytest.approx(80.0)
    got = routing.arrive_by(routes, spark.createDataFrame([(1, 60)], "route_id int, deadline int")).first()
    assert got.depart + got.minutes <= 60 and (got.depart + 15) + ask(got.depart + 15) > 60


def test_normalized_events_do_not_depend_on_order(spark):
    rows = [("v", "2025-07-07", False, "Game", "2025-01-02"), ("v", "2025-07-07T18:45:00", True, "Game", "2025-01-03"), ("v", "2025-07-07T10:41:00", True, "Other", "2025-01-01"), ("v", "2025-07-07", False, "Canceled: Band", "2025-01-01"), ("v", None, None, None, None)]
    schema = "venue string, start string, has_time boolean, title string, captured_at string"
    a, b = (sorted(map(tuple, events.normalize(spark.createDataFrame(r, schema))[0].collect())) for r in (rows, rows[::-1]))
    assert a == b and ("v", "Game", "2025-07-07T18:45:00", True, "2025-01-02", 2) in a and ("v", "Other", "2025-07-07", False, "2025-01-01", 1) in a


def test_json_lists_are_read_one_member_at_a_time():
    text = json.dumps([{"name": f"event {i}", "startDate": "2024-01-01"} for i in range(50_000)])
    tracemalloc.start()
    assert sum(1 for _ in events.members(text)) == 50_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000
    for good in ("[]", " [ 1 , [2], {} ] ", '{"a": [1]}', "7"):
        assert list(events.members(good)) == (v if isinstance(v := json.loads(good), list) else [v])
    for broken in ("", "[1, 2", "[1,]", "[1] 2", "[1 2]", "[,]", "{"):
        with pytest.raises(ValueError):
            list(events.members(broken))


def test_the_start_of_an_entry_is_worked_out_once(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", 2024)], "page_id long, html string, year int")
    assert events.text_events(pages)._jdf.queryExecution().optimizedPlan().toString().count("format_string") == 3


def test_json_ld(spark):
    html = '<script type="application/ld+json">{"@type": "MusicEvent", "name": "Band", "startDate": "2025-01-01T19:00", "location": {"name": "Hall"}}</script><script type="application/ld+json">{broken</script>'
    got = events.json_ld_events(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [tuple(r) for r in got] == [(1, "2025-01-01T19:00", "Band", "Hall", True)]


def test_holidays(spark):
    days = {(str(r.date), r.name) for r in features.holidays(spark, 2025, 2025).collect()}
    assert {("2025-11-27", "Thanksgiving"), ("2025-11-28", "Day After Thanksgiving"), ("2025-05-26", "Memorial Day"), ("2025-09-01", "Labor Day"), ("2025-01-20", "Martin Luther King Jr. Day")} <= days
    df = spark.createDataFrame([(dt.date(2025, 7, d),) for d in (3, 4, 6)], "date date")
    assert [r.holiday_class for r in features.holiday_class(df, features.holidays(spark, 2025, 2025)).orderBy("date").collect()] == ["adjacent", "holiday", "none"]


def test_slices_overlap(spark):
    df = spark.createDataFrame([(10.0, 11.0, 10.5, True), (10.0, 13.0, 10.0, False)], "a double, b double, p double, peak boolean")
    got = {r.slice: (r.n, r.mae_baseline) for r in evaluate.slice_report(df, "a", "b", {"m": "p"}, {"peak": F.col("peak")}).collect()}
    assert got == {"all": (2, 2.0), "peak": (1, 1.0)}


def test_raw_readings(spark, tmp_path):
    (tmp_path / "r.txt").write_text("01/02/2024 07:05:00,1,4,101,N,ML,0.5,10,80,100,0.1,61.5,9,9,9\nbad,2,4,101,N,OR,,,,,,\n")
    rows = readers.raw_readings(spark, str(tmp_path)).collect()
    assert [(r.station, r.ts, r.avg_speed) for r in rows] == [(1, dt.datetime(2024, 1, 2, 7, 5), 61.5)]


def test_weather_and_closures(spark):
    body = '{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "precipitation": [1.0, 2.0]}}'
    got = readers.hourly_weather(spark.createDataFrame([(1.0, 2.0, body)], "lat double, lon double, body string")).collect()
    assert [(r.ts.hour, r.precipitation, r.visibility) for r in got] == [(0, 1.0, None), (1, 2.0, None)]
    for payload in ('{"data": [{"lcs": {"closure": {"facility": "Mainline"}, "n": 1}}]}', '[{"closure": {"facility": "Mainline"}, "n": 1}]'):
        assert [r.facility for r in readers.closures(spark.createDataFrame([(payload,)], "payload string")).collect()] == ["Mainline"]


def test_incremental_ingest_is_exactly_once(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    schema = "station int, dow int, tod int, speed double, date date"
    rows = lambda d: spark.createDataFrame([(1, 0, 0, float(d), dt.date(2024, 1, d))], schema)
    rows(1).write.mode("append").parquet(src)
    ingest.ingest_new_files(spark, src, rows(1).schema, sink, ck)
    ingest.ingest_new_files(spark, src, rows(1).schema, sink, ck)
    rows(2).write.mode("append").parquet(src)
    ingest.ingest_new_files(spark, src, rows(1).schema, sink, ck)
    assert readers.day_readings(spark, sink).count() == 2 and readers.day_readings(spark, sink, first="2024-01-02").count() == 1
    state = str(tmp_path / "state")
    ingest.accumulate_profile(spark, src, rows(1).schema, state, str(tmp_path / "ck2"))
    assert [(r.n, r.s1) for r in ingest.newest_state(spark, state).collect()] == [(2, 3.0)]


def test_write_days_replaces_days(spark, tmp_path):
    path = str(tmp_path / "days")
    df = spark.createDataFrame([(1, 0, dt.date(2024, 1, 1)), (2, 0, dt.date(2024, 1, 2))], "station int, tod int, date date")
    readers.write_days(df, path)
    readers.write_days(df.where("station = 2").withColumn("station", F.lit(3)), path)
    assert sorted(r.station for r in spark.read.parquet(path).collect()) == [1, 3]
    assert [str(r.date) for r in readers.pending_days(df, spark.read.parquet(path).where("station = 1")).collect()] == ["2024-01-02"]


def test_chunks(spark):
    points = [(0.0, 0.0), (0.003, 0.0), (0.006, 0.0), (0.009, 0.0)]
    ways = spark.createDataFrame([(1, points)], "way_id int, points array<struct<lat:double,lon:double>>")
    got = routing.chunk_line(ways).collect()
    assert [len(r.points) for r in got] == [3, 2] and got[0].points[-1] == got[1].points[0]


def test_nearest_event_against_brute_force(spark, monkeypatch):
    """Sub-second gaps, ties, rows without key or time, both directions, and buckets that are dealt to several tasks."""
    import random

    from roadtide.operators import skew

    monkeypatch.setattr(skew, "LEAST", 20)
    rng, zero = random.Random(1), dt.datetime(2024, 1, 1)
    when = lambda: zero + dt.timedelta(microseconds=rng.choice([rng.randrange(0, 72 * 3600 * 10**6), 12 * 3600 * 10**6 + rng.randrange(-3, 3), rng.randrange(0, 72) * 3600 * 10**6]))
    evs = [(i, rng.choice("ab"), when()) for i in range(80)] + [(900, None, zero), (901, "a", None)]
    rows = [(i, rng.choice("ab"), when()) for i in range(300)] + [(i, "a", zero + dt.timedelta(hours=12)) for i in range(300, 360)] + [(990, None, zero), (991, "a", None)]
    df = spark.createDataFrame(rows, "row_id int, venue string, ts timestamp_ntz")
    e = spark.createDataFrame(evs, "event_id int, venue string, start timestamp_ntz")
    for backward in (False, True):
        want = {}
        for i, v, t in rows:
            best = []
            for j, w, s in evs:
                if v is not None and t is not None and v == w and s is not None:
                    h = (t - s) / dt.timedelta(hours=1)
                    if (-4 <= h < 0 and not backward) or 0 <= h <= 6:
                        best.append((h < 0, abs(h), j))
            want[i] = min(best)[2] if best else None
        got = {r.row_id: r.event_id for r in asof.nearest_event(df, e, key="venue", row_id="row_id", backward_only=backward).collect()}
        assert got == want


def test_events_on_a_northern_drive(spark):
    t = dt.datetime(2024, 1, 1)
    drives = spark.createDataFrame([(i, 55.0 + i * 0.01, 10.0 + i * 0.013, t, t) for i in range(20)], "drive_id int, lat double, lon double, depart timestamp_ntz, arrive timestamp_ntz")
    evs = spark.createDataFrame([(j, 55.0 + j * 0.011, 10.0 + j * 0.021, t) for j in range(20)], "event_id int, lat double, lon double, start timestamp_ntz")
    got = {(r.drive_id, r.event_id) for r in asof.events_on_drive(drives, evs, limit=99).collect()}
    miles = fn.equirect_miles(F.col("lat"), F.col("lon"), F.col("b"), F.col("c"))
    want = drives.join(evs.select("event_id", F.col("lat").alias("b"), F.col("lon").alias("c"))).where(miles <= 12).select("drive_id", "event_id")
    assert got == {tuple(r) for r in want.collect()} and len(got) > 100


def test_nearest_in_a_growing_grid(spark):
    left = spark.createDataFrame([(i, 37.0 + i * 0.37, -122.0 - i * 0.91) for i in range(12)], "left_id int, lat double, lon double")
    right = spark.createDataFrame([(f"c{j}", 37.0 + j * 1.3 % 5, -122.0 - j * 2.7 % 9) for j in range(9)], "right_id string, r_lat double, r_lon double")
    got = {r.left_id: r.right_id for r in spatial.nearest_in_grid(left, right, 0.25).collect()}
    d2 = F.round(F.pow(F.col("lat") - F.col("r_lat"), 2) + F.pow(F.col("lon") - F.col("r_lon"), 2), 9)
    want = {r.left_id: r.right_id for r in spatial.nearest(left, right, d2).collect()}
    assert got == want and len(got) == 12
    assert spatial.nearest_in_grid(left, right.where("false"), 0.25).count() == 0


def test_exact_quantiles(spark):
    for values in ([3.0], [1.0, 2.0], [5.0] * 50 + [1.0], [float(x * x % 997) for x in range(3000)], [1e-300, 1e300, 0.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        for q in (0.0, 0.5, 0.95, 1.0):
            assert evaluate.exact_quantile(df, F.col("v"), q, few=10, bins=8) == pytest.approx(np.quantile(values, q), rel=1e-12)
    assert evaluate.exact_quantile(df.where("false"), F.col("v"), 0.5) is None


def test_rolling_sums_over_block_borders(spark):
    rows = [(k, dt.date(2024, 1, 1 + i // 9), i, float(i % 5)) for k in "ab" for i in range(80)]
    df = spark.createDataFrame(rows, "k string, date date, t int, v double")
    got = {(r.k, r.t): (r.a, r.b) for r in seasonal.rolling_sums(df, "v", ("k",), ("date", "t"), {"a": 3, "b": 7}, block=10).collect()}
    assert got == {(k, i): tuple(sum(float(j % 5) for j in range(max(0, i - n + 1), i + 1)) for n in (3, 7)) for k in "ab" for i in range(80)}


def test_titles_of_all_scripts_stay_apart(spark):
    rows = [("v", "2025-01-01", False, t, "2025") for t in ("日本の夜", "東京の朝", "Вечер", "Beyoncé", "Beyonc", "BEYONCE")]
    got = events.merge_observations(spark.createDataFrame(rows, "venue string, start string, has_time boolean, title string, captured_at string"))
    assert sorted(r.observations for r in got.collect()) == [1, 1, 1, 1, 2]


def test_away_games_and_the_walk_over_texts(spark):
    fact = lambda n, place: f'{{"@type": "SportsEvent", "name": "Game {n}", "startDate": "2025-10-0{n}T19:00:00", "location": {{"name": "{place}", "address": {{"addressLocality": "Palo Alto"}}}}}}'
    block = lambda *facts: f'<script type="application/ld+json">[{", ".join(facts)}]</script>'
    texts = "<p>Oct</p><p>4</p><p>, 2026</p><p>Band &amp; Co</p><p>Opening</p><p>7:30 PM</p><p>Tickets</p><p>8:00 PM</p><p>Nov</p><p>31</p><p>No such day</p><p>Dec</p><p>5</p><p>Tickets</p><p>Late</p><p>May come</p>"
    pages = [
        (1, block(fact(1, "Stanford Stadium"), fact(2, "California Memorial"), fact(3, "Stanford"), fact(4, "Stanford")), 2025, "Stanford Stadium"),
        (2, block(fact(1, "Stanford Stadium"), fact(2, "Elsewhere")) + texts, 2025, "Stanford Stadium"),
        (3, None, 2025, None),
    ]
    got = events.page_events(spark.createDataFrame(pages, "page_id long, html string, year int, venue_name string")).collect()
    assert sorted(map(tuple, got)) == [
        (1, "2025-10-01T19:00:00", "Game 1", True), (1, "2025-10-03T19:00:00", "Game 3", True), (1, "2025-10-04T19:00:00", "Game 4", True),
        (2, "2025-12-05", "Late - May come", False), (2, "2026-10-04T19:30:00", "Band & Co - Opening", True),
    ]


def test_simplified_lines(spark):
    import random

    from roadtide.operators import geometry

    rng = random.Random(3)
    lines = [[(37.0 + i * 0.0005 + rng.random() * 0.0007, -122.0 + rng.random() * 0.0007) for i in range(n)] for n in (1, 2, 3, 60, 200)] + [[(37.0, -122.0), (37.0005, -122.0), (37.0, -122.0)]]
    got = {r.way_id: r.points for r in geometry.simplify(spark.createDataFrame(list(enumerate(lines)), "way_id long, points array<struct<lat:double,lon:double>>")).collect()}

    def off(p, a, b):
        import math

        scale, c = 69.0 * 1609.344, 54.6 * 1609.344
        x, y = (p[1] - a[1]) * c, (p[0] - a[0]) * scale
        dx, dy = (b[1] - a[1]) * c, (b[0] - a[0]) * scale
        return abs(dx * y - dy * x) / math.hypot(dx, dy) if math.hypot(dx, dy) else math.hypot(x, y)

    for i, line in enumerate(lines):
        kept = [tuple(p) for p in got[i]]
        assert kept[0] == line[0] and kept[-1] == line[-1] and set(kept) <= set(line)
        marks = [line.index(p) for p in kept[:-1]] + [len(line) - 1]
        for a, b in zip(marks, marks[1:]):  # noqa: B905
            assert all(off(line[k], line[a], line[b]) <= 25.0 + 1e-6 for k in range(a + 1, b))
    assert len(got[5]) == 3 and len(got[4]) < 200


def test_states_are_merged_and_streams_drop_late_rows(spark, tmp_path):
    src, state, ck = (str(tmp_path / n) for n in ("src", "state", "ck"))
    rows = lambda *s: spark.createDataFrame([(1, 0, 0, float(x)) for x in s], "station int, dow int, tod int, speed double")
    for part in ((1, 2), (3,), (4, 5)):
        rows(*part).write.mode("append").parquet(src)
        ingest.accumulate_profile(spark, src, rows(1).schema, state, ck)
    assert [(r.n, r.s1, r.s2) for r in ingest.newest_state(spark, state).collect()] == [(5, 15.0, 55.0)]
    live, out, ck = (str(tmp_path / n) for n in ("live", "out", "ck2"))
    at = lambda *m: spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 8) + dt.timedelta(minutes=x), float(x)) for x in m], "station int, ts timestamp, value double").coalesce(1)
    for part in ((1, 14, 16), (120,), (2, 121), (300,)):  # minute 2 comes when its window is closed
        at(*part).write.mode("append").parquet(live)
        stream = ingest.windowed(spark.readStream.schema(at(1).schema).parquet(live))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.window_start.minute, r.n) for r in spark.read.parquet(out).where("window_start < '2024-01-01 09:00:00'").collect()) == [(0, 2), (15, 1)]


def test_group_quantiles_with_heavy_groups(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=3000), None: 10.0 ** rng.uniform(-300, 300, 500), "one": np.array([7.0]), "same": np.full(400, 2.5), "ends": np.array([-1e308] * 40 + [1e308] * 41), "steps": (np.arange(900) % 7).astype(float), "zero": np.array([0.0, -0.0] * 30)}
    rows = [(k, 1, float(v)) for k, vs in groups.items() for v in vs] + [("a", 1, None), ("a", 1, float("nan")), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double").withColumns({"x": F.lit("q"), "i": F.lit(0), "n": F.lit(0), "low": F.lit(1)}).repartition(5)
    qs = {"q0": 0.0, "q5": 0.05, "med": 0.5, "q95": 0.95, "q1": 1.0}
    for few, bins in ((10_000, 1024), (20, 64)):
        got = {r.k: r for r in quantiles.group_quantiles(df, ["k", "j"], F.col("v"), qs, few=few, bins=bins).collect()}
        assert got.keys() == groups.keys()
        for k, vs in groups.items():
            assert got[k].n == len(vs) and [got[k][n] for n in qs] == pytest.approx([float(np.quantile(vs, q)) for q in qs.values()], rel=1e-9)


def test_a_key_of_all_rows_is_counted_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST", 1)
    df = spark.range(0, 30_000, 1, 6).select(F.lit("k").alias("k"), F.pmod(F.col("id") * 7919, F.lit(30_000)).cast("double").alias("v"))
    assert tuple(quantiles.group_quantiles(df, ["k"], F.col("v"), {"m": 0.5, "h": 0.9999}, few=100, bins=64).first()) == ("k", 30_000, 14_999.5, pytest.approx(29_996.0001))


def test_slices_with_totals(spark):
    rows = [(10.0, 11.0, 10.5, True, True), (10.0, 13.0, 10.0, False, True), (10.0, 10.0, 12.0, True, None)]
    df = spark.createDataFrame(rows, "a double, b double, p double, peak boolean, held boolean")
    got = {(r.level, r.held, r.slice): (r.n, r.mae_baseline, r.mae_m) for r in evaluate.slice_cube(df, "a", "b", {"m": "p"}, {"peak": F.col("peak")}, by="held").collect()}
    assert got[3, None, None] == (3, pytest.approx(4 / 3), pytest.approx(2.5 / 3)) and got[2, None, "peak"] == (2, 0.5, 1.25)
    assert got[0, None, "peak"] == (1, 0.0, 2.0) and got[0, True, "all"] == (2, 2.0, 0.25) and len(got) == 7


def test_layers_are_learnt_on_the_plain_baseline(spark):
    train = spark.createDataFrame([(8.0, 10.0, "x", True)] * 30 + [(6.0, 0.0, "x", True)] * 30 + [(20.0, 10.0, "y", True)] * 30, "actual double, base double, k string, wet boolean")
    layers = [("k", ["k"], F.lit(True)), ("wet", ["wet"], F.col("wet"))]
    test = spark.createDataFrame([(8.0, 10.0, "x", True), (10.0, 10.0, "x", False), (10.0, 10.0, "z", None)], "actual double, base double, k string, wet boolean")
    done = features.layered_corrections(train, test, layers)
    assert [(r.f_k, r.f_wet, round(r.corrected, 6)) for r in done.orderBy("k", F.desc("wet")).collect()] == [(0.8, 1.4, 11.2), (0.8, 1.0, 8.0), (1.0, 1.0, 10.0)]
    got = {r.layer: r for r in features.layer_report(done, layers).collect()}
    assert (got["wet"].rows, got["wet"].mae_before, got["wet"].mae_after) == (1, 2.0, 6.0) and got["k"].rows == 3 and got["k"].global_gain_pct == pytest.approx(0.0)


def test_model_of_nothing_and_of_blank_columns(spark):
    schema = "a double, b double, c string, label double, valid boolean"
    rows = spark.createDataFrame([(float(i % 5), None, "x" if i % 2 else None, float(i % 5), i % 4 == 0) for i in range(80)], schema)
    assert model.fit(rows.where("false"), ["a", "b"], ["c"], valid="valid") is None and model.fit(rows.where("valid"), ["a", "b"], ["c"], valid="valid") is None
    assert model.predict(None, rows).columns == [*rows.columns, "mph"] and model.predict(None, rows).count() == 0 and model.importances(None, spark).count() == 0
    fitted = model.fit(rows, ["a", "b"], ["c"], rounds=8, valid="valid")
    asked = spark.createDataFrame([(3.0, 9.0, "new", None, None), (None, None, None, None, None)], schema)
    got = model.predict(fitted, asked, "minutes", out="m").collect()
    assert got[0].m == pytest.approx(3.0, abs=0.8) and got[1].m is not None and {r.feature for r in model.importances(fitted, spark).collect()} >= {"a_filled", "b", "a_missing", "c_index"}


def test_streets_take_the_slowdown_of_stations_near(spark):
    vertices = spark.createDataFrame([(1, i, 37.0 + i * 0.01, -122.0, 0.69 * i, 1.0 * i) for i in range(5)], "route_id int, seq int, lat double, lon double, cum_mi double, cum_min double")
    spans = spark.createDataFrame([(1, 0, "surface", 0.0, 1.38, None), (1, 1, "freeway", 1.38, 2.76, 9)], "route_id int, span_no int, kind string, start_mi double, end_mi double, sensor_id int")
    stations = spark.createDataFrame([(9, 37.01, -122.0)], "sensor_id int, lat double, lon double")
    speeds = routing.slot_speeds(spark.createDataFrame([(9, 0, 30.0, 3.0), (9, 2, None, None)], "station int, slot int, mph double, sd double"), slots=4, sd="sd")
    streets = routing.street_speeds(spans, vertices, stations, speeds, spark.createDataFrame([(9, 60.0)], "station int, freeflow double"), slots=4)
    got = {r.span_no: r for r in streets.collect()}
    assert got[0].free_mph == pytest.approx(41.4) and got[0].streets == [pytest.approx(41.4 * 0.75), None, None, None]
    routes = routing.priced_spans(spans, speeds, streets)
    r = {r.depart: r for r in routing.price(routes, spark.createDataFrame([(1, 0), (1, 15)], "route_id int, depart int")).collect()}
    first, second = 1.38 / (41.4 * 0.75) * 60, 1.38 / 30 * 60
    assert r[0].total_minutes == pytest.approx(first + second) and r[0].measured_share == pytest.approx(second / (first + second)) and r[0].minutes_sd == pytest.approx(1.38 * 60 * 3 / 900)
    assert r[15].total_minutes == pytest.approx(4.0) and r[15].stations == 0 and r[15].minutes_sd == 0


def test_version_at_each_row(spark):
    at = lambda day, h=0: dt.datetime(2024, 1, day, h)
    versions = spark.createDataFrame([("a", 1, at(1)), ("a", 2, at(1)), ("a", 3, at(9, 5)), ("a", 4, at(9, 7)), ("b", 5, at(3)), (None, 6, at(1)), ("a", 7, None)], "k string, v int, c timestamp_ntz")
    rows = spark.createDataFrame([(1, "a", at(1)), (2, "a", at(8)), (3, "a", at(9, 6)), (4, "a", at(9, 7)), (5, "a", at(30)), (6, "b", at(2, 23)), (7, "c", at(5)), (8, None, at(5)), (9, "a", None), (10, "b", at(31))], "id int, k string, t timestamp_ntz")
    got = {r.id: (r.v, r.valid_from, r.valid_to) for r in asof.as_of_each(rows, versions, key="k", row_id="id", ts="t", captured="c", version_id="v").collect()}
    none = (None, None, None)
    assert got == {1: (2, at(1), at(9, 5)), 2: (2, at(1), at(9, 5)), 3: (3, at(9, 5), at(9, 7)), 4: (4, at(9, 7), None), 5: (4, at(9, 7), None), 6: none, 7: none, 8: none, 9: none, 10: (5, at(3), None)}
    plan = asof.as_of_each(rows, versions, key="k", row_id="id", ts="t", captured="c", version_id="v")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_versions_of_a_key_with_all_rows(spark, monkeypatch):
    monkeypatch.setattr("roadtide.operators.skew.LEAST", 10)
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = spark.range(400).select("id", F.lit("a").alias("k"), (start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("t"))
    versions = rows.where("id % 7 = 3").select("k", F.col("id").alias("v"), F.col("t").alias("c"))
    got = {r.id: r.v for r in asof.as_of_each(rows, versions, key="k", row_id="id", ts="t", captured="c", version_id="v", width_h=1).collect()}
    assert got == {i: None if i < 3 else i - (i - 3) % 7 for i in range(400)}


def test_profile_as_a_log_of_deltas(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = lambda speed: spark.createDataFrame([(s, 0, 0, speed) for s in range(3)], "station int, dow int, tod int, speed double")
    sums = lambda: sorted((r.station, r.n, r.s1, r.s2) for r in ingest.newest_state(spark, state).collect())
    assert sums() == [] and not ingest.compact_profile(spark, state)
    for i in range(6):
        rows(float(i)).write.mode("append").parquet(src)
        ingest.accumulate_profile(spark, src, rows(1.0).schema, state, str(tmp_path / "check"))
        if i == 3:
            assert ingest.compact_profile(spark, state) and commits.names(spark, f"{state}/delta") == []
    want = [(s, 6, 15.0, 55.0) for s in range(3)]
    assert sums() == want and commits.names(spark, f"{state}/delta") == ["000000000004", "000000000005"]
    assert spark.read.parquet(f"{state}/delta/000000000005").count() == 3
    # All batches run again from an empty checkpoint with the same numbers: what the base holds is not written, the rest is written alike.
    for _ in range(2):
        ingest.compact_profile(spark, state)
    assert sums() == want and commits.names(spark, f"{state}/base") == ["000000000003", "000000000005"] and commits.committed(spark, state)[-1] == "base=000000000005"
    (tmp_path / "state/delta/000000000009").mkdir()  # a batch that broke off
    assert sums() == want


def test_days_land_whole_and_once(spark, tmp_path, monkeypatch):
    root, src, schema = str(tmp_path / "days"), str(tmp_path / "src"), "id long, v double, date date"
    days = spark.range(40).selectExpr("id", "double(id) as v", "date_add(date'2024-01-01', cast(id % 4 as int)) as date")
    days.write.partitionBy("date").parquet(src)
    read = lambda: sorted((str(r.date), r.n, r.v) for r in commits.read_days(spark, root, schema).groupBy("date").agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect())
    assert read() == []
    real, calls = commits.commit, []
    monkeypatch.setattr(commits, "commit", lambda *a: calls.append(a) or (real(*a) if len(calls) < 3 else 1 / 0))
    with pytest.raises(ZeroDivisionError):
        commits.land_days(days, root)
    assert [d for d, *_ in read()] == ["2024-01-01", "2024-01-02"]
    monkeypatch.setattr(commits, "commit", real)
    files = spark.read.schema(schema).parquet(src)
    assert "PartitionFilters: [NOT date#" in commits.pending(files, root)._jdf.queryExecution().executedPlan().toString() and commits.pending(files, root).count() == 20
    assert commits.land_days(files.withColumn("v", F.col("v") + 0), root) == ["2024-01-03", "2024-01-04"]
    assert commits.land_days(files, root) == [] and read() == [(f"2024-01-0{i + 1}", 10, sum(float(x) for x in range(i, 40, 4))) for i in range(4)]


def test_live_windows_are_given_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "check"))
    members = spark.createDataFrame([("c", 1, 1.0), ("c", 2, 3.0), ("d", 2, 2.0)], "slug string, sensor_id int, length double")
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    lots = [[(1, at(8), 60.0), (1, at(8, 5), 30.0), (2, at(8, 10), 60.0), (9, at(8), 50.0)], [(1, at(9, 40), 60.0), (1, at(9, 20), 60.0)], [(1, at(8, 1), 5.0), (2, at(9, 30), 30.0), (1, at(12), 60.0)]]
    for rows in lots:
        spark.createDataFrame(rows, "station int, ts timestamp, speed double").coalesce(1).write.mode("append").parquet(src)
        for _ in range(2):
            ingest.live_corridors(spark, src, "station int, ts timestamp, speed double", members, out, ck)
    got = sorted((r.corridor, r.window_start, round(r.raw_minutes, 6), r.n_stations, r.coverage) for r in spark.read.parquet(out).collect())
    assert got == [("c", at(8), round(60 / 45 + 3, 6), 2, 1.0), ("c", at(9, 15), 1.0, 1, 0.25), ("c", at(9, 30), 7.0, 2, 1.0), ("d", at(8), 2.0, 1, 1.0), ("d", at(9, 30), 4.0, 1, 1.0)]


@pytest.mark.parametrize("most", [0, 10])
def test_live_windows_are_never_broadcast(spark, tmp_path, monkeypatch, most):
    """The batch without new files gives the windows that are over; its plan must not send them through the driver, however many members there are."""
    from pyspark.sql.streaming import DataStreamWriter

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "check"))
    started, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: started.append(start(self, *a, **k)) or started[-1])
    monkeypatch.setattr(ingest, "MAX_BROADCAST_MEMBERS", most, raising=False)
    members = spark.createDataFrame([("c", 1, 1.0), ("c", 2, 3.0)], "slug string, sensor_id int, length double")
    rows = [(1, dt.datetime(2024, 1, 1, h), 60.0) for h in (8, 9, 12)]
    spark.createDataFrame(rows, "station int, ts timestamp, speed double").coalesce(1).write.parquet(src)
    ingest.live_corridors(spark, src, "station int, ts timestamp, speed double", members, out, ck)
    plan = started[0]._jsq.explainInternal(False)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines, sent = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            sent += itertools.takewhile(lambda below, d=depth(line): depth(below) > d, lines[i + 1 :])
    assert spark.read.parquet(out).count() == 2
    assert "StateStoreRestore" in plan and not [line for line in sent if "StateStore" in line]


def test_payloads_of_any_nesting(spark):
    record = '{"closure": {"facility": "F", "location": %s}, "n": 1}'
    text, named = record % '"here"', record % '{"name": "there", "x": [1]}'
    cases = {
        f"[{text}, {named}]": ["here", "there"], f'{{"data": [{text}]}}': ["here"], f'[{{"lcs": {named}}}]': ["there"], f'{{"a": {{"b": [{{"lcs": {{"r": {text}}}}}]}}}}': ["here"], text: ["here"], '[{"closure": {"facility": "F"}}]': [None],
        record % "7": [None], "not json": [], "[]": [], "{}": [], "7": [], "null": [], '{"a": 1, "b": [2]}': [], "[1, [2]]": [],
    }
    df = spark.createDataFrame([*((i, p) for i, p in enumerate(cases)), (99, None)], "id int, payload string")
    got = {}
    for r in readers.closures(df).select("id", "facility", "place").collect():
        assert r.facility == "F"
        got.setdefault(r.id, []).append(r.place)
    assert got == {i: places for i, places in enumerate(cases.values()) if places}


def test_ranks_of_one_key_with_all_rows(spark):
    df = spark.range(0, 5000, 1, 6).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 5000).alias("o"), F.col("id").alias("rank_"))
    mixed = df.unionByName(spark.createDataFrame([(None, 1, 0), (None, None, 1), ("k", 17, 2), ("k", 17, 3)], "k string, o long, rank_ long"))
    got = {}
    for r in ordered.ranked(mixed, ["k"], ["o"]).collect():
        got.setdefault(r.k, []).append((r["rank"], r.o, r.size))
    assert sorted(got[None]) == [(0, None, 2), (1, 1, 2)]
    want = sorted([*range(5000), 17, 17])
    assert [(a, b) for a, b, _ in sorted(got["k"])] == list(enumerate(want)) and {s for *_, s in got["k"]} == {5002}
    assert ordered.ranked(mixed.where("false"), [], ["o"]).count() == 0
    tiles = spark.range(23).select(ordered.ntile(F.col("id"), F.lit(23), 5).alias("t"), F.ntile(5).over(Window.orderBy("id")).alias("w"))
    assert tiles.where("t <> w").count() == 0 and spark.range(3).select(ordered.ntile(F.col("id"), F.lit(3), 5).alias("t")).agg(F.max("t")).first()[0] == 3


def test_rolling_statistics_of_a_long_key(spark, monkeypatch):
    monkeypatch.setattr("roadtide.operators.skew.LEAST", 50)
    monkeypatch.setattr(ordered, "BLOCK", 16)
    monkeypatch.setattr(ordered.over_blocks, "__kwdefaults__", {"block": 16})
    rows = [("long", i, float(i * 37 % 23) if i % 9 else None) for i in range(300)] + [("short", i, float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(4)
    got = {(r.k, r.t): (r.seasonal_median, r.seasonal_sd, r.prev_value) for r in seasonal.causal_rolling(df, "v", ("k",), ("t",)).collect()}
    assert len(got) == len(rows)
    by_key = {"long": [v for k, _, v in rows if k == "long"], "short": [v for k, _, v in rows if k == "short"]}
    for (k, t), (median, sd, before) in got.items():
        past = [v for v in by_key[k][max(0, t - 8) : t] if v is not None]
        want = (float(np.median(past)), float(np.std(past, ddof=1))) if len(past) >= 3 else (None, None)
        assert (median, sd) == (pytest.approx(want[0]), pytest.approx(want[1])) if past and len(past) >= 3 else (median, sd) == want
        assert before == (by_key[k][t - 1] if t else None)


def test_a_station_is_predicted_by_a_model_that_never_saw_it(spark):
    rows = spark.range(200).select((F.col("id") % 10).cast("int").alias("station"), F.col("id"))
    seen = []

    def learn(some):
        seen.append({r.station for r in some.select("station").distinct().collect()})
        return len(seen) - 1

    done = model.cross_fitted(rows, learn, lambda m, some: some.withColumn("by", F.lit(m)), folds=3).collect()
    assert len(done) == 200 and all(r.station not in seen[r.by] for r in done) and len(seen) == 3
    assert all(len({r.fold for r in done if r.station == s}) == 1 for s in range(10))


@pytest.mark.parametrize("name", ["J1_bucketed_seasonal", "J3_bucketed_semi_join"])
def test_bucketed_tables_are_joined_without_an_exchange(spark, name):
    from roadtide.plans import source_queries  # noqa: F401  registers the queries
    from roadtide.plans.queries import queries

    plan = queries()[name](spark, str(TESTDATA))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_profile_of_buckets_is_grouped_without_an_exchange(spark):
    rows = spark.range(500).selectExpr("cast(id % 7 as int) as station", "cast(id % 5 as int) as dow", "cast(id % 3 as int) as tod", "double(id) as speed", "50 as pct_observed")
    facts = buckets.bucketed(rows, ["station", "dow", "tod"], 4)
    profile = seasonal.profile(facts, only_current=False)
    assert "Exchange" not in profile._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, profile.collect())) == sorted(map(tuple, seasonal.profile(rows, only_current=False).collect()))


def test_nearest_of_many_copies_at_one_place(spark, monkeypatch):
    """Copies on both sides: the result is that of all pairs, of which only places are held against each other."""
    right = spark.range(150).selectExpr("id AS right_id", "37.0 + id % 5 * 0.004 AS lat", "-122.0 - id % 3 * 0.005 AS lon")
    left = spark.range(40).selectExpr("id AS left_id", "37.0 + id % 4 * 0.006 AS lat", "-122.0D AS lon")
    pairs = spatial.within(left, right, miles=1.0).collect()
    want = {}
    for p in pairs:
        want.setdefault(p.left_id, []).append((p.dist_mi, p.right_id))
    met, within = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda a, b, **more: met.append((a.count(), b.count())) or within(a, b, **more))
    got = {}
    for r in spatial.knn(left, right, k=7, miles=1.0).collect():
        got.setdefault(r.left_id, []).append((r["rank"], r.dist_mi, r.right_id))
    assert met == [(4, 15)]
    assert {i: [(d, x) for _, d, x in sorted(rows)] for i, rows in got.items()} == {i: sorted(rows)[:7] for i, rows in want.items()}
    assert all([n for n, _, _ in sorted(rows)] == list(range(1, len(rows) + 1)) for rows in got.values())


def test_spans_of_copies_of_stations(spark):
    """Stations at one place give a route one stretch, so one of them is matched; the spans are those of all."""
    at = spark.range(12).selectExpr("CAST(1 AS INT) AS route_id", "CAST(id AS INT) AS seq", "37.0 + id * 0.01 AS lat", "-122.0D AS lon")
    v = spatial.along(at)
    stations = spark.range(300).selectExpr("CAST(id AS INT) AS sensor_id", "37.0 + id % 6 * 0.02 AS lat", "-122.0D AS lon", "CAST(id % 2 * 180 AS DOUBLE) AS bearing")
    length = v.groupBy("route_id").agg(F.max("cum_mi").alias("route_mi"))
    one = spatial.match_routes(v, spatial.governing(stations), tolerance_mi=0.5, max_bearing=180.0)
    every = spatial.match_routes(v, stations, tolerance_mi=0.5, max_bearing=180.0)
    spans = lambda m: sorted(map(tuple, routing.build_spans(m, length).collect()))
    assert (one.count(), every.count()) == (6, 300)
    assert spans(one) == spans(every) and len(spans(one)) > 5


def test_spans_of_stations_at_one_place_with_bearings_of_their_own(spark):
    """Where every bearing fits, a place matches once, however many bearings its stations have; a place next to it keeps its own."""
    at = spark.range(12).selectExpr("CAST(1 AS INT) AS route_id", "CAST(id AS INT) AS seq", "37.0 + id * 0.01 AS lat", "-122.0D AS lon")
    v = spatial.along(at)
    stations = spark.range(300).selectExpr("CAST(id AS INT) AS sensor_id", "37.0 + id % 6 * 0.02 AS lat", "-122.0D AS lon", "CAST(id AS DOUBLE) AS bearing")
    length = v.groupBy("route_id").agg(F.max("cum_mi").alias("route_mi"))
    one = spatial.match_routes(v, spatial.governing(stations, max_bearing=180.0), tolerance_mi=0.5, max_bearing=180.0)
    every = spatial.match_routes(v, stations, tolerance_mi=0.5, max_bearing=180.0)
    spans = lambda m: sorted(map(tuple, routing.build_spans(m, length).collect()))
    assert (one.count(), every.count(), spatial.governing(stations).count()) == (6, 300, 300)
    assert spans(one) == spans(every) and len(spans(one)) > 5


def test_rows_at_the_limit_of_coverage_stay_whatever_the_order_of_their_sums(spark):
    rows = spark.createDataFrame([("c", 0.5), ("c", 0.5), ("c", 0.5), ("c", 0.4 - 5e-17), ("c", 0.3)], "corridor string, coverage double")
    assert corridor.well_covered(rows).count() == 4


def test_events_on_drives_of_many_windows(spark):
    """Windows that start and end within, and at the ends of, minutes, against all pairs; a window of hundreds of events makes few rows."""
    t, us = dt.datetime(2024, 1, 1), dt.timedelta(microseconds=1)
    gaps = [dt.timedelta(seconds=x) for x in (0, 1, 59, 60, 61, 600, 3601, 40000)]
    drives = [(i % 7, 37.0 + i % 5 * 0.1, -122.0, t + i * dt.timedelta(minutes=13, seconds=i % 3), t + i * dt.timedelta(minutes=13, seconds=i % 3) + gaps[i % 8]) for i in range(30)]
    events = [(j, 37.0 + j * 7 % 4 * 0.1, -122.0 + j % 3 * 0.1, t + j * dt.timedelta(minutes=3) + j % 5 * us) for j in range(150)]
    evs = spark.createDataFrame(events, "event_id int, lat double, lon double, start timestamp_ntz")
    asks = spark.createDataFrame(drives, "drive_id int, lat double, lon double, depart timestamp_ntz, arrive timestamp_ntz")
    got = sorted((r.drive_id, r.event_id, r["rank"]) for r in asof.events_on_drive(asks, evs, before_h=0.5, after_h=1.0).collect())
    miles = fn.equirect_miles(F.col("lat"), F.col("lon"), F.col("b"), F.col("c"))
    pairs = asks.join(evs.select("event_id", F.col("lat").alias("b"), F.col("lon").alias("c"), "start")).withColumn("m", miles).where("m <= 12 and arrive >= start - interval 30 minutes and depart <= start + interval 1 hour")
    w = Window.partitionBy("drive_id").orderBy("m", "event_id")
    want = pairs.groupBy("drive_id", "event_id").agg(F.min("m").alias("m")).withColumn("r", F.row_number().over(w)).where("r <= 2")
    assert got == sorted((r.drive_id, r.event_id, r.r) for r in want.collect()) and len(got) == 14
    crowd = spark.range(3000).selectExpr("id AS event_id", "1D AS e_lat", "2D AS e_lon", "id * 1000000 AS __at")
    one = spark.createDataFrame([(1.0, 2.0, 61_500_000, 2_900_500_000)], "e_lat double, e_lon double, __from long, __to long")
    ids = sorted(r.event_id for r in asof._in_window(one, crowd, 2).collect())
    assert ids[:2] == [62, 63] and len(ids) < 150


def test_a_fit_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return float(x % 3)

    rows = spark.range(200).select(F.udf(told, "double")("id").alias("label"), (F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 2).cast("string").alias("c"), (F.col("id") >= 150).alias("valid"))
    fitted = model.fit(rows, ["a"], ["c"], rounds=2, valid="valid")
    assert fitted is not None and seen.value == 200


def test_departures_are_never_broadcast(spark):
    """Exploded rows have the planner's size of the few that they come from."""
    span = "named_struct('span_no', 0, 'kind', 'surface', 'miles', 10D, 'speeds', cast(null as array<double>), 'sds', cast(null as array<double>), 'streets', cast(null as array<double>), 'free', 30D)"
    routes = spark.range(3).selectExpr("id AS route_id", f"array({span}) AS spans")
    departs = routing.all_day(spark.range(3).withColumnRenamed("id", "route_id"))
    deadlines = spark.range(3).selectExpr("id AS route_id", "explode(array(540, 1080)) AS deadline")
    asked = {"price": routing.price(routes, departs), "segments": routing.segments(routes, departs), "arrive_by": routing.arrive_by(routes, deadlines)}
    plans = {name: df._jdf.queryExecution().executedPlan().toString() for name, df in asked.items()}
    assert [name for name, plan in plans.items() if "Broadcast" in plan] == []
    assert (asked["price"].count(), asked["segments"].count()) == (288, 288)
    assert sorted(map(tuple, asked["arrive_by"].select("route_id", "deadline", "depart", "minutes").collect())) == [(i, t, t - 30, 20.0) for i in range(3) for t in (540, 1080)]


@pytest.mark.parametrize("name", ["A17_relative_coverage", "M10_route_validation"])
def test_rows_at_the_limit_of_coverage_are_compared_as_in_the_sql(spark, tmp_path, name):
    """Of 2.5 miles 0.4 are 0.8 times 0.5, but less in doubles."""
    from roadtide.plans.queries import oracle_sql, queries

    stations = [4, 12, 16, 20, 40, 60]
    spark.createDataFrame([(k, 0) for k in stations], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(str(tmp_path / "w1"))
    at = [(12, 1, d) for d in range(1, 6)] + [(16, 2, 9)]
    rows = [(k, o, 1, 20.0 + d, 0.05, 0.02, dt.datetime(1996, 1, d)) for k, o, d in at]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "w2"))
    (tmp_path / "sf").mkdir()
    for folder, table in (("w1", "supplier"), ("w2", "lineitem")):
        next((tmp_path / folder).glob("*.parquet")).rename(tmp_path / "sf" / f"{table}.parquet")
    got, names = rows_of(queries()[name](spark, str(tmp_path / "sf")))
    assert got == oracle_rows(oracle_sql()[name], tmp_path / "sf", names) and {r[names.index("n")] for r in got} == {5}


def test_exact_sums_do_not_depend_on_the_order_of_rows(spark):
    asked = lambda vs: spark.createDataFrame([(v,) for v in vs], "x double").coalesce(1).agg(corridor.exact_sum("x").alias("s")).first().s
    assert asked([0.1, 0.2, 0.3]) == asked([0.3, 0.2, 0.1]) == 0.6
    assert np.isnan(asked([0.1, float("nan")])) and asked([1e300, 1.0]) == 1e300 and asked([None]) is None
