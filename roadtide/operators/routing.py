"""Route pricing: spans, the time-dependent fold, bands, all-day profiles and arrive-by answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtide.functions.columns import MPH_MIN, flow_ratio, interpolated, surface_mph
from roadtide.operators.spatial import idw, knn

#: Longest stretch that one station speaks for, and band factors (fixed values).
MAX_SPAN_MI, SLOW, FAST = 2.5, 0.40, 0.25
#: A first station so near to the start has no surface span before it; miles an hour of a stretch without free-flow minutes; part of
#: the freeway's slowdown that other roads take (fixed values).
START_MI, LAST_RESORT_MPH, ALPHA = 0.01, 30.0, 0.5


def build_spans(matched: DataFrame, routes: DataFrame, *, max_span_mi: float = MAX_SPAN_MI) -> DataFrame:
    """Spans of each route: route_id, span_no, kind, start_mi, end_mi, sensor_id.

    Each matched station governs up to the next; what comes before the first (beyond START_MI), and stretches over
    max_span_mi, are surface. matched: route_id, sensor_id, along_mi; routes: route_id, route_mi.
    """
    w = Window.partitionBy("route_id").orderBy("along_mi", "sensor_id")
    runs = matched.join(routes, "route_id").select("route_id", "sensor_id", F.col("along_mi").alias("start_mi"), F.lead("along_mi").over(w).alias("next_mi"), "route_mi")
    runs = runs.withColumn("end_mi", F.coalesce("next_mi", "route_mi"))
    long = F.col("end_mi") - F.col("start_mi") > max_span_mi
    governed = runs.select("route_id", F.when(long, "surface").otherwise("freeway").alias("kind"), "start_mi", "end_mi", F.when(~long, F.col("sensor_id")).alias("sensor_id"))
    first = matched.groupBy("route_id").agg(F.min("along_mi").alias("first_mi"))
    lead = routes.join(first, "route_id", "left").select("route_id", F.lit("surface").alias("kind"), F.lit(0.0).alias("start_mi"), F.coalesce("first_mi", "route_mi").alias("end_mi"), F.lit(None).cast("int").alias("sensor_id"), "first_mi")
    lead = lead.where(F.col("first_mi").isNull() | (F.col("end_mi") > START_MI)).drop("first_mi")
    every = governed.unionByName(lead).where("end_mi > start_mi")
    order = Window.partitionBy("route_id").orderBy("start_mi", "end_mi", "sensor_id")
    return every.select("route_id", (F.row_number().over(order) - 1).alias("span_no"), "kind", "start_mi", "end_mi", "sensor_id")


def slot_speeds(forecast: DataFrame, value: str = "mph", slots: int = 96, sd: str | None = None) -> DataFrame:
    """station, speeds, sds: arrays of `slots` values in slot order, null where the forecast has none. forecast: station, slot, value, and the deviation sd if it is known."""
    deviation = F.col(sd).cast("double") if sd else F.lit(None).cast("double")
    per = forecast.groupBy("station").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct(F.col(value).alias("mph"), deviation.alias("sd"))))).alias("m"))
    at = lambda c: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.try_element_at("m", i)[c])
    return per.select("station", at("mph").alias("speeds"), at("sd").alias("sds"))


def free_speeds(spans: DataFrame, vertices: DataFrame) -> DataFrame:
    """route_id, span_no, free_mph: a span's miles over the route's own free-flow minutes between its ends. vertices: route_id, cum_mi, cum_min."""
    marks = vertices.select("route_id", F.col("cum_mi").alias("mile"), F.col("cum_min").alias("minutes"))
    ends = spans.select("route_id", "span_no", F.inline(F.array(*(F.struct(F.lit(i).alias("end"), F.col(c).alias("mile")) for i, c in enumerate(("start_mi", "end_mi"))))))
    value = lambda c, i: F.max(F.when(F.col("end") == i, F.col(c)))
    per = minutes_at(ends, marks).groupBy("route_id", "span_no").agg((value("mile", 1) - value("mile", 0)).alias("miles"), (value("minutes", 1) - value("minutes", 0)).alias("minutes"))
    return per.select("route_id", "span_no", F.when(F.col("minutes") > 0, F.col("miles") / F.col("minutes") * 60.0).otherwise(LAST_RESORT_MPH).alias("free_mph"))


def street_speeds(spans: DataFrame, vertices: DataFrame, stations: DataFrame, speeds: DataFrame, freeflow: DataFrame, *, alpha: float = ALPHA, slots: int = 96) -> DataFrame:
    """route_id, span_no, free_mph, streets: the estimated speeds by slot of a span that no station speaks for, null where no station near has a speed.

    Any span may need them: surface ones, and freeway spans in slots without a forecast. The stations near the first
    vertex at or behind the span's middle are weighted as for ways; the share of free flow that they have in a slot
    slows the span's free speed by a part alpha of it. Vertices count as behind from a billionth of a mile before.
    speeds: from slot_speeds(); freeflow: station, freeflow; vertices: route_id, seq, lat, lon, cum_mi, cum_min.
    """
    middle = spans.select("route_id", "span_no", ((F.col("start_mi") + F.col("end_mi")) / 2 - 1e-9).alias("__mid"))
    behind = F.col("cum_mi") >= F.col("__mid")
    first = F.min_by(F.struct("lat", "lon"), F.struct((~behind).alias("b"), F.when(behind, F.col("seq")).otherwise(-F.col("seq")).alias("s"))).alias("p")
    points = middle.join(vertices.select("route_id", "seq", "lat", "lon", "cum_mi"), "route_id").groupBy("route_id", "span_no").agg(first)
    links = way_links(points.select(F.struct("route_id", "span_no").alias("way_id"), "p.lat", "p.lon"), stations)
    shares = links.join(speeds, "station").join(freeflow, "station").select("way_id", "weight", "freeflow", F.posexplode("speeds").alias("slot", "mph"))
    ratio = flow_ratio(F.col("mph"), F.col("freeflow"))
    by_slot = shares.where(ratio.isNotNull()).groupBy("way_id", "slot").agg(F.try_divide(F.sum(F.col("weight") * ratio), F.sum("weight")).alias("ratio"))
    per = by_slot.groupBy("way_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", 1.0 - alpha * (1.0 - F.col("ratio"))))).alias("m")).select("way_id.route_id", "way_id.span_no", "m")
    slowed = lambda i: F.greatest(F.col("free_mph") * F.try_element_at("m", i), F.lit(MPH_MIN))
    at = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.when(F.try_element_at("m", i).isNotNull(), slowed(i)))
    return free_speeds(spans, vertices).join(per, ["route_id", "span_no"], "left").select("route_id", "span_no", "free_mph", F.when(F.col("m").isNotNull(), at).alias("streets"))


def priced_spans(spans: DataFrame, speeds: DataFrame, streets: DataFrame | None = None) -> DataFrame:
    """route_id and spans: array<struct<span_no, kind, miles, speeds, sds, streets, free>> in order.

    Where no station speaks for a span it runs at the speed of its slot in `streets` (from street_speeds()), at its free
    speed where there is none, and at LAST_RESORT_MPH where that is not known either.
    """
    rows = spans.join(speeds, F.col("sensor_id") == F.col("station"), "left")
    rows = rows.join(streets, ["route_id", "span_no"], "left") if streets is not None else rows.withColumns({"streets": F.lit(None).cast("array<double>"), "free_mph": F.lit(None).cast("double")})
    if "sds" not in speeds.columns:
        rows = rows.withColumn("sds", F.lit(None).cast("array<double>"))
    one = F.struct("span_no", "kind", (F.col("end_mi") - F.col("start_mi")).alias("miles"), "speeds", "sds", "streets", F.coalesce("free_mph", F.lit(LAST_RESORT_MPH)).alias("free"))
    return rows.groupBy("route_id").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def _span_at(x, t, slot_min: int) -> tuple:
    """The forecast speed of span x at minute t (null without one), the speed it runs at, and its deviation in minutes."""
    at = lambda c: F.when(x[c].isNotNull(), F.get(x[c], F.greatest(F.least(F.floor(t / slot_min).cast("int"), F.size(x[c]) - 1), F.lit(0))))
    forecast = F.when((x["kind"] == "freeway") & (at("speeds") > 0), at("speeds"))
    mph = F.coalesce(forecast, at("streets"), F.greatest(x["free"], F.lit(MPH_MIN)))
    return forecast, mph, F.when(forecast.isNotNull(), minutes_sd(x["miles"], forecast, F.coalesce(at("sds"), F.lit(0.0)))).otherwise(0.0)


def price(routes: DataFrame, departures: DataFrame, *, slot_min: int = 15) -> DataFrame:
    """Minutes of every route and departure, each span at the slot when the driver reaches it.

    routes: from priced_spans(); departures: route_id, depart (minutes since the first slot). A slot beyond the last
    stays at the last. A span without a forecast in its slot counts as surface. measured_share is that of the minutes;
    minutes_sd adds up the deviations of the forecast spans. The fold runs inside one row per (route, departure), so the
    plan has one join and no state across rows. It is a merge join: departures that explode() has made count for the
    planner as the few rows they come from, and it would broadcast them all.
    """
    zero = F.struct(
        F.col("depart").cast("double").alias("t"), *(F.lit(0.0).alias(c) for c in ("freeway", "surface", "freeway_mi", "surface_mi", "sd")), F.lit(0).alias("stations"),
    )

    def step(acc, x):
        forecast, mph, sd = _span_at(x, acc["t"], slot_min)
        known, minutes = forecast.isNotNull(), x["miles"] / mph * 60.0
        add = lambda c, v, when: (acc[c] + F.when(when, v).otherwise(0.0)).alias(c)
        return F.struct(
            (acc["t"] + minutes).alias("t"), add("freeway", minutes, known), add("surface", minutes, ~known), add("freeway_mi", x["miles"], known), add("surface_mi", x["miles"], ~known),
            (acc["sd"] + sd).alias("sd"), (acc["stations"] + known.cast("int")).alias("stations"),
        )

    rows = departures.join(routes.hint("merge"), "route_id").withColumn("r", F.aggregate("spans", zero, step))
    total = F.col("r.t") - F.col("depart")
    return rows.select(
        "route_id", "depart", total.alias("total_minutes"), F.col("r.freeway").alias("freeway_minutes"), F.col("r.surface").alias("surface_minutes"),
        F.col("r.freeway_mi").alias("freeway_mi"), F.col("r.surface_mi").alias("surface_mi"), F.col("r.stations").alias("stations"),
        F.coalesce(F.try_divide(F.col("r.freeway"), total), F.lit(0.0)).alias("measured_share"), F.col("r.sd").alias("minutes_sd"),
    )


def band(df: DataFrame, *, total: str = "total_minutes", sd: str = "minutes_sd", freeway: str = "freeway_minutes", surface: str = "surface_minutes") -> DataFrame:
    """Adds slow and fast ends of the travel time; null without freeway minutes."""
    spread = F.col(sd) * (1.0 + F.try_divide(F.col(surface), F.col(freeway)))
    has = F.col(freeway) > 0
    return df.withColumns({"slow_minutes": F.when(has, F.col(total) + SLOW * spread), "fast_minutes": F.when(has, F.greatest(F.col(total) - FAST * spread, F.lit(1.0)))})


def minutes_sd(miles, mph, sd):
    """Deviation of a span's minutes for a deviation of its speed."""
    return miles * 60.0 * sd / F.pow(F.greatest(mph, F.lit(MPH_MIN)), 2)


def all_day(route_ids: DataFrame, *, step_min: int = 15, horizon_min: int = 1440) -> DataFrame:
    """A departure every step_min minutes for each route."""
    return route_ids.select("route_id", F.explode(F.sequence(F.lit(0), F.lit(horizon_min - step_min), F.lit(step_min))).alias("depart"))


def arrive_by(routes: DataFrame, deadlines: DataFrame, *, step_min: int = 15, back_min: int = 1440, slot_min: int = 15) -> DataFrame:
    """The latest departure on the step grid, at most back_min before the deadline and not before 0, that lands in time.

    deadlines: route_id, deadline. Returns route_id, deadline, depart, arrive, minutes, slack_minutes; none that lands, no row.
    """
    first = F.greatest(F.ceil((F.col("deadline") - back_min) / step_min), F.lit(0)) * step_min
    tries = deadlines.where("deadline >= 0").select("route_id", "deadline", F.explode(F.sequence(first, F.floor(F.col("deadline") / step_min) * step_min, F.lit(step_min))).alias("depart"))
    priced = price(routes, tries.select("route_id", "depart").distinct(), slot_min=slot_min).select("route_id", "depart", "total_minutes")
    landed = tries.join(priced.hint("merge"), ["route_id", "depart"]).where(F.col("depart") + F.col("total_minutes") <= F.col("deadline"))
    best = landed.groupBy("route_id", "deadline").agg(F.max_by(F.struct("depart", "total_minutes"), "depart").alias("b"))
    arrive = F.col("b.depart") + F.col("b.total_minutes")
    return best.select("route_id", "deadline", "b.depart", arrive.alias("arrive"), F.col("b.total_minutes").alias("minutes"), (F.col("deadline") - arrive).alias("slack_minutes"))


def way_links(ways: DataFrame, stations: DataFrame, *, k: int = 6, miles: float = 2.0) -> DataFrame:
    """way_id, station, dist_mi, weight of the k nearest stations of each way; weights of a way add up to 1."""
    links = knn(ways.select(F.col("way_id").alias("left_id"), "lat", "lon"), stations.select(F.col("sensor_id").alias("right_id"), "lat", "lon"), k=k, miles=miles)
    return idw(links).select(F.col("left_id").alias("way_id"), F.col("right_id").alias("station"), "dist_mi", "weight")


def surface_minutes(ways: DataFrame, links: DataFrame, state: DataFrame, *, alpha: float = 0.5) -> DataFrame:
    """Minutes of each way under the slowdown of the stations near it. state: station, ratio; ways: way_id, miles, maxspeed_mph."""
    ratio = links.join(state, "station").groupBy("way_id").agg(F.try_divide(F.sum(F.col("weight") * F.col("ratio")), F.sum("weight")).alias("ratio"))
    out = ways.join(ratio, "way_id", "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    mph = surface_mph(F.col("ratio"), F.col("maxspeed_mph"), alpha)
    return out.select("way_id", "miles", "ratio", mph.alias("est_mph"), (F.col("miles") / mph * 60.0).alias("minutes"))


def minutes_at(asked: DataFrame, marks: DataFrame) -> DataFrame:
    """asked (route_id, mile, ...) with the minutes interpolated between the route's marks (route_id, mile, minutes), and held at its ends.

    Asked miles and marks are put in one order by route, and each takes the marks before and after it.
    """
    m = marks.select("route_id", F.col("mile").alias("__mile"), F.struct("mile", "minutes").alias("__mark"))
    a = asked.select("route_id", F.col("mile").alias("__mile"), F.struct(*asked.columns).alias("__row"))
    every = a.unionByName(m, allowMissingColumns=True).withColumn("__asks", F.col("__row").isNotNull())
    part = Window.partitionBy("route_id").rowsBetween(Window.unboundedPreceding, 0)
    low, high = F.last("__mark", ignorenulls=True).over(part.orderBy("__mile", "__asks")), F.last("__mark", ignorenulls=True).over(part.orderBy(F.desc("__mile"), "__asks"))
    got = every.withColumns({"__low": low, "__high": high}).where("__asks")
    x, y = F.coalesce("__low", "__high"), F.coalesce("__high", "__low")
    return got.select("__row.*", interpolated(F.col("__mile"), x["mile"], x["minutes"], y["mile"], y["minutes"]).alias("minutes"))


def segments(routes: DataFrame, departures: DataFrame, *, slot_min: int = 15) -> DataFrame:
    """A row per route, departure and span: kind, miles, mph, minutes, arrive (minutes since the first slot), estimate (no station's speed). Arguments as for price()."""
    one = "array<struct<span_no:int,mph:double,minutes:double,arrive:double,estimate:boolean>>"
    zero = F.struct(F.col("depart").cast("double").alias("t"), F.array().cast(one).alias("out"))

    def step(acc, x):
        forecast, mph, _ = _span_at(x, acc["t"], slot_min)
        minutes = x["miles"] / mph * 60.0
        row = F.struct(x["span_no"].cast("int").alias("span_no"), mph.alias("mph"), minutes.alias("minutes"), (acc["t"] + minutes).alias("arrive"), forecast.isNull().alias("estimate"))
        return F.struct((acc["t"] + minutes).alias("t"), F.concat(acc["out"], F.array(row)).alias("out"))

    rows = departures.join(routes.hint("merge"), "route_id").select("route_id", "depart", "spans", F.aggregate("spans", zero, step, lambda acc: acc["out"]).alias("out"))
    both = rows.select("route_id", "depart", F.explode(F.arrays_zip("spans", "out")).alias("z"))
    return both.select("route_id", "depart", "z.out.span_no", "z.spans.kind", "z.spans.miles", "z.out.mph", "z.out.minutes", "z.out.arrive", "z.out.estimate")


def chunk_line(ways: DataFrame, chunk_mi: float = 0.4) -> DataFrame:
    """Cuts array<struct<lat, lon>> of each way into pieces of about chunk_mi: way_id, chunk_no, points.

    An ordered fold over the points of one row: a piece ends at the first point at which it is long enough.
    """
    from roadtide.functions.columns import planar_miles

    pt = "array<struct<lat:double,lon:double>>"
    zero = F.struct(F.array().cast(f"array<{pt}>").alias("done"), F.array().cast(pt).alias("cur"), F.lit(0.0).alias("mi"))

    def step(acc, p):
        last = F.get(acc["cur"], F.size(acc["cur"]) - 1)
        mi = acc["mi"] + F.coalesce(planar_miles(last["lat"], last["lon"], p["lat"], p["lon"]), F.lit(0.0))
        cur = F.concat(acc["cur"], F.array(p))
        return F.when(mi >= chunk_mi, F.struct(F.concat(acc["done"], F.array(cur)).alias("done"), F.array(p).alias("cur"), F.lit(0.0).alias("mi"))).otherwise(F.struct(acc["done"].alias("done"), cur.alias("cur"), mi.alias("mi")))

    pieces = F.aggregate(F.col("points").cast(pt), zero, step, lambda acc: F.when(F.size(acc["cur"]) > 1, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))
    return ways.select("way_id", F.posexplode(pieces).alias("chunk_no", "points"))


def governed_chunks(chunks: DataFrame, stations: DataFrame) -> DataFrame:
    """way_id, chunk_no, sensor_id, nearest_mi: the station that governs each chunk of a line, by the chunk's middle point and its heading there.

    chunks: from chunk_line(); stations (those with a forecast): sensor_id, lat, lon, bearing.
    """
    from roadtide.functions.columns import bearing
    from roadtide.operators.spatial import govern_chunks

    mid = F.floor(F.size("points") / 2).cast("int")
    at = chunks.select(F.struct("way_id", "chunk_no").alias("chunk_id"), F.get("points", mid).alias("p"), F.get("points", F.greatest(mid - 1, F.lit(0))).alias("a"), F.get("points", F.least(mid + 1, F.size("points") - 1)).alias("b"))
    headed = at.select("chunk_id", "p.lat", "p.lon", bearing(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("heading"))
    return govern_chunks(headed, stations).select("chunk_id.way_id", "chunk_id.chunk_no", "sensor_id", "nearest_mi")
