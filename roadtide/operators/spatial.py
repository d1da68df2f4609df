"""Spatial joins on grid cells: within a radius, k nearest, and matching of routes to stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtide.functions.columns import IDW_FLOOR_MI, MI_PER_LAT, MI_PER_LON, angle_between, bearing, cell_centre, direction_bearing, planar_miles
from roadtide.session import written

#: Match and link limits (fixed values).
TOLERANCE_MI, MAX_BEARING, RADIUS_MI, MAX_STATIONS, MAX_EVENT_MI = 0.10, 65.0, 2.0, 6, 12.0
CHUNK_BEARING, ASSIGN_MI, RENDER_MI, CHUNK_NEAR = 70.0, 4.0, 8.0, 14


def in_cells(df: DataFrame, lat: str, lon: str, miles: float, narrow: float | None = None) -> DataFrame:
    """Adds the grid cell (cy, cx) of sides of at least so many planar miles.

    narrow: where miles are measured on the sphere instead, the least cosine of the latitudes.
    """
    across = MI_PER_LON if narrow is None else MI_PER_LAT * narrow
    return df.withColumns({"cy": F.floor(F.col(lat) * (MI_PER_LAT * 0.999 / miles)).cast("long"), "cx": F.floor(F.col(lon) * (across * 0.9 / miles)).cast("long")})


def with_neighbours(df: DataFrame, lat: str, lon: str, miles: float, narrow: float | None = None) -> DataFrame:
    """A row for the cell of each row and each of the eight around it."""
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cells = in_cells(df, lat, lon, miles, narrow)
    return cells.withColumn("__dy", F.explode(step)).withColumn("__dx", F.explode(step)).withColumns({"cy": F.col("cy") + F.col("__dy"), "cx": F.col("cx") + F.col("__dx")}).drop("__dy", "__dx")


def within(left: DataFrame, right: DataFrame, *, miles: float) -> DataFrame:
    """All pairs (left_id, right_id, dist_mi) within so many planar miles.

    left: left_id, lat, lon; right: right_id, lat, lon. The right side is copied to neighbouring cells, so the join is
    an equi-join whose size follows the local density.
    """
    l = in_cells(left.select("left_id", F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon")), "l_lat", "l_lon", miles)  # noqa: E741
    r = with_neighbours(right.select("right_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")), "r_lat", "r_lon", miles)
    d = planar_miles(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    return l.join(r, ["cy", "cx"]).withColumn("dist_mi", d).where(F.col("dist_mi") <= miles).select("left_id", "right_id", "dist_mi")


def knn(left: DataFrame, right: DataFrame, *, k: int = MAX_STATIONS, miles: float = RADIUS_MI) -> DataFrame:
    """left_id, right_id, dist_mi, rank of the k nearest within the radius; ties go to the smaller id.

    Only places meet: rows of the left side at one place have the same nearest ones, which are looked for once, and of
    the right side's rows at one place the k smallest ids can be among them. So copies on either side make no pairs.
    """
    at = Window.partitionBy("lat", "lon").orderBy("right_id")
    few = right.select("right_id", "lat", "lon").withColumn("__no", F.row_number().over(at)).where(F.col("__no") <= k)
    spots = few.groupBy("lat", "lon").agg(F.collect_list("right_id").alias("ids")).select(F.struct("lat", "lon", "ids").alias("right_id"), "lat", "lon")
    asked = left.select("lat", "lon").distinct().select(F.struct("lat", "lon").alias("left_id"), "lat", "lon")
    w = Window.partitionBy("left_id").orderBy("dist_mi", "right_id")
    links = within(asked, spots, miles=miles).select("left_id", "dist_mi", F.explode("right_id.ids").alias("right_id"))
    links = links.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return left.select("left_id", "lat", "lon").join(links.select("left_id.lat", "left_id.lon", "right_id", "dist_mi", "rank"), ["lat", "lon"]).select("left_id", "right_id", "dist_mi", "rank")


def idw(links: DataFrame, *, floor_mi: float = IDW_FLOOR_MI) -> DataFrame:
    """Adds weight: inverse squared distance, scaled to 1 by left_id."""
    raw = 1.0 / F.pow(F.greatest(F.col("dist_mi"), F.lit(floor_mi)), 2)
    return links.withColumn("weight", raw / F.sum(raw).over(Window.partitionBy("left_id")))


#: Rows of a dimension that every row may be held against.
DIMENSION = 1000


def nearest(left: DataFrame, right: DataFrame, distance) -> DataFrame:
    """The nearest row of a short list `right` (right_id, r_lat, r_lon) for each of left (left_id, lat, lon): left_id, right_id, dist.

    right is a dimension of fixed size (venues) of DIMENSION rows at most, which is checked; longer lists are for nearest_in_grid.
    """
    if right.limit(DIMENSION + 1).count() > DIMENSION:
        raise ValueError(f"more than {DIMENSION} rows to choose from; use nearest_in_grid")
    pairs = left.join(F.broadcast(right)).withColumn("dist", distance)
    return pairs.groupBy("left_id").agg(F.min_by(F.struct("right_id", "dist"), F.struct("dist", "right_id")).alias("b")).select("left_id", "b.right_id", "b.dist")


def nearest_in_grid(left: DataFrame, right: DataFrame, step: float, *, digits: int = 9) -> DataFrame:
    """The nearest row of right (right_id, r_lat, r_lon) for each of left (left_id, lat, lon) by squared degrees: left_id, right_id, dist.

    Both meet in grid cells of `step` degrees and their neighbours. What is found within a cell's width is certain; the
    rest is asked again in cells twice as wide, so each round reads only rows that are still open.
    Squares are rounded, so that ties go to the smaller right_id. Without rows in right the result is empty.
    """
    found, open_, size = None, left, step
    spread = right.agg((F.max("r_lat") - F.min("r_lat")).alias("a"), (F.max("r_lon") - F.min("r_lon")).alias("b")).first()
    far = left.agg((F.max(F.abs("lat")) + F.max(F.abs("lon"))).alias("m")).first().m
    most = 0.0 if spread.a is None or far is None else spread.a + spread.b + 2 * far + 720.0
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    while True:
        cell = lambda c, s=size: F.floor(F.col(c) / s).cast("long")
        near = right.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around)).select("right_id", "r_lat", "r_lon", (cell("r_lat") + F.col("dy")).alias("cy"), (cell("r_lon") + F.col("dx")).alias("cx"))
        pairs = open_.withColumns({"cy": cell("lat"), "cx": cell("lon")}).join(near, ["cy", "cx"], "left")
        d2 = F.round(F.pow(F.col("lat") - F.col("r_lat"), 2) + F.pow(F.col("lon") - F.col("r_lon"), 2), digits)
        best = pairs.withColumn("dist", d2).groupBy("left_id").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.min_by(F.struct("right_id", "dist"), F.when(F.col("right_id").isNotNull(), F.struct("dist", "right_id"))).alias("b"))
        best = written(best)  # a round is computed once, not again by each that follows
        sure = F.coalesce(F.col("b.dist") < size * size - 10.0**-digits, F.lit(False)) if size <= most else F.lit(True)
        done = best.where(sure & F.col("b.right_id").isNotNull()).select("left_id", "b.right_id", "b.dist")
        found = done if found is None else found.union(done)
        open_ = best.where(~sure).select("left_id", "lat", "lon")
        if size > most or open_.isEmpty():
            return found
        size *= 2


def occupied_cells(points: DataFrame, step: float = 0.25) -> DataFrame:
    """Centres of the grid cells that hold a point."""
    return points.select(cell_centre(F.col("lat"), step).alias("lat"), cell_centre(F.col("lon"), step).alias("lon")).distinct()


def station_bearings(stations: DataFrame) -> DataFrame:
    """Adds bearing: from the station before to the one after on its freeway and direction, turned round for S and W where postmiles fall; the signed direction for a lone station."""
    w = Window.partitionBy("fwy", "dir").orderBy("abs_pm", "sensor_id")
    at = {n: F.coalesce(f(c).over(w), F.col(c)) for n, f, c in (("a", F.lag, "lat"), ("b", F.lag, "lon"), ("c", F.lead, "lat"), ("d", F.lead, "lon"))}
    drawn = bearing(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    turned = F.when(F.col("dir").isin("S", "W"), F.pmod(drawn + 180.0, F.lit(360.0))).otherwise(drawn)
    lone = (F.col("a") == F.col("c")) & (F.col("b") == F.col("d"))
    return stations.withColumns(at).withColumn("bearing", F.when(lone, direction_bearing(F.col("dir"))).otherwise(turned)).drop(*at)


def along(vertices: DataFrame) -> DataFrame:
    """Adds cum_mi (planar miles from the route's start) and heading (to the next vertex; the last keeps its own) to route_id, seq, lat, lon."""
    w = Window.partitionBy("route_id").orderBy("seq")
    leg = F.coalesce(planar_miles(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    head = bearing(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    back = bearing(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    out = vertices.withColumns({"leg_mi": leg, "heading": F.coalesce(head, back)})
    return out.withColumn("cum_mi", F.sum("leg_mi").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def match_routes(vertices: DataFrame, stations: DataFrame, *, tolerance_mi: float = TOLERANCE_MI, max_bearing: float = MAX_BEARING) -> DataFrame:
    """Stations that lie on a route and head its way: route_id, sensor_id, along_mi, off_mi, of the nearest vertex.

    vertices: from along(); stations: with bearing.
    """
    v = in_cells(vertices, "lat", "lon", tolerance_mi)
    s = with_neighbours(stations.select("sensor_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "bearing"), "s_lat", "s_lon", tolerance_mi)
    d = planar_miles(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    near = v.join(s, ["cy", "cx"]).withColumn("off_mi", d).where((F.col("off_mi") <= tolerance_mi) & (angle_between(F.col("heading"), F.col("bearing")) <= max_bearing))
    best = F.min_by(F.struct(F.col("cum_mi").alias("along_mi"), "off_mi"), F.struct("off_mi", "seq"))
    return near.groupBy("route_id", "sensor_id").agg(best.alias("b")).select("route_id", "sensor_id", "b.along_mi", "b.off_mi")


def governing(stations: DataFrame, *, max_bearing: float = MAX_BEARING) -> DataFrame:
    """Of the stations at one place and bearing the one with the largest sensor_id: sensor_id, lat, lon, bearing.

    They match the same vertices of a route, and of stations at one mile only the last by id has a stretch behind it, so
    spans built from these are those of all stations. Where a match may turn by max_bearing of 180 degrees or more, every
    bearing fits, and one station a place is left.
    """
    last = F.max_by(F.struct("sensor_id", "bearing"), "sensor_id").alias("s")
    keys = ["lat", "lon"] if max_bearing >= 180 else ["lat", "lon", "bearing"]
    return stations.where("bearing is not null").groupBy(*keys).agg(last).select("s.sensor_id", "lat", "lon", "s.bearing")


def govern_chunks(chunks: DataFrame, stations: DataFrame, *, k: int = CHUNK_NEAR, assign_mi: float = ASSIGN_MI, render_mi: float = RENDER_MI, max_bearing: float = CHUNK_BEARING) -> DataFrame:
    """The station that governs each chunk of freeway: nearest of the k nearest with an agreeing heading within assign_mi; chunks with no station within render_mi are dropped.

    chunks: chunk_id, lat, lon, heading; stations (those with a forecast): sensor_id, lat, lon, bearing.
    """
    links = knn(chunks.select(F.col("chunk_id").alias("left_id"), "lat", "lon"), stations.select(F.col("sensor_id").alias("right_id"), "lat", "lon"), k=k, miles=render_mi)
    full = links.join(chunks.select(F.col("chunk_id").alias("left_id"), "heading"), "left_id").join(stations.select(F.col("sensor_id").alias("right_id"), "bearing"), "right_id")
    fits = (F.col("dist_mi") <= assign_mi) & (angle_between(F.col("heading"), F.col("bearing")) <= max_bearing)
    return full.groupBy(F.col("left_id").alias("chunk_id")).agg(F.min_by(F.when(fits, F.col("right_id")), F.when(fits, F.struct("dist_mi", "right_id"))).alias("sensor_id"), F.min("dist_mi").alias("nearest_mi"))
