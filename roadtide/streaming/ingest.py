"""Incremental ingest and windowed live readings with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtide.operators.seasonal import merge_sums, partial_sums
from roadtide.sources.commits import commit, committed, names, remove


def ingest_new_files(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform=None) -> None:
    """Appends the files that have landed since the last call to a day-partitioned sink, each exactly once."""
    stream = spark.readStream.schema(schema).parquet(source)
    out = transform(stream) if transform else stream
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).partitionBy("date").trigger(availableNow=True).start().awaitTermination()


#: Columns of the sums that are kept.
SUMS = "station int, dow int, tod int, n long, s1 double, s2 double"


def _base(spark: SparkSession, state: str) -> tuple[int, str | None]:
    """The last batch that the newest committed base holds (-1: none), and the base's folder."""
    last = max((int(n.removeprefix("base=")) for n in committed(spark, state) if n.startswith("base=")), default=-1)
    return last, f"{state}/base/{last:012d}" if last >= 0 else None


def accumulate_profile(spark: SparkSession, source: str, schema, state: str, checkpoint: str) -> None:
    """Keeps mergeable sums (n, sum, sum of squares) by key up to date with new files, as a log of deltas.

    A batch writes the sums of its own rows only, to a folder named by its number: one that runs again writes the same,
    and one that a base already holds writes nothing. compact_profile() folds the deltas into a base.
    """

    def fold(batch: DataFrame, number: int) -> None:
        if number > _base(spark, state)[0]:
            partial_sums(batch).write.mode("overwrite").parquet(f"{state}/delta/{number:012d}")

    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _open_deltas(spark: SparkSession, state: str) -> list[str]:
    last, _ = _base(spark, state)
    return [n for n in names(spark, f"{state}/delta") if int(n) > last and "_SUCCESS" in names(spark, f"{state}/delta/{n}")]


def newest_state(spark: SparkSession, state: str) -> DataFrame:
    """The sums after the last finished batch: the newest base and the deltas behind it."""
    _, base = _base(spark, state)
    folders = [f"{state}/delta/{n}" for n in _open_deltas(spark, state)] + ([base] if base else [])
    if not folders:
        return spark.createDataFrame([], SUMS)
    return merge_sums(spark.read.parquet(*folders))


def compact_profile(spark: SparkSession, state: str) -> bool:
    """Folds the deltas into a new base; False if there are none.

    The base is written first and counts from its commit on; what it holds is deleted after, but for the base before,
    which a reader may still be at.
    """
    last, before = _base(spark, state)
    deltas = _open_deltas(spark, state)
    if not deltas:
        return False
    upto = int(deltas[-1])
    newest_state(spark, state).write.mode("overwrite").parquet(f"{state}/base/{upto:012d}")
    commit(spark, state, f"base={upto:012d}")
    for n in deltas:
        remove(spark, f"{state}/delta/{n}")
    for n in names(spark, f"{state}/base"):
        if int(n) < last:
            remove(spark, f"{state}/base/{n}")
    return True


#: Members of corridors that are broadcast at most.
MAX_BROADCAST_MEMBERS = 100_000


def live_corridors(spark: SparkSession, source: str, schema, members: DataFrame, sink: str, checkpoint: str, *, every: str = "15 minutes", late: str = "30 minutes") -> None:
    """Corridor times of tumbling windows from readings that land as files (station, ts, speed), appended to a Parquet sink.

    A window's mean speed of each station, then the minutes over the stations of a corridor, scaled to its whole length:
    corridor, window_start, raw_minutes, n_stations, coverage, minutes. A window is given once, when the watermark (the
    newest time less `late`) has passed its end; readings of such a window that come later are dropped. The call ends
    when the landed files are done; the next one goes on from the checkpoint, where the open windows are kept.
    members: slug, sensor_id, length; it stays the same for all calls. They are broadcast up to MAX_BROADCAST_MEMBERS rows;
    beyond it both sides are dealt by station. Which side is told, as a batch without new files, which gives the windows that
    are over, looks empty to the planner: it would send all of those windows through the driver.
    """
    whole = members.groupBy("slug").agg(F.sum("length").alias("total_mi"))
    static = members.join(whole, "slug").select("slug", F.col("sensor_id").alias("station"), "length", "total_mi")
    live = spark.readStream.schema(schema).parquet(source).where("speed > 0").withWatermark("ts", late)
    means = live.groupBy(F.window("ts", every).alias("w"), "station").agg(F.avg("speed").alias("mph"))
    few = members.limit(MAX_BROADCAST_MEMBERS + 1).count() <= MAX_BROADCAST_MEMBERS
    known = means.withColumn("at", F.window_time("w")).join(F.broadcast(static) if few else static.hint("merge"), "station")
    per = known.groupBy(F.window("at", every).alias("w"), F.col("slug").alias("corridor")).agg(
        F.sum(F.col("length") / F.col("mph") * 60.0).alias("raw_minutes"), F.count("*").alias("n_stations"), F.sum("length").alias("mi"), F.max("total_mi").alias("total_mi"),
    )
    coverage = F.col("mi") / F.col("total_mi")
    out = per.select("corridor", F.col("w.start").alias("window_start"), "raw_minutes", "n_stations", coverage.alias("coverage"), (F.col("raw_minutes") / coverage).alias("minutes"))
    out.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_snapshots(stream: DataFrame, sink: str, checkpoint: str, captured: str = "captured_at") -> None:
    """Point-in-time snapshots kept append-only by capture date."""
    dated = stream.withColumn("capture_date", F.to_date(captured))
    dated.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).partitionBy("capture_date").trigger(availableNow=True).start().awaitTermination()


def as_of(snapshots: DataFrame, keys, at, captured: str = "captured_at") -> DataFrame:
    """The latest snapshot of each key captured by a time."""
    rows = snapshots.where(F.col(captured) <= F.lit(at))
    others = [c for c in snapshots.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(captured)).alias("s")).select(*keys, "s.*")


def windowed(readings: DataFrame, *, ts: str = "ts", key: str = "station", value: str = "value", every: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Tumbling windows of live readings: key, window_start, n, mean. Works on batches and on streams; on a stream, rows later than the watermark are dropped."""
    df = readings.withWatermark(ts, late) if readings.isStreaming else readings
    return df.groupBy(key, F.window(ts, every).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(key, F.col("w.start").alias("window_start"), "n", "mean")
