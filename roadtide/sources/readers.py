"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Layouts of the landed files, and the corridor and venue dimensions.
RAW_READING = (
    "timestamp string, station int, district int, freeway int, direction string, lane_type string, station_length double, samples int, "
    "pct_observed double, total_flow double, avg_occupancy double, avg_speed double"
)
STATION_META = "ID int, Fwy int, Dir string, Type string, Abs_PM double, Length double, Latitude double, Longitude double, Lanes int"
EVENT = "venue string, start string, has_time boolean, title string, source_url string, captured_at string, time_source string"
GAME_SCHEDULE = "dates array<struct<games: array<struct<start: string, venue: string, title: string>>>>"
WEATHER_HOURLY = "hourly struct<time: array<string>, temperature_2m: array<double>, precipitation: array<double>, wind_speed_10m: array<double>, visibility: array<double>>"
CORRIDORS = [
    ("bay-bridge-wb", "Bay Bridge WB: Berkeley to SF", 80, "W", 4.5, 12.0),
    ("bay-bridge-eb", "Bay Bridge EB: SF to Berkeley", 80, "E", 4.5, 12.0),
    ("101-nb-peninsula", "US-101 NB: San Jose to SFO", 101, "N", 389.2, 421.6),
    ("101-sb-peninsula", "US-101 SB: SFO to San Jose", 101, "S", 389.2, 421.6),
    ("880-nb", "I-880 NB: San Jose to Oakland", 880, "N", 4.5, 41.6),
    ("880-sb", "I-880 SB: Oakland to San Jose", 880, "S", 4.5, 41.6),
    ("580-wb-altamont", "I-580 WB: Altamont to Dublin", 580, "W", 17.8, 36.5),
    ("580-eb-altamont", "I-580 EB: Dublin to Altamont", 580, "E", 17.8, 36.5),
    ("237-eb", "SR-237 EB: Sunnyvale to Milpitas", 237, "E", 0.0, 12.0),
]
VENUES = [
    ("levis-stadium", "Levi's Stadium", 37.4030, -121.9698, 68500, ["237-eb", "101-nb-peninsula", "101-sb-peninsula"]),
    ("oakland-arena", "Oakland Arena / Coliseum", 37.7516, -122.2005, 46800, ["880-nb", "880-sb"]),
    ("stanford-stadium", "Stanford Stadium", 37.4347, -122.1611, 50000, ["101-sb-peninsula", "101-nb-peninsula"]),
    ("shoreline-amph", "Shoreline Amphitheatre", 37.4267, -122.0806, 22500, ["101-nb-peninsula", "101-sb-peninsula"]),
    ("oracle-park", "Oracle Park", 37.7786, -122.3893, 41900, ["bay-bridge-wb", "bay-bridge-eb"]),
    ("sap-center", "SAP Center", 37.3327, -121.9010, 17500, ["101-nb-peninsula", "880-nb"]),
    ("chase-center", "Chase Center", 37.7680, -122.3877, 18000, []),
]


def raw_readings(spark: SparkSession, path: str, *, lane_types=("ML", "HV"), min_pct_observed: float | None = None) -> DataFrame:
    """Headerless positional CSV; columns after the twelfth (per lane) are left out, bad timestamps become null."""
    df = spark.read.schema(RAW_READING).option("mode", "PERMISSIVE").csv(path)
    df = df.withColumn("ts", F.to_timestamp_ntz(F.when(F.col("timestamp").rlike(r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$"), F.col("timestamp")), F.lit("MM/dd/yyyy HH:mm:ss"))).drop("timestamp")
    if lane_types:
        df = df.where(F.col("lane_type").isin(*lane_types))
    return df if min_pct_observed is None else df.where(F.col("pct_observed") >= min_pct_observed)


def station_meta(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated station list with a header."""
    df = spark.read.schema(STATION_META).option("sep", "\t").option("header", True).csv(path)
    names = {"ID": "sensor_id", "Fwy": "fwy", "Dir": "dir", "Type": "type", "Abs_PM": "abs_pm", "Length": "length", "Latitude": "lat", "Longitude": "lon", "Lanes": "lanes"}
    return df.withColumnsRenamed(names)


def newest_snapshot(spark: SparkSession, path: str) -> str | None:
    """Address of the last file of a folder of snapshots, by its name or folder; None without files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").agg(F.max("path")).first()
    return found[0]


def day_readings(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """The day-partitioned fact over [first, last]; the dates prune partitions."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("date") >= F.lit(first).cast("date"))
    return df if last is None else df.where(F.col("date") <= F.lit(last).cast("date"))


def with_file_date(df: DataFrame, pattern: str = r"(\d{4})[_-](\d{2})[_-](\d{2})") -> DataFrame:
    """Adds date, taken from the name of the file that a row is of, or of its folder; null where neither has one."""
    name = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), pattern + r"[^/]*(?:/[^/]*)?$", 0), F.lit(""))
    return df.select("*", F.try_to_date(F.replace(F.regexp_extract(name, pattern, 0), F.lit("_"), F.lit("-")), "yyyy-MM-dd").alias("date"))


def events(spark: SparkSession, path: str, *, skip: str = r"(normalized|merged)") -> DataFrame:
    """Event rows of JSON lines files; blank lines and files derived by earlier steps are left out."""
    df = spark.read.schema(EVENT).json(path)
    return df.where(~F.col("_metadata.file_name").rlike(skip)).where("venue is not null or title is not null")


def write_events(rows: DataFrame, path: str) -> None:
    """A derived event file set: JSON lines in the order of venue and start, range by range, so that files and lines are in one order."""
    rows.repartitionByRange("venue", "start", "title").sortWithinPartitions("venue", "start", "title").write.mode("overwrite").json(path)


def derived_events(spark: SparkSession, path: str) -> DataFrame:
    """What write_events() wrote, with at: rises in the order of the lines."""
    rows = spark.read.schema(EVENT).json(path).withColumns({"__file": F.col("_metadata.file_name"), "__start": F.col("_metadata.file_block_start")})
    return rows.withColumn("at", F.struct("__file", "__start", F.monotonically_increasing_id())).drop("__file", "__start")


def game_schedules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GAME_SCHEDULE).option("multiLine", True).json(path)


def hourly_weather(df: DataFrame, json_col: str = "body", keep=("lat", "lon")) -> DataFrame:
    """Rows of hourly weather from JSON of parallel arrays; a variable that is missing is null."""
    h = F.from_json(json_col, WEATHER_HOURLY)["hourly"]
    cols = ("temperature_2m", "precipitation", "wind_speed_10m", "visibility")
    z = df.select(*keep, F.explode(F.arrays_zip(h["time"].alias("time"), *(F.coalesce(h[c], F.array().cast("array<double>")).alias(c) for c in cols))).alias("z"))
    return z.where("z.time is not null").select(*keep, F.to_timestamp_ntz(F.replace(F.col("z.time"), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm")).alias("ts"), *(F.col(f"z.{c}").alias(c) for c in cols))


#: One-key objects around a list or a record that are taken off, at most.
WRAPPERS = 4


def _members_of(v):
    """An object's members by name; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _unwrapped(v, stop: str):
    """v without the one-key objects around it; one with the key `stop` is not taken off."""
    for _ in range(WRAPPERS):
        members = _members_of(v)
        v = F.when((F.size(members) == 1) & ~F.map_contains_key(members, stop), F.map_values(members)[0]).otherwise(v)
    return v


def text_or_name(v):
    """The text of a place that is given as text or as an object with a name; null for neither."""
    return F.coalesce(F.try_variant_get(v, "$.name", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def closures(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Closure records of snapshots whose nesting is not known: the other columns, record (variant), facility and place.

    A payload is a list of records, in one-key objects or not; each record may be in one-key objects too. A single record
    counts as a list of one. Payloads that are no JSON, or have neither list nor record, give no row.
    """
    others = [c for c in df.columns if c != payload]
    whole = df.select(*others, F.try_parse_json(payload).alias("__v")).where("__v is not null").select(*others, _unwrapped(F.col("__v"), "closure").alias("__v"))
    one = F.when(F.map_contains_key(_members_of(F.col("__v")), "closure"), F.array("__v"))
    rows = whole.select(*others, F.explode(F.coalesce(F.try_variant_get("__v", "$", "array<variant>"), one)).alias("__r"))
    records = rows.select(*others, _unwrapped(F.col("__r"), "closure").alias("record")).where(_members_of(F.col("record")).isNotNull())
    return records.withColumns({"facility": F.try_variant_get("record", "$.closure.facility", "string"), "place": text_or_name(F.try_variant_get("record", "$.closure.location", "variant"))})


def write_days(df: DataFrame, path: str, *, by: str = "date") -> None:
    """A Parquet partition a day; days that the frame holds are replaced, others stay."""
    df.repartition(by).sortWithinPartitions(*[c for c in ("station", "tod") if c in df.columns]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(by).parquet(path)


def pending_days(listed: DataFrame, written: DataFrame) -> DataFrame:
    """Listed days that are not written yet, newest first."""
    return listed.select("date").distinct().join(written.select("date").distinct(), "date", "left_anti").orderBy(F.desc("date"))


def write_metrics(df: DataFrame, path: str) -> None:
    """A long table of metrics as JSON lines; an earlier one is replaced."""
    df.write.mode("overwrite").json(path)


def metrics(spark: SparkSession, path: str, schema) -> DataFrame:
    """What write_metrics() wrote."""
    return spark.read.schema(schema).json(path)


def corridor_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORRIDORS, "slug string, name string, fwy int, dir string, pm_min double, pm_max double")


def venue_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VENUES, "slug string, name string, lat double, lon double, capacity int, corridors array<string>")


def venue_corridors(venues: DataFrame) -> DataFrame:
    """A row per venue and corridor that it affects."""
    return venues.select(F.col("slug").alias("venue"), F.explode("corridors").alias("corridor"))
