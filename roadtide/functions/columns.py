"""Column functions of the travel-time domain: time keys, event titles, speeds and geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, limits and patterns that results depend on.
RAIN_HEAVY, RAIN_LIGHT = 2.5, 0.2
MPH_MIN, MPH_MAX = 5.0, 80.0
RATIO_MIN, RATIO_MAX = 0.15, 1.05
IDW_FLOOR_MI = 0.15
MI_PER_LAT, MI_PER_LON = 69.0, 54.6
KM_TO_MI = 0.621371
DEFAULT_START = "T19:00:00"
TIME_ZONE = "America/Los_Angeles"
DEFAULT_MAXSPEED = {"motorway": 65.0, "trunk": 45.0, "primary": 35.0, "secondary": 35.0, "tertiary": 30.0}
OTHER_MAXSPEED = 30.0
LEVELS = (0.95, 0.85, 0.70, 0.50)
BEARINGS = {"N": 0.0, "E": 90.0, "S": 180.0, "W": 270.0}
TITLE_RULES = (
    ("nfl", ("49ers", "week-")),
    ("soccer", ("earthquakes", " sc", "fc ")),
    ("hockey", ("sharks", "barracuda")),
    ("basketball", ("warriors", "nba")),
    ("baseball", ("giants",)),
    ("college", ("stanford",)),
)
CANCELLED = r"(?i)^\s*(cancell?ed|postponed|rescheduled)\b|\b(cancell?ed|postponed)\s*$"
NON_EVENT = (
    r"(?i)season tickets?|wait\s*list|protocol update|events? calendar|filter by|expand_more|parking|gift card|newsletter|subscribe|"
    r"group tickets?|suite (rental|holder)|private events?|^more events?$|^calendar$|^events?$"
)
WEEKDAY = r"^\s*(?:mon|tues|wednes|thurs|fri|satur|sun)day\s+[a-z]+\s+\d{1,2}\s*[•·|-]\s*"
EMBEDDED = r"(?i)^\s*(?:mon|tues|wednes|thurs|fri|satur|sun)day\s+[a-z]+\s+\d{1,2}\s*[•·|-]\s*(\d{1,2}):(\d{2})\s*(am|pm)\s*[•·|-]\s*(?:[^-•·|]{0,40}[•·|-]\s*)?(.+)$"
TRAILING_DATES = r"(?i)(\s*[-–]\s*(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*\d{1,2}\s*)+$"
LEADING_FRAGMENT = r"^[\s/,\-]*(20\d{2})?\s*[-–]\s*"


# Time keys

def tod(ts) -> Column:
    """Minutes since midnight."""
    return F.hour(ts) * 60 + F.minute(ts)


def time_keys(ts) -> dict[str, Column]:
    """date, dow (Monday 0), tod, month and is_weekend of a timestamp."""
    return {"date": F.to_date(ts), "dow": F.weekday(ts), "tod": tod(ts), "month": F.month(ts), "is_weekend": F.weekday(ts) >= 5}


def slot_of(minutes, slot_min: int = 15) -> Column:
    return F.floor(minutes / slot_min).cast("int")


def slot_floor(ts, slot_min: int = 15) -> Column:
    """The timestamp floored to its slot."""
    return F.date_trunc("DAY", ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), slot_of(tod(ts), slot_min) * slot_min)


def hhmm(minutes) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)).cast("int"))


def is_peak(minutes, *, morning=(420, 595), evening=(900, 1135)) -> Column:
    """Peak by minutes since midnight, ends inclusive; publishing uses evening=(960, 1135)."""
    return minutes.between(*morning) | minutes.between(*evening)


def plausible_time(ts) -> Column:
    """Not midnight, and on the five-minute grid."""
    return ~((F.hour(ts) == 0) & (F.minute(ts) == 0)) & (F.minute(ts) % 5 == 0)


def to_local(stamp, zone: str = TIME_ZONE) -> Column:
    """Local wall clock of an ISO string: offsets are converted, naive times and dates stay."""
    plain = F.regexp_replace(stamp, r"\.\d+", "")
    shifted = plain.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & plain.contains("T")
    local = F.date_format(F.from_utc_timestamp(F.try_to_timestamp(plain), zone), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(shifted, local).otherwise(plain)


# Events

def event_type(title) -> Column:
    """The first rule of TITLE_RULES with a word in the title; concert without one."""
    t = F.lower(F.coalesce(title, F.lit("")))
    out = None
    for name, needles in TITLE_RULES:
        hit = F.lit(False)
        for w in needles:
            hit = hit | t.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("concert")


def rain_class(mm) -> Column:
    return F.when(mm.isNull(), "unknown").when(mm >= RAIN_HEAVY, "rain_heavy").when(mm >= RAIN_LIGHT, "rain_light").otherwise("dry")


def event_start(start) -> Column:
    """A date without a time starts at 19:00."""
    return F.when(start.contains("T"), start).otherwise(F.concat(start, F.lit(DEFAULT_START)))


def is_cancelled(title) -> Column:
    return title.rlike(CANCELLED)


def is_non_event(title) -> Column:
    return title.isNull() | (F.trim(title) == "") | title.rlike(NON_EVENT)


def _tidy(title) -> Column:
    return F.btrim(title, F.lit(" -•·|"))


def embedded_time(title) -> Column:
    """HH:MM that a title carries after its date; null without one."""
    hour = F.regexp_extract(title, EMBEDDED, 1)
    h24 = F.when(hour != "", F.try_mod(hour.try_cast("int"), F.lit(12)) + F.when(F.lower(F.regexp_extract(title, EMBEDDED, 3)) == "pm", 12).otherwise(0))
    return F.when(title.rlike(EMBEDDED), F.concat(F.lpad(h24.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract(title, EMBEDDED, 2)))


def bare_title(title) -> Column:
    """The title without a leading weekday, date and time."""
    return F.when(title.rlike(EMBEDDED), _tidy(F.regexp_extract(title, EMBEDDED, 4))).otherwise(_tidy(F.regexp_replace(title, "(?i)" + WEEKDAY, "")))


def clean_title(title) -> Column:
    """The title without a stray leading year and without trailing dates."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, LEADING_FRAGMENT, ""), TRAILING_DATES, ""))


def dedupe_key(title) -> Column:
    """Lower-case ASCII letters and digits of a title, 40 at most; see titles.folded for accents."""
    return F.left(F.regexp_replace(F.lower(title), "[^a-z0-9]", ""), F.lit(40))


# Speeds

def pace(mph) -> Column:
    """Minutes per mile, for speeds held within 5 to 80 mph."""
    return 60.0 / F.least(F.greatest(mph, F.lit(MPH_MIN)), F.lit(MPH_MAX))


def mph_of_pace(minutes_per_mile) -> Column:
    return 60.0 / F.least(F.greatest(minutes_per_mile, F.lit(60.0 / MPH_MAX)), F.lit(60.0 / MPH_MIN))


def flow_ratio(mph, freeflow) -> Column:
    """Share of the free-flow speed within its limits; null where either is not known."""
    share = F.try_divide(mph, freeflow)
    return F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(RATIO_MIN)), F.lit(RATIO_MAX)))


def surface_mph(ratio, limit, alpha: float = 0.5) -> Column:
    """Speed on a street that takes a part alpha of the freeway's slowdown."""
    factor = 1.0 - alpha * (1.0 - ratio)
    return F.greatest(F.least(limit * factor, limit), F.lit(MPH_MIN))


def maxspeed_mph(tag, highway, defaults: dict[str, float] = DEFAULT_MAXSPEED) -> Column:
    """Speed limit of a tag such as `35 mph` or `50` (km/h); without one the road class's default, which is OTHER_MAXSPEED for classes that have none."""
    digits = F.regexp_replace(tag, r"\D", "").try_cast("double")
    fallback = F.lit(OTHER_MAXSPEED)
    for name, mph in defaults.items():
        fallback = F.when(highway == name, mph).otherwise(fallback)
    return F.coalesce(F.when(F.lower(tag).contains("mph"), digits).otherwise(digits * KM_TO_MI), fallback)


def service_level(ratio) -> Column:
    """1 (free) to 5 (jammed) by the share of free-flow speed."""
    out = F.when(ratio >= LEVELS[0], 1)
    for i, least in enumerate(LEVELS[1:], 2):
        out = out.when(ratio >= least, i)
    return out.otherwise(5)


def delta_class(delta, tolerance: float = 0.5) -> Column:
    return F.when(delta > tolerance, "up").when(delta < -tolerance, "down").otherwise("same")


# Geometry

def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Compass bearing from the first point to the second, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360.0, F.lit(360.0))


def angle_between(a, b) -> Column:
    """Difference of two bearings, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def planar_miles(lat1, lon1, lat2, lon2, per_lon: float = MI_PER_LON) -> Column:
    return F.sqrt(F.pow((lat2 - lat1) * MI_PER_LAT, 2) + F.pow((lon2 - lon1) * per_lon, 2))


def equirect_miles(lat1, lon1, lat2, lon2) -> Column:
    return F.sqrt(F.pow((lat2 - lat1) * MI_PER_LAT, 2) + F.pow((lon2 - lon1) * MI_PER_LAT * F.cos(F.radians(lat1)), 2))


def direction_bearing(direction) -> Column:
    out = F.lit(None).cast("double")
    for name, deg in BEARINGS.items():
        out = F.when(direction == name, deg).otherwise(out)
    return out


def cell_centre(x, step: float = 0.25) -> Column:
    return F.round(F.floor(x / step) * step + step / 2, 3)


def coordinate_key(lat, lon, digits: int = 2) -> Column:
    return F.concat_ws(",", F.round(lat, digits).cast("string"), F.round(lon, digits).cast("string"))


def place_key(lat, lon, name) -> dict[str, Column]:
    """What two results for one place agree in: coordinates of four digits and 24 letters of the name."""
    return {"key_lat": F.round(lat, 4), "key_lon": F.round(lon, 4), "key_name": F.lower(F.left(name, F.lit(24)))}


def in_box(lat, lon, south: float, west: float, north: float, east: float) -> Column:
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def line_length(points) -> Column:
    """Planar miles of array<struct<lat, lon>>."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    legs = F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), lambda a, b: planar_miles(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.aggregate(legs, F.lit(0.0), lambda x, y: x + y)


def interpolated(x, x0, y0, x1, y1) -> Column:
    """Linear value at x between two marks; held at the first mark where they coincide."""
    return y0 + F.coalesce(F.try_divide(x - x0, x1 - x0), F.lit(0.0)) * (y1 - y0)


COS_37 = math.cos(math.radians(37.0))
