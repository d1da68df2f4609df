"""Venue events: cleaning, merging of observations, league times, and extraction from archived pages."""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from roadtide.functions.columns import bare_title, clean_title, embedded_time, is_cancelled, is_non_event, plausible_time, to_local
from roadtide.session import written


@F.pandas_udf(StringType())
def folded(titles: pd.Series) -> pd.Series:
    """Dedupe key with accents folded away: decomposed, lower case, letters and digits of all scripts, 40 at most."""

    def one(t):
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t).lower() if c.isalnum())[:40]

    return titles.map(one)


def _pinned(df: DataFrame, columns: dict) -> DataFrame:
    """Adds columns behind a generator, which the optimizer does not see through: expressions that are used many times stay computed once."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def labelled(raw: DataFrame) -> DataFrame:
    """Adds title, start and has_time as cleaned, reason (non_event, cancelled, time_recovered, time_demoted or kept), and whether a time was recovered and demoted, which may both be.

    raw: venue, start (ISO string), has_time, title, captured_at.
    """
    title = F.trim(F.coalesce("title", F.lit("")))
    has = F.coalesce("has_time", F.lit(False))
    df = _pinned(_pinned(raw, {"__t": title, "__has": has}), {"__found": embedded_time(F.col("__t")), "__bare": bare_title(F.col("__t"))})
    gone = F.when(is_non_event(F.col("__t")) | (~is_cancelled(F.col("__t")) & (F.col("__bare") == "")), "non_event").when(is_cancelled(F.col("__t")), "cancelled")
    recovered = F.col("__found").isNotNull() & ~F.col("__has")
    start = F.when(recovered, F.concat(F.left("start", F.lit(10)), F.lit("T"), F.col("__found"), F.lit(":00"))).otherwise(F.col("start"))
    df = _pinned(df, {"__gone": gone, "__recovered": recovered, "__start": start})
    timed = F.col("__has") | F.col("__recovered")
    parsed = F.try_to_timestamp(F.regexp_replace(F.left("__start", F.lit(19)), "T", " "))
    demoted = timed & ~F.coalesce(plausible_time(parsed), F.lit(False))
    df = _pinned(df, {"__demoted": demoted, "__timed": timed})
    reason = F.coalesce("__gone", F.when(F.col("__demoted"), "time_demoted").when(F.col("__recovered"), "time_recovered").otherwise("kept"))
    other = [c for c in raw.columns if c not in ("title", "start", "has_time")]
    return df.select(
        *other, F.col("__bare").alias("title"), F.when(F.col("__demoted"), F.left("__start", F.lit(10))).otherwise(F.col("__start")).alias("start"),
        (F.col("__timed") & ~F.col("__demoted")).alias("has_time"), reason.alias("reason"),
        (F.col("__gone").isNull() & F.col("__recovered")).alias("recovered"), (F.col("__gone").isNull() & F.col("__demoted")).alias("demoted"),
    )


def merge_observations(rows: DataFrame, key=None) -> DataFrame:
    """One event per venue, day and key: the earliest captured row, with the time of the earliest timed one if it has none.

    The result does not depend on the order of the input.
    """
    key = folded(F.col("title")) if key is None else key
    keyed = rows.withColumns({"__day": F.left("start", F.lit(10)), "__key": key})
    rank = F.struct("captured_at", "title", "start")
    out = keyed.groupBy("venue", "__day", "__key").agg(
        F.min_by(F.struct("title", "start", "has_time", "captured_at"), rank).alias("a"),
        F.min_by(F.when(F.col("has_time"), F.col("start")), F.when(F.col("has_time"), rank)).alias("timed"),
        F.count("*").alias("observations"),
    )
    borrow = ~F.col("a.has_time") & F.col("timed").isNotNull()
    return out.select("venue", "a.title", F.when(borrow, F.col("timed")).otherwise(F.col("a.start")).alias("start"), (F.col("a.has_time") | borrow).alias("has_time"), "a.captured_at", "observations")


def normalize(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean events, and counts of the rows by what became of them: in, non_event, cancelled, time_recovered, time_demoted, deduped and out."""
    rows = labelled(raw)
    clean = merge_observations(rows.where(~F.col("reason").isin("non_event", "cancelled")))
    tally = rows.agg(
        F.count("*").alias("in"), F.count_if(F.col("reason") == "non_event").alias("non_event"), F.count_if(F.col("reason") == "cancelled").alias("cancelled"),
        F.count_if("recovered").alias("time_recovered"), F.count_if("demoted").alias("time_demoted"),
    )
    merged = clean.agg((F.coalesce(F.sum("observations"), F.lit(0)) - F.count("*")).alias("deduped"), F.count("*").alias("out"))
    names = ("in", "non_event", "cancelled", "time_recovered", "time_demoted", "deduped", "out")
    return clean, tally.join(F.broadcast(merged)).select(F.inline(F.array(*(F.struct(F.lit(n).alias("reason"), F.col(n).alias("rows")) for n in names))))


def merge_league(events: DataFrame, games: DataFrame) -> DataFrame:
    """Crawled events with start times filled from the league's (earliest game of the venue and day), and the games that no event covers.

    Adds time_source: crawl, league or null.
    """
    day = lambda c: F.left(c, F.lit(10))
    first = games.groupBy("venue", day(F.col("start")).alias("__day")).agg(F.min_by(F.struct(F.col("start").alias("start"), F.col("title").alias("title")), F.struct("start", "title")).alias("g"))
    crawled = events.withColumn("__day", day(F.col("start"))).join(first, ["venue", "__day"], "left")
    fill = ~F.col("has_time") & F.col("g.start").contains("T")
    filled = crawled.select("venue", "title", F.when(fill, F.col("g.start")).otherwise(F.col("start")).alias("start"), (F.col("has_time") | F.coalesce(fill, F.lit(False))).alias("has_time"), F.when(fill, "league").when(F.col("has_time"), "crawl").alias("time_source"))
    missing = first.join(events.select("venue", day(F.col("start")).alias("__day")).distinct(), ["venue", "__day"], "left_anti")
    return filled.unionByName(missing.select("venue", "g.title", "g.start", F.col("g.start").contains("T").alias("has_time"), F.lit("league").alias("time_source")))


# Tokens of calendar pages, and words that say nothing about a venue.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_TOKEN = "(?i)^(" + "|".join(MONTHS) + r")[a-z]*\.?$"
DAY_TOKEN, YEAR_TOKEN, TIME_TOKEN, STRAY_TOKEN = r"^\d{1,2}$", r"^,?\s*(20\d{2})$", r"(?i)^(\d{1,2}):(\d{2})\s*(am|pm)$", r"^[\d\s,.\-]+$"
STOP_TOKEN = r"(?i)^(buy tickets|tickets|details|more info|event starts|buy|info|group tickets|learn more|sold out|on sale.*)$"
PLAIN_WORDS = ("stadium", "center", "centre", "arena", "park", "amphitheatre")
TITLE_PARTS, LEAST_STRUCTURED = 6, 3


#: Events that are sent on at once.
EVENTS_AT_ONCE = 10_000


def members(text: str) -> Iterator:
    """The values of a JSON text, one at a time where it is a list; ValueError where it is broken."""
    white, decoder = re.compile(r"[ \t\n\r]*"), json.JSONDecoder()
    past = lambda at: white.match(text, at).end()
    at = past(0)
    if text[at : at + 1] != "[":
        yield json.loads(text)
        return
    at = past(at + 1)
    if text[at : at + 1] != "]":
        while True:
            value, at = decoder.raw_decode(text, at)
            yield value
            at = past(at)
            if text[at : at + 1] != ",":
                break
            at = past(at + 1)
    if text[at : at + 1] != "]" or past(at + 1) != len(text):
        raise ValueError("not a list")


def json_ld_events(pages: DataFrame) -> DataFrame:
    """Events in the JSON-LD blocks of archived pages: page_id, start, title, location, has_time. One row per page, start, title and location.

    Python gets the blocks alone and reads the members of a list one at a time; a broken block is passed over.
    """

    def flat(node):
        if isinstance(node, list):
            for x in node:
                yield from flat(x)
        elif isinstance(node, dict):
            if node.get("startDate") and "Event" in str(node.get("@type", "")):
                yield node
            for v in node.values():
                if isinstance(v, (dict, list)):
                    yield from flat(v)

    def place(x):
        if isinstance(x, dict):
            return " ".join(p for p in (place(x.get(k)) for k in ("name", "address", "streetAddress", "addressLocality", "addressRegion")) if p)
        return " ".join(map(place, x)) if isinstance(x, list) else str(x or "")

    def found(text):
        for value in members(text):
            for e in flat(value):
                start = str(e["startDate"])
                yield start, str(e.get("name") or "").strip(), place(e.get("location")), "T" in start

    def whole(text):
        try:
            return sum(1 for _ in found(text)) > 0
        except (ValueError, RecursionError):
            return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "start", "title", "location", "has_time"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for n in range(len(texts)):
                text = texts[n].as_py()
                if not whole(text):
                    continue
                events = found(text)
                while some := list(itertools.islice(events, EVENTS_AT_ONCE)):
                    columns = [[ids[n].as_py()] * len(some), *zip(*some, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    block = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
    blocks = _pinned(pages.where("html is not null"), {"__blocks": F.regexp_extract_all("html", F.lit(block), F.lit(1))}).select(F.col("page_id").cast("long"), F.explode("__blocks").alias("block"))
    return blocks.mapInArrow(run, "page_id long, start string, title string, location string, has_time boolean").distinct()


def text_events(pages: DataFrame) -> DataFrame:
    """Events in the visible texts of pages: page_id, start, title, has_time, pos. pages: page_id, html, year (where a date has none).

    A month cuts the texts into stretches. A stretch whose second text is a day is an entry: an optional year, then a
    title of at most TITLE_PARTS texts up to a stop text, with clock times and stray numbers taken out.
    """
    w = Window.partitionBy("page_id").orderBy("pos")
    cut = page_texts(pages).withColumn("entry", F.sum(F.col("token").rlike(MONTH_TOKEN).cast("int")).over(w)).where("entry > 0")
    kind = F.when(F.col("token").rlike(TIME_TOKEN), "time").when(F.col("token").rlike(STOP_TOKEN), "stop").when(F.col("token").rlike(STRAY_TOKEN), "stray").otherwise("title")
    entries = cut.groupBy("page_id", "entry").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("token").alias("t"), kind.alias("k")))).alias("x"))
    texts = entries.where(F.get("x", F.lit(1))["t"].rlike(DAY_TOKEN)).join(pages.select("page_id", "year"), "page_id")
    df = _pinned(texts, {"dated": F.coalesce(F.get("x", F.lit(2))["t"].rlike(YEAR_TOKEN), F.lit(False))})
    rest = F.slice("x", F.when(F.col("dated"), 4).otherwise(3), F.size("x"))
    df = _pinned(df, {"rest": F.transform(rest, lambda r, i: F.struct(i.alias("i"), r["t"].alias("t"), r["k"].alias("k")))})
    df = _pinned(df, {"titles": F.filter("rest", lambda r: r["k"] == "title")}).where(F.size("titles") > 0)
    stop = F.filter("rest", lambda r: (r["k"] == "stop") & (r["i"] > F.col("titles")[0]["i"]))
    sixth = F.get("titles", F.lit(TITLE_PARTS - 1))["i"] + 1
    df = _pinned(df, {"end": F.least(F.coalesce(F.get(stop, F.lit(0))["i"], F.size("rest")), F.coalesce(sixth, F.size("rest")))})
    inside = lambda k: F.transform(F.filter("rest", lambda r: (r["k"] == k) & (r["i"] < F.col("end"))), lambda r: r["t"])
    df = _pinned(df, {"time": F.try_element_at(inside("time"), F.lit(-1)), "title": F.array_join(inside("title"), " - ")})
    time, first = F.col("time"), lambda i: F.col("x")[i]["t"]
    part = lambda n: F.regexp_extract(time, TIME_TOKEN, n)
    hour = part(1).try_cast("int") % 12 + F.when(F.lower(part(3)) == "pm", 12).otherwise(0)
    month = F.array_position(F.lit(list(MONTHS)), F.lower(F.left(first(0), F.lit(3))))
    year = F.when(F.col("dated"), F.regexp_extract(first(2), YEAR_TOKEN, 1).try_cast("int")).otherwise(F.col("year"))
    day = F.format_string("%04d-%02d-%02d", year, month.cast("int"), first(1).cast("int"))
    start = F.when(time.isNull(), day).otherwise(F.concat(day, F.format_string("T%02d:%02d:00", hour, part(2).try_cast("int"))))
    out = _pinned(df, {"start": start}).select("page_id", "start", "title", time.isNotNull().alias("has_time"), F.col("x")[0]["pos"].alias("pos"))
    return out.where(F.try_to_timestamp(F.replace("start", F.lit("T"), F.lit(" "))).isNotNull())


def page_events(pages: DataFrame) -> DataFrame:
    """Events of archived calendar pages: page_id, start (local), title, has_time, by JSON-LD or, where that has fewer than LEAST_STRUCTURED, by the visible texts.

    pages: page_id, html, year, venue_name. A structured event whose location shares no telling word with the venue's
    name is played elsewhere and left out. Of events of a page that agree in start (to the minute) and title (60
    characters, cases aside) the first stays.
    """
    split = lambda c: F.split(F.lower(c), r"\W+")
    telling = F.filter(split(F.coalesce("venue_name", F.lit(""))), lambda x: (F.length(x) > 3) & ~x.isin(*PLAIN_WORDS))
    named = pages.select("page_id", telling.alias("words"))
    away = (F.col("location") != "") & (F.size("words") > 0) & ~F.arrays_overlap(split(F.col("location")), F.col("words"))
    structured = written(json_ld_events(pages).join(named, "page_id").where(~away).select("page_id", "start", "title", "has_time", F.lit(0).alias("pos")))
    enough = structured.groupBy("page_id").count().where(F.col("count") >= LEAST_STRUCTURED).select("page_id")
    found = structured.join(enough, "page_id", "left_semi").unionByName(text_events(pages.join(enough, "page_id", "left_anti")))
    local = to_local(F.col("start"))
    clean = found.select("page_id", local.alias("start"), F.left(clean_title(F.col("title")), F.lit(200)).alias("title"), "pos", (F.col("has_time") & local.contains("T")).alias("has_time")).where("title <> ''")
    key = [F.left("start", F.lit(16)).alias("minute"), F.left(F.lower("title"), F.lit(60)).alias("folded")]
    first = F.min_by(F.struct("start", "title", "has_time"), F.struct("pos", "title", "start")).alias("e")
    return clean.select("*", *key).groupBy("page_id", "minute", "folded").agg(first).select("page_id", "e.*")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, pos, token: the visible texts of each page in order, by SQL functions: scripts and styles out, tags to breaks, common entities decoded."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "\n")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    tokens = F.filter(F.transform(F.split(text, r"\s*\n\s*"), lambda t: F.trim(t)), lambda x: x != "")
    return _pinned(pages.where("html is not null"), {"__tokens": tokens}).select("page_id", F.posexplode("__tokens").alias("pos", "token"))


def flatten_games(schedule: DataFrame, home_venue: str) -> DataFrame:
    """Home games of nested schedules: dates[].games[] of struct<start, venue, title>, by a case-insensitive part of the venue's name."""
    games = schedule.select(F.explode("dates").alias("d")).select(F.explode("d.games").alias("g")).select("g.*")
    return games.where(F.lower("venue").contains(home_venue.lower()))
