"""Every registered query of the travel-time operators, against its SQL where it has one."""

import pytest
from pyspark.sql import functions as F

from roadtide.operators import asof, routing
from roadtide.plans import forecast_queries, more_queries, source_queries  # noqa: F401  register their queries
from roadtide.plans import queries as q
from tests.conftest import TESTDATA
from tests.oracle import oracle_rows, rows_of


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, name):
    got, names = rows_of(q.queries()[name](spark, str(TESTDATA)))
    if name in q.oracle_sql():
        assert got == oracle_rows(q.oracle_sql()[name], TESTDATA, names)


@pytest.mark.parametrize(("name", "last"), [("O8_latest_departure", 1020), ("A26_route_coverage", 1425), ("R6_band", 1425)])
def test_departures_on_the_quarter_hour_grid(spark, monkeypatch, name, last):
    asked, price = [], routing.price
    monkeypatch.setattr(routing, "price", lambda routes, departures, **more: asked.append(departures) or price(routes, departures, **more))
    q.queries()[name](spark, str(TESTDATA))
    got = asked[0].groupBy("route_id").agg(F.sort_array(F.collect_set("depart")).alias("at")).select("at").distinct().collect()
    assert [r["at"] for r in got] == [list(range(0, last + 1, 15))]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hours_before_an_event_have_buckets_too(spark):
    got = q.queries()["J8_hour_bucket"](spark, str(TESTDATA)).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).first()
    assert got.a < 0 and got.b > 0


def test_events_are_asked_once_a_venue_and_time(spark, monkeypatch):
    asked, nearest = [], asof.nearest_event
    monkeypatch.setattr(asof, "nearest_event", lambda df, *a, **more: asked.append(df) or nearest(df, *a, **more))
    q.queries()["M2_network_matrix"](spark, str(TESTDATA))
    assert asked[0].count() == asked[0].select("venue", "ts").distinct().count() > 0
