"""Domain tables derived from the TPC-H-like tables with expressions that Spark and DuckDB share.

Each table is a list of columns over one source; `frame` applies it with the
DataFrame API, `cte` writes it as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Dialect:
    """The few places where the two SQLs differ."""

    def __init__(self, duck: bool):
        self.duck = duck

    def plus(self, ts: str, minutes: str) -> str:
        return f"({ts} + to_minutes(CAST({minutes} AS BIGINT)))" if self.duck else f"({ts} + make_dt_interval(0, 0, CAST({minutes} AS INT), 0))"

    def dow(self, d: str) -> str:
        return f"CAST(isodow({d}) - 1 AS INT)" if self.duck else f"weekday({d})"

    def at(self, text: str) -> str:
        return f"TIMESTAMP '{text}'" if self.duck else f"TIMESTAMP_NTZ '{text}'"

    def day(self, ts: str) -> str:
        return f"CAST({ts} AS DATE)"


SPARK, DUCK = Dialect(False), Dialect(True)


def _stations(q: Dialect) -> tuple[str, dict[str, str]]:
    return "supplier", {
        "sensor_id": "CAST(s_suppkey AS INT)",
        "fwy": "CAST(s_nationkey % 5 AS INT)",
        "dir": "CASE s_suppkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'E' WHEN 2 THEN 'S' ELSE 'W' END",
        "type": "CASE WHEN s_suppkey % 10 < 8 THEN 'ML' WHEN s_suppkey % 10 = 8 THEN 'HV' ELSE 'OR' END",
        "abs_pm": "(s_suppkey * 37 % 400) / 1e1",
        "length": "CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE (s_suppkey % 5 + 3) / 1e1 END",
        "lat": "372e-1 + (s_suppkey * 7919 % 1000) / 125e1",
        "lon": "-1226e-1 + (s_suppkey * 10473 % 1000) / 11e2",
        "lanes": "CAST(s_suppkey % 4 + 2 AS INT)",
    }


def _readings(q: Dialect) -> tuple[str, dict[str, str]]:
    tod = "CAST(420 + 60 * (l_linenumber - 1) AS INT)"
    return "lineitem", {
        "station": "CAST(l_suppkey AS INT)",
        "date": q.day("l_shipdate"),
        "dow": q.dow(q.day("l_shipdate")),
        "tod": tod,
        "ts": q.plus("date_trunc('day', l_shipdate)" if q.duck else "CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP_NTZ)", tod),
        "speed": "CASE WHEN l_orderkey % 97 = 0 THEN 0e0 ELSE 15e0 + l_quantity END",
        "pct_observed": "CAST(round(l_discount * 1e3) AS INT)",
        "actual": "15e0 + l_quantity",
        "base": "197e-1 + 391e0 * l_tax",
        "pred": "16e0 + l_quantity * 9e-1",
        "row_id": "l_orderkey * 8 + l_linenumber",
    }


def _series(q: Dialect) -> tuple[str, dict[str, str]]:
    tod = "CAST(360 + 15 * (o_orderkey % 64) AS INT)"
    return "orders", {
        "id": "o_orderkey",
        "corridor": "concat('k', CAST(o_custkey % 9 AS STRING))",
        "date": q.day("o_orderdate"),
        "dow": q.dow(q.day("o_orderdate")),
        "tod": tod,
        "ts": q.plus("date_trunc('day', o_orderdate)" if q.duck else "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP_NTZ)", tod),
        "minutes": "5e0 + (CAST(floor(o_totalprice) AS BIGINT) % 4000) / 1e2",
        "coverage": "(o_custkey % 21 + 80) / 1e2",
        "imputed_day": "o_orderkey % 40 = 7",
        "precip": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 7) / 2e0 END",
    }


def _probes(q: Dialect) -> tuple[str, dict[str, str]]:
    return "orders", {
        "row_id": "o_orderkey",
        "venue": "concat('v', CAST(o_custkey % 7 AS STRING))",
        "ts": q.plus(q.at("2024-01-01 00:00:00"), "o_orderkey * 37 % 43200"),
    }


def _venue_events(q: Dialect) -> tuple[str, dict[str, str]]:
    return "events", {
        "event_id": "event_id",
        "venue": "concat('v', CAST(user_id % 7 AS STRING))",
        "start": "ts",
        "title": "concat(event_type, ' ', CASE event_id % 6 WHEN 0 THEN '49ers' WHEN 1 THEN 'Sharks Night' WHEN 2 THEN 'Some Band' WHEN 3 THEN 'Warriors' WHEN 4 THEN 'FC Test' ELSE 'Giants' END)",
        "value": "value",
        "user_id": "user_id",
    }


def _ways(q: Dialect) -> tuple[str, dict[str, str]]:
    return "part", {
        "way_id": "p_partkey",
        "lat": "372e-1 + (p_partkey * 523 % 1000) / 125e1",
        "lon": "-1226e-1 + (p_partkey * 769 % 1000) / 11e2",
        "miles": "(p_size + 1) / 1e1",
        "highway": "CASE p_partkey % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'trunk' WHEN 3 THEN 'motorway' WHEN 4 THEN 'residential' ELSE 'tertiary' END",
        "tag": "CASE p_partkey % 5 WHEN 0 THEN '35 mph' WHEN 1 THEN '50' WHEN 2 THEN NULL WHEN 3 THEN 'none' ELSE '25mph' END",
    }


TABLES = {"stations": _stations, "readings": _readings, "series": _series, "probes": _probes, "venue_events": _venue_events, "ways": _ways}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = TABLES[name](SPARK)
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def cte(*names: str) -> str:
    """WITH clause of the named tables, for DuckDB."""
    parts = []
    for name in names:
        source, columns = TABLES[name](DUCK)
        parts.append(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})")
    return "WITH " + ",\n".join(parts)
