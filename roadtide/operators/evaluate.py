"""Scores: overlapping slices, weighted overalls, backtests and error shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtide.operators.quantiles import group_quantiles


def slice_report(df: DataFrame, actual: str, baseline: str, predictions: dict[str, str], slices: dict[str, object], *, by: str | None = None) -> DataFrame:
    """Mean absolute errors of overlapping slices: [by,] slice, n, mae_baseline, mae_<name>, gain_pct_<name>.

    slices: name to condition; `all` is added. A row counts in each slice that it is in; one pass over the data.
    """
    named = F.array_compact(F.array(F.lit("all"), *(F.when(cond, F.lit(name)) for name, cond in slices.items())))
    keys = [by] if by else []
    error = lambda c: F.avg(F.abs(F.col(c) - F.col(actual)))
    out = df.withColumn("slice", F.explode(named)).groupBy(*keys, "slice").agg(F.count("*").alias("n"), error(baseline).alias("mae_baseline"), *(error(c).alias(f"mae_{n}") for n, c in predictions.items()))
    gain = {f"gain_pct_{n}": F.try_divide(F.col("mae_baseline") - F.col(f"mae_{n}"), F.col("mae_baseline")) * 100.0 for n in predictions}
    return out.withColumns(gain)


def slice_cube(df: DataFrame, actual: str, baseline: str, predictions: dict[str, str], slices: dict[str, object], *, by: str) -> DataFrame:
    """slice_report() with totals, in one pass over grouping sets: a row for each by and slice (level 0), for each slice (level 2), and for all rows (level 3).

    by and slice are null in the totals; level is Spark's grouping id, which tells such a null from one of the data.
    The last row counts every row once, not once for each slice that it is in.
    """
    named = F.array_compact(F.array(F.lit("all"), *(F.when(cond, F.lit(name)) for name, cond in slices.items())))
    rows = df.withColumn("slice", F.explode(named))
    once, level = F.col("slice") == "all", F.grouping_id()
    error = lambda c: F.abs(F.col(c) - F.col(actual))
    errors = {"baseline": error(baseline)} | {n: error(c) for n, c in predictions.items()}
    sums = [F.count("*").alias("__n"), F.count_if(once).alias("__n1")]
    sums += [x for n, e in errors.items() for x in (F.avg(e).alias(f"__{n}"), F.avg(F.when(once, e)).alias(f"__{n}1"))]
    got = rows.groupingSets([[F.col(by), F.col("slice")], [F.col("slice")], []], F.col(by), F.col("slice")).agg(level.alias("level"), *sums)
    pick = lambda c: F.when(F.col("level") == 3, F.col(f"__{c}1")).otherwise(F.col(f"__{c}"))
    by_level = [F.when(F.col("level") == 0, F.col(by)).alias(by), F.when(F.col("level") < 3, F.col("slice")).alias("slice"), F.col("level").cast("int")]
    # grouping_id has a bit for each column that is left out, the first one highest: 0 both, 2 slices, 3 all.
    out = got.select(*by_level, pick("n").alias("n"), *(pick(n).alias(f"mae_{n}") for n in errors))
    return out.withColumns({f"gain_pct_{n}": F.try_divide(F.col("mae_baseline") - F.col(f"mae_{n}"), F.col("mae_baseline")) * 100.0 for n in predictions})


def exact_quantile(df: DataFrame, value, q: float, **limits: int) -> float | None:
    """The interpolated q-quantile of a column expression; nulls and NaN don't count, and without values it is None. No task gets all values."""
    row = group_quantiles(df, [], value, {"v": q}, **limits).first()
    return row.v if row and row.n else None


def worst(df: DataFrame, actual: str, baseline: str, q: float = 0.95) -> DataFrame:
    """Adds is_worst: the baseline's error is above its q-quantile."""
    err = F.abs(F.col(baseline) - F.col(actual))
    return df.withColumn("is_worst", err > F.lit(exact_quantile(df, err, q)))


def weighted_overall(df: DataFrame, metrics: list[str], n: str = "n") -> DataFrame:
    """Metrics of groups weighted by their rows."""
    return df.agg(F.sum(n).alias("n"), *(F.try_divide(F.sum(F.col(m) * F.col(n)), F.sum(n)).alias(m) for m in metrics))


def error_share(df: DataFrame, actual: str, predicted: str, active) -> DataFrame:
    """Share of all absolute error that falls on the active rows."""
    err = F.abs(F.col(predicted) - F.col(actual))
    return df.agg(F.try_divide(F.sum(F.when(active, err)), F.sum(err)).alias("error_share"), F.count_if(active).alias("rows"))


def backtest(series: DataFrame, *, test_start, test_end, order=("ts",)) -> DataFrame:
    """Errors of three reference models by corridor on the test dates: the causal seasonal median, the value before, and the corridor's median before the test.

    Only observations before a row enter its predictions.
    """
    from roadtide.operators.seasonal import causal_rolling

    rolled = causal_rolling(series, "minutes", ("corridor", "dow", "tod"), order)
    before = series.where(F.col("date") < F.lit(test_start).cast("date"))
    before = group_quantiles(before, ["corridor"], F.col("minutes"), {"overall": 0.5}).drop("n")
    test = rolled.where((F.col("date") >= F.lit(test_start).cast("date")) & (F.col("date") < F.lit(test_end).cast("date")) & F.col("seasonal_median").isNotNull() & F.col("prev_value").isNotNull())
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("minutes")))
    return test.join(before, "corridor").groupBy("corridor").agg(F.count("*").alias("n"), err("seasonal_median").alias("mae_seasonal"), err("prev_value").alias("mae_last"), err("overall").alias("mae_overall"))
