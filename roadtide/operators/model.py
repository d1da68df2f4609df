"""Speed models on MLlib: fitting with absolute loss, batch prediction, importances, and the forecast table."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtide.functions.columns import MPH_MAX, MPH_MIN, mph_of_pace, pace
from roadtide.operators.features import horizon
from roadtide.session import written

#: How a target is made from minutes or mph and its baseline, and turned back.
TARGETS = ("speed", "pace", "ratio", "minutes")


def label(df: DataFrame, target: str, actual: str = "speed", base: str = "seasonal_speed") -> DataFrame:
    """Adds label: the speed itself, its pace, or its share of the baseline."""
    value = {"speed": F.col(actual).cast("double"), "pace": pace(F.col(actual)), "ratio": F.try_divide(F.col(actual), F.col(base)), "minutes": F.col(actual).cast("double")}[target]
    return df.withColumn("label", value).where("label is not null")


def to_mph(prediction, target: str, base=None):
    """The speed that a prediction stands for, held within 5 to 80 mph."""
    raw = {"speed": prediction, "pace": mph_of_pace(prediction), "ratio": prediction * (base if base is not None else F.lit(1.0))}[target]
    return F.least(F.greatest(raw, F.lit(MPH_MIN)), F.lit(MPH_MAX))


def fit(train: DataFrame, numeric: list[str], categorical: list[str], *, rounds: int = 400, depth: int = 5, seed: int = 7, tol: float = 0.001, valid: str | None = None) -> PipelineModel | None:
    """Boosted trees with absolute loss. Missing numbers get their median and a flag; unknown categories a place of their own.

    valid: a Boolean column of rows that end the boosting once a round betters their error by less than tol of it; rounds
    bounds it. A numeric column without any value counts as 0 throughout. Without rows to learn from there is no model.
    """
    # The stages, and every look at the rows, read them again: they are computed once, by the columns that count.
    train = written(train.select(*numeric, *categorical, "label", *([valid] if valid else [])))
    learnt = train.where(~F.coalesce(F.col(valid), F.lit(False))) if valid else train
    counts = learnt.agg(F.count("*").alias("__n"), *(F.count(F.col(c).cast("double")).alias(c) for c in numeric)).first()
    if not counts["__n"]:
        return None
    stop = valid and not train.where(F.col(valid)).isEmpty()
    blank = [c for c in numeric if not counts[c]]
    known = [c for c in numeric if counts[c]]
    columns = ", ".join(f"{'0.0D' if c in blank else f'CAST(`{c}` AS DOUBLE)'} AS `{c}_known`, CAST(`{c}` IS NULL AS DOUBLE) AS `{c}_missing`" for c in numeric)
    stages = [
        SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__"),
        *(StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categorical),
        *([Imputer(inputCols=[f"{c}_known" for c in known], outputCols=[f"{c}_filled" for c in known], strategy="median")] if known else []),
        VectorAssembler(inputCols=[*(f"{c}_known" if c in blank else f"{c}_filled" for c in numeric), *(f"{c}_missing" for c in numeric), *(f"{c}_index" for c in categorical)], outputCol="features"),
        GBTRegressor(lossType="absolute", maxIter=rounds, maxDepth=depth, maxBins=256, seed=seed, validationTol=tol, **({"validationIndicatorCol": valid} if stop else {})),
    ]
    return Pipeline(stages=stages).fit(train if stop or not valid else learnt)


def predict(model: PipelineModel | None, df: DataFrame, target: str = "speed", base: str = "seasonal_speed", out: str = "mph") -> DataFrame:
    """df with the prediction under the name `out`: mph held within its limits, or minutes as they are. Without a model, no row."""
    if model is None:
        return df.where(F.lit(False)).withColumn(out, F.lit(None).cast("double"))
    done = model.transform(df)
    value = F.col("prediction") if target == "minutes" else to_mph(F.col("prediction"), target, F.col(base) if target == "ratio" else None)
    return done.select(*df.columns, value.alias(out))


def cross_fitted(rows: DataFrame, learn, apply, *, key: str = "station", folds: int = 3, seed: int = 7) -> DataFrame:
    """Out-of-fold predictions: each fold of keys is predicted by a model that never saw one of its rows.

    learn(rows) gives a model (or None), apply(model, rows) rows with a prediction. A key falls on the same fold always.
    Adds fold. A fold whose complement is empty has no prediction, and no row.
    """
    fold = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")
    dealt = rows.withColumn("fold", fold)
    return reduce(DataFrame.unionByName, (apply(learn(dealt.where(F.col("fold") != i)), dealt.where(F.col("fold") == i)) for i in range(folds)))


def importances(model: PipelineModel | None, spark) -> DataFrame:
    """feature, share (percent) of the fitted trees."""
    rows = []
    if model is not None:
        rows = [(n.removesuffix("_known"), float(s) * 100.0) for n, s in zip(model.stages[-2].getInputCols(), model.stages[-1].featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, share double")


def forecast_table(model: PipelineModel | None, seasonal: DataFrame, start_date, days: int, *, target: str = "speed") -> DataFrame:
    """station, date, tod, mph, seasonal_speed, seasonal_sd of the coming days."""
    return predict(model, horizon(seasonal, start_date, days), target).select("station", "date", "tod", "mph", "seasonal_speed", "seasonal_sd")
