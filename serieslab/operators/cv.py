"""Cross-validation over contiguous folds."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Model(Protocol):
    def predict(self, x: np.ndarray) -> np.ndarray: ...


class MeanModel:
    """Predicts the training mean."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean = float(np.mean(y))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.mean)


def mse(pred: np.ndarray, actual: np.ndarray) -> float:
    return float(np.mean((np.asarray(pred) - np.asarray(actual)) ** 2))


def mae(pred: np.ndarray, actual: np.ndarray) -> float:
    return float(np.mean(np.abs(np.asarray(pred) - np.asarray(actual))))


def folds(n: int, k: int) -> list[tuple[int, int]]:
    """The first row and the one after the last of each of k folds of equal size; rows over are in none."""
    if not 1 <= k <= n:
        raise ValueError(f"{n} rows cannot be split into {k} folds")
    size = n // k
    return [(i * size, (i + 1) * size) for i in range(k)]


def cross_validate(series: DataFrame, col: str, k: int = 5) -> DataFrame:
    """fold, score: mean squared error of the training folds' mean on each contiguous fold, by aggregates alone.

    The model is the mean, so each fold's training sums are those of all rows less its own.
    """
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    held = series.select(F.floor(F.col("t") * k / n).cast("int").alias("fold"), F.col(col).alias("v"))
    sums = held.groupBy("fold").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    every = Window.partitionBy(F.lit(1))
    fit = (F.sum("s").over(every) - F.col("s")) / (F.sum("n").over(every) - F.col("n"))
    return sums.withColumn("m", fit).select("fold", ((F.col("q") - 2 * F.col("m") * F.col("s") + F.col("n") * F.col("m") ** 2) / F.col("n")).alias("score"))


def k_fold(series: DataFrame, x: list[str], y: str, k: int = 5, grid: list[float] | None = None, model: Callable[[np.ndarray, np.ndarray], Model] = MeanModel, score: Callable[[np.ndarray, np.ndarray], float] = mse) -> DataFrame:
    """(p, fold, score): each candidate's score on each fold, a task each.

    A model that takes a third argument gets the candidate p; others score alike for every p. A fold's task sees the
    whole series, which is therefore bounded by what one task holds.
    """
    import inspect

    grid = grid or [round(0.01 * i, 2) for i in range(1, 51)]
    spark = series.sparkSession
    rows = series.select("t", *x, y).orderBy("t").toPandas()  # one series, as a task holds it
    shared = spark.sparkContext.broadcast((rows[x].to_numpy(float), rows[y].to_numpy(float)))
    spans = folds(len(rows), k)
    takes_p = len(inspect.signature(model).parameters) > 2

    def run(batches):
        xs, ys = shared.value
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a, b = spans[int(r.fold)]
                train = np.r_[0:a, b : len(ys)]
                fitted = model(xs[train], ys[train], r.p) if takes_p else model(xs[train], ys[train])
                out.append((r.p, r.fold, float(score(fitted.predict(xs[a:b]), ys[a:b]))))
            yield pd.DataFrame(out, columns=["p", "fold", "score"])

    tasks = spark.createDataFrame([(float(p),) for p in grid], "p double").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return tasks.repartition(min(len(grid) * k, 64), "p", "fold").mapInPandas(run, "p double, fold int, score double")


def best_p(scores: DataFrame) -> DataFrame:
    """(p, score): the candidate with the least mean score, of ties the first."""
    means = scores.groupBy("p").agg(F.avg("score").alias("score"))
    return means.agg(F.min(F.struct("score", "p")).alias("m")).select("m.p", "m.score")


def cv_p(series: DataFrame, col: str, k: int = 5, grid: list[float] | None = None, **kw) -> float:
    """The stationary bootstrap's p by cross-validation of col on its own first lag."""
    w = Window.orderBy("t")
    pairs = series.select("t", F.lag(col).over(w).alias("x"), F.col(col).alias("y")).where("x is not null")
    return float(best_p(k_fold(pairs, ["x"], "y", k, grid, **kw)).first()["p"])
