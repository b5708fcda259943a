"""Timings of bootstraps over a grid, and what is read from them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serieslab.operators.bootstrap import bootstrap
from serieslab.operators.diagnostics import relative_time
from serieslab.sources.series import keys, value_columns

VARY = ("num_boots", "n_boot", "n_assets")
RESULTS = "Setup string, Parameter string, Value double, Time double, Rep int"


def benchmark(series: DataFrame, setups: dict[str, dict], vary: str, values: list[int], times: int = 3, clock: Callable[[], float] = time.time, run: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """(Setup, Parameter, Value, Time, Rep): seconds of each set of bootstrap() arguments at each value, run to the end.

    Time is null where a run failed; more assets than there are columns are left out.
    """
    if vary not in VARY:
        raise ValueError(f"{vary!r} is none of {VARY}")
    if len(values) < 2:
        raise ValueError("a benchmark needs two values or more")
    cols = value_columns(series)
    go = run or (lambda df: df.write.format("noop").mode("overwrite").save())
    rows = []
    for name, options in setups.items():
        for value in values:
            if vary == "n_assets" and value > len(cols):
                continue
            some = series.select(*keys(series), "t", *cols[:value]) if vary == "n_assets" else series
            kw = options if vary == "n_assets" else options | {vary: value}
            for rep in range(1, times + 1):
                began = clock()
                try:
                    got = bootstrap(some, **kw)
                    go(got.func_out_means if got.func_out_means is not None else got.series)
                    took: float | None = clock() - began
                except Exception:  # a setup that cannot run has no time
                    took = None
                rows.append((name, vary, float(value), took, rep))
    return series.sparkSession.createDataFrame(rows, RESULTS)


def summarise(results: DataFrame) -> DataFrame:
    """Setup, Value, Mean_Time, SD_Time and Relative, the mean over the least of its Value."""
    means = results.groupBy("Setup", "Value").agg(F.avg("Time").alias("Mean_Time"), F.stddev_samp("Time").alias("SD_Time"))
    return relative_time(means, ["Value"], "Mean_Time")


def table(results: DataFrame) -> DataFrame:
    """A row a Value and a column a Setup: mean seconds."""
    names = sorted(r["Setup"] for r in results.select("Setup").distinct().collect())  # a row a setup
    return results.groupBy("Value").pivot("Setup", names).agg(F.avg("Time"))


def fastest(results: DataFrame) -> DataFrame:
    """(Setup, Mean_Time) of the least mean over values."""
    means = summarise(results).groupBy("Setup").agg(F.avg("Mean_Time").alias("Mean_Time"))
    return means.agg(F.min(F.struct("Mean_Time", "Setup")).alias("m")).select("m.Setup", "m.Mean_Time")


def plot_table(results: DataFrame) -> DataFrame:
    """Each timing beside its mean and the ribbon of one standard deviation."""
    means = summarise(results).withColumns({"lower": F.greatest(F.lit(0.0), F.col("Mean_Time") - F.coalesce("SD_Time", F.lit(0.0))), "upper": F.col("Mean_Time") + F.coalesce("SD_Time", F.lit(0.0))})
    return results.join(means, ["Setup", "Value"])


def growth(results: DataFrame) -> DataFrame:
    """Setup, Value and how many times the least value's mean time each takes."""
    w = Window.partitionBy("Setup").orderBy("Value")
    return summarise(results).withColumn("growth", F.col("Mean_Time") / F.first("Mean_Time").over(w)).select("Setup", "Value", "growth")
