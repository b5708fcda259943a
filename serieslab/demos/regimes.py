"""Regimes of a series: decoded states, replicates that keep them, and what became of the states' shares."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.operators import bootstrap, diagnostics
from serieslab.operators.resample import lagged
from serieslab.sources import series


def run(spark: SparkSession, sf_dir: str, num_boots: int = 20) -> dict[str, DataFrame]:
    """states, shares, bands and the replicates' volatilities of daily returns, for two hidden regimes."""
    prices = lagged(series.daily_revenue(spark, sf_dir), ["v1"]).where("v1_lag1 is not null")
    returns = prices.select((F.col("t") - 1).alias("t"), F.log(F.col("v1") / F.col("v1_lag1")).alias("r"))
    out = bootstrap.bootstrap(returns, "hmm", num_boots=num_boots, func={"sd": F.stddev_samp}, return_fit=True)
    states = out.fit.select("t", "state")
    return {"states": states, "shares": diagnostics.regime_summary(states, out.series, [0, 1], ["calm", "lively"]), "bands": diagnostics.regime_bands(states), "volatility": out.func_outs}


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    for name, table in run(session, sys.argv[1]).items():
        print(name)
        table.show(truncate=False)
