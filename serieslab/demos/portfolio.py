"""How much portfolio weights vary: statistics of a matrix, bootstrapped, with their spread and robust estimates."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from serieslab.functions import portfolio
from serieslab.operators import bootstrap, summary
from serieslab.sources import series


def run(spark: SparkSession, sf_dir: str, num_boots: int = 50) -> dict[str, DataFrame]:
    """outs, spread and robust estimates of the weights that each statistic gives the daily lines' columns."""
    lines = series.daily_lines(spark, sf_dir)
    statistics = lambda x: {name: f(x.to_numpy()) for name, f in portfolio.STATISTICS.items()}
    out = bootstrap.bootstrap(lines, "stationary", num_boots=num_boots, p_method="plugin", func=statistics, apply_func_to="all")
    outs = series.materialise(out.func_outs, "weights")
    return {"outs": outs, "spread": summary.summarize(outs), "stability": summary.variation(outs), "robust": summary.robust(outs)}


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    for name, table in run(session, sys.argv[1]).items():
        print(name)
        table.show(truncate=False)
