"""Statistics of replicates and their summaries, all as grouped aggregates.

Replicates of many series carry series_id, and every statistic is then one a series. A statistic that gives a vector
has a row a dimension (idx), and summaries are by (name, idx).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.sources.series import keys, over_time, value_columns

SKIP = ("boot_id", "pos", "block_no", "src_t", "w", "state")


def variables(boots: DataFrame) -> list[str]:
    return [c for c in value_columns(boots) if c not in SKIP]


def apply_columns(boots: DataFrame, stats: dict[str, Callable[[str], Column]]) -> DataFrame:
    """(boot_id, name, value): each statistic (a Column aggregate) of each variable of each replicate."""
    cols, by = variables(boots), [*keys(boots), "boot_id"]
    wide = boots.groupBy(*by).agg(*(f(c).cast("double").alias(f"{c}:{s}") for c in cols for s, f in stats.items()))
    return wide.unpivot(by, [f"`{c}:{s}`" for c in cols for s in stats], "name", "value")


def _named(out) -> list[tuple[str, int, float]]:
    import numpy as np

    named = out if isinstance(out, dict) else {"value": out}
    return [(n, i, float(v)) for n, x in named.items() for i, v in enumerate(np.ravel(x))]


def apply_frames(boots: DataFrame, func: Callable, graceful: bool = False) -> DataFrame:
    """(boot_id, name, idx, value): a Python function of each replicate's frame, giving a number, a list, a matrix or a dict of them.

    Matrices are flattened by rows. A replicate for which the function fails stops the query, or has no rows if graceful.
    """
    cols, by = variables(boots), [*keys(boots), "boot_id"]

    def run(key, pdf):
        import pandas as pd

        try:
            rows = _named(func(pdf.sort_values("pos")[cols]))
        except Exception:
            if not graceful:
                raise
            rows = []
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*by, "name", "idx", "value"])

    schema = ", ".join([*("series_id string" for _ in keys(boots)), "boot_id int, name string, idx int, value double"])
    return boots.select(*by, "pos", *cols).groupBy(*by).applyInPandas(run, schema)


def apply_each(boots: DataFrame, func: Callable, graceful: bool = False) -> DataFrame:
    """apply_frames for a function of one column (an array), taken of each variable: names are column:name."""
    cols = variables(boots)

    def every(frame):
        out = {}
        for c in cols:
            got = func(frame[c].to_numpy())
            out |= {f"{c}:{n}": v for n, v in got.items()} if isinstance(got, dict) else {c: got}
        return out

    return apply_frames(boots, every, graceful)


# --- summaries of (name, idx)
def dimensions(outs: DataFrame) -> list[str]:
    return [*keys(outs), *(["name", "idx"] if "idx" in outs.columns else ["name"])]


def _shown(outs: DataFrame) -> list[Column]:
    return [F.col(c).alias("Name" if c == "name" else c) for c in dimensions(outs)]


def summarize(outs: DataFrame, probs: tuple[float, float] = (0.025, 0.975), digits: int = 4) -> DataFrame:
    """Name, Mean, SD, CI_Lower, CI_Upper, CI_Width of each statistic; quantiles interpolate linearly."""
    q = lambda p: F.percentile("value", p)
    r = lambda c: F.bround(c, digits)
    return outs.groupBy(*_shown(outs)).agg(r(F.avg("value")).alias("Mean"), r(F.stddev_samp("value")).alias("SD"), r(q(probs[0])).alias("CI_Lower"), r(q(probs[1])).alias("CI_Upper"), r(q(probs[1]) - q(probs[0])).alias("CI_Width"))


def variation(outs: DataFrame, stable: float = 0.3, moderate: float = 0.6) -> DataFrame:
    """Name, Mean, SD, CV and a stability label."""
    rows = outs.groupBy(*_shown(outs)).agg(F.avg("value").alias("Mean"), F.stddev_samp("value").alias("SD"))
    cv = F.col("SD") / (F.abs("Mean") + 1e-8)
    return rows.withColumn("CV", cv).withColumn("Stability", F.when(F.col("CV") < stable, "Stable").when(F.col("CV") < moderate, "Moderate").otherwise("Unstable"))


def robust(outs: DataFrame, trim: float = 0.1, quantile: float = 0.25, point: DataFrame | None = None) -> DataFrame:
    """Name, Boot_Mean, Boot_Median, Winsorized (trimmed mean) and Conservative (a low quantile), and Point if given.

    A vector statistic whose conservative estimates are not negative and whose means sum to 1 (within 0.1) is weights:
    its conservative estimates are scaled to sum to 1. point has the statistic's dimensions and a value.
    """
    dims = dimensions(outs)
    w = Window.partitionBy(*dims)
    ranked = outs.withColumn("k", F.row_number().over(w.orderBy("value"))).withColumn("n", F.count("*").over(w))
    cut = F.floor(F.col("n") * trim)
    kept = F.when((F.col("k") > cut) & (F.col("k") <= F.col("n") - cut), F.col("value"))
    rows = ranked.groupBy(*dims).agg(F.avg("value").alias("Boot_Mean"), F.median("value").alias("Boot_Median"), F.avg(kept).alias("Winsorized"), F.percentile("value", quantile).alias("Conservative"))
    if "idx" in dims:
        every = Window.partitionBy(*(d for d in dims if d != "idx"))
        weights = (F.min("Conservative").over(every) >= 0) & (F.abs(F.sum("Boot_Mean").over(every) - 1) < 0.1) & (F.sum("Conservative").over(every) > 0)
        rows = rows.withColumn("Conservative", F.when(weights, F.col("Conservative") / F.sum("Conservative").over(every)).otherwise(F.col("Conservative")))
    if point is not None:
        rows = rows.join(point.select(*dims, F.col("value").alias("Point")), dims, "left")
    return rows.withColumnRenamed("name", "Name")


def averages(outs: DataFrame) -> DataFrame:
    """mean_value and n of each statistic, element by element."""
    return outs.groupBy(*dimensions(outs)).agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))


def matrix(outs: DataFrame, names: list[str]) -> DataFrame:
    """A row a replicate and a column a statistic (name, or name_idx for a vector's)."""
    label = F.concat_ws("_", "name", "idx") if "idx" in outs.columns else F.col("name")
    return outs.withColumn("_label", label).groupBy(*keys(outs), "boot_id").pivot("_label", names).agg(F.first("value"))


# --- first and second moments
def replicate_stats(boots: DataFrame, col: str) -> DataFrame:
    """boot_id, length, mean, sd and ac1 (full denominator; 0 for a constant) of one variable."""
    by = [*keys(boots), "boot_id"]
    w = Window.partitionBy(*by).orderBy("pos")
    m = F.avg(col).over(Window.partitionBy(*by))
    d = boots.select(*by, "pos", F.col(col).alias("v"), (F.col(col) - m).alias("d")).withColumn("l", F.lag("d").over(w))
    total = F.sum(F.col("d") * F.col("d"))
    ac1 = F.when(total > 0, F.try_divide(F.coalesce(F.sum(F.col("d") * F.col("l")), F.lit(0.0)), total)).otherwise(0.0)
    return d.groupBy(*by).agg(F.count("*").alias("length"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), ac1.alias("ac1"))


def original_stats(series: DataFrame, col: str) -> DataFrame:
    return replicate_stats(series.withColumnRenamed("t", "pos").withColumn("boot_id", F.lit(-1)), col).drop("boot_id")


def long(df: DataFrame, order: str = "pos") -> DataFrame:
    """(keys, order, name, v): a row for each value of each variable."""
    by = [c for c in ("series_id", "boot_id", order) if c in df.columns]
    cols = variables(df)
    return df.unpivot(by, [F.col(c) for c in cols], "name", "v")


def stats_of(boots: DataFrame) -> DataFrame:
    """replicate_stats of every variable: boot_id, name, length, mean, sd, ac1."""
    by = [*keys(boots), "boot_id", "name"]
    rows = long(boots.select(*keys(boots), "boot_id", "pos", *variables(boots)))
    w = Window.partitionBy(*by)
    d = rows.withColumn("d", F.col("v") - F.avg("v").over(w)).withColumn("l", F.lag("d").over(w.orderBy("pos")))
    total = F.sum(F.col("d") * F.col("d"))
    ac1 = F.when(total > 0, F.try_divide(F.coalesce(F.sum(F.col("d") * F.col("l")), F.lit(0.0)), total)).otherwise(0.0)
    return d.groupBy(*by).agg(F.count("*").alias("length"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), ac1.alias("ac1"))


def original_stats_of(series: DataFrame) -> DataFrame:
    return stats_of(series.withColumnRenamed("t", "pos").withColumn("boot_id", F.lit(-1))).drop("boot_id")


def moments(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """n, min, max, range, skewness and kurtosis: population moments over powers of the sample's sd, and the population's excess."""
    by = by or []
    m = F.avg(col).over(Window.partitionBy(*by))
    d = df.select(*by, F.col(col).cast("double").alias("v"), (F.col(col) - m).alias("d"))
    s = F.stddev_samp("v")
    third, fourth, second = (F.avg(F.pow("d", F.lit(k))) for k in (3, 4, 2))
    over = lambda a, b: F.when(s > 0, F.try_divide(a, b)).otherwise(0.0)
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), (F.max("v") - F.min("v")).alias("range"), over(third, F.pow(s, F.lit(3))).alias("skewness"), (over(fourth, F.pow(s, F.lit(4))) - 3).alias("kurtosis"), (over(fourth, second * second) - 3).alias("excess_kurtosis"))


def weighted_moments(rows: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """Weighted means, variances, covariance and correlation (weights normalised, no small-sample factor)."""
    a = rows.agg((F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("mx"), (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("my"))
    d = rows.select(F.col(w).alias("w"), F.col(x).alias("x"), F.col(y).alias("y")).join(F.broadcast(a))  # one row of means
    c = lambda p, q, mp, mq: F.sum(F.col("w") * (F.col(p) - F.col(mp)) * (F.col(q) - F.col(mq))) / F.sum("w")
    out = d.groupBy("mx", "my").agg(c("x", "x", "mx", "mx").alias("vx"), c("y", "y", "my", "my").alias("vy"), c("x", "y", "mx", "my").alias("cxy"))
    return out.withColumn("corr", F.col("cxy") / F.sqrt(F.col("vx") * F.col("vy")))


# --- ordered functions
def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    return df.groupBy(F.width_bucket(F.col(col).cast("double"), F.lit(lo), F.lit(hi), F.lit(bins)).alias("bucket")).agg(F.count("*").alias("n"))


def average_rank(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*keys(df)).orderBy(col)) + (F.count("*").over(Window.partitionBy(*keys(df), col)) - 1) / 2)


def pseudo_observations(df: DataFrame, col: str) -> DataFrame:
    """The empirical distribution at each value, scaled by n / (n + 1)."""
    n = F.count("*").over(Window.partitionBy(*keys(df)))
    return df.withColumn("u", F.cume_dist().over(Window.partitionBy(*keys(df)).orderBy(col)) * n / (n + 1))


def normalised(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """col from 0 to 1 within each group; 0.5 where the group is constant."""
    w = Window.partitionBy(*by)
    spread = F.max(col).over(w) - F.min(col).over(w)
    return df.withColumn("scaled", F.when(spread > 0, F.try_divide(F.col(col) - F.min(col).over(w), spread)).otherwise(0.5))


def difference(series: DataFrame, col: str, d: int = 1) -> DataFrame:
    out, w = series.select(*keys(series), "t", F.col(col).alias("v")), over_time(series)
    for _ in range(d):
        out = out.withColumn("v", F.col("v") - F.lag("v").over(w))
    return out.where(F.col("t") >= d)


def price_path(returns: DataFrame, col: str, scale: float | None = 100.0, initial: float = 100.0) -> DataFrame:
    """t, price, drawdown, 21-row volatility and 252-row Sharpe ratio of a series of log returns.

    Without a scale, returns of which any is beyond 1 are percentages.
    """
    w = over_time(returns)
    unit = F.lit(scale) if scale else F.when(F.max(F.abs(F.col(col))).over(Window.partitionBy(*keys(returns))) > 1, 100.0).otherwise(1.0)
    rows = returns.select(*keys(returns), "t", F.col(col).alias("r"), (initial * F.exp(F.sum(F.col(col) / unit).over(w))).alias("price"))
    rows = rows.withColumn("drawdown", F.col("price") / F.max("price").over(w) - 1)
    rows = rows.withColumn("vol21", F.when(F.col("t") >= 20, F.stddev_samp("r").over(w.rowsBetween(-20, 0))))
    year = w.rowsBetween(-251, 0)
    sharpe = F.when((F.col("t") >= 251) & (F.stddev_samp("r").over(year) > 0), F.sqrt(F.lit(252.0)) * F.try_divide(F.avg("r").over(year), F.stddev_samp("r").over(year)))
    return rows.withColumn("sharpe252", sharpe).drop("r")


def garch_path(series: DataFrame, col: str, omega: float, alpha: float, beta: float) -> DataFrame:
    """t, h, z: the GARCH(1,1) variance and the standardised value of each series, walked in one pass by an Arrow task a series."""

    def walk(key, pdf):
        import numpy as np
        import pandas as pd

        from serieslab.functions.garch import garch_variance

        pdf = pdf.sort_values("t")
        v = pdf[col].to_numpy(float)
        h = garch_variance(v, omega, alpha, beta)
        return pd.DataFrame({**({"series_id": key[0]} if named else {}), "t": pdf["t"].to_numpy(), "h": h, "z": v / np.sqrt(h)})

    named = bool(keys(series))
    schema = ("series_id string, " if named else "") + "t long, h double, z double"
    rows = series if named else series.withColumn("series_id", F.lit("all"))
    return rows.select("series_id", "t", col).groupBy("series_id").applyInPandas(walk, schema)


def weighted_score(preds: DataFrame, pred: str, actual: str, by: list[str]) -> DataFrame:
    """mse and mae of predictions by group."""
    e = F.col(pred) - F.col(actual)
    return preds.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))
