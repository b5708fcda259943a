"""Series as DataFrames: t (0-based, dense) and one double column per variable; series_id where there are many."""

from __future__ import annotations

import contextlib
import logging
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The largest count that is accepted (a 32-bit integer).
MAX_COUNT = 2**31 - 1


class SeriesError(ValueError):
    """The data are no usable series: wrong columns, empty, or with missing or non-finite values."""


# --- shape
def value_columns(df: DataFrame) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, k in df.dtypes if c not in ("t", "series_id") and (k in kinds or k.startswith("decimal"))]


def keys(df: DataFrame) -> list[str]:
    """["series_id"] if df holds many series, else nothing."""
    return ["series_id"] if "series_id" in df.columns else []


def over_time(df: DataFrame, order: str = "t"):
    """The window of a series' rows in time. Many series are walked side by side; one series is one ordered thing."""
    return Window.partitionBy(*keys(df)).orderBy(order)


def make_series(df: DataFrame, order: list[str], values: list[str], by: str | None = None) -> DataFrame:
    """t and the value columns in a total order, with series_id from the column `by` if there are many series."""
    if not values:
        raise SeriesError("a series needs a numeric column")
    w = Window.partitionBy(*([by] if by else [])).orderBy(*order)
    ids = [F.col(by).cast("string").alias("series_id")] if by else []
    return df.select(*ids, (F.row_number().over(w) - 1).cast("long").alias("t"), *(F.col(c).cast("double").alias(c) for c in values))


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once to the shared checkpoint folder (the warehouse where none is set) and read back: what follows does not compute it again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    path = f"{base.rstrip('/')}/series/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- validation
def validate(df: DataFrame, fail_mode: str = "predictably") -> DataFrame | None:
    """df if it is a series; else an error, or None with fail_mode="gracefully"."""
    try:
        cols = value_columns(df)
        if not cols:
            raise SeriesError("no numeric column")
        bad = F.sum(sum((F.when(~finite(F.col(c)), 1).otherwise(0) for c in cols), F.lit(0)))
        n, wrong = df.agg(F.count("*"), bad).first()
        if not n:
            raise SeriesError("an empty series")
        if wrong:
            raise SeriesError(f"{wrong} missing or non-finite values")
        return df
    except SeriesError:
        if fail_mode == "gracefully":
            return None
        raise


def finite(x: Column) -> Column:
    """Whether x is a number and neither NaN nor infinite; false for null."""
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def invalid_count(n: object, allow_none: bool = True) -> bool:
    """Whether n is no positive whole number up to 2^31 - 1."""
    if n is None:
        return not allow_none
    if isinstance(n, bool) or not isinstance(n, (int, float)) or n != n or abs(n) == float("inf"):
        return True
    return n != int(n) or not 1 <= n <= MAX_COUNT


def outside_unit_interval(p: object, allow_none: bool = True, closed: bool = False) -> bool:
    """Whether p is no number inside the unit interval, whose ends count only if it is closed."""
    if p is None:
        return not allow_none
    if isinstance(p, bool) or not isinstance(p, (int, float)) or p != p:
        return True
    return not (0 <= p <= 1 if closed else 0 < p < 1)


def checked_count(n: object, name: str) -> int | None:
    if invalid_count(n):
        raise ValueError(f"{name} must be a positive whole number, not {n!r}")
    return None if n is None else int(n)


# --- rows
def complete(df: DataFrame) -> DataFrame:
    """The rows without a missing value."""
    return df.dropna(subset=value_columns(df))


def complete_count(df: DataFrame) -> DataFrame:
    """(rows, complete): how many rows there are and how many miss nothing."""
    whole = F.lit(True)
    for c in value_columns(df):
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.agg(F.count("*").alias("rows"), F.count(F.when(whole, 1)).alias("complete"))


def join_on_time(frames: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One column a frame, outer-joined on `key`, and only the rows that all frames have."""
    out = None
    for name, df in frames.items():
        one = df.select(key, F.col(value).cast("double").alias(name))
        out = one if out is None else out.join(one, key, "full")
    if out is None:
        raise SeriesError("no frame to join")
    return out.dropna()


def head(series: DataFrame, n: int) -> DataFrame:
    """The first n rows of each series."""
    return series.where(F.col("t") < n)


def tail(series: DataFrame, n: int) -> DataFrame:
    """The last n rows of each series."""
    last = F.row_number().over(Window.partitionBy(*keys(series)).orderBy(F.desc("t")))
    return series.withColumn("_last", last).where(F.col("_last") <= n).drop("_last")


# --- series of the tables
def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of order prices: (t, v1). Sums are exact decimals, so the series is the same in any order of rows."""
    day = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("d"))
    return make_series(day.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v1")), ["d"], ["v1"])


def revenue_by_group(spark: SparkSession, sf_dir: str, groups: int = 100) -> DataFrame:
    """(series_id, t, v1): the daily sums of order prices of each of `groups` groups of customers."""
    group = (F.col("o_custkey") % groups).cast("string").alias("g")
    day = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(group, F.to_date("o_orderdate").alias("d"))
    return make_series(day.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v1")), ["d"], ["v1"], "g")


def daily_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of shipped lines: (t, quantity, price, discount, tax)."""
    names = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    day = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.to_date("l_shipdate").alias("d"))
    return make_series(day.agg(*((F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count("*")).alias(n) for n, c in names.items())), ["d"], list(names))


def simulated(spark: SparkSession, n_series: int, make: Callable[[int], np.ndarray], columns: list[str]) -> DataFrame:
    """(series_id, t, columns): series that make(number) draws, one task a series. make must depend on its number alone."""

    def run(key, pdf):
        y = np.asarray(make(int(key[0])), float)
        y = y.reshape(len(y), -1)
        return pd.DataFrame({"series_id": str(key[0]), "t": np.arange(len(y))} | {c: y[:, i] for i, c in enumerate(columns)})

    schema = "series_id string, t long, " + ", ".join(f"{c} double" for c in columns)
    return spark.range(n_series).groupBy("id").applyInPandas(run, schema)


def hash_uniform(*parts: Column | str | int) -> Column:
    """A uniform number in [0, 1) that depends on the parts alone: 32 bits of an MD5, the same in any engine and order."""
    text = F.concat_ws("-", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(F.encode(text, "utf-8")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# --- sinks
def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Save diagnostics: a folder a table, as Parquet or CSV with a header."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.parquet if fmt == "parquet" else w.option("header", True).csv)(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


@contextlib.contextmanager
def log_to(path: str | None, name: str = "serieslab") -> Iterator[logging.Logger]:
    """The library's logger, writing to a file as long as the block runs (nowhere without a path)."""
    log = logging.getLogger(name)
    handler: logging.Handler = logging.FileHandler(path) if path else logging.NullHandler()
    handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
    level = log.level
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    try:
        yield log
    finally:
        log.removeHandler(handler)
        log.setLevel(level)
        handler.close()
