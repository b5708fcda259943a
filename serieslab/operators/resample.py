"""Block resampling as a plan of blocks joined to the series.

A plan has one row per block (boot_id, block_no, start, len, pos0): it is generated from hashed uniforms, so it needs
no data but the series' lengths, and is the same on any cluster. Gathering explodes it to positions and joins them to
the series on (series_id, t); the series are broadcast while they are small and joined by a shuffle beyond.

Every operator takes one series (t, values) or many (series_id, t, values). Many series are resampled side by side:
sizes, block lengths and p are columns, replicates are dealt over (series_id, boot_id), and the series' id is part of
the hash, so series draw independently. Results carry series_id where the input does.

A series shorter than the default block length is one block; a constant series has no autocorrelation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.functions.regimes import chain_law, sample_pools, simulate_chain
from serieslab.sources.series import checked_count, hash_uniform, keys, materialise, outside_unit_interval, over_time, value_columns

BLOCK_TYPES = ("overlapping", "non-overlapping", "tapered")
TAPERS = ("cosine", "bartlett", "tukey")
BROADCAST_ROWS = 200_000
#: Rows of replicates that a task makes, about.
TASK_ROWS = 1_000_000
#: Replicates of one series that a task of the chain sampler walks.
CHUNK = 64


def _check(value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{value!r} is none of {allowed}")


def with_id(series: DataFrame) -> DataFrame:
    return series if keys(series) else series.withColumn("series_id", F.lit("all"))


def like(out: DataFrame, series: DataFrame) -> DataFrame:
    """out without series_id if the input has none."""
    return out if keys(series) else out.drop("series_id")


def salt_of(series: DataFrame) -> list[Column]:
    """What a series' draws depend on beside the seed: its id if there are many."""
    return [F.col("series_id")] if keys(series) else []


# --- lags and block lengths
def lagged(series: DataFrame, cols: list[str], p: int = 1) -> DataFrame:
    w = over_time(series)
    return series.select(*keys(series), "t", *cols, *(F.lag(c, i).over(w).alias(f"{c}_lag{i}") for i in range(1, p + 1) for c in cols))


def default_block_length(series: DataFrame, denominator: str = "inner") -> DataFrame:
    """(n, rho, block_length) of each series by the lag-1 rule.

    The denominator of a column's correlation leaves the first row out ("inner") or not ("full"); with "full" a mean
    correlation of 1 or none at all counts as 0.5.
    """
    _check(denominator, ("inner", "full"))
    cols, by = value_columns(series), keys(series)
    mean = lambda c: F.avg(c).over(Window.partitionBy(*by))
    both = lagged(series.select(*by, "t", *((F.col(c) - mean(c)).alias(c) for c in cols)), cols)
    inner = denominator == "inner"
    a = [F.sum(F.when(F.col("t") > 0, F.col(c) * F.col(f"{c}_lag1"))).alias(f"a_{c}") for c in cols]
    b = [F.sum(F.when((F.col("t") > 0) | F.lit(not inner), F.col(c) * F.col(c))).alias(f"b_{c}") for c in cols]
    sums = both.groupBy(*by).agg(F.count("*").alias("n"), *a, *b)
    one = lambda c: F.coalesce(F.when(F.col(f"b_{c}") > 0, F.abs(F.col(f"a_{c}") / F.col(f"b_{c}"))), F.lit(0.0))
    rho = sum((one(c) for c in cols), F.lit(0.0)) / len(cols)
    if not inner:
        rho = F.when(rho >= 1, 0.5).otherwise(rho)
    root = F.floor(F.sqrt("n"))
    length = F.when(F.col("rho") >= 1, root).otherwise(F.least(F.floor(10 / (1 - F.col("rho"))), root))
    return sums.select(*by, "n", rho.alias("rho")).select(*by, "n", "rho", F.least(F.col("n"), F.greatest(F.lit(5), length)).cast("int").alias("block_length"))


def taper_weight(i: Column, length: Column, taper: str, alpha: float = 0.5) -> Column:
    """The weight of place i (from 0) in a block of `length`; a block of one row has weight 1."""
    _check(taper, TAPERS)
    n = (length - 1).cast("double")
    if taper == "cosine":
        w = 0.5 * (1 - F.cos(2 * math.pi * i / n))
    elif taper == "bartlett":
        w = 1 - F.abs((i - n / 2) / (n / 2))
    elif alpha <= 0:
        w = F.lit(1.0)
    else:
        rise = 0.5 * (1 + F.cos(math.pi * (2 * i / (alpha * n) - 1)))
        fall = 0.5 * (1 + F.cos(math.pi * (2 * i / (alpha * n) - 2 / alpha + 1)))
        w = F.when(i < alpha * n / 2, rise).when(i <= n * (1 - alpha / 2), F.lit(1.0)).otherwise(fall)
    return F.when(length <= 1, F.lit(1.0)).otherwise(w)


# --- replicates and their blocks
def replicates(series: DataFrame, num_boots: int, block_length: int | None = None, n_boot: int | None = None, num_blocks: int | None = None) -> tuple[DataFrame, int]:
    """(series_id, boot_id, n, length, target) of every replicate, and the rows of all series.

    A replicate has n_boot rows, else num_blocks x block length, else its series' own. For many series a block length
    beyond a series' rows is cut to them; for one it is an error.
    """
    if block_length:
        sizes = series.groupBy(*keys(series)).agg(F.count("*").alias("n")).withColumn("length", F.least(F.lit(block_length), F.col("n")).cast("int"))
    else:
        sizes = default_block_length(series).withColumnRenamed("block_length", "length")
    spark = series.sparkSession
    if keys(series):
        sizes = materialise(sizes, "sizes")
        total = sizes.agg(F.sum("n")).first()[0] or 0
        frame = sizes.withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(num_boots - 1)))).repartition(_tasks(series, total * num_boots), "series_id", "boot_id")
    else:
        row = sizes.first()
        total = row["n"]
        if not total or block_length and block_length > total:
            raise ValueError(f"block_length must be from 1 to {total}")
        made = spark.range(0, num_boots, 1, _tasks(series, (n_boot or total) * num_boots))
        frame = made.select(F.lit("all").alias("series_id"), F.col("id").cast("int").alias("boot_id"), F.lit(total).cast("long").alias("n"), F.lit(row["length"]).alias("length"))
    target = F.lit(n_boot) if n_boot else F.col("length") * num_blocks if num_blocks else F.col("n")
    return frame.select("series_id", "boot_id", "n", "length", target.cast("long").alias("target")), total


def _tasks(series: DataFrame, rows: int) -> int:
    return int(min(100_000, max(series.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS)))


def moving_plan(frame: DataFrame, block_type: str = "overlapping", seed: int = 1, salt: list[Column] | None = None) -> DataFrame:
    """Blocks of one length; the last one is cut to the target."""
    _check(block_type, BLOCK_TYPES)
    n, length, target = F.col("n"), F.col("length"), F.col("target")
    blocks = frame.withColumn("block_no", F.explode(F.sequence(F.lit(0), (F.ceil(target / length) - 1).cast("int"))))
    u = hash_uniform(seed, *(salt or []), F.col("boot_id"), F.col("block_no"))
    start = F.floor(u * F.floor(n / length)) * length if block_type == "non-overlapping" else F.floor(u * (n - length + 1))
    pos0 = F.col("block_no").cast("long") * length
    return blocks.select("series_id", "boot_id", "n", "block_no", start.cast("long").alias("start"), length.alias("full"), F.least(length, target - pos0).cast("int").alias("len"), pos0.alias("pos0"))


def draw_until(frame: DataFrame, each: Callable[[Column], Column], mean: Column, salt: list[Column] | None = None) -> DataFrame:
    """frame with a row per block: block_no, block (what each(block_no) draws; its field len counts) and pos0, as many as reach the target.

    About as many blocks are drawn as the mean length asks for, with eight standard deviations to spare; a replicate
    for which that is not enough draws the most that it could need.
    """
    some = F.ceil(F.col("target") / mean + 8 * F.sqrt(F.col("target") / mean) + 8)
    upto = lambda k: F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), each)
    drawn = frame.withColumn("some", upto(F.least(some, F.col("target"))))
    short = F.aggregate("some", F.lit(0).cast("long"), lambda a, x: a + x["len"]) < F.col("target")
    drawn = drawn.select(*frame.columns, F.posexplode(F.when(short, upto(F.col("target"))).otherwise(F.col("some"))).alias("block_no", "block"))
    w = Window.partitionBy("series_id", "boot_id").orderBy("block_no")
    return drawn.withColumn("pos0", F.sum(F.col("block.len").cast("long")).over(w) - F.col("block.len")).where(F.col("pos0") < F.col("target"))


def stationary_plan(frame: DataFrame, p: float | Column, block_type: str = "overlapping", percentile: float = 0.99, fraction: float = 0.10, seed: int = 1, salt: list[Column] | None = None, circular: bool = True) -> DataFrame:
    """Blocks of geometric length, capped; as many as reach the target, the last one cut. Unless circular, no block runs over the series' end."""
    _check(block_type, BLOCK_TYPES)
    if not isinstance(p, Column) and outside_unit_interval(p, allow_none=False):
        raise ValueError("p must be between 0 and 1")
    for x in (percentile, fraction):
        if outside_unit_interval(x, allow_none=False, closed=True):
            raise ValueError("percentile and fraction must be from 0 to 1")
    lq = F.log(1 - (p if isinstance(p, Column) else F.lit(p)))
    quantile = F.ceil(F.log(F.lit(1 - percentile)) / lq)
    cap = F.greatest(F.lit(1), F.least(quantile, F.floor(fraction * F.col("n")), F.col("n"))).cast("int")
    frame = frame.withColumns({"lq": lq, "cap": cap})
    salt = salt or []

    def each(x: Column) -> Column:
        u = hash_uniform(seed, "len", *salt, F.col("boot_id"), x)
        return F.struct(F.least(F.floor(F.log(1 - u) / F.col("lq")).cast("int") + 1, F.col("cap")).alias("len"))

    mean = (1 - F.exp(F.col("lq") * F.col("cap"))) / (1 - F.exp(F.col("lq")))
    rows = draw_until(frame, each, mean)
    full, n = F.col("block.len"), F.col("n")
    v = hash_uniform(seed, "start", *salt, F.col("boot_id"), F.col("block_no"))
    start = F.floor(v * F.greatest(F.lit(1), F.floor(n / full))) * full if block_type == "non-overlapping" else F.floor(v * (n if circular else n - full + 1))
    return rows.select("series_id", "boot_id", "n", "block_no", start.cast("long").alias("start"), full.alias("full"), F.least(full, F.col("target") - F.col("pos0")).cast("int").alias("len"), "pos0")


def gather(plan: DataFrame, series: DataFrame, total: int, taper: str | None = None, alpha: float = 0.5, extra: tuple[str, ...] = ()) -> DataFrame:
    """boot_id, pos, block_no, src_t, w and the (weighted) values; rows wrap around the series' end."""
    cols = value_columns(series)
    at = plan.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
    w = taper_weight(F.col("i"), F.col("full"), taper, alpha) if taper else F.lit(1.0)
    at = at.select("series_id", "boot_id", (F.col("pos0") + F.col("i")).alias("pos"), "block_no", *extra, F.pmod(F.col("start") + F.col("i"), F.col("n")).cast("long").alias("src_t"), w.alias("w"))
    rows = values_at(at, series, total)
    return like(rows, series).select(*keys(series), "boot_id", "pos", "block_no", "src_t", "w", *extra, *((F.col(c) * F.col("w")).alias(c) for c in cols))


def values_at(at: DataFrame, series: DataFrame, total: int) -> DataFrame:
    """at (series_id, src_t, ...) with the series' values at src_t."""
    side = with_id(series).select("series_id", F.col("t").alias("src_t"), *value_columns(series))
    return at.join(_small(side, total), ["series_id", "src_t"])


def _small(df: DataFrame, total: int) -> DataFrame:
    """df, made of `total` rows of series, to be broadcast if they are few."""
    return F.broadcast(df) if total <= BROADCAST_ROWS else df


def block_bootstrap(series: DataFrame, bs_type: str = "moving", block_type: str = "overlapping", taper: str = "cosine", alpha: float = 0.5, block_length: int | None = None, n_boot: int | None = None, num_blocks: int | None = None, num_boots: int = 20, p: float | Column = 0.1, percentile: float = 0.99, fraction: float = 0.10, seed: int = 1, circular: bool = True) -> DataFrame:
    """Moving or stationary block replicates. Each has n_boot rows, else num_blocks x block_length, else the series' own."""
    _check(bs_type, ("moving", "stationary"))
    _check(block_type, BLOCK_TYPES)
    for name, x in (("block_length", block_length), ("n_boot", n_boot), ("num_blocks", num_blocks), ("num_boots", num_boots)):
        checked_count(x, name)
    frame, total = replicates(series, num_boots, block_length, n_boot, num_blocks)
    salt = salt_of(series)
    plan = moving_plan(frame, block_type, seed, salt) if bs_type == "moving" else stationary_plan(frame, p, block_type, percentile, fraction, seed, salt, circular)
    return gather(plan, series, total, taper if block_type == "tapered" else None, alpha)


def wild_bootstrap(series: DataFrame, num_boots: int = 20, seed: int = 1) -> DataFrame:
    """One sign for each row and replicate, shared by all columns."""
    checked_count(num_boots, "num_boots")
    rows = series.repartition(series.sparkSession.sparkContext.defaultParallelism, *keys(series), "t")
    rows = rows.withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(num_boots - 1)))).withColumnRenamed("t", "pos")
    sign = F.when(hash_uniform(seed, *salt_of(series), F.col("boot_id"), F.col("pos")) < 0.5, -1.0).otherwise(1.0)
    return rows.withColumn("w", sign).select(*keys(series), "boot_id", "pos", F.col("pos").alias("src_t"), "w", *((F.col(c) * F.col("w")).alias(c) for c in value_columns(series)))


# --- the stationary bootstrap's p
def geometric_p_table(series: DataFrame, method: str = "1/n", block_length: int | None = None) -> DataFrame:
    """(series_id, p): one over the block length, or one less the mean lag-1 (cross-)correlation ("plugin")."""
    _check(method, ("1/n", "plugin"))
    cols, by = value_columns(series), keys(series)
    if method == "1/n":
        if block_length:
            return series.select(*by).distinct().withColumn("p", F.lit(1.0 / block_length)) if by else series.sparkSession.range(1).select(F.lit(1.0 / block_length).alias("p"))
        return default_block_length(series).select(*by, (1.0 / F.col("block_length")).alias("p"))
    w = Window.partitionBy(*by)
    # A constant column correlates with nothing
    scaled = [F.coalesce(F.when(F.var_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)), F.lit(0.0)).alias(c) for c in cols]
    z = series.select(*by, "t", *scaled)
    z = z.select(*by, "t", sum((F.col(c) for c in cols), F.lit(0.0)).alias("z"))
    both = z.withColumn("l", F.lag("z").over(over_time(z)))
    rho = F.coalesce(F.sum(F.col("z") * F.col("l")), F.lit(0.0)) / (len(cols) ** 2 * F.count("*"))
    return both.groupBy(*by).agg(F.least(F.lit(0.999), F.greatest(F.lit(0.001), 1 - F.abs(rho))).alias("p"))


def geometric_p(series: DataFrame, method: str = "1/n", block_length: int | None = None) -> float:
    """The p of one series; see geometric_p_table."""
    return float(geometric_p_table(series, method, block_length).first()["p"])


# --- regimes
def runs(states: DataFrame) -> DataFrame:
    """Run-length encoding of (t, state): run_no, state, start, len."""
    w, by = over_time(states), keys(states)
    island = F.sum(F.when(F.col("state") == F.lag("state").over(w), 0).otherwise(1)).over(w)
    return states.select(*by, "t", "state", (island - 1).alias("run_no")).groupBy(*by, "run_no", "state").agg(F.min("t").alias("start"), F.count("*").cast("int").alias("len"))


def regime_bootstrap(series: DataFrame, states: DataFrame, num_boots: int = 20, n_boot: int | None = None, num_blocks: int | None = None, seed: int = 1) -> DataFrame:
    """Whole runs of one state, drawn evenly over the runs: until n_boot rows (the last is cut), else num_blocks runs.

    A state path shorter than its series belongs to the series' end.
    """
    for name, x in (("num_boots", num_boots), ("n_boot", n_boot), ("num_blocks", num_blocks)):
        checked_count(x, name)
    frame, total = replicates(series, num_boots, 1, n_boot or None)
    run = with_id(materialise(runs(states), "runs"))
    listed = run.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("run_no", "start", "len", "state"))).alias("runs"), F.sum("len").alias("m"), F.avg("len").alias("mean"))
    frame = frame.join(_small(listed, total), "series_id")  # a row a series, which holds its runs
    salt = salt_of(series)

    def each(x: Column) -> Column:
        u = hash_uniform(seed, *salt, F.col("boot_id"), x)
        return F.get("runs", F.floor(u * F.size("runs")).cast("int"))

    if num_blocks and not n_boot:
        drawn = frame.select(*frame.columns, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(num_blocks - 1)), each)).alias("block_no", "block"))
        w = Window.partitionBy("series_id", "boot_id").orderBy("block_no")
        drawn = drawn.withColumn("pos0", F.sum(F.col("block.len").cast("long")).over(w) - F.col("block.len"))
        cut = F.col("block.len")
    else:
        # Runs vary far more than geometric lengths do, so half the mean stands for it
        drawn = draw_until(frame, each, F.greatest(F.lit(1.0), F.col("mean") / 2))
        cut = F.least(F.col("block.len"), F.col("target") - F.col("pos0")).cast("int")
    plan = drawn.select("series_id", "boot_id", "n", "block_no", (F.col("block.start") + F.col("n") - F.col("m")).alias("start"), F.col("block.len").alias("full"), cut.alias("len"), "pos0", F.col("block.state").alias("state"))
    return gather(plan, series, total, extra=("state",))


def transition_counts(states: DataFrame) -> DataFrame:
    """(i, j, n, p): counted transitions, with zeros, and their shares by row. A state that is never left is kept: its p is 1."""
    by = keys(states)
    pairs = states.select(*by, "state", F.lead("state").over(over_time(states)).alias("next")).where("next is not null").groupBy(*by, F.col("state").alias("i"), F.col("next").alias("j")).agg(F.count("*").alias("n"))
    dim = states.groupBy(*by).agg(F.array_sort(F.collect_set("state")).alias("all"))
    grid = dim.select(*by, F.explode("all").alias("i"), "all").select(*by, "i", F.explode("all").alias("j"))
    full = grid.join(pairs, [*by, "i", "j"], "left").na.fill(0, ["n"])
    left = F.sum("n").over(Window.partitionBy(*by, "i"))
    return full.withColumn("p", F.when(left > 0, F.try_divide(F.col("n"), left)).otherwise((F.col("i") == F.col("j")).cast("double")))


def duration_table(transitions: DataFrame) -> DataFrame:
    """(state, duration): the expected rows of a stay, infinite where a state is never left."""
    stay = transitions.where("i = j")
    return stay.select(*keys(transitions), F.col("i").alias("state"), F.when(F.col("p") < 1, 1 / (1 - F.col("p"))).otherwise(F.lit(float("inf"))).alias("duration"))


def pools(states: DataFrame, least: int = 10) -> DataFrame:
    """(state, size, few): the rows of each state that a chain may draw from, and whether they are fewer than `least`."""
    return states.groupBy(*keys(states), "state").agg(F.count("*").alias("size")).withColumn("few", F.col("size") < least)


def pool_starts(states: DataFrame, length: int) -> DataFrame:
    """(state, t): the rows from which a pool has `length` consecutive ones, where a micro-block may start."""
    w = Window.partitionBy(*keys(states), "state").orderBy("t")
    found = states.select(*keys(states), "state", "t", F.lead("t", length - 1).over(w).alias("last")) if length > 1 else states.withColumn("last", F.col("t"))
    return found.where(F.col("last") == F.col("t") + length - 1).select(*keys(states), "state", "t")


def market(series: DataFrame, column: str | None = None) -> DataFrame:
    """(t, x): the series that regimes are told from, the mean of the columns or one of them."""
    cols = [column] if column else value_columns(series)
    return series.select(*keys(series), "t", (sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)).alias("x"))


def pool_bootstrap(series: DataFrame, states: DataFrame, num_boots: int = 20, n_boot: int | None = None, seed: int = 1, micro_block: int = 1) -> DataFrame:
    """A simulated Markov chain of states, each row drawn from its state's pool, or micro-blocks of consecutive rows inside a stay.

    The chain begins with the stationary law of the counted transitions. It is sequential by nature, so an Arrow task
    walks CHUNK replicates of a series, over the series' state path; draws are the hashed uniforms of the other plans.
    """
    for name, x in (("num_boots", num_boots), ("n_boot", n_boot), ("micro_block", micro_block)):
        checked_count(x, name)
    salted = bool(keys(series))
    path = with_id(states).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "state"))), lambda x: x["state"].cast("int")).alias("path"), F.min("t").alias("t0"))
    frame, total = replicates(series, num_boots, 1, n_boot)
    chunks = frame.groupBy("series_id", "target", F.floor(F.col("boot_id") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list("boot_id")).alias("boots")).join(_small(path, total), "series_id")

    def walk(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                states = np.asarray(r.path)
                law = chain_law(states)
                for boot in r.boots:
                    lead = f"{seed}-{r.series_id}" if salted else f"{seed}"
                    u = lambda what, k, lead=lead, boot=boot: int(hashlib.md5(f"{lead}-{what}-{boot}-{k}".encode()).hexdigest()[:8], 16) / 4294967296.0
                    sim = simulate_chain(int(r.target), law, lambda k, u=u: u("chain", k))
                    rows = sample_pools(states, sim, micro_block, lambda k, u=u: u("pool", k))
                    yield pd.DataFrame({"series_id": r.series_id, "boot_id": boot, "pos": np.arange(len(sim)), "src_t": rows + r.t0, "state": sim})

    at = chunks.select("series_id", "target", "boots", "path", "t0").mapInPandas(walk, "series_id string, boot_id int, pos long, src_t long, state int")
    return like(values_at(at, series, total), series).select(*keys(series), "boot_id", "pos", "src_t", "state", *value_columns(series))


def recover_blocks(boots: DataFrame, series: DataFrame) -> DataFrame:
    """Blocks found from values alone: each row's nearest source row, a new block where it isn't the one after the last (mod n).

    Distances are squared Euclidean and ties go to the first row. Equal rows are looked up once, by an Arrow task a
    series (of one series, a task a share of the rows, each with the whole series).
    """
    cols, by = value_columns(series), keys(series)
    if "src_t" in boots.columns:
        boots = boots.drop("src_t")
    rows = boots.select(*by, *cols).distinct()

    def nearest(pdf: pd.DataFrame, source: pd.DataFrame) -> pd.DataFrame:
        source = source.sort_values(["t"])
        x, want = source[cols].to_numpy(float), pdf[cols].to_numpy(float)
        out = np.empty(len(want), np.int64)
        for a in range(0, len(want), 256):
            d = ((want[a : a + 256, None, :] - x[None]) ** 2).sum(axis=2)
            out[a : a + 256] = d.argmin(axis=1)
        return pdf.assign(src_t=source["t"].to_numpy()[out])

    schema = ", ".join([*(f"{c} string" for c in by), *(f"{c} double" for c in cols), "src_t long"])
    if by:
        found = rows.groupBy(*by).cogroup(series.groupBy(*by)).applyInPandas(nearest, schema)
    else:
        # One series: chunks of rows against the whole series, which is bounded by the caller's choice of this operator
        source = series.sparkSession.sparkContext.broadcast(series.toPandas())
        found = rows.mapInPandas(lambda it: (nearest(pdf, source.value) for pdf in it), schema)
    same = [boots[c].eqNullSafe(found[c]) for c in (*by, *cols)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    placed = boots.join(found, condition).select(*(boots[c] for c in by), boots["boot_id"], boots["pos"], found["src_t"])
    sizes = series.groupBy(*by).agg(F.count("*").alias("n"))
    placed = placed.join(sizes, by) if by else placed.withColumn("n", F.lit(series.count()))
    w = Window.partitionBy(*by, "boot_id").orderBy("pos")
    new = F.when(F.col("src_t") == F.pmod(F.lag("src_t").over(w) + 1, F.col("n")), 0).otherwise(1)
    marked = placed.withColumn("new", new).withColumn("block_num", F.sum("new").over(w))
    return marked.groupBy(*by, "boot_id", "block_num").agg(F.count("*").alias("length"), F.min_by("src_t", "pos").alias("start_pos"))
