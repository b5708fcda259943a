"""Diagnostics of replicates as tables: blocks, statistics, coverage, regimes, and what lies behind each plot."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.operators.resample import recover_blocks, runs
from serieslab.operators.summary import original_stats_of, stats_of, variables
from serieslab.sources.series import keys, over_time

PLOTS = ("block_lengths", "start_positions", "means_comparison", "acf_comparison", "length_distribution")
STYLES = ("ribbon", "line", "bands_alpha")


# --- blocks
def blocks_of(boots: DataFrame) -> DataFrame:
    """replicate, block_num, length, start_pos of each block."""
    return boots.groupBy(*keys(boots), F.col("boot_id").alias("replicate"), F.col("block_no").alias("block_num")).agg(F.count("*").alias("length"), F.min_by("src_t", "pos").alias("start_pos"))


def blocks_by_source(boots: DataFrame, n: int) -> DataFrame:
    """Blocks found from source rows alone: a new one begins where the source isn't the next row (mod n)."""
    by = [*keys(boots), "boot_id"]
    w = Window.partitionBy(*by).orderBy("pos")
    new = F.when(F.col("src_t") == F.pmod(F.lag("src_t").over(w) + 1, F.lit(n)), 0).otherwise(1)
    marked = boots.select(*by, "pos", "src_t", new.alias("new")).withColumn("block_num", F.sum("new").over(w))
    return marked.groupBy(*by, "block_num").agg(F.count("*").alias("length"), F.min_by("src_t", "pos").alias("start_pos"))


def block_stats(blocks: DataFrame) -> DataFrame:
    """One row: n, mean, sd, min, max, median and quartiles of block lengths, and blocks a replicate."""
    q = lambda p: F.percentile("length", p)
    per = F.count("*") / F.count_distinct("replicate")
    return blocks.groupBy(*keys(blocks)).agg(F.count("*").alias("n_blocks"), F.avg("length").alias("mean"), F.stddev_samp("length").alias("sd"), F.min("length").alias("min"), F.max("length").alias("max"), F.median("length").alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), per.alias("per_replicate"))


# --- coverage
def coverage(boots: DataFrame, series: DataFrame) -> DataFrame:
    """t, times: how often each source row was sampled, 0 where never."""
    by = keys(series)
    counted = boots.groupBy(*by, F.col("src_t").alias("t")).agg(F.count("*").alias("times"))
    return series.select(*by, "t").join(counted, [*by, "t"], "left").na.fill(0, ["times"])


def coverage_summary(cover: DataFrame) -> DataFrame:
    """never sampled, mean, max and the coefficient of variation."""
    return cover.groupBy(*keys(cover)).agg(F.sum(F.when(F.col("times") == 0, 1).otherwise(0)).alias("never"), F.avg("times").alias("mean"), F.max("times").alias("max"), (F.stddev_samp("times") / F.avg("times")).alias("cv"))


def coverage_by_replicate(boots: DataFrame, most: int = 20) -> DataFrame:
    """boot_id, t, times of the first replicates: a heat map's cells that are not 0."""
    return boots.where(F.col("boot_id") < most).groupBy(*keys(boots), "boot_id", F.col("src_t").alias("t")).agg(F.count("*").alias("times"))


def block_segments(boots: DataFrame, most: int = 20) -> DataFrame:
    """replicate, block_num, start, end: where blocks lie, for the first replicates."""
    rows = blocks_of(boots.where(F.col("boot_id") < most))
    return rows.select(*keys(rows), "replicate", "block_num", F.col("start_pos").alias("start"), (F.col("start_pos") + F.col("length") - 1).alias("end"))


# --- everything of one run
@dataclass
class Diagnostics:
    """The tables of one bootstrap: blocks, replicate_stats (by variable), original_stats; meta, config and extra are small dicts."""

    meta: dict
    replicate_stats: DataFrame
    original_stats: DataFrame
    blocks: DataFrame | None = None
    boots: DataFrame | None = None
    config: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    def record(self, **items) -> Diagnostics:
        self.extra |= items
        return self

    def tables(self) -> dict[str, DataFrame]:
        spark = self.replicate_stats.sparkSession
        said = [(k, str(v)) for part in (self.meta, self.config, self.extra) for k, v in part.items() if not isinstance(v, DataFrame)]
        out = {"meta": spark.createDataFrame(said, "name string, value string"), "replicate_stats": self.replicate_stats, "original_stats": self.original_stats}
        return out | ({"blocks": self.blocks} if self.blocks is not None else {})


def compute(boots: DataFrame, series: DataFrame, bs_type: str, config: dict | None = None) -> Diagnostics:
    """Diagnostics of replicates; blocks come from the plan if the replicates kept it, else from the values alone."""
    blocks = None
    if "block_no" in boots.columns:
        blocks = blocks_of(boots)
    elif bs_type in ("moving", "stationary"):
        blocks = recover_blocks(boots, series).withColumnRenamed("boot_id", "replicate")
    meta = {"bs_type": bs_type, "n_vars": len(variables(boots)), "n_original": series.count(), "num_boots": boots.agg(F.count_distinct("boot_id")).first()[0]}
    return Diagnostics(meta, stats_of(boots), original_stats_of(series), blocks, boots, config or {})


def wide(d: Diagnostics) -> DataFrame:
    """replicate, length, and mean, sd and ac1 of each variable in columns."""
    names = sorted(r["name"] for r in d.original_stats.select("name").distinct().collect())  # the series' columns
    stats = [F.first(s).alias(s) for s in ("mean", "sd", "ac1")]
    by = [*keys(d.replicate_stats), "boot_id", "length"]
    return d.replicate_stats.groupBy(*by).pivot("name", names).agg(*stats).withColumnRenamed("boot_id", "replicate")


def frame(d: Diagnostics, what: str = "stats") -> DataFrame | None:
    """"stats", "blocks", or "all": the statistics left-joined to each replicate's block summary."""
    if what == "blocks":
        return d.blocks
    if what not in ("stats", "all"):
        raise ValueError(f"{what!r} is none of stats, blocks, all")
    rows = wide(d)
    if what == "stats" or d.blocks is None:
        return rows
    by = [*keys(d.blocks), "replicate"]
    blocks = d.blocks.groupBy(*by).agg(F.count("*").alias("n_blocks"), F.avg("length").alias("mean_block_length"), F.stddev_samp("length").alias("sd_block_length"))
    return rows.join(blocks, by, "left")


def summary_stats(d: Diagnostics) -> DataFrame:
    """(name, stat, mean, sd, q025 .. q975, original): each statistic's spread over replicates beside the original's."""
    by = keys(d.replicate_stats)
    rows = d.replicate_stats.unpivot([*by, "boot_id", "name"], [F.col(c) for c in ("mean", "sd", "ac1")], "stat", "value")
    first = d.original_stats.unpivot([*by, "name"], [F.col(c) for c in ("mean", "sd", "ac1")], "stat", "original")
    q = lambda p: F.percentile("value", p)
    out = rows.groupBy(*by, "name", "stat").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), *(q(p).alias(n) for p, n in ((0.025, "q025"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.975, "q975"))))
    return out.join(first, [*by, "name", "stat"], "left").withColumn("bias", F.col("mean") - F.col("original"))


def length_stats(d: Diagnostics) -> DataFrame:
    """min, max, mean and sd of replicate lengths, and whether they differ."""
    one = d.replicate_stats.select(*keys(d.replicate_stats), "boot_id", "length").distinct()
    return one.groupBy(*keys(one)).agg(F.min("length").alias("min"), F.max("length").alias("max"), F.avg("length").alias("mean"), F.stddev_samp("length").alias("sd"), (F.min("length") < F.max("length")).alias("varies"))


def describe(d: Diagnostics) -> str:
    """The diagnostics in words, from aggregates of a few rows."""
    lines = ["Bootstrap diagnostics", *(f"  {k}: {v}" for k, v in d.meta.items())]
    if d.config:
        lines += ["Configuration", *(f"  {k}: {'derived' if v is None else v}" for k, v in d.config.items())]
    one = length_stats(d).first()
    lines += ["Lengths", f"  {one['min']} to {one['max']}, mean {one['mean']:.2f}" + (", variable" if one["varies"] else "")]
    if d.blocks is not None:
        b = block_stats(d.blocks).first()
        lines += ["Blocks", f"  {b['n_blocks']} in all, {b['per_replicate']:.2f} a replicate", f"  length {b['min']} to {b['max']}, mean {b['mean']:.2f}, median {b['median']:g}, quartiles {b['q25']:g} and {b['q75']:g}"]
    lines.append("Original and bootstrap")
    for r in summary_stats(d).where("stat <> 'sd'").orderBy("name", "stat").collect():  # two rows a variable
        lines.append(f"  {r['name']} {r['stat']}: {r['original']:.4f}, {r['mean']:.4f} (sd {0.0 if r['sd'] is None else r['sd']:.4f}, bias {r['bias']:.4f})")
    lines += [f"  {k}: {v}" for k, v in d.extra.items() if not isinstance(v, DataFrame)]
    return "\n".join(lines)


def headline(d: Diagnostics) -> str:
    return f"{d.meta['bs_type']} bootstrap: {d.meta['num_boots']} replicates of {d.meta['n_original']} rows, {d.meta['n_vars']} variables"


# --- behind the plots
def block_length_table(blocks: DataFrame, p: float | None = None) -> DataFrame:
    """length, n, share and, if p is given, the geometric probability of that length."""
    rows = blocks.groupBy(*keys(blocks), "length").agg(F.count("*").alias("n"))
    rows = rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys(blocks))))
    return rows if p is None else rows.withColumn("expected", F.lit(p) * F.pow(F.lit(1 - p), F.col("length") - 1))


def start_position_table(blocks: DataFrame, n: int, bins: int = 30) -> DataFrame:
    return blocks.groupBy(*keys(blocks), F.width_bucket(F.col("start_pos").cast("double"), F.lit(0.0), F.lit(float(n)), F.lit(bins)).alias("bucket")).agg(F.count("*").alias("n"))


def comparison_table(d: Diagnostics, stat: str) -> DataFrame:
    """boot_id, name, value and the original's value of a statistic (mean or ac1)."""
    by = keys(d.replicate_stats)
    first = d.original_stats.select(*by, "name", F.col(stat).alias("original"))
    return d.replicate_stats.select(*by, "boot_id", "name", F.col(stat).alias("value")).join(first, [*by, "name"])


def plot_table(d: Diagnostics, which: str) -> DataFrame | None:
    """The tidy table behind a plot; None where there are no blocks."""
    if which not in PLOTS:
        raise ValueError(f"{which!r} is none of {PLOTS}")
    if which == "means_comparison":
        return comparison_table(d, "mean")
    if which == "acf_comparison":
        return comparison_table(d, "ac1")
    if which == "length_distribution":
        return d.replicate_stats.select(*keys(d.replicate_stats), "boot_id", "length").distinct()
    if d.blocks is None:
        return None
    return block_length_table(d.blocks, d.config.get("p")) if which == "block_lengths" else start_position_table(d.blocks, d.meta["n_original"])


# --- regimes
def regime_shares(rows: DataFrame, states: list[int], labels: list[str] | None = None) -> DataFrame:
    """state, n, share, with zeros for states that don't occur."""
    dim = rows.sparkSession.range(1).select(F.explode(F.array(*(F.lit(s).cast("int") for s in states))).alias("state"))
    counted = rows.groupBy(F.col("state").cast("int").alias("state")).agg(F.count("*").alias("c"))
    out = dim.join(counted, "state", "left").select("state", F.coalesce("c", F.lit(0)).alias("n"))
    out = out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
    return out.withColumn("label", F.element_at(F.create_map(*(x for s, l in zip(states, labels, strict=True) for x in (F.lit(s), F.lit(l)))), F.col("state"))) if labels else out


def replicate_shares(boots: DataFrame, states: list[int]) -> DataFrame:
    """state, original-like mean share over replicates, with zeros for states that a replicate lacks."""
    per = boots.groupBy("boot_id").agg(*((F.sum(F.when(F.col("state") == s, 1).otherwise(0)) / F.count("*")).alias(f"s{s}") for s in states))
    return per.agg(*(F.avg(f"s{s}").alias(str(s)) for s in states)).unpivot([], [F.col(f"`{s}`") for s in states], "state", "mean_share").withColumn("state", F.col("state").cast("int"))


def regime_summary(states: DataFrame, boots: DataFrame, names: list[int], labels: list[str] | None = None) -> DataFrame:
    """state, n, share of the original and the mean share over replicates."""
    return regime_shares(states, names, labels).join(replicate_shares(boots, names), "state")


def regime_bands(states: DataFrame, label: str = "original") -> DataFrame:
    """series, state, xmin, xmax of each run of one state."""
    return runs(states).select(*keys(states), F.lit(label).alias("series"), "state", F.col("start").alias("xmin"), (F.col("start") + F.col("len") - 1).alias("xmax"))


def probability_table(probs: DataFrame, columns: list[str], label: str = "original") -> DataFrame:
    """(t, p0, p1, ...) as (t, state, p, series)."""
    rows = probs.unpivot([*keys(probs), "t"], [F.col(c) for c in columns], "name", "p")
    number = F.element_at(F.create_map(*(x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i)))), F.col("name"))
    return rows.select(*keys(probs), "t", number.alias("state"), "p", F.lit(label).alias("series"))


def replicate_probabilities(boots: DataFrame, probs: DataFrame, states: int = 2) -> DataFrame:
    """boot_id, pos, state, p: each row's source probabilities; 1 for its own state where the source has none."""
    by = keys(boots)
    grid = boots.select(*by, "boot_id", "pos", "src_t", F.col("state").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(states - 1))).alias("state"))
    side = probs.select(*(c for c in by if c in probs.columns), F.col("t").alias("src_t"), F.col("state").cast("int").alias("state"), "p")
    joined = grid.join(side, [c for c in (*by, "src_t", "state") if c in side.columns], "left")
    return joined.select(*by, "boot_id", "pos", "state", F.coalesce("p", (F.col("own") == F.col("state")).cast("double")).alias("p"))


def stacked(probs: DataFrame) -> DataFrame:
    """(t, state, p) with the band ymin..ymax of each state."""
    w = Window.partitionBy(*keys(probs), *(["series"] if "series" in probs.columns else []), "t").orderBy("state")
    return probs.withColumn("ymax", F.sum("p").over(w)).withColumn("ymin", F.col("ymax") - F.col("p"))


def probability_bands(probs: DataFrame) -> DataFrame:
    """A band one row wide for each row and state: xmin, xmax and p."""
    return probs.withColumn("xmin", F.col("t") - 0.5).withColumn("xmax", F.col("t") + 0.5)


def probability_layer(probs: DataFrame, style: str = "ribbon") -> DataFrame:
    """What a style draws: lines, stacked ribbons or bands."""
    if style not in STYLES:
        raise ValueError(f"{style!r} is none of {STYLES}")
    return probs if style == "line" else stacked(probs) if style == "ribbon" else probability_bands(probs)


def regime_composition(series: DataFrame, states: DataFrame, boots: DataFrame, col: str, replicate: int = 0, prices: bool = True, initial: float = 100.0) -> DataFrame:
    """series, x, value, state: the original and one replicate, as prices or as they are, each row with its regime."""
    one = boots.where(F.col("boot_id") == replicate).select(F.lit(f"replicate {replicate}").alias("series"), F.col("pos").alias("x"), F.col(col).alias("v"), F.col("state").cast("int").alias("state"))
    first = series.join(states.select("t", F.col("state").cast("int").alias("state")), "t").select(F.lit("original").alias("series"), F.col("t").alias("x"), F.col(col).alias("v"), "state")
    rows = first.unionByName(one)
    w = Window.partitionBy("series").orderBy("x")
    unit: Column = F.when(F.max(F.abs(F.col("v"))).over(Window.partitionBy("series")) > 1, 100.0).otherwise(1.0)
    value = initial * F.exp(F.sum(F.col("v") / F.col("unit")).over(w)) if prices else F.col("v")
    return rows.withColumn("unit", unit).select("series", "x", value.alias("value"), "state")


def longest_run(states: DataFrame) -> DataFrame:
    """state, longest: the longest stay in each state."""
    return runs(states).groupBy(*keys(states), "state").agg(F.max("len").alias("longest"))


def relative_time(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """col over the least of its group."""
    return df.withColumn("Relative", F.col(col) / F.min(col).over(Window.partitionBy(*by)))


def lag_one(series: DataFrame, col: str) -> DataFrame:
    """t, v, before: each value beside the one before it."""
    return series.select(*keys(series), "t", F.col(col).alias("v"), F.lag(col).over(over_time(series)).alias("before"))
