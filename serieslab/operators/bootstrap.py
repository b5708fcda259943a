"""One front door: six resamplers, a statistic per replicate, its averages, the fit and diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslab.functions import switching
from serieslab.operators import cv, diagnostics, fits, resample, summary
from serieslab.sources.series import checked_count, keys, outside_unit_interval, validate, value_columns

TYPES = ("moving", "stationary", "hmm", "msvar", "ms_varma_garch", "wild")
#: Laws of hidden Markov emissions without and of switching GARCH with a variance model.
RAW = ("norm_raw", "std_raw", "sstd_raw")
GARCH_LAWS = ("norm", "snorm", "std", "sstd", "ged", "sged")


@dataclass
class Bootstrap:
    """series: the replicates. func_outs: (boot_id, name[, idx], value). func_out_means: their averages. fit: states and probabilities by row."""

    series: DataFrame
    func_outs: DataFrame | None = None
    func_out_means: DataFrame | None = None
    fit: DataFrame | None = None
    diagnostics: diagnostics.Diagnostics | None = None
    config: dict = field(default_factory=dict)


def bootstrap(
    series: DataFrame, bs_type: str = "moving", n_boot: int | None = None, block_length: int | None = None, num_blocks: int | None = None, num_boots: int = 100, *,
    func: Callable | dict[str, Callable[[str], Column]] | None = None, apply_func_to: str = "cols", block_type: str = "overlapping", taper: str = "cosine", taper_alpha: float = 0.5,
    p: float | None = None, p_method: str = "1/n", model_func: Callable = cv.MeanModel, score_func: Callable = cv.mse, percentile: float = 0.99, fraction: float = 0.10,
    num_states: int = 2, distribution: str = "gaussian", variance_model: str = "sGARCH", micro_block_length: int = 1, regime_basis: str | int = "market",
    specs: list[switching.StateSpec] | None = None, d: int = 0, control: dict | None = None, return_fit: bool = False, return_diagnostics: bool = False, graceful: bool = False, seed: int = 1,
) -> Bootstrap | None:
    """Resample one series, or many by series_id, and apply a statistic to each replicate.

    func is a dict of Column aggregates (run as one aggregate by Spark), or a Python function of an array (a column,
    with apply_func_to "cols") or of a frame (all columns, with "all"). Without one there are no outs. The hidden
    Markov types draw whole runs of a state for gaussian emissions, and rows of simulated states' pools for the others;
    msvar and ms_varma_garch draw whole runs. A wild replicate has the rows of its series. Bad data are an error, or
    give None if graceful.
    """
    for value, allowed in ((bs_type, TYPES), (apply_func_to, ("cols", "all")), (p_method, ("1/n", "plugin", "cv"))):
        if value not in allowed:
            raise ValueError(f"{value!r} is none of {allowed}")
    for name, x in (("n_boot", n_boot), ("block_length", block_length), ("num_blocks", num_blocks), ("num_boots", num_boots), ("num_states", num_states), ("micro_block_length", micro_block_length)):
        checked_count(x, name)
    if outside_unit_interval(p):
        raise ValueError("p must be between 0 and 1")
    if validate(series, "gracefully" if graceful else "predictably") is None:
        return None
    config = {"block_length": block_length, "block_type": block_type, "n_boot": n_boot, "num_blocks": num_blocks, "seed": seed}
    decoded = None
    if bs_type in ("moving", "stationary"):
        used: float | Column = p or 0.1
        if bs_type == "stationary" and p is None:
            used = _estimate_p(series, p_method, block_length, model_func, score_func)
            config["p"] = used if not isinstance(used, Column) else p_method
        elif bs_type == "stationary":
            config["p"] = p
        source = series
        if isinstance(used, Column):  # one p a series
            table = resample.geometric_p_table(series, p_method, block_length)
            boots = _stationary_by_series(series, table, block_type, taper, taper_alpha, block_length, n_boot, num_blocks, num_boots, percentile, fraction, seed)
        else:
            boots = resample.block_bootstrap(source, bs_type, block_type, taper, taper_alpha, block_length, n_boot, num_blocks, num_boots, used, percentile, fraction, seed)
    elif bs_type == "wild":
        boots = resample.wild_bootstrap(series, num_boots, seed)
    else:
        decoded = _decode(series, bs_type, num_states, distribution, variance_model, regime_basis, specs, d, control or {})
        states = decoded.select(*keys(series), "t", "state")
        if bs_type == "hmm" and distribution != "gaussian":
            boots = resample.pool_bootstrap(series, states, num_boots, n_boot, seed, micro_block_length)
        else:
            boots = resample.regime_bootstrap(series, states, num_boots, n_boot, num_blocks, seed)
    out = Bootstrap(boots, config=config, fit=decoded if return_fit else None)
    if func is not None:
        if isinstance(func, dict):
            out.func_outs = summary.apply_columns(boots, func)
        else:
            out.func_outs = (summary.apply_each if apply_func_to == "cols" else summary.apply_frames)(boots, func, graceful)
        out.func_out_means = summary.averages(out.func_outs)
    if return_diagnostics:
        out.diagnostics = diagnostics.compute(boots, series, bs_type, config)
        if decoded is not None:
            out.diagnostics.record(states=decoded.select(*keys(series), "t", "state"), num_states=num_states)
    return out


def _estimate_p(series: DataFrame, method: str, block_length: int | None, model: Callable, score: Callable) -> float | Column:
    if method == "cv":
        if keys(series):
            raise ValueError("p by cross-validation takes one series")
        return cv.cv_p(series, value_columns(series)[0], model=model, score=score)
    return F.col("p") if keys(series) else resample.geometric_p(series, method, block_length)


def _stationary_by_series(series: DataFrame, p: DataFrame, block_type: str, taper: str, alpha: float, block_length: int | None, n_boot: int | None, num_blocks: int | None, num_boots: int, percentile: float, fraction: float, seed: int) -> DataFrame:
    frame, total = resample.replicates(series, num_boots, block_length, n_boot, num_blocks)
    plan = resample.stationary_plan(frame.join(p.withColumn("p", F.least(F.lit(0.999), "p")), "series_id"), F.col("p"), block_type, percentile, fraction, seed, resample.salt_of(series))
    return resample.gather(plan, series, total, taper if block_type == "tapered" else None, alpha)


def _decode(series: DataFrame, bs_type: str, states: int, distribution: str, variance_model: str, basis: str | int, specs: list[switching.StateSpec] | None, d: int, control: dict) -> DataFrame:
    """(series_id, t, state, p0, ...) of the fitted regimes, computed once."""
    cols = value_columns(series)
    if bs_type == "hmm":
        if distribution == "gaussian":
            found = fits.decode(series, cols, "hmm", states, diagonal=True)
        elif distribution in RAW:
            found = fits.decode(series, cols, "hmm_law", states, law=distribution.removesuffix("_raw"), basis=basis)
        elif distribution in GARCH_LAWS:
            found = fits.decode(series, cols, "ms_garch", states, model=variance_model, law=distribution, basis=basis)
        else:
            raise ValueError(f"{distribution!r} is none of {('gaussian', *RAW, *GARCH_LAWS)}")
    elif bs_type == "msvar":
        if len(cols) < 2:
            raise ValueError("msvar needs two columns or more")
        found = fits.decode(series, cols, "msvar", states)
    else:
        specs = specs or switching.specs("univariate" if len(cols) == 1 else "dcc", states)
        found = fits.decode(series, cols, "switching", len(specs), state_specs=specs, d=d, **control)
    found = resample.materialise(found, "states")
    return found if keys(series) else found.drop("series_id")
