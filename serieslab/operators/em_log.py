"""The events of EM fits as one long table, and what is read from it by relational operations.

events: series_id, event (iteration, parameter, sigma, boundary, warning), iteration, state, item (a margin's number),
name, value, note. A fit of many series has all their events in one table, partitioned by series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslab.functions.switching import EmLog
from serieslab.sources.series import read_tables, write_tables

EVENTS = "series_id string, event string, iteration int, state int, item int, name string, value double, note string"
NAMES = [x.split()[0] for x in EVENTS.split(", ")]
KEY = "series_id"


def rows(log: EmLog, series_id: str = "all") -> list[tuple]:
    """A fit's log as event rows."""
    out: list[tuple] = []
    for r in log.iterations:
        out += [(series_id, "iteration", r["iteration"], None, None, n, float(r[n]), None) for n in ("loglik_before", "loglik_after", "change", "seconds", "converged")]
    out += [(series_id, "parameter", r["iteration"], r["state"], None, r["name"], r["value"], None) for r in log.parameters]
    for r in log.sigma:
        out += [(series_id, "sigma", r["iteration"], r["state"], r["series"], n, float(r[n]), None) for n in ("mean", "sd", "min", "max", "changed")]
    out += [(series_id, "boundary", r["iteration"], r["state"], None, r["name"], r["value"], f"{r['side']}: {r['action']}") for r in log.boundary]
    return [*out, *((series_id, "warning", r["iteration"], None, None, r["kind"], None, r["message"]) for r in log.warnings)]


def table(log: EmLog, series_id: str = "all") -> pd.DataFrame:
    return pd.DataFrame(rows(log, series_id), columns=NAMES).astype({"iteration": "Int32", "state": "Int32", "item": "Int32"}) if rows(log) else pd.DataFrame({c: [] for c in NAMES})


# --- tables
def _wide(events: DataFrame, event: str, by: list[str], names: list[str]) -> DataFrame:
    return events.where(F.col("event") == event).groupBy(KEY, *by).pivot("name", names).agg(F.first("value"))


def iterations(events: DataFrame) -> DataFrame:
    """iteration, loglik_before, loglik_after, change, seconds, decreased, converged."""
    out = _wide(events, "iteration", ["iteration"], ["loglik_before", "loglik_after", "change", "seconds", "converged"])
    return out.withColumn("decreased", F.col("change") < -1e-6).withColumn("converged", F.col("converged") > 0)


def parameters(events: DataFrame, state: int | None = None, name: str | None = None) -> DataFrame:
    """iteration, state, name, value; of one state or parameter if given. A name without a number finds the numbered ones too."""
    out = events.where("event = 'parameter'").select(KEY, "iteration", "state", "name", "value")
    out = out if state is None else out.where(F.col("state") == state)
    if name is None:
        return out
    plain = F.regexp_replace("name", "^corr_", "")
    return out.where((F.col("name") == name) | (plain == name) | (F.regexp_extract("name", "^(.*)_[0-9]+$", 1) == name) | (F.regexp_extract(plain, "^(.*?)[0-9]*$", 1) == name))


def sigmas(events: DataFrame, state: int | None = None, item: int | None = None) -> DataFrame:
    """iteration, state, item, mean, sd, min, max, changed of the volatility."""
    out = _wide(events, "sigma", ["iteration", "state", "item"], ["mean", "sd", "min", "max", "changed"]).withColumn("changed", F.col("changed") > 0)
    out = out if state is None else out.where(F.col("state") == state)
    return out if item is None else out.where(F.col("item") == item)


def boundaries(events: DataFrame) -> DataFrame:
    return events.where("event = 'boundary'").select(KEY, "iteration", "state", "name", "value", F.split("note", ": ", 2)[0].alias("side"), F.split("note", ": ", 2)[1].alias("action"))


def warnings(events: DataFrame) -> DataFrame:
    return events.where("event = 'warning'").select(KEY, "iteration", F.col("name").alias("kind"), F.col("note").alias("message"))


def warning_counts(events: DataFrame) -> DataFrame:
    return warnings(events).groupBy(KEY, "kind").agg(F.count("*").alias("n"))


# --- trajectories
def model_type(events: DataFrame) -> DataFrame:
    """(series_id, model): gogarch, cgarch or dcc by the parameters there are, else univariate."""
    has = lambda e: F.max(F.when(e, 1).otherwise(0)) > 0
    p = events.where("event = 'parameter'")
    n = F.col("name")
    return p.groupBy(KEY).agg(F.when(has(n == "corr_gamma"), "cgarch").when(has(n.startswith("corr_")), "dcc").when(has(n.rlike("_2$")), "gogarch").otherwise("univariate").alias("model"))


def likelihoods(events: DataFrame, which: str = "after") -> DataFrame:
    """iteration, value: the log-likelihood before or after each M-step, or its change."""
    name = {"after": "loglik_after", "before": "loglik_before", "change": "change"}[which]
    return events.where((F.col("event") == "iteration") & (F.col("name") == name)).select(KEY, "iteration", "value")


def trajectory(events: DataFrame, state: int = 0) -> DataFrame:
    """iteration, alpha, beta, gamma, shape and persistence of one state's correlation."""
    p = parameters(events, state).withColumn("short", F.regexp_replace("name", "^corr_", "")).where(F.col("name").startswith("corr_") | (F.col("name") == "shape"))
    out = p.groupBy(KEY, "iteration").pivot("short", ["alpha", "beta", "gamma", "shape"]).agg(F.first("value"))
    return out.withColumn("persistence", F.col("alpha") + F.col("beta") + 0.5 * F.coalesce("gamma", F.lit(0.0)))


def trajectory_with_likelihood(events: DataFrame, state: int = 0) -> DataFrame:
    return trajectory(events, state).join(likelihoods(events).withColumnRenamed("value", "loglik"), [KEY, "iteration"], "left")


def component_trajectory(events: DataFrame, state: int = 0, component: int | None = None) -> DataFrame:
    """iteration, component, alpha, beta, persistence of each component's volatility."""
    part = F.regexp_extract("name", "^(alpha|beta)1?(?:_([0-9]+))?$", 1)
    number = F.regexp_extract("name", "^(?:alpha|beta)1?(?:_([0-9]+))?$", 1)
    p = parameters(events, state).withColumns({"part": part, "component": F.coalesce(F.try_to_number(F.nullif(number, F.lit("")), F.lit("999999")).cast("int"), F.lit(1))}).where("part <> ''")
    out = p.groupBy(KEY, "iteration", "component").pivot("part", ["alpha", "beta"]).agg(F.sum("value")).withColumn("persistence", F.col("alpha") + F.col("beta"))
    return out if component is None else out.where(F.col("component") == component)


def normalised_parameters(events: DataFrame, normalise: bool = False) -> DataFrame:
    """Every parameter's path, from 0 to 1 if normalised (0.5 where it never moved)."""
    p = parameters(events)
    if not normalise:
        return p
    w = Window.partitionBy(KEY, "state", "name")
    spread = F.max("value").over(w) - F.min("value").over(w)
    return p.withColumn("value", F.when(spread > 0, F.try_divide(F.col("value") - F.min("value").over(w), spread)).otherwise(0.5))


def plot_table(events: DataFrame, which: str, normalise: bool = False) -> DataFrame:
    """What lies behind a plot: ll_evolution, parameters or sigma."""
    if which == "ll_evolution":
        return iterations(events).select(KEY, "iteration", "loglik_after", "change")
    if which == "parameters":
        return normalised_parameters(events, normalise)
    if which == "sigma":
        return sigmas(events)
    raise ValueError(f"{which!r} is none of ll_evolution, parameters, sigma")


# --- checks
def monotonicity(events: DataFrame, tolerance: float = 1e-4, allowed: int = 2) -> DataFrame:
    """violations (changes below -tolerance), the worst one, and passed: at most `allowed` of them."""
    c = likelihoods(events, "change")
    bad = F.sum(F.when(F.col("value") < -tolerance, 1).otherwise(0))
    return c.groupBy(KEY).agg(bad.alias("violations"), F.min("value").alias("worst"), (bad <= allowed).alias("passed"))


def convergence(events: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """iterations, final_change, marked and converged."""
    i = iterations(events)
    out = i.groupBy(KEY).agg(F.count("*").alias("iterations"), F.max_by("change", "iteration").alias("final_change"), F.max("converged").alias("marked"))
    return out.withColumn("converged", F.col("marked") | (F.abs("final_change") < tolerance))


def sigma_failures(events: DataFrame) -> DataFrame:
    """state, item, failures: how often a volatility did not move between iterations."""
    return sigmas(events).where(~F.col("changed")).groupBy(KEY, "state", "item").agg(F.count("*").alias("failures"), F.array_sort(F.collect_list("iteration")).alias("iterations"))


def final_parameters(events: DataFrame, state: int | None = None) -> DataFrame:
    """state, name, value at the last iteration."""
    p = parameters(events, state)
    return p.groupBy(KEY, "state", "name").agg(F.max_by("value", "iteration").alias("value"))


def _piece(last: DataFrame) -> DataFrame:
    """state, item, part, value: omega, alpha, beta of margins (item 1 and up) and of the correlation (item 0), summed over orders."""
    margin = "^(omega|alpha|beta)[0-9]*(?:_([0-9]+))?$"
    corr = "^corr_(alpha|beta|gamma)"
    part = F.when(F.col("name").rlike(corr), F.regexp_extract("name", corr, 1)).otherwise(F.regexp_extract("name", margin, 1))
    number = F.nullif(F.regexp_extract("name", margin, 2), F.lit(""))
    item = F.when(F.col("name").rlike(corr), 0).otherwise(F.coalesce(F.try_to_number(number, F.lit("999999")).cast("int"), F.lit(1)))
    return last.withColumns({"part": part, "item": item}).where("part <> ''").groupBy(KEY, "state", "item", "part").agg(F.sum("value").alias("value"))


def violations(events: DataFrame, state: int | None = None) -> DataFrame:
    """state, item, name, value, constraint of every final parameter that breaks one; no row if all hold."""
    piece = _piece(final_parameters(events, state))
    sign = piece.where(((F.col("part") == "omega") & (F.col("value") <= 0)) | ((F.col("part") != "omega") & (F.col("value") < 0)))
    sign = sign.select(KEY, "state", "item", F.col("part").alias("name"), "value", F.when(F.col("part") == "omega", "> 0").otherwise(">= 0").alias("constraint"))
    total = piece.where("part in ('alpha', 'beta')").groupBy(KEY, "state", "item").agg(F.sum("value").alias("value")).where("value >= 1")
    return sign.unionByName(total.select(KEY, "state", "item", F.lit("alpha + beta").alias("name"), "value", F.lit("< 1").alias("constraint")))


def one_iteration(events: DataFrame, number: int) -> DataFrame:
    """Everything that happened in one iteration."""
    return events.where(F.col("iteration") == number)


def compare_states(events: DataFrame) -> DataFrame:
    """omega_range and its relative size, alpha_range of the correlations, and whether the states look alike."""
    piece = _piece(final_parameters(events))
    omega = F.when((F.col("item") == 1) & (F.col("part") == "omega"), F.col("value"))
    alpha = F.when((F.col("item") == 0) & (F.col("part") == "alpha"), F.col("value"))
    out = piece.groupBy(KEY).agg(F.count_distinct("state").alias("states"), (F.max(omega) - F.min(omega)).alias("omega_range"), F.try_divide(F.max(omega) - F.min(omega), F.avg(omega)).alias("omega_relative"), F.when(F.count(alpha) > 0, F.max(alpha) - F.min(alpha)).alias("alpha_range"))
    return out.withColumn("similar", F.coalesce(F.col("omega_relative") < 0.2, F.lit(False)) | F.coalesce(F.col("alpha_range") < 0.05, F.lit(False)))


def last_range(events: DataFrame, last: int = 5) -> DataFrame:
    """state, name, spread of each parameter over its last iterations, where there are as many."""
    p = parameters(events)
    nth = F.row_number().over(Window.partitionBy(KEY, "state", "name").orderBy(F.desc("iteration")))
    tail = p.withColumn("nth", nth).where(F.col("nth") <= last)
    return tail.groupBy(KEY, "state", "name").agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("spread")).where(F.col("n") == last)


def problems(events: DataFrame, state: int | None = None) -> DataFrame:
    """state, problem: what is suspicious about the final parameters and the last five iterations.

    Correlations: constancy, persistence above 0.95 and 0.98, gamma above 0.3 or negative, shapes below 3 (4 for a
    copula) or above 100, alpha or beta still moving by more than 0.05. Margins and components: persistence above
    0.99, alpha still moving.
    """
    last = final_parameters(events, state)
    part = _piece(last)
    value = lambda item, name: F.max(F.when((F.col("item") == item) & (F.col("part") == name), F.col("value")))
    corr = part.groupBy(KEY, "state").agg(value(0, "alpha").alias("alpha"), value(0, "beta").alias("beta"), value(0, "gamma").alias("gamma"))
    shape = last.where("name = 'shape'").select(KEY, "state", F.col("value").alias("shape"))
    corr = corr.join(shape, [KEY, "state"], "left").withColumn("p", F.col("alpha") + F.col("beta") + 0.5 * F.coalesce("gamma", F.lit(0.0)))
    say = lambda when, text, *args: F.when(when, F.format_string(text, *args))
    found: list[Column] = [
        say(F.col("p") > 0.98, "very high correlation persistence (%.4f)", F.col("p")),
        say((F.col("p") > 0.95) & (F.col("p") <= 0.98), "high correlation persistence (%.4f)", F.col("p")),
        say(F.col("gamma") > 0.3, "high asymmetry (%.3f)", F.col("gamma")),
        say(F.col("gamma") < 0, "negative asymmetry (%.3f)", F.col("gamma")),
        say(F.col("shape") < 3, "shape %.2f is below 3", F.col("shape")),
        say((F.col("shape") >= 3) & (F.col("shape") < 4) & F.col("alpha").isNotNull(), "shape %.2f is below 4", F.col("shape")),
        say(F.col("shape") > 100, "shape %.0f is as good as normal", F.col("shape")),
    ]
    out = corr.select(KEY, "state", F.explode(F.array_compact(F.array(*found))).alias("problem"))
    margin = part.where("item > 0 and part in ('alpha', 'beta')").groupBy(KEY, "state", "item").agg(F.sum("value").alias("p")).where("p > 0.99")
    out = out.unionByName(margin.select(KEY, "state", F.format_string("component %d has persistence %.4f", "item", "p").alias("problem")))
    moving = last_range(events).where(F.col("name").rlike("^(corr_)?(alpha|beta)") & (F.col("spread") > 0.05))
    moving = moving if state is None else moving.where(F.col("state") == state)
    out = out.unionByName(moving.select(KEY, "state", F.format_string("%s still moves (%.4f)", "name", "spread").alias("problem")))
    constant = boundaries(events).where("action like 'constant correlation%' or action like 'refitted%'").select(KEY, "state", F.lit("correlation became constant").alias("problem")).distinct()
    return out.unionByName(constant if state is None else constant.where(F.col("state") == state))


def all_states_constant(events: DataFrame) -> DataFrame:
    """(series_id, iteration): when all states of a fit came to have constant correlation."""
    return warnings(events).where("kind = 'all_states_constant'").groupBy(KEY).agg(F.min("iteration").alias("iteration"))


def overview(events: DataFrame) -> DataFrame:
    """One row a fit: counts of iterations, states, warnings and boundary events, likelihood changes, seconds, converged."""
    count = lambda e: F.sum(F.when(F.col("event") == e, 1).otherwise(0))
    counts = events.groupBy(KEY).agg(F.count_distinct("state").alias("states"), count("warning").alias("warnings"), count("boundary").alias("boundary_events"))
    i = iterations(events).groupBy(KEY).agg(F.sum("change").alias("improvement"), F.avg("change").alias("mean_change"), F.min("change").alias("min_change"), F.max("change").alias("max_change"), F.sum(F.col("decreased").cast("int")).alias("decreases"), F.sum("seconds").alias("seconds"))
    return counts.join(i, KEY, "left").join(convergence(events), KEY, "left")


def describe(events: DataFrame) -> str:
    """The overview and warnings in words."""
    lines = []
    for r in overview(events).orderBy(KEY).limit(20).collect():  # the first 20 fits of a report
        lines.append(f"{r[KEY]}: {r['iterations']} iterations, {r['states']} states, likelihood {r['improvement']:+.4f} ({r['decreases']} falls), {r['seconds']:.2f} s, {'converged' if r['converged'] else 'not converged'}, {r['boundary_events']} boundary events, {r['warnings']} warnings")
    lines += [f"  {r['kind']}: {r['n']}" for r in warnings(events).groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect()]
    return "\n".join(lines)


# --- sinks
def export_csv(events: DataFrame, folder: str) -> None:
    """iterations, boundaries and warnings as CSV with headers."""
    write_tables({"em_iterations": iterations(events).coalesce(1), "boundary_events": boundaries(events).coalesce(1), "warnings": warnings(events).coalesce(1)}, folder, "csv")


def save(events: DataFrame, folder: str) -> None:
    write_tables({"events": events}, folder)


def load(spark, folder: str) -> DataFrame:
    return read_tables(spark, folder, ["events"])["events"]


def as_numpy(log: EmLog, name: str, state: int = 0) -> np.ndarray:
    """One parameter's path of a log that is at hand."""
    return np.array([r["value"] for r in log.parameters if r["name"] == name and r["state"] == state])
