"""Errors and intervals of correlation models: Hessian, sandwich, bootstrap and profile, and the likelihood's surface.

A bootstrap replicate, a point of a grid or a point of a profile is a row of a task of its own; residuals (rows x
columns of one series, bounded by what a task holds) and weights go to the tasks once. Estimates come back as rows
(boot_id, name, value), and everything after them is an aggregate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from serieslab.functions import dcc, dist, ica
from serieslab.functions.garch import GarchFit, fit_garch, simulate_garch
from serieslab.functions.optim import crossings, profile

METHODS = ("residual", "parametric")
KINDS = ("dcc", "cgarch", "adcc")
#: Rows x columns that may be sent to every task.
MOST_CELLS = 20_000_000


@dataclass
class Problem:
    """Residuals z (a copula's: scores), weights, and the model over them."""

    z: np.ndarray
    w: np.ndarray | None = None
    kind: str = "dcc"
    law: str = "mvn"
    qbar: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"{self.kind!r} is none of {KINDS}")
        if self.z.size > MOST_CELLS:
            raise ValueError(f"{self.z.size} values are too many to send to every task")
        self.qbar = dcc.weighted_correlation(self.z, self.w) if self.qbar is None else self.qbar

    @property
    def options(self) -> dict:
        nbar = dcc.negative_moment(self.z) if self.kind == "adcc" else None
        return {"law": self.law, "asymmetric": self.kind == "adcc", "copula": self.kind != "dcc", "nbar": nbar}

    def names(self) -> list[str]:
        return dcc.start_of(self.kind == "adcc", self.law)[0]

    def fit(self) -> dcc.DccFit:
        return dcc.fit(self.z, self.w, self.law, self.kind == "adcc", self.kind != "dcc", self.qbar)

    def nll(self, par: np.ndarray) -> float:
        return dcc.nll(par, self.z, self.qbar, self.w, **self.options)

    def errors(self, par: np.ndarray, method: str = "hessian") -> dict:
        return dcc.errors(par, self.z, self.qbar, self.w, method, **self.options)

    def again(self, seed: list[int], par: np.ndarray, method: str) -> Problem:
        """The problem of one replicate: rows drawn evenly (with their weights), or simulated at par."""
        rng = np.random.default_rng(seed)
        n, k = self.z.shape
        if method == "residual":
            rows = rng.integers(0, n, n)
            return Problem(self.z[rows], None if self.w is None else self.w[rows], self.kind, self.law)
        gamma = par[2] if self.kind == "adcc" else 0.0
        z = dcc.simulate_residuals(n, k, par[0], par[1], self.qbar, seed, self.law, par[-1] if self.law == "mvt" else None, gamma, dcc.negative_moment(self.z) if gamma else None)
        return Problem(z, self.w, self.kind, self.law)


def residuals_of(series: DataFrame, cols: list[str], kind: str = "dcc", law: str = "mvn") -> Problem:
    """The Problem of one series: its standardised residuals, or for copulas their scores."""
    from serieslab.functions import copula

    y = series.select("t", *cols).orderBy("t").toPandas()[cols].to_numpy(float)  # one series, as a task holds it
    f = copula.fit_two_stage(y - y.mean(axis=0), law=law, copula=kind != "dcc", force_constant=True)
    return Problem(f.z, None, kind, law)


# --- bootstrap
def bootstrap_estimates(spark: SparkSession, problem: Problem, par: np.ndarray, n_boot: int = 200, method: str = "residual", seed: int = 1) -> DataFrame:
    """(boot_id, name, value): the model fitted anew to each replicate; null where a fit failed."""
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {METHODS}")
    shared = spark.sparkContext.broadcast((problem, np.asarray(par, float)))

    def run(batches):
        p, at = shared.value
        for pdf in batches:
            out = []
            for b in pdf["id"]:
                try:
                    found = p.again([seed, int(b)], at, method).fit()
                    values = found.vector() if found.converged else np.full(len(at), np.nan)
                except (np.linalg.LinAlgError, ValueError):
                    values = np.full(len(at), np.nan)
                out += [(int(b), n, None if math.isnan(v) else float(v)) for n, v in zip(p.names(), values, strict=True)]
            yield pd.DataFrame(out, columns=["boot_id", "name", "value"]).astype({"boot_id": "int32"})

    return spark.range(0, n_boot, 1, min(n_boot, 1000)).mapInPandas(run, "boot_id int, name string, value double")


def bootstrap_table(estimates: DataFrame, mle: dict[str, float], level: float = 0.95) -> DataFrame:
    """name, estimate, n_valid, n, mean, se, bias, percentile and basic intervals, reason.

    Only replicates of which no parameter is missing count. Fewer than three give nulls; fewer than half, a warning
    for a reason.
    """
    a = (1 - level) / 2
    whole = F.min(F.col("value").isNotNull()).over(Window.partitionBy("boot_id"))
    rows = estimates.withColumn("whole", whole)
    v = F.when(F.col("whole"), F.col("value"))
    known = F.create_map(*(x for k, e in mle.items() for x in (F.lit(k), F.lit(float(e)))))
    out = rows.groupBy("name").agg(F.count("*").alias("n"), F.count(v).alias("n_valid"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("se"), F.percentile(v, a).alias("lower"), F.percentile(v, 1 - a).alias("upper"))
    enough = F.col("n_valid") >= 3
    out = out.withColumn("estimate", F.element_at(known, F.col("name")))
    reason = F.when(~enough, "insufficient").when(F.col("n_valid") < F.col("n") / 2, "few_valid").otherwise("ok")
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("mean", "se", "lower", "upper")})
    return out.select("name", "estimate", "n", "n_valid", "mean", "se", (F.col("mean") - F.col("estimate")).alias("bias"), "lower", "upper", (2 * F.col("estimate") - F.col("upper")).alias("basic_lower"), (2 * F.col("estimate") - F.col("lower")).alias("basic_upper"), reason.alias("reason"))


def bootstrap_errors(spark: SparkSession, problem: Problem, mle: dict[str, float] | None = None, n_boot: int = 200, method: str = "residual", seed: int = 1, level: float = 0.95) -> DataFrame:
    """bootstrap_table of a DCC, copula or asymmetric model at its estimates."""
    mle = mle or problem.fit().par
    return bootstrap_table(bootstrap_estimates(spark, problem, np.array(list(mle.values())), n_boot, method, seed), mle, level)


def gogarch_bootstrap(spark: SparkSession, fit: ica.GogarchFit, w: np.ndarray | None = None, n_boot: int = 200, method: str = "residual", seed: int = 1, level: float = 0.95) -> DataFrame:
    """component, and bootstrap_table's columns, of each component's volatility: a task for each component and replicate."""
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {METHODS}")
    shared = spark.sparkContext.broadcast((fit.ica.s, fit.fits, w))

    def one(c: np.ndarray, f: GarchFit, weight: np.ndarray | None, key: list[int]) -> np.ndarray:
        rng = np.random.default_rng(key)
        if method == "residual":
            rows = rng.integers(0, len(c), len(c))
            return fit_garch(c[rows], None if weight is None else weight[rows], f.spec, f.par).par
        v = f.values
        law = {k: v[k] for k in ("skew", "shape") if k in v}
        return fit_garch(simulate_garch(len(c), v["omega"], v["alpha1"], v["beta1"], int(rng.integers(2**31)), law=f.spec.law, **law), weight, f.spec, f.par).par

    def run(batches):
        s, fits, weight = shared.value
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                f = fits[r.component - 1]
                values = one(s[:, r.component - 1], f, weight, [seed, int(r.component), int(r.boot_id)])
                out += [(r.component, r.boot_id, n, float(x) if math.isfinite(x) else None) for n, x in zip(f.spec.names(), values, strict=True)]
            yield pd.DataFrame(out, columns=["component", "boot_id", "name", "value"]).astype({"component": "int32", "boot_id": "int32"})

    k = len(fit.fits)
    tasks = spark.range(0, k * n_boot, 1, min(k * n_boot, 1000)).select((F.col("id") % k + 1).cast("int").alias("component"), F.floor(F.col("id") / k).cast("int").alias("boot_id"))
    est = tasks.mapInPandas(run, "component int, boot_id int, name string, value double").withColumn("name", F.format_string("%s_%d", "name", "component"))
    mle = {f"{n}_{i}": v for i, f in enumerate(fit.fits, 1) for n, v in f.values.items()}
    # Components fail apart from each other, so each has replicates of its own
    own = est.withColumn("boot_id", F.col("boot_id") * k + F.col("component") - 1)
    table = bootstrap_table(own, mle, level)
    return table.withColumn("component", F.regexp_extract("name", "_([0-9]+)$", 1).cast("int"))


# --- grids
def surface(spark: SparkSession, problem: Problem, alpha: tuple[float, float] = (0.01, 0.20), beta: tuple[float, float] = (0.70, 0.98), points: int = 50, shape: float = 8.0) -> DataFrame:
    """alpha, beta, nll on a grid, null where the pair is not stationary; a task takes a share of the points."""
    shared = spark.sparkContext.broadcast(problem)
    rest = ([0.0] if problem.kind == "adcc" else []) + ([shape] if problem.law == "mvt" else [])

    def run(batches):
        p = shared.value
        for pdf in batches:
            v = [p.nll(np.array([a, b, *rest])) if a + b < 0.9999 else None for a, b in zip(pdf["alpha"], pdf["beta"], strict=True)]
            yield pd.DataFrame({"alpha": pdf["alpha"], "beta": pdf["beta"], "nll": [None if x is None or x >= dcc.PENALTY else x for x in v]})

    step = lambda r, i: F.lit(r[0]) + i * (r[1] - r[0]) / max(1, points - 1)
    grid = spark.range(0, points * points, 1, min(points, 200)).select(step(alpha, F.floor(F.col("id") / points)).alias("alpha"), step(beta, F.col("id") % points).alias("beta"))
    return grid.mapInPandas(run, "alpha double, beta double, nll double")


def surface_minimum(grid: DataFrame) -> DataFrame:
    return grid.where("nll is not null").agg(F.min(F.struct("nll", "alpha", "beta")).alias("m")).select("m.alpha", "m.beta", "m.nll")


def profile_points(spark: SparkSession, problem: Problem, mle: dict[str, float], names: list[str] | None = None, points: int = 50, span: float = 4.0) -> DataFrame:
    """(name, at, rise): the profile likelihood over its least, other parameters minimised anew at each point.

    A side of a parameter is a task, walked outwards, so each point starts from its neighbour's result.
    """
    par, order = np.array(list(mle.values())), list(mle)
    se = problem.errors(par)["se"]
    wide = [span * s if np.isfinite(s) else 0.5 * max(abs(p), 0.05) for p, s in zip(par, se, strict=True)]
    wanted = names or order
    shared = spark.sparkContext.broadcast((problem, par, wide))
    base = problem.nll(par)

    def run(batches):
        p, x, width = shared.value
        for pdf in batches:
            for r in pdf.itertuples():
                k = order.index(r.name)
                top = 0.9998 if r.name in ("alpha", "beta") else 0.5 if r.name == "gamma" else 100.0
                low = 2.1 if r.name == "shape" else 1e-5
                end = max(low, min(top, x[k] + r.side * width[k]))
                at = np.linspace(x[k], end, points // 2 + 1)[1:]
                lower = np.array([2.1 if n == "shape" else 1e-6 for n in order])
                upper = np.array([100.0 if n == "shape" else 0.999 for n in order])
                rise = profile(p.nll, x, k, at, True, lower, upper) - base
                yield pd.DataFrame({"name": r.name, "at": at, "rise": rise})

    tasks = spark.createDataFrame([(n, s) for n in wanted for s in (-1, 1)], "name string, side int").repartition(2 * len(wanted), "name", "side")
    return tasks.mapInPandas(run, "name string, at double, rise double")


def profile_intervals(points: DataFrame, mle: dict[str, float], level: float = 0.95) -> DataFrame:
    """name, estimate, lower, upper: where the rise reaches half the chi-square, interpolated between points.

    A side on which it never does ends at its outermost point.
    """
    drop = dist.chi2_quantile(level, 1) / 2
    known = F.create_map(*(x for k, e in mle.items() for x in (F.lit(k), F.lit(float(e)))))
    rows = points.withColumn("estimate", F.element_at(known, F.col("name"))).withColumn("side", F.when(F.col("at") < F.col("estimate"), "lower").otherwise("upper"))
    w = Window.partitionBy("name", "side").orderBy(F.abs(F.col("at") - F.col("estimate")))
    near = rows.withColumns({"before": F.coalesce(F.lag("at").over(w), F.col("estimate")), "was": F.coalesce(F.lag("rise").over(w), F.lit(0.0))})
    cross = F.col("before") + (F.col("at") - F.col("before")) * F.try_divide(F.lit(drop) - F.col("was"), F.col("rise") - F.col("was"))
    far = F.abs(F.col("at") - F.col("estimate"))
    first = F.min(F.when((F.col("rise") >= drop) & (F.col("was") < drop), F.struct(far.alias("far"), cross.alias("x"))))
    ends = near.groupBy("name", "estimate", "side").agg(F.coalesce(first["x"], F.max_by("at", far)).alias("end"))
    return ends.groupBy("name", "estimate").pivot("side", ["lower", "upper"]).agg(F.first("end"))


def local_profile(problem: Problem, mle: dict[str, float], name: str, points: int = 50, level: float = 0.95) -> tuple[float, float]:
    """The same interval without Spark, for one parameter of one series."""
    par, k = np.array(list(mle.values())), list(mle).index(name)
    s = problem.errors(par)["se"][k]
    wide = 4 * s if np.isfinite(s) else 0.5 * max(abs(par[k]), 0.05)
    at = np.linspace(max(1e-5, par[k] - wide), par[k] + wide, points)
    lower, upper = np.full(len(par), 1e-6), np.array([100.0 if n == "shape" else 0.999 for n in mle])
    rise = profile(problem.nll, par, k, at, True, lower, upper) - problem.nll(par)
    return crossings(at, rise, par[k], dist.chi2_quantile(level, 1) / 2)


# --- all of it side by side
def comprehensive(spark: SparkSession, problem: Problem, n_boot: int = 200, boot_method: str = "residual", points: int = 50, level: float = 0.95, seed: int = 1) -> DataFrame:
    """name, estimate, hessian, sandwich and bootstrap errors with their intervals, the profile's, and the ratio of Hessian to bootstrap.

    A ratio below 0.7 says that the Hessian makes the estimate look better than it is.
    """
    found = problem.fit()
    mle, par = found.par, found.vector()
    h, s = problem.errors(par), problem.errors(par, "sandwich")
    ci = dcc.wald(par, h["se"], level)
    clean = lambda x: None if not np.isfinite(x) else float(x)
    local = [(n, float(p), clean(a), clean(b), clean(c[0]), clean(c[1])) for n, p, a, b, c in zip(mle, par, h["se"], s["se"], ci, strict=True)]
    out = spark.createDataFrame(local, "name string, estimate double, se_hessian double, se_sandwich double, wald_lower double, wald_upper double")
    boot = bootstrap_errors(spark, problem, mle, n_boot, boot_method, seed, level).select("name", "n_valid", F.col("se").alias("se_bootstrap"), "bias", F.col("lower").alias("boot_lower"), F.col("upper").alias("boot_upper"), "reason")
    out = out.join(boot, "name", "left")
    if points:
        prof = profile_intervals(profile_points(spark, problem, mle, [n for n in mle if n != "shape"], points), mle, level)
        out = out.join(prof.select("name", F.col("lower").alias("profile_lower"), F.col("upper").alias("profile_upper")), "name", "left")
    ratio = F.try_divide(F.col("se_hessian"), F.col("se_bootstrap"))
    return out.withColumn("ratio", ratio).withColumn("doubtful", F.coalesce(ratio < 0.7, F.lit(False)))


def gogarch_comprehensive(spark: SparkSession, fit: ica.GogarchFit, w: np.ndarray | None = None, n_boot: int = 200, boot_method: str = "residual", level: float = 0.95, seed: int = 1) -> DataFrame:
    """component, name, estimate, Hessian and bootstrap errors, intervals and their ratio."""
    clean = lambda x: None if not np.isfinite(x) else float(x)
    local = [(r["component"], f"{r['name']}_{r['component']}", r["estimate"], clean(r["se"]), clean(r["lower"]), clean(r["upper"]), r["reason"]) for r in ica.summary(fit, w, level)]
    out = spark.createDataFrame(local, "component int, name string, estimate double, se_hessian double, wald_lower double, wald_upper double, gate string")
    boot = gogarch_bootstrap(spark, fit, w, n_boot, boot_method, seed, level).select("name", F.col("se").alias("se_bootstrap"), F.col("lower").alias("boot_lower"), F.col("upper").alias("boot_upper"), "n_valid")
    return out.join(boot, "name", "left").withColumn("ratio", F.try_divide(F.col("se_hessian"), F.col("se_bootstrap")))


def describe(table: DataFrame) -> str:
    """A comprehensive table in words; it has a row a parameter."""
    lines = []
    for r in table.orderBy("name").collect():
        said = [f"{r['name']}: {r['estimate']:.4f}"]
        said += [f"{label} {r[c]:.4f}" for c, label in (("se_hessian", "Hessian"), ("se_sandwich", "sandwich"), ("se_bootstrap", "bootstrap")) if c in table.columns and r[c] is not None]
        said += [f"{label} [{r[a]:.4f}, {r[b]:.4f}]" for a, b, label in (("wald_lower", "wald_upper", "Wald"), ("boot_lower", "boot_upper", "percentile"), ("profile_lower", "profile_upper", "profile")) if a in table.columns and r[a] is not None]
        lines.append(", ".join(said) + (", Hessian doubtful" if "doubtful" in table.columns and r["doubtful"] else ""))
    return "\n".join(lines)


def errors_table(spark: SparkSession, fit: dcc.DccFit, z: np.ndarray, w: np.ndarray | None = None, method: str = "hessian", level: float = 0.95) -> DataFrame:
    """name, estimate, se, lower, upper, reason of a correlation's fit, behind the boundary and definiteness gates."""
    e = dcc.gated_errors(fit, z, w, method)
    ci = dcc.wald(fit.vector(), e["se"], level)
    clean = lambda x: None if not np.isfinite(x) else float(x)
    rows = [(n, v, clean(s), clean(c[0]), clean(c[1]), e["reason"]) for (n, v), s, c in zip(fit.par.items(), e["se"], ci, strict=True)]
    return spark.createDataFrame(rows, "name string, estimate double, se double, lower double, upper double, reason string")
