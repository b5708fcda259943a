"""Monte-Carlo studies of the fits: one simulated series a row, fitted in a task; the study is an aggregate of the rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from serieslab.functions import copula, dcc, dist, ica
from serieslab.functions.garch import standardised
from serieslab.operators import inference

ROWS = "sim long, name string, est double, se double, true double, converged boolean"


def simulations(spark: SparkSession, n_sim: int, one: Callable[[int], list[tuple[str, float, float, float, bool]]]) -> DataFrame:
    """(sim, name, est, se, true, converged) of one(number) for each simulation; nulls for what is not finite."""

    def run(batches):
        for pdf in batches:
            out = []
            for sim in pdf["id"]:
                out += [(int(sim), n, *(float(x) if np.isfinite(x) else None for x in (e, s, t)), bool(c)) for n, e, s, t, c in one(int(sim))]
            yield pd.DataFrame(out, columns=["sim", "name", "est", "se", "true", "converged"])

    return spark.range(0, n_sim, 1, min(n_sim, 1000)).mapInPandas(run, ROWS)


def dcc_study(spark: SparkSession, n_sim: int = 100, n_obs: int = 500, k: int = 2, alpha: float = 0.05, beta: float = 0.90, omega: np.ndarray | None = None, arch: np.ndarray | None = None, garch: np.ndarray | None = None, law: str = "mvn", shape: float = 8.0, seed: int = 12345) -> DataFrame:
    """DCC fits of simulated DCC-GARCH series; residuals are those of the true margins if they are given."""
    true = {"alpha": alpha, "beta": beta} | ({"shape": shape} if law == "mvt" else {})

    def one(sim: int) -> list:
        y = dcc.simulate(n_obs, k, alpha, beta, None, omega, arch, garch, seed + sim, law, shape if law == "mvt" else None)
        if omega is not None and arch is not None and garch is not None:
            z = standardised(y, np.resize(omega, k), np.resize(arch, k), np.resize(garch, k))
        else:
            z = copula.fit_two_stage(y, force_constant=True).z
        return _fitted(z, true, law, False, False)

    return simulations(spark, n_sim, one)


def _fitted(z: np.ndarray, true: dict[str, float], law: str, asymmetric: bool, copula_: bool) -> list:
    f = dcc.fit(z, None, law, asymmetric, copula_)
    e = dcc.gated_errors(f, z, copula=copula_)
    return [(n, v, s, true.get(n, np.nan), f.converged) for (n, v), s in zip(f.par.items(), e["se"], strict=True)]


def copula_study(spark: SparkSession, n_sim: int = 100, n_obs: int = 500, k: int = 2, alpha: float = 0.05, beta: float = 0.90, gamma: float | None = None, law: str = "mvn", shape: float = 8.0, transform: str = "parametric", seed: int = 12345) -> DataFrame:
    """Copula DCC (asymmetric with gamma) fits of simulated copula series; the errors are those of the model that is fitted."""
    true = {"alpha": alpha, "beta": beta} | ({"gamma": gamma} if gamma is not None else {}) | ({"shape": shape} if law == "mvt" else {})

    def one(sim: int) -> list:
        y = copula.simulate(n_obs, k, alpha, beta, gamma or 0.0, law, shape, seed=seed + sim)
        z = copula.fit_two_stage(y, law=law, copula=True, transform=transform, copula_shape=shape, force_constant=True).z
        return _fitted(z, true, law, gamma is not None, True)

    return simulations(spark, n_sim, one)


def gogarch_study(spark: SparkSession, n_sim: int = 100, n_obs: int = 500, k: int = 3, omega: np.ndarray | None = None, arch: np.ndarray | None = None, garch: np.ndarray | None = None, law: str = "norm", method: str = "radical", seed: int = 12345) -> DataFrame:
    """Orthogonal GARCH fits of simulated mixtures: each component's persistence, and the Amari distance and angle of the mixing matrix (true 0)."""

    def one(sim: int) -> list:
        y, s, a = ica.simulate(n_obs, k, None, omega, arch, garch, law, seed=seed + sim)
        f = ica.fit_gogarch(y, method=method)
        fill = lambda x, v: np.resize(np.asarray(v if x is None else x, float), k)
        truth = fill(arch, [0.10, 0.15, 0.06]) + fill(garch, [0.85, 0.75, 0.92])
        rows = [(f"persistence_{j + 1}", f.fits[i].persistence, np.nan, truth[j], f.ica.converged) for i, j, _ in ica.match_columns(f.ica.a, a)]
        return [*rows, ("amari", ica.amari_distance(f.ica.a, a), np.nan, 0.0, f.ica.converged), ("angle", ica.mixing_angle(f.ica.a, a), np.nan, 0.0, f.ica.converged)]

    return simulations(spark, n_sim, one)


def study_summary(sims: DataFrame, level: float = 0.95) -> DataFrame:
    """name, true, n, n_se, mean, bias, rmse, sd, mean_se, se_ratio and coverage of converged fits."""
    z = float(dist.normal_quantile(np.array(0.5 + level / 2)))
    ok = sims.where("converged and est is not null")
    sound = F.col("se").isNotNull() & (F.col("se") > 0)
    inside = F.when(sound, (F.abs(F.col("est") - F.col("true")) <= z * F.col("se")).cast("double"))
    se = F.when(sound, F.col("se"))
    return ok.groupBy("name").agg(
        F.first("true").alias("true"), F.count("*").alias("n"), F.count(se).alias("n_se"), F.avg("est").alias("mean"), (F.avg("est") - F.first("true")).alias("bias"),
        F.sqrt(F.avg((F.col("est") - F.col("true")) ** 2)).alias("rmse"), F.stddev_samp("est").alias("sd"), F.avg(se).alias("mean_se"), F.try_divide(F.avg(se), F.stddev_samp("est")).alias("se_ratio"), F.avg(inside).alias("coverage"),
    )


def intervals(sims: DataFrame, level: float = 0.95) -> DataFrame:
    """sim, name, est, lower, upper, covered: the segments of a coverage plot."""
    z = float(dist.normal_quantile(np.array(0.5 + level / 2)))
    out = sims.withColumns({"lower": F.col("est") - z * F.col("se"), "upper": F.col("est") + z * F.col("se")})
    return out.select("sim", "name", "est", "true", "lower", "upper", ((F.col("lower") <= F.col("true")) & (F.col("true") <= F.col("upper"))).alias("covered"))


def z_scores(sims: DataFrame) -> DataFrame:
    return sims.where("converged and se > 0").select("sim", "name", ((F.col("est") - F.col("true")) / F.col("se")).alias("z"))


def normality(sims: DataFrame) -> DataFrame:
    """name, n, mean, sd, skewness, kurtosis, W and p of Shapiro and Wilk (null beyond 3 to 5000 values) of the standardised estimates."""

    def run(key, pdf):
        x = pdf["z"].to_numpy(float)
        m = dist.moments(x)
        w, p = dist.shapiro_wilk(x) if 3 <= len(x) <= 5000 else (None, None)
        return pd.DataFrame([(key[0], len(x), m["mean"], m["sd"], m["skewness"], m["kurtosis"], w, p)], columns=["name", "n", "mean", "sd", "skewness", "kurtosis", "w", "p"])

    return z_scores(sims).groupBy("name").applyInPandas(run, "name string, n long, mean double, sd double, skewness double, kurtosis double, w double, p double")


def describe(sims: DataFrame, n_sim: int, level: float = 0.95) -> str:
    """The study in words; it has a row a parameter."""
    show = lambda x: "-" if x is None else f"{x:.4f}"
    lines = [f"{n_sim} simulations"]
    for r in study_summary(sims, level).orderBy("name").collect():
        lines.append(f"{r['name']}: {r['n']} valid, true {show(r['true'])}, mean {show(r['mean'])}, bias {show(r['bias'])}, rmse {show(r['rmse'])}, se ratio {show(r['se_ratio'])}, coverage {show(r['coverage'])}")
    return "\n".join(lines)


def trace(z: np.ndarray, start: tuple[float, float] = (0.10, 0.80), law: str = "mvn") -> pd.DataFrame:
    """step, alpha, beta, nll of a DCC fit's accepted points, without repeats."""
    f = dcc.fit(z, law=law, start=np.r_[start, [8.0] if law == "mvt" else []], keep_trace=True)
    return pd.DataFrame(f.trace).drop_duplicates(subset=["alpha", "beta"])


def standalone_optimisation(spark: SparkSession, n: int = 500, alpha: float = 0.05, beta: float = 0.90, start: tuple[float, float] = (0.10, 0.80), points: int = 30, seed: int = 42) -> dict[str, DataFrame]:
    """surface and trace: a simulated series' likelihood and the path that its fit takes over it."""
    z = dcc.simulate_residuals(n, 2, alpha, beta, np.array([[1, 0.5], [0.5, 1]]), seed)
    return {"surface": inference.surface(spark, inference.Problem(z), points=points), "trace": spark.createDataFrame(trace(z, start))}


def complete_study(spark: SparkSession, kind: str = "dcc", n_sim: int = 50, n_obs: int = 500, points: int = 30, seed: int = 42, **options) -> dict[str, DataFrame]:
    """simulations, summary, intervals, normality and, but for gogarch, one simulation's surface."""
    study = {"dcc": dcc_study, "cgarch": copula_study, "gogarch": gogarch_study}[kind](spark, n_sim, n_obs, seed=seed, **options)
    out = {"simulations": study, "summary": study_summary(study), "intervals": intervals(study), "normality": normality(study)}
    if kind != "gogarch":
        z = dcc.simulate_residuals(n_obs, 2, options.get("alpha", 0.05), options.get("beta", 0.9), np.array([[1, 0.5], [0.5, 1]]), seed)
        out["surface"] = inference.surface(spark, inference.Problem(z, kind=kind), points=points)
    return out


def matrix_table(spark: SparkSession, a: np.ndarray) -> DataFrame:
    """(row, col, value): a mixing matrix as a heat map's cells."""
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "row int, col int, value double")


def estimate_table(sims: DataFrame) -> DataFrame:
    """sim and a column a parameter: the points of a scatter."""
    names = sorted(r["name"] for r in sims.select("name").distinct().collect())  # a row a parameter
    return sims.where("converged").groupBy("sim").pivot("name", names).agg(F.first("est"))


def running_coverage(sims: DataFrame, level: float = 0.95) -> DataFrame:
    """sim, name, coverage: the share of intervals so far that hold the truth."""
    w = Window.partitionBy("name").orderBy("sim")
    return intervals(sims, level).where("covered is not null").withColumn("coverage", F.avg(F.col("covered").cast("double")).over(w)).select("sim", "name", "coverage")
