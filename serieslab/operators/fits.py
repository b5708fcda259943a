"""Model fits over many series: one series is one group, so fits run side by side; results come back as tidy rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.functions import copula, dcc, ica, likelihood, regimes, switching
from serieslab.functions.garch import GarchSpec, fit_garch, garch_errors
from serieslab.operators import em_log
from serieslab.operators.resample import with_id

PARAMETERS = "series_id string, model string, name string, value double"


def fit_each(series: DataFrame, cols: list[str], fit: Callable[[np.ndarray], dict[str, float]], model: str) -> DataFrame:
    """(series_id, model, name, value): fit() of each series' values (rows by t)."""

    def run(key, pdf):
        found = fit(pdf.sort_values("t")[cols].to_numpy(float))
        return pd.DataFrame([(str(key[0]), model, n, float(v)) for n, v in found.items()], columns=["series_id", "model", "name", "value"])

    return with_id(series).select("series_id", "t", *cols).groupBy("series_id").applyInPandas(run, PARAMETERS)


# --- what fit_each fits
def garch(y: np.ndarray, spec: GarchSpec | None = None, method: str = "hessian") -> dict[str, float]:
    y = y[:, 0] - y[:, 0].mean()
    f = fit_garch(y, spec=spec)
    return f.values | {"loglik": -f.nll, "persistence": f.persistence} | {f"se_{n}": float(s) for n, s in zip(f.spec.names(), garch_errors(y, f, method=method), strict=True)}


def correlation(y: np.ndarray, law: str = "mvn", asymmetric: bool = False, copula_: bool = False, transform: str = "parametric", criterion: str | None = None, order: tuple[int, int] = (1, 1), method: str = "hessian") -> dict[str, float]:
    """DCC, asymmetric DCC or a copula over them, with margins, errors and information criteria."""
    y = y - y.mean(axis=0)
    f = copula.fit_two_stage(y, law=law, asymmetric=asymmetric, copula=copula_, transform=transform, criterion=criterion, order=order)
    c = f.correlation
    rows = f.rows()
    out = dict(c.par) | {"nll": c.nll, "loglik": float(rows.sum()), "dynamic": float(c.dynamic)}
    n_par = len(c.par) + sum(len(m.par) for m in f.margins)
    out |= {"aic": 2 * n_par - 2 * out["loglik"], "bic": n_par * np.log(len(y)) - 2 * out["loglik"]}
    if c.dynamic and order == (1, 1):
        e = dcc.gated_errors(c, f.z, method=method, copula=copula_)
        out |= {f"se_{n}": float(s) for n, s in zip(c.par, e["se"], strict=True)}
    return out | {f"{n}_{i}": v for i, m in enumerate(f.margins, 1) for n, v in m.values.items()}


def adcc(y: np.ndarray) -> dict[str, float]:
    return correlation(y, asymmetric=True)


def copula_garch(y: np.ndarray, law: str = "mvn", asymmetric: bool = False, transform: str = "parametric") -> dict[str, float]:
    return correlation(y, law, asymmetric, True, transform)


def gogarch(y: np.ndarray, method: str = "radical") -> dict[str, float]:
    y = y - y.mean(axis=0)
    f = ica.fit_gogarch(y, method=method)
    errors = ica.component_errors(f)
    out = {f"{r['name']}_{r['component']}": r["estimate"] for r in errors} | {f"se_{r['name']}_{r['component']}": r["se"] for r in errors}
    d = ica.diagnose(f, y)
    cov = f.covariance()[-1]
    out |= {f"cov_last_{i}{j}": float(cov[i, j]) for i in range(len(cov)) for j in range(i + 1)}
    return out | {"loglik": float(f.rows().sum()), "condition": d["condition"], "unmixing_error": d["unmixing_error"], "covariance_error": d["covariance_error"]}


def hmm(y: np.ndarray) -> dict[str, float]:
    f = regimes.fit_hmm(y)
    return {"loglik": f["loglik"], "p00": f["p"][0, 0], "p11": f["p"][1, 1], "mean0": f["mean"][0, 0], "mean1": f["mean"][1, 0], "sd0": f["cov"][0, 0, 0] ** 0.5, "sd1": f["cov"][1, 0, 0] ** 0.5}


def hmm_law(y: np.ndarray, law: str = "sstd", states: int = 2, basis: str | int = "market") -> dict[str, float]:
    f = regimes.fit_hmm_law(regimes.regime_series(y, basis), states, law)
    out = {"loglik": f["loglik"], "iterations": float(f["iterations"])} | {f"{n}{s}": v for s, state in enumerate(f["states"]) for n, v in state.items()}
    return out | {f"p{s}{s}": float(f["p"][s, s]) for s in range(states)} | {f"duration{s}": float(d) for s, d in enumerate(f["durations"])}


def msvar(y: np.ndarray) -> dict[str, float]:
    f = regimes.fit_msvar(y)
    return {"loglik": f["loglik"], "p00": f["p"][0, 0], "p11": f["p"][1, 1]} | {f"beta{s}_{i}{j}": f["beta"][s][i, j] for s in range(2) for i in range(f["beta"][s].shape[0]) for j in range(f["beta"][s].shape[1])}


def ms_garch(y: np.ndarray, states: int = 2, model: str = "sGARCH", law: str = "norm") -> dict[str, float]:
    f = regimes.fit_msgarch(y[:, 0], states, model, law)
    out = {"loglik": f["loglik"], "aic": f["aic"], "bic": f["bic"], "iterations": float(f["iterations"]), "converged": float(f["converged"])}
    return out | {f"{n}_{s}": v for s, g in enumerate(f["fits"]) for n, v in g.values.items()} | {f"p{s}{s}": float(f["p"][s, s]) for s in range(states)}


def switching_rows(f: switching.SwitchingFit) -> dict[str, float]:
    out = {"loglik": f.loglik, "aic": f.aic, "bic": f.bic, "parameters": float(f.parameters), "converged": float(f.converged), "refitted": float(len(f.refitted))}
    out |= {f"p{i}{j}": float(f.p[i, j]) for i in range(len(f.p)) for j in range(len(f.p))}
    return out | {f"{n}@{s}": v for s, g in enumerate(f.fits) for n, v in g.values().items()}


# --- switching models: parameters, events, states
def fit_switching_each(series: DataFrame, cols: list[str], specs: list[switching.StateSpec], **options) -> DataFrame:
    """(series_id, model, name, value) of a switching model fitted to each series."""
    return fit_each(series, cols, lambda y: switching_rows(switching.fit_switching(y, specs, **options)), specs[0].kind)


def switching_events(series: DataFrame, cols: list[str], specs: list[switching.StateSpec], **options) -> DataFrame:
    """The EM events of each series' fit, as em_log reads them."""

    def run(key, pdf):
        f = switching.fit_switching(pdf.sort_values("t")[cols].to_numpy(float), specs, **options)
        return em_log.table(f.log, str(key[0]))

    return with_id(series).select("series_id", "t", *cols).groupBy("series_id").applyInPandas(run, em_log.EVENTS)


def switching_driver(series: DataFrame, cols: list[str], specs: list[switching.StateSpec], **options) -> switching.SwitchingFit:
    """One series' fit whose M-step is a Spark job a state: for models whose states are dear to fit.

    The E-step is on the driver, which holds the one series; each iteration sends rows and weights to a task a state.
    """
    spark = series.sparkSession
    y = series.select("t", *cols).orderBy("t").toPandas()[cols].to_numpy(float)

    def m_step(y_, w, specs_, last):
        shared = spark.sparkContext.broadcast((y_, w, specs_, last, options.get("criterion", "bic"), options.get("threshold", 0.02)))

        def run(key, pdf):
            import pickle

            y0, w0, specs0, last0, criterion, threshold = shared.value
            s = int(key[0])
            return pd.DataFrame({"state": [s], "fit": [pickle.dumps(switching.fit_state(y0, w0[:, s], specs0[s], None if last0 is None else last0[s], criterion, threshold))]})

        import pickle

        rows = spark.range(len(specs_)).repartition(len(specs_), "id").groupBy("id").applyInPandas(run, "state int, fit binary").collect()  # a row a state
        shared.unpersist()
        return [pickle.loads(r["fit"]) for r in sorted(rows, key=lambda r: r["state"])]

    return switching.fit_switching(y, specs, m_step=m_step, **options)


def _states(method: str, options: dict) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """values -> (path, smoothed probabilities)."""
    if method == "hmm":
        return lambda y: ((f := regimes.fit_hmm(y, **options))["path"], f["smooth"])
    if method == "hmm_law":
        basis = options.pop("basis", "market")
        return lambda y: ((f := regimes.fit_hmm_law(regimes.regime_series(y, basis), **options))["path"], f["smooth"])
    if method == "msvar":
        return lambda y: ((f := regimes.fit_msvar(y, **options))["smooth"].argmax(axis=1), f["smooth"])
    if method == "ms_garch":
        basis = options.pop("basis", "market")
        return lambda y: ((f := regimes.fit_msgarch(regimes.regime_series(y, basis), **options))["path"], f["smooth"])
    if method == "switching":
        return lambda y: ((f := switching.fit_switching(y, **options)).smooth.argmax(axis=1), f.smooth)
    raise ValueError(f"{method!r} is none of hmm, hmm_law, msvar, ms_garch, switching")


def decode(series: DataFrame, cols: list[str], method: str = "hmm", states: int = 2, **options) -> DataFrame:
    """(series_id, t, state, p0, p1, ...): the state path and smoothed probabilities of each series."""
    if method in ("hmm", "hmm_law", "msvar", "ms_garch"):
        options["k"] = states
    fit = _states(method, dict(options))

    def run(key, pdf):
        pdf = pdf.sort_values("t")
        path, smooth = fit(pdf[cols].to_numpy(float))
        return pd.DataFrame({"series_id": str(key[0]), "t": pdf["t"].to_numpy(), "state": path.astype("int32")} | {f"p{s}": smooth[:, s] for s in range(states)})

    schema = "series_id string, t long, state int, " + ", ".join(f"p{s} double" for s in range(states))
    return with_id(series).select("series_id", "t", *cols).groupBy("series_id").applyInPandas(run, schema)


def probabilities(decoded: DataFrame) -> DataFrame:
    """(series_id, t, state, p) from decode()."""
    cols = [c for c in decoded.columns if c[0] == "p" and c[1:].isdigit()]
    rows = decoded.unpivot(["series_id", "t"], [F.col(c) for c in cols], "name", "p")
    return rows.select("series_id", "t", F.substring("name", 2, 9).cast("int").alias("state"), "p")


def covariance_path(series: DataFrame, cols: list[str], kind: str = "dcc") -> DataFrame:
    """(series_id, t, i, j, value): the fitted correlations (dcc, adcc, copula) or covariances (gogarch) over time, i >= j."""

    def run(key, pdf):
        pdf = pdf.sort_values("t")
        y = pdf[cols].to_numpy(float)
        y = y - y.mean(axis=0)
        path = ica.fit_gogarch(y).covariance() if kind == "gogarch" else copula.fit_two_stage(y, asymmetric=kind == "adcc", copula=kind == "copula").correlations()
        i, j = np.tril_indices(len(cols))
        return pd.DataFrame({"series_id": str(key[0]), "t": np.repeat(pdf["t"].to_numpy(), len(i)), "i": np.tile(i, len(y)), "j": np.tile(j, len(y)), "value": path[:, i, j].ravel()})

    return with_id(series).select("series_id", "t", *cols).groupBy("series_id").applyInPandas(run, "series_id string, t long, i int, j int, value double")


def likelihood_rows(series: DataFrame, cols: list[str], kind: str, par: dict[str, float]) -> DataFrame:
    """(series_id, t, ll): each row's log-likelihood of a model fitted to its series, at the given parameters."""

    def run(key, pdf):
        pdf = pdf.sort_values("t")
        y = pdf[cols].to_numpy(float)
        y = y - y.mean(axis=0)
        fit = ica.fit_gogarch(y) if kind == "gogarch" else copula.fit_two_stage(y, asymmetric=kind == "adcc", copula=kind == "copula", force_constant=kind == "constant")
        return pd.DataFrame({"series_id": str(key[0]), "t": pdf["t"].to_numpy(), "ll": likelihood.at(fit, par, by_row=True)})

    return with_id(series).select("series_id", "t", *cols).groupBy("series_id").applyInPandas(run, "series_id string, t long, ll double")


# --- paths at fixed parameters
def dcc_path_table(series: DataFrame, x: str, y: str, alpha: float, beta: float) -> DataFrame:
    """t, q11, q12, q22, rho of a pair of standardised columns at given parameters, about their own correlation."""
    named = "series_id" in series.columns

    def run(key, pdf):
        pdf = pdf.sort_values("t")
        z = pdf[[x, y]].to_numpy(float)
        q, r = dcc.path(z, alpha, beta, np.corrcoef(z.T))
        return pd.DataFrame({"series_id": str(key[0]), "t": pdf["t"].to_numpy(), "q11": q[:, 0, 0], "q12": q[:, 0, 1], "q22": q[:, 1, 1], "rho": r[:, 0, 1]})

    out = with_id(series).select("series_id", "t", x, y).groupBy("series_id").applyInPandas(run, "series_id string, t long, q11 double, q12 double, q22 double, rho double")
    return out if named else out.drop("series_id")


def filter_table(series: DataFrame, col: str, p: np.ndarray, means: list[float], sds: list[float]) -> DataFrame:
    """(series_id, t, p0, p1, ...): filtered probabilities of normal regimes at given parameters, from even odds."""
    k = len(p)

    def run(key, pdf):
        pdf = pdf.sort_values("t")
        v = pdf[col].to_numpy(float)
        ll = np.column_stack([-0.5 * ((v - m) / s) ** 2 - np.log(s) for m, s in zip(means, sds, strict=True)])
        f = regimes.filtered(ll, p, np.full(k, 1 / k))
        return pd.DataFrame({"series_id": str(key[0]), "t": pdf["t"].to_numpy()} | {f"p{i}": f[:, i] for i in range(k)})

    schema = "series_id string, t long, " + ", ".join(f"p{i} double" for i in range(k))
    return with_id(series).select("series_id", "t", col).groupBy("series_id").applyInPandas(run, schema)
