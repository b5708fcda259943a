"""Queries of kernels and tables at fixed parameters, each with SQL that says the same by recursion, windows or formula.

What they run on is either a series of the tables or a small table of literals, which the SQL repeats as VALUES.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.functions import arma, dcc, dist, ica, portfolio, regimes
from serieslab.functions.garch import GarchSpec
from serieslab.functions.switching import EmLog
from serieslab.operators import diagnostics, em_log, fits, inference, montecarlo, resample
from serieslab.plans.registry import DAY, LINES, PAIR, RET, STATES, _pair, _returns, _round, _states, query
from serieslab.sources import series as src


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of literals."""

    def literal(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, float):
            return f"CAST('{x!r}' AS DOUBLE)"
        return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def rows_of(spark, make, schema: str) -> DataFrame:
    """A frame that a task makes in numpy."""
    return spark.range(0, 1, 1, 1).mapInPandas(lambda it: (make() for _ in it), schema)


# --- laws
GRID = [-2.5, -1.0, -0.25, 0.0, 0.5, 1.75]
LAW_AT = {"norm": {}, "std": {"shape": 6.0}, "ged": {"shape": 1.4}, "snorm": {"skew": 1.3}, "sstd": {"skew": 0.8, "shape": 7.0}, "sged": {"skew": 1.2, "shape": 1.6}, "jsu": {"skew": 0.5, "shape": 2.0}}


def _log_sql(base: str, z: str, nu: str) -> str:
    """The log density of a symmetric law of variance 1 in SQL."""
    if base == "norm":
        return f"(-0.5 * (ln(2 * pi()) + ({z}) * ({z})))"
    if base == "std":
        return f"(lgamma(({nu} + 1) / 2) - lgamma({nu} / 2) - 0.5 * ln(pi() * ({nu} - 2)) - ({nu} + 1) / 2 * ln(1 + ({z}) * ({z}) / ({nu} - 2)))"
    scale = f"exp(0.5 * (-2 / {nu} * ln(2) + lgamma(1 / {nu}) - lgamma(3 / {nu})))"
    return f"(ln({nu}) - ln({scale}) - (1 + 1 / {nu}) * ln(2) - lgamma(1 / {nu}) - 0.5 * pow(abs(({z}) / {scale}), {nu}))"


def _moment_sql(base: str, nu: str) -> str:
    if base == "norm":
        return "sqrt(2 / pi())"
    if base == "std":
        return f"(2 * sqrt({nu} - 2) / ({nu} - 1) * exp(lgamma(({nu} + 1) / 2) - lgamma(CAST(0.5 AS DOUBLE)) - lgamma({nu} / 2)))"
    return f"(exp(0.5 * (-2 / {nu} * ln(2) + lgamma(1 / {nu}) - lgamma(3 / {nu}))) * pow(2, 1 / {nu}) * exp(lgamma(2 / {nu}) - lgamma(1 / {nu})))"


def _law_sql(law: str, at: dict[str, float]) -> str:
    nu, xi = f"CAST({at.get('shape', 1.0)} AS DOUBLE)", f"CAST({at.get('skew', 1.0)} AS DOUBLE)"
    if law == "jsu":
        r, w = f"(1 / {nu})", f"exp(1 / ({nu} * {nu}))"
        omega = f"(-{xi} * {r})"
        c = f"pow(0.5 * ({w} - 1) * ({w} * cosh(2 * {omega}) + 1), -0.5)"
        y = f"((z - {c} * sqrt({w}) * sinh({omega})) / ({c}))"
        return f"(-ln({c}) - ln({r}) - 0.5 * ln(1 + {y} * {y}) - 0.5 * (ln(2 * pi()) + pow(-{xi} + asinh({y}) / {r}, 2)))"
    if law in ("norm", "std", "ged"):
        return _log_sql(law, "z", nu)
    base = law[1:]
    m = _moment_sql(base, nu)
    sd = f"sqrt((1 - {m} * {m}) * ({xi} * {xi} + 1 / ({xi} * {xi})) + 2 * {m} * {m} - 1)"
    y = f"(z * {sd} + {m} * ({xi} - 1 / {xi}))"
    return f"(ln(2 / ({xi} + 1 / {xi})) + ln({sd}) + " + _log_sql(base, f"CASE WHEN {y} < 0 THEN {y} * {xi} ELSE {y} / {xi} END", nu) + ")"


@query("WITH " + values("g", "z", [(z,) for z in GRID]) + " " + " UNION ALL ".join(f"SELECT '{law}' AS law, z, round({_law_sql(law, at)}, 8) AS log_density FROM g" for law, at in LAW_AT.items()))
def law_densities(spark, sf_dir):
    make = lambda: pd.concat([pd.DataFrame({"law": law, "z": GRID, "log_density": dist.log_density(law, np.array(GRID), **at)}) for law, at in LAW_AT.items()])
    return _round(rows_of(spark, make, "law string, z double, log_density double"), "log_density", digits=8)


@query("WITH " + values("g", "z", [(z,) for z in GRID]) + ", i AS (SELECT z, x.range AS k FROM g, range(20001) x) SELECT z, round(sum(CASE WHEN k IN (0, 20000) THEN 0.5 ELSE 1 END * exp(-0.5 * pow(-10 + (z + 10) * k / 20000.0, 2)) * (z + 10) / 20000.0) / sqrt(2 * pi()), 6) AS p FROM i GROUP BY z")
def normal_probabilities(spark, sf_dir):
    return _round(rows_of(spark, lambda: pd.DataFrame({"z": GRID, "p": dist.normal_cdf(np.array(GRID))}), "z double, p double"), "p")


# --- volatility models at fixed parameters
_VARIANTS = {"sGARCH": [40.0, 0.08, 0.9], "gjrGARCH": [40.0, 0.05, 0.06, 0.88], "tGARCH": [2.0, 0.08, 0.1, 0.88], "eGARCH": [0.8, -0.05, 0.15, 0.9]}
_STEP = {
    "sGARCH": "40 + 0.08 * r * r + 0.9 * h",
    "gjrGARCH": "40 + (0.05 + CASE WHEN r < 0 THEN 0.06 ELSE 0 END) * r * r + 0.88 * h",
    "tGARCH": "pow(2 + 0.08 * (abs(r) - 0.1 * r) + 0.88 * sqrt(h), 2)",
    "eGARCH": "exp(0.8 - 0.05 * r / sqrt(h) + 0.15 * (abs(r) / sqrt(h) - sqrt(2 / pi())) + 0.9 * ln(h))",
}


@query(f"WITH RECURSIVE {DAY}, {RET}, " + ", ".join(f"{m}(t, h) AS (SELECT CAST(0 AS BIGINT), {'CAST(40 / (1 - 0.98) AS DOUBLE)' if m == 'sGARCH' else 'var_pop(r)'} FROM ret UNION ALL SELECT ret.t + 1, {_STEP[m]} FROM {m} JOIN ret ON ret.t = {m}.t WHERE ret.t + 1 < (SELECT count(*) FROM ret))" for m in _STEP).replace("CAST(40 / (1 - 0.98) AS DOUBLE) FROM ret", "CAST(40 / (1 - 0.98) AS DOUBLE)") + " " + " UNION ALL ".join(f"SELECT '{m}' AS model, t, round(h, 4) AS h FROM {m}" for m in _STEP))
def variance_models(spark, sf_dir):
    def run(key, pdf):
        y = pdf.sort_values("t")["r"].to_numpy(float)
        return pd.concat([pd.DataFrame({"model": m, "t": np.arange(len(y)), "h": GarchSpec(model=m).variance(y, np.array(par))}) for m, par in _VARIANTS.items()])

    return _round(resample.with_id(_returns(spark, sf_dir)).groupBy("series_id").applyInPandas(run, "model string, t long, h double"), "h", digits=4)


@query(f"WITH {DAY}, {RET}, p AS (SELECT lag(r) OVER (ORDER BY t) AS x, r AS y, 1 + t % 3 AS w FROM ret QUALIFY lag(r) OVER (ORDER BY t) IS NOT NULL), m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM p) SELECT round(any_value(my) - sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) ** 2) * any_value(mx), 6) AS intercept, round(sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) ** 2), 8) AS slope FROM p, m")
def weighted_autoregression(spark, sf_dir):
    def run(key, pdf):
        y = pdf.sort_values("t")["r"].to_numpy(float)
        c = arma.fit_var(y, 1, 1.0 + np.arange(len(y)) % 3)["coef"]
        return pd.DataFrame({"intercept": [c[0, 0]], "slope": [c[1, 0]]})

    return _round(_round(resample.with_id(_returns(spark, sf_dir)).groupBy("series_id").applyInPandas(run, "intercept double, slope double"), "intercept"), "slope", digits=8)


@query(f"WITH {DAY}, {RET}, d AS (SELECT t, r - avg(r) OVER () AS d FROM ret), l AS (SELECT k.range + 1 AS k, sum(a.d * b.d) AS c FROM range(10) k JOIN d a ON true JOIN d b ON b.t = a.t - k.range - 1 GROUP BY 1), n AS (SELECT count(*) AS m, sum(d * d) AS v FROM d) SELECT round(any_value(m) * (any_value(m) + 2) * sum((c / v) ** 2 / (m - k)), 6) AS q FROM l, n".replace(", n AS (SELECT count(*) AS m", ", nn AS (SELECT count(*) AS m").replace("FROM l, n", "FROM l, nn"))
def ljung_box_statistic(spark, sf_dir):
    at = lambda y: {"q": dist.ljung_box(y[:, 0])[0]}
    return _round(fits.fit_each(_returns(spark, sf_dir), ["r"], at, "test").select(F.col("value").alias("q")), "q")


# --- correlations at fixed parameters
@query(f"WITH RECURSIVE {PAIR}, m AS (SELECT corr(x, y) AS r, avg(least(x, 0) ** 2) AS n11, avg(least(x, 0) * least(y, 0)) AS n12, avg(least(y, 0) ** 2) AS n22 FROM z), q(t, q11, q12, q22) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS DOUBLE), r, CAST(1 AS DOUBLE) FROM m UNION ALL SELECT z.t + 1, 0.07 - 0.04 * n11 + 0.05 * x * x + 0.04 * least(x, 0) ** 2 + 0.88 * q11, 0.07 * r - 0.04 * n12 + 0.05 * x * y + 0.04 * least(x, 0) * least(y, 0) + 0.88 * q12, 0.07 - 0.04 * n22 + 0.05 * y * y + 0.04 * least(y, 0) ** 2 + 0.88 * q22 FROM q JOIN z ON z.t = q.t, m WHERE z.t + 1 < (SELECT n FROM n)) SELECT t, round(q11, 6) AS q11, round(q12, 6) AS q12, round(q12 / sqrt(q11 * q22), 8) AS rho FROM q")
def asymmetric_correlations(spark, sf_dir):
    def run(key, pdf):
        z = pdf.sort_values("t")[["x", "y"]].to_numpy(float)
        q, r = dcc.path(z, 0.05, 0.88, np.corrcoef(z.T), 0.04)
        return pd.DataFrame({"t": np.arange(len(z)), "q11": q[:, 0, 0], "q12": q[:, 0, 1], "rho": r[:, 0, 1]})

    out = resample.with_id(_pair(spark, sf_dir)).groupBy("series_id").applyInPandas(run, "t long, q11 double, q12 double, rho double")
    return _round(_round(out, "q11", "q12"), "rho", digits=8)


_PATH = "qb AS (SELECT corr(x, y) AS r FROM z), q(t, q11, q12, q22) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS DOUBLE), r, CAST(1 AS DOUBLE) FROM qb UNION ALL SELECT z.t + 1, 0.05 + 0.05 * x * x + 0.9 * q11, 0.05 * r + 0.05 * x * y + 0.9 * q12, 0.05 + 0.05 * y * y + 0.9 * q22 FROM q JOIN z ON z.t = q.t, qb WHERE z.t + 1 < (SELECT n FROM n)), l AS (SELECT x, y, q12 / sqrt(q11 * q22) AS p FROM q JOIN z ON z.t = q.t), u AS (SELECT x, y, 1 - p * p AS d, (x * x - 2 * p * x * y + y * y) / (1 - p * p) AS quad FROM l)"
_MVT = "lgamma(CAST(5 AS DOUBLE)) - lgamma(CAST(4 AS DOUBLE)) - ln(pi() * 6) - 0.5 * ln(d) - 5 * ln(1 + quad / 6)"
_T1 = "(lgamma(CAST(4.5 AS DOUBLE)) - lgamma(CAST(4 AS DOUBLE)) - 0.5 * ln(pi() * 6) - 4.5 * ln(1 + {0} * {0} / 6))"


@query(f"WITH RECURSIVE {PAIR}, {_PATH} SELECT 'normal' AS law, round(sum(0.5 * (ln(d) + quad - x * x - y * y)), 4) AS nll FROM u UNION ALL SELECT 't', round(-sum({_MVT}), 4) FROM u UNION ALL SELECT 't copula', round(-sum({_MVT} - {_T1.format('x')} - {_T1.format('y')}), 4) FROM u")
def correlation_likelihoods(spark, sf_dir):
    def run(key, pdf):
        z = pdf.sort_values("t")[["x", "y"]].to_numpy(float)
        q, at = np.corrcoef(z.T), np.array([0.05, 0.9, 8.0])
        got = {"normal": dcc.nll(at[:2], z, q), "t": dcc.nll(at, z, q, law="mvt"), "t copula": dcc.nll_at_shape(8.0, z, q, 0.05, 0.9)}
        return pd.DataFrame({"law": list(got), "nll": list(got.values())})

    return _round(resample.with_id(_pair(spark, sf_dir)).groupBy("series_id").applyInPandas(run, "law string, nll double"), "nll", digits=4)


@query(f"WITH {PAIR}, c AS (SELECT corr(x, y) AS p FROM z) SELECT round(sum(-0.5 * (ln(1 - p * p) + (x * x - 2 * p * x * y + y * y) / (1 - p * p) - x * x - y * y)), 4) AS loglik FROM z, c")
def constant_correlation_likelihood(spark, sf_dir):
    def run(key, pdf):
        z = pdf.sort_values("t")[["x", "y"]].to_numpy(float)
        return pd.DataFrame({"loglik": [dcc.constant_rows(z, np.corrcoef(z.T)).sum()]})

    return _round(resample.with_id(_pair(spark, sf_dir)).groupBy("series_id").applyInPandas(run, "loglik double"), "loglik", digits=4)


PAIRS = [(0.02, 0.9), (0.05, 0.9), (0.1, 0.6), (0.3, 0.3)]


@query("WITH " + values("g", "alpha, beta", PAIRS) + " SELECT alpha, beta, round(alpha + beta, 8) AS persistence, round(alpha / (alpha + beta), 8) AS ratio, round(ln((alpha + beta) / (1 - alpha - beta)), 8) AS psi, round(ln(alpha / beta), 8) AS phi, alpha + beta < 1 AS stationary, round(alpha + beta + 0.5 * 0.04, 8) AS with_gamma FROM g")
def correlation_parameters(spark, sf_dir):
    def make():
        rows = [(a, b, *dcc.to_ratio(a, b), *dcc.to_free(a, b), dcc.stationarity({"alpha": a, "beta": b})[0], dcc.adcc_persistence(a, 0.04, b)) for a, b in PAIRS]
        return pd.DataFrame(rows, columns=["alpha", "beta", "persistence", "ratio", "psi", "phi", "stationary", "with_gamma"])

    out = rows_of(spark, make, "alpha double, beta double, persistence double, ratio double, psi double, phi double, stationary boolean, with_gamma double")
    return _round(out, "persistence", "ratio", "psi", "phi", "with_gamma", digits=8)


@query(f"WITH {PAIR}, w AS (SELECT x, y, 1 + t % 2 AS w FROM z), m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w) SELECT round(sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) ** 2) * sum(w * (y - my) ** 2)), 8) AS corr, round(sum(w) ** 2 / sum(w * w), 6) AS effective FROM w, m")
def weighted_correlation(spark, sf_dir):
    def run(key, pdf):
        z = pdf.sort_values("t")[["x", "y"]].to_numpy(float)
        w = 1.0 + np.arange(len(z)) % 2
        return pd.DataFrame({"corr": [dcc.weighted_correlation(z, w)[0, 1]], "effective": [dcc.effective_rows(w)]})

    return _round(_round(resample.with_id(_pair(spark, sf_dir)).groupBy("series_id").applyInPandas(run, "corr double, effective double"), "corr", digits=8), "effective")


@query(f"WITH {PAIR}, s2 AS (SELECT (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS y FROM z), k AS (SELECT avg(x ** 4) / avg(x * x) ** 2 - 3 AS kx, avg(y ** 4) / avg(y * y) ** 2 - 3 AS ky, (avg(ln(cosh(x))) - 0.374567) ** 2 AS nx, (avg(ln(cosh(y))) - 0.374567) ** 2 AS ny, corr(x, y) AS c FROM s2) SELECT round(kx, 8) AS kurtosis_x, round(ky, 8) AS kurtosis_y, round(nx, 8) AS negentropy_x, round(ny, 8) AS negentropy_y, round(1 - abs(c) / 2, 8) AS independence FROM k")
def component_quality(spark, sf_dir):
    def run(key, pdf):
        q = ica.quality(pdf.sort_values("t")[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"kurtosis_x": q["kurtosis"][:1], "kurtosis_y": q["kurtosis"][1:], "negentropy_x": q["negentropy"][:1], "negentropy_y": q["negentropy"][1:], "independence": [q["independence"]]})

    out = resample.with_id(_pair(spark, sf_dir)).groupBy("series_id").applyInPandas(run, "kurtosis_x double, kurtosis_y double, negentropy_x double, negentropy_y double, independence double")
    return _round(out, *out.columns, digits=8)


# --- hidden regimes at fixed parameters
_P, _SD = np.array([[0.95, 0.05], [0.1, 0.9]]), (30.0, 90.0)
_E = "e AS (SELECT t, exp(-0.5 * (r / 30.0) ** 2) / 30 AS e0, exp(-0.5 * (r / 90.0) ** 2) / 90 AS e1 FROM ret)"
_FORWARD = "f(t, a0, a1) AS (SELECT t, e0 / (e0 + e1), e1 / (e0 + e1) FROM e WHERE t = 0 UNION ALL SELECT t1, g0 / (g0 + g1), g1 / (g0 + g1) FROM (SELECT e.t AS t1, (0.95 * a0 + 0.1 * a1) * e0 AS g0, (0.05 * a0 + 0.9 * a1) * e1 AS g1 FROM f JOIN e ON e.t = f.t + 1))"
_BACK = "b(t, b0, b1) AS (SELECT max(t), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) FROM e UNION ALL SELECT t1, g0 / (g0 + g1), g1 / (g0 + g1) FROM (SELECT b.t - 1 AS t1, 0.95 * e0 * b0 + 0.05 * e1 * b1 AS g0, 0.1 * e0 * b0 + 0.9 * e1 * b1 AS g1 FROM b JOIN e ON e.t = b.t WHERE b.t > 0))"


def _densities(pdf: pd.DataFrame) -> np.ndarray:
    v = pdf.sort_values("t")["r"].to_numpy(float)
    return np.column_stack([-0.5 * (v / s) ** 2 - math.log(s) for s in _SD])


@query(f"WITH RECURSIVE {DAY}, {RET}, {_E}, {_FORWARD}, {_BACK} SELECT f.t, round(a0 * b0 / (a0 * b0 + a1 * b1), 8) AS p0, round(a1 * b1 / (a0 * b0 + a1 * b1), 8) AS p1 FROM f JOIN b ON b.t = f.t")
def hidden_smoother(spark, sf_dir):
    def run(key, pdf):
        smooth, _, _ = regimes.forward_backward(_densities(pdf), _P, np.array([0.5, 0.5]))
        return pd.DataFrame({"t": np.arange(len(smooth)), "p0": smooth[:, 0], "p1": smooth[:, 1]})

    return _round(resample.with_id(_returns(spark, sf_dir)).groupBy("series_id").applyInPandas(run, "t long, p0 double, p1 double"), "p0", "p1", digits=8)


@query(f"WITH RECURSIVE {DAY}, {RET}, {_E}, v(t, s0, s1, c0, c1) AS (SELECT t, ln(0.5) + ln(e0), ln(0.5) + ln(e1), 0, 0 FROM e WHERE t = 0 UNION ALL SELECT e.t, greatest(s0 + ln(0.95), s1 + ln(0.1)) + ln(e0), greatest(s0 + ln(0.05), s1 + ln(0.9)) + ln(e1), CASE WHEN s1 + ln(0.1) > s0 + ln(0.95) THEN 1 ELSE 0 END, CASE WHEN s1 + ln(0.9) > s0 + ln(0.05) THEN 1 ELSE 0 END FROM v JOIN e ON e.t = v.t + 1), p(t, state) AS (SELECT t, CASE WHEN s1 > s0 THEN 1 ELSE 0 END FROM v WHERE t = (SELECT max(t) FROM e) UNION ALL SELECT v.t - 1, CASE WHEN state = 1 THEN c1 ELSE c0 END FROM p JOIN v ON v.t = p.t WHERE v.t > 0) SELECT t, state FROM p")
def hidden_path(spark, sf_dir):
    def run(key, pdf):
        path = regimes.viterbi(_densities(pdf), _P, np.array([0.5, 0.5]))
        return pd.DataFrame({"t": np.arange(len(path)), "state": path.astype("int32")})

    return resample.with_id(_returns(spark, sf_dir)).groupBy("series_id").applyInPandas(run, "t long, state int")


@query(f"WITH {DAY}, {STATES}, tr AS (SELECT state AS i, lead(state) OVER (ORDER BY t) AS j FROM st), p AS (SELECT avg(CASE WHEN i = 0 THEN j END) AS p01, 1 - avg(CASE WHEN i = 1 THEN j END) AS p10 FROM tr WHERE j IS NOT NULL) SELECT 0 AS state, round(p10 / (p01 + p10), 8) AS share FROM p UNION ALL SELECT 1, round(p01 / (p01 + p10), 8) FROM p")
def stationary_shares(spark, sf_dir):
    def run(key, pdf):
        names, _, law = regimes.chain_law(pdf.sort_values("t")["state"].to_numpy())
        return pd.DataFrame({"state": names, "share": law})

    return _round(resample.with_id(_states(spark, sf_dir)[1]).groupBy("series_id").applyInPandas(run, "state int, share double"), "share", digits=8)


@query(f"WITH {DAY}, {STATES}, k AS (SELECT t, state, lead(t, 2) OVER (PARTITION BY state ORDER BY t) AS third FROM st) SELECT state, t FROM k WHERE third = t + 2")
def micro_block_starts(spark, sf_dir):
    return resample.pool_starts(_states(spark, sf_dir)[1], 3)


@query(f"WITH {LINES} SELECT t, (quantity + price + discount + tax) / 4 AS x FROM s")
def market_series(spark, sf_dir):
    return resample.market(src.daily_lines(spark, sf_dir))


# --- portfolios
@query(f"WITH {LINES}, c AS (SELECT var_samp(quantity) AS a, var_samp(tax) AS b, covar_samp(quantity, tax) AS c FROM s) SELECT round((b - c) / (a + b - 2 * c), 8) AS w0, round((a - c) / (a + b - 2 * c), 8) AS w1 FROM c")
def minimum_variance_pair(spark, sf_dir):
    at = lambda y: dict(zip(("w0", "w1"), portfolio.min_variance(y), strict=True))
    out = fits.fit_each(src.daily_lines(spark, sf_dir), ["quantity", "tax"], at, "portfolio").groupBy().pivot("name", ["w0", "w1"]).agg(F.first("value"))
    return _round(out, "w0", "w1", digits=8)


@query(f"WITH {DAY}, {RET}, p AS (SELECT t, r / 1000 AS r, exp(sum(ln(1 + r / 1000)) OVER (ORDER BY t)) AS v FROM ret), d AS (SELECT r, v / max(v) OVER (ORDER BY t) - 1 AS d FROM p) SELECT round(avg(r) * 252, 8) AS \"return\", round(stddev_samp(r) * sqrt(252), 8) AS volatility, round(avg(r) / stddev_samp(r) * sqrt(252), 8) AS sharpe, round(min(d), 8) AS drawdown, round(quantile_cont(r, 0.05), 8) AS var95 FROM d")
def portfolio_metrics(spark, sf_dir):
    names = ["return", "volatility", "sharpe", "drawdown", "var95"]
    at = lambda y: portfolio.metrics(y / 1000, np.array([1.0]))
    out = fits.fit_each(_returns(spark, sf_dir), ["r"], at, "portfolio").groupBy().pivot("name", names).agg(F.first("value"))
    return _round(out, *names, digits=8)


# --- tables of inference
ESTIMATES = [(b, n, None if b == 3 else round(v + 0.01 * math.sin(7 * b + i), 6)) for b in range(12) for i, (n, v) in enumerate((("alpha", 0.05), ("beta", 0.9)))]
MLE = {"alpha": 0.05, "beta": 0.9}


@query("WITH " + values("e", "boot_id, name, value", ESTIMATES) + ", w AS (SELECT *, bool_and(value IS NOT NULL) OVER (PARTITION BY boot_id) AS whole FROM e), g AS (SELECT name, CASE name WHEN 'alpha' THEN 0.05 ELSE 0.9 END::DOUBLE AS estimate, count(*) AS n, count(value) FILTER (whole) AS n_valid, avg(value) FILTER (whole) AS m, stddev_samp(value) FILTER (whole) AS se, quantile_cont(value, 0.025) FILTER (whole) AS lo, quantile_cont(value, 0.975) FILTER (whole) AS hi FROM w GROUP BY name) SELECT name, estimate, n, n_valid, round(m, 8) AS mean, round(se, 8) AS se, round(m - estimate, 8) AS bias, round(lo, 8) AS lower, round(hi, 8) AS upper, round(2 * estimate - hi, 8) AS basic_lower, round(2 * estimate - lo, 8) AS basic_upper, 'ok' AS reason FROM g")
def bootstrap_interval_table(spark, sf_dir):
    out = inference.bootstrap_table(spark.createDataFrame(ESTIMATES, "boot_id int, name string, value double"), MLE)
    return _round(out, "mean", "se", "bias", "lower", "upper", "basic_lower", "basic_upper", digits=8)


PROFILE = [(n, round(v + d * s, 6), round(50 * d * d * (1 + 0.2 * (d > 0)), 6)) for n, v, s in (("alpha", 0.05, 0.1), ("beta", 0.9, 0.3)) for d in (-0.4, -0.3, -0.2, -0.1, 0.1, 0.2, 0.3, 0.4)]


@query("WITH " + values("p", 'name, x0, rise', PROFILE) + ", s AS (SELECT *, CASE name WHEN 'alpha' THEN 0.05 ELSE 0.9 END::DOUBLE AS estimate, 3.841458820694124 / 2 AS k FROM p), d AS (SELECT *, CASE WHEN x0 < estimate THEN 'lower' ELSE 'upper' END AS side, abs(x0 - estimate) AS far FROM s), l AS (SELECT *, coalesce(lag(x0) OVER w, estimate) AS before, coalesce(lag(rise) OVER w, 0) AS was FROM d WINDOW w AS (PARTITION BY name, side ORDER BY far)), c AS (SELECT name, estimate, side, before + (x0 - before) * (k - was) / (rise - was) AS x FROM l WHERE rise >= k AND was < k) SELECT name, estimate, round(max(x) FILTER (side = 'lower'), 8) AS lower, round(max(x) FILTER (side = 'upper'), 8) AS upper FROM c GROUP BY 1, 2")
def profile_interval_table(spark, sf_dir):
    return _round(inference.profile_intervals(spark.createDataFrame(PROFILE, "name string, at double, rise double"), MLE), "lower", "upper", digits=8)


SIMS = [(i, n, round(v + 0.03 * math.sin(3 * i + j), 6), None if i == 5 else round(0.02 + 0.001 * i, 6), v, i != 7) for i in range(15) for j, (n, v) in enumerate((("alpha", 0.05), ("beta", 0.9)))]
SIM_SCHEMA = "sim long, name string, est double, se double, true double, converged boolean"
SIMS_SQL = values("s", 'sim, name, est, se, "true", converged', SIMS)


@query(f"WITH {SIMS_SQL}, ok AS (SELECT * FROM s WHERE converged) SELECT name, any_value(\"true\") AS \"true\", count(*) AS n, count(se) AS n_se, round(avg(est), 8) AS mean, round(avg(est) - any_value(\"true\"), 8) AS bias, round(sqrt(avg((est - \"true\") ** 2)), 8) AS rmse, round(stddev_samp(est), 8) AS sd, round(avg(se), 8) AS mean_se, round(avg(se) / stddev_samp(est), 8) AS se_ratio, round(avg(CASE WHEN se IS NOT NULL THEN CASE WHEN abs(est - \"true\") <= 1.959963984540054 * se THEN 1.0 ELSE 0.0 END END), 8) AS coverage FROM ok GROUP BY name")
def study_table(spark, sf_dir):
    out = montecarlo.study_summary(spark.createDataFrame(SIMS, SIM_SCHEMA))
    return _round(out, *(c for c in out.columns if c not in ("name", "true", "n", "n_se")), digits=8)


@query(f"WITH {SIMS_SQL} SELECT sim, name, est, \"true\", round(est - 1.959963984540054 * se, 8) AS lower, round(est + 1.959963984540054 * se, 8) AS upper, abs(est - \"true\") <= 1.959963984540054 * se AS covered FROM s")
def study_intervals(spark, sf_dir):
    return _round(montecarlo.intervals(spark.createDataFrame(SIMS, SIM_SCHEMA)), "lower", "upper", digits=8)


@query(f"WITH {SIMS_SQL}, z AS (SELECT name, (est - \"true\") / se AS z FROM s WHERE converged AND se > 0), m AS (SELECT name, count(*) AS n, avg(z) AS m, stddev_samp(z) AS sd FROM z GROUP BY name) SELECT m.name, any_value(n) AS n, round(any_value(m), 8) AS mean, round(any_value(sd), 8) AS sd, round(avg((z - m) ** 3) / any_value(sd) ** 3, 8) AS skewness, round(avg((z - m) ** 4) / any_value(sd) ** 4 - 3, 8) AS kurtosis FROM z JOIN m USING (name) GROUP BY m.name")
def study_normality(spark, sf_dir):
    return _round(montecarlo.normality(spark.createDataFrame(SIMS, SIM_SCHEMA)).drop("w", "p"), "mean", "sd", "skewness", "kurtosis", digits=8)


# --- events of an EM fit
def _log() -> EmLog:
    """Eight iterations of two states, in which something happens."""
    log, last = EmLog(), -250.0
    for i, change in enumerate((30.0, 9.0, 2.5, -0.8, 0.6, 0.2, 0.03, 0.00004), 1):
        log.iteration(i, last, last + change, 0.25 * i, False)
        last += change
        for state, alpha in ((0, 0.04 + 0.03 * (i % 2)), (1, 0.01)):
            log.parameter(i, state, {"omega_1": 0.1 + 0.02 * state, "alpha1_1": 0.1, "beta1_1": 0.93 - 0.2 * state, "corr_alpha": alpha, "corr_beta": 0.93 - 0.2 * state, "shape": 2.5 + 5 * state})
            log.spread(i, state, 1, np.array([1.0, 2.0 + (i if state else 0)]))
        log.edge(i, 1, "alpha", 0.01, "lower", "none")
    log.warn(4, "likelihood_fell", "by 0.8")
    log.warn(6, "all_states_constant", "no state has dynamic correlation")
    return log


EVENTS = em_log.rows(_log())
EV = values("ev", "series_id, event, iteration, state, item, name, value, note", EVENTS)
IT = "it AS (SELECT series_id, iteration, max(value) FILTER (name = 'loglik_before') AS loglik_before, max(value) FILTER (name = 'loglik_after') AS loglik_after, max(value) FILTER (name = 'change') AS change, max(value) FILTER (name = 'seconds') AS seconds, max(value) FILTER (name = 'converged') > 0 AS converged FROM ev WHERE event = 'iteration' GROUP BY 1, 2)"
LAST = "la AS (SELECT series_id, state, name, arg_max(value, iteration) AS value FROM ev WHERE event = 'parameter' GROUP BY 1, 2, 3)"
_events = lambda spark: spark.createDataFrame(EVENTS, em_log.EVENTS)


def _em(name: str, sql: str, make) -> None:
    def run(spark, sf_dir):
        return make(_events(spark))

    run.__name__ = name
    query(sql)(run)


_em("em_iteration_table", f"WITH {EV}, {IT} SELECT series_id, iteration, loglik_before, loglik_after, change, seconds, converged, change < -1e-6 AS decreased FROM it", em_log.iterations)
_em("em_parameter_path", f"WITH {EV} SELECT series_id, iteration, state, name, value FROM ev WHERE event = 'parameter' AND state = 0 AND name = 'corr_alpha'", lambda e: em_log.parameters(e, 0, "corr_alpha"))
_em("em_likelihood_path", f"WITH {EV} SELECT series_id, iteration, value FROM ev WHERE event = 'iteration' AND name = 'loglik_after'", em_log.likelihoods)
_em("em_sigma_table", f"WITH {EV} SELECT series_id, iteration, state, item, max(value) FILTER (name = 'mean') AS mean, max(value) FILTER (name = 'sd') AS sd, max(value) FILTER (name = 'min') AS min, max(value) FILTER (name = 'max') AS max, max(value) FILTER (name = 'changed') > 0 AS changed FROM ev WHERE event = 'sigma' GROUP BY 1, 2, 3, 4", em_log.sigmas)
_em("em_boundary_table", f"WITH {EV} SELECT series_id, iteration, state, name, value, 'lower' AS side, 'none' AS action FROM ev WHERE event = 'boundary'", em_log.boundaries)
_em("em_warning_counts", f"WITH {EV} SELECT series_id, name AS kind, count(*) AS n FROM ev WHERE event = 'warning' GROUP BY 1, 2", em_log.warning_counts)
_em("em_monotonicity", f"WITH {EV}, {IT} SELECT series_id, count(*) FILTER (change < -1e-4) AS violations, min(change) AS worst, count(*) FILTER (change < -1e-4) <= 2 AS passed FROM it GROUP BY 1", em_log.monotonicity)
_em("em_convergence", f"WITH {EV}, {IT} SELECT series_id, count(*) AS iterations, arg_max(change, iteration) AS final_change, bool_or(converged) AS marked, bool_or(converged) OR abs(arg_max(change, iteration)) < 1e-4 AS converged FROM it GROUP BY 1", em_log.convergence)
_em("em_sigma_failures", f"WITH {EV} SELECT series_id, state, item, count(*) AS failures FROM ev WHERE event = 'sigma' AND name = 'changed' AND value = 0 GROUP BY 1, 2, 3", lambda e: em_log.sigma_failures(e).drop("iterations"))
_em("em_final_parameters", f"WITH {EV}, {LAST} SELECT * FROM la", em_log.final_parameters)
_em("em_violations", f"WITH {EV}, {LAST}, a AS (SELECT series_id, state, CASE WHEN name LIKE 'corr_%' THEN 0 ELSE 1 END AS item, sum(value) AS value FROM la WHERE name SIMILAR TO '(corr_)?(alpha|beta).*' GROUP BY 1, 2, 3) SELECT series_id, state, item, 'alpha + beta' AS name, round(value, 8) AS value, '< 1' AS \"constraint\" FROM a WHERE value >= 1", lambda e: _round(em_log.violations(e), "value", digits=8))
_em("em_one_iteration", f"WITH {EV} SELECT series_id, event, state, item, name, value, note FROM ev WHERE iteration = 4", lambda e: em_log.one_iteration(e, 4).drop("iteration"))
_em("em_state_comparison", f"WITH {EV}, {LAST} SELECT series_id, count(DISTINCT state) AS states, round(max(value) FILTER (name = 'omega_1') - min(value) FILTER (name = 'omega_1'), 8) AS omega_range, round((max(value) FILTER (name = 'omega_1') - min(value) FILTER (name = 'omega_1')) / avg(value) FILTER (name = 'omega_1'), 8) AS omega_relative, round(max(value) FILTER (name = 'corr_alpha') - min(value) FILTER (name = 'corr_alpha'), 8) AS alpha_range, (max(value) FILTER (name = 'omega_1') - min(value) FILTER (name = 'omega_1')) / avg(value) FILTER (name = 'omega_1') < 0.2 OR max(value) FILTER (name = 'corr_alpha') - min(value) FILTER (name = 'corr_alpha') < 0.05 AS similar FROM la GROUP BY 1", lambda e: _round(em_log.compare_states(e), "omega_range", "omega_relative", "alpha_range", digits=8))
_em("em_last_ranges", f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY state, name ORDER BY iteration DESC) AS k FROM ev WHERE event = 'parameter') SELECT series_id, state, name, count(*) AS n, round(max(value) - min(value), 8) AS spread FROM r WHERE k <= 5 GROUP BY 1, 2, 3", lambda e: _round(em_log.last_range(e), "spread", digits=8))
_em("em_correlation_trajectory", f"WITH {EV}, {IT}, p AS (SELECT series_id, iteration, max(value) FILTER (name = 'corr_alpha') AS alpha, max(value) FILTER (name = 'corr_beta') AS beta, max(value) FILTER (name = 'shape') AS shape FROM ev WHERE event = 'parameter' AND state = 0 GROUP BY 1, 2) SELECT series_id, iteration, alpha, beta, CAST(NULL AS DOUBLE) AS gamma, shape, round(alpha + beta, 8) AS persistence, loglik_after AS loglik FROM p JOIN it USING (series_id, iteration)", lambda e: _round(em_log.trajectory_with_likelihood(e), "persistence", digits=8))
_em("em_component_trajectory", f"WITH {EV} SELECT series_id, iteration, 1 AS component, max(value) FILTER (name = 'alpha1_1') AS alpha, max(value) FILTER (name = 'beta1_1') AS beta, round(max(value) FILTER (name = 'alpha1_1') + max(value) FILTER (name = 'beta1_1'), 8) AS persistence FROM ev WHERE event = 'parameter' AND state = 1 GROUP BY 1, 2", lambda e: _round(em_log.component_trajectory(e, 1), "persistence", digits=8))
_em("em_normalised_paths", f"WITH {EV} SELECT series_id, iteration, state, name, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.5 END, 8) AS value FROM ev WHERE event = 'parameter' WINDOW w AS (PARTITION BY state, name)", lambda e: _round(em_log.normalised_parameters(e, True), "value", digits=8))
_em("em_all_constant", f"WITH {EV} SELECT series_id, min(iteration) AS iteration FROM ev WHERE event = 'warning' AND name = 'all_states_constant' GROUP BY 1", em_log.all_states_constant)
_em("em_model_type", "SELECT 'all' AS series_id, 'dcc' AS model", em_log.model_type)
_em("em_problem_counts", f"WITH {EV}, {LAST}, c AS (SELECT state, sum(value) FILTER (name IN ('corr_alpha', 'corr_beta')) AS p, max(value) FILTER (name = 'shape') AS shape, sum(value) FILTER (name IN ('alpha1_1', 'beta1_1')) AS g FROM la GROUP BY state) SELECT 'all' AS series_id, state, (p > 0.95)::INT + (shape < 4)::INT + (shape > 100)::INT + (g > 0.99)::INT AS n FROM c WHERE p > 0.95 OR shape < 4 OR shape > 100 OR g > 0.99", lambda e: em_log.problems(e).groupBy("series_id", "state").agg(F.count("*").alias("n")))
_em("em_fit_overview", f"WITH {EV}, {IT}, c AS (SELECT series_id, count(DISTINCT state) AS states, count(*) FILTER (event = 'warning') AS warnings, count(*) FILTER (event = 'boundary') AS boundary_events FROM ev GROUP BY 1) SELECT c.*, round(sum(change), 8) AS improvement, round(avg(change), 8) AS mean_change, min(change) AS min_change, max(change) AS max_change, count(*) FILTER (change < -1e-6) AS decreases, sum(seconds) AS seconds, count(*) AS iterations, arg_max(change, iteration) AS final_change, bool_or(converged) AS marked, abs(arg_max(change, iteration)) < 1e-4 AS converged FROM c JOIN it USING (series_id) GROUP BY ALL", lambda e: _round(em_log.overview(e), "improvement", "mean_change", digits=8))


# --- regimes of a replicate
@query(f"WITH {DAY}, {STATES}, b AS (SELECT t, state, t - 0.5 AS xmin, t + 0.5 AS xmax, CASE WHEN state = 1 THEN 0.75 ELSE 0.25 END AS p FROM st) SELECT t, state, p, xmin, xmax FROM b")
def probability_band_table(spark, sf_dir):
    st = _states(spark, sf_dir)[1]
    return diagnostics.probability_bands(st.select("t", "state", F.when(F.col("state") == 1, 0.75).otherwise(0.25).alias("p")))


@query(f"WITH {DAY}, {STATES} SELECT t, x.range AS state, CASE WHEN (state = 1) = (x.range = 1) THEN 1.0 ELSE 0.0 END::DOUBLE AS p, 'original' AS series FROM st, range(2) x")
def probability_long_table(spark, sf_dir):
    st = _states(spark, sf_dir)[1].select("t", (1 - F.col("state")).cast("double").alias("p0"), F.col("state").cast("double").alias("p1"))
    return diagnostics.probability_table(st, ["p0", "p1"])
