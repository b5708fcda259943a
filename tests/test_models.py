"""Recovery, invariants and exact values of the numeric kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from serieslab.functions import arma, copula, dcc, dist, garch, ica, likelihood, optim, portfolio, regimes, switching
from serieslab.operators import bootstrap, diagnostics, em_log, fits, inference, montecarlo, resample, summary
from serieslab.sources import series as src


def test_stationary_law():
    p = np.array([[0.9, 0.1], [0.2, 0.8]])
    assert regimes.stationary_law(p) == pytest.approx([2 / 3, 1 / 3])


def test_hessian_of_known_functions():
    quad = optim.hessian(lambda x: x[0] ** 2 + 3 * x[1] ** 2 + 2 * x[0] * x[1], np.ones(2))
    assert quad == pytest.approx(np.array([[2, 2], [2, 6]]), abs=1e-4)
    rosen = optim.hessian(lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.ones(2))
    assert rosen == pytest.approx(np.array([[802, -400], [-400, 200]]), rel=1e-3)


def test_garch_recovers_its_parameters():
    f = garch.fit_garch(garch.simulate_garch(3000, 0.05, 0.08, 0.88, 3)).values
    assert abs(f["alpha1"] - 0.08) < 0.04 and abs(f["beta1"] - 0.88) < 0.08


def test_dcc_recovers_and_is_a_correlation():
    f = copula.fit_two_stage(dcc.simulate(900, 2, 0.05, 0.9, seed=4))
    par = f.correlation.par
    assert 0 <= par["alpha"] < 0.15 and par["beta"] > 0.6
    assert np.allclose(np.einsum("tii->ti", f.correlations()), 1)


def test_hmm_finds_the_regimes():
    y, state = regimes.simulate_regimes(600, np.array([[0.97, 0.03], [0.05, 0.95]]), [0.5, -0.5], [0.3, 1.5], 2)
    f = regimes.fit_hmm(y)
    assert (f["path"] == state).mean() > 0.9
    assert f["p"].sum(axis=1) == pytest.approx([1, 1])


def test_msvar_and_ms_garch_run_and_give_probabilities():
    rng = np.random.default_rng(1)
    y = rng.standard_normal((300, 2)).cumsum(axis=0) * 0.1 + rng.standard_normal((300, 2))
    f = regimes.fit_msvar(y)
    assert f["smooth"].shape == (300, 2) and f["smooth"].sum(axis=1) == pytest.approx(np.ones(300))
    g = regimes.fit_msgarch(garch.simulate_garch(250, 0.05, 0.1, 0.85, 1), max_iter=3)
    assert np.isfinite(g["aic"]) and len(g["log"]) <= 3 and (np.diff(g["log"]) > -1e-6).all()


def test_gogarch_covariances_are_positive():
    rng = np.random.default_rng(0)
    s = np.column_stack([garch.simulate_garch(600, 0.05, 0.15, 0.8, i) for i in range(2)])
    f = ica.fit_gogarch(s @ rng.standard_normal((2, 2)))
    assert (np.linalg.eigvalsh(f.covariance()) > 0).all()


def test_profile_interval_of_a_parabola():
    lo, hi = optim.profile_interval(lambda x: float((x**2).sum()) / 2 + 0.0, np.array([1e-9, 0.0]), 0, span=100)
    assert hi == pytest.approx(1.96, abs=0.1) and lo == pytest.approx(-1.96, abs=0.1)


def test_copula_scores_are_normal():
    z = copula.normal_scores(np.random.default_rng(0).exponential(size=(500, 2)))
    assert abs(z.mean()) < 1e-9 and abs(z.std() - 1) < 0.03


def test_validation(spark):
    good = spark.createDataFrame([(0, 1.0)], "t long, v double")
    assert src.validate(good) is good
    for bad in (good.where("t > 0"), spark.createDataFrame([(0, float("nan"))], "t long, v double"), spark.createDataFrame([("a",)], "x string")):
        with pytest.raises(src.SeriesError):
            src.validate(bad)
        assert src.validate(bad, "gracefully") is None


def test_bootstrap_shapes_and_bad_options(spark):
    s = spark.range(50).select("id", "id").toDF("t", "v").selectExpr("t", "cast(v as double) v")
    out = resample.block_bootstrap(s, block_length=7, num_blocks=3, num_boots=4)
    assert {(r["boot_id"], r["count"]) for r in out.groupBy("boot_id").count().collect()} == {(b, 21) for b in range(4)}
    assert diagnostics.blocks_by_source(out, 50).groupBy("boot_id").count().count() == 4
    for bad in ({"block_type": "nonoverlapping"}, {"block_length": 51}, {"num_boots": 0}, {"n_boot": 2.5}, {"bs_type": "stationary", "p": 1.0}):
        with pytest.raises(ValueError):
            resample.block_bootstrap(s, **bad).count()


def test_series_that_are_short_or_constant(spark):
    short = spark.createDataFrame([(i, float(i)) for i in range(3)], "t long, v double")
    flat = spark.createDataFrame([(i, 2.0) for i in range(40)], "t long, v double")
    assert resample.default_block_length(short).first()["block_length"] == 3
    assert resample.block_bootstrap(short, num_boots=2).count() == 6
    assert resample.geometric_p(flat, "plugin") == 0.999
    assert summary.original_stats(flat, "v").first()["ac1"] == 0
    states = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "t long, state int")
    got = {(r["i"], r["j"]): r["p"] for r in resample.transition_counts(states).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 0.0, (1, 1): 1.0}
    assert resample.pool_bootstrap(short, states, 2, 10).count() == 20


def test_counts_and_intervals_are_checked():
    assert [src.invalid_count(x) for x in (None, 1, 2.0, 0, -1, 2.5, True, float("inf"), float("nan"), "a", 2**31)] == [False, False, False] + [True] * 8
    assert [src.outside_unit_interval(x) for x in (None, 0.5, 0, 1, float("nan"), "a")] == [False, False, True, True, True, True]
    assert not src.outside_unit_interval(1, closed=True)


def test_linear_recursion_is_the_loop():
    r = np.random.default_rng(0)
    u = r.standard_normal((331, 2, 2))
    got = garch.linear_recursion(u, 0.83, np.eye(2))
    want = np.empty_like(u)
    want[0] = np.eye(2)
    for t in range(1, len(u)):
        want[t] = u[t] + 0.83 * want[t - 1]
    assert np.allclose(got, want)


def test_forward_backward_is_the_loop():
    r = np.random.default_rng(1)
    ll, p, first = r.standard_normal((57, 3)) * 4, r.dirichlet(np.ones(3), 3), np.array([0.2, 0.3, 0.5])
    b, a = np.exp(ll), np.empty((57, 3))
    a[0] = first * b[0]
    for t in range(1, 57):
        a[t] = a[t - 1] @ p * b[t]
    back = np.ones((57, 3))
    for t in range(55, -1, -1):
        back[t] = p @ (b[t + 1] * back[t + 1])
    smooth, joint, total = regimes.forward_backward(ll, p, first)
    assert total == pytest.approx(np.log(a[-1].sum()))
    assert np.allclose(smooth, a * back / (a * back).sum(axis=1, keepdims=True))
    assert joint.sum() == pytest.approx(56)
    assert np.allclose(regimes.filtered(ll, p, first), a / a.sum(axis=1, keepdims=True))


@pytest.mark.parametrize("law", dist.LAWS)
def test_laws_have_mean_0_and_variance_1(law):
    args = {n: v * 1.2 + 0.2 * (n == "skew") for n, v, *_ in dist.LAWS[law]}
    x = np.linspace(-60, 60, 120001)
    f = np.exp(dist.log_density(law, x, **args)) * (x[1] - x[0])
    assert [f.sum(), (x * f).sum(), (x * x * f).sum()] == pytest.approx([1, 0, 1], abs=2e-3)
    assert dist.cdf(law, np.array([0.5]), **args)[0] == pytest.approx(f[x <= 0.5].sum(), abs=1e-3)
    assert dist.quantile(law, dist.cdf(law, np.array([0.5]), **args), **args)[0] == pytest.approx(0.5, abs=1e-3)


def test_special_functions_and_tests():
    assert dist.digamma(1.0) == pytest.approx(-0.5772156649) and dist.chi2_quantile(0.95, 1) == pytest.approx(3.841458820694124)
    assert dist.t_quantile(np.array([0.975]), 10)[0] == pytest.approx(2.228138852)
    w, p = dist.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert (w, p) == pytest.approx((0.79, 0.0067), abs=2e-3)
    assert dist.geometric_quantile(0.99, 0.1) == 43


@pytest.mark.parametrize("options", [{}, {"law": "mvt"}, {"asymmetric": True}, {"law": "mvt", "copula": True}, {"law": "mvt", "asymmetric": True, "copula": True}, {"free": True}, {"law": "mvt", "free": True}])
@pytest.mark.parametrize("seed", [1, 2])
def test_correlation_gradients_are_the_numerical_ones(options, seed):
    z = dcc.simulate_residuals(300, 3, 0.06, 0.88, np.full((3, 3), 0.4) + 0.6 * np.eye(3), seed)
    _, x = dcc.start_of(options.get("asymmetric", False), options.get("law", "mvn"))
    x = np.r_[dcc.to_free(x[0], x[1]), x[2:]] if options.get("free") else x
    assert dcc.check_gradient(x, z, dcc.weighted_correlation(z), **options) < 1e-6


@pytest.mark.parametrize("law", dcc.LAWS)
def test_analytic_hessian_is_the_numerical_one(law):
    z = dcc.simulate_residuals(400, 2, 0.05, 0.9, np.array([[1, 0.5], [0.5, 1]]), 3)
    q, par = dcc.weighted_correlation(z), np.array([0.05, 0.9] + [8.0] * (law == "mvt"))
    w = np.random.default_rng(0).uniform(0.5, 1.5, 400)
    numeric = optim.hessian(lambda p: dcc.nll(np.r_[p, par[2:]], z, q, w, law), par[:2])
    assert np.allclose(dcc.analytic_hessian(par, z, q, w, law), numeric, rtol=1e-4)


def test_parameters_of_correlations():
    assert dcc.from_free(*dcc.to_free(0.05, 0.9)) == pytest.approx((0.05, 0.9))
    assert dcc.from_ratio(*dcc.to_ratio(0.05, 0.9)) == pytest.approx((0.05, 0.9))
    j = dcc.free_jacobian(*dcc.to_free(0.05, 0.9))
    numeric = np.column_stack([(np.array(dcc.from_free(*(np.array(dcc.to_free(0.05, 0.9)) + e))) - np.array(dcc.from_free(*(np.array(dcc.to_free(0.05, 0.9)) - e)))) / 2e-6 for e in np.eye(2) * 1e-6])
    assert np.allclose(j, numeric, atol=1e-7)
    assert dcc.persistence({"alpha_2": 0.02, "alpha_1": 0.03, "beta_1": 0.9})["alphas"] == [0.03, 0.02]
    assert dcc.order_of({"alpha_1": 0.1, "alpha_2": 0.1, "beta_1": 0.5, "shape": 5}) == (2, 1) and dcc.is_11({"alpha": 0.1, "beta": 0.8})
    assert not dcc.stationarity({"alpha": 0.2, "beta": 0.85})[0] and not dcc.stationarity({"alpha": -0.1, "beta": 0.85})[0] and dcc.stationarity({"alpha": 0.1, "beta": 0.85})[0]
    with pytest.raises(ValueError):
        dcc.check_order((1, 0))
    r = dcc.safe_correlation(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]]))
    assert np.linalg.eigvalsh(r).min() > 0 and np.allclose(np.diag(r), 1)


def test_errors_shrink_and_gates_say_why():
    q = np.array([[1, 0.5], [0.5, 1]])
    small, large = (dcc.simulate_residuals(n, 2, 0.08, 0.85, q, 5) for n in (400, 4000))
    a, b = (dcc.gated_errors(dcc.fit(z), z) for z in (small, large))
    assert a["valid"] and b["valid"] and (b["se"] < a["se"]).all()
    s = dcc.errors(dcc.fit(large).vector(), large, dcc.weighted_correlation(large), method="sandwich")["se"]
    assert np.allclose(s, b["se"], rtol=0.5)
    assert dcc.gated_errors(dcc.fit_constant(small), small)["reason"] == "constant"
    noise = np.random.default_rng(2).standard_normal((500, 2))
    assert not dcc.select(noise)[0].dynamic and dcc.select(large)[0].dynamic and dcc.select(large, force_constant=True)[1] == "forced"
    par = dcc.fit(large).vector()
    free, se, v = dcc.transform_errors(par, b["vcov"], True)
    assert np.allclose(dcc.transform_errors(free, v, False)[2], b["vcov"])
    wide, narrow = dcc.wald(par, b["se"], 0.99), dcc.wald(par, b["se"], 0.9)
    assert (wide[:, 0] < narrow[:, 0]).all() and (wide[:, 1] > narrow[:, 1]).all()
    held = dcc.held_profile(par, large, dcc.weighted_correlation(large))
    assert held["lower"] < par[0] < held["upper"]


def test_copula_margins():
    r = np.random.default_rng(0)
    x = r.standard_normal((800, 2))
    for transform in copula.TRANSFORMS:
        u = copula.uniforms(x, transform)
        assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.05
        assert abs(np.corrcoef(copula.scores(u)[:, 0], x[:, 0])[0, 1]) > 0.98
    assert copula.average_ranks(np.array([1.0, 1.0, 3.0])).tolist() == [1.5, 1.5, 3.0]
    s = copula.scores(copula.uniforms(x), "mvt", 6.0)
    assert s.std() == pytest.approx(1, abs=0.1)


def test_likelihood_by_row_sums_to_the_total_at_any_parameters():
    y = dcc.simulate(500, 2, 0.06, 0.88, seed=3)
    for f in (copula.fit_two_stage(y), copula.fit_two_stage(y, copula=True, law="mvt"), copula.fit_two_stage(y, force_constant=True), ica.fit_gogarch(y)):
        rows = likelihood.at(f, by_row=True)
        assert rows.sum() == pytest.approx(likelihood.at(f)) == pytest.approx(likelihood.at(f, parts=True)["total"]) == pytest.approx(f.rows().sum())
    f = copula.fit_two_stage(y)
    assert likelihood.at(f, {"alpha": 0.2, "beta": 0.5}) < likelihood.at(f)
    for bad in ({"nothing": 1.0}, {"alpha": 0.5, "beta": 0.6}):
        with pytest.raises(ValueError):
            likelihood.at(f, bad)


def test_components_are_found():
    y, _, a = ica.simulate(2000, 3, law="std", shape=4.0, a=np.array([[1, 0.5, 0.2], [0.1, 1, 0.4], [0.3, 0.2, 1.0]]))
    for method in ("radical", "fastica"):
        f = ica.fit_gogarch(y, method=method)
        assert ica.amari_distance(f.ica.a, a) < 0.2 and ica.mixing_angle(f.ica.a, a) < 0.4
        assert np.allclose(f.ica.w @ f.ica.a, np.eye(3), atol=1e-8) and not ica.problems(f)
    assert ica.amari_distance(a[:, [2, 0, 1]] * [2, -1, 3], a) == pytest.approx(0, abs=1e-9)
    assert {r["name"] for r in ica.summary(f)} == {"omega", "alpha1", "beta1"}
    assert ica.diagnose(f, y)["covariance_error"] < 0.3


def test_arma_recovers_and_its_filter_is_exact():
    e = np.random.default_rng(0).standard_normal(1500)
    x = e.copy()
    for i in range(1, len(x)):
        x[i] = 0.6 * x[i - 1] + e[i] + 0.3 * e[i - 1]
    assert arma.fit_arma(x, (1, 1))["coef"] == pytest.approx([0.6, 0.3], abs=0.08)
    v, f = arma.innovations(x[:5], np.array([0.6]), np.array([0.3]))
    lags = [(1 + 0.3 * 0.6) * (0.6 + 0.3) / (1 - 0.36) * 0.6 ** (k - 1) if k else (1 + 2 * 0.6 * 0.3 + 0.09) / (1 - 0.36) for k in range(5)]
    cov = np.array([[lags[abs(i - j)] for j in range(5)] for i in range(5)])
    want = -0.5 * (np.linalg.slogdet(cov)[1] + x[:5] @ np.linalg.solve(cov, x[:5]))
    assert -0.5 * (np.log(f) + v * v / f).sum() == pytest.approx(want)


@pytest.mark.parametrize("kind", switching.KINDS)
def test_switching_models(kind):
    a, b = dcc.simulate(240, 2, 0.05, 0.9, seed=1), dcc.simulate(240, 2, 0.05, 0.9, qbar=np.array([[1, -0.5], [-0.5, 1]]), seed=2) * 3
    y = np.vstack([a[:120], b[:120], a[120:], b[120:]])
    f = switching.fit_switching(y[:, :1] if kind == "univariate" else y, switching.specs(kind, 2), max_iter=4)
    assert f.smooth.shape == (480, 2) and np.allclose(f.smooth.sum(axis=1), 1) and np.allclose(f.p.sum(axis=1), 1)
    assert f.parameters == switching.parameter_count(f.fits) and len(f.log.iterations) <= 4
    got = switching.log_likelihood_rows(y[:, :1] if kind == "univariate" else y, f.fits[0])
    assert np.allclose(got[1:], f.fits[0].rows, atol=1e-6)
    if kind in ("univariate", "dcc"):
        assert f.log.iterations[-1]["loglik_after"] > f.log.iterations[0]["loglik_before"]


def test_switching_models_reject_bad_input():
    y = np.random.default_rng(0).standard_normal((100, 2))
    for bad in ({"state_specs": switching.specs("dcc", 1)}, {"state_specs": switching.specs("univariate", 2)}, {"state_specs": [*switching.specs("dcc", 1), *switching.specs("gogarch", 1)]}, {"state_specs": switching.specs("dcc", 2), "d": 100}, {"state_specs": switching.specs("dcc", 2), "criterion": "x"}):
        with pytest.raises(ValueError):
            switching.fit_switching(y, **bad)
    for bad in ({"kind": "x"}, {"order": (1, 0)}, {"kind": "dcc", "ma": 1}, {"law": "x"}):
        with pytest.raises(ValueError):
            switching.StateSpec(**bad)


def test_pools_and_chains():
    path = np.array([0, 0, 0, 1, 1, 0, 0, 1])
    u = lambda k: (k * 0.37) % 1
    sim = regimes.simulate_chain(50, regimes.chain_law(path), u)
    rows = regimes.sample_pools(path, sim, 3, u)
    assert (path[rows] == sim).all()
    assert regimes.consecutive_starts(np.array([1, 2, 3, 7, 8, 10]), 3).tolist() == [1]
    with pytest.raises(ValueError):
        regimes.sample_pools(path, np.array([2]), 1, u)
    y = np.random.default_rng(0).standard_normal((50, 3))
    assert np.allclose(regimes.regime_series(y), y.mean(axis=1)) and np.allclose(regimes.regime_series(y, 1), y[:, 1])
    assert regimes.regime_series(y, "first_pc").std() > 0.9
    with pytest.raises(ValueError):
        regimes.regime_series(y, "x")


@pytest.mark.parametrize("law", ["norm", "std", "sstd"])
def test_hmm_with_other_emissions(law):
    y, state = regimes.simulate_regimes(800, np.array([[0.97, 0.03], [0.05, 0.95]]), [0.5, -0.5], [0.3, 1.5], 2)
    f = regimes.fit_hmm_law(y, 2, law)
    assert (f["path"] == state).mean() > 0.9 and f["durations"][0] > 10


def test_portfolios_sum_to_one():
    y = np.random.default_rng(0).standard_normal((300, 4)) * [0.01, 0.02, 0.01, 0.03] + 0.001
    for name, f in portfolio.STATISTICS.items():
        assert f(y).sum() == pytest.approx(1), name
    share = (w := portfolio.risk_parity(y)) * (np.cov(y.T) @ w)
    assert np.allclose(share / share.sum(), 0.25, atol=1e-3)
    assert portfolio.min_variance(y, short=False).min() >= 0
    assert portfolio.metrics(y, portfolio.equal_weight(y))["drawdown"] <= 0


def test_monte_carlo_table(spark):
    sims = montecarlo.dcc_study(spark, 6, 150)
    r = montecarlo.study_summary(sims).collect()
    assert {x["name"] for x in r} == {"alpha", "beta"} and all(x["n"] <= 6 for x in r)
    assert montecarlo.normality(sims).count() <= 2 and "simulations" in montecarlo.describe(sims, 6)
    got = montecarlo.complete_study(spark, "cgarch", 3, 120, 5)
    assert got["surface"].count() == 25 and set(got) == {"simulations", "summary", "intervals", "normality", "surface"}


def test_every_fit_gives_rows(spark):
    y = dcc.simulate(200, 2, 0.05, 0.9, seed=4)
    df = spark.createDataFrame([("a", i, float(p), float(q)) for i, (p, q) in enumerate(y)], "series_id string, t long, x double, y double")
    for fit, name, needs in ((fits.copula_garch, "copula", "alpha"), (fits.adcc, "adcc", "gamma"), (fits.gogarch, "gogarch", "alpha1_2"), (fits.ms_garch, "ms_garch", "alpha1_1"), (fits.hmm_law, "hmm", "shape0")):
        got = {r["name"]: r["value"] for r in fits.fit_each(df, ["x", "y"], fit, name).collect()}
        assert needs in got
    assert fits.covariance_path(df, ["x", "y"], "adcc").count() == 600
    assert fits.likelihood_rows(df, ["x", "y"], "dcc", {}).count() == 200


def test_ms_garch_tells_whether_it_converged():
    y = garch.simulate_garch(120, 0.05, 0.1, 0.85, 1)
    assert not regimes.fit_msgarch(y, max_iter=1)["converged"]
    assert regimes.fit_msgarch(y, tol=1e9, max_iter=3)["converged"]


def test_bootstrap_errors_and_profiles(spark):
    z = dcc.simulate_residuals(400, 2, 0.08, 0.85, np.array([[1, 0.5], [0.5, 1]]), 5)
    p = inference.Problem(z)
    table = {r["name"]: r for r in inference.comprehensive(spark, p, 12, points=12).collect()}
    mle = p.fit().par
    for name in ("alpha", "beta"):
        r = table[name]
        assert r["estimate"] == pytest.approx(mle[name]) and r["profile_lower"] < r["estimate"] < r["profile_upper"] and r["n_valid"] <= 12
    lo, hi = inference.local_profile(p, mle, "alpha", 40)
    assert lo < mle["alpha"] < hi
    est = inference.bootstrap_estimates(spark, p, p.fit().vector(), 5, "parametric")
    assert est.count() == 10
    few = {r["reason"] for r in inference.bootstrap_table(est.where("boot_id < 2"), mle).collect()}
    assert few == {"insufficient"}
    g = ica.fit_gogarch(dcc.simulate(200, 2, 0.05, 0.9, seed=4))
    assert inference.gogarch_comprehensive(spark, g, n_boot=4).count() == 6
    with pytest.raises(ValueError):
        inference.Problem(z, kind="x")


def test_profile_intervals_of_a_parabola(spark):
    rows = [("a", 1 + d / 10, (d / 10) ** 2 * 50) for d in range(-10, 11) if d] + [("b", 1 + d / 10, 0.0) for d in range(-3, 4) if d]
    got = {r["name"]: (r["lower"], r["upper"]) for r in inference.profile_intervals(spark.createDataFrame(rows, "name string, at double, rise double"), {"a": 1.0, "b": 1.0}).collect()}
    half = (3.841458820694124 / 2 / 50) ** 0.5
    assert got["a"] == pytest.approx((1 - half, 1 + half), abs=0.01) and got["b"] == pytest.approx((0.7, 1.3))


def log_of(changes, alphas=(0.05,)) -> switching.EmLog:
    log, last = switching.EmLog(), -100.0
    for i, c in enumerate(changes, 1):
        log.iteration(i, last, last + c, 0.5, False)
        last += c
        log.parameter(i, 0, {"omega_1": 0.1, "alpha1_1": 0.3, "beta1_1": 0.75, "corr_alpha": alphas[(i - 1) % len(alphas)], "corr_beta": 0.94, "shape": 2.5})
        log.parameter(i, 1, {"omega_1": 0.1, "alpha1_1": 0.05, "beta1_1": 0.9, "corr_alpha": 0.02, "corr_beta": 0.9})
        log.spread(i, 0, 1, np.array([1.0, 2.0]))
    log.edge(1, 1, "alpha", 0.01, "lower", "none")
    log.warn(2, "all_states_constant", "no state moves")
    return log


def test_em_tables_and_checks(spark, tmp_path):
    ev = spark.createDataFrame(em_log.rows(log_of([5, 1, -0.5, 0.1, 0.01, 0.00001], (0.05, 0.2))), em_log.EVENTS)
    assert [r["change"] for r in em_log.iterations(ev).orderBy("iteration").collect()][2] == pytest.approx(-0.5)
    m = em_log.monotonicity(ev).first()
    assert (m["violations"], m["passed"]) == (1, True)
    c = em_log.convergence(ev).first()
    assert c["iterations"] == 6 and c["converged"] and not c["marked"]
    assert em_log.sigma_failures(ev).first()["failures"] == 5
    v = {(r["state"], r["item"], r["name"]) for r in em_log.violations(ev).collect()}
    assert v == {(0, 1, "alpha + beta"), (0, 0, "alpha + beta")}
    said = " ".join(r["problem"] for r in em_log.problems(ev, 0).collect())
    assert "persistence" in said and "below 3" in said and "corr_alpha still moves" in said
    assert em_log.compare_states(ev).first()["similar"]
    assert em_log.trajectory_with_likelihood(ev, 1).count() == 6 and em_log.component_trajectory(ev, 0, 1).count() == 6
    assert em_log.all_states_constant(ev).first()["iteration"] == 2 and em_log.model_type(ev).first()["model"] == "dcc"
    o = em_log.overview(ev).first()
    assert (o["states"], o["warnings"], o["boundary_events"], o["decreases"]) == (2, 1, 1, 1)
    assert "all: 6 iterations" in em_log.describe(ev)
    assert {r["value"] for r in em_log.plot_table(ev, "parameters", True).where("name = 'omega_1'").collect()} == {0.5}
    assert em_log.one_iteration(ev, 2).where("event = 'warning'").count() == 1
    em_log.save(ev, str(tmp_path))
    assert em_log.load(spark, str(tmp_path)).count() == ev.count()
    em_log.export_csv(ev, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/em_iterations").count() == 6


def test_switching_events_and_states_in_tasks(spark):
    a = regimes.simulate_regimes(200, np.array([[0.95, 0.05], [0.1, 0.9]]), [0.0, 0.0], [0.5, 2.0], 1)[0]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a)], "t long, x double")
    ev = fits.switching_events(df, ["x"], switching.specs("univariate", 2), max_iter=3)
    assert em_log.iterations(ev).count() == 3
    here = switching.fit_switching(a, switching.specs("univariate", 2), max_iter=2)
    there = fits.switching_driver(df, ["x"], switching.specs("univariate", 2), max_iter=2)
    assert there.loglik == pytest.approx(here.loglik)


@pytest.mark.parametrize("bs_type", bootstrap.TYPES)
def test_front_door(spark, bs_type):
    y, _ = regimes.simulate_regimes(150, np.array([[0.95, 0.05], [0.1, 0.9]]), [0.2, 0.0], [0.5, 2.0], 1)
    cols = {"x": y, "y": np.random.default_rng(0).standard_normal(150) + y}
    rows = [(s, i, float(cols["x"][i]), float(cols["y"][i])) for s in ("a", "b") for i in range(150 if s == "a" else 130)]
    many = spark.createDataFrame(rows, "series_id string, t long, x double, y double")
    many = many.drop("y") if bs_type == "ms_varma_garch" else many
    out = bootstrap.bootstrap(many, bs_type, num_boots=3, func=lambda x: {"mean": x.mean(), "ends": x[[0, -1]]}, return_fit=True, return_diagnostics=True, control={"max_iter": 2}, seed=4)
    k = 1 if bs_type == "ms_varma_garch" else 2
    assert {(r["series_id"], r["boot_id"], r["count"]) for r in out.series.groupBy("series_id", "boot_id").count().collect()} == {(s, b, n) for s, n in (("a", 150), ("b", 130)) for b in range(3)}
    assert out.func_outs.count() == 2 * 3 * 3 * k and out.func_out_means.count() == 2 * 3 * k
    outs, means = out.func_outs.collect(), out.func_out_means.first()
    same = [r["value"] for r in outs if (r["series_id"], r["name"], r["idx"]) == (means["series_id"], means["name"], means["idx"])]
    assert means["mean_value"] == pytest.approx(np.mean(same))
    assert (out.fit is not None) == (bs_type in ("hmm", "msvar", "ms_varma_garch"))
    assert out.diagnostics.replicate_stats.count() == 2 * 3 * k
    one = bootstrap.bootstrap(many.where("series_id = 'a'").drop("series_id"), bs_type, num_boots=2, func={"mean": F.avg}, control={"max_iter": 2})
    assert "series_id" not in one.series.columns and one.func_outs.count() == 2 * k


def test_front_door_options(spark):
    s = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "t long, v double")
    for bad in ({"bs_type": "x"}, {"num_boots": 0}, {"p": 1.5}, {"apply_func_to": "x"}, {"p_method": "x"}, {"bs_type": "hmm", "distribution": "x"}):
        with pytest.raises(ValueError):
            bootstrap.bootstrap(s, **bad)
    assert bootstrap.bootstrap(s.where("t < 0"), graceful=True) is None
    with pytest.raises(src.SeriesError):
        bootstrap.bootstrap(s.where("t < 0"))
    assert bootstrap.bootstrap(s, "stationary", num_boots=2, p_method="cv").config["p"] == 0.01
    assert bootstrap.bootstrap(s, "hmm", num_boots=2, n_boot=30, distribution="std_raw", micro_block_length=2).series.count() == 60
    d = bootstrap.bootstrap(s, "moving", num_boots=4, return_diagnostics=True).diagnostics
    text = diagnostics.describe(d)
    assert "moving" in text and "Blocks" in text and diagnostics.headline(d).startswith("moving")
    assert {t: diagnostics.plot_table(d, t).count() > 0 for t in diagnostics.PLOTS} == dict.fromkeys(diagnostics.PLOTS, True)
    assert set(d.tables()) == {"meta", "replicate_stats", "original_stats", "blocks"}
