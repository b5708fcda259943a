"""Markov-switching VARMA-GARCH: M states, each with a conditional mean and a univariate, DCC, copula or orthogonal volatility model.

EM: every state's log-likelihood by row, filter and smoother, the transition matrix, then each state's weighted fit.
Rows that a state's lags use up have log-likelihood 0 in every state; what is not finite counts as -1e10.
"""

from __future__ import annotations

import dataclasses
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from serieslab.functions import arma, copula, dcc, ica
from serieslab.functions.garch import GarchFit, GarchSpec, fit_garch
from serieslab.functions.regimes import STAY, fit_hmm, forward_backward, viterbi

KINDS = ("univariate", "dcc", "cgarch", "gogarch")
DYNAMICS = ("dcc", "adcc", "constant")
FLOOR = -1e10


@dataclass
class StateSpec:
    """What one state is made of. start holds values that the first iteration begins with, by name."""

    kind: str = "univariate"
    ar: int = 1
    ma: int = 0
    garch: GarchSpec = field(default_factory=GarchSpec)
    law: str = "mvn"
    dynamics: str = "dcc"
    order: tuple[int, int] = (1, 1)
    transform: str = "parametric"
    ica_method: str = "radical"
    components: int | None = None
    start: dict[str, float] = field(default_factory=dict)
    force_constant: bool = False

    def __post_init__(self) -> None:
        for value, allowed in ((self.kind, KINDS), (self.dynamics, DYNAMICS), (self.law, dcc.LAWS), (self.transform, copula.TRANSFORMS), (self.ica_method, ica.METHODS)):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")
        self.order = dcc.check_order(self.order)
        if self.ma and self.kind != "univariate":
            raise ValueError("only univariate states have moving averages")


def check_orders(specs: list[StateSpec]) -> list[StateSpec]:
    return [dataclasses.replace(s, order=dcc.check_order(s.order)) for s in specs]


def specs(kind: str, states: int, seed: int | None = None, simple: bool = False, **options) -> list[StateSpec]:
    """Specs of `states` states whose starting values spread from calm to lively; simple ones all start alike."""
    rng = np.random.default_rng(seed)
    out = []
    for s in range(states):
        at = 0.0 if simple or states == 1 else s / (states - 1)
        jitter = 1 + (0 if seed is None else 0.1 * rng.standard_normal())
        start = {"omega": (0.05 + 0.1 * at) * abs(jitter), "alpha1": 0.05 + 0.08 * at, "beta1": 0.9 - 0.12 * at}
        if kind in ("dcc", "cgarch"):
            start |= {"alpha": 0.03 + 0.05 * at, "beta": 0.94 - 0.1 * at}
        out.append(StateSpec(kind=kind, start=start, **options))
    return out


def single_spec(kind: str = "dcc", **options) -> StateSpec:
    return specs(kind, 1, simple=True, **options)[0]


@dataclass
class EmLog:
    """What happened, appended to as EM goes; operators.em_log makes tables of it."""

    iterations: list[dict] = field(default_factory=list)
    parameters: list[dict] = field(default_factory=list)
    sigma: list[dict] = field(default_factory=list)
    boundary: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)

    def iteration(self, number: int, before: float, after: float, seconds: float, converged: bool) -> None:
        self.iterations.append({"iteration": number, "loglik_before": before, "loglik_after": after, "change": after - before, "decreased": bool(after - before < -1e-6), "seconds": seconds, "converged": converged})

    def parameter(self, number: int, state: int, values: dict[str, float]) -> None:
        self.parameters += [{"iteration": number, "state": state, "name": k, "value": float(v)} for k, v in values.items()]

    def spread(self, number: int, state: int, series: int, sigma: np.ndarray) -> None:
        last = next((x for x in reversed(self.sigma) if x["state"] == state and x["series"] == series), None)
        row = {"iteration": number, "state": state, "series": series, "mean": float(sigma.mean()), "sd": float(sigma.std(ddof=1)) if len(sigma) > 1 else 0.0, "min": float(sigma.min()), "max": float(sigma.max())}
        self.sigma.append(row | {"changed": last is None or abs(last["mean"] - row["mean"]) > 1e-12})

    def edge(self, number: int, state: int, name: str, value: float, side: str, action: str) -> None:
        self.boundary.append({"iteration": number, "state": state, "name": name, "value": float(value), "side": side, "action": action})

    def warn(self, number: int, kind: str, message: str) -> None:
        self.warnings.append({"iteration": number, "kind": kind, "message": message})


@dataclass
class StateFit:
    spec: StateSpec
    mean: dict
    volatility: GarchFit | copula.TwoStage | ica.GogarchFit
    rows: np.ndarray
    reason: str = ""

    @property
    def margins(self) -> list[GarchFit]:
        v = self.volatility
        return [v] if isinstance(v, GarchFit) else v.margins if isinstance(v, copula.TwoStage) else v.fits

    @property
    def correlation(self) -> dict[str, float]:
        return self.volatility.correlation.par if isinstance(self.volatility, copula.TwoStage) else {}

    @property
    def constant(self) -> bool:
        return isinstance(self.volatility, copula.TwoStage) and not self.volatility.correlation.dynamic

    def values(self) -> dict[str, float]:
        """Every estimate by name; margins and components are numbered."""
        many = len(self.margins) > 1
        out = {f"{n}_{i}" if many else n: v for i, m in enumerate(self.margins, 1) for n, v in m.values.items()}
        out |= {f"corr_{n}" if n in ("alpha", "beta", "gamma") else n: v for n, v in self.correlation.items()}
        return out

    def mean_parameters(self) -> int:
        return int(np.size(self.mean["coef"]))


def fit_mean(y: np.ndarray, w: np.ndarray, spec: StateSpec) -> dict:
    if spec.ma:
        # The filter has no intercept, so the weighted mean is taken off
        centre = float(w @ y[:, 0] / w.sum())
        found = arma.fit_arma(y[:, 0] - centre, (spec.ar, spec.ma), w)
        return {"coef": np.r_[centre, found["coef"]], "residuals": found["residuals"][:, None]}
    return arma.fit_var(y, spec.ar, w)


def fit_state(y: np.ndarray, w: np.ndarray, spec: StateSpec, last: StateFit | None = None, criterion: str = "bic", threshold: float = 0.02) -> StateFit:
    """One state's weighted fit: the mean, then the volatility of its residuals. Later fits start from the last one's."""
    mean = fit_mean(y, w, spec)
    e = mean["residuals"]
    we = w[len(w) - len(e) :]
    reason = ""
    begin = lambda c, i: np.array([spec.start.get(n, v) for n, v in zip(spec.garch.names(), spec.garch.start(c), strict=True)]) if last is None else last.margins[i].par
    if spec.kind == "univariate":
        vol: GarchFit | copula.TwoStage | ica.GogarchFit = fit_garch(e[:, 0], we, spec.garch, begin(e[:, 0], 0), iterations=60)
        rows = spec.garch.loglik(e[:, 0], vol.par, vol.h)
    elif spec.kind == "gogarch":
        vol = ica.fit_gogarch(e, we, spec.ica_method, spec.components, spec.garch, restarts=1 if last else 3)
        rows = vol.rows()
    else:
        constant = spec.force_constant or spec.dynamics == "constant" or spec.order == (0, 0) or last is not None and last.constant
        start = None if last is None else last.margins
        vol = copula.fit_two_stage(e, we, spec.law, spec.dynamics == "adcc", spec.kind == "cgarch", spec.transform, spec.garch, spec.order, None if spec.order not in ((1, 1), (0, 0)) else criterion, threshold, constant, start=start)
        rows, reason = vol.rows(), vol.reason
    return StateFit(spec, mean, vol, rows, reason)


def log_densities(fits: list[StateFit], n: int) -> np.ndarray:
    """n x M log-likelihoods by row, padded and floored."""
    out = np.zeros((n, len(fits)))
    for s, f in enumerate(fits):
        out[n - len(f.rows) :, s] = np.where(np.isfinite(f.rows), f.rows, FLOOR)
    # Rows that any state lacks tell nothing about the others
    out[: n - min(len(f.rows) for f in fits)] = 0.0
    return out


def edge_states(fits: list[StateFit], threshold: float = 0.02) -> list[int]:
    """States whose dynamic correlation has an alpha below the threshold."""
    return [s for s, f in enumerate(fits) if not f.constant and any(v < threshold for k, v in f.correlation.items() if k.startswith("alpha"))]


def correlation_parameters(fits: list[StateFit]) -> int:
    return sum(k.split("_")[0] in ("alpha", "beta", "gamma") for f in fits for k in f.correlation)


def parameter_count(fits: list[StateFit]) -> int:
    """Means, every margin's parameters, correlation dynamics and shapes, and the free transitions."""
    m = len(fits)
    return sum(f.mean_parameters() + sum(len(g.par) for g in f.margins) + len(f.correlation) for f in fits) + m * (m - 1)


@dataclass
class SwitchingFit:
    fits: list[StateFit]
    p: np.ndarray
    smooth: np.ndarray
    path: np.ndarray
    loglik: float
    aic: float
    bic: float
    parameters: int
    converged: bool
    refitted: list[int]
    log: EmLog


def start_weights(y: np.ndarray, states: int) -> np.ndarray:
    """Responsibilities to begin with: regimes of the rows' distance from their median."""
    if states == 1:
        return np.ones((len(y), 1))
    return 0.8 * fit_hmm(y, states, max_iter=20, diagonal=True)["smooth"] + 0.2 / states


def em(y: np.ndarray, state_specs: list[StateSpec], max_iter: int = 50, tol: float = 1e-4, criterion: str = "bic", threshold: float = 0.02, m_step: Callable | None = None) -> SwitchingFit:
    """EM without the refit. m_step(y, weights, specs, last) may fit the states elsewhere, such as one a Spark task."""
    n, m, log = len(y), len(state_specs), EmLog()
    if m_step is None:

        def m_step(y, w, specs_, last):
            return [fit_state(y, w[:, s], spec, None if last is None else last[s], criterion, threshold) for s, spec in enumerate(specs_)]

    p = np.full((m, m), 1 / m)
    np.fill_diagonal(p, STAY)
    p /= p.sum(axis=1, keepdims=True)
    first = np.full(m, 1 / m)
    fits = m_step(y, start_weights(y, m), state_specs, None)
    ll = log_densities(fits, n)
    smooth, joint, now = forward_backward(ll, p, first)
    converged = False
    for it in range(1, max_iter + 1):
        began, before = time.time(), now
        left = joint.sum(axis=1, keepdims=True)
        p = np.where(left > 0, joint / np.maximum(left, 1e-300), p)
        if smooth.sum(axis=0).min() < 2 * (1 + state_specs[0].ar) * y.shape[1]:
            log.warn(it, "empty_state", f"state {int(smooth.sum(axis=0).argmin())} has almost no rows")
            break
        fits = m_step(y, smooth, state_specs, fits)
        ll = log_densities(fits, n)
        smooth, joint, now = forward_backward(ll, p, first)
        converged = bool(abs(now - before) < tol)
        log.iteration(it, before, now, time.time() - began, converged)
        for s, f in enumerate(fits):
            log.parameter(it, s, f.values())
            for i, g in enumerate(f.margins, 1):
                log.spread(it, s, i, np.sqrt(g.h))
            for name, value, side in dcc.boundary_events(f.correlation, threshold) if f.correlation and not f.constant else []:
                log.edge(it, s, name, value, side, "none")
            if f.reason:
                log.edge(it, s, "alpha", 0.0, "lower", f"constant correlation: {f.reason}")
        if now < before - 1e-6:
            log.warn(it, "likelihood_fell", f"by {before - now:.6g}")
        if m and all(f.constant for f in fits) and not any(w["kind"] == "all_states_constant" for w in log.warnings):
            log.warn(it, "all_states_constant", "no state has dynamic correlation")
        if converged:
            break
    if not converged:
        log.warn(len(log.iterations), "not_converged", f"after {len(log.iterations)} iterations")
    k = parameter_count(fits)
    return SwitchingFit(fits, p, smooth, viterbi(ll, p, first), now, 2 * k - 2 * now, k * math.log(n) - 2 * now, k, converged, [], log)


def difference(y: np.ndarray, d: int) -> np.ndarray:
    return np.diff(y, n=d, axis=0) if d else y


def fit_switching(y: np.ndarray, state_specs: list[StateSpec], d: int = 0, max_iter: int = 50, tol: float = 1e-4, criterion: str = "bic", threshold: float = 0.02, refit: bool = True, m_step: Callable | None = None) -> SwitchingFit:
    """The whole fit: differencing, EM, and a second one in which states at the boundary have constant correlation.

    The second fit is kept if its criterion is lower ("threshold" keeps it always). Smoothed probabilities and the
    path have a row for each row of y; those that differencing lost repeat the first.
    """
    y = np.asarray(y, float).reshape(len(y), -1)
    if len(state_specs) < 2:
        raise ValueError("a switching model needs two states or more")
    if d < 0 or len(y) <= d:
        raise ValueError("there must be more rows than differences")
    if not np.isfinite(y).all():
        raise ValueError("y has missing or infinite values")
    if criterion not in ("threshold", "aic", "bic") or not 0 < threshold < 1:
        raise ValueError("criterion is threshold, aic or bic, and the threshold between 0 and 1")
    if len({s.kind for s in state_specs}) > 1:
        raise ValueError("all states have one kind of model")
    if state_specs[0].kind == "univariate" and y.shape[1] > 1:
        raise ValueError("univariate states have one column")
    x, state_specs = difference(y, d), check_orders(state_specs)
    out = em(x, state_specs, max_iter, tol, criterion, threshold, m_step)
    edge = edge_states(out.fits, threshold) if refit and state_specs[0].kind in ("dcc", "cgarch") else []
    if edge:
        held = [dataclasses.replace(s, force_constant=s.force_constant or i in edge) for i, s in enumerate(state_specs)]
        second = em(x, held, max_iter, tol, criterion, threshold, m_step)
        each = 2.0 if criterion == "aic" else math.log(len(x))
        cost = lambda f: -2 * f.loglik + each * correlation_parameters(f.fits)
        if criterion == "threshold" or cost(second) < cost(out):
            for s in edge:
                second.log.edge(0, s, "alpha", 0.0, "lower", "refitted with constant correlation")
            out = dataclasses.replace(second, refitted=edge)
    pad = len(y) - len(out.smooth)
    if pad:
        out = dataclasses.replace(out, smooth=np.vstack([np.repeat(out.smooth[:1], pad, axis=0), out.smooth]), path=np.r_[np.repeat(out.path[:1], pad), out.path])
    return out


def log_likelihood_rows(y: np.ndarray, fit: StateFit) -> np.ndarray:
    """A fitted state's log-likelihood of each row of another y: its mean, margins and correlation as they are."""
    y = np.asarray(y, float).reshape(len(y), -1)
    spec = fit.spec
    if spec.ma:
        e = arma.innovations(y[:, 0] - fit.mean["coef"][0], fit.mean["coef"][1 : 1 + spec.ar], fit.mean["coef"][1 + spec.ar :])[0][:, None]
    else:
        e = arma.var_residuals(y, spec.ar, fit.mean["coef"])
    v = fit.volatility
    if isinstance(v, GarchFit):
        rows = v.spec.loglik(e[:, 0], v.par)
    elif isinstance(v, ica.GogarchFit):
        s = e @ v.ica.w.T
        rows = ica.log_likelihood(s, [dataclasses.replace(f, h=f.spec.variance(c, f.par)) for c, f in zip(s.T, v.fits, strict=True)], v.ica.w)
    else:
        margins = []
        for c, m in zip(e.T, v.margins, strict=True):
            g = GarchFit(m.spec, m.par, m.nll, m.spec.variance(c, m.par), m.converged)
            g.extra["z"] = g.residuals(c)
            margins.append(g)
        z = np.column_stack([g.extra["z"] for g in margins])
        if v.copula:
            z = copula.scores(copula.uniforms(z, v.transform or "parametric", margins), v.correlation.law, v.score_shape)
        rows = dataclasses.replace(v, margins=margins, z=z).rows()
    out = np.zeros(len(y))
    out[len(y) - len(rows) :] = np.where(np.isfinite(rows), rows, FLOOR)
    return out
