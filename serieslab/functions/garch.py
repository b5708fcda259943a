"""Univariate volatility: recursions, weighted likelihoods and fits."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from serieslab.functions import dist
from serieslab.functions.optim import PENALTY, hessian, minimise_box

MODELS = ("sGARCH", "gjrGARCH", "tGARCH", "eGARCH")
CHUNK = 64


def linear_recursion(u: np.ndarray, rate: float, first: np.ndarray) -> np.ndarray:
    """x[0] = first, x[t] = u[t] + rate * x[t - 1], over the rows of u; walked in chunks by a triangular product."""
    u = np.asarray(u, float)
    flat = u.reshape(len(u), -1).copy()
    flat[0] = np.ravel(first)
    k = np.arange(min(CHUNK, len(u)))
    gaps = k[:, None] - k[None, :]
    powers = np.where(gaps >= 0, float(rate) ** np.maximum(gaps, 0), 0.0)
    decay = float(rate) ** (k + 1)
    out, last = np.empty_like(flat), np.zeros(flat.shape[1])
    for a in range(0, len(u), CHUNK):
        part = flat[a : a + CHUNK]
        n = len(part)
        out[a : a + n] = powers[:n, :n] @ part + decay[:n, None] * last
        last = out[a + n - 1]
    return out.reshape(u.shape)


@dataclass
class GarchSpec:
    """The order (p ARCH terms, q GARCH terms), variance model and law of a volatility model."""

    order: tuple[int, int] = (1, 1)
    model: str = "sGARCH"
    law: str = "norm"

    def __post_init__(self) -> None:
        if self.model not in MODELS:
            raise ValueError(f"{self.model!r} is none of {MODELS}")
        if self.law not in dist.LAWS:
            raise ValueError(f"{self.law!r} is none of {tuple(dist.LAWS)}")
        if self.model != "sGARCH" and self.order != (1, 1):
            raise ValueError(f"{self.model} has order (1, 1)")

    def names(self) -> list[str]:
        p, q = self.order
        number = lambda n, k: [f"{n}{i + 1}" for i in range(k)]
        own = ["omega", *number("alpha", p), *(["gamma1"] if self.model != "sGARCH" else []), *number("beta", q)]
        return [*own, *(x[0] for x in dist.LAWS[self.law])]

    def split(self, par: np.ndarray) -> tuple[np.ndarray, dict[str, float]]:
        laws = dist.LAWS[self.law]
        cut = len(par) - len(laws)
        return np.asarray(par[:cut], float), {x[0]: float(v) for x, v in zip(laws, par[cut:], strict=True)}

    def start(self, y: np.ndarray) -> np.ndarray:
        p, q = self.order
        v = float(np.var(y)) or 1e-8
        arch, garch = [0.08 / p] * p, [0.82 / q] * q if q else []
        own = {
            "sGARCH": [v * max(1e-3, 1 - sum(arch) - sum(garch)), *arch, *garch],
            "gjrGARCH": [0.1 * v, 0.05, 0.06, 0.82],
            "tGARCH": [0.1 * math.sqrt(v), 0.08, 0.02, 0.85],
            "eGARCH": [0.1 * math.log(v), -0.02, 0.15, 0.9],
        }[self.model]
        return np.array([*own, *(x[1] for x in dist.LAWS[self.law])])

    def bounds(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, q = self.order
        v = float(np.var(y)) or 1e-8
        if self.model == "eGARCH":
            own = [(-20.0, 20.0), (-2.0, 2.0), (-2.0, 2.0), (-0.9999, 0.9999)]
        elif self.model == "sGARCH":
            own = [(1e-6 * v, 10 * v), *[(0.0, 0.9999)] * (p + q)]
        elif self.model == "gjrGARCH":
            own = [(1e-6 * v, 10 * v), (0.0, 0.9999), (-0.5, 0.9999), (0.0, 0.9999)]
        else:
            own = [(1e-6 * math.sqrt(v), 10 * math.sqrt(v)), (0.0, 0.9999), (-0.9, 0.9), (0.0, 0.9999)]
        own += [(x[2], x[3]) for x in dist.LAWS[self.law]]
        return np.array([x[0] for x in own]), np.array([x[1] for x in own])

    def persistence(self, par: np.ndarray) -> float:
        own, law = self.split(par)
        p = self.order[0]
        if self.model == "sGARCH":
            return float(own[1:].sum())
        if self.model == "gjrGARCH":
            return float(own[1] + own[2] / 2 + own[3])
        return float(abs(own[3])) if self.model == "eGARCH" else float((own[1] * math.sqrt(2 / math.pi) + own[3]) ** 2) if p else 0.0

    def variance(self, y: np.ndarray, par: np.ndarray, first: float | None = None) -> np.ndarray:
        """The variance path. The first is the unconditional one where it exists, else the sample's."""
        own, law = self.split(par)
        y, v = np.asarray(y, float), float(np.var(y)) or 1e-8
        if self.model == "eGARCH":
            omega, alpha, gamma, beta = own
            mean = dist.abs_moment("norm")
            lh = np.empty(len(y))
            lh[0] = math.log(first or v)
            for t in range(1, len(y)):
                z = y[t - 1] * math.exp(-0.5 * lh[t - 1])
                lh[t] = min(50.0, max(-50.0, omega + alpha * z + gamma * (abs(z) - mean) + beta * lh[t - 1]))
            return np.exp(lh)
        if self.model == "tGARCH":
            omega, alpha, gamma, beta = own
            drive = omega + alpha * (np.abs(y) - gamma * y)
            s = linear_recursion(np.r_[0.0, drive[:-1]], beta, np.array([math.sqrt(first or v)]))
            return np.maximum(s, 1e-12) ** 2
        p, q = self.order
        if self.model == "gjrGARCH":
            drive = own[0] + (own[1] + own[2] * (y < 0)) * y * y
            return np.maximum(linear_recursion(np.r_[0.0, drive[:-1]], own[3], np.array([first or v])), 1e-12)
        return garch_variance(y, own[0], own[1 : 1 + p], own[1 + p :], first)

    def loglik(self, y: np.ndarray, par: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        """The log-likelihood of each row."""
        h = self.variance(y, par) if h is None else h
        s = np.sqrt(h)
        return dist.log_density(self.law, y / s, **self.split(par)[1]) - np.log(s)

    def nll(self, par: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> float:
        if self.persistence(par) >= 0.9999:
            return PENALTY
        with np.errstate(all="ignore"):
            ll = self.loglik(y, par)
        total = float(ll.sum() if w is None else (w * ll).sum())
        return -total if np.isfinite(total) else PENALTY


def garch_variance(y: np.ndarray, omega: float, alpha: np.ndarray | float, beta: np.ndarray | float, first: float | None = None) -> np.ndarray:
    """GARCH(p, q): omega + sum alpha_i y^2[t-i] + sum beta_j h[t-j]; rows before the first have its variance."""
    alpha, beta = np.atleast_1d(np.asarray(alpha, float)), np.atleast_1d(np.asarray(beta, float))
    y = np.asarray(y, float)
    rest = 1 - alpha.sum() - beta.sum()
    h0 = first if first is not None else omega / rest if rest > 1e-8 else float(np.var(y))
    drive = np.full(len(y), float(omega))
    for i, a in enumerate(alpha, 1):
        drive[i:] += a * y[:-i] ** 2
        drive[:i] += a * h0
    if len(beta) <= 1:
        return linear_recursion(drive, beta[0] if len(beta) else 0.0, np.array([h0]))
    h = np.full(len(y), h0)
    for t in range(1, len(y)):
        h[t] = drive[t] + sum(b * (h[t - j] if t >= j else h0) for j, b in enumerate(beta, 1))
    return h


@dataclass
class GarchFit:
    spec: GarchSpec
    par: np.ndarray
    nll: float
    h: np.ndarray
    converged: bool
    extra: dict = field(default_factory=dict)

    @property
    def values(self) -> dict[str, float]:
        return dict(zip(self.spec.names(), map(float, self.par), strict=True))

    @property
    def persistence(self) -> float:
        return self.spec.persistence(self.par)

    def residuals(self, y: np.ndarray) -> np.ndarray:
        return np.asarray(y, float) / np.sqrt(self.h)


def fit_garch(y: np.ndarray, w: np.ndarray | None = None, spec: GarchSpec | None = None, start: np.ndarray | None = None, iterations: int = 200) -> GarchFit:
    """The weighted maximum-likelihood fit; y has mean 0. A constant series has its tiny variance and no dynamics."""
    spec, y = spec or GarchSpec(), np.asarray(y, float)
    lower, upper = spec.bounds(y)
    x0 = np.clip(spec.start(y) if start is None else np.asarray(start, float), lower, upper)
    if not np.var(y):
        return GarchFit(spec, x0, float("nan"), np.full(len(y), 1e-8), False)
    # Parameters in units that a minimiser likes: omega relative to the variance
    unit = np.ones(len(x0))
    if spec.model != "eGARCH":
        unit[0] = float(np.var(y)) if spec.model != "tGARCH" else float(np.std(y))
    found = minimise_box(lambda p: spec.nll(p * unit, y, w), x0 / unit, lower / unit, upper / unit, iterations=iterations)
    par = found["x"] * unit
    return GarchFit(spec, par, found["value"], spec.variance(y, par), found["converged"])


def garch_errors(y: np.ndarray, fit: GarchFit, w: np.ndarray | None = None, method: str = "hessian") -> np.ndarray:
    """Standard errors of the fit's parameters, by the Hessian or the sandwich; NaN where undefined."""
    unit = np.maximum(np.abs(fit.par), 1e-4)
    f = lambda p: fit.spec.nll(p * unit, y, w)
    x = fit.par / unit
    try:
        inv = np.linalg.inv(hessian(f, x))
    except np.linalg.LinAlgError:
        return np.full(len(x), np.nan)
    if method == "sandwich":
        eps = 1e-5
        g = np.column_stack([(fit.spec.loglik(y, (x + e) * unit) - fit.spec.loglik(y, (x - e) * unit)) / (2 * eps) for e in np.eye(len(x)) * eps])
        g = g if w is None else g * np.asarray(w)[:, None]
        inv = inv @ (g.T @ g) @ inv
    d = np.diag(inv)
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.where(d > 0, d, np.nan)) * unit


def standardised(y: np.ndarray, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Each column over the root of its GARCH(1,1) variance."""
    y = np.asarray(y, float).reshape(len(y), -1)
    return np.column_stack([c / np.sqrt(garch_variance(c, o, a, b)) for c, o, a, b in zip(y.T, np.atleast_1d(omega), np.atleast_1d(alpha), np.atleast_1d(beta), strict=True)])


def simulate_garch(n: int, omega: float, alpha: float, beta: float, seed: int, burn: int = 200, law: str = "norm", skew: float | None = None, shape: float | None = None) -> np.ndarray:
    rng = np.random.default_rng(seed)
    e, h, out = dist.draw(law, rng, n + burn, skew, shape), omega / (1 - alpha - beta), np.empty(n + burn)
    for t in range(n + burn):
        out[t] = math.sqrt(h) * e[t]
        h = omega + alpha * out[t] ** 2 + beta * h
    return out[burn:]
