"""Copulas over dynamic correlation: margins to uniforms, uniforms to scores, and the two-stage fit."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from serieslab.functions import dcc, dist
from serieslab.functions.garch import GarchFit, GarchSpec, fit_garch

TRANSFORMS = ("parametric", "empirical", "spd")
CLIP = 1e-10


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1; ties share the mean of theirs."""
    values, where, counts = np.unique(x, return_inverse=True, return_counts=True)
    upto = np.cumsum(counts)
    return (upto - (counts - 1) / 2)[where]


def bandwidth(x: np.ndarray) -> float:
    """The rule of thumb for a normal kernel: 0.9 n^(-1/5) times the smaller of the sd and the quartile range / 1.34."""
    s, (a, b) = x.std(ddof=1) if len(x) > 1 else 0.0, np.quantile(x, (0.25, 0.75))
    spread = min(v for v in (s, (b - a) / 1.34, s or 1.0) if v > 0) if s > 0 else 1.0
    return 0.9 * spread * len(x) ** -0.2


def kernel_cdf(x: np.ndarray, points: int = 512) -> np.ndarray:
    """The distribution function of a normal kernel density at each x, summed over a grid of points."""
    h = bandwidth(x)
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, points)
    cells, _ = np.histogram(x, bins=points, range=(grid[0], grid[-1]))
    step = grid[1] - grid[0]
    reach = max(1, min(points, int(4 * h / step) + 1))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) * step / h) ** 2)
    density = np.convolve(cells, kernel, mode="full")[reach : reach + points]
    return np.interp(x, grid, np.cumsum(density) / density.sum())


def semi_parametric(x: np.ndarray, low: float = 0.1, high: float = 0.9) -> np.ndarray:
    """Uniforms: ranks in the tails beyond the low and high quantiles, a kernel distribution between them."""
    x = np.asarray(x, float)
    a, b = np.quantile(x, (low, high))
    u, below, above = np.empty(len(x)), x < a, x > b
    middle = ~(below | above)
    if below.any():
        u[below] = low * average_ranks(x[below]) / (below.sum() + 1)
    if above.any():
        u[above] = high + (1 - high) * average_ranks(x[above]) / (above.sum() + 1)
    if middle.any():
        u[middle] = low + (high - low) * (kernel_cdf(x[middle]) if middle.sum() > 1 else np.array([0.5]))
    return np.clip(u, CLIP, 1 - CLIP)


def uniforms(z: np.ndarray, transform: str = "parametric", margins: list[GarchFit] | None = None) -> np.ndarray:
    """Standardised residuals through their distribution: the margin's law (normal without one), ranks, or both."""
    if transform not in TRANSFORMS:
        raise ValueError(f"{transform!r} is none of {TRANSFORMS}")
    z = np.asarray(z, float).reshape(len(z), -1)
    out = np.empty_like(z)
    for i, x in enumerate(z.T):
        if transform == "parametric":
            spec = margins[i].spec if margins else GarchSpec()
            out[:, i] = dist.cdf(spec.law, x, **(spec.split(margins[i].par)[1] if margins else {}))
        elif transform == "empirical":
            counts = np.searchsorted(np.sort(x), x, "right")
            out[:, i] = counts / (len(x) + 1)
        else:
            out[:, i] = semi_parametric(x)
    return np.clip(out, CLIP, 1 - CLIP)


def scores(u: np.ndarray, law: str = "mvn", shape: float | None = None) -> np.ndarray:
    """Uniforms through the normal's quantile, or the t's over its own standard deviation; 0 where that is not finite."""
    z = dist.normal_quantile(u) if law == "mvn" else dist.t_quantile(u, shape) / math.sqrt(shape / (shape - 2))
    return np.where(np.isfinite(z), z, 0.0)


def normal_scores(z: np.ndarray) -> np.ndarray:
    """Average ranks / (n + 1) through the normal's quantile."""
    return dist.normal_quantile(np.column_stack([average_ranks(c) for c in np.asarray(z, float).T]) / (len(z) + 1))


def residual_scores(y: np.ndarray, omega: np.ndarray, arch: np.ndarray, garch: np.ndarray, transform: str = "parametric", law: str = "mvn", shape: float = 8.0) -> np.ndarray:
    """The copula's scores of series with given GARCH(1,1) margins."""
    from serieslab.functions.garch import standardised

    return scores(uniforms(standardised(y, omega, arch, garch), transform), law, shape)


@dataclass
class TwoStage:
    """Margins, their residuals z (a copula's: scores) and the correlation over them."""

    margins: list[GarchFit]
    z: np.ndarray
    correlation: dcc.DccFit
    copula: bool
    reason: str
    transform: str | None = None
    score_shape: float = 8.0

    def rows(self) -> np.ndarray:
        """The whole log-likelihood of each row."""
        c, par = self.correlation, self.correlation.par
        shape = par.get("shape")
        if c.dynamic:
            order = dcc.order_of(par)
            a = [par.get("alpha", par.get(f"alpha_{i + 1}")) for i in range(order[0])]
            b = [par.get("beta", par.get(f"beta_{i + 1}")) for i in range(order[1])]
            _, r = dcc.path(self.z, a, b, c.qbar, par.get("gamma", 0.0))
        else:
            r = np.broadcast_to(c.qbar, (len(self.z), *c.qbar.shape))
        return whole_rows(self.margins, self.z, r, shape, self.copula)

    def correlations(self) -> np.ndarray:
        par, c = self.correlation.par, self.correlation
        if not c.dynamic:
            return np.broadcast_to(c.qbar, (len(self.z), *c.qbar.shape))
        return dcc.path(self.z, par["alpha"], par["beta"], c.qbar, par.get("gamma", 0.0))[1] if "alpha" in par else dcc.path(self.z, [v for k, v in par.items() if k.startswith("alpha")], [v for k, v in par.items() if k.startswith("beta")], c.qbar)[1]


def whole_rows(margins: list[GarchFit], z: np.ndarray, r: np.ndarray, shape: float | None, copula: bool) -> np.ndarray:
    """Margins and correlation together. A copula's margins keep their own laws; without one the multivariate law is that of the residuals."""
    log_scale = sum(0.5 * np.log(m.h) for m in margins)
    if copula:
        laws = sum(dist.log_density(m.spec.law, m.extra["z"], **m.spec.split(m.par)[1]) for m in margins)
        return laws - log_scale + dcc.log_likelihood(z, r, shape, copula=True)
    ll = dcc.log_likelihood(z, r, shape)
    return ll + (dist.log_density("norm", z).sum(axis=1) if shape is None else 0.0) - log_scale


def fit_two_stage(y: np.ndarray, w: np.ndarray | None = None, law: str = "mvn", asymmetric: bool = False, copula: bool = False, transform: str = "parametric", margin: GarchSpec | None = None, order: tuple[int, int] = (1, 1), criterion: str | None = None, threshold: float = 0.02, force_constant: bool = False, copula_shape: float = 8.0, start: list[GarchFit] | None = None) -> TwoStage:
    """Weighted GARCH margins, then the correlation (or the copula) over their residuals.

    With a criterion ("threshold", "aic" or "bic") constant correlation may be chosen instead; see dcc.select.
    """
    y = np.asarray(y, float)
    margin = margin or GarchSpec()
    margins = []
    for i, c in enumerate(y.T):
        m = fit_garch(c, w, margin, None if start is None else start[i].par)
        m.extra["z"] = m.residuals(c)
        margins.append(m)
    z = np.column_stack([m.extra["z"] for m in margins])
    if copula:
        z = scores(uniforms(z, transform, margins), law, copula_shape)
    if force_constant or criterion:
        found, reason = dcc.select(z, w, law, asymmetric, copula, criterion or "bic", threshold, force_constant)
    else:
        found, reason = (dcc.fit(z, w, law, asymmetric, copula) if order == (1, 1) else dcc.fit_order(z, order, w, law)), ""
    return TwoStage(margins, z, found, copula, reason, transform if copula else None, copula_shape)


def simulate(n: int, k: int = 2, alpha: float = 0.04, beta: float = 0.93, gamma: float = 0.0, law: str = "mvn", shape: float = 8.0, qbar: np.ndarray | None = None, omega: np.ndarray | None = None, arch: np.ndarray | None = None, garch: np.ndarray | None = None, seed: int = 1, burn: int = 200) -> np.ndarray:
    """Series with normal GARCH(1,1) margins and a normal or t copula with DCC or asymmetric dynamics."""
    qbar = np.full((k, k), 0.4) + 0.6 * np.eye(k) if qbar is None else qbar
    z = dcc.simulate_residuals(n + burn, k, alpha, beta, qbar, seed, law, shape, gamma)
    if law == "mvt":  # t margins become normal ones; the dependence stays
        z = dist.normal_quantile(np.clip(dist.cdf("std", z, None, shape), CLIP, 1 - CLIP))
    fill = lambda x, v: np.full(k, v) if x is None else np.resize(np.asarray(x, float), k)
    omega, arch, garch = fill(omega, 0.05), fill(arch, 0.08), fill(garch, 0.9)
    y, h = np.empty_like(z), omega / (1 - arch - garch)
    for t in range(len(z)):
        y[t] = np.sqrt(h) * z[t]
        h = omega + arch * y[t] ** 2 + garch * h
    return y[burn:]
