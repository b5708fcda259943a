"""Portfolio statistics that users bootstrap: weights from a matrix of returns, and metrics of weights."""

from __future__ import annotations

import math

import numpy as np


def shrunk_covariance(returns: np.ndarray, intensity: float | None = None) -> np.ndarray:
    """The sample covariance drawn towards a multiple of the identity; the intensity is Ledoit and Wolf's if none is given."""
    x = returns - returns.mean(axis=0)
    n, k = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / k
    target = mu * np.eye(k)
    if intensity is None:
        d2 = ((s - target) ** 2).sum() / k
        b2 = sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / (n * n * k)
        intensity = min(b2, d2) / d2 if d2 > 0 else 1.0
    return intensity * target + (1 - intensity) * s


def _solve(cov: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(cov + 1e-12 * np.eye(len(cov)), b)


def long_only(cov: np.ndarray, mean: np.ndarray | None = None, aversion: float = 1.0, iterations: int = 500) -> np.ndarray:
    """Weights >= 0 of sum 1 that minimise aversion/2 w'Cw - mean'w, by projected gradients."""
    k = len(cov)
    w, mean = np.ones(k) / k, np.zeros(k) if mean is None else mean
    step = 1 / max(1e-12, aversion * np.linalg.eigvalsh(cov)[-1])
    for _ in range(iterations):
        v = w - step * (aversion * cov @ w - mean)
        u = np.sort(v)[::-1]
        c = (np.cumsum(u) - 1) / np.arange(1, k + 1)
        new = np.maximum(v - c[np.flatnonzero(u > c)[-1]], 0)
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w


def equal_weight(returns: np.ndarray) -> np.ndarray:
    return np.ones(returns.shape[1]) / returns.shape[1]


def min_variance(returns: np.ndarray, short: bool = True) -> np.ndarray:
    """The closed form where shorting is allowed."""
    cov = np.cov(returns.T).reshape(returns.shape[1], returns.shape[1])
    if not short:
        return long_only(cov)
    w = _solve(cov, np.ones(len(cov)))
    return w / w.sum()


def shrinkage_min_variance(returns: np.ndarray, short: bool = True) -> np.ndarray:
    cov = shrunk_covariance(returns)
    if not short:
        return long_only(cov)
    w = _solve(cov, np.ones(len(cov)))
    return w / w.sum()


def max_sharpe(returns: np.ndarray, risk_free: float = 0.0, short: bool = False) -> np.ndarray:
    """The tangency portfolio; long only, the best of the frontier over risk aversions. Equal weights if nothing earns the risk-free rate."""
    cov, excess = np.cov(returns.T).reshape(returns.shape[1], returns.shape[1]), returns.mean(axis=0) - risk_free
    if (excess <= 0).all():
        return equal_weight(returns)
    if short:
        w = _solve(cov, excess)
        if abs(w.sum()) > 1e-12:
            return w / w.sum()
    ratio = lambda w: (w @ excess) / math.sqrt(max(w @ cov @ w, 1e-300))
    return max((long_only(cov, excess, a) for a in np.geomspace(0.1, 1000, 25)), key=ratio)


def risk_parity(returns: np.ndarray, iterations: int = 200) -> np.ndarray:
    """Weights to which every asset contributes the same share of the variance."""
    cov = np.cov(returns.T).reshape(returns.shape[1], returns.shape[1])
    w = np.ones(len(cov)) / len(cov)
    for _ in range(iterations):
        w = w * np.sqrt(1 / len(cov) / np.maximum(w * (cov @ w) / (w @ cov @ w), 1e-12))
        w /= w.sum()
    return w


def black_litterman(returns: np.ndarray, market: np.ndarray | None = None, views: np.ndarray | None = None, picks: np.ndarray | None = None, tau: float = 0.05, aversion: float = 2.5) -> np.ndarray:
    """Equilibrium returns of the market's weights, blended with views (picks w = views), as long-only weights.

    Without views the sample means are the views.
    """
    cov = np.cov(returns.T).reshape(returns.shape[1], returns.shape[1])
    k = len(cov)
    market = np.ones(k) / k if market is None else market
    picks, views = (np.eye(k), returns.mean(axis=0)) if picks is None else (picks, views)
    prior = aversion * cov @ market
    doubt = np.diag(np.maximum(np.diag(tau * picks @ cov @ picks.T), 1e-12))
    gain = tau * cov @ picks.T @ np.linalg.inv(picks @ (tau * cov) @ picks.T + doubt)
    return long_only(cov, prior + gain @ (views - picks @ prior), aversion)


def sharpe(returns: np.ndarray, periods: int = 252) -> float:
    """Annualised mean over standard deviation; 0 for a constant."""
    r = np.asarray(returns, float)
    s = r.std(ddof=1) if len(r) > 1 else 0.0
    return float(r.mean() / s * math.sqrt(periods)) if s > 0 else 0.0


def metrics(returns: np.ndarray, weights: np.ndarray, periods: int = 252) -> dict[str, float]:
    """Annual return and volatility, Sharpe ratio, worst drawdown of the compounded path, and 5 % value at risk."""
    r = np.asarray(returns, float) @ np.asarray(weights, float)
    path = np.cumprod(1 + r)
    return {"return": float(r.mean() * periods), "volatility": float(r.std(ddof=1) * math.sqrt(periods)), "sharpe": sharpe(r, periods), "drawdown": float((path / np.maximum.accumulate(path) - 1).min()), "var95": float(np.quantile(r, 0.05))}


def several(x: np.ndarray) -> dict[str, np.ndarray | float]:
    """A statistic with many outputs: means, volatilities and the mean correlation."""
    x = np.asarray(x, float).reshape(len(x), -1)
    out: dict[str, np.ndarray | float] = {"mean": x.mean(axis=0), "sd": x.std(axis=0, ddof=1)}
    if x.shape[1] > 1:
        c = np.corrcoef(x.T)
        out["correlation"] = float(c[np.triu_indices(len(c), 1)].mean())
    return out


#: Statistics of a matrix of returns by name.
STATISTICS = {"min_variance": min_variance, "max_sharpe": max_sharpe, "risk_parity": risk_parity, "black_litterman": black_litterman, "shrinkage": shrinkage_min_variance, "equal_weight": equal_weight}
