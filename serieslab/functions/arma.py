"""Conditional means: ARMA by a Kalman filter and vector autoregressions by weighted least squares."""

from __future__ import annotations

import math

import numpy as np

from serieslab.functions.optim import PENALTY, minimise_box


def state_space(phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(T, R R', stationary covariance) of an ARMA in Harvey's form, for innovations of variance 1."""
    r = max(len(phi), len(theta) + 1)
    t = np.zeros((r, r))
    t[: len(phi), 0] = phi
    t[: r - 1, 1:] = np.eye(r - 1)
    load = np.zeros(r)
    load[0], load[1 : 1 + len(theta)] = 1.0, theta
    rr = np.outer(load, load)
    p = np.linalg.solve(np.eye(r * r) - np.kron(t, t), rr.ravel()).reshape(r, r)
    return t, rr, (p + p.T) / 2


def innovations(y: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors and their variances (in units of the innovations'), exact from the first row on."""
    t, rr, p = state_space(np.atleast_1d(phi), np.atleast_1d(theta))
    a = np.zeros(len(t))
    v, f, settled = np.empty(len(y)), np.empty(len(y)), False
    gain = np.zeros(len(t))
    for i, x in enumerate(y):
        if not settled:
            f[i] = p[0, 0]
            gain = t @ p[:, 0] / f[i]
            new = t @ p @ t.T + rr - np.outer(gain, gain) * f[i]
            settled = bool(np.abs(new - p).max() < 1e-12)
            p = new
        else:
            f[i] = f[i - 1]
        v[i] = x - a[0]
        a = t @ a + gain * v[i]
    return v, f


def stationary(phi: np.ndarray) -> bool:
    """Whether the autoregression's roots lie outside the unit circle."""
    phi = np.atleast_1d(phi)
    if not len(phi) or not phi.any():
        return True
    companion = np.zeros((len(phi),) * 2)
    companion[0] = phi
    companion[1:, :-1] = np.eye(len(phi) - 1)
    return bool(np.abs(np.linalg.eigvals(companion)).max() < 0.9999)


def fit_arma(y: np.ndarray, order: tuple[int, int], w: np.ndarray | None = None, start: np.ndarray | None = None) -> dict:
    """Weighted maximum likelihood of ARMA(p, q) without a mean, the innovations' variance concentrated out."""
    p, q = order
    y, w = np.asarray(y, float).ravel(), np.ones(len(y)) if w is None else np.asarray(w, float)

    def nll(par: np.ndarray) -> float:
        if not stationary(par[:p]) or not stationary(-par[p:]):
            return PENALTY
        try:
            v, f = innovations(y, par[:p], par[p:])
        except np.linalg.LinAlgError:
            return PENALTY
        s2 = float((w * v * v / f).sum() / w.sum())
        return 0.5 * float((w * (np.log(2 * math.pi * s2 * f) + v * v / (s2 * f))).sum()) / w.sum()

    x0 = np.zeros(p + q) if start is None else np.asarray(start, float)
    found = minimise_box(nll, x0, np.full(p + q, -1.99), np.full(p + q, 1.99), iterations=60) if p + q else {"x": x0, "converged": True}
    v, f = innovations(y, found["x"][:p], found["x"][p:]) if p + q else (y, np.ones(len(y)))
    return {"coef": found["x"], "phi": found["x"][:p], "theta": found["x"][p:], "residuals": v, "variance": float((w * v * v / f).sum() / w.sum()), "converged": found["converged"]}


def lag_matrix(y: np.ndarray, p: int) -> np.ndarray:
    """A column of ones and p lags of every column, for rows p and later."""
    return np.column_stack([np.ones(len(y) - p), *(y[p - i : len(y) - i] for i in range(1, p + 1))])


def fit_var(y: np.ndarray, p: int, w: np.ndarray | None = None) -> dict:
    """Weighted least squares of VAR(p) with an intercept; residuals are those of rows p and later."""
    y = np.asarray(y, float).reshape(len(y), -1)
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    x, target, weight = lag_matrix(y, p), y[p:], w[p:]
    xw = x * weight[:, None]
    coef = np.linalg.lstsq(xw.T @ x + 1e-10 * np.eye(x.shape[1]), xw.T @ target, rcond=None)[0]
    return {"coef": coef, "residuals": target - x @ coef}


def var_residuals(y: np.ndarray, p: int, coef: np.ndarray) -> np.ndarray:
    y = np.asarray(y, float).reshape(len(y), -1)
    return y[p:] - lag_matrix(y, p) @ coef
