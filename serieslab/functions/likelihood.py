"""The log-likelihood of a fitted correlation model at given parameters: total, by part, or by row."""

from __future__ import annotations

import dataclasses
import math

import numpy as np

from serieslab.functions import copula, dcc, ica


def at(fit: copula.TwoStage | ica.GogarchFit, par: dict[str, float] | None = None, by_row: bool = False, parts: bool = False) -> float | dict | np.ndarray:
    """Total log-likelihood with par in place of the fit's own values; its parts, or one value a row.

    A correlation's parameters are named as in the fit (alpha, beta, gamma, shape, or numbered); an orthogonal model's
    name_i for component i or name for all. Unknown names are an error.
    """
    margin, link = (_gogarch(fit, par or {}) if isinstance(fit, ica.GogarchFit) else _correlation(fit, par or {}))
    rows = margin + link
    if by_row:
        return rows
    if parts:
        return {"margins": float(margin.sum()), "correlation": float(link.sum()), "total": float(rows.sum())}
    return float(rows.sum())


def _correlation(fit: copula.TwoStage, par: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Margins and correlation, dynamic or constant, DCC or copula."""
    c = fit.correlation
    values, unknown = dcc.update(c.par, par)
    if unknown:
        raise ValueError(f"no such parameters: {unknown}")
    sound, why = dcc.stationarity(values) if c.dynamic else (True, "")
    if not sound:
        raise ValueError(why)
    rows = dataclasses.replace(fit, correlation=dataclasses.replace(c, par=values)).rows()
    margin = margin_rows(fit)
    return margin, rows - margin


def margin_rows(fit: copula.TwoStage) -> np.ndarray:
    """The sum over the margins of each row's log-likelihood."""
    if fit.copula:
        return sum(m.spec.loglik(m.extra["z"] * np.sqrt(m.h), m.par, m.h) for m in fit.margins)
    z = np.column_stack([m.extra["z"] for m in fit.margins])
    return -0.5 * (z * z + math.log(2 * math.pi)).sum(axis=1) - sum(0.5 * np.log(m.h) for m in fit.margins)


def _gogarch(fit: ica.GogarchFit, par: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    known = {f"{n}_{i}" for i, f in enumerate(fit.fits, 1) for n in f.spec.names()} | {n for f in fit.fits for n in f.spec.names()}
    if set(par) - known:
        raise ValueError(f"no such parameters: {sorted(set(par) - known)}")
    vectors = ica.parse_parameters(par, fit)
    rows = sum(f.spec.loglik(c, v) for c, f, v in zip(fit.ica.s.T, fit.fits, vectors, strict=True))
    square = fit.ica.w.shape[0] == fit.ica.w.shape[1]
    jacobian = np.linalg.slogdet(fit.ica.w)[1] if square else 0.5 * np.linalg.slogdet(fit.ica.w @ fit.ica.w.T)[1]
    return rows, np.full(len(rows), jacobian)
