"""Dynamic correlation: DCC(p, q), its asymmetric form and copulas over it.

Q_t = (1 - sum a - sum b) Qbar - g Nbar + sum a_i zz'[t-i] + g nn'[t-1] + sum b_j Q[t-j], R_t = Q_t with unit diagonal; the
first rows have Q = Qbar. Of order (1, 1) every path, its first and its second derivatives are linear recursions in
b, so they are walked in chunks for all elements at once. Weights are per row; likelihoods leave out what no
correlation parameter changes (the margins) unless they say otherwise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from serieslab.functions import dist
from serieslab.functions.garch import linear_recursion
from serieslab.functions.optim import PENALTY, gradient, hessian, minimise_box, profile

DELTA = 0.5  # what the asymmetric term adds to the persistence
LAWS = ("mvn", "mvt")


# --- parameters and orders
def check_order(order: tuple[int, int] | None) -> tuple[int, int]:
    """(p, q): (1, 1) if none is given, (0, 0) for constant correlation."""
    if order is None:
        return 1, 1
    if len(order) != 2 or any(int(x) != x or x < 0 for x in order):
        raise ValueError(f"a DCC order is two whole numbers, not {order!r}")
    if order != (0, 0) and min(order) == 0:
        raise ValueError("a DCC order has both terms or neither")
    return int(order[0]), int(order[1])


def order_of(par: dict[str, float]) -> tuple[int, int]:
    """(p, q) from the names alpha_i and beta_j (or alpha and beta)."""
    count = lambda n: sum(k == n or k.startswith(f"{n}_") and k[len(n) + 1 :].isdigit() for k in par)
    return count("alpha"), count("beta")


def is_11(par: dict[str, float]) -> bool:
    return order_of(par) == (1, 1)


def persistence(par: dict[str, float]) -> dict:
    """alphas and betas in the order of their numbers, their sums and the persistence."""
    pick = lambda n: [par[k] for k in sorted((k for k in par if k == n or k.startswith(f"{n}_")), key=lambda k: int(k.rpartition("_")[2]) if "_" in k else 0)]
    a, b = pick("alpha"), pick("beta")
    return {"alphas": a, "betas": b, "alpha_sum": float(sum(a)), "beta_sum": float(sum(b)), "persistence": float(sum(a) + sum(b)), "order": (len(a), len(b))}


def stationarity(par: dict[str, float]) -> tuple[bool, str]:
    """Whether the terms are non-negative and sum to less than 1, and what is wrong if not."""
    p = persistence(par)
    if any(x < 0 for x in (*p["alphas"], *p["betas"])):
        return False, "a term is negative"
    g = par.get("gamma", 0.0)
    if g < 0:
        return False, "gamma is negative"
    total = p["persistence"] + DELTA * g
    return (False, f"persistence {total:.4f} is not below 1") if total >= 1 else (True, "")


def adcc_persistence(alpha: float, gamma: float, beta: float, delta: float = DELTA) -> float:
    return alpha + beta + delta * gamma


def to_ratio(alpha: float, beta: float) -> tuple[float, float]:
    """(persistence, alpha's share of it)."""
    s = alpha + beta
    return s, alpha / s if s > 0 else 0.5


def from_ratio(total: float, ratio: float) -> tuple[float, float]:
    return total * ratio, total * (1 - ratio)


def to_free(alpha: float, beta: float) -> tuple[float, float]:
    """(logit of the persistence, log alpha / beta): any two numbers are a stationary pair."""
    a, b = max(alpha, 1e-12), max(beta, 1e-12)
    s = min(a + b, 1 - 1e-12)
    return math.log(s / (1 - s)), math.log(a / b)


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def from_free(psi: float, phi: float) -> tuple[float, float]:
    s, r = _logistic(psi), _logistic(phi)
    return s * r, s * (1 - r)


def free_jacobian(psi: float, phi: float) -> np.ndarray:
    """d(alpha, beta) / d(psi, phi)."""
    s, r = _logistic(psi), _logistic(phi)
    ds, dr = s * (1 - s), r * (1 - r)
    return np.array([[ds * r, s * dr], [ds * (1 - r), -s * dr]])


def parameter_names(par: dict[str, list[float] | float]) -> dict[str, float]:
    """Lists flattened to numbered names: {"alpha": [a, b]} is {"alpha_1": a, "alpha_2": b}."""
    out: dict[str, float] = {}
    for k, v in par.items():
        out |= {f"{k}_{i}": float(x) for i, x in enumerate(v, 1)} if isinstance(v, (list, tuple, np.ndarray)) else {k: float(v)}
    return out


def update(par: dict[str, float], new: dict[str, float]) -> tuple[dict[str, float], list[str]]:
    """par with the values of new that it knows, and the names that it does not."""
    return par | {k: v for k, v in new.items() if k in par}, sorted(set(new) - set(par))


# --- matrices
def safe_correlation(r: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """The correlation matrix next to r whose eigenvalues are at least `floor`."""
    r = (r + r.T) / 2
    val, vec = np.linalg.eigh(r)
    if val.min() < floor:
        r = (vec * np.maximum(val, floor)) @ vec.T
    d = 1 / np.sqrt(np.diag(r))
    return r * np.outer(d, d)


def weighted_correlation(z: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The weighted maximum-likelihood covariance as a correlation that can be inverted."""
    w = np.ones(len(z)) if w is None else np.asarray(w, float)
    w = w / w.sum()
    d = z - w @ z
    c = (d * w[:, None]).T @ d
    s = np.sqrt(np.maximum(np.diag(c), 1e-12))
    return safe_correlation(c / np.outer(s, s), 1e-6)


def negative_part(z: np.ndarray) -> np.ndarray:
    return np.minimum(z, 0)


def negative_moment(z: np.ndarray) -> np.ndarray:
    n = negative_part(z)
    return n.T @ n / len(z)


def effective_rows(w: np.ndarray) -> float:
    return float(w.sum() ** 2 / (w * w).sum())


# --- paths
def _outer(z: np.ndarray) -> np.ndarray:
    return z[:, :, None] * z[:, None, :]


def _unit(q: np.ndarray) -> np.ndarray:
    d = 1 / np.sqrt(np.maximum(np.einsum("tii->ti", q), 1e-12))
    return q * d[:, :, None] * d[:, None, :]


def path(z: np.ndarray, alphas: np.ndarray | float, betas: np.ndarray | float, qbar: np.ndarray, gamma: float = 0.0, nbar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Q and R for every row."""
    a, b = np.atleast_1d(np.asarray(alphas, float)), np.atleast_1d(np.asarray(betas, float))
    n, k = z.shape
    zz = _outer(z)
    base = (1 - a.sum() - b.sum()) * qbar
    if gamma:
        base = base - gamma * (negative_moment(z) if nbar is None else nbar)
    first = max(len(a), len(b), 1)
    u = np.broadcast_to(base, (n, k, k)).copy()
    for i, x in enumerate(a, 1):
        u[i:] += x * zz[:-i]
    if gamma:
        u[1:] += gamma * _outer(negative_part(z))[:-1]
    if first == 1 and len(b) <= 1:
        q = linear_recursion(u, b[0] if len(b) else 0.0, qbar)
    else:
        q = u
        q[:first] = qbar
        for t in range(first, n):
            for j, x in enumerate(b, 1):
                q[t] += x * q[t - j]
    return q, _unit(q)


@dataclass
class Derivatives:
    """A path with its inverse and derivatives by parameter: dq and dr per name, in the order alpha, beta(, gamma)."""

    q: np.ndarray
    r: np.ndarray
    inv: np.ndarray
    logdet: np.ndarray
    dq: list[np.ndarray]
    dr: list[np.ndarray]


def _d_unit(q: np.ndarray, r: np.ndarray, dq: np.ndarray) -> np.ndarray:
    """The derivative of R where Q's is dq."""
    diag = np.einsum("tii->ti", q)
    s = 1 / np.sqrt(diag)
    rate = np.einsum("tii->ti", dq) / diag
    return dq * s[:, :, None] * s[:, None, :] - 0.5 * r * (rate[:, :, None] + rate[:, None, :])


def _d2_unit(q: np.ndarray, r: np.ndarray, d1: np.ndarray, d2: np.ndarray, dr2: np.ndarray, d12: np.ndarray) -> np.ndarray:
    """The second derivative of R, from Q's first (d1, d2) and second (d12) derivatives and R's first (dr2)."""
    diag = np.einsum("tii->ti", q)
    s = 1 / np.sqrt(diag)
    ss = s[:, :, None] * s[:, None, :]
    a1, a2, a12 = (np.einsum("tii->ti", x) / diag for x in (d1, d2, d12))
    sums = lambda x: x[:, :, None] + x[:, None, :]
    return ss * d12 - 0.5 * ss * sums(a2) * d1 - 0.5 * dr2 * sums(a1) - 0.5 * r * sums(a12 - a1 * a2)


def derivatives(z: np.ndarray, alpha: float, beta: float, qbar: np.ndarray, gamma: float | None = None, nbar: np.ndarray | None = None) -> Derivatives:
    nbar = (negative_moment(z) if nbar is None else nbar) if gamma is not None else None
    q, r = path(z, alpha, beta, qbar, gamma or 0.0, nbar)
    zz = _outer(z)
    zero = np.zeros_like(qbar)
    lagged = lambda x, minus: np.concatenate([zero[None], x[:-1] - minus])
    drivers = [lagged(zz, qbar), lagged(q, qbar)]
    if gamma is not None:
        drivers.append(lagged(_outer(negative_part(z)), nbar))
    dq = [linear_recursion(d, beta, zero) for d in drivers]
    inv = np.linalg.inv(r)
    return Derivatives(q, r, inv, np.linalg.slogdet(r)[1], dq, [_d_unit(q, r, d) for d in dq])


# --- likelihoods
def log_likelihood(z: np.ndarray, r: np.ndarray, shape: float | None = None, copula: bool = False) -> np.ndarray:
    """Per row: normal correlation part -1/2 (log|R| + z'R^-1 z - z'z), or Student t; as a copula the t margins are taken off."""
    k = z.shape[1]
    _, logdet = np.linalg.slogdet(r)
    quad = np.einsum("ti,ti->t", z, np.linalg.solve(r, z[:, :, None])[:, :, 0])
    if shape is None:
        return -0.5 * (logdet + quad - (z * z).sum(axis=1))
    c = math.lgamma((shape + k) / 2) - math.lgamma(shape / 2) - k / 2 * math.log(math.pi * (shape - 2))
    ll = c - 0.5 * logdet - (shape + k) / 2 * np.log1p(quad / (shape - 2))
    return ll - dist.log_density("std", z, None, shape).sum(axis=1) if copula else ll


def nll_rows(par: np.ndarray, z: np.ndarray, qbar: np.ndarray, law: str = "mvn", asymmetric: bool = False, nbar: np.ndarray | None = None, copula: bool = False) -> np.ndarray | None:
    """Negative log-likelihoods per row at (alpha, beta[, gamma][, shape]); None outside the domain."""
    alpha, beta = par[0], par[1]
    gamma = par[2] if asymmetric else 0.0
    shape = par[-1] if law == "mvt" else None
    if min(alpha, beta, gamma) < 0 or adcc_persistence(alpha, gamma, beta) >= 0.99999 or shape is not None and shape <= 2.01:
        return None
    _, r = path(z, alpha, beta, qbar, gamma, nbar)
    sign, _ = np.linalg.slogdet(r)
    if (sign <= 0).any():
        return None
    return -log_likelihood(z, r, shape, copula)


def nll(par: np.ndarray, z: np.ndarray, qbar: np.ndarray, w: np.ndarray | None = None, law: str = "mvn", asymmetric: bool = False, nbar: np.ndarray | None = None, copula: bool = False, free: bool = False) -> float:
    """The weighted negative log-likelihood; with `free` the first two parameters are those of to_free."""
    par = np.asarray(par, float)
    if free:
        par = np.r_[from_free(par[0], par[1]), par[2:]]
    rows = nll_rows(par, z, qbar, law, asymmetric, nbar, copula)
    if rows is None:
        return PENALTY
    total = float(rows.sum() if w is None else (w * rows).sum())
    return total if np.isfinite(total) else PENALTY


def nll_ratio(par: np.ndarray, z: np.ndarray, qbar: np.ndarray, w: np.ndarray | None = None, law: str = "mvn") -> float:
    """nll at (persistence, ratio[, shape])."""
    a, b = from_ratio(par[0], par[1])
    return nll(np.r_[a, b, par[2:]], z, qbar, w, law)


def nll_at_shape(shape: float, z: np.ndarray, qbar: np.ndarray, alpha: float, beta: float, w: np.ndarray | None = None, copula: bool = True) -> float:
    """The Student t likelihood as a function of its shape alone."""
    return nll(np.array([alpha, beta, shape]), z, qbar, w, "mvt", copula=copula)


def constant_rows(z: np.ndarray, r: np.ndarray, shape: float | None = None, copula: bool = False) -> np.ndarray:
    """Log-likelihoods per row under one correlation matrix, on the same scale as the dynamic ones."""
    return log_likelihood(z, np.broadcast_to(r, (len(z), *r.shape)), shape, copula)


# --- gradients
def d_by_r(z: np.ndarray, inv: np.ndarray, shape: float | None = None) -> np.ndarray:
    """The derivative of each row's negative log-likelihood by R."""
    u = np.einsum("tij,tj->ti", inv, z)
    if shape is None:
        c = 0.5
    else:
        quad = np.einsum("ti,ti->t", z, u)
        c = ((shape + z.shape[1]) / 2 / (shape - 2 + quad))[:, None, None]
    return 0.5 * inv - c * _outer(u)


def d_r_to_q(g: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The derivative by Q from the one by R, through the normalisation."""
    s = 1 / np.sqrt(np.einsum("tii->ti", q))
    out = g * s[:, :, None] * s[:, None, :]
    pull = (g * r).sum(axis=2) / np.einsum("tii->ti", q)
    i = np.arange(q.shape[1])
    out[:, i, i] -= pull
    return out


def shape_score(z: np.ndarray, inv: np.ndarray, shape: float, copula: bool = False) -> np.ndarray:
    """The derivative of each row's negative log-likelihood by the t's shape."""
    k = z.shape[1]

    def one(m: int, quad: np.ndarray) -> np.ndarray:
        return -(0.5 * (dist.digamma((shape + m) / 2) - dist.digamma(shape / 2) - m / (shape - 2)) - 0.5 * np.log1p(quad / (shape - 2)) + (shape + m) / 2 * quad / ((shape - 2) * (shape - 2 + quad)))

    out = one(k, np.einsum("ti,tij,tj->t", z, inv, z))
    return out - sum(one(1, z[:, i] ** 2) for i in range(k)) if copula else out


def scores(par: np.ndarray, z: np.ndarray, qbar: np.ndarray, w: np.ndarray | None = None, law: str = "mvn", asymmetric: bool = False, nbar: np.ndarray | None = None, copula: bool = False, free: bool = False) -> np.ndarray:
    """The (weighted) derivative of each row's negative log-likelihood by each parameter, analytically, in one pass."""
    par = np.asarray(par, float)
    own = np.r_[from_free(par[0], par[1]), par[2:]] if free else par
    shape = own[-1] if law == "mvt" else None
    d = derivatives(z, own[0], own[1], qbar, own[2] if asymmetric else None, nbar)
    g = d_r_to_q(d_by_r(z, d.inv, shape), d.q, d.r)
    cols = [np.einsum("tij,tij->t", g, x) for x in d.dq]
    if free:
        j = free_jacobian(par[0], par[1])
        cols[:2] = [cols[0] * j[0, i] + cols[1] * j[1, i] for i in range(2)]
    if shape is not None:
        cols.append(shape_score(z, d.inv, shape, copula))
    out = np.column_stack(cols)
    return out if w is None else out * np.asarray(w)[:, None]


def nll_gradient(par: np.ndarray, z: np.ndarray, qbar: np.ndarray, w: np.ndarray | None = None, **kw) -> np.ndarray:
    return scores(par, z, qbar, w, **kw).sum(axis=0)


def analytic_hessian(par: np.ndarray, z: np.ndarray, qbar: np.ndarray, w: np.ndarray | None = None, law: str = "mvn") -> np.ndarray:
    """The 2 x 2 Hessian by alpha and beta (at a fixed shape)."""
    alpha, beta = float(par[0]), float(par[1])
    shape = float(par[2]) if law == "mvt" else None
    d = derivatives(z, alpha, beta, qbar)
    zero = np.zeros_like(qbar)
    shift = lambda x: np.concatenate([zero[None], x[:-1]])
    second = {(0, 0): np.zeros_like(d.q), (0, 1): linear_recursion(shift(d.dq[0]), beta, zero), (1, 1): linear_recursion(2 * shift(d.dq[1]), beta, zero)}
    u = np.einsum("tij,tj->ti", d.inv, z)
    if shape is None:
        c, slope = np.full(len(z), 0.5), np.zeros(len(z))
    else:
        quad = np.einsum("ti,ti->t", z, u)
        c = (shape + z.shape[1]) / 2 / (shape - 2 + quad)
        slope = -c / (shape - 2 + quad)
    weight = np.ones(len(z)) if w is None else np.asarray(w, float)
    out = np.empty((2, 2))
    for (i, j), d12 in second.items():
        d2r = _d2_unit(d.q, d.r, d.dq[i], d.dq[j], d.dr[j], d12)
        a, b = d.inv @ d.dr[i], d.inv @ d.dr[j]
        half = 0.5 * (np.einsum("tij,tji->t", d.inv, d2r) - np.einsum("tij,tji->t", a, b))
        bend = 2 * np.einsum("ti,tij,tj->t", u, d.dr[j] @ d.inv @ d.dr[i], u) - np.einsum("ti,tij,tj->t", u, d2r, u)
        qi, qj = (-np.einsum("ti,tij,tj->t", u, d.dr[x], u) for x in (i, j))
        out[i, j] = out[j, i] = (weight * (half + c * bend + slope * qi * qj)).sum()
    return out


# --- fits
@dataclass
class DccFit:
    par: dict[str, float]
    nll: float
    qbar: np.ndarray
    law: str
    dynamic: bool
    converged: bool
    trace: list

    def vector(self) -> np.ndarray:
        return np.array(list(self.par.values()))


def start_of(asymmetric: bool, law: str) -> tuple[list[str], np.ndarray]:
    names = ["alpha", "beta", *(["gamma"] if asymmetric else []), *(["shape"] if law == "mvt" else [])]
    return names, np.array([{"alpha": 0.05, "beta": 0.9, "gamma": 0.02, "shape": 8.0}[n] for n in names])


def fit(z: np.ndarray, w: np.ndarray | None = None, law: str = "mvn", asymmetric: bool = False, copula: bool = False, qbar: np.ndarray | None = None, start: np.ndarray | None = None, keep_trace: bool = False, iterations: int = 200) -> DccFit:
    """DCC(1,1) by projected BFGS with the analytic gradient.

    Without an asymmetric term alpha and beta are searched in to_free's coordinates, where every point is stationary;
    with one in a box, beyond whose stationary part the likelihood is a penalty.
    """
    if law not in LAWS:
        raise ValueError(f"{law!r} is none of {LAWS}")
    qbar = weighted_correlation(z, w) if qbar is None else qbar
    nbar = negative_moment(z) if asymmetric else None
    names, x0 = start_of(asymmetric, law)
    x0 = x0 if start is None else np.asarray(start, float)
    trace: list = []
    options = {"law": law, "asymmetric": asymmetric, "nbar": nbar, "copula": copula}
    # A mean likelihood keeps steps of the same size at every length
    n = float(len(z) if w is None else np.sum(w))
    if asymmetric:
        lower = np.array([1e-6, 1e-6, 0.0] + ([2.1] if law == "mvt" else []))
        upper = np.array([0.5, 0.999, 0.5] + ([100.0] if law == "mvt" else []))
        f = lambda x: nll(x, z, qbar, w, **options) / n

        def grad(x: np.ndarray) -> np.ndarray:
            return nll_gradient(x, z, qbar, w, **options) / n

        found = minimise_box(f, x0, lower, upper, grad, iterations, trace=trace)
        x = found["x"]
    else:
        free = np.r_[to_free(x0[0], x0[1]), x0[2:]]
        lower = np.array([-8.0, -12.0] + ([2.1] if law == "mvt" else []))
        upper = np.array([11.0, 12.0] + ([100.0] if law == "mvt" else []))
        f = lambda x: nll(x, z, qbar, w, free=True, **options) / n
        found = minimise_box(f, free, lower, upper, lambda x: nll_gradient(x, z, qbar, w, free=True, **options) / n, iterations, trace=trace)
        back = lambda v: np.r_[from_free(v[0], v[1]), v[2:]]
        x, trace = back(found["x"]), [(back(v), y) for v, y in trace]
    rows = [{"step": i, **dict(zip(names, map(float, v), strict=True)), "nll": y * n} for i, (v, y) in enumerate(trace)] if keep_trace else []
    return DccFit(dict(zip(names, map(float, x), strict=True)), found["value"] * n, qbar, law, True, found["converged"], rows)


def fit_ratio(z: np.ndarray, w: np.ndarray | None = None, start: tuple[float, float] = (0.05, 0.9), qbar: np.ndarray | None = None, law: str = "mvn") -> DccFit:
    """DCC(1,1) searched in (persistence, ratio)."""
    qbar = weighted_correlation(z, w) if qbar is None else qbar
    n = float(len(z) if w is None else np.sum(w))
    x0, lower, upper = [*to_ratio(*start)], [1e-4, 1e-4], [0.9998, 0.9999]
    if law == "mvt":
        x0, lower, upper = [*x0, 8.0], [*lower, 2.1], [*upper, 100.0]
    found = minimise_box(lambda x: nll_ratio(x, z, qbar, w, law) / n, np.array(x0), np.array(lower), np.array(upper))
    a, b = from_ratio(*found["x"][:2])
    par = {"alpha": float(a), "beta": float(b)} | ({"shape": float(found["x"][2])} if law == "mvt" else {})
    return DccFit(par, found["value"] * n, qbar, law, True, found["converged"], [])


def fit_order(z: np.ndarray, order: tuple[int, int], w: np.ndarray | None = None, law: str = "mvn", qbar: np.ndarray | None = None) -> DccFit:
    """DCC(p, q); (0, 0) is constant correlation, (1, 1) is fit()."""
    p, q = check_order(order)
    if (p, q) == (1, 1):
        return fit(z, w, law, qbar=qbar)
    qbar = weighted_correlation(z, w) if qbar is None else qbar
    if (p, q) == (0, 0):
        return fit_constant(z, w, law, qbar=qbar)
    weight = np.ones(len(z)) if w is None else np.asarray(w, float)
    n = float(weight.sum())
    x0 = np.r_[np.full(p, 0.05 / p), np.full(q, 0.9 / q), [8.0] if law == "mvt" else []]
    lower, upper = np.r_[np.zeros(p + q), [2.1] if law == "mvt" else []], np.r_[np.full(p + q, 0.999), [100.0] if law == "mvt" else []]

    def f(x: np.ndarray) -> float:
        if x[: p + q].sum() >= 0.9999:
            return PENALTY
        _, r = path(z, x[:p], x[p : p + q], qbar)
        return -float((weight * log_likelihood(z, r, x[-1] if law == "mvt" else None)).sum()) / n

    found = minimise_box(f, x0, lower, upper, iterations=100)
    names = [*(f"alpha_{i + 1}" for i in range(p)), *(f"beta_{i + 1}" for i in range(q)), *(["shape"] if law == "mvt" else [])]
    return DccFit(dict(zip(names, map(float, found["x"]), strict=True)), found["value"] * n, qbar, law, True, found["converged"], [])


def fit_constant(z: np.ndarray, w: np.ndarray | None = None, law: str = "mvn", copula: bool = False, qbar: np.ndarray | None = None) -> DccFit:
    """One correlation matrix for all rows; under mvt its shape is fitted."""
    qbar = weighted_correlation(z, w) if qbar is None else qbar
    weight = np.ones(len(z)) if w is None else np.asarray(w, float)
    total = lambda s: -float((weight * constant_rows(z, qbar, s, copula)).sum())
    if law == "mvn":
        return DccFit({}, total(None), qbar, law, False, True, [])
    found = minimise_box(lambda x: total(x[0]) / weight.sum(), np.array([8.0]), np.array([2.1]), np.array([100.0]))
    return DccFit({"shape": float(found["x"][0])}, total(float(found["x"][0])), qbar, law, False, found["converged"], [])


def select(z: np.ndarray, w: np.ndarray | None = None, law: str = "mvn", asymmetric: bool = False, copula: bool = False, criterion: str = "bic", threshold: float = 0.02, force_constant: bool = False) -> tuple[DccFit, str]:
    """(fit, why): dynamic correlation unless it is not worth its parameters.

    "threshold" keeps constant correlation where alpha stays below it; "aic" and "bic" compare the likelihoods, which
    are on one scale here, with the effective rows of the weights as their number.
    """
    if criterion not in ("threshold", "aic", "bic"):
        raise ValueError(f"{criterion!r} is none of threshold, aic, bic")
    still = fit_constant(z, w, law, copula)
    if force_constant:
        return still, "forced"
    moving = fit(z, w, law, asymmetric, copula, qbar=still.qbar)
    if criterion == "threshold":
        return (still, f"alpha below {threshold}") if moving.par["alpha"] < threshold else (moving, "")
    rows = effective_rows(np.ones(len(z)) if w is None else np.asarray(w, float))
    each = 2.0 if criterion == "aic" else math.log(max(rows, 2.0))
    cost = lambda f: 2 * f.nll + each * len(f.par)
    return (still, f"{criterion} of constant correlation is lower") if cost(still) <= cost(moving) else (moving, "")


def boundary_events(par: dict[str, float], threshold: float = 0.02) -> list[tuple[str, float, str]]:
    """(name, value, side) of each alpha or beta below the threshold and of a persistence next to 1."""
    p = persistence(par)
    found = [(k, v, "lower") for k, v in par.items() if k.split("_")[0] in ("alpha", "beta") and v < threshold]
    return [*found, *([("persistence", p["persistence"], "upper")] if p["persistence"] > 1 - threshold / 10 else [])]


# --- inference
def information(par: np.ndarray, z: np.ndarray, qbar: np.ndarray, w: np.ndarray | None = None, method: str = "numerical", **kw) -> np.ndarray:
    """The Hessian of the negative log-likelihood: numerical (of the analytic gradient's function) or analytic (alpha and beta)."""
    if method == "analytic" and not kw.get("asymmetric") and not kw.get("free") and not kw.get("copula"):
        h = analytic_hessian(par, z, qbar, w, kw.get("law", "mvn"))
        if len(par) == 2:
            return h
    return hessian(lambda p: nll(p, z, qbar, w, **kw), np.asarray(par, float))


def covariance(h: np.ndarray) -> tuple[np.ndarray, dict]:
    """The inverse of a Hessian (the pseudo-inverse where an eigenvalue is not above 1e-10) and what it was like."""
    val = np.linalg.eigvalsh((h + h.T) / 2) if np.isfinite(h).all() else np.array([np.nan])
    sound = bool(val.min() > 1e-10)
    inv = np.linalg.inv(h) if sound else np.linalg.pinv(h) if np.isfinite(h).all() else np.full(h.shape, np.nan)
    return inv, {"eigenvalues": val.tolist(), "positive": sound, "condition": float(val.max() / val.min()) if sound else float("inf")}


def errors(par: np.ndarray, z: np.ndarray, qbar: np.ndarray, w: np.ndarray | None = None, method: str = "hessian", **kw) -> dict:
    """se, vcov and the Hessian's eigenvalues, by "hessian" or "sandwich" (scores from one pass, each with its weight once)."""
    if method not in ("hessian", "sandwich"):
        raise ValueError(f"{method!r} is neither hessian nor sandwich")
    h = information(par, z, qbar, w, **kw)
    inv, about = covariance(h)
    if method == "sandwich":
        g = scores(par, z, qbar, w, **kw)
        inv = inv @ (g.T @ g) @ inv
    d = np.diag(inv)
    with np.errstate(invalid="ignore"):
        se = np.sqrt(np.where(d > 0, d, np.nan))
    return {"se": se, "vcov": inv, "hessian": h, "method": method} | about


def gated_errors(found: DccFit, z: np.ndarray, w: np.ndarray | None = None, method: str = "hessian", boundary: float = 1e-4, **kw) -> dict:
    """errors() of a fit, or NaN with a reason: constant, boundary, no_hessian, not_positive or invalid."""
    par = found.vector()
    none = {"se": np.full(len(par), np.nan), "valid": False}
    if not found.dynamic:
        return none | {"reason": "constant"}
    a, b = found.par["alpha"], found.par["beta"]
    if min(a, b) < boundary or a + b + DELTA * found.par.get("gamma", 0.0) > 1 - boundary:
        return none | {"reason": "boundary"}
    kw = {"law": found.law, "asymmetric": "gamma" in found.par} | kw
    try:
        out = errors(par, z, found.qbar, w, method, **kw)
    except np.linalg.LinAlgError:
        return none | {"reason": "no_hessian"}
    if not out["positive"]:
        return none | {"reason": "not_positive", "eigenvalues": out["eigenvalues"]}
    sound = bool(np.isfinite(out["se"]).all())
    return out | {"valid": sound, "reason": "ok" if sound else "invalid"}


def transform_errors(par: np.ndarray, vcov: np.ndarray, to_unconstrained: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(par, se, vcov) in the other coordinates of (alpha, beta), by the delta method."""
    if to_unconstrained:
        new = np.array(to_free(par[0], par[1]))
        j = np.linalg.inv(free_jacobian(*new))
    else:
        new = np.array(from_free(par[0], par[1]))
        j = free_jacobian(par[0], par[1])
    v = j @ vcov[:2, :2] @ j.T
    return new, np.sqrt(np.maximum(np.diag(v), 0)), v


def wald(par: np.ndarray, se: np.ndarray, level: float = 0.95) -> np.ndarray:
    """Lower and upper ends, a row a parameter."""
    z = float(dist.normal_quantile(np.array(0.5 + level / 2)))
    return np.column_stack([par - z * se, par + z * se])


def held_profile(par: np.ndarray, z: np.ndarray, qbar: np.ndarray, w: np.ndarray | None = None, k: int = 0, level: float = 0.95, points: int = 50, **kw) -> dict:
    """The grid of parameter k, the others held, and the outermost points whose likelihood is not rejected."""
    par = np.asarray(par, float)
    se = errors(par, z, qbar, w, **kw)["se"][k]
    span = 4 * se if np.isfinite(se) else 0.5 * abs(par[k])
    at = np.linspace(max(1e-6, par[k] - span), min(0.999, par[k] + span), points)
    f = lambda p: nll(p, z, qbar, w, **kw)
    values = profile(f, par, k, at, refit=False)
    inside = at[values - f(par) <= dist.chi2_quantile(level, 1) / 2]
    return {"at": at, "nll": values, "lower": float(inside.min()) if len(inside) else float("nan"), "upper": float(inside.max()) if len(inside) else float("nan")}


def summary(par: np.ndarray, z: np.ndarray, qbar: np.ndarray, w: np.ndarray | None = None, level: float = 0.95, method: str = "hessian", **kw) -> dict:
    """Log-likelihood, AIC, BIC, estimates with errors and intervals, and the Hessian's eigenvalues."""
    e = errors(par, z, qbar, w, method, **kw)
    ll, n = -nll(par, z, qbar, w, **kw), len(z)
    ci = wald(np.asarray(par), e["se"], level)
    return {"loglik": ll, "aic": 2 * len(par) - 2 * ll, "bic": len(par) * math.log(n) - 2 * ll, "par": np.asarray(par), "se": e["se"], "lower": ci[:, 0], "upper": ci[:, 1], "eigenvalues": e["eigenvalues"], "condition": e["condition"], "rows": n}


def check_gradient(par: np.ndarray, z: np.ndarray, qbar: np.ndarray, **kw) -> float:
    """The largest difference of the analytic and the numerical gradient, relative to the gradient."""
    a = nll_gradient(par, z, qbar, **kw)
    return float(np.abs(a - gradient(lambda p: nll(p, z, qbar, **kw), np.asarray(par, float))).max() / (1 + np.abs(a).max()))


# --- simulation
def simulate_residuals(n: int, k: int, alpha: float | np.ndarray, beta: float | np.ndarray, qbar: np.ndarray, seed, law: str = "mvn", shape: float | None = None, gamma: float = 0.0, nbar: np.ndarray | None = None, burn: int = 0) -> np.ndarray:
    """Rows with unit variances and DCC(p, q) correlations; Student t rows have unit variances too."""
    rng = np.random.default_rng(seed)
    a, b = np.atleast_1d(np.asarray(alpha, float)), np.atleast_1d(np.asarray(beta, float))
    nbar = (0.5 * qbar if nbar is None else nbar) if gamma else None
    base = (1 - a.sum() - b.sum()) * qbar - (gamma * nbar if gamma else 0)
    total = n + burn
    e = rng.standard_normal((total, k))
    scale = np.sqrt((shape - 2) / rng.chisquare(shape, total)) if law == "mvt" else np.ones(total)
    z, q = np.empty((total, k)), np.broadcast_to(qbar, (total, k, k)).copy()
    for t in range(total):
        if t >= max(len(a), len(b)):
            q[t] = base + sum(x * np.outer(z[t - i], z[t - i]) for i, x in enumerate(a, 1)) + sum(x * q[t - j] for j, x in enumerate(b, 1))
            if gamma:
                m = np.minimum(z[t - 1], 0)
                q[t] += gamma * np.outer(m, m)
        d = 1 / np.sqrt(np.diag(q[t]))
        z[t] = np.linalg.cholesky(safe_correlation(q[t] * np.outer(d, d))) @ e[t] * scale[t]
    return z[burn:]


def simulate(n: int, k: int = 2, alpha: float | np.ndarray = 0.04, beta: float | np.ndarray = 0.93, qbar: np.ndarray | None = None, omega: np.ndarray | None = None, arch: np.ndarray | None = None, garch: np.ndarray | None = None, seed: int = 1, law: str = "mvn", shape: float | None = None, gamma: float = 0.0, burn: int = 200) -> np.ndarray:
    """Series with GARCH(1,1) margins over simulate_residuals()."""
    qbar = np.full((k, k), 0.4) + 0.6 * np.eye(k) if qbar is None else qbar
    fill = lambda x, v: np.full(k, v) if x is None else np.resize(np.asarray(x, float), k)
    omega, arch, garch = fill(omega, 0.05), fill(arch, 0.08), fill(garch, 0.9)
    z = simulate_residuals(n + burn, k, alpha, beta, qbar, seed, law, shape, gamma)
    y, h = np.empty_like(z), omega / (1 - arch - garch)
    for t in range(len(z)):
        y[t] = np.sqrt(h) * z[t]
        h = omega + arch * y[t] ** 2 + garch * h
    return y[burn:]
