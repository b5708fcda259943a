"""Orthogonal GARCH: independent components, their quality, and the fit over them."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np

from serieslab.functions import dist
from serieslab.functions.garch import GarchFit, GarchSpec, fit_garch, garch_errors, simulate_garch
from serieslab.functions.dcc import wald

METHODS = ("radical", "fastica", "pca")
#: E log cosh of a standard normal.
NORMAL_LOG_COSH = 0.374567


def whiten(x: np.ndarray, components: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(white rows, whitening W, its inverse): the first principal components at variance 1."""
    val, vec = np.linalg.eigh(np.cov(x.T).reshape(x.shape[1], x.shape[1]))
    keep = np.argsort(val)[::-1][: components or x.shape[1]]
    val, vec = np.maximum(val[keep], 1e-12), vec[:, keep]
    w = (vec / np.sqrt(val)).T
    return x @ w.T, w, vec * np.sqrt(val)


def spacing_entropy(x: np.ndarray, m: int) -> np.ndarray:
    """Vasicek's m-spacing estimate of the entropy of each column, up to a constant."""
    s = np.sort(x, axis=0)
    return np.log(np.maximum(s[m:] - s[:-m], 1e-12)).mean(axis=0)


def radical(white: np.ndarray, angles: int = 150, replicates: int = 4, noise: float = 0.1, rounds: int | None = None, seed: int = 0, most: int = 1500) -> np.ndarray:
    """A rotation to independence: pair by pair, the angle whose two marginal spacing entropies sum to the least.

    Points are smoothed by a few noisy copies of each; of long series an even subset of rows sets the angles.
    """
    n, k = white.shape
    rng = np.random.default_rng(seed)
    some = white[:: max(1, n // most)]
    copies = max(1, min(replicates, 6000 // len(some)))
    x = np.repeat(some, copies, axis=0)
    if copies > 1:
        x = x + rng.standard_normal(x.shape) * noise
    m = max(1, int(math.sqrt(len(x))))
    theta = (np.arange(angles) / angles - 0.5) * math.pi / 2
    c, s = np.cos(theta), np.sin(theta)
    total = np.eye(k)
    for _ in range(rounds or max(1, k - 1)):
        for i, j in itertools.combinations(range(k), 2):
            a, b = np.multiply.outer(x[:, i], c) - np.multiply.outer(x[:, j], s), np.multiply.outer(x[:, i], s) + np.multiply.outer(x[:, j], c)
            best = int((spacing_entropy(a, m) + spacing_entropy(b, m)).argmin())
            turn = np.eye(k)
            turn[np.ix_([i, j], [i, j])] = [[c[best], -s[best]], [s[best], c[best]]]
            x, total = x @ turn.T, turn @ total
    return total


def fixed_point(white: np.ndarray, iterations: int = 200, seed: int = 0) -> tuple[np.ndarray, bool]:
    """(rotation, converged): symmetric fixed-point iteration on log cosh."""
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((white.shape[1],) * 2))[0]
    for _ in range(iterations):
        g = np.tanh(white @ w.T)
        u, _, vt = np.linalg.svd(g.T @ white / len(white) - np.diag((1 - g * g).mean(axis=0)) @ w)
        new = u @ vt
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-8
        w = new
        if done:
            return w, True
    return w, False


def negentropy(s: np.ndarray) -> np.ndarray:
    """(E log cosh s - that of a normal)^2 of each standardised column."""
    z = (s - s.mean(axis=0)) / np.maximum(s.std(axis=0, ddof=1), 1e-12)
    return (np.log(np.cosh(np.clip(z, -300, 300))).mean(axis=0) - NORMAL_LOG_COSH) ** 2


def quality(s: np.ndarray) -> dict:
    """Negentropies, excess kurtoses, the components' correlations and 1 - their mean absolute value (the diagonal counts as 0)."""
    c = np.corrcoef(s.T).reshape(s.shape[1], s.shape[1])
    return {"negentropy": negentropy(s), "total_negentropy": float(negentropy(s).sum()), "kurtosis": np.array([dist.excess_kurtosis(x) for x in s.T]), "correlation": c, "independence": float(1 - np.abs(c - np.eye(len(c))).mean())}


@dataclass
class Ica:
    """s = x W', x = s A'; k is the unmixing W whose log |det| the likelihood needs."""

    s: np.ndarray
    a: np.ndarray
    w: np.ndarray
    method: str
    converged: bool
    quality: dict


def decompose(x: np.ndarray, method: str = "radical", components: int | None = None, restarts: int = 3, demean: bool = False, seed: int = 0) -> Ica:
    """Whiten and rotate; of some restarts the one with the most negentropy, principal components where none can be had."""
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {METHODS}")
    x = np.asarray(x, float)
    x = x - x.mean(axis=0) if demean else x
    white, w0, a0 = whiten(x, components)
    best: tuple[float, np.ndarray, bool] | None = None
    for r in range(restarts if method != "pca" and white.shape[1] > 1 else 0):
        start = np.linalg.qr(np.random.default_rng([seed, r]).standard_normal((white.shape[1],) * 2))[0] if r else np.eye(white.shape[1])
        if method == "radical":
            turn, done = radical(white @ start.T, seed=seed + r) @ start, True
        else:
            turn, done = fixed_point(white, seed=seed + r)
        score = float(negentropy(white @ turn.T).sum())
        if np.isfinite(score) and (best is None or score > best[0]):
            best = (score, turn, done)
    turn, done = (best[1], best[2]) if best else (np.eye(white.shape[1]), method == "pca")
    s = white @ turn.T
    return Ica(s, a0 @ turn.T, turn @ w0, method if best or method == "pca" else "pca", done, quality(s) if s.shape[1] > 1 else {})


@dataclass
class GogarchFit:
    ica: Ica
    fits: list[GarchFit]

    def covariance(self) -> np.ndarray:
        h = np.column_stack([f.h for f in self.fits])
        return np.einsum("ij,tj,kj->tik", self.ica.a, h, self.ica.a)

    def rows(self) -> np.ndarray:
        return log_likelihood(self.ica.s, self.fits, self.ica.w)


def log_likelihood(s: np.ndarray, fits: list[GarchFit], w: np.ndarray) -> np.ndarray:
    """Per row: the components' log-likelihoods and the log |det| of the unmixing (of W W' where W is not square)."""
    square = w.shape[0] == w.shape[1]
    jacobian = np.linalg.slogdet(w)[1] if square else 0.5 * np.linalg.slogdet(w @ w.T)[1]
    return sum(f.spec.loglik(c, f.par, f.h if len(f.h) == len(c) else None) for c, f in zip(s.T, fits, strict=True)) + jacobian


def fit_gogarch(y: np.ndarray, w: np.ndarray | None = None, method: str = "radical", components: int | None = None, spec: GarchSpec | None = None, restarts: int = 3, seed: int = 0) -> GogarchFit:
    """Independent components of y (of mean 0) and a weighted GARCH fit of each."""
    ica = decompose(y, method, components, restarts, seed=seed)
    return GogarchFit(ica, [fit_garch(c, w, spec or GarchSpec()) for c in ica.s.T])


def parse_parameters(par: dict[str, float], fit: GogarchFit) -> list[np.ndarray]:
    """Each component's parameters: those of the fit, where par does not name others (name_i for one component, name for all)."""
    out = []
    for i, f in enumerate(fit.fits, 1):
        names = f.spec.names()
        out.append(np.array([par.get(f"{n}_{i}", par.get(n, v)) for n, v in zip(names, f.par, strict=True)]))
    return out


def component_errors(fit: GogarchFit, w: np.ndarray | None = None, method: str = "hessian", boundary: float = 1e-4) -> list[dict]:
    """A row a parameter of each component: estimate, se and why it is missing if it is."""
    rows = []
    for i, (c, f) in enumerate(zip(fit.ica.s.T, fit.fits, strict=True), 1):
        own, _ = f.spec.split(f.par)
        edge = own[1] < boundary or f.persistence > 1 - boundary
        se = np.full(len(f.par), np.nan) if edge else garch_errors(c, f, w, method)
        for n, v, e in zip(f.spec.names(), f.par, se, strict=True):
            rows.append({"component": i, "name": n, "estimate": float(v), "se": float(e), "reason": "boundary" if edge else "ok" if np.isfinite(e) else "invalid"})
    return rows


def summary(fit: GogarchFit, w: np.ndarray | None = None, level: float = 0.95, method: str = "hessian") -> list[dict]:
    rows = component_errors(fit, w, method)
    for r in rows:
        r["lower"], r["upper"] = map(float, wald(np.array([r["estimate"]]), np.array([r["se"]]), level)[0])
    return rows


def diagnose(fit: GogarchFit, y: np.ndarray) -> dict:
    """Persistence, moments and Ljung-Box of the components; how well W and A fit each other, A's condition and the covariance's error."""
    res = [f.residuals(c) for c, f in zip(fit.ica.s.T, fit.fits, strict=True)]
    identity = fit.ica.w @ fit.ica.a
    mean_cov, sample = fit.covariance().mean(axis=0), np.cov(y.T).reshape(y.shape[1], y.shape[1])
    return {
        "persistence": [f.persistence for f in fit.fits],
        "moments": [dist.moments(r) for r in res],
        "ljung_box": [dist.ljung_box(r * r) for r in res],
        "unmixing_error": float(np.linalg.norm(identity - np.eye(len(identity)))),
        "condition": float(np.linalg.cond(fit.ica.a)),
        "covariance_error": float(np.linalg.norm(mean_cov - sample) / np.linalg.norm(sample)),
    }


def problems(fit: GogarchFit) -> list[str]:
    """What is suspicious about a fit, in words."""
    found = [] if fit.ica.converged else ["components did not converge"]
    cond = float(np.linalg.cond(fit.ica.a))
    if cond > 100:
        found.append(f"mixing matrix is {'badly ' if cond > 1000 else ''}conditioned ({cond:.0f})")
    if fit.ica.w.shape[0] == fit.ica.w.shape[1] and abs(np.linalg.det(fit.ica.w)) < 1e-10:
        found.append("unmixing matrix is singular")
    if fit.ica.s.shape[1] > 1 and np.abs(np.corrcoef(fit.ica.s.T) - np.eye(fit.ica.s.shape[1])).max() > 0.2:
        found.append("components are correlated")
    return [*found, *(f"component {i} has persistence {f.persistence:.3f}" for i, f in enumerate(fit.fits, 1) if f.persistence > 0.99)]


def match_columns(estimate: np.ndarray, truth: np.ndarray) -> list[tuple[int, int, float]]:
    """(column, its partner, |cosine|): greedily the best pair of those left."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=0), 1e-12)
    c = np.abs(unit(estimate).T @ unit(truth))
    out = []
    for _ in range(min(c.shape)):
        i, j = np.unravel_index(int(c.argmax()), c.shape)
        out.append((int(i), int(j), float(min(1.0, c[i, j]))))
        c[i, :], c[:, j] = -1, -1
    return out


def mixing_angle(estimate: np.ndarray, truth: np.ndarray) -> float:
    """The mean angle (radians) between matched columns."""
    return float(np.mean([math.acos(c) for *_, c in match_columns(estimate, truth)]))


def amari_distance(estimate: np.ndarray, truth: np.ndarray) -> float:
    """0 where estimate is truth up to order and scale of columns, at most 1."""
    p = np.abs(np.linalg.pinv(estimate) @ truth)
    k = len(p)
    if k < 2:
        return 0.0
    rows, cols = (p.sum(axis=1) / p.max(axis=1) - 1).sum(), (p.sum(axis=0) / p.max(axis=0) - 1).sum()
    return float((rows + cols) / (2 * k * (k - 1)))


def simulate(n: int, k: int = 3, a: np.ndarray | None = None, omega: np.ndarray | None = None, arch: np.ndarray | None = None, garch: np.ndarray | None = None, law: str = "norm", shape: float = 8.0, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, s, A): GARCH(1,1) components mixed by A, a random rotation if none is given."""
    a = np.linalg.qr(np.random.default_rng([seed, 99]).standard_normal((k, k)))[0] if a is None else a
    fill = lambda x, v: np.resize(np.asarray(v if x is None else x, float), k)
    omega, arch, garch = fill(omega, [0.05, 0.08, 0.03]), fill(arch, [0.10, 0.15, 0.06]), fill(garch, [0.85, 0.75, 0.92])
    s = np.column_stack([simulate_garch(n, omega[i], arch[i], garch[i], seed * 1000 + i, law=law, shape=shape if law != "norm" else None) for i in range(k)])
    return s @ a.T, s, a
