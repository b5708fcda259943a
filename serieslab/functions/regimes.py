"""Hidden regimes: filters, Markov chains and pools, hidden Markov models, switching VAR and switching GARCH."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from serieslab.functions import dist
from serieslab.functions.garch import GarchFit, GarchSpec, fit_garch
from serieslab.functions.optim import minimise_box

STAY = 0.9  # where every chain's transition matrix starts from


# --- chains
def stationary_law(p: np.ndarray) -> np.ndarray:
    """pi with pi P = pi and sum 1; least squares where it is not unique, never negative."""
    k = len(p)
    law = np.linalg.lstsq(np.vstack([p.T - np.eye(k), np.ones(k)]), np.r_[np.zeros(k), 1.0], rcond=None)[0]
    law = np.maximum(law, 0)
    return law / law.sum()


def start_transitions(k: int) -> np.ndarray:
    p = np.full((k, k), (1 - STAY) / max(1, k - 1))
    np.fill_diagonal(p, STAY if k > 1 else 1.0)
    return p


def durations(p: np.ndarray) -> np.ndarray:
    """The expected rows of a stay in each state."""
    d = np.diag(p)
    return np.where(d < 1, 1 / np.maximum(1 - d, 1e-300), np.inf)


def chain_law(path: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(names, P, stationary law) of the counted transitions; a state that is never left stays."""
    names, code = np.unique(path, return_inverse=True)
    n = np.zeros((len(names),) * 2)
    np.add.at(n, (code[:-1], code[1:]), 1)
    left = n.sum(axis=1, keepdims=True)
    p = np.where(left > 0, n / np.maximum(left, 1), np.eye(len(names)))
    return names.tolist(), p, stationary_law(p)


def simulate_chain(n: int, law: tuple[list[int], np.ndarray, np.ndarray], uniform: Callable[[int], float]) -> np.ndarray:
    """n states: the first from the stationary law, each next from its row of P, by the given uniforms."""
    names, p, first = law
    rows = np.cumsum(p, axis=1).tolist()
    cum, last = np.cumsum(first).tolist(), len(names) - 1
    out = np.empty(n, np.int64)
    for t in range(n):
        u, s = uniform(t), 0
        while s < last and u >= cum[s]:
            s += 1
        out[t] = s
        cum = rows[s]
    return np.asarray(names)[out]


def consecutive_starts(rows: np.ndarray, length: int) -> np.ndarray:
    """The rows of a sorted pool from which `length` consecutive ones are in it."""
    rows = np.sort(np.asarray(rows))
    if len(rows) < length:
        return rows[:0]
    return rows[: len(rows) - length + 1][rows[length - 1 :] - rows[: len(rows) - length + 1] == length - 1]


def sample_pools(path: np.ndarray, states: np.ndarray, micro: int, uniform: Callable[[int], float]) -> np.ndarray:
    """A source row for each simulated state, from the rows of path that are in it.

    With micro > 1 a stay is filled by blocks of at most that many consecutive rows of the pool; a block for which the
    pool has no such run is one row. uniform(k) is the draw for place k.
    """
    path, out = np.asarray(path), np.empty(len(states), np.int64)
    pool = {s: np.flatnonzero(path == s) for s in np.unique(states)}
    for s, rows in pool.items():
        if not len(rows):
            raise ValueError(f"no row is in state {s}")
    starts = {(s, k): consecutive_starts(rows, k) for s, rows in pool.items() for k in range(2, micro + 1)}
    t = 0
    while t < len(states):
        s, end = states[t], t + 1
        while end < len(states) and end - t < micro and states[end] == s:
            end += 1
        length = end - t
        choice = starts[s, length] if length > 1 else pool[s]
        if not len(choice):
            choice, length = pool[s], 1
        first = choice[int(uniform(t) * len(choice))]
        out[t : t + length] = np.arange(first, first + length)
        t += length
    return out


def regime_series(y: np.ndarray, basis: str | int = "market") -> np.ndarray:
    """What regimes are told from: the mean of the columns, their first principal component (scaled), or one column."""
    y = np.asarray(y, float).reshape(len(y), -1)
    if isinstance(basis, int):
        return y[:, basis]
    if basis == "market" or y.shape[1] == 1:
        return y.mean(axis=1)
    if basis != "first_pc":
        raise ValueError(f"{basis!r} is neither market, first_pc nor a column's number")
    z = (y - y.mean(axis=0)) / np.maximum(y.std(axis=0, ddof=1), 1e-12)
    return z @ np.linalg.eigh(np.cov(z.T))[1][:, -1]


# --- filters
def _scan(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products m[0] ... m[t] for every t, each scaled to a largest element of 1, and the logs of the scales.

    Products are doubled in length at each of log n steps, so all rows move at once.
    """
    m, logs = m.copy(), np.zeros(len(m))
    step = 1
    while True:
        top = m.max(axis=(1, 2))
        top = np.where(top > 0, top, 1.0)
        m /= top[:, None, None]
        logs = logs + np.log(top)
        if step >= len(m):
            return m, logs
        m = np.concatenate([m[:step], m[:-step] @ m[step:]])
        logs = np.concatenate([logs[:step], logs[:-step] + logs[step:]])
        step *= 2


def forward_backward(ll: np.ndarray, p: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Smoothed state probabilities, summed joint probabilities of neighbours, and the log-likelihood."""
    n, k = ll.shape
    top = ll.max(axis=1, keepdims=True)
    b = np.exp(ll - top)
    start = first * b[0]
    if n == 1:
        smooth = (start / max(start.sum(), 1e-300))[None]
        return smooth, np.zeros((k, k)), float(math.log(max(start.sum(), 1e-300)) + top[0, 0])
    step = p[None] * b[1:, None, :]
    ahead, logs = _scan(step)
    a = np.vstack([start, start @ ahead])
    total = float(math.log(max(a[-1].sum(), 1e-300)) + logs[-1] + top.sum())
    behind = _scan(step[::-1].transpose(0, 2, 1))[0][::-1].transpose(0, 2, 1)
    back = np.vstack([behind.sum(axis=2), np.ones(k)])
    a = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
    back = back / np.maximum(back.sum(axis=1, keepdims=True), 1e-300)
    smooth = a * back
    smooth /= np.maximum(smooth.sum(axis=1, keepdims=True), 1e-300)
    joint = a[:-1, :, None] * step * back[1:, None, :]
    joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
    return smooth, joint.sum(axis=0), total


def filtered(ll: np.ndarray, p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """State probabilities given the rows so far (Hamilton's filter)."""
    b = np.exp(ll - ll.max(axis=1, keepdims=True))
    start = first * b[0]
    a = np.vstack([start, start @ _scan(p[None] * b[1:, None, :])[0]]) if len(ll) > 1 else start[None]
    return a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300)


def viterbi(ll: np.ndarray, p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The most likely path; ties go to the lower state."""
    lp = np.log(p + 1e-300)
    score, came = np.log(first + 1e-300) + ll[0], np.zeros(ll.shape, int)
    for t in range(1, len(ll)):
        step = score[:, None] + lp
        came[t] = step.argmax(axis=0)
        score = step.max(axis=0) + ll[t]
    path = np.empty(len(ll), int)
    path[-1] = score.argmax()
    for t in range(len(ll) - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def _rows_to_law(joint: np.ndarray, p: np.ndarray) -> np.ndarray:
    left = joint.sum(axis=1, keepdims=True)
    return np.where(left > 0, joint / np.maximum(left, 1e-300), p)


# --- hidden Markov models
def log_normal(y: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """log density of each row of y under a normal law, by Cholesky."""
    d = y - mean
    low = np.linalg.cholesky(cov + 1e-10 * np.eye(cov.shape[0]))
    s = np.linalg.solve(low, d.T)
    return -0.5 * ((s * s).sum(axis=0) + len(cov) * math.log(2 * math.pi)) - np.log(np.diag(low)).sum()


def fit_hmm(y: np.ndarray, k: int = 2, max_iter: int = 100, tol: float = 1e-6, diagonal: bool = False) -> dict:
    """Gaussian hidden Markov model by EM, with whole or diagonal covariances; states are numbered by rising variance."""
    y = y.reshape(len(y), -1)
    order = np.abs(y - np.median(y, axis=0)).sum(axis=1).argsort(kind="stable")
    label = np.empty(len(y), int)
    for s, part in enumerate(np.array_split(order, k)):
        label[part] = s
    smooth = np.eye(k)[label]
    p, first, last, log = start_transitions(k), np.full(k, 1 / k), -np.inf, []
    for it in range(1, max_iter + 1):
        w = np.maximum(smooth.sum(axis=0), 1e-12)
        mean = smooth.T @ y / w[:, None]
        cov = [((smooth[:, s, None] * (y - mean[s])).T @ (y - mean[s])) / w[s] + 1e-8 * np.eye(y.shape[1]) for s in range(k)]
        cov = [np.diag(np.diag(c)) for c in cov] if diagonal else cov
        ll = np.column_stack([log_normal(y, mean[s], cov[s]) for s in range(k)])
        smooth, joint, now = forward_backward(ll, p, first)
        p, first = _rows_to_law(joint, p), smooth[0]
        log.append(now)
        if abs(now - last) < tol:
            break
        last = now
    rank = np.argsort([np.trace(c) for c in cov])
    grid = np.ix_(rank, rank)
    return {"p": p[grid], "mean": mean[rank], "cov": np.array(cov)[rank], "smooth": smooth[:, rank], "path": viterbi(ll[:, rank], p[grid], first[rank]), "loglik": now, "iterations": it, "log": log}


def cluster(y: np.ndarray, k: int, starts: int = 10, seed: int = 0) -> np.ndarray:
    """Labels of one-dimensional k-means, the best of some starts (the first from quantiles)."""
    best: tuple[float, np.ndarray] | None = None
    for r in range(starts):
        centre = np.quantile(y, (np.arange(k) + 0.5) / k) if r == 0 else np.random.default_rng([seed, r]).choice(y, k, replace=False)
        for _ in range(50):
            label = np.abs(y[:, None] - centre).argmin(axis=1)
            new = np.array([y[label == s].mean() if (label == s).any() else centre[s] for s in range(k)])
            if np.allclose(new, centre):
                break
            centre = new
        cost = float(((y - centre[label]) ** 2).sum())
        if best is None or cost < best[0]:
            best = (cost, label)
    return best[1]


def emission(y: np.ndarray, state: dict[str, float], law: str) -> np.ndarray:
    """log density of y in a state with mean, sd and the law's own parameters."""
    own = {n: state[n] for n, *_ in dist.LAWS[law]}
    return dist.log_density(law, (y - state["mean"]) / state["sd"], **own) - math.log(state["sd"])


def update_emission(y: np.ndarray, w: np.ndarray, state: dict[str, float], law: str) -> dict[str, float]:
    """Weighted mean and sd, then the law's own parameters by weighted likelihood."""
    total = max(w.sum(), 1e-12)
    mean = float(w @ y / total)
    out = state | {"mean": mean, "sd": max(1e-8, float(math.sqrt(w @ (y - mean) ** 2 / total)))}
    own = dist.LAWS[law]
    if own:
        z = (y - out["mean"]) / out["sd"]
        names = [n for n, *_ in own]
        f = lambda x: -float(w @ dist.log_density(law, z, **dict(zip(names, x, strict=True)))) / total
        found = minimise_box(f, np.array([state[n] for n in names]), np.array([x[2] for x in own]), np.array([x[3] for x in own]), iterations=20)
        out |= dict(zip(names, map(float, found["x"]), strict=True))
    return out


def fit_hmm_law(y: np.ndarray, k: int = 2, law: str = "sstd", max_iter: int = 200, tol: float = 1e-6) -> dict:
    """Hidden Markov model of one column with norm, std or sstd (or any other) emissions, states by rising sd."""
    y = np.asarray(y, float).ravel()
    if k < 2:
        raise ValueError("a hidden Markov model needs two states or more")
    label = cluster(y, k)
    states = []
    for s in range(k):
        own = y[label == s] if (label == s).sum() >= 5 else y
        states.append({"mean": float(own.mean()), "sd": float(own.std(ddof=1)) or 1e-8} | {n: v for n, v, *_ in dist.LAWS[law]})
    p, last, log = start_transitions(k), -np.inf, []
    first = stationary_law(p)
    for it in range(1, max_iter + 1):
        ll = np.column_stack([emission(y, s, law) for s in states])
        smooth, joint, now = forward_backward(ll, p, first)
        log.append(now)
        p, first = _rows_to_law(joint, p), smooth[0]
        states = [update_emission(y, smooth[:, i], s, law) for i, s in enumerate(states)]
        if abs(now - last) < tol * max(1.0, abs(now)):
            break
        last = now
    ll = np.column_stack([emission(y, s, law) for s in states])
    smooth, joint, now = forward_backward(ll, p, first)
    rank = np.argsort([s["sd"] for s in states])
    grid = np.ix_(rank, rank)
    return {"p": p[grid], "states": [states[i] for i in rank], "smooth": smooth[:, rank], "path": viterbi(ll[:, rank], p[grid], first[rank]), "loglik": now, "iterations": it, "log": log, "converged": it < max_iter, "durations": durations(p[grid]), "law": law}


# --- switching vector autoregression
def fit_msvar(y: np.ndarray, max_iter: int = 100, tol: float = 1e-6, k: int = 2) -> dict:
    """VAR(1) with switching coefficients and covariances, by EM with a filter and a smoother."""
    x, t = np.column_stack([np.ones(len(y) - 1), y[:-1]]), y[1:]
    beta0 = np.linalg.lstsq(x, t, rcond=None)[0]
    e = t - x @ beta0
    sigma0 = np.cov(e.T).reshape(t.shape[1], t.shape[1])
    spread = np.linspace(0.9, 1.1, k)
    beta, sigma = [c * beta0 for c in spread], [c * sigma0 for c in spread]
    p, first, last, log = start_transitions(k), np.full(k, 1 / k), -np.inf, []
    for it in range(1, max_iter + 1):
        ll = np.column_stack([log_normal(t - x @ b, np.zeros(t.shape[1]), s) for b, s in zip(beta, sigma, strict=True)])
        smooth, joint, now = forward_backward(ll, p, first)
        for s in range(k):
            w = smooth[:, s]
            xw = x * w[:, None]
            beta[s] = np.linalg.solve(xw.T @ x + 1e-10 * np.eye(x.shape[1]), xw.T @ t)
            r = t - x @ beta[s]
            sigma[s] = (r * w[:, None]).T @ r / max(w.sum(), 1e-12)
        p = _rows_to_law(joint, p)
        log.append(now)
        if abs(now - last) < tol:
            break
        last = now
    return {"beta": beta, "sigma": sigma, "p": p, "smooth": np.vstack([smooth[:1], smooth]), "loglik": now, "iterations": it, "log": log}


# --- switching volatility
def fit_msgarch(y: np.ndarray, k: int = 2, model: str = "sGARCH", law: str = "norm", max_iter: int = 50, tol: float = 1e-4) -> dict:
    """Switching GARCH with a variance recursion of its own in each state, by EM.

    Every state's recursion runs over all rows and depends on its own parameters alone, so the M-step is a weighted
    fit a state. States are numbered by rising long-run variance.
    """
    y = np.asarray(y, float).ravel()
    y = y - y.mean()
    spec = GarchSpec(model=model, law=law)
    smooth, p, first, last, log = fit_hmm(y, k)["smooth"], start_transitions(k), np.full(k, 1 / k), -np.inf, []
    fits: list[GarchFit | None] = [None] * k
    for it in range(1, max_iter + 1):
        fits = [fit_garch(y, smooth[:, s], spec, None if f is None else f.par, iterations=30) for s, f in enumerate(fits)]
        ll = np.column_stack([spec.loglik(y, f.par, f.h) for f in fits])
        smooth, joint, now = forward_backward(ll, p, first)
        p = _rows_to_law(joint, p)
        log.append(now)
        if abs(now - last) < tol:
            break
        last = now
    rank = np.argsort([f.h.mean() for f in fits])
    grid = np.ix_(rank, rank)
    n_par = k * len(spec.names()) + k * (k - 1)
    return {"fits": [fits[i] for i in rank], "pars": [fits[i].par for i in rank], "p": p[grid], "smooth": smooth[:, rank], "path": viterbi(ll[:, rank], p[grid], first[rank]), "loglik": now, "log": log, "iterations": it, "converged": it < max_iter or len(log) > 1 and abs(log[-1] - log[-2]) < tol, "aic": 2 * n_par - 2 * now, "bic": n_par * math.log(len(y)) - 2 * now, "durations": durations(p[grid])}


def simulate_regimes(n: int, p: np.ndarray, means: list[float], sds: list[float], seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    state = np.empty(n, int)
    state[0] = 0
    for t in range(1, n):
        state[t] = rng.choice(len(p), p=p[state[t - 1]])
    return np.array(means)[state] + np.array(sds)[state] * rng.standard_normal(n), state
