"""Minimisers and derivatives for models of a few parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: What a likelihood outside its domain counts as.
PENALTY = 1e10


def minimise(f: Callable[[np.ndarray], float], x0: np.ndarray, step: float = 0.1, iterations: int = 600, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Nelder-Mead from x0, begun anew from its result until that no longer helps; for functions without a gradient."""

    def value(x: np.ndarray) -> float:
        v = f(x)
        return v if np.isfinite(v) else 1e12

    best, fbest = np.asarray(x0, float), value(np.asarray(x0, float))
    for _ in range(3):
        pts = np.vstack([best, best + np.eye(len(best)) * step * (np.abs(best)[:, None] + 0.1)])
        vals = np.array([value(p) for p in pts])
        for _ in range(iterations):
            order = vals.argsort()
            pts, vals = pts[order], vals[order]
            if vals[-1] - vals[0] < tol * (abs(vals[0]) + tol):
                break
            centre = pts[:-1].mean(axis=0)
            r = 2 * centre - pts[-1]
            fr = value(r)
            if fr < vals[0]:
                e = 3 * centre - 2 * pts[-1]
                fe = value(e)
                pts[-1], vals[-1] = (e, fe) if fe < fr else (r, fr)
            elif fr < vals[-2]:
                pts[-1], vals[-1] = r, fr
            else:
                c = (centre + (r if fr < vals[-1] else pts[-1])) / 2
                fc = value(c)
                if fc < min(fr, vals[-1]):
                    pts[-1], vals[-1] = c, fc
                else:
                    pts[1:] = (pts[1:] + pts[0]) / 2
                    vals[1:] = [value(p) for p in pts[1:]]
        k = vals.argmin()
        gain, best, fbest = fbest - vals[k], pts[k].copy(), vals[k]
        if gain < tol * (abs(fbest) + 1):
            break
    return best, float(fbest)


def gradient(f: Callable, x: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Central differences."""
    h = eps * np.maximum(1, np.abs(x))
    return np.array([(f(x + e) - f(x - e)) / (2 * d) for e, d in zip(np.diag(h), h, strict=True)])


def _inside(f: Callable, x: np.ndarray, lower: np.ndarray, upper: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Differences that stay in the box: central where there is room, else one-sided."""
    h = eps * np.maximum(1e-2, np.abs(x))
    out = np.empty(len(x))
    for i in range(len(x)):
        a, b = x.copy(), x.copy()
        a[i], b[i] = max(lower[i], x[i] - h[i]), min(upper[i], x[i] + h[i])
        out[i] = (f(b) - f(a)) / (b[i] - a[i]) if b[i] > a[i] else 0.0
    return out


def minimise_box(f: Callable[[np.ndarray], float], x0: np.ndarray, lower: np.ndarray, upper: np.ndarray, grad: Callable[[np.ndarray], np.ndarray] | None = None, iterations: int = 200, tol: float = 1e-8, trace: list | None = None) -> dict:
    """Projected BFGS inside a box: x, value, converged and iterations.

    Coordinates held by a bound leave the quasi-Newton step; the others search along the projected path, halving until
    the Armijo condition holds. `trace` gets every accepted point.
    """
    lower, upper = np.asarray(lower, float), np.asarray(upper, float)

    def value(x: np.ndarray) -> float:
        v = f(x)
        return float(v) if np.isfinite(v) else PENALTY

    slope = grad or (lambda x: _inside(value, x, lower, upper))
    x = np.clip(np.asarray(x0, float), lower, upper)
    fx, g, inv, converged, it = value(x), slope(x), np.eye(len(x)), False, 0
    scale = 1.0 / max(1.0, float(np.abs(g).max()))
    inv *= scale
    if trace is not None:
        trace.append((x.copy(), fx))
    for it in range(1, iterations + 1):
        held = ((x <= lower) & (g > 0)) | ((x >= upper) & (g < 0))
        free = ~held
        if not free.any() or np.abs(np.clip(x - g, lower, upper) - x).max() < tol:
            converged = True
            break
        d = np.zeros(len(x))
        d[free] = -inv[np.ix_(free, free)] @ g[free]
        if d @ g >= 0:
            inv = np.eye(len(x)) * scale
            d[free] = -scale * g[free]
        step, moved = 1.0, False
        for _ in range(40):
            new = np.clip(x + step * d, lower, upper)
            fn = value(new)
            if fn <= fx + 1e-4 * g @ (new - x) and fn < PENALTY:
                moved = True
                break
            step /= 2
        if not moved:
            if np.allclose(inv, np.eye(len(x)) * scale):
                converged = True  # no descent is left along the gradient
                break
            inv = np.eye(len(x)) * scale
            continue
        gn = slope(new)
        s, y = new - x, gn - g
        gain = fx - fn
        sy = s @ y
        if sy > 1e-12:
            if it == 1:
                inv = np.eye(len(x)) * sy / (y @ y)
            r = 1 / sy
            left = np.eye(len(x)) - r * np.outer(s, y)
            inv = left @ inv @ left.T + r * np.outer(s, s)
        x, fx, g = new, fn, gn
        if trace is not None:
            trace.append((x.copy(), fx))
        if gain < tol * (abs(fx) + tol) and np.abs(s).max() < 1e-6 * (1 + np.abs(x).max()):
            converged = True
            break
    return {"x": x, "value": fx, "converged": converged, "iterations": it}


def minimise_scalar(f: Callable[[float], float], a: float, b: float, tol: float = 1e-6) -> tuple[float, float]:
    """Golden-section search with parabolic steps where they stay inside (Brent): (x, f(x))."""
    gold = (3 - 5**0.5) / 2
    x = w = v = a + gold * (b - a)
    fx = fw = fv = f(x)
    d = e = 0.0
    for _ in range(200):
        m = (a + b) / 2
        t = tol * abs(x) + 1e-12
        if abs(x - m) <= 2 * t - (b - a) / 2:
            break
        p = q = 0.0
        if abs(e) > t:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p if q > 0 else p), abs(q)
        if q and abs(p) < abs(q * e / 2) and q * (a - x) < p < q * (b - x):
            e, d = d, p / q
        else:
            e = (b if x < m else a) - x
            d = gold * e
        u = x + (d if abs(d) >= t else (t if d > 0 else -t))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return float(x), float(fx)


def plain_hessian(f: Callable, x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Second differences over four points."""
    x = np.asarray(x, float)
    h = eps * np.maximum(1, np.abs(x))
    n = len(x)
    out = np.empty((n, n))
    for i in range(n):
        for j in range(i, n):
            a, b = np.zeros(n), np.zeros(n)
            a[i], b[j] = h[i], h[j]
            out[i, j] = out[j, i] = (f(x + a + b) - f(x + a - b) - f(x - a + b) + f(x - a - b)) / (4 * h[i] * h[j])
    return out


def hessian(f: Callable, x: np.ndarray, eps: float = 1e-4, ratio: float = 2.0) -> np.ndarray:
    """plain_hessian, extrapolated once from the steps eps x ratio and eps (Richardson)."""
    r = ratio * ratio
    return (r * plain_hessian(f, x, eps) - plain_hessian(f, x, eps * ratio)) / (r - 1)


def standard_errors(f: Callable, x: np.ndarray, scores: np.ndarray | None = None) -> np.ndarray:
    """From the Hessian of a negative log-likelihood; the sandwich form if per-row scores are given. NaN where undefined."""
    try:
        inv = np.linalg.inv(hessian(f, x))
    except np.linalg.LinAlgError:
        return np.full(len(x), np.nan)
    cov = inv if scores is None else inv @ (scores.T @ scores) @ inv
    d = np.diag(cov)
    return np.sqrt(np.where(d > 0, d, np.nan))


def profile(f: Callable, x: np.ndarray, k: int, at: np.ndarray, refit: bool = True, lower: np.ndarray | None = None, upper: np.ndarray | None = None) -> np.ndarray:
    """f along parameter k, the others minimised anew at each point (from the last point's) or held."""
    rest = [i for i in range(len(x)) if i != k]
    out, y = np.empty(len(at)), np.array(x, float)
    for n, v in enumerate(at):
        y[k] = v
        if refit and rest:

            def g(z: np.ndarray, y: np.ndarray = y) -> float:
                w = y.copy()
                w[rest] = z
                return f(w)

            if lower is not None and upper is not None:
                y[rest] = minimise_box(g, y[rest], np.asarray(lower)[rest], np.asarray(upper)[rest], iterations=40)["x"]
            else:
                y[rest] = minimise(g, y[rest], iterations=120)[0]
        out[n] = f(y)
    return out


def crossings(at: np.ndarray, rise: np.ndarray, centre: float, drop: float) -> tuple[float, float]:
    """Where a profile's rise reaches `drop` on either side of the centre, interpolated between points; the outermost point if it does not."""
    order = np.argsort(at)
    at, rise = at[order], rise[order]
    ends = []
    for side in (at < centre, at > centre):
        xs, ys = at[side], rise[side]
        if side[0]:
            xs, ys = xs[::-1], ys[::-1]
        last, lv, end = centre, 0.0, None
        for v, r in zip(xs, ys, strict=True):
            if r >= drop:
                end = last + (v - last) * (drop - lv) / (r - lv) if np.isfinite(r) and r > lv else v
                break
            last, lv = v, r
        ends.append(float(last if end is None else end))
    return ends[0], ends[1]


def profile_interval(f: Callable, x: np.ndarray, k: int, drop: float = 3.841458820694124 / 2, span: float = 0.5, points: int = 41, refit: bool = True) -> tuple[float, float]:
    """Where the profile of parameter k rises by `drop` (half the 95 % chi-square); the others are refitted or held."""
    base, ends = f(x), []
    for sign in (-1, 1):
        at = x[k] + sign * np.linspace(0, span * max(abs(x[k]), 0.05), points)[1:]
        last, lv, y = x[k], 0.0, np.array(x, float)
        for v in at:
            r = float(profile(f, y, k, np.array([v]), refit)[0]) - base
            if r >= drop:
                last += (v - last) * (drop - lv) / (r - lv)
                break
            last, lv = v, r
        ends.append(float(last))
    return ends[0], ends[1]
