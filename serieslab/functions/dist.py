"""Distributions of mean 0 and variance 1, special functions and tests, in numpy.

The laws that volatility models use: norm, std, ged and their skewed forms (snorm, sstd, sged), nig, ghyp, ghst, jsu.
skew and shape mean what the law makes of them; see LAWS for the parameters that a law has and their bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Law -> parameters: (name, start, lower, upper).
LAWS: dict[str, tuple[tuple[str, float, float, float], ...]] = {
    "norm": (),
    "std": (("shape", 8.0, 2.05, 100.0),),
    "ged": (("shape", 1.5, 0.3, 50.0),),
    "snorm": (("skew", 1.0, 0.1, 10.0),),
    "sstd": (("skew", 1.0, 0.1, 10.0), ("shape", 8.0, 2.05, 100.0)),
    "sged": (("skew", 1.0, 0.1, 10.0), ("shape", 1.5, 0.3, 50.0)),
    "nig": (("skew", 0.0, -0.99, 0.99), ("shape", 2.0, 0.1, 25.0)),
    "ghyp": (("skew", 0.0, -0.99, 0.99), ("shape", 2.0, 0.25, 25.0)),
    "ghst": (("skew", 0.0, -10.0, 10.0), ("shape", 8.0, 4.1, 50.0)),
    "jsu": (("skew", 0.0, -20.0, 20.0), ("shape", 2.0, 0.3, 10.0)),
}
GH_LAMBDA = 1.0  # of ghyp


def _ufunc(f: Callable[[float], float]) -> Callable:
    return np.vectorize(f, otypes=[float])


lgamma = _ufunc(math.lgamma)
erf = _ufunc(math.erf)


def digamma(x: float) -> float:
    """By recurrence up to 6, then the asymptotic series."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def log_bessel_k(order: float, x: np.ndarray) -> np.ndarray:
    """log K_order(x) for x > 0, by the integral of exp(-x cosh t) cosh(order t)."""
    x = np.maximum(np.asarray(x, float), 1e-10)
    top = np.arccosh(1 + 700 / x.min()) if x.size else 1.0
    t = np.linspace(0, min(top, 30.0), 400)
    e = -np.multiply.outer(x, np.cosh(t) - 1) + np.logaddexp(order * t, -order * t) - math.log(2)
    m = e.max(axis=-1, keepdims=True)
    w = np.full(len(t), t[1] - t[0])
    w[[0, -1]] /= 2
    return -x + m[..., 0] + np.log((np.exp(e - m) * w).sum(axis=-1))


# --- densities
def _log_norm(z: np.ndarray) -> np.ndarray:
    return -0.5 * (math.log(2 * math.pi) + z * z)


def _log_std(z: np.ndarray, shape: float) -> np.ndarray:
    c = math.lgamma((shape + 1) / 2) - math.lgamma(shape / 2) - 0.5 * math.log(math.pi * (shape - 2))
    return c - (shape + 1) / 2 * np.log1p(z * z / (shape - 2))


def _ged_scale(shape: float) -> float:
    return math.exp(0.5 * (-2 / shape * math.log(2) + math.lgamma(1 / shape) - math.lgamma(3 / shape)))


def _log_ged(z: np.ndarray, shape: float) -> np.ndarray:
    s = _ged_scale(shape)
    return math.log(shape) - math.log(s) - (1 + 1 / shape) * math.log(2) - math.lgamma(1 / shape) - 0.5 * np.abs(z / s) ** shape


def abs_moment(law: str, shape: float | None = None) -> float:
    """E|z| of norm, std or ged."""
    if law == "norm":
        return math.sqrt(2 / math.pi)
    if law == "std":
        return 2 * math.sqrt(shape - 2) / (shape - 1) * math.exp(math.lgamma((shape + 1) / 2) - math.lgamma(0.5) - math.lgamma(shape / 2))
    return _ged_scale(shape) * 2 ** (1 / shape) * math.exp(math.lgamma(2 / shape) - math.lgamma(1 / shape))


def _skewing(law: str, skew: float, shape: float | None) -> tuple[float, float]:
    """Mean and standard deviation that inverse scale factors on either side give a symmetric law."""
    m = abs_moment(law, shape)
    return m * (skew - 1 / skew), math.sqrt(max(1e-12, (1 - m * m) * (skew**2 + skew**-2) + 2 * m * m - 1))


def _gh_parts(skew: float, zeta: float, order: float) -> tuple[float, float, float, float]:
    """alpha, beta, delta, mu of the generalised hyperbolic law of mean 0 and variance 1."""

    def kappa(o: float) -> float:
        if o == -0.5:
            return 1 / zeta
        k = log_bessel_k(o + 1, np.array([zeta]))[0] - log_bessel_k(o, np.array([zeta]))[0]
        return math.exp(k) / zeta

    rest = 1 - skew * skew
    k0 = kappa(order)
    a2 = zeta**2 * k0 / rest * (1 + skew**2 * zeta**2 * (kappa(order + 1) - k0) / rest)
    alpha = math.sqrt(a2)
    beta = alpha * skew
    delta = zeta / (alpha * math.sqrt(rest))
    return alpha, beta, delta, -beta * delta**2 * k0


def _log_gh(z: np.ndarray, skew: float, zeta: float, order: float) -> np.ndarray:
    alpha, beta, delta, mu = _gh_parts(skew, zeta, order)
    r = np.sqrt(delta**2 + (z - mu) ** 2)
    g = math.sqrt(max(alpha**2 - beta**2, 1e-300))
    c = order * math.log(g) - 0.5 * math.log(2 * math.pi) - (order - 0.5) * math.log(alpha) - order * math.log(delta) - log_bessel_k(order, np.array([delta * g]))[0]
    return c + (order - 0.5) * np.log(r) + log_bessel_k(order - 0.5, alpha * r) + beta * (z - mu)


def _log_ghst(z: np.ndarray, skew: float, nu: float) -> np.ndarray:
    if abs(skew) < 1e-4:
        return _log_std(z, nu)
    delta = (2 * skew**2 / ((nu - 2) ** 2 * (nu - 4)) + 1 / (nu - 2)) ** -0.5
    beta = skew / delta
    d = z + beta * delta**2 / (nu - 2)
    r = np.sqrt(delta**2 + d * d)
    half = (nu + 1) / 2
    c = (1 - nu) / 2 * math.log(2) + nu * math.log(delta) + half * math.log(abs(beta)) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi)
    return c + log_bessel_k(half, abs(beta) * r) + beta * d - half * np.log(r)


def _jsu_parts(skew: float, tau: float) -> tuple[float, float, float]:
    r = 1 / tau
    w = math.exp(min(r * r, 50.0))
    omega = -skew * r
    c = (0.5 * (w - 1) * (w * math.cosh(2 * omega) + 1)) ** -0.5
    return r, c, c * math.sqrt(w) * math.sinh(omega)


def _log_jsu(z: np.ndarray, skew: float, tau: float) -> np.ndarray:
    r, c, shift = _jsu_parts(skew, tau)
    y = (z - shift) / c
    return -math.log(c) - math.log(r) - 0.5 * np.log1p(y * y) + _log_norm(-skew + np.arcsinh(y) / r)


def log_density(law: str, z: np.ndarray, skew: float | None = None, shape: float | None = None) -> np.ndarray:
    """log f(z) of a law of mean 0 and variance 1."""
    z = np.asarray(z, float)
    if law in ("snorm", "sstd", "sged"):
        base = law[1:]
        mean, sd = _skewing(base, skew, shape)
        y = z * sd + mean
        x = np.where(y < 0, y * skew, y / skew)
        return math.log(2 / (skew + 1 / skew)) + math.log(sd) + log_density(base, x, None, shape)
    if law == "norm":
        return _log_norm(z)
    if law == "std":
        return _log_std(z, shape)
    if law == "ged":
        return _log_ged(z, shape)
    if law == "nig":
        return _log_gh(z, skew, shape, -0.5)
    if law == "ghyp":
        return _log_gh(z, skew, shape, GH_LAMBDA)
    if law == "ghst":
        return _log_ghst(z, skew, shape)
    if law == "jsu":
        return _log_jsu(z, skew, shape)
    raise ValueError(f"{law!r} is none of {tuple(LAWS)}")


# --- distribution functions and quantiles
def gamma_p(a: float, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function."""

    def one(v: float) -> float:
        if v <= 0:
            return 0.0
        lead = math.exp(a * math.log(v) - v - math.lgamma(a))
        if v < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-15:
                n += 1
                term *= v / n
                total += term
            return total * lead
        b, c, d = v + 1 - a, 1e300, 1 / (v + 1 - a)
        h = d
        for i in range(1, 500):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return 1 - lead * h

    return _ufunc(one)(x)


def beta_i(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function."""

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        h = d
        for m in range(1, 500):
            for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + an * d or 1e-300)
                c = 1 + an / c or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return h

    def one(v: float) -> float:
        if v <= 0 or v >= 1:
            return float(v >= 1)
        lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(v) + b * math.log1p(-v))
        return lead * fraction(a, b, v) / a if v < (a + 1) / (a + b + 2) else 1 - lead * fraction(b, a, 1 - v) / b

    return _ufunc(one)(x)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(np.asarray(x, float) / math.sqrt(2)))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return _ufunc(NormalDist().inv_cdf)(p)


def t_cdf(x: np.ndarray, nu: float) -> np.ndarray:
    """Student's t with its own variance nu / (nu - 2)."""
    x = np.asarray(x, float)
    tail = 0.5 * beta_i(nu / 2, 0.5, nu / (nu + x * x))
    return np.where(x > 0, 1 - tail, tail)


def t_quantile(p: np.ndarray, nu: float) -> np.ndarray:
    p = np.asarray(p, float)
    grid = np.sinh(np.linspace(-14, 14, 1200))
    x = np.interp(p, t_cdf(grid, nu), grid)
    c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * nu)
    for _ in range(4):  # Newton from the interpolated value
        most = 0.1 * np.abs(x) + 0.1
        x = x - np.clip((t_cdf(x, nu) - p) / np.exp(c - (nu + 1) / 2 * np.log1p(x * x / nu)), -most, most)
    return x


def chi2_sf(x: float, df: float) -> float:
    return float(1 - gamma_p(df / 2, np.array(x / 2)))


def chi2_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, df + 50 * math.sqrt(2 * df) + 50
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(df / 2, np.array(mid / 2)) < p else (lo, mid)
    return (lo + hi) / 2


def geometric_pmf(k: np.ndarray, p: float) -> np.ndarray:
    """k failures before the first success."""
    return p * (1 - p) ** np.asarray(k, float)


def geometric_quantile(q: float, p: float) -> int:
    return max(0, math.ceil(math.log(1 - q) / math.log(1 - p)) - 1)


def cdf(law: str, z: np.ndarray, skew: float | None = None, shape: float | None = None) -> np.ndarray:
    """F(z) of a law of mean 0 and variance 1."""
    z = np.asarray(z, float)
    if law == "norm":
        return normal_cdf(z)
    if law == "std":
        return t_cdf(z * math.sqrt(shape / (shape - 2)), shape)
    if law == "ged":
        return 0.5 + 0.5 * np.sign(z) * gamma_p(1 / shape, 0.5 * np.abs(z / _ged_scale(shape)) ** shape)
    if law in ("snorm", "sstd", "sged"):
        base = law[1:]
        mean, sd = _skewing(base, skew, shape)
        y = z * sd + mean
        x = np.where(y < 0, y * skew, y / skew)
        lead = 2 / (skew + 1 / skew)
        f = cdf(base, x, None, shape)
        return np.where(y < 0, lead * f / skew, 1 - lead * skew * (1 - f))
    if law == "jsu":
        r, c, shift = _jsu_parts(skew, shape)
        return normal_cdf(-skew + np.arcsinh((z - shift) / c) / r)
    # nig, ghyp, ghst: the density summed over a fine grid
    grid = np.linspace(-30, 30, 12001)
    d = np.exp(log_density(law, grid, skew, shape))
    f = np.r_[0, np.cumsum((d[1:] + d[:-1]) / 2) * (grid[1] - grid[0])]
    return np.interp(z, grid, f / f[-1])


def _invert(f: Callable[[np.ndarray], np.ndarray], p: np.ndarray) -> np.ndarray:
    """Bisection of an increasing function, from brackets that grow until they hold p."""
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, -8.0), np.full(p.shape, 8.0)
    for _ in range(60):
        low, high = f(lo) > p, f(hi) < p
        if not low.any() and not high.any():
            break
        lo, hi = np.where(low, lo * 2, lo), np.where(high, hi * 2, hi)
    for _ in range(80):
        mid = (lo + hi) / 2
        up = f(mid) < p
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def quantile(law: str, p: np.ndarray, skew: float | None = None, shape: float | None = None) -> np.ndarray:
    return normal_quantile(p) if law == "norm" else _invert(lambda x: cdf(law, x, skew, shape), p)


def draw(law: str, rng: np.random.Generator, size: int | tuple[int, ...], skew: float | None = None, shape: float | None = None) -> np.ndarray:
    """Draws of mean 0 and variance 1."""
    if law == "norm":
        return rng.standard_normal(size)
    if law == "std":
        return rng.standard_t(shape, size) * math.sqrt((shape - 2) / shape)
    return quantile(law, rng.uniform(1e-9, 1 - 1e-9, size), skew, shape)


# --- tests
def autocorrelations(x: np.ndarray, lags: int) -> np.ndarray:
    d = np.asarray(x, float) - np.mean(x)
    total = (d * d).sum()
    return np.array([(d[i:] * d[:-i]).sum() for i in range(1, lags + 1)]) / total if total > 0 else np.zeros(lags)


def ljung_box(x: np.ndarray, lags: int = 10) -> tuple[float, float]:
    """(statistic, p value)."""
    n, r = len(x), autocorrelations(x, lags)
    q = float(n * (n + 2) * (r**2 / (n - np.arange(1, lags + 1))).sum())
    return q, chi2_sf(q, lags)


def moments(x: np.ndarray) -> dict[str, float]:
    """mean, sd, skewness and excess kurtosis; the moments are the population's over powers of the sample's sd."""
    x = np.asarray(x, float)
    d, s = x - x.mean(), x.std(ddof=1) if len(x) > 1 else 0.0
    return {"mean": float(x.mean()), "sd": float(s), "skewness": float((d**3).mean() / s**3) if s else 0.0, "kurtosis": float((d**4).mean() / s**4 - 3) if s else 0.0}


def excess_kurtosis(x: np.ndarray) -> float:
    """m4 / m2^2 - 3 of the population."""
    d = np.asarray(x, float) - np.mean(x)
    m2 = (d * d).mean()
    return float((d**4).mean() / m2**2 - 3) if m2 > 0 else 0.0


# Royston's polynomials for the Shapiro-Wilk test (Applied Statistics algorithm R94).
SW_A1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SW_A2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SW_MEAN_SMALL = (0.544, -0.39978, 0.025054, -6.714e-4)
SW_SD_SMALL = (1.3822, -0.77857, 0.062767, -0.0020322)
SW_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
SW_SD = (-0.4803, -0.082676, 0.0030302)
SW_GAMMA = (-2.273, 0.459)


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """(W, p value) for 3 to 5000 values."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if not 3 <= n <= 5000:
        raise ValueError("Shapiro-Wilk needs 3 to 5000 values")
    d = x - x.mean()
    if (d * d).sum() == 0:
        return 1.0, 1.0
    poly = lambda c, v: float(np.polyval(c[::-1], v))
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        m = normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
        total, u = float(m @ m), 1 / math.sqrt(n)
        last = m[-1] / math.sqrt(total) + poly(SW_A1, u)
        a = np.zeros(n)
        if n > 5:
            before = m[-2] / math.sqrt(total) + poly(SW_A2, u)
            phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2], a[1] = before, -before
        else:
            phi = (total - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[-1], a[0] = last, -last
    w = min(1.0, float((a @ x) ** 2 / (d @ d)))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        g = poly(SW_GAMMA, n)
        if y >= g:
            return w, 1e-99
        y, mean, sd = -math.log(g - y), poly(SW_MEAN_SMALL, n), math.exp(poly(SW_SD_SMALL, n))
    else:
        v = math.log(n)
        mean, sd = poly(SW_MEAN, v), math.exp(poly(SW_SD, v))
    return w, float(1 - normal_cdf(np.array((y - mean) / sd)))
