"""Vectorised incomplete gamma for discretising rate distributions inside tasks."""

from __future__ import annotations

import numpy as np

# fixed values: Bernoulli numbers B(2k) / (2k (2k - 1)) of the asymptotic series of log gamma
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
#: The series is used from here on; smaller arguments are moved up by the recurrence.
SERIES_FROM = 10
#: Smallest logarithm of a quantile: its exponential is still a normal number.
LOWEST = -700.0


def log_gamma(a: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive arguments."""
    a = np.asarray(a, float)
    moved = np.log(a[..., None] + np.arange(SERIES_FROM)).sum(axis=-1)
    z = a + SERIES_FROM
    series = sum(c / z ** (2 * k + 1) for k, c in enumerate(STIRLING))
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - moved


def lower_regularised(a: np.ndarray, x: np.ndarray, log_g: np.ndarray | None = None) -> np.ndarray:
    """P(a, x): power series left of a + 1, continued fraction right of it.

    ``log_g`` is log gamma of ``a``, for callers that ask for the same ``a`` again and again.
    """
    log_g = log_gamma(a) if log_g is None else log_g
    a, x, log_g = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float), log_g)
    out = np.zeros(a.shape)
    finite = np.isfinite(x)
    out[~finite] = 1.0
    left = finite & (x > 0) & (x < a + 1)
    if left.any():
        al, xl = a[left], x[left]
        term = 1.0 / al
        total, d = term.copy(), al.copy()
        for _ in range(1000):
            d += 1
            term = term * xl / d
            total += term
            if np.all(term <= total * 1e-16):
                break
        out[left] = total * np.exp(-xl + al * np.log(xl) - log_g[left])
    right = finite & (x >= a + 1)
    if right.any():
        ar, xr = a[right], x[right]
        tiny = 1e-300
        b = xr + 1 - ar
        c = np.full_like(b, 1 / tiny)
        d = 1 / b
        h = d.copy()
        for i in range(1, 1000):
            an = -i * (i - ar)
            b = b + 2
            d = an * d + b
            d = np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / d
            delta = d * c
            h *= delta
            if np.all(np.abs(delta - 1) < 1e-15):
                break
        out[right] = 1 - h * np.exp(-xr + ar * np.log(xr) - log_g[right])
    return out


def quantile(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """x with P(a, x) = p, for p strictly between 0 and 1.

    Newton steps for log P over log x, which is concave; a step that leaves the bracket is replaced
    by halving the bracket. Quantiles below the smallest normal number are set to exp(LOWEST).
    """
    log_g = log_gamma(a)
    a, p, log_g = np.broadcast_arrays(np.asarray(a, float), np.asarray(p, float), log_g)
    lo = np.full(a.shape, LOWEST)
    hi = np.log(a + 50 * np.sqrt(a) + 100)
    # the first term of the power series, exact for small quantiles
    u = np.clip((np.log(p) + log_g + np.log(a)) / a, lo, hi)
    for _ in range(200):
        x = np.exp(u)
        reached = lower_regularised(a, x, log_g)
        below = reached < p
        lo, hi = np.where(below, u, lo), np.where(below, hi, u)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            slope = np.exp(a * u - x - log_g) / reached
            step = u - (np.log(reached) - np.log(p)) / slope
        inside = np.isfinite(step) & (step > lo) & (step < hi)
        after = np.where(inside, step, (lo + hi) / 2)
        settled = np.abs(after - u) <= 4e-16 * np.maximum(np.abs(u), 1.0)
        u = after
        if settled.all():
            break
    return np.exp(u)


def gamma_category_means(
    alpha: np.ndarray, n: int, bounds: list[float] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Conditional means and shares of the classes of a mean-one gamma, one row per alpha."""
    alpha = np.asarray(alpha, float)[:, None]
    if bounds is None:
        inner = quantile(alpha, np.arange(1, n)[None, :] / n) if n > 1 else np.empty((len(alpha), 0))
        edges = np.hstack([np.zeros_like(alpha), inner, np.full_like(alpha, np.inf)])
    else:
        edges = alpha * np.asarray(bounds, float)[None, :]
    log_g = log_gamma(alpha)
    share = np.diff(lower_regularised(alpha, edges, log_g), axis=1)
    mean = np.diff(lower_regularised(alpha + 1, edges, log_g + np.log(alpha)), axis=1) / share
    return mean, share / share.sum(axis=1, keepdims=True)
