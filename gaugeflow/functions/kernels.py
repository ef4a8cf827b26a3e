"""Sequential statistics in numpy, for grouped Python functions. Each takes one ordered series.

Written from the literature: MacKinnon (1996) response surfaces, Kwiatkowski et al. (1992), Hobijn et al. (2004),
Cleveland et al. (1990), Killick et al. (2012), Monahan (1984), Durbin and Koopman's Kalman filter.
"""

from __future__ import annotations

import math

import numpy as np


# -- dependence ---------------------------------------------------------------------------------

def acf(x: np.ndarray, lags: int) -> np.ndarray:
    """Biased autocorrelations 0..lags; 1 then null when constant."""
    x = np.asarray(x, float) - np.mean(x)
    v = float(x @ x)
    return np.array([1.0, *([math.nan] * lags)]) if v == 0 else np.array([float(x[: len(x) - k] @ x[k:]) / v for k in range(lags + 1)])


def pacf(x: np.ndarray, lags: int) -> np.ndarray:
    """Partial autocorrelations by Levinson-Durbin on the biased autocorrelations."""
    r, out, phi, v = acf(x, lags), [1.0], np.empty(0), 1.0
    for k in range(1, lags + 1):
        a = (r[k] - phi @ r[k - 1 : 0 : -1]) / v if k > 1 else r[1]
        phi = np.append(phi - a * phi[::-1], a)
        v *= 1 - a * a
        out.append(a)
    return np.array(out)


def chi2_tail(q: float, k: int) -> float:
    """P(X > q) for k degrees of freedom: regularised upper incomplete gamma."""
    a, x = k / 2.0, q / 2.0
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def ljung_box(x: np.ndarray, lags: int) -> tuple[float, float]:
    n, r = len(x), acf(x, lags)
    q = n * (n + 2) * float(np.sum(r[1:] ** 2 / (n - np.arange(1, lags + 1))))
    return q, chi2_tail(q, lags)


# -- stationarity -------------------------------------------------------------------------------

def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = float(np.sum((y - x @ beta) ** 2))
    se = np.sqrt(np.diag(np.linalg.pinv(x.T @ x)) * rss / (len(y) - x.shape[1]))
    return beta, se, rss


#: MacKinnon's surface for a constant, one series: normal quantile as a polynomial of tau, on both sides of tau*.
_TAU_MAX, _TAU_MIN, _TAU_STAR = 2.74, -18.83, -1.61
_SMALL_P = (2.1659, 1.4412, 0.038269)
_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p(tau: float) -> float:
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    z = sum(c * tau**i for i, c in enumerate(_SMALL_P if tau <= _TAU_STAR else _LARGE_P))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf(x: np.ndarray) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller with a constant, lag by AIC on a common sample: (tau, p, lag)."""
    x = np.asarray(x, float)
    d, n = np.diff(x), len(x)
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))

    def design(lag: int, start: int):
        rows = np.arange(start, len(d))
        return d[rows], np.column_stack([x[rows], *[d[rows - i] for i in range(1, lag + 1)], np.ones(len(rows))])

    def aic(lag: int) -> float:
        y, m = design(lag, most)
        rss = max(_ols(y, m)[2], 1e-300)
        return len(y) * (math.log(2 * math.pi) + math.log(rss / len(y)) + 1) + 2 * m.shape[1]

    lag = min(range(most + 1), key=lambda k: (aic(k), k))
    beta, se, _ = _ols(*design(lag, lag))
    tau = float(beta[0] / se[0])
    return tau, adf_p(tau), lag


#: The 1992 table of critical values for level stationarity.
_KPSS_CRITICAL, _KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def kpss(x: np.ndarray) -> tuple[float, float, int]:
    """Level stationarity with Hobijn's automatic bandwidth: (statistic, p clipped to the table, lag)."""
    e = np.asarray(x, float) - np.mean(x)
    n = len(e)
    m = int(n ** (2 / 9))
    s0, s1 = float(e @ e) / n, 0.0
    for i in range(1, m + 1):
        c = 2 * float(e[i:] @ e[: n - i]) / n
        s0 += c
        s1 += i * c
    g = 1.1447 * ((s1 / s0) ** 2) ** (1 / 3) if s0 else 0.0
    lag = min(int(g * n ** (1 / 3)), n - 1)
    s = float(e @ e) / n + sum(2 * (1 - i / (lag + 1)) * float(e[i:] @ e[: n - i]) / n for i in range(1, lag + 1))
    stat = float(np.sum(np.cumsum(e) ** 2)) / (n * n * s)
    return stat, float(np.interp(stat, _KPSS_CRITICAL, _KPSS_P)), lag


def stationarity_label(p_adf: float, p_kpss: float) -> str:
    if p_adf < 0.05 and p_kpss >= 0.05:
        return "stationary"
    return "nonstationary" if p_adf >= 0.05 and p_kpss < 0.05 else "inconclusive"


# -- decomposition ------------------------------------------------------------------------------

def _loess(y: np.ndarray, width: int, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Local lines on 0..n-1 at the points `at`, tricube weights times robustness."""
    n = len(y)
    place, out = np.arange(n, dtype=float), np.empty(len(at))
    k = min(width, n)
    for i, p in enumerate(at):
        lo = int(np.clip(round(p) - k // 2, 0, n - k))
        while lo + k < n and abs(place[lo] - p) > abs(place[lo + k] - p):
            lo += 1
        while lo > 0 and abs(place[lo + k - 1] - p) > abs(place[lo - 1] - p):
            lo -= 1
        s = slice(lo, lo + k)
        h = max(abs(place[lo] - p), abs(place[lo + k - 1] - p)) + (max(0, width - n) // 2)
        w = np.clip(1 - (np.abs(place[s] - p) / max(h * 1.0001, 1e-9)) ** 3, 0, 1) ** 3 * weights[s]
        if w.sum() <= 0:
            out[i] = y[int(np.clip(round(p), 0, n - 1))]
            continue
        w /= w.sum()
        mx, my = w @ place[s], w @ y[s]
        var = w @ (place[s] - mx) ** 2
        out[i] = my + (w @ ((place[s] - mx) * (y[s] - my)) / var * (p - mx) if var > 1e-9 else 0.0)
    return out


def _moving(x: np.ndarray, k: int) -> np.ndarray:
    c = np.cumsum(np.insert(x, 0, 0.0))
    return (c[k:] - c[:-k]) / k


def stl(y: np.ndarray, period: int, seasonal: int = 7, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal, trend and remainder; they add up to y."""
    y = np.asarray(y, float)
    n = len(y)
    odd = lambda v: int(v) + (int(v) % 2 == 0)
    trend_width, low_width = odd(math.ceil(1.5 * period / (1 - 1.5 / seasonal))), odd(period + (period % 2 == 0))
    weights, trend, season = np.ones(n), np.zeros(n), np.zeros(n)
    place = np.arange(n, dtype=float)
    step = max(1, trend_width // 10)
    knots = np.unique(np.append(np.arange(0, n, step), n - 1)).astype(float)
    for _ in range(16 if robust else 1):
        for _ in range(1 if robust else 2):
            d = y - trend
            cycle = np.empty(n + 2 * period)
            for p in range(period):
                sub = d[p::period]
                cycle[p::period][: len(sub) + 2] = _loess(sub, seasonal, np.arange(-1, len(sub) + 1, dtype=float), weights[p::period])
            low = _moving(_moving(_moving(cycle, period), period), 3)
            low = np.interp(place, knots, _loess(low, low_width, knots, np.ones(n)))
            season = cycle[period : period + n] - low
            trend = np.interp(place, knots, _loess(y - season, trend_width, knots, weights))
        if robust:
            r = np.abs(y - season - trend)
            h = 6 * np.median(r)
            weights = np.clip(1 - (r / h) ** 2, 0, 1) ** 2 if h > 0 else np.ones(n)
    return season, trend, y - season - trend


def strengths(season: np.ndarray, trend: np.ndarray, rest: np.ndarray) -> tuple[float, float]:
    v = lambda a: float(np.var(a, ddof=1))
    share = lambda part: max(0.0, 1 - v(rest) / v(rest + part)) if v(rest + part) > 0 else math.nan
    return share(season), share(trend)


# -- bootstrap ----------------------------------------------------------------------------------

def _blocks(rng: np.random.Generator, n: int, block: int) -> np.ndarray:
    starts = rng.choice(n - block + 1, size=math.ceil(n / block), replace=True)
    return (starts[:, None] + np.arange(block)).ravel()[:n]


def block_bootstrap_corr(x: np.ndarray, y: np.ndarray, block: int = 30, draws: int = 500, seed: int = 170) -> tuple[float, float]:
    """Central 95 % of correlations over moving blocks; null when short or constant."""
    n = len(x)
    block = min(block, max(2, n // 4))
    if n < max(20, 2 * block) or np.std(x) == 0 or np.std(y) == 0:
        return math.nan, math.nan
    rng, found = np.random.default_rng(seed), []
    for _ in range(draws):
        k = _blocks(rng, n, block)
        if np.std(x[k]) > 0 and np.std(y[k]) > 0:
            found.append(np.corrcoef(x[k], y[k])[0, 1])
    return tuple(map(float, np.quantile(found, [0.025, 0.975]))) if found else (math.nan, math.nan)


def block_bootstrap_mean(x: np.ndarray, block: int = 3, draws: int = 1000, seed: int = 170) -> tuple[float, float]:
    n = len(x)
    if n < max(10, 2 * block):
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    return tuple(map(float, np.quantile([x[_blocks(rng, n, block)].mean() for _ in range(draws)], [0.025, 0.975])))


# -- changepoints -------------------------------------------------------------------------------

class _Cost:
    """Squared error about the mean of [a, b) in constant time."""

    def __init__(self, x: np.ndarray):
        x = np.asarray(x, float) - np.mean(x)
        self.s, self.q = np.insert(np.cumsum(x), 0, 0.0), np.insert(np.cumsum(x * x), 0, 0.0)

    def __call__(self, a, b):
        return self.q[b] - self.q[a] - (self.s[b] - self.s[a]) ** 2 / (b - a)


def pelt(x: np.ndarray, penalty: float, least: int = 30) -> list[int]:
    """Exact optimal partition with pruning; ends of segments without the last."""
    n, cost = len(x), _Cost(x)
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    starts = np.array([0])
    for t in range(least, n + 1):
        open_ = starts[t - starts >= least]
        value = best[open_] + cost(open_, t) + penalty
        k = int(np.argmin(value))
        best[t], last[t] = value[k], open_[k]
        keep = np.isin(starts, open_[value - penalty <= best[t]]) | (t - starts < least)
        starts = np.append(starts[keep], t - least + 1) if t - least + 1 >= least else starts[keep]
    out, t = [], n
    while t > 0 and last[t] > 0:
        out.append(int(t := last[t]))
    return sorted(out)


def binary_segmentation(x: np.ndarray, breaks: int, least: int = 30) -> list[int]:
    """The greedy splits of largest gain."""
    cost, cuts = _Cost(x), [0, len(x)]
    for _ in range(breaks):
        best = (-np.inf, -1)
        for a, b in zip(cuts, cuts[1:]):
            k = np.arange(a + least, b - least + 1)
            if len(k):
                gain = cost(a, b) - cost(a, k) - cost(k, b)
                i = int(np.argmax(gain))
                best = max(best, (float(gain[i]), -int(k[i])))
        if best[1] >= 0 or not np.isfinite(best[0]):
            break
        cuts = sorted([*cuts, -best[1]])
    return cuts[1:-1]


# -- ARIMA --------------------------------------------------------------------------------------

def _stationary(raw: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary AR polynomial from free numbers, by partial autocorrelations."""
    phi = np.empty(0)
    for a in raw / np.sqrt(1 + raw * raw):
        phi = np.append(phi - a * phi[::-1], a)
    return phi


def _polynomials(spec: tuple[int, int, int, int], theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q, seasonal, period = spec
    ar = np.append(1.0, -_stationary(theta[:p]))
    ma = np.append(1.0, -_stationary(theta[p : p + q]))
    if seasonal:
        s = np.zeros(period * seasonal + 1)
        s[0], s[period::period] = 1.0, -_stationary(theta[p + q : p + q + seasonal])
        ar = np.convolve(ar, s)
    return -ar[1:], ma[1:]


def _filter(y: np.ndarray, mean: float, ar: np.ndarray, ma: np.ndarray) -> tuple[float, float, int, np.ndarray, np.ndarray]:
    """Concentrated exact likelihood with missing values; (log-likelihood, variance, n, state, its covariance) for variance 1."""
    r = max(len(ar), len(ma) + 1, 1)
    t = np.zeros((r, r))
    t[: len(ar), 0] = ar
    t[:-1, 1:] += np.eye(r - 1)
    h = np.zeros(r)
    h[0] = 1.0
    h[1 : 1 + len(ma)] = ma
    q = np.outer(h, h)
    p = np.linalg.solve(np.eye(r * r) - np.kron(t, t), q.ravel()).reshape(r, r) if r <= 3 else _lyapunov(t, q)
    a, logs, sse, n = np.zeros(r), 0.0, 0.0, 0
    for v in y:
        if v == v:
            f = p[0, 0]
            e = v - mean - a[0]
            logs += math.log(f)
            sse += e * e / f
            n += 1
            k = p[:, 0] / f
            a = a + k * e
            p = p - np.outer(k, p[0])
        a = t @ a
        p = t @ p @ t.T + q
    var = max(sse / max(n, 1), 1e-300)
    return -0.5 * (n * math.log(2 * math.pi * var) + logs + n), var, n, a, p


def _losses(y: np.ndarray, seen: np.ndarray, spec: tuple[int, int, int, int], xs: np.ndarray) -> np.ndarray:
    """Minus the mean log-likelihood at several parameter vectors at once, as _filter has it. While observations follow each other the covariance
    settles, and is then left alone until the next gap."""
    polynomials = [_polynomials(spec, x[1:]) for x in xs]
    size = max(max(len(ar), len(ma) + 1, 1) for ar, ma in polynomials)
    b = len(xs)
    ar, h, p, t = np.zeros((b, size)), np.zeros((b, size)), np.zeros((b, size, size)), np.zeros((b, size, size))
    for i, (phi, theta) in enumerate(polynomials):
        ar[i, : len(phi)], h[i, 0], h[i, 1 : 1 + len(theta)] = phi, 1.0, theta
        t[i, :, 0] = ar[i]
        t[i, :-1, 1:] += np.eye(size - 1)
        q = np.outer(h[i], h[i])
        p[i] = np.linalg.solve(np.eye(size * size) - np.kron(t[i], t[i]), q.ravel()).reshape(size, size) if size <= 3 else _lyapunov(t[i], q)
    q, tt = h[:, :, None] * h[:, None, :], np.swapaxes(t, 1, 2)
    a, logs, sse, n, steady = np.zeros((b, size)), np.zeros(b), np.zeros(b), 0, False
    f = logf = k = np.zeros(b)
    for v, there in zip((y[:, None] - xs[:, 0]), seen):
        if there:
            n += 1
            if not steady:
                f = p[:, 0, 0].copy()
                logf, k = np.log(f), p[:, :, 0] / f[:, None]
            e = v - a[:, 0]
            logs += logf
            sse += e * e / f
            a = a + k * e[:, None]
        out = ar * a[:, :1]
        out[:, :-1] += a[:, 1:]
        a = out
        if there and steady:
            continue
        new = t @ (p - k[:, :, None] * p[:, :1, :] if there else p) @ tt + q
        steady = there and bool(np.abs(new - p).max() < 1e-13 * np.abs(new).max())
        p = new
    var = np.maximum(sse / max(n, 1), 1e-300)
    return 0.5 * (n * np.log(2 * math.pi * var) + logs + n) / n


def _lyapunov(t: np.ndarray, q: np.ndarray) -> np.ndarray:
    p, m = q.copy(), t.copy()
    for _ in range(60):
        step = m @ p @ m.T
        p = p + step
        m = m @ m
        if np.abs(step).max() <= 1e-13 * max(1.0, np.abs(p).max()):
            break
    return p


def arima_forecast(y: np.ndarray, spec: tuple[int, int, int, int], steps: int = 7, max_iterations: int = 100) -> dict | None:
    """Fit (p, q, seasonal p, period) with a mean by exact likelihood, missing values kept missing, and forecast. Null mean where it fails."""
    y = np.asarray(y, float)
    seen = y[np.isfinite(y)]
    if len(seen) < 10 or np.std(seen) == 0:
        return None
    scale, centre = float(np.std(seen)), float(np.mean(seen))
    z, k = (y - centre) / scale, spec[0] + spec[1] + spec[2]

    there = np.isfinite(z)

    def loss(x: np.ndarray) -> float:
        return float(_losses(z, there, spec, x[None, :])[0])

    def slope(x: np.ndarray) -> np.ndarray:
        e = np.eye(len(x)) * 1e-5
        both = _losses(z, there, spec, np.concatenate([x + e, x - e]))
        return (both[: len(x)] - both[len(x) :]) / 2e-5

    x, inverse, converged = np.concatenate([[0.0], np.full(k, 0.1)]), np.eye(k + 1), False
    fx, g = loss(x), slope(x)
    for _ in range(max_iterations):  # BFGS with backtracking
        if np.abs(g).max() < 1e-6:
            converged = True
            break
        d = -inverse @ g
        if d @ g >= 0:
            inverse, d = np.eye(k + 1), -g
        step = 1.0
        while step > 1e-10 and not (fn := loss(x + step * d)) <= fx + 1e-4 * step * (d @ g):
            step /= 2
        if step <= 1e-10:
            converged = np.abs(g).max() < 1e-3
            break
        s = step * d
        gn = slope(x + s)
        u = gn - g
        if (su := s @ u) > 1e-12:
            m = np.eye(k + 1) - np.outer(s, u) / su
            inverse = m @ inverse @ m.T + np.outer(s, s) / su
        if fx - fn < 1e-10:
            x, fx, converged = x + s, fn, np.abs(gn).max() < 1e-3  # stalled: only a small gradient is convergence
            break
        x, fx, g = x + s, fn, gn
    ar, ma = _polynomials(spec, x[1:])
    level, var, _, a, p = _filter(z, x[0], ar, ma)
    r = len(a)
    t = np.zeros((r, r))
    t[: len(ar), 0] = ar
    t[:-1, 1:] += np.eye(r - 1)
    h = np.zeros(r)
    h[0] = 1.0
    h[1 : 1 + len(ma)] = ma
    mean, sd = [], []
    for _ in range(steps):
        mean.append(centre + scale * (x[0] + a[0]))
        sd.append(scale * math.sqrt(var * p[0, 0]))
        a, p = t @ a, t @ p @ t.T + np.outer(h, h)
    root = lambda c: float(np.abs(np.roots(np.append(1.0, c)[::-1])).min()) if len(c) and np.any(np.abs(c) > 1e-12) else math.inf
    return {"mean": np.array(mean), "sd": np.array(sd), "ar": ar, "ma": ma, "level": centre + scale * x[0], "variance": var * scale**2, "converged": bool(converged), "min_ar_root": root(-ar), "min_ma_root": root(ma), "loglik": level - len(seen) * math.log(scale)}
