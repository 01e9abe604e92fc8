"""Numpy kernels of one series; the grouped operators in ``operators.models`` run them."""

from __future__ import annotations

import numpy as np
import pandas as pd

from .special import normal_quantile


def finite(rows: pd.DataFrame, position: str = "t", value: str = "value") -> pd.DataFrame:
    """Rows with finite values in order of position."""
    rows = rows.sort_values(position)
    return rows[np.isfinite(rows[value].to_numpy(float))]


def dtw(x, y) -> float:
    """Root of the least total squared cost of a warping path; row by row."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    row = np.full(len(y) + 1, np.inf)
    row[0] = 0.0
    for a in x:
        cost, new = (a - y) ** 2, np.full(len(y) + 1, np.inf)
        best = np.minimum(row[1:], row[:-1])
        for j in range(len(y)):
            new[j + 1] = cost[j] + min(best[j], new[j])
        row = new
    return float(np.sqrt(row[-1]))


def kalman_trend(y, fh: int, measurement_noise: float = 5.0, process_noise: float = 0.1, initial_covariance: float = 1000.0, dt: float = 1.0, coverage: float = 0.9) -> np.ndarray:
    """Local linear trend filter; rows (forecast, lower, upper)."""
    move, seen = np.array([[1, dt], [0, 1]]), np.array([1.0, 0.0])
    noise = process_noise * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]])
    x, p = np.array([y[0] if len(y) else 0.0, 0.0]), np.eye(2) * initial_covariance
    for value in y:
        x, p = move @ x, move @ p @ move.T + noise
        if np.isfinite(value):
            gain = p @ seen / (seen @ p @ seen + measurement_noise)
            x, p = x + gain * (value - seen @ x), p - np.outer(gain, seen @ p)
    out, z = [], normal_quantile(0.5 + coverage / 2)
    for _ in range(fh):
        x, p = move @ x, move @ p @ move.T + noise
        half = z * np.sqrt(p[0, 0])
        out.append((x[0], x[0] - half, x[0] + half))
    return np.array(out)


def run_length_changes(y, hazard: float, beta0: float) -> np.ndarray:
    """Change probability at each row from a run-length recursion with running means and variances."""
    n = len(y)
    probability, out = np.zeros(n + 1), np.zeros(n)
    probability[0] = 1.0
    total, square, count = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for t, value in enumerate(y):
        r = np.arange(t + 1)
        total[1 : t + 2], square[1 : t + 2], count[1 : t + 2] = total[: t + 1] + value, square[: t + 1] + value**2, count[: t + 1] + 1
        total[0] = square[0] = count[0] = 0
        mean = np.where(count[r] > 0, total[r] / np.maximum(count[r], 1), value)
        spread = np.where(count[r] > 1, np.maximum(square[r] / np.maximum(count[r], 1) - mean**2, 0), beta0)
        likelihood = np.maximum(np.exp(-0.5 * (value - mean) ** 2 / (spread + 1e-6)), 1e-10)
        grown = probability[r] * likelihood * (1 - hazard)
        change = float((probability[r] * likelihood).sum() * hazard)
        out[t] = change / (change + grown.sum() + 1e-10)
        probability[1 : t + 2], probability[0] = grown, change
        probability /= probability.sum() or 1.0
    return out


def pelt(y, penalty: float | None = None, min_size: int = 3, jump: int = 1, model: str = "l2") -> list[int]:
    """Change positions of the least penalised cost; candidates that cannot win are pruned."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 2 * min_size:
        return []
    penalty = np.log(n) * y.var() if penalty is None else penalty
    if model == "rbf":
        d2 = (y[:, None] - y[None, :]) ** 2
        gamma = 1 / (np.median(d2[d2 > 0]) if (d2 > 0).any() else 1.0)
        kernel = np.zeros((n + 1, n + 1))
        kernel[1:, 1:] = np.exp(-np.clip(gamma * d2, 0.01, 100)).cumsum(0).cumsum(1)
        diag = np.arange(n + 1, dtype=float)
        cost = lambda a, b: diag[b] - diag[a] - (kernel[b, b] - kernel[a, b] - kernel[b, a] + kernel[a, a]) / (b - a)
    else:
        s, q = np.concatenate(([0], y.cumsum())), np.concatenate(([0], (y**2).cumsum()))
        cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    best, last, open_ = {0: -penalty}, {}, [0]
    for b in [k for k in range(min_size, n, jump)] + [n]:
        tried = [(best[a] + cost(a, b) + penalty, a) for a in open_ if b - a >= min_size]
        if tried:
            best[b], last[b] = min(tried)
            value = {a: v for v, a in tried}
            open_ = [a for a in open_ if a not in value or value[a] <= best[b] + penalty] + [b]
    cuts, at = [], n
    while last.get(at, 0) > 0:
        at = last[at]
        cuts.append(at)
    return cuts[::-1]


def holt_winters(y, fh: int, trend: str | None = "add", seasonal: str | None = None, period: int | None = None, coverage: float = 0.9) -> np.ndarray:
    """Smoothing parameters by coordinate search on squared errors; rows (forecast, lower, upper)."""
    y = np.asarray(y, float)
    m = period or 1
    seasonal = seasonal if period and len(y) >= 2 * period else None

    def run(a: float, b: float, g: float, steps: int = 0) -> tuple[np.ndarray, np.ndarray]:
        level, slope = y[:m].mean(), ((y[m : 2 * m].mean() - y[:m].mean()) / m if len(y) >= 2 * m and trend else 0.0)
        s = ((y[:m] / level if seasonal == "mul" else y[:m] - level) if seasonal else np.zeros(m)).copy()
        errors = np.empty(len(y))
        for t, value in enumerate(y):
            base = level * slope if trend == "mul" and slope else level + slope
            k = s[t % m]
            fit = base * k if seasonal == "mul" else base + k
            errors[t] = value - fit
            fresh = value / k if seasonal == "mul" and k else value - k
            new = a * fresh + (1 - a) * base
            if trend:
                slope = b * ((new / level if level else 1.0) if trend == "mul" else new - level) + (1 - b) * slope
            if seasonal:
                s[t % m] = g * (value / base if seasonal == "mul" and base else value - base) + (1 - g) * k
            level = new
        h = np.arange(1, steps + 1)
        ahead = level * slope**h if trend == "mul" and slope else level + slope * h
        k = s[(len(y) + h - 1) % m]
        return errors, ahead * k if seasonal == "mul" else ahead + k

    p = [0.3, 0.1 if trend else 0.0, 0.1 if seasonal else 0.0]
    loss = lambda q: float((run(*q)[0] ** 2).sum())
    best, step = loss(p), 0.2
    while step > 0.01:
        moved = False
        for i in range(3):
            if (i == 1 and not trend) or (i == 2 and not seasonal):
                continue
            for d in (step, -step):
                q = p.copy()
                q[i] = min(0.99, max(0.01, q[i] + d))
                if (value := loss(q)) < best - 1e-12:
                    p, best, moved = q, value, True
        step = step if moved else step / 2
    errors, made = run(*p, steps=fh)
    half = normal_quantile(0.5 + coverage / 2) * errors.std(ddof=1)
    return np.stack([made, made - half, made + half], 1)


def arima(y, fh: int, max_p: int = 3, max_d: int = 1, max_q: int = 2, coverage: float = 0.95) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Hannan-Rissanen fits over orders, chosen by AIC; rows (forecast, lower, upper) and the order."""
    y = np.asarray(y, float)
    best = None
    for d in range(max_d + 1):
        z = np.diff(y, d)
        mean = z.mean()
        x = z - mean
        long = min(max(max_p + max_q, 4), len(x) // 3)
        lagged = lambda v, k, start: np.stack([v[start - i : len(v) - i] for i in range(1, k + 1)], 1) if k else np.empty((len(v) - start, 0))
        e = np.zeros(len(x))
        if len(x) > 2 * long + 2:
            coef, *_ = np.linalg.lstsq(lagged(x, long, long), x[long:], rcond=None)
            e[long:] = x[long:] - lagged(x, long, long) @ coef
        start = max(max_p, max_q) + long
        if len(x) - start < 5:
            continue
        for p in range(max_p + 1):
            for q in range(max_q + 1):
                design = np.hstack([lagged(x, p, start), lagged(e, q, start)])
                coef = np.linalg.lstsq(design, x[start:], rcond=None)[0] if p + q else np.empty(0)
                residual = x[start:] - design @ coef
                n, s2 = len(residual), max(float(residual.var()), 1e-12)
                aic = n * np.log(s2) + 2 * (p + q + 1)
                if best is None or aic < best[0] - 1e-9:
                    best = (aic, (p, d, q), coef, mean, x, e, s2)
    if best is None:
        half = normal_quantile(0.5 + coverage / 2) * (y.std() if len(y) > 1 else 0.0)
        return np.array([[y[-1], y[-1] - half, y[-1] + half]] * fh), (0, 1, 0)
    _, (p, d, q), coef, mean, x, e, s2 = best
    xs, es, psi = list(x), list(e), [1.0]
    for _ in range(fh):
        xs.append(float(sum(c * xs[-i - 1] for i, c in enumerate(coef[:p])) + sum(c * es[-i - 1] for i, c in enumerate(coef[p:]))))
        es.append(0.0)
    for k in range(1, fh):
        psi.append((coef[p + k - 1] if k <= q else 0.0) + sum(coef[i] * psi[k - 1 - i] for i in range(min(p, k))))
    made, weights = np.array(xs[-fh:]) + mean, np.array(psi)
    for k in range(d):
        base = np.diff(y, d - 1 - k)[-1] if d - 1 - k else y[-1]
        made, weights = base + made.cumsum(), weights.cumsum()
    half = normal_quantile(0.5 + coverage / 2) * np.sqrt(s2 * (weights**2).cumsum())
    return np.stack([made, made - half, made + half], 1), (p, d, q)


def butterworth(y, cutoff: float = 0.1, order: int = 4, kind: str = "low") -> np.ndarray:
    """Zero-phase low or high pass; cutoff in cycles a sample, below 0.5. Sections run both ways."""
    y = np.asarray(y, float)
    w = np.tan(np.pi * cutoff)
    poles = w * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "high":
        poles = w * w / poles
    z = (1 + poles) / (1 - poles)
    a = np.real(np.poly(z))
    b = np.real(np.poly(np.full(order, -1.0 if kind == "low" else 1.0)))
    at = 1.0 if kind == "low" else -1.0
    b *= np.polyval(a, at) / np.polyval(b, at)
    pad = min(3 * (order + 1), len(y) - 1)
    x = np.concatenate([2 * y[0] - y[pad:0:-1], y, 2 * y[-1] - y[-2 : -pad - 2 : -1]])
    steady = np.linalg.solve(np.eye(order) - np.vstack([np.column_stack([-a[1:-1], np.eye(order - 1)]), np.concatenate([[-a[-1]], np.zeros(order - 1)])]), b[1:] - a[1:] * b[0]) if order > 1 else (b[1:] - a[1:] * b[0]) / (1 + a[1])

    def once(v: np.ndarray) -> np.ndarray:
        state, out = steady * v[0], np.empty(len(v))
        for t, value in enumerate(v):
            out[t] = b[0] * value + state[0]
            state = np.append(state[1:], 0.0) + b[1:] * value - a[1:] * out[t]
        return out

    x = once(once(x)[::-1])[::-1]
    return x[pad : pad + len(y)]


def savgol(y, window: int = 5, degree: int = 2) -> np.ndarray:
    """Local polynomials; the ends are read off the first and last window's polynomial."""
    y = np.asarray(y, float)
    window += 1 - window % 2
    degree, half = min(degree, window - 1), window // 2
    if len(y) < window:
        return y.copy()
    x = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(x, degree + 1, increasing=True))
    out = np.convolve(y, fit[0][::-1], "same")
    powers = np.vander(x, degree + 1, increasing=True)
    out[:half], out[-half:] = (powers @ (fit @ y[:window]))[:half], (powers @ (fit @ y[-window:]))[-half:]
    return out


#: The scaling filter of the Daubechies wavelet with four vanishing moments.
DB4 = np.array([-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965])


def wavelet_split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximation and detail of one level, ends mirrored."""
    low, n = DB4, len(DB4)
    high = np.array([(-1) ** (k + 1) for k in range(n)]) * low[::-1]
    padded = np.concatenate([x[: n - 1][::-1], x, x[: -n : -1]]) if len(x) >= n - 1 else np.pad(x, n - 1, "symmetric")
    return np.convolve(padded, low, "valid")[1::2], np.convolve(padded, high, "valid")[1::2]


def wavelet_join(approx: np.ndarray, detail: np.ndarray, size: int) -> np.ndarray:
    low, n = DB4[::-1], len(DB4)
    high = np.array([(-1) ** (k + 1) for k in range(n)])[::-1] * DB4
    up = lambda c: np.ravel(np.column_stack([c, np.zeros(len(c))]))
    whole = np.convolve(up(approx), low) + np.convolve(up(detail), high)
    return whole[n - 2 : n - 2 + size]


def wavelet_details(y, level: int = 5) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    a, details, sizes = np.asarray(y, float), [], []
    for _ in range(level):
        if len(a) < 2:
            break
        sizes.append(len(a))
        a, d = wavelet_split(a)
        details.append(d)
    return a, details, sizes


def wavelet_denoise(y, level: int = 5, mode: str = "soft") -> np.ndarray:
    a, details, sizes = wavelet_details(y, level)
    if not details:
        return np.asarray(y, float)
    limit = np.median(np.abs(details[0])) / 0.6745 * np.sqrt(2 * np.log(max(2, len(y))))
    cut = (lambda d: np.sign(d) * np.maximum(np.abs(d) - limit, 0)) if mode == "soft" else (lambda d: np.where(np.abs(d) > limit, d, 0.0))
    for d, size in zip(details[::-1], sizes[::-1], strict=True):
        a = wavelet_join(a[: len(d)], cut(d), size)
    return a


def wavelet_scores(y, level: int = 5, factor: float = 3.0) -> np.ndarray:
    """Coefficient sizes beyond median + factor * MAD of their level, added to their stretch of rows."""
    y, out = np.asarray(y, float), np.zeros(len(y))
    for d in wavelet_details(y, level)[1]:
        size = np.abs(d)
        limit = np.median(size) + factor * np.median(np.abs(size - np.median(size))) / 0.6745
        stretch = max(1, len(y) // len(d))
        for k in np.flatnonzero(size > limit):
            out[k * stretch : (k + 1) * stretch] += size[k]
    return out


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 0) -> np.ndarray:
    """Isolation forest scores (higher: more isolated) of the rows of ``x``."""
    random, n = np.random.default_rng(seed), len(x)
    size = min(sample, n)
    norm = lambda m: 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m if m > 2 else float(m == 2)
    depth, top = np.zeros(n), int(np.ceil(np.log2(max(2, size))))
    for _ in range(trees):
        stack = [(random.choice(n, size, replace=False), np.arange(n), 0)]
        while stack:
            own, passing, d = stack.pop()
            if not len(passing):
                continue
            spread = x[own].max(axis=0) - x[own].min(axis=0) if len(own) else np.zeros(1)
            if d >= top or len(own) <= 1 or not spread.any():
                depth[passing] += d + norm(len(own))
                continue
            f = random.choice(np.flatnonzero(spread))
            cut = random.uniform(x[own, f].min(), x[own, f].max())
            stack += [(own[x[own, f] < cut], passing[x[passing, f] < cut], d + 1), (own[x[own, f] >= cut], passing[x[passing, f] >= cut], d + 1)]
    return 2 ** (-depth / trees / max(norm(size), 1e-9))


def surrogate(y, method: str = "shuffle", seed: int = 0, iterations: int = 100, block: int | None = None) -> np.ndarray:
    y, random = np.asarray(y, float), np.random.default_rng(seed)
    n = len(y)
    if method == "shuffle":
        return random.permutation(y)
    if method == "circular":
        return np.roll(y, int(random.integers(n)))
    if method == "block_bootstrap":
        size = block or max(1, int(np.sqrt(n)))
        starts = random.integers(0, max(1, n - size + 1), -(-n // size))
        return np.concatenate([y[s : s + size] for s in starts])[:n]
    spectrum = np.fft.rfft(y)
    if method == "phase":
        turn = np.exp(2j * np.pi * random.random(len(spectrum)))
        turn[0] = 1
        if n % 2 == 0:
            turn[-1] = 1
        return np.fft.irfft(spectrum * turn, n)
    if method == "iaaft":
        ordered, out = np.sort(y), random.permutation(y)
        for _ in range(iterations):
            now = np.fft.rfft(out)
            out = np.fft.irfft(np.abs(spectrum) * np.exp(1j * np.angle(now)), n)
            out = ordered[np.argsort(np.argsort(out))]
        return out
    raise ValueError(f"unknown surrogate {method}")


def bayes_forecast(y, fh: int, model: str = "linear_trend", samples: int = 2000, seed: int = 0, coverage: float = 0.9, prior: float = 1e-6) -> tuple[np.ndarray, dict[str, float]]:
    """Posterior forecasts, rows (mean, lower, upper), and posterior means.

    linear_trend and ar1 have a conjugate normal-inverse-gamma posterior; exponential_trend is
    the linear model of the logarithm.
    """
    y, random = np.asarray(y, float), np.random.default_rng(seed)
    log = model == "exponential_trend"
    target = np.log(np.maximum(y, 1e-9)) if log else y
    if model == "ar1":
        x, target = np.column_stack([np.ones(len(y) - 1), y[:-1]]), y[1:]
    else:
        x = np.column_stack([np.ones(len(y)), np.arange(len(y))])
    precision = x.T @ x + prior * np.eye(2)
    mean = np.linalg.solve(precision, x.T @ target)
    a, b = 1e-3 + len(target) / 2, 1e-3 + max(0.0, (target @ target - mean @ precision @ mean) / 2)
    s2 = b / random.gamma(a, size=samples)
    draws = mean + np.sqrt(s2)[:, None] * random.multivariate_normal(np.zeros(2), np.linalg.inv(precision), samples)
    noise = np.sqrt(s2)[:, None] * random.standard_normal((samples, fh))
    if model == "ar1":
        paths, now = [], np.full(samples, y[-1])
        for h in range(fh):
            now = draws[:, 0] + draws[:, 1] * now + noise[:, h]
            paths.append(now)
        paths = np.stack(paths, 1)
    else:
        paths = draws[:, :1] + draws[:, 1:] * (len(y) + np.arange(fh)) + noise
        paths = np.exp(paths) if log else paths
    lo, hi = np.quantile(paths, [(1 - coverage) / 2, (1 + coverage) / 2], axis=0)
    return np.stack([paths.mean(axis=0), lo, hi], 1), {"intercept": float(mean[0]), "slope": float(mean[1]), "sigma2": float(s2.mean())}


def reservoir_forecast(y, fh: int, lookback: int = 12, hidden: int = 64, seed: int = 0) -> np.ndarray:
    """Recurrent forecaster: a fixed random LSTM layer over min-max scaled windows with a ridge readout."""
    y, random = np.asarray(y, float), np.random.default_rng(seed)
    lo, span = y.min(), (y.max() - y.min()) or 1.0
    z, lookback = (y - lo) / span, max(1, min(lookback, len(y) - 2))
    wx, wh, bias = random.normal(0, 1, (4, hidden)), random.normal(0, 0.5 / np.sqrt(hidden), (4, hidden, hidden)), random.normal(0, 0.1, (4, hidden))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def encode(windows: np.ndarray) -> np.ndarray:
        h = c = np.zeros((len(windows), hidden))
        for t in range(windows.shape[1]):
            i, f, o, g = (windows[:, t, None] * wx[k] + h @ wh[k] + bias[k] for k in range(4))
            c = sigmoid(f + 1) * c + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
        return np.column_stack([h, windows, np.ones(len(windows))])

    windows = np.stack([z[k : k + lookback] for k in range(len(z) - lookback)])
    x, target = encode(windows), z[lookback:]
    readout = np.linalg.solve(x.T @ x + 1e-2 * np.eye(x.shape[1]), x.T @ target)
    now = list(z[-lookback:])
    for _ in range(fh):
        now.append(float(encode(np.array(now[-lookback:])[None])[0] @ readout))
    return np.array(now[-fh:]) * span + lo
