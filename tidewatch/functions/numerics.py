"""Numeric kernels over one series; numpy and the standard library only."""

from __future__ import annotations

import math

import numpy as np


# --- distributions -----------------------------------------------------------------------------


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_cdf(t: float, df: float) -> float:
    tail = beta_inc(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2


def binom_cdf(k: int, n: int, p: float = 0.5) -> float:
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(0, min(k, n) + 1)))


def ks_2samp(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-sample Kolmogorov-Smirnov statistic and its asymptotic p-value."""
    x, y = np.sort(x), np.sort(y)
    both = np.concatenate((x, y))
    d = float(np.abs(np.searchsorted(x, both, "right") / len(x) - np.searchsorted(y, both, "right") / len(y)).max())
    n = math.sqrt(len(x) * len(y) / (len(x) + len(y)))
    z = (n + 0.12 + 0.11 / n) * d
    if z < 0.2:
        return d, 1.0
    return d, float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101)))))


# --- detectors ---------------------------------------------------------------------------------


def cox_stuart(values: np.ndarray, side: str = "positive", alpha: float | None = None) -> bool:
    """Whether the second half of the values lies above (positive) or below (negative) the first, and their line agrees.

    Values are paired at half the length; of an odd number the last has no partner. Without
    ``alpha`` the level is twice the binomial distribution over all values, just before its first
    rise by more than 1e-5, and the test value is read off the same distribution.
    """
    values = values[np.isfinite(values)]
    n = len(values)
    half = n // 2
    if not half:
        return False
    gap = values[half : 2 * half] - values[:half]
    up, down = int((gap > 0).sum()), int((gap < 0).sum())
    slope = np.polyfit(np.arange(n), values, 1)[0]
    if alpha is None:
        table = [2 * binom_cdf(k, n) for k in range(half + 1)]
        level = next(a for a, b in zip(table, table[1:]) if b - a > 1e-5)
        chance = table.__getitem__
    else:
        level, chance = alpha, lambda against: 2 * binom_cdf(against, up + down)
    rising = up >= down and slope > 0 and chance(down) < level
    falling = down >= up and slope < 0 and chance(up) < level
    return bool((rising and side in ("positive", "both")) or (falling and side in ("negative", "both")))


def _critical(n: int, alpha: float) -> float:
    """How far one of n normal values may lie from their mean, in deviations."""
    t = t_ppf(1 - alpha / (2 * n), n - 2)
    return (n - 1) * t / math.sqrt((n - 2 + t * t) * n)


def esd(values: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """The most deviating value is removed as long as it is significant; then each is tested against what is left."""
    left = values[np.isfinite(values)]
    while len(left) > 2:
        worst = int(np.abs(left - left.mean()).argmax())
        spread = left.std(ddof=1)
        if spread == 0 or abs(left[worst] - left.mean()) / spread <= _critical(len(left), alpha):
            break
        left = np.delete(left, worst)
    n = len(left) + 1
    if n < 3:
        return np.zeros(len(values), dtype=bool)
    mean = (values + left.sum()) / n
    spread = np.sqrt(np.maximum((values**2 + (left**2).sum() - n * mean**2) / (n - 1), 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(np.abs(values - mean) / spread, nan=0.0) > _critical(n, alpha)


def rolling_mean(values: np.ndarray, width: int) -> np.ndarray:
    left = width - 1 - (width - 1) // 2
    total = np.concatenate(([0.0], np.cumsum(values)))
    low = np.maximum(np.arange(len(values)) - left, 0)
    high = np.minimum(np.arange(len(values)) + width - left, len(values))
    return (total[high] - total[low]) / (high - low)


def acf(values: np.ndarray) -> np.ndarray:
    """Autocorrelation of all lags, by a transform of twice the length."""
    x = values - values.mean()
    f = np.fft.rfft(x, 2 * len(x))
    full = np.fft.irfft(f * np.conj(f))[: len(x)]
    return full / full[0] if full[0] > 0 else np.zeros(len(x))


def find_peaks(x: np.ndarray) -> np.ndarray:
    """Indices of strict local maxima; a plateau counts once, at its middle rounded down."""
    edges = np.flatnonzero(np.diff(x) != 0)
    runs = np.concatenate(([0], edges + 1)), np.concatenate((edges, [len(x) - 1]))
    return np.array([(a + b) // 2 for a, b in zip(*runs) if a > 0 and b < len(x) - 1 and x[a - 1] < x[a] > x[b + 1]], dtype=int)


def moving_trend(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A weighted moving average; where it is not whole, a line goes on from its first and its last value.

    The lines have the slopes of as many of its first and last values as there are weights.
    """
    inner = np.convolve(values, weights, "valid")
    tail = (len(weights) - 1) // 2
    head = len(weights) - 1 - tail
    slope = lambda part: np.polyfit(np.arange(len(part)), part, 1)[0] if len(part) > 1 else 0.0
    before = inner[0] + slope(inner[: len(weights)]) * np.arange(-head, 0)
    after = inner[-1] + slope(inner[-len(weights) :]) * np.arange(1, tail + 1)
    return np.concatenate((before, inner, after))


def season(values: np.ndarray, high_ac: float = 0.1, min_freq: int = 2) -> int | None:
    """The period of a series: the highest peak of its autocorrelation, without trend, after the first valley below zero.

    There must be ``min_freq`` peaks of ``high_ac`` or more in the first half of the lags.
    """
    n = len(values)
    if n < 3 or np.ptp(values) == 0:
        return None
    width = min(max(9, n // (min_freq + 1)), n - 1)
    r = acf(values - moving_trend(values, np.full(width, 1 / width)))
    valleys = find_peaks(-r)
    valleys = valleys[r[valleys] <= 0]
    peaks = find_peaks(r)
    peaks = peaks[(peaks > (valleys[0] if len(valleys) else 0)) & (peaks < n // 2) & (r[peaks] >= max(high_ac, 0))]
    return int(peaks[r[peaks].argmax()]) if len(peaks) >= min_freq else None


def decompose(values: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Additive (trend, seasonal, residual)."""
    n = len(values)
    if n < 2 * period or not np.isfinite(values).all():
        raise ValueError("two whole periods of finite values are needed")
    weights = np.full(period, 1 / period) if period % 2 else np.concatenate(([0.5], np.ones(period - 1), [0.5])) / period
    trend = moving_trend(values, weights)
    rest = values - trend
    phase = np.array([rest[k::period].mean() for k in range(period)])
    seasonal = np.resize(phase - phase.mean(), n)
    return trend, seasonal, rest - seasonal


def seasonal_outliers(values: np.ndarray, outliers=(None, 3), side: str = "positive", window: int = 10, period: int | None = None, high_ac: float = 0.1, min_freq: int = 2) -> np.ndarray:
    out = np.zeros(len(values), dtype=bool)
    known = np.isfinite(values)
    if known.sum() < 4:
        return out
    filled = np.interp(np.arange(len(values)), np.flatnonzero(known), values[known])
    period = period or season(filled, high_ac, min_freq)
    tested = filled
    if len(filled) < window:
        window = 1
    ahead, behind = window - 1 - (window - 1) // 2, (window - 1) // 2
    if period and len(filled) >= 2 * period:
        smooth = rolling_mean(filled, window)
        smooth[:ahead], smooth[len(smooth) - behind :] = smooth[ahead], smooth[len(smooth) - 1 - behind]
        tested = decompose(smooth, period)[2]
    q1, q3 = np.percentile(tested, (25, 75))
    below, above = outliers
    out = np.zeros(len(values), dtype=bool)
    if above is not None:
        out |= tested > q3 + above * (q3 - q1)
    if below is not None:
        out |= tested < q1 - below * (q3 - q1)
    out &= {"positive": tested > 0, "negative": tested < 0, "both": known, "neither": np.zeros(len(values), bool)}[side]
    out[:ahead], out[len(out) - 1 - behind :] = False, False  # there a moving average is not whole
    return out & known


# --- forecasting -------------------------------------------------------------------------------


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, their t-values, BIC) of a least-squares fit by the pseudo-inverse."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    rest = y - x @ beta
    spread = rest @ rest / max(1, len(y) - x.shape[1])
    t = beta / np.sqrt(np.maximum(spread * np.diag(inverse), 1e-300))
    return beta, t, len(y) * math.log(max(rest @ rest / len(y), 1e-300)) + x.shape[1] * math.log(len(y))


def adf(values: np.ndarray) -> tuple[float, int]:
    """The Dickey-Fuller statistic with a constant, its lags chosen by BIC."""
    n, dy = len(values), np.diff(values)
    most = max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))
    best = (math.inf, 0.0, 0)
    for lags in range(most + 1):
        x = np.column_stack([values[most:-1], np.ones(len(dy) - most), *(dy[most - k : len(dy) - k] for k in range(1, lags + 1))])
        _, t, bic = ols(x, dy[most:])
        if bic < best[0]:
            best = bic, float(t[0]), lags
    return best[1], best[2]


#: MacKinnon's response surfaces for one series with a constant: where the p-value's polynomials in the
#: statistic hold, their coefficients (constant first), and those of the critical values in powers of 1 / n.
_LOWEST, _BEND, _HIGHEST = -18.83, -1.61, 2.74
_BELOW = (2.1659, 1.4412, 0.038269)
_ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)
_CRITICAL = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)}


def adf_p_value(statistic: float) -> float:
    """How likely a series with a unit root has a statistic as low."""
    if statistic >= _HIGHEST or statistic <= _LOWEST:
        return float(statistic >= _HIGHEST)
    surface = _BELOW if statistic <= _BEND else _ABOVE
    z = sum(c * statistic**k for k, c in enumerate(surface))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf_critical(n: int, level: float = 0.05) -> float:
    return sum(c / n**k for k, c in enumerate(_CRITICAL[level]))


def least_squares_ar(values: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """AR and MA coefficients by two regressions, the constant, and the innovations."""
    n = len(values)
    long = min(max(p, q) + 3, max(1, n // 4))
    noise = np.zeros(n)
    if q:
        x = np.column_stack([np.ones(n - long), *(values[long - k : n - k] for k in range(1, long + 1))])
        beta, *_ = np.linalg.lstsq(x, values[long:], rcond=None)
        noise[long:] = values[long:] - x @ beta
    first = max(p, q + (long if q else 0))
    x = np.column_stack([np.ones(n - first), *(values[first - k : n - k] for k in range(1, p + 1)), *(noise[first - k : n - k] for k in range(1, q + 1))])
    beta, *_ = np.linalg.lstsq(x, values[first:], rcond=None)
    rest = np.zeros(n)
    rest[first:] = values[first:] - x @ beta
    return beta[1 : p + 1], beta[p + 1 :], float(beta[0]), rest


def css_errors(values: np.ndarray, ar: np.ndarray, ma: np.ndarray, constant: float) -> np.ndarray:
    """One-step errors given zero errors before the first value that has all its lags."""
    p, q = len(ar), len(ma)
    errors = np.zeros(len(values) + q)  # q zeros ahead
    base = values - constant
    for k in range(1, p + 1):
        base[p:] = base[p:] - ar[k - 1] * values[p - k : len(values) - k]
    if not q:
        base[:p] = 0.0
        return base
    back = ma[::-1]
    for t in range(p, len(values)):
        errors[t + q] = base[t] - back @ errors[t : t + q]
    return errors[q:]


def stable(ar: np.ndarray, ma: np.ndarray) -> bool:
    """Stationary and invertible."""
    return all(not len(c) or np.abs(np.roots(np.concatenate(([1.0], c)))).max() < 1 for c in (-ar, ma))


def css_fit(values: np.ndarray, p: int, q: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """AR and MA coefficients, constant and errors of least conditional sum of squares.

    Starts from two regressions and goes down by damped Gauss-Newton steps within the stable region.
    """
    ar, ma, constant, _ = least_squares_ar(values, p, q)
    if not stable(ar, ma):
        ar, ma = np.zeros(p), np.zeros(q)
    at = np.concatenate((ar, ma, [constant]))
    split = lambda x: (x[:p], x[p : p + q], float(x[-1]))
    now = css_errors(values, *split(at))
    damp = 1e-3
    for _ in range(rounds if q else 0):  # without MA part the regression is the least already
        steps = 1e-6 * np.maximum(1.0, np.abs(at))
        slope = np.column_stack([(css_errors(values, *split(at + step)) - now) / size for step, size in zip(np.diag(steps), steps)])
        normal = slope.T @ slope
        while damp < 1e8:
            tried = at - np.linalg.solve(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-12)), slope.T @ now)
            errors = css_errors(values, *split(tried)) if stable(*split(tried)[:2]) else None
            if errors is not None and errors @ errors < now @ now:
                break
            damp *= 10
        else:
            break
        gain = 1 - errors @ errors / (now @ now)
        at, now, damp = tried, errors, damp / 10
        if gain < 1e-9:
            break
    return *split(at), now


def yule_walker(values: np.ndarray, p: int) -> np.ndarray:
    """AR coefficients by the autocovariances, which always make a stationary process."""
    x = values - values.mean()
    c = np.array([x[k:] @ x[: len(x) - k] for k in range(p + 1)]) / len(x)
    return np.linalg.lstsq(c[np.abs(np.subtract.outer(np.arange(p), np.arange(p)))], c[1:], rcond=None)[0]


def from_free(free: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary AR part for any numbers: these are partial autocorrelations, bent into (-1, 1)."""
    out = np.zeros(0)
    for r in np.tanh(free / 2):
        out = np.append(out - r * out[::-1], r)
    return out


def to_free(ar: np.ndarray) -> np.ndarray:
    """The numbers that from_free() makes stationary coefficients of."""
    left, free = np.array(ar, float), []
    while len(left):
        r = float(np.clip(left[-1], -0.999999, 0.999999))
        free.append(2 * math.atanh(r))
        left = (left[:-1] + r * left[-2::-1]) / (1 - r * r) if len(left) > 1 else left[:0]
    return np.array(free[::-1])


def free_fit(values: np.ndarray, p: int, q: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """AR and MA coefficients, constant and errors of least conditional squares, by damped Gauss-Newton steps in free numbers.

    Any step gives a stationary and invertible model. Pure AR parts begin with Yule and Walker's, others with two regressions.
    """
    if q:
        ar, ma, _, _ = least_squares_ar(values, p, q)
        if not stable(ar, ma):
            ar, ma = yule_walker(values, p) if p else np.zeros(0), np.zeros(q)
    else:
        ar, ma = yule_walker(values, p) if p else np.zeros(0), np.zeros(0)
    at = np.concatenate((to_free(ar), to_free(-ma), [float(values.mean()) * (1 - ar.sum())]))
    split = lambda x: (from_free(x[:p]), -from_free(x[p : p + q]), float(x[-1]))
    now, damp = css_errors(values, *split(at)), 1e-3
    for _ in range(rounds):
        steps = 1e-6 * np.maximum(1.0, np.abs(at))
        slope = np.column_stack([(css_errors(values, *split(at + step)) - now) / size for step, size in zip(np.diag(steps), steps)])
        normal, before = slope.T @ slope, now @ now
        while damp < 1e10:
            tried = at - np.linalg.lstsq(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-12)), slope.T @ now, rcond=None)[0]
            errors = css_errors(values, *split(np.append(np.clip(tried[:-1], -30, 30), tried[-1])))
            if errors @ errors < before:
                break
            damp *= 10
        else:
            break
        tried = np.append(np.clip(tried[:-1], -30, 30), tried[-1])
        at, now, damp = tried, css_errors(values, *split(tried)), damp / 10
        if 1 - now @ now / max(before, 1e-300) < 1e-10:
            break
    return *split(at), now


def arima_forecast(values: np.ndarray, steps: int, most: int = 3) -> np.ndarray:
    """ARIMA: differences until stationary (Dickey-Fuller at 5 %), p and q up to ``most`` by BIC, coefficients by least
    conditional squares, forecasts integrated again."""
    d, series, heads = 0, values.astype(float), []
    while d < 2 and len(series) > 12 and np.ptp(series) > 0 and adf(series)[0] > adf_critical(len(series)):
        heads.append(series[-1])
        series, d = np.diff(series), d + 1
    if len(series) < 8 or np.ptp(series) == 0:
        out = np.full(steps, series[-1] if len(series) else 0.0)
    else:
        best = None
        for p in range(most + 1):
            for q in range(most + 1 if len(series) > 40 else 1):
                ar, ma, c, rest = least_squares_ar(series, p, q)
                bic = len(series) * math.log(max(float(rest @ rest) / len(series), 1e-300)) + (p + q + 1) * math.log(len(series))
                if stable(ar, ma) and (best is None or bic < best[0]):
                    best = bic, p, q
        ar, ma, c, rest = css_fit(series, *(best[1:] if best else (0, 0)))
        past, noise = list(series), list(rest)
        for _ in range(steps):
            past.append(c + sum(a * past[-k - 1] for k, a in enumerate(ar)) + sum(m * noise[-k - 1] for k, m in enumerate(ma)))
            noise.append(0.0)
        out = np.array(past[len(series) :])
    for head in reversed(heads):
        out = head + np.cumsum(out)
    return out


def forecast(values: np.ndarray, steps: int, low: float = -math.inf, high: float = math.inf) -> np.ndarray:
    """Fill, take the season off, forecast the trend (a line if it explains 90 %, else ARIMA), put the season back, clip."""
    known = np.isfinite(values)
    if known.sum() < 2:
        return np.full(steps, values[known][0] if known.any() else np.nan)
    filled = np.interp(np.arange(len(values)), np.flatnonzero(known), values[known])
    period = season(filled)
    trend, again = filled, np.zeros(steps)
    if period and len(filled) >= 2 * period:
        trend, seasonal, rest = decompose(filled, period)
        rest = np.where(np.abs(rest - rest.mean()) > 3 * rest.std(), rest.mean(), rest)
        again = np.resize((seasonal + rest)[-period:], steps)
    at = np.arange(len(trend))
    slope, base = np.polyfit(at, trend, 1)
    spread = ((trend - trend.mean()) ** 2).sum()
    r2 = 1.0 if spread == 0 else 1 - ((trend - base - slope * at) ** 2).sum() / spread
    ahead = base + slope * np.arange(len(trend), len(trend) + steps) if r2 >= 0.9 else arima_forecast(trend, steps)
    return np.clip(ahead + again, low, high)


def holt_winters(values: np.ndarray, alpha: float = 0.2, beta: float = 0.2, gamma: float = 0.2, period: int = 7) -> np.ndarray:
    """What additive triple smoothing leaves of each value, once that value has moved the level and the season.

    Level and trend start at the first value, seasons at zero; see the survey's quirks.
    """
    level = slope = float(values[0]) if len(values) else 0.0
    seasons = np.zeros(period)
    out = np.zeros(len(values))
    for i, v in enumerate(values.tolist()):
        k, before = i % period, level
        level = alpha * (v - seasons[k]) + (1 - alpha) * (level + slope)
        slope = beta * (level - before) + (1 - beta) * slope
        seasons[k] = gamma * (v - level) + (1 - gamma) * seasons[k]
        out[i] = v - level - seasons[k]
    return out


def tidy_up(ts: np.ndarray, values: np.ndarray, step: int) -> tuple[list[int], list[float]]:
    """Samples on a grid from the first: points too close are dropped (filling a missing one before), holes are NaN."""
    out_t, out_v = [int(ts[0])], [float(values[0])]
    for t, v in zip(ts[1:].tolist(), values[1:].tolist()):
        gap = t - out_t[-1]
        if gap < step:
            if not math.isfinite(out_v[-1]):
                out_v[-1] = v
            continue
        while gap >= 2 * step:
            out_t.append(out_t[-1] + step)
            out_v.append(math.nan)
            gap -= step
        out_t.append(out_t[-1] + step)
        out_v.append(v)
    return out_t, out_v
