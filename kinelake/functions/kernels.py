"""Signal kernels on whole series, in plain NumPy: filters, peaks, splines, spectra and shapes.

These are for operators that need all of an ordered series at once; they run inside grouped-map functions and know
nothing of Spark.
"""

from __future__ import annotations

import math

import numpy as np

# ---------------------------------------------------------------- filters


def butterworth(order: int, cutoff: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital low-pass: analog prototype poles, pre-warped, through the bilinear transform."""
    warped = 2.0 * math.tan(math.pi * cutoff / rate)
    k = np.arange(1, order + 1)
    analog = warped * np.exp(1j * math.pi * (2 * k + order - 1) / (2 * order))
    poles = (2.0 + analog) / (2.0 - analog)
    gain = np.real(warped**order / np.prod(2.0 - analog))
    return np.real(gain * np.poly(-np.ones(order))), np.real(np.poly(poles))


def iir(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A recursive filter in transposed direct form II, from a state of len(b) - 1 values."""
    z = list(state) + [0.0]
    n = len(b) - 1
    out = np.empty(len(x))
    bs, as_ = b.tolist(), a.tolist()
    for i, v in enumerate(x.tolist()):
        y = bs[0] * v + z[0]
        for j in range(n):
            z[j] = bs[j + 1] * v + z[j + 1] - as_[j + 1] * y
        out[i] = y
    return out


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state at which a constant input of one passes unchanged."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[np.arange(n - 1), np.arange(1, n)] = 1.0
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering, with point-mirrored ends of three filter lengths; too short series raise."""
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        raise ValueError(f"a series of {len(x)} is too short for padding of {pad}")
    z = steady_state(b, a)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    ahead = iir(b, a, wide, z * wide[0])
    back = iir(b, a, ahead[::-1], z * ahead[-1])[::-1]
    return back[pad:-pad]


def lowpass(x: np.ndarray, cutoff: float, rate: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth; series that are too short, or cutoffs beyond half the rate, pass as they are."""
    x = np.asarray(x, float)
    if cutoff >= rate / 2 or cutoff <= 0:
        return x.copy()
    b, a = butterworth(order, cutoff, rate)
    return x.copy() if len(x) <= 3 * max(len(a), len(b)) else zero_phase(b, a, x)


def fill_linear(x: np.ndarray) -> np.ndarray:
    """NaN replaced by interpolation between known values, ends held; all-NaN series stay."""
    x = np.asarray(x, float)
    known = np.flatnonzero(~np.isnan(x))
    return x.copy() if not len(known) else np.interp(np.arange(len(x)), known, x[known])


def savgol(x: np.ndarray, window: int = 21, degree: int = 2) -> np.ndarray:
    """Local polynomial smoothing; the ends take the polynomial of the first and last whole window."""
    x = np.asarray(x, float)
    window += window % 2 == 0
    if len(x) < window or degree >= window:
        return x.copy()
    half = window // 2
    powers = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    fit = np.linalg.pinv(powers)
    out = np.convolve(x, fit[0][::-1], "same")
    at = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    out[:half] = (at @ (fit @ x[:window]))[:half]
    out[-half:] = (at @ (fit @ x[-window:]))[-half:]
    return out


def median_filter(x: np.ndarray, kernel: int = 3) -> np.ndarray:
    """Running median over an odd kernel, zeros beyond the ends."""
    kernel += kernel % 2 == 0
    half = kernel // 2
    wide = np.concatenate([np.zeros(half), np.asarray(x, float), np.zeros(half)])
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, kernel), axis=1)


def moving_mean(x: np.ndarray, window: int = 5) -> np.ndarray:
    """Centred mean of the known values in the window."""
    x = np.asarray(x, float)
    known = ~np.isnan(x)
    sums = np.concatenate([[0.0], np.cumsum(np.where(known, x, 0.0))])
    counts = np.concatenate([[0], np.cumsum(known)])
    low = np.maximum(np.arange(len(x)) - window // 2, 0)
    high = np.minimum(np.arange(len(x)) + (window - 1) // 2 + 1, len(x))
    with np.errstate(invalid="ignore"):
        return (sums[high] - sums[low]) / (counts[high] - counts[low])


def kalman_smooth(x: np.ndarray, process: float = 1.0, noise: float = 1.0) -> np.ndarray:
    """Kalman filter of a random walk that begins at the first value, with a backward smoothing pass.

    Steps, observations and the beginning have the variances ``process``, ``noise`` and 1. Missing values are
    interpolated first. Gains don't depend on the values, so they are worked out once.
    """
    x = fill_linear(np.asarray(x, float))
    n = len(x)
    if not n or np.isnan(x).all():
        return x.copy()
    gain, back, spread = np.empty(n), np.empty(n), 1.0
    for i in range(n):
        ahead = spread if i == 0 else spread + process
        gain[i] = ahead / (ahead + noise)
        spread = (1 - gain[i]) * ahead
        back[i] = spread / (spread + process)
    out = np.empty(n)
    state = x[0]
    for i in range(n):
        state = out[i] = state + gain[i] * (x[i] - state)
    for i in range(n - 2, -1, -1):
        out[i] += back[i] * (out[i + 1] - out[i])
    return out


def lowess(y: np.ndarray, share: float = 0.1, rounds: int = 3) -> np.ndarray:
    """Locally weighted lines (tricube over the nearest share of points), re-weighted by bisquare of the residuals."""
    y = np.asarray(y, float)
    n = len(y)
    k = min(n, max(2, int(share * n + 1e-10)))
    if n < 3:
        return y.copy()
    x = np.arange(n, dtype=float)
    left = np.clip(np.arange(n) - k // 2, 0, n - k)
    for i in range(n):  # the k nearest positions
        while left[i] + k < n and x[left[i] + k] - x[i] < x[i] - x[left[i]]:
            left[i] += 1
    cols = left[:, None] + np.arange(k)
    d = np.abs(x[cols] - x[:, None])
    reach = np.maximum(d.max(axis=1, keepdims=True), 1e-12)
    base = np.where(d <= 0.999 * reach, np.where(d > 0.001 * reach, (1 - np.minimum(d / reach, 1) ** 3) ** 3, 1.0), 0.0)
    robust = np.ones(n)
    fit = y.copy()
    for _ in range(rounds + 1):
        w = base * robust[cols]
        total = w.sum(axis=1, keepdims=True)
        w = np.where(total > 0, w / np.maximum(total, 1e-300), 0)
        mx = (w * x[cols]).sum(axis=1)
        my = (w * y[cols]).sum(axis=1)
        dx = x[cols] - mx[:, None]
        sxx = (w * dx * dx).sum(axis=1)
        slope = np.where(sxx > 1e-12, (w * dx * y[cols]).sum(axis=1) / np.maximum(sxx, 1e-12), 0)
        fit = np.where(total[:, 0] > 0, my + slope * (x - mx), y)
        residual = np.abs(y - fit)
        scale = 6 * np.median(residual)
        if scale <= 1e-12:
            break
        u = residual / scale
        robust = np.where(u >= 0.999, 0, np.where(u <= 0.001, 1, (1 - np.minimum(u, 1) ** 2) ** 2))
    return fit


def smoothing_spline(y: np.ndarray, limit: float = 0.5) -> np.ndarray:
    """The natural cubic smoothing spline with the most smoothing whose sum of squared residuals is at most ``limit``.

    The penalty is on squared second derivatives, found by bisection; it stands for knot selection to the same limit.
    """
    y = np.asarray(y, float)
    n = len(y)
    if n < 4:
        return y.copy()
    second = np.diff(np.eye(n), 2, axis=0)
    mass = np.diag(np.full(n - 2, 2 / 3)) + np.diag(np.full(n - 3, 1 / 6), 1) + np.diag(np.full(n - 3, 1 / 6), -1)
    values, vectors = np.linalg.eigh(second.T @ np.linalg.solve(mass, second))
    coordinates = vectors.T @ y

    def fit(penalty: float) -> np.ndarray:
        return vectors @ (coordinates / (1 + penalty * np.maximum(values, 0)))

    low, high = 0.0, 1.0
    while ((y - fit(high)) ** 2).sum() <= limit and high < 1e12:
        high *= 10
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if ((y - fit(middle)) ** 2).sum() <= limit else (low, middle)
    return fit(low)


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Interpolating cubic spline whose third derivative is continuous at the second and last but one knots."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0]) if n else np.full(len(at), np.nan)
    h = np.diff(x)
    slope = np.diff(y) / h
    m = np.zeros((n, n))
    r = np.zeros(n)
    m[0, :3] = h[1], -(h[0] + h[1]), h[0]
    m[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * (slope[i] - slope[i - 1])
    second = np.linalg.solve(m, r)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t = at - x[k]
    return y[k] + t * (slope[k] - h[k] * (2 * second[k] + second[k + 1]) / 6) + t**2 * second[k] / 2 + t**3 * (second[k + 1] - second[k]) / (6 * h[k])


# The low-pass reconstruction coefficients of the Daubechies wavelet with four vanishing moments.
DB4 = np.array([0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278])


def _mirror(x: np.ndarray, pad: int) -> np.ndarray:
    return np.pad(x, pad, mode="symmetric")


def dwt(x: np.ndarray, taps: np.ndarray = DB4) -> tuple[np.ndarray, np.ndarray]:
    """One level of the wavelet transform with mirrored ends: approximation and detail."""
    low = taps[::-1]
    high = taps * (-1.0) ** np.arange(1, len(taps) + 1)
    wide = _mirror(x, len(taps) - 1)
    return tuple(np.convolve(wide, f, "valid")[1::2] for f in (low, high))


def idwt(approximation: np.ndarray, detail: np.ndarray, n: int, taps: np.ndarray = DB4) -> np.ndarray:
    """The signal of n values back from one level."""
    high = taps[::-1] * (-1.0) ** np.arange(len(taps))
    out = 0
    for values, f in ((approximation, taps), (detail, high)):
        spread = np.zeros(2 * len(values) - 1)
        spread[::2] = values
        out = out + np.convolve(spread, f)
    start = len(taps) - 2
    return out[start : start + n]


def wavelet_denoise(x: np.ndarray, level: int | None = None, mode: str = "soft") -> np.ndarray:
    """Details shrunk by the universal threshold, with the noise from the finest level's median absolute value."""
    x = np.asarray(x, float)
    most = int(math.log2(len(x) / (len(DB4) - 1))) if len(x) >= 2 * (len(DB4) - 1) else 0
    level = most if level is None else min(level, most)
    if level < 1:
        return x.copy()
    parts, sizes, rest = [], [], x
    for _ in range(level):
        sizes.append(len(rest))
        rest, detail = dwt(rest)
        parts.append(detail)
    limit = np.median(np.abs(parts[0])) / 0.6745 * math.sqrt(2 * math.log(len(x)))
    shrink = (lambda d: np.sign(d) * np.maximum(np.abs(d) - limit, 0)) if mode == "soft" else (lambda d: np.where(np.abs(d) > limit, d, 0))
    for detail, n in zip(reversed(parts), reversed(sizes), strict=True):
        rest = idwt(rest[: len(detail)], shrink(detail), n)
    return rest


def residuals_by_cutoff(x: np.ndarray, rate: float, cutoffs: np.ndarray, order: int = 2) -> np.ndarray:
    """Root mean square of what each low-pass takes away."""
    x = fill_linear(x)
    return np.array([math.sqrt(np.mean((x - lowpass(x, c, rate, order)) ** 2)) for c in cutoffs])


def knee_frequency(cutoffs: np.ndarray, residuals: np.ndarray, tolerance: float = 0.05) -> float:
    """The last cutoff at which the residual leaves the line through the upper quarter by more than a share of its range."""
    n = len(cutoffs)
    tail = slice(n - max(2, n // 4), n)
    slope, intercept = np.polyfit(cutoffs[tail], residuals[tail], 1)
    away = residuals - (slope * cutoffs + intercept) > tolerance * np.ptp(residuals)
    return float(cutoffs[np.flatnonzero(away)[-1]]) if away.any() else float(cutoffs[0])


# ---------------------------------------------------------------- peaks and lags


def _valleys(x: np.ndarray) -> np.ndarray:
    """For each value the lowest since the last one that is higher, itself included, in one pass."""
    out, open_ = [], []
    for v in x.tolist():
        low = v
        while open_ and open_[-1][0] <= v:
            low = min(low, open_.pop()[1])
        open_.append((v, low))
        out.append(low)
    return np.array(out)


def find_peaks(x: np.ndarray, distance: int = 1, prominence: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Positions and prominences of peaks.

    A peak is above both sides, a plateau counts at its middle. Of peaks closer than ``distance`` the lower go, highest
    first; then those of too little prominence go, measured down to the higher of the two valleys towards higher ground.
    """
    x = np.asarray(x, float)
    peaks = []
    i, n = 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < n and x[j + 1] == x[i]:
                j += 1
            if j + 1 < n and x[j + 1] < x[i]:
                peaks.append((i + j) // 2)
            i = j
        i += 1
    peaks = np.array(peaks, int)
    if distance > 1 and len(peaks):
        keep = np.ones(len(peaks), bool)
        at = peaks.tolist()
        for k in np.argsort(x[peaks], kind="stable")[::-1].tolist():
            if keep[k]:
                for way in (-1, 1):
                    j = k + way
                    while 0 <= j < len(at) and abs(at[j] - at[k]) < distance:
                        keep[j] = False
                        j += way
        peaks = peaks[keep]
    heights = x[peaks] - np.maximum(_valleys(x)[peaks], _valleys(x[::-1])[::-1][peaks])
    good = heights >= prominence
    return peaks[good], heights[good]


def thin(positions, distance: int) -> list[int]:
    """Positions in order, each at least ``distance`` after the last one kept."""
    kept: list[int] = []
    for p in sorted(positions):
        if not kept or p - kept[-1] >= distance:
            kept.append(int(p))
    return kept


def correlation_lags(a: np.ndarray, b: np.ndarray, max_lag: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lags and normalised cross-correlation of two series; positive lags mean that a comes later."""
    a, b = fill_linear(a), fill_linear(b)
    n = min(len(a), len(b))
    a, b = a[:n] - a[:n].mean(), b[:n] - b[:n].mean()
    scale = math.sqrt((a * a).sum() * (b * b).sum())
    r = np.correlate(a, b, "full") / scale if scale > 0 else np.zeros(2 * n - 1)
    lags = np.arange(-(n - 1), n)
    near = np.abs(lags) <= (n // 4 if max_lag is None else max_lag)
    return lags[near], r[near]


# ---------------------------------------------------------------- spectra


def harmonic_ratio(x: np.ndarray, harmonics: int = 20) -> float:
    """Sum of even over odd harmonics of a stride; 0 where there are no odd ones."""
    size = np.abs(np.fft.rfft(x - np.mean(x)))[1 : harmonics + 1]
    odd, even = size[0::2].sum(), size[1::2].sum()
    return float(even / odd) if odd > 1e-10 else 0.0


def morlet_power(x: np.ndarray, rate: float, frequencies: np.ndarray, w0: float = 5.0) -> np.ndarray:
    """Power of the continuous wavelet transform, frequencies by samples, from the frequency domain."""
    n = len(x)
    size = 1 << max(1, 2 * n - 1).bit_length()
    spectrum = np.fft.fft(x - np.mean(x), size)
    omega = 2 * np.pi * np.fft.fftfreq(size, 1 / rate)
    out = np.empty((len(frequencies), n))
    for k, f in enumerate(frequencies):
        scale = w0 / (2 * np.pi * f)
        window = np.pi**-0.25 * np.sqrt(2 * np.pi * scale * rate) * np.exp(-0.5 * (scale * omega - w0) ** 2) * (omega > 0)
        out[k] = np.abs(np.fft.ifft(spectrum * window)[:n]) ** 2
    return out


def stft_power(x: np.ndarray, rate: float, segment: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, times and power of half-overlapping Hann windows, ends padded with zeros."""
    n = len(x)
    segment = segment or min(256, 1 << max(3, (n // 4).bit_length() - 1))
    hop = segment // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    wide = np.concatenate([np.zeros(hop), x, np.zeros(hop)])
    wide = np.concatenate([wide, np.zeros(-(len(wide) - segment) % hop)])
    frames = np.lib.stride_tricks.sliding_window_view(wide, segment)[::hop] * window
    power = np.abs(np.fft.rfft(frames, axis=1) / window.sum()).T ** 2
    return np.fft.rfftfreq(segment, 1 / rate), np.arange(frames.shape[0]) * hop / rate, power


# ---------------------------------------------------------------- shapes


def principal_components(rows: np.ndarray, n: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components, scores and explained shares; each component's largest entry is positive."""
    mean = rows.mean(axis=0)
    u, s, vt = np.linalg.svd(rows - mean, full_matrices=False)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    sign[sign == 0] = 1
    total = (s * s).sum()
    n = min(n, len(s))
    return mean, (vt * sign[:, None])[:n], (u * s * sign)[:, :n], (s * s / total if total > 0 else s * 0)[:n]


def regularity(y: np.ndarray, rate: float, shortest: float = 0.3, longest: float = 1.5) -> tuple[float, float] | tuple[float, None] | tuple[None, None]:
    """Autocorrelation at the first peak from ``shortest`` to ``longest`` seconds, and at the first from there and ``shortest`` more to three times that lag."""
    known = ~np.isnan(y)
    if len(y) < 30 or known.sum() < 30:
        return None, None
    v = fill_linear(y)
    v = v - v.mean()
    r = np.correlate(v, v, "full")[len(v) - 1 :]
    if r[0] <= 0:
        return None, None
    r = r / r[0]
    least, most = max(1, int(shortest * rate)), min(len(r) - 1, int(longest * rate))

    def first(a: int, b: int) -> int | None:
        """The first place within r[a:b], its ends excluded, above both neighbours; of a level top the middle."""
        k = a + 1
        while k < b - 1:
            end = k
            while end < b - 1 and r[end + 1] == r[k]:
                end += 1
            if r[k] > r[k - 1] and end < b - 1 and r[end + 1] < r[k]:
                return (k + end) // 2
            k = end + 1
        return None

    step = first(least, most) if most > least else None
    if step is None:
        return None, None
    stride = first(step + least, min(len(r) - 1, 3 * step))
    return float(r[step]), None if stride is None else float(r[stride])


def procrustes(points: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Points moved, turned and scaled onto target in the plane, and the distance left; rows with NaN are left out of the fit."""
    known = ~(np.isnan(points).any(axis=1) | np.isnan(target).any(axis=1))
    if known.sum() < 2:
        return points.copy(), float("nan")
    p, t = points[known], target[known]
    a, b = p - p.mean(axis=0), t - t.mean(axis=0)
    size = (a * a).sum()
    if size < 1e-20:
        return points - p.mean(axis=0) + t.mean(axis=0), float(np.sqrt((b * b).sum()))
    dot, cross = (a * b).sum(), (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum()
    angle, scale = math.atan2(cross, dot), math.hypot(dot, cross) / size
    turn = np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]])
    moved = scale * (points - p.mean(axis=0)) @ turn + t.mean(axis=0)
    return moved, float(np.sqrt(((moved[known] - t) ** 2).sum()))


def multiple_correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    """Coefficient of multiple correlation of two waveforms; null for constant ones."""
    y = np.vstack([a, b])
    within = ((y - y.mean(axis=0)) ** 2).sum() / y.shape[1]
    total = ((y - y.mean()) ** 2).sum() / (y.size - 1)
    return math.sqrt(max(0.0, 1 - within / total)) if total > 0 else None


def resample(x: np.ndarray, points: int = 101) -> np.ndarray:
    """A curve at equally spaced points."""
    return np.interp(np.linspace(0, len(x) - 1, points), np.arange(len(x)), x)
