"""Queries without SQL, against plain computations that share nothing with the kernels."""

import math

import duckdb
import numpy as np
import pytest

from kinelake.plans.registry import QUERIES
from kinelake.plans.series_queries import RATE
from tests.conftest import DATA, requires_data

TESTED = {"lowess_smooth", "wavelet_denoise", "spline_smooth", "spline_gap_fill", "normalize_chain", "residual_cutoff", "find_peaks", "morlet_dominant", "waveform_pca", "procrustes", "detect_events", "detect_events_in_sql"}
pytestmark = requires_data


@pytest.fixture(scope="module")
def values():
    """Each user's values by time."""
    rows = duckdb.sql(f"SELECT user_id::VARCHAR AS u, value FROM '{DATA}/events.parquet' ORDER BY user_id, ts, event_id").fetchall()
    out: dict[str, list] = {}
    for u, v in rows:
        out.setdefault(u, []).append(v)
    return {u: np.array(v) for u, v in out.items()}


def series(spark, name):
    out: dict[str, dict] = {}
    for r in QUERIES[name](spark, DATA).collect():
        out.setdefault(str(r["trial_id"]), {})[r["pos"]] = r[-1]
    return {u: np.array([v[k] for k in sorted(v)], float) for u, v in out.items()}


def plain_lowess(y, share):
    n, k = len(y), min(len(y), max(2, int(share * len(y) + 1e-10)))
    if n < 3:
        return y
    x, robust, fit = np.arange(n), np.ones(n), y
    for _ in range(4):
        fit = y.copy()
        for i in range(n):
            left = min(max(i - k // 2, 0), n - k)
            while left + k < n and left + k - i < i - left:
                left += 1
            d = np.abs(x[left : left + k] - i)
            w = np.array([0 if v > 0.999 * d.max() else 1 if v <= 0.001 * d.max() else (1 - (v / d.max()) ** 3) ** 3 for v in d]) * robust[left : left + k]
            if w.sum() > 0:
                if (w > 0).sum() > 1:
                    a, b = np.polyfit(x[left : left + k], y[left : left + k], 1, w=np.sqrt(w))
                    fit[i] = a * i + b
                else:
                    fit[i] = (w * y[left : left + k]).sum() / w.sum()
        far = np.abs(y - fit)
        scale = 6 * np.median(far)
        if scale <= 1e-12:
            break
        robust = np.array([0 if v >= 0.999 * scale else 1 if v <= 0.001 * scale else (1 - (v / scale) ** 2) ** 2 for v in far])
    return fit


def test_lowess(spark, values):
    mine = series(spark, "lowess_smooth")
    assert set(mine) == set(values)
    for u, v in values.items():
        assert mine[u] == pytest.approx(plain_lowess(v, 0.2), abs=1e-3)


def plain_peaks(x, distance, prominence):
    top = []
    for i in range(1, len(x) - 1):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            top.append((i + j) // 2)
    for p in sorted(top, key=lambda p: (x[p], p), reverse=True):
        if p in top:
            top = [q for q in top if q == p or abs(q - p) >= distance]
    out = {}
    for p in top:
        valleys = []
        for way in (-1, 1):
            q, low = p, x[p]
            while 0 <= q < len(x) and x[q] <= x[p]:
                low = min(low, x[q])
                q += way
            valleys.append(low)
        if x[p] - max(valleys) >= prominence:
            out[p] = x[p] - max(valleys)
    return out


def test_peaks(spark, values):
    mine: dict[str, dict] = {}
    for r in QUERIES["find_peaks"](spark, DATA).collect():
        mine.setdefault(str(r["trial_id"]), {})[r["pos"]] = r["prominence"]
    assert mine
    for u, v in values.items():
        assert mine.get(u, {}) == pytest.approx(plain_peaks(v, 3, 20.0), abs=1e-5)


def test_peaks_of_steps_and_ties():
    from kinelake.functions import kernels as K

    rng = np.random.default_rng(3)
    for n in (3, 10, 60):
        for _ in range(50):
            x = rng.integers(0, 5, n).astype(float)
            at, height = K.find_peaks(x, 3, 1.0)
            assert dict(zip(at.tolist(), height.tolist(), strict=True)) == plain_peaks(x, 3, 1.0)


def test_smoothing_spline(spark, values):
    """The residuals meet the limit, and no smoother curve does: the fit is the solution of its own penalised equations."""
    for u, mine in series(spark, "spline_smooth").items():
        v = values[u]
        n = len(v)
        if n < 4:
            assert mine == pytest.approx(v)
            continue
        left = ((v - mine) ** 2).sum()
        line = np.polyval(np.polyfit(np.arange(n), v, 1), np.arange(n))
        assert left <= 500 + 1e-2
        if ((v - line) ** 2).sum() > 500:
            assert left == pytest.approx(500, abs=1e-2)
        d2 = np.diff(np.eye(n), 2, axis=0)
        band = 2 / 3 * np.eye(n - 2) + 1 / 6 * (np.eye(n - 2, k=1) + np.eye(n - 2, k=-1))
        pull = d2.T @ np.linalg.solve(band, d2 @ mine)  # what the penalty pulls by is in proportion to the residuals
        share = (pull @ (v - mine)) / max(pull @ pull, 1e-12)
        if left > 1:
            assert v - mine == pytest.approx(share * pull, abs=1e-2)


def test_gap_spline(spark, values):
    mine = series(spark, "spline_gap_fill")
    for u, v in values.items():
        known = np.arange(len(v)) % 7 != 3
        assert mine[u][known] == pytest.approx(v[known], abs=1e-5)
        x = np.flatnonzero(known)
        if len(x) != 4:
            continue
        cubic = np.polyval(np.polyfit(x, v[x], 3), np.arange(len(v)))  # four knots have one cubic
        inside = ~known & (np.arange(len(v)) < x[-1])
        assert mine[u][inside] == pytest.approx(cubic[inside], abs=1e-4)


def test_components(spark):
    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM '{DATA}/embeddings.parquet'").fetchall()
    groups: dict = {}
    for i, label, e in rows:
        groups.setdefault((("hip", "knee", "ankle")[label % 3], "left" if i % 2 == 0 else "right"), []).append(np.array(e, float) * 60)
    mine = {(r["joint"], r["side"], r["component"]): r["explained"] for r in QUERIES["waveform_pca"](spark, DATA).collect()}
    assert len(mine) == 3 * len(groups)
    for (joint, side), curves in groups.items():
        values = np.sort(np.linalg.eigvalsh(np.cov(np.array(curves).T)))[::-1]
        for k in range(3):
            assert mine[joint, side, k] == pytest.approx(values[k] / values.sum(), abs=1e-5)


def test_morlet(spark, values):
    """Power as sums over time, where neither the sampling nor the ends come into it; the query gives its largest mean."""
    from kinelake.functions import kernels as K

    v = np.random.default_rng(5).normal(0, 1, 200)
    some = np.linspace(0.3, 1.0, 8)
    t = np.arange(len(v))
    for f, power in zip(some, K.morlet_power(v, RATE, some), strict=True):
        s = 5.0 / (2 * math.pi * f)
        z = (t[:, None] - t[None, :]) / RATE / s
        wave = math.pi**-0.25 / math.sqrt(s * RATE) * np.exp(1j * 5.0 * z - z * z / 2)
        assert power == pytest.approx(np.abs(((v - v.mean())[:, None] * np.conj(wave)).sum(axis=0)) ** 2, rel=1e-2, abs=1e-2)
    mine = {str(r["trial_id"]): r["dominant"] for r in QUERIES["morlet_dominant"](spark, DATA).collect()}
    assert set(mine) == {u for u, v in values.items() if len(v) >= 8}
    frequencies = np.linspace(0.1, min(2.0, RATE / 2), 20)
    for u, top in mine.items():
        assert top == pytest.approx(frequencies[K.morlet_power(values[u], RATE, frequencies).mean(axis=1).argmax()], abs=1e-5)


def test_shapes(spark):
    """Each frame moved, turned and scaled by one complex line, whose coefficients are those of least squares onto the mean."""
    rows = duckdb.sql(f"SELECT vec_id // 20 AS t, vec_id % 20 AS pos, embedding[1:42] AS e FROM '{DATA}/embeddings.parquet' ORDER BY 1, 2").fetchall()
    given: dict = {}
    for t, pos, e in rows:
        given.setdefault(str(t), {})[pos] = np.array(e[0::2], float) + 1j * np.array(e[1::2], float) + (0.5 + 0.5j)
    from kinelake.sources.driver_tables import VECTOR_LANDMARKS

    mine: dict = {}
    for r in QUERIES["procrustes"](spark, DATA).collect():
        mine.setdefault(str(r["trial_id"]), {}).setdefault(r["pos"], {})[r["name"]] = complex(r["x"], r["y"])
    assert set(mine) == set(given)
    for t, frames in given.items():
        moved = {p: np.array([mine[t][p][n] for n in VECTOR_LANDMARKS]) for p in frames}
        mean = frames[min(frames)]
        for _ in range(10):
            fitted = {}
            for p, z in frames.items():
                c = z - z.mean()
                fitted[p] = np.vdot(c, mean - mean.mean()) / np.vdot(c, c) * c + mean.mean()
            new = np.mean(list(fitted.values()), axis=0)
            done, mean = max(np.abs((new - mean).real).max(), np.abs((new - mean).imag).max()) < 1e-9, new
            if done:
                break
        for p in frames:
            assert moved[p] == pytest.approx(fitted[p], abs=1e-4)


def test_wavelet_takes_details_only(spark, values):
    """Short series stay; others lose energy, yet keep their mean about."""
    for u, mine in series(spark, "wavelet_denoise").items():
        v = values[u]
        if len(v) < 14:
            assert mine == pytest.approx(v, abs=1e-5)
        else:
            assert np.square(np.diff(mine)).sum() < np.square(np.diff(v)).sum()
            assert abs(mine.mean() - v.mean()) < v.std()


def test_chain_and_cutoffs(spark, values):
    """The chain is the low-pass of series without outliers; cutoffs are among those asked for."""
    chain = series(spark, "normalize_chain")
    assert {u: len(v) for u, v in chain.items()} == {u: len(v) for u, v in values.items()}
    raw = series(spark, "butterworth_zero_phase")
    for u, v in values.items():
        if len(v) > 15 and (np.abs(v - v.mean()) < 1.9 * v.std()).all():
            assert chain[u] == pytest.approx(raw[u], abs=20)
    knees = QUERIES["residual_cutoff"](spark, DATA).collect()
    assert len({r["trial_id"] for r in knees}) > 0
    assert all(r["knee"] is None or 0.25 <= r["knee"] <= 1.75 for r in knees)


def test_events_are_extremes(spark):
    found = QUERIES["detect_events"](spark, DATA).collect()
    frames = {(r["trial_id"], r["side"], r["kind"], r["frame"]) for r in found}
    assert len(frames) == len(found)
    n = dict(duckdb.sql(f"SELECT (vec_id // 20)::VARCHAR, count(*) FROM '{DATA}/embeddings.parquet' GROUP BY 1").fetchall())
    assert all(0 <= f < n[t] and s in ("left", "right") and k in ("hs", "to") for t, s, k, f in frames)
