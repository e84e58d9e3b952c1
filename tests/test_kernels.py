"""Kernels against closed forms."""

import numpy as np
import pytest

from kinelake.functions import kernels as K


def test_butterworth_of_second_order():
    b, a = K.butterworth(2, 4.0, 30.0)
    assert b == pytest.approx([0.10844744, 0.21689488, 0.10844744], abs=1e-8)
    assert a == pytest.approx([1, -0.87727063, 0.31106039], abs=1e-8)


@pytest.mark.parametrize("order", [1, 2, 4, 6])
def test_filters_pass_a_constant(order):
    b, a = K.butterworth(order, 3.0, 50.0)
    assert b.sum() / a.sum() == pytest.approx(1)
    assert K.zero_phase(b, a, np.full(120, 3.5)) == pytest.approx(np.full(120, 3.5))


def test_zero_phase_keeps_slow_and_removes_fast():
    t = np.arange(600) / 100
    slow, fast = np.sin(2 * np.pi * t), np.sin(2 * np.pi * 30 * t)
    out = K.lowpass(slow + fast, 6.0, 100.0)
    assert np.abs(out - slow)[60:-60].max() < 0.02


def test_short_series():
    with pytest.raises(ValueError):
        K.zero_phase(*K.butterworth(2, 4, 30), np.ones(5))
    assert K.lowpass(np.ones(5), 4, 30).tolist() == [1] * 5
    assert K.lowess(np.array([1.0, 2.0])).tolist() == [1, 2]
    assert K.wavelet_denoise(np.arange(5.0)).tolist() == list(range(5))
    assert len(K.find_peaks(np.array([]))[0]) == 0


def test_savgol_is_exact_on_parabolas():
    x = np.arange(40.0)
    y = 2 * x**2 - 3 * x + 1
    assert K.savgol(y, 9, 2) == pytest.approx(y)


def test_median_removes_a_spike():
    x = np.zeros(101)
    x[50] = 1000
    assert K.median_filter(x).max() == 0


def test_moving_mean_of_even_window_looks_back():
    assert K.moving_mean(np.array([1.0, 2, 3, 4]), 2).tolist() == [1, 1.5, 2.5, 3.5]
    assert K.moving_mean(np.array([1.0, np.nan, 3.0]), 3).tolist() == [1, 2, 3]


def test_lowess_is_exact_on_lines_and_resists_spikes(rng):
    y = 2 * np.arange(60.0) + 1
    assert K.lowess(y, 0.3) == pytest.approx(y)
    spiked = y + rng.normal(0, 0.5, 60)
    spiked[30] += 500
    assert abs(K.lowess(spiked, 0.3)[30] - y[30]) < 5


def test_cubic_spline_is_exact_on_cubics():
    x = np.arange(8.0)
    at = np.array([0.5, 3.25, 6.9])
    assert K.cubic_spline(x, x**3 - x, at) == pytest.approx(at**3 - at)


def test_smoothing_spline_meets_its_limit(rng):
    y = np.sin(np.arange(100) / 10) + rng.normal(0, 0.1, 100)
    assert ((K.smoothing_spline(y, 0.5) - y) ** 2).sum() == pytest.approx(0.5, rel=1e-3)


@pytest.mark.parametrize("n", [16, 63, 64, 101, 200])
def test_wavelet_is_invertible(n, rng):
    x = rng.normal(size=n)
    a, d = K.dwt(x)
    assert K.idwt(a, d, n) == pytest.approx(x, abs=1e-9)


@pytest.mark.parametrize("smooth", [K.wavelet_denoise, K.kalman_smooth])
def test_smoothers_come_nearer_to_the_truth(smooth, rng):
    truth = np.sin(np.arange(256) / 12)
    noisy = truth + rng.normal(0, 0.2, 256)
    assert np.std(smooth(noisy) - truth) < np.std(noisy - truth)


def test_peaks():
    x = np.array([0, 1, 0, 2, 0, 3, 3, 3, 0, 1.0, 0])
    assert K.find_peaks(x)[0].tolist() == [1, 3, 6, 9]
    assert K.find_peaks(x, prominence=1.5)[0].tolist() == [3, 6]
    assert K.find_peaks(x, distance=3)[0].tolist() == [3, 6, 9]


def test_lag_of_a_shifted_series(rng):
    a = rng.normal(size=300)
    lags, r = K.correlation_lags(np.roll(a, 7), a)
    assert lags[r.argmax()] == 7


def test_frequencies():
    t = np.arange(512) / 64
    x = np.sin(2 * np.pi * 4 * t)
    f = np.linspace(1, 10, 37)
    assert f[K.morlet_power(x, 64, f).mean(axis=1).argmax()] == pytest.approx(4, abs=0.3)
    g, _, p = K.stft_power(x, 64)
    assert g[p.mean(axis=1).argmax()] == pytest.approx(4, abs=0.5)


def test_harmonic_ratio():
    t = np.arange(200) / 200
    assert K.harmonic_ratio(np.sin(4 * np.pi * t) + 0.5 * np.sin(2 * np.pi * t)) == pytest.approx(2, rel=1e-6)
    assert K.harmonic_ratio(np.ones(50)) == 0


def test_components_rebuild(rng):
    x = rng.normal(size=(10, 30))
    mean, parts, scores, share = K.principal_components(x, 9)
    assert mean + scores @ parts == pytest.approx(x)
    assert share.sum() == pytest.approx(1)


def test_procrustes_undoes_a_turn(rng):
    p = rng.normal(size=(8, 2))
    c, s = np.cos(0.7), np.sin(0.7)
    moved, left = K.procrustes(2 * p @ np.array([[c, s], [-s, c]]) + 3, p)
    assert moved == pytest.approx(p)
    assert left == pytest.approx(0, abs=1e-9)


def test_multiple_correlation():
    x = np.sin(np.arange(50))
    assert K.multiple_correlation(x, x) == pytest.approx(1)
    assert K.multiple_correlation(np.ones(5), np.ones(5)) is None


def test_fill():
    assert K.fill_linear(np.array([np.nan, 1, np.nan, 3, np.nan])).tolist() == [1, 1, 2, 3, 3]
    assert np.isnan(K.fill_linear(np.full(3, np.nan))).all()
