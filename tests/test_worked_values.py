"""Values worked out by hand or by plain NumPy, and what only some inputs bring out."""

import math

import numpy as np
import pytest

from kinelake.functions import kernels as K
from kinelake.operators import analysis, events, pose, quality
from kinelake.plans import kernel_queries
from kinelake.plans.series_queries import RATE
from kinelake.sources import pivot
from kinelake.sources.driver_tables import event_series
from tests.conftest import DATA, as_documents, requires_data, walking

COCO = "NOSE LEFT_EYE RIGHT_EYE LEFT_EAR RIGHT_EAR LEFT_SHOULDER RIGHT_SHOULDER LEFT_ELBOW RIGHT_ELBOW LEFT_WRIST RIGHT_WRIST LEFT_HIP RIGHT_HIP LEFT_KNEE RIGHT_KNEE LEFT_ANKLE RIGHT_ANKLE".split()
STEPS = np.arange(240) + 0.37  # no value is exactly 0


def tracks(**changes):
    """Series of a walk to the right by name; feet swing, knees swing less, the right side is half a period behind."""
    out = {f"{s}_{n}_{a}": np.full(240, 0.5) for s in ("LEFT", "RIGHT") for n in ("HIP", "KNEE", "ANKLE", "HEEL", "FOOT_INDEX") for a in "xy"}
    for side, phase in (("LEFT", 0.0), ("RIGHT", math.pi)):
        swing = np.sin(2 * np.pi * STEPS / 30 + phase)
        for name, reach in (("KNEE", 0.04), ("ANKLE", 0.08), ("HEEL", 0.08), ("FOOT_INDEX", 0.08)):
            out[f"{side}_{name}_x"] = 0.5 + reach * swing + (0.03 if name == "FOOT_INDEX" else 0.0)
            out[f"{side}_{name}_y"] = 0.8 + 0.02 * np.cos(2 * np.pi * STEPS / 30 + phase)
    return out | changes


def test_crossing_gives_lift_offs_to_the_other_side():
    found = events.crossing(tracks(), 30.0, 0.4, 6.0)
    for side, other in (("left", "right"), ("right", "left")):
        contacts = [p for p, _ in found[side, "hs"]]
        assert len(contacts) >= 7 and all(abs(b - a - 30) <= 1 for a, b in zip(contacts, contacts[1:], strict=False))
        assert [p for p, _ in found[other, "to"]] == [max(0, p - 1) for p in contacts]
        assert {q for _, q in found[side, "hs"]} == {0.8} and {q for _, q in found[side, "to"]} == {0.7}
    left, right = ([p for p, _ in found[s, "hs"]] for s in ("left", "right"))
    assert all(min(abs(p - q) for q in right) >= 14 for p in left)
    unseen = events.crossing(tracks(LEFT_KNEE_x=np.full(240, np.nan)), 30.0, 0.4, 6.0)
    assert all(v == [] for v in unseen.values())


@pytest.mark.parametrize("method", [events.velocity, events.pelvis_velocity])
def test_ankles_stand_in_for_heels_and_toes(method):
    lost = {f"{s}_{n}_{a}": np.full(240, np.nan) for s in ("LEFT", "RIGHT") for n in ("HEEL", "FOOT_INDEX") for a in "xy"}
    whole, coco = method(tracks(), 30.0, 0.4, 6.0), method(tracks(**lost), 30.0, 0.4, 6.0)
    for key in whole:
        assert len(coco[key]) >= 7
        assert len(whole[key]) == len(coco[key])
        assert all(abs(p - q) <= 1 for (p, _), (q, _) in zip(whole[key], coco[key], strict=True))
    none = method(tracks(**lost, **{f"{s}_ANKLE_{a}": np.full(240, np.nan) for s in ("LEFT", "RIGHT") for a in "xy"}), 30.0, 0.4, 6.0)
    assert all(v == [] for v in none.values())
    assert {q for v in whole.values() for _, q in v} == {0.75 if method is events.velocity else 0.8}


def test_detectors_take_recordings_that_end_at_the_ankle(spark):
    doc = walking(240)
    for frame in doc["frames"]:
        frame["landmarks"] = {k: v for k, v in frame["landmarks"].items() if k in COCO}
    docs = as_documents(spark, [doc])
    poses = pivot.poses(docs)
    for method in ("zeni", "oconnor", "crossing"):
        found = events.detect_events(poses, docs, method).filter("kind = 'hs'").count()
        assert found >= 8, method


def hips(xs, shift=0.0, femur=0.2):
    return [{"frame_idx": i, "time_s": i / 30, "confidence": 1.0, "landmarks": {"LEFT_HIP": {"x": x, "y": 0.5, "visibility": 1.0}, "RIGHT_HIP": {"x": x + shift, "y": 0.5 + shift, "visibility": 1.0}, "LEFT_KNEE": {"x": x, "y": 0.5 + femur, "visibility": 1.0}, "RIGHT_KNEE": {"x": x + shift, "y": 0.5 + shift + femur, "visibility": 1.0}}} for i, x in enumerate(xs)]


def posed(spark, frames):
    return pivot.poses(as_documents(spark, [walking(1) | {"frames": frames}]))


@pytest.mark.parametrize(("xs", "expected"), [
    ([0.50, 0.52, 0.54], (True, 0.6)),  # 1 - 0.04 / 0.1
    ([0.50, 0.59], (True, 0.5)),  # a half at least
    ([0.40, 0.45, 0.52], (False, 0.5)),  # little variance, but too far
    ([0.30, 0.49], (False, 0.1)),  # 1 - (0.19 - 0.1) / 0.1
    ([0.1, 0.9], (False, 0.0)),
    ([0.5], (False, 0.0)),
])
def test_treadmill_confidence(spark, xs, expected):
    r = quality.treadmill(posed(spark, hips(xs))).first()
    assert r["treadmill"] == expected[0]
    var = np.var(xs)
    sure = expected[1] if not (var < 0.005 and not expected[0] and len(xs) > 1) else 0.5
    assert r["confidence"] == pytest.approx(sure)


def test_sagittal_ratio_is_of_whole_distances(spark):
    r = quality.sagittal_alignment(posed(spark, hips([0.4, 0.5], shift=0.03))).first()
    ratio = math.hypot(0.03, 0.03) / 0.2
    assert (r["ratio"], r["degrees"]) == (pytest.approx(ratio), pytest.approx(math.degrees(math.asin(ratio))))
    assert r["aligned"] and r["confidence"] == 1.0


def test_harmonic_ratio_by_a_fourier_transform(spark, rng):
    x = np.sin(2 * np.pi * np.arange(90) / 45) + 0.4 * np.sin(2 * np.pi * np.arange(90) / 90) + 0.05 * rng.normal(size=90)
    gaps = x.copy()
    gaps[[0, 7, 8, 40, 89]] = np.nan
    known = ~np.isnan(gaps)
    filled = np.interp(np.arange(90), np.flatnonzero(known), gaps[known])
    size = np.abs(np.fft.rfft(filled - filled.mean()))[1:21]
    df = spark.createDataFrame([("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(gaps)] + [("b", i, 1.0) for i in range(59)], "trial_id string, pos int, value double")
    for forward, expected in ((False, size[1::2].sum() / size[::2].sum()), (True, size[::2].sum() / size[1::2].sum())):
        got = {r["trial_id"]: r["ratio"] for r in analysis.harmonic_ratio(df, ["trial_id"], "value", forward).collect()}
        assert got["a"] == pytest.approx(expected) and got["b"] is None


def test_arm_swing_is_reduced_by_the_mean(spark):
    rows = [("a", 0.0, 0.0, 0.0, 0.0, 0.0), ("a", 8.0, 14.0, -1.0, 0.0, 0.0), ("b", 0.0, None, 0.0, 0.1, 0.2), ("b", 30.0, None, 0.0, 0.15, 0.26)]
    df = spark.createDataFrame(rows, "trial_id string, left double, right double, hip double, wrist_left double, wrist_right double")
    got = {r["trial_id"]: r for r in analysis.arm_swing(df).collect()}
    assert (got["a"]["left"], got["a"]["right"], got["a"]["reduced"], got["a"]["coordination"]) == (8, 14, False, pytest.approx(100))
    assert (got["b"]["left"], got["b"]["right"], got["b"]["reduced"]) == (pytest.approx(5), pytest.approx(6), True)
    assert got["b"]["coordination"] is None


def test_frontal_angles_by_hand(spark):
    frame = {"frame_idx": 0, "time_s": 0.0, "confidence": 1.0, "landmarks": {n: {"x": x, "y": 0.5, "visibility": 1.0} for n, x in (("LEFT_HIP", 0.5), ("LEFT_KNEE", 0.6), ("LEFT_ANKLE", 0.6))}, "landmark_depths": {"LEFT_HIP": 0.0, "LEFT_KNEE": 0.1, "LEFT_ANKLE": 0.3}}
    r = pose.frontal_angles(posed(spark, [frame])).first()
    assert r["hip_abduction_L"] == pytest.approx(45) and r["knee_valgus_L"] == pytest.approx(45)
    assert r["hip_abduction_R"] is None and r["knee_valgus_R"] is None


def test_kalman_by_matrices(rng):
    """The same smoother as one weighted least-squares problem: observations, steps and the beginning all weigh 1."""
    x = rng.normal(size=40).cumsum()
    n = len(x)
    steps = np.eye(n)[1:] - np.eye(n)[:-1]
    begin = np.eye(n)[:1]
    rows = np.vstack([np.eye(n), steps, begin])
    best = np.linalg.lstsq(rows, np.concatenate([x, np.zeros(n - 1), x[:1]]), rcond=None)[0]
    assert K.kalman_smooth(x) == pytest.approx(best)
    x[[0, 5, 6, 39]] = np.nan
    assert not np.isnan(K.kalman_smooth(x)).any()


def test_zero_phase_by_a_plain_recursion(rng):
    """Forward and backward from the steady state of an odd extension, sample by sample."""
    b, a = K.butterworth(2, 4.0, 30.0)
    x = rng.normal(size=60).cumsum()
    edge = 3 * max(len(a), len(b))
    wide = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]])

    def once(v):
        # Direct form I on a signal that was at v[0] for ever.
        past_x, past_y = [v[0]] * 2, [v[0]] * 2
        out = []
        for value in v:
            y = b[0] * value + b[1] * past_x[0] + b[2] * past_x[1] - a[1] * past_y[0] - a[2] * past_y[1]
            past_x, past_y = [value, past_x[0]], [y, past_y[0]]
            out.append(y)
        return np.array(out)

    expected = once(once(wide)[::-1])[::-1][edge:-edge]
    assert K.zero_phase(b, a, x) == pytest.approx(expected, abs=1e-8)


def test_lowess_by_plain_least_squares(rng):
    """Tricube-weighted lines over the nearest share of points, without re-weighting rounds."""
    y = np.sin(np.arange(50) / 6) + 0.1 * rng.normal(size=50)
    share, n = 0.3, 50
    k = int(share * n + 1e-10)
    expected = []
    for i in range(n):
        d = np.abs(np.arange(n) - i).astype(float)
        reach = np.sort(d)[k - 1]
        w = np.where(d <= 0.999 * reach, (1 - np.minimum(1, d / reach) ** 3) ** 3, 0)
        fit = np.polyfit(np.arange(n), y, 1, w=np.sqrt(w))
        expected.append(np.polyval(fit, i))
    assert K.lowess(y, share, 0) == pytest.approx(np.array(expected), abs=1e-6)


@requires_data
def test_offset_query_finds_the_shift(spark):
    rows = {r["trial_id"]: r["n"] for r in event_series(spark, DATA).groupBy("trial_id").count().withColumnRenamed("count", "n").collect()}
    got = {r["trial_id"]: r for r in kernel_queries.estimate_offset(spark, DATA).collect()}
    long = [t for t, n in rows.items() if n >= 16 and t in got]
    assert len(long) >= 5
    right = [t for t in long if abs(abs(got[t]["offset"]) * RATE - t % 4) < 0.51]
    assert len(right) >= 0.9 * len(long)
    assert len({round(abs(got[t]["offset"]) * RATE) for t in right}) == 4
