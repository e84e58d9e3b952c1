"""Corrections of labels, segments, ankles and landmarks, and the whole recipe."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import corrections, cycles, pose, validation
from kinelake.plans import pipeline
from kinelake.sources import pivot
from tests.conftest import as_documents, walking


def points(df, *names):
    rows = df.orderBy("trial_id", "pos").select(*[c.alias(f"{n}_{a}") for n in names for a, c in (("x", pose.x(n)), ("y", pose.y(n)))]).collect()
    return {n: np.array([[r[f"{n}_x"], r[f"{n}_y"]] for r in rows], float) for n in names}


def changed(n=60, change=None, **more):
    doc = walking(n, **more)
    for f in doc["frames"]:
        if change:
            change(f["frame_idx"], f["landmarks"])
    return doc


def test_right_segments_take_the_left_ones_median_length(spark):
    def shorter(i, lm):
        for k, name in enumerate(("RIGHT_KNEE", "RIGHT_ANKLE", "RIGHT_HEEL")):
            lm[name] = lm[name] | {"y": lm[name]["y"] - 0.02 * (k + 1)}

    df = pivot.poses(as_documents(spark, [changed(change=shorter)]))
    names = [f"{s}_{n}" for s in ("LEFT", "RIGHT") for n in ("HIP", "KNEE", "ANKLE", "HEEL")]
    before, after = points(df, *names), points(pose.match_sides(df), *names)
    expected = {n: v.copy() for n, v in before.items()}
    for a, b in (("HIP", "KNEE"), ("KNEE", "ANKLE"), ("ANKLE", "HEEL")):
        length = {s: np.median(np.linalg.norm(expected[f"{s}_{b}"] - expected[f"{s}_{a}"], axis=1)) for s in ("LEFT", "RIGHT")}
        expected[f"RIGHT_{b}"] = expected[f"RIGHT_{a}"] + (expected[f"RIGHT_{b}"] - expected[f"RIGHT_{a}"]) * length["LEFT"] / length["RIGHT"]
    for n in names:
        assert after[n] == pytest.approx(expected[n])
    assert not np.allclose(before["RIGHT_ANKLE"], after["RIGHT_ANKLE"])


def test_pairs_are_put_right_one_by_one(spark):
    def apart(i, lm):
        for n in pose.SIDE_PAIRS:
            for s, d in (("LEFT", -0.05), ("RIGHT", 0.05)):
                y = {"SHOULDER": 0.25, "HIP": 0.5, "KNEE": 0.65, "ANKLE": 0.8, "HEEL": 0.82, "FOOT_INDEX": 0.83}[n]
                lm[f"{s}_{n}"] = {"x": 0.5 + d + 0.001 * i, "y": y, "visibility": 1.0}

    def wrong(i, lm):
        apart(i, lm)
        if 20 <= i < 30:
            for n in ("ANKLE", "HEEL", "FOOT_INDEX"):
                lm[f"LEFT_{n}"], lm[f"RIGHT_{n}"] = lm[f"RIGHT_{n}"], lm[f"LEFT_{n}"]

    names = [f"{s}_{n}" for s in ("LEFT", "RIGHT") for n in pose.SIDE_PAIRS]
    right = points(pivot.poses(as_documents(spark, [changed(change=apart)])), *names)
    mended = pose.correct_pair_labels(pivot.poses(as_documents(spark, [changed(change=wrong)])))
    assert mended.count() == 60
    got = points(mended, *names)
    for n in names:
        assert got[n] == pytest.approx(right[n])


def test_toes_stand_for_the_foot_where_both_are_seen(spark):
    def toes(i, lm):
        if i % 2:
            lm["LEFT_BIG_TOE"], lm["LEFT_SMALL_TOE"] = {"x": 0.6, "y": 0.84, "visibility": 1.0}, {"x": 0.58, "y": 0.86, "visibility": 1.0}

    df = pivot.poses(as_documents(spark, [changed(4, toes)]))
    x, y = pose.toe("LEFT")
    got = [tuple(r) for r in df.orderBy("pos").select(x, y).collect()]
    own = points(df, "LEFT_FOOT_INDEX")["LEFT_FOOT_INDEX"]
    assert got[1] == got[3] == pytest.approx((0.59, 0.85)) and got[0] == pytest.approx(tuple(own[0]))


def test_sliding_ankles_are_taken_out(spark):
    slide = [0.01 * math.sin(i / 3) for i in range(60)]

    def flat(i, lm):
        lm["LEFT_HEEL"], lm["LEFT_FOOT_INDEX"] = {"x": 0.45, "y": 0.9, "visibility": 1.0}, {"x": 0.6, "y": 0.9 if i < 40 else 0.85, "visibility": 1.0}
        lm["LEFT_ANKLE"], lm["LEFT_KNEE"] = {"x": 0.47 + slide[i], "y": 0.88, "visibility": 1.0}, {"x": 0.47, "y": 0.7, "visibility": 1.0}

    df = pivot.poses(as_documents(spark, [changed(change=flat)]))
    angles = df.select("trial_id", "frame_idx", "pos", pose.ankle("LEFT").alias("ankle_L"), pose.ankle("RIGHT").alias("ankle_R"))
    out = pose.correct_ankle_projection(df, angles).orderBy("pos").collect()
    before = np.array([r["ankle_L"] for r in angles.orderBy("pos").collect()])
    t = []
    for i in range(60):
        d = np.array([0.15, 0.0 if i < 40 else -0.05])
        t.append(np.dot([0.02 + slide[i], -0.02], d) / (d @ d))
    t = np.array(t)
    k = np.polyfit((np.median(t) - t)[:40], before[:40] - before[:40].mean(), 1)[0]
    assert [r["ankle_L"] for r in out] == pytest.approx((before - k * (np.median(t) - t)).tolist())
    assert np.std([r["ankle_L"] for r in out[:40]]) < 0.1 * np.std(before[:40])


def test_landmark_bias_is_learnt_and_taken_out(spark):
    bias = lambda phase: (0.1 * math.sin(2 * math.pi * phase), 0.05)
    true = walking(240, speed=0.01)

    def off(i, lm):
        thigh = math.hypot((lm["LEFT_KNEE"]["x"] + lm["RIGHT_KNEE"]["x"] - lm["LEFT_HIP"]["x"] - lm["RIGHT_HIP"]["x"]) / 2, 0.15)
        dx, dy = bias(i % 30 / 30)
        lm["LEFT_ANKLE"] = lm["LEFT_ANKLE"] | {"x": lm["LEFT_ANKLE"]["x"] + dx * thigh, "y": lm["LEFT_ANKLE"]["y"] + dy * thigh}

    docs, wrong = as_documents(spark, [true]), as_documents(spark, [changed(240, off, speed=0.01)])
    cut = spark.createDataFrame([("walk", k, side, 30 * k, 30 * k + 30) for k in range(7) for side in ("left", "right")], "trial_id string, cycle_id int, side string, start_frame int, end_frame int")
    phases = cycles.phase_by_frame(cut)
    offsets = spark.createDataFrame([("walk", 0.0)], "trial_id string, offset double")
    video, trials = pivot.poses(wrong), pivot.trials(wrong)
    model = corrections.fit_landmark_bias(video, trials, pivot.poses(docs), pivot.trials(docs), phases, offsets, 10, ("LEFT_ANKLE", "LEFT_HEEL"))
    found = {(r["name"], r["bin"]): r for r in model.collect()}
    assert len(found) == 20
    for b in range(10):
        assert found["LEFT_ANKLE", b]["dy"] == pytest.approx(0.05, abs=1e-6)
        assert found["LEFT_ANKLE", b]["dx"] == pytest.approx(np.mean([bias(p / 30)[0] for p in range(3 * b, 3 * b + 3)]), abs=0.02)
        assert found["LEFT_HEEL", b]["dx"] == pytest.approx(0, abs=1e-9)
    mended = corrections.remove_landmark_bias(video, trials, phases, model)
    assert mended.count() == 240
    at = lambda df: points(df, "LEFT_ANKLE")["LEFT_ANKLE"][15:200]
    assert np.abs(at(mended) - at(pivot.poses(docs))).max() < 0.4 * np.abs(at(video) - at(pivot.poses(docs))).max()
    part = corrections.filled_bias(model.filter("bin % 2 = 0"), 10).filter("name = 'LEFT_ANKLE'").orderBy("bin").collect()
    assert part[9]["dx"] == pytest.approx((part[8]["dx"] + part[0]["dx"]) / 2) and len(part) == 10


def test_cycles_of_one_direction(spark):
    cut = spark.createDataFrame([("t", k, "left", 10 * k, 10 * k + 10) for k in range(5)], "trial_id string, cycle_id int, side string, start_frame int, end_frame int")
    xs = {0: 0.1, 10: 0.3, 20: 0.5, 30: 0.5, 40: 0.3, 50: 0.1}
    at = spark.createDataFrame([("t", f, x) for f, x in xs.items()], "trial_id string, frame_idx int, x double")
    flat = lambda v: [float(v)] * 101
    curves = spark.createDataFrame([("t", k, "left", "knee", flat(-20 if k < 2 else 5)) for k in range(5)], "trial_id string, cycle_id int, side string, joint string, curve array<double>")
    assert {r["cycle_id"] for r in cycles.dominant_direction(cut, at).collect()} == {0, 1}
    assert {r["cycle_id"] for r in cycles.dominant_direction(cut, at, curves).collect()} == {3, 4}
    still = at.withColumn("x", F.lit(0.5))
    assert cycles.dominant_direction(cut, still).count() == 5
    hip = [float(min(20, k)) for k in range(101)]
    both = spark.createDataFrame([("t", 0, "left", "knee", flat(-20)), ("t", 0, "left", "hip", hip), ("t", 0, "left", "ankle", hip)], "trial_id string, cycle_id int, side string, joint string, curve array<double>")
    got = {r["joint"]: r["curve"] for r in cycles.flexion_positive(both).collect()}
    assert got["knee"] == flat(20) and got["ankle"] == hip and got["hip"] == [-v for v in hip]


def test_caveats_and_accuracy(spark):
    docs = as_documents(spark, [walking(2, trial="a") | {"extraction": {"model": "yolo", "treadmill": True}, "subject": None}, walking(2, trial="b")])
    got = {(r["trial_id"], r["parameter"]) for r in validation.caveats(pivot.trials(docs)).collect()}
    assert got == {("a", "treadmill_context"), ("a", "calibration"), ("a", "pathology_screening"), ("b", "pathology_screening")}
    assert {r["trial_id"]: r["mae_px"] for r in validation.model_accuracy(pivot.trials(docs)).collect()} == {"a": 4.0, "b": None}


def test_the_whole_recipe(spark):
    docs = as_documents(spark, [walking(300, trial="a", speed=0.02), walking(300, trial="b", period=1.2)])
    out = pipeline.run(docs, {"corrections": {"ankle_projection": True, "drift": True}})
    rows = {r["trial_id"]: r for r in out.report.collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["cadence"] == pytest.approx(120, rel=0.02) and rows["b"]["cadence"] == pytest.approx(100, rel=0.03)
    assert rows["a"]["speed"] > 0 and rows["a"]["hr_ap"] > 0 and rows["a"]["stance_pct"] is not None
    assert {"flags", "patterns", "step_length_left", "stride_time_mean_s", "overall_si", "cycle_duration_cv"} <= set(out.report.columns)
    assert out.diagnosis.count() == 2 and "trial_id" in out.phases.columns


def test_names_and_command_line(spark, tmp_path, capsys):
    import json

    import kinelake
    from kinelake import cli

    assert all(callable(getattr(kinelake, n)) for n in kinelake.__all__) and "detect_events" in dir(kinelake)
    with pytest.raises(AttributeError):
        kinelake.nothing_of_the_kind
    assert cli.main(["choices"]) == 0
    assert "zeni" in capsys.readouterr().out
    (tmp_path / "a.json").write_text(json.dumps(walking(240, trial="a")))
    assert cli.main(["analyze", f"file://{tmp_path}/a.json"]) == 0
    assert "cadence" in capsys.readouterr().out
