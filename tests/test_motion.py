"""Poses, events, cycles and figures of made-up walks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.exceptions import InvalidData, UnknownName
from kinelake.operators import analysis, corrections, cycles, events, normative, optical, pose, quality, scores, signals, validation
from kinelake.plans import pipeline
from kinelake.sources import pivot, settings, sinks
from tests.conftest import as_documents, standing, walking


@pytest.fixture(scope="module")
def poses(walk):
    return pivot.poses(walk).cache()


@pytest.fixture(scope="module")
def found(walk, poses):
    return events.detect_events(poses, pivot.trials(walk)).cache()


@pytest.fixture(scope="module")
def cut(found):
    return cycles.segment(found, 30.0).cache()


def test_round_trip_of_documents(spark, walk, tmp_path):
    for r in walk.select("trial_id", F.to_json(F.struct("meta", "frames")).alias("j")).collect():
        (tmp_path / f"{r[0]}.json").write_text(r["j"].replace('"x":0.5,', '"x":NaN,', 1))
    again = pivot.read_documents(spark, f"file://{tmp_path}/*.json")
    assert sorted(r[0] for r in again.select("trial_id").collect()) == ["a", "b"]
    assert pivot.poses(again).filter(F.exists(F.map_values("landmarks"), lambda p: p["x"].isNull())).count() == 2
    (tmp_path / "bad.json").write_text('{"meta": {}}')
    with pytest.raises(InvalidData):
        pivot.read_documents(spark, f"file://{tmp_path}/*.json", refuse=True)
    kept = {r["trial_id"]: r["status"] for r in pivot.read_documents(spark, f"file://{tmp_path}/*.json").collect()}
    assert kept["a"] is None and kept["bad"]["kind"] == "no_frames"


def test_standing_has_straight_legs(spark):
    doc = walking(2)
    for f in doc["frames"]:
        f["landmarks"] = {k: {"x": x, "y": y, "visibility": 1.0} for k, (x, y) in standing().items()}
    p = pivot.poses(as_documents(spark, [doc]))
    r = p.select(pose.hip_vertical("LEFT").alias("h"), pose.knee("LEFT").alias("k"), pose.ankle("LEFT").alias("a"), pose.trunk_lean().alias("t")).first()
    assert (r["h"], r["k"], r["a"], r["t"]) == pytest.approx((0, 0, 0, 0), abs=1e-5)


@pytest.mark.parametrize("method", ["sagittal_vertical_axis", "sagittal_classic"])
def test_angles(poses, method):
    a = pose.compute_angles(poses, method, calibrate=False)
    r = a.groupBy("trial_id").agg(F.count("*").alias("n"), F.count("knee_L").alias("k"), F.max(F.abs("hip_L")).alias("h")).collect()
    assert all(x["n"] == x["k"] == 300 and 0 < x["h"] < 60 for x in r)
    with pytest.raises(UnknownName):
        pose.compute_angles(poses, "none")


def test_signs_become_canonical(poses):
    a = pose.compute_angles(poses, calibrate=False)
    flipped = a.withColumns({c: -F.col(c) for c in ("hip_L", "knee_L")})
    same = pose.canonicalize_signs(flipped).groupBy("trial_id").agg(F.avg("knee_L").alias("k")).collect()
    assert all(r["k"] >= 0 for r in same)


def test_events_of_a_walk(found):
    n = {(r["trial_id"], r["side"], r["kind"]): r["n"] for r in found.groupBy("trial_id", "side", "kind").agg(F.count("*").alias("n")).collect()}
    assert all(n["a", s, k] >= 8 for s in ("left", "right") for k in ("hs", "to"))
    hs = [r["frame"] for r in found.filter("trial_id = 'a' AND side = 'left' AND kind = 'hs'").orderBy("frame").collect()]
    assert set(np.diff(hs)) <= {29, 30, 31}


@pytest.mark.parametrize("method", ["crossing", "velocity", "oconnor"])
def test_other_detectors_run(walk, poses, method):
    out = events.detect_events(poses, pivot.trials(walk), method)
    assert out.filter("frame < 0 OR frame > 299").count() == 0
    assert method in events.list_event_methods()


def test_consensus_and_thinning(spark):
    rows = [("t", "left", "hs", f, m) for f, m in ((10, "a"), (12, "b"), (13, "c"), (40, "a"), (60, "a"), (61, "b"))]
    e = spark.createDataFrame(rows, "trial_id string, side string, kind string, frame int, method string")
    assert [(r["frame"], r["n_methods"]) for r in events.consensus(e, 3).orderBy("frame").collect()] == [(12, 3), (60, 2)]
    assert sorted(r["frame"] for r in events.thinned(e, 20).collect()) == [10, 40, 60]


def test_cycles_and_stance(cut):
    r = cut.filter("trial_id = 'a'").agg(F.count("*").alias("n"), F.avg("duration").alias("d"), F.avg("stance_pct").alias("s")).first()
    assert r["n"] >= 14
    assert r["d"] == pytest.approx(1.0, abs=0.02)
    assert 40 < r["s"] < 60


def test_lift_off_is_strictly_inside(spark):
    e = spark.createDataFrame([("t", "left", k, f) for k, f in (("hs", 0), ("to", 0), ("to", 30), ("hs", 30), ("to", 48), ("to", 50), ("hs", 60))], "trial_id string, side string, kind string, frame int")
    rows = cycles.segment(e, 30.0).orderBy("start_frame").collect()
    assert [(r["start_frame"], r["end_frame"], r["toe_off_frame"]) for r in rows] == [(0, 30, None), (30, 60, 48)]
    assert rows[1]["stance_pct"] == pytest.approx(60)


def test_curves_summary_and_ensemble(poses, cut):
    a = pose.angles_long(pose.compute_angles(poses, calibrate=False))
    c = cycles.curves(cut, a)
    assert c.filter(F.size("curve") != 101).count() == 0
    s = cycles.summary(cycles.long_curves(c))
    assert s.filter("joint = 'knee' AND std < 0").count() == 0
    e = cycles.ensemble(s).filter("side = 'left' AND joint = 'hip'")
    assert e.count() == 101
    assert e.first()["n_trials"] == 2


def test_figures(found, cut):
    r = analysis.spatiotemporal(cut, found, 30.0).filter("trial_id = 'a'").first()
    assert r["cadence_steps_per_min"] == pytest.approx(120, rel=0.02)
    assert r["step_time_mean_s"] == pytest.approx(0.5, abs=0.05)
    c = analysis.instantaneous_cadence(found, 30.0).filter("trial_id = 'a'").first()
    assert c["mean"] == pytest.approx(120, rel=0.1)
    assert analysis.variability(cut).filter("trial_id = 'a'").first()["cycle_duration_cv"] < 5


def test_patterns(spark):
    flat = lambda v: [float(v)] * 101
    rows = [("t", "left", "knee", flat(28)), ("t", "left", "hip", flat(50)), ("t", "left", "ankle", flat(0))]
    got = {r["pattern"]: r for r in analysis.patterns(spark.createDataFrame(rows, "trial_id string, side string, joint string, curve array<double>")).collect()}
    assert set(got) == {"spastic", "steppage", "crouch"}
    assert (got["spastic"]["severity"], got["spastic"]["confidence"]) == ("moderate", 0.6)
    assert (got["crouch"]["severity"], got["crouch"]["confidence"]) == ("severe", 0.65)


def test_flags(spark):
    df = spark.createDataFrame([("t", 60.0, 75.0, 25.0, 30.0)], "trial_id string, cadence_steps_per_min double, stance_pct_left double, knee_rom_si double, cycle_duration_cv double")
    assert len(analysis.flags(df).first()["flags"]) == 4


def test_normative_table(spark):
    t = normative.table(spark)
    assert t.count() == 2424
    m, s = normative.curve("knee")
    e, d = normative.curve("knee", "elderly")
    assert np.ptp(e) == pytest.approx(0.8 * np.ptp(m)) and e.mean() == pytest.approx(m.mean()) and d == pytest.approx(1.3 * s)


def test_scores_of_the_norm_itself(spark):
    norm = normative.table(spark).filter("stratum = 'adult' AND joint IN ('hip', 'knee', 'ankle')")
    own = norm.select(F.lit("t").alias("trial_id"), F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"), "joint", "p", (F.col("mean") + 3.0).alias("mean"))
    gvs = scores.variable_scores(own, norm)
    assert {r["gvs"] for r in gvs.collect()} == {3.0}
    gps = scores.profile_score(gvs)
    assert sorted((r["side"], r["gps"]) for r in gps.collect()) == [("left", 3.0), ("overall", 3.0), ("right", 3.0)]
    assert all(100 <= r["sdi"] <= 120 for r in scores.deviation_index(gps, norm).collect())
    assert scores.movement_profile(gvs).count() == 3


def test_validation(spark):
    values = spark.createDataFrame([("t", "left", "knee", v) for v in (10.0, 90.0, 95.0)], "trial_id string, side string, joint string, value double")
    r = validation.check_angles(values, validation.ranges(spark)).first()
    assert (r["severity"], r["outside"]) == ("critical", pytest.approx(200 / 3))
    wider = validation.adjusted(spark, age=10).filter("joint = 'knee' AND phase = 'full'").first()
    assert (wider["lo"], wider["hi"]) == (-10, 85)
    old = {(r["joint"], r["phase"]): (r["lo"], r["hi"]) for r in validation.adjusted(spark, age=70).collect()}
    assert old["hip", "full"] == (-25, 50) and old["knee", "swing"] == (20, 80) and old["ankle", "stance"] == (-15, 20) and old["knee_valgus", "full"] == (-7, 17)
    assert validation.spatiotemporal_ranges(70, "F", "slow")["cadence_steps_per_min"] == (45, 125)
    assert validation.spatiotemporal_ranges(8, speed="fast")["step_time_mean_s"] == (pytest.approx(0.22), pytest.approx(0.6))
    assert validation.spatiotemporal_ranges(speed="fast")["cadence_steps_per_min"] == (90, 160)
    contacts = spark.createDataFrame([("t", "hs", float(i)) for i in range(4)], "trial_id string, kind string, time double")
    assert validation.check_cadence(contacts).first()["cadence"] == 60


def test_quality(poses):
    r = quality.quality_score(poses).first()
    assert r["score"] == pytest.approx(100 * (0.3 + 0.3 * 0.9 + 0.2 + 0.2), abs=0.5)
    c = quality.coherence(poses, pose.compute_angles(poses)).filter("frame_idx = 0").first()
    assert c["score"] == 1.0
    assert quality.treadmill(poses).first()["treadmill"]
    assert quality.visible_span(poses).count() == 600


def test_signal_steps(poses):
    tracks = pose.to_long(poses).filter("name = 'LEFT_ANKLE'").select("trial_id", "name", "pos", "x", "y", "visibility")
    for step in ("butterworth", "savgol", "moving_mean", "median", "loess", "outliers"):
        out = signals.normalize(tracks, [step])
        assert out.columns == tracks.columns
        d = out.join(tracks.withColumnRenamed("x", "x0"), ["trial_id", "name", "pos"]).agg(F.sqrt(F.avg(F.pow(F.col("x") - F.col("x0"), 2)))).first()[0]
        assert d < 0.05, step
    with pytest.warns(UserWarning):
        signals.normalize(tracks, ["nothing"])
    signals.register_step("double", lambda t: t.withColumn("x", F.col("x") * 2))
    assert "double" in signals.list_steps()


def test_long_gaps_stay(spark):
    rows = [("t", "P", i, None if 10 <= i < 25 or i == 40 else float(i), float(i), 1.0) for i in range(60)]
    tracks = spark.createDataFrame(rows, "trial_id string, name string, pos int, x double, y double, visibility double")
    out = {r["pos"]: r["x"] for r in signals.normalize(tracks, ["moving_mean"], gap_max=10).collect()}
    assert out[15] is None and out[40] is not None
    for method in ("spline", "linear"):
        filled = {r["pos"]: r["x"] for r in signals.fill_gaps(tracks, method, 5).collect()}
        assert filled[40] == pytest.approx(40) and filled[15] is None


def test_swapped_labels_are_put_right(poses):
    n = F.col("pos")
    bad = pose.swap_sides(poses.withColumn("w", n.between(100, 130)), F.col("w")).drop("w")
    assert bad.select("landmarks").count() == 600
    twice = pose.swap_sides(pose.swap_sides(poses, F.lit(True)), F.lit(True))
    a, b = (df.filter("pos = 7 AND trial_id = 'a'").select(pose.x("LEFT_KNEE")).first()[0] for df in (poses, twice))
    assert a == b
    m = pose.mirror(poses).filter("pos = 7 AND trial_id = 'a'").select(pose.x("RIGHT_KNEE")).first()[0]
    assert m == pytest.approx(1 - a)


def test_corrections(spark):
    df = spark.createDataFrame([("t", i, 10.0 + i) for i in range(10)], "trial_id string, pos int, a double")
    out = [r[0] for r in df.select(corrections.unprojected(F.col("a"), F.lit(1.0)).alias("b")).collect()]
    assert out == pytest.approx([10.0 + i for i in range(10)])
    b = df.select(corrections.bias(F.lit(0.25), "ankle").alias("b")).first()["b"]
    assert b == pytest.approx((-1.398 + 0.056) / 0.707106781)


def test_optical(spark):
    wave = lambda t: 30 + 15 * math.sin(2 * math.pi * 0.7 * t) + 5 * math.sin(2 * math.pi * 0.31 * t)
    video = spark.createDataFrame([("t", i, wave(i / 30)) for i in range(300)], "trial_id string, pos int, value double")
    mocap = spark.createDataFrame([("t", i, wave(i / 200 - 0.5)) for i in range(2200)], "trial_id string, pos int, value double")
    off = optical.estimate_offset(video, mocap, 30, 200).first()["offset"]
    assert off == pytest.approx(0.5, abs=0.04)
    pairs = optical.align_nearest(video, mocap.withColumnRenamed("value", "reference"), ["trial_id"], 30, 200, 0.5)
    m = optical.error_metrics(pairs, ["trial_id"]).first()
    assert m["n"] == 300 and m["rmse"] < 0.5 and m["cmc"] > 0.99
    labels = spark.createDataFrame([("t", n) for n in ("LASI", "LKNE", "LANK", "LTOE", "RKNE")], "trial_id string, label string")
    assert optical.detect_convention(labels).first()["convention"] == "plug_in_gait"
    near = optical.nearest(spark.createDataFrame([("t", 5), ("t", 12)], "k string, at int"), spark.createDataFrame([("t", 4), ("t", 20)], "k string, at int"), ["k"])
    assert sorted(r["distance"] for r in near.collect()) == [1, 8]


def test_pipeline_and_sinks(spark, walk, tmp_path):
    results = pipeline.run(walk, {"normalize": {"steps": [{"type": "moving_mean", "window": 3}]}})
    f = results.figures.filter("trial_id = 'a'").first()
    assert f["cadence_steps_per_min"] == pytest.approx(120, rel=0.03)
    assert results.gps.filter("side = 'overall'").count() == 2
    where = f"file://{tmp_path}/out"
    for files in (sinks.mot_files(results.angles, results.trials), sinks.trc_files(results.poses, results.trials, ["LEFT_HIP", "LEFT_KNEE"]), sinks.scale_setup(results.trials), sinks.openpose_files(results.poses.filter("pos < 2")), sinks.summary_documents(results.figures, results.gps, results.trials), sinks.ik_setup(results.trials, ["A"])):
        assert files.count() >= 2
    sizes = sinks.write_files(sinks.trc_files(results.poses, results.trials, ["LEFT_HIP", "LEFT_KNEE"]), where).collect()
    assert all((tmp_path / "out" / r["name"]).stat().st_size == r["bytes"] for r in sizes)
    back = pivot.read_trc(spark, f"{where}/a.trc")
    assert back.count() == 600
    assert {r[0] for r in back.select("name").distinct().collect()} == {"LEFT_HIP", "LEFT_KNEE"}
    sinks.write_csv({"cycles": results.cycles}, f"{where}/csv")
    assert spark.read.option("header", True).csv(f"{where}/csv/cycles").count() == results.cycles.count()


def test_settings(tmp_path):
    settings.save({"cycles": {"points": 51}}, tmp_path / "s.json")
    s = settings.load(tmp_path / "s.json")
    assert s["cycles"] == {"shortest": 0.4, "longest": 2.5, "points": 51}
    assert settings.DEFAULTS["cycles"]["points"] == 101
