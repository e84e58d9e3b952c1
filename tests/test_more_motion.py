"""Backends, degradation, figures and grids."""

import pytest
from pyspark.sql import functions as F

from kinelake.exceptions import InvalidData, UnknownName
from kinelake.operators import analysis, backends, cycles, degradation, events, normative, pose, scores
from kinelake.plans import benchmark, figures, pipeline
from kinelake.sources import pivot


@pytest.fixture(scope="module")
def poses(walk):
    return pivot.poses(walk).cache()


def test_heat_maps(spark):
    df = spark.createDataFrame([([0.0, 0.1, 0.9, 0.2, 0.9, 0.0],)], "map array<double>")
    r = backends.heatmap_peaks(df, 3).first()
    assert (r["px"], r["py"], r["score"]) == (2, 0, 0.9)
    x, y = backends.unletterbox(F.lit(50.0), F.lit(50.0), (100, 100), F.lit(200), F.lit(100))
    assert tuple(spark.range(1).select(x, y).first()) == (0.5, 0.5)
    v = backends.sample_map(F.array(*[F.lit(float(k)) for k in range(6)]), 3, 2, F.lit(0.99), F.lit(0.6))
    assert spark.range(1).select(v).first()[0] == 5


def test_models(spark):
    assert len(backends.list_models()) >= 18
    assert len(backends.names_of("mediapipe")) == 33 and len(backends.names_of("yolo")) == 17
    with pytest.raises(UnknownName):
        backends.names_of("none")

    def run(frames):
        for f in frames:
            yield f[["trial_id", "frame_idx"]].assign(points=[[[0.5, 0.5, 1.0]]] * len(f))

    backends.register_runner("fixed", run)
    images = spark.createDataFrame([("t", 0, b"x")], "trial_id string, frame_idx int, image binary")
    assert backends.estimate(images, "fixed").first()["points"] == [[0.5, 0.5, 1.0]]


def test_person(spark):
    rows = [("t", 0, 1, 0.0, 0.0, 0.2, 0.2, 0.9), ("t", 0, 2, 0.5, 0.5, 1.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "trial_id string, frame_idx int, person int, x0 double, y0 double, x1 double, y1 double, score double")
    pick = lambda *a: backends.select_person(df, *a).first()["person"]
    assert (pick("largest"), pick("surest"), pick("box", (0.0, 0.0, 0.3, 0.3))) == (2, 1, 1)


def test_degradation(poses):
    assert degradation.stride(60, 25) == (2, 30)
    assert not degradation.is_active(degradation.settings())
    with pytest.raises(InvalidData):
        degradation.settings(downscale=3)
    out = degradation.degrade(poses, degradation.settings(target_fps=10, downscale=0.5, noise=0.01), 30)
    assert out.count() == 200
    d = out.join(poses.select("trial_id", "frame_idx", pose.x("NOSE").alias("x")), ["trial_id", "frame_idx"]).select(F.max(F.abs(pose.x("NOSE") - F.col("x")))).first()[0]
    assert 0 < d < 0.012


def test_figures_tables(spark, walk, poses):
    found = events.detect_events(poses, pivot.trials(walk))
    cut = cycles.segment(found, 30.0)
    angles = pose.compute_angles(poses, calibrate=False)
    long = pose.angles_long(angles)
    curves = cycles.curves(cut, long)
    summary = cycles.summary(cycles.long_curves(curves))
    norm = normative.table(spark).filter("stratum = 'adult'")
    assert figures.angles_with_events(long, found).filter(F.col("events").isNotNull()).count() > 0
    assert figures.phase_plane(long, 30.0).count() == long.count()
    assert figures.normative_comparison(summary, norm).filter("z IS NULL").count() == 0
    assert figures.butterfly(summary, "knee").count() == 202
    assert figures.cadence_profile(found, 30.0).count() > 10
    assert figures.overlay(poses, angles, found).count() == 600
    assert figures.rom_comparison(analysis.rom_table(curves), norm).count() > 0
    assert set(figures.quality_dashboard(poses)) == {"detection", "scores", "gaps"}
    assert figures.arm_swing_curves(cut, pose.extended_angles(poses)).count() > 10
    gvs = scores.variable_scores(summary, norm)
    assert figures.score_profile(gvs).filter("band IS NULL").count() == 0
    own = analysis.spatiotemporal(cut, found, 30.0)
    text = figures.report(own, analysis.flags(own), scores.profile_score(gvs), "fr").filter("name = 'a.md'").first()["content"]
    assert text.startswith("# a\n") and "Paramètres" in text
    d = pipeline.diagnose(poses, pivot.trials(walk), cut, cut.filter("cycle_id > 0"), curves).filter("trial_id = 'a'").first()
    assert d["coverage"] == 1 and d["confidence"] == pytest.approx(0.9) and d["n_dropped"] == 1
    assert any(w.startswith("direction: 1 ") for w in d["warnings"]) and not any(w.startswith("tracking") for w in d["warnings"])


def test_grid(walk, poses):
    reference = pose.angles_long(pose.canonicalize_signs(pose.compute_angles(poses))).select("trial_id", "frame_idx", "side", "joint", F.col("value").alias("reference"))
    out = benchmark.run_grid(poses, pivot.trials(walk), reference, {"raw": degradation.settings(), "coarse": degradation.settings(downscale=0.2)}, ["zeni"], {"none": []})
    rows = {(r["variant"], r["trial_id"], r["side"], r["joint"]): r["rmse"] for r in out.collect()}
    assert rows["raw", "a", "left", "knee"] < rows["coarse", "a", "left", "knee"] < 20
    assert benchmark.wide_rows(out).count() == 4


def test_c3d_round_trip(spark, walk, poses, tmp_path):
    from kinelake.sources import sinks

    files = sinks.c3d_files(poses, pivot.trials(walk), ["LEFT_HIP", "LEFT_KNEE"])
    sinks.write_files(files, f"file://{tmp_path}/c3d").collect()
    back = pivot.read_c3d(spark, f"file://{tmp_path}/c3d/*.c3d")
    assert back.count() == 2 * 2 * 300
    r = back.filter("trial_id = 'a' AND frame_idx = 7 AND name = 'LEFT_KNEE'").first()
    x, y = poses.filter("trial_id = 'a' AND pos = 7").select(pose.x("LEFT_KNEE"), pose.y("LEFT_KNEE")).first()
    assert (r["X"], r["Z"]) == pytest.approx((x, 1 - y), abs=1e-6)
    assert sinks.moco_setup(pivot.trials(walk)).count() == 2
