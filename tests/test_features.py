"""Failures as rows, pooled components, optical runs, conventions and scales, against plain computations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.functions import kernels as K
from kinelake.operators import analysis, cycles, events, optical, signals
from kinelake.plans import pipeline
from kinelake.sources import pivot
from tests.conftest import as_documents, walking


def test_a_trial_that_fails_costs_only_itself(spark, tmp_path, monkeypatch):
    """Of 100 documents with four broken ones 96 are finished; what failed is in rows."""

    def brittle(s, rate, least, cutoff):
        if np.nanmax(s["LEFT_HIP_x"]) > 5:
            raise RuntimeError("out of the picture")
        return events.zeni(s, rate, least, cutoff)

    for k in range(100):
        doc = walking(60, trial=f"t{k}")
        if k == 11:
            doc["frames"] = []
        if k == 33:
            for f in doc["frames"]:
                f["landmarks"]["LEFT_HIP"]["x"] += 9
        if k == 55:
            del doc["meta"]
        text = json.dumps(doc)
        (tmp_path / f"t{k}.json").write_text(text[: len(text) // 2] if k == 77 else text)
    monkeypatch.setitem(events._METHODS, "brittle", brittle)
    docs = pivot.read_documents(spark, f"file://{tmp_path}/*.json")
    results = pipeline.run(docs, {"events": {"method": "brittle"}})
    errors = sorted((r["trial_id"], r["stage"], r["kind"]) for r in results.errors.collect())
    assert errors == [("t11", "read", "no_frames"), ("t33", "events", "RuntimeError"), ("t55", "read", "no_meta"), ("t77", "read", "malformed")]
    outcome = {r["trial_id"]: r for r in results.outcome.collect()}
    assert len(outcome) == 100 and sum(r["status"] == "ok" for r in outcome.values()) == 96
    assert outcome["t33"]["error"] == "events: RuntimeError: out of the picture" and outcome["t33"]["n_events"] == 0
    assert outcome["t1"]["n_frames"] == 60 and outcome["t1"]["n_events"] > 0 and outcome["t1"]["n_cycles"] > 0
    assert {r["trial_id"] for r in results.cycles.select("trial_id").distinct().collect()} == set(outcome) - {"t11", "t33", "t55", "t77"}
    results.release()


def test_a_landmark_whose_filter_fails_is_named(spark):
    def step(tracks, limit):
        def kernel(v):
            if v.max() > limit:
                raise ArithmeticError("too far")
            return v + 1

        return signals.per_series(tracks, kernel, ("y",))

    signals.register_step("brittle", step)
    try:
        doc = walking(40, trial="a")
        doc["frames"][7]["landmarks"]["NOSE"]["y"] = 1.5
        results = pipeline.run(as_documents(spark, [doc]), {"normalize": {"steps": [{"type": "brittle", "limit": 1.2}]}}, keep=False)
        assert [tuple(r) for r in results.errors.collect()] == [("a", "normalize", "ArithmeticError", "too far", "NOSE")]
        assert results.outcome.first()["status"] == "ok"
    finally:
        del signals.STEPS["brittle"]


def test_documents_parse_with_a_status(spark):
    doc = walking(3, trial="x")
    nan = json.dumps(doc).replace('"confidence": 0.9', '"confidence": NaN')
    files = [("a.json", nan), ("b.json", ""), ("c.json", "[1, 2"), ("d.json", "{}"), ("e.json", '{"meta": {"fps": 30}}'), ("f.json", None), ("g.json", json.dumps({k: v for k, v in doc.items() if k != "trial_id"}))]
    got = {r["trial_id"]: r["status"] and r["status"]["kind"] for r in pivot.parse_documents(spark.createDataFrame(files, "name string, content string")).collect()}
    assert got == {"x": None, "b": "malformed", "c": "malformed", "d": "malformed", "e": "no_frames", "f": "malformed", "g": None}


def test_a_document_that_breaks_off_anywhere_is_malformed(spark):
    """Wherever a text ends too early; a field of another type or a number that isn't one breaks nothing."""
    text = json.dumps(walking(2, trial="x") | {"meta": {"fps": 4.0, "source": 'a " b'}}).replace('"confidence": 0.9', '"confidence": NaN')
    files = [(f"{k}.json", text[:k]) for k in range(len(text))] + [("other.json", text.replace('"fps": 4.0', '"fps": [1]')), ("whole.json", text)]
    got = pivot.parse_documents(spark.createDataFrame(files, "name string, content string")).collect()
    cut = [r for r in got if r["trial_id"] != "x"]
    assert len(cut) == len(text) and {r["status"]["kind"] for r in cut} == {"malformed"}
    assert all(r["frames"] is None and r["meta"] is None for r in cut)
    assert [(r["status"], len(r["frames"])) for r in got if r["trial_id"] == "x"] == [(None, 2)] * 2


def test_pooled_components(spark, rng):
    """Sums merged over tasks give what one decomposition of all curves gives; few or broken curves are left out."""
    base = rng.normal(size=(3, 101)).cumsum(axis=1)
    rows = [(f"t{k}", "hip" if k % 3 else "knee", "left" if k % 2 else "right", (100 + base.T @ rng.normal(size=3) + rng.normal(size=101) * 0.1).tolist()) for k in range(200)]
    rows += [("x", "ankle", "left", [1.0] * 101), ("y", "ankle", "left", [2.0] * 101), ("z", "hip", "left", None), ("z", "hip", "left", [None] * 101), ("z", "hip", "left", [float("nan")] * 101), ("z", "hip", "left", [])]
    curves = spark.createDataFrame(rows, "trial_id string, joint string, side string, curve array<double>").repartition(7)
    found = analysis.waveform_components(curves, 3)
    got = {(r["joint"], r["side"], r["component"]): r for r in found.collect()}
    scores = analysis.waveform_scores(curves, found).collect()
    assert {k[:2] for k in got} == {("hip", "left"), ("hip", "right"), ("knee", "left"), ("knee", "right")}
    for joint, side in {k[:2] for k in got}:
        own = [r for r in rows if r[1:3] == (joint, side) and r[3] and r[3][0] is not None and r[3][0] == r[3][0]]
        mean, parts, each, shares = K.principal_components(np.array([r[3] for r in own]), 3)
        for k in range(3):
            r = got[joint, side, k]
            assert r["explained"] == pytest.approx(shares[k], abs=1e-9) and r["mean"] == pytest.approx(mean.tolist())
            assert r["loading"] == pytest.approx(parts[k].tolist(), abs=1e-6)
        by_trial = {(s["trial_id"], s["component"]): s["score"] for s in scores if (s["joint"], s["side"]) == (joint, side)}
        for r, e in zip(own, each, strict=True):
            assert [by_trial[r[0], k] for k in range(3)] == pytest.approx(e.tolist(), abs=1e-5)


def test_groups_by_trial_are_flushed(spark, rng, monkeypatch):
    monkeypatch.setattr(analysis, "_HELD_GROUPS", 3)
    rows = [(k % 20, rng.normal(size=5).tolist()) for k in range(200)]
    m = analysis.waveform_moments(spark.createDataFrame(rows, "trial_id long, curve array<double>").repartition(3), ("trial_id",)).collect()
    for r in m:
        x = np.array([v for t, v in rows if t == r["trial_id"]])
        assert r["n"] == len(x) and r["mean"] == pytest.approx(x.mean(axis=0).tolist()) and r["comoment"] == pytest.approx(((x - x.mean(axis=0)).T @ (x - x.mean(axis=0))).ravel().tolist())
    assert len(m) == 20


def _signal(n, joint, seed):
    t = np.arange(n)
    return np.sin(t / 5 + joint) + 0.5 * np.sin(t / 2.3 + seed)


def test_optical_run(spark, rng):
    """Shifted and gappy recordings with another best joint in each trial; one trial is too short, one isn't there."""
    video, other, expected = [], [], {}
    for k, (best, shift) in enumerate([("knee_R", 7), ("hip_L", 0), ("knee_L", 12), ("hip_R", 3)]):
        for j, joint in enumerate([*optical.SYNC_JOINTS, "ankle_L"]):
            full = _signal(150, j, k)
            n = 100 if joint == best else 60 + j
            video += [(f"t{k}", joint, i, None if i % 9 == 4 else float(full[i + shift])) for i in range(n)]
            other += [(f"t{k}", joint, i, float(full[i]) + 0.25) for i in range(150)]
        expected[f"t{k}"] = (best, shift)
    for j, joint in enumerate(optical.SYNC_JOINTS):
        video += [("short", joint, i, 1.0) for i in range(9)]
        other += [("short", joint, i, 1.0) for i in range(50)]
        video += [("alone", joint, i, float(i)) for i in range(40)]
    schema = "trial_id string, joint string, pos int, value double"
    beat = lambda shift: [(f"t{k}", "left", "hs", (10.0 * i + shift) / 20) for k in range(4) for i in range(1, 5)]
    run = optical.optical_run(spark.createDataFrame(video, schema), spark.createDataFrame(other, schema), 20.0, 20.0, *(spark.createDataFrame(beat(s), "trial_id string, side string, kind string, time double") for s in (0, 0)), longest=2.0)
    sync = {r["trial_id"]: (r["signal"], round(r["offset"] * 20)) for r in run.sync.collect()}
    assert sync == expected
    errors = {r["trial_id"]: r for r in run.errors.collect()}
    assert set(errors) == {"short", "alone"} and all(r["kind"] == "SyncFailed" for r in errors.values())
    assert errors["short"]["message"] == "too few common samples: knee_L=9, knee_R=9, hip_L=9, hip_R=9; 10 are needed"
    for r in run.angle_errors.collect():
        assert r["bias"] == pytest.approx(-0.25) and r["rmse"] == pytest.approx(0.25) and r["rom_diff"] == pytest.approx(0, abs=0.1)
    blocks = {r["trial_id"]: r["optical"] for r in run.blocks.collect()}
    assert {t: b["status"] for t, b in blocks.items()} == {"t0": "ok", "t1": "ok", "t2": "ok", "t3": "ok", "short": "error", "alone": "error"}
    assert blocks["t0"]["alignment"]["n_aligned"] == 100 and set(blocks["t0"]["angles"]) == {*optical.SYNC_JOINTS, "ankle_L"}
    assert blocks["t1"]["events"]["left_hs"]["mae_ms"] == pytest.approx(0) and blocks["t0"]["events"]["left_hs"]["mae_ms"] == pytest.approx(200)  # three events are 150 ms from the nearest, the last one 350
    attached = optical.attach_blocks(spark.createDataFrame([("t0",), ("none",)], "trial_id string"), run).collect()
    assert {r["trial_id"]: r["experimental"] and r["experimental"]["optical"]["sync"]["signal"] for r in attached} == {"t0": "knee_R", "none": None}


def test_joints_that_all_trials_have(spark):
    rows = [(t, s, j, p, float(p + t), 1.0, 2) for t in range(3) for s in ("left", "right") for j in ("hip", "knee") for p in range(2) if not (t == 1 and s == "left" and j == "knee")]
    df = spark.createDataFrame(rows, "trial_id int, side string, joint string, p int, mean double, std double, n_cycles int")
    have = lambda mode: {(r["side"], r["joint"], r["n_trials"]) for r in cycles.ensemble(df, mode).collect()}
    assert have("all") == {("left", "hip", 3), ("right", "hip", 3), ("right", "knee", 3)}
    assert have("any") == have("all") | {("left", "knee", 2)} and have(["knee"]) == {("left", "knee", 2), ("right", "knee", 3)}


def test_conventions(spark):
    for name, table in optical.CONVENTIONS.items():
        assert set(optical.REQUIRED) <= set(table), name
    sets = {
        "pig": ["sub:LASI", "RASI", "LKNE", "RKNE", "LANK", "RANK", "LTHI"], "hh": ["LASI", "RASI", "LKNE", "RKNE", "LHEEL"],
        "bath": ["ASIS_L", "asis_r", "KNEE_LAT_L", "KNEE_LAT_R", "LAJC", "RAJC"], "under": ["L_ASIS", "R_ASIS", "L_LFE", "R_LFE"], "iso": ["LASIS", "RASIS", "LLFE", "LMFE", "RLFE", "LLM", "RLM"],
        "other": ["L_HIP_top", "R_HIP_top", "L KNE", "R KNE", "C7"],
    }
    labels = spark.createDataFrame([(t, x) for t, own in sets.items() for x in own], "trial_id string, label string")
    got = {r["trial_id"]: (r["convention"], r["n"]) for r in optical.detect_convention(labels).collect()}
    assert got == {"pig": ("plug_in_gait", 6), "hh": ("plug_in_gait", 4), "bath": ("bath_biocv", 6), "under": ("iso_biomechanics_underscore", 4), "iso": ("iso_biomechanics", 6), "other": ("fuzzy", 0)}
    mapped = {}
    for r in optical.marker_mapping(labels).collect():
        mapped.setdefault(r["trial_id"], set()).add((r["label"], r["landmark"]))
    assert mapped["other"] == {("L_HIP_top", "LEFT_HIP"), ("R_HIP_top", "RIGHT_HIP"), ("L KNE", "LEFT_KNEE"), ("R KNE", "RIGHT_KNEE"), ("C7", "NOSE")}
    assert {x for x in mapped["pig"] if x[1] == "LEFT_KNEE"} == {("LKNE", "LEFT_KNEE"), ("LTHI", "LEFT_KNEE")} and ("sub:LASI", "LEFT_HIP") in mapped["pig"]


def test_scales(spark):
    def point(x, y):
        return {"x": x, "y": y, "visibility": 1.0}

    docs = []
    for t, (height, rows) in {"a": (1.8, 80), "b": (None, 80), "c": (1.8, 0)}.items():
        doc = walking(80, trial=t)
        doc["subject"]["height_m"] = height
        doc["meta"]["height"] = 1000
        for i, f in enumerate(doc["frames"]):
            f["confidence"] = 0.4 if i % 2 or not rows else 0.5
            f["landmarks"] = {"NOSE": point(0.5, 0.1), "LEFT_ANKLE": point(0.5, 0.5 + 0.001 * i), "RIGHT_ANKLE": point(0.5, 0.5 + 0.001 * i), "LEFT_HIP": point(0.5, 0.3), "LEFT_KNEE": point(0.5, 0.4), "RIGHT_HEEL": point(0.4, 0.5), "RIGHT_FOOT_INDEX": point(0.5, 0.5)}
        docs.append(doc)
    docs = as_documents(spark, docs)
    found = {r["trial_id"]: r["scale"] for r in analysis.height_scale(pivot.poses(docs), pivot.trials(docs)).collect()}
    assert found == {"a": pytest.approx(1.8 / np.median([400 + i for i in range(0, 60, 2)])), "b": None, "c": None}
    subjects = spark.createDataFrame([("a", 1.8, None, None), ("b", 1.8, 500.0, None), ("c", None, 500.0, 200.0), ("d", None, None, None)], "trial_id string, height_m double, femur_mm double, foot_mm double")
    found = {r["trial_id"]: r["scale"] for r in analysis.scale(pivot.poses(docs), subjects, 0.25).collect()}
    assert found == {"a": pytest.approx(4.5), "b": pytest.approx(5.0), "c": pytest.approx((5.0 + 2.0) / 2), "d": 1.0}
    assert analysis.scale(pivot.poses(docs), subjects).filter(F.col("trial_id") == "a").first()["scale"] == pytest.approx(1.8 * 0.245 / 0.1)
