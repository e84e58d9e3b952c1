"""The recipe, markers through it, frontal curves, extra key points, measurements, setups and workbooks."""

import io
import math
import xml.etree.ElementTree as ET
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.exceptions import InvalidData, UnknownName
from kinelake.functions import kernels as K
from kinelake.operators import analysis, layouts, pose, scores
from kinelake.plans import pipeline
from kinelake.sources import pivot, settings, sinks
from tests.conftest import as_documents, walking

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def test_presets():
    recipe = settings.preset("recipe")
    assert recipe["angles"]["calibrate"] is False and recipe["events"]["least"] == 0.6 and (recipe["cycles"]["shortest"], recipe["cycles"]["longest"]) == (0.8, 1.6)
    assert settings.preset("defaults")["cycles"]["longest"] == 2.5 and recipe["normalize"] == settings.DEFAULTS["normalize"]
    with pytest.raises(UnknownName):
        settings.preset("none")


def test_recipe(spark):
    """Cycles out of 0.8 to 1.6 s go; the filter follows the trial's own rate; the report has all parts."""
    docs = as_documents(spark, [walking(300, trial="a", period=1.0), walking(400, 60.0, "fast", 1.1), walking(200, trial="short", period=0.7)])
    lengths = spark.createDataFrame([("a", 430.0, None)], "trial_id string, femur_mm double, foot_mm double")
    recipe = pipeline.run(docs, preset="recipe", lengths=lengths)
    cut = {r["trial_id"]: r for r in recipe.cycles.groupBy("trial_id").agg(F.min("duration").alias("a"), F.max("duration").alias("b"), F.count("*").alias("n")).collect()}
    assert set(cut) == {"a", "fast"} and all(0.8 <= r["a"] <= r["b"] <= 1.6 and r["n"] >= 4 for r in cut.values())
    assert cut["fast"]["a"] == pytest.approx(1.1, abs=0.05)
    report = {r["trial_id"]: r for r in recipe.report.collect()}
    assert {"step_regularity", "stride_regularity", "symmetry_ratio", "ankle_at_contact_left", "ankle_at_contact_right", "hr_ap", "flags", "patterns", "cadence", "speed"} <= set(report["a"].asDict())
    recipe.release()


def test_filter_at_the_trials_rate(spark):
    from kinelake.operators import signals

    rows = [("a", "P", i, float(np.sin(i)), 0.0, 1.0, 100.0) for i in range(80)]
    tracks = spark.createDataFrame(rows, "trial_id string, name string, pos int, x double, y double, visibility double, rate double")
    x = np.array([r[3] for r in rows])
    got = np.array([r["x"] for r in signals.butterworth(tracks, 4.0, 2).orderBy("pos").collect()])
    assert got == pytest.approx(K.zero_phase(*K.butterworth(2, 4.0, 100.0), x))
    assert np.array([r["x"] for r in signals.butterworth(tracks.drop("rate"), 4.0, 2).orderBy("pos").collect()]) == pytest.approx(K.zero_phase(*K.butterworth(2, 4.0, 30.0), x))


def plain_regularity(y, rate):
    from numpy import correlate

    v = y - y.mean()
    r = correlate(v, v, "full")[len(v) - 1 :]
    r = r / r[0]
    low, high = max(1, int(0.3 * rate)), min(len(r) - 1, int(1.5 * rate))
    tops = lambda a, b: [k for k in range(a + 1, b - 1) if r[k - 1] < r[k] > r[k + 1]]
    first = tops(low, high)
    if not first:
        return None, None
    second = tops(first[0] + low, min(len(r) - 1, 3 * first[0]))
    return r[first[0]], r[second[0]] if second else None


def test_regularity(spark, rng):
    for period, rate, n in ((1.0, 30.0, 240), (1.4, 25.0, 200), (0.9, 60.0, 300), (9.0, 30.0, 100)):
        t = np.arange(n) / rate
        y = np.sin(2 * np.pi * t / period) + 0.3 * np.sin(4 * np.pi * t / period + 1) + rng.normal(size=n) * 0.05
        got, expected = K.regularity(y, rate), plain_regularity(y, rate)
        assert [None if v is None else pytest.approx(v) for v in expected] == list(got)
    assert K.regularity(np.ones(50), 30.0) == (None, None) == K.regularity(np.arange(20.0), 30.0)
    docs = as_documents(spark, [walking(240, trial="a")])
    row = analysis.regularity_index(pivot.poses(docs), pivot.trials(docs), "LEFT_HIP").first()
    assert row["trial_id"] == "a" and row["step_regularity"] is None


def made_markers(spark, n=600, rate=100):
    """Markers in space, labelled by a convention, of a walk with a period of 1.1 s."""
    body = {"LASI": (0.0, 1.0), "LKNE": (0.0, 0.55), "LANK": (0.0, 0.1), "LHEE": (-0.05, 0.03), "LTOE": (0.15, 0.02), "LSHO": (0.0, 1.5)}
    rows = []
    for i in range(n):
        t = i / rate
        for side, phase in (("L", 0.0), ("R", math.pi)):
            swing = math.sin(2 * math.pi * t / 1.1 + phase)
            for name, (x, z) in body.items():
                far = {"KNE": 0.15, "ANK": 0.3, "HEE": 0.3, "TOE": 0.3}.get(name[1:], 0.0)
                rows.append(("t", i, t, side + name[1:], 0.1 if side == "L" else -0.1, x + 1.2 * t + far * swing, z))
    return spark.createDataFrame(rows, "trial_id string, frame_idx int, time_s double, name string, X double, Y double, Z double")


def test_documents_of_markers(spark, tmp_path):
    """Documents by a convention's labels, at the rate that times tell; their contacts are a period apart; ankles are those in space."""
    from kinelake.operators import events, optical
    from kinelake.schemas import DOCUMENT

    made_markers(spark).write.parquet(f"file://{tmp_path}/markers")
    markers = spark.read.parquet(f"file://{tmp_path}/markers")
    optical.marker_documents(markers, _mapping(markers)).write.parquet(f"file://{tmp_path}/documents")
    docs = spark.read.parquet(f"file://{tmp_path}/documents")
    assert docs.columns == DOCUMENT.names
    trial = pivot.trials(docs).first()
    assert trial["meta"]["fps"] == pytest.approx(100) and trial["meta"]["n_frames"] == 600
    p = pivot.poses(docs)
    assert p.count() == 600 and p.filter("pos != frame_idx").isEmpty() and set(p.first()["landmarks"]) == {f"{s}_{n}" for s in ("LEFT", "RIGHT") for n in ("HIP", "KNEE", "ANKLE", "HEEL", "FOOT_INDEX", "SHOULDER")}
    hits = sorted(r["frame"] for r in events.detect_events(p, pivot.trials(docs), least=0.6).filter("side = 'left' AND kind = 'hs'").collect())
    assert len(hits) >= 4 and all(abs(b - a - 110) <= 3 for a, b in zip(hits, hits[1:], strict=False))
    spatial = _spatial(markers)
    angles = p.select("trial_id", "frame_idx", F.lit(1.0).alias("ankle_L"), F.lit(2.0).alias("ankle_R"))
    wide = spark.createDataFrame([("t", k, "left", v) for k, v in spatial.items() if k % 2], "trial_id string, frame_idx int, side string, ankle double")
    got = {r["frame_idx"]: (r["ankle_L"], r["ankle_R"]) for r in pipeline.with_spatial_ankles(angles, wide).collect()}
    assert len(spatial) == 600 and all(got[k] == ((pytest.approx(v), 2.0) if k % 2 else (1.0, 2.0)) for k, v in spatial.items())


def _mapping(markers):
    from kinelake.operators import optical

    return optical.marker_mapping(markers.select("trial_id", F.col("name").alias("label")).distinct())


def _spatial(markers):
    from kinelake.operators import optical

    named = markers.join(_mapping(markers).withColumnRenamed("label", "name"), ["trial_id", "name"]).groupBy("trial_id", "frame_idx", F.col("landmark").alias("name")).agg(*[F.avg(c).alias(c) for c in "XYZ"])
    return {r["frame_idx"]: r["ankle"] for r in optical.spatial_angles(named).filter("side = 'left'").collect()}


def test_frontal_joints_get_cycles_and_scores(spark):
    def deep(trial, with_depths):
        doc = walking(300, trial=trial)
        for i, f in enumerate(doc["frames"]):
            if with_depths:
                f["landmark_depths"] = {n: 0.1 + 0.02 * math.sin(i / 5) + 0.05 * k for k, n in enumerate(("LEFT_HIP", "LEFT_KNEE", "LEFT_ANKLE", "RIGHT_HIP", "RIGHT_KNEE", "RIGHT_ANKLE"))}
        return doc

    results = pipeline.run(as_documents(spark, [deep("deep", True), deep("flat", False)]))
    joints = {(r["trial_id"], r["joint"]) for r in results.curves.select("trial_id", "joint").distinct().collect()}
    assert ("deep", "knee_valgus") in joints and ("flat", "knee_valgus") not in joints and ("flat", "knee") in joints
    assert ("deep", "knee_valgus") in {(r["trial_id"], r["joint"]) for r in results.gvs.collect()}
    norm = spark.createDataFrame([(j, float(sd)) for j, sd in (("hip", 5), ("knee", 6), ("ankle", 4), ("trunk", 3), ("knee_valgus", 12))], "joint string, sd double")
    gps = spark.createDataFrame([("deep", "left", 8.0), ("flat", "left", 8.0)], "trial_id string, side string, gps double")
    own = {r["trial_id"]: r["sdi"] for r in scores.deviation_index(gps, norm, results.gvs).collect()}
    sd = lambda v: max(float(np.std(v)), 1.0)
    assert own == {"deep": round(100 - 10 * (8 - 6.0) / sd([5, 6, 4, 3, 12]), 1), "flat": round(100 - 10 * (8 - 4.5) / sd([5, 6, 4, 3]), 1)}
    with pytest.warns(DeprecationWarning):
        scores.gait_deviation_index_2d(gps, norm)
    results.release()


def test_depth_factors(spark):
    doc = walking(2, trial="a")
    doc["frames"][0]["landmark_depths"] = {"LEFT_HIP": 0.0, "LEFT_KNEE": 0.2, "LEFT_ANKLE": 5.0}
    p = pivot.poses(as_documents(spark, [doc]))
    first, second = pose.depth_factors(p).orderBy("pos").collect()
    thigh = math.dist(*[[doc["frames"][0]["landmarks"][n][c] for c in "xy"] for n in ("LEFT_HIP", "LEFT_KNEE")])
    assert first["hip_L"] == pytest.approx(math.hypot(thigh, 0.2) / thigh) and first["knee_L"] == 2.0 and first["ankle_L"] == 1.0 and first["hip_R"] == 1.0
    assert second["hip_L"] is None
    angles = p.select("trial_id", "frame_idx", "pos", F.lit(10.0).alias("hip_L"), F.lit(20.0).alias("knee_L"))
    got = pose.depth_corrected(p, angles).orderBy("pos").collect()
    assert [g["knee_L"] for g in got] == [40.0, 20.0] and got[0]["hip_L"] == pytest.approx(10 * first["hip_L"])


def plain_swap(points, names, mirror):
    out = [None if p is None else [1 - p[0], *p[1:]] if mirror else list(p) for p in points]
    done = set()
    for i, n in enumerate(names):
        m = layouts.partner(n)
        if i not in done and m in names:
            j = names.index(m)
            out[i], out[j] = out[j], out[i]
            done |= {i, j}
    return out


def test_extra_points_by_index(spark, rng):
    names = layouts.wholebody_133()
    assert len(names) == 133 == len(set(names)) and names[0] == "nose" and names[17] == "left_big_toe" and names[91] == "left_hand_0" and names[112] == "right_hand_0"
    assert layouts.permutation(["l_knee", "nose", "r_knee", "left_x", "l_alone"]) == [2, 1, 0, 3, 4]
    with pytest.raises(InvalidData):
        layouts.permutation(["a", "a"])
    points = [[[float(v) for v in rng.normal(size=3)] for _ in names] for _ in range(4)]
    rows = [(k, k % 2 == 0, p) for k, p in enumerate(points)] + [(9, True, None), (10, True, points[0][:5]), (11, None, points[1]), (12, True, points[2] + [[7.0, 8.0, 9.0]])]
    df = spark.createDataFrame(rows, "k int, wrong boolean, points array<array<double>>")
    for mirror, f in ((False, layouts.swap_points), (True, layouts.flip_points)):
        once = f(df, names, F.col("wrong"))
        got = {r["k"]: r["points"] for r in once.collect()}
        assert got[1] == points[1] and got[11] == points[1] and got[9] is None
        assert got[0] == pytest.approx(np.array(plain_swap(points[0], names, mirror))) and got[12][:133] == pytest.approx(np.array(plain_swap(points[2], names, mirror)))
        twice = {r["k"]: r["points"] for r in f(once, names, F.col("wrong")).collect()}
        assert twice[2] == pytest.approx(np.array(points[2])) and twice[12] == pytest.approx(np.array(rows[-1][2]))


def test_measurements_and_scale_setup(spark):
    docs = [walking(40, trial="a & b"), walking(10, trial="c")]
    docs[0]["subject"] |= {"weight_kg": 61.5, "height_m": 1.7}
    docs[1]["subject"] = None
    for f in docs[1]["frames"]:
        del f["landmarks"]["LEFT_KNEE"], f["landmarks"]["RIGHT_KNEE"]
    df = as_documents(spark, docs)
    lengths = sinks.measurements(pivot.poses(df))
    got = {(r["trial_id"], r["measurement"], r["part"]): (r["length"], r["n"]) for r in lengths.collect()}
    frames = docs[0]["frames"]
    at = lambda f, n: np.array([f["landmarks"][n]["x"], f["landmarks"][n]["y"]])
    mean = lambda f: pytest.approx(np.mean([np.linalg.norm(f(x)) for x in frames]))
    assert got["a & b", "femur_length", 0] == (mean(lambda x: at(x, "LEFT_HIP") - at(x, "LEFT_KNEE")), 40)
    assert got["a & b", "trunk_height", 0] == (mean(lambda x: (at(x, "LEFT_SHOULDER") + at(x, "RIGHT_SHOULDER") - at(x, "LEFT_HIP") - at(x, "RIGHT_HIP")) / 2), 40)
    assert {k[1] for k in got if k[0] == "c"} == {"trunk_height"}
    files = {r["name"]: ET.fromstring(r["content"].split("\n", 1)[1]) for r in sinks.scale_setup(pivot.trials(df), lengths=lengths).collect()}
    tool = files["a & b_scale.xml"].find("ScaleTool")
    assert tool.get("name") == "a & b" and float(tool.find("mass").text) == 61.5 and float(tool.find("height").text) == 1.7
    sets = tool.findall("ModelScaler/MeasurementSet/objects/Measurement")
    assert [m.get("name") for m in sets] == ["femur_length", "tibia_length", "trunk_height"] and [m.find("apply").text for m in sets] == ["true"] * 3
    assert [p.text for p in sets[0].iter("markers")] == ["L.ASIS L.Knee.Lat", "R.ASIS R.Knee.Lat"] and [b.get("name") for b in sets[1].iter("BodyScale")] == ["tibia_l", "tibia_r"]
    assert float(sets[2].find("notes").text) == pytest.approx(got["a & b", "trunk_height", 0][0], abs=1e-6)
    assert tool.find("MarkerPlacer/time_range").text == "0.000000 1.000000"
    other = files["c_scale.xml"].find("ScaleTool")
    assert (float(other.find("mass").text), float(other.find("height").text)) == (75.0, 1.75)
    assert [m.find("apply").text for m in other.iter("Measurement")] == ["false", "false", "true"]
    assert len(ET.fromstring(sinks.scale_setup(pivot.trials(df)).first()["content"].split("\n", 1)[1]).findall(".//MarkerPair")) == 6


def opened(content):
    """Sheets of a workbook, read by its XML."""
    book = zipfile.ZipFile(io.BytesIO(content))
    assert book.testzip() is None
    titles = [s.get("name") for s in ET.fromstring(book.read("xl/workbook.xml")).find("m:sheets", NS)]
    out = {}
    for k, t in enumerate(titles, 1):
        rows = []
        for row in ET.fromstring(book.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{{{NS['m']}}}row"):
            cells = []
            for c in row:
                v, text = c.find("m:v", NS), c.find("m:is/m:t", NS)
                cells.append(None if v is None and text is None else (text.text or "") if text is not None else bool(int(v.text)) if c.get("t") == "b" else float(v.text))
            rows.append(cells)
        out[t] = rows
    return out


def test_workbooks(spark, tmp_path):
    a = spark.createDataFrame([("t1", 2, 0.5, "x<&>\"é", True, [1, 2]), ("t1", 1, float("nan"), "\x01ok", False, None), ("t2", 3, None, None, None, [])], "trial_id string, n int, v double, s string, b boolean, l array<int>")
    b = spark.createDataFrame([("t1", k, k * 1.5) for k in range(2500)] + [("t3", 0, 0.0)], "trial_id string, k long, y double").repartition(5)
    files = sinks.workbook_files({"First & one": a, "Long": b, "Only": b.select("trial_id").distinct()})
    written = sinks.write_files(files, f"file://{tmp_path}/books").collect()
    assert {r["name"] for r in written} == {"t1.xlsx", "t2.xlsx", "t3.xlsx"}
    t1 = opened((tmp_path / "books/t1.xlsx").read_bytes())
    assert t1["First & one"] == [["n", "v", "s", "b", "l"], [1.0, None, "ok", False, "{}"], [2.0, 0.5, "x<&>\"é", True, '{"v":[1,2]}']]
    assert t1["Long"] == [["k", "y"], *[[float(k), k * 1.5] for k in range(2500)]] and t1["Only"] == [[], []]
    assert list(opened((tmp_path / "books/t2.xlsx").read_bytes())) == ["First & one"]
    try:
        from openpyxl import load_workbook
    except ImportError:
        return
    assert load_workbook(tmp_path / "books/t1.xlsx")["Long"]["B3"].value == 1.5


def test_results_as_workbooks(spark):
    docs = as_documents(spark, [walking(120, trial="a"), walking(120, trial="b", period=1.2)])
    results = pipeline.run(docs)
    sheets = sinks.result_sheets(results)
    assert set(sheets) == {"Summary", "Angles", "Events", "Cycles", "Curves", "Scores", "Quality", "Trial"} and all("trial_id" in df.columns for df in sheets.values())
    books = {r["name"]: opened(bytes(r["content"])) for r in sinks.workbook_files({k: sheets[k] for k in ("Angles", "Events", "Cycles", "Curves", "Trial")}).collect()}
    assert set(books) == {"a.xlsx", "b.xlsx"} and set(books["a.xlsx"]) == {"Angles", "Events", "Cycles", "Curves", "Trial"}
    assert len(books["a.xlsx"]["Angles"]) == 121 and len(books["b.xlsx"]["Cycles"]) == 1 + results.cycles.filter("trial_id = 'b'").count()
    marks = {r["name"]: opened(bytes(r["content"])) for r in sinks.workbook_files(sinks.landmark_sheets(pivot.poses(docs), ["NOSE", "LEFT_HIP"])).collect()}
    assert marks["a.xlsx"]["X"][0] == ["frame_idx", "NOSE", "LEFT_HIP"] and len(marks["a.xlsx"]["Visibility"]) == 121 and marks["a.xlsx"]["Y"][1] == [0.0, 0.15, 0.5]
    results.release()
