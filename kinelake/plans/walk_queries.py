"""Queries on poses, cycles, scores and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.columns import r6
from kinelake.operators import analysis, corrections, cycles, normative, optical, pose, quality, scores, validation
from kinelake.plans.series_queries import _CY, _EV, _R101, _S, _VC, RATE, _summaries
from kinelake.sources.driver_tables import VECTOR_LANDMARKS, event_series, gait_events, vector_curves, vector_pose

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _xy(name: str) -> tuple[str, str]:
    k = VECTOR_LANDMARKS.index(name)
    return f"(e[{2 * k + 1}] + 0.5)", f"(e[{2 * k + 2}] + 0.5)"


def _v(name: str) -> str:
    return f"least(1.0, abs(e[{43 + VECTOR_LANDMARKS.index(name)}]) * 5)"


_PO = """po AS (SELECT vec_id // 20 AS trial_id, (vec_id % 20)::INT AS frame_idx, (vec_id % 20)::INT AS pos, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)"""


def _sub(a: str, b: str) -> tuple[str, str]:
    return tuple(f"({p} - {q})" for p, q in zip(_xy(a), _xy(b), strict=True))


def _mid(a: str, b: str) -> tuple[str, str]:
    return tuple(f"(({p} + {q}) / 2)" for p, q in zip(_xy(a), _xy(b), strict=True))


def _between(u: tuple[str, str], v: tuple[str, str]) -> str:
    return f"degrees(acos(greatest(-1, least(1, ({u[0]} * {v[0]} + {u[1]} * {v[1]}) / (sqrt({u[0]} * {u[0]} + {u[1]} * {u[1]}) * sqrt({v[0]} * {v[0]} + {v[1]} * {v[1]}))))))"


def _knee(s: str) -> str:
    a, b = _sub(f"{s}_HIP", f"{s}_KNEE"), _sub(f"{s}_ANKLE", f"{s}_KNEE")
    return f"CASE WHEN {a[0]} * {b[1]} - {a[1]} * {b[0]} <= 0 THEN 180 - {_between(a, b)} ELSE {_between(a, b)} - 180 END"


def _ankle(s: str) -> str:
    return f"90 - {_between(_sub(f'{s}_KNEE', f'{s}_ANKLE'), _sub(f'{s}_FOOT_INDEX', f'{s}_HEEL'))}"


_TR = tuple(f"({h} - {s})" for h, s in zip(_mid("LEFT_HIP", "RIGHT_HIP"), _mid("LEFT_SHOULDER", "RIGHT_SHOULDER"), strict=True))


def _hip(s: str) -> str:
    t = _sub(f"{s}_KNEE", f"{s}_HIP")
    raw = f"(degrees(atan2({_TR[0]}, {_TR[1]}) - atan2({t[0]}, {t[1]})) + 180)"
    return f"{raw} - 360 * floor({raw} / 360) - 180"


# ------------------------------------------------------------ poses


@_query(f"WITH {_PO} SELECT trial_id, frame_idx, " + ", ".join(f"round({f(p)}, 5) + 0 AS {n}_{s}" for n, f in (("hip", _hip), ("knee", _knee), ("ankle", _ankle)) for s, p in (("L", "LEFT"), ("R", "RIGHT"))) + " FROM po")
def joint_angles(spark: SparkSession, d: str) -> DataFrame:
    """Hip against the trunk, signed knee flexion and dorsiflexion of every frame."""
    own = [(f"{n}_{s}", f(p)) for n, f in (("hip", pose.hip_vertical), ("knee", pose.knee), ("ankle", pose.ankle)) for s, p in (("L", "LEFT"), ("R", "RIGHT"))]
    return vector_pose(spark, d).select("trial_id", "frame_idx", *[(F.round(c, 5) + 0.0).alias(n) for n, c in own])


_TX = f"(-{_TR[0]})"


@_query(f"WITH {_PO} SELECT trial_id, frame_idx, round(CASE WHEN {_TX} > 0 THEN a ELSE -a END, 5) + 0 AS trunk_angle, round(CASE WHEN sqrt(power({_sub('RIGHT_HIP', 'LEFT_HIP')[0]}, 2) + power({_sub('RIGHT_HIP', 'LEFT_HIP')[1]}, 2)) >= 0.45 * sqrt(power({_TR[0]}, 2) + power({_TR[1]}, 2)) THEN degrees(atan2({_sub('RIGHT_HIP', 'LEFT_HIP')[1]}, {_sub('RIGHT_HIP', 'LEFT_HIP')[0]})) END, 5) + 0 AS pelvis_tilt FROM (SELECT *, {_between((_TX, f'(-{_TR[1]})'), ('0', '(-1)'))} AS a FROM po)")
def trunk_and_pelvis(spark: SparkSession, d: str) -> DataFrame:
    """Lean of the trunk and tilt of the pelvis."""
    return vector_pose(spark, d).select("trial_id", "frame_idx", (F.round(pose.trunk_lean(), 5) + 0.0).alias("trunk_angle"), (F.round(pose.pelvis_tilt(), 5) + 0.0).alias("pelvis_tilt"))


@_query(f"WITH {_PO} SELECT trial_id, frame_idx, pos, " + ", ".join(f"round(degrees(atan2(-({_sub(f'{p}_FOOT_INDEX', f'{p}_HEEL')[1]}), {_sub(f'{p}_FOOT_INDEX', f'{p}_HEEL')[0]})), 5) + 0 AS foot_angle_{s}" for s, p in (("L", "LEFT"), ("R", "RIGHT"))) + " FROM po")
def foot_progression(spark: SparkSession, d: str) -> DataFrame:
    """Feet above the horizontal."""
    out = pose.foot_progression(vector_pose(spark, d))
    return out.select("trial_id", "frame_idx", "pos", *[(F.round(c, 5) + 0.0).alias(c) for c in ("foot_angle_L", "foot_angle_R")])


@_query(f"WITH {_PO}, a AS (SELECT trial_id, unnest([{_sub('LEFT_FOOT_INDEX', 'LEFT_HEEL')[0]}, {_sub('RIGHT_FOOT_INDEX', 'RIGHT_HEEL')[0]}]) AS d FROM po) SELECT trial_id, CASE WHEN median(d) < 0 THEN 'left' ELSE 'right' END AS direction FROM a GROUP BY trial_id")
def walking_direction(spark: SparkSession, d: str) -> DataFrame:
    """Which way the feet point."""
    return pose.walking_direction(vector_pose(spark, d))


_SEG = [("LEFT_HIP", "LEFT_KNEE", "femur_L"), ("RIGHT_HIP", "RIGHT_KNEE", "femur_R"), ("LEFT_KNEE", "LEFT_ANKLE", "tibia_L"), ("RIGHT_KNEE", "RIGHT_ANKLE", "tibia_R"), ("LEFT_SHOULDER", "LEFT_ELBOW", "upper_arm_L"), ("RIGHT_SHOULDER", "RIGHT_ELBOW", "upper_arm_R"), ("LEFT_ELBOW", "LEFT_WRIST", "forearm_L"), ("RIGHT_ELBOW", "RIGHT_WRIST", "forearm_R"), ("LEFT_SHOULDER", "LEFT_HIP", "trunk_L"), ("RIGHT_SHOULDER", "RIGHT_HIP", "trunk_R")]


@_query(f"WITH {_PO}, l AS (" + " UNION ALL ".join(f"SELECT trial_id, '{n}' AS segment, sqrt(power({_sub(a, b)[0]}, 2) + power({_sub(a, b)[1]}, 2)) AS d FROM po" for a, b, n in _SEG) + ") SELECT trial_id, segment, round(avg(d), 6) + 0 AS mean, round(stddev_pop(d), 6) + 0 AS std, round(stddev_pop(d) / avg(d) * 100, 6) + 0 AS cv, stddev_pop(d) / avg(d) * 100 > 15 AS unsteady FROM l GROUP BY trial_id, segment")
def segment_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of body segments and how they vary."""
    out = analysis.segment_lengths(vector_pose(spark, d))
    return out.select("trial_id", "segment", r6("mean").alias("mean"), r6("std").alias("std"), r6("cv").alias("cv"), "unsteady")


_HX, _HY = _mid("LEFT_HIP", "RIGHT_HIP")


@_query(f"""WITH {_PO}, q AS (SELECT trial_id, pos, least(1.0, abs(e[64]) * 5) AS c, {_HX} AS hx, {_HY} AS hy FROM po), w AS (SELECT *, sqrt(power(hx - lag(hx) OVER x, 2) + power(hy - lag(hy) OVER x, 2)) AS step FROM q WINDOW x AS (PARTITION BY trial_id ORDER BY pos)),
    a AS (SELECT trial_id, avg((c > 0.3)::INT) AS detection, avg(c) AS confidence, 0.0::DOUBLE AS gap, coalesce(avg(step), 0) AS jitter FROM w GROUP BY trial_id)
    SELECT trial_id, round(detection, 6) AS detection, round(confidence, 6) AS confidence, round(gap, 6) AS gap, round(jitter, 6) AS jitter, round(100 * (0.3 * detection + 0.3 * least(confidence, 1) + 0.2 * (1 - gap) + 0.2 * greatest(0, 1 - jitter / 0.05)), 6) AS score FROM a""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """Detection, confidence, gaps and jitter as one score."""
    return quality.quality_score(vector_pose(spark, d)).select("trial_id", *[r6(c).alias(c) for c in ("detection", "confidence", "gap", "jitter", "score")])


@_query(f"""WITH {_PO}, q AS (SELECT trial_id, max({_HX}) - min({_HX}) AS reach, var_pop({_HX}) AS v, count({_HX}) AS n FROM po GROUP BY trial_id)
    SELECT trial_id, n >= 2 AND reach < 0.10 AS treadmill,
           round(CASE WHEN n < 2 THEN 0 WHEN reach < 0.10 AND v < 0.005 THEN greatest(0.5, least(1, 1 - reach / 0.10)) WHEN reach < 0.10 OR v < 0.005 THEN 0.5 ELSE greatest(0, 1 - (reach - 0.10) / 0.10) END, 6)::DOUBLE AS confidence FROM q""")
def treadmill_detection(spark: SparkSession, d: str) -> DataFrame:
    """Whether the hips stay in place."""
    return quality.treadmill(vector_pose(spark, d)).select("trial_id", "treadmill", r6("confidence").alias("confidence"))


def _length(a: str, b: str) -> str:
    dx, dy = _sub(a, b)
    return f"sqrt(power({dx}, 2) + power({dy}, 2))"


@_query(f"""WITH {_PO}, q AS (SELECT trial_id, {_length('LEFT_HIP', 'RIGHT_HIP')} AS wide, ({_length('LEFT_HIP', 'LEFT_KNEE')} + {_length('RIGHT_HIP', 'RIGHT_KNEE')}) / 2 AS femur FROM po),
    a AS (SELECT trial_id, coalesce(avg(wide / femur) FILTER (femur >= 1e-6), 0) AS r, count(*) FILTER (femur >= 1e-6) / count(*) AS share FROM q GROUP BY trial_id)
    SELECT trial_id, round(r, 6) AS ratio, round(degrees(asin(least(1.0, r))), 6) AS degrees, degrees(asin(least(1.0, r))) < 15 AS aligned, round(share, 6) AS confidence FROM a""")
def sagittal_alignment(spark: SparkSession, d: str) -> DataFrame:
    """How far the walk leaves the picture's plane."""
    out = quality.sagittal_alignment(vector_pose(spark, d))
    return out.select("trial_id", *[r6(c).alias(c) for c in ("ratio", "degrees", "confidence")], "aligned")


@_query(f"""WITH {_PO}, a AS (SELECT trial_id, pos, 60 * {_xy('LEFT_SHOULDER')[0]} AS l, CASE WHEN trial_id % 3 > 0 THEN 60 * {_xy('RIGHT_SHOULDER')[0]} END AS r, 60 * {_xy('LEFT_HIP')[0]} AS h, {_xy('LEFT_WRIST')[0]} AS wl, {_xy('RIGHT_WRIST')[0]} AS wr FROM po),
    g AS (SELECT trial_id, count(l) > 0 AND count(r) > 0 AS known, max(l) - min(l) AS l, max(r) - min(r) AS r, 100 * (max(wl) - min(wl)) AS wl, 100 * (max(wr) - min(wr)) AS wr, count(r) AS n, count(h) AS m, corr(r, h) AS c FROM a GROUP BY trial_id),
    s AS (SELECT trial_id, CASE WHEN known THEN l ELSE wl END AS l, CASE WHEN known THEN r ELSE wr END AS r, CASE WHEN n > 0 AND n = m THEN greatest(0, -100 * c) END AS c FROM g)
    SELECT trial_id, round(l, 6) AS "left", round(r, 6) AS "right", round(c, 6) + 0 AS coordination, (l + r) / 2 < 10 AS reduced FROM s""")
def arm_swing(spark: SparkSession, d: str) -> DataFrame:
    """Reach of the arms, by shoulders or else wrists."""
    p = vector_pose(spark, d)
    arms = p.select("trial_id", (pose.x("LEFT_SHOULDER") * 60).alias("left"), F.when(F.col("trial_id") % 3 > 0, pose.x("RIGHT_SHOULDER") * 60).alias("right"), (pose.x("LEFT_HIP") * 60).alias("hip"), pose.x("LEFT_WRIST").alias("wrist_left"), pose.x("RIGHT_WRIST").alias("wrist_right"))
    return analysis.arm_swing(arms).select("trial_id", *[r6(c).alias(c) for c in ("left", "right", "coordination")], "reduced")


def _z(name: str) -> str:
    return f"e[{VECTOR_LANDMARKS.index(name) + 1}]"


def _frontal(a: str, b: str) -> tuple[str, str]:
    return _sub(a, b)[0], f"({_z(a)} - {_z(b)})"


_FRONTAL = ", ".join(f"round({_between(_frontal(f'{s}_KNEE', f'{s}_HIP'), ('0', '1'))}, 6) AS hip_abduction_{s[0]}, round(180 - {_between(_frontal(f'{s}_HIP', f'{s}_KNEE'), _frontal(f'{s}_ANKLE', f'{s}_KNEE'))}, 6) AS knee_valgus_{s[0]}" for s in ("LEFT", "RIGHT"))


@_query(f"WITH {_PO} SELECT trial_id, frame_idx, {_FRONTAL} FROM po")
def frontal_angles(spark: SparkSession, d: str) -> DataFrame:
    """Thigh and knee in the plane of x and depth."""
    depths = F.map_from_arrays(F.array(*map(F.lit, VECTOR_LANDMARKS)), F.array(*[pose.x(n) * 0 + F.get("e", F.lit(k)) for k, n in enumerate(VECTOR_LANDMARKS)]))
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.floor(F.col("vec_id") / 20).alias("trial_id"), (F.col("vec_id") % 20).cast("int").alias("frame_idx"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    p = vector_pose(spark, d).join(e, ["trial_id", "frame_idx"]).withColumn("landmark_depths", depths)
    out = pose.frontal_angles(p)
    return out.select("trial_id", "frame_idx", *[r6(c).alias(c) for c in out.columns if c.startswith(("hip", "knee"))])


@_query(f"WITH {_PO}, l AS (SELECT trial_id, unnest([{', '.join(_xy(n)[0] for n in VECTOR_LANDMARKS)}]) AS x, unnest([{', '.join(_xy(n)[1] for n in VECTOR_LANDMARKS)}]) AS y FROM po), q AS (SELECT trial_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM l GROUP BY trial_id) SELECT trial_id, greatest(0, least(1920, round((x0 - 0.15 * (x1 - x0)) * 1920)))::INT AS \"left\", greatest(0, least(1080, round((y0 - 0.15 * (y1 - y0)) * 1080)))::INT AS top, greatest(0, least(1920, round((x1 + 0.15 * (x1 - x0)) * 1920)))::INT AS \"right\", greatest(0, least(1080, round((y1 + 0.15 * (y1 - y0)) * 1080)))::INT AS bottom FROM q")
def landmark_box(spark: SparkSession, d: str) -> DataFrame:
    """The padded box of all landmarks in pixels."""
    return quality.bounding_box(vector_pose(spark, d), 1920, 1080)


_MASS = {"trunk": (0.497 / 2, 0.5), "upper_arm": (0.028, 0.436), "forearm": (0.022, 0.43), "femur": (0.1, 0.433), "tibia": (0.047, 0.433)}


def _com(axis: int) -> str:
    parts = [f"{_MASS[n[:-2]][0]!r} * ({_xy(a)[axis]} + {_MASS[n[:-2]][1]} * ({_xy(b)[axis]} - {_xy(a)[axis]}))" for a, b, n in _SEG]
    s = _mid("LEFT_SHOULDER", "RIGHT_SHOULDER")[axis]
    return f"({' + '.join(parts)} + 0.081 * ({s} + 0.5 * ({_xy('NOSE')[axis]} - {s}))) / {sum(_MASS[n[:-2]][0] for _, _, n in _SEG) + 0.081!r}"


@_query(f"WITH {_PO} SELECT trial_id, frame_idx, pos, round({_com(0)}, 6) + 0 AS com_x, round({_com(1)}, 6) + 0 AS com_y FROM po")
def centre_of_mass(spark: SparkSession, d: str) -> DataFrame:
    """Mass-weighted mean of the body's segments."""
    return analysis.centre_of_mass(vector_pose(spark, d)).select("trial_id", "frame_idx", "pos", r6("com_x").alias("com_x"), r6("com_y").alias("com_y"))


@_query(f"""WITH {_PO}, q AS (SELECT trial_id, pos, {_mid('LEFT_ANKLE', 'RIGHT_ANKLE')[0]} AS x, {_mid('LEFT_ANKLE', 'RIGHT_ANKLE')[1]} AS y FROM po), w AS (SELECT *, sqrt(power(x - lag(x) OVER o, 2) + power(y - lag(y) OVER o, 2)) AS dist FROM q WINDOW o AS (PARTITION BY trial_id ORDER BY pos))
    SELECT trial_id, round(pi() * 5.991 * sqrt(greatest(0, var_samp(x) * var_samp(y) - covar_samp(x, y) * covar_samp(x, y))), 6) AS ellipse_area, round(sum(dist), 6) AS path, round(max(x) - min(x), 6) AS range_x, round(max(y) - min(y), 6) AS range_y, round(sum(dist) * 4 / (count(*) - 1), 6) AS speed FROM w GROUP BY trial_id""")
def postural_sway(spark: SparkSession, d: str) -> DataFrame:
    """Ellipse and path of the ankles' middle."""
    p = vector_pose(spark, d).select("trial_id", "pos", pose.middle(pose.x("LEFT_ANKLE"), pose.x("RIGHT_ANKLE")).alias("x"), pose.middle(pose.y("LEFT_ANKLE"), pose.y("RIGHT_ANKLE")).alias("y"))
    return analysis.postural_sway(p, RATE).select("trial_id", *[r6(c).alias(c) for c in ("ellipse_area", "path", "range_x", "range_y", "speed")])


@_query(f"WITH {_PO}, l AS (" + " UNION ALL ".join(f"SELECT trial_id, pos, '{n}' AS name, {_xy(n)[0]} AS x, {_v(n)} AS v FROM po" for n in VECTOR_LANDMARKS) + "), w AS (SELECT *, max(pos) OVER (PARTITION BY trial_id) + 1 AS n FROM l) SELECT trial_id, name, least(floor(pos * 5 / n::DOUBLE), 4)::INT AS bin, round(avg((v >= 0.3)::INT), 6) AS rate FROM w GROUP BY ALL")
def detection_matrix(spark: SparkSession, d: str) -> DataFrame:
    """How often each landmark is seen, by time."""
    out = quality.detection_matrix(vector_pose(spark, d), 5)
    return out.select("trial_id", "name", "bin", r6("rate").alias("rate"))


@_query(f"WITH {_PO}, q AS (SELECT trial_id, frame_idx, [" + ", ".join(f"round({c}, 6)" for n in ("NOSE LEFT_EYE RIGHT_EYE LEFT_EAR RIGHT_EAR LEFT_SHOULDER RIGHT_SHOULDER LEFT_ELBOW RIGHT_ELBOW LEFT_WRIST RIGHT_WRIST LEFT_HIP RIGHT_HIP LEFT_KNEE RIGHT_KNEE LEFT_ANKLE RIGHT_ANKLE").split() for c in (*_xy(n), _v(n))) + "] AS k FROM po), n AS (SELECT trial_id, frame_idx, unnest(k) AS v, unnest(range(51)) AS i FROM q) SELECT trial_id, frame_idx, i::INT AS i, v FROM n")
def keypoints_coco(spark: SparkSession, d: str) -> DataFrame:
    """Landmarks in the order of a keypoint format."""
    out = pose.keypoints(vector_pose(spark, d), "COCO")
    return out.select("trial_id", "frame_idx", F.posexplode(F.transform("keypoints", lambda v: F.round(v, 6))).alias("i", "v"))


# ------------------------------------------------------------ cycles and figures


@_query(f"""WITH {_CY}, a AS (SELECT trial_id, count(*) AS n_cycles, avg(duration) AS m, stddev_pop(duration) AS sd, avg(CASE WHEN side = 'left' AND stance_pct BETWEEN 35 AND 80 THEN stance_pct END) AS sl, avg(CASE WHEN side = 'right' AND stance_pct BETWEEN 35 AND 80 THEN stance_pct END) AS sr FROM cy GROUP BY trial_id),
    hh AS (SELECT *, lead(frame) OVER x AS nf, lead(side) OVER x AS ns FROM ev WHERE kind = 'hs' WINDOW x AS (PARTITION BY trial_id ORDER BY frame, side)), st AS (SELECT trial_id, avg((nf - frame) / 4.0) AS step FROM hh WHERE side <> ns GROUP BY trial_id)
    SELECT a.trial_id, n_cycles, round(m, 6) AS stride_time_mean_s, round(sd, 6) AS stride_time_std_s, round(120 / m, 6) AS cadence_steps_per_min, round(sl, 6) AS stance_pct_left, round(sr, 6) AS stance_pct_right, round(greatest(0, CASE WHEN sl + sr IS NOT NULL THEN sl + sr - 100 END), 6) AS dsp, round(step, 6) AS step_time_mean_s, sl + sr IS NULL AS no_dsp FROM a LEFT JOIN st USING (trial_id)""")
def spatiotemporal(spark: SparkSession, d: str) -> DataFrame:
    """Stride, step, cadence, stance and double support of each trial."""
    e = gait_events(spark, d)
    out = analysis.spatiotemporal(cycles.segment(e, RATE), e, RATE)
    return out.select("trial_id", "n_cycles", *[r6(c).alias(c) for c in ("stride_time_mean_s", "stride_time_std_s", "cadence_steps_per_min", "stance_pct_left", "stance_pct_right", "step_time_mean_s")], r6(F.coalesce("double_support_pct", F.lit(0.0))).alias("dsp"), F.col("double_support_pct").isNull().alias("no_dsp"))


@_query(f"WITH {_CY} SELECT trial_id, round(CASE WHEN count(duration) < 2 THEN 0 ELSE stddev_samp(duration) / avg(duration) * 100 END, 6) AS cycle_duration_cv, round(CASE WHEN count(stance_pct) < 2 OR avg(stance_pct) = 0 THEN 0 ELSE stddev_samp(stance_pct) / avg(stance_pct) * 100 END, 6) AS stance_cv FROM cy GROUP BY trial_id")
def variability(spark: SparkSession, d: str) -> DataFrame:
    """Variation of cycles."""
    return analysis.variability(cycles.segment(gait_events(spark, d), RATE)).select("trial_id", r6("cycle_duration_cv").alias("cycle_duration_cv"), r6("stance_cv").alias("stance_cv"))


@_query(f"""WITH {_CY}, t AS (SELECT cy.trial_id, cy.side, cy.cycle_id, cy.end_frame, min(ev.frame) AS f FROM cy JOIN ev ON ev.trial_id = cy.trial_id AND ev.side <> cy.side AND ev.kind = 'to' AND ev.frame BETWEEN cy.start_frame AND cy.end_frame GROUP BY ALL) SELECT trial_id, side, round(avg((end_frame - f) / 4.0), 6) AS single_support FROM t GROUP BY trial_id, side""")
def single_support(spark: SparkSession, d: str) -> DataFrame:
    """Time on one leg within cycles."""
    e = gait_events(spark, d)
    return analysis.single_support(cycles.segment(e, RATE), e, RATE).select("trial_id", "side", r6("single_support").alias("single_support"))


@_query(f"""WITH {_CY}, v AS (SELECT cy.trial_id, cy.side, abs(b.value - a.value) / duration AS v FROM cy JOIN s a ON a.trial_id = cy.trial_id AND a.pos = cy.start_frame JOIN s b ON b.trial_id = cy.trial_id AND b.pos = cy.end_frame)
    SELECT trial_id, side, round(avg(v), 6) AS speed FROM v GROUP BY trial_id, side UNION ALL SELECT trial_id, 'overall', round(avg(v), 6) FROM v GROUP BY trial_id""")
def walking_speed(spark: SparkSession, d: str) -> DataFrame:
    """Distance over duration of cycles, by side and overall."""
    at = event_series(spark, d).withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right")))).select("trial_id", "side", F.col("pos").alias("frame_idx"), F.col("value").alias("x"))
    return analysis.walking_speed(cycles.segment(gait_events(spark, d), RATE), at).select("trial_id", "side", r6("speed").alias("speed"))


@_query(f"""WITH {_EV}, h AS (SELECT *, lead(frame) OVER x AS nf, lead(side) OVER x AS ns FROM ev WHERE kind = 'hs' WINDOW x AS (PARTITION BY trial_id ORDER BY frame, side)) SELECT h.trial_id, ns AS side, round(avg(abs(b.value - a.value)), 6) AS step_length FROM h JOIN s a ON a.trial_id = h.trial_id AND a.pos = h.frame JOIN s b ON b.trial_id = h.trial_id AND b.pos = h.nf WHERE side <> ns GROUP BY h.trial_id, ns""")
def step_length(spark: SparkSession, d: str) -> DataFrame:
    """Distance between successive contacts of the two sides."""
    at = event_series(spark, d).withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right")))).select("trial_id", "side", F.col("pos").alias("frame_idx"), F.col("value").alias("x"))
    return analysis.step_lengths(gait_events(spark, d), at).select("trial_id", "side", r6("step_length").alias("step_length"))


@_query(f"""WITH {_CY}, g AS (SELECT trial_id, quantile_cont(value, 0.95) AS ground FROM s GROUP BY trial_id), c AS (SELECT cy.trial_id, cy.side, cy.cycle_id, min(ground - s.value) AS c FROM cy JOIN g USING (trial_id) JOIN s ON s.trial_id = cy.trial_id AND s.pos >= cy.toe_off_frame AND s.pos < cy.end_frame GROUP BY ALL)
    SELECT trial_id, side, round(avg(c), 6) + 0 AS clearance FROM c GROUP BY trial_id, side""")
def toe_clearance(spark: SparkSession, d: str) -> DataFrame:
    """Least height above ground between lift-off and contact."""
    at = event_series(spark, d).withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right")))).select("trial_id", "side", F.col("pos").alias("frame_idx"), F.col("value").alias("y"))
    return analysis.toe_clearance(cycles.segment(gait_events(spark, d), RATE), at, at).select("trial_id", "side", r6("clearance").alias("clearance"))


@_query(f"""WITH {_CY}, a AS (SELECT trial_id, avg(CASE WHEN side = 'left' THEN stance_pct END) AS l, avg(CASE WHEN side = 'right' THEN stance_pct END) AS r FROM cy GROUP BY trial_id) SELECT trial_id, coalesce((l < 55 AND r > 60) OR (r < 55 AND l > 60), false) AS detected, CASE WHEN l < 55 AND r > 60 THEN 'left' WHEN r < 55 AND l > 60 THEN 'right' END AS affected FROM a""")
def antalgic_gait(spark: SparkSession, d: str) -> DataFrame:
    """Short stance on one side and long on the other."""
    return analysis.antalgic(cycles.segment(gait_events(spark, d), RATE))


@_query(f"WITH {_VC}, r AS (SELECT trial_id, side, joint, list_max(curve) - list_min(curve) AS rom FROM vc) SELECT trial_id, side, joint, round(avg(rom), 5) AS rom_mean, round(stddev_pop(rom), 5) AS rom_std, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(rom) / avg(rom) * 100 END, 5) AS rom_cv FROM r GROUP BY ALL")
def rom_summary(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of motion over cycles."""
    out = analysis.rom_table(vector_curves(spark, d))
    return out.select("trial_id", "side", "joint", *[F.round(c, 5).alias(c) for c in ("rom_mean", "rom_std", "rom_cv")])


@_query(f"""WITH {_VC}, r AS (SELECT trial_id, side, joint, avg(list_max(curve) - list_min(curve)) AS rom FROM vc GROUP BY ALL), w AS (SELECT trial_id, joint, max(CASE WHEN side = 'left' THEN rom END) AS l, max(CASE WHEN side = 'right' THEN rom END) AS r FROM r GROUP BY ALL) SELECT trial_id, joint, round(abs(l - r) / (0.5 * (l + r)) * 100, 5) AS si FROM w WHERE l IS NOT NULL AND r IS NOT NULL""")
def symmetry_index(spark: SparkSession, d: str) -> DataFrame:
    """Difference of ranges of motion between sides."""
    from kinelake.functions.columns import symmetry_index as si

    roms = analysis.rom_table(vector_curves(spark, d)).groupBy("trial_id", "joint").agg(*[F.max(F.when(F.col("side") == s, F.col("rom_mean"))).alias(s) for s in ("left", "right")])
    return roms.select("trial_id", "joint", F.round(si("left", "right"), 5).alias("si")).filter(F.col("si").isNotNull())


@_query(f"WITH {_R101}, g AS (SELECT cycle_id, side, joint, trial_id, list(value ORDER BY p) AS c FROM rs GROUP BY ALL), m AS (SELECT trial_id, side, joint, avg(list_max(c[61:101])) AS swing_max, avg(list_max(c[1:61])) AS stance_max FROM g GROUP BY ALL) SELECT trial_id, side, round(max(CASE WHEN joint = 'ankle' THEN stance_max END), 5) + 0 AS value FROM m GROUP BY trial_id, side HAVING max(CASE WHEN joint = 'ankle' THEN stance_max END) IS NOT NULL")
def equinus_value(spark: SparkSession, d: str) -> DataFrame:
    """Greatest dorsiflexion up to 60 percent, mean over cycles."""
    from kinelake.functions.columns import resample

    out = analysis.equinus(vector_curves(spark, d).withColumn("curve", resample("curve", 101)))
    return out.select("trial_id", "side", (F.round("value", 5) + 0.0).alias("value"))


# ------------------------------------------------------------ scores and checks

_NORM = "nm(joint, p, mean, sd) AS (VALUES " + ", ".join(f"('{j}', {p}, {float(m)!r}::DOUBLE, {float(s)!r}::DOUBLE)" for j in ("hip", "knee", "ankle") for p, (m, s) in enumerate(zip(*normative.curve(j), strict=True))) + ")"
_GVS = f"{_R101}, {_NORM}, gv AS (SELECT trial_id, side, joint, sqrt(avg(power(sm.mean - nm.mean, 2))) AS gvs FROM sm JOIN nm USING (joint, p) GROUP BY ALL)"


def _adult(spark: SparkSession) -> DataFrame:
    return normative.table(spark).filter("stratum = 'adult' AND joint IN ('hip', 'knee', 'ankle')")


def _gvs(spark: SparkSession, d: str) -> DataFrame:
    return scores.variable_scores(_summaries(spark, d), _adult(spark), digits=None)


@_query(f"WITH {_GVS} SELECT trial_id, side, joint, round(gvs, 5) AS gvs FROM gv")
def gait_variable_scores(spark: SparkSession, d: str) -> DataFrame:
    """Distance of mean curves from normative ones."""
    return _gvs(spark, d).withColumn("gvs", F.round("gvs", 5))


@_query(f"WITH {_GVS} SELECT trial_id, side, round(sqrt(avg(gvs * gvs)), 5) AS gps FROM gv GROUP BY trial_id, side UNION ALL SELECT trial_id, 'overall', round(sqrt(avg(gvs * gvs)), 5) FROM gv GROUP BY trial_id")
def gait_profile_score(spark: SparkSession, d: str) -> DataFrame:
    """Root mean square of the variable scores, by side and overall."""
    return scores.profile_score(_gvs(spark, d)).withColumn("gps", F.round("gps", 5))


@_query(f"WITH {_GVS}, gp AS (SELECT trial_id, side, sqrt(avg(gvs * gvs)) AS gps FROM gv GROUP BY trial_id, side UNION ALL SELECT trial_id, 'overall', sqrt(avg(gvs * gvs)) FROM gv GROUP BY trial_id), rf AS (SELECT avg(m) AS ref, greatest(stddev_pop(m), 1) AS sd FROM (SELECT avg(sd) AS m FROM nm GROUP BY joint)) SELECT trial_id, side, round(greatest(0, least(120, 100 - 10 * (gps - ref) / sd)), 1) + 0 AS sdi FROM gp, rf")
def sagittal_deviation_index(spark: SparkSession, d: str) -> DataFrame:
    """The profile score as an index."""
    return scores.deviation_index(scores.profile_score(_gvs(spark, d)), _adult(spark))


@_query(f"WITH {_GVS} SELECT trial_id, joint, round(max(CASE WHEN side = 'left' THEN gvs END), 5) AS \"left\", round(max(CASE WHEN side = 'right' THEN gvs END), 5) AS \"right\" FROM gv GROUP BY trial_id, joint")
def movement_analysis_profile(spark: SparkSession, d: str) -> DataFrame:
    """Variable scores by joint, sides beside each other."""
    return scores.movement_profile(_gvs(spark, d)).select("trial_id", "joint", F.round("left", 5).alias("left"), F.round("right", 5).alias("right"))


@_query("""WITH r(joint, lo, hi) AS (VALUES ('A', 5.0, 40.0), ('N', 10.0, 50.0), ('R', 1.0, 30.0)), q AS (SELECT l_suppkey AS trial_id, l_returnflag AS joint, count(*) AS n, avg(CASE WHEN l_quantity BETWEEN lo AND hi THEN 0.0 ELSE 100.0 END) AS o FROM lineitem JOIN r ON joint = l_returnflag GROUP BY ALL)
    SELECT trial_id, joint, n, round(o, 6) AS outside, CASE WHEN o > 50 THEN 'critical' WHEN o > 20 THEN 'warning' ELSE 'info' END AS severity FROM q WHERE o > 5""")
def range_validation(spark: SparkSession, d: str) -> DataFrame:
    """Share of values outside ranges, with a severity."""
    table = spark.createDataFrame([("A", 5.0, 40.0), ("N", 10.0, 50.0), ("R", 1.0, 30.0)], "joint string, lo double, hi double")
    values = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("trial_id"), F.col("l_returnflag").alias("joint"), F.col("l_quantity").cast("double").alias("value"))
    return validation.check_ranges(values, table, ["trial_id"]).withColumn("outside", r6("outside"))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 100 < 18 THEN 'pediatric' WHEN c_custkey % 100 >= 65 THEN 'elderly' ELSE 'adult' END AS stratum FROM customer")
def select_stratum(spark: SparkSession, d: str) -> DataFrame:
    """Normative stratum by age."""
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", normative.stratum_of(F.col("c_custkey") % 100).alias("stratum"))


@_query("SELECT r_name AS model, n_name AS method, 'raw' AS variant FROM region, nation UNION ALL SELECT r_name, n_name, 'filtered' FROM region, nation")
def benchmark_grid(spark: SparkSession, d: str) -> DataFrame:
    """All combinations of three lists of settings."""
    from kinelake.plans.benchmark import grid

    model = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("model"))
    method = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("method"))
    return grid(model, method, spark.createDataFrame([("raw",), ("filtered",)], "variant string"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, to_json({'k': CAST(json_extract(props, '$.k') AS BIGINT)})::VARCHAR AS again FROM events")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A field out of JSON text, and JSON text again."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k bigint").alias("j"))
    return rows.select("event_id", F.col("j.k").alias("k"), F.to_json("j").alias("again"))


@_query(f"""WITH {_S}, p AS (SELECT trial_id, pos, value, (pos % 20) / 20.0::DOUBLE AS ph FROM s) SELECT trial_id, pos, round(value - (3.251 * sin(2 * pi() * ph) + 1.207 * cos(2 * pi() * ph) - 2.989 * sin(4 * pi() * ph) + 4.170 * cos(4 * pi() * ph)) / 0.707106781, 6) + 0 AS value FROM p""")
def fourier_bias_correction(spark: SparkSession, d: str) -> DataFrame:
    """Less the mean error of the knee at each phase."""
    rows = event_series(spark, d).withColumn("ph", (F.col("pos") % 20) / 20.0)
    return rows.select("trial_id", "pos", r6(F.col("value") - corrections.bias(F.col("ph"), "knee")).alias("value"))


@_query(f"WITH {_S}, l AS (SELECT *, CASE WHEN count(value) OVER x < 5 THEN 1 ELSE greatest(0.3, least(1, value / quantile_cont(value, 0.95) OVER x)) END AS c, value - 50 AS a FROM s WINDOW x AS (PARTITION BY trial_id)) SELECT trial_id, pos, round(degrees(atan2(sin(radians(greatest(-80, least(80, a)))), cos(radians(greatest(-80, least(80, a)))) * c)), 6) + 0 AS angle FROM l")
def perspective_correction(spark: SparkSession, d: str) -> DataFrame:
    """Angles brought back into their plane by how much segments are foreshortened."""
    rows = event_series(spark, d).withColumn("c", corrections.foreshortening(F.col("value")))
    return rows.select("trial_id", "pos", r6(corrections.unprojected(F.col("value") - 50.0, F.col("c"))).alias("angle"))


@_query(f"""WITH {_S}, q AS (SELECT trial_id, pos, value AS v, lag(value) OVER (PARTITION BY trial_id ORDER BY pos) AS w FROM s), k AS (SELECT * FROM q WHERE w IS NOT NULL),
    a AS (SELECT trial_id, count(*) AS n, sqrt(avg(power(v - w, 2))) AS rmse, avg(abs(v - w)) AS mae, avg(v - w) AS bias, (max(v) - min(v)) - (max(w) - min(w)) AS rom_diff, sum(2 * power(v - (v + w) / 2, 2)) / count(*) AS wi, (sum(v * v + w * w) - 2 * count(*) * power((avg(v) + avg(w)) / 2, 2)) / (2 * count(*) - 1) AS t FROM k GROUP BY trial_id)
    SELECT trial_id, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(bias, 6) + 0 AS bias, round(rom_diff, 6) + 0 AS rom_diff, round(CASE WHEN t > 0 THEN sqrt(greatest(0, 1 - wi / t)) END, 5) AS cmc FROM a WHERE n >= 3""")
def error_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two recordings of one signal."""
    from pyspark.sql import Window

    rows = event_series(spark, d).withColumn("reference", F.lag("value").over(Window.partitionBy("trial_id").orderBy("pos")))
    out = optical.error_metrics(rows, ["trial_id"]).filter("n >= 3")
    return out.select("trial_id", "n", *[r6(c).alias(c) for c in ("rmse", "mae", "bias", "rom_diff")], F.round("cmc", 5).alias("cmc"))
