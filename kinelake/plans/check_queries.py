"""Queries on plausibility, views and normalised figures, with SQL written from their definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.columns import r6
from kinelake.operators import analysis, cycles, degradation, events, pose, quality
from kinelake.operators.quality import STEADY_LANDMARKS, STEADY_SEGMENTS
from kinelake.plans.series_queries import _CY, _VC, RATE
from kinelake.plans.walk_queries import _PO, _TR, _ankle, _between, _knee, _mid, _sub, _v, _xy
from kinelake.sources.driver_tables import VECTOR_LANDMARKS, gait_events, vector_curves, vector_pose

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _far(a: tuple[str, str], b: tuple[str, str]) -> str:
    return f"sqrt(({a[0]} - {b[0]}) ** 2 + ({a[1]} - {b[1]}) ** 2)"


def _cv(value: str) -> str:
    return f"CASE WHEN count({value}) < 2 OR avg({value}) = 0 THEN 0 ELSE stddev_samp({value}) / avg({value}) * 100 END"


def _penalty(z: str) -> str:
    return f"CASE WHEN {z} > 2 THEN greatest(0, least(1, 1 - ({z} - 2) / 4)) ELSE 1 END"


_N = range(len(STEADY_SEGMENTS))
_LAGGED = {n: tuple(f"lag({c}) OVER w" for c in _xy(n)) for n in STEADY_LANDMARKS}
_Z = ", ".join(f"coalesce(CASE WHEN median(s{k}) OVER t >= 0.05 THEN (d{k} - CASE WHEN count(d{k}) OVER t > 2 THEN avg(d{k}) OVER t ELSE 0 END) / (CASE WHEN count(d{k}) OVER t > 2 THEN stddev_pop(d{k}) OVER t ELSE 0 END + 1e-10) END, 0)" for k in _N)


@_query(f"""WITH {_PO}, l AS (SELECT *, {", ".join(f"{_far(_xy(a), _xy(b))} AS s{k}" for k, (a, b) in enumerate(STEADY_SEGMENTS))}, {", ".join(f"{_between(_sub(f'{s}_HIP', f'{s}_KNEE'), _sub(f'{s}_ANKLE', f'{s}_KNEE'))} AS k{s[0]}" for s in ("LEFT", "RIGHT"))} FROM po),
    d AS (SELECT *, {", ".join(f"abs(s{k} - lag(s{k}) OVER w) AS d{k}" for k in _N)}, CASE WHEN lag(pos) OVER w IS NOT NULL THEN greatest({", ".join(_far(_xy(n), _LAGGED[n]) for n in STEADY_LANDMARKS)}) END AS v, abs(kL - lag(kL) OVER w) AS a, abs(kR - lag(kR) OVER w) AS b FROM l WINDOW w AS (PARTITION BY trial_id ORDER BY pos)),
    k AS (SELECT trial_id, count(c) AS n, avg(c) AS m, stddev_pop(c) + 1e-10 AS sd FROM (SELECT trial_id, a AS c FROM d UNION ALL SELECT trial_id, b FROM d) GROUP BY trial_id),
    z AS (SELECT d.trial_id, frame_idx, greatest({_Z}) AS zs, CASE WHEN count(v) OVER t > 2 AND stddev_pop(v) OVER t > 1e-10 THEN (v - avg(v) OVER t) / stddev_pop(v) OVER t END AS zv, CASE WHEN n > 2 THEN greatest((a - m) / sd, (b - m) / sd) END AS za FROM d JOIN k USING (trial_id) WINDOW t AS (PARTITION BY d.trial_id)),
    p AS (SELECT trial_id, frame_idx, {_penalty("zs")} AS segment, {_penalty("zv")} AS velocity, {_penalty("za")} AS angle FROM z)
    SELECT trial_id, frame_idx, round(segment, 6) AS segment, round(velocity, 6) AS velocity, round(angle, 6) AS angle, round(0.4 * segment + 0.35 * velocity + 0.25 * angle, 6) AS score, 0.4 * segment + 0.35 * velocity + 0.25 * angle < 0.5 AS is_low FROM p""")
def frame_coherence(spark: SparkSession, d: str) -> DataFrame:
    """How plausible each frame is after the one before."""
    return quality.coherence(vector_pose(spark, d)).select("trial_id", "frame_idx", *[r6(c).alias(c) for c in ("segment", "velocity", "angle", "score")], "is_low")


_UP = tuple(f"(-{c})" for c in _TR)
_HEAD = tuple(f"({n} - {m})" for n, m in zip(_xy("NOSE"), _mid("LEFT_EAR", "RIGHT_EAR"), strict=True))


@_query(f"""WITH {_PO} SELECT trial_id, frame_idx, round(CASE WHEN {_HEAD[0]} * {_UP[1]} - {_HEAD[1]} * {_UP[0]} >= 0 THEN 1 ELSE -1 END * {_between(_HEAD, _UP)}, 6) + 0 AS head_angle,
    {", ".join(f"round({_between(_sub(f'{s}_ELBOW', f'{s}_SHOULDER'), _TR)}, 6) + 0 AS shoulder_flex_{s[0]}, round(180 - {_between(_sub(f'{s}_SHOULDER', f'{s}_ELBOW'), _sub(f'{s}_WRIST', f'{s}_ELBOW'))}, 6) + 0 AS elbow_flex_{s[0]}" for s in ("LEFT", "RIGHT"))},
    round(CASE WHEN {_UP[0]} >= 0 THEN 1 ELSE -1 END * {_between(_UP, ("0.0", "-1.0"))}, 6) + 0 AS pelvis_sagittal_tilt FROM po""")
def extended_angles(spark: SparkSession, d: str) -> DataFrame:
    """Head, shoulders, elbows and sagittal pelvis."""
    out = pose.extended_angles(vector_pose(spark, d))
    return out.select("trial_id", "frame_idx", *[r6(c).alias(c) for c in out.columns if c not in ("trial_id", "frame_idx", "pos")])


_TRUNK = ["NOSE", "LEFT_SHOULDER", "RIGHT_SHOULDER", "LEFT_HIP", "RIGHT_HIP"]
_LEAPS = ", ".join(_far(_xy(n), tuple(f"lag({c}) OVER w" for c in _xy(n))) for n in _TRUNK)


@_query(f"""WITH {_PO}, j AS (SELECT trial_id, frame_idx, [{_LEAPS}] AS far, least(1, abs(e[64]) * 5) AS c, lag(least(1, abs(e[64]) * 5)) OVER w AS before, lead(least(1, abs(e[64]) * 5)) OVER w AS after FROM po WINDOW w AS (PARTITION BY trial_id ORDER BY pos)),
    r AS (SELECT trial_id, frame_idx, CASE WHEN list_max(far) > 0.3 OR list_avg(far) > 0.15 THEN 'jump' WHEN c < 0.3 AND before > 0.7 AND after > 0.7 THEN 'dip' END AS reason FROM j) SELECT * FROM r WHERE reason IS NOT NULL""")
def person_changes(spark: SparkSession, d: str) -> DataFrame:
    """Frames at which the tracker may have changed person."""
    return quality.other_people(vector_pose(spark, d))


@_query(f"""WITH {_CY}, hv AS (SELECT trial_id, count(*) FILTER (kind = 'hs' AND side = 'left') AS hl, count(*) FILTER (kind = 'to' AND side = 'left') AS tl, count(*) FILTER (kind = 'hs' AND side = 'right') AS hr, count(*) FILTER (kind = 'to' AND side = 'right') AS tr FROM ev GROUP BY trial_id),
    j AS (SELECT trial_id, side, duration < 0.4 OR duration > 2.5 OR coalesce((toe_off_frame - start_frame)::DOUBLE / (end_frame - start_frame) NOT BETWEEN 0.3 AND 0.8, false) AS bad FROM c0),
    n AS (SELECT trial_id, count(*) FILTER (side = 'left' AND bad) AS bl, count(*) FILTER (side = 'left' AND NOT bad) AS gl, count(*) FILTER (side = 'right' AND bad) AS br, count(*) FILTER (side = 'right' AND NOT bad) AS gr FROM j GROUP BY trial_id),
    sm AS (SELECT trial_id, count(*) FILTER (side = before) AS same FROM (SELECT trial_id, side, lag(side) OVER (PARTITION BY trial_id ORDER BY frame, side) AS before FROM ev WHERE kind = 'hs') GROUP BY trial_id),
    i AS (SELECT hv.trial_id, CASE WHEN hl = 0 OR tl = 0 THEN 1 ELSE coalesce(bl, 0) END + CASE WHEN hr = 0 OR tr = 0 THEN 1 ELSE coalesce(br, 0) END + CASE WHEN hl > 0 AND hr > 0 AND same > 0.5 * (hl + hr) THEN 1 ELSE 0 END AS n_issues, CASE WHEN hl > 0 AND tl > 0 THEN coalesce(gl, 0) ELSE 0 END AS n_valid_left, CASE WHEN hr > 0 AND tr > 0 THEN coalesce(gr, 0) ELSE 0 END AS n_valid_right FROM hv LEFT JOIN n USING (trial_id) LEFT JOIN sm USING (trial_id))
    SELECT trial_id, n_issues = 0 AS valid, n_issues::BIGINT AS n_issues, n_valid_left, n_valid_right FROM i""")
def event_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is implausible of contacts and lift-offs."""
    out = events.validate_events(gait_events(spark, d), RATE)
    return out.select("trial_id", "valid", F.size("issues").cast("long").alias("n_issues"), "n_valid_left", "n_valid_right")


_ROMS = [(j, s) for s in ("left", "right") for j in ("hip", "knee", "ankle")]
_LA, _RA = _xy("LEFT_ANKLE")[0], _xy("RIGHT_ANKLE")[0]


@_query(f"""WITH {_CY}, {_PO}, {_VC}, hh AS (SELECT *, lead(frame) OVER x AS nf, lead(side) OVER x AS ns FROM ev WHERE kind = 'hs' WINDOW x AS (PARTITION BY trial_id ORDER BY frame, side)), sp AS (SELECT * FROM hh WHERE side <> ns),
    a AS (SELECT trial_id, {_cv("duration")} AS stride_time_cv FROM cy GROUP BY trial_id), b AS (SELECT trial_id, {_cv("((nf - frame) / 4.0)")} AS step_time_cv FROM sp GROUP BY trial_id),
    f AS (SELECT sp.trial_id, ns, p.frame_idx, abs(CASE WHEN ns = 'left' THEN {_LA.replace("e[", "q.e[")} - {_LA.replace("e[", "p.e[")} ELSE {_RA.replace("e[", "q.e[")} - {_RA.replace("e[", "p.e[")} END) AS v FROM sp JOIN po p ON p.trial_id = sp.trial_id AND p.frame_idx = sp.frame JOIN po q ON q.trial_id = sp.trial_id AND q.frame_idx = sp.nf),
    c AS (SELECT trial_id, {_cv("CASE WHEN ns = 'left' THEN v END")} AS step_length_cv_left, {_cv("CASE WHEN ns = 'right' THEN v END")} AS step_length_cv_right FROM f GROUP BY trial_id),
    g AS (SELECT trial_id, {", ".join(f'''{_cv(f"CASE WHEN joint = '{j}' AND side = '{s}' THEN list_max(curve) - list_min(curve) END")} AS rom_cv_{j}_{s}''' for j, s in _ROMS)} FROM vc GROUP BY trial_id)
    SELECT a.trial_id, {", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in ["stride_time_cv", "step_time_cv", "step_length_cv_left", "step_length_cv_right", *[f"rom_cv_{j}_{s}" for j, s in _ROMS]])} FROM a LEFT JOIN b USING (trial_id) LEFT JOIN c USING (trial_id) LEFT JOIN g USING (trial_id)""")
def stride_variability(spark: SparkSession, d: str) -> DataFrame:
    """Variation of strides, steps and excursions."""
    e = gait_events(spark, d)
    out = analysis.stride_variability(cycles.segment(e, RATE), e, RATE, vector_pose(spark, d), vector_curves(spark, d))
    return out.select("trial_id", *[r6(c).alias(c) for c in out.columns if c != "trial_id"])


@_query(f"""WITH {_CY}, a AS (SELECT trial_id, 120 / avg(duration) AS cad, avg(CASE WHEN side = 'left' AND stance_pct BETWEEN 35 AND 80 THEN stance_pct END) AS sl, avg(CASE WHEN side = 'right' AND stance_pct BETWEEN 35 AND 80 THEN stance_pct END) AS sr, {_cv("duration")} AS cv FROM cy GROUP BY trial_id)
    SELECT trial_id, concat_ws(',', CASE WHEN cad > 0 AND cad < 80 THEN 'Low cadence' END, CASE WHEN cad > 140 THEN 'High cadence' END, CASE WHEN sl > 70 THEN 'Prolonged stance left' END, CASE WHEN sr > 70 THEN 'Prolonged stance right' END, CASE WHEN cv > 20 THEN 'High cycle duration variability' END) AS flags FROM a""")
def gait_flags(spark: SparkSession, d: str) -> DataFrame:
    """Figures beyond usual limits, by name."""
    e = gait_events(spark, d)
    c = cycles.segment(e, RATE)
    figures = analysis.spatiotemporal(c, e, RATE).join(analysis.variability(c), "trial_id")
    return analysis.flags(figures).select("trial_id", F.array_join(F.transform("flags", lambda t: F.substring_index(t, ":", 1)), ",").alias("flags"))


@_query(f"""WITH {_CY}, a AS (SELECT trial_id, avg(duration) AS st, (1.5 + (trial_id % 50) / 100.0) * 0.53 AS leg, (trial_id % 7) * 0.3 AS speed FROM cy GROUP BY trial_id)
    SELECT trial_id, round(CASE WHEN speed > 0 THEN speed * speed / (9.81 * leg) END, 6) AS froude, round(CASE WHEN speed > 0 THEN speed / sqrt(9.81 * leg) END, 6) AS speed_n, round(1 / st * sqrt(leg / 9.81), 6) AS cadence_n, round(speed * st / leg, 6) AS stride_n FROM a""")
def speed_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Figures without dimension, of made-up heights and speeds."""
    own = cycles.segment(gait_events(spark, d), RATE).groupBy("trial_id").agg(F.avg("duration").alias("stride"))
    speed = (F.col("trial_id") % 7) * 0.3
    figures = own.select("trial_id", (1.5 + (F.col("trial_id") % 50) / 100.0).alias("height_m"), speed.alias("speed"), (120.0 / F.col("stride")).alias("cadence"), (speed * F.col("stride")).alias("stride_length"))
    out = analysis.speed_normalized(figures)
    return out.select("trial_id", *[r6(c).alias(c) for c in out.columns if c != "trial_id"])


_LEGS = [f"{s}_{n}" for s in ("LEFT", "RIGHT") for n in ("HIP", "KNEE", "ANKLE")]
_SEEN = " AND ".join(f"{c} BETWEEN 0.02 AND 0.98" for n in _LEGS for c in _xy(n)) + " AND " + " AND ".join(f"{_v(n)} >= 0.3" for n in _LEGS)


@_query(f"WITH {_PO}, b AS (SELECT trial_id, min(pos) AS a, max(pos) AS b FROM po WHERE {_SEEN} GROUP BY trial_id) SELECT po.trial_id, frame_idx FROM po JOIN b ON b.trial_id = po.trial_id AND pos BETWEEN a AND b")
def visible_span(spark: SparkSession, d: str) -> DataFrame:
    """Frames between the first and the last whole pair of legs."""
    return quality.visible_span(vector_pose(spark, d)).select("trial_id", "frame_idx")


_VIEW = ["NOSE", "LEFT_KNEE", "RIGHT_HEEL"]


def _keystone(name: str) -> str:
    a, b = _xy(name)
    return f"round((0.5 + ({a} - 0.5) / (1 + 0.2 * ({b} - 0.5))) * 960) / 960, round((0.5 + ({b} - 0.5) / (1 - 0.1 * ({a} - 0.5))) * 540) / 540"


@_query(f"WITH {_PO} SELECT trial_id, frame_idx, " + ", ".join(f'round({c}, 6) + 0 AS "{n}_{a}"' for n in _VIEW for a, c in zip("xy", _keystone(n).split(", "), strict=True)) + " FROM po WHERE frame_idx % 2 = 0")
def degraded_view(spark: SparkSession, d: str) -> DataFrame:
    """Half the frames and pixels, seen at an angle."""
    config = degradation.settings(target_fps=2.0, downscale=0.5, perspective_x=0.2, perspective_y=-0.1)
    out = degradation.degrade(vector_pose(spark, d), config, RATE)
    return out.select("trial_id", "frame_idx", *[r6(c).alias(f"{n}_{a}") for n in _VIEW for a, c in (("x", pose.x(n)), ("y", pose.y(n)))])


def _by_heel(s: str) -> str:
    return f"90 - {_between(_sub(f'{s}_KNEE', f'{s}_HEEL'), _sub(f'{s}_FOOT_INDEX', f'{s}_HEEL'))}"


@_query(f"WITH {_PO}, a AS (SELECT trial_id, frame_idx, {', '.join(f'{_ankle(s)} AS a{s[0]}, {_by_heel(s)} AS b{s[0]}' for s in ('LEFT', 'RIGHT'))} FROM po) SELECT trial_id, frame_idx, {', '.join(f'abs(a{s} - b{s}) > 8 AS swap_{s}, round(CASE WHEN abs(a{s} - b{s}) > 8 THEN b{s} ELSE a{s} END, 6) + 0 AS ankle_{s}' for s in 'LR')} FROM a")
def ankle_swaps(spark: SparkSession, d: str) -> DataFrame:
    """Ankle angles where the ankle's landmark can't be right."""
    p = vector_pose(spark, d)
    out = pose.correct_ankle_swaps(p, pose.compute_angles(p, factor=1.0, calibrate=False))
    return out.select("trial_id", "frame_idx", *[c for s in ("L", "R") for c in (F.col(f"swap_{s}"), r6(f"ankle_{s}").alias(f"ankle_{s}"))])


def _classic(s: str) -> str:
    up = tuple(f"({m} - {h})" for m, h in zip(_mid("LEFT_SHOULDER", "RIGHT_SHOULDER"), _xy(f"{s}_HIP"), strict=True))
    return f"(180 - {_between(up, _sub(f'{s}_KNEE', f'{s}_HIP'))})"


_AHEAD = f"(({_sub('LEFT_FOOT_INDEX', 'LEFT_HEEL')[0]} + {_sub('RIGHT_FOOT_INDEX', 'RIGHT_HEEL')[0]}) / 2)"


@_query(f"WITH {_PO} SELECT trial_id, frame_idx, {', '.join(f'round(CASE WHEN median({_AHEAD}) OVER t < 0 THEN -1 ELSE 1 END * {_classic(s)}, 6) + 0 AS hip_{s[0]}' for s in ('LEFT', 'RIGHT'))} FROM po WINDOW t AS (PARTITION BY trial_id)")
def classic_hips(spark: SparkSession, d: str) -> DataFrame:
    """Hips as the angle between trunk and thigh."""
    out = pose.compute_angles(vector_pose(spark, d), "sagittal_classic", factor=1.0, calibrate=False)
    return out.select("trial_id", "frame_idx", r6("hip_L").alias("hip_L"), r6("hip_R").alias("hip_R"))


_CORNERS = ["LEFT_SHOULDER", "RIGHT_SHOULDER", "LEFT_HIP", "RIGHT_HIP"]
_MEAN = tuple(f"(({' + '.join(_xy(n)[k] for n in _CORNERS)}) / 4)" for k in (0, 1))


@_query(f"WITH {_PO}, a AS (SELECT *, median({_far(_xy('LEFT_SHOULDER'), _xy('LEFT_ANKLE'))}) OVER (PARTITION BY trial_id) AS tall FROM po) SELECT trial_id, frame_idx, " + ", ".join(f'round(({_xy(n)[k]} - {_MEAN[k]}) / tall * 100, 6) + 0 AS "{n}_{a}"' for n in _VIEW for k, a in enumerate("xy")) + " FROM a")
def aligned_skeleton(spark: SparkSession, d: str) -> DataFrame:
    """Landmarks about the trunk, in hundredths of the body."""
    return _viewed(pose.align_skeleton(vector_pose(spark, d)), _VIEW)


def _viewed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("trial_id", "frame_idx", *[r6(c).alias(f"{n}_{a}") for n in names for a, c in (("x", pose.x(n)), ("y", pose.y(n)))])


_FEET = ["LEFT_HEEL", "LEFT_FOOT_INDEX", "RIGHT_HEEL", "RIGHT_FOOT_INDEX"]


def _made_foot(name: str) -> tuple[str, str]:
    """The place of a heel or toe that is made from the shank, where the frame's number is even."""
    s = name.split("_")[0]
    (dx, dy), (ax, ay) = _sub(f"{s}_ANKLE", f"{s}_KNEE"), _xy(f"{s}_ANKLE")
    shank = _far(_xy(f"{s}_ANKLE"), _xy(f"{s}_KNEE"))
    foot = f"({shank} * 0.25)"
    made = (f"{ax} + {dx} / {shank} * {foot} * 0.3", f"{ay} + {dy} / {shank} * {foot} * 0.3 + {foot} * 0.1") if name.endswith("HEEL") else (f"{ax} - {dx} / {shank} * {foot} * 0.5", f"{ay} + {foot} * 0.15")
    return tuple(f"CASE WHEN frame_idx % 2 = 0 THEN greatest(0, least(1, {m})) ELSE {c} END" for m, c in zip(made, _xy(name), strict=True))


@_query(f"WITH {_PO} SELECT trial_id, frame_idx, " + ", ".join(f'round({c}, 6) + 0 AS "{n}_{a}"' for n in _FEET for a, c in zip("xy", _made_foot(n), strict=True)) + " FROM po")
def estimated_feet(spark: SparkSession, d: str) -> DataFrame:
    """Heels and toes made for every other frame, which has none."""
    p = vector_pose(spark, d)
    bare = F.map_filter("landmarks", lambda k, v: ~k.isin(_FEET))
    return _viewed(pose.estimate_feet(p.withColumn("landmarks", F.when(F.col("frame_idx") % 2 == 0, bare).otherwise(F.col("landmarks")))), _FEET)


@_query(f"WITH {_PO} SELECT trial_id, CASE WHEN median({_HEAD[0]}) < 0 THEN 'left' ELSE 'right' END AS direction FROM po GROUP BY trial_id")
def facing(spark: SparkSession, d: str) -> DataFrame:
    """Which way faces look."""
    return pose.facing(vector_pose(spark, d))


_INSIDE = ", ".join(f"CASE WHEN {_xy(n)[0]} BETWEEN 0.4 AND 0.9 AND {_xy(n)[1]} BETWEEN 0.45 AND 0.8 THEN {{'x': {_xy(n)[0]}, 'y': {_xy(n)[1]}}} END" for n in VECTOR_LANDMARKS)


@_query(f"""WITH {_PO}, l AS (SELECT trial_id, frame_idx, unnest([{_INSIDE}]) AS p FROM po)
    SELECT trial_id, count(p) > 0 AS selected, count(DISTINCT CASE WHEN p IS NOT NULL THEN frame_idx END) AS n_frames, round(min(p.x), 6) AS x0, round(min(p.y), 6) AS y0, round(max(p.x), 6) AS x1, round(max(p.y), 6) AS y1 FROM l GROUP BY trial_id""")
def person_extent(spark: SparkSession, d: str) -> DataFrame:
    """The person within a part of the picture."""
    out = quality.person_extent(vector_pose(spark, d), (0.4, 0.45, 0.9, 0.8))
    return out.select("trial_id", "selected", "n_frames", *[r6(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


@_query(f"""WITH {_PO}, a AS (SELECT trial_id, frame_idx, pos, {', '.join(f'{_knee(s)} AS k{s[0]}, {_classic(s)} AS h{s[0]}' for s in ('LEFT', 'RIGHT'))}, count(*) OVER (PARTITION BY trial_id) AS n FROM po),
    b AS (SELECT trial_id, frame_idx, pos, n, {', '.join(f'CASE WHEN avg(k{s}) OVER t < 0 THEN -k{s} ELSE k{s} END AS k{s}, CASE WHEN avg(k{s}) OVER t < 0 THEN -h{s} ELSE h{s} END AS h{s}' for s in 'LR')} FROM a WINDOW t AS (PARTITION BY trial_id)),
    c AS (SELECT *, {', '.join(f'row_number() OVER (PARTITION BY trial_id ORDER BY k{s} DESC, pos) AS r{s}' for s in 'LR')} FROM b),
    m AS (SELECT trial_id, {', '.join(f'avg(h{s}) FILTER (r{s} <= greatest(5, n // 10)) AS m{s}' for s in 'LR')} FROM c GROUP BY trial_id)
    SELECT trial_id, frame_idx, {', '.join(f'round(k{s}, 6) + 0 AS knee_{s}, round(CASE WHEN m{s} < 0 THEN -h{s} ELSE h{s} END, 6) + 0 AS hip_{s}' for s in 'LR')} FROM c JOIN m USING (trial_id)""")
def canonical_signs(spark: SparkSession, d: str) -> DataFrame:
    """Knees that flex upward, and hips with them."""
    own = vector_pose(spark, d).select("trial_id", "frame_idx", "pos", *[f(side).alias(f"{n}_{side[0]}") for side in ("LEFT", "RIGHT") for n, f in (("knee", pose.knee), ("hip", pose.hip_interior))])
    out = pose.canonicalize_signs(own)
    return out.select("trial_id", "frame_idx", *[r6(c).alias(c) for c in ("knee_L", "hip_L", "knee_R", "hip_R")])
