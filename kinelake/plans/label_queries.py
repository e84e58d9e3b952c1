"""Queries on labels, coordinates and patterns, with SQL written from their definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.columns import r6, resample
from kinelake.operators import analysis, cycles, pose, validation
from kinelake.plans.series_queries import _R101
from kinelake.plans.walk_queries import _PO, _ankle, _v, _xy
from kinelake.sources.driver_tables import VECTOR_LANDMARKS, vector_curves, vector_pose

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _points(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("trial_id", "frame_idx", *[r6(c).alias(f"{n}_{a}") for n in names for a, c in (("x", pose.x(n)), ("y", pose.y(n)))])


def _shown(columns: dict[str, tuple[str, str]]) -> str:
    return ", ".join(f'round({c}, 6) + 0 AS "{n}_{a}"' for n, xy in columns.items() for a, c in zip("xy", xy, strict=True))


_SOME = ["NOSE", "LEFT_HIP", "RIGHT_KNEE", "LEFT_FOOT_INDEX"]


@_query(f"WITH {_PO} SELECT trial_id, frame_idx, " + _shown({n: (f"1 - {_xy(m)[0]}", _xy(m)[1]) for n, m in (("NOSE", "NOSE"), ("LEFT_HIP", "RIGHT_HIP"), ("RIGHT_KNEE", "LEFT_KNEE"), ("LEFT_FOOT_INDEX", "RIGHT_FOOT_INDEX"))}) + " FROM po")
def mirrored_landmarks(spark: SparkSession, d: str) -> DataFrame:
    """The picture flipped, and sides renamed."""
    return _points(pose.mirror(vector_pose(spark, d)), _SOME)


@_query(f"WITH {_PO} SELECT trial_id, frame_idx, " + _shown({n: (f"greatest(0, least(1, {_xy(n)[0]}))", f"greatest(0, least(1, {_xy(n)[1]} * 0.75))") for n in _SOME}) + " FROM po")
def pixel_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A picture of 16 by 9 that was looked at as 4 by 3."""
    return _points(pose.pixel_ratio(vector_pose(spark, d), (1920, 1080), (640, 480)), _SOME)


_FOUR = ["LEFT_SHOULDER", "RIGHT_SHOULDER", "LEFT_HIP", "RIGHT_HIP"]
_C = tuple(f"(({' + '.join(_xy(n)[k] for n in _FOUR)}) / 4)" for k in (0, 1))
_ALL = ", ".join(f"abs({_xy(n)[k]} - {_C[k]})" for n in VECTOR_LANDMARKS for k in (0, 1))


@_query(f"WITH {_PO}, c AS (SELECT *, max(greatest({_ALL})) OVER (PARTITION BY trial_id) AS m FROM po) SELECT trial_id, frame_idx, " + _shown({n: tuple(f"({_xy(n)[k]} - {_C[k]}) / m * 100" for k in (0, 1)) for n in _SOME}) + " FROM c")
def torso_centred(spark: SparkSession, d: str) -> DataFrame:
    """Landmarks about the trunk's middle, the trial's greatest coordinate at 100."""
    return _points(pose.center_on_torso(vector_pose(spark, d)), _SOME)


@_query(f"WITH {_PO} SELECT trial_id, frame_idx, " + _shown({n: tuple(f"CASE WHEN {_v(n)} >= 0.3 THEN {_xy(n)[k]} END" for k in (0, 1)) for n in _SOME}) + " FROM po")
def confident_landmarks(spark: SparkSession, d: str) -> DataFrame:
    """Landmarks that are seen well enough."""
    return _points(pose.confidence_filter(vector_pose(spark, d), 0.3), _SOME)


@_query(f"""WITH {_PO}, o AS (SELECT *, sign({_xy('LEFT_HIP')[0]} - {_xy('RIGHT_HIP')[0]}) AS h, sign({_xy('LEFT_KNEE')[0]} - {_xy('RIGHT_KNEE')[0]}) AS k FROM po),
    f AS (SELECT *, CASE WHEN lag(h) OVER x * h < 0 AND lag(k) OVER x * k < 0 THEN 1 ELSE 0 END AS flip FROM o WINDOW x AS (PARTITION BY trial_id ORDER BY pos)),
    t AS (SELECT *, sum(flip) OVER (PARTITION BY trial_id ORDER BY pos) % 2 AS odd FROM f), s AS (SELECT *, (odd = 1) <> (avg(odd) OVER (PARTITION BY trial_id) > 0.5) AS swap FROM t)
    SELECT trial_id, frame_idx, """ + ", ".join(f'round(CASE WHEN swap THEN {_xy(m)[k]} ELSE {_xy(n)[k]} END, 6) + 0 AS "{n}_{"xy"[k]}"' for n, m in (("NOSE", "NOSE"), ("LEFT_HIP", "RIGHT_HIP"), ("RIGHT_KNEE", "LEFT_KNEE"), ("LEFT_FOOT_INDEX", "RIGHT_FOOT_INDEX")) for k in (0, 1)) + " FROM s")
def side_labels(spark: SparkSession, d: str) -> DataFrame:
    """Sides exchanged in frames after an odd number of flips."""
    return _points(pose.correct_side_labels(vector_pose(spark, d)), _SOME)


def _gap(a: tuple[str, str], b: tuple[str, str]) -> str:
    return f"sqrt(power({b[0]} - {a[0]}, 2) + power({b[1]} - {a[1]}, 2))"


def _outwards() -> str:
    """The legs' segments, one CTE each: the end's new place from the last one's."""
    steps, last, source = [], _xy("RIGHT_HIP"), "po"
    for k, (a, b) in enumerate((("HIP", "KNEE"), ("KNEE", "ANKLE"), ("ANKLE", "HEEL"))):
        end = _xy(f"RIGHT_{b}")
        steps.append(f"m{k} AS (SELECT *, median({_gap(_xy(f'LEFT_{a}'), _xy(f'LEFT_{b}'))}) OVER (PARTITION BY trial_id) / median({_gap(last, end)}) OVER (PARTITION BY trial_id) AS s{k} FROM {source})")
        steps.append(f"n{k} AS (SELECT *, {last[0]} + ({end[0]} - {last[0]}) * s{k} AS x{k}, {last[1]} + ({end[1]} - {last[1]}) * s{k} AS y{k} FROM m{k})")
        last, source = (f"x{k}", f"y{k}"), f"n{k}"
    return ", ".join(steps)


@_query(f"WITH {_PO}, {_outwards()} SELECT trial_id, frame_idx, " + _shown({"RIGHT_KNEE": ("x0", "y0"), "RIGHT_ANKLE": ("x1", "y1"), "RIGHT_HEEL": ("x2", "y2"), "LEFT_KNEE": _xy("LEFT_KNEE")}) + " FROM n2")
def matched_sides(spark: SparkSession, d: str) -> DataFrame:
    """The right leg's segments at the left one's median lengths."""
    return _points(pose.match_sides(vector_pose(spark, d)), ["RIGHT_KNEE", "RIGHT_ANKLE", "RIGHT_HEEL", "LEFT_KNEE"])


def _slide(s: str) -> str:
    heel, toe, ankle = _xy(f"{s}_HEEL"), _xy(f"{s}_FOOT_INDEX"), _xy(f"{s}_ANKLE")
    f = tuple(f"({toe[k]} - {heel[k]})" for k in (0, 1))
    t = f"(({ankle[0]} - {heel[0]}) * {f[0]} + ({ankle[1]} - {heel[1]}) * {f[1]}) / ({f[0]} * {f[0]} + {f[1]} * {f[1]})"
    return f"a{s[0]} AS (SELECT trial_id, frame_idx, {_ankle(s)} AS a, abs({f[1]}) < 0.2 AS flat, {t} AS t FROM po), d{s[0]} AS (SELECT *, median(t) OVER x - t AS d FROM a{s[0]} WINDOW x AS (PARTITION BY trial_id)), k{s[0]} AS (SELECT trial_id, CASE WHEN count(*) FILTER (flat) >= 5 THEN regr_slope(a, d) FILTER (flat) END AS k FROM d{s[0]} GROUP BY trial_id)"


@_query(f"WITH {_PO}, {_slide('LEFT')}, {_slide('RIGHT')} SELECT l.trial_id, l.frame_idx, round(l.a - coalesce(p.k * l.d, 0), 4) + 0 AS ankle_L, round(r.a - coalesce(q.k * r.d, 0), 4) + 0 AS ankle_R FROM dL l JOIN kL p USING (trial_id) JOIN dR r USING (trial_id, frame_idx) JOIN kR q USING (trial_id)")
def ankle_projection(spark: SparkSession, d: str) -> DataFrame:
    """Ankle angles less what a landmark that slides along the foot adds."""
    p = vector_pose(spark, d)
    angles = p.select("trial_id", "frame_idx", pose.ankle("LEFT").alias("ankle_L"), pose.ankle("RIGHT").alias("ankle_R"))
    out = pose.correct_ankle_projection(p, angles, flat=0.2, least=5)
    return out.select("trial_id", "frame_idx", *[(F.round(c, 4) + 0.0).alias(c) for c in ("ankle_L", "ankle_R")])


def _whole(spark: SparkSession, d: str) -> DataFrame:
    return vector_curves(spark, d).withColumn("curve", resample("curve", 101))


_LISTS = _R101 + ", ls AS (SELECT trial_id, cycle_id, side, joint, list(value ORDER BY p) AS c FROM rs GROUP BY ALL), ms AS (SELECT trial_id, side, joint, list(mean ORDER BY p) AS c FROM sm GROUP BY ALL)"


@_query(f"""WITH {_LISTS} SELECT trial_id, side, round(avg(list_avg(c[1:5])) FILTER (joint = 'ankle'), 6) + 0 AS ankle_at_contact, round(avg(list_min(c[61:101])) FILTER (joint = 'ankle'), 6) + 0 AS ankle_swing_min,
    round(avg(list_max(c[61:101])) FILTER (joint = 'knee'), 6) + 0 AS knee_swing_max, round(avg(list_max(c)) FILTER (joint = 'hip'), 6) + 0 AS hip_max FROM ls GROUP BY trial_id, side""")
def clinical_markers(spark: SparkSession, d: str) -> DataFrame:
    """Ankles at contact and in swing, knees in swing, hips."""
    out = analysis.clinical_markers(_whole(spark, d))
    names = dict(zip([c for c in out.columns if c not in ("trial_id", "side")], ("ankle_at_contact", "ankle_swing_min", "knee_swing_max", "hip_max"), strict=True))
    return out.select("trial_id", "side", *[r6(c).alias(n) for c, n in names.items()])


@_query(f"""WITH {_LISTS}, w AS (SELECT trial_id, side, max(list_max(c[61:101])) FILTER (joint = 'knee') AS k, max(list_min(c)) FILTER (joint = 'knee') AS low, max(list_max(c[61:101])) FILTER (joint = 'hip') AS h, max(list_max(c) - list_min(c)) FILTER (joint = 'ankle') AS a FROM ms GROUP BY trial_id, side),
    r AS (SELECT trial_id, side, 'spastic' AS pattern, CASE WHEN k < 30 THEN 'moderate' ELSE 'mild' END AS severity, k AS value FROM w WHERE k < 40
          UNION ALL SELECT trial_id, side, 'steppage', CASE WHEN a < 10 THEN 'moderate' ELSE 'mild' END, a FROM w WHERE h > 45 AND a < 15
          UNION ALL SELECT trial_id, side, 'crouch', CASE WHEN low > 25 THEN 'severe' ELSE 'moderate' END, low FROM w WHERE low > 15)
    SELECT trial_id, side, pattern, severity, round(value, 1) + 0 AS value FROM r""")
def gait_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Spastic, steppage and crouch gait by rule, from mean curves."""
    return analysis.patterns(cycles.mean_curves(_whole(spark, d))).select("trial_id", "side", "pattern", "severity", (F.col("value") + 0.0).alias("value"))


_RANGES = "rg(joint, phase, lo, hi) AS (VALUES " + ", ".join(f"('{j}', '{p}', {float(lo)!r}, {float(hi)!r})" for j in ("hip", "knee", "ankle") for p, (lo, hi) in validation.ANGLE_RANGES[j].items() if p != "full") + ")"


@_query(f"""WITH {_LISTS}, {_RANGES}, s AS (SELECT *, 55 + cycle_id % 10 AS n FROM ls), h AS (SELECT trial_id, cycle_id, side, joint, phase, CASE WHEN phase = 'stance' THEN c[1:n] ELSE c[n + 1:101] END AS c FROM s, (VALUES ('stance'), ('swing')) t(phase))
    SELECT trial_id, cycle_id, side, joint, phase, round(list_min(c), 6) + 0 AS low, round(list_max(c), 6) + 0 AS high FROM h JOIN rg USING (joint, phase) WHERE list_min(c) < lo - 10 OR list_max(c) > hi + 10""")
def phase_checks(spark: SparkSession, d: str) -> DataFrame:
    """Curves that leave the ranges of stance or swing."""
    curves = _whole(spark, d)
    cut = curves.select("trial_id", "cycle_id", (F.lit(55.0) + F.col("cycle_id") % 10).alias("stance_pct"))
    out = validation.check_phases(curves, cut, validation.ranges(spark))
    return out.select("trial_id", "cycle_id", "side", "joint", "phase", r6("low").alias("low"), r6("high").alias("high"))


@_query(f"""WITH {_LISTS}, k AS (SELECT trial_id, side, avg(list_avg(c)) FILTER (joint = 'knee') AS knee, avg(list_avg(c[1:15]) - list_avg(c[41:60])) FILTER (joint = 'hip') AS hip FROM ls GROUP BY trial_id, side),
    g AS (SELECT *, CASE WHEN knee < 0 THEN -1 ELSE 1 END AS f FROM k)
    SELECT trial_id, cycle_id, joint, round(list_avg(c) * CASE WHEN joint = 'knee' THEN f WHEN joint = 'hip' THEN f * CASE WHEN f * hip < 0 THEN -1 ELSE 1 END ELSE 1 END, 6) + 0 AS mean FROM ls JOIN g USING (trial_id, side)""")
def flexion_positive(spark: SparkSession, d: str) -> DataFrame:
    """Means of curves whose knees and hips have been turned to flex upwards."""
    out = cycles.flexion_positive(_whole(spark, d))
    return out.select("trial_id", "cycle_id", "joint", r6(F.aggregate("curve", F.lit(0.0), lambda a, v: a + v) / F.size("curve")).alias("mean"))
