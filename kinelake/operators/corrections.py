"""Corrections of angles: perspective, drift, and mean biases over the cycle; and of landmarks: their bias by phase."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions import columns as C
from kinelake.functions import series
from kinelake.operators import pose as P

# Weights of sin 2pi, cos 2pi, sin 4pi and cos 4pi of the phase, each divided by 0.707106781.
BIAS = {
    "ankle": (-1.398, 0.0, 2.508, -0.056),
    "hip": (0.208, 3.338, 0.0, -1.468),
    "knee": (3.251, 1.207, -2.989, 4.170),
}


def bias(phase: Column, joint: str) -> Column:
    """The mean error of a joint's angle at a phase of the cycle."""
    a, b, c, d = BIAS[joint]
    turn = 2 * math.pi * phase
    return (a * F.sin(turn) + b * F.cos(turn) + c * F.sin(2 * turn) + d * F.cos(2 * turn)) / 0.707106781


def correct_bias(angles_long: DataFrame, phases: DataFrame, joints: tuple[str, ...] = ("hip", "knee", "ankle")) -> DataFrame:
    """Angles less the mean bias at their frame's phase; frames outside cycles stay."""
    joined = angles_long.join(phases, ["trial_id", "side", "frame_idx"], "left")
    out = F.col("value")
    for j in joints:
        out = F.when((F.col("joint") == j) & F.col("phase").isNotNull(), F.col("value") - bias(F.col("phase"), j)).otherwise(out)
    return joined.withColumn("value", out).select(angles_long.columns)


def foreshortening(length: Column, floor: float = 0.3) -> Column:
    """A segment's length over its trial's 95th percentile, within floor and 1; 1 where fewer than five are known."""
    w = P.trial()
    full = F.percentile(length, F.lit(0.95)).over(w)
    return F.when(F.count(length).over(w) < 5, 1.0).otherwise(F.coalesce(C.clip(C.safe_divide(length, full), floor, 1.0), F.lit(1.0)))


def unprojected(degrees: Column, ratio: Column, limit: float = 80.0) -> Column:
    """An angle seen obliquely, brought back into its plane."""
    a = F.radians(C.clip(degrees, -limit, limit))
    return F.degrees(F.atan2(F.sin(a), F.cos(a) * ratio))


def correct_perspective(angles: DataFrame, pose: DataFrame) -> DataFrame:
    """Hips by the thigh's foreshortening, knees by the smaller of thigh's and shank's."""
    parts = {}
    for s, p in (("L", "LEFT"), ("R", "RIGHT")):
        parts[f"__t{s}"] = C.distance(P.x(f"{p}_HIP"), P.y(f"{p}_HIP"), P.x(f"{p}_KNEE"), P.y(f"{p}_KNEE"))
        parts[f"__s{s}"] = C.distance(P.x(f"{p}_KNEE"), P.y(f"{p}_KNEE"), P.x(f"{p}_ANKLE"), P.y(f"{p}_ANKLE"))
    lengths = pose.select("trial_id", "frame_idx", *[c.alias(n) for n, c in parts.items()])
    ratios = lengths.select("trial_id", "frame_idx", *[foreshortening(F.col(n)).alias(n) for n in parts])
    out = angles.join(ratios, ["trial_id", "frame_idx"], "left")
    for s in ("L", "R"):
        out = out.withColumns({f"hip_{s}": unprojected(F.col(f"hip_{s}"), F.coalesce(F.col(f"__t{s}"), F.lit(1.0))), f"knee_{s}": unprojected(F.col(f"knee_{s}"), F.coalesce(F.least(f"__t{s}", f"__s{s}"), F.lit(1.0)))})
    return out.select(angles.columns)


def detrend_angles(angles: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Straight drift over the trial taken out of angle columns, their means kept."""
    out = angles
    for c in columns or P.LEG:
        out = series.detrend(out, ["trial_id"], c, c)
    return out.select(angles.columns)


def landmark_bias(pairs: DataFrame, bins: int = 20) -> DataFrame:
    """name, bin, dx, dy, n: mean error of landmarks against a reference by phase bin.

    pairs: name, phase (0 to 1), dx, dy, already in segment lengths and walking direction.
    """
    at = F.least(F.floor(F.col("phase") * bins), F.lit(bins - 1)).cast("int")
    return pairs.groupBy("name", at.alias("bin")).agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"), F.count("*").alias("n"))


def merge_landmark_bias(models: DataFrame) -> DataFrame:
    """Several models (model, name, bin, dx, dy, n) as one, weighted by their counts."""
    w = F.sum("n")
    return models.groupBy("name", "bin").agg((F.sum(F.col("dx") * F.col("n")) / w).alias("dx"), (F.sum(F.col("dy") * F.col("n")) / w).alias("dy"), w.alias("n"))


def smooth_landmark_bias(model: DataFrame, bins: int = 20, half: int = 1) -> DataFrame:
    """Each bin the median of its neighbours', around the cycle."""
    near = model.select("name", F.explode(F.array(*[F.struct(F.pmod(F.col("bin") + k, F.lit(bins)).alias("bin")) for k in range(-half, half + 1)])).alias("b"), "dx", "dy", "n")
    out = near.groupBy("name", F.col("b.bin").alias("bin")).agg(F.median("dx").alias("dx"), F.median("dy").alias("dy"))
    return out.join(model.select("name", "bin", "n"), ["name", "bin"])


def apply_landmark_bias(tracks: DataFrame, phases: DataFrame, model: DataFrame, bins: int = 20) -> DataFrame:
    """Tracks less the model's error at each frame's phase; frames or landmarks without one stay.

    phases: trial_id, frame_idx, phase. The model has a row per landmark and bin, a fixed small table.
    """
    at = F.least(F.floor(F.col("phase") * bins), F.lit(bins - 1)).cast("int")
    joined = tracks.join(phases, ["trial_id", "frame_idx"], "left").withColumn("bin", at).join(model.drop("n"), ["name", "bin"], "left")
    return joined.withColumns({"x": F.col("x") - F.coalesce("dx", F.lit(0.0)), "y": F.col("y") - F.coalesce("dy", F.lit(0.0))}).select(tracks.columns)


# Landmarks whose bias is learnt if none are named.
CORRECTABLE = ("LEFT_KNEE", "RIGHT_KNEE", "LEFT_ANKLE", "RIGHT_ANKLE", "LEFT_HEEL", "RIGHT_HEEL", "LEFT_FOOT_INDEX", "RIGHT_FOOT_INDEX")


def anchored(pose: DataFrame, trials: DataFrame) -> DataFrame:
    """trial_id, frame_idx, pos, mx, my, thigh, direction: the hips' middle, the length from there to the knees' middle, and the way of walking.

    The direction is the sign of the hips' way from a quarter of a second before to one after, within the recording;
    null where it is under 1e-5 or unknown. All are null without hips and knees, or where the thigh has no length.
    """
    mx, my = (P.middle(f("LEFT_HIP"), f("RIGHT_HIP")) for f in (P.x, P.y))
    kx, ky = (P.middle(f("LEFT_KNEE"), f("RIGHT_KNEE")) for f in (P.x, P.y))
    thigh = C.distance(mx, my, kx, ky)
    half = F.greatest(F.lit(1), F.floor(0.25 * F.coalesce("meta.fps", F.lit(30.0)))).cast("int")
    own = pose.select("trial_id", "frame_idx", "pos", *[F.when(thigh >= 1e-6, c).alias(n) for n, c in (("mx", mx), ("my", my), ("thigh", thigh))])
    own = own.join(trials.select("trial_id", half.alias("half")), "trial_id").withColumn("last", F.max("pos").over(P.trial()))
    own = own.withColumns({"before": F.greatest(F.lit(0), F.col("pos") - F.col("half")), "after": F.least(F.col("last"), F.col("pos") + F.col("half"))})
    at = lambda name, out: own.select("trial_id", F.col("pos").alias(name), F.col("mx").alias(out))
    both = own.join(at("before", "x0"), ["trial_id", "before"], "left").join(at("after", "x1"), ["trial_id", "after"], "left")
    way = F.col("x1") - F.col("x0")
    return both.select("trial_id", "frame_idx", "pos", "mx", "my", "thigh", F.when(F.abs(way) >= 1e-5, F.signum(way)).alias("direction"))


def anchored_landmarks(pose: DataFrame, trials: DataFrame, names: tuple[str, ...] = CORRECTABLE) -> DataFrame:
    """trial_id, frame_idx, pos, name, fx, fy: landmarks from the hips' middle, in thighs and with x forward; no row where either is unknown."""
    long = P.to_long(pose).filter(F.col("name").isin(*names)).select("trial_id", "frame_idx", "name", "x", "y")
    joined = long.join(anchored(pose, trials), ["trial_id", "frame_idx"])
    out = joined.select("trial_id", "frame_idx", "pos", "name", ((F.col("x") - F.col("mx")) / F.col("thigh") * F.col("direction")).alias("fx"), ((F.col("y") - F.col("my")) / F.col("thigh")).alias("fy"))
    return out.filter(F.col("fx").isNotNull() & F.col("fy").isNotNull())


def fit_landmark_bias(video: DataFrame, video_trials: DataFrame, optical: DataFrame, optical_trials: DataFrame, phases: DataFrame, offsets: DataFrame, bins: int = 10, names: tuple[str, ...] = CORRECTABLE) -> DataFrame:
    """name, bin, dx, dy, n: a landmark's mean distance from an optical recording's, by phase of its side's cycle.

    Both recordings are poses of the same trial_id; phases has trial_id, side, frame_idx and phase, offsets trial_id and
    offset (seconds that the optical recording's clock is ahead). A video frame meets the optical sample nearest in time.
    """
    rate = lambda t, name, usual: t.select("trial_id", F.coalesce("meta.fps", F.lit(usual)).alias(name))
    side = F.when(F.col("name").startswith("LEFT"), "left").otherwise("right")
    mine = anchored_landmarks(video, video_trials, names).join(rate(video_trials, "fps", 30.0), "trial_id").join(offsets, "trial_id").join(rate(optical_trials, "ofps", 200.0), "trial_id")
    mine = mine.withColumns({"at": F.rint((F.col("frame_idx") / F.col("fps") + F.col("offset")) * F.col("ofps")).cast("int"), "side": side}).join(phases, ["trial_id", "side", "frame_idx"])
    theirs = anchored_landmarks(optical, optical_trials, names).select("trial_id", F.col("pos").alias("at"), "name", F.col("fx").alias("ox"), F.col("fy").alias("oy"))
    pairs = mine.join(theirs, ["trial_id", "at", "name"]).select("name", "phase", (F.col("fx") - F.col("ox")).alias("dx"), (F.col("fy") - F.col("oy")).alias("dy"))
    return landmark_bias(pairs, bins)


def filled_bias(model: DataFrame, bins: int) -> DataFrame:
    """name, bin, dx, dy for all bins: missing ones interpolated around the cycle. The model is a small table, a row per landmark and bin."""
    every = model.select("name").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    whole = every.join(model.select("name", "bin", "dx", "dy"), ["name", "bin"], "left")
    thrice = whole.withColumn("turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("pos", F.col("bin") + F.col("turn") * bins)
    for c in ("dx", "dy"):
        thrice = series.interpolate(thrice, ["name"], c, c)
    return thrice.filter("turn = 0").select("name", "bin", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dx", "dy")])


def remove_landmark_bias(pose: DataFrame, trials: DataFrame, phases: DataFrame, model: DataFrame, bins: int = 10) -> DataFrame:
    """Landmarks less the model's bias at their side's phase, brought back to the picture by the thigh and the way of walking.

    The bias is interpolated between bins around the cycle; the thigh is a median over half a second. Frames outside
    cycles, without hips and knees, or where the way is unknown stay, and so do landmarks that the model lacks.
    """
    whole = filled_bias(model, bins)
    after = whole.select("name", F.pmod(F.col("bin") - 1, F.lit(bins)).alias("bin"), F.col("dx").alias("dx1"), F.col("dy").alias("dy1"))
    curve = whole.join(after, ["name", "bin"])
    fps = trials.select("trial_id", F.greatest(F.lit(1), F.floor(0.25 * F.coalesce("meta.fps", F.lit(30.0)))).cast("int").alias("half"))
    at = anchored(pose, trials).join(fps, "trial_id")
    near = at.select("trial_id", "thigh", F.explode(F.sequence(F.col("pos") - F.col("half"), F.col("pos") + F.col("half"))).alias("pos")).groupBy("trial_id", "pos").agg(F.median("thigh").alias("scale"))
    at = at.join(near, ["trial_id", "pos"]).filter(F.col("direction").isNotNull() & F.col("scale").isNotNull()).select("trial_id", "frame_idx", "scale", "direction")
    where = F.col("phase") * bins
    shift = phases.join(at, ["trial_id", "frame_idx"]).withColumns({"bin": F.pmod(F.floor(where), F.lit(bins)).cast("int"), "w": where - F.floor(where)}).join(curve, "bin")
    shift = shift.filter(F.col("name").startswith("LEFT_") == (F.col("side") == "left"))
    bent = lambda c: (1 - F.col("w")) * F.col(c) + F.col("w") * F.col(f"{c}1")
    entry = F.struct("name", F.struct((bent("dx") * F.col("direction") * F.col("scale")).alias("x"), (bent("dy") * F.col("scale")).alias("y")).alias("p"))
    moves = shift.groupBy("trial_id", "frame_idx").agg(F.map_from_entries(F.collect_list(entry)).alias("__by"))  # a few landmarks a frame
    own = pose.join(moves, ["trial_id", "frame_idx"], "left")
    moved = F.transform_values("landmarks", lambda k, p: F.struct((p["x"] - F.coalesce(F.col("__by")[k]["x"], F.lit(0.0))).alias("x"), (p["y"] - F.coalesce(F.col("__by")[k]["y"], F.lit(0.0))).alias("y"), p["visibility"].alias("visibility")))
    return own.withColumn("landmarks", F.when(F.col("__by").isNull(), F.col("landmarks")).otherwise(moved)).select(pose.columns)
