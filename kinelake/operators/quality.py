"""Quality of recordings: detection, gaps, jitter, coherence between frames, and what the camera saw."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import columns as C
from kinelake.operators import pose as P


def quality_score(pose: DataFrame, detected: float = 0.3) -> DataFrame:
    """trial_id, detection, confidence, gap, jitter, score (0 to 100): detection and confidence count for 0.3 each, gaps and jitter for 0.2."""
    w = Window.partitionBy("trial_id").orderBy("pos")
    hx, hy = P.middle(P.x("LEFT_HIP"), P.x("RIGHT_HIP")), P.middle(P.y("LEFT_HIP"), P.y("RIGHT_HIP"))
    own = pose.select("trial_id", "pos", "confidence", hx.alias("hx"), hy.alias("hy"))
    own = own.withColumn("step", F.hypot(F.col("hx") - F.lag("hx").over(w), F.col("hy") - F.lag("hy").over(w)))
    sums = own.groupBy("trial_id").agg(
        F.avg(F.when(F.coalesce("confidence", F.lit(0.0)) > detected, 1.0).otherwise(0.0)).alias("detection"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"),
        F.avg(F.when(F.col("hx").isNull() | F.col("hy").isNull(), 1.0).otherwise(0.0)).alias("gap"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("jitter"),
    )
    score = 100.0 * (0.3 * F.col("detection") + 0.3 * F.least(F.col("confidence"), F.lit(1.0)) + 0.2 * (1.0 - F.col("gap")) + 0.2 * F.greatest(F.lit(0.0), 1.0 - F.col("jitter") / 0.05))
    return sums.withColumn("score", score)


def penalty(z):
    """1 up to two deviations, falling to 0 at six."""
    return F.when(z > 2, C.clip(1.0 - (z - 2.0) / 4.0, 0.0, 1.0)).otherwise(1.0)


# Segments and landmarks whose changes between frames count.
STEADY_SEGMENTS = [
    ("LEFT_HIP", "LEFT_KNEE"), ("RIGHT_HIP", "RIGHT_KNEE"), ("LEFT_KNEE", "LEFT_ANKLE"), ("RIGHT_KNEE", "RIGHT_ANKLE"),
    ("LEFT_ANKLE", "LEFT_HEEL"), ("RIGHT_ANKLE", "RIGHT_HEEL"), ("LEFT_HIP", "RIGHT_HIP"),
]
STEADY_LANDMARKS = [
    "LEFT_HIP", "RIGHT_HIP", "LEFT_KNEE", "RIGHT_KNEE", "LEFT_ANKLE", "RIGHT_ANKLE", "LEFT_HEEL", "RIGHT_HEEL", "LEFT_FOOT_INDEX", "RIGHT_FOOT_INDEX",
]


def coherence(pose: DataFrame, angles: DataFrame | None = None, low: float = 0.5) -> DataFrame:
    """trial_id, frame_idx, segment, velocity, angle, score, is_low: how plausible each frame is after the one before.

    The score weighs changes of segment lengths 0.40 (of segments with a median of 0.05 at least), of the landmark that
    moves most 0.35 and of knee angles 0.25 (one mean and deviation for both knees), each by its worst z-score in the
    trial. Changes that a trial has two or fewer of are judged against none. The first frame is 1. Knees come from
    the landmarks, or from ``angles`` (knee_L, knee_R) where given.
    """
    w, every = Window.partitionBy("trial_id").orderBy("pos"), P.trial()
    knee = lambda s: C.interior_angle(P.x(f"{s}_HIP"), P.y(f"{s}_HIP"), P.x(f"{s}_KNEE"), P.y(f"{s}_KNEE"), P.x(f"{s}_ANKLE"), P.y(f"{s}_ANKLE"))
    lengths = {f"__s{k}": C.distance(P.x(a), P.y(a), P.x(b), P.y(b)) for k, (a, b) in enumerate(STEADY_SEGMENTS)}
    points = {f"__{a}{k}": c for k, n in enumerate(STEADY_LANDMARKS) for a, c in (("x", P.x(n)), ("y", P.y(n)))}
    knees = {} if angles is not None else {"knee_L": knee("LEFT"), "knee_R": knee("RIGHT")}
    own = pose.select("trial_id", "frame_idx", "pos", *[c.alias(n) for n, c in (lengths | points | knees).items()])
    if angles is not None:
        own = own.join(angles.select("trial_id", "frame_idx", "knee_L", "knee_R"), ["trial_id", "frame_idx"], "left")
    step = lambda c: F.col(c) - F.lag(c).over(w)
    change = {f"{c}d": F.when(F.median(c).over(every) >= 0.05, F.abs(step(c))) for c in lengths}
    moved = F.array_max(F.array(F.lit(0.0), *[F.hypot(step(f"__x{k}"), step(f"__y{k}")) for k in range(len(STEADY_LANDMARKS))]))
    own = own.withColumns(change | {"__v": F.when(F.lag("pos").over(w).isNotNull(), moved), "__l": F.abs(step("knee_L")), "__r": F.abs(step("knee_R"))})
    n = F.count("__l").over(every) + F.count("__r").over(every)
    own = own.withColumn("__m", (F.coalesce(F.sum("__l").over(every), F.lit(0.0)) + F.coalesce(F.sum("__r").over(every), F.lit(0.0))) / n)
    off = lambda c: F.coalesce(F.sum((F.col(c) - F.col("__m")) * (F.col(c) - F.col("__m"))).over(every), F.lit(0.0))
    spread = F.sqrt((off("__l") + off("__r")) / n) + 1e-10

    def against(c: str):
        known = F.count(c).over(every) > 2
        return (F.col(c) - F.when(known, F.avg(c).over(every)).otherwise(0.0)) / F.when(known, F.stddev_pop(c).over(every) + 1e-10).otherwise(1e-10)

    z = {
        "segment": F.greatest(F.lit(0.0), *[against(c) for c in change]),
        "velocity": F.when((F.count("__v").over(every) > 2) & (F.stddev_pop("__v").over(every) > 1e-10), against("__v")),
        "angle": F.when(n > 2, F.greatest(F.lit(0.0), (F.col("__l") - F.col("__m")) / spread, (F.col("__r") - F.col("__m")) / spread)),
    }
    own = own.withColumns({c: penalty(v) for c, v in z.items()})
    score = 0.40 * F.col("segment") + 0.35 * F.col("velocity") + 0.25 * F.col("angle")
    return own.withColumn("score", score).select("trial_id", "frame_idx", *z, "score", (F.col("score") < low).alias("is_low"))


def treadmill(pose: DataFrame) -> DataFrame:
    """trial_id, treadmill, confidence: whether the hips range over less than a tenth of the picture.

    Confidence falls with the range from 1, to a half at least where the variance is small too; one sign alone gives a
    half, and none what is left of 1 as the range exceeds a tenth. Fewer than two frames with both hips tell nothing: 0.
    """
    hx = P.middle(P.x("LEFT_HIP"), P.x("RIGHT_HIP"))
    own = pose.select("trial_id", hx.alias("hx")).groupBy("trial_id").agg((F.max("hx") - F.min("hx")).alias("reach"), F.var_pop("hx").alias("var"), F.count("hx").alias("n"))
    stays, steady = F.col("reach") < 0.10, F.col("var") < 0.005
    sure = F.when(F.col("n") < 2, 0.0).when(stays & steady, F.greatest(F.lit(0.5), 1.0 - F.col("reach") / 0.10)).when(stays | steady, 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - (F.col("reach") - 0.10) / 0.10))
    return own.select("trial_id", ((F.col("n") >= 2) & stays).alias("treadmill"), sure.alias("confidence"))


def other_people(pose: DataFrame, jump: float = 0.30, mean_jump: float = 0.15) -> DataFrame:
    """trial_id, frame_idx, reason: frames where landmarks leap or confidence dips alone, as when the tracker changes person."""
    w = Window.partitionBy("trial_id").orderBy("pos")
    names = ["NOSE", "LEFT_SHOULDER", "RIGHT_SHOULDER", "LEFT_HIP", "RIGHT_HIP"]
    own = pose.select("trial_id", "frame_idx", "pos", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), *[c for n in names for c in (P.x(n).alias(f"{n}_x"), P.y(n).alias(f"{n}_y"))])
    leap = F.array_compact(F.array(*[F.hypot(F.col(f"{n}_x") - F.lag(f"{n}_x").over(w), F.col(f"{n}_y") - F.lag(f"{n}_y").over(w)) for n in names]))
    own = own.withColumns({"leap": leap, "before": F.lag("confidence").over(w), "after": F.lead("confidence").over(w)})
    mean = C.safe_divide(F.aggregate("leap", F.lit(0.0), lambda a, v: a + v), F.size("leap"))
    reason = F.when((F.array_max("leap") > jump) | (mean > mean_jump), "jump").when((F.col("confidence") < 0.3) & (F.col("before") > 0.7) & (F.col("after") > 0.7), "dip")
    return own.select("trial_id", "frame_idx", reason.alias("reason")).filter(F.col("reason").isNotNull())


def sagittal_alignment(pose: DataFrame, limit: float = 15.0) -> DataFrame:
    """trial_id, ratio, degrees, aligned, confidence: how far the walk leaves the picture's plane.

    The ratio is the mean distance of the hips over the femurs' mean length, its arc sine the angle, and confidence the
    share of frames that have it. Trials without any count as aligned, with 0 for the rest.
    """
    length = lambda a, b: C.distance(P.x(a), P.y(a), P.x(b), P.y(b))
    femur = (length("LEFT_HIP", "LEFT_KNEE") + length("RIGHT_HIP", "RIGHT_KNEE")) / 2
    ratio = F.when(femur >= 1e-6, length("LEFT_HIP", "RIGHT_HIP") / femur)
    own = pose.select("trial_id", ratio.alias("r")).groupBy("trial_id").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("ratio"), (F.count("r") / F.count("*")).alias("confidence"))
    own = own.withColumn("degrees", F.degrees(F.asin(F.least(F.lit(1.0), F.col("ratio")))))
    return own.select("trial_id", "ratio", "degrees", (F.col("degrees") < limit).alias("aligned"), "confidence")


def bounding_box(pose: DataFrame, width: int, height: int, padding: float = 0.15) -> DataFrame:
    """trial_id and the padded box of all landmarks in pixels, within the picture."""
    points = F.filter(F.map_values("landmarks"), lambda p: C.clean(p["x"]).isNotNull() & C.clean(p["y"]).isNotNull())
    own = pose.select("trial_id", F.explode(points).alias("p")).groupBy("trial_id").agg(F.min("p.x").alias("x0"), F.max("p.x").alias("x1"), F.min("p.y").alias("y0"), F.max("p.y").alias("y1"))
    px, py = padding * (F.col("x1") - F.col("x0")), padding * (F.col("y1") - F.col("y0"))
    whole = lambda c, size: C.clip(F.round(c * size), 0.0, float(size)).cast("int")
    return own.select("trial_id", whole(F.col("x0") - px, width).alias("left"), whole(F.col("y0") - py, height).alias("top"), whole(F.col("x1") + px, width).alias("right"), whole(F.col("y1") + py, height).alias("bottom"))


def person_extent(pose: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """trial_id, selected, n_frames, x0, y0, x1, y1: in how many frames a person is seen (within ``box``, if given), and the box of all their landmarks."""
    inside = lambda p: C.clean(p["x"]).between(box[0], box[2]) & C.clean(p["y"]).between(box[1], box[3]) if box else C.clean(p["x"]).isNotNull() & C.clean(p["y"]).isNotNull()
    own = pose.select("trial_id", F.filter(F.map_values("landmarks"), lambda p: F.coalesce(inside(p), F.lit(False))).alias("p"))
    edge = lambda pick, axis: pick(F.transform("p", lambda q: q[axis]))
    out = own.groupBy("trial_id").agg(F.count_if(F.size("p") > 0).alias("n_frames"), F.min(edge(F.array_min, "x")).alias("x0"), F.min(edge(F.array_min, "y")).alias("y0"), F.max(edge(F.array_max, "x")).alias("x1"), F.max(edge(F.array_max, "y")).alias("y1"))
    return out.select("trial_id", (F.col("n_frames") > 0).alias("selected"), "n_frames", "x0", "y0", "x1", "y1")


def visible_span(pose: DataFrame, margin: float = 0.02, seen: float = 0.3) -> DataFrame:
    """Frames between the first and the last in which all leg landmarks are well inside the picture and seen."""
    names = [f"{s}_{n}" for s in ("LEFT", "RIGHT") for n in ("HIP", "KNEE", "ANKLE")]
    whole = F.lit(True)
    for n in names:
        whole = whole & P.x(n).between(margin, 1 - margin) & P.y(n).between(margin, 1 - margin) & (P.visibility(n) >= seen)
    good = F.when(F.coalesce(whole, F.lit(False)), F.col("pos"))
    return pose.withColumns({"__a": F.min(good).over(P.trial()), "__b": F.max(good).over(P.trial())}).filter(F.col("pos").between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def detection_matrix(pose: DataFrame, bins: int = 50) -> DataFrame:
    """trial_id, name, bin, rate: how often a landmark is seen, by time bin."""
    long = P.to_long(pose)
    n = F.max("pos").over(P.trial()) + 1
    at = F.least(F.floor(F.col("pos") * bins / n), F.lit(bins - 1)).cast("int")
    return long.withColumn("bin", at).groupBy("trial_id", "name", "bin").agg(F.avg(F.when(F.col("x").isNotNull() & (F.coalesce("visibility", F.lit(1.0)) >= 0.3), 1.0).otherwise(0.0)).alias("rate"))
