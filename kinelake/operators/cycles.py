"""Gait cycles: segmentation, time-normalised curves, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import columns as C

SIDE = ["trial_id", "side"]


def segment(events: DataFrame, rate: Column | float, shortest: float = 0.4, longest: float = 2.5) -> DataFrame:
    """Cycles from each contact to the next of the same side.

    events: trial_id, side, kind, frame; rate in frames a second (a column of events, or a number). Durations from
    shortest to longest stay, both included. The lift-off is the first strictly inside; stance is its share of the cycle.
    """
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    w = Window.partitionBy(*SIDE).orderBy("frame")
    # The first lift-off after a contact: the next one in the merged order, if it comes before the next contact.
    order = Window.partitionBy(*SIDE).orderBy("frame", F.when(F.col("kind") == "to", 0).otherwise(1))
    after = order.rowsBetween(1, Window.unboundedFollowing)
    merged = events.select(*SIDE, "kind", "frame", r.alias("rate")).withColumn("to", F.first(F.when(F.col("kind") == "to", F.col("frame")), ignorenulls=True).over(after))
    starts = merged.filter("kind = 'hs'").withColumn("end_frame", F.lead("frame").over(w)).filter(F.col("end_frame").isNotNull())
    duration = (F.col("end_frame") - F.col("frame")) / F.col("rate")
    inside = F.when((F.col("to") > F.col("frame")) & (F.col("to") < F.col("end_frame")), F.col("to"))
    out = starts.select(*SIDE, F.col("frame").alias("start_frame"), "end_frame", inside.alias("toe_off_frame"), duration.alias("duration")).filter(F.col("duration").between(shortest, longest))
    stance = (F.col("toe_off_frame") - F.col("start_frame")) / (F.col("end_frame") - F.col("start_frame")) * 100.0
    number = F.row_number().over(Window.partitionBy("trial_id").orderBy("start_frame", "side")) - 1
    return out.select("trial_id", number.alias("cycle_id"), "side", "start_frame", "end_frame", "toe_off_frame", "duration", stance.alias("stance_pct"), (100.0 - stance).alias("swing_pct"))


def frames_of(cycles: DataFrame) -> DataFrame:
    """A row per frame of each cycle, both ends included: an equi-joinable form of the interval."""
    return cycles.withColumn("frame_idx", F.explode(F.sequence("start_frame", "end_frame")))


def quality_gate(cycles: DataFrame, frames: DataFrame, score: str, least: float) -> DataFrame:
    """Cycles whose frames' mean score isn't below ``least``; cycles of unknown score stay."""
    mean = frames_of(cycles.select("trial_id", "cycle_id", "start_frame", "end_frame")).join(frames.select("trial_id", "frame_idx", F.col(score).alias("__s")), ["trial_id", "frame_idx"]).groupBy("trial_id", "cycle_id").agg(F.avg("__s").alias("__m"))
    return cycles.join(mean, ["trial_id", "cycle_id"], "left").filter(F.coalesce(F.col("__m") >= least, F.lit(True))).drop("__m")


def curves(cycles: DataFrame, angles: DataFrame, points: int = 101, least: int = 10) -> DataFrame:
    """trial_id, cycle_id, side, joint, curve: each joint's angle over a cycle, missing values interpolated, at ``points`` points.

    angles: trial_id, frame_idx, side, joint, value. Cycles of fewer than ``least`` frames, and joints without any value,
    have no curve.
    """
    spans = frames_of(cycles.select("trial_id", "cycle_id", "side", "start_frame", "end_frame")).select("trial_id", "cycle_id", "side", "frame_idx")
    joined = spans.join(angles.select("trial_id", "frame_idx", "side", "joint", "value"), ["trial_id", "frame_idx", "side"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "value"))), lambda s: s["value"])
    raw = joined.groupBy("trial_id", "cycle_id", "side", "joint").agg(ordered.alias("curve"), F.count("value").alias("__known"))
    kept = raw.filter((F.size("curve") >= least) & (F.col("__known") > 0)).drop("__known")
    return kept.withColumn("curve", C.filled_curve("curve")).withColumn("curve", C.resample("curve", points))


def long_curves(curved: DataFrame) -> DataFrame:
    """trial_id, cycle_id, side, joint, p, value."""
    # An inner explode would have the optimizer push size(curve) > 0 below, and work out curves once more for each point.
    return curved.select("trial_id", "cycle_id", "side", "joint", F.posexplode_outer("curve").alias("p", "value")).filter(F.col("p").isNotNull())


def summary(curves_long: DataFrame) -> DataFrame:
    """Mean, population deviation and number of cycles at each point: trial_id, side, joint, p, mean, std, n_cycles."""
    return curves_long.groupBy("trial_id", "side", "joint", "p").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_cycles"))


def mean_curves(curved: DataFrame) -> DataFrame:
    """trial_id, side, joint, curve: the mean curve over cycles."""
    points = F.array_sort(F.collect_list(F.struct("p", "mean")))  # as many as a curve has points
    return summary(long_curves(curved)).groupBy("trial_id", "side", "joint").agg(F.transform(points, lambda x: x["mean"]).alias("curve"))


def common_joints(summaries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, side, joint that every trial of a side (and of ``by``) has: those with as many trials as there are."""
    keys = [*by, "side"]
    have = summaries.filter(F.col("mean").isNotNull()).select(*keys, "trial_id", "joint").distinct()
    of_joint = have.groupBy(*keys, "joint").agg(F.count("*").alias("__n"))
    of_side = have.select(*keys, "trial_id").distinct().groupBy(*keys).agg(F.count("*").alias("__all"))
    return of_joint.join(of_side, keys).filter(F.col("__n") == F.col("__all")).select(*keys, "joint")


def ensemble(summaries: DataFrame, joints: str | list[str] = "any", by: tuple[str, ...] = ()) -> DataFrame:
    """Over trials: by, side, joint, p, mean of means, their deviation, mean deviation within, trials and cycles.

    joints: ``any`` takes each joint over the trials that have it, ``all`` only joints that every trial of the side has, a
    list only those named.
    """
    if joints == "all":
        summaries = summaries.join(common_joints(summaries, by), [*by, "side", "joint"], "left_semi")
    elif joints != "any":
        summaries = summaries.filter(F.col("joint").isin(list(joints)))
    return summaries.groupBy(*by, "side", "joint", "p").agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std_between"), F.avg("std").alias("std_within"), F.count("*").alias("n_trials"), F.sum("n_cycles").alias("n_cycles"))


def phase_by_frame(cycles: DataFrame) -> DataFrame:
    """trial_id, side, frame_idx, phase from 0 to 1; a frame of two cycles belongs to the later one."""
    rows = frames_of(cycles).withColumn("phase", (F.col("frame_idx") - F.col("start_frame")) / (F.col("end_frame") - F.col("start_frame")))
    return rows.groupBy("trial_id", "side", "frame_idx").agg(F.max_by("phase", "cycle_id").alias("phase"))


def dominant_direction(cycles: DataFrame, positions: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """The cycles of the larger group by sign of displacement; of equal groups that of the larger mean knee curve, or to the right.

    positions: trial_id, frame_idx, x (the hips' middle). Cycles that move by less than 1e-5, or at whose ends x is
    unknown, belong to neither; a trial without either group keeps all its cycles.
    """
    at = lambda f, name: positions.select("trial_id", F.col("frame_idx").alias(f), F.col("x").alias(name))
    signed = cycles.join(at("start_frame", "__a"), ["trial_id", "start_frame"], "left").join(at("end_frame", "__b"), ["trial_id", "end_frame"], "left")
    way = F.col("__b") - F.col("__a")
    signed = signed.withColumn("__d", F.when(way >= 1e-5, 1).when(way <= -1e-5, -1))
    if curves is not None:
        knee = curves.filter("joint = 'knee'").select("trial_id", "cycle_id", (F.aggregate("curve", F.lit(0.0), lambda a, v: a + v) / F.size("curve")).alias("__k"))
        signed = signed.join(knee, ["trial_id", "cycle_id"], "left")
    else:
        signed = signed.withColumn("__k", F.lit(0.0))
    size = signed.filter(F.col("__d").isNotNull()).groupBy("trial_id", "__d").agg(F.count("*").alias("__n"), F.coalesce(F.avg("__k"), F.lit(float("-inf"))).alias("__k"))
    best = size.groupBy("trial_id").agg(F.max(F.struct("__n", "__k", "__d")).alias("m")).select("trial_id", F.col("m.__d").alias("__best"))
    return signed.join(best, "trial_id", "left").filter(F.col("__best").isNull() | (F.col("__d") == F.col("__best"))).select(cycles.columns)


def flexion_positive(curves: DataFrame) -> DataFrame:
    """Curves with knees whose mean is positive, and hips that are more flexed at contact than in the middle, by trial and side.

    Where the knee's mean over a side's cycles is negative its knee and hip curves change sign; where the hip's mean curve
    then is lower over its first 15 points than from 40 to 59 the hip's do.
    """
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)
    every = Window.partitionBy("trial_id", "side")
    of = lambda joint, value: F.avg(F.when(F.col("joint") == joint, value)).over(every)
    whole = F.size("curve") == 101
    out = curves.withColumns({"__knee": of("knee", mean("curve")), "__hip": of("hip", F.when(whole, mean(F.slice("curve", 1, 15)) - mean(F.slice("curve", 41, 20))))})
    first = F.when(F.col("__knee") < 0, -1.0).otherwise(1.0)
    sign = F.when(F.col("joint") == "knee", first).when(F.col("joint") == "hip", first * F.when(first * F.col("__hip") < 0, -1.0).otherwise(1.0)).otherwise(1.0)
    return out.withColumn("__s", sign).withColumn("curve", F.when(F.col("__s") < 0, F.transform("curve", lambda v: -v)).otherwise(F.col("curve"))).select(curves.columns)
