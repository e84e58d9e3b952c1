"""Statistics of walking: spatiotemporal figures, symmetry, variability, spectra, distances and patterns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import columns as C
from kinelake.functions import kernels as K
from kinelake.functions import series
from kinelake.operators import pose as P
from kinelake.schemas import SEGMENT_MASS, SEGMENTS


def contacts(events: DataFrame) -> DataFrame:
    """Contacts of both sides in order, left first where both share a frame, with the next contact of any side."""
    w = Window.partitionBy("trial_id").orderBy("frame", "side")
    return events.filter("kind = 'hs'").select("trial_id", "side", "frame", F.lead("frame").over(w).alias("next_frame"), F.lead("side").over(w).alias("next_side"))


def _by_side(value: Column, name: str, f=F.avg) -> list[Column]:
    return [f(F.when(F.col("side") == s, value)).alias(f"{name}_{s}") for s in ("left", "right")]


def spatiotemporal(cycles: DataFrame, events: DataFrame, rate: float) -> DataFrame:
    """A row per trial: stride, step and cadence, stance by side, and double support."""
    plausible = F.when(F.col("stance_pct").between(35, 80), F.col("stance_pct"))
    per = cycles.groupBy("trial_id").agg(
        F.count("*").alias("n_cycles"), F.avg("duration").alias("stride_time_mean_s"), F.stddev_pop("duration").alias("stride_time_std_s"),
        *_by_side(F.col("duration"), "stride_time"), *_by_side(plausible, "stance_pct"), *_by_side(F.lit(1), "n_cycles", F.count),
    )
    steps = contacts(events).filter(F.col("side") != F.col("next_side")).withColumn("t", (F.col("next_frame") - F.col("frame")) / float(rate))
    step = steps.groupBy("trial_id").agg(F.avg("t").alias("step_time_mean_s"), F.stddev_pop("t").alias("step_time_std_s"))
    both = F.col("stance_pct_left") + F.col("stance_pct_right") - 100.0
    return per.join(step, "trial_id", "left").withColumns({"cadence_steps_per_min": C.safe_divide(F.lit(120.0), F.col("stride_time_mean_s")), "double_support_pct": F.when(both.isNotNull(), F.greatest(F.lit(0.0), both))})


def rom_table(curves: DataFrame) -> DataFrame:
    """trial_id, side, joint, rom mean, deviation, variation and list over cycles."""
    own = curves.withColumn("rom", F.array_max("curve") - F.array_min("curve"))
    return own.groupBy("trial_id", "side", "joint").agg(F.avg("rom").alias("rom_mean"), F.stddev_pop("rom").alias("rom_std"), C.cv("rom", population=True).alias("rom_cv"), F.transform(F.array_sort(F.collect_list(F.struct("cycle_id", "rom"))), lambda x: x["rom"]).alias("roms"))


def symmetry(cycles: DataFrame, roms: DataFrame) -> DataFrame:
    """trial_id, hip_rom_si, knee_rom_si, ankle_rom_si, duration_si, stance_si, and their mean overall_si."""
    joint = lambda j, s: F.max(F.when((F.col("joint") == j) & (F.col("side") == s), F.col("rom_mean")))
    r = roms.groupBy("trial_id").agg(*[C.symmetry_index(joint(j, "left"), joint(j, "right")).alias(f"{j}_rom_si") for j in ("hip", "knee", "ankle")])
    c = cycles.groupBy("trial_id").agg(*_by_side(F.col("duration"), "d"), *_by_side(F.col("stance_pct"), "s")).select("trial_id", C.symmetry_index("d_left", "d_right").alias("duration_si"), C.symmetry_index("s_left", "s_right").alias("stance_si"))
    out = c.join(r, "trial_id", "full_outer")
    known = F.array_compact(F.array(*[F.col(n) for n in out.columns if n.endswith("_si")]))
    return out.withColumn("overall_si", F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)))


def variability(cycles: DataFrame) -> DataFrame:
    """trial_id, cycle_duration_cv, stance_cv."""
    return cycles.groupBy("trial_id").agg(C.cv("duration").alias("cycle_duration_cv"), C.cv("stance_pct").alias("stance_cv"))


def stride_variability(cycles: DataFrame, events: DataFrame, rate: float, poses: DataFrame | None = None, curves: DataFrame | None = None) -> DataFrame:
    """trial_id, stride_time_cv, step_time_cv; with poses step_length_cv of both sides, with curves rom_cv of joints and sides.

    A step is a contact after one of the other side; its length is how far its ankle is from where it was at that one.
    Figures of fewer than two values are 0.
    """
    steps = contacts(events).filter(F.col("side") != F.col("next_side"))
    own = [steps.groupBy("trial_id").agg(C.cv((F.col("next_frame") - F.col("frame")) / float(rate)).alias("step_time_cv"))]
    if poses is not None:
        at = poses.select("trial_id", F.col("frame_idx").cast("long").alias("frame"), P.x("LEFT_ANKLE").alias("l"), P.x("RIGHT_ANKLE").alias("r"))
        then = at.select("trial_id", F.col("frame").alias("next_frame"), F.col("l").alias("next_l"), F.col("r").alias("next_r"))
        both = steps.withColumns({"frame": F.col("frame").cast("long"), "next_frame": F.col("next_frame").cast("long")}).join(at, ["trial_id", "frame"]).join(then, ["trial_id", "next_frame"])
        far = {s: F.when(F.col("next_side") == s, F.abs(F.col(f"next_{s[0]}") - F.col(s[0]))) for s in ("left", "right")}
        own.append(both.groupBy("trial_id").agg(*[C.cv(v).alias(f"step_length_cv_{s}") for s, v in far.items()]))
    if curves is not None:
        reach = F.array_max("curve") - F.array_min("curve")
        one = lambda j, s: F.when((F.col("joint") == j) & (F.col("side") == s), reach)
        own.append(curves.groupBy("trial_id").agg(*[C.cv(one(j, s)).alias(f"rom_cv_{j}_{s}") for s in ("left", "right") for j in ("hip", "knee", "ankle")]))
    out = cycles.groupBy("trial_id").agg(C.cv("duration").alias("stride_time_cv"))
    for more in own:
        out = out.join(more, "trial_id", "left")
    return out.fillna(0.0, [c for c in out.columns if c.endswith("_cv") or "_cv_" in c])


def clinical_markers(curves: DataFrame) -> DataFrame:
    """trial_id, side, ankle at contact, least ankle in swing, greatest knee in swing, greatest hip; means over whole curves."""
    whole = curves.filter(F.size("curve") == 101)
    first = F.slice("curve", 1, 5)
    mean5 = F.aggregate(first, F.lit(0.0), lambda a, v: a + v) / F.size(first)
    pick = lambda j, v: F.avg(F.when(F.col("joint") == j, v))
    swing = F.slice("curve", 61, 41)
    return whole.groupBy("trial_id", "side").agg(pick("ankle", mean5).alias("ankle_at_contact"), pick("ankle", F.array_min(swing)).alias("ankle_swing_min"), pick("knee", F.array_max(swing)).alias("knee_swing_max"), pick("hip", F.array_max("curve")).alias("hip_max"))


def flags(figures: DataFrame) -> DataFrame:
    """trial_id, flags: texts for figures (columns of the functions above, those there are) beyond usual limits."""
    have = set(figures.columns)
    out = []
    if "cadence_steps_per_min" in have:
        c = F.col("cadence_steps_per_min")
        out += [F.when((c > 0) & (c < 80), F.format_string("Low cadence: %.0f steps/min", c)), F.when(c > 140, F.format_string("High cadence: %.0f steps/min", c))]
    out += [F.when(F.col(f"stance_pct_{s}") > 70, F.format_string(f"Prolonged stance {s}: %.1f%%", f"stance_pct_{s}")) for s in ("left", "right") if f"stance_pct_{s}" in have]
    out += [F.when(F.col(n) > 20, F.format_string(f"Asymmetry {n.removesuffix('_si').replace('_rom', '')}: SI=%.1f%%", n)) for n in figures.columns if n.endswith("_si") and n != "overall_si"]
    if "cycle_duration_cv" in have:
        out.append(F.when(F.col("cycle_duration_cv") > 20, F.format_string("High cycle duration variability: CV=%.1f%%", "cycle_duration_cv")))
    return figures.select("trial_id", F.array_compact(F.array(*out)).alias("flags"))


def instantaneous_cadence(events: DataFrame, rate: float) -> DataFrame:
    """trial_id, mean, std, cv and slope of the cadence between successive contacts of any side."""
    own = contacts(events).filter(F.col("next_frame") > F.col("frame")).select("trial_id", (60.0 * rate / (F.col("next_frame") - F.col("frame"))).alias("c"), ((F.col("next_frame") + F.col("frame")) / (2.0 * rate)).alias("t"))
    return own.groupBy("trial_id").agg(F.count("*").alias("n"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), C.safe_divide(F.stddev_pop("c") * 100.0, F.avg("c")).alias("cv"), F.regr_slope("c", "t").alias("slope"))


def regularity(tracks: DataFrame, keys: list[str], value: str, rate: float, shortest: float = 0.3, longest: float = 1.5) -> DataFrame:
    """keys, step_lag, step, stride_lag, stride: the first two peaks of the autocorrelation from ``shortest`` seconds on."""
    r = series.autocorrelation(tracks, keys, value, int(2 * longest * rate) + 1)
    peaks = series.local_maxima(r, keys, "r", pos="lag").filter(F.col("lag") >= max(1, int(shortest * rate)))
    ranked = peaks.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("lag"))).filter("k <= 2")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return ranked.groupBy(*keys).agg(pick(1, "lag").alias("step_lag"), pick(1, "r").alias("step"), pick(2, "lag").alias("stride_lag"), pick(2, "r").alias("stride"))


def regularity_index(pose: DataFrame, trials: DataFrame, landmark: str = "LEFT_ANKLE") -> DataFrame:
    """trial_id, step_regularity, stride_regularity, symmetry_ratio: of a landmark's height, at each trial's own rate (see kernels.regularity)."""
    kind = dict(pose.dtypes)["trial_id"]
    rates = trials.select("trial_id", F.coalesce("meta.fps", F.lit(30.0)).alias("fps"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        step, stride = K.regularity(table.column("y").to_numpy().astype(float), table.column("fps")[0].as_py())
        return pa.table({"trial_id": table.column("trial_id")[:1], "step_regularity": pa.array([step], pa.float64()), "stride_regularity": pa.array([stride], pa.float64())})

    own = pose.select("trial_id", "pos", P.y(landmark).alias("y")).join(rates, "trial_id")
    out = own.groupBy("trial_id").applyInArrow(run, f"trial_id {kind}, step_regularity double, stride_regularity double")
    return out.withColumn("symmetry_ratio", F.when(F.col("stride_regularity") > 0, F.col("step_regularity") / F.col("stride_regularity")))


def harmonic_ratio(tracks: DataFrame, keys: list[str], value: str, forward: bool = False, harmonics: int = 20, least: int = 30, rows: int = 60, pos: str = "pos") -> DataFrame:
    """keys, ratio: even over odd harmonics of the whole series, or odd over even ones for the ``forward`` axis.

    Missing values are interpolated. A series of fewer than ``rows`` rows, of fewer than ``least`` known values, or too
    short to have so many harmonics has a null ratio, and so has one whose divisor is 0. Harmonics are sums over rows of
    sines and cosines.
    """
    every = Window.partitionBy(*keys)
    whole = series.interpolate(tracks.select(*keys, pos, F.col(value).cast("double").alias("__x")), keys, "__x", "__v", pos)
    counted = whole.withColumns({"__n": F.count("*").over(every), "__known": F.count("__x").over(every), "__k": F.row_number().over(every.orderBy(pos)) - 1})
    x = counted.select(*keys, "__n", "__known", (F.col("__v") - F.avg("__v").over(every)).alias("__v"), (2 * math.pi * F.col("__k") / F.col("__n")).alias("__a"))
    sums = x.groupBy(*keys).agg(F.first("__n").alias("__n"), F.first("__known").alias("__known"), *[c for k in range(1, harmonics + 1) for c in (F.sum(F.col("__v") * F.cos(k * F.col("__a"))).alias(f"c{k}"), F.sum(F.col("__v") * F.sin(k * F.col("__a"))).alias(f"s{k}"))])
    size = lambda k: F.hypot(f"c{k}", f"s{k}")
    even = sum((size(k) for k in range(2, harmonics + 1, 2)), F.lit(0.0))
    odd = sum((size(k) for k in range(1, harmonics + 1, 2)), F.lit(0.0))
    enough = (F.col("__n") >= rows) & (F.col("__known") >= least) & (F.floor(F.col("__n") / 2) >= harmonics)
    return sums.select(*keys, F.when(enough, C.safe_divide(*((odd, even) if forward else (even, odd)))).alias("ratio"))


def harmonic_ratios(pose: DataFrame, landmark: str = "LEFT_ANKLE") -> DataFrame:
    """trial_id, hr_ap, hr_vertical: harmonic ratios of a landmark's way forward and up and down."""
    own = pose.select("trial_id", "pos", P.x(landmark).alias("x"), P.y(landmark).alias("y"))
    ahead = harmonic_ratio(own, ["trial_id"], "x", forward=True).withColumnRenamed("ratio", "hr_ap")
    return ahead.join(harmonic_ratio(own, ["trial_id"], "y").withColumnRenamed("ratio", "hr_vertical"), "trial_id")


def scale(pose: DataFrame, subjects: DataFrame, femur_ratio: float = 0.245) -> DataFrame:
    """trial_id, scale: metres per unit from femur and foot lengths, their mean if both are known, or the height; 1 without any.

    subjects: trial_id, height_m, femur_mm, foot_mm (nullable). Lengths are medians of the first 60 frames: of the left
    thigh, and of the left foot, or where a frame lacks one of its ends that of the right. The femur is ``femur_ratio`` of the height.
    """
    early = pose.filter("pos < 60")
    has = lambda n: F.map_contains_key("landmarks", F.lit(n)) & F.col("landmarks")[n].isNotNull()
    either = lambda part, axis: F.when(has(f"LEFT_{part}"), axis(f"LEFT_{part}")).otherwise(axis(f"RIGHT_{part}"))
    femur = C.distance(P.x("LEFT_HIP"), P.y("LEFT_HIP"), P.x("LEFT_KNEE"), P.y("LEFT_KNEE"))
    foot = C.distance(either("HEEL", P.x), either("HEEL", P.y), either("FOOT_INDEX", P.x), either("FOOT_INDEX", P.y))
    lengths = early.groupBy("trial_id").agg(F.median(femur).alias("femur"), F.median(foot).alias("foot"))
    j = subjects.join(lengths, "trial_id", "left")
    a, b = C.safe_divide(F.col("femur_mm") / 1000.0, F.col("femur")), C.safe_divide(F.col("foot_mm") / 1000.0, F.col("foot"))
    return j.select("trial_id", F.coalesce((a + b) / 2, a, b, C.safe_divide(F.col("height_m") * femur_ratio, F.col("femur")), F.lit(1.0)).alias("scale"))


def height_scale(pose: DataFrame, trials: DataFrame, first: int = 30, among: int = 60, least: float = 0.5) -> DataFrame:
    """trial_id, scale: metres per pixel from the subject's height and the median height from nose to ankles in the picture.

    It is that of the first ``first`` frames that qualify of the trial's first ``among``: with a confidence of at least
    ``least``, nose and both ankles known, and more than 10 pixels between them. trials: meta.height (1080 if unknown),
    subject.height_m. Null without a height, or a frame that qualifies.
    """
    pixels = F.abs(P.middle(P.y("LEFT_ANKLE"), P.y("RIGHT_ANKLE")) - P.y("NOSE")) * F.coalesce("picture", F.lit(1080))
    about = trials.select("trial_id", F.col("meta.height").alias("picture"), F.col("subject.height_m").alias("height_m"))
    early = pose.filter(F.col("pos") < among).join(about.select("trial_id", "picture"), "trial_id").select("trial_id", "pos", F.when((F.coalesce("confidence", F.lit(0.0)) >= least) & (pixels > 10), pixels).alias("pixels"))
    upto = Window.partitionBy("trial_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    chosen = early.withColumn("k", F.count("pixels").over(upto)).filter(F.col("pixels").isNotNull() & (F.col("k") <= first))
    medians = chosen.groupBy("trial_id").agg(F.median("pixels").alias("pixels"))
    return about.join(medians, "trial_id", "left").select("trial_id", F.when(F.col("height_m") > 0, F.col("height_m") / F.col("pixels")).alias("scale"))


def step_lengths(events: DataFrame, positions: DataFrame) -> DataFrame:
    """trial_id, side, step_length: mean distance along x between the leading ankles of successive contacts.

    positions: trial_id, frame_idx, side, x (already in metres if scaled).
    """
    steps = contacts(events).filter(F.col("side") != F.col("next_side"))
    at = lambda s, f, name: positions.select("trial_id", F.col("side").alias(s), F.col("frame_idx").alias(f), F.col("x").alias(name))
    joined = steps.join(at("side", "frame", "__a"), ["trial_id", "side", "frame"]).join(at("next_side", "next_frame", "__b"), ["trial_id", "next_side", "next_frame"])
    return joined.groupBy("trial_id", F.col("next_side").alias("side")).agg(F.avg(F.abs(F.col("__b") - F.col("__a"))).alias("step_length"))


def walking_speed(cycles: DataFrame, positions: DataFrame) -> DataFrame:
    """trial_id, side (left, right, overall), speed: mean stride length over duration."""
    at = lambda f, name: positions.select("trial_id", "side", F.col("frame_idx").alias(f), F.col("x").alias(name))
    j = cycles.join(at("start_frame", "__a"), ["trial_id", "side", "start_frame"]).join(at("end_frame", "__b"), ["trial_id", "side", "end_frame"])
    v = F.abs(F.col("__b") - F.col("__a")) / F.col("duration")
    return j.rollup("trial_id", "side").agg(F.avg(v).alias("speed"), F.grouping_id().alias("__g")).filter("__g <= 1").select("trial_id", F.when(F.col("__g") == 1, "overall").otherwise(F.col("side")).alias("side"), "speed")


def single_support(cycles: DataFrame, events: DataFrame, rate: float) -> DataFrame:
    """trial_id, side, single_support: from the other side's first lift-off within a cycle to the cycle's end, mean seconds."""
    lift = events.filter("kind = 'to'").select("trial_id", F.when(F.col("side") == "left", "right").otherwise("left").alias("side"), F.col("frame").alias("frame_idx"))
    spans = cycles.select("trial_id", "side", "cycle_id", "start_frame", "end_frame").withColumn("frame_idx", F.explode(F.sequence("start_frame", "end_frame")))
    first = spans.join(lift, ["trial_id", "side", "frame_idx"]).groupBy("trial_id", "side", "cycle_id", "end_frame").agg(F.min("frame_idx").alias("to"))
    return first.groupBy("trial_id", "side").agg(F.avg((F.col("end_frame") - F.col("to")) / float(rate)).alias("single_support"))


def toe_clearance(cycles: DataFrame, toes: DataFrame, heels: DataFrame) -> DataFrame:
    """trial_id, side, clearance and its variation: least height of the toe above ground in swing.

    toes and heels: trial_id, frame_idx, side, y downward. Ground is the 95th percentile of the side's heel.
    """
    ground = heels.groupBy("trial_id", "side").agg(F.percentile("y", F.lit(0.95)).alias("ground"))
    swing = cycles.filter(F.col("toe_off_frame").isNotNull()).select("trial_id", "side", "cycle_id", F.explode(F.sequence(F.col("toe_off_frame"), F.col("end_frame") - 1)).alias("frame_idx"))
    least = swing.join(toes, ["trial_id", "side", "frame_idx"]).join(ground, ["trial_id", "side"]).groupBy("trial_id", "side", "cycle_id").agg(F.min(F.col("ground") - F.col("y")).alias("c"))
    return least.groupBy("trial_id", "side").agg(F.avg("c").alias("clearance"), C.cv("c").alias("clearance_cv"))


def arm_swing(arms: DataFrame) -> DataFrame:
    """trial_id, left, right, si, coordination, reduced: reach of both arms, how it differs, and how the right arm goes against the left leg.

    arms has trial_id, left and right (shoulder flexion) and hip (left hip flexion) per frame, and may have wrist_left
    and wrist_right (x), whose reach in hundredths stands in for both sides where a shoulder is never known. Coordination
    needs as many values of the right shoulder as of the hip. A mean reach under 10 is reduced.
    """
    reach = lambda c: F.max(c) - F.min(c)
    wrists = {s: reach(f"wrist_{s}") * 100.0 if f"wrist_{s}" in arms.columns else F.lit(None).cast("double") for s in ("left", "right")}
    both = (F.count("left") > 0) & (F.count("right") > 0)
    against = F.when((F.count("right") > 0) & (F.count("right") == F.count("hip")), F.greatest(F.lit(0.0), -100.0 * F.corr("right", "hip")))
    own = arms.groupBy("trial_id").agg(*[F.when(both, reach(s)).otherwise(wrists[s]).alias(s) for s in ("left", "right")], against.alias("coordination"))
    return own.withColumns({"si": C.symmetry_index("left", "right"), "reduced": (F.col("left") + F.col("right")) / 2 < 10})


def speed_normalized(figures: DataFrame, gravity: float = 9.81) -> DataFrame:
    """Froude number, and speed, cadence and stride without dimension, of trial_id, height_m, speed, cadence, stride_length.

    cadence is in steps a minute, and half of it the strides that are scaled. Without a speed above 0 its figures are null.
    """
    leg = 0.53 * F.col("height_m")
    pace = F.sqrt(F.lit(gravity) * leg)
    speed = F.when(F.col("speed") > 0, F.col("speed"))
    return figures.select("trial_id", (speed * speed / (gravity * leg)).alias("froude"), (speed / pace).alias("speed_n"), (F.when(F.col("cadence") > 0, F.col("cadence")) / 120.0 * F.sqrt(leg / gravity)).alias("cadence_n"), (F.col("stride_length") / leg).alias("stride_n"))


def _bounded(value: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 2)


def patterns(mean_curves: DataFrame) -> DataFrame:
    """trial_id, side, pattern, severity, value, confidence: spastic, steppage and crouch gait from mean curves (trial_id, side, joint, curve)."""
    pick = lambda j: F.first(F.when(F.col("joint") == j, F.col("curve")), ignorenulls=True).alias(j)
    w = mean_curves.groupBy("trial_id", "side").agg(pick("hip"), pick("knee"), pick("ankle"))
    swing = lambda c: F.array_max(F.slice(c, 61, 41))
    w = w.withColumns({"k": swing("knee"), "h": swing("hip"), "low": F.array_min("knee"), "a": F.array_max("ankle") - F.array_min("ankle")})
    rule = lambda when, name, severity, value, confidence: F.when(when, F.struct(F.lit(name).alias("pattern"), severity.alias("severity"), F.round(value, 1).alias("value"), _bounded(confidence).alias("confidence")))
    found = F.array_compact(F.array(
        rule(F.col("k") < 40, "spastic", F.when(F.col("k") < 30, "moderate").otherwise("mild"), F.col("k"), (40.0 - F.col("k")) / 20.0),
        rule((F.col("h") > 45) & (F.col("a") < 15), "steppage", F.when(F.col("a") < 10, "moderate").otherwise("mild"), F.col("a"), 0.5 * ((F.col("h") - 45.0) / 25.0 + (15.0 - F.col("a")) / 10.0)),
        rule(F.col("low") > 15, "crouch", F.when(F.col("low") > 25, "severe").otherwise("moderate"), F.col("low"), (F.col("low") - 15.0) / 20.0),
    ))
    return w.select("trial_id", "side", F.explode(found).alias("r")).select("trial_id", "side", "r.*")


def trendelenburg(angles: DataFrame) -> DataFrame:
    """trial_id, value, severity, confidence where the unwrapped pelvis tilt ranges over more than 10 and at most 90 degrees."""
    known = series.unwrap(angles.filter(F.col("pelvis_tilt").isNotNull()), ["trial_id"], "pelvis_tilt", "u")
    reach = known.groupBy("trial_id").agg((F.max("u") - F.min("u")).alias("value")).filter((F.col("value") > 10) & (F.col("value") <= 90))
    return reach.select("trial_id", F.round("value", 1).alias("value"), F.when(F.col("value") > 15, "moderate").otherwise("mild").alias("severity"), _bounded((F.col("value") - 10.0) / 10.0).alias("confidence"))


def equinus(curves: DataFrame) -> DataFrame:
    """trial_id, side, value, severity: mean over cycles of the greatest ankle angle up to 60 percent, none where above 0."""
    own = curves.filter("joint = 'ankle'").groupBy("trial_id", "side").agg(F.avg(F.array_max(F.slice("curve", 1, 61))).alias("value"))
    return own.withColumn("severity", F.when(F.col("value") <= -10, "severe").when(F.col("value") <= -5, "moderate").when(F.col("value") <= 0, "mild").otherwise("none"))


def antalgic(cycles: DataFrame) -> DataFrame:
    """trial_id, detected, affected: stance below 55 on one side and above 60 on the other."""
    s = cycles.groupBy("trial_id").agg(*_by_side(F.col("stance_pct"), "s"))
    side = F.when((F.col("s_left") < 55) & (F.col("s_right") > 60), "left").when((F.col("s_right") < 55) & (F.col("s_left") > 60), "right")
    return s.select("trial_id", side.isNotNull().alias("detected"), side.alias("affected"))


def parkinsonian(figures: DataFrame) -> DataFrame:
    """trial_id, signs, detected: two or more of small ankle excursion, small arm swing and high cadence."""
    signs = F.array_compact(F.array(F.when(F.col("ankle_excursion") < 0.08, "short_stride"), F.when(F.col("arm_swing") < 10, "reduced_arm_swing"), F.when(F.col("cadence") > 130, "festination")))
    return figures.select("trial_id", signs.alias("signs"), (F.size(signs) >= 2).alias("detected"))


def segment_lengths(pose: DataFrame, limit: float = 15.0) -> DataFrame:
    """trial_id, segment, mean, std, cv, unsteady (cv beyond the limit), and the series by frame."""
    rows = F.array(*[F.struct(F.lit(n).alias("segment"), C.distance(P.x(a), P.y(a), P.x(b), P.y(b)).alias("d")) for a, b, n in SEGMENTS])
    long = pose.select("trial_id", "pos", F.explode(rows).alias("r")).select("trial_id", "pos", "r.segment", "r.d")
    own = long.groupBy("trial_id", "segment").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "d"))), lambda x: x["d"]).alias("series"))
    return own.withColumn("cv", F.coalesce(C.safe_divide(F.col("std"), F.col("mean")) * 100.0, F.lit(0.0))).withColumn("unsteady", F.col("cv") > limit)


def centre_of_mass(pose: DataFrame) -> DataFrame:
    """trial_id, frame_idx, pos, com_x, com_y: mass-weighted mean of the segments that are there, trunk halves by side, and the head."""
    parts = []
    for a, b, name in SEGMENTS:
        mass, at = SEGMENT_MASS[name[:-2]]
        mass = mass / 2 if name.startswith("trunk") else mass
        parts.append((mass, *[f(a) + at * (f(b) - f(a)) for f in (P.x, P.y)]))
    mass, at = SEGMENT_MASS["head"]
    parts.append((mass, *[P.middle(f("LEFT_SHOULDER"), f("RIGHT_SHOULDER")) + at * (f("NOSE") - P.middle(f("LEFT_SHOULDER"), f("RIGHT_SHOULDER"))) for f in (P.x, P.y)]))
    there = lambda p: p[1].isNotNull() & p[2].isNotNull()
    total = sum((F.when(there(p), p[0]).otherwise(0.0) for p in parts), F.lit(0.0))
    weighted = lambda k: sum((F.when(there(p), p[0] * p[k]).otherwise(0.0) for p in parts), F.lit(0.0))
    return pose.select("trial_id", "frame_idx", "pos", C.safe_divide(weighted(1), total).alias("com_x"), C.safe_divide(weighted(2), total).alias("com_y"))


def com_summary(com: DataFrame, rate: float) -> DataFrame:
    """trial_id, vertical_excursion, smoothness (1 over 1 plus the root mean square of the third derivative)."""
    w = Window.partitionBy("trial_id").orderBy("pos")
    known = com.filter(F.col("com_y").isNotNull())
    y = lambda k: F.lag("com_y", k).over(w)
    jerk = (F.col("com_y") - 3 * y(1) + 3 * y(2) - y(3)) * rate**3
    return known.withColumn("j", jerk).groupBy("trial_id").agg((F.max("com_y") - F.min("com_y")).alias("vertical_excursion"), F.coalesce(1.0 / (1.0 + C.rms("j")), F.lit(0.0)).alias("smoothness"))


def postural_sway(points: DataFrame, rate: float) -> DataFrame:
    """trial_id, area of the 95 percent ellipse, path, speed and ranges of points (trial_id, pos, x, y)."""
    w = Window.partitionBy("trial_id").orderBy("pos")
    step = points.withColumn("d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    det = F.greatest(F.lit(0.0), F.var_samp("x") * F.var_samp("y") - F.covar_samp("x", "y") * F.covar_samp("x", "y"))
    out = step.groupBy("trial_id").agg((math.pi * 5.991 * F.sqrt(det)).alias("ellipse_area"), F.sum("d").alias("path"), F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("range_x"), (F.max("y") - F.min("y")).alias("range_y"))
    return out.withColumn("speed", C.safe_divide(F.col("path") * rate, F.col("n") - 1)).drop("n")


def derivatives(angles_long: DataFrame, rate: float) -> DataFrame:
    """angles_long with velocity and acceleration by central differences."""
    keys = ["trial_id", "side", "joint"]
    out = series.gradient(angles_long, keys, "value", "velocity", 1.0 / rate)
    return series.gradient(out, keys, "velocity", "acceleration", 1.0 / rate)


#: Groups of which a task holds sums at a time; more go out and begin anew.
_HELD_GROUPS = 256


def _merged_moments(a: tuple[int, np.ndarray, np.ndarray] | None, b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and sum of outer products about the mean of two sets of curves together."""
    if a is None:
        return b
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def waveform_moments(curves: DataFrame, keys: tuple[str, ...] = ("joint", "side")) -> DataFrame:
    """keys, width, n, mean, comoment: number, mean curve and sum of outer products about it (row by row) of the curves (keys, curve) of each length.

    Each task sums up its own curves, and sums are merged twice, by some tasks for a group and then by one; only these
    fixed-size sums are dealt, so that a group may have any number of curves. Curves that are null, empty or have a
    missing value don't count.
    """
    kinds = dict(curves.dtypes)
    keyed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    schema = f"{keyed}, width int, n long, mean array<double>, comoment array<double>"
    usable = F.col("curve").isNotNull() & (F.size("curve") > 0) & F.forall("curve", lambda v: v.isNotNull() & ~F.isnan(v))
    own = curves.filter(usable).select(*keys, F.col("curve").cast("array<double>").alias("curve"))

    def rows(held: dict, template: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], template.field(i).type) for i in range(len(keys))]
        columns += [pa.array([k[-1] for k in held], pa.int32()), pa.array([m[0] for m in held.values()], pa.int64())]
        columns += [pa.array([m[i].ravel() for m in held.values()], pa.list_(pa.float64())) for i in (1, 2)]
        return pa.record_batch(columns, names=[*keys, "width", "n", "mean", "comoment"])

    def partial(batches):
        held: dict = {}
        template = None
        for batch in batches:
            template = batch.schema
            lists = batch.column(len(keys))
            groups: dict = {}
            for k, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)):
                groups.setdefault((*key, len(lists[k])), []).append(k)
            for key, at in groups.items():
                x = lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), key[-1])
                mean = x.mean(axis=0)
                held[key] = _merged_moments(held.get(key), (len(x), mean, (x - mean).T @ (x - mean)))
            if len(held) > _HELD_GROUPS:
                yield rows(held, template)
                held = {}
        if held:
            yield rows(held, template)

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for n, mean, comoment in zip(*(table.column(c).to_pylist() for c in ("n", "mean", "comoment")), strict=True):
            total = _merged_moments(total, (n, np.array(mean), np.array(comoment).reshape(len(mean), -1)))
        key = tuple(table.column(c)[0].as_py() for c in (*keys, "width"))
        return pa.Table.from_batches([rows({key: total}, table.schema)])

    parts = own.mapInArrow(partial, schema)
    by_task = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    return by_task.groupBy(*keys, "width", "salt").applyInArrow(lambda t: merge(t), schema).groupBy(*keys, "width").applyInArrow(lambda t: merge(t), schema)


def waveform_components(curves: DataFrame, n: int = 3, keys: tuple[str, ...] = ("joint", "side")) -> DataFrame:
    """keys, component, explained, mean, loading: principal components of the curves of each group, three curves at least.

    The curves themselves are only summed up (see waveform_moments); a component's largest entry is positive.
    """
    kinds = dict(curves.dtypes)

    def solve(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["n"] < 3:
                    continue
                values, vectors = np.linalg.eigh(np.array(row["comoment"]).reshape(row["width"], -1))
                values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
                total = values.sum()
                for k in range(min(n, row["width"], row["n"])):
                    v = vectors[k] * (np.sign(vectors[k][np.abs(vectors[k]).argmax()]) or 1.0)
                    out.append({c: row[c] for c in keys} | {"component": k, "explained": float(values[k] / total) if total > 0 else 0.0, "mean": row["mean"], "loading": v.tolist()})
            fields = [*(batch.schema.field(c) for c in keys), pa.field("component", pa.int32()), pa.field("explained", pa.float64()), pa.field("mean", pa.list_(pa.float64())), pa.field("loading", pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    keyed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return waveform_moments(curves, keys).mapInArrow(solve, f"{keyed}, component int, explained double, mean array<double>, loading array<double>")


def waveform_scores(curves: DataFrame, components: DataFrame, keys: tuple[str, ...] = ("joint", "side")) -> DataFrame:
    """curves with component and score: each curve's part along each component of its group, of the same length."""
    dot = F.aggregate(F.zip_with(F.zip_with("curve", "mean", lambda v, m: v - m), "loading", lambda d, w: d * w), F.lit(0.0), lambda s, x: s + x)
    joined = curves.join(components.select(*keys, "component", "mean", "loading"), list(keys)).filter(F.size("curve") == F.size("mean"))
    return joined.select(*curves.columns, "component", dot.alias("score"))


def time_frequency(angles_long: DataFrame, rate: float, method: str = "cwt", low: float = 0.5, high: float = 15.0, n: int = 50) -> DataFrame:
    """trial_id, side, joint, frequencies, power (by frequency, over time), dominant frequency."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        v = K.fill_linear(table.column("value").to_numpy().astype(float))
        rows = []
        if len(v) >= 8 and not np.isnan(v).any():
            if method == "stft":
                f, _, power = K.stft_power(v - v.mean(), rate)
                keep = (f >= low) & (f <= high)
                f, power = f[keep], power[keep]
            else:
                f = np.linspace(low, min(high, rate / 2), n)
                power = K.morlet_power(v, rate, f)
            if len(f):
                rows = [{k: table.column(k)[0].as_py() for k in ("trial_id", "side", "joint")} | {"frequencies": f.tolist(), "power": power.tolist(), "dominant": float(f[power.mean(axis=1).argmax()])}]
        return pa.Table.from_pylist(rows, schema=pa.schema([("trial_id", pa.string()), ("side", pa.string()), ("joint", pa.string()), ("frequencies", pa.list_(pa.float64())), ("power", pa.list_(pa.list_(pa.float64()))), ("dominant", pa.float64())]))

    return angles_long.groupBy("trial_id", "side", "joint").applyInArrow(run, "trial_id string, side string, joint string, frequencies array<double>, power array<array<double>>, dominant double")
