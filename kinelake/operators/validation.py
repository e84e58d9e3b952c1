"""Checks of angles and spatiotemporal figures against ranges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import columns as C

# Usual ranges of adults in degrees, as whole cycle, stance and swing.
ANGLE_RANGES = {
    "hip": {"full": (-20, 50), "stance": (-10, 40), "swing": (0, 50)},
    "knee": {"full": (-5, 75), "stance": (-5, 20), "swing": (20, 75)},
    "ankle": {"full": (-30, 30), "stance": (-15, 20), "swing": (-10, 10)},
    "trunk": {"full": (-10, 20)},
    "pelvis": {"full": (-15, 15)},
    "pelvis_list": {"full": (-5, 10)},
    "hip_adduction": {"full": (-5, 15)},
    "knee_valgus": {"full": (-5, 15)},
}
# Usual ranges of adults.
SPATIOTEMPORAL_RANGES = {
    "cadence_steps_per_min": (80, 140),
    "stride_time_mean_s": (0.8, 1.6),
    "step_time_mean_s": (0.4, 0.8),
    "stance_pct": (55, 65),
    "swing_pct": (35, 45),
    "double_support_pct": (10, 30),
}


# How far ranges reach further down and up, by stratum, joint and phase.
WIDER = {
    "elderly": {
        ("hip", "full"): (5, 0), ("hip", "stance"): (5, 0),
        ("knee", "full"): (0, 5), ("knee", "swing"): (0, 5),
        ("ankle", "full"): (5, 5),
        ("trunk", "full"): (5, 5), ("pelvis", "full"): (5, 5),
        ("pelvis_list", "full"): (2, 2), ("hip_adduction", "full"): (2, 2), ("knee_valgus", "full"): (2, 2),
    },
    "pediatric": {
        ("hip", "full"): (5, 5), ("hip", "stance"): (5, 5),
        ("knee", "full"): (5, 10), ("knee", "swing"): (5, 10),
        ("ankle", "full"): (5, 5),
        ("trunk", "full"): (3, 3), ("pelvis", "full"): (3, 3),
        ("pelvis_list", "full"): (3, 3), ("hip_adduction", "full"): (3, 3), ("knee_valgus", "full"): (3, 3),
    },
}
# Ranges that a stratum has of its own.
STRATUM_RANGES = {
    "elderly": {"cadence_steps_per_min": (60, 130), "stride_time_mean_s": (0.9, 1.8), "step_time_mean_s": (0.45, 0.9)},
    "pediatric": {"cadence_steps_per_min": (100, 170), "stride_time_mean_s": (0.6, 1.3), "step_time_mean_s": (0.3, 0.65)},
}
# Shifts of the lower and the upper bound, and the least lower and greatest upper one that they may give.
SHIFTS = {
    "F": {"cadence_steps_per_min": (5, 5, -1e9, 1e9), "stride_time_mean_s": (-0.05, -0.05, -1e9, 1e9), "step_time_mean_s": (-0.02, -0.02, -1e9, 1e9)},
    "slow": {"cadence_steps_per_min": (-20, -10, 40, 1e9), "stride_time_mean_s": (0.1, 0.3, -1e9, 1e9), "step_time_mean_s": (0.05, 0.15, -1e9, 1e9)},
    "fast": {"cadence_steps_per_min": (10, 20, -1e9, 200), "stride_time_mean_s": (-0.15, -0.1, 0.4, 1e9), "step_time_mean_s": (-0.08, -0.05, 0.2, 1e9)},
}


def ranges(spark: SparkSession) -> DataFrame:
    """joint, phase, lo, hi."""
    return spark.createDataFrame(pa.Table.from_pylist([{"joint": j, "phase": p, "lo": float(lo), "hi": float(hi)} for j, own in ANGLE_RANGES.items() for p, (lo, hi) in own.items()]))


def adjusted(spark: SparkSession, age: int | None = None) -> DataFrame:
    """joint, phase, lo, hi: the usual ranges, widened for children (under 18) and the old (from 65)."""
    more = WIDER.get(_stratum(age), {})
    rows = []
    for joint, own in ANGLE_RANGES.items():
        for phase, (lo, hi) in own.items():
            below, above = more.get((joint, phase), (0, 0))
            rows.append({"joint": joint, "phase": phase, "lo": float(lo - below), "hi": float(hi + above)})
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def _stratum(age: int | None) -> str:
    return "adult" if age is None else "pediatric" if age < 18 else "elderly" if age >= 65 else "adult"


def spatiotemporal_ranges(age: int | None = None, sex: str | None = None, speed: str | None = None) -> dict[str, tuple[float, float]]:
    """Ranges by parameter for a stratum, shifted for women and for slow or fast walking."""
    out = {k: (float(lo), float(hi)) for k, (lo, hi) in (SPATIOTEMPORAL_RANGES | STRATUM_RANGES.get(_stratum(age), {})).items()}
    for shifts in (SHIFTS.get((sex or "").upper(), {}), SHIFTS.get((speed or "").lower(), {})):
        for name, (low, high, least, most) in shifts.items():
            lo, hi = out[name]
            out[name] = (max(least, lo + low), min(most, hi + high))
    return out


def severity(share: Column) -> Column:
    """From the percentage outside: over 50 critical, over 20 warning, over 5 info, else none."""
    return F.when(share > 50, "critical").when(share > 20, "warning").when(share > 5, "info")


def check_ranges(values: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, joint, n, outside (percent), severity of values (keys, joint, value) against ranges (joint, lo, hi); only violations."""
    joined = values.filter(F.col("value").isNotNull()).join(table.select("joint", "lo", "hi"), "joint")
    share = F.avg(F.when(F.col("value").between(F.col("lo"), F.col("hi")), 0.0).otherwise(100.0))
    out = joined.groupBy(*keys, "joint").agg(F.count("*").alias("n"), share.alias("outside"))
    return out.withColumn("severity", severity(F.col("outside"))).filter(F.col("severity").isNotNull())


def check_angles(angles_long: DataFrame, table: DataFrame) -> DataFrame:
    return check_ranges(angles_long, table.filter("phase = 'full'"), ["trial_id", "side"])


def check_phases(curves: DataFrame, cycles: DataFrame, table: DataFrame, margin: float = 10.0) -> DataFrame:
    """trial_id, cycle_id, side, joint, phase, low, high of curves that leave a phase's range by more than a margin."""
    split = curves.join(cycles.select("trial_id", "cycle_id", F.coalesce("stance_pct", F.lit(60.0)).alias("__s")), ["trial_id", "cycle_id"])
    split = split.withColumn("__n", F.least(F.size("curve") - 1, F.greatest(F.lit(1), F.floor(F.col("__s")).cast("int"))))
    parts = F.array(F.struct(F.lit("stance").alias("phase"), F.slice("curve", 1, F.col("__n")).alias("c")), F.struct(F.lit("swing").alias("phase"), F.slice("curve", F.col("__n") + 1, F.size("curve")).alias("c")))
    long = split.select("trial_id", "cycle_id", "side", "joint", F.explode(parts).alias("x")).select("trial_id", "cycle_id", "side", "joint", F.col("x.phase").alias("phase"), F.array_min("x.c").alias("low"), F.array_max("x.c").alias("high"))
    return long.join(table, ["joint", "phase"]).filter((F.col("low") < F.col("lo") - margin) | (F.col("high") > F.col("hi") + margin)).select("trial_id", "cycle_id", "side", "joint", "phase", "low", "high")


def check_cadence(events: DataFrame, low: float = 80.0, high: float = 140.0) -> DataFrame:
    """trial_id, cadence of trials with at least three contacts whose cadence is outside."""
    gaps = events.filter("kind = 'hs'").groupBy("trial_id").agg(F.count("*").alias("n"), C.safe_divide(60.0 * (F.count("*") - 1), F.max("time") - F.min("time")).alias("cadence"))
    return gaps.filter((F.col("n") >= 3) & ~F.col("cadence").between(low, high)).select("trial_id", "cadence")


def check_spatiotemporal(figures: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """trial_id, parameter, value, lo, hi of figures (a column per parameter) outside their range, adults' by default."""
    rows = [F.struct(F.lit(k).alias("parameter"), F.col(k).cast("double").alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for k, (lo, hi) in (ranges or SPATIOTEMPORAL_RANGES).items() if k in figures.columns]
    return figures.select("trial_id", F.explode(F.array(*rows)).alias("r")).select("trial_id", "r.*").filter(~F.col("value").between(F.col("lo"), F.col("hi")))


def caveats(trials: DataFrame) -> DataFrame:
    """trial_id, parameter, severity, description: what to bear in mind with a trial's results, from what is known of it."""
    note = lambda when, parameter, text: F.when(when, F.struct(F.lit(parameter).alias("parameter"), F.lit("info").alias("severity"), F.lit(text).alias("description")))
    height = F.col("subject.height_m")
    notes = F.array_compact(F.array(
        note(F.coalesce(F.col("extraction.treadmill"), F.lit(False)), "treadmill_context", "On a treadmill, lengths and speeds from the way through the picture come out too small."),
        note(height.isNull() | (height == 0), "calibration", "Without the subject's height, lengths and speeds have no unit and can't be compared between subjects or sessions."),
        note(F.lit(True), "pathology_screening", "Patterns found by rule are hints for screening, to be read with a clinical examination."),
    ))
    return trials.select("trial_id", F.explode(notes).alias("n")).select("trial_id", "n.*")


# Published accuracy by pose model, as mean error in pixels and share of correct key points at 0.05.
MODEL_ACCURACY = {
    "mediapipe": (5.0, 0.92),
    "yolo": (4.0, 0.94),
    "vitpose": (3.0, 0.96),
    "sapiens": (2.5, 0.97),
    "rtmw": (3.5, 0.95),
    "mmpose": (3.0, 0.96),
    "hrnet": (3.0, 0.96),
}


def model_accuracy(trials: DataFrame) -> DataFrame:
    """trial_id, model, mae_px, pck_05: the accuracy published for each trial's pose model, null where there is none."""
    known = F.create_map(*[c for m, (e, k) in MODEL_ACCURACY.items() for c in (F.lit(m), F.struct(F.lit(e).alias("mae_px"), F.lit(k).alias("pck_05")))])
    return trials.select("trial_id", F.col("extraction.model").alias("model"), known[F.col("extraction.model")].alias("a")).select("trial_id", "model", "a.mae_px", "a.pck_05")
