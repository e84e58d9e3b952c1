"""The tables behind figures and reports; drawing is left to whoever shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions import series
from kinelake.operators import analysis, quality
from kinelake.operators import pose as P


def angles_with_events(angles_long: DataFrame, events: DataFrame) -> DataFrame:
    """Angles over frames, with the kinds of events at each."""
    marks = events.groupBy("trial_id", "side", F.col("frame").alias("frame_idx")).agg(F.array_sort(F.collect_set("kind")).alias("events"))
    return angles_long.join(marks, ["trial_id", "side", "frame_idx"], "left")


def phase_plane(angles_long: DataFrame, rate: float) -> DataFrame:
    """Angle against its velocity."""
    return series.gradient(angles_long, ["trial_id", "side", "joint"], "value", "velocity", 1.0 / rate)


def cycle_bands(summary: DataFrame) -> DataFrame:
    """Mean curves with one deviation below and above."""
    return summary.withColumns({"lower": F.col("mean") - F.col("std"), "upper": F.col("mean") + F.col("std")})


def normative_comparison(summary: DataFrame, normative: DataFrame) -> DataFrame:
    """Mean curves beside the normative band, and how many deviations they are off."""
    norm = normative.select("joint", "p", F.col("mean").alias("norm"), "sd")
    return summary.join(norm, ["joint", "p"]).withColumn("z", (F.col("mean") - F.col("norm")) / F.col("sd"))


def score_profile(gvs: DataFrame) -> DataFrame:
    """Variable scores with a band: good below 5, fair up to 10, else poor."""
    return gvs.withColumn("band", F.when(F.col("gvs") < 5, "good").when(F.col("gvs") <= 10, "fair").otherwise("poor"))


def quality_dashboard(pose: DataFrame) -> dict[str, DataFrame]:
    """Detection by landmark and time, scores with a band, and gaps."""
    scores = quality.quality_score(pose).withColumn("band", F.when(F.col("score") >= 80, "good").when(F.col("score") >= 50, "fair").otherwise("poor"))
    return {"detection": quality.detection_matrix(pose), "scores": scores, "gaps": series.gap_runs(P.to_long(pose), ["trial_id", "name"], "x")}


def longitudinal(figures: DataFrame, sessions: DataFrame, metric: str) -> DataFrame:
    """A figure by session of each subject (sessions: trial_id, subject, session), with the change since the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("subject").orderBy("session")
    return figures.join(sessions, "trial_id").select("subject", "session", F.col(metric).alias("value")).withColumn("change", F.col("value") - F.lag("value").over(w))


def session_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean curves of two sessions (side, joint, p, mean) and their difference."""
    keys = ["side", "joint", "p"]
    return a.select(*keys, F.col("mean").alias("a")).join(b.select(*keys, F.col("mean").alias("b")), keys).withColumn("difference", F.col("b") - F.col("a"))


def arm_swing_curves(cycles: DataFrame, extended: DataFrame) -> DataFrame:
    """Shoulder curves over cycles: trial_id, cycle_id, side, joint, curve."""
    from kinelake.operators.cycles import curves

    rows = F.array(F.struct(F.lit("left").alias("side"), F.col("shoulder_flex_L").alias("value")), F.struct(F.lit("right").alias("side"), F.col("shoulder_flex_R").alias("value")))
    long = extended.select("trial_id", "frame_idx", F.explode(rows).alias("r")).select("trial_id", "frame_idx", "r.side", F.lit("shoulder").alias("joint"), "r.value")
    return curves(cycles, long)


def cadence_profile(events: DataFrame, rate: float) -> DataFrame:
    """Cadence between successive contacts over time."""
    own = analysis.contacts(events).filter(F.col("next_frame") > F.col("frame"))
    return own.select("trial_id", ((F.col("frame") + F.col("next_frame")) / (2.0 * rate)).alias("time"), (60.0 * rate / (F.col("next_frame") - F.col("frame"))).alias("cadence"))


def rom_comparison(roms: DataFrame, normative: DataFrame) -> DataFrame:
    """Ranges of motion beside those of the normative curves."""
    norm = normative.groupBy("joint").agg((F.max("mean") - F.min("mean")).alias("norm_rom"))
    return roms.select("trial_id", "side", "joint", "rom_mean", "rom_std").join(norm, "joint", "left")


def butterfly(summary: DataFrame, joint: str) -> DataFrame:
    """A joint's left and right mean curves beside each other."""
    return summary.filter(F.col("joint") == joint).groupBy("trial_id", "p").pivot("side", ["left", "right"]).agg(F.first("mean"))


def overlay(pose: DataFrame, angles: DataFrame, events: DataFrame) -> DataFrame:
    """A row per frame with landmarks, angles and event labels: what a video overlay draws."""
    labels = events.groupBy("trial_id", F.col("frame").alias("frame_idx")).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "side", "kind"))).alias("labels"))
    return pose.join(angles.drop("pos"), ["trial_id", "frame_idx"], "left").join(labels, ["trial_id", "frame_idx"], "left")


#: Headings by language.
HEADINGS = {"en": {"figures": "Figures", "flags": "Findings", "scores": "Scores"}, "fr": {"figures": "Paramètres", "flags": "Constats", "scores": "Scores"}}


def report(figures: DataFrame, flags: DataFrame, gps: DataFrame, language: str = "en") -> DataFrame:
    """name, content: a short text report of each trial."""
    words = HEADINGS[language]
    own = [c for c, t in figures.dtypes if c != "trial_id" and t in ("double", "bigint")]
    lines = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"- {c}: "), F.format_string("%.3f", F.col(c).cast("double")))) for c in own]))
    score = gps.groupBy("trial_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "side", F.lit(": "), F.format_string("%.2f", "gps")))), "\n").alias("scores"))
    j = figures.withColumn("lines", lines).join(flags, "trial_id", "left").join(score, "trial_id", "left")
    part = lambda k, c: F.concat(F.lit(f"\n## {words[k]}\n\n"), F.coalesce(c, F.lit("")), F.lit("\n"))
    return j.select(F.concat("trial_id", F.lit(".md")).alias("name"), F.concat(F.lit("# "), "trial_id", F.lit("\n"), part("figures", F.array_join("lines", "\n")), part("flags", F.array_join(F.transform("flags", lambda f: F.concat(F.lit("- "), f)), "\n")), part("scores", F.col("scores"))).alias("content"))
