"""Deviation scores of mean curves from normative ones."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions import columns as C


def variable_scores(summaries: DataFrame, normative: DataFrame, keys: tuple[str, ...] = ("trial_id", "side", "joint"), digits: int | None = 2) -> DataFrame:
    """keys, gvs: root mean square distance of each mean curve from the normative one of its joint.

    normative: joint, p, mean, sd of one stratum; a table of fixed, small size, so Spark is free to broadcast it.
    """
    norm = normative.select("joint", "p", F.col("mean").alias("__norm"))
    gvs = summaries.join(norm, ["joint", "p"]).groupBy(*keys).agg(C.rms(F.col("mean") - F.col("__norm")).alias("gvs"))
    return gvs if digits is None else gvs.withColumn("gvs", F.round("gvs", digits))


def profile_score(gvs: DataFrame) -> DataFrame:
    """trial_id, side (left, right, overall), gps: root mean square of the variable scores, overall over both sides' together."""
    rolled = gvs.rollup("trial_id", "side").agg(C.rms("gvs").alias("gps"), F.grouping_id().alias("__g"))
    return rolled.filter("__g <= 1").select("trial_id", F.when(F.col("__g") == 1, "overall").otherwise(F.col("side")).alias("side"), "gps")


# Joints that every score is judged by; those of other planes count where a trial has them.
SCORE_JOINTS = ("hip", "knee", "ankle", "trunk")


def deviation_index(gps: DataFrame, normative: DataFrame, gvs: DataFrame | None = None) -> DataFrame:
    """trial_id, side, sdi: 100 for the expected score, 10 less for each reference deviation above it, within 0 and 120.

    The expected score is the mean of the joints' mean normative deviations: of all joints of ``normative``, or with
    ``gvs`` of SCORE_JOINTS and of those that a trial has variable scores for.
    """
    by_joint = normative.groupBy("joint").agg(F.avg("sd").alias("sd"))
    expected = [F.avg("sd").alias("__ref"), F.greatest(F.stddev_pop("sd"), F.lit(1.0)).alias("__sd")]
    if gvs is None:
        scored = gps.crossJoin(F.broadcast(by_joint.agg(*expected)))  # one row
    else:
        always = F.explode(F.array(*map(F.lit, SCORE_JOINTS))).alias("joint")
        judged = gps.select("trial_id").distinct().select("trial_id", always).union(gvs.select("trial_id", "joint")).distinct()
        scored = gps.join(judged.join(by_joint, "joint").groupBy("trial_id").agg(*expected), "trial_id")
    return scored.select("trial_id", "side", F.round(C.clip(100.0 - 10.0 * (F.col("gps") - F.col("__ref")) / F.col("__sd"), 0.0, 120.0), 1).alias("sdi"))


def gait_deviation_index_2d(gps: DataFrame, normative: DataFrame, gvs: DataFrame | None = None) -> DataFrame:
    """The former name of deviation_index."""
    warnings.warn("use deviation_index", DeprecationWarning, stacklevel=2)
    return deviation_index(gps, normative, gvs)


def movement_profile(gvs: DataFrame) -> DataFrame:
    """trial_id, joint, left, right."""
    return gvs.groupBy("trial_id", "joint").pivot("side", ["left", "right"]).agg(F.first("gvs"))
