"""Grids of settings over which a comparison runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(*lists: DataFrame) -> DataFrame:
    """All combinations of the rows of small tables of settings. These are product tables of settings, not of data."""
    out = lists[0]
    for more in lists[1:]:
        out = out.crossJoin(more)
    return out


def manifest(runs: DataFrame) -> DataFrame:
    """model, method, variant: runs, failures and mean errors, from a row per run with status and *_rmse_deg columns."""
    errors = [c for c in runs.columns if c.endswith(("_deg", "_ms"))]
    keys = [c for c in ("model", "method", "variant") if c in runs.columns]
    return runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.count_if(F.col("status") != "ok").alias("n_failed"), *[F.avg(c).alias(c) for c in errors])


def run_grid(poses: DataFrame, trials: DataFrame, reference: DataFrame, variants: dict[str, dict], methods: list[str], steps: dict[str, list], rate: float = 30.0) -> DataFrame:
    """Angle errors of every combination: variant, normalization, method, trial_id, joint, side, n and errors.

    variants are settings of operators.degradation by name, steps normalisation chains by name. reference has trial_id,
    frame_idx, side, joint, reference. Combinations are plans over all trials, put together by union: their number is
    that of the settings, not of the data.
    """
    from functools import reduce

    from kinelake.operators import cycles, degradation, events, optical, pose, signals

    parts = []
    for variant, config in variants.items():
        worse = degradation.degrade(poses, config, rate)
        for chain, own in steps.items():
            clean = pose.to_pose(signals.normalize(pose.to_long(worse), own)) if own else worse
            angles = pose.angles_long(pose.canonicalize_signs(pose.compute_angles(clean)))
            errors = optical.error_metrics(angles.join(reference, ["trial_id", "frame_idx", "side", "joint"]), ["trial_id", "side", "joint"])
            for method in methods:
                found = events.detect_events(clean, trials, method)
                n = cycles.segment(found, rate).groupBy("trial_id").agg(F.count("*").alias("n_cycles"))
                parts.append(errors.join(n, "trial_id", "left").select(F.lit(variant).alias("variant"), F.lit(chain).alias("normalization"), F.lit(method).alias("method"), "*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def wide_rows(errors: DataFrame) -> DataFrame:
    """A row per run and trial with a column per joint and measure."""
    keys = ["variant", "normalization", "method", "trial_id"]
    return errors.withColumn("j", F.concat_ws("_", "joint", "side")).groupBy(*keys).pivot("j").agg(F.first("rmse").alias("rmse_deg"), F.first("mae").alias("mae_deg"), F.first("bias").alias("bias_deg"))
