"""Normative curves by stratum: a small table built from key points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.exceptions import UnknownName

STRATA = ("adult", "elderly", "pediatric")
# Factors of range and deviation by stratum.
FACTORS = {"adult": (1.0, 1.0), "elderly": (0.8, 1.3), "pediatric": (1.05, 1.4)}
_EVERY_4 = [*range(0, 101, 4)]
# Key points of the adult curves as percent of the cycle, mean and standard deviation in degrees.
KEY_POINTS = {
    "hip": (
        _EVERY_4,
        [21.6, 20.1, 18.9, 17.6, 13.6, 8.8, 3.7, -0.9, -5.1, -9.1, -12.7, -15.7, -17.8, -19.3, -18.5, -13.6, -6.2, 1.9, 9.2, 14.9, 19.0, 21.5, 22.2, 21.3, 20.2, 20.4],
        [7.2, 6.6, 6.6, 6.9, 6.6, 6.3, 5.9, 5.4, 4.8, 4.3, 4.1, 4.0, 4.2, 4.5, 5.3, 5.9, 6.0, 5.5, 4.8, 4.6, 4.4, 4.3, 4.2, 4.1, 4.5, 4.7],
    ),
    "knee": (
        _EVERY_4,
        [5.2, 8.3, 14.3, 19.7, 19.0, 16.4, 13.0, 9.6, 7.0, 5.4, 5.0, 5.8, 8.5, 14.1, 23.6, 37.6, 51.4, 60.7, 63.9, 60.9, 52.8, 40.6, 25.2, 9.3, 4.0, 4.3],
        [5.6, 4.4, 6.1, 7.2, 7.5, 6.7, 5.4, 4.2, 3.4, 3.0, 3.0, 3.4, 4.1, 5.2, 6.5, 6.9, 5.4, 4.2, 3.9, 4.6, 5.8, 6.6, 6.8, 4.6, 2.8, 2.7],
    ),
    "ankle": (
        _EVERY_4,
        [6.9, -1.0, -4.2, -0.7, 1.9, 3.8, 5.0, 5.9, 7.0, 8.2, 9.9, 11.7, 12.8, 11.6, 4.9, -8.9, -19.2, -14.7, -8.0, -2.8, 0.7, 2.7, 3.4, 3.7, 4.7, 6.3],
        [8.0, 6.3, 5.0, 3.8, 4.0, 4.0, 3.8, 3.4, 3.1, 3.3, 3.8, 4.6, 5.0, 5.7, 8.0, 9.0, 7.2, 5.4, 4.8, 3.8, 3.2, 2.8, 2.8, 3.7, 3.3, 4.3],
    ),
    "trunk": ([0, 30, 62, 85, 100], [3, 1, 5, 2, 3], [3, 3, 4, 3, 3]),
    "pelvis_sagittal": (
        _EVERY_4,
        [8.9, 8.3, 8.1, 7.1, 6.6, 7.1, 7.8, 8.6, 9.1, 9.5, 9.9, 10.2, 10.3, 10.2, 10.1, 9.8, 8.9, 8.4, 8.3, 8.4, 8.5, 8.5, 8.6, 8.8, 8.9, 8.8],
        [4.8, 5.3, 5.2, 5.4, 5.2, 5.1, 5.1, 5.3, 5.2, 5.3, 5.2, 5.0, 5.1, 5.4, 5.7, 5.9, 5.8, 5.7, 5.5, 5.5, 5.4, 5.3, 5.2, 5.1, 5.0, 5.1],
    ),
    "pelvis_obliquity": ([0, 15, 30, 50, 60, 75, 90, 100], [2, 4, 3, 0, -1, 1, 3, 2], [3, 3, 2, 3, 4, 5, 4, 3]),
    "hip_adduction": ([0, 10, 30, 50, 60, 75, 90, 100], [2, 6, 5, 4, 1, 2, 3, 2], [3, 3, 2, 3, 4, 5, 4, 3]),
    "knee_valgus": ([0, 12, 30, 50, 60, 75, 90, 100], [3, 5, 3, 2, 2, 1, 2, 3], [3, 3, 2, 3, 4, 5, 4, 3]),
}


def curve(joint: str, stratum: str = "adult") -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation at 0 to 100 percent. Other strata scale the adult range about its mean, and the deviation."""
    if joint not in KEY_POINTS or stratum not in FACTORS:
        raise UnknownName(f"{joint}, {stratum}")
    at, mean, sd = KEY_POINTS[joint]
    p = np.arange(101.0)
    m, s = np.interp(p, at, mean), np.interp(p, at, sd)
    reach, spread = FACTORS[stratum]
    return m.mean() + (m - m.mean()) * reach, s * spread


def table(spark: SparkSession) -> DataFrame:
    """stratum, joint, p, mean, sd: 2424 rows, which the plan holds itself, so that Spark knows their size."""
    curves = [(stratum, joint, *curve(joint, stratum)) for stratum in STRATA for joint in KEY_POINTS]
    columns = {"stratum": [s for s, *_ in curves for _ in range(101)], "joint": [j for _, j, *_ in curves for _ in range(101)], "p": pa.array(list(range(101)) * len(curves), pa.int32()), "mean": np.concatenate([m for *_, m, _ in curves]), "sd": np.concatenate([s for *_, s in curves])}
    return spark.createDataFrame(pa.table(columns))


def band(normative: DataFrame, n_sd: float = 1.0) -> DataFrame:
    return normative.withColumns({"lower": F.col("mean") - n_sd * F.col("sd"), "upper": F.col("mean") + n_sd * F.col("sd")})


def stratum_of(age: Column) -> Column:
    return F.when(age < 18, "pediatric").when(age >= 65, "elderly").otherwise("adult")


def joints() -> list[str]:
    return list(KEY_POINTS)


def strata() -> list[str]:
    return list(STRATA)
