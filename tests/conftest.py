"""One small session for all tests, and made-up recordings."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import numpy as np
import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from kinelake.schemas import DOCUMENT  # noqa: E402

NAMES = (
    "NOSE LEFT_EYE RIGHT_EYE LEFT_EAR RIGHT_EAR LEFT_SHOULDER RIGHT_SHOULDER LEFT_ELBOW RIGHT_ELBOW LEFT_WRIST RIGHT_WRIST "
    "LEFT_HIP RIGHT_HIP LEFT_KNEE RIGHT_KNEE LEFT_ANKLE RIGHT_ANKLE LEFT_HEEL RIGHT_HEEL LEFT_FOOT_INDEX RIGHT_FOOT_INDEX"
).split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def standing() -> dict[str, tuple[float, float]]:
    at = {"NOSE": (0.5, 0.15), "SHOULDER": (0.5, 0.25), "ELBOW": (0.5, 0.38), "WRIST": (0.5, 0.48), "HIP": (0.5, 0.5), "KNEE": (0.5, 0.65), "ANKLE": (0.5, 0.8), "HEEL": (0.49, 0.82), "FOOT_INDEX": (0.53, 0.82), "EYE": (0.51, 0.14), "EAR": (0.49, 0.15)}
    return {n: at[n if n == "NOSE" else n.split("_", 1)[1]] for n in NAMES}


def walking(n: int = 300, rate: float = 30.0, trial: str = "walk", period: float = 1.0, speed: float = 0.0) -> dict:
    """A sinusoidal walk as a document; the right side is half a period behind."""
    frames = []
    for i in range(n):
        t = i / rate
        points = standing()
        for side, phase in (("LEFT", 0.0), ("RIGHT", math.pi)):
            a = math.sin(2 * math.pi * t / period + phase)
            shift = 0.0 if side == "LEFT" else 0.01
            for name, swing in (("KNEE", 0.04), ("ANKLE", 0.08), ("HEEL", 0.08), ("FOOT_INDEX", 0.08)):
                x, y = points[f"{side}_{name}"]
                points[f"{side}_{name}"] = (x + swing * a + shift, y)
            for name, swing in (("ELBOW", 0.02), ("WRIST", 0.04)):
                x, y = points[f"{side}_{name}"]
                points[f"{side}_{name}"] = (x - swing * a + shift, y)
        frames.append({"frame_idx": i, "time_s": round(t, 4), "confidence": 0.9, "landmarks": {k: {"x": x + speed * t, "y": y, "visibility": 1.0} for k, (x, y) in points.items()}})
    return {"trial_id": trial, "meta": {"source": "made", "fps": rate, "width": 1920, "height": 1080, "n_frames": n, "duration_s": n / rate}, "extraction": {"model": "made"}, "subject": {"age": 30, "height_m": 1.7}, "frames": frames}


def as_documents(spark, docs: list[dict]):
    return spark.createDataFrame(docs, DOCUMENT)


@pytest.fixture(scope="session")
def walk(spark):
    return as_documents(spark, [walking(trial="a"), walking(trial="b", period=1.2)]).cache()


@pytest.fixture()
def rng():
    return np.random.default_rng(42)


DATA = "/root/testdata/sf0.001"
requires_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
