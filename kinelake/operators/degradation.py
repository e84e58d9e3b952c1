"""What worse cameras would have seen: fewer frames, coarser pictures, and oblique views, applied to landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.exceptions import InvalidData
from kinelake.operators import pose as P

#: Settings with their least and greatest values; None leaves the recording as it is.
LIMITS = {"target_fps": (1.0, 1000.0), "downscale": (0.05, 1.0), "aspect_ratio": (0.2, 5.0), "perspective_x": (-0.5, 0.5), "perspective_y": (-0.5, 0.5), "noise": (0.0, 0.2)}


def settings(**values: float | None) -> dict[str, float | None]:
    """All settings with the given ones; unknown names and values out of range are refused."""
    for k, v in values.items():
        if k not in LIMITS:
            raise InvalidData(f"no setting {k}")
        if v is not None and not LIMITS[k][0] <= v <= LIMITS[k][1]:
            raise InvalidData(f"{k} has to be within {LIMITS[k]}")
    return dict.fromkeys(LIMITS) | values


def is_active(config: dict) -> bool:
    return any(v is not None and v != (1.0 if k in ("downscale", "aspect_ratio") else 0.0) for k, v in config.items())


def stride(rate: float, target: float | None) -> tuple[int, float]:
    """Every how many frames are kept, and the rate that leaves."""
    n = 1 if not target or target >= rate else max(1, round(rate / target))
    return n, rate / n


def resolution(width: int, height: int, config: dict) -> tuple[int, int]:
    f, a = config.get("downscale") or 1.0, config.get("aspect_ratio") or 1.0
    return max(1, round(width * f * a)), max(1, round(height * f))


def degrade(pose: DataFrame, config: dict, rate: float = 30.0, width: int = 1920, height: int = 1080) -> DataFrame:
    """Poses as the worse camera would have given them: sampled frames, coordinates of whole pixels, keystone, and noise by a hash."""
    n, _ = stride(rate, config.get("target_fps"))
    out = pose.filter(F.col("frame_idx") % n == 0) if n > 1 else pose
    w, h = resolution(width, height, config)
    kx, ky, noise = (config.get(k) or 0.0 for k in ("perspective_x", "perspective_y", "noise"))
    jitter = lambda k, salt: noise * ((F.pmod(F.xxhash64("trial_id", "frame_idx", k, F.lit(salt)), F.lit(20001)) - 10000) / 10000.0)

    def moved(k, p):
        px = 0.5 + (p["x"] - 0.5) / (1.0 + kx * (p["y"] - 0.5)) + (jitter(k, 1) if noise else F.lit(0.0))
        py = 0.5 + (p["y"] - 0.5) / (1.0 + ky * (p["x"] - 0.5)) + (jitter(k, 2) if noise else F.lit(0.0))
        return P._point(F.round(px * w) / w, F.round(py * h) / h, p["visibility"])

    return out.withColumn("landmarks", F.transform_values("landmarks", moved))
