"""Pose backends by name, and what remains of them in tables: decoding of heat maps and mapping of key points.

Networks run elsewhere; their output comes as rows. A backend that runs in Spark registers a function over batches of
pictures, which then is loaded once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.exceptions import UnknownName
from kinelake.functions import columns as C
from kinelake.schemas import COCO_17, MEDIAPIPE_33

# Layouts of the known backends.
LAYOUTS = {
    "mediapipe": "MEDIAPIPE_33", "yolo": "COCO_17", "vitpose": "COCO_17", "vitpose-large": "COCO_17", "vitpose-huge": "COCO_17", "rtmw": "COCO_17+WHOLEBODY_133",
    "hrnet": "COCO_17", "mmpose": "COCO_17", "openpose": "COCO_17", "alphapose": "COCO_17", "detectron2": "COCO_17",
    "sapiens-quick": "COCO_17+GOLIATH_308", "sapiens-mid": "COCO_17+GOLIATH_308", "sapiens-top": "COCO_17+GOLIATH_308",
    "sapiens2-quick": "COCO_17+GOLIATH_308", "sapiens2-mid": "COCO_17+GOLIATH_308", "sapiens2-top": "COCO_17+GOLIATH_308", "sapiens2-ultra": "COCO_17+GOLIATH_308",
}
_RUNNERS: dict[str, Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]] = {}


def list_models() -> list[str]:
    return list(LAYOUTS)


def available_models() -> dict[str, bool]:
    """Which backends have a runner in this session."""
    return {name: name in _RUNNERS for name in LAYOUTS}


def names_of(model: str) -> list[str]:
    """Landmark names of a backend's main layout, in order."""
    if model not in LAYOUTS:
        raise UnknownName(model)
    return MEDIAPIPE_33 if LAYOUTS[model].startswith("MEDIAPIPE") else COCO_17


def register_runner(model: str, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> None:
    """Add a backend: a function from batches (trial_id, frame_idx, image) to batches with points (x, y, score triples)."""
    LAYOUTS.setdefault(model, "COCO_17")
    _RUNNERS[model] = run


def estimate(images: DataFrame, model: str) -> DataFrame:
    """trial_id, frame_idx, points of pictures (trial_id string, frame_idx int, image binary), by a registered runner."""
    if model not in _RUNNERS:
        raise UnknownName(model)
    return images.select("trial_id", "frame_idx", "image").mapInPandas(_RUNNERS[model], "trial_id string, frame_idx int, points array<array<double>>")


def heatmap_peaks(maps: DataFrame, width: int) -> DataFrame:
    """Rows (.., map: values row by row) with px, py and score of each map's greatest value, the first of equal ones."""
    at = F.array_position("map", F.array_max("map")) - 1
    return maps.withColumns({"px": (at % width).cast("double"), "py": F.floor(at / width).cast("double"), "score": F.array_max("map")})


def unletterbox(px: Column, py: Column, map_size: tuple[int, int], image_width: Column, image_height: Column) -> tuple[Column, Column]:
    """Shares of the picture from places in a map that holds it whole, with bars at two sides."""
    w, h = map_size
    scale = F.least(F.lit(float(w)) / image_width, F.lit(float(h)) / image_height)
    bar_x, bar_y = (w - image_width * scale) / 2, (h - image_height * scale) / 2
    return C.clip((px - bar_x) / (image_width * scale), 0.0, 1.0), C.clip((py - bar_y) / (image_height * scale), 0.0, 1.0)


def sample_map(values: Column, width: int, height: int, x: Column, y: Column) -> Column:
    """The value of a map (row by row) under a landmark."""
    column = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.floor(x * width).cast("int")))
    row = F.greatest(F.lit(0), F.least(F.lit(height - 1), F.floor(y * height).cast("int")))
    return F.get(values, row * width + column)


def select_person(candidates: DataFrame, strategy: str = "largest", box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """One person a frame of candidates (trial_id, frame_idx, person, x0, y0, x1, y1, score): the largest, the surest, or that most within a box."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    if strategy == "box" and box:
        inner = F.greatest(F.lit(0.0), F.least("x1", F.lit(box[2])) - F.greatest("x0", F.lit(box[0]))) * F.greatest(F.lit(0.0), F.least("y1", F.lit(box[3])) - F.greatest("y0", F.lit(box[1])))
        rank = inner
    elif strategy in ("largest", "surest"):
        rank = area if strategy == "largest" else F.col("score")
    else:
        raise UnknownName(strategy)
    rest = [c for c in candidates.columns if c not in ("trial_id", "frame_idx")]
    best = candidates.groupBy("trial_id", "frame_idx").agg(F.max_by(F.struct(*rest), F.struct(rank, -F.col("person"))).alias("b"))
    return best.select("trial_id", "frame_idx", "b.*")


def goliath_to_mediapipe(points: DataFrame, mapping: DataFrame) -> DataFrame:
    """Poses from extra key points (trial_id, frame_idx, idx, x, y, confidence) by a table (idx, name); several of a name are averaged."""
    named = points.join(mapping, "idx").filter(F.col("x").isNotNull()).groupBy("trial_id", "frame_idx", "name").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("confidence").alias("visibility"))
    entry = F.struct("name", F.struct("x", "y", "visibility").alias("p"))
    return named.groupBy("trial_id", "frame_idx").agg(F.map_from_entries(F.collect_list(entry)).alias("landmarks"))


def enrich_feet(pose: DataFrame, extra: DataFrame, least: float = 0.1) -> DataFrame:
    """Heels and toes of extra key points (trial_id, frame_idx, name, x, y, confidence) put into poses that lack them."""
    own = extra.filter((F.col("confidence") >= least) & F.col("name").rlike("HEEL|FOOT_INDEX|TOE")).groupBy("trial_id", "frame_idx").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("x", "y", F.col("confidence").alias("visibility")).alias("p")))).alias("__more"))
    seen = F.map_filter("landmarks", lambda k, p: C.clean(p["x"]).isNotNull())
    joined = pose.join(own, ["trial_id", "frame_idx"], "left").withColumn("__seen", seen)
    added = F.map_filter("__more", lambda k, p: ~F.array_contains(F.map_keys("__seen"), k))
    return joined.withColumn("landmarks", F.when(F.col("__more").isNull(), F.col("landmarks")).otherwise(F.map_concat("__seen", added))).drop("__more", "__seen")
