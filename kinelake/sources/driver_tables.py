"""Generic tables as motion data: what an ordered stream of events offers as series, gait events and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.series import as_series

#: Which event types stand for contacts and lift-offs of which side.
GAIT = {"click": ("left", "hs"), "view": ("left", "to"), "purchase": ("right", "hs"), "signup": ("right", "to")}


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial_id (the user), pos (by time), event_type, value."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    return as_series(rows, ["user_id"], ["ts", "event_id"]).select(F.col("user_id").alias("trial_id"), "pos", "event_type", "value")


def gait_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial_id, side, kind, frame."""
    kind = F.create_map(*[x for t, (s, k) in GAIT.items() for x in (F.lit(t), F.struct(F.lit(s).alias("side"), F.lit(k).alias("kind")))])
    return event_series(spark, sf_dir).withColumn("g", kind[F.col("event_type")]).filter(F.col("g").isNotNull()).select("trial_id", F.col("g.side").alias("side"), F.col("g.kind").alias("kind"), F.col("pos").alias("frame"))


def vector_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial_id (vec_id div 10), cycle_id (vec_id), side, joint, curve: embeddings as curves in degrees, sides taking turns."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    joint = F.element_at(F.array(*[F.lit(j) for j in ("hip", "knee", "ankle")]), (F.pmod("label", F.lit(3)) + 1).cast("int"))
    return rows.select(F.floor(F.col("vec_id") / 10).alias("trial_id"), F.col("vec_id").alias("cycle_id"), F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right").alias("side"), joint.alias("joint"), F.transform("embedding", lambda v: v.cast("double") * 60.0).alias("curve"))


#: Landmarks that the first 42 numbers of a vector stand for, x and y in turn.
VECTOR_LANDMARKS = (
    "NOSE LEFT_EYE RIGHT_EYE LEFT_EAR RIGHT_EAR LEFT_SHOULDER RIGHT_SHOULDER LEFT_ELBOW RIGHT_ELBOW LEFT_WRIST RIGHT_WRIST "
    "LEFT_HIP RIGHT_HIP LEFT_KNEE RIGHT_KNEE LEFT_ANKLE RIGHT_ANKLE LEFT_HEEL RIGHT_HEEL LEFT_FOOT_INDEX RIGHT_FOOT_INDEX"
).split()


def vector_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses from embeddings: 20 frames a trial, coordinates about 0.5, visibility and confidence from later numbers."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    point = [F.struct((F.get("e", F.lit(2 * k)) + 0.5).alias("x"), (F.get("e", F.lit(2 * k + 1)) + 0.5).alias("y"), F.least(F.lit(1.0), F.abs(F.get("e", F.lit(42 + k))) * 5.0).alias("visibility")) for k in range(len(VECTOR_LANDMARKS))]
    frame = (F.col("vec_id") % 20).cast("int")
    return rows.select(F.floor(F.col("vec_id") / 20).alias("trial_id"), frame.alias("frame_idx"), frame.alias("pos"), (frame / 4.0).alias("time_s"), F.least(F.lit(1.0), F.abs(F.get("e", F.lit(63))) * 5.0).alias("confidence"), F.map_from_arrays(F.array(*map(F.lit, VECTOR_LANDMARKS)), F.array(*point)).alias("landmarks"))
