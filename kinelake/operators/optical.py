"""Comparison with optical recordings: offset, alignment, and errors; marker names and their conventions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.exceptions import SyncFailed
from kinelake.functions import columns as C
from kinelake.functions import kernels as K
from kinelake.operators.guard import failures, status
from kinelake.schemas import DOCUMENT, FRAME

# Marker labels of common conventions by landmark; all that a recording has of a landmark's are averaged.
CONVENTIONS = {
    "plug_in_gait": {
        "LEFT_HIP": ["LASI", "LPSI", "LHJC"],
        "RIGHT_HIP": ["RASI", "RPSI", "RHJC"],
        "LEFT_KNEE": ["LKNE", "LTHI"],
        "RIGHT_KNEE": ["RKNE", "RTHI"],
        "LEFT_ANKLE": ["LANK", "LTIB"],
        "RIGHT_ANKLE": ["RANK", "RTIB"],
        "LEFT_HEEL": ["LHEE"],
        "RIGHT_HEEL": ["RHEE"],
        "LEFT_FOOT_INDEX": ["LTOE"],
        "RIGHT_FOOT_INDEX": ["RTOE"],
        "LEFT_SHOULDER": ["LSHO"],
        "RIGHT_SHOULDER": ["RSHO"],
        "NOSE": ["C7", "CLAV", "STRN"],
    },
    "iso_biomechanics": {
        "LEFT_HIP": ["LASIS", "LHJC"],
        "RIGHT_HIP": ["RASIS", "RHJC"],
        "LEFT_KNEE": ["LLFE", "LMFE"],
        "RIGHT_KNEE": ["RLFE", "RMFE"],
        "LEFT_ANKLE": ["LLM", "LMM"],
        "RIGHT_ANKLE": ["RLM", "RMM"],
        "LEFT_HEEL": ["LCAL"],
        "RIGHT_HEEL": ["RCAL"],
        "LEFT_FOOT_INDEX": ["LTT2"],
        "RIGHT_FOOT_INDEX": ["RTT2"],
        "LEFT_SHOULDER": ["LASIS"],
        "RIGHT_SHOULDER": ["RASIS"],
        "NOSE": ["LASIS", "RASIS"],
    },
    "helen_hayes": {
        "LEFT_HIP": ["LASI", "LPSI"],
        "RIGHT_HIP": ["RASI", "RPSI"],
        "LEFT_KNEE": ["LKNE"],
        "RIGHT_KNEE": ["RKNE"],
        "LEFT_ANKLE": ["LANK"],
        "RIGHT_ANKLE": ["RANK"],
        "LEFT_HEEL": ["LHEEL", "LHEE"],
        "RIGHT_HEEL": ["RHEEL", "RHEE"],
        "LEFT_FOOT_INDEX": ["LFT2", "LMT2", "LTOE"],
        "RIGHT_FOOT_INDEX": ["RFT2", "RMT2", "RTOE"],
        "LEFT_SHOULDER": ["LSHO"],
        "RIGHT_SHOULDER": ["RSHO"],
        "NOSE": ["C7", "CLAV"],
    },
    "bath_biocv": {
        "LEFT_HIP": ["LEFT_HIP", "ILCREST_L", "ASIS_L"],
        "RIGHT_HIP": ["RIGHT_HIP", "ILCREST_R", "ASIS_R"],
        "LEFT_KNEE": ["LEFT_KNEE", "KNEE_LAT_L", "KNEE_MED_L"],
        "RIGHT_KNEE": ["RIGHT_KNEE", "KNEE_LAT_R", "KNEE_MED_R"],
        "LEFT_ANKLE": ["LEFT_ANKLE", "MAL_LAT_L", "MAL_MED_L", "LAJC"],
        "RIGHT_ANKLE": ["RIGHT_ANKLE", "MAL_LAT_R", "MAL_MED_R", "RAJC"],
        "LEFT_HEEL": ["HEEL_L"],
        "RIGHT_HEEL": ["HEEL_R"],
        "LEFT_FOOT_INDEX": ["LEFT_MTP", "TOE_L", "MTP1_L", "MTP5_L", "LTOE"],
        "RIGHT_FOOT_INDEX": ["RIGHT_MTP", "TOE_R", "MTP1_R", "MTP5_R", "RTOE"],
        "LEFT_SHOULDER": ["LEFT_SHO", "ACROM_L"],
        "RIGHT_SHOULDER": ["RIGHT_SHO", "ACROM_R"],
        "NOSE": ["C7", "CLAV"],
    },
    "iso_biomechanics_underscore": {
        "LEFT_HIP": ["L_ASIS", "L_HJC"],
        "RIGHT_HIP": ["R_ASIS", "R_HJC"],
        "LEFT_KNEE": ["L_LFE", "L_MFE"],
        "RIGHT_KNEE": ["R_LFE", "R_MFE"],
        "LEFT_ANKLE": ["L_LM", "L_MM"],
        "RIGHT_ANKLE": ["R_LM", "R_MM"],
        "LEFT_HEEL": ["L_CAL"],
        "RIGHT_HEEL": ["R_CAL"],
        "LEFT_FOOT_INDEX": ["L_TT2"],
        "RIGHT_FOOT_INDEX": ["R_TT2"],
        "LEFT_SHOULDER": ["L_SHO"],
        "RIGHT_SHOULDER": ["R_SHO"],
        "NOSE": ["L_ASIS", "R_ASIS"],
    },
}
#: Landmarks that a convention is judged by, and of how many of these it has to name a marker.
REQUIRED, ENOUGH = ("LEFT_HIP", "RIGHT_HIP", "LEFT_KNEE", "RIGHT_KNEE", "LEFT_ANKLE", "RIGHT_ANKLE"), 4
# Patterns for labels of no known convention, by part, and the prefixes of the sides.
FUZZY = {
    "HIP": "ASIS?|HJC|HIP|ILIAC|PELV", "KNEE": "KNE|KJC|LFE|MFE|FEP", "ANKLE": "ANK|AJC|LM$|MM$|MALL", "HEEL": "HEE|HEEL|CAL",
    "FOOT_INDEX": "TOE|TT2|MT2|MTP|FT2", "SHOULDER": "SHO|AC$|ACR", "NOSE": "CLAV|C7|STRN|NOSE",
}
FUZZY_SIDES = {"LEFT": "^(L(?![A-Z])|LEFT[_ ]?|L_)", "RIGHT": "^(R(?![A-Z])|RIGHT[_ ]?|R_)"}
# Angles that two recordings may be synchronised by, the first of equally long ones, and the samples needed.
SYNC_JOINTS, SYNC_SAMPLES = ("knee_L", "knee_R", "hip_L", "hip_R"), 10


def nearest(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a (keys, at) with the distance to the nearest of b (keys, at), by one sort of both rather than all pairs; null without any."""
    both = a.select(*keys, "at", F.lit(0).alias("__b")).unionByName(b.select(*keys, "at", F.lit(1).alias("__b")))
    w = Window.partitionBy(*keys).orderBy("at", F.desc("__b"))
    theirs = F.when(F.col("__b") == 1, F.col("at"))
    marked = both.withColumns({"__p": F.last(theirs, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.first(theirs, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    return marked.filter("__b = 0").select(*keys, "at", F.least(F.col("at") - F.col("__p"), F.col("__n") - F.col("at")).alias("distance")).filter(F.col("distance").isNotNull())


def sample_index(time: Column, offset: Column | float, rate: float) -> Column:
    """The sample nearest to a time, halves to the even one."""
    return F.rint((time + offset) * rate).cast("bigint")


def align_nearest(video: DataFrame, optical: DataFrame, keys: list[str], video_rate: float, optical_rate: float, offset: Column | float) -> DataFrame:
    """video rows (keys, pos, ...) beside the optical row of the nearest time; rows outside the overlap go. An equi-join on a computed sample."""
    at = sample_index(F.col("pos") / float(video_rate), offset if isinstance(offset, Column) else F.lit(float(offset)), float(optical_rate))
    return video.withColumn("__at", at).join(optical.withColumnRenamed("pos", "__at"), [*keys, "__at"]).drop("__at")


def estimate_offset(video: DataFrame, optical: DataFrame, video_rate: float, optical_rate: float, longest: float = 10.0) -> DataFrame:
    """trial_id, offset (seconds), r: the shift at which an angle's two recordings agree best.

    Both (trial_id, pos, value) are brought to the lower rate and standardised. Trials with fewer than ten samples of
    either have no row; ``require_offsets`` turns these into an error.
    """
    rate = min(video_rate, optical_rate)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        which, value = table.column("which").to_numpy(), table.column("value").to_numpy().astype(float)
        sides = []
        for k, r in ((0, video_rate), (1, optical_rate)):
            v = K.fill_linear(value[which == k])
            sides.append(np.interp(np.arange(int(len(v) * rate / r)) / rate, np.arange(len(v)) / r, v) if len(v) else v)
        a, b = sides
        if min(len(a), len(b)) < 10:
            return pa.table({"trial_id": table.column("trial_id")[:0], "offset": pa.array([], pa.float64()), "r": pa.array([], pa.float64())})
        a, b = ((v - v.mean()) / (v.std() or 1.0) for v in (a, b))
        lags = np.arange(-(len(a) - 1), len(b))
        r = np.correlate(b, a, "full") / min(len(a), len(b))
        near = np.abs(lags) <= longest * rate
        k = int(r[near].argmax())
        return pa.table({"trial_id": table.column("trial_id")[:1], "offset": pa.array([float(lags[near][k] / rate)]), "r": pa.array([float(r[near][k])])})

    kind = dict(video.dtypes)["trial_id"]
    both = [df.select("trial_id", "pos", F.col("value").cast("double").alias("value"), F.lit(k).alias("which")) for k, df in enumerate((video, optical))]
    return both[0].unionByName(both[1]).groupBy("trial_id").applyInArrow(run, f"trial_id {kind}, offset double, r double")


def require_offsets(trials: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets, or an error that names trials without one."""
    missing = trials.join(offsets, "trial_id", "left_anti").select("trial_id").limit(5).collect()
    if missing:
        raise SyncFailed(f"too few common samples in {', '.join(str(r[0]) for r in missing)}")
    return offsets


def error_metrics(pairs: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """keys, n, rmse, mae, bias, rom_diff, cmc of pairs (keys, value, reference); null measures for fewer than ``least`` pairs."""
    d = F.col("value") - F.col("reference")
    known = pairs.filter(F.col("value").isNotNull() & F.col("reference").isNotNull())
    mid = (F.col("value") + F.col("reference")) / 2
    within = F.sum(2 * F.pow(F.col("value") - mid, 2)) / F.count("*")
    grand = (F.avg("value") + F.avg("reference")) / 2
    total = (F.sum(F.col("value") * F.col("value") + F.col("reference") * F.col("reference")) - 2 * F.count("*") * grand * grand) / (2 * F.count("*") - 1)
    out = known.groupBy(*keys).agg(F.count("*").alias("n"), C.rms(d).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), ((F.max("value") - F.min("value")) - (F.max("reference") - F.min("reference"))).alias("rom_diff"), F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - within / total))).alias("cmc"))
    return out.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("rmse", "mae", "bias", "rom_diff", "cmc")})


def event_errors(video: DataFrame, optical: DataFrame) -> DataFrame:
    """trial_id, side, kind, mae_ms, median_ms: distance in time from each event (trial_id, side, kind, time) to the nearest optical one."""
    keys = ["trial_id", "side", "kind"]
    d = nearest(video.select(*keys, F.col("time").alias("at")), optical.select(*keys, F.col("time").alias("at")), keys)
    return d.groupBy(*keys).agg((F.avg("distance") * 1000).alias("mae_ms"), (F.median("distance") * 1000).alias("median_ms"))


@dataclass
class OpticalRun:
    """Tables of a comparison, by trial: choice and offset (sync), who couldn't be synchronised (errors), rows beside each other, and how they differ."""

    sync: DataFrame
    errors: DataFrame
    aligned: DataFrame
    angle_errors: DataFrame
    event_errors: DataFrame | None
    blocks: DataFrame


def sync_signals(video: DataFrame, optical: DataFrame) -> DataFrame:
    """trial_id, joint, n, counts: for each trial of video the candidate of SYNC_JOINTS of which both recordings have most samples.

    Both have trial_id, joint, pos, value; n is the smaller of a joint's two numbers of samples, counts those of all candidates.
    """
    count = lambda df, name: df.filter(F.col("joint").isin(*SYNC_JOINTS)).groupBy("trial_id", "joint").agg(F.count("*").alias(name))
    rank = F.array_position(F.array(*map(F.lit, SYNC_JOINTS)), F.col("joint"))
    both = count(video, "a").join(count(optical, "b"), ["trial_id", "joint"]).select("trial_id", "joint", F.least("a", "b").alias("n"), rank.alias("rank"))
    best = both.groupBy("trial_id").agg(F.max_by(F.struct("joint", "n"), F.struct("n", -F.col("rank"))).alias("b"), F.map_from_entries(F.collect_list(F.struct("joint", "n"))).alias("counts"))  # four at most
    none = F.create_map().cast("map<string,bigint>")
    return video.select("trial_id").distinct().join(best, "trial_id", "left").select("trial_id", "b.joint", F.coalesce("b.n", F.lit(0)).alias("n"), F.coalesce("counts", none).alias("counts"))


def optical_run(video: DataFrame, optical: DataFrame, video_rate: float, optical_rate: float, video_events: DataFrame | None = None, optical_events: DataFrame | None = None, longest: float = 10.0, least: int = SYNC_SAMPLES) -> OpticalRun:
    """Compare angles (trial_id, joint, pos, value) of both recordings, and events (trial_id, side, kind, time), of all trials in one plan.

    Each trial is synchronised by its longest common signal; its rows are put beside the optical ones of the nearest time,
    and differ by joint. Trials with fewer than ``least`` samples of every candidate are rows of ``errors`` and have
    no others. ``blocks`` has a struct for each trial of video: status (ok, no_overlap, error), sync, alignment, angles by joint.
    """
    chosen = sync_signals(video, optical)
    enough = chosen.filter(F.col("n") >= least)
    own = lambda df: df.join(enough.select("trial_id", "joint"), ["trial_id", "joint"], "left_semi").select("trial_id", "pos", "value")
    offsets = estimate_offset(own(video), own(optical), video_rate, optical_rate, longest)
    sync = enough.join(offsets, "trial_id").select("trial_id", F.col("joint").alias("signal"), "n", "offset", "r")
    listed = F.array_join(F.array(*[F.concat(F.lit(f"{j}="), F.coalesce(F.col("counts")[j], F.lit(0)).cast("string")) for j in SYNC_JOINTS]), ", ")
    failed = chosen.join(sync, "trial_id", "left_anti").select("trial_id", status("sync", "SyncFailed", F.concat(F.lit("too few common samples: "), listed, F.lit(f"; {least} are needed"))).alias("status"))
    errors = failures(failed)
    moved = video.join(sync.select("trial_id", F.col("offset").alias("__offset")), "trial_id")
    aligned = align_nearest(moved, optical.withColumnRenamed("value", "reference"), ["trial_id", "joint"], video_rate, optical_rate, F.col("__offset")).drop("__offset")
    angle_errors = error_metrics(aligned, ["trial_id", "joint"])
    events = None
    if video_events is not None and optical_events is not None:
        shifted = video_events.join(sync.select("trial_id", "offset"), "trial_id").withColumn("time", F.col("time") + F.col("offset"))
        events = event_errors(shifted, optical_events)
    measures = F.struct("n", "rmse", "mae", "bias", "rom_diff", "cmc")
    by_joint = angle_errors.groupBy("trial_id").agg(F.map_from_entries(F.collect_list(F.struct("joint", measures))).alias("angles"))
    counts = aligned.groupBy("trial_id").agg(F.countDistinct("pos").alias("n_aligned"))
    j = video.select("trial_id").distinct().join(sync, "trial_id", "left").join(counts, "trial_id", "left").join(by_joint, "trial_id", "left")
    state = F.when(F.col("signal").isNull(), "error").when(F.coalesce("n_aligned", F.lit(0)) == 0, "no_overlap").otherwise("ok")
    part = [state.alias("status"), F.struct("signal", "offset", "r").alias("sync"), F.struct("offset", F.coalesce("n_aligned", F.lit(0)).alias("n_aligned")).alias("alignment"), "angles"]
    if events is not None:
        entry = F.struct(F.concat_ws("_", "side", "kind").alias("k"), F.struct("mae_ms", "median_ms").alias("v"))
        j = j.join(events.groupBy("trial_id").agg(F.map_from_entries(F.collect_list(entry)).alias("events")), "trial_id", "left")
        part.append("events")
    return OpticalRun(sync, errors, aligned, angle_errors, events, j.select("trial_id", F.struct(*part).alias("optical")))


def attach_blocks(documents: DataFrame, run: OpticalRun) -> DataFrame:
    """documents with an ``experimental`` struct that holds the trial's block, null for trials that weren't compared."""
    return documents.join(run.blocks, "trial_id", "left").withColumn("experimental", F.when(F.col("optical").isNotNull(), F.struct("optical"))).drop("optical")


def convention_table(spark: SparkSession) -> DataFrame:
    """convention, number, landmark, label, rank."""
    return spark.createDataFrame(pa.Table.from_pylist([{"convention": c, "number": i, "landmark": n, "label": label, "rank": k} for i, (c, own) in enumerate(CONVENTIONS.items()) for n, labels in own.items() for k, label in enumerate(labels)]))


def _bare(labels: DataFrame) -> DataFrame:
    return labels.select("trial_id", "label", F.upper(F.element_at(F.split("label", ":"), -1)).alias("__l")).distinct()


def detect_convention(labels: DataFrame, least: int = ENOUGH) -> DataFrame:
    """trial_id, convention, n: of labels (trial_id, label) the convention that names markers of most of the REQUIRED landmarks.

    The first of equal ones; ``fuzzy`` where none has ``least``. Labels may have a subject's prefix before a colon, in any case.
    """
    table = convention_table(labels.sparkSession).filter(F.col("landmark").isin(*REQUIRED)).withColumn("__l", F.upper("label")).drop("label")
    bare = _bare(labels)
    score = bare.join(F.broadcast(table), "__l").groupBy("trial_id", "convention", "number").agg(F.countDistinct("landmark").alias("n"))
    best = score.groupBy("trial_id").agg(F.max_by(F.struct("convention", "n"), F.struct("n", -F.col("number"))).alias("b"))
    out = bare.select("trial_id").distinct().join(best, "trial_id", "left")
    return out.select("trial_id", F.when(F.col("b.n") >= least, F.col("b.convention")).otherwise("fuzzy").alias("convention"), F.coalesce("b.n", F.lit(0)).alias("n"))


def fuzzy_landmarks(labels: DataFrame) -> DataFrame:
    """trial_id, label, landmark by the side's prefix and a part's pattern; a label may stand for several."""
    bare = _bare(labels)
    own = []
    for part, pattern in FUZZY.items():
        for side in FUZZY_SIDES if part != "NOSE" else [""]:
            fits = F.col("__l").rlike(pattern) & (F.col("__l").rlike(FUZZY_SIDES[side]) if side else F.lit(True))
            own.append(F.when(fits, f"{side}_{part}" if side else part))
    return bare.select("trial_id", "label", F.explode(F.array_compact(F.array(*own))).alias("landmark"))


def marker_mapping(labels: DataFrame) -> DataFrame:
    """trial_id, label, landmark of each trial's labels, by the convention that fits it, or by patterns where none does."""
    found = detect_convention(labels).select("trial_id", "convention")
    table = convention_table(labels.sparkSession).withColumn("__l", F.upper("label")).select("convention", "landmark", "__l")
    known = _bare(labels).join(found, "trial_id").join(F.broadcast(table), ["convention", "__l"]).select("trial_id", "label", "landmark")
    other = fuzzy_landmarks(labels.join(found.filter("convention = 'fuzzy'"), "trial_id", "left_semi"))
    return known.unionByName(other)


def marker_landmarks(markers: DataFrame, mapping: DataFrame, forward: str = "Y", up: str = "Z") -> DataFrame:
    """trial_id, frame_idx, name, x, y: markers (trial_id, frame_idx, name, X, Y, Z) as landmarks in the sagittal plane, within 0 and 1.

    A marker at the origin is missing; several markers of a landmark (mapping: trial_id, label, landmark) are averaged; one
    scale serves both axes.
    """
    there = markers.filter(~((F.col("X") == 0) & (F.col("Y") == 0) & (F.col("Z") == 0)))
    named = there.join(mapping.select("trial_id", F.col("label").alias("name"), "landmark"), ["trial_id", "name"]).groupBy("trial_id", "frame_idx", F.col("landmark").alias("name")).agg(F.avg(forward).alias("a"), F.avg(up).alias("b"))
    w = Window.partitionBy("trial_id")
    low_a, low_b = F.min("a").over(w), F.min("b").over(w)
    reach = F.greatest(F.max("a").over(w) - low_a, F.max("b").over(w) - low_b)
    return named.select("trial_id", "frame_idx", "name", C.safe_divide(F.col("a") - low_a, reach).alias("x"), (1.0 - C.safe_divide(F.col("b") - low_b, reach)).alias("y"))


def marker_documents(markers: DataFrame, mapping: DataFrame, forward: str = "Y", up: str = "Z") -> DataFrame:
    """Documents (see schemas.DOCUMENT) of markers (trial_id, frame_idx, time_s, name, X, Y, Z) seen from the side; the rate follows from times."""
    times = markers.groupBy("trial_id", "frame_idx").agg(F.min("time_s").alias("time_s"))
    rate = times.groupBy("trial_id").agg(F.count("*").alias("n"), ((F.max("frame_idx") - F.min("frame_idx")) / F.nullif(F.max("time_s") - F.min("time_s"), F.lit(0.0))).alias("fps"))
    point = F.struct("x", "y", F.lit(1.0).alias("visibility"))
    frames = marker_landmarks(markers, mapping, forward, up).groupBy("trial_id", "frame_idx").agg(F.map_from_entries(F.collect_list(F.struct("name", point.alias("p")))).alias("landmarks"))
    empty = F.create_map().cast("map<string,struct<x:double,y:double,visibility:double>>")
    whole = times.join(frames, ["trial_id", "frame_idx"], "left").select("trial_id", F.struct(F.col("frame_idx").cast("int").alias("frame_idx"), "time_s", F.when(F.col("landmarks").isNotNull(), 1.0).otherwise(0.0).alias("confidence"), F.coalesce("landmarks", empty).alias("landmarks")).alias("f"))
    body = whole.groupBy("trial_id").agg(F.array_sort(F.collect_list("f"), lambda a, b: a["frame_idx"] - b["frame_idx"]).alias("frames"))  # a recording
    meta = F.struct(F.lit("optical").alias("source"), F.lit(None).cast("string").alias("video_path"), "fps", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.col("n").cast("int").alias("n_frames"), (F.col("n") / F.col("fps")).alias("duration_s"))
    out = body.join(rate, "trial_id").withColumn("meta", meta)
    kinds = {f.name: f.dataType for f in DOCUMENT.fields}
    fill = F.transform("frames", lambda f: F.struct(f["frame_idx"].alias("frame_idx"), f["time_s"].alias("time_s"), f["confidence"].alias("confidence"), f["landmarks"].alias("landmarks"), *[F.lit(None).cast(x.dataType).alias(x.name) for x in FRAME.fields[4:]]))
    return out.select("trial_id", F.col("meta").cast(kinds["meta"]).alias("meta"), F.lit(None).cast(kinds["extraction"]).alias("extraction"), F.lit(None).cast(kinds["subject"]).alias("subject"), fill.alias("frames"))


def spatial_angles(markers: DataFrame) -> DataFrame:
    """trial_id, frame_idx, side, knee, ankle from points in space (trial_id, frame_idx, name, X, Y, Z)."""
    pick = lambda n, s, c: F.max(F.when(F.col("name") == F.concat(F.col("side"), F.lit(f"_{n}")), F.col(c))).alias(f"{n}{c}")
    sided = markers.withColumn("side", F.element_at(F.split("name", "_"), 1)).filter(F.col("side").isin("LEFT", "RIGHT"))
    wide = sided.groupBy("trial_id", "frame_idx", "side").agg(*[pick(n, None, c) for n in ("HIP", "KNEE", "ANKLE", "HEEL", "FOOT_INDEX") for c in "XYZ"])

    def between(a: str, b: str, c: str, d: str) -> Column:
        u, v = [[F.col(f"{q}{k}") - F.col(f"{p}{k}") for k in "XYZ"] for p, q in ((a, b), (c, d))]
        dot = sum((x * y for x, y in zip(u, v, strict=True)), F.lit(0.0))
        return F.degrees(F.acos(C.clip(C.safe_divide(dot, C.norm(*u) * C.norm(*v)), -1.0, 1.0)))

    return wide.select("trial_id", "frame_idx", F.lower("side").alias("side"), (180.0 - between("KNEE", "HIP", "KNEE", "ANKLE")).alias("knee"), (90.0 - between("ANKLE", "KNEE", "HEEL", "FOOT_INDEX")).alias("ankle"))
