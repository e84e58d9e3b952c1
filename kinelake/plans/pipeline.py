"""From recordings to cycles and figures in one lazy plan over all trials."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import columns as C
from kinelake.operators import analysis, corrections, cycles, events, guard, normative, optical, pose, quality, scores, signals, validation
from kinelake.sources import pivot, settings


@dataclass
class Results:
    """Tables of a run, all lazy."""

    trials: DataFrame
    poses: DataFrame
    angles: DataFrame
    events: DataFrame
    cycles: DataFrame
    curves: DataFrame
    summary: DataFrame
    figures: DataFrame
    gvs: DataFrame
    gps: DataFrame
    sdi: DataFrame
    violations: DataFrame
    quality: DataFrame
    report: DataFrame
    diagnosis: DataFrame
    phases: DataFrame
    errors: DataFrame
    outcome: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give back what run keeps."""
        for df in self.held:
            df.unpersist()


def run(documents: DataFrame, options: dict | None = None, keep: bool = True, preset: str = "defaults", lengths: DataFrame | None = None, spatial: DataFrame | None = None) -> Results:
    """All stages over documents (see sources.pivot); options are merged over the defaults. Rates are the trials' own.

    Tables that later ones read several times are worked out once and kept, in memory and on disk, until ``release`` is
    called; without ``keep`` each result is a plan from the documents on.

    ``preset`` names the settings that options change, of which ``recipe`` is the validated one. lengths: trial_id, femur_mm,
    foot_mm of subjects that were measured. spatial: trial_id, frame_idx, side, ankle, angles in space that replace those of
    the picture (see run_markers). Angles of the frontal plane, where poses have depths, get cycles and scores too.

    A trial that a stage fails for is a row of ``errors`` (trial_id, stage, kind, message, item) and missing from what
    comes after; all others go on. ``outcome`` has a row for each document: ok or error, frames, events and cycles.
    """
    kept: list[DataFrame] = []

    def held(df: DataFrame) -> DataFrame:
        if keep:
            kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    o = settings.merged(settings.preset(preset), options or {})
    every, documents = guard.with_status(documents), guard.good(documents)
    trials = pivot.trials(documents)
    raw = pivot.poses(documents)
    rates = trials.select("trial_id", F.coalesce("meta.fps", F.lit(30.0)).alias("fps"))
    rated = pose.to_long(raw).join(rates.withColumnRenamed("fps", "rate"), "trial_id")
    tracks = signals.normalize(guard.with_status(rated), o["normalize"]["steps"], o["normalize"]["gap_max"])
    clean = held(pose.to_pose(tracks))
    angles = pose.compute_angles(clean, **o["angles"])
    if spatial is not None:
        angles = with_spatial_ankles(angles, spatial)
    angles = pose.canonicalize_signs(angles)
    if o["corrections"]["ankle_projection"]:
        angles = pose.correct_ankle_projection(clean, angles)
    if o["corrections"]["drift"]:
        angles = corrections.detrend_angles(angles)
    angles = held(angles)
    detected = held(events.detect_events(clean, trials, **o["events"], report=True))
    found = guard.good(detected)
    cut = held(cycles.segment(found.join(rates, "trial_id"), F.col("fps"), o["cycles"]["shortest"], o["cycles"]["longest"]))
    deep = clean.join(raw.filter("landmark_depths IS NOT NULL").select("trial_id", "pos", "landmark_depths"), ["trial_id", "pos"])
    curves = held(cycles.curves(cut, pose.angles_long(angles).unionByName(pose.frontal_long(pose.frontal_angles(deep))), o["cycles"]["points"]))
    all_cuts = cut
    if o["corrections"]["one_direction"]:
        cut = cycles.dominant_direction(cut, clean.select("trial_id", "frame_idx", pose.middle(pose.x("LEFT_HIP"), pose.x("RIGHT_HIP")).alias("x")), curves)
        cut = held(cut)
        curves = cycles.flexion_positive(curves.join(cut.select("trial_id", "cycle_id"), ["trial_id", "cycle_id"], "left_semi"))
        curves = held(curves)
    summary = cycles.summary(cycles.long_curves(curves))
    figures = analysis.variability(cut).join(_figures(cut, found, rates), "trial_id", "full_outer").join(analysis.symmetry(cut, analysis.rom_table(curves)), "trial_id", "full_outer")
    norm = normative.table(documents.sparkSession).filter(F.col("stratum") == o["scores"]["stratum"]).filter(F.col("joint").isin("hip", "knee", "ankle", "trunk", *pose.FRONTAL_JOINTS))
    gvs = scores.variable_scores(summary, norm)
    gps = scores.profile_score(gvs)
    limits = validation.ranges(documents.sparkSession)
    errors = guard.together(guard.failures(every), guard.failures(tracks, "name"), guard.failures(detected))
    return Results(
        trials, clean, angles, found, cut, curves, summary, figures, gvs, gps, scores.deviation_index(gps, norm, gvs), validation.check_angles(pose.angles_long(angles), limits), quality.quality_score(raw),
        report(figures, clean, trials, found, cut, curves, lengths), diagnose(raw, trials, all_cuts, cut, curves), validation.check_phases(curves, cut, limits),
        errors, outcome(every, errors, found, cut), kept,
    )


def outcome(documents: DataFrame, errors: DataFrame, found: DataFrame, cut: DataFrame) -> DataFrame:
    """trial_id, status (ok or error), n_frames, n_events, n_cycles, error of each document; a landmark's failure alone is no error of its trial."""
    count = lambda df, name: df.groupBy("trial_id").agg(F.count("*").alias(name))
    first = errors.filter("item IS NULL").groupBy("trial_id").agg(F.min(F.concat_ws(": ", "stage", "kind", "message")).alias("error"))
    frames = documents.select("trial_id", F.greatest(F.coalesce(F.size("frames"), F.lit(0)), F.lit(0)).alias("n_frames"))
    out = frames.join(first, "trial_id", "left").join(count(found, "n_events"), "trial_id", "left").join(count(cut, "n_cycles"), "trial_id", "left").fillna(0, ["n_events", "n_cycles"])
    return out.select("trial_id", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "n_frames", "n_events", "n_cycles", "error")


def with_spatial_ankles(angles: DataFrame, spatial: DataFrame) -> DataFrame:
    """angles with ankle_L and ankle_R of spatial (trial_id, frame_idx, side, ankle) where there are any."""
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("ankle")))
    wide = spatial.groupBy("trial_id", "frame_idx").agg(of("left").alias("__l"), of("right").alias("__r"))
    j = angles.join(wide, ["trial_id", "frame_idx"], "left")
    return j.withColumns({"ankle_L": F.coalesce("__l", "ankle_L"), "ankle_R": F.coalesce("__r", "ankle_R")}).select(angles.columns)


def run_markers(markers: DataFrame, options: dict | None = None, keep: bool = True, preset: str = "recipe", mapping: DataFrame | None = None) -> Results:
    """The same over markers in space (trial_id, frame_idx, time_s, name, X, Y, Z, as read_c3d gives), with the ankle's angle in space.

    Labels are understood by the convention that fits a trial, or by ``mapping`` (trial_id, label, landmark). Rates follow
    from the frames' times. Documents that many tables read are best written once: optical.marker_documents, then run with
    ``spatial``.
    """
    known = mapping if mapping is not None else optical.marker_mapping(markers.select("trial_id", F.col("name").alias("label")).distinct())
    named = markers.join(known.withColumnRenamed("label", "name"), ["trial_id", "name"]).groupBy("trial_id", "frame_idx", F.col("landmark").alias("name")).agg(*[F.avg(a).alias(a) for a in "XYZ"])
    return run(optical.marker_documents(markers, known), options, keep, preset, spatial=optical.spatial_angles(named).select("trial_id", "frame_idx", "side", "ankle"))


def report(figures: DataFrame, poses: DataFrame, trials: DataFrame, found: DataFrame, cut: DataFrame, curves: DataFrame, lengths: DataFrame | None = None, femur_ratio: float = 0.245) -> DataFrame:
    """A row per trial with all figures: spatiotemporal, symmetry, variability, clinical markers, regularity, harmonics, steps, speed, flags, patterns, and their short names.

    Lengths are in metres where the subject's thigh or foot (lengths: trial_id, femur_mm, foot_mm) or height is known, else
    in units of the picture's width.
    """
    measured = lengths.select("trial_id", F.col("femur_mm").cast("double").alias("femur_mm"), F.col("foot_mm").cast("double").alias("foot_mm")) if lengths is not None else trials.select("trial_id", F.lit(None).cast("double").alias("femur_mm"), F.lit(None).cast("double").alias("foot_mm"))
    subjects = trials.select("trial_id", "subject.height_m").join(measured, "trial_id", "left")
    scaled = poses.join(analysis.scale(poses, subjects, femur_ratio), "trial_id")
    ankles = scaled.select("trial_id", "frame_idx", F.explode(F.array(*[F.struct(F.lit(s.lower()).alias("side"), (pose.x(f"{s}_ANKLE") * F.col("scale")).alias("x")) for s in ("LEFT", "RIGHT")])).alias("a")).select("trial_id", "frame_idx", "a.*")
    by_side = lambda df, value: df.groupBy("trial_id").pivot("side", ["left", "right"]).agg(F.first(value)).select("trial_id", *[F.col(s).alias(f"{value}_{s}") for s in ("left", "right")])
    speed = analysis.walking_speed(cut, ankles).filter("side = 'overall'").select("trial_id", F.col("speed").alias("speed_mean"))
    signs = analysis.patterns(cycles.mean_curves(curves)).groupBy("trial_id").agg(F.array_sort(F.collect_list(F.struct("pattern", "side", "severity"))).alias("patterns"))  # at most three a side
    clinical = analysis.clinical_markers(curves)
    own = [c for c in clinical.columns if c not in ("trial_id", "side")]
    both = clinical.groupBy("trial_id").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for c in own for s in ("left", "right")])
    out = figures
    for part in (both, analysis.regularity_index(poses, trials), analysis.harmonic_ratios(poses), by_side(analysis.step_lengths(found, ankles), "step_length"), speed, analysis.flags(figures), signs):
        out = out.join(part, "trial_id", "left")
    stance = F.array_compact(F.array("stance_pct_left", "stance_pct_right"))
    mean = F.when(F.size(stance) > 0, F.aggregate(stance, F.lit(0.0), lambda a, v: a + v) / F.size(stance))
    return out.withColumns({"cadence": F.col("cadence_steps_per_min"), "speed": F.col("speed_mean"), "stance_pct": mean})


def _figures(cut: DataFrame, found: DataFrame, rates: DataFrame) -> DataFrame:
    """Spatiotemporal figures with each trial's own rate: events are brought to seconds, a rate of one."""
    in_seconds = found.join(rates, "trial_id").withColumn("frame", F.col("frame") / F.col("fps"))
    return analysis.spatiotemporal(cut, in_seconds, 1.0)


def diagnose(poses: DataFrame, trials: DataFrame, cut: DataFrame, kept: DataFrame, curves: DataFrame) -> DataFrame:
    """trial_id, n_frames, coverage, confidence, distortion, n_left, n_right, n_dropped, ankle_rom, warnings: what to doubt in a trial.

    Distortion is how much of its greatest apparent length the left thigh loses, from percentiles, where over 30 frames
    show it. A first second in which that length hardly changes can serve for calibration.
    """
    thigh = C.distance(pose.x("LEFT_HIP"), pose.y("LEFT_HIP"), pose.x("LEFT_KNEE"), pose.y("LEFT_KNEE"))
    own = poses.join(trials.select("trial_id", F.coalesce("meta.fps", F.lit(30.0)).alias("fps")), "trial_id").select("trial_id", "pos", "confidence", "fps", F.size("landmarks").alias("seen"), thigh.alias("thigh"))
    first = F.row_number().over(Window.partitionBy("trial_id", F.col("thigh").isNull()).orderBy("pos"))
    early = F.when(F.col("thigh").isNotNull() & (first <= F.floor("fps")), F.col("thigh"))
    own = own.withColumn("early", early).groupBy("trial_id").agg(
        F.count("*").alias("n_frames"), F.avg(F.when(F.col("seen") > 0, 1.0).otherwise(0.0)).alias("coverage"), F.avg("confidence").alias("confidence"),
        F.when(F.count("thigh") > 30, (F.percentile("thigh", F.lit(0.95)) - F.percentile("thigh", F.lit(0.05))) / (F.percentile("thigh", F.lit(0.95)) + 1e-9)).alias("distortion"),
        F.when((F.count("*") > 60) & (F.count("early") > 10), F.stddev_pop("early") / (F.avg("early") + 1e-9)).alias("unrest"),
    )
    side = lambda s: F.count(F.when(F.col("side") == s, 1))
    counts = cut.groupBy("trial_id").agg(F.count("*").alias("n_cut")).join(kept.groupBy("trial_id").agg(F.count("*").alias("n_kept"), side("left").alias("n_left"), side("right").alias("n_right")), "trial_id", "left")
    ankle = curves.filter("joint = 'ankle'").groupBy("trial_id").agg(F.avg(F.array_max("curve") - F.array_min("curve")).alias("ankle_rom"))
    j = own.join(counts, "trial_id", "left").join(ankle, "trial_id", "left").fillna(0, ["n_cut", "n_kept", "n_left", "n_right"]).withColumn("n_dropped", F.col("n_cut") - F.col("n_kept"))
    warn = F.array_compact(F.array(
        F.when(F.col("coverage") < 0.8, F.format_string("tracking: landmarks in %.0f %% of frames", F.col("coverage") * 100)),
        F.when(F.col("confidence") < 0.6, F.format_string("tracking: mean confidence %.2f", "confidence")),
        F.when(F.col("distortion") > 0.35, F.format_string("perspective: the thigh's apparent length varies by %.0f %%", F.col("distortion") * 100)),
        F.when(F.col("unrest") < 0.02, "calibration: the first second is still and can serve as neutral pose"),
        F.when(F.col("n_dropped") > 0, F.format_string("direction: %d cycles against the main direction left out", "n_dropped")),
        *[F.when(F.col(f"n_{s}") < 3, F.format_string(f"cycles: %d on the {s}", f"n_{s}")) for s in ("left", "right")],
        F.when((F.col("ankle_rom") < 8) | (F.col("ankle_rom") > 60), F.format_string("ankle: mean range of %.0f degrees", "ankle_rom")),
    ))
    return j.withColumn("warnings", warn).drop("unrest", "n_cut", "n_kept")
