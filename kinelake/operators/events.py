"""Gait events: detectors by whole series, voting, and checks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.exceptions import UnknownName
from kinelake.functions import kernels as K
from kinelake.functions import series
from kinelake.operators import cycles, guard
from kinelake.operators import pose as P
from kinelake.schemas import EVENTS

#: Landmarks that detectors look at.
NEEDED = [f"{s}_{n}" for s in ("LEFT", "RIGHT") for n in ("HIP", "KNEE", "ANKLE", "HEEL", "FOOT_INDEX")]
Series = dict[str, np.ndarray]
Found = dict[tuple[str, str], list[tuple[int, float]]]


def _held(v: np.ndarray) -> np.ndarray:
    """Missing values take the last known one, at the beginning the first."""
    known = ~np.isnan(v)
    if not known.any():
        return np.zeros(len(v))
    at = np.maximum.accumulate(np.where(known, np.arange(len(v)), -1))
    return v[np.where(at < 0, np.argmax(known), at)]


def _track(s: Series, name: str, rate: float, cutoff: float) -> np.ndarray:
    return K.lowpass(_held(s[name]), cutoff, rate)


def _direction(s: Series) -> float:
    ahead = np.concatenate([s["LEFT_FOOT_INDEX_x"] - s["LEFT_HEEL_x"], s["RIGHT_FOOT_INDEX_x"] - s["RIGHT_HEEL_x"]])
    return -1.0 if (~np.isnan(ahead)).any() and np.nanmedian(ahead) < 0 else 1.0


def _peaks(v: np.ndarray, rate: float, least: float) -> list[tuple[int, float]]:
    at, prominence = K.find_peaks(v, max(1, int(least * rate)), max(0.005, 0.1 * np.ptp(v)))
    top = prominence.max() if len(prominence) else 1.0
    return [(int(p), round(float(q / top), 3)) for p, q in zip(at, prominence, strict=True)]


def zeni(s: Series, rate: float, least: float, cutoff: float) -> Found:
    """Contacts and lift-offs at the extremes of the ankle's place ahead of the pelvis."""
    pelvis = (_held(s["LEFT_HIP_x"]) + _held(s["RIGHT_HIP_x"])) / 2
    out: Found = {}
    for side, name in (("left", "LEFT"), ("right", "RIGHT")):
        v = K.lowpass(_direction(s) * (_held(s[f"{name}_ANKLE_x"]) - pelvis), cutoff, rate)
        out[side, "hs"], out[side, "to"] = _peaks(v, rate, least), _peaks(-v, rate, least)
    return out


def _unseen(v: np.ndarray) -> bool:
    return bool(np.isnan(v).all())


def _or_ankle(s: Series, side: str, part: str, axis: str) -> np.ndarray:
    """A foot's landmark, or the ankle where a recording never has it, as with layouts that end there."""
    own = s[f"{side}_{part}_{axis}"]
    return s[f"{side}_ANKLE_{axis}"] if _unseen(own) else own


def _spaced(at, rate: float, least: float, confidence: float) -> list[tuple[int, float]]:
    return [(p, confidence) for p in K.thin(np.asarray(at).tolist(), max(1, int(least * rate)))]


_SIDES = (("left", "LEFT"), ("right", "RIGHT"))


def crossing(s: Series, rate: float, least: float, cutoff: float) -> Found:
    """Contacts where a knee passes the other one, and the other side's lift-off a tenth of the least cycle before."""
    out: Found = {(side, kind): [] for side, _ in _SIDES for kind in ("hs", "to")}
    if _unseen(s["LEFT_KNEE_x"]) or _unseen(s["RIGHT_KNEE_x"]):
        return out
    d = _direction(s) * (_track(s, "LEFT_KNEE_x", rate, cutoff) - _track(s, "RIGHT_KNEE_x", rate, cutoff))
    at = np.flatnonzero(d[:-1] * d[1:] < 0) + 1
    at = at[at < len(d) - 1]
    early = max(1, int(0.1 * least * rate))
    for side, other, passes in (("left", "right", at[d[at] > d[at - 1]]), ("right", "left", at[d[at] <= d[at - 1]])):
        out[side, "hs"] = _spaced(passes, rate, least, 0.8)
        out[other, "to"] = _spaced(np.maximum(0, passes - early), rate, least, 0.7)
    return out


def velocity(s: Series, rate: float, least: float, cutoff: float) -> Found:
    """Contacts where the heel stops going down, lift-offs where the toe does; heels are ankles, and toes heels, where they are never seen."""
    out: Found = {}
    for side, name in _SIDES:
        heel = _or_ankle(s, name, "HEEL", "y")
        toe = heel if _unseen(s[f"{name}_FOOT_INDEX_y"]) else s[f"{name}_FOOT_INDEX_y"]
        for kind, part in (("hs", heel), ("to", toe)):
            v = np.gradient(K.lowpass(_held(part), cutoff, rate)) * rate
            out[side, kind] = [] if _unseen(heel) else _spaced(np.flatnonzero((v[:-1] > 0) & (v[1:] <= 0)) + 1, rate, least, 0.75)
    return out


def pelvis_velocity(s: Series, rate: float, least: float, cutoff: float) -> Found:
    """Contacts and lift-offs where the filtered speed of the heel (or ankle) past the pelvis changes sign."""
    out: Found = {}
    pelvis = (_held(s["LEFT_HIP_x"]) + _held(s["RIGHT_HIP_x"])) / 2
    for side, name in _SIDES:
        heel = _or_ankle(s, name, "HEEL", "x")
        v = K.lowpass(np.gradient(K.lowpass(_direction(s) * (_held(heel) - pelvis), cutoff, rate)) * rate, cutoff, rate)
        unseen = _unseen(heel) or _unseen(s["LEFT_HIP_x"]) or _unseen(s["RIGHT_HIP_x"])
        for kind, hits in (("hs", (v[:-1] > 0) & (v[1:] <= 0)), ("to", (v[:-1] < 0) & (v[1:] >= 0))):
            out[side, kind] = [] if unseen else _spaced(np.flatnonzero(hits) + 1, rate, least, 0.8)
    return out


_METHODS: dict[str, Callable[[Series, float, float, float], Found]] = {"zeni": zeni, "crossing": crossing, "velocity": velocity, "oconnor": pelvis_velocity}


def register_event_method(name: str, detector: Callable[[Series, float, float, float], Found]) -> None:
    """Add a detector: a function of series by name, rate, least cycle and cutoff that gives (position, confidence) by side and kind."""
    _METHODS[name] = detector


def list_event_methods() -> list[str]:
    return list(_METHODS)


def methods() -> dict[str, Callable[[Series, float, float, float], Found]]:
    return dict(_METHODS)


def wide_tracks(pose: DataFrame) -> DataFrame:
    """trial_id, frame_idx, pos and the coordinates that detectors look at, a column each."""
    return pose.select("trial_id", "frame_idx", "pos", *[c for n in NEEDED for c in (P.x(n).alias(f"{n}_x"), P.y(n).alias(f"{n}_y"))])


def detect_events(pose: DataFrame, trials: DataFrame, method: str = "zeni", least: float = 0.4, cutoff: float = 6.0, adaptive: bool = False, report: bool = False) -> DataFrame:
    """Events of every trial: trial_id, side, kind (hs or to), frame, time, confidence, method.

    The rate is the trial's meta.fps. With ``adaptive`` the least cycle and the cutoff follow how fast the pelvis moves.
    Frames are those of the recording, not positions in it. With ``report`` there is a status too, and a trial for which
    the detector raises has a row with it and no event.
    """
    if method not in _METHODS:
        raise UnknownName(method)
    detector = _METHODS[method]
    rate = trials.select("trial_id", F.coalesce("meta.fps", F.lit(30.0)).alias("fps"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        fps = table.column("fps")[0].as_py()
        frames = table.column("frame_idx").to_numpy()
        s = {c: table.column(c).to_numpy().astype(float) for c in table.column_names if c.endswith(("_x", "_y"))}
        cycle, low = adapted(s, fps) if adaptive else (least, cutoff)
        rows = []
        if len(frames) > 3:
            for (side, kind), found in detector(s, fps, cycle, low).items():
                rows += [{"trial_id": table.column("trial_id")[0].as_py(), "side": side, "kind": kind, "frame": int(frames[p]), "time": round(float(frames[p]) / fps, 4), "confidence": float(q), "method": method} for p, q in found]
        return pa.Table.from_pylist(rows, schema=pa.schema([("trial_id", pa.string()), ("side", pa.string()), ("kind", pa.string()), ("frame", pa.int32()), ("time", pa.float64()), ("confidence", pa.float64()), ("method", pa.string())]))

    make, schema = guard.guarded(run, EVENTS, "events", ["trial_id"]) if report else (run, EVENTS)
    return wide_tracks(pose).join(rate, "trial_id").groupBy("trial_id").applyInArrow(lambda table: make(table), schema)


def adapted(s: Series, rate: float) -> tuple[float, float]:
    """Least cycle and cutoff for slow, usual and fast walking."""
    pelvis = (s["LEFT_HIP_x"] + s["RIGHT_HIP_x"]) / 2
    pelvis = pelvis[~np.isnan(pelvis)]
    speed = np.abs(np.diff(pelvis)).mean() * rate if len(pelvis) > 1 else 0.05
    return (0.6, 4.0) if speed < 0.02 else (0.3, 8.0) if speed > 0.08 else (0.4, 6.0)


def motion_mask(pose: DataFrame, trials: DataFrame, window: float = 0.5, ratio: float = 0.003) -> DataFrame:
    """trial_id, frame_idx, moving: whether an ankle's height varies around the frame by more than a share of its range.

    Where fewer than a twentieth of a trial's frames move, all count as moving.
    """
    rate = trials.select("trial_id", F.coalesce("meta.fps", F.lit(30.0)).alias("fps"))
    df = pose.select("trial_id", "frame_idx", "pos", P.y("LEFT_ANKLE").alias("l"), P.y("RIGHT_ANKLE").alias("r")).join(rate, "trial_id")
    moving = F.lit(False)
    near = Window.partitionBy("trial_id").orderBy("time").rangeBetween(-window / 2 - 1e-9, window / 2 + 1e-9)
    df = df.withColumn("time", F.col("pos") / F.col("fps"))
    for c in ("l", "r"):
        spread = F.when(F.count(c).over(near) >= 3, F.stddev_pop(c).over(near))
        moving = moving | F.coalesce(spread > ratio * (F.max(c).over(P.trial()) - F.min(c).over(P.trial())), F.lit(False))
    df = df.withColumn("moving", moving)
    few = F.avg(F.col("moving").cast("int")).over(P.trial()) < 0.05
    return df.select("trial_id", "frame_idx", (F.col("moving") | few).alias("moving"))


def trim_standstill(events: DataFrame, mask: DataFrame) -> DataFrame:
    """Events in frames that move."""
    return events.join(mask.filter("moving").select("trial_id", F.col("frame_idx").alias("frame")), ["trial_id", "frame"], "left_semi")


def consensus(events: DataFrame, tolerance: int = 3, votes: int | None = None, n_methods: int | None = None) -> DataFrame:
    """trial_id, side, kind, frame, n_methods: runs of events no more than ``tolerance`` frames apart that enough methods share.

    A run's frame is the whole part of its median. By default half of the methods, rounded up, have to be in it.
    """
    key = ["trial_id", "side", "kind"]
    w = Window.partitionBy(*key).orderBy("frame", "method")
    gap = F.col("frame") - F.lag("frame").over(w)
    runs = series.islands(events, key, gap.isNull() | (gap > tolerance), "run", ["frame", "method"])
    grouped = runs.groupBy(*key, "run").agg(F.floor(F.median("frame")).cast("int").alias("frame"), F.countDistinct("method").alias("n_methods"))
    if votes is None and n_methods is None:
        need = events.groupBy("trial_id").agg(F.ceil(F.countDistinct("method") / 2).alias("need"))
        grouped = grouped.join(need, "trial_id").filter(F.col("n_methods") >= F.col("need"))
    else:
        grouped = grouped.filter(F.col("n_methods") >= (votes or -(-n_methods // 2)))
    return grouped.select(*key, "frame", "n_methods")


def thinned(events: DataFrame, distance: int) -> DataFrame:
    """trial_id, side, kind, frame: events at least ``distance`` frames after the last one kept."""
    return series.thin(events, ["trial_id", "side", "kind"], "frame", distance)


def alternation(events: DataFrame) -> DataFrame:
    """trial_id, n, share: how many successive contacts there are, and the share that changes side."""
    w = Window.partitionBy("trial_id").orderBy("frame", "side")
    pairs = events.filter("kind = 'hs'").select("trial_id", (F.lag("side").over(w) != F.col("side")).alias("changes")).filter(F.col("changes").isNotNull())
    return pairs.groupBy("trial_id").agg(F.count("*").alias("n"), F.avg(F.col("changes").cast("int")).alias("share"))


def validate_events(events: DataFrame, rate: Column | float) -> DataFrame:
    """trial_id, valid, issues, n_valid_left, n_valid_right: what is implausible of each trial's contacts and lift-offs.

    A side has to have both kinds. Its cycles, from contact to contact, last 0.4 to 2.5 s, and a lift-off within one comes
    after 30 to 80 % of it; the others count as valid. Where both sides have contacts, no more than half of all
    follow one of their own side. Trials are those of events; rate is a number or a column of events.
    """
    every = cycles.segment(events, rate, 0.0, float("inf"))
    kinds = {f"__{k}_{s}": F.count_if((F.col("kind") == k) & (F.col("side") == s)) for s in ("left", "right") for k in ("hs", "to")}
    have = events.groupBy("trial_id").agg(*[c.alias(n) for n, c in kinds.items()])
    d, share = F.col("duration"), F.col("stance_pct")
    at = F.concat(F.col("side"), F.lit(" cycle at frame "), F.col("start_frame").cast("string"), F.lit(": "))
    issue = (
        F.when(d < 0.4, F.concat(at, F.format_string("%.2f s, under 0.4", d))).when(d > 2.5, F.concat(at, F.format_string("%.2f s, over 2.5", d)))
        .when(share < 30, F.concat(at, F.format_string("stance %.1f %%, under 30", share))).when(share > 80, F.concat(at, F.format_string("stance %.1f %%, over 80", share)))
    )
    judged = every.select("trial_id", "side", "start_frame", issue.alias("issue"))
    one = lambda s: F.count_if((F.col("side") == s) & F.col("issue").isNull())
    listed = lambda s: F.transform(F.array_sort(F.collect_list(F.when((F.col("side") == s) & F.col("issue").isNotNull(), F.struct("start_frame", "issue")))), lambda r: r["issue"])
    found = judged.groupBy("trial_id").agg(*[f(s).alias(f"__{n}_{s}") for s in ("left", "right") for n, f in (("n", one), ("issues", listed))])
    w = Window.partitionBy("trial_id").orderBy("frame", "side")
    same = events.filter("kind = 'hs'").select("trial_id", (F.lag("side").over(w) == F.col("side")).alias("s")).groupBy("trial_id").agg(F.count_if("s").alias("__same"))
    out = have.join(found, "trial_id", "left").join(same, "trial_id", "left")
    none = F.array().cast("array<string>")
    parts = []
    for s in ("left", "right"):
        lacks = F.when(F.col(f"__hs_{s}") == 0, F.array(F.lit(f"no contacts on the {s}"))).when(F.col(f"__to_{s}") == 0, F.array(F.lit(f"no lift-offs on the {s}")))
        parts.append(F.coalesce(lacks, F.col(f"__issues_{s}"), none))
    turns = (F.col("__hs_left") > 0) & (F.col("__hs_right") > 0) & (F.col("__same") > 0.5 * (F.col("__hs_left") + F.col("__hs_right")))
    parts.append(F.when(turns, F.array(F.concat(F.lit("sides don't alternate: "), F.col("__same").cast("string"), F.lit(" contacts follow one of their side")))).otherwise(none))
    valid = lambda s: F.when((F.col(f"__hs_{s}") > 0) & (F.col(f"__to_{s}") > 0), F.coalesce(f"__n_{s}", F.lit(0))).otherwise(0).alias(f"n_valid_{s}")
    out = out.withColumn("issues", F.concat(*parts))
    return out.select("trial_id", (F.size("issues") == 0).alias("valid"), "issues", valid("left"), valid("right"))
