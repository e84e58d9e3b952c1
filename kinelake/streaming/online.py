"""Continuous operators: cadence, movement and walking bouts over streams of events and frames.

Batch tables work as well: all are plain transformations, and watermarks are ignored there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_cadence(contacts: DataFrame, late: str = "30 seconds", length: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """trial_id, start, end, n, cadence (steps a minute) of contacts (trial_id, ts) in tumbling or sliding windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    own = contacts.withWatermark("ts", late).groupBy("trial_id", w.alias("w")).agg(F.count("*").alias("n"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return own.select("trial_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", (60.0 * F.col("n") / seconds).alias("cadence"))


def moving_windows(frames: DataFrame, late: str = "30 seconds", length: str = "1 second", slide: str = "500 milliseconds", least: float = 0.003) -> DataFrame:
    """trial_id, start, end, spread, moving: deviation of a height (trial_id, ts, y) in sliding windows."""
    own = frames.withWatermark("ts", late).groupBy("trial_id", F.window("ts", length, slide).alias("w")).agg(F.stddev_pop("y").alias("spread"))
    return own.select("trial_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "spread", (F.col("spread") > least).alias("moving"))


def walking_bouts(contacts: DataFrame, gap: str = "5 seconds", late: str = "30 seconds") -> DataFrame:
    """trial_id, start, end, n: sessions of contacts no further apart than a gap."""
    own = contacts.withWatermark("ts", late).groupBy("trial_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return own.select("trial_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(frames: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Frames that were sent again are dropped."""
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(["trial_id", "frame_idx"])


def online_contacts(frames: DataFrame, least: float = 0.4, late: str = "30 seconds", forget: float = 300.0) -> DataFrame:
    """trial_id, ts, height: peaks of a signal (trial_id, ts, value), each at least ``least`` seconds after the last.

    State per trial is the last two samples and the time of the last peak; it goes once the watermark, ``late`` behind the
    newest sample of all trials, is ``forget`` seconds beyond the trial's last sample. Samples that come after a later
    one of their trial was used, and missing ones, are left out, as they can't be put in between any more.
    """
    step = int(least * 1e6)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        t1, v1, v2, last = state.get if state.exists else (None, float("nan"), float("nan"), None)
        rows = pd.concat(list(parts)).dropna(subset=["ts", "value"])
        at, value = rows["ts"].to_numpy("datetime64[us]").astype(np.int64), rows["value"].to_numpy(float)
        order = np.argsort(at, kind="stable")
        at, value = at[order], value[order]
        if t1 is not None:
            at, value = at[at > t1], value[at > t1]
        if not len(at):
            return
        times = np.concatenate([[at[0] if t1 is None else t1], at[:-1]])
        tops = np.concatenate([[v1], value[:-1]])
        before = np.concatenate([[v2], tops[:-1]])
        found = []
        for k in np.flatnonzero((tops > before) & (tops >= value)).tolist():  # never where one isn't known
            if last is None or times[k] - last >= step:
                last = int(times[k])
                found.append(k)
        state.update((int(at[-1]), float(value[-1]), float(tops[-1]), last))
        state.setTimeoutTimestamp(max(int(at[-1] // 1000 + forget * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"trial_id": [key[0]] * len(found), "ts": times[found].astype("datetime64[us]"), "height": tops[found]})

    kind = dict(frames.dtypes)["trial_id"]
    return frames.withWatermark("ts", late).groupBy("trial_id").applyInPandasWithState(run, f"trial_id {kind}, ts timestamp, height double", "t1 long, v1 double, v2 double, last long", "append", GroupStateTimeout.EventTimeTimeout)
