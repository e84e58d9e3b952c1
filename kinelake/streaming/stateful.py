"""Contacts of streams through a filter whose delay line is in the state, equal to the same detector over whole recordings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinelake.functions import kernels as K

#: What goes on from sample to sample: time and value of the last filtered one, the value before, time of the last peak, both delays.
CARRY = "t1 long, v1 double, v2 double, last long, z1 double, z2 double"
_NONE = (None, float("nan"), float("nan"), None, 0.0, 0.0)


class CausalContacts:
    """A low-pass of second order, forward only, and peaks of what comes out, sample by sample over any number of calls.

    The filter begins at rest in its first value, and so after a pause of more than ``pause`` microseconds. A peak is higher
    than the sample before and not lower than the one after, and ``step`` microseconds after the last peak at least.
    """

    def __init__(self, rate: float, cutoff: float, step: int, pause: int):
        self.b, self.a = (v.tolist() for v in K.butterworth(2, cutoff, rate))
        self.step, self.pause = step, pause

    def run(self, at: list[int], values: list[float], carry: tuple) -> tuple[list[tuple[int, float]], tuple]:
        """Peaks (time, filtered value) of samples in order of time, and what to carry on."""
        t1, v1, v2, last, z1, z2 = carry
        (b0, b1, b2), (_, a1, a2) = self.b, self.a
        found = []
        for t, x in zip(at, values, strict=True):
            if t1 is None or t - t1 > self.pause:
                rest2 = (b2 - a2) * x  # delays at which a constant x stays x
                z1, z2, v1, v2 = (b1 - a1) * x + rest2, rest2, float("nan"), float("nan")
                t1 = None
            y = b0 * x + z1
            z1, z2 = b1 * x - a1 * y + z2, b2 * x - a2 * y
            if t1 is not None and v1 > v2 and v1 >= y and (last is None or t1 - last >= self.step):
                found.append((t1, v1))
                last = t1
            t1, v1, v2 = t, y, v1
        return found, (t1, v1, v2, last, z1, z2)


def _settings(rate: float, cutoff: float, least: float, pause: float) -> CausalContacts:
    return CausalContacts(rate, cutoff, int(least * 1e6), int(pause * 1e6))


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy("datetime64[us]").astype(np.int64)


def _ordered(at: np.ndarray, values: np.ndarray) -> tuple[list[int], list[float]]:
    """Samples by time, of one time the least value."""
    order = np.lexsort((values, at))
    at, values = at[order], values[order]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    return at[new].tolist(), values[new].tolist()


def causal_contacts(frames: DataFrame, rate: float = 30.0, cutoff: float = 6.0, least: float = 0.4, pause: float = 1.0) -> DataFrame:
    """trial_id, ts, height: peaks of a signal (trial_id, ts, value) behind a causal low-pass, over whole recordings.

    Missing values are left out; of several samples of one time the least value counts.
    """
    machine = _settings(rate, cutoff, least, pause)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pandas().dropna(subset=["ts", "value"])
        found, _ = machine.run(*_ordered(_micros(rows["ts"].dt.tz_localize(None) if rows["ts"].dt.tz is not None else rows["ts"]), rows["value"].to_numpy(float)), _NONE)
        stamps = pa.array([t for t, _ in found], pa.int64()).cast(pa.timestamp("us")).cast(table.schema.field("ts").type) if found else pa.array([], table.schema.field("ts").type)
        return pa.table({"trial_id": pa.array([table.column("trial_id")[0].as_py()] * len(found), table.schema.field("trial_id").type), "ts": stamps, "height": pa.array([h for _, h in found], pa.float64())})

    kinds = dict(frames.dtypes)
    return frames.select("trial_id", "ts", F.col("value").cast("double").alias("value")).groupBy("trial_id").applyInArrow(run, f"trial_id {kinds['trial_id']}, ts {kinds['ts']}, height double")


class ContactProcessor(StatefulProcessor):
    """Samples wait until the watermark has passed them, go through the filter in order of time, and are forgotten a while after the last."""

    def __init__(self, machine: CausalContacts, forget: int):
        self.machine, self.forget = machine, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", CARRY)
        self.waiting = handle.getListState("waiting", "at long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).dropna(subset=["ts", "value"])
        added = list(zip(_micros(new["ts"]).tolist(), new["value"].astype(float).tolist(), strict=True))
        yield self._advance(key, added, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, added: list[tuple[int, float]], watermark: int) -> pd.DataFrame:
        """Filter all samples that the watermark has passed, keep the rest, and set the timer for what comes next."""
        carry = self.carry.get() if self.carry.exists() else _NONE
        carry = tuple(carry)
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        # What isn't later than a sample that went through can't be put before it any more.
        rows = [r for r in held + added if carry[0] is None or r[0] > carry[0]]
        ready = [r for r in rows if r[0] <= watermark * 1000]
        rest = [r for r in rows if r[0] > watermark * 1000]
        found = []
        if ready:
            at, values = _ordered(np.array([r[0] for r in ready]), np.array([r[1] for r in ready], float))
            found, carry = self.machine.run(at, values, carry)
            self.carry.update(carry)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-min(r[0] for r in rest) // 1000))
        else:
            self.waiting.clear()
            if carry[0] is not None:
                end = carry[0] // 1000 + self.forget
                if end <= watermark:
                    self.carry.clear()
                else:
                    self.handle.registerTimer(end)
        return pd.DataFrame({"trial_id": pd.Series([key[0]] * len(found), dtype=object), "ts": np.array([t for t, _ in found], "datetime64[us]"), "height": np.array([h for _, h in found], float)})

    def close(self) -> None:
        pass


def online_contacts(frames: DataFrame, rate: float = 30.0, cutoff: float = 6.0, least: float = 0.4, pause: float = 1.0, late: str = "2 seconds", forget: float = 300.0) -> DataFrame:
    """The same of a stream of samples (trial_id, ts, value), whatever its micro-batches: equal to causal_contacts over all that came in time.

    Samples wait for the watermark, ``late`` behind the newest of all trials, and go through in order of time; those that
    come behind it are left out. State is the filter's delay line, the last samples and what waits; it goes when the watermark
    is ``forget`` seconds beyond a trial's last sample. Needs the state store on RocksDB
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    processor = ContactProcessor(_settings(rate, cutoff, least, pause), int(forget * 1000))
    kind = dict(frames.dtypes)["trial_id"]
    own = frames.select("trial_id", "ts", F.col("value").cast("double").alias("value")).withWatermark("ts", late)
    return own.groupBy("trial_id").transformWithStateInPandas(processor, f"trial_id {kind}, ts timestamp, height double", "Append", "EventTime")
