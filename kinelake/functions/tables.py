"""Registries in SQL: table functions over event detectors, and what can be chosen."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from kinelake.exceptions import InvalidData, UnknownName
from kinelake.operators import events, pose, signals
from kinelake.schemas import EVENTS

#: Columns that a table of detect_events has: those of events.wide_tracks.
NEEDED = ("trial_id", "frame_idx", "pos", *[f"{n}_{a}" for n in events.NEEDED for a in "xy"])


@dataclass
class Settings(AnalyzeResult):
    """What analyze has found, for the rows that follow."""

    method: str = "zeni"
    rate: float = 30.0
    least: float = 0.4
    cutoff: float = 6.0


def _constant(name: str, argument: AnalyzeArgument | None, default):
    if argument is None:
        return default
    if argument.isTable or not argument.isConstantExpression:
        raise InvalidData(f"{name} has to be a constant")
    return default if argument.value is None else type(default)(argument.value)


def _detector(methods: dict):
    """A table function over these detectors, which go with it to the tasks."""

    class DetectEvents:
        """detect_events(TABLE(tracks) PARTITION BY trial_id ORDER BY pos, method, rate, least, cutoff): the events of each trial."""

        @staticmethod
        def analyze(tracks: AnalyzeArgument, method: AnalyzeArgument | None = None, rate: AnalyzeArgument | None = None, least: AnalyzeArgument | None = None, cutoff: AnalyzeArgument | None = None) -> Settings:
            if not tracks.isTable:
                raise InvalidData("detect_events takes a table first")
            missing = [c for c in NEEDED if c not in tracks.dataType.names]
            if missing:
                raise InvalidData(f"no column {', '.join(missing)}")
            chosen = _constant("method", method, "zeni")
            if chosen not in methods:
                raise UnknownName(chosen)
            key = tracks.dataType["trial_id"].dataType
            schema = T.StructType([T.StructField("trial_id", key), *EVENTS.fields[1:]])
            return Settings(schema, method=chosen, rate=_constant("rate", rate, 30.0), least=_constant("least", least, 0.4), cutoff=_constant("cutoff", cutoff, 6.0))

        def __init__(self, settings: Settings):
            self.settings = settings
            self.trial, self.frames, self.columns = None, [], {c: [] for c in NEEDED[3:]}

        def eval(self, tracks, method=None, rate=None, least=None, cutoff=None):
            self.trial = tracks["trial_id"]
            self.frames.append(tracks["frame_idx"])
            for c, own in self.columns.items():
                own.append(tracks[c])

        def terminate(self):
            s = self.settings
            if len(self.frames) <= 3:
                return
            series = {c: np.array(own, float) for c, own in self.columns.items()}
            for (side, kind), found in methods[s.method](series, s.rate, s.least, s.cutoff).items():
                for p, q in found:
                    frame = int(self.frames[p])
                    yield self.trial, side, kind, frame, round(frame / s.rate, 4), float(q), s.method

    return DetectEvents


def register(spark: SparkSession) -> None:
    """Make ``detect_events`` and ``engine_choices`` known to SQL, with the detectors, steps and methods registered by now."""
    spark.udtf.register("detect_events", udtf(_detector(dict(events.methods()))))
    rows = [(r, n) for r, names in (("step", signals.list_steps()), ("angle method", pose.list_angle_methods()), ("event method", events.list_event_methods())) for n in names]

    class EngineChoices:
        def eval(self):
            yield from rows

    spark.udtf.register("engine_choices", udtf(EngineChoices, returnType="registry string, name string"))
