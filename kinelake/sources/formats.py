"""Motion files as Spark data sources: ``spark.read.format("c3d")``, ``trc``, ``motion_mat`` and ``keypoint_json``.

Files are dealt by size: small ones share a partition, large C3D files are cut into runs of frames. Filters on frames, times, points
and files are taken over, so that of a C3D file only the frames asked for are read (with
``spark.sql.python.filterPushdown.enabled``, which ``register`` sets); columns are those of the schema that the reader is given.
"""

from __future__ import annotations

import io
import json
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from kinelake.exceptions import InvalidData
from kinelake.sources.matlab import parse_mat

#: Bytes of files in a partition, about, and rows of a batch.
PARTITION_BYTES, BATCH_ROWS = 32 << 20, 65_536
MARKERS = "trial_id string, frame_idx int, time_s double, name string, X double, Y double, Z double"


@dataclass
class Part(InputPartition):
    """Files (path, size) and of these the k-th of ``pieces`` runs of frames."""

    files: tuple[tuple[str, int], ...]
    piece: int = 0
    pieces: int = 1


@dataclass
class Asked:
    """What filters ask for; None is everything."""

    trials: frozenset[str] | None = None
    names: frozenset[str] | None = None
    first: float = -math.inf
    last: float = math.inf

    def among(self, field: str, values) -> None:
        own = frozenset(values) if getattr(self, field) is None else getattr(self, field) & frozenset(values)
        setattr(self, field, own)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_files(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, size) of the files under a folder, or that match a pattern of * and ? in the last part, or of one file."""
    folder, _, last = path.rstrip("/").rpartition("/")
    if re.search(r"[*?]", last):
        store, root = _open(folder)
        fits = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in last))
        found = [f for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and fits.fullmatch(f.base_name)]
    else:
        store, root = _open(path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise InvalidData(f"nothing at {path}")
        found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.base_name.lower().endswith(ending)]
    scheme = re.match(r"^([a-z0-9+.-]+://[^/]*)/", path)
    prefix = scheme[1] if scheme and not path.startswith("file:") else ""
    return sorted((f"{prefix}{f.path}" if not prefix or f.path.startswith("/") else f"{prefix}/{f.path.partition('/')[2]}", f.size) for f in found)


def trial_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


class FileReader(DataSourceReader):
    """Plans partitions over files and keeps what filters ask for; formats say how a file's rows are read."""

    ending = ""
    splits = False
    #: Columns that filters are taken over for: of files, of names, and of the frame.
    name_column, frame_column = "name", "frame_idx"

    def __init__(self, schema: T.StructType, options: dict):
        if "path" not in options:
            raise InvalidData("give a path to load")
        self.options, self.arrow = dict(options), to_arrow_schema(schema)
        self.asked = Asked()
        self.bytes_read = 0

    def pushFilters(self, filters):
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f) -> bool:
        """Whether a filter is wholly taken over."""
        column = f.attribute[0] if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
        field = {"trial_id": "trials", self.name_column: "names"}.get(column)
        if field and isinstance(f, (EqualTo, In)):
            self.asked.among(field, [f.value] if isinstance(f, EqualTo) else f.value)
            return True
        if column == self.frame_column and not isinstance(f, In):
            a = self.asked
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                a.first = max(a.first, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                a.last = min(a.last, f.value - isinstance(f, LessThan))
            return True
        return False

    def partitions(self) -> list[Part]:
        least = int(self.options.get("partitionbytes", self.options.get("partitionBytes", PARTITION_BYTES)))
        out, held, size = [], [], 0
        for path, n in list_files(self.options["path"], self.ending):
            if self.asked.trials is not None and trial_of(path) not in self.asked.trials:
                continue
            if self.splits and n > least:
                pieces = -(-n // least)
                out += [Part(((path, n),), k, pieces) for k in range(pieces)]
                continue
            if held and size + n > least:
                out.append(Part(tuple(held)))
                held, size = [], 0
            held.append((path, n))
            size += n
        return [*out, Part(tuple(held))] if held else out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for path, size in partition.files:
            store, at = _open(path)
            with store.open_input_file(at) as f:
                for columns in self.rows(trial_of(path), f, size, partition):
                    n = len(next(iter(columns.values())))
                    for k in range(0, n, BATCH_ROWS):
                        yield pa.record_batch([pa.array(columns[c][k : k + BATCH_ROWS], t, from_pandas=True) for c, t in zip(self.arrow.names, self.arrow.types, strict=True)], schema=self.arrow)

    def take(self, f, start: int, size: int) -> bytes:
        """Bytes of a file, counted."""
        f.seek(start)
        data = f.read(size)
        self.bytes_read += len(data)
        return data

    def rows(self, trial: str, f, size: int, part: Part) -> Iterator[dict]:
        raise NotImplementedError

    def wanted(self, names: list[str]) -> list[int]:
        return [k for k, n in enumerate(names) if self.asked.names is None or n in self.asked.names]


def _marker_columns(trial: str, frames: np.ndarray, times: np.ndarray, names: list[str], xyz: np.ndarray) -> dict:
    """Long columns of points (frame, point, axis); points without any coordinate are left out."""
    f, p = np.nonzero(~np.isnan(xyz).all(axis=2))
    own = xyz[f, p]
    return {"trial_id": [trial] * len(f), "frame_idx": frames[f], "time_s": times[f], "name": np.array(names, object)[p] if names else np.zeros(0, object), "X": own[:, 0], "Y": own[:, 1], "Z": own[:, 2]}


class C3dReader(FileReader):
    """Header and parameters, then only the frames that are asked for."""

    ending, splits = ".c3d", True

    def rows(self, trial, f, size, part):
        head = self.take(f, 0, 512)
        if len(head) < 512 or head[1] != 80:
            raise InvalidData(f"{trial}: not a C3D file")
        n_points, n_analog, first, last = struct.unpack_from("<HHHH", head, 2)
        scale, start = struct.unpack_from("<fH", head, 12)
        (rate,) = struct.unpack_from("<f", head, 20)
        labels = _c3d_labels(self.take(f, (head[0] - 1) * 512, max(0, (start - head[0]) * 512)), n_points)
        chosen = self.wanted(labels)
        real = scale < 0
        width, kind = (16, "<f4") if real else (8, "<i2")
        step = n_points * width + n_analog * (4 if real else 2)
        count = min(last - first + 1, (size - (start - 1) * 512) // step if step else 0)
        low, high = count * part.piece // part.pieces, count * (part.piece + 1) // part.pieces
        low, high = max(low, math.ceil(max(self.asked.first, 0))), min(high, math.floor(min(self.asked.last, count)) + 1)
        block = max(1, (8 << 20) // max(1, step))
        for a in range(low, high, block) if chosen else ():
            n = min(block, high - a)
            raw = np.frombuffer(self.take(f, (start - 1) * 512 + a * step, n * step), np.uint8).reshape(n, step)
            points = np.ascontiguousarray(raw[:, : n_points * width]).view(kind).reshape(n, n_points, 4)[:, chosen, :3].astype(float) * (1.0 if real else scale)
            points[(points == 0).all(axis=2)] = np.nan
            frames = np.arange(a, a + n)
            yield _marker_columns(trial, frames, frames / rate if rate else np.full(n, np.nan), [labels[k] for k in chosen], points)


def _c3d_labels(parameters: bytes, n_points: int) -> list[str]:
    """The points' labels of a parameter section; points without one are M and their number."""
    labels: list[str] = []
    groups: dict[int, str] = {}
    at = 4
    while at + 2 < len(parameters):
        size, group = struct.unpack_from("<bb", parameters, at)
        if size == 0:
            break
        name = parameters[at + 2 : at + 2 + abs(size)].decode("latin-1").upper()
        body = at + 2 + abs(size)
        (step,) = struct.unpack_from("<h", parameters, body)
        if group < 0:
            groups[-group] = name
        elif name == "LABELS" and groups.get(group) == "POINT" and parameters[body + 3] == 2 and struct.unpack_from("<b", parameters, body + 2)[0] == -1:
            wide, many = parameters[body + 4], parameters[body + 5]
            labels = [parameters[body + 6 + k * wide : body + 6 + (k + 1) * wide].decode("latin-1").strip() for k in range(many)]
        if step == 0:
            break
        at = body + step
    return (labels + [f"M{k}" for k in range(len(labels), n_points)])[:n_points]


class TrcReader(FileReader):
    """Tab-separated marker files, read line by line until the last frame that is asked for."""

    ending = ".trc"

    def rows(self, trial, f, size, part):
        lines = io.TextIOWrapper(io.BufferedReader(_Counted(f, self)), encoding="utf-8", newline=None)
        head = [lines.readline().rstrip("\r\n").split("\t") for _ in range(5)]
        factor = 0.001 if dict(zip(head[1], head[2], strict=False)).get("Units", "m") == "mm" else 1.0
        labels = [c for c in head[3][2:] if c]
        chosen = self.wanted(labels)
        frames, times, points = [], [], []

        def columns():
            return _marker_columns(trial, np.array(frames, int), np.array(times, float), [labels[k] for k in chosen], np.array(points, float).reshape(len(frames), len(chosen), 3) * factor)

        for line in lines:
            cells = line.rstrip("\r\n").split("\t")
            if len(cells) < 2 or not cells[0].strip():
                continue
            frame = int(cells[0])
            if frame > self.asked.last:
                break
            if frame < self.asked.first:
                continue
            frames.append(frame)
            times.append(float(cells[1]))
            cells += [""] * (2 + 3 * len(labels) - len(cells))
            points.append([[float(v) if v.strip() else math.nan for v in cells[2 + 3 * k : 5 + 3 * k]] for k in chosen])
            if len(frames) * max(1, len(chosen)) >= BATCH_ROWS:
                yield columns()
                frames, times, points = [], [], []
        if frames:
            yield columns()


class _Counted(io.RawIOBase):
    """A file whose bytes a reader counts."""

    def __init__(self, f, reader: FileReader):
        self.f, self.reader = f, reader

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.f.read(len(into))
        into[: len(data)] = data
        self.reader.bytes_read += len(data)
        return len(data)


class MatReader(FileReader):
    """One column of each array in a struct variable, as joint angles over frames; options variable and column."""

    ending, frame_column = ".mat", "pos"

    def rows(self, trial, f, size, part):
        value = parse_mat(self.take(f, 0, size)).get(self.options.get("variable", "res_angles_t"))
        column = int(self.options.get("column", 2))
        fields = value if isinstance(value, dict) else {}
        names = list(fields)
        for k in self.wanted(names):
            array = fields[names[k]]
            if isinstance(array, np.ndarray) and array.ndim == 2 and array.dtype.kind in "iuf" and array.size:
                low, high = max(0, math.ceil(max(self.asked.first, 0))), min(len(array), math.floor(min(self.asked.last, len(array))) + 1)
                own = array[low:high, min(column, array.shape[1] - 1)].astype(float)
                yield {"trial_id": [trial] * len(own), "name": [names[k]] * len(own), "pos": np.arange(low, low + len(own)), "value": own}


class KeypointReader(FileReader):
    """Key point documents, a frame each; trial and frame come from names like trial_000012_keypoints.json."""

    ending, name_column = "_keypoints.json", "idx"

    def partitions(self):
        own = self.asked.trials
        self.asked.trials = None  # a file's name holds the frame too
        try:
            parts = super().partitions()
        finally:
            self.asked.trials = own
        kept = [Part(tuple(f for f in p.files if self._named(trial_of(f[0])))) for p in parts]
        return [p for p in kept if p.files]

    def _named(self, stem: str):
        m = re.fullmatch(r"(.*)_(\d+)_keypoints", stem)
        if m and (self.asked.trials is None or m[1] in self.asked.trials) and self.asked.first <= int(m[2]) <= self.asked.last:
            return m[1], int(m[2])
        return None

    def rows(self, trial, f, size, part):
        trial, frame = self._named(trial)
        people = json.loads(self.take(f, 0, size).decode() or "{}").get("people") or []
        values = np.array(people[0].get("pose_keypoints_2d") or [] if people else [], float)
        triples = values[: len(values) // 3 * 3].reshape(-1, 3)
        at = [k for k in range(len(triples)) if triples[k, 2] > 0 and (self.asked.names is None or k in self.asked.names)]
        yield {"trial_id": [trial] * len(at), "frame_idx": [frame] * len(at), "idx": at, "x": triples[at, 0], "y": triples[at, 1], "confidence": triples[at, 2]}


class _Source(DataSource):
    reads: type[FileReader]
    columns: str

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: T.StructType) -> FileReader:
        known = [c.split()[0] for c in self.columns.split(", ")]
        wrong = [f.name for f in schema if f.name not in known]
        if wrong:
            raise InvalidData(f"no column {', '.join(wrong)}")
        return self.reads(schema, self.options)


class C3dSource(_Source):
    reads, columns = C3dReader, MARKERS

    @classmethod
    def name(cls) -> str:
        return "c3d"


class TrcSource(_Source):
    reads, columns = TrcReader, MARKERS

    @classmethod
    def name(cls) -> str:
        return "trc"


class MatSource(_Source):
    reads, columns = MatReader, "trial_id string, name string, pos int, value double"

    @classmethod
    def name(cls) -> str:
        return "motion_mat"


class KeypointSource(_Source):
    reads, columns = KeypointReader, "trial_id string, frame_idx int, idx int, x double, y double, confidence double"

    @classmethod
    def name(cls) -> str:
        return "keypoint_json"


SOURCES = (C3dSource, TrcSource, MatSource, KeypointSource)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and have Spark hand filters to them."""
    for source in SOURCES:
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
