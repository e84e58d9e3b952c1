"""MATLAB files of level 5: numbers, texts, structs and cells, compressed or not."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.exceptions import InvalidData

# Fixed values of the format: element types of numbers, and array classes of numbers.
_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2"}
_MATRIX, _COMPRESSED = 14, 15
_CELL, _STRUCT, _CHAR = 1, 2, 4


def _elements(data: bytes, order: str):
    """(type, content) of the elements in a run of bytes; short ones hold their content in their tag."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + (size if kind == _COMPRESSED else -(-size // 8) * 8)


def _numbers(kind: int, content: bytes, order: str) -> np.ndarray:
    if kind not in _NUMBERS:
        raise InvalidData(f"no numbers of type {kind}")
    return np.frombuffer(content, np.dtype(order + _NUMBERS[kind]))


def _array(content: bytes, order: str):
    """Name and value of a matrix element: an array, a text, a list for cells, a dict (or list of dicts) for structs."""
    parts = _elements(content, order)
    flags = next(parts, None)
    if flags is None:
        return "", None
    kind = struct.unpack_from(order + "I", flags[1])[0] & 0xFF
    dims = _numbers(*next(parts), order).astype(int).tolist()
    name = next(parts)[1].decode("latin-1")
    if kind == _CELL:
        return name, [_array(c, order)[1] for _, c in parts]
    if kind == _STRUCT:
        width = int(_numbers(*next(parts), order)[0])
        raw = next(parts)[1]
        fields = [raw[k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(raw), width)]
        values = [_array(c, order)[1] for _, c in parts]
        rows = [dict(zip(fields, values[k : k + len(fields)], strict=False)) for k in range(0, len(values), len(fields))] if fields else []
        return name, rows[0] if len(rows) == 1 else rows
    real = next(parts, None)
    values = _numbers(*real, order) if real else np.zeros(0)
    if kind == _CHAR:
        return name, "".join(map(chr, values.tolist()))
    return name, values.reshape(dims, order="F")


def parse_mat(content: bytes) -> dict:
    """Variables of a file by name."""
    if len(content) < 128 or content[126:128] not in (b"IM", b"MI"):
        raise InvalidData("not a MATLAB file of level 5")
    order = "<" if content[126:128] == b"IM" else ">"
    out = {}
    for kind, body in _elements(content[128:], order):
        if kind == _COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind == _MATRIX:
            name, value = _array(body, order)
            out[name] = value
    return out


def read_angles(spark: SparkSession, path: str, variable: str, column: int = 2) -> DataFrame:
    """trial_id (the file), name, pos, value: one column of each array in a struct variable, as joint angles over frames.

    Arrays of one column are taken as they are; fields that aren't numbers, and files without the variable, give no rows.
    """

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = parse_mat(content).get(variable)
                names, pos, values = [], [], []
                for name, array in (value.items() if isinstance(value, dict) else []):
                    if isinstance(array, np.ndarray) and array.ndim == 2 and array.dtype.kind in "iuf" and array.size:
                        own = array[:, min(column, array.shape[1] - 1)].astype(float)
                        names += [name] * len(own)
                        pos += range(len(own))
                        values += [None if np.isnan(v) else float(v) for v in own]
                yield pa.record_batch([pa.array([file.rsplit(".", 1)[0]] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(pos, pa.int32()), pa.array(values, pa.float64())], names=["trial_id", "name", "pos", "value"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(run, "trial_id string, name string, pos int, value double")


def read_events(spark: SparkSession, path: str, variable: str, keys: dict[str, tuple[str, str]]) -> DataFrame:
    """trial_id, side, kind, frame of events held in a struct variable; keys names the fields: field -> (side, kind)."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = parse_mat(content).get(variable)
                rows = [(file.rsplit(".", 1)[0], *keys[f], int(v)) for f, array in (value.items() if isinstance(value, dict) else []) if f in keys and isinstance(array, np.ndarray) for v in array.ravel() if v == v]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], names=["trial_id", "side", "kind", "frame"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(run, "trial_id string, side string, kind string, frame int")
