"""MATLAB files written byte by byte."""

import struct
import zlib

import numpy as np
import pytest

from kinelake.exceptions import InvalidData
from kinelake.sources import matlab


def element(kind, content):
    return struct.pack("<II", kind, len(content)) + content + b"\0" * (-len(content) % 8)


def matrix(name, kind, dims, *parts):
    return element(14, element(6, struct.pack("<II", kind, 0)) + element(5, struct.pack(f"<{len(dims)}i", *dims)) + element(1, name.encode()) + b"".join(parts))


def double(name, array):
    a = np.asarray(array, float)
    return matrix(name, 6, a.shape, element(9, a.tobytes(order="F")))


def struct_of(name, **fields):
    names = b"".join(f.encode().ljust(32, b"\0") for f in fields)
    return matrix(name, 2, (1, 1), struct.pack("<HHi", 5, 4, 32), element(1, names), *fields.values())


def file_of(*variables, compress=False):
    body = b"".join(struct.pack("<II", 15, len(z := zlib.compress(v))) + z if compress else v for v in variables)
    return b"text".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + body


@pytest.mark.parametrize("compress", [False, True])
def test_values(compress):
    text = matrix("t", 4, (1, 2), element(17, "hé".encode("utf-16-le")))
    cell = matrix("c", 1, (1, 2), double("", [[1]]), double("", [[2, 3]]))
    out = matlab.parse_mat(file_of(double("x", [[1, 2], [3, 4], [5, 6]]), text, cell, struct_of("s", a=double("", [[7]]), b=double("", np.zeros((0, 0)))), compress=compress))
    assert out["x"].tolist() == [[1, 2], [3, 4], [5, 6]]
    assert out["t"] == "hé"
    assert [v.tolist() for v in out["c"]] == [[[1]], [[2, 3]]]
    assert out["s"]["a"].tolist() == [[7]] and out["s"]["b"].size == 0


def test_other_files_are_refused():
    with pytest.raises(InvalidData):
        matlab.parse_mat(b"x" * 200)


def test_reading(spark, tmp_path):
    angles = struct_of("model", LKnee=double("", [[0, 0, 10], [0, 0, np.nan]]), note=matrix("", 4, (1, 1), element(17, b"x\0")))
    events = struct_of("ev", LHS=double("", [[5, 9]]), RTO=double("", [[7]]))
    (tmp_path / "t1.mat").write_bytes(file_of(angles, events, compress=True))
    where = f"file://{tmp_path}/*.mat"
    assert [tuple(r) for r in matlab.read_angles(spark, where, "model").orderBy("pos").collect()] == [("t1", "LKnee", 0, 10.0), ("t1", "LKnee", 1, None)]
    got = matlab.read_events(spark, where, "ev", {"LHS": ("left", "hs"), "RTO": ("right", "to")}).orderBy("frame").collect()
    assert [tuple(r) for r in got] == [("t1", "left", "hs", 5), ("t1", "right", "to", 7), ("t1", "left", "hs", 9)]
