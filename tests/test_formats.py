"""Motion files as data sources: the same rows as the plain readers, filters handed down, and fewer bytes for less."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.sources import formats, pivot, sinks
from tests.test_matlab import double, file_of, struct_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    formats.register(spark)
    top = tmp_path_factory.mktemp("motion")
    rng = np.random.default_rng(3)
    for t, n in (("a", 200), ("b", 30), ("empty", 0)):
        frames = [[None if (k + j) % 11 == 5 else tuple(np.float32(v).item() for v in rng.normal(size=3)) for j in range(5)] for k in range(n)]
        (top / f"{t}.c3d").write_bytes(sinks.build_c3d([f"P{j}" for j in range(5)], 50.0, frames))
    head = "PathFileType\t4\t(X/Y/Z)\tt.trc\nDataRate\tCameraRate\tNumFrames\tNumMarkers\tUnits\tOrigDataRate\tOrigDataStartFrame\tOrigNumFrames\n50\t50\t400\t2\tmm\t50\t1\t400\nFrame#\tTime\tA\t\t\tB\t\t\n\t\tX1\tY1\tZ1\tX2\tY2\tZ2\n"
    body = "".join(f"{k}\t{k / 50:.3f}\t{k}.5\t2\t3\t" + ("\t\t" if k % 4 == 0 else f"{k}\t5\t6") + "\n" for k in range(1, 4001))
    (top / "t.trc").write_text(head + body)
    for trial, frame, points in (("w", 0, [1, 2, 0.5, 3, 4, 0.0]), ("w", 1, [5, 6, 0.9, 7, 8, 0.1]), ("v", 0, [])):
        (top / f"{trial}_{frame:012d}_keypoints.json").write_text(json.dumps({"people": [{"pose_keypoints_2d": points}] if points else []}))
    (top / "m.mat").write_bytes(file_of(struct_of("res_angles_t", knee=double("", np.arange(30).reshape(10, 3)), hip=double("", [[1], [float("nan")]]))))
    return f"file://{top}"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("size", [1 << 30, 4000])
def test_same_rows_as_the_plain_readers(spark, folder, size):
    """Whole files, and large ones cut into runs of frames."""
    c3d = spark.read.format("c3d").option("partitionBytes", size).load(folder)
    assert rows(c3d) == rows(pivot.read_c3d(spark, f"{folder}/*.c3d").select(c3d.columns)) and c3d.count() > 900
    trc = spark.read.format("trc").load(f"{folder}/*.trc")
    plain = pivot.read_trc(spark, f"{folder}/*.trc").filter("X IS NOT NULL").select(trc.columns)
    assert rows(trc) == rows(plain)


def test_filters_are_handed_down(spark, folder):
    c3d = spark.read.format("c3d").load(folder)
    asked = (F.col("name").isin("P1", "P3")) & (F.col("frame_idx") >= 20) & (F.col("frame_idx") < 25) & (F.col("trial_id") == "a") & (F.col("X") > -9)
    some = c3d.filter(asked)
    assert rows(some) == rows(pivot.read_c3d(spark, f"{folder}/*.c3d").select(c3d.columns).filter(asked)) and some.count() > 5
    own = plan(some).split("== Physical Plan ==")[1]
    assert "X" in own and "frame_idx#" in own and ">= 20" not in own.replace("PushedFilters", "")
    trc = spark.read.format("trc").load(f"{folder}/t.trc").filter("frame_idx = 7 AND name = 'A'")
    assert rows(trc) == [("t", 7, 0.14, "A", 0.0075, 0.002, 0.003)]
    points = spark.read.format("keypoint_json").load(folder)
    assert rows(points) == [("w", 0, 0, 1.0, 2.0, 0.5), ("w", 1, 0, 5.0, 6.0, 0.9), ("w", 1, 1, 7.0, 8.0, 0.1)]
    assert rows(points.filter("trial_id = 'w' AND frame_idx > 0 AND idx = 1")) == [("w", 1, 1, 7.0, 8.0, 0.1)]


def test_matlab_angles(spark, folder):
    df = spark.read.format("motion_mat").load(f"{folder}/m.mat")
    assert rows(df) == sorted([("m", "knee", k, 3.0 * k + 2) for k in range(10)] + [("m", "hip", 0, 1.0), ("m", "hip", 1, None)], key=repr)
    assert rows(df.filter("name = 'knee' AND pos >= 3 AND pos < 5")) == [("m", "knee", 3, 11.0), ("m", "knee", 4, 14.0)]
    assert rows(spark.read.format("motion_mat").option("column", 0).load(f"{folder}/m.mat").filter("pos = 9")) == [("m", "knee", 9, 27.0)]


def read(source, options, filters=(), schema=None):
    from pyspark.sql.types import StructType

    made = source(options)
    reader = made.reader(StructType.fromDDL(schema or made.schema()))
    left = list(reader.pushFilters(list(filters)))
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    return reader, left, sum(b.num_rows for b in batches), batches


def test_less_is_read_for_less(spark, folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, StringContains

    whole, _, n, _ = read(formats.C3dSource, {"path": f"{folder}/a.c3d"})
    frames = [GreaterThanOrEqual(("frame_idx",), 50), LessThan(("frame_idx",), 60)]
    part, left, m, _ = read(formats.C3dSource, {"path": f"{folder}/a.c3d"}, [*frames, StringContains(("name",), "P")])
    assert len(left) == 1 and 0 < m < n / 10
    assert whole.bytes_read - part.bytes_read == 190 * 5 * 16
    one, left, m, _ = read(formats.C3dSource, {"path": folder}, [EqualTo(("trial_id",), "b"), In(("name",), ("P0", "none"))])
    assert not left and 0 < m <= 30 and one.bytes_read < 512 * 6 + 30 * 80
    trc, _, _, _ = read(formats.TrcSource, {"path": f"{folder}/t.trc"})
    early, _, m, _ = read(formats.TrcSource, {"path": f"{folder}/t.trc"}, [LessThan(("frame_idx",), 10)])
    assert early.bytes_read < trc.bytes_read / 3 and m == 9 + 7
    _, _, m, batches = read(formats.C3dSource, {"path": f"{folder}/a.c3d"}, [GreaterThan(("frame_idx",), 197)], "name string, X double")
    assert batches[0].schema.names == ["name", "X"] and 0 < m <= 10
    assert read(formats.C3dSource, {"path": f"{folder}/a.c3d"}, [GreaterThan(("frame_idx",), 500)])[2] == 0


def test_columns_of_a_schema(spark, folder):
    df = spark.read.format("c3d").schema("name string, X double").load(f"{folder}/b.c3d")
    assert df.columns == ["name", "X"] and df.count() == pivot.read_c3d(spark, f"{folder}/b.c3d").count()


def test_what_isn_t_there(spark, folder, tmp_path):
    from pyspark.sql.types import StructType

    from kinelake.exceptions import InvalidData

    with pytest.raises(InvalidData):
        formats.list_files(f"{folder}/nothing", ".c3d")
    with pytest.raises(InvalidData):
        formats.C3dSource({}).reader(StructType([]))
    (tmp_path / "bad.c3d").write_bytes(b"no")
    with pytest.raises(Exception, match="not a C3D file"):
        spark.read.format("c3d").load(f"file://{tmp_path}").collect()
