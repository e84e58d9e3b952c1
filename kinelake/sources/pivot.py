"""Reading recordings: JSON documents, landmark and marker tables, and text formats of motion files."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.exceptions import InvalidData
from kinelake.functions import columns as C
from kinelake.operators.guard import status
from kinelake.schemas import DOCUMENT, MEDIAPIPE_33, POSE


def parse_documents(files: DataFrame) -> DataFrame:
    """Documents of files (name, content), NaN tokens allowed, with a status: null, or why a file can't be worked on.

    Kinds are malformed (no JSON), no_meta and no_frames (missing or empty). A field of another type is null, and so are
    all fields of a malformed document, those before the break too. trial_id defaults to the file's name without its ending.
    """
    schema = T.StructType([*DOCUMENT.fields, T.StructField("__broken", T.StringType())])
    options = {"allowNonNumericNumbers": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}
    rows = files.select("name", F.col("content").cast("string").alias("__text")).withColumn("d", F.from_json("__text", schema, options))
    # A break and a field of another type both count as broken there; without fields of the document only a break does.
    whole = F.from_json("__text", T.StructType([T.StructField(n, T.StringType()) for n in ("__none", "__broken")]), options)["__broken"].isNull()
    rows = rows.select("name", F.when(F.col("d.__broken").isNull() | whole, F.col("d")).alias("d")).select("name", "d.*")
    nothing = F.col("meta").isNull() & F.col("frames").isNull()
    failed = (
        F.when(nothing & F.col("__broken").isNotNull() | nothing & F.col("trial_id").isNull() & F.col("extraction").isNull() & F.col("subject").isNull(), status("read", "malformed", "not a JSON document"))
        .when(F.col("meta").isNull(), status("read", "no_meta", "no meta")).when(F.coalesce(F.size("frames"), F.lit(0)) < 1, status("read", "no_frames", "no frames"))
    )
    own = F.coalesce("trial_id", F.regexp_replace("name", r"\.json$", ""))
    return rows.select(own.alias("trial_id"), *[c for c in DOCUMENT.names if c != "trial_id"], failed.alias("status"))


def read_documents(spark: SparkSession, path: str, refuse: bool = False) -> DataFrame:
    """JSON documents, one a file, with a status (see parse_documents). With ``refuse`` any that failed are an error at once."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    rows = parse_documents(files)
    if refuse:
        bad = rows.filter("status IS NOT NULL").select("trial_id", "status.message").limit(3).collect()
        if bad:
            raise InvalidData(", ".join(f"{r[0]}: {r[1]}" for r in bad))
    return rows


def trials(documents: DataFrame) -> DataFrame:
    return documents.select("trial_id", "meta", "extraction", "subject")


def poses(documents: DataFrame) -> DataFrame:
    """A row per frame, with its place in the list beside its index in the recording; NaN is missing."""
    long = documents.select("trial_id", F.posexplode("frames").alias("pos", "f"))
    clean = F.transform_values("f.landmarks", lambda _, p: F.struct(C.clean(p["x"]).alias("x"), C.clean(p["y"]).alias("y"), C.clean(p["visibility"]).alias("visibility")))
    return long.select("trial_id", F.coalesce("f.frame_idx", "pos").alias("frame_idx"), F.col("pos").cast("int").alias("pos"), C.clean("f.time_s").alias("time_s"), C.clean("f.confidence").alias("confidence"), clean.alias("landmarks"), F.col("f.landmark_depths").alias("landmark_depths"))


def auxiliary_points(documents: DataFrame, field: str = "wholebody133") -> DataFrame:
    """trial_id, frame_idx, idx, x, y, confidence of the extra key points of a field."""
    long = documents.select("trial_id", F.explode("frames").alias("f")).select("trial_id", "f.frame_idx", F.posexplode(f"f.{field}").alias("idx", "p"))
    return long.select("trial_id", "frame_idx", "idx", *[C.clean(F.get("p", F.lit(k))).alias(n) for k, n in enumerate(("x", "y", "confidence"))])


def with_subject(trials_df: DataFrame, **values) -> DataFrame:
    """Fields of the subject set by name; others stay."""
    out = F.coalesce("subject", F.expr("named_struct('age', cast(null as int), 'sex', cast(null as string), 'height_m', cast(null as double), 'weight_kg', cast(null as double), 'pathology', cast(null as string), 'notes', cast(null as string))"))
    for name, value in values.items():
        out = out.withField(name, F.lit(value))
    return trials_df.withColumn("subject", out)


def poses_from_array(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Poses from rows (trial_id, frame_idx, pos, time_s, confidence, points array of [x, y, visibility]) by the names' order."""
    names = names or MEDIAPIPE_33
    own = F.map_from_arrays(F.array(*map(F.lit, names)), F.transform(F.slice("points", 1, len(names)), lambda p: F.struct(C.clean(F.get(p, F.lit(0))).alias("x"), C.clean(F.get(p, F.lit(1))).alias("y"), F.get(p, F.lit(2)).alias("visibility"))))
    return rows.withColumn("landmarks", own).drop("points")


def read_openpose(spark: SparkSession, path: str, names: list[str], width: int, height: int) -> DataFrame:
    """Poses from key point files, a frame each; trial and frame come from names like trial_000012_keypoints.json."""
    schema = T.StructType([T.StructField("people", T.ArrayType(T.StructType([T.StructField("pose_keypoints_2d", T.ArrayType(T.DoubleType()))])))])
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("__f", F.col("_metadata.file_name"))
    k = F.get("people", F.lit(0))["pose_keypoints_2d"]
    point = lambda i: F.when(F.get(k, F.lit(3 * i + 2)) > 0, F.struct((F.get(k, F.lit(3 * i)) / width).alias("x"), (F.get(k, F.lit(3 * i + 1)) / height).alias("y"), F.get(k, F.lit(3 * i + 2)).alias("visibility")))
    frame = F.regexp_extract("__f", r"_(\d+)_keypoints", 1).cast("int")
    return rows.select(F.regexp_extract("__f", r"^(.*)_\d+_keypoints", 1).alias("trial_id"), frame.alias("frame_idx"), frame.alias("pos"), F.lit(None).cast("double").alias("time_s"), F.lit(1.0).alias("confidence"), F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[point(i) for i in range(len(names))])), lambda _, p: p.isNotNull()).alias("landmarks"))


def read_trc(spark: SparkSession, path: str) -> DataFrame:
    """Markers of tab-separated marker files: trial_id (the file), frame_idx, time_s, name, X, Y, Z in metres; blanks are missing."""
    schema = "trial_id string, frame_idx int, time_s double, name string, X double, Y double, Z double"

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = content.decode().splitlines()
                unit = dict(zip(lines[1].split("\t"), lines[2].split("\t"), strict=False)).get("Units", "m")
                labels = [c for c in lines[3].split("\t")[2:] if c]
                factor = 0.001 if unit == "mm" else 1.0
                rows = []
                for line in lines[5:]:
                    cells = line.split("\t")
                    if len(cells) < 2 or not cells[0].strip():
                        continue
                    cells += [""] * (2 + 3 * len(labels) - len(cells))
                    for j, label in enumerate(labels):
                        xyz = [float(v) * factor if v.strip() else None for v in cells[2 + 3 * j : 5 + 3 * j]]
                        rows.append({"trial_id": name.removesuffix(".trc"), "frame_idx": int(cells[0]), "time_s": float(cells[1]), "name": label, "X": xyz[0], "Y": xyz[1], "Z": xyz[2]})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("trial_id", pa.string()), ("frame_idx", pa.int32()), ("time_s", pa.float64()), ("name", pa.string()), ("X", pa.float64()), ("Y", pa.float64()), ("Z", pa.float64())]))

    return _files(spark, path).mapInArrow(run, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def parse_c3d(content: bytes) -> tuple[list[str], float, list[list[tuple[float, float, float]]]]:
    """Marker labels, rate, and per frame their points, of a C3D file with floating-point or integer coordinates of Intel order."""
    if len(content) < 512 or content[1] != 80:
        raise InvalidData("not a C3D file")
    n_points, n_analog, first, last = struct.unpack_from("<HHHH", content, 2)
    scale, start = struct.unpack_from("<fH", content, 12)
    rate = struct.unpack_from("<f", content, 20)[0]
    labels: list[str] = []
    groups: dict[int, str] = {}
    at = (content[0] - 1) * 512 + 4
    while at + 2 < len(content):
        size, group = struct.unpack_from("<bb", content, at)
        if size == 0:
            break
        name = content[at + 2 : at + 2 + abs(size)].decode("latin-1")
        step_at = at + 2 + abs(size)
        step = struct.unpack_from("<h", content, step_at)[0]
        if group < 0:
            groups[-group] = name.upper()
        elif name.upper() == "LABELS" and groups.get(group) == "POINT":
            kind, dims = struct.unpack_from("<bB", content, step_at + 2)
            shape = list(content[step_at + 4 : step_at + 4 + dims])
            body = step_at + 4 + dims
            if kind == -1 and dims == 2:
                labels = [content[body + k * shape[0] : body + (k + 1) * shape[0]].decode("latin-1").strip() for k in range(shape[1])]
        if step == 0:
            break
        at = step_at + step
    labels += [f"M{k}" for k in range(len(labels), n_points)]
    frames = []
    real = scale < 0
    point, width = ("<4f", 16) if real else ("<4h", 8)
    row = n_points * width + n_analog * (4 if real else 2)
    for f in range(last - first + 1):
        base = (start - 1) * 512 + f * row
        if base + n_points * width > len(content):
            break
        values = [struct.unpack_from(point, content, base + k * width) for k in range(n_points)]
        frames.append([tuple(v * (1.0 if real else scale) for v in p[:3]) for p in values])
    return labels[:n_points], rate, frames


def read_c3d(spark: SparkSession, path: str) -> DataFrame:
    """trial_id (the file), frame_idx, time_s, name, X, Y, Z of C3D files; points at the origin are missing."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                labels, rate, frames = parse_c3d(content)
                rows = [{"trial_id": name.rsplit(".", 1)[0], "frame_idx": f, "time_s": f / rate if rate else None, "name": label, "X": p[0], "Y": p[1], "Z": p[2]} for f, points in enumerate(frames) for label, p in zip(labels, points, strict=True) if any(p)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("trial_id", pa.string()), ("frame_idx", pa.int32()), ("time_s", pa.float64()), ("name", pa.string()), ("X", pa.float64()), ("Y", pa.float64()), ("Z", pa.float64())]))

    return _files(spark, path).mapInArrow(run, "trial_id string, frame_idx int, time_s double, name string, X double, Y double, Z double")


def empty_poses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], POSE)
