"""Writing results: CSV, JSON, key point files, and text formats of simulation tools.

Tables are written by Spark. Formats of one file per trial or frame become rows (name, content) first, which
``write_files`` puts into a folder from the executors.
"""

from __future__ import annotations

import io
import re
import zipfile
from functools import reduce
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.exceptions import UnknownName
from kinelake.operators import pose as P

# Marker names of a model by landmark.
OPENSIM_MARKERS = {
    "gait2392": {
        "RIGHT_SHOULDER": "R.Acromion", "LEFT_SHOULDER": "L.Acromion", "RIGHT_HIP": "R.ASIS", "LEFT_HIP": "L.ASIS", "RIGHT_KNEE": "R.Knee.Lat", "LEFT_KNEE": "L.Knee.Lat",
        "RIGHT_ANKLE": "R.Ankle.Lat", "LEFT_ANKLE": "L.Ankle.Lat", "RIGHT_HEEL": "R.Heel", "LEFT_HEEL": "L.Heel", "RIGHT_FOOT_INDEX": "R.MT5", "LEFT_FOOT_INDEX": "L.MT5",
    },
}
MOT_COLUMNS = {"pelvis_tilt": "pelvis_tilt", "hip_flexion_r": "hip_R", "knee_angle_r": "knee_R", "ankle_angle_r": "ankle_R", "hip_flexion_l": "hip_L", "knee_angle_l": "knee_L", "ankle_angle_l": "ankle_L", "lumbar_extension": "trunk_angle"}
#: Places after the point by table.
CSV_PLACES = {"landmarks": 6, "angles": 3, "events": 4, "cycles": 3, "curves": 3, "stats": 4}


def csv_table(df: DataFrame, kind: str) -> DataFrame:
    """Doubles as text with the table's places; missing values stay empty."""
    places = CSV_PLACES[kind]
    return df.select(*[F.when(F.col(c).isNotNull(), F.format_string(f"%.{places}f", c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def write_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table (by its kind) as CSV under folder, a folder per trial."""
    for kind, df in tables.items():
        csv_table(df, kind).write.mode("overwrite").option("header", True).partitionBy("trial_id").csv(f"{folder}/{kind}")


def statistics_long(figures: DataFrame) -> DataFrame:
    """trial_id, parameter, value from a column per figure."""
    own = [c for c, t in figures.dtypes if c != "trial_id" and t in ("double", "bigint", "int", "float")]
    return figures.select("trial_id", F.explode(F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(c).cast("double").alias("value")) for c in own])).alias("r")).select("trial_id", "r.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def summary_documents(figures: DataFrame, gps: DataFrame, meta: DataFrame) -> DataFrame:
    """name, content: a short JSON document per trial."""
    score = gps.groupBy("trial_id").agg(F.map_from_entries(F.collect_list(F.struct("side", "gps"))).alias("gps"))
    own = F.struct(*[c for c in figures.columns if c != "trial_id"])
    j = meta.join(figures.select("trial_id", own.alias("statistics")), "trial_id", "left").join(score, "trial_id", "left")
    return j.select(F.concat(F.col("trial_id"), F.lit("_summary.json")).alias("name"), F.to_json(F.struct("trial_id", "meta", "subject", "statistics", "gps")).alias("content"))


def openpose_files(pose: DataFrame, form: str = "COCO", prefix: str = "") -> DataFrame:
    """name, content: a JSON document per frame with the key points of a format."""
    k = P.keypoints(pose, form)
    person = F.struct(F.array(F.lit(-1)).alias("person_id"), F.transform("keypoints", lambda v: F.round(v, 6)).alias("pose_keypoints_2d"))
    return k.select(F.format_string(f"{prefix}%s_%012d_keypoints.json", "trial_id", "frame_idx").alias("name"), F.to_json(F.struct(F.lit(1.3).alias("version"), F.array(person).alias("people"))).alias("content"))


def _number(c: Column, places: int, missing: str) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", c)).otherwise(missing)


def mot_files(angles: DataFrame, trials: DataFrame) -> DataFrame:
    """name, content: motion files, a header and a tab-separated row per frame; missing angles are 0."""
    rate = trials.select("trial_id", F.coalesce("meta.fps", F.lit(30.0)).alias("fps"))
    names = [n for n, c in MOT_COLUMNS.items() if c in angles.columns]
    row = F.concat_ws("\t", _number(F.col("frame_idx") / F.col("fps"), 6, "0.0"), *[_number(F.col(MOT_COLUMNS[n]), 6, "0.000000") for n in names])
    lines = angles.join(rate, "trial_id").select("trial_id", "pos", row.alias("line")).groupBy("trial_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    head = F.concat(F.col("trial_id"), F.lit("\nversion=1\nnRows="), F.size("rows").cast("string"), F.lit(f"\nnColumns={len(names) + 1}\ninDegrees=yes\nendheader\n" + "\t".join(["time", *names]) + "\n"))
    return lines.select(F.concat("trial_id", F.lit(".mot")).alias("name"), F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("content"))


def trc_files(pose: DataFrame, trials: DataFrame, names: list[str], model: str | None = None, scale: float | DataFrame = 1.0, units: str = "m") -> DataFrame:
    """name, content: marker files of landmarks, y upward, blank where missing.

    scale is a number, or a table (trial_id, scale) of metres per unit, such as analysis.height_scale gives for pixels; trials without one have 1.
    """
    if model is not None and model not in OPENSIM_MARKERS:
        raise UnknownName(model)
    shown = [OPENSIM_MARKERS[model].get(n, n) if model else n for n in names]
    if isinstance(scale, DataFrame):
        pose = pose.join(scale.select("trial_id", F.coalesce("scale", F.lit(1.0)).alias("__scale")), "trial_id", "left").withColumn("__scale", F.coalesce("__scale", F.lit(1.0)))
    factor = (F.col("__scale") if isinstance(scale, DataFrame) else F.lit(float(scale))) * (1000.0 if units == "mm" else 1.0)
    rate = trials.select("trial_id", F.coalesce("meta.fps", F.lit(30.0)).alias("fps"))
    cells = [c for n in names for c in (_number(P.x(n) * factor, 6, ""), _number((1.0 - P.y(n)) * factor, 6, ""), F.when(P.x(n).isNotNull(), F.format_string("%.6f", F.coalesce(F.col("landmark_depths")[n], F.lit(0.0)) * factor if "landmark_depths" in pose.columns else F.lit(0.0))).otherwise(""))]
    row = F.concat_ws("\t", (F.col("frame_idx") + 1).cast("string"), F.format_string("%.6f", F.col("frame_idx") / F.col("fps")), *cells)
    lines = pose.join(rate, "trial_id").select("trial_id", "pos", "fps", row.alias("line")).groupBy("trial_id", "fps").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    f, n = F.format_string("%.2f", "fps"), F.size("rows").cast("string")
    head = F.concat(
        F.lit("PathFileType\t4\t(X/Y/Z)\t"), F.col("trial_id"), F.lit(".trc\nDataRate\tCameraRate\tNumFrames\tNumMarkers\tUnits\tOrigDataRate\tOrigDataStartFrame\tOrigNumFrames\n"),
        f, F.lit("\t"), f, F.lit("\t"), n, F.lit(f"\t{len(names)}\t{units}\t"), f, F.lit("\t1\t"), n,
        F.lit("\nFrame#\tTime\t" + "\t\t\t".join(shown) + "\t\t\n\t\t" + "\t".join(f"X{k}\tY{k}\tZ{k}" for k in range(1, len(names) + 1)) + "\n"),
    )
    return lines.select(F.concat("trial_id", F.lit(".trc")).alias("name"), F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("content"))


# Measurements of a scaling setup: name, pairs of landmarks, bodies, and between which points or middles its length is.
MEASUREMENTS = (
    ("femur_length", (("LEFT_HIP", "LEFT_KNEE"), ("RIGHT_HIP", "RIGHT_KNEE")), ("femur_l", "femur_r"), ((("LEFT_HIP",), ("LEFT_KNEE",)), (("RIGHT_HIP",), ("RIGHT_KNEE",)))),
    ("tibia_length", (("LEFT_KNEE", "LEFT_ANKLE"), ("RIGHT_KNEE", "RIGHT_ANKLE")), ("tibia_l", "tibia_r"), ((("LEFT_KNEE",), ("LEFT_ANKLE",)), (("RIGHT_KNEE",), ("RIGHT_ANKLE",)))),
    ("trunk_height", (("LEFT_SHOULDER", "LEFT_HIP"), ("RIGHT_SHOULDER", "RIGHT_HIP")), ("torso",), ((("LEFT_SHOULDER", "RIGHT_SHOULDER"), ("LEFT_HIP", "RIGHT_HIP")),)),
)


def _between(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """Distance between two points, or the middles of pairs of points; null where one isn't known."""
    at = lambda names, axis: axis(names[0]) if len(names) == 1 else P.middle(axis(names[0]), axis(names[1]))
    return F.hypot(at(a, P.x) - at(b, P.x), at(a, P.y) - at(b, P.y))


def measurements(pose: DataFrame) -> DataFrame:
    """trial_id, measurement, part, length, n: mean lengths of the MEASUREMENTS over the frames that know their points; part numbers those of a measurement."""
    own = [F.struct(F.lit(name).alias("measurement"), F.lit(k).alias("part"), _between(a, b).alias("d")) for name, _, _, parts in MEASUREMENTS for k, (a, b) in enumerate(parts)]
    rows = pose.select("trial_id", F.explode(F.array(*own)).alias("m")).select("trial_id", "m.*").filter(F.col("d").isNotNull())
    return rows.groupBy("trial_id", "measurement", "part").agg(F.avg("d").alias("length"), F.count("*").alias("n"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def scale_setup(trials: DataFrame, model: str = "gait2392", lengths: DataFrame | None = None, frames: tuple[int, int] = (0, 30), model_file: str = "gait2392_simbody.osim", output_model: str = "scaled_model.osim") -> DataFrame:
    """name, content: a scaling setup for each trial, with its subject's mass and height, marker pairs and bodies of each measurement, and a static time range.

    With ``lengths`` (see measurements) a measurement whose points a trial never has isn't applied, and each has a note of its
    lengths. Subjects without mass or height have 75 kg and 1.75 m.
    """
    if model not in OPENSIM_MARKERS:
        raise UnknownName(model)
    own = trials
    if lengths is not None:
        entry = F.struct(F.concat_ws(".", "measurement", F.col("part").cast("string")).alias("k"), "length")
        own = trials.join(lengths.groupBy("trial_id").agg(F.map_from_entries(F.collect_list(entry)).alias("__lengths")), "trial_id", "left")
    rate, name = F.coalesce("meta.fps", F.lit(30.0)), _escaped(F.col("trial_id").cast("string"))
    text = lambda tag, value, depth: [F.lit(f"{' ' * depth}<{tag}>"), value if isinstance(value, Column) else F.lit(value), F.lit(f"</{tag}>\n")]
    body: list[Column] = [F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<OpenSimDocument Version="40000">\n  <ScaleTool name="'), name, F.lit('">\n')]
    body += text("mass", F.coalesce("subject.weight_kg", F.lit(75.0)).cast("string"), 4) + text("height", F.coalesce("subject.height_m", F.lit(1.75)).cast("string"), 4)
    body += [F.lit(f"    <GenericModelMaker>\n      <model_file>{model_file}</model_file>\n    </GenericModelMaker>\n    <ModelScaler>\n      <apply>true</apply>\n      <scaling_order>measurements</scaling_order>\n      <MeasurementSet>\n        <objects>\n")]
    for what, pairs, bodies, parts in MEASUREMENTS:
        marker = lambda n: OPENSIM_MARKERS[model].get(n, n)
        markers = "".join(f"                <MarkerPair><markers>{marker(a)} {marker(b)}</markers></MarkerPair>\n" for a, b in pairs)
        scaled = "".join(f'                <BodyScale name="{n}"><axes>X Y Z</axes></BodyScale>\n' for n in bodies)
        apply, note = F.lit("true"), F.lit("")
        if lengths is not None:
            known = [F.col("__lengths")[f"{what}.{k}"] for k in range(len(parts))]
            apply = F.when(F.coalesce(*known).isNotNull(), "true").otherwise("false")
            note = F.concat(F.lit("            <notes>"), F.array_join(F.array_compact(F.array(*[F.when(c.isNotNull(), F.format_string("%.6f", c)) for c in known])), " "), F.lit("</notes>\n"))
        body += [F.lit(f'          <Measurement name="{what}">\n'), note, *text("apply", apply, 12)]
        body += [F.lit(f"            <MarkerPairSet>\n              <objects>\n{markers}              </objects>\n            </MarkerPairSet>\n            <BodyScaleSet>\n              <objects>\n{scaled}              </objects>\n            </BodyScaleSet>\n          </Measurement>\n")]
    body += [F.lit("        </objects>\n      </MeasurementSet>\n"), *text("output_scale_file", F.concat(name, F.lit("_scale_factors.xml")), 6), F.lit("    </ModelScaler>\n    <MarkerPlacer>\n      <apply>true</apply>\n")]
    body += text("marker_file", F.concat(name, F.lit(".trc")), 6) + text("time_range", F.concat_ws(" ", *[F.format_string("%.6f", F.lit(float(k)) / rate) for k in frames]), 6)
    body += [F.lit(f"      <output_model_file>{output_model}</output_model_file>\n"), *text("output_marker_file", F.concat(name, F.lit("_markers_adjusted.xml")), 6), *text("output_motion_file", F.concat(name, F.lit("_static_output.mot")), 6), F.lit("    </MarkerPlacer>\n  </ScaleTool>\n</OpenSimDocument>\n")]
    return own.select(F.concat("trial_id", F.lit("_scale.xml")).alias("name"), F.concat(*body).alias("content"))


def ik_setup(trials: DataFrame, markers: list[str]) -> DataFrame:
    """name, content: an inverse kinematics setup for each trial."""
    tasks = "".join(f'        <IKMarkerTask name="{m}"><apply>true</apply><weight>1</weight></IKMarkerTask>\n' for m in markers)
    end = F.coalesce("meta.duration_s", F.col("meta.n_frames") / F.col("meta.fps"), F.lit(0.0))
    return trials.select(F.concat("trial_id", F.lit("_ik.xml")).alias("name"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<OpenSimDocument Version="30000">\n  <InverseKinematicsTool name="'), "trial_id", F.lit(f'">\n    <IKTaskSet>\n      <objects>\n{tasks}      </objects>\n    </IKTaskSet>\n    <marker_file>'), "trial_id", F.lit(".trc</marker_file>\n    <time_range>0 "), F.format_string("%.4f", end), F.lit("</time_range>\n    <output_motion_file>"), "trial_id", F.lit("_ik.mot</output_motion_file>\n  </InverseKinematicsTool>\n</OpenSimDocument>\n")).alias("content"))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, content) as files under a folder URI that all executors reach; returns name and bytes of each.

    A file appears whole or not at all, and a repeated task writes the same again. Nothing is written before an action.
    """

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = content.encode() if isinstance(content, str) else content
                with store.open_output_stream(f"{root}/.{name}.tmp", compression=None) as f:
                    f.write(data)
                store.move(f"{root}/.{name}.tmp", f"{root}/{name}")
                sizes.append(len(data))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return files.select("name", "content").mapInArrow(run, "name string, bytes long")


def build_c3d(labels: list[str], rate: float, frames: list[list[tuple[float, float, float] | None]]) -> bytes:
    """A C3D file of floating-point markers in Intel order; missing points are at the origin with a negative residual."""
    import struct

    def text(values: list[str], width: int) -> bytes:
        return b"".join(v.encode("ascii", "replace")[:width].ljust(width) for v in values)

    def parameter(group: int, name: str, kind: int, dims: list[int], data: bytes) -> bytes:
        body = struct.pack("<bB", kind, len(dims)) + bytes(dims) + data + b"\x00"
        return struct.pack("<bb", len(name), group) + name.encode() + struct.pack("<h", 2 + len(body)) + body

    head = struct.pack("<bb", 5, -1) + b"POINT" + struct.pack("<h", 3) + b"\x00"
    body = b"".join([
        head, parameter(1, "USED", 2, [], struct.pack("<h", len(labels))), parameter(1, "SCALE", 4, [], struct.pack("<f", -1.0)), parameter(1, "RATE", 4, [], struct.pack("<f", rate)),
        parameter(1, "LABELS", -1, [32, len(labels)], text(labels, 32)), b"\x00\x00",
    ])
    blocks = -(-(len(body) + 4) // 512)
    first = struct.pack("<BBHHHHHfHHf", 2, 80, len(labels), 0, 1, len(frames), 0, -1.0, 2 + blocks, 0, rate).ljust(512, b"\x00")
    parameters = (struct.pack("<BBBB", 1, 80, blocks, 84) + body).ljust(512 * blocks, b"\x00")
    points = b"".join(struct.pack("<4f", *(p or (0.0, 0.0, 0.0)), 0.0 if p else -1.0) for frame in frames for p in frame)
    return first + parameters + points.ljust(-(-len(points) // 512) * 512, b"\x00")


def c3d_files(pose: DataFrame, trials: DataFrame, names: list[str]) -> DataFrame:
    """name, content: C3D files of landmarks (x forward, z up)."""
    rate = trials.select("trial_id", F.coalesce("meta.fps", F.lit(30.0)).alias("fps"))
    cells = [c for n in names for c in (P.x(n).alias(f"{n}_x"), P.y(n).alias(f"{n}_y"))]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        xs = [(table.column(f"{n}_x").to_pylist(), table.column(f"{n}_y").to_pylist()) for n in names]
        frames = [[None if a[k] is None or b[k] is None else (a[k], 0.0, 1.0 - b[k]) for a, b in xs] for k in range(table.num_rows)]
        content = build_c3d(names, table.column("fps")[0].as_py(), frames)
        return pa.table({"name": pa.array([f"{table.column('trial_id')[0].as_py()}.c3d"]), "content": pa.array([content], pa.binary())})

    return pose.select("trial_id", "pos", *cells).join(rate, "trial_id").groupBy("trial_id").applyInArrow(run, "name string, content binary")


def workbook_files(sheets: dict[str, DataFrame], key: str = "trial_id") -> DataFrame:
    """name, content: a workbook for each trial, with a sheet for each table that has rows of it; every table has the column ``key``.

    Rows become one table of (key, sheet, order, cells) and are gathered by trial; each group's task writes its sheets' XML into a
    zip as it goes through its rows, so nothing passes through the driver, and no library is needed. Rows are in the order of
    their cells; numbers and truth values are cells of their kind, all else is text, null is an empty cell.
    """
    if not sheets:
        raise UnknownName("no sheets")
    parts = []
    for k, (sheet, df) in enumerate(sheets.items()):
        columns = [c for c in df.columns if c != key]
        kinds = dict(df.dtypes)
        number = lambda c: kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")  # noqa: B023, E731
        plain = lambda c: F.col(f"`{c}`").cast("string") if kinds[c] in ("string", "boolean", "date", "timestamp") or number(c) else F.to_json(F.struct(F.col(f"`{c}`").alias("v")))  # noqa: B023, E731
        cells = F.array(*[plain(c) for c in columns]) if columns else F.array().cast("array<string>")
        order = [F.col(f"`{c}`") for c in columns if "map" not in kinds[c]]
        head = F.array(*[F.struct(F.lit(c).alias("name"), F.lit("n" if number(c) else "b" if kinds[c] == "boolean" else "s").alias("kind")) for c in columns]) if columns else F.array().cast("array<struct<name:string,kind:string>>")
        ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))) if order else df.withColumn("__r", F.lit(1))
        parts.append(ranked.select(F.col(key).cast("string").alias("key"), F.lit(k).alias("sheet"), F.col("__r").alias("row"), F.lit(sheet[:31]).alias("title"), head.alias("head"), cells.alias("cells")))

    def run(table: pa.Table) -> pa.Table:
        name = table.column("key")[0].as_py()
        return pa.table({"name": pa.array([f"{name}.xlsx"]), "content": pa.array([_workbook(table.sort_by([("sheet", "ascending"), ("row", "ascending")]))], pa.binary())})

    return reduce(DataFrame.unionByName, parts).groupBy("key").applyInArrow(run, "name string, content binary")


_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _cell(value: str | None, kind: str) -> str:
    if value is None or kind == "n" and value in ("NaN", "Infinity", "-Infinity"):
        return "<c/>"
    if kind == "n":
        return f"<c><v>{value}</v></c>"
    if kind == "b":
        return f'<c t="b"><v>{int(value == "true")}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub("", value)[:32767])}</t></is></c>'


def _workbook(rows: pa.Table) -> bytes:
    """A workbook of rows (title, head, cells) in order of sheet and row; sheets are written one after the other."""
    out = io.BytesIO()
    titles: list[str] = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:

        def add(path: str, text: str) -> None:
            book.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)

        last, sheet = None, None
        for batch in rows.select(["sheet", "title", "head", "cells"]).to_batches(max_chunksize=1000):
            for r in batch.to_pylist():
                if r["sheet"] != last:
                    if sheet is not None:
                        sheet.write(b"</sheetData></worksheet>")
                        sheet.close()
                    titles.append(r["title"])
                    last, kinds = r["sheet"], [c["kind"] for c in r["head"]]
                    sheet = book.open(zipfile.ZipInfo(f"xl/worksheets/sheet{len(titles)}.xml", (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)
                    sheet.write(f"{_XML}<worksheet {_MAIN}><sheetData><row>{''.join(_cell(c['name'], 's') for c in r['head'])}</row>".encode())
                sheet.write(f"<row>{''.join(_cell(v, k) for v, k in zip(r['cells'], kinds, strict=True))}</row>".encode())
        if sheet is not None:
            sheet.write(b"</sheetData></worksheet>")
            sheet.close()
        n = range(1, len(titles) + 1)
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        add("xl/workbook.xml", f'{_XML}<workbook {_MAIN} xmlns:r="{relation}"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, t in zip(n, titles, strict=True)) + "</sheets></workbook>")
        add("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{relation}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>")
        add("_rels/.rels", f'{_XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        add("[Content_Types].xml", f'{_XML}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in n) + "</Types>")
    return out.getvalue()


def result_sheets(results) -> dict[str, DataFrame]:
    """The tables of a run (see plans.pipeline) that make a workbook: eight sheets."""
    events = results.events.orderBy("frame")
    mean = results.summary.select("trial_id", "side", "joint", "p", "mean", "std", "n_cycles")
    return {
        "Summary": statistics_long(results.figures), "Angles": results.angles, "Events": events.select("trial_id", "frame", "side", "kind", "time", "confidence"), "Cycles": results.cycles, "Curves": mean,
        "Scores": results.gvs, "Quality": results.diagnosis, "Trial": results.trials.select("trial_id", "meta.*"),
    }


def landmark_sheets(pose: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """Sheets of landmarks by frame: X, Y and Visibility, a column for each name."""
    own = lambda f: pose.select("trial_id", "frame_idx", *[f(n).alias(n) for n in names])
    return {"X": own(P.x), "Y": own(P.y), "Visibility": own(P.visibility)}


def moco_setup(trials: DataFrame, model: str = "scaled_model.osim") -> DataFrame:
    """name, content: a tracking setup for each trial that follows its motion file."""
    end = F.coalesce("meta.duration_s", F.lit(0.0))
    return trials.select(F.concat("trial_id", F.lit("_moco.xml")).alias("name"), F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<OpenSimDocument Version="40000">\n  <MocoTrack name="'), "trial_id", F.lit(f'">\n    <model>{model}</model>\n    <states_reference>'), "trial_id", F.lit(".mot</states_reference>\n    <initial_time>0</initial_time>\n    <final_time>"), F.format_string("%.4f", end), F.lit("</final_time>\n  </MocoTrack>\n</OpenSimDocument>\n")).alias("content"))
