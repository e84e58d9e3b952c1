"""Per-frame operators on poses: remaps, coordinate changes, joint angles, and trial-wide corrections of them.

A pose row is a frame: trial_id, frame_idx, pos, time_s, confidence and a map of landmarks. Everything is column
expressions; trial-wide figures are windows over the trial.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.exceptions import UnknownName
from kinelake.functions import columns as C
from kinelake.functions import series
from kinelake.schemas import COCO_17, FORMATS, MEDIAPIPE_33, MIDDLES, mirrored

def trial():
    """The window over a whole trial."""
    return Window.partitionBy("trial_id")


def x(name: str) -> Column:
    return C.clean(F.col("landmarks")[name]["x"])


def y(name: str) -> Column:
    return C.clean(F.col("landmarks")[name]["y"])


def visibility(name: str) -> Column:
    return F.coalesce(C.clean(F.col("landmarks")[name]["visibility"]), F.lit(1.0))


def middle(a: Column, b: Column) -> Column:
    return (a + b) / 2.0


def _entries(change: Callable[[Column, Column], Column]) -> Column:
    return F.transform_values("landmarks", change)


def _point(px: Column, py: Column, v: Column) -> Column:
    return F.struct(px.cast("double").alias("x"), py.cast("double").alias("y"), v.cast("double").alias("visibility"))


# ------------------------------------------------------------ shapes


def to_long(pose: DataFrame) -> DataFrame:
    """A row per landmark and frame."""
    return pose.select("trial_id", "frame_idx", "pos", "time_s", "confidence", F.explode("landmarks").alias("name", "p")).select("trial_id", "frame_idx", "pos", "time_s", "name", C.clean("p.x").alias("x"), C.clean("p.y").alias("y"), C.clean("p.visibility").alias("visibility"), "confidence")


def to_pose(landmarks: DataFrame) -> DataFrame:
    """A row per frame from a row per landmark."""
    entry = F.struct("name", _point(F.col("x"), F.col("y"), F.col("visibility")).alias("p"))
    return landmarks.groupBy("trial_id", "frame_idx", "pos", "time_s").agg(F.max("confidence").alias("confidence"), F.map_from_entries(F.collect_list(entry)).alias("landmarks"))


def to_wide(pose: DataFrame, names: list[str]) -> DataFrame:
    """Columns NAME_x, NAME_y and NAME_visibility for the landmarks named."""
    own = [c for n in names for c in (x(n).alias(f"{n}_x"), y(n).alias(f"{n}_y"), C.clean(F.col("landmarks")[n]["visibility"]).alias(f"{n}_visibility"))]
    return pose.select("trial_id", "frame_idx", "pos", *own)


# ------------------------------------------------------------ coordinates and labels


def coco_to_mediapipe(pose: DataFrame) -> DataFrame:
    """All 33 names, of which those without a counterpart among the 17 are missing with visibility 0."""
    empty = _point(F.lit(None), F.lit(None), F.lit(0.0))
    out = F.map_from_arrays(F.array(*map(F.lit, MEDIAPIPE_33)), F.array(*[F.coalesce(F.col("landmarks")[n], empty) if n in COCO_17 else empty for n in MEDIAPIPE_33]))
    return pose.withColumn("landmarks", out)


def keypoints(pose: DataFrame, form: str = "COCO") -> DataFrame:
    """A column ``keypoints`` of x, y, visibility triples, one after the other, in the order of a keypoint format; missing ones are 0."""
    if form not in FORMATS:
        raise UnknownName(form)
    out = []
    for k, name in enumerate(FORMATS[form]):
        pair = MIDDLES[form].get(k)
        if name:
            px, py, v = x(name), y(name), C.clean(F.col("landmarks")[name]["visibility"])
        elif pair:
            px, py, v = (middle(f(pair[0]), f(pair[1])) if f is not visibility else F.least(f(pair[0]), f(pair[1])) for f in (x, y, visibility))
        else:
            px = py = v = F.lit(None).cast("double")
        seen = px.isNotNull() & py.isNotNull()
        out += [F.when(seen, c).otherwise(0.0) for c in (px, py, F.coalesce(v, F.lit(0.0)))]
    return pose.withColumn("keypoints", F.array(*out))


def mirror(pose: DataFrame) -> DataFrame:
    """x becomes 1 - x and sides change names."""
    swap = F.transform_keys("landmarks", lambda k, v: F.when(k.startswith("LEFT"), F.regexp_replace(k, "LEFT", "RIGHT")).when(k.startswith("RIGHT"), F.regexp_replace(k, "RIGHT", "LEFT")).when(k.endswith("LEFT"), F.regexp_replace(k, "LEFT", "RIGHT")).when(k.endswith("RIGHT"), F.regexp_replace(k, "RIGHT", "LEFT")).otherwise(k))
    return pose.withColumn("landmarks", swap).withColumn("landmarks", _entries(lambda _, p: _point(1.0 - p["x"], p["y"], p["visibility"])))


def swap_sides(pose: DataFrame, when: Column) -> DataFrame:
    """Left and right names exchanged in the frames where ``when`` holds."""
    names = F.array(*map(F.lit, MEDIAPIPE_33))
    other = F.map_from_arrays(names, F.array(*[F.lit(mirrored(n)) for n in MEDIAPIPE_33]))
    return pose.withColumn("landmarks", F.when(when, F.transform_keys("landmarks", lambda k, v: F.coalesce(other[k], k))).otherwise(F.col("landmarks")))


def pixels(pose: DataFrame, width: Column | float, height: Column | float) -> DataFrame:
    """Coordinates in pixels rather than shares of the picture."""
    w, h = (c if isinstance(c, Column) else F.lit(float(c)) for c in (width, height))
    return pose.withColumns({"__w": w, "__h": h}).withColumn("landmarks", _entries(lambda _, p: _point(p["x"] * F.col("__w"), p["y"] * F.col("__h"), p["visibility"]))).drop("__w", "__h")


def pixel_ratio(pose: DataFrame, input_size: tuple[int, int], processed_size: tuple[int, int]) -> DataFrame:
    """Undo the stretch of a picture that was processed at another aspect ratio; results stay within 0 and 1."""
    ratio = (input_size[0] / input_size[1]) / (processed_size[0] / processed_size[1])
    fx, fy = (1.0, 1.0 / ratio) if ratio > 1 else (ratio, 1.0)
    return pose.withColumn("landmarks", _entries(lambda _, p: _point(C.clip(p["x"] * fx, 0.0, 1.0), C.clip(p["y"] * fy, 0.0, 1.0), p["visibility"])))


def confidence_filter(pose: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Coordinates of landmarks seen less clearly than the threshold become missing; the landmarks stay."""
    return pose.withColumn("landmarks", _entries(lambda _, p: F.when(F.coalesce(p["visibility"], F.lit(1.0)) < threshold, _point(F.lit(None), F.lit(None), p["visibility"])).otherwise(_point(C.clean(p["x"]), C.clean(p["y"]), p["visibility"]))))


def center_on_torso(pose: DataFrame) -> DataFrame:
    """Origin at the middle of shoulders and hips, scaled so that the trial's greatest coordinate is 100."""
    four = ["LEFT_SHOULDER", "RIGHT_SHOULDER", "LEFT_HIP", "RIGHT_HIP"]
    at = {"__cx": reduce(lambda a, b: a + b, map(x, four)) / 4.0, "__cy": reduce(lambda a, b: a + b, map(y, four)) / 4.0}
    moved = pose.withColumns(at).withColumn("landmarks", _entries(lambda _, p: _point(C.clean(p["x"]) - F.col("__cx"), C.clean(p["y"]) - F.col("__cy"), p["visibility"])))
    largest = F.array_max(F.transform(F.map_values("landmarks"), lambda p: F.greatest(F.abs(p["x"]), F.abs(p["y"]))))
    moved = moved.withColumn("__m", F.max(largest).over(trial()))
    return moved.withColumn("landmarks", _entries(lambda _, p: _point(C.safe_divide(p["x"], F.col("__m")) * 100.0, C.safe_divide(p["y"], F.col("__m")) * 100.0, p["visibility"]))).drop("__cx", "__cy", "__m")


def align_skeleton(pose: DataFrame, size: float | None = None) -> DataFrame:
    """Origin at the mean of the shoulders and hips that are known, in hundredths of the trial's median distance from left shoulder to left ankle (or ``size``)."""
    corners = [f"{s}_{n}" for n in ("SHOULDER", "HIP") for s in ("LEFT", "RIGHT")]

    def mean(axis: Callable[[str], Column]) -> Column:
        known = F.array_compact(F.array(*[axis(n) for n in corners]))
        return C.safe_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known))

    tall = C.distance(x("LEFT_SHOULDER"), y("LEFT_SHOULDER"), x("LEFT_ANKLE"), y("LEFT_ANKLE"))
    marked = pose.withColumns({"__cx": mean(x), "__cy": mean(y), "__t": tall}).withColumn("__s", F.lit(float(size)) if size else F.median("__t").over(trial()))
    return marked.withColumn("landmarks", _entries(lambda _, p: _point(C.safe_divide(C.clean(p["x"]) - F.col("__cx"), F.col("__s")) * 100.0, C.safe_divide(C.clean(p["y"]) - F.col("__cy"), F.col("__s")) * 100.0, p["visibility"]))).drop("__cx", "__cy", "__t", "__s")


def walking_direction(pose: DataFrame) -> DataFrame:
    """trial_id, direction: right where toes are ahead of heels in the median over both feet and all frames, or unknown."""
    ahead = pose.select("trial_id", F.explode(F.array(*[x(f"{s}_FOOT_INDEX") - x(f"{s}_HEEL") for s in ("LEFT", "RIGHT")])).alias("d"))
    return ahead.groupBy("trial_id").agg(F.median("d").alias("d")).select("trial_id", F.when(F.col("d") < 0, "left").otherwise("right").alias("direction"))


def facing(pose: DataFrame) -> DataFrame:
    """trial_id, direction: left where the nose is behind the ears' middle in the median, or never seen with both, else right."""
    d = x("NOSE") - middle(x("LEFT_EAR"), x("RIGHT_EAR"))
    return pose.select("trial_id", d.alias("d")).groupBy("trial_id").agg(F.median("d").alias("d")).select("trial_id", F.when(F.col("d") >= 0, "right").otherwise("left").alias("direction"))


def correct_side_labels(pose: DataFrame) -> DataFrame:
    """Exchange sides in frames after an odd number of joint flips of hip and knee order, unless most frames would be."""
    w = Window.partitionBy("trial_id").orderBy("pos")
    order = lambda a: F.signum(x(f"LEFT_{a}") - x(f"RIGHT_{a}"))
    marked = pose.withColumns({"__h": order("HIP"), "__k": order("KNEE")})
    flip = (F.lag("__h").over(w) * F.col("__h") < 0) & (F.lag("__k").over(w) * F.col("__k") < 0)
    marked = marked.withColumn("__flip", F.when(flip, 1).otherwise(0)).withColumn("__odd", F.sum("__flip").over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2)
    most = F.avg("__odd").over(trial()) > 0.5
    return swap_sides(marked.withColumn("__swap", (F.col("__odd") == 1) != most), F.col("__swap")).drop("__h", "__k", "__flip", "__odd", "__swap")


def with_points(pose: DataFrame, points: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Landmarks of these names moved to other coordinates where they are seen; their visibility stays."""
    held = {f"__{n}_{a}": c for n, xy in points.items() for a, c in zip("xy", xy, strict=True)}

    def moved(k: Column, p: Column) -> Column:
        out = p
        for n in points:
            out = F.when(k == n, _point(F.col(f"__{n}_x"), F.col(f"__{n}_y"), p["visibility"])).otherwise(out)
        return out

    return pose.withColumns(held).withColumn("landmarks", _entries(moved)).drop(*held)


# Segments whose right side takes the left one's length, in this order.
SEGMENT_PAIRS = (("SHOULDER", "ELBOW"), ("ELBOW", "WRIST"), ("HIP", "KNEE"), ("KNEE", "ANKLE"), ("ANKLE", "HEEL"))


def match_sides(pose: DataFrame, first: int | None = None) -> DataFrame:
    """Right segments scaled by one factor a trial, so that their median length is that of the left.

    Segments follow each other outwards, each from where the last one has moved its end. Medians are over all frames, or
    the ``first`` ones. A segment without a length on either side stays. Meant for symmetric bodies only.
    """
    out, early = pose, F.col("pos") < first if first else F.lit(True)
    right = {n: (x(f"RIGHT_{n}"), y(f"RIGHT_{n}")) for pair in SEGMENT_PAIRS for n in pair}
    out = out.withColumns({f"__r{n}_{a}": c for n, xy in right.items() for a, c in zip("xy", xy, strict=True)})
    for a, b in SEGMENT_PAIRS:
        ax, ay, bx, by = (F.col(f"__r{n}_{c}") for n in (a, b) for c in "xy")
        left = C.distance(x(f"LEFT_{a}"), y(f"LEFT_{a}"), x(f"LEFT_{b}"), y(f"LEFT_{b}"))
        m, n = (F.median(F.when(early, d)).over(trial()) for d in (left, C.distance(ax, ay, bx, by)))
        out = out.withColumns({"__m": m, "__n": n})
        scale = F.when((F.col("__m") > 0) & (F.col("__n") > 0), F.col("__m") / F.col("__n")).otherwise(1.0)
        out = out.withColumns({f"__r{b}_x": F.coalesce(ax + (bx - ax) * scale, bx), f"__r{b}_y": F.coalesce(ay + (by - ay) * scale, by)})
    ends = {f"RIGHT_{b}": (F.col(f"__r{b}_x"), F.col(f"__r{b}_y")) for _, b in SEGMENT_PAIRS}
    return with_points(out, ends).select(pose.columns)


# Pairs whose sides are told apart, and the next inner one of the pairs that are checked against one.
SIDE_PAIRS = ("HIP", "KNEE", "ANKLE", "HEEL", "FOOT_INDEX", "SHOULDER")
INNER_PAIR = {"KNEE": "HIP", "ANKLE": "KNEE", "HEEL": "ANKLE", "FOOT_INDEX": "HEEL"}
#: Frames after which a running mean that keeps nine tenths has lost what came before, to the precision of doubles.
_MEMORY = 400


def _square(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.pow(ax - bx, F.lit(2.0)) + F.pow(ay - by, F.lit(2.0))


def pair_turns(pose: DataFrame, ratio: float = 0.25, apart: float = 0.03, drop: float = 0.25) -> DataFrame:
    """trial_id, pos, pair, lx, ly, rx, ry, odd: each pair's points, and whether its sides are the wrong way round by its path alone.

    A pair's last place is that in its last frame in which both points are known and at least ``apart`` from each other.
    It turns in a frame like that where the two ways from there, taken crosswise, are less than ``ratio`` of the straight
    ones, or twice that where both points are seen less by ``drop`` than their running mean, which begins at 1 and
    takes a tenth of each frame. Of an odd number of turns that of the greatest share doesn't count. Frames after an odd
    number of turns are the wrong way round, or all others, if these are fewer.
    """
    seen = lambda n: F.when(F.isnan(F.col("landmarks")[n]["visibility"]), 0.0).otherwise(visibility(n))
    own = [F.struct(F.lit(n).alias("pair"), *[c.alias(f"{s[0].lower()}{a}") for s in ("LEFT", "RIGHT") for a, c in (("x", x(f"{s}_{n}")), ("y", y(f"{s}_{n}")), ("v", seen(f"{s}_{n}")))]) for n in SIDE_PAIRS]
    rows = pose.select("trial_id", "pos", F.explode(F.array(*own)).alias("p")).select("trial_id", "pos", "p.*")
    rows = rows.withColumn("known", F.col("lx").isNotNull() & F.col("ly").isNotNull() & F.col("rx").isNotNull() & F.col("ry").isNotNull())
    rows = rows.withColumn("used", F.coalesce(F.col("known") & (_square(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry")) >= apart * apart), F.lit(False)))
    known, used, every = (Window.partitionBy("trial_id", "pair", *more).orderBy("pos") for more in (["known"], ["used"], []))
    mean = lambda c: F.aggregate(F.collect_list(c).over(known.rowsBetween(1 - _MEMORY, 0)), F.lit(1.0), lambda m, v: 0.1 * v + 0.9 * m)
    rows = rows.withColumns({"ml": mean("lv"), "mr": mean("rv"), **{f"p{c}": F.lag(c).over(used) for c in ("lx", "ly", "rx", "ry")}})
    to = lambda a, b: _square(F.col(f"p{a}x"), F.col(f"p{a}y"), F.col(f"{b}x"), F.col(f"{b}y"))
    straight, crosswise = to("l", "l") + to("r", "r"), to("l", "r") + to("r", "l")
    dim = (F.col("lv") < F.col("ml") - drop) & (F.col("rv") < F.col("mr") - drop)
    share = F.when(F.col("used") & (straight > 0), crosswise / F.when(straight > 0, straight))
    rows = rows.withColumn("share", share).withColumn("share", F.when(F.col("share") < F.when(dim, 2 * ratio).otherwise(ratio), F.col("share")))
    whole = Window.partitionBy("trial_id", "pair")
    rows = rows.withColumns({"turns": F.count("share").over(whole), "weakest": F.min(F.when(F.col("share").isNotNull(), F.struct(-F.col("share"), "pos"))).over(whole)})
    counts = F.col("share").isNotNull() & ~((F.col("turns") % 2 == 1) & (F.col("weakest.pos") == F.col("pos")))
    rows = rows.withColumn("odd", F.sum(F.when(counts, 1).otherwise(0)).over(every.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1)
    most = 2 * F.sum(F.col("odd").cast("int")).over(whole) > F.count("*").over(whole)
    return rows.withColumn("odd", F.col("odd") != most).select("trial_id", "pos", "pair", "lx", "ly", "rx", "ry", "odd")


def exchanged_pairs(turns: DataFrame) -> DataFrame:
    """trial_id, pos, exchanged: the pairs of each frame whose names are exchanged, from the pairs' own turns and their inner neighbours.

    From the hips outwards a joint goes with the next inner one: its left is the point that is nearer to the left of that,
    summed over both sides. Whether two pairs are nearer straight or crosswise doesn't depend on their names, so
    a joint's names are exchanged as its neighbour's are where it's nearer straight, and the other way where crosswise;
    where the sums are equal, or a point is missing, its own turns stand.
    """
    entry = F.struct("pair", F.struct("lx", "ly", "rx", "ry", "odd").alias("p"))
    frames = turns.groupBy("trial_id", "pos").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))  # a pair each
    frames = frames.withColumns({f"e_{n}": F.col("m")[n]["odd"] for n in SIDE_PAIRS})
    for n, inner in INNER_PAIR.items():
        p, q = F.col("m")[n], F.col("m")[inner]
        to = lambda a, b: _square(p[f"{a}x"], p[f"{a}y"], q[f"{b}x"], q[f"{b}y"])  # noqa: B023, E731
        lead = to("l", "r") + to("r", "l") - to("l", "l") - to("r", "r")
        frames = frames.withColumn(f"e_{n}", F.when(lead > 0, F.col(f"e_{inner}")).when(lead < 0, ~F.col(f"e_{inner}")).otherwise(F.col(f"e_{n}")))
    return frames.select("trial_id", "pos", F.array_compact(F.array(*[F.when(F.col(f"e_{n}"), n) for n in SIDE_PAIRS])).alias("exchanged"))


def correct_pair_labels(pose: DataFrame, ratio: float = 0.25, apart: float = 0.03, drop: float = 0.25) -> DataFrame:
    """Sides exchanged pair by pair, where only some landmarks of a frame have them the wrong way round (see pair_turns, exchanged_pairs)."""
    found = exchanged_pairs(pair_turns(pose, ratio, apart, drop))
    other = lambda k: F.when(k.startswith("LEFT_"), F.regexp_replace(k, "^LEFT_", "RIGHT_")).otherwise(F.regexp_replace(k, "^RIGHT_", "LEFT_"))
    own = pose.join(found, ["trial_id", "pos"])
    own = own.withColumn("landmarks", F.when(F.size("exchanged") > 0, F.transform_keys("landmarks", lambda k, v: F.when(F.array_contains(F.col("exchanged"), F.regexp_replace(k, "^(LEFT|RIGHT)_", "")), other(k)).otherwise(k))).otherwise(F.col("landmarks")))
    return own.select(pose.columns)


def estimate_feet(pose: DataFrame, share: float = 0.25) -> DataFrame:
    """Heels and toes that are missing, put about the ankle by a foot's length that is a share of the shank's.

    The heel goes on along the shank by 0.3 and down by 0.1 of it, the toe back across by half and down by 0.15, both
    within the picture, with visibility 0.5. A side without knee or ankle, or with both in one place, has none made.
    """
    parts = {}
    for s in ("LEFT", "RIGHT"):
        kx, ky, ax, ay = x(f"{s}_KNEE"), y(f"{s}_KNEE"), x(f"{s}_ANKLE"), y(f"{s}_ANKLE")
        dx, dy = ax - kx, ay - ky
        length = F.sqrt(dx * dx + dy * dy)
        foot = F.when(length > 0, share * length)
        parts[f"{s}_HEEL"] = (ax + 0.3 * foot * dx / length, ay + 0.3 * foot * dy / length + 0.1 * foot)
        parts[f"{s}_FOOT_INDEX"] = (ax - 0.5 * foot * dx / length, ay + 0.15 * foot)
    made = F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*[_point(C.clip(a, 0.0, 1.0), C.clip(b, 0.0, 1.0), F.lit(0.5)) for a, b in parts.values()]))
    seen = F.map_filter("landmarks", lambda k, p: ~(k.endswith("HEEL") | k.endswith("FOOT_INDEX")) | (C.clean(p["x"]).isNotNull() & C.clean(p["y"]).isNotNull()))
    return pose.withColumns({"__made": made, "__seen": seen}).withColumn("landmarks", F.map_concat("__seen", F.map_filter("__made", lambda k, p: p["x"].isNotNull() & ~F.array_contains(F.map_keys("__seen"), k)))).drop("__made", "__seen")


# ------------------------------------------------------------ joint angles


def trunk_vector() -> tuple[Column, Column]:
    return middle(x("LEFT_HIP"), x("RIGHT_HIP")) - middle(x("LEFT_SHOULDER"), x("RIGHT_SHOULDER")), middle(y("LEFT_HIP"), y("RIGHT_HIP")) - middle(y("LEFT_SHOULDER"), y("RIGHT_SHOULDER"))


def trunk_lean() -> Column:
    """Degrees of the trunk from the vertical, forward positive."""
    tx, ty = trunk_vector()
    a = C.angle_between(-tx, -ty, F.lit(0.0), F.lit(-1.0))
    return F.when(-tx > 0, a).otherwise(-a)


def pelvis_tilt() -> Column:
    """Degrees of the line between the hips; unknown where these are too close to each other for their trunk."""
    dx, dy = x("RIGHT_HIP") - x("LEFT_HIP"), y("RIGHT_HIP") - y("LEFT_HIP")
    tx, ty = trunk_vector()
    wide = F.sqrt(dx * dx + dy * dy)
    return F.when(wide >= F.greatest(F.lit(0.0), F.coalesce(0.45 * F.sqrt(tx * tx + ty * ty), F.lit(0.15))), F.degrees(F.atan2(dy, dx)))


def hip_vertical(side: str) -> Column:
    tx, ty = trunk_vector()
    hx, hy = x(f"{side}_KNEE") - x(f"{side}_HIP"), y(f"{side}_KNEE") - y(f"{side}_HIP")
    return C.wrap180(F.degrees(F.atan2(tx, ty) - F.atan2(hx, hy)))


def hip_interior(side: str) -> Column:
    a = C.interior_angle(middle(x("LEFT_SHOULDER"), x("RIGHT_SHOULDER")), middle(y("LEFT_SHOULDER"), y("RIGHT_SHOULDER")), x(f"{side}_HIP"), y(f"{side}_HIP"), x(f"{side}_KNEE"), y(f"{side}_KNEE"))
    return 180.0 - a


def knee(side: str) -> Column:
    """Flexion; negative where the knee bends over."""
    ax, ay = x(f"{side}_HIP") - x(f"{side}_KNEE"), y(f"{side}_HIP") - y(f"{side}_KNEE")
    bx, by = x(f"{side}_ANKLE") - x(f"{side}_KNEE"), y(f"{side}_ANKLE") - y(f"{side}_KNEE")
    flexion = 180.0 - C.angle_between(ax, ay, bx, by)
    return F.when(ax * by - ay * bx <= 0, flexion).otherwise(-flexion)


def toe(side: str) -> tuple[Column, Column]:
    """The middle of the big and the small toe where a layout has both, else the foot's index."""
    big, small = f"{side}_BIG_TOE", f"{side}_SMALL_TOE"
    seen = x(big).isNotNull() & y(big).isNotNull() & x(small).isNotNull() & y(small).isNotNull()
    return F.when(seen, middle(x(big), x(small))).otherwise(x(f"{side}_FOOT_INDEX")), F.when(seen, middle(y(big), y(small))).otherwise(y(f"{side}_FOOT_INDEX"))


def ankle(side: str) -> Column:
    """Dorsiflexion from the shank and the foot's axis (from the ankle where there is no heel)."""
    tx, ty = toe(side)
    fx, fy = tx - F.coalesce(x(f"{side}_HEEL"), x(f"{side}_ANKLE")), ty - F.coalesce(y(f"{side}_HEEL"), y(f"{side}_ANKLE"))
    return 90.0 - C.angle_between(x(f"{side}_KNEE") - x(f"{side}_ANKLE"), y(f"{side}_KNEE") - y(f"{side}_ANKLE"), fx, fy)


def ankle_from_heel(side: str) -> Column:
    """Dorsiflexion from the line between heel and knee, without the ankle."""
    tx, ty = toe(side)
    return 90.0 - C.angle_between(x(f"{side}_KNEE") - x(f"{side}_HEEL"), y(f"{side}_KNEE") - y(f"{side}_HEEL"), tx - x(f"{side}_HEEL"), ty - y(f"{side}_HEEL"))


def _sides(f: Callable[[str], Column], name: str) -> dict[str, Column]:
    return {f"{name}_L": f("LEFT"), f"{name}_R": f("RIGHT")}


_METHODS: dict[str, Callable[[], dict[str, Column]]] = {
    "sagittal_vertical_axis": lambda: _sides(hip_vertical, "hip") | _sides(knee, "knee") | _sides(ankle, "ankle"),
    "sagittal_classic": lambda: _sides(hip_interior, "hip") | _sides(knee, "knee") | _sides(ankle, "ankle"),
}
LEG = [f"{j}_{s}" for j in ("hip", "knee", "ankle") for s in ("L", "R")]


def register_angle_method(name: str, columns: Callable[[], dict[str, Column]]) -> None:
    """Add a method: a function that gives the columns hip_L to ankle_R over a pose row."""
    _METHODS[name] = columns


def list_angle_methods() -> list[str]:
    return list(_METHODS)


def compute_angles(pose: DataFrame, method: str = "sagittal_vertical_axis", factor: float = 0.8, calibrate: bool = True, calibration_frames: int = 30, min_confidence: float = 0.0, min_std: float = 1.0, max_offset: float = 25.0) -> DataFrame:
    """Joint angles per frame: trial_id, frame_idx, pos, hip_L to ankle_R, trunk_angle, pelvis_tilt.

    Frames below ``min_confidence`` have none. Angles of trials that walk to the left change sign. Leg angles are scaled
    by ``factor``. Calibration takes the mean of the first frames as neutral, where these move enough to be a stance
    (standard deviation at least ``min_std`` means walking, whose mean is not neutral) or the offset is no more than
    ``max_offset``.
    """
    if method not in _METHODS:
        raise UnknownName(method)
    angles = _METHODS[method]() | {"trunk_angle": trunk_lean(), "pelvis_tilt": pelvis_tilt()}
    ahead = F.median(middle(x("LEFT_FOOT_INDEX") - x("LEFT_HEEL"), x("RIGHT_FOOT_INDEX") - x("RIGHT_HEEL"))).over(trial())
    base = pose.select("trial_id", "frame_idx", "pos", "confidence", *[c.alias(n) for n, c in angles.items()], ahead.alias("__ahead"))
    sure = F.coalesce(F.col("confidence") >= min_confidence, F.lit(True))
    turn = F.when(F.col("__ahead") < 0, -1.0).otherwise(1.0)
    out = base.withColumns({n: F.when(sure, F.col(n) * (turn if n[:3] in ("hip", "kne", "tru") else 1.0) * (factor if n in LEG else 1.0)) for n in angles})
    out = series.unwrap(out, ["trial_id"], "pelvis_tilt", "pelvis_tilt")
    if calibrate:
        early = lambda n: F.when(F.col("pos") < calibration_frames, F.col(n))
        out = out.withColumns({f"__o_{n}": F.avg(early(n)).over(trial()) for n in LEG} | {f"__s_{n}": F.stddev_pop(early(n)).over(trial()) for n in LEG})
        still = lambda n: (F.col(f"__s_{n}") < min_std) & (F.abs(f"__o_{n}") <= max_offset)
        out = out.withColumns({n: F.when(still(n), F.col(n) - F.col(f"__o_{n}")).otherwise(F.col(n)) for n in LEG})
    return out.select("trial_id", "frame_idx", "pos", *angles)


def canonicalize_signs(angles: DataFrame) -> DataFrame:
    """Knees flex upward: hip and knee turn where a knee's mean is negative, then the hip where it extends at the knee's top frames."""
    out = angles
    for s in ("L", "R"):
        turn = F.when(F.avg(f"knee_{s}").over(trial()) < 0, -1.0).otherwise(1.0)
        out = out.withColumn("__t", turn).withColumns({f"knee_{s}": F.col(f"knee_{s}") * F.col("__t"), f"hip_{s}": F.col(f"hip_{s}") * F.col("__t")})
        out = out.withColumns({"__r": F.row_number().over(Window.partitionBy("trial_id").orderBy(F.desc_nulls_last(f"knee_{s}"), "pos")), "__n": F.count(f"knee_{s}").over(trial())})
        top = F.col(f"knee_{s}").isNotNull() & (F.col("__r") <= F.greatest(F.lit(5), F.floor(F.col("__n") / 10)))
        out = out.withColumn("__h", F.avg(F.when(top, F.col(f"hip_{s}"))).over(trial())).withColumn(f"hip_{s}", F.when(F.col("__h") < 0, -F.col(f"hip_{s}")).otherwise(F.col(f"hip_{s}")))
    return out.drop("__t", "__r", "__n", "__h")


def extended_angles(pose: DataFrame) -> DataFrame:
    """Head, shoulders, elbows and sagittal pelvis per frame, in degrees.

    The head's angle is that of the nose over the ears against the trunk, with the sign of their turn; shoulders are the
    upper arms' angles from the hanging trunk, without sign; elbows are 0 when straight; the pelvis leans forward positive.
    """
    tx, ty = trunk_vector()
    hx, hy = x("NOSE") - middle(x("LEFT_EAR"), x("RIGHT_EAR")), y("NOSE") - middle(y("LEFT_EAR"), y("RIGHT_EAR"))
    head = C.angle_between(hx, hy, -tx, -ty)
    lean = C.angle_between(-tx, -ty, F.lit(0.0), F.lit(-1.0))

    def shoulder(s: str) -> Column:
        return C.angle_between(x(f"{s}_ELBOW") - x(f"{s}_SHOULDER"), y(f"{s}_ELBOW") - y(f"{s}_SHOULDER"), tx, ty)

    def elbow(s: str) -> Column:
        return 180.0 - C.interior_angle(x(f"{s}_SHOULDER"), y(f"{s}_SHOULDER"), x(f"{s}_ELBOW"), y(f"{s}_ELBOW"), x(f"{s}_WRIST"), y(f"{s}_WRIST"))

    own = {"head_angle": F.when(hy * tx - hx * ty >= 0, head).otherwise(-head)} | _sides(shoulder, "shoulder_flex") | _sides(elbow, "elbow_flex") | {"pelvis_sagittal_tilt": F.when(-tx >= 0, lean).otherwise(-lean)}
    return pose.select("trial_id", "frame_idx", "pos", *[c.alias(n) for n, c in own.items()])


def foot_progression(pose: DataFrame) -> DataFrame:
    """Degrees of each foot's axis above the horizontal."""
    own = _sides(lambda s: F.degrees(F.atan2(-(toe(s)[1] - y(f"{s}_HEEL")), toe(s)[0] - x(f"{s}_HEEL"))), "foot_angle")
    return pose.select("trial_id", "frame_idx", "pos", *[c.alias(n) for n, c in own.items()])


def frontal_angles(pose: DataFrame) -> DataFrame:
    """hip_abduction and knee_valgus of both sides, from x and depth; null where a depth is.

    Abduction is the angle between the thigh and the axis of depth, valgus what thigh and shank lack of a straight line,
    both without sign.
    """
    z = lambda n: F.col("landmark_depths")[n]

    def hip(s: str) -> Column:
        return C.angle_between(x(f"{s}_KNEE") - x(f"{s}_HIP"), z(f"{s}_KNEE") - z(f"{s}_HIP"), F.lit(0.0), F.lit(1.0))

    def valgus(s: str) -> Column:
        return 180.0 - C.interior_angle(x(f"{s}_HIP"), z(f"{s}_HIP"), x(f"{s}_KNEE"), z(f"{s}_KNEE"), x(f"{s}_ANKLE"), z(f"{s}_ANKLE"))

    own = _sides(hip, "hip_abduction") | _sides(valgus, "knee_valgus")
    return pose.select("trial_id", "frame_idx", "pos", *[c.alias(n) for n, c in own.items()])


def depth_ratio(a: str, b: str) -> Column:
    """How much longer a segment is in space than in the picture, 2 at most."""
    flat = C.distance(x(a), y(a), x(b), y(b))
    dz = F.col("landmark_depths")[b] - F.col("landmark_depths")[a]
    ratio = C.safe_divide(F.sqrt(flat * flat + dz * dz), flat)
    return F.when(ratio.isNotNull(), F.least(F.lit(2.0), ratio))


# The segment by whose depth an angle is judged.
DEPTH_SEGMENTS = {"hip": ("HIP", "KNEE"), "knee": ("KNEE", "ANKLE"), "ankle": ("ANKLE", "FOOT_INDEX")}


def depth_factors(pose: DataFrame) -> DataFrame:
    """trial_id, frame_idx, pos, and hip_L to ankle_R: how much longer each angle's segment is in space than in the picture.

    From 1, also where a point or a depth is missing, to 2. Frames without any depths have null factors.
    """
    has = F.col("landmark_depths").isNotNull()
    own = {f"{joint}_{s[0]}": F.when(has, F.coalesce(depth_ratio(f"{s}_{a}", f"{s}_{b}"), F.lit(1.0))) for s in ("LEFT", "RIGHT") for joint, (a, b) in DEPTH_SEGMENTS.items()}
    return pose.select("trial_id", "frame_idx", "pos", *[c.alias(n) for n, c in own.items()])


def depth_corrected(pose: DataFrame, angles: DataFrame) -> DataFrame:
    """angles with hip, knee and ankle multiplied by their segments' factors, where frames have depths."""
    factors = depth_factors(pose).drop("pos")
    names = [c for c in factors.columns if c not in ("trial_id", "frame_idx") and c in angles.columns]
    j = angles.join(factors.select("trial_id", "frame_idx", *[F.col(c).alias(f"__f_{c}") for c in names]), ["trial_id", "frame_idx"], "left")
    return j.withColumns({c: F.col(c) * F.coalesce(f"__f_{c}", F.lit(1.0)) for c in names}).select(angles.columns)


# Joints of the frontal plane, and the column of each side.
FRONTAL_JOINTS = {"pelvis_list": ("pelvis_list", "pelvis_list"), "hip_adduction": ("hip_adduction_L", "hip_adduction_R"), "knee_valgus": ("knee_valgus_L", "knee_valgus_R")}


def frontal_long(angles: DataFrame) -> DataFrame:
    """trial_id, frame_idx, pos, side, joint, value of the frontal joints whose columns angles has; frames without a value have no row."""
    rows = [F.struct(F.lit(side).alias("side"), F.lit(joint).alias("joint"), F.col(columns[k]).alias("value")) for joint, columns in FRONTAL_JOINTS.items() for k, side in enumerate(("left", "right")) if columns[k] in angles.columns]
    keys = ["trial_id", "frame_idx", "pos"]
    if not rows:
        return angles.select(*keys, F.lit("").alias("side"), F.lit("").alias("joint"), F.lit(0.0).alias("value")).limit(0)
    return angles.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*").filter(F.col("value").isNotNull())


def correct_ankle_swaps(pose: DataFrame, angles: DataFrame, threshold: float = 8.0) -> DataFrame:
    """Ankle angles replaced by those without the ankle landmark where both differ by more than the threshold; swap_L, swap_R tell."""
    both = pose.select("trial_id", "frame_idx", *[c for s, p in (("L", "LEFT"), ("R", "RIGHT")) for c in (ankle(p).alias(f"__a_{s}"), ankle_from_heel(p).alias(f"__b_{s}"))])
    out = angles.join(both, ["trial_id", "frame_idx"], "left")
    for s in ("L", "R"):
        out = out.withColumn(f"swap_{s}", F.coalesce(F.abs(F.col(f"__a_{s}") - F.col(f"__b_{s}")) > threshold, F.lit(False))).withColumn(f"ankle_{s}", F.when(F.col(f"swap_{s}"), F.col(f"__b_{s}")).otherwise(F.col(f"ankle_{s}")))
    return out.drop("__a_L", "__b_L", "__a_R", "__b_R")


def correct_ankle_projection(pose: DataFrame, angles: DataFrame, flat: float = 0.012, least: int = 10) -> DataFrame:
    """Ankle angles less what an ankle landmark that slides along the foot adds to them.

    t is the ankle's place along the line from heel to toe. While the foot is flat (heel and toe within ``flat``) the true
    angle hardly changes, so its slope over t's distance from its median is the landmark's doing and is taken out of all
    frames. Sides with fewer than ``least`` places, or angles of a flat foot, stay as they are.
    """
    out = angles
    for s, side in (("L", "LEFT"), ("R", "RIGHT")):
        tx, ty = toe(side)
        hx, hy = x(f"{side}_HEEL"), y(f"{side}_HEEL")
        fx, fy = tx - hx, ty - hy
        length = fx * fx + fy * fy
        t = F.when((F.sqrt(length) >= 1e-6) & x(f"{side}_KNEE").isNotNull(), ((x(f"{side}_ANKLE") - hx) * fx + (y(f"{side}_ANKLE") - hy) * fy) / length)
        placed = pose.select("trial_id", "frame_idx", t.alias("__t"), (F.abs(fy) < flat).alias("__flat"))
        out = out.join(placed, ["trial_id", "frame_idx"], "left")
        out = out.withColumn("__d", F.median("__t").over(trial()) - F.col("__t"))
        steady = F.col("__flat") & F.col("__d").isNotNull() & F.col(f"ankle_{s}").isNotNull()
        d, a = F.when(steady, F.col("__d")), F.when(steady, F.col(f"ankle_{s}"))
        slope = F.when((F.count("__t").over(trial()) >= least) & (F.count(d).over(trial()) >= least) & (F.stddev_pop(d).over(trial()) >= 1e-8), F.covar_pop(a, d).over(trial()) / F.var_pop(d).over(trial()))
        out = out.withColumn(f"ankle_{s}", F.col(f"ankle_{s}") - F.coalesce(slope * F.col("__d"), F.lit(0.0))).drop("__t", "__flat", "__d")
    return out.select(angles.columns)


def angles_long(angles: DataFrame) -> DataFrame:
    """trial_id, frame_idx, pos, side, joint, value; trunk and pelvis belong to both sides."""
    rows = [F.struct(F.lit(side).alias("side"), F.lit(joint).alias("joint"), F.col(column).alias("value")) for s, side in (("L", "left"), ("R", "right")) for joint, column in (("hip", f"hip_{s}"), ("knee", f"knee_{s}"), ("ankle", f"ankle_{s}"), ("trunk", "trunk_angle"), ("pelvis", "pelvis_tilt")) if column in angles.columns]
    return angles.select("trial_id", "frame_idx", "pos", F.explode(F.array(*rows)).alias("r")).select("trial_id", "frame_idx", "pos", "r.side", "r.joint", "r.value")
