"""Extra key points by index: sides exchanged by a permutation that names make, over arrays of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.exceptions import InvalidData
from kinelake.schemas import COCO_17


def wholebody_133() -> list[str]:
    """Names of the 133 points of whole bodies: 17 of the body, 6 of the feet, 68 of the face, 21 of each hand."""
    body = [n.lower() for n in COCO_17]
    feet = [f"{s}_{n}" for s in ("left", "right") for n in ("big_toe", "small_toe", "heel")]
    hands = [f"{s}_hand_{k}" for s in ("left", "right") for k in range(21)]
    return [*body, *feet, *(f"face_{k}" for k in range(68)), *hands]


def partner(name: str) -> str | None:
    """The name of the point on the other side, if a name has a side."""
    for a, b in (("left_", "right_"), ("right_", "left_")):
        if a in name:
            return name.replace(a, b)
    for a, b in (("l_", "r_"), ("r_", "l_")):
        if name.startswith(a):
            return b + name[2:]
    return None


def permutation(names: list[str]) -> list[int]:
    """For each point the place of the one on its other side; points of no side, or without the other, stay.

    Names have to differ. Doing it twice is the identity.
    """
    place = {n: k for k, n in enumerate(names)}
    if len(place) != len(names):
        raise InvalidData("names of points repeat")
    other = [place.get(partner(n) or n, k) for k, n in enumerate(names)]
    return [j if other[j] == k else k for k, j in enumerate(other)]


def _permuted(points: Column, names: list[str]) -> Column:
    """The points at the permuted places; points beyond the names stay behind them."""
    order = F.array(*map(F.lit, permutation(names)))
    own = F.transform(order, lambda k: F.get(points, k))
    return F.when(F.size(points) >= len(names), F.concat(own, F.slice(points, len(names) + 1, F.greatest(F.lit(1), F.size(points))))).otherwise(points)


def swap_points(frames: DataFrame, names: list[str], when: Column | bool = True, column: str = "points") -> DataFrame:
    """Frames with the sides of an array of points [x, y, confidence] exchanged where ``when`` holds.

    Null arrays stay null, and arrays of fewer points than names as they are.
    """
    where = F.coalesce(when if isinstance(when, Column) else F.lit(when), F.lit(False))
    return frames.withColumn(column, F.when(where, _permuted(F.col(column), names)).otherwise(F.col(column)))


def flip_points(frames: DataFrame, names: list[str], when: Column | bool = True, column: str = "points") -> DataFrame:
    """The same in a mirror: x becomes 1 - x too."""
    where = F.coalesce(when if isinstance(when, Column) else F.lit(when), F.lit(False))
    mirrored = F.transform(column, lambda p: F.when(p.isNotNull(), F.concat(F.array(1.0 - F.get(p, F.lit(0))), F.slice(p, 2, F.greatest(F.lit(1), F.size(p))))))
    return swap_points(frames.withColumn(column, F.when(where, mirrored).otherwise(F.col(column))), names, when, column)
