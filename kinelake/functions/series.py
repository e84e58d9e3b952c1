"""Operators on ordered series as window expressions over (key, pos).

A series is a set of rows with the same key, ordered by an integer position. All functions take and return DataFrames,
add columns, and use one partitioning (the key), so that chains of them need a single exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def _w(keys: Keys, pos: str):
    return Window.partitionBy(*keys).orderBy(pos)


def _all(keys: Keys):
    return Window.partitionBy(*keys)


def as_series(rows: DataFrame, keys: Keys, order: list[str], pos: str = "pos") -> DataFrame:
    """Number the rows of each key from 0 in the given order."""
    return rows.withColumn(pos, F.row_number().over(_w(keys, order[0]) if len(order) == 1 else Window.partitionBy(*keys).orderBy(*order)) - 1)


def gradient(df: DataFrame, keys: Keys, value: str, out: str, dt: Column | float = 1.0, pos: str = "pos") -> DataFrame:
    """Central differences; one-sided at the ends; null where a neighbour is null or the series has one row."""
    w = _w(keys, pos)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    first, last = F.lag(pos).over(w).isNull(), F.lead(pos).over(w).isNull()
    step = dt if isinstance(dt, Column) else F.lit(float(dt))
    slope = F.when(first & last, F.lit(None)).when(first, (after - F.col(value)) / step).when(last, (F.col(value) - before) / step).otherwise((after - before) / (2.0 * step))
    return df.withColumn(out, slope)


def forward_fill(df: DataFrame, keys: Keys, value: str, out: str, pos: str = "pos") -> DataFrame:
    w = _w(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def fill_both(df: DataFrame, keys: Keys, value: str, out: str, pos: str = "pos") -> DataFrame:
    """The last known value, and before the first one that."""
    back = _w(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    on = _w(keys, pos).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(on)))


def interpolate(df: DataFrame, keys: Keys, value: str, out: str, pos: str = "pos", hold_ends: bool = True, max_gap: int | None = None) -> DataFrame:
    """Nulls between known values replaced in proportion to position.

    ``hold_ends`` carries the nearest known value to the ends. With ``max_gap`` only runs of at most so many nulls are
    filled.
    """
    back = _w(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    on = _w(keys, pos).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(pos))
    p0, p1 = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(on)
    v0, v1 = F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(on)
    marked = df.withColumns({"__p0": p0, "__p1": p1, "__v0": v0, "__v1": v1})
    between = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col(pos) - F.col("__p0")) / (F.col("__p1") - F.col("__p0"))
    filled = F.coalesce(F.col(value), between)
    if hold_ends:
        filled = F.coalesce(filled, "__v0", "__v1")
    if max_gap is not None:
        size = F.col("__p1") - F.col("__p0") - 1
        filled = F.when(F.col(value).isNotNull() | (size <= max_gap), filled)
    return marked.withColumn(out, filled).drop("__p0", "__p1", "__v0", "__v1")


def rolling_mean(df: DataFrame, keys: Keys, value: str, out: str, window: int = 5, pos: str = "pos") -> DataFrame:
    """Centred mean of what is known in the window; an even window reaches one row further back than ahead."""
    w = _w(keys, pos).rowsBetween(-(window // 2), (window - 1) // 2)
    return df.withColumn(out, F.avg(value).over(w))


def rolling_std(df: DataFrame, keys: Keys, value: str, out: str, half: int, least: int = 3, pos: str = "pos") -> DataFrame:
    """Centred population standard deviation over 2 * half + 1 rows; null with fewer than ``least`` known values."""
    w = _w(keys, pos).rowsBetween(-half, half)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, F.stddev_pop(value).over(w)))


def rolling_median(df: DataFrame, keys: Keys, value: str, out: str, kernel: int = 3, pos: str = "pos") -> DataFrame:
    """Median over an odd kernel; beyond the ends the series counts as zero."""
    if kernel % 2 == 0:
        kernel += 1
    w = _w(keys, pos)
    half = kernel // 2
    around = F.array(*[F.coalesce(F.lag(value, -k).over(w), F.when(F.lag(pos, -k).over(w).isNull(), F.lit(0.0))) if k else F.col(value) for k in range(-half, half + 1)])
    return df.withColumn(out, F.when(F.exists(around, lambda v: v.isNull()), F.lit(None)).otherwise(F.get(F.array_sort(around), F.lit(half))))


def z_score(df: DataFrame, keys: Keys, value: str, out: str, population: bool = False) -> DataFrame:
    """Distance from the series' mean in standard deviations; null where these are zero or undefined."""
    w = _all(keys)
    sd = (F.stddev_pop if population else F.stddev_samp)(value).over(w)
    return df.withColumn(out, F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd))


def drop_outliers(df: DataFrame, keys: Keys, value: str, out: str, limit: float = 3.0, pos: str = "pos") -> DataFrame:
    """Values more than ``limit`` sample standard deviations from the mean, interpolated from the others."""
    marked = z_score(df, keys, value, "__z").withColumn("__kept", F.when(F.col("__z").isNull() | (F.abs("__z") <= limit), F.col(value)))
    return interpolate(marked, keys, "__kept", out, pos).drop("__z", "__kept")


def detrend(df: DataFrame, keys: Keys, value: str, out: str, least: int = 20, pos: str = "pos") -> DataFrame:
    """Less the straight line fitted over position, with the mean kept; series of fewer than ``least`` values stay."""
    w = _all(keys)
    x, y = F.when(F.col(value).isNotNull(), F.col(pos).cast("double")), F.col(value)
    n = F.count(value).over(w)
    mx, my = F.avg(x).over(w), F.avg(y).over(w)
    marked = df.withColumns({"__n": n, "__mx": mx, "__my": my})
    dx = x - F.col("__mx")
    marked = marked.withColumns({"__xy": F.sum(dx * (y - F.col("__my"))).over(w), "__xx": F.sum(dx * dx).over(w)})
    flat = y - F.col("__xy") / F.col("__xx") * dx
    return marked.withColumn(out, F.when((F.col("__n") >= least) & (F.col("__xx") > 0), flat).otherwise(y)).drop("__n", "__mx", "__my", "__xy", "__xx")


def unwrap(df: DataFrame, keys: Keys, value: str, out: str, period: float = 360.0, pos: str = "pos") -> DataFrame:
    """Jumps of more than half a period between known values taken out by whole periods."""
    back = _w(keys, pos).rowsBetween(Window.unboundedPreceding, -1)
    step = F.col(value) - F.last(value, ignorenulls=True).over(back)
    half = period / 2
    shifted = step + half
    inside = shifted - period * F.floor(shifted / period) - half
    inside = F.when((inside == -half) & (step > 0), F.lit(half)).otherwise(inside)
    change = F.when(F.abs(step) < half, F.lit(0.0)).otherwise(inside - step)
    marked = df.withColumn("__change", F.coalesce(change, F.lit(0.0)))
    total = F.sum("__change").over(_w(keys, pos).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(out, F.col(value) + total).drop("__change")


def islands(df: DataFrame, keys: Keys, starts: Column, out: str, order: list[str]) -> DataFrame:
    """Number runs of rows: ``starts`` is true on the first row of each; numbers begin at 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__start", F.when(starts, 1).otherwise(0))
    return marked.withColumn(out, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def gap_runs(df: DataFrame, keys: Keys, value: str, pos: str = "pos") -> DataFrame:
    """A row per run of nulls: keys, first and last position, and length."""
    w = _w(keys, pos)
    known_before = F.last(F.when(F.col(value).isNotNull(), F.col(pos)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nulls = df.select(*keys, pos, value, known_before.alias("__known")).filter(F.col(value).isNull())
    return nulls.groupBy(*keys, "__known").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("length")).drop("__known")


def autocorrelation(df: DataFrame, keys: Keys, value: str, lags: int, pos: str = "pos") -> DataFrame:
    """keys, lag, r: the normalised autocorrelation for lags 0 to ``lags``, by one window per lag in a single pass."""
    w, every = _w(keys, pos), _all(keys)
    centred = df.withColumn("__c", F.col(value) - F.avg(value).over(every))
    products = centred.select(*keys, *[(F.col("__c") * F.lead("__c", k).over(w)).alias(f"__{k}") if k else (F.col("__c") * F.col("__c")).alias("__0") for k in range(lags + 1)], F.lit(1).alias("__one"))
    sums = products.groupBy(*keys).agg(F.count("__one").alias("__n"), *[F.sum(f"__{k}").alias(f"__{k}") for k in range(lags + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__{k}").alias("s")) for k in range(lags + 1)])
    long = sums.select(*keys, "__0", "__n", F.explode(pairs).alias("x")).filter(F.col("x.lag") < F.col("__n"))
    return long.filter(F.col("__0") > 0).select(*keys, F.col("x.lag").alias("lag"), (F.col("x.s") / F.col("__0")).alias("r"))


def local_maxima(df: DataFrame, keys: Keys, value: str, pos: str = "pos") -> DataFrame:
    """Rows strictly above both neighbours."""
    w = _w(keys, pos)
    marked = df.withColumns({"__a": F.lag(value).over(w), "__b": F.lead(value).over(w)})
    return marked.filter((F.col(value) > F.col("__a")) & (F.col(value) > F.col("__b"))).drop("__a", "__b")


def thin(df: DataFrame, keys: Keys, pos: str, distance: int) -> DataFrame:
    """Of each key's positions, greedily from the first, those at least ``distance`` after the last one kept.

    What is kept depends on what was, so it is a fold over each key's ordered positions rather than a window.
    """
    start = F.array().cast("array<bigint>")
    fold = F.aggregate(F.array_sort(F.collect_list(F.col(pos).cast("bigint"))), start, lambda kept, p: F.when((F.size(kept) == 0) | (p - F.element_at(kept, -1) >= distance), F.concat(kept, F.array(p))).otherwise(kept))
    return df.groupBy(*keys).agg(fold.alias("__kept")).select(*keys, F.explode("__kept").alias(pos))


def exponential_mean(df: DataFrame, keys: Keys, value: str, alpha: float, pos: str = "pos") -> DataFrame:
    """keys, pos, ema: the exponential moving average, which starts at the first value; null values leave it as it is."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(value).alias("v"))))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<struct<pos:bigint,ema:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.coalesce(alpha * x["v"] + (1 - alpha) * acc["last"], acc["last"], x["v"].cast("double"))
        return F.struct(new.alias("last"), F.concat(acc["out"], F.array(F.struct(x[pos].cast("bigint").alias("pos"), new.alias("ema")))).alias("out"))

    folded = df.groupBy(*keys).agg(F.aggregate(ordered, start, step, lambda acc: acc["out"]).alias("__out"))
    return folded.select(*keys, F.explode("__out").alias("__x")).select(*keys, F.col("__x.pos").alias(pos), F.col("__x.ema").alias("ema"))


def cross_correlation(df: DataFrame, keys: Keys, a: str, b: str, max_lag: int, pos: str = "pos") -> DataFrame:
    """keys, lag, r: correlation of a shifted by lag against b, centred and normalised, for all lags within max_lag."""
    w, every = _w(keys, pos), _all(keys)
    centred = df.withColumns({"__a": F.col(a) - F.avg(a).over(every), "__b": F.col(b) - F.avg(b).over(every)})
    lags = range(-max_lag, max_lag + 1)
    products = centred.select(*keys, "__a", "__b", *[(F.lag("__a", -k).over(w) * F.col("__b") if k else F.col("__a") * F.col("__b")).alias(f"__{k + max_lag}") for k in lags])
    scale = F.sqrt(F.sum(F.col("__a") * F.col("__a")) * F.sum(F.col("__b") * F.col("__b")))
    sums = products.groupBy(*keys).agg(scale.alias("__s"), *[F.sum(f"__{k + max_lag}").alias(f"__{k + max_lag}") for k in lags])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(f"__{k + max_lag}", F.lit(0.0)).alias("s")) for k in lags])
    return sums.filter(F.col("__s") > 0).select(*keys, "__s", F.explode(pairs).alias("x")).select(*keys, F.col("x.lag").alias("lag"), (F.col("x.s") / F.col("__s")).alias("r"))


def resample_long(df: DataFrame, keys: Keys, value: str, points: int = 101, pos: str = "pos") -> DataFrame:
    """keys, p, value: each series brought to equally spaced points, by neighbours within the window and no join."""
    w, every = _w(keys, pos), _all(keys)
    marked = df.select(*keys, F.row_number().over(w).alias("__k"), F.col(value).cast("double").alias("__v"), F.count("*").over(every).alias("__n"), F.lead(F.col(value).cast("double")).over(w).alias("__next"))
    at = (F.col("__k") - 1).cast("double")
    scale = (F.col("__n") - 1).cast("double") / float(points - 1)
    # The points p whose place p * scale lies in [k, k + 1); the last row takes the last point, and one row takes all.
    first = F.ceil(at / scale - 1e-9).cast("int")
    last = F.when(F.col("__k") == F.col("__n"), F.lit(points - 1)).otherwise((F.ceil((at + 1) / scale - 1e-9) - 1).cast("int"))
    place = F.when(F.col("__n") == 1, F.sequence(F.lit(0), F.lit(points - 1))).when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    long = marked.withColumn("p", F.explode(place))
    fraction = F.col("p") * scale - at
    return long.select(*keys, "p", F.when(F.col("__next").isNull() | (F.abs(fraction) < 1e-9), F.col("__v")).otherwise(F.col("__v") + (F.col("__next") - F.col("__v")) * fraction).alias("value"))
