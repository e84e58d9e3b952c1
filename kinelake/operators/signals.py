"""Signal cleaning of landmark tracks: a registry of steps, relational where windows express them, else kernels by series.

Tracks are long rows (trial_id, name, pos, x, y, ...). Kernels get one series at a time through grouped maps.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.exceptions import UnknownName
from kinelake.functions import kernels as K
from kinelake.functions import series
from kinelake.operators import guard

KEYS = ["trial_id", "name"]


def per_series(tracks: DataFrame, kernel: Callable[..., np.ndarray], columns: tuple[str, ...] = ("x", "y"), keys: list[str] | None = None, rated: bool = False) -> DataFrame:
    """Each column of each series through a kernel, after gaps are interpolated; a kernel that raises leaves the interpolated series.

    Tracks with a status (see guard) get there what was raised first, of any kind. A ``rated`` kernel is given the series'
    rate too, from a column of that name.
    """
    keys = keys or KEYS
    names = tracks.columns
    tell = "status" in names
    caught = Exception if tell else (ValueError, np.linalg.LinAlgError)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        failed = None
        more = (table.column("rate")[0].as_py(),) if rated else ()
        for c in columns:
            values = K.fill_linear(table.column(c).to_numpy().astype(float))
            if not np.isnan(values).all():
                try:
                    values = kernel(values, *more)
                except caught as error:
                    failed = failed or guard.described("normalize", error)
            table = table.set_column(table.column_names.index(c), c, pa.array(values, pa.float64(), mask=np.isnan(values)))
        if tell and failed and table.column("status")[0].as_py() is None:
            table = table.set_column(table.column_names.index("status"), "status", pa.array([failed] * table.num_rows, guard.STATUS_ARROW))
        return table.select(names)

    return tracks.groupBy(*keys).applyInArrow(run, tracks.schema)


def butterworth(tracks: DataFrame, cutoff: float = 4.0, order: int = 2, rate: float | None = None) -> DataFrame:
    """A low-pass forward and backward; without a rate that of the tracks' column ``rate`` holds, or else 30."""
    if rate is None and "rate" in tracks.columns:
        return per_series(tracks, lambda v, own: K.zero_phase(*K.butterworth(order, cutoff, own), v), rated=True)
    b, a = K.butterworth(order, cutoff, rate or 30.0)
    return per_series(tracks, lambda v: K.zero_phase(b, a, v))


def savgol(tracks: DataFrame, window: int = 21, degree: int = 2) -> DataFrame:
    return per_series(tracks, lambda v: K.savgol(v, window, degree))


def spline(tracks: DataFrame, limit: float = 0.5) -> DataFrame:
    return per_series(tracks, lambda v: K.smoothing_spline(v, limit))


def kalman(tracks: DataFrame) -> DataFrame:
    return per_series(tracks, K.kalman_smooth)


def loess(tracks: DataFrame, share: float = 0.1, rounds: int = 3) -> DataFrame:
    return per_series(tracks, lambda v: K.lowess(v, share, rounds))


def wavelet(tracks: DataFrame, level: int | None = None, mode: str = "soft") -> DataFrame:
    return per_series(tracks, lambda v: K.wavelet_denoise(v, level, mode))


def _by_window(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def run(tracks: DataFrame, **options) -> DataFrame:
        names = tracks.columns
        for c in ("x", "y"):
            tracks = step(tracks, KEYS, c, f"__{c}", **options).withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
        return tracks.select(names)

    return run


def moving_mean(tracks: DataFrame, window: int = 5) -> DataFrame:
    return _by_window(series.rolling_mean)(tracks, window=window)


def median(tracks: DataFrame, kernel: int = 3) -> DataFrame:
    filled = _by_window(series.interpolate)(tracks)
    return _by_window(series.rolling_median)(filled, kernel=kernel)


def outliers(tracks: DataFrame, limit: float = 3.0) -> DataFrame:
    return _by_window(series.drop_outliers)(tracks, limit=limit)


def low_visibility(tracks: DataFrame, threshold: float = 0.3) -> DataFrame:
    bad = F.coalesce("visibility", F.lit(1.0)) < threshold
    return tracks.withColumns({c: F.when(~bad, F.col(c)) for c in ("x", "y")})


def fill_gaps(tracks: DataFrame, method: str = "spline", max_gap: int = 10) -> DataFrame:
    """Runs of at most ``max_gap`` missing points filled by line, cubic spline or zero; longer ones stay missing."""
    if method == "linear":
        return _by_window(series.interpolate)(tracks, hold_ends=False, max_gap=max_gap)
    if method == "zero":
        out = tracks
        for c in ("x", "y"):
            out = series.interpolate(out, KEYS, c, "__short", hold_ends=False, max_gap=max_gap).withColumn(c, F.when(F.col(c).isNull() & F.col("__short").isNotNull(), 0.0).otherwise(F.col(c))).drop("__short")
        return out.select(tracks.columns)
    if method != "spline":
        raise UnknownName(method)

    def kernel(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        at = table.column("pos").to_numpy().astype(float)
        for c in ("x", "y"):
            v = table.column(c).to_numpy().astype(float)
            known = np.flatnonzero(~np.isnan(v))
            if len(known) >= 4:
                runs = np.split(np.flatnonzero(np.isnan(v)), np.flatnonzero(np.diff(np.flatnonzero(np.isnan(v))) > 1) + 1)
                short = np.concatenate([np.zeros(0, int), *[r for r in runs if len(r) and len(r) <= max_gap and known[0] < r[0] and r[-1] < known[-1]]]).astype(int)
                v[short] = K.cubic_spline(at[known], v[known], at[short])
            table = table.set_column(table.column_names.index(c), c, pa.array(v, mask=np.isnan(v)))
        return table.select(names)

    names = tracks.columns
    return tracks.groupBy(*KEYS).applyInArrow(kernel, tracks.schema)


def gap_report(tracks: DataFrame) -> DataFrame:
    """Runs of missing points of each landmark."""
    return series.gap_runs(tracks, KEYS, "x")


STEPS: dict[str, Callable[..., DataFrame]] = {
    "butterworth": butterworth, "savgol": savgol, "moving_mean": moving_mean, "spline": spline, "median": median, "kalman": kalman, "loess": loess, "wavelet": wavelet,
    "outliers": outliers, "confidence": low_visibility, "fill_gaps": fill_gaps,
}


def register_step(name: str, step: Callable[..., DataFrame]) -> None:
    """Add a step: a function of a tracks DataFrame and options that gives one with the same columns."""
    STEPS[name] = step


def list_steps() -> list[str]:
    return list(STEPS)


def normalize(tracks: DataFrame, steps: list[dict | str], gap_max: int = 10) -> DataFrame:
    """The steps, by name with options, one after the other; points in gaps longer than ``gap_max`` are missing again at the end.

    Names that aren't registered are passed over with a warning.
    """
    out = tracks
    for c in ("x", "y"):
        out = series.interpolate(out, KEYS, c, f"__ok_{c}", hold_ends=False, max_gap=gap_max)
    long = out.select(*KEYS, "pos", F.col("__ok_x").isNotNull().alias("__kx"), F.col("__ok_y").isNotNull().alias("__ky"))
    out = tracks
    for step in steps:
        options = {} if isinstance(step, str) else {k: v for k, v in step.items() if k != "type"}
        name = step if isinstance(step, str) else step["type"]
        if name not in STEPS:
            warnings.warn(f"no normalisation step {name}", stacklevel=2)
            continue
        out = STEPS[name](out, **options)
    joined = out.join(long, [*KEYS, "pos"])
    return joined.withColumns({"x": F.when(F.col("__kx"), F.col("x")), "y": F.when(F.col("__ky"), F.col("y"))}).select(tracks.columns)


def residual_analysis(tracks: DataFrame, rate: float = 30.0, low: float = 1.0, high: float = 15.0, step: float = 0.5) -> DataFrame:
    """trial_id, name, axis, cutoffs, residuals, knee: what low-passes of each cutoff take away, and where that bends."""
    cutoffs = np.arange(low, min(high, rate / 2 - 1e-9) + 1e-9, step)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        rows = []
        for axis in ("x", "y"):
            v = table.column(axis).to_numpy().astype(float)
            if np.isnan(v).all():
                continue
            r = K.residuals_by_cutoff(v, rate, cutoffs)
            rows.append({"trial_id": table.column("trial_id")[0].as_py(), "name": table.column("name")[0].as_py(), "axis": axis, "cutoffs": cutoffs.tolist(), "residuals": r.tolist(), "knee": K.knee_frequency(cutoffs, r)})
        return pa.Table.from_pylist(rows, schema=pa.schema([("trial_id", pa.string()), ("name", pa.string()), ("axis", pa.string()), ("cutoffs", pa.list_(pa.float64())), ("residuals", pa.list_(pa.float64())), ("knee", pa.float64())]))

    return tracks.groupBy(*KEYS).applyInArrow(run, "trial_id string, name string, axis string, cutoffs array<double>, residuals array<double>, knee double")


def auto_cutoff(tracks: DataFrame, rate: float = 30.0) -> DataFrame:
    """trial_id, cutoff: the median of its landmarks' knee frequencies."""
    return residual_analysis(tracks, rate).groupBy("trial_id").agg(F.median("knee").alias("cutoff"))


def procrustes_align(tracks: DataFrame, rounds: int = 10) -> DataFrame:
    """Each frame's landmarks moved, turned and scaled onto the trial's mean shape, which follows them for some rounds."""
    names = tracks.columns

    def run(table: pa.Table) -> pa.Table:
        frame = table.to_pandas()
        wide = {c: frame.pivot(index="pos", columns="name", values=c) for c in ("x", "y")}
        shapes = np.stack([wide["x"].to_numpy(float), wide["y"].to_numpy(float)], axis=2)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            mean = shapes[0]
            for _ in range(rounds):
                moved = np.stack([K.procrustes(s, mean)[0] for s in shapes])
                new = np.nanmean(moved, axis=0)
                done, mean = np.nanmax(np.abs(new - mean)) < 1e-9, new
                if done:
                    break
        spot = (wide["x"].index.get_indexer(frame["pos"]), wide["x"].columns.get_indexer(frame["name"]))
        frame["x"], frame["y"] = moved[(*spot, 0)], moved[(*spot, 1)]
        return pa.Table.from_pandas(frame[names], preserve_index=False).cast(table.select(names).schema)

    return tracks.groupBy("trial_id").applyInArrow(run, tracks.schema)


def cross_correlation_lag(pairs: DataFrame, keys: list[str], a: str, b: str, max_lag: int) -> DataFrame:
    """keys, lag, r: the lag of the greatest correlation, the smallest in size of equal ones."""
    r = series.cross_correlation(pairs, keys, a, b, max_lag)
    return r.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("r"), F.abs("lag"), "lag"))).filter("__k = 1").drop("__k")


def align_by_lag(a: DataFrame, b: DataFrame, lags: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a (keys, pos, value) beside those of b that come ``lag`` rows earlier."""
    left = a.join(lags, keys).withColumn("__pos", F.col("pos") - F.col("lag"))
    right = b.select(*keys, F.col("pos").alias("__pos"), F.col("value").alias("value_b"))
    return left.join(right, [*keys, "__pos"]).select(*keys, "pos", F.col("value").alias("value_a"), "value_b")
