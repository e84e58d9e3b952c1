"""Queries by whole-series kernels and grouped maps; SQL where a recurrence or a fixed window can say the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import kernels as K
from kinelake.functions import series
from kinelake.functions.columns import r6
from kinelake.operators import analysis, events, optical, pose, signals
from kinelake.plans.series_queries import _S, RATE
from kinelake.sources.driver_tables import event_series, vector_curves, vector_pose

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
T = ["trial_id"]


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    """Each user's values as one landmark's track."""
    rows = event_series(spark, d)
    return rows.select(F.col("trial_id").cast("string").alias("trial_id"), F.lit("P").alias("name"), "pos", F.col("value").alias("x"), (100.0 - F.col("value")).alias("y"), F.lit(1.0).alias("visibility"))


def _fir(weights: list[float]) -> str:
    half = len(weights) // 2
    return " + ".join(f"{w!r}::DOUBLE * {'lag' if k <= half else 'lead'}(value, {abs(k - half)}) OVER x" for k, w in enumerate(weights))


_B, _A = (v.tolist() for v in K.butterworth(2, 1.0, RATE))
_SG = np.linalg.pinv(np.vander(np.arange(-3, 4), 3, increasing=True))[0].tolist()


@_query(f"""WITH RECURSIVE {_S}, r(trial_id, pos, y, z1, z2) AS (
    SELECT trial_id, pos, {_B[0]!r}::DOUBLE * value, {_B[1]!r}::DOUBLE * value - {_A[1]!r}::DOUBLE * ({_B[0]!r}::DOUBLE * value), {_B[2]!r}::DOUBLE * value - {_A[2]!r}::DOUBLE * ({_B[0]!r}::DOUBLE * value) FROM s WHERE pos = 0
    UNION ALL SELECT s.trial_id, s.pos, {_B[0]!r}::DOUBLE * value + z1, {_B[1]!r}::DOUBLE * value + z2 - {_A[1]!r}::DOUBLE * ({_B[0]!r}::DOUBLE * value + z1), {_B[2]!r}::DOUBLE * value - {_A[2]!r}::DOUBLE * ({_B[0]!r}::DOUBLE * value + z1) FROM r JOIN s ON s.trial_id = r.trial_id AND s.pos = r.pos + 1)
    SELECT trial_id::VARCHAR AS trial_id, pos, round(y, 6) + 0 AS x FROM r""")
def butterworth_forward(spark: SparkSession, d: str) -> DataFrame:
    """A recursive filter of second order, forward from rest."""
    b, a = K.butterworth(2, 1.0, RATE)
    out = signals.per_series(_tracks(spark, d), lambda v: K.iir(b, a, v, np.zeros(2)), ("x",))
    return out.select("trial_id", "pos", r6("x").alias("x"))


@_query(f"WITH {_S}, w AS (SELECT trial_id, pos, {_fir(_SG)} AS v FROM s WINDOW x AS (PARTITION BY trial_id ORDER BY pos)) SELECT trial_id::VARCHAR AS trial_id, pos, round(v, 6) + 0 AS x FROM w WHERE v IS NOT NULL")
def savgol_interior(spark: SparkSession, d: str) -> DataFrame:
    """Local parabolas over seven points, away from the ends."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("trial_id"))
    out = signals.savgol(_tracks(spark, d), 7, 2)
    return out.withColumn("n", n).filter((F.col("pos") >= 3) & (F.col("pos") < F.col("n") - 3)).select("trial_id", "pos", r6("x").alias("x"))


_Z2 = _B[2] - _A[2]
_Z1 = _B[1] - _A[1] + _Z2


def _pass(name: str, rows: str, order: str) -> str:
    """A recursive table of one direction of the filter, from rest at its first value."""
    b0, b1, b2, a1, a2 = (f"{c!r}::DOUBLE" for c in (*_B, *_A[1:]))
    y0, y = f"({b0} * v + {_Z1!r}::DOUBLE * v)", f"({b0} * v + z1)"
    return f"""{name}(trial_id, i, y, z1, z2) AS (SELECT trial_id, i, {y0}, {b1} * v + {_Z2!r}::DOUBLE * v - {a1} * {y0}, {b2} * v - {a2} * {y0} FROM {rows} WHERE i = {order}
        UNION ALL SELECT w.trial_id, w.i, {y}, {b1} * v + z2 - {a1} * {y}, {b2} * v - {a2} * {y} FROM {name} r JOIN {rows} w ON w.trial_id = r.trial_id AND w.i = r.i + 1)"""


@_query(f"""WITH RECURSIVE {_S}, n AS (SELECT trial_id, count(*) AS n, min_by(value, pos) AS first, max_by(value, pos) AS last FROM s GROUP BY trial_id),
    wide AS (SELECT s.trial_id, pos + 9 AS i, value AS v FROM s JOIN n USING (trial_id) WHERE n > 9
        UNION ALL SELECT s.trial_id, 9 - pos, 2 * first - value FROM s JOIN n USING (trial_id) WHERE n > 9 AND pos BETWEEN 1 AND 9
        UNION ALL SELECT s.trial_id, 2 * (n - 1) - pos + 9, 2 * last - value FROM s JOIN n USING (trial_id) WHERE n > 9 AND pos BETWEEN n - 10 AND n - 2),
    {_pass("ahead", "wide", "0")},
    turned AS (SELECT trial_id, n + 17 - i AS i, y AS v FROM ahead JOIN n USING (trial_id)),
    {_pass("back", "turned", "0")}
    SELECT trial_id::VARCHAR AS trial_id, n + 8 - i AS pos, round(y, 6) + 0 AS x FROM back JOIN n USING (trial_id) WHERE n + 8 - i BETWEEN 0 AND n - 1
    UNION ALL SELECT s.trial_id::VARCHAR, pos, round(value, 6) + 0 FROM s JOIN n USING (trial_id) WHERE n <= 9""")
def butterworth_zero_phase(spark: SparkSession, d: str) -> DataFrame:
    """The low-pass forward and backward."""
    return signals.butterworth(_tracks(spark, d), 1.0, 2, RATE).select("trial_id", "pos", r6("x").alias("x"))


@_query()
def lowess_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Locally weighted lines."""
    return signals.loess(_tracks(spark, d), 0.2).select("trial_id", "pos", r6("x").alias("x"))


@_query()
def wavelet_denoise(spark: SparkSession, d: str) -> DataFrame:
    """Wavelet details shrunk."""
    return signals.wavelet(_tracks(spark, d)).select("trial_id", "pos", r6("x").alias("x"))


@_query(f"""WITH RECURSIVE {_S}, n AS (SELECT trial_id, max(pos) AS last FROM s GROUP BY trial_id),
    f(trial_id, pos, m, p) AS (SELECT trial_id, pos, value, 0.5::DOUBLE FROM s WHERE pos = 0
        UNION ALL SELECT s.trial_id, s.pos, m + (p + 1) / (p + 2) * (value - m), (p + 1) / (p + 2) FROM f JOIN s ON s.trial_id = f.trial_id AND s.pos = f.pos + 1),
    b(trial_id, pos, x) AS (SELECT f.trial_id, f.pos, f.m FROM f JOIN n ON n.trial_id = f.trial_id AND n.last = f.pos
        UNION ALL SELECT f.trial_id, f.pos, f.m + f.p / (f.p + 1) * (b.x - f.m) FROM b JOIN f ON f.trial_id = b.trial_id AND f.pos = b.pos - 1)
    SELECT trial_id::VARCHAR AS trial_id, pos, round(x, 6) + 0 AS x FROM b""")
def kalman_smooth(spark: SparkSession, d: str) -> DataFrame:
    """A random walk's filter and its backward pass."""
    return signals.kalman(_tracks(spark, d)).select("trial_id", "pos", r6("x").alias("x"))


@_query()
def spline_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Smoothing spline."""
    return signals.spline(_tracks(spark, d), 500.0).select("trial_id", "pos", r6("x").alias("x"))


@_query()
def spline_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """Short gaps filled by a cubic spline."""
    rows = _tracks(spark, d).withColumn("x", F.when(F.col("pos") % 7 != 3, F.col("x")))
    return signals.fill_gaps(rows, "spline", 3).select("trial_id", "pos", r6("x").alias("x"))


@_query()
def normalize_chain(spark: SparkSession, d: str) -> DataFrame:
    """Outliers, gaps and a low-pass, one after the other."""
    return signals.normalize(_tracks(spark, d), [{"type": "outliers", "limit": 2.0}, {"type": "butterworth", "cutoff": 1.0, "rate": RATE}]).select("trial_id", "pos", r6("x").alias("x"))


@_query()
def residual_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """The cutoff at which residuals bend."""
    return signals.residual_analysis(_tracks(spark, d), RATE, 0.25, 1.75, 0.25).select("trial_id", "axis", r6("knee").alias("knee"))


@_query()
def find_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks by distance and prominence."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        at, height = K.find_peaks(table.column("value").to_numpy(), 3, 20.0)
        return pa.table({"trial_id": pa.array([table.column("trial_id")[0].as_py()] * len(at), pa.int64()), "pos": pa.array(at, pa.int64()), "prominence": pa.array(np.round(height, 6), pa.float64())})

    return event_series(spark, d).select("trial_id", "pos", "value").groupBy("trial_id").applyInArrow(run, "trial_id long, pos long, prominence double")


def _long(spark: SparkSession, d: str) -> DataFrame:
    return event_series(spark, d).select("trial_id", "pos", F.lit("left").alias("side"), F.lit("hip").alias("joint"), "value")


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("trial_id", F.col("trial_id").cast("string"))


@_query()
def morlet_dominant(spark: SparkSession, d: str) -> DataFrame:
    """Dominant frequency of the wavelet transform."""
    return analysis.time_frequency(_as_text(_long(spark, d)), RATE, "cwt", 0.1, 2.0, 20).select("trial_id", r6("dominant").alias("dominant"))


@_query(f"""WITH {_S}, n AS (SELECT trial_id, count(*) AS n, avg(value) AS m, (2 ** greatest(3, least(8, floor(log2(count(*) // 4)))))::INT AS g FROM s GROUP BY trial_id HAVING count(*) >= 8),
    u AS (SELECT s.trial_id, pos, value - m AS v, g FROM s JOIN n USING (trial_id)),
    fr AS (SELECT trial_id, g, t, k FROM (SELECT *, unnest(range(0, ceil(n / (g / 2))::INT + 1)) AS t FROM n), range(0, 129) q(k) WHERE k <= g / 2 AND k * {RATE}::DOUBLE / g BETWEEN 0.1 AND 2.0),
    c AS (SELECT fr.trial_id, fr.g, t, k, sum(v * w * cos(2 * pi() * k * j / fr.g)) AS re, sum(v * w * sin(2 * pi() * k * j / fr.g)) AS im
        FROM (SELECT fr.*, j, 0.5 - 0.5 * cos(2 * pi() * j / g) AS w FROM fr, range(0, 256) z(j) WHERE j < g) fr JOIN u ON u.trial_id = fr.trial_id AND u.pos = t * (fr.g // 2) + j - fr.g // 2 GROUP BY ALL),
    pw AS (SELECT trial_id, g, k, sum(re * re + im * im) AS power FROM c GROUP BY ALL)
    SELECT trial_id::VARCHAR AS trial_id, round(max_by(k * {RATE}::DOUBLE / g, power), 6) AS dominant FROM pw GROUP BY trial_id""")
def stft_dominant(spark: SparkSession, d: str) -> DataFrame:
    """Dominant frequency of short windows."""
    return analysis.time_frequency(_as_text(_long(spark, d)), RATE, "stft", 0.1, 2.0).select("trial_id", r6("dominant").alias("dominant"))


@_query()
def waveform_pca(spark: SparkSession, d: str) -> DataFrame:
    """Principal components of the curves of all trials, by joint and side."""
    return analysis.waveform_components(vector_curves(spark, d)).select("joint", "side", "component", r6("explained").alias("explained"))


@_query()
def procrustes(spark: SparkSession, d: str) -> DataFrame:
    """Frames brought onto the trial's mean shape."""
    tracks = _as_text(pose.to_long(vector_pose(spark, d)).select("trial_id", "name", "pos", "x", "y"))
    return signals.procrustes_align(tracks).select("trial_id", "name", "pos", r6("x").alias("x"), r6("y").alias("y"))


@_query()
def detect_events(spark: SparkSession, d: str) -> DataFrame:
    """Contacts and lift-offs of poses by ankle extremes."""
    p = _as_text(vector_pose(spark, d))
    trials = p.select("trial_id").distinct().select("trial_id", F.struct(F.lit(RATE).alias("fps")).alias("meta"))
    return events.detect_events(p, trials, "zeni", least=0.5, cutoff=1.5)


@_query(f"""WITH {_S}, a0 AS (SELECT trial_id, pos, value FROM s), b0 AS (SELECT trial_id, pos - trial_id % 4 AS pos, value + 5 * sin(pos * 12.9898) AS value FROM s WHERE pos >= trial_id % 4),
    na AS (SELECT trial_id, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM a0 GROUP BY trial_id), nb AS (SELECT trial_id, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM b0 GROUP BY trial_id),
    a AS (SELECT trial_id, pos, (value - m) / sd AS v, n FROM a0 JOIN na USING (trial_id)), b AS (SELECT trial_id, pos, (value - m) / sd AS v, n FROM b0 JOIN nb USING (trial_id)),
    c AS (SELECT a.trial_id, b.pos - a.pos AS k, sum(a.v * b.v) / any_value(least(a.n, b.n)) AS r FROM a JOIN b ON a.trial_id = b.trial_id AND b.pos - a.pos BETWEEN -20 AND 20 WHERE least(a.n, b.n) >= 10 GROUP BY ALL)
    SELECT trial_id, round(max_by(k / {RATE}::DOUBLE, r), 6) + 0 AS "offset", round(max(r), 6) + 0 AS r FROM c GROUP BY trial_id""")
def estimate_offset(spark: SparkSession, d: str) -> DataFrame:
    """The shift between two recordings of one signal, of which the second begins later by a trial's own number of rows and is noisy."""
    a = event_series(spark, d).select("trial_id", "pos", "value")
    shift = F.col("trial_id") % 4
    b = a.filter(F.col("pos") >= shift).select("trial_id", (F.col("pos") - shift).alias("pos"), (F.col("value") + 5.0 * F.sin(F.col("pos") * 12.9898)).alias("value"))
    return optical.estimate_offset(a, b, RATE, RATE, 5.0).select("trial_id", r6("offset").alias("offset"), r6("r").alias("r"))


@_query(f"""WITH RECURSIVE {_S}, r(trial_id, pos, ema) AS (SELECT trial_id, pos, value FROM s WHERE pos = 0 UNION ALL SELECT s.trial_id, s.pos, 0.3::DOUBLE * value + 0.7::DOUBLE * ema FROM r JOIN s ON s.trial_id = r.trial_id AND s.pos = r.pos + 1) SELECT trial_id, pos, round(ema, 6) AS ema FROM r""")
def exponential_mean(spark: SparkSession, d: str) -> DataFrame:
    """Exponential moving average."""
    return series.exponential_mean(event_series(spark, d), T, "value", 0.3).select("trial_id", "pos", r6("ema").alias("ema"))


@_query(f"WITH {_S}, c AS (SELECT trial_id, pos, value, lead(value) OVER x AS nx, count(*) OVER (PARTITION BY trial_id) AS n FROM s WINDOW x AS (PARTITION BY trial_id ORDER BY pos)), p AS (SELECT trial_id, any_value(n) AS n, k, k * (any_value(n) - 1) / 100.0::DOUBLE AS q FROM c, range(101) t(k) GROUP BY trial_id, k), l AS (SELECT trial_id, k, CASE WHEN abs(q - round(q)) < 1e-9 THEN round(q) ELSE floor(q) END AS f, q FROM p) SELECT l.trial_id, k::INT AS p, round(value + CASE WHEN abs(q - f) < 1e-9 THEN 0 ELSE (nx - value) * (q - f) END, 6) + 0 AS value FROM l JOIN c ON c.trial_id = l.trial_id AND c.pos = l.f")
def resample_series(spark: SparkSession, d: str) -> DataFrame:
    """Series of any length at 101 points."""
    return series.resample_long(event_series(spark, d), T, "value").select("trial_id", "p", r6("value").alias("value"))
