"""Queries on ordered series: cleaning, derivatives, correlation, events, cycles and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import series
from kinelake.functions.columns import r6
from kinelake.operators import analysis, cycles, events, signals
from kinelake.sources.driver_tables import event_series, gait_events, vector_curves

T = ["trial_id"]
#: Frames a second of the series below.
RATE = 4.0

_S = """s AS (SELECT user_id AS trial_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type, value FROM events)"""
_GAPS = _S + """, g AS (SELECT trial_id, pos, event_type, CASE WHEN event_type <> 'error' THEN value END AS v FROM s)"""
_EV = _S + """, ev AS (SELECT trial_id, CASE WHEN event_type IN ('click', 'view') THEN 'left' ELSE 'right' END AS side,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'hs' ELSE 'to' END AS kind, pos AS frame FROM s WHERE event_type IN ('click', 'view', 'purchase', 'signup'))"""
_CY = _EV + """, h AS (SELECT *, lead(frame) OVER (PARTITION BY trial_id, side ORDER BY frame) AS end_frame FROM ev WHERE kind = 'hs'),
    c0 AS (SELECT h.trial_id, h.side, h.frame AS start_frame, h.end_frame,
        (SELECT min(t.frame) FROM ev t WHERE t.trial_id = h.trial_id AND t.side = h.side AND t.kind = 'to' AND t.frame > h.frame AND t.frame < h.end_frame) AS toe_off_frame,
        (h.end_frame - h.frame) / 4.0::DOUBLE AS duration FROM h WHERE h.end_frame IS NOT NULL),
    cy AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY start_frame, side) - 1 AS cycle_id,
        (toe_off_frame - start_frame)::DOUBLE / (end_frame - start_frame) * 100 AS stance_pct FROM c0 WHERE duration BETWEEN 0.4 AND 2.5)"""
_VC = """vc AS (SELECT vec_id // 10 AS trial_id, vec_id AS cycle_id, CASE WHEN vec_id % 2 = 0 THEN 'left' ELSE 'right' END AS side,
    ['hip', 'knee', 'ankle'][label % 3 + 1] AS joint, list_transform(embedding, lambda v: v::DOUBLE * 60) AS curve FROM embeddings)"""
_R101 = _VC + """, pts AS (SELECT vc.*, p, p * (len(curve) - 1) / 100.0::DOUBLE AS q_at FROM vc, range(101) r(p)),
    rs AS (SELECT trial_id, cycle_id, side, joint, p::INT AS p, curve[floor(q_at)::INT + 1] + (curve[least(floor(q_at)::INT + 2, len(curve))] - curve[floor(q_at)::INT + 1]) * (q_at - floor(q_at)) AS value FROM pts),
    sm AS (SELECT trial_id, side, joint, p, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n FROM rs GROUP BY ALL)"""
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _gapped(spark: SparkSession, d: str) -> DataFrame:
    return event_series(spark, d).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))


@_query(f"WITH {_S}, w AS (SELECT *, lag(value) OVER x AS a, lead(value) OVER x AS b FROM s WINDOW x AS (PARTITION BY trial_id ORDER BY pos)) SELECT trial_id, pos, round(CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NULL THEN (b - value) / 0.25 WHEN b IS NULL THEN (value - a) / 0.25 ELSE (b - a) / 0.5 END, 6) + 0 AS velocity FROM w")
def gradient(spark: SparkSession, d: str) -> DataFrame:
    """First derivative of every series."""
    out = series.gradient(event_series(spark, d), T, "value", "velocity", 1 / RATE)
    return out.select("trial_id", "pos", r6("velocity").alias("velocity"))


@_query(f"WITH {_S}, w AS (SELECT *, lag(value) OVER x AS a, lead(value) OVER x AS b FROM s WINDOW x AS (PARTITION BY trial_id ORDER BY pos)), g AS (SELECT trial_id, pos, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN a IS NULL THEN (b - value) / 0.25 WHEN b IS NULL THEN (value - a) / 0.25 ELSE (b - a) / 0.5 END AS v FROM w), w2 AS (SELECT *, lag(v) OVER x AS a, lead(v) OVER x AS b, lag(pos) OVER x AS pa, lead(pos) OVER x AS pb FROM g WINDOW x AS (PARTITION BY trial_id ORDER BY pos)) SELECT trial_id, pos, round(CASE WHEN pa IS NULL AND pb IS NULL THEN NULL WHEN pa IS NULL THEN (b - v) / 0.25 WHEN pb IS NULL THEN (v - a) / 0.25 ELSE (b - a) / 0.5 END, 6) + 0 AS acceleration FROM w2")
def second_derivative(spark: SparkSession, d: str) -> DataFrame:
    """Second derivative, by differences of differences."""
    out = series.gradient(event_series(spark, d), T, "value", "velocity", 1 / RATE)
    out = series.gradient(out, T, "velocity", "acceleration", 1 / RATE)
    return out.select("trial_id", "pos", r6("acceleration").alias("acceleration"))


@_query(f"WITH {_S}, f AS (SELECT trial_id, regr_slope(value, pos) AS b, avg(pos) AS m, count(*) AS n FROM s GROUP BY trial_id) SELECT trial_id, pos, round(CASE WHEN n >= 20 THEN value - b * (pos - m) ELSE value END, 6) + 0 AS value FROM s JOIN f USING (trial_id)")
def linear_detrend(spark: SparkSession, d: str) -> DataFrame:
    """Straight drift taken out, the mean kept."""
    return series.detrend(event_series(spark, d), T, "value", "out").select("trial_id", "pos", r6("out").alias("value"))


@_query(f"WITH {_GAPS} SELECT trial_id, pos, round(avg(v) OVER (PARTITION BY trial_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0 AS mean FROM g")
def moving_mean(spark: SparkSession, d: str) -> DataFrame:
    """Centred mean of five, of what is known."""
    return series.rolling_mean(_gapped(spark, d), T, "v", "mean", 5).select("trial_id", "pos", r6("mean").alias("mean"))


@_query(f"WITH {_GAPS} SELECT trial_id, pos, CASE WHEN count(v) OVER x >= 3 THEN round(stddev_pop(v) OVER x, 6) + 0 END AS spread FROM g WINDOW x AS (PARTITION BY trial_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def rolling_std(spark: SparkSession, d: str) -> DataFrame:
    """Centred deviation over seven rows, where three are known."""
    return series.rolling_std(_gapped(spark, d), T, "v", "spread", 3).select("trial_id", "pos", r6("spread").alias("spread"))


@_query(f"WITH {_S}, w AS (SELECT *, coalesce(lag(value) OVER x, 0) AS a, coalesce(lead(value) OVER x, 0) AS b FROM s WINDOW x AS (PARTITION BY trial_id ORDER BY pos)) SELECT trial_id, pos, round(list_sort([a, value, b])[2], 6) + 0 AS median FROM w")
def median_filter(spark: SparkSession, d: str) -> DataFrame:
    """Running median of three, zero beyond the ends."""
    return series.rolling_median(event_series(spark, d), T, "value", "median", 3).select("trial_id", "pos", r6("median").alias("median"))


@_query(f"""WITH {_S}, z AS (SELECT *, avg(value) OVER x AS m, stddev_samp(value) OVER x AS sd FROM s WINDOW x AS (PARTITION BY trial_id)),
    k AS (SELECT trial_id, pos, CASE WHEN sd > 0 AND abs((value - m) / sd) > 1.5 THEN NULL ELSE value END AS v FROM z),
    w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER f AS v1 FROM k
        WINDOW b AS (PARTITION BY trial_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY trial_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT trial_id, pos, round(coalesce(v, v0 + (v1 - v0) * (pos - p0) / (p1 - p0), v0, v1), 6) + 0 AS value FROM w""")
def outlier_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """Values beyond 1.5 deviations replaced by interpolation."""
    return series.drop_outliers(event_series(spark, d), T, "value", "out", 1.5).select("trial_id", "pos", r6("out").alias("value"))


@_query(f"WITH {_GAPS}, w AS (SELECT *, count(v) OVER (PARTITION BY trial_id ORDER BY pos) AS k FROM g) SELECT trial_id, min(pos) AS first, max(pos) AS last, count(*) AS length FROM w WHERE v IS NULL GROUP BY trial_id, k")
def gap_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of missing values."""
    return series.gap_runs(_gapped(spark, d), T, "v")


@_query(f"""WITH {_GAPS}, w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER f AS v1 FROM g
        WINDOW b AS (PARTITION BY trial_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY trial_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT trial_id, pos, round(CASE WHEN v IS NOT NULL THEN v WHEN p1 - p0 - 1 <= 1 THEN v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END, 6) + 0 AS value FROM w""")
def fill_short_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of one value filled by a line, longer ones and the ends left."""
    return series.interpolate(_gapped(spark, d), T, "v", "out", hold_ends=False, max_gap=1).select("trial_id", "pos", r6("out").alias("value"))


@_query(f"WITH {_GAPS} SELECT trial_id, pos, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0 AS value FROM g")
def fill_held(spark: SparkSession, d: str) -> DataFrame:
    """The last known value, at the beginning the first."""
    return series.fill_both(_gapped(spark, d), T, "v", "out").select("trial_id", "pos", r6("out").alias("value"))


@_query(f"""WITH {_S}, a AS (SELECT trial_id, pos, value * 37.0 - floor(value * 37.0 / 360) * 360 AS v FROM s), w AS (SELECT *, v - lag(v) OVER (PARTITION BY trial_id ORDER BY pos) AS d FROM a),
    c AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < 180 THEN 0 ELSE (CASE WHEN (d + 180) - 360 * floor((d + 180) / 360) - 180 = -180 AND d > 0 THEN 180 ELSE (d + 180) - 360 * floor((d + 180) / 360) - 180 END) - d END AS j FROM w)
    SELECT trial_id, pos, round(v + sum(j) OVER (PARTITION BY trial_id ORDER BY pos), 6) + 0 AS angle FROM c""")
def unwrap_angles(spark: SparkSession, d: str) -> DataFrame:
    """Whole turns taken out of a series of angles."""
    a = F.col("value") * 37.0
    df = event_series(spark, d).withColumn("v", a - F.floor(a / 360.0) * 360.0)
    return series.unwrap(df, T, "v", "out").select("trial_id", "pos", r6("out").alias("angle"))


@_query(f"""WITH {_S}, c AS (SELECT trial_id, pos, value - avg(value) OVER (PARTITION BY trial_id) AS v, count(*) OVER (PARTITION BY trial_id) AS n FROM s),
    z AS (SELECT trial_id, sum(v * v) AS zero FROM c GROUP BY trial_id)
    SELECT a.trial_id, l::INT AS lag, round(coalesce(sum(a.v * b.v), 0) / any_value(zero), 6) + 0 AS r FROM c a JOIN z USING (trial_id), range(11) t(l) JOIN c b ON b.trial_id = a.trial_id AND b.pos = a.pos + l WHERE zero > 0 GROUP BY a.trial_id, l""")
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    """Normalised autocorrelation, lags 0 to 10."""
    return series.autocorrelation(event_series(spark, d), T, "value", 10).select("trial_id", "lag", r6("r").alias("r"))


@_query(f"""WITH {_S}, c AS (SELECT trial_id, pos, value - avg(value) OVER x AS a, (event_type = 'click')::INT - avg((event_type = 'click')::INT) OVER x AS b FROM s WINDOW x AS (PARTITION BY trial_id)),
    z AS (SELECT trial_id, sqrt(sum(a * a) * sum(b * b)) AS sc FROM c GROUP BY trial_id),
    r AS (SELECT x.trial_id, l::INT AS lag, sum(x.a * y.b) / any_value(sc) AS r FROM c x JOIN z USING (trial_id), range(-5, 6) t(l) JOIN c y ON y.trial_id = x.trial_id AND y.pos = x.pos - l WHERE sc > 0 GROUP BY x.trial_id, l)
    SELECT trial_id, lag, round(r, 6) + 0 AS r FROM r QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY round(r, 9) DESC, abs(lag), lag) = 1""")
def cross_correlation_lag(spark: SparkSession, d: str) -> DataFrame:
    """The lag at which a series follows another best."""
    df = event_series(spark, d).withColumn("b", (F.col("event_type") == "click").cast("int").cast("double"))
    return signals.cross_correlation_lag(df, T, "value", "b", 5).select("trial_id", "lag", r6("r").alias("r"))


@_query(f"""WITH {_S}, e AS (SELECT trial_id, pos AS frame, event_type AS method FROM s WHERE event_type IN ('click', 'view', 'purchase')), w AS (SELECT *, frame - lag(frame) OVER (PARTITION BY trial_id ORDER BY frame, method) AS gap FROM e),
    r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY trial_id ORDER BY frame, method) AS run FROM w)
    SELECT trial_id, 'left' AS side, 'hs' AS kind, floor(median(frame))::INT AS frame, count(DISTINCT method) AS n_methods FROM r GROUP BY trial_id, run HAVING count(DISTINCT method) >= 2""")
def event_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events that two of three methods share."""
    e = event_series(spark, d).filter(F.col("event_type").isin("click", "view", "purchase")).select("trial_id", F.lit("left").alias("side"), F.lit("hs").alias("kind"), F.col("pos").alias("frame"), F.col("event_type").alias("method"))
    return events.consensus(e, tolerance=1, n_methods=3)


@_query(f"""WITH {_EV}, l AS (SELECT trial_id, side, kind, list_sort(list(frame)) AS f FROM ev GROUP BY ALL),
    k AS (SELECT trial_id, side, kind, list_reduce(list_transform(f, lambda x: [x]), lambda kept, x: CASE WHEN x[1] - kept[len(kept)] >= 4 THEN list_concat(kept, x) ELSE kept END) AS kept FROM l) SELECT trial_id, side, kind, unnest(kept) AS frame FROM k""")
def thin_events(spark: SparkSession, d: str) -> DataFrame:
    """Events at least four frames after the last one kept."""
    return events.thinned(gait_events(spark, d), 4)


@_query(f"WITH {_CY} SELECT trial_id, cycle_id, side, start_frame, end_frame, toe_off_frame, round(duration, 6) AS duration, round(stance_pct, 6) AS stance_pct, round(100 - stance_pct, 6) AS swing_pct FROM cy")
def segment_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles with their lift-off and stance."""
    out = cycles.segment(gait_events(spark, d), RATE)
    return out.select("trial_id", "cycle_id", "side", "start_frame", "end_frame", "toe_off_frame", r6("duration").alias("duration"), r6("stance_pct").alias("stance_pct"), r6("swing_pct").alias("swing_pct"))


@_query(f"""WITH {_CY}, j AS (SELECT cy.trial_id, cy.cycle_id, cy.side, s.pos, s.value, cy.start_frame AS a, cy.end_frame - cy.start_frame AS n FROM cy JOIN s ON s.trial_id = cy.trial_id AND s.pos BETWEEN cy.start_frame AND cy.end_frame WHERE cy.end_frame - cy.start_frame >= 4),
    q AS (SELECT DISTINCT trial_id, cycle_id, side, a, n, p, p * n / 20.0::DOUBLE AS q_at FROM j, range(21) r(p)),
    v AS (SELECT q.trial_id, q.side, p::INT AS p, x.value + (coalesce(y.value, x.value) - x.value) * (q_at - floor(q_at)) AS value FROM q JOIN s x ON x.trial_id = q.trial_id AND x.pos = q.a + floor(q_at)::INT LEFT JOIN s y ON y.trial_id = q.trial_id AND y.pos = q.a + least(floor(q_at)::INT + 1, q.n))
    SELECT trial_id, side, 'hip' AS joint, p, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, count(*) AS n_cycles FROM v GROUP BY trial_id, side, p""")
def cycle_curve_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of curves over cycles: from events and series to summaries."""
    rows = event_series(spark, d)
    cut = cycles.segment(gait_events(spark, d), RATE)
    values = rows.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right")))).select("trial_id", F.col("pos").alias("frame_idx"), "side", F.lit("hip").alias("joint"), "value")
    out = cycles.summary(cycles.long_curves(cycles.curves(cut, values, points=21, least=5)))
    return out.select("trial_id", "side", "joint", F.col("p").cast("int").alias("p"), F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "n_cycles")


@_query(f"WITH {_CY}, f AS (SELECT trial_id, side, cycle_id, unnest(range(start_frame, end_frame + 1)) AS frame_idx, start_frame, end_frame FROM cy) SELECT trial_id, side, frame_idx, round(arg_max((frame_idx - start_frame)::DOUBLE / (end_frame - start_frame), cycle_id), 6) + 0 AS phase FROM f GROUP BY trial_id, side, frame_idx")
def phase_by_frame(spark: SparkSession, d: str) -> DataFrame:
    """The phase of each frame in its cycle; shared frames go to the later cycle."""
    return cycles.phase_by_frame(cycles.segment(gait_events(spark, d), RATE)).select("trial_id", "side", "frame_idx", r6("phase").alias("phase"))


@_query(f"WITH {_R101} SELECT cycle_id, p, round(value, 6) + 0 AS value FROM rs")
def resample_101(spark: SparkSession, d: str) -> DataFrame:
    """Curves of 64 points at 101."""
    from kinelake.functions.columns import resample

    return vector_curves(spark, d).select("cycle_id", F.posexplode_outer(resample("curve", 101)).alias("p", "v")).filter("p IS NOT NULL").select("cycle_id", "p", r6("v").alias("value"))


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    from kinelake.functions.columns import resample

    return cycles.summary(cycles.long_curves(vector_curves(spark, d).withColumn("curve", resample("curve", 101))))


@_query(f"WITH {_R101} SELECT side, joint, p, round(avg(mean), 6) + 0 AS mean, round(stddev_pop(mean), 6) + 0 AS std_between, round(avg(std), 6) + 0 AS std_within, count(*) AS n_trials, sum(n)::BIGINT AS n_cycles FROM sm GROUP BY side, joint, p")
def ensemble_average(spark: SparkSession, d: str) -> DataFrame:
    """Mean over trials of mean curves, with deviations between and within."""
    out = cycles.ensemble(_summaries(spark, d))
    return out.select("side", "joint", "p", *[r6(c).alias(c) for c in ("mean", "std_between", "std_within")], "n_trials", "n_cycles")


@_query(f"WITH {_EV}, h AS (SELECT *, lead(frame) OVER x AS nf, lead(side) OVER x AS ns FROM ev WHERE kind = 'hs' WINDOW x AS (PARTITION BY trial_id ORDER BY frame, side)), q AS (SELECT trial_id, 240.0 / (nf - frame) AS c, (nf + frame) / 8.0 AS t FROM h WHERE nf > frame) SELECT trial_id, count(*) AS n, round(avg(c), 6) + 0 AS mean, round(stddev_pop(c), 6) + 0 AS std, round(stddev_pop(c) * 100 / avg(c), 6) + 0 AS cv, round(regr_slope(c, t), 6) + 0 AS slope FROM q GROUP BY trial_id")
def instantaneous_cadence(spark: SparkSession, d: str) -> DataFrame:
    """Cadence between contacts, and how it drifts."""
    out = analysis.instantaneous_cadence(gait_events(spark, d), RATE)
    return out.select("trial_id", "n", *[r6(c).alias(c) for c in ("mean", "std", "cv", "slope")])


@_query(f"WITH {_EV}, h AS (SELECT *, lag(side) OVER (PARTITION BY trial_id ORDER BY frame, side) AS ls FROM ev WHERE kind = 'hs') SELECT trial_id, count(*) AS n, round(avg((side <> ls)::INT), 6) + 0 AS share FROM h WHERE ls IS NOT NULL GROUP BY trial_id")
def step_alternation(spark: SparkSession, d: str) -> DataFrame:
    """How often successive contacts change side."""
    return events.alternation(gait_events(spark, d)).select("trial_id", "n", r6("share").alias("share"))


@_query(f"""WITH {_S}, c AS (SELECT trial_id, pos, value - avg(value) OVER (PARTITION BY trial_id) AS v FROM s), z AS (SELECT trial_id, sum(v * v) AS zero, count(*) AS n FROM c GROUP BY trial_id),
    r AS (SELECT a.trial_id, l AS lag, sum(a.v * b.v) / any_value(zero) AS r FROM c a JOIN z USING (trial_id), range(14) t(l) JOIN c b ON b.trial_id = a.trial_id AND b.pos = a.pos + l WHERE zero > 0 AND l < n GROUP BY a.trial_id, l),
    p AS (SELECT *, lag(r) OVER x AS a, lead(r) OVER x AS b FROM r WINDOW x AS (PARTITION BY trial_id ORDER BY lag)), k AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY lag) AS i FROM p WHERE r > a AND r > b AND lag >= 1)
    SELECT trial_id, max(CASE WHEN i = 1 THEN lag END)::INT AS step_lag, round(max(CASE WHEN i = 1 THEN r END), 6) + 0 AS step, max(CASE WHEN i = 2 THEN lag END)::INT AS stride_lag, round(max(CASE WHEN i = 2 THEN r END), 6) + 0 AS stride FROM k WHERE i <= 2 GROUP BY trial_id""")
def regularity_index(spark: SparkSession, d: str) -> DataFrame:
    """First two peaks of the autocorrelation."""
    out = analysis.regularity(event_series(spark, d), T, "value", RATE)
    return out.select("trial_id", "step_lag", r6("step").alias("step"), "stride_lag", r6("stride").alias("stride"))


@_query(f"""WITH {_S}, g AS (SELECT trial_id, pos, CASE WHEN pos % 9 <> 4 THEN value END AS v FROM s),
    i AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN pos END) OVER x AS p0, min(CASE WHEN v IS NOT NULL THEN pos END) OVER y AS p1 FROM g
          WINDOW x AS (PARTITION BY trial_id ORDER BY pos ROWS UNBOUNDED PRECEDING), y AS (PARTITION BY trial_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT i.trial_id, i.pos, CASE WHEN i.v IS NOT NULL THEN i.v WHEN p0 IS NULL THEN b.v WHEN p1 IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (i.pos - p0) / (p1 - p0) END AS v, i.v IS NOT NULL AS known
          FROM i LEFT JOIN g a ON a.trial_id = i.trial_id AND a.pos = p0 LEFT JOIN g b ON b.trial_id = i.trial_id AND b.pos = p1),
    c AS (SELECT trial_id, v - avg(v) OVER x AS v, 2 * pi() * pos / count(*) OVER x AS a, count(*) OVER x AS n, sum(known::INT) OVER x AS m FROM f WINDOW x AS (PARTITION BY trial_id)),
    k AS (SELECT trial_id, k, any_value(n) AS n, any_value(m) AS m, sqrt(power(sum(v * cos(k * a)), 2) + power(sum(v * sin(k * a)), 2)) AS size FROM c, range(1, 11) t(k) GROUP BY trial_id, k),
    r AS (SELECT trial_id, any_value(n) >= 30 AND any_value(m) >= 20 AS ok, sum(CASE WHEN k % 2 = 0 THEN size END) AS even, sum(CASE WHEN k % 2 = 1 THEN size END) AS odd FROM k GROUP BY trial_id)
    SELECT trial_id, CASE WHEN ok THEN round(even / odd, 6) + 0 END AS vertical, CASE WHEN ok THEN round(odd / even, 6) + 0 END AS forward FROM r""")
def harmonic_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Even over odd harmonics, and for the way forward odd over even, of series with gaps."""
    rows = event_series(spark, d).select("trial_id", "pos", F.when(F.col("pos") % 9 != 4, F.col("value")).alias("value"))
    ratio = lambda forward: analysis.harmonic_ratio(rows, T, "value", forward, 10, 20, 30).select("trial_id", r6("ratio").alias("forward" if forward else "vertical"))
    return ratio(False).join(ratio(True), "trial_id")


@_query(f"""WITH {_S}, e AS (SELECT trial_id, avg(value) OVER x AS m, CASE WHEN count(value) OVER y >= 3 THEN stddev_pop(value) OVER y END AS sd, max(value) OVER x - min(value) OVER x AS reach, pos FROM s WINDOW x AS (PARTITION BY trial_id), y AS (PARTITION BY trial_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT trial_id, pos, coalesce(sd > 0.2 * reach, false) AS moving FROM e""")
def motion_mask(spark: SparkSession, d: str) -> DataFrame:
    """Rows around which a series varies by a fifth of its range."""
    from pyspark.sql import Window

    w = Window.partitionBy("trial_id")
    out = series.rolling_std(event_series(spark, d), T, "value", "sd", 2)
    return out.select("trial_id", "pos", F.coalesce(F.col("sd") > 0.2 * (F.max("value").over(w) - F.min("value").over(w)), F.lit(False)).alias("moving"))


@_query(f"""WITH {_S}, f AS (SELECT *, lag(value) OVER x AS a FROM s WINDOW x AS (PARTITION BY trial_id ORDER BY pos)), g AS (SELECT *, CASE WHEN (value - 50) * (a - 50) < 0 THEN 1 ELSE 0 END AS flip FROM f), o AS (SELECT *, sum(flip) OVER (PARTITION BY trial_id ORDER BY pos) % 2 AS odd FROM g)
    SELECT trial_id, pos, (odd = 1) <> (avg(odd) OVER (PARTITION BY trial_id) > 0.5) AS swapped FROM o""")
def toggle_parity(spark: SparkSession, d: str) -> DataFrame:
    """Rows after an odd number of flips, unless most are."""
    from pyspark.sql import Window

    w, every = Window.partitionBy("trial_id").orderBy("pos"), Window.partitionBy("trial_id")
    df = event_series(spark, d).withColumn("flip", F.when((F.col("value") - 50) * (F.lag("value").over(w) - 50) < 0, 1).otherwise(0))
    df = df.withColumn("odd", F.sum("flip").over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2)
    return df.select("trial_id", "pos", ((F.col("odd") == 1) != (F.avg("odd").over(every) > 0.5)).alias("swapped"))


@_query(f"""WITH {_S}, c AS (SELECT trial_id, pos FROM s WHERE event_type = 'click'), v AS (SELECT trial_id, pos FROM s WHERE event_type = 'view') SELECT c.trial_id, c.pos, min(abs(v.pos - c.pos)) AS nearest FROM c JOIN v USING (trial_id) GROUP BY c.trial_id, c.pos""")
def nearest_event(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each event to the nearest of another kind."""
    from kinelake.operators.optical import nearest

    rows = event_series(spark, d)
    of = lambda t: rows.filter(F.col("event_type") == t).select("trial_id", F.col("pos").alias("at"))
    return nearest(of("click"), of("view"), T).select("trial_id", F.col("at").alias("pos"), F.col("distance").cast("bigint").alias("nearest"))


@_query(f"""WITH {_S}, b AS (SELECT trial_id, pos, value AS other FROM s) SELECT s.trial_id, s.pos, round(value, 6) + 0 AS value, round(other, 6) + 0 AS other FROM s JOIN b ON b.trial_id = s.trial_id AND b.pos = round_even((s.pos / 4.0 + 0.3) * 3.0, 0)::BIGINT""")
def align_by_rate(spark: SparkSession, d: str) -> DataFrame:
    """Rows beside those of another rate at the nearest time."""
    from kinelake.operators.optical import align_nearest

    rows = event_series(spark, d).select("trial_id", "pos", "value")
    out = align_nearest(rows, rows.withColumnRenamed("value", "other"), T, RATE, 3.0, 0.3)
    return out.select("trial_id", "pos", r6("value").alias("value"), r6("other").alias("other"))
