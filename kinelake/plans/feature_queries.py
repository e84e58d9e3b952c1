"""Queries on labels by pairs, pooled components, optical runs, failures and exports, over poses and series from generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import tables
from kinelake.functions.columns import r6
from kinelake.operators import analysis, cycles, events, optical, pose
from kinelake.plans.series_queries import _S, RATE
from kinelake.plans.walk_queries import _PO, _v, _xy
from kinelake.sources import pivot
from kinelake.sources.driver_tables import event_series, vector_curves, vector_pose

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _pairs() -> str:
    return " UNION ALL ".join(f"SELECT trial_id, pos, '{n}' AS pair, " + ", ".join(f"{_xy(f'{s}_{n}')[k]} AS {s[0].lower()}{a}" for s in ("LEFT", "RIGHT") for k, a in enumerate("xy")) + f", {_v(f'LEFT_{n}')} AS lv, {_v(f'RIGHT_{n}')} AS rv FROM po" for n in pose.SIDE_PAIRS)


def _chain() -> str:
    """The exchanges of each pair, from the hips outwards, as nested SELECTs."""
    far = lambda a, b: f"(power({a}x - {b}x, 2) + power({a}y - {b}y, 2))"
    out = "SELECT trial_id, pos, " + ", ".join(f"any_value(odd) FILTER (pair = '{n}') AS e_{n}" + "".join(f", any_value({c}) FILTER (pair = '{n}') AS {n}_{c}" for c in ("lx", "ly", "rx", "ry")) for n in pose.SIDE_PAIRS) + " FROM o GROUP BY ALL"
    for n, inner in pose.INNER_PAIR.items():
        lead = f"{far(f'{n}_l', f'{inner}_r')} + {far(f'{n}_r', f'{inner}_l')} - {far(f'{n}_l', f'{inner}_l')} - {far(f'{n}_r', f'{inner}_r')}"
        out = f"SELECT * REPLACE (CASE WHEN {lead} > 0 THEN e_{inner} WHEN {lead} < 0 THEN NOT e_{inner} ELSE e_{n} END AS e_{n}) FROM ({out})"
    return out


@_query(f"""WITH RECURSIVE {_PO}, r AS ({_pairs()}),
    m(trial_id, pair, pos, ml, mr) AS (SELECT trial_id, pair, pos, 0.1 * lv + 0.9, 0.1 * rv + 0.9 FROM r WHERE pos = 0
        UNION ALL SELECT r.trial_id, r.pair, r.pos, 0.1 * lv + 0.9 * ml, 0.1 * rv + 0.9 * mr FROM m JOIN r ON r.trial_id = m.trial_id AND r.pair = m.pair AND r.pos = m.pos + 1),
    u AS (SELECT r.*, ml, mr, lag(lx) OVER w AS plx, lag(ly) OVER w AS ply, lag(rx) OVER w AS prx, lag(ry) OVER w AS pry FROM r JOIN m USING (trial_id, pair, pos)
        WHERE power(lx - rx, 2) + power(ly - ry, 2) >= 0.15 * 0.15 WINDOW w AS (PARTITION BY trial_id, pair ORDER BY pos)),
    s AS (SELECT *, (power(plx - rx, 2) + power(ply - ry, 2) + power(prx - lx, 2) + power(pry - ly, 2)) / (power(plx - lx, 2) + power(ply - ly, 2) + power(prx - rx, 2) + power(pry - ry, 2)) AS share FROM u),
    t AS (SELECT trial_id, pair, pos, share, count(*) OVER w AS n, row_number() OVER (PARTITION BY trial_id, pair ORDER BY share DESC, pos) AS k FROM s
        WHERE share < CASE WHEN lv < ml - 0.05 AND rv < mr - 0.05 THEN 1.2 ELSE 0.6 END WINDOW w AS (PARTITION BY trial_id, pair)),
    c AS (SELECT r.trial_id, r.pair, r.pos, r.lx, r.ly, r.rx, r.ry, sum(CASE WHEN t.pos IS NOT NULL AND NOT (n % 2 = 1 AND k = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY r.trial_id, r.pair ORDER BY r.pos) % 2 AS a
        FROM r LEFT JOIN t ON t.trial_id = r.trial_id AND t.pair = r.pair AND t.pos = r.pos),
    o AS (SELECT *, (a = 1) <> (2 * sum(a) OVER (PARTITION BY trial_id, pair) > count(*) OVER (PARTITION BY trial_id, pair)) AS odd FROM c)
    SELECT trial_id, pos, concat_ws(',', {", ".join(f"CASE WHEN e_{n} THEN '{n}' END" for n in pose.SIDE_PAIRS)}) AS exchanged FROM ({_chain()})""")
def pair_labels(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of landmarks whose sides are exchanged, frame by frame."""
    found = pose.exchanged_pairs(pose.pair_turns(vector_pose(spark, d), ratio=0.6, apart=0.15, drop=0.05))
    return found.select("trial_id", "pos", F.array_join("exchanged", ",").alias("exchanged"))


_CURVES = """v AS (SELECT vec_id, vec_id // 10 AS trial_id, CASE WHEN vec_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, (['hip', 'knee', 'ankle'])[(label % 3 + 3) % 3 + 1] AS joint, list_transform(embedding, lambda x: x::DOUBLE * 60.0) AS curve FROM embeddings)"""


@_query(f"""WITH {_CURVES}, l AS (SELECT joint, side, unnest(curve) AS x, unnest(range(len(curve))) AS p FROM v)
    SELECT joint, side, any_value(n) AS n, round(sum(s), 3) + 0 AS variance, round(sum(m), 4) + 0 AS level FROM (SELECT joint, side, p, count(*) AS n, var_samp(x) AS s, avg(x) AS m FROM l GROUP BY ALL) GROUP BY joint, side""")
def waveform_variance(spark: SparkSession, d: str) -> DataFrame:
    """Number, total variance and summed mean of the curves of each joint and side, from sums that tasks merge."""
    m = analysis.waveform_moments(vector_curves(spark, d))
    diagonal = F.aggregate(F.sequence(F.lit(0), F.col("width") - 1), F.lit(0.0), lambda s, k: s + F.get("comoment", k * (F.col("width") + 1)))
    level = F.aggregate("mean", F.lit(0.0), lambda s, x: s + x)
    return m.select("joint", "side", "n", (F.round(diagonal / (F.col("n") - 1), 3) + 0.0).alias("variance"), (F.round(level, 4) + 0.0).alias("level"))


@_query(f"""WITH {_CURVES}, l AS (SELECT trial_id, trial_id % 4 AS cohort, side, joint, unnest(curve) AS x, unnest(range(len(curve))) AS p FROM v WHERE NOT (joint = 'ankle' AND trial_id % 8 = 5) AND NOT (joint = 'hip' AND trial_id % 8 = 2)),
    s AS (SELECT cohort, trial_id, side, joint, p, avg(x) AS m FROM l GROUP BY ALL),
    have AS (SELECT DISTINCT cohort, side, trial_id, joint FROM s), every AS (SELECT DISTINCT cohort, side, trial_id FROM s),
    lacks AS (SELECT cohort, side, joint FROM (SELECT cohort, side, trial_id, joint FROM every, (SELECT DISTINCT joint FROM s) EXCEPT SELECT cohort, side, trial_id, joint FROM have)),
    whole AS (SELECT cohort, side, joint FROM have EXCEPT SELECT cohort, side, joint FROM lacks)
    SELECT cohort, side, joint, p::INT AS p, round(avg(m), 5) + 0 AS mean, count(*) AS n_trials FROM s SEMI JOIN whole USING (cohort, side, joint) GROUP BY ALL""")
def common_joint_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Mean curves over the trials of a cohort, of the joints that each of its trials has."""
    curves = vector_curves(spark, d).filter(~((F.col("joint") == "ankle") & (F.col("trial_id") % 8 == 5)) & ~((F.col("joint") == "hip") & (F.col("trial_id") % 8 == 2)))
    summaries = cycles.summary(cycles.long_curves(curves)).withColumn("cohort", F.col("trial_id") % 4)
    return cycles.ensemble(summaries, "all", ("cohort",)).select("cohort", "side", "joint", "p", (F.round("mean", 5) + 0.0).alias("mean"), "n_trials")


_MID = f"(({_xy('LEFT_ANKLE')[1]} + {_xy('RIGHT_ANKLE')[1]}) / 2)"


@_query(f"""WITH {_PO}, q AS (SELECT trial_id, pos, abs({_MID} - {_xy("NOSE")[1]}) * (480 + 240 * (trial_id % 3)) AS px FROM po WHERE pos < 15 AND least(1.0, abs(e[64]) * 5) >= 0.4),
    f AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY pos) AS k FROM q WHERE px > 10),
    m AS (SELECT trial_id, median(px) AS px FROM f WHERE k <= 5 GROUP BY trial_id)
    SELECT t.trial_id, round(CASE WHEN t.trial_id % 5 <> 0 THEN (1.5 + 0.01 * (t.trial_id % 50)) / px END, 8) AS scale FROM (SELECT DISTINCT trial_id FROM po) t LEFT JOIN m USING (trial_id)""")
def height_scale(spark: SparkSession, d: str) -> DataFrame:
    """Metres per pixel by the first five frames that qualify of fifteen; every fifth subject's height is unknown."""
    p = vector_pose(spark, d)
    meta = F.struct((480 + 240 * (F.col("trial_id") % 3)).cast("int").alias("height"))
    subject = F.struct(F.when(F.col("trial_id") % 5 != 0, 1.5 + 0.01 * (F.col("trial_id") % 50)).alias("height_m"))
    trials = p.select("trial_id").distinct().select("trial_id", meta.alias("meta"), subject.alias("subject"))
    return analysis.height_scale(p, trials, 5, 15, 0.4).select("trial_id", F.round("scale", 8).alias("scale"))


def _vector_documents(spark: SparkSession, d: str) -> DataFrame:
    """name, content: a JSON document for each trial of poses; of five successive ones the second breaks off, the third has no frames, the fourth no meta, the fifth an empty list of frames."""
    p = vector_pose(spark, d)
    frame = F.struct("pos", F.struct("frame_idx", "time_s", "confidence", "landmarks").alias("f"))
    rows = p.groupBy("trial_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos"), F.to_json(F.struct(frame["f"].alias("f"))).alias("j")))), lambda x: F.substring(x["j"], 6, 1 << 30)).alias("frames"))
    listed = F.array_join(F.transform("frames", lambda j: F.substr(j, F.lit(1), F.length(j) - 1)), ",")
    meta, k = F.lit('"meta": {"fps": 4.0, "width": 640, "height": 480}'), F.col("trial_id") % 5
    body = F.concat(F.lit('"frames": ['), listed, F.lit("]"))
    whole = F.when(k == 2, F.concat(F.lit("{"), meta, F.lit("}"))).when(k == 3, F.concat(F.lit("{"), body, F.lit("}"))).when(k == 4, F.concat(F.lit("{"), meta, F.lit(', "frames": []}'))).otherwise(F.concat(F.lit("{"), meta, F.lit(", "), body, F.lit("}")))
    content = F.when(k == 1, F.substr(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int"))).otherwise(whole)
    return rows.select(F.concat(F.col("trial_id").cast("string"), F.lit(".json")).alias("name"), content.alias("content"))


@_query("""SELECT (vec_id // 20)::VARCHAR AS trial_id, CASE WHEN (vec_id // 20) % 5 IN (0, 3) THEN count(*) WHEN (vec_id // 20) % 5 = 4 THEN 0 END AS n_frames,
    CASE (vec_id // 20) % 5 WHEN 1 THEN 'malformed' WHEN 2 THEN 'no_frames' WHEN 3 THEN 'no_meta' WHEN 4 THEN 'no_frames' END AS kind FROM embeddings GROUP BY vec_id // 20""")
def document_failures(spark: SparkSession, d: str) -> DataFrame:
    """JSON documents made of poses, most of them broken in some way: what each has, and what is wrong with it."""
    docs = pivot.parse_documents(_vector_documents(spark, d))
    return docs.select("trial_id", F.when(F.col("frames").isNotNull(), F.size("frames").cast("long")).alias("n_frames"), F.col("status.kind").alias("kind"))


_SYNC = "['knee_L', 'knee_R', 'hip_L', 'hip_R']"


@_query(f"""WITH {_S}, k AS (SELECT unnest({_SYNC}) AS joint, unnest(range(4)) AS j), n AS (SELECT trial_id, count(*) AS n FROM s GROUP BY trial_id),
    a0 AS (SELECT s.trial_id, joint, j, pos, value * (1 + 0.1 * j) AS value FROM s JOIN n USING (trial_id), k WHERE pos < n - ((s.trial_id + j) % 4) * 3),
    b0 AS (SELECT s.trial_id, joint, j, pos - s.trial_id % 4 AS pos, value * (1 + 0.1 * j) + 5 * sin(pos * 12.9898) AS value FROM s JOIN n USING (trial_id), k WHERE pos >= s.trial_id % 4),
    c AS (SELECT trial_id, joint, j, least(a.n, b.n) AS n FROM (SELECT trial_id, joint, j, count(*) AS n FROM a0 GROUP BY ALL) a JOIN (SELECT trial_id, joint, j, count(*) AS n FROM b0 GROUP BY ALL) b USING (trial_id, joint, j)),
    ch AS (SELECT trial_id, joint, n FROM c WHERE n >= 10 QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY n DESC, j) = 1),
    na AS (SELECT trial_id, joint, avg(value) AS m, stddev_pop(value) AS sd FROM a0 GROUP BY ALL), nb AS (SELECT trial_id, joint, avg(value) AS m, stddev_pop(value) AS sd FROM b0 GROUP BY ALL),
    za AS (SELECT a0.trial_id, joint, pos, (value - m) / sd AS v, ch.n FROM a0 JOIN ch USING (trial_id, joint) JOIN na USING (trial_id, joint)), zb AS (SELECT trial_id, joint, pos, (value - m) / sd AS v FROM b0 JOIN nb USING (trial_id, joint)),
    cc AS (SELECT za.trial_id, zb.pos - za.pos AS k, sum(za.v * zb.v) / any_value(n) AS r FROM za JOIN zb ON za.trial_id = zb.trial_id AND za.joint = zb.joint AND zb.pos - za.pos BETWEEN -20 AND 20 GROUP BY ALL),
    o AS (SELECT trial_id, max_by(k, r) AS k FROM cc GROUP BY trial_id),
    al AS (SELECT a0.trial_id, a0.joint, a0.value - b0.value AS d FROM a0 JOIN o USING (trial_id) JOIN b0 ON b0.trial_id = a0.trial_id AND b0.joint = a0.joint AND b0.pos = a0.pos + k),
    e AS (SELECT trial_id, max(q) AS worst, max(p) AS n_aligned FROM (SELECT trial_id, joint, sqrt(avg(d * d)) AS q, count(*) AS p FROM al GROUP BY ALL) GROUP BY trial_id)
    SELECT t.trial_id, CASE WHEN ch.joint IS NULL THEN 'error' ELSE 'ok' END AS status, ch.joint AS signal, round(k / {RATE}::DOUBLE, 6) + 0 AS "offset", coalesce(n_aligned, 0) AS n_aligned, round(worst, 5) + 0 AS worst_rmse
    FROM (SELECT DISTINCT trial_id FROM a0) t LEFT JOIN ch USING (trial_id) LEFT JOIN o USING (trial_id) LEFT JOIN e USING (trial_id)""")
def optical_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Four angles of each trial in two recordings: which is longest in both, the shift by it, and how the others then differ."""
    from pyspark.sql import Window

    s = event_series(spark, d).select("trial_id", "pos", "value", F.count("*").over(Window.partitionBy("trial_id")).alias("n"))
    joints = F.array(*[F.struct(F.lit(name).alias("joint"), F.lit(j).alias("j")) for j, name in enumerate(optical.SYNC_JOINTS)])
    s = s.withColumn("x", F.explode(joints)).select("trial_id", "pos", "n", "x.*", (F.col("value") * (1 + 0.1 * F.col("x.j"))).alias("value"))
    video = s.filter(F.col("pos") < F.col("n") - (F.col("trial_id") + F.col("j")) % 4 * 3).select("trial_id", "joint", "pos", "value")
    shift = F.col("trial_id") % 4
    other = s.filter(F.col("pos") >= shift).select("trial_id", "joint", (F.col("pos") - shift).alias("pos"), (F.col("value") + 5.0 * F.sin(F.col("pos") * 12.9898)).alias("value"))
    run = optical.optical_run(video, other, RATE, RATE, longest=5.0)
    worst = F.array_max(F.transform(F.map_values("optical.angles"), lambda m: m["rmse"]))
    o = F.col("optical")
    return run.blocks.select("trial_id", o["status"].alias("status"), o["sync"]["signal"].alias("signal"), r6(o["sync"]["offset"]).alias("offset"), o["alignment"]["n_aligned"].alias("n_aligned"), (F.round(worst, 5) + 0.0).alias("worst_rmse"))


@_query()
def detect_events_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """The detectors as a table function: contacts and lift-offs by two methods in one statement."""
    tables.register(spark)
    events.wide_tracks(vector_pose(spark, d)).createOrReplaceTempView("kinelake_tracks")
    call = "SELECT * FROM detect_events(TABLE(kinelake_tracks) PARTITION BY trial_id ORDER BY pos, method => '{0}', rate => {1}D, least => 0.5D, cutoff => 1.5D)"
    return spark.sql(" UNION ALL ".join(call.format(m, RATE) for m in ("zeni", "velocity")))
