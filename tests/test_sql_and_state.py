"""Table functions in SQL, and stateful contacts over micro-batches of any size."""

import datetime as dt
import math
import time

import pytest
from pyspark.errors import AnalysisException

from kinelake.functions import tables
from kinelake.operators import events, pose
from kinelake.plans.registry import QUERIES
from kinelake.plans.series_queries import RATE
from kinelake.sources import pivot
from kinelake.sources.driver_tables import vector_pose
from kinelake.streaming import stateful
from tests.conftest import DATA, as_documents, requires_data, walking
from tests.test_streaming import drained
from pyspark.sql import functions as F


@requires_data
def test_detectors_in_sql(spark):
    p = vector_pose(spark, DATA)
    trials = p.select("trial_id").distinct().select("trial_id", F.struct(F.lit(RATE).alias("fps")).alias("meta"))
    text = p.withColumn("trial_id", F.col("trial_id").cast("string")), trials.withColumn("trial_id", F.col("trial_id").cast("string"))
    expected = sorted((int(r[0]), *r[1:]) for m in ("zeni", "velocity") for r in events.detect_events(*text, m, least=0.5, cutoff=1.5).collect())
    assert sorted(tuple(r) for r in QUERIES["detect_events_in_sql"](spark, DATA).collect()) == expected and expected


def test_own_detectors_and_wrong_calls_in_sql(spark, monkeypatch):
    def first(s, rate, least, cutoff):
        return {("left", "hs"): [(0, 0.5), (len(s["LEFT_HIP_x"]) - 1, least)]}

    docs = as_documents(spark, [walking(30, trial="a"), walking(3, trial="short"), walking(40, trial="b")])
    events.wide_tracks(pivot.poses(docs)).createOrReplaceTempView("tracks")
    monkeypatch.setitem(events._METHODS, "first", first)
    tables.register(spark)
    monkeypatch.delitem(events._METHODS, "first")
    own = "SELECT trial_id, frame, confidence FROM detect_events(TABLE(tracks) PARTITION BY trial_id ORDER BY pos, method => 'first', least => 0.25D) ORDER BY 1, 2"
    assert [tuple(r) for r in spark.sql(own).collect()] == [("a", 0, 0.5), ("a", 29, 0.25), ("b", 0, 0.5), ("b", 39, 0.25)]
    assert "first" in {r["name"] for r in spark.sql("SELECT * FROM engine_choices() WHERE registry = 'event method'").collect()}
    for wrong in ("detect_events(TABLE(tracks) PARTITION BY trial_id ORDER BY pos, method => 'none')", "detect_events(TABLE(SELECT 1 AS pos))", "detect_events(TABLE(tracks) PARTITION BY trial_id, method => rand())"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {wrong}").collect()
    assert set(pose.list_angle_methods()) <= {r[0] for r in spark.sql("SELECT name FROM engine_choices()").collect()}


T0 = dt.datetime(2024, 1, 1)
SCHEMA = "trial_id string, ts timestamp, value double"


def samples():
    """Two noisy walks, one of which pauses, with a missing and a repeated sample."""
    out = []
    for trial, period, n in (("a", 1.0, 240), ("b", 1.3, 200)):
        for i in range(n):
            at = i / 30 + (3.0 if trial == "b" and i >= 120 else 0.0)
            out.append((trial, T0 + dt.timedelta(seconds=at), None if i == 50 else math.sin(2 * math.pi * at / period) + 0.3 * math.sin(i * 12.9898)))
    return [*out, out[70], out[300]]


@pytest.mark.parametrize(("size", "shuffle"), [(1000, False), (97, False), (40, True)])
def test_a_stream_equals_the_whole(spark, tmp_path, size, shuffle):
    """Samples out of order by up to a second, in batches of any size: the contacts of the whole recording."""
    rows = sorted(samples(), key=lambda r: (r[1], r[0]))
    if shuffle:
        rows = [r for k in range(0, len(rows), 30) for r in sorted(rows[k : k + 30], key=lambda r: hash((r[0], r[1].microsecond)))]
    batches = [rows[k : k + size] for k in range(0, len(rows), size)] + [[("end", T0 + dt.timedelta(seconds=60), 0.0)], [("end", T0 + dt.timedelta(seconds=61), 0.0)]]
    for k, own in enumerate(batches):
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.02 * (k < len(batches)))
    whole = stateful.causal_contacts(spark.createDataFrame(samples(), SCHEMA)).collect()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        got = drained(spark, stateful.online_contacts(stream), f"contacts_{size}_{shuffle}".lower())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    key = lambda r: (r["trial_id"], r["ts"], round(r["height"], 9))
    assert sorted(map(key, got)) == sorted(map(key, whole)) and len(whole) >= 10


def test_late_samples_and_forgotten_trials(spark, tmp_path):
    """A sample behind the watermark is left out; a trial that was forgotten begins anew."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    wave = lambda t, a, b: [(t, at(a + i / 30), math.sin(2 * math.pi * i / 30)) for i in range(int(30 * (b - a)))]
    batches = [wave("t", 0, 3), wave("t", 3, 6), [("t", at(0.5), 99.0)], wave("u", 1000, 1003), wave("t", 1003, 1006), wave("u", 1006, 1010), [("u", at(1020), 0.0)]]
    for own in batches:
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.02)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        got = drained(spark, stateful.online_contacts(stream, forget=60.0), "late_contacts")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    whole = stateful.causal_contacts(spark.createDataFrame([r for b in batches for r in b if r[2] != 99.0], SCHEMA)).collect()
    key = lambda r: (r["trial_id"], r["ts"], round(r["height"], 9))
    assert sorted(map(key, got)) == sorted(map(key, whole)) and len({r["trial_id"] for r in got}) == 2


def test_the_filter_is_the_usual_one():
    machine = stateful.CausalContacts(30.0, 6.0, 0, 10**9)
    assert machine.run([0, 1, 2, 3], [5.0] * 4, stateful._NONE)[1][1] == pytest.approx(5.0)
    whole = [math.sin(i / 3) for i in range(50)]
    parts, carry = [], stateful._NONE
    for k in range(0, 50, 7):
        found, carry = machine.run(list(range(k, min(50, k + 7))), whole[k : k + 7], carry)
        parts += found
    assert parts == machine.run(list(range(50)), whole, stateful._NONE)[0]
