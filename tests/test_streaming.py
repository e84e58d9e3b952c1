"""Streams over files of made-up contacts."""

import datetime as dt

from pyspark.sql import functions as F

from kinelake.streaming import online


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")


def test_cadence_and_bouts(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("t", t0 + dt.timedelta(seconds=0.5 * i)) for i in range(40)] + [("t", t0 + dt.timedelta(seconds=500))]
    s = stream(spark, tmp_path, rows, "trial_id string, ts timestamp")
    got = drained(spark, online.windowed_cadence(s), "cadence")
    assert [r["cadence"] for r in got] == [120.0, 120.0]
    bouts = drained(spark, online.walking_bouts(s), "bouts")
    assert [r["n"] for r in bouts] == [40]


def test_online_contacts(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    import math

    rows = [("t", t0 + dt.timedelta(seconds=i / 20), math.sin(2 * math.pi * i / 20)) for i in range(100)]
    s = stream(spark, tmp_path, rows, "trial_id string, ts timestamp, value double")
    assert len(drained(spark, online.online_contacts(s), "contacts")) == 5


def test_online_contacts_over_batches(spark, tmp_path):
    """A peak at a batch's end is found in the next; late samples are left out, and a trial that is gone begins anew."""
    import time

    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    schema = "trial_id string, ts timestamp, value double"
    batches = [
        [("t", at(0.0), 0.0), ("t", at(0.1), 1.0)],  # no peak yet
        [("t", at(0.05), 9.0), ("t", at(0.2), 0.5), ("t", at(0.3), None), ("t", at(0.4), 0.4)],  # 0.1 was one; 0.05 is late
        [("t", at(0.45), 0.6), ("t", at(0.48), 0.1), ("t", at(1.0), 0.7), ("t", at(1.1), 0.2)],  # 0.45 is too near, 1.0 is one
        [("u", at(900.0), 0.0)],  # the watermark passes what is remembered of t
        [("u", at(900.1), 0.0)],
        [("t", at(880.0), 5.0), ("t", at(880.1), 0.0)],  # not a peak, as nothing is known from before
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.05 * (k < 5))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = drained(spark, online.online_contacts(s), "batches")
    assert sorted((r["trial_id"], r["ts"], r["height"]) for r in got) == [("t", at(0.1), 1.0), ("t", at(1.0), 0.7)]


def test_batch_works_too(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("t", t0 + dt.timedelta(seconds=i / 10), float(i % 2), i) for i in range(40)], "trial_id string, ts timestamp, y double, frame_idx int")
    assert online.moving_windows(df).filter("moving").count() > 0
    assert df.dropDuplicates(["trial_id", "frame_idx"]).count() == 40
    assert df.select(F.max("ts")).first()[0] > t0
