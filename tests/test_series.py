"""Window operators against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.functions import columns as C
from kinelake.functions import kernels as K
from kinelake.functions import series as S

KEY = ["k"]


def frame(spark, *runs):
    return spark.createDataFrame([(k, i, None if v is None else float(v)) for k, run in enumerate(runs) for i, v in enumerate(run)], "k int, pos int, v double")


def values(df, column, key=0):
    return [r[column] for r in df.filter(F.col("k") == key).orderBy("pos").collect()]


def test_gradient(spark, rng):
    x = rng.normal(size=20)
    out = S.gradient(frame(spark, x, [1.0]), KEY, "v", "g", 0.5)
    assert values(out, "g") == pytest.approx(np.gradient(x, 0.5))
    assert values(out, "g", 1) == [None]


def test_interpolation(spark):
    df = frame(spark, [None, 1, None, None, 4, None], [None, None])
    assert values(S.interpolate(df, KEY, "v", "o"), "o") == [1, 1, 2, 3, 4, 4]
    assert values(S.interpolate(df, KEY, "v", "o", hold_ends=False), "o") == [None, 1, 2, 3, 4, None]
    assert values(S.interpolate(df, KEY, "v", "o", hold_ends=False, max_gap=1), "o") == [None, 1, None, None, 4, None]
    assert values(S.interpolate(df, KEY, "v", "o"), "o", 1) == [None, None]
    assert values(S.fill_both(df, KEY, "v", "o"), "o") == [1, 1, 1, 1, 4, 4]


def test_rolling(spark, rng):
    x = rng.normal(size=25)
    assert values(S.rolling_mean(frame(spark, x), KEY, "v", "o", 4), "o") == pytest.approx(K.moving_mean(x, 4))
    assert values(S.rolling_median(frame(spark, x), KEY, "v", "o", 5), "o") == pytest.approx(K.median_filter(x, 5))
    spread = values(S.rolling_std(frame(spark, x), KEY, "v", "o", 2), "o")
    assert spread[5] == pytest.approx(x[3:8].std())


def test_detrend(spark):
    x = 3 * np.arange(30) + np.sin(np.arange(30))
    fit = np.polyfit(np.arange(30), x, 1)
    out = values(S.detrend(frame(spark, x, [1, 5]), KEY, "v", "o"), "o")
    assert out == pytest.approx(x - fit[0] * (np.arange(30) - 14.5))
    assert values(S.detrend(frame(spark, x, [1, 5]), KEY, "v", "o"), "o", 1) == [1, 5]


def test_unwrap(spark):
    true = np.cumsum(np.full(50, 35.0))
    wrapped = (true + 180) % 360 - 180
    assert values(S.unwrap(frame(spark, wrapped), KEY, "v", "o"), "o") == pytest.approx(np.degrees(np.unwrap(np.radians(wrapped))))


def test_outliers(spark):
    x = [1.0] * 10 + [100.0] + [1.0] * 10
    assert max(values(S.drop_outliers(frame(spark, x), KEY, "v", "o"), "o")) == 1


def test_correlations(spark, rng):
    x = rng.normal(size=40)
    c = x - x.mean()
    got = {r["lag"]: r["r"] for r in S.autocorrelation(frame(spark, x, [2.0, 2.0]), KEY, "v", 5).collect()}
    assert len(got) == 6
    assert got[3] == pytest.approx((c[:-3] * c[3:]).sum() / (c * c).sum())
    df = frame(spark, np.roll(x, 4)).withColumn("b", F.col("v") * 0)
    pair = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(np.roll(x, 4), x, strict=True))], "k int, pos int, a double, b double")
    r = S.cross_correlation(pair, KEY, "a", "b", 6).orderBy(F.desc("r")).first()
    lags, expected = K.correlation_lags(np.roll(x, 4), x, 6)
    assert (r["lag"], r["r"]) == (4, pytest.approx(expected.max()))
    assert df.count() == 40


def test_gap_runs(spark):
    rows = S.gap_runs(frame(spark, [1, None, None, 2, None]), KEY, "v").orderBy("first").collect()
    assert [(r["first"], r["last"], r["length"]) for r in rows] == [(1, 2, 2), (4, 4, 1)]


def test_thinning(spark):
    df = spark.createDataFrame([(0, p) for p in (9, 1, 3, 4, 6)], "k int, pos int")
    assert sorted(r["pos"] for r in S.thin(df, KEY, "pos", 3).collect()) == K.thin([9, 1, 3, 4, 6], 3) == [1, 4, 9]


def test_exponential_mean(spark):
    out = S.exponential_mean(frame(spark, [1, None, 3]), KEY, "v", 0.5)
    assert values(out, "ema") == [1, 1, 2]


@pytest.mark.parametrize("n", [1, 2, 7, 101, 250])
def test_resampling(spark, rng, n):
    x = rng.normal(size=n)
    long = [r["value"] for r in S.resample_long(frame(spark, x), KEY, "v", 101).orderBy("p").collect()]
    assert long == pytest.approx(K.resample(x, 101))
    if n > 1:
        array = spark.createDataFrame([(x.tolist(),)], "c array<double>").select(C.resample("c", 101).alias("c")).first()["c"]
        assert array == pytest.approx(K.resample(x, 101))


def test_filled_curve(spark):
    df = spark.createDataFrame([([None, 1.0, None, 3.0, None],), ([None, None],), ([1.0, 2.0],)], "c array<double>")
    assert [r[0] for r in df.select(C.filled_curve("c")).collect()] == [[1, 1, 2, 3, 3], [None, None], [1, 2]]


def test_columns(spark):
    row = spark.sql("select float('nan') as n, 190.0D as a, 3.0D as l, 1.0D as r, 0.0D as z").select(
        C.clean("n").alias("n"), C.wrap180("a").alias("a"), C.symmetry_index("l", "r").alias("s"), C.symmetry_index("z", "z").alias("s0"),
        C.angle_between(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)).alias("right"), C.angle_between(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)).alias("none"), C.safe_divide("l", "z").alias("d"),
    ).first()
    assert (row["n"], row["a"], row["s"], row["s0"], row["right"], row["none"], row["d"]) == (None, -170, 100, 0, pytest.approx(90), None, None)
