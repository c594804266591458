"""Operators over parts of series give what their namesakes over whole series give, wherever the cuts fall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coilwave.operators import kernels as K
from coilwave.operators import long as G
from coilwave.operators import series as S

KEYS, BY = ["k"], ["k", "i"]


@pytest.fixture(scope="module")
def samples(spark):
    """Series of many, few, one and no known samples, one without a key; times come in any order and hold equal values."""
    rng = np.random.default_rng(11)
    rows = []
    for k, n in ((1, 137), (2, 9), (3, 1), (4, 40), (None, 23), (5, 6), (6, 10)):
        x = rng.normal(size=n).cumsum()
        for i in range(n):
            gap = k == 5 or (k == 4 and not 20 <= i < 22) or (k == 1 and (i < 30 or 60 <= i < 95 or i == 136)) or (k == 2 and i != 4)
            rows.append((k, 100 - i if k == 1 else i, float(x[i]), None if gap else float(x[i]), int(rng.integers(0, 604_800))))
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(None if v is None else v for v in r) for r in rows], "k int, t int, v double, g double, sec long")
    own = G.numbered(df, KEYS, ["t"], parts=7)
    assert {(r.k, r.t): r.i for r in own.collect()} == {(r.k, r.t): r.j for r in S.indexed(df, KEYS, ["t"], "j").collect()}
    assert own.columns == [*df.columns, "i"]
    return own.cache()


def same(got, want, name):
    a, b = ({(r.k, r.i): r[name] for r in df.select(*BY, name).collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) == 226
    for at, v in b.items():
        assert a[at] == (v if v is None else pytest.approx(v, abs=1e-9)), at


def test_frames(samples, size=7):
    for n, edges, value in ((5, "edge", "g"), (3, "same", "g"), (80, "null", "v")):
        same(G.running_mean(samples, KEYS, "i", value, n, edges=edges, size=size), S.running_mean(samples, KEYS, ["i"], value, n, edges=edges), "mean")
    same(G.running_mean_fractional(samples, KEYS, "i", "v", 4.5, size=size), S.running_mean_fractional(samples, KEYS, ["i"], "v", 4.5), "mean")
    same(G.demean(samples, KEYS, "i", "v", 3.0, size=size), S.demean(samples, KEYS, ["i"], "v", 3.0), "demeaned")
    same(G.prewhiten(samples, KEYS, "i", "v", size=size), S.prewhiten(samples, KEYS, ["i"], "v"), "diff")


def test_carries(samples, size=7):
    same(G.week_numbers(samples, KEYS, "i", "sec", 5, size=size), S.week_numbers(samples, KEYS, ["i"], "sec", 5), "week")
    same(G.unwrap(samples, KEYS, "i", "v", period=1.0, size=size), S.unwrap(samples, KEYS, ["i"], "v", period=1.0), "unwrapped")
    for ends in ("hold", "extend"):
        same(G.interpolate(samples, KEYS, "i", "g", ends=ends, size=size), S.interpolate(samples, KEYS, ["i"], "i", "g", ends=ends), "filled")


def test_notch_over_parts(samples, size=13):
    own = samples.withColumn("w", F.when(F.coalesce(F.col("k"), F.lit(0)) == 4, F.col("g")).otherwise(F.col("v")))
    b, a = K.notch_coefficients(5.0, 64.0, 2.0)
    got = {(r.k, r.i): r.filtered for r in G.notch(own, KEYS, "i", "w", 5.0, 64.0, 2.0, size=size).collect()}
    assert len(got) == 226
    for k, n in ((1, 137), (2, 9), (3, 1), (None, 23), (6, 10)):
        x = np.array([r.w for r in sorted((r for r in own.collect() if r.k == k), key=lambda r: r.i)])
        assert [got[k, i] for i in range(n)] == pytest.approx(by_samples(b, a, x).tolist(), abs=1e-9)
    assert {got[4, i] for i in range(40)} == {None}


def by_samples(b, a, x, pad=9):
    """Forth and back, one sample after another."""
    if len(x) <= pad:
        return x
    long = [*(2 * x[0] - x[pad:0:-1]), *x, *(2 * x[-1] - x[-2 : -pad - 2 : -1])]
    for _ in range(2):
        level = sum(b) / sum(a)
        s, t = (level - b[0]) * long[0], (b[2] - a[2] * level) * long[0]
        out = []
        for v in long:
            y = b[0] * v + s
            s, t = b[1] * v - a[1] * y + t, b[2] * v - a[2] * y
            out.append(y)
        long = out[::-1]
    return np.array(long[pad:-pad])


def test_parts_are_many_tasks(spark, samples):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made = G.running_mean(samples.repartition(8), KEYS, "i", "v", 4, size=7).withColumn("p", F.spark_partition_id())
    try:
        assert made.where("k = 1").select("p").distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert K.zero_phase(*K.notch_coefficients(5.0, 64.0, 2.0), np.arange(30.0)) == pytest.approx(by_samples(*K.notch_coefficients(5.0, 64.0, 2.0), np.arange(30.0)), abs=1e-9)


@pytest.mark.parametrize("cells,most", [(8, 10)])
def test_ranks_by_refinement(spark, samples, cells, most):
    rng = np.random.default_rng(2)
    hard = [(7, float(x)) for x in [*rng.normal(size=300), *[0.25] * 90, 1e308, -1e308, 5e-324, 0.0, -0.0]] + [(8, 1.0)] * 40 + [(9, None)] + [(10, 3.5)]
    df = samples.select("k", F.col("g").alias("v")).unionByName(spark.createDataFrame(hard, "k int, v double")).withColumn("t", F.monotonically_increasing_id()).cache()
    for p, mask in ((0.05, False), (0.3, True)):
        got = {r.t: r.clipped for r in G.winsorize(df, KEYS, "v", p, mask=mask, cells=cells, most=most).collect()}
        want = {r.t: r.clipped for r in S.winsorize(df, KEYS, "v", p, ["t"], mask=mask).collect()}
        assert got == want


def test_period_against_all_lags(spark):
    rng = np.random.default_rng(4)
    series = {k: np.sin(np.arange(n) * 2 * np.pi / turn) + 0.1 * rng.normal(size=n) + level for k, (n, turn, level) in enumerate(((900, 68.31, 0.0), (900, 66.9, 0.0), (300, 7.2, 0.3), (60, 7.0, 0.0), (5, 7.0, 0.0)))}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k int, i int, v double")

    def plain(x, guess, around, excluded):
        like = [float(x[: len(x) - lag] @ x[lag:]) for lag in range(len(x))]
        like = like[: max(0, len(x) - excluded * guess)]
        lag, times = 2 * guess, 2
        while lag + around < len(like):
            lag = 2 * (lag - around + int(np.argmax(like[lag - around : lag + around + 1])))
            times *= 2
        return lag / times

    for guess, around, excluded in ((68, 2, 3), (7, 1, 0)):
        got = {r.k: r.period for r in G.period(df, KEYS, "i", "v", guess, around, excluded).collect()}
        assert got == {k: plain(x, guess, around, excluded) for k, x in series.items()}
        assert guess != 68 or abs(got[0] - 68.31) < 0.3


def test_tapers(spark):
    from coilwave.operators import spectral as X

    for name, make in (("hann", lambda n, m: 0.5 - 0.5 * np.cos(2 * np.pi * n / m)), ("tukey_ten_sample_taper", lambda n, m: np.where(np.minimum(n, m - n) < 10, 0.5 - 0.5 * np.cos(np.pi * np.minimum(n, m - n) / 10), 1.0))):
        got = [r.weight for r in X.taper_table(spark, name, 50).orderBy("place").collect()]
        assert got == pytest.approx(make(np.arange(50), 50).tolist())
    X.TAPERS["mine"] = lambda place, width: place + 1.0
    try:
        x = np.random.default_rng(1).normal(size=30)
        df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, i long, v double")
        got = {r.win: complex(r.re, r.im) for r in X.windowed_bins(df, ["k"], "i", "v", 12, 5, [1.5], "mine", named=[1]).collect()}
    finally:
        del X.TAPERS["mine"]
    w = np.arange(12) + 1.0
    assert got == {k: pytest.approx(complex((x[5 * k : 5 * k + 12] * w * np.exp(-2j * np.pi * 1.5 * np.arange(12) / 12)).sum() / w.sum())) for k in range(4)}
