"""Spectra spread over tasks are those of whole series, whatever the lengths and the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coilwave.operators import fourier as R

LENGTHS = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 8, 7: 9, 8: 17, 9: 64, 10: 97, 11: 360, None: 33}


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(2)
    return {k: rng.normal(3, 2, size=n) for k, n in LENGTHS.items()}


@pytest.mark.parametrize(("whole", "block"), [(0, 20), (0, 0), (0, 4), (16, 3)])
def test_spectra_of_all_lengths_and_back(spark, series, whole, block):
    rows = [(k, 1000 - i, float(v), "n") for k, x in series.items() for i, v in enumerate(x[::-1])]
    df = spark.createDataFrame(rows, "g int, t int, v double, n string").repartition(5)
    # the order column runs against the order of rows; keys that are null are one series; a column named like a result's is ignored
    sums = R.spectrum(df, ["g"], ["t"], "v", whole=whole, block=block)
    assert sums.columns == ["g", "n", "k", "re", "im"]
    got = {}
    for r in sums.collect():
        assert r.n == LENGTHS[r.g] and (r.g, r.k) not in got
        got[r.g, r.k] = complex(r.re, r.im)
    for k, x in series.items():
        want = np.fft.rfft(x)
        assert [got.pop((k, j)) for j in range(len(want))] == pytest.approx(want.tolist(), abs=1e-9)
    assert not got
    back = {(r.g, r.i): r.value for r in R.series_of(sums, ["g"], whole=whole, block=block).collect()}
    assert len(back) == sum(LENGTHS.values())
    assert all(back[k, i] == pytest.approx(v, abs=1e-9) for k, x in series.items() for i, v in enumerate(x))


def test_missing_samples_and_no_rows(spark, series):
    rows = [(k, i, None if (k, i) in ((9, 5), (1, 0)) else float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, t int, v double")
    sums = R.spectrum(df, ["g"], ["t"], "v", whole=0, block=3)
    assert {r.g for r in sums.where("re is null or im is null").collect()} == {1, 9} and sums.where("g = 9").count() == 33
    back = R.series_of(sums, ["g"], whole=0, block=3)
    assert sorted((r.g, r.i) for r in back.where("value is null").collect()) == [(1, 0), *((9, i) for i in range(64))]
    empty = R.spectrum(df.where("t < 0"), ["g"], ["t"], "v", whole=0)
    assert empty.count() == 0 and R.series_of(empty, ["g"], whole=0).count() == 0


def test_no_task_gets_a_whole_series(spark):
    """A series of 4000 samples in blocks of 256 places: no tile and no group holds more than a block of both parts."""
    df = spark.range(4000).select(F.lit(1).alias("g"), F.col("id").alias("t"), F.sin("id").alias("v"))
    placed = df.select(F.lit(0).cast("long").alias("_s"), F.lit(4000).cast("long").alias("_n"), F.col("t").alias("_p"), F.col("v").alias("_re"), F.lit(0.0).alias("_im"))
    m, block = 13, 8
    columns, rows, width, height = R._grid(m, block)
    assert rows + width == block and columns + height == block
    sums = R._sums(placed, True, block).collect()
    want = np.fft.rfft(np.sin(np.arange(4000)))
    got = np.zeros(2001, complex)
    for r in sums:
        got[r._k] = complex(r._re, r._im)
    assert len(sums) == 2001 and np.abs(got - want).max() < 1e-8
