import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coilwave.operators import pairs as P
from coilwave.sources import catalogs as C

T0 = dt.datetime(2016, 5, 1, 12, 0, 0)
RATE, SECONDS = 1024, 12
NO_BOARDS = "box string, CARDSNX string, ADFREQ double, CALFREQ double, MAG double, PHASE double"
NO_ANTENNAS = "antenna_sn string, base_frequency double, mag double, phz double"


def wave(frequency, n=RATE * SECONDS, shift=0):
    return np.where(((np.arange(n) + shift) * frequency / RATE) % 1 < 0.5, 1.0, -1.0)


def rows_of(path, x, start=0):
    return [(path, T0 + dt.timedelta(seconds=start + k), [None if np.isnan(v) else float(v) for v in x[k * RATE : (k + 1) * RATE]]) for k in range(len(x) // RATE)]


@pytest.fixture(scope="module")
def survey(spark):
    r = np.random.default_rng(2)
    t = np.arange(RATE * SECONDS) / RATE
    noise = lambda s: r.normal(0, s, len(t))
    hum = 0.05 * np.cos(2 * math.pi * 60 * t + 1)
    tx = {32: 10 * wave(32) + noise(0.01), 8: 10 * wave(8) + noise(0.01)}
    rx = {f: 0.05 * x + hum + 0.01 * t / 12 + noise(1e-4) for f, x in tx.items()}
    gaps = rx[32].copy()
    gaps[[3000, 3001, 9000]] = np.nan
    clips = rx[32].copy()
    clips[[4 * RATE, 4 * RATE + 7]] = 3.0
    worse = rx[32].copy()
    worse[::50] = -2.5
    rows = rows_of("t32", tx[32]) + rows_of("t8", tx[8])
    for name, x, start in (("good", rx[32], 0), ("slow", rx[8], 0), ("gaps", gaps, 0), ("clips", clips, 0), ("worse", worse, 0), ("late", rx[32][: 6 * RATE], 4), ("rate", rx[32], 0), ("cut", rx[32][: 6 * RATE], 0)):
        rows += rows_of(name, x, start)
    records = spark.createDataFrame(rows, "path string, time timestamp, values array<double>")
    end = T0 + dt.timedelta(seconds=SECONDS)
    info = []
    for k, name in enumerate(("good", "slow", "gaps", "clips", "worse", "late", "rate", "cut")):
        s, e = (T0 + dt.timedelta(seconds=4), T0 + dt.timedelta(seconds=10)) if name == "late" else (T0, end)
        f = 8.0 if name == "slow" else 32.0
        info.append((k, "t8" if name == "slow" else "t32", name, s, e, 1024.0, 512.0 if name == "rate" else 1024.2, f, "1", "0xa", None, "TX", "2", "b", "77", "Hx" if name == "good" else "Ex"))
    pairs = spark.createDataFrame(info, "pair int, tx_path string, rx_path string, start timestamp, end timestamp, tx_rate double, rx_rate double, frequency double, tx_box string, tx_card string, tx_antenna string, tx_component string, rx_box string, rx_card string, rx_antenna string, rx_component string")
    return records, pairs, tx, rx


def test_record_subsets(spark, survey):
    records, pairs, tx, rx = survey
    got = {r.pair: r for r in P.paired_records(records, pairs).groupBy("pair").agg(F.count("tx").alias("t"), F.count("rx").alias("r")).collect()}
    assert (got[0].t, got[0].r) == (10, 10) and (got[5].t, got[5].r) == (4, 4) and (got[7].t, got[7].r) == (10, 4)
    said = {r.pair: r.problem for r in P.problems(P.paired_records(records, pairs), pairs).collect()}
    assert said == {0: None, 1: None, 2: None, 3: None, 4: None, 5: None, 6: "sampling rates differ", 7: "lengths differ"}
    own = P.paired_samples(P.paired_records(records, pairs.where("pair = 5"))).sort("i").collect()
    assert [r.i for r in own] == list(range(4 * RATE))
    assert np.allclose([r.tx for r in own], tx[32][6 * RATE : 10 * RATE]) and np.allclose([r.rx for r in own], rx[32][2 * RATE : 6 * RATE])


def test_whole_pairs(spark, survey, tmp_path):
    records, pairs, _, _ = survey
    none = [spark.createDataFrame([], s) for s in (NO_BOARDS, NO_ANTENNAS)]
    done = P.processed(records, pairs, *none, save_coefficients=str(tmp_path / "fc"))
    got = {r.rx_path: r for r in done.collect()}
    assert len(got) == 8
    assert {k for k, r in got.items() if not r.processed} == {"worse", "rate", "cut"}
    assert (got["worse"].problem, got["rate"].problem, got["cut"].problem, got["good"].problem) == ("insufficient clip-free data", "sampling rates differ", "lengths differ", None)
    for name in ("good", "slow", "gaps", "clips", "late"):
        for h in P.HARMONICS:
            for kind in ("LS", "RM"):
                assert abs(complex(got[name][f"tf{h}_real_{kind}"], got[name][f"tf{h}_imag_{kind}"]) - 0.05) < 0.002, (name, h, kind)
                assert got[name][f"tf{h}_var_{kind}"] >= 0
    g, c = got["gaps"], got["clips"]
    assert (g.num_samples, g.num_nans, g.num_clips, g.samples_per_cycle, g.num_cycles, g.signal_duration) == (10 * RATE, 3, 0, 32, 10 * 32, 10.0)
    # two seconds are left out, so places are 2 * RATE less
    assert g.nan_free_sec == (9000 - 3001 - 1) / RATE
    assert (c.num_clips, c.clip_first, c.max_clipfree_tx_cycles) == (2, 2 * RATE + 8, (8 * RATE - 8) / RATE * 32)
    assert got["worse"].max_clipfree_tx_cycles < 3 and 9.9 < c.max_current < 10.1 and -10.1 < c.min_current < -9.9
    assert set(r.pair for r in spark.read.parquet(str(tmp_path / "fc")).select("pair").distinct().collect()) == {0, 1, 2, 3, 5}
    table = P.result_table(done)
    assert len(table.columns) == 58 and table.columns == P.RESULT_COLUMNS and (table.columns[26], table.columns[35], table.columns[36], table.columns[41], table.columns[-1]) == ("tf1_real_LS", "tf9_imag_LS", "tf1_var_LS", "tf1_real_RM", "n_good")
    rows = {r.rx_filename: r for r in table.collect()}
    assert rows["gaps"].num_nans == 3 and rows["gaps"].sampling_rate == RATE and rows["gaps"].dx1 is None and rows["gaps"].tf3_imag_LS == g.tf3_imag_LS
    C.save(done, str(tmp_path / "avg"), "csv", order=("pair",), one_file=True)
    again = spark.read.csv(str(tmp_path / "avg"), header=True, inferSchema=True)
    assert again.count() == 8 and again.columns == done.columns


def test_calibration_of_pairs(spark, survey):
    """A board that doubles and turns by a tenth of a radian, an antenna that halves: both come out of the receiver alone."""
    records, pairs, _, _ = survey
    boards = spark.createDataFrame([("2", "0xb", 1024.0, float(f), 2.0, 100.0) for f in (1, 8, 32, 64, 128, 256, 512, 1024, 2048)], NO_BOARDS)
    antennas = spark.createDataFrame([("77", float(2**k), 0.5, 0.0) for k in range(12)], NO_ANTENNAS)
    got = {r.rx_path: r for r in P.processed(records, pairs.where("pair in (0, 2)"), boards, antennas).collect()}
    turn = complex(math.cos(0.1), -math.sin(0.1))
    for name, gain in (("good", 1 / (2 * 0.5)), ("gaps", 1 / 2)):
        for h in P.HARMONICS:
            assert abs(complex(got[name][f"tf{h}_real_LS"], got[name][f"tf{h}_imag_LS"]) - 0.05 * gain * turn) < 0.003


def test_pairs_with_a_longer_taper(spark, survey):
    records, pairs, _, _ = survey
    none = [spark.createDataFrame([], s) for s in (NO_BOARDS, NO_ANTENNAS)]
    got = P.processed(records, pairs.where("pair = 0"), *none, taper="tukey_ten_sample_taper").first()
    for h in P.HARMONICS:
        assert abs(complex(got[f"tf{h}_real_LS"], got[f"tf{h}_imag_LS"]) - 0.05) < 0.003


def test_window_sums(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=50)
    df = spark.createDataFrame([("a", k, None if k == 13 else float(v), float(2 * v)) for k, v in enumerate(x)], "key string, i long, x double, y double")
    got = {g.win: g for g in P.bin_sums(df, ["key"], "i", "x", 8, 1 / 8, halves=True).collect()}
    x[13] = 0
    starts = sorted([8 * k for k in range(6)] + [4 + 8 * k for k in range(5)])
    assert sorted(got) == list(range(11))
    for w, s in enumerate(starts):
        want = sum(x[s + k] * np.exp(-2j * math.pi * k / 8) for k in range(8))
        assert abs(complex(got[w].re, got[w].im) - want) < 1e-9 and got[w].n == 8 - (s <= 13 < s + 8)
    assert len(P.bin_sums(df, ["key"], "i", "x", 8, 1 / 8).collect()) == 6
    assert all(abs(complex(g.re, g.im) - 2) < 1e-9 for g in P.window_ratios(df.where("i > 13").withColumn("i", F.col("i") - 14), ["key"], "i", "x", "y", 8, 1 / 8).collect())


def test_kept_tables(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.createDataFrame([("a", 0.0, True, T0, T0), ("b", 2.0, True, T0, T0)], "path string, num_records double, valid boolean, start timestamp, end timestamp")

    at = str(tmp_path / "catalog")
    rows = [C.cached(spark, at, build, read=C.load_catalog).sort("path").collect() for _ in range(2)]
    assert made == [1] and rows[0] == rows[1] and (rows[0][0].valid, rows[0][0].start, rows[0][1].valid) == (False, None, True)
    C.cached(spark, at, build, use_kept=False)
    assert made == [1, 1]
    (tmp_path / "s.csv").write_text("name,value\na,1\nb,2\nb,3\n")
    settings = C.read_csv(spark, str(tmp_path / "s.csv"), C.SETTINGS)
    assert C.setting(settings, "a") == "1"
    for name in ("b", "c"):
        with pytest.raises(ValueError):
            C.setting(settings, name)
    with pytest.raises(Exception, match="not unique: b"):
        C.assert_unique(settings, "name").collect()
    assert C.assert_unique(settings, "name", "value").count() == 3
    span = lambda k, s, e: (k, T0 + dt.timedelta(hours=s), T0 + dt.timedelta(hours=e))
    tx, rx = (spark.createDataFrame(x, "id long, start timestamp, end timestamp") for x in ([span(1, 0, 2)], [span(7, 1, 3), span(8, 2, 4)]))
    got = C.local_overlaps(spark, tx, rx, str(tmp_path / "ov")).collect()
    assert [(r.tx_id, r.rx_id, r.start) for r in got] == [(1, 7, T0 + dt.timedelta(hours=1 - 6))]
    assert C.without(settings, settings.where("name = 'b'"), ["name"]).count() == 1 and C.summed_calibrations(settings.withColumn("v", F.col("value").cast("double")), ["name"], ["v"]).where("v = 5").count() == 1
