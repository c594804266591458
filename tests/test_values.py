import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coilwave.functions import geometry as G
from coilwave.operators import catalog as C
from coilwave.operators import overlap as O
from coilwave.operators import series as S


@pytest.mark.parametrize("signed", [False, True])
def test_offsets_against_convolution(spark, signed):
    period, half = 8, 4
    rng = np.random.default_rng(3)
    series = {k: np.where((np.arange(n) - shift) // half % 2 == 0, 1.0, -1.0) + rng.normal(0, 0.05, n) for k, (n, shift) in enumerate([(40, 3), (41, 6), (50, 1), (17, 5)])}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    got = {r["k"]: r["offset"] for r in S.on_time_offset(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], ["i"], "v", period, signed=signed).collect()}
    for k, x in series.items():
        cycles = len(x) // period
        train = np.tile([1.0, 0, 0, 0, -1.0, 0, 0, 0], cycles - 1) if signed else np.tile([1.0, 0, 0, 0], 2 * cycles - 1)
        steps = np.diff(x) if signed else np.abs(np.diff(x))
        assert got[k] == np.argmax(np.convolve(steps, train, "valid")) % (period if signed else half)


def test_rotation_is_proper_and_corrected(spark):
    rows = [(35.0, 36.0, 34.0, 9.0), (10.0, 50.0, 40.0, -20.0), (-30.0, 40.0, 33.0, 0.0), (90.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    m = G.triaxial_to_geographic(*[F.col(x) for x in "abcd"], "deg")
    fixed = G.corrected_inclinations(*[F.col(x) for x in "abc"], "deg")
    got = df.select(F.array(*[F.array(*r) for r in m]).alias("m"), F.array(*fixed).alias("f"), F.array(*G.azimuths(m, "deg")).alias("z")).collect()
    for (*inclinations, declination), r in zip(rows[:3], got, strict=False):
        own = np.array(r["m"])
        assert np.allclose(own @ own.T, np.eye(3)) and np.linalg.det(own) == pytest.approx(1)
        sines = np.sin(np.radians(inclinations))
        assert np.allclose(own[2], np.abs(sines) / np.linalg.norm(sines)) and np.allclose(np.sin(np.radians(r["f"])), sines / np.linalg.norm(sines))
        assert (r["z"][0] - declination) % 360 == pytest.approx(180)
    assert any(x is None for row in got[3]["m"] for x in row)


def test_projections(spark):
    e, n = G.utm(F.lit(0.0), F.lit(-105.0))
    x, y = G.web_mercator(F.lit(45.0), F.lit(180.0))
    got = spark.range(1).select(e.alias("e"), n.alias("n"), x.alias("x"), y.alias("y")).first()
    assert (got["e"], got["n"]) == pytest.approx((500_000, 0)) and got["x"] == pytest.approx(math.pi * 6378137) and got["y"] == pytest.approx(5621521.486, abs=1e-2)


def hum_removed(x, period, rate, hum, before, after, cut):
    """The same by loops over one series."""
    n, half = len(x), period // 2
    score = np.convolve(np.abs(np.diff(x)), np.tile([1.0] + [0.0] * (half - 1), 2 * (n // period) - 1), "valid")
    off = int(np.argmax(score)) % half
    width = round(rate / hum)
    mean = np.full(n, np.nan)
    for i in range(width // 2, n - (width - 1) // 2):
        mean[i] = x[i - width // 2 : i + (width - 1) // 2 + 1].mean()
    full = np.flatnonzero(~np.isnan(mean))
    mean[: full[0]], mean[full[-1] :] = mean[full[0]], mean[full[-1]]
    v = x - mean
    known = np.array([after <= (i - off) % half < half - before for i in range(n)])
    ordered = np.sort(v[known])
    low = int(cut * len(ordered))
    known &= (v >= ordered[low]) & (v <= ordered[len(ordered) - low - 1])
    count = n // period + (n - half) // period
    total = np.zeros((count + 1) * period // 2)
    for k in range(count):
        start = k * period // 2
        j = np.arange(period)
        wave = np.exp(2j * np.pi * hum * j / rate)
        use = known[start : start + period]
        c = (v[start : start + period] * use * wave.conj()).sum()
        up = (j + 0.5) * 2 / period
        weight = np.minimum(up, up[::-1])
        if k == 0:
            weight[:half] = 1
        if k == count - 1:
            weight = np.where(j >= half, 1, up)
        total[start : start + period] += (2 * c * wave / use.sum()).real * weight
    return x[: len(total)] - total


def test_lockin(spark):
    from coilwave.operators.lockin import lockin

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k, n in enumerate((400, 333, 128)):
        i = np.arange(n)
        x = np.where((i - 7) // 32 % 2 == 0, 1.0, -1.0) + 0.3 * np.cos(2 * np.pi * 60 * i / 480 + k) + rng.normal(0, 0.01, n)
        rows += [(k, int(a), float(b)) for a, b in zip(i, x, strict=True)]
        want[k] = hum_removed(x, 64, 480.0, 60.0, 4, 8, 0.05)
    rows += [(9, a, 1.0) for a in range(10)]
    got = lockin(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], ["i"], "v", 64, 480.0, 60.0, 4, 8, 0.05)
    found = {}
    for r in got.orderBy("k", "i").collect():
        found.setdefault(r["k"], []).append(r["filtered"])
    assert sorted(found) == [0, 1, 2]
    for k, x in want.items():
        assert len(found[k]) == len(x) and np.allclose(found[k], x, atol=1e-8)


def test_whole_series_are_used(spark, tmp_path):
    from coilwave.plans.catalog import QUERIES

    rng = np.random.default_rng(6)
    rows = [(2 * i + k, i, 1, kind, float(rng.normal())) for i in range(200) for k, kind in enumerate(("view", "click"))]
    spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert [r["n"] for r in QUERIES["tf_windows"](spark, str(tmp_path)).collect()] == [99]
    got = {r["win"]: (r["n"], complex(r["re"], r["im"])) for r in QUERIES["dft_bins"](spark, str(tmp_path)).collect()}
    x = np.array([r[-1] for r in rows])
    for w in range(7):
        part = x[64 * w : 64 * w + 64]
        assert got[w][0] == len(part) and got[w][1] == pytest.approx((part * np.exp(-2j * np.pi * 3 * np.arange(len(part)) / 64)).sum(), abs=1e-5)
    assert len(got) == 7


@pytest.mark.parametrize("in_one_task", [0, 50, 100_000])
def test_regression_in_rounds(spark, monkeypatch, in_one_task):
    """In rounds, in one task a key, and by size: the same results."""
    from coilwave.operators import kernels as K

    monkeypatch.setattr(K, "IN_ONE_TASK", in_one_task)
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k, n in ((1, 300), (2, 40), (None, 25), (3, 2)):
        t = rng.normal(size=n) + 1j * rng.normal(size=n)
        r = (2 - 0.5j) * t + 0.1 * (rng.normal(size=n) + 1j * rng.normal(size=n))
        r[:: 7] += rng.normal(0, 9, len(r[:: 7]))
        want[k] = (n, K.huber_regression(t, r))
        rows += [(k, float(a.real), float(a.imag), float(b.real), float(b.imag)) for a, b in zip(t, r, strict=True)]
    rows += [(1, 1.0, None, 1.0, 1.0), (1, float("nan"), 1.0, 1.0, 1.0), (4, 1.0, 1.0, 1.0, 1.0), (5, 0.0, 0.0, 1.0, 1.0), (5, 0.0, 0.0, 2.0, 1.0), (6, None, 1.0, 1.0, 1.0)]
    rows += [(7, 1.0, 0.0, 2.0, 0.0), (7, 0.0, 1.0, 0.0, 2.0)]
    df = K.regression_m(spark.createDataFrame(rows, "k int, t_re double, t_im double, r_re double, r_im double").repartition(5), ["k"])
    # no task holds all pairs of a key
    got = {r["k"]: tuple(r)[1:] for r in df.collect()}
    for k, (n, (h, v, rounds, good, converged)) in want.items():
        assert converged and got[k][6] and got[k][0] == n and got[k][1:4] == pytest.approx((h.real, h.imag, v), rel=1e-6) and got[k][5] == pytest.approx(good) and abs(got[k][4] - rounds) <= 1
    assert got[4] == (1, *[None] * 6) and got[5] == (2, *[None] * 6) and got[6] == (0, *[None] * 6)
    assert got[7] == (2, 2.0, 0.0, 0.0, 0, 1.0, True) and len(got) == 8
    cut = K.regression_m(spark.createDataFrame(rows[:300], "k int, t_re double, t_im double, r_re double, r_im double"), ["k"], most=1).first()
    assert (cut["rounds"], cut["converged"]) == (1, False)


def test_waveforms_and_grids_of_gaps(spark):
    rng = np.random.default_rng(5)
    series = {0: rng.normal(size=43), 1: rng.normal(size=1), 2: rng.normal(size=9), 3: rng.normal(size=24)}
    rows = [(k, i, None if (k, i) == (0, 20) else float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    got = {(r.k, r.cycle, r.phase): r.value for r in S.reshaped(df, ["k"], ["i"], "v", 8, shift=3, keep=True).collect()}
    for k, x in series.items():
        padded = [None] * 5 + [None if (k, i) == (0, 20) else float(v) for i, v in enumerate(x)]
        padded += [None] * (-len(padded) % 8)
        assert {(c, p): v for (n, c, p), v in got.items() if n == k} == {divmod(j, 8): v for j, v in enumerate(padded)}
    # a waveform that repeats comes back as it is, also where a sample is missing
    wave = [(0, i, None if i == 20 else math.sin(2 * math.pi * i / 8) + i % 3) for i in range(48)]
    back = {r.i: r.value for r in S.running_waveform(spark.createDataFrame(wave, "k int, i int, v double"), ["k"], ["i"], "v", 24.0, 24, 3).collect()}
    assert sorted(back) == list(range(48)) and all(back[i] == pytest.approx(math.sin(2 * math.pi * i / 8) + i % 3) for i in range(48))
    empty = df.where("k < 0")
    assert S.running_waveform(empty, ["k"], ["i"], "v", 6.5, 8, 3).count() == 0 == S.reshaped(empty, ["k"], ["i"], "v", 8).count()


def test_windows_of_any_shape(spark):
    rng = np.random.default_rng(6)
    x, known = rng.normal(size=30), rng.random(30) < 0.7
    df = spark.createDataFrame([(1, i, float(v) if k else None) for i, (v, k) in enumerate(zip(x, known, strict=True))], "k int, i int, v double")
    for weights in ([1, 2, 4], [0.5, 1], [0, 1, 3, 1, 0]):
        own, count = (np.convolve(a, weights, "same") for a in (np.where(known, x, 0), known.astype(float)))
        got = [r["mean"] for r in S.windowed_mean(df, ["k"], ["i"], "v", weights).orderBy("i").collect()]
        assert all((g is None) == (c == 0) and (g is None or g == pytest.approx(o / c)) for g, o, c in zip(got, own, count, strict=True))


def test_overlaps_of_all_lengths(spark):
    """Against all with all: short and day-long recordings, some of years and centuries, reversed and missing times."""
    rng = np.random.default_rng(8)
    base = dt.datetime(2020, 1, 1)

    def some(first):
        rows = [(first + k, base + dt.timedelta(seconds=int(s)), base + dt.timedelta(seconds=int(s) + int(n))) for k, (s, n) in enumerate(zip(rng.integers(-400_000, 400_000, 60), rng.choice([600, 7200, 21600, 90_000, -50], 60), strict=True))]
        rows += [(first + 60, base, base + dt.timedelta(days=2000)), (first + 61, dt.datetime(1700, 1, 1), dt.datetime(2300, 1, 1)), (first + 62, None, base), (first + 63, base, None), (first + 64, base, base)]
        return rows

    tx, rx = some(0), some(1000)
    fields = "id long, start timestamp_ntz, end timestamp_ntz"
    want = sorted((a, b, max(s, u), min(e, v)) for a, s, e in tx for b, u, v in rx if None not in (s, e, u, v) and s < e and u < v and max(s, u) < min(e, v))
    for seconds in (600, 21600):
        got = O.overlaps(spark.createDataFrame(tx, fields), spark.createDataFrame(rx, fields), seconds)
        assert sorted(map(tuple, got.collect())) == want


def test_overlaps_in_crowded_buckets(spark, monkeypatch):
    """Blocks and parts of a few rows, and tasks by pairs: the same pairs, each once; a recording's partners follow each other by time; equal ids and columns of any name go along."""
    monkeypatch.setattr(O, "BLOCK", 7)
    monkeypatch.setattr(O, "PART", 11)
    monkeypatch.setattr(O, "LEAST", 50)
    monkeypatch.setattr(O, "MOST", 400)
    rng = np.random.default_rng(9)
    base = dt.datetime(2020, 1, 1)
    some = lambda n: [(k // 2, base + dt.timedelta(seconds=int(s)), base + dt.timedelta(seconds=int(s + d)), k % 3 > 0, f"n{k}") for k, (s, d) in enumerate(zip(rng.integers(0, 9000, n), rng.choice([300, 2000, 9000, 40_000], n), strict=True))]
    tx, rx = some(90), some(70)
    fields = "id long, start timestamp_ntz, end timestamp_ntz, valid boolean, level string"
    want = sorted((u[0], t[0], max(t[1], u[1]), min(t[2], u[2]), *t[1:], *u[1:], t[3] and u[3]) for t in tx for u in rx if max(t[1], u[1]) < min(t[2], u[2]))
    got = O.full_overlaps(spark.createDataFrame(tx, fields), spark.createDataFrame(rx, fields))
    assert got.columns == ["rx_id", "tx_id", "overlap_start", "overlap_end", *[f"{n}_{c}" for n in ("tx", "rx") for c in ("start", "end", "valid", "level")], "ok"]
    assert len(want) > 3000 and sorted(map(tuple, got.collect())) == want
    short = O.overlaps(*[spark.createDataFrame(x, fields) for x in (tx, rx)], 600)
    assert sorted(map(tuple, short.collect())) == sorted((w[1], w[0], w[2], w[3]) for w in want)


def _ops(plan):
    """The operators of a plan without what lies below its joins."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _ops(plan.initialPlan())
    kids = plan.children()
    return [plan.simpleString(99)] + ([] if "Join" in plan.nodeName() else [x for k in range(kids.size()) for x in _ops(kids.apply(k))])


def test_pairs_are_not_shuffled(spark):
    """No exchange stands above the joins that make pairs, and partners of a recording come in order of time, so that written pairs are small."""
    base = dt.datetime(2020, 1, 1)
    rows = [(k, base + dt.timedelta(seconds=97 * k % 3000), base + dt.timedelta(seconds=97 * k % 3000 + 4000), True) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, start timestamp_ntz, end timestamp_ntz, valid boolean").repartition(8)
    pairs = O.overlaps(df, df)
    for found in (pairs, O.full_overlaps(df, df)):
        names = _ops(found._jdf.queryExecution().executedPlan())
        joins = [x for x in names if "Join" in x.split(" ")[0]]
        assert len(joins) == 2 and all("bucket" in x for x in joins) and not any("Exchange" in x for x in names), names
    start, partners = {r[0]: r[1] for r in rows}, {}
    for p in pairs.collect():
        partners.setdefault(p.tx_id, []).append(start[p.rx_id])
    assert len(partners) == 300 and all(x == sorted(x) for x in partners.values())


def test_codes_over_many_parts(spark):
    names = [f"s{k * 7919 % 1000:03d}" for k in range(1000)] + [None, "s005"]
    got = C.coded(spark.createDataFrame([(n,) for n in names], "station string").repartition(16), "station", "code").collect()
    assert len(got) == len(names) and all(r.code == (None if r.station is None else int(r.station[1:])) for r in got)
    assert C.coded(spark.createDataFrame([], "station string"), "station", "code").count() == 0


def test_points_between_knots(spark):
    """Straight lines by hand; a point's columns keep their names and order, and no array holds a key's knots."""
    from coilwave.operators import catalog as C

    knots = {1: [(0.0, 1.0), (2.0, 5.0), (3.0, 4.0)], 2: [(1.0, 7.0)], 3: []}
    table = spark.createDataFrame([(k, x, y) for k, own in knots.items() for x, y in own] + [(None, 1.0, 9.0), (1, 2.0, 6.0), (1, None, 3.0)], "k int, f double, m double")
    points = [(i, k, x) for i, (k, x) in enumerate([(k, x) for k in (1, 2, 3, None) for x in (-1.0, 0.0, 1.5, 2.0, 2.5, 3.0, 9.0, None)] * 3)]
    df = C.interpolated(spark.createDataFrame(points, "id int, k int, f double"), table, ["k"], "f", "m", "out")
    assert df.columns == ["id", "k", "f", "out"] and "collect_list" not in df._jdf.queryExecution().toString()

    def line(k, x):
        own = knots.get(k) or []
        if x is None or not own:
            return None
        if len(own) == 1:
            return own[0][1]
        j = max([i for i, p in enumerate(own[:-1]) if p[0] <= x], default=0)
        (a, b), (c, d) = own[j], own[j + 1]
        return b + (d - b) * (x - a) / (c - a)

    got = {r["id"]: r["out"] for r in df.collect()}
    assert got == {i: pytest.approx(line(k, x)) if line(k, x) is not None else None for i, k, x in points}


def test_periods_as_columns(spark):
    """Robust means and offsets of series of several periods in one plan are those of each period by itself."""
    rng = np.random.default_rng(12)
    rows = [(k, i, float(np.where(i // (n // 2) % 2 == 0, 3.0, -3.0) + rng.normal()), n) for k, (n, m) in enumerate([(4, 83), (5, 61), (8, 200), (9, 8), (2, 1), (7, 7)]) for i in range(m)]
    df = spark.createDataFrame(rows, "k int, i int, v double, n long")
    got = {(r.k, r.i): r.mean for r in S.robust_running_mean(df, ["k"], ["i"], "v", F.col("n"), 0.1).collect()}
    offsets = {r.k: r.offset for r in S.on_time_offset(df, ["k"], ["i"], "v", F.col("n")).collect()}
    assert len(got) == len(rows)
    for k, n in {(r[0], r[3]) for r in rows}:
        own = df.where(F.col("k") == k)
        for r in S.robust_running_mean(own, ["k"], ["i"], "v", n, 0.1).collect():
            assert got[k, r.i] == (r.mean if r.mean is None else pytest.approx(r.mean, abs=1e-9)), (k, r.i)
        assert [o for j, o in offsets.items() if j == k] == [r.offset for r in S.on_time_offset(own, ["k"], ["i"], "v", n).collect()]
    assert got[3, 0] is None and got[5, 3] is not None


@pytest.mark.parametrize("n", [5, 64, 65, 101])
def test_medians_of_known_samples(spark, n):
    """Narrow and wide frames by hand: missing samples, repeated values, frames of missing samples only, whole numbers."""
    rng = np.random.default_rng(13)
    x = rng.integers(0, 9, 300).astype(float)
    x[rng.random(300) < 0.3] = np.nan
    x[100:230] = np.nan
    rows = [(1, i, None if np.isnan(v) and i % 2 else float(v), None if np.isnan(v) else int(v)) for i, v in enumerate(x)] + [(2, 0, 4.0, 4), (None, 0, None, None)]
    df = spark.createDataFrame(rows, "k int, i int, v double, w int").repartition(4)
    got = S.running_median(S.running_median(df, ["k"], ["i"], "v", n), ["k"], ["i"], "w", n, "whole")
    assert dict(got.dtypes)["whole"] == "int" and got.columns == ["k", "i", "v", "w", "median", "whole"]
    found = {(r.k, r.i): (r.median, r.whole) for r in got.collect()}
    assert found[2, 0] == (4.0, 4) and found[None, 0] == (None, None)
    for i in range(300):
        seen = np.sort(x[max(0, i - n + 1) : i + 1][~np.isnan(x[max(0, i - n + 1) : i + 1])])
        want = seen[len(seen) // 2] if len(seen) else None
        assert found[1, i] == (want, None if want is None else int(want))


def test_ends_of_fractional_means(spark):
    x = np.random.default_rng(14).normal(size=20)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(2, 0, 1.0)], "k int, i int, v double")
    got = {(r.k, r.i): r.mean for r in S.running_mean_fractional(df, ["k"], ["i"], "v", 4.5, edges="same").collect()}
    full = [(x[i - 1 : i + 2].sum() + 0.75 * (x[i - 2] + x[i + 2])) / 4.5 for i in range(2, 18)]
    assert [got[1, i] for i in range(20)] == pytest.approx([full[0]] * 2 + full + [full[-1]] * 2) and got[2, 0] is None


def test_half_a_calibration_corrects_nothing(spark):
    """Boards with eight points and with fewer: the first divides, the second leaves its coefficients and says so."""
    from coilwave.sources import calibrations as B

    cal = spark.createDataFrame([(k, float(2**j), 2.0, 0.0) for k, n in (("whole", 9), ("few", 5)) for j in range(n)], "box string, f double, mag double, phase double")
    fc = spark.createDataFrame([(k, 8.0, 6.0, -2.0) for k in ("whole", "few", "none", None)], "box string, f double, re double, im double")
    got = {r.box: (r.ok, r.re, r.im) for r in B.board_corrected(fc, cal, ["box"], "ok").collect()}
    assert got["whole"] == (True, pytest.approx(3.0), pytest.approx(-1.0)) and all(got[k] == (False, 6.0, -2.0) for k in ("few", "none", None))


def test_a_waveform_goes_and_a_step_stays(spark):
    """A hum of 40.5 samples beside a slow drift: the hum goes, also where edges are masked; all masked, nothing goes."""
    i = np.arange(400)
    drift = i / 10_000
    x = drift + np.sin(2 * np.pi * i / 40.5) + 0.4 * np.cos(4 * np.pi * i / 40.5)
    rows = [(1, int(a), float(v), bool(a % 50 < 5)) for a, v in zip(i, x, strict=True)] + [(2, int(a), float(v), True) for a, v in zip(i, x, strict=True)] + [(3, 0, 1.5, False)]
    df = spark.createDataFrame(rows, "k int, i int, v double, near boolean")
    got = {(r.k, r.i): r.f for r in S.waveform_filtered(df, ["k"], ["i"], "v", 40.5, 7, 100, "f", masked="near").collect()}
    assert len(got) == len(rows)
    assert max(abs(got[1, a] - drift[a]) for a in range(10, 390)) < 0.05
    assert all(got[2, a] == x[a] for a in range(400)) and got[3, 0] == 1.5
