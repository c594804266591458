"""Queries of single steps (cleaning, times, tapers, windows, spectra of whole series), each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coilwave.functions import geometry as G
from coilwave.functions import timeconv as T
from coilwave.operators import catalog as C
from coilwave.operators import fourier as R
from coilwave.operators import pairs as P
from coilwave.operators import series as S
from coilwave.operators import spectral as X
from coilwave.plans.tables import ORDER, OVER, RESAMPLED, events, rounded, table
from coilwave.sources import calibrations as B
from coilwave.sources import catalogs as M


def _recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as recordings of up to 100 records, some without an end, a station or a valid header."""
    k = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, folder, "orders").select(
        k, F.col("o_custkey"), (k % 5 != 0).alias("valid"), F.when(k % 7 == 0, 256.0).otherwise(4096.0).alias("sampling_rate"), (k % 100).alias("num_records"),
        F.when(k % 3 > 0, F.concat(F.lit("s"), (k % 10).cast("string"))).alias("station"), F.element_at(F.array(*map(F.lit, ("Ex", "Ey", "Hz", "TX"))), (k % 4 + 1).cast("int")).alias("component"),
        start.alias("start"), F.when(k % 11 != 0, start + F.make_dt_interval(days=(k % 10).cast("int"))).alias("end"),
    )


def usable_recordings(spark: SparkSession, folder: str) -> DataFrame:
    return C.usable(_recordings(spark, folder)).select("o_orderkey", "station")


def recordings_in_range(spark: SparkSession, folder: str) -> DataFrame:
    least_end, most_start = (F.lit(x).cast("timestamp_ntz") for x in ("1995-03-01 00:00:00", "1996-03-01 00:00:00"))
    return _recordings(spark, folder).select("o_orderkey", C.in_range(F.col("start"), F.col("end"), least_end, most_start).alias("in_range"))


def component_span(spark: SparkSession, folder: str) -> DataFrame:
    """One component, within a span of keys of which both ends belong to it."""
    return M.in_span(M.of_component(_recordings(spark, folder), "Hz"), "o_orderkey", 102, 4102).select("o_orderkey", "component")


def recordings_left(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings less those that were picked: all of customers whose number is divisible by 4."""
    own = _recordings(spark, folder)
    return M.without(own, own.where("o_custkey % 4 = 0"), ["o_custkey"]).select("o_orderkey", "o_custkey")


def unique_names(spark: SparkSession, folder: str) -> DataFrame:
    return M.assert_unique(table(spark, folder, "nation").select("n_name", "n_regionkey"), "n_name")


def mean_locations(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    own = table(spark, folder, "customer").select("c_nationkey", F.when(k % 6 > 0, k % 50 + 0.5).alias("x"), F.when(k % 6 > 0, k % 30 - 0.25).alias("y"))
    return rounded(M.mean_locations(own, ["c_nationkey"]), "x", "y")


def summed_calibrations(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    own = table(spark, folder, "customer").select(F.col("c_nationkey").alias("box"), (k % 5 * 2 + 1).alias("harmonic"), (k / 4).alias("mag"), (k % 9 - 4.0).alias("phase"))
    return rounded(M.summed_calibrations(own, ["box", "harmonic"], ["mag", "phase"]), "mag", "phase")


def steady_files(spark: SparkSession, folder: str) -> DataFrame:
    own = S.indexed(events(spark, folder), ["user_id"], ORDER, "record_no")
    return C.steady(own.select(F.col("user_id").alias("file"), "record_no", (F.col("record_no") + F.when((F.col("user_id") % 3 == 0) & (F.col("record_no") > 5), 2).otherwise(0)).alias("gps_second")))


def _gappy(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def gap_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.gap_statistics(_gappy(spark, folder), ["user_id"], ORDER, "value"), "share")


def winsorize_gappy(spark: SparkSession, folder: str) -> DataFrame:
    return S.winsorize(_gappy(spark, folder), ["user_id"], "value", 0.125, ["event_id"]).select("event_id", "clipped")


def robust_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.robust_running_mean(events(spark, folder), ["user_id"], ORDER, "value", 8, 0.25).select("event_id", "mean"), "mean")


def windowed_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.windowed_mean(_gappy(spark, folder), ["user_id"], ORDER, "value", [1, 2, 4]).select("event_id", "mean"), "mean")


def windowed_mean_masked(spark: SparkSession, folder: str) -> DataFrame:
    own = events(spark, folder).withColumn("use", F.col("event_id") % 3 / 2)
    return rounded(S.windowed_mean(own, ["user_id"], ORDER, "value", [1, 2, 3, 2, 1], mask="use").select("event_id", "mean"), "mean")


def reshape_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return S.reshaped(events(spark, folder), ["user_id"], ORDER, "value", 8)


def reshape_padded(spark: SparkSession, folder: str) -> DataFrame:
    return S.reshaped(events(spark, folder), ["user_id"], ORDER, "value", 8, shift=3, keep=True)


def unresample(spark: SparkSession, folder: str) -> DataFrame:
    own = events(spark, folder)
    sizes = own.groupBy("user_id").agg(F.count("*").alias("n"))
    return rounded(S.unresampled(S.resampled(own, ["user_id"], ORDER, "value", 6.5, 8, 3.0), ["user_id"], sizes, 6.5, 8, 3.0), "value")


def running_waveform(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.running_waveform(events(spark, folder), ["user_id"], ORDER, "value", 6.5, 8, 3, 3.0), "value", digits=9)


def series_spectrum(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(R.spectrum(events(spark, folder), ["user_id"], ORDER, "value"), "re", "im", digits=5)


def spectrum_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(R.series_of(R.spectrum(events(spark, folder), ["user_id"], ORDER, "value"), ["user_id"]), "value", digits=5)


def embedding_harmonics(spark: SparkSession, folder: str) -> DataFrame:
    """Bins 1, 3, 5, 7 and 9 of each vector."""
    long = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("i", "v"))
    own = long.select("id", "i", F.col("v").cast("double").alias("v"), F.explode(F.array(*[F.lit(h) for h in (1, 3, 5, 7, 9)])).alias("bin"))
    return rounded(X.dft_bin(own, ["id", "bin"], "i", "v", F.col("bin") / 64), "re", "im", digits=5)


def window_ratios(spark: SparkSession, folder: str) -> DataFrame:
    own = S.indexed(events(spark, folder), ["user_id"], ORDER).withColumn("rx", (F.col("event_id") % 23).cast("double"))
    return rounded(P.window_ratios(own, ["user_id"], "i", "value", "rx", 8, 1 / 8), "re", "im", digits=4)


def postdarken(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    re, im = X.postdarkened(((k % 7).cast("double"), (k % 5).cast("double")), (k % 31 + 1) / F.lit(64.0))
    return rounded(table(spark, folder, "customer").select("c_custkey", re.alias("re"), im.alias("im")), "re", "im")


def sinusoids(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    wave = X.sinusoid((k % 7).cast("double"), (k % 5).cast("double"), 0.1, 6)
    return rounded(table(spark, folder, "supplier").select("s_suppkey", F.posexplode(wave).alias("i", "value")), "value")


def tapers(spark: SparkSession, folder: str) -> DataFrame:
    """Tapers of each kind and of an even and an odd length, for each region."""
    own = table(spark, folder, "region")
    parts = [own.select("r_regionkey", F.lit(n).alias("size"), F.lit(mode).alias("mode"), F.posexplode(X.hat(n, mode)).alias("i", "weight")) for n in (6, 9) for mode in ("center", "left", "right")]
    return rounded(reduce(DataFrame.union, parts), "weight")


def _angles(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(k, *[(F.pmod(k * m, F.lit(20)) + 25).cast("double").alias(n) for n, m in (("a", 3), ("b", 7), ("c", 11))])


def inclinations(spark: SparkSession, folder: str) -> DataFrame:
    a, b, c = G.corrected_inclinations(F.col("a"), F.col("b"), F.col("c"), "deg")
    return rounded(_angles(spark, folder).select("p_partkey", a.alias("a"), b.alias("b"), c.alias("c")), "a", "b", "c")


def rotate_back(spark: SparkSession, folder: str) -> DataFrame:
    m = G.transposed(G.triaxial_to_geomagnetic(F.col("a"), F.col("b"), F.col("c"), "deg"))
    x, y, z = G.applied(m, F.lit(100.0), F.col("b"), F.lit(-30.0))
    return rounded(_angles(spark, folder).select("p_partkey", x.alias("x"), y.alias("y"), z.alias("z")), "x", "y", "z")


def ordinal_times(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select("o_orderkey", T.ordinal_to_utc(k % 20000 + 719163 + k % 4 / 4).cast("timestamp_ntz").alias("utc"))


def local_from_week(spark: SparkSession, folder: str) -> DataFrame:
    own = events(spark, folder).withColumn("sec", F.pmod(F.col("event_id") * 7919, F.lit(604_800)).cast("long"))
    own = S.week_numbers(own, ["user_id"], ["event_id"], "sec", 1900)
    return own.select("event_id", T.week_seconds_to_local(F.col("week"), F.col("sec") + F.lit(0.25)).alias("local"))


def start_and_end(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    start, end = T.start_and_end(F.pmod(k * 7919, F.lit(604_800)) * 1024, F.pmod(k * 7919 + 90_000, F.lit(604_800)) * 1024, F.lit(2000), F.lit(4096.0))
    return table(spark, folder, "orders").select("o_orderkey", start.cast("timestamp_ntz").alias("start"), end.cast("timestamp_ntz").alias("end"))


def sample_times(spark: SparkSession, folder: str) -> DataFrame:
    own = _recordings(spark, folder).where("end is not null")
    times = F.posexplode(T.sample_times(F.col("start"), F.col("end"), F.col("o_orderkey") % 5 + 1))
    return own.select("o_orderkey", times.alias("i", "at")).withColumn("at", F.col("at").cast("timestamp_ntz"))


def text_parts(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("box "), F.col("s_suppkey").cast("string"), F.lit("b"))
    xyz = C.offsets(F.concat_ws(":", F.col("s_suppkey").cast("string"), F.lit("-2.5"), F.when(F.col("s_suppkey") % 3 > 0, "7").otherwise("none")))
    return table(spark, folder, "supplier").select("s_suppkey", C.digits(name).alias("number"), C.without_digits(name).alias("letters"), F.right(name, F.lit(1)).alias("last"), xyz["dx"].alias("dx"), xyz["dy"].alias("dy"), xyz["dz"].alias("dz"))


def unwrap_by_delay(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    own = table(spark, folder, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("k"), (k + 1.0).alias("f"), F.pmod(k * 37, F.lit(3000)).cast("double").alias("phase"))
    return rounded(B.unwrapped_by_delay(own, ["k"], "f", "phase").select("c_custkey", "unwrapped"), "unwrapped", digits=4)


QUERIES = {
    f.__name__: f
    for f in (
        usable_recordings, recordings_in_range, component_span, recordings_left, unique_names, mean_locations, summed_calibrations, steady_files, gap_statistics, winsorize_gappy,
        robust_mean, windowed_mean, windowed_mean_masked, reshape_cycles, reshape_padded, unresample, running_waveform, series_spectrum, spectrum_round_trip, embedding_harmonics,
        window_ratios, postdarken, sinusoids, tapers, inclinations, rotate_back, ordinal_times, local_from_week, start_and_end, sample_times, text_parts, unwrap_by_delay,
    )
}

_RECORDINGS = """r AS (SELECT o_orderkey, o_custkey, o_orderkey % 5 <> 0 AS valid, CASE WHEN o_orderkey % 7 = 0 THEN 256 ELSE 4096 END AS rate, o_orderkey % 100 AS records,
    CASE WHEN o_orderkey % 3 > 0 THEN 's' || o_orderkey % 10 END AS station, ['Ex', 'Ey', 'Hz', 'TX'][o_orderkey % 4 + 1] AS component,
    o_orderdate::TIMESTAMP AS s, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::TIMESTAMP + to_days((o_orderkey % 10)::INTEGER) END AS e FROM orders)"""
_SERIES = f"s AS (SELECT event_id, user_id, value AS v, row_number() {OVER} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_GAPPY = _SERIES.replace("value AS v", "CASE WHEN event_id % 7 <> 0 THEN value END AS v")
#: Cells with those of a period further in repeated beyond either end, read at the samples.
_READ_BACK = """
    b AS MATERIALIZED (SELECT *, min(p) OVER (PARTITION BY user_id) AS lo, max(p) OVER (PARTITION BY user_id) AS hi FROM c),
    a AS MATERIALIZED (SELECT user_id, p, v FROM b UNION ALL SELECT user_id, p - 8, v FROM b WHERE p < lo + 8 UNION ALL SELECT user_id, p + 8, v FROM b WHERE p > hi - 8),
    z AS MATERIALIZED (SELECT user_id, i, (i + 3) / 0.8125::DOUBLE AS t, floor((i + 3) / 0.8125::DOUBLE)::BIGINT AS f FROM s)
    SELECT z.user_id, i, round(CASE WHEN t = floor(t) THEN x.v ELSE x.v + (y.v - x.v) * (t - floor(t)) END, {digits}) + 0.0 AS value
    FROM z JOIN a x ON x.user_id = z.user_id AND x.p = z.f LEFT JOIN a y ON y.user_id = z.user_id AND y.p = z.f + 1
"""
_ANGLES = "p AS (SELECT p_partkey, sin(radians(p_partkey * 3 % 20 + 25)) AS a, sin(radians(p_partkey * 7 % 20 + 25)) AS b, sin(radians(p_partkey * 11 % 20 + 25)) AS c, (p_partkey * 7 % 20 + 25)::DOUBLE AS y FROM part), t AS (SELECT *, sqrt(a * a + b * b + c * c) AS r FROM p)"
ORACLE = {
    "usable_recordings": f"WITH {_RECORDINGS} SELECT o_orderkey, station FROM r WHERE valid AND rate <> 256 AND records >= 30 AND station IS NOT NULL",
    "recordings_in_range": f"WITH {_RECORDINGS} SELECT o_orderkey, e IS NOT NULL AND e > TIMESTAMP '1995-03-01' AND s < TIMESTAMP '1996-03-01' AS in_range FROM r",
    "component_span": f"WITH {_RECORDINGS} SELECT o_orderkey, component FROM r WHERE component = 'Hz' AND o_orderkey >= 102 AND o_orderkey <= 4102",
    "recordings_left": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 4 <> 0",
    "unique_names": "SELECT n_name, n_regionkey FROM nation",
    "mean_locations": "SELECT c_nationkey, count(*) FILTER (c_custkey % 6 > 0) AS n, round(avg(c_custkey % 50 + 0.5::DOUBLE) FILTER (c_custkey % 6 > 0), 6) + 0.0 AS x, round(avg(c_custkey % 30 - 0.25::DOUBLE) FILTER (c_custkey % 6 > 0), 6) + 0.0 AS y FROM customer GROUP BY c_nationkey",
    "summed_calibrations": "SELECT c_nationkey AS box, c_custkey % 5 * 2 + 1 AS harmonic, round(sum(c_custkey / 4::DOUBLE), 6) + 0.0 AS mag, round(sum(c_custkey % 9 - 4.0::DOUBLE), 6) + 0.0 AS phase FROM customer GROUP BY 1, 2",
    "steady_files": "SELECT user_id AS file, NOT (user_id % 3 = 0 AND count(*) > 6) AS steady FROM events GROUP BY user_id",
    "gap_statistics": f"""
        WITH {_GAPPY}, g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM s WHERE v IS NOT NULL),
        r AS (SELECT user_id, min(i) AS first, count(*) AS n FROM g GROUP BY user_id, g), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM r),
        t AS (SELECT user_id, count(*) AS n, count(*) FILTER (v IS NULL) AS n_missing FROM s GROUP BY user_id)
        SELECT t.user_id, t.n, n_missing, round(n_missing / t.n, 6) + 0.0 AS share, k.first, coalesce(k.n, 0) AS n_free FROM t LEFT JOIN k ON k.user_id = t.user_id AND k.k = 1
    """,
    "winsorize_gappy": f"""
        WITH {_GAPPY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS c FROM s WHERE v IS NOT NULL),
        b AS (SELECT user_id, max(v) FILTER (r = floor(0.125::DOUBLE * c)) AS lo, max(v) FILTER (r = c - floor(0.125::DOUBLE * c) - 1) AS hi FROM r GROUP BY user_id)
        SELECT event_id, CASE WHEN v IS NOT NULL THEN greatest(lo, least(hi, v)) END AS clipped FROM s LEFT JOIN b USING (user_id)
    """,
    "robust_mean": f"""
        WITH {_SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, i % 8 ORDER BY v, i) - 1 AS r, count(*) OVER (PARTITION BY user_id, i % 8) AS c FROM s),
        b AS (SELECT user_id, i % 8 AS phase, max(v) FILTER (r = floor(c / 4)) AS lo, max(v) FILTER (r = c - floor(c / 4) - 1) AS hi FROM r GROUP BY user_id, i % 8),
        w AS (SELECT event_id, s.user_id, i, n, greatest(lo, least(hi, v)) AS v FROM s JOIN b ON b.user_id = s.user_id AND b.phase = s.i % 8),
        m AS (SELECT *, avg(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) AS x FROM w)
        SELECT a.event_id, round(b.x, 6) + 0.0 AS mean FROM m a LEFT JOIN m b ON b.user_id = a.user_id AND a.n >= 8 AND b.i = least(greatest(a.i, 4), a.n - 4)
    """,
    "windowed_mean": f"""
        WITH {_GAPPY} SELECT a.event_id, round(sum(b.v * CASE b.i - a.i WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 4 END) / sum(CASE WHEN b.v IS NULL THEN 0 WHEN b.i - a.i = 1 THEN 1 WHEN b.i = a.i THEN 2 ELSE 4 END), 6) + 0.0 AS mean
        FROM s a JOIN s b ON b.user_id = a.user_id AND b.i BETWEEN a.i - 1 AND a.i + 1 GROUP BY a.event_id
    """,
    "windowed_mean_masked": f"""
        WITH {_SERIES} SELECT a.event_id, round(sum(b.v * (b.event_id % 3 / 2) * (3 - abs(a.i - b.i))) / nullif(sum((b.event_id % 3 / 2) * (3 - abs(a.i - b.i))), 0), 6) + 0.0 AS mean
        FROM s a JOIN s b ON b.user_id = a.user_id AND b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY a.event_id
    """,
    "reshape_cycles": f"WITH {_SERIES} SELECT user_id, (i - n % 8) // 8 AS cycle, ((i - n % 8) % 8)::INTEGER AS phase, v AS value FROM s WHERE i >= n % 8",
    "reshape_padded": f"""
        WITH {_SERIES}, p AS (SELECT user_id, unnest(range((max(n) + 12) // 8 * 8)) AS p FROM s GROUP BY user_id)
        SELECT p.user_id, p // 8 AS cycle, (p % 8)::INTEGER AS phase, v AS value FROM p LEFT JOIN s ON s.user_id = p.user_id AND s.i = p.p - 5
    """,
    "unresample": f"WITH {RESAMPLED}, c AS (SELECT user_id, cycle * 8 + phase AS p, value AS v FROM q), {_READ_BACK.format(digits=6)}",
    "running_waveform": f"""
        WITH {RESAMPLED}, c AS (SELECT x.user_id, x.cycle * 8 + x.phase AS p, sum(y.value * CASE WHEN y.cycle = x.cycle THEN 1 ELSE 0.5::DOUBLE END) / sum(CASE WHEN y.cycle = x.cycle THEN 1 ELSE 0.5::DOUBLE END) AS v
            FROM q x JOIN q y ON y.user_id = x.user_id AND y.phase = x.phase AND y.cycle BETWEEN x.cycle - 1 AND x.cycle + 1 GROUP BY x.user_id, x.cycle, x.phase), {_READ_BACK.format(digits=9)}
    """,
    "series_spectrum": f"""
        WITH {_SERIES}, k AS (SELECT user_id, unnest(range(max(n) // 2 + 1)) AS k FROM s GROUP BY user_id)
        SELECT user_id, n, k, round(sum(v * cos(2 * pi() * (k * i % n) / n)), 5) + 0.0 AS re, round(-sum(v * sin(2 * pi() * (k * i % n) / n)), 5) + 0.0 AS im FROM s JOIN k USING (user_id) GROUP BY user_id, n, k
    """,
    "spectrum_round_trip": f"WITH {_SERIES} SELECT user_id, i, round(v, 5) + 0.0 AS value FROM s",
    "embedding_harmonics": """
        WITH s AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings)
        SELECT id, bin::INTEGER AS bin, count(*) AS n, round(sum(v * cos(2 * pi() * i * bin / 64)), 5) + 0.0 AS re, round(-sum(v * sin(2 * pi() * i * bin / 64)), 5) + 0.0 AS im FROM s, (VALUES (1), (3), (5), (7), (9)) b(bin) GROUP BY id, bin
    """,
    "window_ratios": f"""
        WITH {_SERIES}, w AS (SELECT user_id, i // 8 AS win, sum(v * cos(pi() * (i % 8) / 4)) AS tr, -sum(v * sin(pi() * (i % 8) / 4)) AS ti, sum((event_id % 23) * cos(pi() * (i % 8) / 4)) AS rr, -sum((event_id % 23) * sin(pi() * (i % 8) / 4)) AS ri
            FROM s GROUP BY user_id, i // 8 HAVING count(*) = 8)
        SELECT user_id, win, round((rr * tr + ri * ti) / (tr * tr + ti * ti), 4) + 0.0 AS re, round((ri * tr - rr * ti) / (tr * tr + ti * ti), 4) + 0.0 AS im FROM w
    """,
    "postdarken": """
        WITH c AS (SELECT c_custkey, (c_custkey % 7)::DOUBLE AS re, (c_custkey % 5)::DOUBLE AS im, cos(2 * pi() * (c_custkey % 31 + 1) / 64) - 1 AS a, sin(2 * pi() * (c_custkey % 31 + 1) / 64) AS b FROM customer)
        SELECT c_custkey, round((re * a + im * b) / (a * a + b * b), 6) + 0.0 AS re, round((im * a - re * b) / (a * a + b * b), 6) + 0.0 AS im FROM c
    """,
    "sinusoids": "SELECT s_suppkey, i::INTEGER AS i, round(((s_suppkey % 7) * cos(2 * pi() * i / 10) - (s_suppkey % 5) * sin(2 * pi() * i / 10)) / 3, 6) + 0.0 AS value FROM supplier, range(6) t(i)",
    "tapers": """
        WITH t AS (SELECT r_regionkey, size::INTEGER AS size, mode, i::INTEGER AS i, (i + 1) / ((size + 1) / 2) AS rise, (size - i) / ((size + 1) / 2) AS fall FROM region, (VALUES (6), (9)) s(size), (VALUES ('center'), ('left'), ('right')) m(mode), range(9) g(i) WHERE i < size)
        SELECT r_regionkey, size, mode, i, round(CASE WHEN mode = 'right' THEN least(1, fall) WHEN mode = 'left' THEN least(1, rise) ELSE least(rise, fall) END, 6) + 0.0 AS weight FROM t
    """,
    "inclinations": f"WITH {_ANGLES} SELECT p_partkey, round(degrees(asin(a / r)), 6) + 0.0 AS a, round(degrees(asin(b / r)), 6) + 0.0 AS b, round(degrees(asin(c / r)), 6) + 0.0 AS c FROM t",
    "rotate_back": f"""
        WITH {_ANGLES}, u AS (SELECT p_partkey, y, a / r AS u, b / r AS v, c / r AS w, sqrt(b * b + c * c) / r AS f FROM t)
        SELECT p_partkey, round(-100 * f - 30 * u, 6) + 0.0 AS x, round(100 * u * v / f - y * w / f - 30 * v, 6) + 0.0 AS y, round(100 * u * w / f + y * v / f - 30 * w, 6) + 0.0 AS z FROM u
    """,
    "ordinal_times": "SELECT o_orderkey, make_timestamp((o_orderkey % 20000) * 86400000000 + (o_orderkey % 4) * 21600000000) AS utc FROM orders",
    "local_from_week": """
        WITH s AS (SELECT event_id, user_id, event_id * 7919 % 604800 AS sec FROM events), f AS (SELECT *, CASE WHEN lag(sec) OVER (PARTITION BY user_id ORDER BY event_id) > sec + 600000 THEN 1 ELSE 0 END AS f FROM s),
        w AS (SELECT *, 1900 + sum(f) OVER (PARTITION BY user_id ORDER BY event_id) AS week FROM f)
        SELECT event_id, (make_timestamp(((315964800 + week * 604800 - 18 + sec) * 1000000 + 250000)::BIGINT) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Denver' AS local FROM w
    """,
    "start_and_end": """
        WITH r AS (SELECT o_orderkey, o_orderkey * 7919 % 604800 AS a, (o_orderkey * 7919 + 90000) % 604800 AS b FROM orders)
        SELECT o_orderkey, make_timestamp((315964800 + 2000 * 604800::BIGINT - 18 + a) * 1000000) AS start, make_timestamp((315964800 + (2000 + CASE WHEN b < a THEN 1 ELSE 0 END) * 604800::BIGINT - 18 + b) * 1000000 + 999756) AS "end" FROM r
    """,
    "sample_times": f"""
        WITH {_RECORDINGS}, i AS (SELECT o_orderkey, s, e, o_orderkey % 5 + 1 AS n, unnest(range(o_orderkey % 5 + 1)) AS i FROM r WHERE e IS NOT NULL)
        SELECT o_orderkey, i::INTEGER AS i, make_timestamp(epoch_us(s) + round(i * ((epoch_us(e) - epoch_us(s)) / greatest(n - 1, 1)))::BIGINT) AS at FROM i
    """,
    "text_parts": "SELECT s_suppkey, s_suppkey AS number, 'box b' AS letters, 'b' AS last, s_suppkey::DOUBLE AS dx, -2.5::DOUBLE AS dy, CASE WHEN s_suppkey % 3 > 0 THEN 7::DOUBLE END AS dz FROM supplier",
    "unwrap_by_delay": """
        WITH c AS (SELECT c_custkey, c_nationkey % 5 AS k, c_custkey + 1::DOUBLE AS f, (c_custkey * 37 % 3000)::DOUBLE / 1000 AS p FROM customer),
        d AS (SELECT *, first_value(p / f) OVER (PARTITION BY k ORDER BY f) AS d, row_number() OVER (PARTITION BY k ORDER BY f) AS j, count(*) OVER (PARTITION BY k) AS n FROM c),
        r AS (SELECT *, p - d * f + pi() / 2 - floor((p - d * f + pi() / 2) / pi()) * pi() - pi() / 2 AS r FROM d),
        l AS (SELECT k, regr_slope(r, f) AS slope, regr_intercept(r, f) AS cut FROM r WHERE j <= n // 4 GROUP BY k)
        SELECT c_custkey, round((p - round((p - (d + slope) * f - cut) / pi()) * pi()) * 1000, 4) + 0.0 AS unwrapped FROM r LEFT JOIN l USING (k)
    """,
}
