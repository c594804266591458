"""Queries over the whole way from records to transfer functions, and over calibration texts that are written from suppliers.

A user's events are a recording of 16 samples a second; users 2k (transmitter) and 2k + 1 (receiver) are pair k."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coilwave.operators import pairs as P
from coilwave.operators import series as S
from coilwave.plans import whole
from coilwave.plans.tables import ORDER, OVER, events, rounded, table
from coilwave.sources import calibrations as B
from coilwave.tables import shared_dir

RATE, CLIPPED = 16, 220.0
#: What is notched here: a hum below half the sampling rate.
HUM, BANDWIDTH = 3.0, 0.5
BEGIN = "2024-01-01 00:00:00"
#: Suppliers of a calibration file.
CARDS = 20


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """(path, time, values); every seventh event is a missing sample."""
    own = S.indexed(events(spark, folder), ["user_id"], ORDER).withColumn("record", F.floor(F.col("i") / RATE))
    sample = F.struct("i", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    rows = own.groupBy("user_id", "record").agg(F.transform(F.array_sort(F.collect_list(sample)), lambda x: x["v"]).alias("values"))
    return rows.select(F.concat(F.lit("u"), "user_id").alias("path"), _second(F.col("record")).alias("time"), "values")


def _second(k: F.Column) -> F.Column:
    return F.timestamp_micros(F.unix_micros(F.lit(BEGIN).cast("timestamp_ntz").cast("timestamp")) + k * 1_000_000)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth pair lasts until its longer recording ends, the others as long as whole records of both; the receiver of some has another rate."""
    sizes = events(spark, folder).groupBy("user_id").agg(F.count("*").alias("n"))
    even = F.col("user_id") % 2 == 0
    own = sizes.groupBy(F.floor(F.col("user_id") / 2).alias("pair")).agg(F.max(F.when(even, F.col("n"))).alias("nt"), F.max(F.when(~even, F.col("n"))).alias("nr")).where("nt is not null and nr is not null")
    last = F.when(F.col("pair") % 5 == 0, F.ceil(F.greatest("nt", "nr") / RATE)).otherwise(F.floor(F.least("nt", "nr") / RATE))
    unknown = [F.lit(None).cast("string").alias(f"{n}_{c}") for n in ("tx", "rx") for c in ("box", "card", "antenna", "component")]
    return own.select(
        "pair", F.concat(F.lit("u"), F.col("pair") * 2).alias("tx_path"), F.concat(F.lit("u"), F.col("pair") * 2 + 1).alias("rx_path"), _second(F.lit(0)).alias("start"), _second(last).alias("end"),
        F.lit(16.0).alias("tx_rate"), F.when(F.col("pair") % 11 == 3, 32.0).otherwise(16.2).alias("rx_rate"), F.when(F.col("pair") % 2 == 0, 2.0).otherwise(1.0).alias("frequency"), *unknown,
    )


def pair_results(spark: SparkSession, folder: str) -> DataFrame:
    """Problems, checks and least-squares transfer functions of all pairs: records side by side, filled, trimmed, less hum and drift, in windows of two cycles."""
    boards = spark.createDataFrame([], "box string, CARDSNX string, ADFREQ double, CALFREQ double, MAG double, PHASE double")
    antennas = spark.createDataFrame([], "antenna_sn string, base_frequency double, mag double, phz double")
    done = P.processed(_records(spark, folder), _pairs(spark, folder), boards, antennas, limits=(CLIPPED, CLIPPED), hum=HUM, notch_bandwidth=BANDWIDTH, notched_above=0.0)
    cells = [f"tf{h}_{part}_LS" for h in (1, 3) for part in ("real", "imag", "var")]
    return rounded(done.select("pair", "problem", "processed", "num_samples", "num_nans", "num_clips", "min_current", "max_current", "max_clipfree_tx_cycles", *cells), "min_current", "max_current", *cells)


def _boards(spark: SparkSession, folder: str) -> DataFrame:
    """Board calibrations written as texts, a box for every 20 suppliers, and read back: a line for a card and frequency, of which harmonics follow."""
    own = table(spark, folder, "supplier").select(F.floor(F.col("s_suppkey") / CARDS).alias("box"), F.col("s_suppkey").alias("card"), F.explode(F.array(*[F.lit(f) for f in (1, 8, 64)])).alias("f"))
    cells = [F.lit(1), F.lit(0), *[c for h in B.HARMONICS for c in (1 + F.col("card") % 7 * 0.25 + h * 0.125, F.when(F.col("card") % 5 != 0, -F.col("f") * h * 0.5 - F.col("card") % 3))]]
    line = F.concat_ws(",", F.col("card"), F.col("f"), F.lit(4096), *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])
    lines = own.groupBy("box").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    text = F.concat(F.lit("$CAL.VER,31\n$GDP.SN,"), F.col("box"), F.lit("\n\n"), F.col("lines"), F.lit("\n"))
    at = f"{shared_dir(spark)}/boards-{uuid.uuid4().hex}"
    lines.select("box", text.alias("text")).write.partitionBy("box").text(at)
    return B.boards(B.texts(spark, at))


def board_calibrations(spark: SparkSession, folder: str) -> DataFrame:
    return _boards(spark, folder).select("box", "CARDSNX", "ADFREQ", "CALFREQ", "MAG", "PHASE")


def antenna_calibrations(spark: SparkSession, folder: str) -> DataFrame:
    """Antenna calibrations written as texts of two blocks, a file for every 20 suppliers, and read back."""
    own = table(spark, folder, "supplier").select(F.floor(F.col("s_suppkey") / CARDS).alias("box"), F.col("s_suppkey").alias("card"))
    line = F.concat_ws("  ", F.col("card"), F.col("card") % 9 + 0.5, F.col("card") % 4 - 1.25, F.col("card") % 9 + 0.75, F.lit("*"))
    blocks = own.groupBy("box").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    text = F.concat_ws("\n", *[c for f in ("4.0", "15.8") for c in (F.lit(f"AMT antenna {f}"), F.col("lines"))])
    at = f"{shared_dir(spark)}/antennas-{uuid.uuid4().hex}"
    blocks.select("box", text.alias("text")).write.partitionBy("box").text(at)
    return B.antennas(B.texts(spark, at))


def calibrated_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients of suppliers' cards at frequencies below, between and above those of their boards' calibrations, and of cards without one."""
    own = table(spark, folder, "supplier").select(F.floor(F.col("s_suppkey") / CARDS).cast("string").alias("box"), F.col("s_suppkey").alias("card"), F.explode(F.array(*[F.lit(x) for x in (0.5, 3.0, 100.0, 1000.0)])).alias("f"))
    fc = own.select("box", F.col("card").cast("string").alias("CARDSNX"), F.lit(4096.0).alias("ADFREQ"), "f", (F.col("card") % 13 + 1.0).alias("re"), (F.col("f") / 10).alias("im"))
    cal = _boards(spark, folder).withColumnsRenamed({"CALFREQ": "f", "MAG": "mag", "PHASE": "phase"})
    got = B.board_corrected(fc, cal, ["box", "CARDSNX", "ADFREQ"], "corrected")
    return rounded(got.select("CARDSNX", "f", "corrected", "re", "im"), "re", "im")


QUERIES = {f.__name__: f for f in (pair_results, board_calibrations, antenna_calibrations, calibrated_coefficients)}

_CAL = f"""
    cal AS (SELECT (s_suppkey // {CARDS})::VARCHAR AS box, s_suppkey::VARCHAR AS CARDSNX, s_suppkey AS card, (f * h)::DOUBLE AS CALFREQ, (1 + s_suppkey % 7 * 0.25::DOUBLE + h * 0.125::DOUBLE)::DOUBLE AS MAG,
        CASE WHEN s_suppkey % 5 <> 0 THEN -f * h * 0.5::DOUBLE - s_suppkey % 3 END::DOUBLE AS PHASE
        FROM supplier, (VALUES (1), (8), (64)) a(f), (VALUES (1), (3), (5), (7), (9)) b(h))
"""


def _same(period: int) -> str:
    """The centred mean of a period, the nearest full one at the ends."""
    half = period // 2
    frame = f"(PARTITION BY user_id ORDER BY i ROWS BETWEEN {half} PRECEDING AND {half - 1} FOLLOWING)"
    return f"SELECT user_id, i, n, y, period, CASE WHEN count(*) OVER {frame} = {period} THEN avg(w) OVER {frame} END AS m FROM c WHERE period = {period}"


ORACLE = {
    "pair_results": f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, value, event_id % 7 = 0 AS hole, row_number() {OVER} - 1 AS i FROM events),
    u AS (SELECT user_id // 2 AS pair, max(n) FILTER (user_id % 2 = 0) AS nt, max(n) FILTER (user_id % 2 = 1) AS nr FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) GROUP BY user_id // 2),
    g AS MATERIALIZED (SELECT *, CASE WHEN pair % 11 = 3 THEN 'sampling rates differ' WHEN last <= 2 THEN 'no common records' WHEN pair % 5 = 0 AND nt <> nr THEN 'lengths differ' END AS problem,
        CASE WHEN pair % 2 = 0 THEN 8 ELSE 16 END AS period FROM (SELECT *, CASE WHEN pair % 5 = 0 THEN (greatest(nt, nr) + 15) // 16 ELSE least(nt, nr) // 16 END AS last FROM u WHERE nt IS NOT NULL AND nr IS NOT NULL)),
    l AS MATERIALIZED (SELECT pair, e.user_id, e.i - 32 AS i, CASE WHEN NOT hole THEN value END AS v FROM g JOIN e ON e.user_id // 2 = g.pair WHERE problem IS NULL AND e.i BETWEEN 32 AND 16 * last - 1),
    h AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS p, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM l),
    f AS MATERIALIZED (SELECT h.pair, h.user_id, h.i, h.v IS NULL AS hole, coalesce(h.v, a.v + (b.v - a.v) * (h.i - p) / (q - p)::DOUBLE, a.v, b.v) AS v FROM h LEFT JOIN l a ON a.user_id = h.user_id AND a.i = p LEFT JOIN l b ON b.user_id = h.user_id AND b.i = q),
    w AS MATERIALIZED (SELECT pair, i, bool_or(hole) AS hole, bool_or(abs(v) >= {CLIPPED}::DOUBLE) AS clip, max(v) FILTER (user_id % 2 = 0) AS tx FROM f GROUP BY pair, i),
    r AS (SELECT pair, min(i) AS first, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY pair ORDER BY i) AS run FROM w WHERE NOT clip) GROUP BY pair, run),
    k AS MATERIALIZED (SELECT w.pair, count(*) AS num_samples, count(*) FILTER (hole) AS num_nans, count(*) FILTER (clip) AS num_clips, min(tx) AS min_current, max(tx) AS max_current,
        coalesce((SELECT max(n) FROM r WHERE r.pair = w.pair), 0) AS free, (SELECT arg_min(first, 1000000 * -n + first) FROM r WHERE r.pair = w.pair) AS first FROM w GROUP BY w.pair),
    j AS MATERIALIZED (SELECT k.*, period, free / 16.0::DOUBLE * (16 / period) AS cycles, num_clips = 0 OR free / 16.0::DOUBLE * (16 / period) >= 3 AS enough FROM k JOIN g USING (pair)),
    z AS MATERIALIZED (SELECT user_id, CASE WHEN num_clips > 0 THEN i - first ELSE i END AS i, v, period, count(*) OVER (PARTITION BY user_id) AS n FROM f JOIN j USING (pair) WHERE enough AND (num_clips = 0 OR i BETWEEN first AND first + free - 1)),
    d AS MATERIALIZED (SELECT user_id, n, max(v) FILTER (i = 0) AS v0, max(v) FILTER (i = n - 1) AS v1 FROM z GROUP BY user_id, n),
    x AS MATERIALIZED (
        SELECT user_id, i + 9 AS i, n + 18 AS m, v AS x FROM z
        UNION ALL SELECT z.user_id, 9 - i, z.n + 18, 2 * v0 - v FROM z JOIN d USING (user_id) WHERE i BETWEEN 1 AND 9
        UNION ALL SELECT z.user_id, 2 * (z.n - 1) - i + 9, z.n + 18, 2 * v1 - v FROM z JOIN d USING (user_id) WHERE i BETWEEN z.n - 10 AND z.n - 2
    ), {whole.notch_pass("forth", "x", (HUM, float(RATE), BANDWIDTH))}, turned AS MATERIALIZED (SELECT user_id, m - 1 - i AS i, m, y AS x FROM forth), {whole.notch_pass("back", "turned", (HUM, float(RATE), BANDWIDTH))},
    y AS MATERIALIZED (SELECT z.user_id, z.i, z.n, period, y, row_number() OVER (PARTITION BY z.user_id, z.i % period ORDER BY y, z.i) - 1 AS o, count(*) OVER (PARTITION BY z.user_id, z.i % period) AS t
        FROM z JOIN back ON back.user_id = z.user_id AND back.i = back.m - 1 - (z.i + 9)),
    c AS MATERIALIZED (SELECT *, greatest(max(y) FILTER (o = floor(0.05::DOUBLE * t)) OVER p, least(max(y) FILTER (o = t - floor(0.05::DOUBLE * t) - 1) OVER p, y)) AS w FROM y WINDOW p AS (PARTITION BY user_id, i % period)),
    q AS MATERIALIZED ({_same(8)} UNION ALL {_same(16)}),
    s AS MATERIALIZED (SELECT q.user_id, q.i, q.period, q.y - coalesce(q.m, n.m) AS v FROM q LEFT JOIN q n ON n.user_id = q.user_id AND n.i = CASE WHEN q.i < q.period // 2 THEN q.period // 2 ELSE q.n - q.period // 2 END),
    b AS (SELECT user_id, period, win, v, i - win * (period // 2) AS p FROM (SELECT *, unnest(range(greatest(0, ceil((i - 2 * period + 1) / (period / 2)))::BIGINT, i // (period // 2) + 1)) AS win FROM s)),
    t AS MATERIALIZED (SELECT user_id // 2 AS pair, user_id % 2 AS side, win, harmonic, sum(v * g * cos(2 * pi() * harmonic * p / period)) / sum(g) AS re, -sum(v * g * sin(2 * pi() * harmonic * p / period)) / sum(g) AS im
        FROM (SELECT *, 0.5::DOUBLE - 0.5::DOUBLE * cos(pi() * p / period) AS g FROM b), (VALUES (1), (3)) a(harmonic) GROUP BY user_id, win, harmonic, period HAVING count(v) = 2 * period),
    o AS MATERIALIZED (SELECT a.pair, a.win, a.harmonic, a.re AS tr, a.im AS ti, b.re AS rr, b.im AS ri FROM t a JOIN t b ON a.pair = b.pair AND a.win = b.win AND a.harmonic = b.harmonic AND a.side = 0 AND b.side = 1),
    ls AS MATERIALIZED (SELECT pair, harmonic, count(*) AS n, sum(tr * tr + ti * ti) AS power, sum(tr * rr + ti * ri) / sum(tr * tr + ti * ti) AS re, sum(tr * ri - ti * rr) / sum(tr * tr + ti * ti) AS im FROM o GROUP BY pair, harmonic),
    vr AS (SELECT pair, harmonic, re, im, sum((rr - (tr * re - ti * im)) ** 2 + (ri - (tr * im + ti * re)) ** 2) / power / nullif(2 * n - 2, 0) AS v FROM o JOIN ls USING (pair, harmonic) GROUP BY pair, harmonic, re, im, power, n),
    wide AS (SELECT pair, {", ".join(f"max({c}) FILTER (harmonic = {h}) AS tf{h}_{part}_LS" for h in (1, 3) for part, c in (("real", "re"), ("imag", "im"), ("var", "v")))} FROM vr GROUP BY pair)
    SELECT pair, CASE WHEN problem IS NULL AND NOT enough THEN 'insufficient clip-free data' ELSE problem END AS problem, wide.pair IS NOT NULL AS processed, num_samples, num_nans, num_clips,
        round(min_current, 6) + 0.0 AS min_current, round(max_current, 6) + 0.0 AS max_current, cycles AS max_clipfree_tx_cycles, {", ".join(f"round(tf{h}_{part}_LS, 6) + 0.0 AS tf{h}_{part}_LS" for h in (1, 3) for part in ("real", "imag", "var"))}
    FROM g LEFT JOIN j USING (pair) LEFT JOIN wide USING (pair)
    """,
    "board_calibrations": f"WITH {_CAL} SELECT box, CARDSNX, 4096.0::DOUBLE AS ADFREQ, CALFREQ, MAG, PHASE FROM cal",
    "antenna_calibrations": """
        SELECT s_suppkey::VARCHAR AS antenna_sn, (f * x)::DOUBLE AS base_frequency, (CASE WHEN x = 1 THEN s_suppkey % 9 + 0.5 ELSE s_suppkey % 9 + 0.75 END)::DOUBLE AS mag, CASE WHEN x = 1 THEN s_suppkey % 4 - 1.25 END::DOUBLE AS phz
        FROM supplier, (VALUES (4), (16)) a(f), (VALUES (1), (1.5)) b(x)
    """,
    "calibrated_coefficients": f"""
        WITH {_CAL}, c AS (SELECT card, CALFREQ AS f, min(MAG) AS mag, PHASE / 1000 AS p FROM cal WHERE PHASE IS NOT NULL GROUP BY card, CALFREQ, PHASE),
        d AS (SELECT *, first_value(p / f) OVER (PARTITION BY card ORDER BY f) AS d, row_number() OVER (PARTITION BY card ORDER BY f) AS j, count(*) OVER (PARTITION BY card) AS n FROM c),
        r AS (SELECT *, p - d * f + pi() / 2 - floor((p - d * f + pi() / 2) / pi()) * pi() - pi() / 2 AS r FROM d),
        b AS (SELECT card, regr_slope(r, f) AS slope, regr_intercept(r, f) AS cut FROM r WHERE j <= n // 4 GROUP BY card),
        k AS (SELECT card, f, mag, p - round((p - (d + slope) * f - cut) / pi()) * pi() AS p, n, j FROM r JOIN b USING (card)),
        l AS (SELECT *, lead(f) OVER w AS f2, lead(mag) OVER w AS mag2, lead(p) OVER w AS p2 FROM k WINDOW w AS (PARTITION BY card ORDER BY f)),
        x AS (SELECT s_suppkey AS card, x::DOUBLE AS x, s_suppkey % 13 + 1.0::DOUBLE AS re, x::DOUBLE / 10 AS im FROM supplier, (VALUES (0.5), (3.0), (100.0), (1000.0)) a(x)),
        y AS (SELECT x.*, l.card IS NOT NULL AS corrected, coalesce(mag + (mag2 - mag) * (x - f) / (f2 - f), 1) AS m, coalesce(p + (p2 - p) * (x - f) / (f2 - f), 0) AS p
            FROM x LEFT JOIN l ON l.card = x.card AND j < n AND (j = 1 OR x >= f) AND (j = n - 1 OR x < f2))
        SELECT card::VARCHAR AS CARDSNX, x AS f, corrected, round((re * cos(p) + im * sin(p)) / m, 6) + 0.0 AS re, round((im * cos(p) - re * sin(p)) / m, 6) + 0.0 AS im FROM y
    """,
}
