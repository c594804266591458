"""Queries over series of any length: all events as one series in many parts, and recursive filters as scans over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coilwave.operators import fourier as R
from coilwave.operators import kernels as K
from coilwave.operators import long as G
from coilwave.operators import series as S
from coilwave.operators import spectral as X
from coilwave.plans.tables import ORDER, OVER, events, rounded

#: Samples of a part here, so that the tables have many; ranges that the series is first sorted into.
SIZE, RANGES = 1024, 16
NOTCH = (60.0, 4096.0, 0.2)


def _series(spark: SparkSession, folder: str) -> DataFrame:
    own = events(spark, folder).withColumn("series", F.lit("all"))
    sec = F.pmod(F.col("event_id") * 7919, F.lit(604_800)).cast("long").alias("sec")
    gap = F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("gappy")
    return G.numbered(own.select("*", sec, gap, (F.col("value") % 6.25).alias("phase")), ["series"], ORDER, parts=RANGES)


def long_index(spark: SparkSession, folder: str) -> DataFrame:
    return _series(spark, folder).select("event_id", "i")


def long_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(G.running_mean(_series(spark, folder), ["series"], "i", "value", 41, size=SIZE).select("event_id", "mean"), "mean")


def long_mean_same(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(G.running_mean(_series(spark, folder), ["series"], "i", "value", 101, edges="same", size=SIZE).select("event_id", "mean"), "mean", digits=4)


def long_demean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(G.demean(_series(spark, folder), ["series"], "i", "value", 4.5, size=SIZE).select("event_id", "demeaned"), "demeaned")


def long_median(spark: SparkSession, folder: str) -> DataFrame:
    """The median of the 201 events up to each one, holes left out."""
    return G.running_median(_series(spark, folder), ["series"], "i", "gappy", 201, size=SIZE).select("event_id", "median")


def long_diff(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(G.prewhiten(_series(spark, folder), ["series"], "i", "value", size=SIZE).select("event_id", "diff"), "diff")


def long_weeks(spark: SparkSession, folder: str) -> DataFrame:
    return G.week_numbers(_series(spark, folder), ["series"], "i", "sec", 1900, size=SIZE).select("event_id", F.col("week").cast("long").alias("week"))


def long_unwrap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(G.unwrap(_series(spark, folder), ["series"], "i", "phase", period=6.25, size=SIZE).select("event_id", "unwrapped"), "unwrapped", digits=4)


def long_hold(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(G.interpolate(_series(spark, folder), ["series"], "i", "gappy", size=SIZE).select("event_id", "filled"), "filled")


def long_extend(spark: SparkSession, folder: str) -> DataFrame:
    """Values are missing at both ends, too."""
    own = _series(spark, folder).withColumn("gappy", F.when((F.col("i") > 4) & (F.col("user_id") != 7), F.col("gappy")))
    return rounded(G.interpolate(own, ["series"], "i", "gappy", ends="extend", size=SIZE).select("event_id", "filled"), "filled")


def long_winsorize(spark: SparkSession, folder: str) -> DataFrame:
    own = events(spark, folder).withColumn("series", F.lit("all"))
    return G.winsorize(own, ["series"], "value", 0.05, most=500).select("event_id", "clipped")


def long_mask(spark: SparkSession, folder: str) -> DataFrame:
    own = events(spark, folder).withColumn("gappy", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return G.winsorize(own, ["event_type"], "gappy", 0.1, mask=True, most=500).select("event_id", "clipped")


def autocorr_period(spark: SparkSession, folder: str) -> DataFrame:
    return G.period(S.indexed(events(spark, folder), ["user_id"], ORDER), ["user_id"], "i", "value", 6)


def tapered_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Bin 3 of windows of 40 in each event type's series, with two tapers."""
    own = S.indexed(events(spark, folder), ["event_type"], ORDER)
    made = [X.windowed_bins(own, ["event_type"], "i", "value", 40, 20, [3], taper).withColumn("taper", F.lit(taper)) for taper in ("tukey_ten_sample_taper", "blackman")]
    return rounded(made[0].unionByName(made[1]).select("taper", "event_type", "win", "re", "im"), "re", "im")


def long_notch(spark: SparkSession, folder: str) -> DataFrame:
    """A notch over the events of each type, in parts of 256 samples."""
    own = G.numbered(events(spark, folder), ["event_type"], ORDER, parts=RANGES)
    return rounded(G.notch(own, ["event_type"], "i", "value", *NOTCH, size=256).select("event_id", "filtered"), "filtered", digits=4)


#: log2 of the places of a block of the spectra here, so that a series is spread over tasks.
SPREAD = 10


def _spectrum(spark: SparkSession, folder: str) -> DataFrame:
    own = events(spark, folder).withColumn("series", F.lit("all"))
    return R.spectrum(own, ["series"], ORDER, "value", whole=0, block=SPREAD)


def long_spectrum(spark: SparkSession, folder: str) -> DataFrame:
    """The Fourier sums of all events as one series."""
    return rounded(_spectrum(spark, folder).select("n", "k", "re", "im"), "re", "im", digits=3)


def long_lowpass(spark: SparkSession, folder: str) -> DataFrame:
    """That series, rebuilt from the slowest sixteenth of its sums."""
    slow = lambda c: F.when(16 * F.col("k") < F.col("n"), F.col(c)).otherwise(0.0)
    sums = _spectrum(spark, folder).withColumns({"re": slow("re"), "im": slow("im")})
    return rounded(R.series_of(sums, ["series"], whole=0, block=SPREAD).select("i", "value"), "value", digits=5)


QUERIES = {f.__name__: f for f in (long_spectrum, long_lowpass, long_index, long_mean, long_mean_same, long_demean, long_median, long_diff, long_weeks, long_unwrap, long_hold, long_extend, long_winsorize, long_mask, long_notch, autocorr_period, tapered_bins)}

_ALL = "s AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, CASE WHEN event_id % 7 <> 0 THEN value END AS gappy FROM events)"
_FILL = """
    a AS (SELECT *, max(CASE WHEN gappy IS NOT NULL THEN i END) OVER (ORDER BY i) AS p, min(CASE WHEN gappy IS NOT NULL THEN i END) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM s),
    f AS (SELECT a.event_id, a.i, a.gappy, a.p, a.q, x.gappy AS py, y.gappy AS qy FROM a LEFT JOIN s x ON x.i = a.p LEFT JOIN s y ON y.i = a.q)
"""


def notch_pass(name: str, source: str, notch: tuple[float, float, float]) -> str:
    """A recursive CTE: y = b0 x + s1, s1 = b1 x - a1 y + s2, s2 = b2 x - a2 y, from the steady state of the first sample; notch: frequency, rate, bandwidth."""
    b, a = K.notch_coefficients(*notch)
    b0, b1, b2, a1, a2, level = (f"({float(c)!r}::DOUBLE)" for c in (*b, a[1], a[2], b.sum() / a.sum()))
    y = f"({b0} * x.x + f.s1)"
    return f"""
        {name}(user_id, i, m, y, s1, s2) AS (
            SELECT user_id, i, m, {level} * x, ({b1} - {a1} * {level} + {b2} - {a2} * {level}) * x, ({b2} - {a2} * {level}) * x FROM {source} WHERE i = 0
            UNION ALL
            SELECT f.user_id, f.i + 1, f.m, {y}, {b1} * x.x - {a1} * {y} + f.s2, {b2} * x.x - {a2} * {y} FROM {name} f JOIN {source} x ON x.user_id = f.user_id AND x.i = f.i + 1
        )"""


def notch_sql(key: str) -> str:
    """The filter sample by sample, forth and back."""
    return f"""
    WITH RECURSIVE s AS MATERIALIZED (SELECT event_id, {key} AS user_id, value AS v, row_number() {OVER.replace("user_id", key)} - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM events),
    e AS MATERIALIZED (SELECT user_id, n, max(v) FILTER (i = 0) AS v0, max(v) FILTER (i = n - 1) AS v1 FROM s GROUP BY user_id, n),
    x AS MATERIALIZED (
        SELECT user_id, i + 9 AS i, n + 18 AS m, v AS x FROM s WHERE n > 9
        UNION ALL SELECT s.user_id, 9 - i, s.n + 18, 2 * v0 - v FROM s JOIN e USING (user_id) WHERE s.n > 9 AND i BETWEEN 1 AND 9
        UNION ALL SELECT s.user_id, 2 * (s.n - 1) - i + 9, s.n + 18, 2 * v1 - v FROM s JOIN e USING (user_id) WHERE s.n > 9 AND i BETWEEN s.n - 10 AND s.n - 2
    ), {notch_pass("f", "x", NOTCH)}, r AS MATERIALIZED (SELECT user_id, m - 1 - i AS i, m, y AS x FROM f), {notch_pass("g", "r", NOTCH)}
    SELECT event_id, round(CASE WHEN n <= 9 THEN v ELSE y END, 4) + 0.0 AS filtered FROM s LEFT JOIN g ON g.user_id = s.user_id AND g.i = g.m - 1 - (s.i + 9)
"""


# turns are reduced to less than one before the cosine, so that they stay exact
_SUMS = """
    s AS MATERIALIZED (SELECT value AS v, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
    c AS MATERIALIZED (SELECT n, k, sum(v * cos(2 * pi() * (i * k % n) / n::DOUBLE)) AS re, -sum(v * sin(2 * pi() * (i * k % n) / n::DOUBLE)) AS im
        FROM s, (SELECT unnest(range((SELECT {upto} FROM s))) AS k) GROUP BY n, k)
"""
_FRAME = "OVER (ORDER BY ts, event_id ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING)"
ORACLE = {
    "long_index": f"WITH {_ALL} SELECT event_id, i FROM s",
    "long_mean": f"SELECT event_id, round(CASE WHEN count(*) {_FRAME.format(20)} = 41 THEN avg(value) {_FRAME.format(20)} END, 6) + 0.0 AS mean FROM events",
    "long_mean_same": f"""
        WITH m AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n, CASE WHEN count(*) {_FRAME.format(50)} = 101 THEN avg(value) {_FRAME.format(50)} END AS mean FROM events)
        SELECT event_id, round(coalesce(mean, CASE WHEN i <= 50 THEN (SELECT mean FROM m WHERE i = 51) ELSE (SELECT mean FROM m WHERE i = n - 50) END), 4) + 0.0 AS mean FROM m
    """,
    "long_demean": f"SELECT event_id, round(value - (sum(value) {_FRAME.format(1)} + 0.75::DOUBLE * (lag(value, 2) OVER (ORDER BY ts, event_id) + lead(value, 2) OVER (ORDER BY ts, event_id))) / 4.5::DOUBLE, 6) + 0.0 AS demeaned FROM events",
    "long_median": f"WITH {_ALL}, l AS (SELECT event_id, list_sort(list(gappy) FILTER (gappy IS NOT NULL) OVER (ORDER BY i ROWS BETWEEN 200 PRECEDING AND CURRENT ROW)) AS x FROM s) SELECT event_id, x[len(x) // 2 + 1] AS median FROM l",
    "long_diff": "SELECT event_id, round(coalesce(value - lag(value) OVER (ORDER BY ts, event_id), 0), 6) + 0.0 AS diff FROM events",
    "long_weeks": """
        WITH s AS (SELECT event_id, ts, event_id * 7919 % 604800 AS sec, lag(event_id * 7919 % 604800) OVER (ORDER BY ts, event_id) AS before FROM events)
        SELECT event_id, (1900 + sum(CASE WHEN before > sec + 600000 THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id))::BIGINT AS week FROM s
    """,
    "long_unwrap": """
        WITH s AS (SELECT event_id, ts, value % 6.25::DOUBLE AS x, value % 6.25::DOUBLE - lag(value % 6.25::DOUBLE) OVER (ORDER BY ts, event_id) AS d FROM events)
        SELECT event_id, round(x + 6.25::DOUBLE * sum(CASE WHEN abs(d) > 3.125 THEN -round(d / 6.25::DOUBLE) ELSE 0 END) OVER (ORDER BY ts, event_id), 4) + 0.0 AS unwrapped FROM s
    """,
    "long_hold": f"WITH {_ALL}, {_FILL} SELECT event_id, round(coalesce(gappy, py + (qy - py) * (i - p) / (q - p)::DOUBLE, py, qy), 6) + 0.0 AS filled FROM f",
    "long_extend": f"""
        WITH {_ALL.replace("THEN value END AS gappy", "AND user_id <> 7 AND row_number() OVER (ORDER BY ts, event_id) > 5 THEN value END AS gappy")}, {_FILL},
        k AS (SELECT i, gappy, row_number() OVER (ORDER BY i) AS u, row_number() OVER (ORDER BY i DESC) AS d FROM s WHERE gappy IS NOT NULL),
        e AS (SELECT max(i) FILTER (u = 1) AS a, max(gappy) FILTER (u = 1) AS ay, max(i) FILTER (u = 2) AS b, max(gappy) FILTER (u = 2) AS by_, max(i) FILTER (d = 1) AS z, max(gappy) FILTER (d = 1) AS zy, max(i) FILTER (d = 2) AS w, max(gappy) FILTER (d = 2) AS wy FROM k)
        SELECT event_id, round(coalesce(gappy, py + (qy - py) * (i - p) / (q - p)::DOUBLE, CASE WHEN p IS NULL THEN ay + (by_ - ay) * (i - a) / (b - a)::DOUBLE ELSE zy + (wy - zy) * (i - z) / (w - z)::DOUBLE END), 6) + 0.0 AS filled FROM f, e
    """,
    "long_winsorize": """
        WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) - 1 AS r, count(*) OVER () AS n FROM events),
        b AS (SELECT max(value) FILTER (r = floor(0.05::DOUBLE * n)) AS lo, max(value) FILTER (r = n - floor(0.05::DOUBLE * n) - 1) AS hi FROM r)
        SELECT event_id, greatest(lo, least(hi, value)) AS clipped FROM events, b
    """,
    "long_mask": """
        WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE event_id % 7 <> 0),
        b AS (SELECT event_type, max(value) FILTER (r = floor(0.1::DOUBLE * n)) AS lo, max(value) FILTER (r = n - floor(0.1::DOUBLE * n) - 1) AS hi FROM r GROUP BY event_type)
        SELECT event_id, CASE WHEN event_id % 7 <> 0 AND value BETWEEN lo AND hi THEN value END AS clipped FROM events JOIN b USING (event_type)
    """,
    "autocorr_period": f"""
        WITH RECURSIVE s AS MATERIALIZED (SELECT user_id, value AS v, row_number() {OVER} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        c AS MATERIALIZED (SELECT a.user_id, b.i - a.i AS lag, sum(a.v * b.v) AS p FROM s a JOIN s b ON b.user_id = a.user_id AND b.i >= a.i GROUP BY ALL),
        m AS MATERIALIZED (SELECT user_id, lag, arg_max(lag, p) OVER (PARTITION BY user_id ORDER BY lag ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS best FROM c),
        e(user_id, most, lag, times) AS (
            SELECT DISTINCT user_id, n - 18, 12::BIGINT, 2::BIGINT FROM s
            UNION ALL SELECT e.user_id, most, 2 * best, 2 * times FROM e JOIN m ON m.user_id = e.user_id AND m.lag = e.lag WHERE e.lag + 2 < most
        )
        SELECT user_id, arg_max(lag, times) / max(times)::DOUBLE AS period FROM e GROUP BY user_id
    """,
    "tapered_bins": """
        WITH s AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events),
        w AS (SELECT event_type, v, m AS win, i - 20 * m AS p FROM (SELECT *, unnest([i // 20 - 1, i // 20]) AS m FROM s) WHERE m >= 0),
        t AS (SELECT *, 'tukey_ten_sample_taper' AS taper, CASE WHEN least(p, 40 - p) < 10 THEN 0.5 - 0.5 * cos(pi() * least(p, 40 - p) / 10) ELSE 1 END AS g FROM w
            UNION ALL SELECT *, 'blackman', 0.42::DOUBLE - 0.5 * cos(2 * pi() * p / 40) + 0.08::DOUBLE * cos(4 * pi() * p / 40) FROM w)
        SELECT taper, event_type, win, round(sum(v * g * cos(2 * pi() * 3 * p / 40)) / sum(g), 6) + 0.0 AS re, round(-sum(v * g * sin(2 * pi() * 3 * p / 40)) / sum(g), 6) + 0.0 AS im
        FROM t GROUP BY taper, event_type, win HAVING count(*) = 40
    """,
    "long_notch": notch_sql("event_type"),
    "long_spectrum": f"WITH {_SUMS.format(upto='max(n) // 2 + 1')} SELECT n, k, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM c",
    "long_lowpass": f"""
        WITH {_SUMS.format(upto="(max(n) + 15) // 16")}
        SELECT i, round(sum((CASE WHEN k = 0 THEN 1 ELSE 2 END) * (re * cos(2 * pi() * (i * k % c.n) / c.n::DOUBLE) - im * sin(2 * pi() * (i * k % c.n) / c.n::DOUBLE))) / any_value(c.n), 5) + 0.0 AS value FROM s, c GROUP BY i
    """,
}
