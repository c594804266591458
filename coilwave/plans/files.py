"""Queries over binary recordings that are written from events: each user's events are a recording of 16 samples a second.

The files are written to the shared folder and read back in ranges of a kilobyte, so that records and preambles are cut anywhere."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coilwave.plans.tables import ORDER, events, rounded
from coilwave.sources import ranged as N
from coilwave.sources import recordings as R
from coilwave.tables import shared_dir, written

RATE, FIRST_SECOND = 16, 604_790
#: Bytes of a range, and of a task's ranges.
SPLIT = (1024, 1 << 20)
TURN = ((0.6, 0.8, 0.0), (-0.8, 0.6, 0.0), (0.0, 0.0, 1.0))


def _user(path: str = "path") -> F.Column:
    return F.regexp_extract(path, r"/u(\d+)[^/]*$", 1).cast("long").alias("user_id")


def recorded(spark: SparkSession, folder: str) -> str:
    """Writes a recording for each user and returns their folder. Even users are transmitters; the week ends within a recording."""
    at = f"{shared_dir(spark)}/recordings-{uuid.uuid4().hex}"
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    own = events(spark, folder).withColumn("i", F.row_number().over(w) - 1).withColumn("record_no", F.floor(F.col("i") / RATE))
    path = F.concat(F.lit(f"{at}/u"), F.col("user_id"), F.lit(".z3d")).alias("path")
    samples = F.transform(F.array_sort(F.collect_list(F.struct("i", F.round(F.col("value") * 100).cast("int").alias("c")))), lambda x: x["c"])
    rows = own.groupBy("user_id", "record_no").agg(samples.alias("counts"))
    records = rows.select(
        path, "record_no", ((F.lit(FIRST_SECOND) + F.col("record_no")) % 604_800 * 1024).alias("gps_stamp"), F.lit(0.7).alias("lat"), F.lit(-1.9).alias("lon"), F.lit(b"stat").alias("status"),
        F.lit(3).cast("long").alias("accuracy"), F.lit(21.5).cast("float").alias("temperature"), F.lit(bytes(24)).alias("opaque"), "counts",
    )
    header = F.concat(F.lit("A/D Rate=16\nGpsWeek=1900\nLat=0.7\nLong=-1.9\nChannelGain=2\nCh.Factor=0.5\nCH.CMP=Hx\nRX.STN="), F.col("user_id"), F.lit("\n"), F.when(F.col("user_id") % 2 == 0, "TX.SENSE=4\n").otherwise(""))
    metadata = F.concat(F.lit(R.METADATA_ID.decode()), F.lit("CH.ANTSN=2314|CH.AZIMUTH=10|CH.XYZ1=1:2:3"))
    preamble = F.concat(F.rpad(header, 2 * R.BLOCK, " "), F.rpad(metadata, R.BLOCK - 1, " "), F.lit("\0$cal,1\0\0"))
    N.write(records, own.select("user_id").distinct().select(path, F.encode(preamble, "utf-8").alias("preamble")), at, F.col("path"))
    return at


def recording_catalog(spark: SparkSession, folder: str) -> DataFrame:
    found = N.catalog(spark, recorded(spark, folder))
    return rounded(found.select(_user(), "valid", "type", "sampling_rate", "num_records", F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), F.unix_seconds(F.col("end").cast("timestamp")).alias("end"), "lat", "station", "component", "antenna", "dz1"), "num_records", "lat")


def recording_samples(spark: SparkSession, folder: str) -> DataFrame:
    at = recorded(spark, folder)
    found = R.samples(N.records(spark, at, *SPLIT), N.heads(spark, at))
    flat = found.select(_user(), "record_no", F.col("gps_second").cast("long").alias("second"), F.posexplode("values").alias("k", "value"))
    return rounded(flat.select("user_id", (F.col("record_no") * RATE + F.col("k")).alias("i"), "second", "value"), "value")


def recording_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return N.record_lengths(spark, recorded(spark, folder), *SPLIT).select(_user(), "position", "length")


def recording_checks(spark: SparkSession, folder: str) -> DataFrame:
    at = recorded(spark, folder)
    lengths = N.record_lengths(spark, at, *SPLIT).groupBy(_user()).agg(F.count("*").alias("n"), F.min("length").alias("shortest"))
    missing = R.missing_samples(R.samples(N.records(spark, at, *SPLIT), N.heads(spark, at))).groupBy(_user()).agg(F.count("*").alias("n_missing"), F.min("sample").alias("first_missing"))
    return lengths.join(missing, "user_id", "left").select("user_id", "n", "shortest", F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"), "first_missing")


def recordings_rotated(spark: SparkSession, folder: str) -> DataFrame:
    """Users 3k, 3k + 1 and 3k + 2 are a triplet: turned, written as files and read back."""
    at = recorded(spark, folder)
    records = N.records(spark, at, *SPLIT)
    three = written(N.files(spark, at).select("path", _user()).groupBy(F.floor(F.col("user_id") / 3).alias("k")).agg(*[F.max(F.when(F.col("user_id") % 3 == j, F.col("path"))).alias(f"file{j + 1}") for j in range(3)]), "triplets")
    turned = R.rotated(records, three, [[F.lit(x) for x in row] for row in TURN])
    N.write(turned, N.preambles(spark, at).join(three.selectExpr("explode(array(file1, file2, file3)) AS path"), "path"), f"{at}-rot", F.regexp_replace(R.renamed(F.col("path")), r"/(u[^/]*)$", "-rot/$1"))
    back = N.records(spark, f"{at}-rot", *SPLIT).select(_user(), "record_no", F.posexplode("counts").alias("k", "count"))
    return back.select("user_id", (F.col("record_no") * RATE + F.col("k")).alias("i"), "count")


QUERIES = {f.__name__: f for f in (recording_catalog, recording_samples, recording_lengths, recording_checks, recordings_rotated)}

_SERIES = "s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
#: Bytes before the first record.
_HEAD = 3 * R.BLOCK + 8
ORACLE = {
    "recording_catalog": f"""
        WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), r AS (SELECT *, (n + 15) // 16 AS r FROM u)
        SELECT user_id, true AS valid, CASE WHEN user_id % 2 = 0 THEN 'TX' ELSE 'RX' END AS type, 16.0::DOUBLE AS sampling_rate, round((64 * r + 4 * n) / 128.0::DOUBLE, 6) AS num_records,
            (315964800 + 1900 * 604800 + {FIRST_SECOND} - 18)::BIGINT AS start, (315964800 + 1900 * 604800 + {FIRST_SECOND} + r - 1 - 18)::BIGINT AS end,
            round(degrees(0.7::DOUBLE), 6) AS lat, user_id::VARCHAR AS station, 'Hx' AS component, '2314' AS antenna, 3.0::DOUBLE AS dz1 FROM r
    """,
    "recording_samples": f"""
        WITH {_SERIES}, places AS (SELECT user_id, unnest(range((n + 15) // 16 * 16)) AS i FROM (SELECT DISTINCT user_id, n FROM s))
        SELECT user_id, p.i, (({FIRST_SECOND} + p.i // 16) % 604800)::BIGINT AS second,
            round(round(value * 100)::INTEGER * 0.25::DOUBLE / CASE WHEN user_id % 2 = 0 THEN 4 ELSE 1 END, 6) AS value
        FROM places p LEFT JOIN s USING (user_id, i)
    """,
    "recording_lengths": f"""
        WITH {_SERIES} SELECT user_id, ({_HEAD} + 128 * (i // 16))::BIGINT AS position, (64 + 4 * count(*))::BIGINT AS length FROM s GROUP BY user_id, i // 16
    """,
    "recording_checks": """
        WITH u AS (SELECT user_id, count(*) AS m FROM events GROUP BY user_id)
        SELECT user_id, ((m + 15) // 16)::BIGINT AS n, (CASE WHEN m % 16 = 0 THEN 128 ELSE 64 + 4 * (m % 16) END)::BIGINT AS shortest,
            ((16 - m % 16) % 16)::BIGINT AS n_missing, (CASE WHEN m % 16 > 0 THEN m END)::BIGINT AS first_missing FROM u
    """,
    "recordings_rotated": f"""
        WITH {_SERIES}, c AS (SELECT user_id // 3 AS g, user_id % 3 AS j, i, round(value * 100) AS c FROM s),
        t AS (SELECT a.g, i, a.c AS c1, b.c AS c2, d.c AS c3 FROM c a JOIN c b USING (g, i) JOIN c d USING (g, i) WHERE a.j = 0 AND b.j = 1 AND d.j = 2)
        SELECT g * 3 AS user_id, i, trunc(0.6::DOUBLE * c1 + 0.8::DOUBLE * c2 + 0.0::DOUBLE * c3)::INTEGER AS count FROM t
        UNION ALL SELECT g * 3 + 1, i, trunc(-0.8::DOUBLE * c1 + 0.6::DOUBLE * c2 + 0.0::DOUBLE * c3)::INTEGER FROM t
        UNION ALL SELECT g * 3 + 2, i, c3::INTEGER FROM t
    """,
}
