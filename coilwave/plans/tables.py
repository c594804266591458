"""What the modules of queries share: the tables, rounding, and parts of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["ts", "event_id"]
OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


RESAMPLED = f"""
    s AS MATERIALIZED (SELECT user_id, value AS v, row_number() {OVER} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, lead(value) {OVER} AS w FROM events),
    p AS MATERIALIZED (SELECT user_id, i, v, w, unnest(range(ceil((i + 3) / 0.8125::DOUBLE)::BIGINT, CASE WHEN i = n - 1 THEN floor((i + 3) / 0.8125::DOUBLE)::BIGINT + 1 ELSE ceil((i + 4) / 0.8125::DOUBLE)::BIGINT END)) AS p FROM s),
    q AS MATERIALIZED (SELECT user_id, p // 8 AS cycle, (p % 8)::INTEGER AS phase, v + coalesce((w - v) * (p * 0.8125::DOUBLE - 3 - i), 0) AS value FROM p)
"""
