"""Taking a steady hum out of a square wave by what is left late in its half cycles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coilwave.operators import series as S


def rising(j: Column, n: int) -> Column:
    """The first half of a triangle of n samples."""
    return (j + 0.5) * 2 / n if n % 2 == 0 else (j + 1.0) * 2 / (n + 1)


def hat(j: Column, n: int, first: Column, last: Column) -> Column:
    """Weight of sample j of a window of n: a triangle; the first window stays 1 up to its middle, the last one from there on."""
    left = F.when(j < (n + 1) // 2, 1.0).otherwise(rising(n - 1 - j, n))
    right = F.when(j >= n // 2, 1.0).otherwise(rising(j, n))
    return F.when(last, right).when(first, left).otherwise(rising(F.least(j, n - 1 - j), n))


def lockin(df: DataFrame, keys: list[str], order: list[str], value: str, period: int, rate: float, hum: float = 60.0, before: int = 40, after: int = 100, cut: float = 0.002, out: str = "filtered") -> DataFrame:
    """The series less a sinusoid at `hum`, fitted in windows of one period that overlap by half and added up with triangular weights.

    Samples near the edges of half cycles and outliers of the demeaned series count nowhere; a window without other samples adds nothing.
    Samples beyond the last whole window go, so series shorter than a period are empty."""
    own = S.indexed(df, keys, order, "_i").withColumn("_size", F.count("*").over(Window.partitionBy(*keys)))
    offset = S.on_time_offset(df, keys, order, value, period).withColumnRenamed("offset", "_off")
    own = S.running_mean(own.join(offset, keys), keys, ["_i"], value, max(1, round(rate / hum)), out="_mean", edges="same")
    edge = S.near_edges(F.col("_i"), F.col("_off"), period // 2, before, after)
    own = own.withColumn("_v", F.when(~edge, F.col(value) - F.col("_mean")))
    kept = S.winsorize(own.select(*keys, "_i", "_size", "_v"), keys, "_v", cut, ["_i"], mask=True)
    windows = F.floor(F.col("_size") / period) + F.floor((F.col("_size") - period // 2) / period)
    late = F.floor((2 * F.col("_i") + 1) / period)
    parts = kept.withColumns({"_w": windows, "_k": F.explode(F.array(late, late - 1))}).where("_k >= 0 and _k < _w").withColumn("_j", F.col("_i") - F.floor(F.col("_k") * period / 2))
    turn = F.col("_j") * (2 * math.pi * hum / rate)
    own_window = Window.partitionBy(*keys, "_k")
    parts = parts.withColumns({"_re": F.sum(F.col("clipped") * F.cos(turn)).over(own_window), "_im": -F.sum(F.col("clipped") * F.sin(turn)).over(own_window), "_c": F.count("clipped").over(own_window)})
    wave = (F.col("_re") * F.cos(turn) - F.col("_im") * F.sin(turn)) * 2 / F.nullif(F.col("_c"), F.lit(0))
    weight = hat(F.col("_j"), period, F.col("_k") == 0, F.col("_k") == F.col("_w") - 1)
    hummed = parts.groupBy(*keys, "_i").agg(F.coalesce(F.sum(wave * weight), F.lit(0.0)).alias("_hum"))
    return own.join(hummed, [*keys, "_i"]).withColumn(out, F.col(value) - F.col("_hum")).drop("_i", "_size", "_off", "_mean", "_v", "_hum")
