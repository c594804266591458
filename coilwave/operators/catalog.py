"""Cleaning and summing up catalogs of recordings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coilwave.tables import written


def flag_original(df: DataFrame, by: list[str], order: list[str], out: str = "original") -> DataFrame:
    """True for the first row of each group of equal `by`, in the order given."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)


def drop_duplicates(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group; unlike dropDuplicates the same one each time."""
    return flag_original(df, by, order, "_original").where("_original").drop("_original")


def in_range(start: Column, end: Column, least_end: Column, most_start: Column) -> Column:
    """Whether a recording reaches into a span of time; false if a time is missing."""
    return F.coalesce((end > least_end) & (start < most_start), F.lit(False))


def usable(df: DataFrame, excluded_rate: float = 256.0, least_records: int = 30) -> DataFrame:
    """Recordings that are valid, not of the excluded rate, long enough, and at a station."""
    return df.where(F.coalesce(F.col("valid"), F.lit(False)) & (F.col("sampling_rate") != excluded_rate) & (F.col("num_records") >= least_records)).na.drop(subset=["station"])


def quality_counts(df: DataFrame, by: list[str], **flags: Column) -> DataFrame:
    """How many rows of each group have each flag."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(f).alias(k) for k, f in flags.items()])


def padded_range(df: DataFrame, by: list[str], start: str, end: str, pad: float = 0.05) -> DataFrame:
    """(by, low, high): seconds from the first start to the last end, widened by a share of their distance on either side."""
    low, high = F.min(F.unix_timestamp(F.col(start).cast("timestamp"))), F.max(F.unix_timestamp(F.col(end).cast("timestamp")))
    return df.groupBy(*by).agg((low - pad * (high - low)).alias("low"), (high + pad * (high - low)).alias("high"))


def coded(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the place of each value among the distinct values of a column, from 0; null stays null.

    The distinct values are kept in the shared folder in parts that follow each other; each part is numbered by itself, after all before it."""
    parts = written(df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()), "codes")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each shuffle partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1 + F.col("_before")
    values = parts.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").select(column, place.alias(out))
    return df.join(values, column, "left")


def commonest(df: DataFrame, by: list[str], column: str, out: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equally frequent ones."""
    return df.groupBy(*by).agg(F.mode(column, deterministic=True).alias(out))


#: Fixed value: folders of stations in the surveys this was made for; other surveys name theirs otherwise.
STATION = r"/(?:BC|sub|Sub|SUB|LMA)(\d+[a-zA-Z]+)/"


def station_of(path: Column, pattern: str = STATION) -> Column:
    """The station in a folder name like .../BC12a/..., which is the first group of the pattern; null if there is none."""
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def digits(text: Column) -> Column:
    """The digits of a text as a number; null if it has none."""
    return F.regexp_replace(text, r"\D", "").try_cast("long")


def without_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\d", "")


def offsets(xyz: Column) -> Column:
    """A text `x:y:z` as a struct of numbers."""
    parts = F.split(xyz, ":")
    return F.struct(*[F.get(parts, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(("dx", "dy", "dz"))])


def check_records(records: DataFrame) -> DataFrame:
    """(file, code, n_records, missing_bytes) from records (file, position, file_size, record_size, gps_second), position being where a record begins.

    -1: the usual length differs from record_size. -2: the counts of records by flags, by size and by elapsed time differ.
    -3: a record but the last has another length. Else 0, and the bytes that the last record lacks."""
    w = Window.partitionBy("file").orderBy("position")
    own = records.withColumns({"length": F.coalesce(F.lead("position").over(w), F.col("file_size")) - F.col("position"), "last": F.lead("position").over(w).isNull()})
    s = own.groupBy("file").agg(
        F.mode("length", deterministic=True).alias("usual"), F.first("record_size").alias("size"), F.count("*").alias("n_records"),
        F.ceil((F.first("file_size") - F.min("position")) / F.first("record_size")).alias("by_size"), (F.max("gps_second") - F.min("gps_second") + 1).alias("by_time"),
        F.count_if(~F.col("last") & (F.col("length") != F.col("record_size"))).alias("odd"), F.max(F.when(F.col("last"), F.col("length"))).alias("last_length"),
    )
    code = F.when(F.col("usual") != F.col("size"), -1).when((F.col("n_records") != F.col("by_size")) | (F.col("n_records") != F.col("by_time")), -2).when(F.col("odd") > 0, -3).otherwise(0)
    return s.select("file", code.alias("code"), "n_records", F.greatest(F.lit(0), F.col("size") - F.col("last_length")).alias("missing_bytes"))


def steady(records: DataFrame) -> DataFrame:
    """(file, steady): whether all neighbouring records are one second apart."""
    w = Window.partitionBy("file").orderBy("record_no")
    return records.withColumn("_d", F.col("gps_second") - F.lag("gps_second").over(w)).groupBy("file").agg(F.bool_and(F.coalesce(F.col("_d") == 1, F.lit(True))).alias("steady"))


def unpivoted_calibrations(df: DataFrame, harmonics: tuple[int, ...] = (1, 3, 5, 7, 9)) -> DataFrame:
    """(CARDSNX, ADFREQ, CALFREQ, MAG, PHASE): a row for each harmonic from columns MAG1, PHASE1, MAG3, ..."""
    stacked = ", ".join(f"CALFREQ * {h}, MAG{h}, PHASE{h}" for h in harmonics)
    return df.select("CARDSNX", "ADFREQ", F.expr(f"stack({len(harmonics)}, {stacked}) as (CALFREQ, MAG, PHASE)"))


def interpolated(points: DataFrame, table: DataFrame, keys: list[str], x: str, y: str | list[str], out: str | list[str]) -> DataFrame:
    """points with y at x from a table of knots (keys, x, y): straight lines between neighbours, going on beyond the ends. A key of one knot is constant, one of
    none, or a null key or x, gives null. Of knots at one x the least y counts. Several y with as many names go at once.

    Knots and the places that are asked for, each once a key, lie in one order; a place takes the last knot before it, or the first of all. So however many points
    a key has, its order holds only their distinct places."""
    ys, outs = ([y], [out]) if isinstance(y, str) else (y, out)
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, x)])
    knots = table.where(known).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.array(*[F.min(F.col(c).cast("double")) for c in ys]).alias("_y"))
    every = Window.partitionBy(*keys)
    w = every.orderBy("_x")
    lines = knots.withColumns({"_x2": F.lead("_x").over(w), "_y2": F.lead("_y").over(w), "_n": F.count("*").over(every)}).where("_x2 is not null or _n = 1")
    lines = lines.select(*keys, "_x", F.struct("_x", "_y", "_x2", "_y2").alias("_s"))
    own = points.withColumn("_x", F.col(x).cast("double"))
    asked = own.where(known).select(*keys, "_x").distinct()
    met = lines.unionByName(asked, allowMissingColumns=True)
    before = F.last("_s", ignorenulls=True).over(every.orderBy("_x", F.col("_s").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    found = met.withColumn("_h", F.coalesce(before, F.min("_s").over(every))).where("_s is null").drop("_s")

    def line(j: int) -> Column:
        a, b = F.col("_h._y")[j], F.col("_h._y2")[j]
        return a + F.coalesce((b - a) * (F.col("_x") - F.col("_h._x")) / (F.col("_h._x2") - F.col("_h._x")), F.lit(0.0))

    return own.join(found, [*keys, "_x"], "left").withColumns({n: line(j) for j, n in enumerate(outs)}).select(*points.columns, *outs)
