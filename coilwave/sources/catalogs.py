"""Catalogs, overlaps, settings and results as tables: read, kept and written through Spark, in any store that it reaches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coilwave.functions import timeconv as T
from coilwave.operators import overlap as O

#: Tables that people keep by hand, as CSV with a header.
STATIONS = "name string, x double, y double"
SETTINGS = "name string, value string"
ROTATION = "file1 string, file2 string, file3 string, azimuth double, inclination1 double, inclination2 double, inclination3 double, declination double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a known schema; a cell that does not fit its type raises."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def setting(settings: DataFrame, name: str) -> str:
    """A setting by name; a name that is missing or there twice raises."""
    found = settings.where(F.col("name") == name).select("value").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} settings are named {name}")
    return found[0].value


def assert_unique(df: DataFrame, *by: str) -> DataFrame:
    """df; a value of `by` that several rows have raises when it is read."""
    said = F.raise_error(F.concat_ws(" ", F.lit("not unique:"), *[F.col(c).cast("string") for c in by])).cast("boolean")
    counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return counted.where(F.when(F.col("_n") > 1, said).otherwise(True)).drop("_n")


def save(df: DataFrame, path: str, kind: str = "parquet", *, order: tuple[str, ...] = (), one_file: bool = False) -> None:
    """Writes a table as Parquet or CSV (with a header), replacing what was there. one_file: sorted by `order` into a single file, for result tables
    of a row a pair; larger tables stay in parts, sorted over all parts."""
    df = df.coalesce(1).sortWithinPartitions(*order) if one_file and order else df.coalesce(1) if one_file else df.orderBy(*order) if order else df
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A kept catalog; recordings without records have no start and end and are not valid."""
    kept = spark.read.parquet(path)
    none = F.coalesce(F.col("num_records") == 0, F.lit(False))
    return kept.withColumns({"start": F.when(~none, F.col("start")), "end": F.when(~none, F.col("end")), "valid": F.coalesce("valid", F.lit(False)) & ~none})


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], use_kept: bool = True, read: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """The table kept at `path`, or, if there is none or it is not wanted, that which `build` makes, kept there for the next time. Only a missing
    table is made anew; any other failure to read it is raised."""
    read = read or (lambda s, p: s.read.parquet(p))
    if use_kept:
        try:
            return read(spark, path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    save(build(), path)
    return read(spark, path)


def local_overlaps(spark: SparkSession, tx: DataFrame, rx: DataFrame, path: str | None = None, use_kept: bool = True, zone: str = "America/Denver") -> DataFrame:
    """(tx_id, rx_id, start, end) of recordings (id, start, end in UTC) that overlap, in local time; kept at `path`, if one is given."""

    def build() -> DataFrame:
        return O.overlaps(tx, rx).withColumns({c: T.to_local(F.col(c), zone) for c in ("start", "end")})

    return cached(spark, path, build, use_kept) if path else build()


def mean_locations(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(keys, n, x, y): mean place of each group; missing coordinates count nowhere."""
    return points.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias(x), F.avg(y).alias(y))


def summed_calibrations(cal: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums of `values` by keys: a calibration given in several rows is one."""
    return cal.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def without(df: DataFrame, picked: DataFrame, on: list[str]) -> DataFrame:
    """df less the rows that were picked."""
    return df.join(picked.select(*on).distinct(), on, "left_anti")


def of_component(df: DataFrame, component: str) -> DataFrame:
    return df.where(F.col("component") == component)


def in_span(df: DataFrame, column: str, start: object, stop: object) -> DataFrame:
    """Rows from start to stop, both included."""
    return df.where(F.col(column).between(F.lit(start), F.lit(stop)))
