"""Calibration texts: boards (comma-separated, with a header) and antennas (blocks of one frequency)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coilwave.operators import catalog as C
from coilwave.operators import fourier as R

# Fixed values of the format.
HARMONICS = (1, 3, 5, 7, 9)
BOARD_COLUMNS = ["CARDSNX", "CALFREQ", "ADFREQ", "G0", "ATTEN", *[f"{n}{h}" for h in HARMONICS for n in ("MAG", "PHASE")]]
VERSIONS = (29, 31)
ANTENNA_BLOCK = "AMT antenna"


def texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text) of whole files; calibration files are a few hundred lines."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _lines(df: DataFrame) -> DataFrame:
    return df.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def board_headers(files: DataFrame) -> DataFrame:
    """(path, header): the lines `$KEY,value` as a map of texts."""
    own = _lines(files).where("line like '$%'")
    pair = F.struct(F.regexp_extract("line", r"^\$([^,]*)", 1).alias("k"), F.trim(F.regexp_extract("line", r"^\$[^,]*,(.*)$", 1)).alias("v"))
    return own.groupBy("path").agg(F.map_from_entries(F.collect_list(pair)).alias("header"))


def board_rows(files: DataFrame) -> DataFrame:
    """(path, CARDSNX, HDWKEY, CALFREQ, ADFREQ, ..., PHASE9): blanks are null. Version 29 writes card and hardware key in one field; other versions have no key.
    A file of an unknown version raises."""
    h = board_headers(files).select("path", F.col("header")["CAL.VER"].try_cast("double").cast("int").alias("_v"))
    parts = F.split("line", ",")
    cells = {n: F.nullif(F.trim(F.get(parts, F.lit(k))), F.lit("")) for k, n in enumerate(BOARD_COLUMNS)}
    own = _lines(files).where("line not like '$%'").join(h, "path", "left")
    known = F.when(F.col("_v").isin(*VERSIONS), F.col("_v")).otherwise(F.raise_error(F.concat(F.lit("unknown version of "), F.col("path"))).cast("int"))
    card = F.split(cells["CARDSNX"], " ", 2)
    return own.withColumn("_v", known).select(
        "path", F.when(F.col("_v") == 29, card[0]).otherwise(cells["CARDSNX"]).alias("CARDSNX"), F.when(F.col("_v") == 29, F.get(card, F.lit(1))).alias("HDWKEY"),
        *[cells[n].try_cast("double").alias(n) for n in BOARD_COLUMNS[1:]],
    )


def boards(files: DataFrame) -> DataFrame:
    """(box, CARDSNX, ADFREQ, CALFREQ, MAG, PHASE), a row for each harmonic. The box is GDP.SN of the header, else the name less `zen` and its ending."""
    box = board_headers(files).select("path", F.coalesce(F.col("header")["GDP.SN"], F.regexp_extract("path", r"/zen([^/]*)\.cal$", 1)).alias("box"))
    rows = board_rows(files).select("path", "CARDSNX", "ADFREQ", "CALFREQ", *[F.col(f"{n}{h}") for h in HARMONICS for n in ("MAG", "PHASE")])
    stacked = rows.select("path", F.inline(F.array(*[F.struct("CARDSNX", "ADFREQ", (F.col("CALFREQ") * h).alias("CALFREQ"), F.col(f"MAG{h}").alias("MAG"), F.col(f"PHASE{h}").alias("PHASE")) for h in HARMONICS])))
    return stacked.join(box, "path").drop("path")


def antennas(files: DataFrame) -> DataFrame:
    """(antenna_sn, base_frequency, mag, phz) from blocks `AMT antenna <frequency>`: the nearest power of two and, from the second pair of
    columns, one and a half times that."""
    rest = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    body = rest(F.split("text", ANTENNA_BLOCK))
    block = files.select("path", F.explode(body).alias("block"))
    lines = block.select("path", F.split("block", r"\r?\n").alias("l")).select("path", F.pow(F.lit(2.0), F.rint(F.log2(F.trim(F.col("l")[0]).cast("double")))).alias("f"), F.explode(rest(F.col("l"))).alias("line"))
    cells = F.split(F.trim("line"), r"\s+")
    at = lambda k: F.get(cells, F.lit(k)).try_cast("double")
    own = lines.where(F.trim("line") != "")
    pairs = F.array(*[F.struct((F.col("f") * x).alias("base_frequency"), at(k).alias("mag"), at(k + 1).alias("phz")) for x, k in ((1.0, 1), (1.5, 3))])
    return own.select(cells[0].alias("antenna_sn"), F.inline(pairs))


def unwrapped_by_delay(df: DataFrame, keys: list[str], frequency: str, phase: str, out: str = "unwrapped", scale: float = 1e-3) -> DataFrame:
    """Phases of a delayed signal without their jumps by pi. The delay is that of the first frequency above 0, mended by a straight line through the
    first quarter of the points; with under eight points that line does not exist and `out` is null. `scale` is radians a unit."""
    every = Window.partitionBy(*keys)
    w = every.orderBy(frequency)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    f, p = F.col(frequency), F.col(phase) * scale
    pi = F.lit(3.141592653589793)
    own = df.withColumns({"_d": F.first(p / F.nullif(f, F.lit(0.0)), ignorenulls=True).over(whole), "_k": F.row_number().over(w), "_n": F.count("*").over(every)})
    own = own.withColumn("_r", F.pmod(p - F.col("_d") * f + pi / 2, pi) - pi / 2)
    head = F.col("_k") <= F.floor(F.col("_n") / 4)
    own = own.withColumns({"_slope": F.regr_slope(F.when(head, F.col("_r")), F.when(head, f)).over(every), "_cut": F.regr_intercept(F.when(head, F.col("_r")), F.when(head, f)).over(every)})
    left = p - (F.col("_d") + F.col("_slope")) * f - F.col("_cut")
    return own.withColumn(out, (p - F.rint(left / pi) * pi) / scale).drop("_d", "_k", "_n", "_r", "_slope", "_cut")


def divided(df: DataFrame, re: str, im: str, magnitude: Column, radians: Column) -> DataFrame:
    """A complex column divided by a response given as magnitude and phase."""
    a, b = F.cos(radians), F.sin(radians)
    return df.withColumns({re: (F.col(re) * a + F.col(im) * b) / magnitude, im: (F.col(im) * a - F.col(re) * b) / magnitude})


def board_corrected(fc: DataFrame, cal: DataFrame, keys: list[str], flag: str | None = None) -> DataFrame:
    """Coefficients (keys, f, re, im) less the response of their board, interpolated over frequency; those without a calibration, or with one of so few
    points that its phase is not known, stay as they are. `flag` names a column that says which are corrected. cal: (keys, f, mag, phase in mrad)."""
    flat = unwrapped_by_delay(cal.where("mag is not null and phase is not null and f > 0"), keys, "f", "phase")
    own = C.interpolated(fc, flat, keys, "f", ["mag", "unwrapped"], ["_mag", "_phase"])
    whole = F.col("_mag").isNotNull() & F.col("_phase").isNotNull()
    own = own if flag is None else own.withColumn(flag, whole)
    return divided(own, "re", "im", F.when(whole, F.col("_mag")).otherwise(1.0), F.when(whole, F.col("_phase") / 1000).otherwise(0.0)).drop("_mag", "_phase")


def antenna_corrected(fc: DataFrame, cal: DataFrame, keys: list[str]) -> DataFrame:
    """The same for antennas: phase over log2 f, magnitude with both axes logarithmic; frequency 0 becomes 0. cal: (keys, base_frequency, mag, phz in mrad)."""
    knots = cal.select(*keys, F.log2("base_frequency").alias("_lf"), F.log2("mag").alias("_lm"), F.col("phz").alias("_p"))
    own = fc.withColumn("_lf", F.log2(F.nullif(F.col("f"), F.lit(0.0))))
    own = C.interpolated(own, knots, keys, "_lf", ["_lm", "_p"], ["_mag", "_phase"])
    own = divided(own, "re", "im", F.coalesce(F.pow(F.lit(2.0), F.col("_mag")), F.lit(1.0)), F.coalesce(F.col("_phase") / 1000, F.lit(0.0)))
    zero = F.col("f") == 0
    return own.withColumns({c: F.when(zero, 0.0).otherwise(F.col(c)) for c in ("re", "im")}).drop("_lf", "_mag", "_phase")


def calibrated_series(df: DataFrame, keys: list[str], order: list[str], value: str, rate: float, board: DataFrame, antenna: DataFrame | None = None) -> DataFrame:
    """(keys, i, value): whole series less the responses of their boards, and of their antennas where a table is given, through one spectrum of the
    series. Calibrations have the keys of the series. With antennas the mean becomes 0."""
    sums = R.spectrum(df, keys, order, value).withColumn("f", F.col("k") * rate / F.col("n"))
    sums = board_corrected(sums, board, keys)
    return R.series_of(sums if antenna is None else antenna_corrected(sums, antenna, keys), keys, value)


def write_as_text(series: DataFrame, keys: list[str], order: list[str], value: str, path: str) -> None:
    """One value a line in order, in a folder of its own for each series; the parts of a folder are in order by name. Missing values are `nan`."""
    line = F.when(F.col(value).isNull(), "nan").otherwise(F.format_string("%.18e", F.col(value).cast("double")))
    own = series.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    own.select(*keys, line.alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)
