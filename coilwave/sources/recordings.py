"""Binary recordings: headers, records, samples and the catalog of a folder, and recordings written again.

A recording is two 512-byte header blocks, metadata blocks, a calibration text that ends in a zero byte, and records of one second:
64 bytes that begin with a flag, then 32-bit counts. Here Spark reads the files, so they may be in any store that it reads; a task holds
one file at a time, of up to 2 GB (a day and a half at 4096 samples a second). sources/ranged.py reads files of any size in parts,
and writes them. Nothing here imports pandas before a task needs it: the driver's helpers of the data source, a process each, import this module."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from coilwave.functions import timeconv as T
from coilwave.operators import catalog as C

if TYPE_CHECKING:
    import pandas as pd

# Fixed values of the format.
FLAG = b"\xff\xff\xff\x7f\x00\x00\x00\x80"
BLOCK = 512
METADATA_ID = b"\n\n\nGPS Brd339/Brd357 Metadata Record\n"
RECORD_HEADER = 64
CALIBRATION_BYTES = 32768
DEFAULT_FACTOR = 9.536743164062e-10
MOST_RECORDS = 604_800
# Records in a batch.
BATCH = 512

HEADER_SCHEMA = "path string, file_size long, first_record long, metadata map<string, string>, syscal string, error string"
RECORD_SCHEMA = "path string, record_no long, position long, length long, gps_stamp long, lat double, lon double, status binary, accuracy long, temperature float, opaque binary, counts array<int>"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every recording below a folder, whatever the case of its suffix."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[zZ]3[dD]").load(folder).select("path", "content")


def flags(content: bytes) -> np.ndarray:
    """Where records begin, in bytes; flags stand at multiples of four."""
    words = np.frombuffer(content, "<u4", len(content) // 4)
    first, second = struct.unpack("<II", FLAG)
    return np.flatnonzero((words[:-1] == first) & (words[1:] == second)) * 4 if len(words) > 1 else np.empty(0, int)


def header(content: bytes) -> tuple[dict[str, str], str]:
    """Key and value texts and the calibration text. A key twice in the header blocks is an error; in the metadata the last one counts."""
    if len(content) < 2 * BLOCK:
        raise ValueError("shorter than two header blocks")
    found: dict[str, str] = {}

    def pairs(text: str, between: str | None) -> Iterator[tuple[str, str]]:
        for part in text.splitlines() if between is None else text.split(between):
            key, _, value = part.partition("=")
            if key.strip() and key.strip().isprintable():
                yield key.strip(), value.strip()

    for start in (0, BLOCK):
        for key, value in pairs(content[start : start + BLOCK].decode("ascii"), None):
            if key in found:
                raise ValueError(f"duplicate key {key}")
            found[key] = value
    at, metadata = 2 * BLOCK, ""
    while content[at : at + len(METADATA_ID)] == METADATA_ID:
        lines = content[at + len(METADATA_ID) : at + BLOCK - 1].decode("ascii").splitlines()
        metadata += lines[0] if lines else ""
        at += BLOCK
    found.update(pairs(metadata, "|"))
    end = content.find(b"\0", at, at + CALIBRATION_BYTES)
    if end < 0:
        raise ValueError("no end of the calibration text")
    return found, content[at:end].decode("latin-1")


def headers(files: DataFrame) -> DataFrame:
    """One row a file: path, file_size, first_record (bytes; null without records), metadata, syscal, and error (null if it was read)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                own, text, error = None, None, None
                content = content or b""
                try:
                    own, text = header(content)
                except ValueError as e:
                    error = str(e)
                at = flags(content)
                yield pd.DataFrame({"path": [path], "file_size": [len(content)], "first_record": pd.array([at[0] if len(at) else None], "Int64"), "metadata": [own], "syscal": [text], "error": [error]})

    return files.select("path", "content").mapInPandas(run, HEADER_SCHEMA)


def records(files: DataFrame) -> DataFrame:
    """One row a record: its place, length in bytes, fields and all its counts. A file without flags has none; a last record cut
    within its 64 bytes is left out."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                content = content or b""
                at = flags(content)
                ends = np.append(at[1:], len(content))
                rows = []
                for no, (p, end) in enumerate(zip(at.tolist(), ends.tolist(), strict=False)):
                    if end - p < RECORD_HEADER:
                        continue
                    stamp, lat, lon, status, accuracy, temperature, opaque = struct.unpack_from("<Idd4sIf24s", content, p + len(FLAG))
                    counts = np.frombuffer(content, "<i4", (end - p - RECORD_HEADER) // 4, p + RECORD_HEADER)
                    rows.append((path, no, p, end - p, stamp, lat, lon, status, accuracy, temperature, opaque, counts))
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    columns = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    return files.select("path", "content").mapInPandas(run, RECORD_SCHEMA)


def number(metadata: Column, key: str) -> Column:
    return metadata[key].try_cast("double")


def factor(metadata: Column) -> Column:
    """What a count is worth: volts, or amperes where the file names the resistance it was sensed over."""
    volts = F.coalesce(number(metadata, "Ch.Factor"), F.lit(DEFAULT_FACTOR)) / F.coalesce(number(metadata, "ChannelGain"), F.lit(1.0))
    return volts / F.coalesce(number(metadata, "TX.SENSE"), F.lit(1.0))


def rates(records: DataFrame, headers: DataFrame) -> DataFrame:
    """(path, rate, factor): samples a record, from the header or, where it names none, as many as most of the file's records have."""
    usual = records.groupBy("path").agg(F.mode(F.floor((F.col("length") - RECORD_HEADER) / 4), deterministic=True).cast("int").alias("_usual"))
    own = headers.where("error is null").select("path", number(F.col("metadata"), "A/D Rate").cast("int").alias("_rate"), factor(F.col("metadata")).alias("factor"))
    return own.join(usual, "path").select("path", F.coalesce("_rate", "_usual").alias("rate"), "factor")


def samples(records: DataFrame, headers: DataFrame) -> DataFrame:
    """(path, record_no, gps_second, values): each record's values, as many as rates() says; what a short one lacks is null, what a long one has over is cut."""
    m = rates(records, headers).select("path", F.col("rate").alias("_rate"), F.col("factor").alias("_factor"))
    own = records.join(m, "path")
    known = F.transform(F.slice("counts", F.lit(1), F.col("_rate")), lambda c: c * F.col("_factor"))
    filled = F.concat(known, F.array_repeat(F.lit(None).cast("double"), F.greatest(F.col("_rate") - F.size("counts"), F.lit(0))))
    return own.select("path", "record_no", (F.col("gps_stamp") / 1024.0).alias("gps_second"), filled.alias("values"))


def missing_samples(samples: DataFrame) -> DataFrame:
    """(path, sample): places in their series (from 0) of the samples that short records lack."""
    return samples.select("path", "record_no", F.size("values").alias("_n"), F.posexplode("values").alias("_k", "_v")).where("_v is null").select("path", (F.col("record_no") * F.col("_n") + F.col("_k")).alias("sample"))


def checked(records: DataFrame, headers: DataFrame) -> DataFrame:
    """`catalog.check_records` over the records of files."""
    size = (RECORD_HEADER + 4 * number(F.col("metadata"), "A/D Rate")).cast("long")
    own = records.join(headers.where("error is null").select("path", "file_size", size.alias("record_size")), "path")
    return C.check_records(own.select(F.col("path").alias("file"), "position", "file_size", "record_size", F.floor(F.col("gps_stamp") / 1024).alias("gps_second")))


def catalog(files: DataFrame) -> DataFrame:
    """described() over files that are read whole; ranged.catalog() reads only their ends."""
    w = Window.partitionBy("path")
    r = records(files).select("path", "record_no", "gps_stamp").withColumn("_last", F.max("record_no").over(w)).where("record_no in (0, _last)")
    ends = r.groupBy("path").agg(F.min_by("gps_stamp", "record_no").alias("_from"), F.max_by("gps_stamp", "record_no").alias("_to"))
    return described(headers(files).join(ends, "path", "left"))


def described(h: DataFrame) -> DataFrame:
    """One row a file: whether it is valid (else why not), kind, rate, records, UTC start and end, place in degrees, component and geometry.
    h: headers(), with the stamps of the first and last records as _from and _to.

    num_records is the bytes from the first record on by the bytes of a full record. The week turns where a later stamp is smaller. A
    component is magnetic (H), electric (E) or a reference (R); a file of another one is not valid."""
    m = F.col("metadata")
    week = number(m, "GpsWeek").cast("long")
    rate = number(m, "A/D Rate")
    n = (F.col("file_size") - F.col("first_record")) / (RECORD_HEADER + 4 * rate)
    text = lambda *keys: F.coalesce(*[F.nullif(m[k], F.lit("")) for k in keys])
    error = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(rate.isNull(), "no sampling rate").when(week.isNull(), "no week")
        .when(F.col("_from").isNull(), "no records").when(n >= MOST_RECORDS, "a week or more of records")
        .when(~F.coalesce(F.substring(text("CH.CMP"), 1, 1).isin("H", "E", "R"), F.lit(False)), F.concat(F.lit("unknown component "), F.coalesce(text("CH.CMP"), F.lit(""))))
    )
    place = lambda key: F.degrees(number(m, key))
    one, two = C.offsets(text("CH.OFFSET.XYZ1", "CH.XYZ1")), C.offsets(text("CH.OFFSET.XYZ2", "CH.XYZ2"))
    component, magnetic = text("CH.CMP"), F.col("component").startswith("H")
    rows = h.select(
        "path", error.alias("error"), F.when(m["TX.SENSE"].isNotNull(), "TX").otherwise("RX").alias("type"), rate.alias("sampling_rate"), n.alias("num_records"),
        T.gps_stamp_to_utc(F.col("_from"), week).alias("start"), T.gps_stamp_to_utc(F.col("_to"), week + (F.col("_to") < F.col("_from")).cast("long")).alias("end"),
        place("Lat").alias("lat"), place("Long").alias("lon"), number(m, "Tx.Freq").alias("txfreq"), number(m, "Tx.Duty").alias("txduty"), text("TX.SN").alias("tx_sn"),
        text("CH.STN", "RX.STN").alias("station"), text("JOB.NUMBER").alias("job"), component.alias("component"), text("Box number").alias("box"), text("ChannelSerial").alias("channel_serial"),
        text("CH.ANTSN").alias("antenna"), number(m, "CH.AZIMUTH").alias("azimuth"), number(m, "CH.INCL").alias("inclination"), one.alias("_1"), two.alias("_2"),
    )
    rows = rows.withColumns({f"{d}1": F.col("_1")[d] for d in ("dx", "dy", "dz")} | {f"{d}2": F.when(~magnetic, F.col("_2")[d]) for d in ("dx", "dy", "dz")} | {"valid": F.col("error").isNull()})
    return rows.withColumns({c: F.when(magnetic, F.col(c)) for c in ("antenna", "azimuth", "inclination")}).drop("_1", "_2")


@F.arrow_udf(BinaryType())
def record_bytes(gps_stamp: pa.Array, lat: pa.Array, lon: pa.Array, status: pa.Array, accuracy: pa.Array, temperature: pa.Array, opaque: pa.Array, counts: pa.Array) -> pa.Array:
    fields = zip(*[x.to_pylist() for x in (gps_stamp, lat, lon, status, accuracy, temperature, opaque)], strict=True)
    return pa.array([FLAG + struct.pack("<Idd4sIf24s", *row) + own.values.to_numpy().astype("<i4").tobytes() for row, own in zip(fields, counts, strict=True)], pa.binary())


def rotated(records: DataFrame, triplets: DataFrame, matrix: list[list[Column]]) -> DataFrame:
    """Records of three files turned by a matrix over columns of triplets (file1, file2, file3, ...): counts cut to whole numbers, as many
    as the shortest of the three has; all other fields stay. Triplets without all three files are skipped; records whose seconds differ raise."""
    whole = triplets.where(" and ".join(f"file{k} is not null and file{k} <> ''" for k in (1, 2, 3)))
    names = ["file1", "file2", "file3", "_m"]
    whole = whole.select(*names[:3], F.array(*[F.array(*row) for row in matrix]).cast("array<array<double>>").alias("_m")).groupBy(*names).agg(F.count("*").alias("_n"))
    fields = [c for c in records.columns if c not in ("path", "record_no")]
    # every record is read once and meets the two others of its triplet by grouping
    sides = records.select("path", "record_no", F.struct(*fields).alias("_r")).join(whole.select("*", F.posexplode(F.array(*names[:3])).alias("_k", "path")), "path")
    own = sides.groupBy(*names, "_n", "record_no").agg(*[F.max(F.when(F.col("_k") == k - 1, F.col("_r"))).alias(f"_r{k}") for k in (1, 2, 3)]).where("_r1 is not null and _r2 is not null and _r3 is not null")
    second = lambda k: F.floor(F.col(f"_r{k}.gps_stamp") / 1024)
    own = own.withColumn("_m", F.when((second(1) == second(2)) & (second(1) == second(3)), F.col("_m")).otherwise(F.raise_error(F.lit("times of the records differ")).cast("array<array<double>>")))
    n = F.least(*[F.size(f"_r{k}.counts") for k in (1, 2, 3)])
    zipped = F.slice(F.arrays_zip(*[F.col(f"_r{k}.counts").alias(f"c{k}") for k in (1, 2, 3)]), F.lit(1), n)
    own = own.withColumn("_v", zipped)

    def side(k: int) -> Column:
        turned = F.transform("_v", lambda v: sum((F.col("_m")[k - 1][j] * v[f"c{j + 1}"] for j in (1, 2)), F.col("_m")[k - 1][0] * v["c1"]).cast("int"))
        return F.struct(F.col(f"file{k}").alias("path"), *[F.col(f"_r{k}.{c}").alias(c) for c in fields if c != "counts"], turned.alias("counts"))

    # a triplet that is named several times gives its records as often
    three = own.withColumn("_i", F.explode(F.sequence(F.lit(1), "_n"))).select("record_no", F.inline(F.array(*[side(k) for k in (1, 2, 3)])))
    return three.select("path", "record_no", *[c for c in fields if c != "counts"], "counts")


def renamed(path: Column, suffix: str = "_rot") -> Column:
    """A path with a suffix before its ending."""
    return F.regexp_replace(path, r"(\.[^./]*)$", f"{suffix}$1")
