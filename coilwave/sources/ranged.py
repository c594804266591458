"""Recordings read by byte ranges and written record by record: a data source for files of any size.

    spark.dataSource.register(Recordings)
    spark.read.format("recordings").option("mode", "records").option("split", 64 << 20).load(folder)

Folders are local paths or URIs that pyarrow.fs opens (file, s3, gs, hdfs and others); all machines must reach them. A range has the
records whose flags begin in it: a task looks for the first flag at or after the start of its range and reads on past its end until
the last one's record is whole. Flags stand at multiples of four bytes, and so do ranges. A task has ranges of a file that follow one
another, a piece: a file is cut into pieces by its own length alone, whatever else lies in the folder. Small files share a task."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as A
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from coilwave.sources import recordings as R
from coilwave.tables import written

#: Bytes of a range and of a task's ranges, unless the options `split` and `pack` say otherwise, and what opening a file counts for, once for each piece.
SPLIT, OPENING = 64 << 20, 1 << 14
#: Bytes that are read at once.
CHUNK = 4 << 20
#: What is read of either end of a file at first; twice as much each time, until a flag is found.
END = 1 << 16

SCHEMAS = {
    # records with all their fields; range_start and place (from 0) say where their piece of the file begins and which of its records it is
    "records": "path string, range_start long, place long, position long, length long, gps_stamp long, lat double, lon double, status binary, accuracy long, temperature float, opaque binary, counts array<int>",
    # where records begin, without what they hold
    "flags": "path string, range_start long, place long, position long, file_size long",
    # a row a file from its two ends; modified in microseconds since 1970
    "heads": R.HEADER_SCHEMA + ", modified long, first_stamp long, second_record long, second_stamp long, last_record long, last_stamp long",
    # a row a file without opening it
    "files": "path string, file_size long, modified long",
    # bytes before the first record
    "preambles": "path string, preamble binary",
}


def opened(folder: str) -> tuple[A.FileSystem, str, str]:
    """The file system of a path or URI, the path in it, and what stands before paths of it in a URI."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    if "://" not in folder:
        return A.LocalFileSystem(), folder, "file:"
    system, path = A.FileSystem.from_uri(folder)
    return system, path, folder[: folder.rindex(path)] if path in folder else ""


@dataclass
class Ranges(InputPartition):
    """(path, start, end, file size, modified) of one or more pieces of files."""

    ranges: list[tuple[str, int, int, int, int]]


def aligned_flags(data: bytes, at: int) -> np.ndarray:
    """Places in the file of the flags in `data`, which begins at the file's byte `at`, a multiple of four."""
    return R.flags(data) + at


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.mode, self.split = options["path"], options.get("mode", "records"), max(8, int(options.get("split", SPLIT)) // 4 * 4)
        self.pack = int(options.get("pack", max(SPLIT, self.split)))
        self.second, self.cut = (options.get(o, "false").lower() == "true" for o in ("second", "cut"))
        self.paths = set(options["only"].split("\n")) if options.get("only") else None

    def partitions(self) -> list[Ranges]:
        system, path, prefix = opened(self.folder)
        found = system.get_file_info(path)
        infos = [found] if found.type == A.FileType.File else system.get_file_info(A.FileSelector(path, recursive=True))
        packed: list[list] = [[]]
        room, ranged = self.pack, self.mode in ("records", "flags")
        piece = max(1, self.pack // self.split) * self.split
        for i in sorted(infos, key=lambda i: i.path):
            name = prefix + i.path
            hidden = any(x.startswith((".", "_")) for x in i.path.removeprefix(path).split("/"))
            if i.type != A.FileType.File or hidden or not i.path.lower().endswith(".z3d") or (self.paths is not None and name not in self.paths):
                continue
            if self.cut and i.size <= piece:
                continue
            step = piece if ranged else max(1, i.size)
            for start in range(0, max(1, i.size), step):
                end = min(start + step, i.size)
                cost = (end - start if ranged else END) + OPENING
                if cost > room and packed[-1]:
                    packed.append([])
                    room = self.pack
                room -= cost
                packed[-1].append((name, start, end, i.size, (i.mtime_ns or 0) // 1000))
        return [Ranges(p) for p in packed if p] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        if self.mode == "records":
            yield from _batches(self._pieces(partition))
            return
        for name, start, end, size, modified in partition.ranges:
            if self.mode == "files":
                yield _batch(self.mode, [(name, size, modified)])
                continue
            system, path, prefix = opened(name)
            with system.open_input_file(path) as f:
                if self.mode == "heads":
                    yield _batch(self.mode, [_head(f, name, size, modified, self.second)])
                elif self.mode == "preambles":
                    first, data = _first_flag(f, size)
                    yield _batch(self.mode, [(name, data[: size if first is None else first])])
                elif self.mode == "flags":
                    place = 0
                    for at in _flags(f, start, end, size):
                        n = len(at)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.full(n, start)), pa.array(np.arange(place, place + n)), pa.array(at), pa.array(np.full(n, size))], ["path", "range_start", "place", "position", "file_size"])
                        place += n

    def _pieces(self, partition: Ranges) -> Iterator[tuple]:
        """Rows of a task's pieces, range by range; a file is opened once for a piece."""
        for name, start, end, size, _ in partition.ranges:
            system, path, _ = opened(name)
            with system.open_input_file(path) as f:
                place = 0
                for at in range(start, end, self.split):
                    place = yield from _rows(f, name, at, min(at + self.split, end), size, start, place)


class FilteringReader(Reader):
    """For sessions in which spark.sql.python.filterPushdown.enabled is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Files that the conditions on `path` leave out are never opened; Spark still applies every condition."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.paths = {f.value} if self.paths is None else self.paths & {f.value}
            elif isinstance(f, In) and f.attribute == ("path",):
                self.paths = set(f.value) if self.paths is None else self.paths & set(f.value)
            yield f


def _flags(f: pa.NativeFile, start: int, end: int, size: int) -> Iterator[np.ndarray]:
    """Places of the flags that begin in a range, chunk by chunk."""
    for at in range(start, end, CHUNK):
        upto = min(at + CHUNK, end)
        f.seek(at)
        # four bytes more, for a flag across the seam
        found = aligned_flags(f.read(min(upto + 4, size) - at), at)
        if len(found := found[found < upto]):
            yield found


def _records(f: pa.NativeFile, name: str, start: int, end: int, size: int) -> Iterator[pa.RecordBatch]:
    yield from _batches(_rows(f, name, start, end, size, start, 0))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, R.BATCH)):
        yield _batch("records", some)


def _rows(f: pa.NativeFile, name: str, start: int, end: int, size: int, piece: int, place: int) -> Generator[tuple, None, int]:
    """Records of a range, of which the first one is number `place` of its piece; returns the number that comes next."""
    data, at, read = b"", start, start
    while True:
        f.seek(read)
        # little more than the range holds, then twice as much each time
        more = f.read(min(CHUNK, max(end - read, len(data)) + END))
        data, read = data + more, read + len(more)
        found = aligned_flags(data, at)
        whole = read >= size
        ends = np.append(found[1:], size) if whole else found[1:]
        for p, q in zip(found.tolist(), ends.tolist(), strict=False):
            if p >= end:
                break
            # a last record cut within its 64 bytes is left out
            if q - p >= R.RECORD_HEADER:
                stamp, lat, lon, status, accuracy, temperature, opaque = struct.unpack_from("<Idd4sIf24s", data, p - at + len(R.FLAG))
                # a copy, as a batch may have records of many ranges
                counts = np.frombuffer(data, "<i4", (q - p - R.RECORD_HEADER) // 4, p - at + R.RECORD_HEADER).copy()
                yield name, piece, place, p, q - p, stamp, lat, lon, status, accuracy, temperature, opaque, counts
            place += 1
        if whole or (len(found) and found[-1] >= end) or (not len(found) and read >= end + len(R.FLAG)):
            return place
        # from the last flag on, or what may be the beginning of one
        keep = int(found[-1]) if len(found) else max(start, read // 4 * 4 - len(R.FLAG))
        data, at = data[keep - at :], keep


def _first_flag(f: pa.NativeFile, size: int) -> tuple[int | None, bytes]:
    """Where the first record begins, and the bytes read to find it. A file without records is read to its end."""
    data = b""
    while len(data) < size:
        f.seek(len(data))
        data += f.read(max(END, len(data)))
        found = R.flags(data)
        if len(found):
            return int(found[0]), data
    return None, data


def _head(f: pa.NativeFile, name: str, size: int, modified: int, want_second: bool) -> tuple:
    first, data = _first_flag(f, size)
    own, text, error = None, None, None
    try:
        own, text = R.header(data)
    except ValueError as e:
        error = str(e)
    stamp = lambda p: struct.unpack("<I", _part(f, p + len(R.FLAG), 4))[0] if p is not None and size - p >= R.RECORD_HEADER else None
    second = last = None
    if first is not None:
        reach = END
        while last is None:
            begin = max(first, (size - reach) // 4 * 4)
            found = aligned_flags(_part(f, begin, size - begin), begin)
            found = found[size - found >= R.RECORD_HEADER]
            if len(found):
                last = int(found[-1])
            elif begin == first:
                break
            reach *= 2
        if want_second:
            second = next((int(x[0]) for x in _flags(f, first + 4, size, size)), None)
    return (name, size, first, own, text, error, modified, stamp(first), second, stamp(second), last, stamp(last))


def _part(f: pa.NativeFile, start: int, n: int) -> bytes:
    f.seek(start)
    return f.read(n)


_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "float": pa.float32(), "binary": pa.binary(), "map<string, string>": pa.map_(pa.string(), pa.string()), "array<int>": pa.list_(pa.int32())}


def _batch(mode: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split(" ", 1) for x in SCHEMAS[mode].replace("map<string, string>", "map<string,string>").split(", ")]
    kinds = [_KINDS[k.replace(",", ", ")] for _, k in fields]
    columns = [pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and the names that its files, 0, 1 and so on, are to have."""

    folder: str
    targets: list[str]


class Writer(DataSourceArrowWriter):
    """Files from rows (target, place, bytes), sorted by target and place within a task; a target's rows are in one task.

    Files are written to a folder of the job below `_temporary` and get their names when all tasks have ended; if one fails for good, that folder goes."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.job = f"{self.folder}/_temporary/{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, job, _ = opened(f"{self.job}/{uuid.uuid4().hex}")
        done: dict[str, None] = {}
        out, target = None, None
        try:
            for batch in batches:
                for name, part in zip(batch.column("target").to_pylist(), batch.column("bytes"), strict=True):
                    if name != target:
                        if out:
                            out.close()
                        if name in done:
                            raise ValueError(f"rows of {name} are not together")
                        if not done:
                            system.create_dir(job, recursive=True)
                        out, target = system.open_output_stream(f"{job}/{len(done)}"), name
                        done[name] = None
                    out.write(part.as_buffer())
        finally:
            if out:
                out.close()
        return Written(job, list(done))

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m]
        if len({t for m in done for t in m.targets}) < sum(len(m.targets) for m in done):
            self.abort(messages)
            raise ValueError("a file was written by two tasks")
        system, _, _ = opened(self.job)
        folders: set[str] = set()
        for m in done:
            for k, target in enumerate(m.targets):
                path = opened(target)[1]
                if (folder := path.rsplit("/", 1)[0]) not in folders:
                    system.create_dir(folder, recursive=True)
                    folders.add(folder)
                system.move(f"{m.folder}/{k}", path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, job, _ = opened(self.job)
        if system.get_file_info(job).type == A.FileType.Directory:
            system.delete_dir(job)


class Recordings(DataSource):
    """Options: mode (see SCHEMAS), split (bytes of a range), pack (bytes of a task), second (true: heads also tell the second record), cut (true: only files in several pieces), only (only these paths, one a line)."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("mode", "records")]

    def reader(self, schema: StructType) -> Reader:
        options = dict(self.options)
        return FilteringReader(options) if options.get("filtering") == "true" else Reader(options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def _read(spark: SparkSession, folder: str, mode: str, **options: object) -> DataFrame:
    spark.dataSource.register(Recordings)
    filtering = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("recordings").options(mode=mode, filtering=filtering, **{k: str(v) for k, v in options.items()}).load(folder)


def records(spark: SparkSession, folder: str, split: int = SPLIT, pack: int = SPLIT) -> DataFrame:
    """Every record of a folder's recordings, as recordings.records() gives them, whatever the split; files may have any size.

    A file of one piece is numbered as it is read. Longer ones are read before, and how many flags stand before each of their pieces is sent to the
    tasks: a row for each piece but the first, so at most one for every `pack` bytes. No record is moved."""
    held = _read(spark, folder, "records", split=split, pack=pack)
    counts = _read(spark, folder, "flags", split=split, pack=pack, cut=True).groupBy("path", "range_start").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("path", "range_start", before.alias("_base")).where("range_start > 0")
    named = [c.split()[0] for c in R.RECORD_SCHEMA.split(", ")]
    numbered = held.join(F.broadcast(bases), ["path", "range_start"], "left").where("range_start = 0 or _base is not null")
    return numbered.withColumn("record_no", F.coalesce("_base", F.lit(0)) + F.col("place")).select(*named)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_size, modified) of every recording below a folder; none is opened."""
    return _read(spark, folder, "files")


def heads(spark: SparkSession, folder: str, second: bool = False, paths: list[str] | None = None) -> DataFrame:
    """A row a file, from its first and last bytes: what recordings.headers() tells, and places and stamps of the first, the last and, if asked
    for, the second record; only of `paths`, if they are given. What is read does not grow with the length of files that have records."""
    return _read(spark, folder, "heads", second=second, **({} if paths is None else {"only": "\n".join(["", *paths])}))


def record_lengths(spark: SparkSession, folder: str, split: int = SPLIT, pack: int = SPLIT) -> DataFrame:
    """(path, position, length) of every record, in bytes: only flags are looked for."""
    found = _read(spark, folder, "flags", split=split, pack=pack)
    after = F.lead("position").over(Window.partitionBy("path").orderBy("position"))
    return found.select("path", "position", (F.coalesce(after, F.col("file_size")) - F.col("position")).alias("length"))


def catalog(spark: SparkSession, folder: str, paths: list[str] | None = None) -> DataFrame:
    """recordings.catalog() from heads and tails."""
    return described(heads(spark, folder, paths=paths))


def described(heads: DataFrame) -> DataFrame:
    return R.described(heads.withColumns({"_from": F.col("first_stamp"), "_to": F.col("last_stamp")}))


def grown_catalog(spark: SparkSession, folder: str, kept: str, parts: int = 16) -> DataFrame:
    """catalog() of a folder, kept as Parquet at `kept`, with file_size and modified. Only files that are new, or have another size or time than when they were
    read, are opened; files that are gone are marked so and left out. The kept table has `parts` parts by path, and only those that change are written."""
    part = F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int").alias("part")
    listed = written(files(spark, folder).select("*", part), "listed")
    same = ["path", "file_size", "modified"]
    try:
        had = spark.read.parquet(kept)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        had = None
    known = listed.where("false") if had is None else had.where("not gone")
    fresh = listed.join(known, same, "left_anti").select("path", "part").collect()
    gone = known.join(listed, "path", "left_anti").select("path", "part").collect()
    if fresh or gone or had is None:
        read = catalog(spark, folder, [r.path for r in fresh]).join(listed, "path").withColumn("gone", F.lit(False))
        if had is not None:
            old = had.where(F.col("part").isin({r.part for r in [*fresh, *gone]})).join(read.select("path"), "path", "left_anti")
            read = old.withColumn("gone", F.col("gone") | F.col("path").isin([r.path for r in gone])).unionByName(read)
        # Spark does not overwrite what it reads
        written(read, "catalog").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(kept)
    return spark.read.parquet(kept).where("not gone").drop("gone", "part")


def preambles(spark: SparkSession, folder: str) -> DataFrame:
    """(path, preamble): what stands before the first record, byte for byte."""
    return _read(spark, folder, "preambles")


def write(records: DataFrame, preambles: DataFrame, folder: str, target: Column) -> None:
    """Writes recordings from their preambles (path, preamble) and records below a folder; `target`, of path, is a file's new path. A file is
    written by one task, record after record, and appears when all are whole. A file without records is its preamble."""
    body = records.select("path", "record_no", R.record_bytes("gps_stamp", "lat", "lon", "status", "accuracy", "temperature", "opaque", "counts").alias("bytes"))
    parts = body.unionByName(preambles.select("path", F.lit(-1).cast("long").alias("record_no"), F.col("preamble").alias("bytes")))
    parts = parts.select(target.alias("target"), F.col("record_no").alias("place"), "bytes").repartition("target").sortWithinPartitions("target", "place")
    parts.sparkSession.dataSource.register(Recordings)
    parts.write.format("recordings").mode("append").save(folder)
