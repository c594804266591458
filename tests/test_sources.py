import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from coilwave.functions import geometry as G
from coilwave.sources import calibrations as B
from coilwave.sources import ranged as N
from coilwave.sources import recordings as R

RATE = 16


def recording(records, rate=RATE, head="", week=1900, component="Hx", metadata="", junk=False):
    """records: (second, counts)."""
    text = f"A/D Rate={rate}\nGpsWeek={week}\nLat=0.7\nLong=-1.9\nChannelGain=2\nCh.Factor=0.5\nCH.CMP={component}\n{head}"
    out = text.encode().ljust(512) + b" " * 512
    out += (R.METADATA_ID + b"CH.ANTSN=2314|CH.AZIMUTH=10|CH.XYZ1=1:2:3|RX.STN=5|" + metadata.encode()).ljust(511) + b"\0"
    out += b"$cal,1\0"
    out += b"x" * (-len(out) % 4)
    for second, counts in records:
        out += R.FLAG + struct.pack("<Idd4sIf24s", second * 1024, 0.7, -1.9, b"abcd", 3, 21.5, bytes(range(24))) + np.asarray(counts, "<i4").tobytes()
    return out


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    rng = np.random.default_rng(1)
    whole = [(100 + i, rng.integers(-1000, 1000, RATE)) for i in range(5)]
    short = [(604_798 + i if i < 2 else i - 2, np.arange(RATE if i < 3 else RATE - 3) + i) for i in range(4)]
    (tmp_path / "a.z3d").write_bytes(recording(whole))
    (tmp_path / "deep" / "b.Z3D").write_bytes(recording(short, component="Ex", metadata="TX.SENSE=4|RX.STN=6|CH.XYZ2=4:5:6"))
    (tmp_path / "none.z3d").write_bytes(recording([]))
    (tmp_path / "twice.z3d").write_bytes(recording(whole, head="GpsWeek=3\n"))
    (tmp_path / "stub.z3d").write_bytes(b"tiny")
    (tmp_path / "other.txt").write_bytes(b"tiny")
    return tmp_path, whole, short


def by_name(df):
    return {r["path"].rsplit("/", 1)[-1]: r for r in df.collect()}


def test_catalog(spark, folder):
    got = by_name(R.catalog(R.files(spark, str(folder[0]))))
    assert {k: r["error"] for k, r in got.items()} == {"a.z3d": None, "b.Z3D": None, "none.z3d": "no records", "twice.z3d": "duplicate key GpsWeek", "stub.z3d": "shorter than two header blocks"}
    a, b = got["a.z3d"], got["b.Z3D"]
    assert a["valid"] and a["num_records"] == 5 and (a["end"] - a["start"]).total_seconds() == 4
    assert (a["antenna"], a["azimuth"], a["dx1"], a["dx2"], a["station"]) == ("2314", 10.0, 1.0, None, "5")
    assert (b["antenna"], b["dz2"], b["station"]) == (None, 6.0, "6") and (b["end"] - b["start"]).total_seconds() == 3
    assert a["lat"] == pytest.approx(math.degrees(0.7))


def test_samples_and_check(spark, folder):
    path, whole, short = folder
    files = R.files(spark, str(path))
    heads, records = R.headers(files), R.records(files)
    rows = R.samples(records, heads).orderBy("path", "record_no").collect()
    a = [r["values"] for r in rows if r["path"].endswith("a.z3d")]
    assert np.allclose(a, [np.asarray(c) * 0.25 for _, c in whole])
    b = [r["values"] for r in rows if r["path"].endswith("b.Z3D")]
    assert b[3] == [(k + 3) * 0.5 / 2 / 4 for k in range(RATE - 3)] + [None] * 3
    checks = {r["file"].rsplit("/", 1)[-1]: (r["code"], r["n_records"], r["missing_bytes"]) for r in R.checked(records, heads).collect()}
    assert checks == {"a.z3d": (0, 5, 0), "b.Z3D": (-2, 4, 12)}


def test_records_by_ranges(spark, folder):
    """Equal rows for any split, whole files or parts of them; flags that are not aligned, or cut by a range, are told apart."""
    path, whole, short = folder
    odd = recording([(7, np.arange(9)), (8, np.arange(4))])
    (path / "flagged.z3d").write_bytes(odd + b"\xff" + R.FLAG + b"\0\0\0" + R.FLAG + b"cut off")
    (path / "void.z3d").write_bytes(b"")
    files = R.files(spark, str(path))
    key = lambda r: (r["path"], r["record_no"])
    want = sorted((r.asDict() for r in R.records(files).collect()), key=key)
    assert len(want) == 5 + 4 + 5 + 2
    for split in (8, 100, 1 << 20):
        got = sorted((r.asDict() for r in N.records(spark, str(path), split, 20_000).collect()), key=key)
        assert got == want, split
        lengths = {(r["path"], r["position"]): r["length"] for r in N.record_lengths(spark, str(path), split).collect()}
        assert {(r["path"], r["position"]): r["length"] for r in want}.items() <= lengths.items()
    assert N.records(spark, str(path), 64, 64).select(F.spark_partition_id()).distinct().count() > 1


def test_chunks_of_long_records(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    (tmp_path / "a.z3d").write_bytes(recording([(i, rng.integers(-9, 9, 300)) for i in range(9)]))
    data = (tmp_path / "a.z3d").read_bytes()
    for chunk in (8, 12, 100, 1204, 5000):
        monkeypatch.setattr(N, "CHUNK", chunk)
        for split in (400, 1300, 20_000):
            rows = []
            for start in range(0, len(data), split):
                with N.opened(str(tmp_path / "a.z3d"))[0].open_input_file(str(tmp_path / "a.z3d")) as f:
                    rows += [r for b in N._records(f, "a", start, min(start + split, len(data)), len(data)) for r in b.to_pylist()]
            assert [r["position"] for r in rows] == R.flags(data).tolist() and all(len(r["counts"]) == 300 for r in rows)


def test_catalog_from_ends(spark, folder, monkeypatch):
    path, whole, short = folder
    (path / "cut.z3d").write_bytes(recording(whole) + R.FLAG + b"cut")
    (path / "q.z3d").write_bytes(recording(whole, component="Q1"))
    want = {k: r.asDict() for k, r in by_name(R.catalog(R.files(spark, str(path)))).items()}
    got = {k: r.asDict() for k, r in by_name(N.catalog(spark, str(path))).items()}
    assert got == want and got["q.z3d"]["error"] == "unknown component Q1"
    heads = by_name(N.heads(spark, str(path), second=True))
    assert (heads["a.z3d"]["second_stamp"], heads["a.z3d"]["last_stamp"], heads["none.z3d"]["last_record"]) == (101 * 1024, 104 * 1024, None)
    long = tmp = path / "deep" / "long.z3d"
    long.write_bytes(recording([(i, np.zeros(1 << 12)) for i in range(200)]))
    read = []
    class Counted:
        def __init__(self, f):
            self.f, self.seek = f, f.seek
        def read(self, n):
            read.append(n)
            return self.f.read(n)
    with tmp.open("rb") as f:
        assert N._head(Counted(f), "x", long.stat().st_size, 0, False)[-1] == 199 * 1024
    assert sum(read) < 5 * N.END < long.stat().st_size / 9


def test_growing_catalog(spark, folder, tmp_path):
    import os

    path, whole, _ = folder
    kept = str(tmp_path / "kept-catalog")
    first = N.grown_catalog(spark, str(path), kept)
    plain = by_name(N.catalog(spark, str(path)))
    assert {k: r["error"] for k, r in by_name(first).items()} == {k: r["error"] for k, r in plain.items()} and len(plain) == 5
    # what has not changed is not opened: a file broken behind its time and size stays as it was read
    old = (path / "a.z3d").stat()
    (path / "a.z3d").write_bytes(b"?" * old.st_size)
    os.utime(path / "a.z3d", ns=(old.st_atime_ns, old.st_mtime_ns))
    (path / "new.z3d").write_bytes(recording(whole[:2]))
    (path / "none.z3d").unlink()
    (path / "stub.z3d").write_bytes(recording(whole[:3]))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "kept-catalog").rglob("*.parquet")}
    before = files()
    got = by_name(N.grown_catalog(spark, str(path), kept))
    assert set(got) == {"a.z3d", "b.Z3D", "twice.z3d", "stub.z3d", "new.z3d"}
    assert got["a.z3d"]["valid"] and got["new.z3d"]["num_records"] == 2 and got["stub.z3d"]["num_records"] == 3
    between = files()
    assert between != before and len(between) <= 6
    assert len(N.grown_catalog(spark, str(path), kept).collect()) == 5 and files() == between


def test_only_paths_that_are_asked_for_are_opened(spark, folder):
    path = f"file:{folder[0]}"
    (folder[0] / "a2.z3d").write_bytes(b"broken")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = N.heads(spark, path).where(F.col("path") == f"{path}/a.z3d")
        assert [r["path"] for r in got.collect()] == [f"{path}/a.z3d"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = N.FilteringReader({"path": path, "mode": "heads"})
    list(reader.pushFilters([N.In(("path",), (f"{path}/a.z3d", "x")), N.EqualTo(("file_size",), 3)]))
    assert [r[0] for p in reader.partitions() for r in p.ranges] == [f"{path}/a.z3d"]


def test_failed_writes_leave_nothing(spark, tmp_path):
    rows = spark.range(20, numPartitions=2).select(F.lit(str(tmp_path / "x.z3d")).alias("target"), F.col("id").alias("place"), F.when(F.col("id") < 19, F.lit(b"ab")).otherwise(F.raise_error(F.lit("stop"))).cast("binary").alias("bytes"))
    spark.dataSource.register(N.Recordings)
    with pytest.raises(Exception, match="stop"):
        rows.repartition("target").sortWithinPartitions("place").write.format("recordings").mode("append").save(str(tmp_path))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="two tasks"):
        rows.where("id < 19").write.format("recordings").mode("append").save(str(tmp_path))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_rates_and_missing_samples(spark, tmp_path):
    data = recording([(1, np.arange(RATE)), (2, np.arange(RATE - 2)), (3, np.arange(RATE))])
    (tmp_path / "a.z3d").write_bytes(data.replace(b"A/D Rate=16\n", b"A_D Rate=16\n"))
    records, heads = N.records(spark, str(tmp_path)), N.heads(spark, str(tmp_path))
    assert R.rates(records, heads).first()["rate"] == RATE
    samples = R.samples(records, heads)
    assert [len(r["values"]) for r in samples.collect()] == [RATE] * 3
    assert sorted(r["sample"] for r in R.missing_samples(samples).collect()) == [2 * RATE - 2, 2 * RATE - 1]


def test_rotation_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    counts = rng.integers(-10_000, 10_000, (3, 4, RATE))
    for k in range(3):
        (tmp_path / f"f{k}.z3d").write_bytes(recording([(9 + i, c[: RATE - (k == 2 and i == 3)]) for i, c in enumerate(counts[k])]))
    records = N.records(spark, str(tmp_path), split=200, pack=300)
    names = sorted(r["path"] for r in R.files(spark, str(tmp_path)).select("path").collect())
    N.write(records, N.preambles(spark, str(tmp_path)), str(tmp_path / "same"), F.regexp_replace("path", "/(f[0-9].z3d)$", "/same/$1"))
    for k in range(3):
        assert (tmp_path / "same" / f"f{k}.z3d").read_bytes() == (tmp_path / f"f{k}.z3d").read_bytes()
    triplets = spark.createDataFrame([(*names, 35.0, 35.3, 35.5, 9.0), (names[0], "", None, 1.0, 1.0, 1.0, 1.0)], "file1 string, file2 string, file3 string, a double, b double, c double, d double")
    matrix = G.triaxial_to_geographic(F.col("a"), F.col("b"), F.col("c"), F.col("d"), "deg")
    m = np.array(triplets.limit(1).select(F.array(*[F.array(*row) for row in matrix])).first()[0])
    only = N.preambles(spark, str(tmp_path)).where(F.col("path").isin(names))
    N.write(R.rotated(records.where(F.col("path").isin(names)), triplets, matrix), only, str(tmp_path), R.renamed(F.col("path")))
    assert not (tmp_path / "_temporary").exists() or not list((tmp_path / "_temporary").iterdir())
    back = N.records(spark, str(tmp_path)).where("path like '%_rot.z3d'").orderBy("path", "record_no").collect()
    assert len(back) == 12
    for r in back:
        k, i = int(r["path"][-9]), r["record_no"]
        n = RATE - (i == 3)
        assert np.abs(np.array(r["counts"]) - (m @ counts[:, i, :n])[k]).max() < 1 + 1e-6 and len(r["counts"]) == n
        assert (bytes(r["status"]), bytes(r["opaque"]), r["gps_stamp"]) == (b"abcd", bytes(range(24)), (9 + i) * 1024)


def test_small_files_need_no_numbers_from_the_driver(spark, tmp_path, monkeypatch):
    """A file is opened once for a piece and counts as one opening; only files of several pieces are numbered from counts, and a file's pieces do not depend on the others."""
    for k in range(40):
        (tmp_path / f"f{k}.z3d").write_bytes(recording([(i, np.arange(RATE)) for i in range(50)]))
    (tmp_path / "long.z3d").write_bytes(recording([(i, np.arange(RATE)) for i in range(900)]))
    options = {"path": str(tmp_path), "split": "1024", "pack": str(5 * N.OPENING)}
    parts = [p.ranges for p in N.Reader(options).partitions()]
    pieces = [r[:3] for p in parts for r in p]
    assert len(pieces) == 42 and len(parts) < 20
    cut = N.Reader(options | {"mode": "flags", "cut": "true"})
    assert [r[:3] for p in cut.partitions() for r in p.ranges] == [r for r in pieces if r[0].endswith("long.z3d")] and len({r[1] for r in pieces}) == 2
    opened = []
    monkeypatch.setattr(N, "opened", lambda name, f=N.opened: opened.append(name) or f(name))
    rows = [r for p in parts for b in N.Reader(options).read(N.Ranges(p)) for r in b.to_pylist()]
    assert len(opened) == 42 and len(rows) == 40 * 50 + 900
    assert [r["place"] for r in rows if r["path"].endswith("f7.z3d")] == list(range(50))
    monkeypatch.undo()
    got = {(r["path"], r["position"]): r["record_no"] for r in N.records(spark, str(tmp_path), 1024, 5 * N.OPENING).collect()}
    assert got == {(r["path"], r["position"]): r["record_no"] for r in R.records(R.files(spark, str(tmp_path))).collect()}


def test_triplets_that_share_files(spark, tmp_path):
    """Each record is read once, whatever triplets its file is in; a triplet named twice gives its records twice, and records that one of three lacks are left out."""
    names = [f"file:{tmp_path}/f{k}.z3d" for k in range(4)]
    for k in range(4):
        (tmp_path / f"f{k}.z3d").write_bytes(recording([(i, np.arange(RATE) + 100 * k + i) for i in range(3 - (k == 3))]))
    records = N.records(spark, str(tmp_path), split=200, pack=300)
    triplets = spark.createDataFrame([(names[0], names[1], names[2]), (names[0], names[1], names[2]), (names[3], names[0], names[0])], "file1 string, file2 string, file3 string")
    turned = R.rotated(records, triplets, [[F.lit(float(x)) for x in row] for row in ((0, 1, 0), (1, 0, 0), (0, 0, 2))])
    assert turned.columns == [c.split()[0] for c in R.RECORD_SCHEMA.split(", ")][:2] + [c for c in records.columns if c not in ("path", "record_no", "counts")] + ["counts"]
    values = lambda k, i, by=1: [by * (x + 100 * k + i) for x in range(RATE)]
    want = [(names[a], i, values(b, i, by)) for _ in range(2) for a, b, by in ((0, 1, 1), (1, 0, 1), (2, 2, 2)) for i in range(3)]
    want += [(names[a], i, values(b, i, by)) for a, b, by in ((3, 0, 1), (0, 3, 1), (0, 0, 2)) for i in range(2)]
    assert sorted((r["path"], r["record_no"], list(r["counts"])) for r in turned.collect()) == sorted(want)


def test_board_texts(spark, tmp_path):
    row = lambda card: ",".join([card, "2", "4096", "1", " ", *[str(x) for x in range(1, 11)]])
    (tmp_path / "zen7.cal").write_text("$CAL.VER,29\n" + row("0xab key 1") + "\n")
    (tmp_path / "zen8.cal").write_text("$CAL.VER,31\n$GDP.SN,88\n\n" + row("0xcd") + "\n")
    files = B.texts(spark, str(tmp_path), "zen*.cal")
    raw = {r["CARDSNX"]: r for r in B.board_rows(files).collect()}
    assert raw["0xab"]["HDWKEY"] == "key 1" and raw["0xcd"]["HDWKEY"] is None and raw["0xcd"]["ATTEN"] is None
    got = {(r["box"], r["CALFREQ"]): (r["MAG"], r["PHASE"]) for r in B.boards(files).collect()}
    assert got == {(box, 2.0 * h): (2.0 * k + 1, 2.0 * k + 2) for box in ("7", "88") for k, h in enumerate(B.HARMONICS)}


def test_antenna_text(spark, tmp_path):
    (tmp_path / "antenna.cal").write_text("AMT antenna 3.9\n 11 1 2 3 4\n\nAMT antenna 8\n 11 5 6 7 8\n")
    got = sorted(tuple(r) for r in B.antennas(B.texts(spark, str(tmp_path))).collect())
    assert got == [("11", 4.0, 1.0, 2.0), ("11", 6.0, 3.0, 4.0), ("11", 8.0, 5.0, 6.0), ("11", 12.0, 7.0, 8.0)]


def test_delay_and_correction(spark):
    f = [2.0**k for k in range(-2, 8)]
    true = [-40.0 * x for x in f]
    seen = [(p / 1000 + math.pi / 2) % math.pi * 1000 - math.pi / 2 * 1000 for p in true]
    cal = spark.createDataFrame([(1, x, 2.0 + x, p) for x, p in zip(f, seen, strict=True)], "k int, f double, mag double, phase double")
    got = {r["f"]: r["unwrapped"] for r in B.unwrapped_by_delay(cal, ["k"], "f", "phase").collect()}
    assert [got[x] for x in f] == pytest.approx(true)
    fc = spark.createDataFrame([(1, 3.0, 1.0, 2.0), (2, 3.0, 1.0, 2.0)], "k int, f double, re double, im double")
    one, two = (complex(r["re"], r["im"]) for r in B.board_corrected(fc, cal, ["k"]).orderBy("k").collect())
    assert one == pytest.approx((1 + 2j) / (5 * complex(math.cos(-0.12), math.sin(-0.12)))) and two == 1 + 2j
    ant = spark.createDataFrame([(1, 2.0, 1.0, 0.0), (1, 8.0, 4.0, 200.0)], "k int, base_frequency double, mag double, phz double")
    fc = spark.createDataFrame([(1, 4.0, 2.0, 0.0), (1, 0.0, 2.0, 1.0)], "k int, f double, re double, im double")
    got = {r["f"]: complex(r["re"], r["im"]) for r in B.antenna_corrected(fc, ant, ["k"]).collect()}
    assert got[0.0] == 0 and got[4.0] == pytest.approx(complex(math.cos(-0.1), math.sin(-0.1)))


def test_whole_series_through_their_calibrations(spark, tmp_path):
    rate, rng = 64.0, np.random.default_rng(4)
    series = {"a": rng.normal(size=128), "b": rng.normal(size=75)}
    knots = [float(f) for f in range(1, 33)]
    board = [("a", f, 2.0 + f / 100, -3.0 * f) for f in knots]
    antenna = [("a", f, 3.0, 100.0) for f in (0.5, 64.0)]
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "file string, i long, v double")
    boards = spark.createDataFrame(board, "file string, f double, mag double, phase double")
    antennas = spark.createDataFrame(antenna, "file string, base_frequency double, mag double, phz double")
    got = B.calibrated_series(df, ["file"], ["i"], "v", rate, boards, antennas).collect()
    for k, x in series.items():
        sums, f = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / rate)
        if k == "a":
            sums = sums / ((2 + f / 100) * np.exp(-3e-3j * f)) / (3 * np.exp(0.1j))
        sums[0] = 0
        own = dict((r.i, r.v) for r in got if r.file == k)
        assert [own[i] for i in range(len(x))] == pytest.approx(list(np.fft.irfft(sums, len(x))))
    B.write_as_text(df, ["file"], ["i"], "v", str(tmp_path / "text"))
    for k, x in series.items():
        lines = [line for part in sorted((tmp_path / "text" / f"file={k}").glob("part-*")) for line in part.read_text().splitlines()]
        assert [float(line) for line in lines] == list(x)
