"""Transmitter and receiver recordings of the same time: their samples side by side, checks, and transfer functions of each pair.

Records are rows (path, time, values): one second each, with the time it begins. A pair is a row (pair, tx_path, rx_path, start, end)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coilwave.operators import kernels as K
from coilwave.operators import series as S
from coilwave.operators import spectral as X
from coilwave.sources import calibrations as B
from coilwave.tables import written

# Readings from which a channel counts as clipped, the least whole cycles without one, and the harmonics of a result.
TX_MOST, RX_MOST, LEAST_CYCLES = 39.8, 1.99, 3
HARMONICS = (1, 3, 5, 7, 9)


def within(time: Column, start: Column, end: Column, start_offset: int = 0, end_offset: int = 0) -> Column:
    """Whether a record is inside a span moved by seconds at either end. Records begin at whole seconds; the end is not inside."""
    moved = lambda c, s: F.timestamp_micros(F.unix_micros(c.cast("timestamp")) + s * 1_000_000)
    second = F.date_trunc("second", time.cast("timestamp"))
    return (second >= moved(start, start_offset)) & (second < moved(end, end_offset))


def subset(records: DataFrame, spans: DataFrame, on: str, start_offset: int = 0, end_offset: int = 0) -> DataFrame:
    """Records of the spans (on, start, end, ...) with all columns of both: what lies in a span, each record once a span."""
    return records.join(spans, on).where(within(F.col("time"), F.col("start"), F.col("end"), start_offset, end_offset))


def paired_records(records: DataFrame, pairs: DataFrame, start_offset: int = 2, end_offset: int = 0) -> DataFrame:
    """(pair, second, tx, rx): the k-th records of both recordings within the overlap, which leaves out its first two seconds. If one side has
    fewer records, what the other has over has a null side; see problems(). A recording in several pairs is read once."""

    def side(n: str) -> DataFrame:
        spans = pairs.select("pair", F.col(f"{n}_path").alias("path"), "start", "end")
        own = subset(records.select("path", "time", "values"), spans, "path", start_offset, end_offset)
        return own.select("pair", (F.row_number().over(Window.partitionBy("pair").orderBy("time")) - 1).alias("second"), F.col("values").alias(n))

    return side("tx").join(side("rx"), ["pair", "second"], "full")


def problems(paired: DataFrame, rates: DataFrame) -> DataFrame:
    """(pair, problem): why a pair cannot be processed, else null. rates: (pair, tx_rate, rx_rate). A pair whose overlap holds no record has a row too; lengths
    differ where a record has no partner, or one of another length."""
    unlike = F.count_if(F.col("tx").isNull() | F.col("rx").isNull() | (F.size("tx") != F.size("rx")))
    sides = paired.groupBy("pair").agg(F.count("*").alias("_n"), unlike.alias("_unlike"))
    why = F.when(F.round("tx_rate") != F.round("rx_rate"), "sampling rates differ").when(F.coalesce("_n", F.lit(0)) == 0, "no common records").when(F.col("_unlike") > 0, "lengths differ")
    return rates.join(sides, "pair", "left").select("pair", why.alias("problem"))


def paired_samples(paired: DataFrame) -> DataFrame:
    """(pair, i, tx, rx): one row a sample, i from 0; records of one side only are left out."""
    before = F.coalesce(F.sum(F.size("tx")).over(Window.partitionBy("pair").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = paired.where("tx is not null and rx is not null").withColumn("_at", before)
    zipped = own.select("pair", "_at", F.posexplode(F.arrays_zip("tx", "rx")).alias("_k", "_v"))
    return zipped.select("pair", (F.col("_at") + F.col("_k")).alias("i"), F.col("_v.tx").alias("tx"), F.col("_v.rx").alias("rx"))


def _free_runs(samples: DataFrame, free: Column) -> DataFrame:
    """(pair, first, n): each pair's longest run of samples that are free of something, the first of equally long ones."""
    return S.longest_run(samples, ["pair"], ["i"], free)


def filled(samples: DataFrame) -> DataFrame:
    """Missing samples of either side filled by straight lines, with the nearest value at the ends; `missing` tells where either side was."""
    known = samples.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("tx", "rx")})
    return S.filled(known.withColumn("missing", F.col("tx").isNull() | F.col("rx").isNull()), ["pair"], "i", ["tx", "rx"])


def checks(samples: DataFrame, settings: DataFrame, tx_most: float = TX_MOST, rx_most: float = RX_MOST) -> DataFrame:
    """One row a pair: numbers of samples, cycles, missing and clipped samples, the longest runs without either (clip_first, clip_free samples),
    the least and largest current, and enough: no clips, or three transmitter cycles without one.

    samples: as filled() gives them; clips are looked for in what is filled too. settings: (pair, rate, frequency)."""
    clipped = F.coalesce(S.clip_limits("tx", "rx", tx_most, rx_most), F.lit(False))
    counts = samples.groupBy("pair").agg(
        F.count("*").alias("num_samples"), F.min("tx").alias("min_current"), F.max("tx").alias("max_current"), F.count_if("missing").alias("num_nans"), F.count_if(clipped).alias("num_clips"),
    )
    nan_free = _free_runs(samples, ~F.col("missing")).select("pair", F.col("n").alias("_nan_free"))
    clip_free = _free_runs(samples, ~clipped).select("pair", F.col("first").alias("clip_first"), F.col("n").alias("clip_free"))
    own = settings.join(counts, "pair").join(nan_free, "pair", "left").join(clip_free, "pair", "left")
    cycle = F.bround(F.col("rate") / F.col("frequency")).cast("long")
    own = own.withColumns({"samples_per_cycle": cycle, "clip_free": F.coalesce("clip_free", F.lit(0)), "_nan_free": F.coalesce("_nan_free", F.lit(0))})
    own = own.withColumns({
        "signal_duration": F.col("num_samples") / F.col("rate"), "num_cycles": F.floor(F.col("num_samples") / F.col("samples_per_cycle")).cast("long"),
        "frac_nans": F.col("num_nans") / F.col("num_samples"), "nan_free_sec": F.col("_nan_free") / F.col("rate"),
        "frac_clips": F.col("num_clips") / F.col("num_samples"), "max_clipfree_tx_cycles": F.col("clip_free") / F.col("rate") * F.col("frequency"),
    })
    return own.withColumn("enough", (F.col("num_clips") == 0) | (F.col("max_clipfree_tx_cycles") >= LEAST_CYCLES)).drop("_nan_free")


def trimmed(samples: DataFrame, checked: DataFrame) -> DataFrame:
    """Filled samples of the pairs that have enough; where there are clips, only the longest run without one, counted anew."""
    own = samples.join(checked.where("enough").select("pair", "num_clips", "clip_first", "clip_free"), "pair")
    inside = (F.col("num_clips") == 0) | ((F.col("i") >= F.col("clip_first")) & (F.col("i") < F.col("clip_first") + F.col("clip_free")))
    return own.where(inside).select("pair", F.when(F.col("num_clips") > 0, F.col("i") - F.col("clip_first")).otherwise(F.col("i")).alias("i"), "tx", "rx")


def coefficients(samples: DataFrame, settings: DataFrame, cycles_per_window: int = 2, strides_per_cycle: int = 2, notch_bandwidth: float = 0.2, hum: float = 60.0, periods: int = 15, phases: int = 100, before: int = 40, after: int = 100, taper: str = "hann", notched_above: float = 16.0) -> DataFrame:
    """(pair, side, win, harmonic, f, re, im) of both sides, t and r: samples less hum and drift, in windows of whole cycles (with the tapers of X.LONGER
    some samples more), at the odd harmonics that a window resolves. settings: (pair, rate, frequency); rates and frequencies are columns, so one plan
    serves all pairs.

    Above 16 Hz hum is notched, else its mean waveform goes, which samples near the transmitter's edges do not count for. Drift is the robust
    running mean over a cycle."""
    cycle = F.bround(F.col("rate") / F.col("frequency")).cast("long")
    own = samples.join(settings.select("pair", "rate", "frequency", cycle.alias("period")), "pair")
    keys = ["pair", "side"]

    def sides(df: DataFrame, *more: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).cast("double").alias("v")) for c, n in (("tx", "t"), ("rx", "r"))]))
        return df.select("pair", "i", "rate", "frequency", "period", *more, each.alias("_s")).select("pair", "_s.side", "i", "rate", "frequency", "period", *more, "_s.v")

    less = K.notch(sides(own.where(F.col("frequency") > notched_above)), keys, ["i"], "v", hum, F.col("rate"), notch_bandwidth, "_f")
    slow = own.where(F.col("frequency") <= notched_above)
    # the waveform's frames are as long as a hum period: a plan for each sampling rate, of which instruments have a few
    for r in settings.where(F.col("frequency") <= notched_above).select("rate").distinct().sort("rate").collect():
        at = slow.where(F.col("rate") == r.rate)
        offset = S.on_time_offset(at.select("pair", "i", "tx", "period"), ["pair"], ["i"], "tx", F.col("period"))
        near = F.coalesce(S.near_edges(F.col("i"), F.col("offset"), F.floor(F.col("period") / 2), before, after), F.lit(False))
        edged = sides(at.join(offset, "pair", "left").withColumn("_near", near), "_near")
        less = less.unionByName(S.waveform_filtered(edged, keys, ["i"], "v", r.rate / hum, periods, phases, "_f", masked="_near").drop("_near"))
    flat = S.robust_running_mean(less, keys, ["i"], "_f", F.col("period"), out="_m").withColumn("_v", F.col("_f") - F.col("_m"))
    width, hop = F.col("period") * cycles_per_window + X.longer(taper), F.greatest(F.lit(1), F.bround(F.col("period") / strides_per_cycle)).cast("long")
    by = [*keys, "frequency", "period", "width", "hop"]
    bins = X.harmonic_bins(flat.withColumns({"width": width, "hop": hop}), by, "i", "_v", "period", "width", "hop", HARMONICS, taper)
    found = F.floor(F.col("width") / 2) + 1
    place = F.array_position(F.array(*[F.lit(h) for h in HARMONICS]), F.col("harmonic"))
    resolved = (place <= F.floor(found / 2)) & (F.col("harmonic") * cycles_per_window < found)
    return bins.where(resolved).select(*keys, "win", "harmonic", (F.col("harmonic") * F.col("frequency")).alias("f"), "re", "im")


def calibrated(fc: DataFrame, places: DataFrame, boards: DataFrame, antennas: DataFrame) -> DataFrame:
    """Coefficients (pair, side, ..., f, re, im) less the responses of their boards, and of antennas where the component begins with H; with `board`, whether
    there is a board's calibration. Without one a coefficient stays as it is.

    places: (pair, side, box, card, antenna, component, rate). boards: (box, CARDSNX, ADFREQ, CALFREQ, MAG, PHASE), antennas: (antenna_sn,
    base_frequency, mag, phz); leading `0x` of card numbers does not count."""
    bare = lambda c: F.regexp_replace(F.col(c).cast("string"), "^0x", "")
    board = boards.select(F.col("box").cast("string").alias("box"), bare("CARDSNX").alias("card"), F.col("ADFREQ").cast("double").alias("rate"), F.col("CALFREQ").cast("double").alias("f"), F.col("MAG").alias("mag"), F.col("PHASE").alias("phase"))
    antenna = antennas.select(F.col("antenna_sn").cast("string").alias("antenna_sn"), "base_frequency", "mag", "phz")
    at = places.select("pair", "side", F.col("box").cast("string").alias("box"), bare("card").alias("card"), F.col("rate").cast("double").alias("rate"), F.when(F.col("component").startswith("H"), F.col("antenna").cast("string")).alias("antenna_sn"))
    own = B.board_corrected(fc.join(at, ["pair", "side"], "left"), board, ["box", "card", "rate"], "board")
    return B.antenna_corrected(own, antenna, ["antenna_sn"]).drop("box", "card", "rate", "antenna_sn")


def side_by_side(fc: DataFrame) -> DataFrame:
    """(pair, win, harmonic, f, t_re, t_im, t_board, r_re, r_im, r_board): coefficients of windows that both sides have."""
    own = {n: fc.where(F.col("side") == n).select("pair", "win", "harmonic", "f", *[F.col(c).alias(f"{n}_{c}") for c in ("re", "im", "board")]) for n in ("t", "r")}
    return own["t"].join(own["r"].drop("f"), ["pair", "win", "harmonic"])


def transfer_functions(fc: DataFrame) -> DataFrame:
    """(pair, harmonic, n, and re, im, v of both estimates: _ls, _rm; rounds, good): least squares and robust regression over the windows."""
    ls = X.least_squares(fc, ["pair", "harmonic"]).select("pair", "harmonic", "n", *[F.col(c).alias(f"{c}_ls") for c in ("re", "im", "v")])
    rm = K.regression_m(fc, ["pair", "harmonic"]).select("pair", "harmonic", *[F.col(c).alias(f"{c}_rm") for c in ("re", "im", "v")], "rounds", "good")
    return ls.join(rm, ["pair", "harmonic"])


def result_rows(catalog: DataFrame, checked: DataFrame, tf: DataFrame) -> DataFrame:
    """One row a pair: columns of the catalog, checks, and for each harmonic and estimate (LS, RM) the real and imaginary part and variance, null
    where a harmonic is missing; n_iter and n_good are those of the first harmonic. A pair without coefficients has processed = false."""
    cells = []
    for kind in ("LS", "RM"):
        for part, c in (("real", "re"), ("imag", "im"), ("var", "v")):
            cells += [F.max(F.when(F.col("harmonic") == h, F.col(f"{c}_{kind.lower()}"))).alias(f"tf{h}_{part}_{kind}") for h in HARMONICS]
    first = [F.max(F.when(F.col("harmonic") == 1, F.col(c))).alias(n) for c, n in (("rounds", "n_iter"), ("good", "n_good"))]
    wide = tf.groupBy("pair").agg(*cells, *first).withColumn("processed", F.lit(True))
    own = [c for c in checked.columns if c == "pair" or c not in catalog.columns]
    return catalog.join(checked.select(*own), "pair", "left").join(wide, "pair", "left").withColumn("processed", F.coalesce("processed", F.lit(False)))


# The columns of a result table by name and order.
RESULT_COLUMNS = [
    "processed", "tx_station", "rx_station", "rx_run", "rx_component", "num_nans", "num_clips", "max_clipfree_tx_cycles", "sampling_rate", "num_samples", "signal_duration",
    "samples_per_cycle", "num_cycles", "tx_filename", "rx_filename", "dx1", "dy1", "dz1", "dx2", "dy2", "dz2", "azimuth", "inclination", "transmitter_frequency", "min_current", "max_current",
    *[f"tf{h}_{part}_LS" for h in HARMONICS for part in ("real", "imag")], *[f"tf{h}_var_LS" for h in HARMONICS],
    *[f"tf{h}_{part}_RM" for h in HARMONICS for part in ("real", "imag")], *[f"tf{h}_var_RM" for h in HARMONICS],
    "n_iter", "n_good",
]
#: Where they come from, if not from a column of the same name.
RESULT_SOURCES = {"sampling_rate": "rate", "tx_filename": "tx_path", "rx_filename": "rx_path", "transmitter_frequency": "frequency"}


def result_table(done: DataFrame) -> DataFrame:
    """result_rows() with the columns of a result table and no others, in their order; columns that the catalog did not have are null. dx1 to inclination are
    the receiver's, also from columns named rx_dx1 and so on."""

    def column(name: str) -> Column:
        for c in (name, RESULT_SOURCES.get(name), f"rx_{name}"):
            if c in done.columns:
                return F.col(c).alias(name)
        return F.lit(None).cast("string" if name in ("tx_station", "rx_station", "rx_run", "rx_component") else "double").alias(name)

    return done.select(*[column(c) for c in RESULT_COLUMNS])


def processed(records: DataFrame, pairs: DataFrame, boards: DataFrame, antennas: DataFrame, save_coefficients: str | None = None, limits: tuple[float, float] = (TX_MOST, RX_MOST), **how) -> DataFrame:
    """All of it: result_rows of pairs (pair, tx_path, rx_path, start, end, tx_rate, rx_rate, frequency, tx_box, tx_card, tx_antenna,
    tx_component, rx_..., any others), with `problem`: why a pair was left out, and tx_board, rx_board: whether all its coefficients are calibrated. `how` goes
    to coefficients(), limits are the readings that count as clipped. save_coefficients: a folder for the calibrated coefficients, parted by pair."""
    spans = pairs.select("pair", "tx_path", "rx_path", "start", "end")
    paired = written(paired_records(records, spans), "paired")
    wrong = written(problems(paired, pairs.select("pair", "tx_rate", "rx_rate")), "problems")
    sound = pairs.join(wrong.where("problem is null").select("pair"), "pair").withColumn("rate", F.round("rx_rate"))
    samples = written(filled(paired_samples(paired.join(sound.select("pair"), "pair", "left_semi"))), "samples")
    checked = written(checks(samples, sound.select("pair", "rate", "frequency"), *limits), "checked")
    ready = written(trimmed(samples, checked), "ready")
    clips = checked.select("pair", F.when(~F.col("enough"), "insufficient clip-free data").alias("clipping"))
    catalog = pairs.join(wrong, "pair", "left").join(clips, "pair", "left").withColumn("problem", F.coalesce("problem", "clipping")).drop("clipping")
    each = F.inline(F.array(*[F.struct(F.lit(n[0]).alias("side"), *[F.col(f"{n}_{c}").cast("string").alias(c) for c in ("box", "card", "antenna", "component")]) for n in ("tx", "rx")]))
    places = sound.select("pair", "rate", each)
    long = coefficients(ready, checked.where("enough").select("pair", "rate", "frequency"), **how)
    fc = written(side_by_side(calibrated(long, places, boards, antennas)), "coefficients")
    if save_coefficients:
        fc.write.partitionBy("pair").mode("overwrite").parquet(save_coefficients)
    whole = fc.groupBy("pair").agg(F.bool_and("t_board").alias("tx_board"), F.bool_and("r_board").alias("rx_board"))
    return result_rows(catalog.join(whole, "pair", "left"), checked, transfer_functions(fc))


def bin_sums(df: DataFrame, keys: list[str], index: str, value: str, width: int, turns: float, halves: bool = False) -> DataFrame:
    """(keys, win, n, re, im): in whole windows of `width` samples, how many are there and their sum times exp(-2 pi i turns * place), turns being
    cycles a sample and place counted within the window. With halves further windows begin half a window later; win counts both in order of place."""
    i = F.col(index)
    starts = [(F.lit(0), F.lit(0))] + ([(F.lit(width // 2), F.lit(1))] if halves else [])
    per = len(starts)
    places = F.array(*[F.struct((F.floor((i - s) / width) * per + k).cast("long").alias("win"), F.pmod(i - s, F.lit(width)).alias("place"), (i >= s).alias("in_it")) for s, k in starts])
    own = df.select(*keys, i.alias("_i"), F.col(value).alias("_v"), F.explode(places).alias("_w")).where("_w.in_it")
    angle = 2 * math.pi * turns * F.col("_w.place")
    full = F.count("_i") == width
    sums = own.groupBy(*keys, F.col("_w.win").alias("win")).agg(full.alias("_full"), F.count("_v").alias("n"), F.coalesce(F.sum(F.col("_v") * F.cos(angle)), F.lit(0.0)).alias("re"), (-F.coalesce(F.sum(F.col("_v") * F.sin(angle)), F.lit(0.0))).alias("im"))
    return sums.where("_full").drop("_full")


def window_ratios(df: DataFrame, keys: list[str], index: str, tx: str, rx: str, width: int, turns: float, halves: bool = False) -> DataFrame:
    """(keys, win, re, im): bin_sums of rx by those of tx in each window; null where tx has none."""
    t, r = (bin_sums(df, keys, index, c, width, turns, halves).drop("n").withColumnsRenamed({"re": f"{n}_re", "im": f"{n}_im"}) for c, n in ((tx, "t"), (rx, "r")))
    h = X.divided(X.pair("r"), X.pair("t"))
    return t.join(r, [*keys, "win"]).select(*keys, "win", h[0].alias("re"), h[1].alias("im"))
