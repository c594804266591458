"""Ordered operators over series: one row a sample, `keys` name the series, `order` its order.

Every window is partitioned by the series, so series are spread over the tasks and none is gathered on the driver."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coilwave.operators import kernels as K

#: Up to this width a moving frame is cheaper than two cumulative sums, or than a frame that is kept sorted.
FRAME = 64


def _window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def indexed(df: DataFrame, keys: list[str], order: list[str], name: str = "i") -> DataFrame:
    """Adds the place of each sample in its series, from 0."""
    return df.withColumn(name, (F.row_number().over(_window(keys, order)) - 1).cast("long"))


def running_mean(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, out: str = "mean", edges: str = "null") -> DataFrame:
    """Centred mean of the n samples from n//2 before to (n-1)//2 after. Where the frame is not full: null, `same` (the
    nearest full mean) or `edge` (the mean of what is there). Nulls in a full frame make it null."""
    w = _window(keys, order)
    before, after = n // 2, (n - 1) // 2
    frame = w.rowsBetween(-before, after)
    full = F.count(value).over(frame) == n
    if n <= FRAME:
        mean = F.when(full, F.avg(value).over(frame))
    else:
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({"_s": F.sum(value).over(run), "_n": F.count(value).over(run)})
        size = F.count(F.lit(1)).over(frame)
        total = F.lead("_s", after).over(w) - F.coalesce(F.lag("_s", before + 1).over(w), F.lit(0.0)) if after else F.col("_s") - F.coalesce(F.lag("_s", before + 1).over(w), F.lit(0.0))
        count = (F.lead("_n", after).over(w) if after else F.col("_n")) - F.coalesce(F.lag("_n", before + 1).over(w), F.lit(0))
        mean = F.when((size == n) & (count == n), total / n)
    df = df.withColumn(out, mean)
    if edges == "same":
        df = _nearest_full(df, keys, order, out)
    elif edges == "edge":
        df = df.withColumn(out, F.coalesce(out, F.avg(value).over(frame)))
    return df.drop("_s", "_n")


def _nearest_full(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Where `out` is null at the ends of a series, the nearest one that is not."""
    w = _window(keys, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = F.first(out, ignorenulls=True).over(whole)
    return df.withColumn(out, F.coalesce(out, F.when(F.count(out).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0, ahead), F.last(out, ignorenulls=True).over(whole)))


def running_mean_fractional(df: DataFrame, keys: list[str], order: list[str], value: str, n: float, out: str = "mean", edges: str = "null") -> DataFrame:
    """Centred mean over a width n that need not be whole: k = floor((n-1)/2) samples on either side, and a part of the next. Null at the edges, or with
    `same` the nearest full mean."""
    w = _window(keys, order)
    k = int((n - 1) // 2)
    c = (n - (2 * k + 1)) / 2
    frame = w.rowsBetween(-k, k)
    ends = F.lag(value, k + 1).over(w) + F.lead(value, k + 1).over(w)
    mean = (F.sum(value).over(frame) + F.lit(c) * ends) / n if c else F.when(F.count(value).over(frame) == 2 * k + 1, F.avg(value).over(frame))
    df = df.withColumn(out, mean)
    return _nearest_full(df, keys, order, out) if edges == "same" else df


def windowed_mean(df: DataFrame, keys: list[str], order: list[str], value: str, weights: list[float], out: str = "mean", mask: str | None = None) -> DataFrame:
    """Mean over a window of any shape: of m weights, that of place k (from 0) belongs to the sample (m - 1) // 2 - k places further on.
    Missing samples count nowhere, and `mask` weighs samples (0: not at all). Where no sample counts: null."""
    w = _window(keys, order)
    each = F.when(F.col(value).isNotNull(), F.lit(1.0) if mask is None else F.coalesce(F.col(mask).cast("double"), F.lit(0.0))).otherwise(0.0)
    own = df.withColumns({"_m": each, "_x": F.coalesce(F.col(value).cast("double"), F.lit(0.0)) * each})
    zero = F.lit(0.0)
    places = [((len(weights) - 1) // 2 - k, float(g)) for k, g in enumerate(weights) if g]
    total, count = (reduce(Column.__add__, [F.coalesce(F.lead(c, o).over(w), zero) * g for o, g in places], zero) for c in ("_x", "_m"))
    return own.withColumns({"_t": total, "_c": count}).withColumn(out, F.col("_t") / F.nullif("_c", zero)).drop("_m", "_x", "_t", "_c")


def demean(df: DataFrame, keys: list[str], order: list[str], value: str, n: float, out: str = "demeaned", edges: str = "null") -> DataFrame:
    """The value less its centred mean over n samples; null at the edges, or with `same` less the nearest full mean."""
    return running_mean_fractional(df, keys, order, value, n, "_m", edges).withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def running_median(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, out: str = "median") -> DataFrame:
    """Trailing median of the last n samples (fewer at the start), of which missing ones (null or NaN) count nowhere; of an even number the upper one. Narrow
    frames are sorted as arrays; wide ones keep one sorted frame from sample to sample."""
    own = df.withColumn("_known", F.when(~F.isnan(F.col(value).cast("double")), F.col(value)))
    if n > FRAME:
        wide = K.per_series(own, keys, order, "_known", out, lambda x: K.trailing_medians(x, n))
        return wide.withColumn(out, F.col(out).cast(df.schema[value].dataType)).select(*df.columns, out)
    seen = F.sort_array(F.collect_list("_known").over(_window(keys, order).rowsBetween(-(n - 1), 0)))
    return own.withColumn(out, F.get(seen, F.floor(F.size(seen) / 2).cast("int"))).select(*df.columns, out)


def prewhiten(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "diff") -> DataFrame:
    """First difference; 0 at the start of a series."""
    return df.withColumn(out, F.coalesce(F.col(value) - F.lag(value).over(_window(keys, order)), F.lit(0.0)))


def week_numbers(df: DataFrame, keys: list[str], order: list[str], seconds: str, first_week: Column | int = 0, out: str = "week") -> DataFrame:
    """GPS week of each sample from seconds of the week: one more where they fall by more than 600000."""
    w = _window(keys, order)
    fell = F.when(F.lag(seconds).over(w) > F.col(seconds) + 600_000, 1).otherwise(0)
    first = first_week if isinstance(first_week, Column) else F.lit(first_week)
    return df.withColumn("_fell", fell).withColumn(out, first + F.sum("_fell").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fell")


def interpolate(df: DataFrame, keys: list[str], order: list[str], index: str, value: str, out: str = "filled", ends: str = "hold") -> DataFrame:
    """Fills nulls linearly between the nearest values. Beyond the first and last value: `hold` repeats it, `extend` goes on
    with the line through the nearest two. A series without values stays null."""
    w = _window(keys, order)
    # what lies ahead is what lies behind in reverse order; a frame up to the end would be gone through anew for each row
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(index).cast("double").alias("x"), F.col(value).cast("double").alias("y")))
    df = df.withColumn("_p", at)
    df = df.withColumns({"_a": F.last("_p", ignorenulls=True).over(back), "_b": F.last("_p", ignorenulls=True).over(ahead)})
    x = F.col(index).cast("double")

    def line(p: str, q: str) -> Column:
        px, py, qx, qy = (F.col(f"{n}.{c}") for n in (p, q) for c in "xy")
        return py + (qy - py) * (x - px) / F.nullif(qx - px, F.lit(0.0))

    inside = F.when(F.col("_p").isNotNull(), F.col(value).cast("double")).otherwise(line("_a", "_b"))
    if ends == "hold":
        return df.withColumn(out, F.coalesce(inside, F.col("_a.y"), F.col("_b.y"))).drop("_p", "_a", "_b")
    # the two values nearest to either end of the series
    whole = Window.partitionBy(*keys)
    rank_up = F.count("_p").over(back)
    rank_down = F.count("_p").over(ahead)
    df = df.withColumns({"_u": rank_up, "_d": rank_down})
    pick = lambda r, k: F.max(F.when(F.col("_p").isNotNull() & (F.col(r) == k), F.col("_p"))).over(whole)
    df = df.withColumns({"_f1": pick("_u", 1), "_f2": pick("_u", 2), "_l1": pick("_d", 1), "_l2": pick("_d", 2)})
    value_at = F.coalesce(inside, F.when(F.col("_u") == 0, F.coalesce(line("_f1", "_f2"), F.col("_f1.y"))), F.coalesce(line("_l1", "_l2"), F.col("_l1.y")))
    return df.withColumn(out, value_at).drop("_p", "_a", "_b", "_u", "_d", "_f1", "_f2", "_l1", "_l2")


def filled(df: DataFrame, keys: list[str], index: str, values: list[str]) -> DataFrame:
    """interpolate() of several columns at once, in place, with the nearest value at the ends: two orders of the series, however many columns."""
    back, ahead = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(index), F.col(index).desc()))
    x = F.col(index).cast("double")
    at = {c: F.when(F.col(c).isNotNull(), F.struct(x.alias("x"), F.col(c).cast("double").alias("y"))) for c in values}
    own = df.withColumns({f"_p_{c}": p for c, p in at.items()})
    own = own.withColumns({f"_a_{c}": F.last(f"_p_{c}", ignorenulls=True).over(back) for c in values}).withColumns({f"_b_{c}": F.last(f"_p_{c}", ignorenulls=True).over(ahead) for c in values})

    def line(c: str) -> Column:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        between = a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
        return F.coalesce(F.col(c).cast("double"), between, a["y"], b["y"])

    return own.withColumns({c: line(c) for c in values}).select(*df.columns)


def unwrap(df: DataFrame, keys: list[str], order: list[str], phase: str, out: str = "unwrapped", period: float = 6.283185307179586) -> DataFrame:
    """Removes jumps of more than half a period between neighbours."""
    w = _window(keys, order)
    step = F.col(phase) - F.lag(phase).over(w)
    turns = F.when(F.abs(step) > period / 2, -F.round(step / period)).otherwise(0.0)
    return df.withColumn("_t", F.coalesce(turns, F.lit(0.0))).withColumn(out, F.col(phase) + period * F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_t")


def winsorize(df: DataFrame, keys: list[str], value: str, p: float, ties: list[str], out: str = "clipped", mask: bool = False) -> DataFrame:
    """Clamps to the values of rank int(p*n) from either end of the series (from 0), or with mask makes what is outside null. Nulls stay."""
    whole = Window.partitionBy(*keys)
    n = F.count(value).over(whole)
    rank = F.when(F.col(value).isNotNull(), F.row_number().over(whole.orderBy(F.col(value).asc_nulls_last(), *ties)) - 1)
    df = df.withColumns({"_n": n, "_r": rank}).withColumn("_k", F.floor(F.lit(p) * F.col("_n")))
    low = F.max(F.when(F.col("_r") == F.col("_k"), F.col(value))).over(whole)
    high = F.max(F.when(F.col("_r") == F.col("_n") - F.col("_k") - 1, F.col(value))).over(whole)
    df = df.withColumns({"_lo": low, "_hi": high})
    inside = F.col(value).between(F.col("_lo"), F.col("_hi"))
    clipped = F.when(inside, F.col(value)) if mask else F.when(F.col(value).isNotNull(), F.greatest("_lo", F.least("_hi", value)))
    return df.withColumn(out, clipped).drop("_n", "_r", "_k", "_lo", "_hi")


def runs(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """(keys, first, last, n): the maximal runs of samples for which flag holds; places count from 0."""
    own = indexed(df, keys, order, "_i").withColumn("_f", F.coalesce(flag, F.lit(False))).where("_f")
    island = F.col("_i") - F.row_number().over(Window.partitionBy(*keys).orderBy("_i"))
    return own.withColumn("_g", island).groupBy(*keys, "_g").agg(F.min("_i").alias("first"), F.max("_i").alias("last"), F.count("*").alias("n")).drop("_g")


def gap_statistics(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, n, n_missing, share, first, n_free): samples, missing ones and their share, and the longest run without one (null and 0 if all are missing)."""
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~known).alias("n_missing"))
    runs_of = longest_run(df, keys, order, known).select(*keys, "first", F.col("n").alias("_free"))
    return sums.join(runs_of, keys, "left").select(*keys, "n", "n_missing", (F.col("n_missing") / F.col("n")).alias("share"), "first", F.coalesce("_free", F.lit(0)).cast("long").alias("n_free"))


def longest_run(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """(keys, first, n): the longest run, the first of equally long ones. Series without a run have no row."""
    best = F.max(F.struct(F.col("n"), (-F.col("first")).alias("f")))
    return runs(df, keys, order, flag).groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.f")).alias("first"), F.col("b.n").alias("n"))


def sessions(df: DataFrame, keys: list[str], ts: str, ties: list[str], gap_seconds: int) -> DataFrame:
    """(keys, session, start, end, n): parts of a series with no gap longer than gap_seconds."""
    w = _window(keys, [ts, *ties])
    sec = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.when(sec - F.lag(sec).over(w) > gap_seconds * 1_000_000, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def folded(df: DataFrame, index: str, period: int | Column, shift: int = 0) -> DataFrame:
    """Adds cycle and phase of each sample."""
    i = F.col(index) - shift
    return df.withColumns({"cycle": F.floor(i / period).cast("long"), "phase": F.pmod(i, F.lit(period)).cast("long")})


def reshaped(df: DataFrame, keys: list[str], order: list[str], value: str, period: int, shift: int | None = None, keep: bool = False, out: str = "value") -> DataFrame:
    """(keys, cycle, phase, out): the series as rows of whole cycles. The first cycle begins at `shift`, by default so late that the last sample ends
    one; what is left over goes, or with keep is a cycle filled up with nulls."""
    w = _window(keys, order)
    own = indexed(df, keys, order, "_i").select(*keys, "_i", F.col(value).alias("_v"), F.lead(F.lit(1)).over(w).isNull().alias("_last"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    own = own.withColumn("_s", F.col("_n") % period if shift is None else F.lit(shift % period))
    if not keep:
        place = F.col("_i") - F.col("_s")
        own = own.withColumn("_p", place).where((place >= 0) & (F.floor(place / period) < F.floor((F.col("_n") - F.col("_s")) / period)))
    else:
        own = own.withColumn("_at", F.col("_i") + F.pmod(-F.col("_s"), F.lit(period)))
        end = F.when(F.col("_last"), (F.floor(F.col("_at") / period) + 1) * period - 1).otherwise(F.col("_at"))
        own = own.withColumn("_p", F.explode(F.sequence(F.when(F.col("_i") == 0, F.lit(0).cast("long")).otherwise(F.col("_at")), end)))
        own = own.withColumn("_v", F.when(F.col("_p") == F.col("_at"), F.col("_v")))
    return own.select(*keys, F.floor(F.col("_p") / period).cast("long").alias("cycle"), (F.col("_p") % period).cast("int").alias("phase"), F.col("_v").alias(out))


def robust_running_mean(df: DataFrame, keys: list[str], order: list[str], value: str, n: int | Column, p: float = 0.05, out: str = "mean") -> DataFrame:
    """Running mean over n samples after each phase of n has been winsorized over all cycles; edges repeat the nearest full mean. n may be a column that is
    the same for all samples of a series, so that series of many periods go in one plan. Columns cycle and phase of df go."""
    own = folded(indexed(df, keys, order, "_i"), "_i", n)
    own = winsorize(own, [*keys, "phase"], value, p, ["_i"], "_w")
    own = _mean_of_a_cycle(own, keys, n, out) if isinstance(n, Column) else running_mean(own, keys, ["_i"], "_w", n, out, "same")
    return own.drop("_i", "_w", "cycle", "phase")


def _mean_of_a_cycle(own: DataFrame, keys: list[str], n: Column, out: str) -> DataFrame:
    """The centred mean of _w over n samples, n being a column and the length of a cycle: what leaves a frame of n samples is the sample of the same phase
    a cycle before, so no frame depends on n. A mean is found at the last sample of its frame and moved to the middle as a row of its own, which the next
    order of the series puts just before the sample it belongs to. A sample whose frame is not full or has a null takes the mean before it, or the first."""
    lane = Window.partitionBy(*keys, "phase").orderBy("_i")
    x, known = F.coalesce("_w", F.lit(0.0)), F.col("_w").isNotNull().cast("int")
    own = own.withColumns({"_x": x - F.coalesce(F.lag(x).over(lane), F.lit(0.0)), "_c": known - F.coalesce(F.lag(known).over(lane), F.lit(0))})
    run = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({"_x": F.sum("_x").over(run), "_c": F.sum("_c").over(run)})
    full = F.when((F.col("_i") >= n - 1) & (F.col("_c") == n), F.col("_x") / n)
    here = F.struct(F.col("_i").alias("at"), F.lit(True).alias("sample"), F.lit(None).cast("double").alias("m"))
    middle = F.struct((F.col("_i") - F.floor((n - 1) / 2)).cast("long").alias("at"), F.lit(False).alias("sample"), full.alias("m"))
    own = own.withColumn("_e", F.explode(F.array(here, middle))).where("_e.sample or _e.m is not null")
    w = Window.partitionBy(*keys).orderBy("_e.at", "_e.sample")
    first = F.first("_e.m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    mean = F.coalesce(F.last("_e.m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), first)
    return own.withColumn(out, mean).where("_e.sample").drop("_x", "_c", "_e")


def near_edges(index: Column, offset: Column, half: int | Column, before: int, after: int) -> Column:
    """Whether a sample is within `after` samples after or `before` samples ahead of a half cycle's edge."""
    at = F.pmod(index - offset, F.lit(half))
    return (at < after) | (at >= half - before)


def on_time_offset(df: DataFrame, keys: list[str], order: list[str], value: str, period: int | Column, signed: bool = False, digits: int = 9) -> DataFrame:
    """(keys, offset): where the half cycles begin (signed: the cycles), as the place at which steps of the series match a
    train of spikes best. The score at j adds the steps j - 1 + q * half (signed: those at q * period less those half a period before), q from 1; the smallest j of the best counts.
    Unsigned, the period may be a column that is the same for all samples of a series."""
    half = F.floor(period / 2) if isinstance(period, Column) else period // 2
    own = indexed(df, keys, order, "_i")
    w = Window.partitionBy(*keys).orderBy("_i")
    step = F.lead(value).over(w) - F.col(value)
    by = period if signed else half
    own = own.withColumns({"_d": step if signed else F.abs(step), "_n": F.count("*").over(Window.partitionBy(*keys)), "_by": F.lit(by)}).where("_d is not null")
    if signed:
        own = own.withColumn("_d", F.col("_d") - F.coalesce(F.lag("_d", half).over(w), F.lit(0.0)))
    cycles = F.floor(F.col("_n") / period)
    length = cycles - 1 if signed else 2 * cycles - 1
    lane = Window.partitionBy(*keys, "_lane").orderBy("_i")
    own = own.withColumns({"_lane": F.col("_i") % F.col("_by"), "_len": length}).where("_len > 0")
    sums = F.sum("_d").over(lane.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumns({"_s": sums, "_k": F.row_number().over(lane)})
    # the frame's length differs by series: its start is found by a join on the place that is `_len` rows before
    prior = own.select(*keys, "_lane", F.col("_k").alias("_pk"), F.col("_s").alias("_ps"))
    scored = own.withColumn("_pk", F.col("_k") - F.col("_len")).where("_pk >= 0").join(prior, [*keys, "_lane", "_pk"], "left")
    score = F.round(F.col("_s") - F.coalesce("_ps", F.lit(0.0)), digits)
    start = F.col("_i") + 1 - F.col("_len") * F.col("_by")
    best = scored.where(start >= 0).groupBy(*keys, "_by").agg(F.max(F.struct(score.alias("s"), (-start).alias("j"))).alias("b"))
    return best.select(*keys, F.pmod(-F.col("b.j"), F.col("_by")).cast("long").alias("offset"))


def clip_limits(tx: str, rx: str, tx_most: float = 39.8, rx_most: float = 1.99) -> Column:
    """Whether a pair of samples is clipped on either side."""
    return (F.abs(F.col(tx)) >= tx_most) | (F.abs(F.col(rx)) >= rx_most)


def resampled(df: DataFrame, keys: list[str], order: list[str], value: str, samples: float, phases: int, offset: float = 0.0, out: str = "value") -> DataFrame:
    """(keys, cycle, phase, out): the series read by straight lines at `phases` places of each period of `samples` samples. `offset` is the place
    of the first sample in a longer signal, so that parts of it agree on phases. Each sample gives the places from it up to the next one; a place
    beside a null is null."""
    step = samples / phases
    w = _window(keys, order)
    own = indexed(df, keys, order, "_i").select(*keys, "_i", F.col(value).alias("_v"), F.lead(value).over(w).alias("_next"), F.lead("_i").over(w).isNull().alias("_last"))
    first = F.ceil((F.col("_i") + offset) / step)
    end = F.when(F.col("_last"), F.floor((F.col("_i") + offset) / step)).otherwise(F.ceil((F.col("_i") + 1 + offset) / step) - 1)
    own = own.withColumns({"_first": first, "_end": end}).where("_first <= _end").withColumn("_p", F.explode(F.sequence("_first", "_end")))
    part = F.col("_p") * step - offset - F.col("_i")
    read = F.when(part == 0, F.col("_v")).otherwise(F.col("_v") + (F.col("_next") - F.col("_v")) * part)
    return own.select(*keys, F.floor(F.col("_p") / phases).alias("cycle"), F.pmod("_p", F.lit(phases)).cast("int").alias("phase"), read.alias(out))


def mean_per_phase(df: DataFrame, keys: list[str], order: list[str], value: str, samples: float, phases: int, offset: float = 0.0) -> DataFrame:
    """(keys, phase, mean): the mean waveform of a series that repeats every `samples` samples."""
    return resampled(df, keys, order, value, samples, phases, offset).groupBy(*keys, "phase").agg(F.avg("value").alias("mean"))


def unresampled(cells: DataFrame, keys: list[str], sizes: DataFrame, samples: float, phases: int, offset: float = 0.0, value: str = "value") -> DataFrame:
    """(keys, i, value): what resampled() gave, or a waveform in its cells, read back by straight lines at the samples i < n of each series; sizes: (keys, n).

    Beyond the first and last cell the cells of a period further in are repeated. A sample between cells of which one is null or missing is null;
    one without a cell before it has no row."""
    step = samples / phases
    whole = Window.partitionBy(*keys)
    own = cells.select(*keys, (F.col("cycle") * phases + F.col("phase")).alias("_p"), F.col(value).alias("_v"))
    own = own.withColumns({"_lo": F.min("_p").over(whole), "_hi": F.max("_p").over(whole)})
    own = own.withColumn("_q", F.explode(F.array_compact(F.array(F.col("_p"), F.when(F.col("_p") < F.col("_lo") + phases, F.col("_p") - phases), F.when(F.col("_p") > F.col("_hi") - phases, F.col("_p") + phases)))))
    w = whole.orderBy("_q")
    own = own.withColumns({"_next": F.when(F.lead("_q").over(w) == F.col("_q") + 1, F.lead("_v").over(w))}).join(sizes.select(*keys, F.col("n").alias("_n")), keys)
    first = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("_q") * step - offset).cast("long"))
    last = F.least(F.col("_n").cast("long"), F.ceil((F.col("_q") + 1) * step - offset).cast("long")) - 1
    own = own.withColumns({"_first": first, "_end": last}).where("_first <= _end").withColumn("i", F.explode(F.sequence("_first", "_end")))
    part = (F.col("i") + offset) / step - F.col("_q")
    return own.select(*keys, "i", F.when(part == 0, F.col("_v")).otherwise(F.col("_v") + (F.col("_next") - F.col("_v")) * part).alias(value))


def running_waveform(df: DataFrame, keys: list[str], order: list[str], value: str, samples: float, phases: int, periods: int, offset: float = 0.0) -> DataFrame:
    """(keys, i, value): at each sample the waveform that repeats around it, each phase averaged over `periods` periods with a Hann weight; missing
    samples, and places beside one, count nowhere."""
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * k / (periods + 1)) for k in range(periods + 2)]
    hann[0] = hann[-1] = 0.0
    cells = windowed_mean(resampled(df, keys, order, value, samples, phases, offset), [*keys, "phase"], ["cycle"], "value", hann, "_mean")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return unresampled(cells.select(*keys, "cycle", "phase", F.col("_mean").alias("value")), keys, sizes, samples, phases, offset)


def waveform_filtered(df: DataFrame, keys: list[str], order: list[str], value: str, samples: float, periods: int, phases: int = 100, out: str = "filtered", masked: str | None = None) -> DataFrame:
    """The series less the running mean of the waveform that repeats every `samples` samples; what the mean of each period holds stays. Samples for which
    the column `masked` is true do not count for the waveform; where none counts, nothing is known of it and nothing goes. Missing samples stay missing."""
    own = demean(indexed(df, keys, order, "_i"), keys, ["_i"], value, samples, "_d", "same")
    known = F.col("_d") if masked is None else F.when(~F.coalesce(F.col(masked), F.lit(False)), F.col("_d"))
    wave = running_waveform(own.select(*keys, "_i", known.alias("_d")), keys, ["_i"], "_d", samples, phases, periods)
    found = wave.select(*keys, F.col("i").alias("_i"), F.col("value").alias("_wave"))
    return own.join(found, [*keys, "_i"], "left").withColumn(out, F.col(value) - F.coalesce("_wave", F.lit(0.0))).select(*df.columns, out)
