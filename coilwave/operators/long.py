"""Series of any length: parts of them in many tasks, with halos for frames and carries for what runs on.

numbered() gives each sample its place in the whole series, from a table sorted by ranges and counts by range. From then on a part is place div
SIZE. A frame takes its part with a halo of samples from the parts beside it; a running sum, number of weeks, or last known value is found in each part from
nothing, and what the parts before it end with is added. Those carries are a row for each part, gone through in one order for each series: a millionth of
the samples. Every operator gives the rows of its namesake in operators/series.py."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coilwave.operators import kernels as K
from coilwave.operators import series as S
from coilwave.tables import written

#: Samples of a part.
SIZE = 1 << 20


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "i", parts: int | None = None) -> DataFrame:
    """df with the place of each sample in its series, from 0, as a written table. Order columns must tell the samples of a series apart."""
    columns = [*keys, *order]
    dealt = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    held = written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = held.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = _renamed(counts.select(*keys, F.col("_range").alias("_r"), before.alias("_base")), keys)
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    own = held.withColumn("_place", place).join(bases, _same(keys, F.col("_range") == F.col("_r")))
    return written(own.withColumn(name, (F.col("_base") + F.col("_place")).cast("long")).select(*df.columns, name), "numbered")


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with its keys renamed, for _same()."""
    return df.withColumnsRenamed({k: f"_k{j}" for j, k in enumerate(keys)})


def _same(keys: list[str], more: Column) -> Column:
    """Keys that are null are equal."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)], more)


def with_halos(df: DataFrame, index: str, before: int, after: int, size: int = SIZE) -> DataFrame:
    """Adds _part; a sample is also in every part that begins up to `before` samples after it or ends up to `after` samples ahead of it."""
    first = F.greatest(F.lit(0), F.floor((F.col(index) - after) / size))
    return df.withColumn("_part", F.explode(F.sequence(first.cast("long"), F.floor((F.col(index) + before) / size).cast("long"))))


def framed(df: DataFrame, keys: list[str], index: str, before: int, after: int, make: Callable[[DataFrame, list[str], list[str]], DataFrame], size: int = SIZE) -> DataFrame:
    """make(samples, keys, order) over parts with their halos; of the rows that it gives for samples, those of the part itself stay.

    `before` and `after` are how far make() looks back and ahead. At the ends of a series it sees that there is no more."""
    return make(with_halos(df, index, before, after, size), [*keys, "_part"], [index]).where(F.floor(F.col(index) / size) == F.col("_part")).drop("_part")


def running_mean(df: DataFrame, keys: list[str], index: str, value: str, n: int, out: str = "mean", edges: str = "null", size: int = SIZE) -> DataFrame:
    """series.running_mean()."""
    made = framed(df, keys, index, n, n, lambda d, k, o: S.running_mean(d, k, o, value, n, out, "edge" if edges == "edge" else "null"), size)
    if edges != "same":
        return made
    ends = _renamed(made.where(F.col(out).isNotNull()).groupBy(*keys).agg(F.min(index).alias("_i1"), F.min_by(out, index).alias("_m1"), F.max_by(out, index).alias("_m2")), keys)
    # a null between full means takes the last one, as in a window over all
    own = made.join(ends, _same(keys, F.lit(True)), "left")
    return own.withColumn(out, F.coalesce(out, F.when(F.col(index) < F.col("_i1"), F.col("_m1")), F.col("_m2"))).select(*df.columns, out)


def running_mean_fractional(df: DataFrame, keys: list[str], index: str, value: str, n: float, out: str = "mean", size: int = SIZE) -> DataFrame:
    """series.running_mean_fractional()."""
    return framed(df, keys, index, int(n) + 1, int(n) + 1, lambda d, k, o: S.running_mean_fractional(d, k, o, value, n, out), size)


def demean(df: DataFrame, keys: list[str], index: str, value: str, n: float, out: str = "demeaned", size: int = SIZE) -> DataFrame:
    """series.demean()."""
    return framed(df, keys, index, int(n) + 1, int(n) + 1, lambda d, k, o: S.demean(d, k, o, value, n, out), size)


def running_median(df: DataFrame, keys: list[str], index: str, value: str, n: int, out: str = "median", size: int = SIZE) -> DataFrame:
    """series.running_median()."""
    return framed(df, keys, index, n, 0, lambda d, k, o: S.running_median(d, k, o, value, n, out), size)


def prewhiten(df: DataFrame, keys: list[str], index: str, value: str, out: str = "diff", size: int = SIZE) -> DataFrame:
    """series.prewhiten()."""
    return framed(df, keys, index, 1, 0, lambda d, k, o: S.prewhiten(d, k, o, value, out), size)


def running_sum(df: DataFrame, keys: list[str], index: str, value: Column, out: str, size: int = SIZE) -> DataFrame:
    """The sum of all values up to each sample (nulls add nothing): sums within parts, and the sums of the parts before."""
    own = df.withColumns({"_part": F.floor(F.col(index) / size), "_v": value})
    totals = own.groupBy(*keys, "_part").agg(F.sum("_v").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carries = _renamed(totals.select(*keys, F.col("_part").alias("_of"), before.alias("_carry")), keys)
    within = F.sum("_v").over(Window.partitionBy(*keys, "_part").orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_s", within).join(carries, _same(keys, F.col("_part") == F.col("_of")))
    return own.withColumn(out, F.coalesce("_s", F.lit(0)) + F.col("_carry")).select(*df.columns, out)


def week_numbers(df: DataFrame, keys: list[str], index: str, seconds: str, first_week: int = 0, out: str = "week", size: int = SIZE) -> DataFrame:
    """series.week_numbers()."""
    fell = lambda d, k, o: d.withColumn("_fell", F.when(F.lag(seconds).over(Window.partitionBy(*k).orderBy(*o)) > F.col(seconds) + 600_000, 1).otherwise(0))
    own = framed(df, keys, index, 1, 0, fell, size)
    return running_sum(own, keys, index, F.col("_fell"), "_w", size).withColumn(out, F.col("_w") + first_week).select(*df.columns, out)


def unwrap(df: DataFrame, keys: list[str], index: str, phase: str, out: str = "unwrapped", period: float = 6.283185307179586, size: int = SIZE) -> DataFrame:
    """series.unwrap()."""

    def turned(d: DataFrame, k: list[str], o: list[str]) -> DataFrame:
        step = F.col(phase) - F.lag(phase).over(Window.partitionBy(*k).orderBy(*o))
        return d.withColumn("_turn", F.coalesce(F.when(F.abs(step) > period / 2, -F.round(step / period)), F.lit(0.0)))

    own = framed(df, keys, index, 1, 0, turned, size)
    return running_sum(own, keys, index, F.col("_turn"), "_turns", size).withColumn(out, F.col(phase) + period * F.col("_turns")).select(*df.columns, out)


def _carried(df: DataFrame, keys: list[str], index: str, at: str, out: str, back: bool, size: int) -> DataFrame:
    """`out`: the last `at` that is not null up to each sample (back: from it on), within its part or else from the parts before it."""
    own = df.withColumn("_part", F.floor(F.col(index) / size))
    place = F.when(F.col(at).isNotNull(), F.col(index))
    edge = (F.min_by if back else F.max_by)(at, place).alias("_edge")
    order = F.col("_part").desc() if back else F.col("_part")
    before = F.last("_edge", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    carries = _renamed(own.groupBy(*keys, "_part").agg(edge).select(*keys, F.col("_part").alias("_of"), before.alias("_carry")), keys)
    inside = Window.partitionBy(*keys, "_part").orderBy(F.col(index).desc() if back else F.col(index)).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_in", F.last(at, ignorenulls=True).over(inside)).join(carries, _same(keys, F.col("_part") == F.col("_of")))
    return own.withColumn(out, F.coalesce("_in", "_carry")).select(*df.columns, out)


def interpolate(df: DataFrame, keys: list[str], index: str, value: str, out: str = "filled", ends: str = "hold", size: int = SIZE) -> DataFrame:
    """series.interpolate() with the place as x."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(index).cast("double").alias("x"), F.col(value).cast("double").alias("y")))
    own = _carried(df.withColumn("_p", known), keys, index, "_p", "_a", False, size)
    own = _carried(own, keys, index, "_p", "_b", True, size)
    x = F.col(index).cast("double")

    def line(p: str, q: str) -> Column:
        px, py, qx, qy = (F.col(f"{n}.{c}") for n in (p, q) for c in "xy")
        return py + (qy - py) * (x - px) / F.nullif(qx - px, F.lit(0.0))

    inside = F.when(F.col("_p").isNotNull(), F.col(value).cast("double")).otherwise(line("_a", "_b"))
    if ends == "hold":
        return own.withColumn(out, F.coalesce(inside, F.col("_a.y"), F.col("_b.y"))).select(*df.columns, out)
    # the two known values nearest to either end
    ends_of = own.where("_p is not null").groupBy(*keys).agg(F.min("_p").alias("_f1"), F.max("_p").alias("_l1"))
    inner = own.select(*keys, "_p").join(_renamed(ends_of, keys), _same(keys, F.lit(True)))
    few = inner.groupBy(*keys).agg(F.first("_f1").alias("_f1"), F.first("_l1").alias("_l1"), F.min(F.when(F.col("_p.x") > F.col("_f1.x"), F.col("_p"))).alias("_f2"), F.max(F.when(F.col("_p.x") < F.col("_l1.x"), F.col("_p"))).alias("_l2"))
    few = _renamed(few, keys)
    own = own.join(few, _same(keys, F.lit(True)), "left")
    value_at = F.coalesce(inside, F.when(F.col("_a").isNull(), F.coalesce(line("_f1", "_f2"), F.col("_f1.y"))), F.coalesce(line("_l1", "_l2"), F.col("_l1.y")))
    return own.withColumn(out, value_at).select(*df.columns, out)


#: Ranges that values are counted in at once, and values of one range that one task ranks.
CELLS, RANKED = 256, 100_000


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], cells: int = CELLS, most: int = RANKED) -> DataFrame:
    """(keys, a column for each of `ranks`): the values of these ranks (from 0) among the known values of each series; a rank is an expression over n, how many there are.

    Values are counted in `cells` ranges between their least and greatest, and only the range that holds a rank goes on to the next round, with its own least and
    greatest; once a range has at most `most` values, or one value only, it is ranked. No task gets more, however many samples a series has."""
    own = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = own.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    state = written(sizes.withColumn("_a", asked).select(*keys, "n", "lo", "hi", "_a.name", "_a.rank").where("rank between 0 and n - 1"), "ranks")
    done = []
    while True:
        done.append(state.where(F.col("lo") == F.col("hi")).select(*keys, "name", F.col("lo").alias("_r")))
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        met = own.join(_renamed(open_, keys), _same(keys, F.col("_v").between(F.col("lo"), F.col("hi")))).select(*keys, "name", "rank", "n", "lo", "hi", "_v")
        few = met.where(F.col("n") <= most).withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "name").orderBy("_v")) - 1)
        done.append(written(few.where("_k = rank").select(*keys, "name", F.col("_v").alias("_r")), "ranked"))
        # halves first, as the span of two doubles may be no double; equal values share a cell, and cells keep their order
        cell = F.least(F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * cells), F.lit(cells - 1))
        counts = met.where(F.col("n") > most).groupBy(*keys, "name", "rank", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "name").orderBy("cell"))
        held = counts.withColumn("_upto", upto).where("rank >= _upto - n and rank < _upto")
        state = written(held.select(*keys, "n", "lo", "hi", "name", (F.col("rank") - F.col("_upto") + F.col("n")).alias("rank")), "ranks")
    found = reduce(DataFrame.unionByName, done)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("_r"))).alias(name) for name in ranks])


def winsorize(df: DataFrame, keys: list[str], value: str, p: float, out: str = "clipped", mask: bool = False, **how: int) -> DataFrame:
    """series.winsorize(), for series of any length."""
    k = F.floor(F.lit(p) * F.col("n"))
    bounds = _renamed(ranked_values(df, keys, value, {"_lo": k, "_hi": F.col("n") - k - 1}, **how), keys)
    own = df.join(bounds, _same(keys, F.lit(True)), "left")
    inside = F.col(value).between(F.col("_lo"), F.col("_hi"))
    clipped = F.when(inside, F.col(value)) if mask else F.when(F.col(value).isNotNull(), F.greatest("_lo", F.least("_hi", value)))
    return own.withColumn(out, clipped).select(*df.columns, out)


def period(df: DataFrame, keys: list[str], index: str, value: str, guess: int, around: int = 2, excluded: int = 3) -> DataFrame:
    """(keys, period): samples a waveform lasts. Of the lags within `around` of twice the guess that one counts at which the sum of products of samples is greatest (of
    equal ones the least), then of those around twice that lag, and so on while lags stay below the series' length less `excluded` guesses; the last one is divided
    by its number of waveforms. A series that is too short keeps the guess. Null samples add nothing.

    Each round is a join of the samples with themselves by place and lag, summed by series and lag."""
    own = df.select(*keys, F.col(index).cast("long").alias("_i"), F.col(value).cast("double").alias("_x"))
    sizes = own.groupBy(*keys).agg((F.count(F.lit(1)) - excluded * guess).alias("_most"))
    state = written(sizes.select(*keys, "_most", F.lit(2 * guess).cast("long").alias("_lag"), F.lit(2).cast("long").alias("_times")), "lags")
    done = []
    going = F.col("_lag") + around < F.col("_most")
    shifted = _renamed(own.select(*keys, F.col("_i").alias("_j"), F.col("_x").alias("_y")), keys)
    while True:
        done.append(state.where(~going).select(*keys, (F.col("_lag") / F.col("_times")).alias("period")))
        open_ = state.where(going)
        if open_.isEmpty():
            break
        lagged = own.join(_renamed(open_, keys), _same(keys, F.lit(True))).select(*own.columns, "_most", "_times", F.explode(F.sequence(F.col("_lag") - around, F.col("_lag") + around)).alias("_l"))
        met = lagged.join(shifted, _same(keys, F.col("_i") + F.col("_l") == F.col("_j")))
        sums = met.groupBy(*keys, "_most", "_times", "_l").agg(F.coalesce(F.sum(F.col("_x") * F.col("_y")), F.lit(0.0)).alias("_s"))
        best = sums.groupBy(*keys, "_most", "_times").agg(F.max(F.struct("_s", (-F.col("_l")).alias("_l"))).alias("_b"))
        state = written(best.select(*keys, "_most", (-2 * F.col("_b._l")).alias("_lag"), (2 * F.col("_times")).alias("_times")), "lags")
    return reduce(DataFrame.unionByName, done)


def notch(df: DataFrame, keys: list[str], index: str, value: str, frequency: float, rate: float, bandwidth: float, out: str = "filtered", size: int = SIZE) -> DataFrame:
    """kernels.notch(): a recursive filter forth and back over series of any length, whose samples are placed by `index` (from 0, without gaps).

    A filter carries two numbers from sample to sample, and a part maps them to state -> A ** length * state + what its own samples leave. So each part is filtered
    from rest, these maps are composed over the parts, and what the state at a part's begin adds to it is added. Series of at most 9 samples stay as they are,
    series with missing samples become null."""
    b, a = K.notch_coefficients(frequency, rate, bandwidth)
    pad = 9
    own = df.select(*keys, F.col(index).cast("long").alias("_i"), F.col(value).cast("double").alias("_x"))
    sizes = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.count("_x") < F.count(F.lit(1))).alias("_holes"))
    edge = own.join(_renamed(sizes, keys), _same(keys, F.lit(True))).drop(*[f"_k{j}" for j in range(len(keys))]).where(f"_n > {pad} and not _holes")
    ends = edge.where(f"_i <= {pad} or _i >= _n - {pad + 1}").groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.max(F.when(F.col("_i") == 0, F.col("_x"))).alias("_x0"), F.max(F.when(F.col("_i") == F.col("_n") - 1, F.col("_x"))).alias("_x1"),
        F.collect_list(F.when(F.col("_i").between(1, pad), F.struct("_i", "_x"))).alias("_head"), F.collect_list(F.when(F.col("_i").between(F.col("_n") - 1 - pad, F.col("_n") - 2), F.struct("_i", "_x"))).alias("_tail"),
    )
    head = ends.select(*keys, F.col("_x0"), F.explode("_head").alias("_e")).select(*keys, (pad - F.col("_e._i")).alias("_i"), (2 * F.col("_x0") - F.col("_e._x")).alias("_x"))
    tail = ends.select(*keys, "_n", F.col("_x1"), F.explode("_tail").alias("_e")).select(*keys, (2 * (F.col("_n") - 1) - F.col("_e._i") + pad).alias("_i"), (2 * F.col("_x1") - F.col("_e._x")).alias("_x"))
    whole = edge.select(*keys, (F.col("_i") + pad).alias("_i"), "_x").unionByName(head).unionByName(tail)
    forth = _recursive(written(whole, "long"), keys, b, a, size)
    last = _renamed(ends.select(*keys, (F.col("_n") + 2 * pad - 1).alias("_end")), keys)
    turned = forth.join(last, _same(keys, F.lit(True))).select(*keys, (F.col("_end") - F.col("_i")).alias("_i"), F.col("_y").alias("_x"), "_end")
    back = _recursive(written(turned, "back"), keys, b, a, size).select(*keys, (F.col("_end") - F.col("_i") - pad).alias("_i"), "_y")
    found = _renamed(back.withColumnRenamed("_i", "_at"), keys)
    short = _renamed(sizes.where(f"_n <= {pad}").select(*keys, F.lit(True).alias("_short")), keys)
    out_of = df.join(found, _same(keys, F.col(index) == F.col("_at")), "left").drop(*[f"_k{j}" for j in range(len(keys))]).join(short, _same(keys, F.lit(True)), "left")
    return out_of.withColumn(out, F.coalesce("_y", F.when(F.col("_short"), F.col(value).cast("double")))).select(*df.columns, out)


def _recursive(df: DataFrame, keys: list[str], b: np.ndarray, a: np.ndarray, size: int) -> DataFrame:
    """df (keys, _i from 0, _x, ...) with _y, filtered from the steady state of the first sample."""
    level = b.sum() / a.sum()
    steady = np.array([level - b[0], b[2] - a[2] * level])
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    own = df.withColumn("_part", F.floor(F.col("_i") / size))
    by = [*keys, "_part"]
    key_types = "".join(f"{k} {own.schema[k].dataType.simpleString()}, " for k in keys)

    def left(group: pd.DataFrame) -> pd.DataFrame:
        """What a part leaves behind, from rest."""
        x = group.sort_values("_i")["_x"].to_numpy()
        # the state after the last sample follows from what comes out, and from the last two samples
        y = K.recursive(b, a, x, np.zeros(2))
        second = b[2] * x[-1] - a[2] * y[-1]
        before = b[2] * x[-2] - a[2] * y[-2] if len(x) > 1 else 0.0
        first = before + b[1] * x[-1] - a[1] * y[-1]
        return pd.DataFrame([(*(group[k].iloc[0] for k in by), len(x), x[0], first, second)], columns=[*by, "m", "x0", "s0", "s1"])

    def begun(parts: pd.DataFrame) -> pd.DataFrame:
        """The state at the begin of each part: the maps of those before it, one after another."""
        parts = parts.sort_values("_part")
        state, states, powers = steady * parts["x0"].iloc[0], [], {}
        for m, s0, s1 in parts[["m", "s0", "s1"]].itertuples(index=False):
            states.append(state)
            if m not in powers:
                powers[m] = np.linalg.matrix_power(step, int(m))
            state = powers[m] @ state + np.array([s0, s1])
        return parts[by].assign(s0=[s[0] for s in states], s1=[s[1] for s in states])

    ends = own.groupBy(*by).applyInPandas(left, f"{key_types}_part long, m long, x0 double, s0 double, s1 double")
    states = ends.groupBy(*keys).applyInPandas(begun, f"{key_types}_part long, s0 double, s1 double")
    states = _renamed(written(states, "states").withColumnRenamed("_part", "_of"), keys)
    met = own.join(states, _same(keys, F.col("_part") == F.col("_of"))).select(*own.columns, "s0", "s1")

    kept = [*df.columns, "_y"]

    def filtered(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_i")
        y = K.recursive(b, a, group["_x"].to_numpy(), group[["s0", "s1"]].iloc[0].to_numpy())
        return group.assign(_y=y)[kept]

    return met.groupBy(*by).applyInPandas(filtered, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", _y double")
