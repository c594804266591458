"""Recursive and FFT-like kernels: NumPy over one series at a time, dealt to the tasks by series.

A series is one recording or a part of it, so it fits a task: an hour at 4096 samples a second is 118 MB. The robust
regression takes groups of any size, in rounds of aggregations."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coilwave.operators import spectral as X
from coilwave.tables import written


def _series(df: DataFrame, keys: list[str], order: list[str], value: str, schema: T.StructType, result: Callable[[pa.RecordBatch, np.ndarray, list[np.ndarray]], pa.RecordBatch]) -> DataFrame:
    """result(rows, first, values) for whole series at a time: rows sorted by series and order, the row where each series begins, and its samples
    (null: NaN). The window that numbers the samples has dealt and sorted the rows; a series that a batch cuts waits for its rest."""
    numbered = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
            first = np.flatnonzero(rows.column("_place").to_numpy() == 1)
            x = rows.column(value)
            if pa.types.is_list(x.type):  # several values a sample
                flat = x.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(x), -1).T
                return result(rows.drop_columns(["_place"]), first, np.split(flat, first[1:], axis=1))
            flat = x.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            return result(rows.drop_columns(["_place"]), first, np.split(flat, first[1:]))

        for batch in batches:
            begins = np.flatnonzero(batch.column("_place").to_numpy() == 1)
            if len(begins) and (held or begins[-1] > 0):
                yield whole(pa.concat_batches([*held, batch.slice(0, begins[-1])]))
                held = []
            held.append(batch.slice(begins[-1]) if len(begins) else batch)
        if held:
            yield whole(pa.concat_batches(held))

    return numbered.mapInArrow(run, schema)


#: The variance of normal residuals that Huber's function pulls in at 1.5 scales, and by how much the loss must fall to go on.
SPREAD, FALL = 0.7784, 2e-9
#: Pairs of a key that one task takes in the robust regression (3 MB).
IN_ONE_TASK = 100_000


def per_series(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adds kernel(series) as a column. Null samples reach the kernel as NaN; NaN comes back as null."""

    def result(rows: pa.RecordBatch, first: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        return rows.append_column(out, pa.array(np.concatenate([kernel(x) for x in values]), from_pandas=True))

    return _series(df, keys, order, value, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]), result)


def trailing_medians(x: np.ndarray, n: int) -> np.ndarray:
    """The upper median of what is known among the last n samples. One sorted frame goes along: a sample enters and one leaves by binary search."""
    frame: list[float] = []
    out = np.full(len(x), np.nan)
    samples = x.tolist()
    for i, v in enumerate(samples):
        if v == v:
            insort(frame, v)
        if i >= n and samples[i - n] == samples[i - n]:
            del frame[bisect_left(frame, samples[i - n])]
        if frame:
            out[i] = frame[len(frame) // 2]
    return out


def spectrum(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, n, k, re, im): the Fourier sums of whole series of n samples at k / n cycles a sample, for k up to n / 2. A series with a missing
    sample has null sums: fill it first. Keys have other names than these columns."""
    out = T.StructType([*[df.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("k", T.LongType()), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def result(rows: pa.RecordBatch, first: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        sums = [np.fft.rfft(x) for x in values]
        sizes = np.array([len(s) for s in sums])
        own = rows.select(keys).take(pa.array(np.repeat(first, sizes)))
        c = np.concatenate(sums)
        added = (np.repeat([len(x) for x in values], sizes), np.concatenate([np.arange(m) for m in sizes.tolist()]), c.real, c.imag)
        return pa.RecordBatch.from_arrays([*own.columns, *[pa.array(a, from_pandas=True) for a in added]], names=out.names)

    return _series(df.select(*{*keys, *order, value}), keys, order, value, out, result)


def series_of(sums: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, i, value): the series of which spectrum() gives these sums (keys, n, k, re, im)."""
    out = T.StructType([*[sums.schema[k] for k in keys], T.StructField("i", T.LongType()), T.StructField(value, T.DoubleType())])

    def result(rows: pa.RecordBatch, first: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        sizes = rows.column("n").to_numpy()[first]
        own = rows.select(keys).take(pa.array(np.repeat(first, sizes)))
        back = np.concatenate([np.fft.irfft(c[0] + 1j * c[1], n) for c, n in zip(values, sizes.tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([*own.columns, pa.array(np.concatenate([np.arange(n) for n in sizes.tolist()])), pa.array(back, from_pandas=True)], names=out.names)

    return _series(sums.select(*keys, "n", "k", F.array("re", "im").alias("_c")), keys, ["k"], "_c", out, result)


def notch_coefficients(frequency: float, rate: float, bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order notch: zeros on the unit circle at the frequency, gain 1 far from it, half power at +- bandwidth / 2."""
    w, half = 2 * math.pi * frequency / rate, math.tan(math.pi * bandwidth / rate)
    gain = 1 / (1 + half)
    return gain * np.array([1, -2 * math.cos(w), 1]), np.array([1, -2 * gain * math.cos(w), 2 * gain - 1])


#: Samples that a recursive filter takes as one block.
BLOCK = 64


def recursive(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A second-order filter from a state, block by block: what a block answers to its own samples is one product for all blocks, and
    the state at its beginning adds a fixed response."""
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    inward = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    reach = np.empty((BLOCK + 1, 2, 2))
    reach[0] = np.eye(2)
    for k in range(BLOCK):
        reach[k + 1] = step @ reach[k]
    pulse = np.concatenate([[b[0]], (reach[: BLOCK - 1] @ inward)[:, 0]])
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    own = np.where(lag >= 0, pulse[np.maximum(lag, 0)], 0.0)
    blocks = np.zeros((-(-len(x) // BLOCK), BLOCK))
    blocks.reshape(-1)[: len(x)] = x
    left = blocks @ (reach[BLOCK - 1 :: -1] @ inward)
    states = np.empty((len(blocks), 2))
    for k in range(len(blocks)):
        states[k] = state
        state = reach[BLOCK] @ state + left[k]
    return (blocks @ own.T + states @ reach[:BLOCK, 0].T).reshape(-1)[: len(x)]


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray, pad: int = 9) -> np.ndarray:
    """Forward and backward, with ends reflected oddly and both passes begun in the steady state. Series of at most `pad` samples stay as they are."""
    if len(x) <= pad:
        return x.copy()
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    level = b.sum() / a.sum()
    steady = np.array([level - b[0], b[2] - a[2] * level])
    forth = recursive(b, a, long, steady * long[0])
    back = recursive(b, a, forth[::-1], steady * forth[-1])[::-1]
    return back[pad:-pad]


def notch(df: DataFrame, keys: list[str], order: list[str], value: str, frequency: float, rate: float | Column, bandwidth: float, out: str = "filtered") -> DataFrame:
    """Takes out one frequency without shifting phases. Series with missing samples come back null: fill them first. The rate may be a column that is
    the same for all samples of a series."""
    if not isinstance(rate, Column):
        b, a = notch_coefficients(frequency, rate, bandwidth)
        return per_series(df, keys, order, value, out, lambda x: zero_phase(b, a, x))
    two = F.array(F.col(value).cast("double"), rate.cast("double"))
    return per_series(df.withColumn("_two", two), keys, order, "_two", out, lambda x: zero_phase(*notch_coefficients(frequency, float(x[1][0]), bandwidth), x[0])).drop("_two")


def huber_regression(t: np.ndarray, r: np.ndarray, r0: float = 1.5, most: int = 100, two_sided: bool = False) -> tuple[complex, float, int, float, bool]:
    """Robust H with r = H t, its variance by part, rounds, share of good residuals (by default those below r0, whatever their sign), and whether the loss
    had stopped falling when the rounds ended.

    Residuals beyond r0 scales, real and imaginary parts apart, are pulled in and H is fitted anew, while the loss falls."""
    n, power = len(t), float((np.abs(t) ** 2).sum())
    h = complex((t.conj() * r).sum() / power)
    parts = lambda z: np.concatenate([z.real, z.imag])
    res = parts(r - h * t)
    scale = math.sqrt(float(res @ res) / (2 * n - 2))
    if not scale:
        return h, 0.0, 0, 1.0, True
    loss = lambda x: float(np.where(np.abs(x) < r0, x * x / 2, r0 * np.abs(x) - r0 * r0 / 2).sum())
    old, rounds, pulled = math.inf, 0, parts(r)
    now = loss(res / scale)
    while rounds == 0 or (now < old * (1 - FALL) and rounds < most):
        old = now
        x = np.abs(res / scale)
        pulled = parts(h * t) + np.where(x <= r0, 1.0, r0 / np.maximum(x, 1e-300)) * res
        star = pulled[:n] + 1j * pulled[n:]
        h = complex((t.conj() * star).sum() / power)
        res = parts(r - h * t)
        scale = math.sqrt(float(res @ res) / (2 * n - 2) / SPREAD)
        rounds += 1
        if not scale:
            return h, 0.0, rounds, 1.0, True
        now = loss(res / scale)
    good = float(np.mean((np.abs(res) if two_sided else res) / scale < r0))
    fit = parts(h * t)
    return h, float(pulled @ pulled - fit @ fit) / power / (2 * n - 2) / good**2, rounds, good, now >= old * (1 - FALL)


def regression_m(pairs: DataFrame, keys: list[str], tx: str = "t", rx: str = "r", r0: float = 1.5, most: int = 100, two_sided: bool = False, in_one_task: int | None = None) -> DataFrame:
    """(keys, n, re, im, v, rounds, good, converged): a robust transfer function of each group of complex pairs, as by huber_regression. Pairs with
    a null or NaN count nowhere; groups of one pair, or without power, have nulls. converged is false where `most` rounds were not enough.

    Keys of at most `in_one_task` (else IN_ONE_TASK) pairs are solved in one task each. A key may have any number of pairs: for larger ones each round is one
    aggregation over the pairs, and only H and the scale of each key go back to them."""
    in_one_task = IN_ONE_TASK if in_one_task is None else in_one_task
    parts = [f"{c}_{p}" for c in (tx, rx) for p in ("re", "im")]
    known = F.lit(True)
    for c in parts:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    # as one struct, keys that are null meet too
    own = pairs.select(F.struct(*keys).alias("k"), *[F.when(known, F.col(c).cast("double")).alias(x) for c, x in zip(parts, ("tr", "ti", "rr", "ri"), strict=True)])
    own = written(own, "pairs")
    # keys by number, as a struct is no pandas value; the numbers are written, so they stay what they are
    sizes = written(own.groupBy("k").agg(F.count("*").alias("size")).withColumn("kk", F.monotonically_increasing_id()), "sizes")
    few = own.join(sizes.where(F.col("size") <= in_one_task).select("k"), "k", "left_semi")
    own = own.join(sizes.where(F.col("size") > in_one_task).select("k"), "k", "left_semi")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        known = group[["tr", "ti", "rr", "ri"]].dropna().to_numpy(float)
        t, r = known[:, 0] + 1j * known[:, 1], known[:, 2] + 1j * known[:, 3]
        power = float((np.abs(t) ** 2).sum())
        h, v, rounds, good, converged = huber_regression(t, r, r0, most, two_sided) if len(t) > 1 and power > 0 else (None,) * 5
        row = (group["kk"].iloc[0], len(t), *((None, None) if h is None else (h.real, h.imag)), v if good != 0 else None, rounds, good, converged)
        return pd.DataFrame([row], columns=["kk", "n", "re", "im", "v", "rounds", "good", "converged"]).astype(object)

    named = sizes.select("k", "kk")
    solved = few.join(named, "k").groupBy("kk").applyInPandas(solve, "kk long, n long, re double, im double, v double, rounds long, good double, converged boolean")
    solved = solved.join(named, "kk").select(*[F.col("k")[c].alias(c) for c in keys], "n", "re", "im", "v", "rounds", "good", "converged")
    if sizes.where(F.col("size") > in_one_task).isEmpty():
        return solved
    own = written(own, "many")
    tr, ti, rr, ri = (F.col(x) for x in ("tr", "ti", "rr", "ri"))

    def residuals(h: str = "h") -> tuple[Column, Column]:
        re, im = X.times((tr, ti), X.pair(h))
        return rr - re, ri - im

    def pulled(h: str, scale: str) -> tuple[Column, Column]:
        fit = X.times((tr, ti), X.pair(h))
        return tuple(f + X.huber_weight(x / F.col(scale), r0) * x for f, x in zip(fit, residuals(h), strict=True))

    def fitted(to: tuple[Column, Column]) -> list[Column]:
        return [F.sum(tr * to[0] + ti * to[1]).alias("a"), F.sum(tr * to[1] - ti * to[0]).alias("b")]

    def met(state: DataFrame, *aggs: Column) -> DataFrame:
        """Sums over the pairs of the keys of a state, beside the state."""
        kept = [F.first(c).alias(c) for c in state.columns if c != "k"]
        return own.join(F.broadcast(state), "k").groupBy("k").agg(*kept, *aggs)

    squares = F.sum(residuals()[0] ** 2 + residuals()[1] ** 2).alias("ss")
    first = own.groupBy("k").agg(F.count("tr").alias("n"), F.sum(tr * tr + ti * ti).alias("power"), *fitted((rr, ri)))
    first = written(first.withColumns({"h_re": F.try_divide("a", "power"), "h_im": F.try_divide("b", "power")}).drop("a", "b"), "first")
    able = (F.col("n") > 1) & (F.col("power") > 0)
    state = met(first.where(able), squares)
    # what the least-squares H leaves is orthogonal to t, so any other H leaves that and |H - H0| ** 2 times the power: a round needs no pass for its scale
    state = state.select("k", "n", "power", "ss", F.col("h_re").alias("z_re"), F.col("h_im").alias("z_im"), "h_re", "h_im", F.sqrt(F.col("ss") / (2 * F.col("n") - 2)).alias("scale"), F.lit(0).cast("long").alias("rounds"), F.lit(math.inf).alias("old"), F.lit(0.0).alias("g_re"), F.lit(0.0).alias("g_im"), F.lit(0.0).alias("was"))
    state = written(state, "state")
    ended = []
    loss = sum((F.sum(X.huber_loss(x / F.col("scale"), r0)) for x in residuals()), F.lit(0.0)).alias("now")
    falls = (F.col("rounds") == 0) | ((F.col("now") < F.col("old") * (1 - FALL)) & (F.col("rounds") < most))
    while True:
        ended.append(state.where("scale = 0").withColumn("converged", F.lit(True)))
        tried = written(met(state.where("scale <> 0"), loss, *fitted(pulled("h", "scale"))), "tried")
        ended.append(tried.where(~falls).select(*state.columns, (F.col("now") >= F.col("old") * (1 - FALL)).alias("converged")))
        again = tried.where(falls)
        if again.isEmpty():
            break
        again = again.select("k", "n", "power", "ss", "z_re", "z_im", (F.col("a") / F.col("power")).alias("h_re"), (F.col("b") / F.col("power")).alias("h_im"), (F.col("rounds") + 1).alias("rounds"), F.col("now").alias("old"), F.col("h_re").alias("g_re"), F.col("h_im").alias("g_im"), F.col("scale").alias("was"))
        left = F.col("ss") + ((F.col("h_re") - F.col("z_re")) ** 2 + (F.col("h_im") - F.col("z_im")) ** 2) * F.col("power")
        state = again.withColumn("scale", F.sqrt(left / (2 * F.col("n") - 2) / SPREAD)).select(*state.columns)
    done = written(reduce(DataFrame.unionByName, ended), "done")
    # What the last fit leaves of the pulled values: H is fitted to them, so it is also their power less the fit's.
    last, fit = pulled("g", "was"), X.times((tr, ti), X.pair("h"))
    rest = F.sum((last[0] - fit[0]) ** 2 + (last[1] - fit[1]) ** 2).alias("rest")
    inside = [F.when((F.abs(x) if two_sided else x) / F.col("scale") < r0, 1.0).otherwise(0.0) for x in residuals()]
    own_good = F.sum(F.when(tr.isNotNull(), inside[0] + inside[1])).alias("inside")
    sums = met(done.where("scale <> 0"), rest, own_good).withColumn("good", F.col("inside") / (2 * F.col("n")))
    variance = F.try_divide(F.col("rest") / F.col("power") / (2 * F.col("n") - 2), F.col("good") ** 2)
    out = sums.select("k", variance.alias("v"), "rounds", "good", "h_re", "h_im", "converged").unionByName(done.where("scale = 0").select("k", F.lit(0.0).alias("v"), "rounds", F.lit(1.0).alias("good"), "h_re", "h_im", "converged"))
    every = first.select("k", "n").join(out, "k", "left")
    return solved.unionByName(every.select(*[F.col("k")[c].alias(c) for c in keys], "n", F.col("h_re").alias("re"), F.col("h_im").alias("im"), "v", "rounds", "good", "converged"))
