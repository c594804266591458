"""Fourier sums of whole series of any length, and back, with a series spread over many tasks.

The sums of n samples are a convolution with a chirp: k i = (k^2 + i^2 - (k - i)^2) / 2. The convolution is circular over M places, the least power of two that
holds it, and M is a grid of R rows and C columns, both near its root. Three shuffles take it through: (1) columns of the grid, with samples and chirp, are
transformed from row to row; (2) rows are transformed from column to column, multiplied with the chirp's and transformed back; (3) columns are transformed back.
Between them blocks of the grid travel as tiles. A task holds a block of whole columns or rows: BLOCK places, or one line where a line is longer than that."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coilwave.operators import kernels as K
from coilwave.operators import long as G
from coilwave.tables import written

#: log2 of the places of a block (16 MB of complex numbers); series of at most so many samples are transformed whole, many in a batch.
BLOCK, WHOLE = 20, 1 << 20

TILES = "_s long, _m int, _n long, _to long, _from long, _tile binary"


def _grid(m: int, block: int) -> tuple[int, int, int, int]:
    """log2 of columns, of rows, of columns in a block of columns, and of rows in a block of rows."""
    columns = m // 2
    rows = m - columns
    return columns, rows, min(columns, max(0, block - rows)), min(rows, max(0, block - columns))


def _chirp(p: np.ndarray, n: int) -> np.ndarray:
    return np.exp(1j * np.pi / n * (p * p % (2 * n)))


def _turns(rows: np.ndarray, columns: np.ndarray, m: int) -> np.ndarray:
    return np.exp(2j * np.pi / (1 << m) * np.multiply.outer(rows, columns))


def _cut(parts: np.ndarray, axis: int, size: int, fixed: tuple[int, int, int], of: int) -> pd.DataFrame:
    """A block as tiles for the blocks of the other direction, which have `size` lines each along the axis."""
    tiles = np.split(parts, parts.shape[axis] // size, axis)
    return pd.DataFrame([(*fixed, to, of, np.ascontiguousarray(t).tobytes()) for to, t in enumerate(tiles)], columns=["_s", "_m", "_n", "_to", "_from", "_tile"])


def _columns_forth(block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        s, m, n, of = (int(group[c].iloc[0]) for c in ("_s", "_m", "_n", "_block"))
        columns, rows, width, height = _grid(m, block)
        own = np.arange(1 << width) + (of << width)
        place = np.add.outer(np.arange(1 << rows) << columns, own)
        far = np.minimum(place, (1 << m) - place)
        both = np.zeros((2, *place.shape), complex)
        both[1] = np.where(far < n, _chirp(far, n), 0)
        p = group["_p"].to_numpy()
        both[0][p >> columns, (p & ((1 << columns) - 1)) - own[0]] = (group["_re"].to_numpy() + 1j * group["_im"].to_numpy()) * _chirp(p, n).conj()
        both = np.fft.fft(both, axis=1) * _turns(np.arange(1 << rows), own, m).conj()
        return _cut(both, 1, 1 << height, (s, m, n), of)

    return run


def _rows_forth_and_back(block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        s, m, n, of = (int(group[c].iloc[0]) for c in ("_s", "_m", "_n", "_to"))
        columns, _, width, height = _grid(m, block)
        tiles = [np.frombuffer(t, complex).reshape(2, 1 << height, 1 << width) for t in group.sort_values("_from")["_tile"]]
        sums = np.fft.fft(np.concatenate(tiles, axis=2), axis=2)
        back = np.fft.ifft(sums[0] * sums[1], axis=1) * _turns(np.arange(1 << height) + (of << height), np.arange(1 << columns), m)
        return _cut(back, 1, 1 << width, (s, m, n), of)

    return run


def _columns_back(block: int, half: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        s, m, n, of = (int(group[c].iloc[0]) for c in ("_s", "_m", "_n", "_to"))
        columns, rows, width, height = _grid(m, block)
        tiles = [np.frombuffer(t, complex).reshape(1 << height, 1 << width) for t in group.sort_values("_from")["_tile"]]
        found = np.fft.ifft(np.concatenate(tiles, axis=0), axis=0)
        place = np.add.outer(np.arange(1 << rows) << columns, np.arange(1 << width) + (of << width))
        kept = place < (n // 2 + 1 if half else n)
        k = place[kept]
        sums = found[kept] * _chirp(k, n).conj()
        return pd.DataFrame({"_s": s, "_n": n, "_k": k, "_re": sums.real, "_im": sums.imag})

    return run


def _sums(placed: DataFrame, half: bool, block: int) -> DataFrame:
    """(_s, _n, _k, _re, _im): the sums of complex series (_s, _n, _p, _re, _im) of n < 2^31 samples each, at places from 0 without gaps."""
    m = F.length(F.bin(2 * F.col("_n") - 2))
    columns = F.floor(m / 2)
    width = F.least(columns, F.greatest(F.lit(0), F.lit(block) - (m - columns)))
    own = placed.withColumn("_m", m.cast("int")).withColumn("_block", F.floor(F.expr("_p") % F.pow(F.lit(2.0), columns) / F.pow(F.lit(2.0), width)).cast("long"))
    forth = own.groupBy("_s", "_block").applyInPandas(_columns_forth(block), TILES)
    back = forth.groupBy("_s", "_to").applyInPandas(_rows_forth_and_back(block), TILES)
    return back.groupBy("_s", "_to").applyInPandas(_columns_back(block, half), "_s long, _n long, _k long, _re double, _im double")


def _named(sizes: DataFrame) -> DataFrame:
    """sizes (keys, n) with a number for each series, as a written table, so that the numbers stay."""
    return written(sizes.withColumn("_s", F.monotonically_increasing_id()), "series")


def _whole_or_not(sizes: DataFrame, keys: list[str], df: DataFrame, whole: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the series of at most `whole` samples, and of the others (None: there are none). Keys that are null are equal."""
    many = sizes.where(F.col("_n") > whole)
    if many.isEmpty():
        return df, None
    named = G._renamed(many.select(*keys), keys)
    return tuple(df.join(named, G._same(keys, F.lit(True)), how) for how in ("left_anti", "left_semi"))


def spectrum(df: DataFrame, keys: list[str], order: list[str], value: str, whole: int = WHOLE, block: int = BLOCK) -> DataFrame:
    """(keys, n, k, re, im): the Fourier sums of whole series of n samples at k / n cycles a sample, for k up to n / 2.

    A series with a missing sample has null sums: fill it first. Keys that are null are equal; they have other names than these columns, and order columns tell
    the samples of a series apart. An empty table gives no rows. Series of at most `whole` samples are transformed whole, by kernels.spectrum; longer ones, of
    below 2^31 samples, in blocks of 2 ** block places."""
    sizes = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    few, many = _whole_or_not(sizes, keys, df, whole)
    short = K.spectrum(few, keys, order, value)
    if many is None:
        return short
    named = _named(sizes.where(F.col("_n") > whole))
    own = G.numbered(many.select(*dict.fromkeys([*keys, *order, value])), keys, order, "_p")
    # a missing sample makes every sum NaN
    x = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    placed = own.join(G._renamed(named, keys), G._same(keys, F.lit(True))).select("_s", "_n", "_p", x.alias("_re"), F.lit(0.0).alias("_im"))
    sums = _sums(placed, True, block).join(named.select("_s", *keys), "_s")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return short.unionByName(sums.select(*keys, F.col("_n").alias("n"), F.col("_k").alias("k"), known("_re").alias("re"), known("_im").alias("im")))


def series_of(sums: DataFrame, keys: list[str], value: str = "value", whole: int = WHOLE, block: int = BLOCK) -> DataFrame:
    """(keys, i, value): the series of which spectrum() gives these sums (keys, n, k, re, im), all n // 2 + 1 of them; null where sums are null."""
    sizes = written(sums.groupBy(*keys).agg(F.max("n").alias("_n")), "sizes")
    few, many = _whole_or_not(sizes, keys, sums, whole)
    short = K.series_of(few, keys, value)
    if many is None:
        return short
    named = _named(sizes.where(F.col("_n") > whole))
    own = many.select(*keys, "k", "re", "im").join(G._renamed(named, keys), G._same(keys, F.lit(True)))
    # the series is real: the sums' conjugates at n - k, and none at the ends; transformed forth, conjugates give the series back
    k, n = F.col("k"), F.col("_n")
    alone = (k == 0) | (2 * k == n)
    re, im = (F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in ("re", "im"))
    here = F.struct(k.cast("long").alias("p"), re.alias("re"), F.when(alone, 0.0).otherwise(-im).alias("im"))
    there = F.struct((n - k).cast("long").alias("p"), re.alias("re"), im.alias("im"))
    placed = own.select("_s", "_n", F.explode(F.when(alone, F.array(here)).otherwise(F.array(here, there))).alias("_e")).select("_s", "_n", F.col("_e.p").alias("_p"), F.col("_e.re").alias("_re"), F.col("_e.im").alias("_im"))
    back = _sums(placed, False, block).join(named.select("_s", *keys), "_s")
    x = F.col("_re") / F.col("_n")
    return short.unionByName(back.select(*keys, F.col("_k").alias("i"), F.when(~F.isnan(x), x).alias(value)))
