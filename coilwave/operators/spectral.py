"""Complex spectra and transfer functions as DataFrame aggregates. A complex column c is the pair c_re, c_im."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def times(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def divided(a: Pair, b: Pair) -> Pair:
    """a / b; null where b is 0."""
    d = F.nullif(b[0] * b[0] + b[1] * b[1], F.lit(0.0))
    return (a[0] * b[0] + a[1] * b[1]) / d, (a[1] * b[0] - a[0] * b[1]) / d


def pair(name: str) -> Pair:
    return F.col(f"{name}_re"), F.col(f"{name}_im")


def dft_bin(df: DataFrame, keys: list[str], index: str, value: str, turns: float | Column) -> DataFrame:
    """(keys, n, re, im): the sum of value * exp(-2 pi i * turns * index), turns being cycles a sample."""
    angle = 2 * math.pi * F.col(index) * turns
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(F.col(value) * F.cos(angle)).alias("re"), (-F.sum(F.col(value) * F.sin(angle))).alias("im"))


def sinusoid(re: Column, im: Column, turns: float, n: int, scale: float | None = None) -> Column:
    """The n samples of the sinusoid with this coefficient, times scale (2/n)."""
    k = 2.0 / n if scale is None else scale
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(k) * (re * F.cos(2 * math.pi * turns * i) - im * F.sin(2 * math.pi * turns * i)))


def hat(n: int, mode: str = "center") -> Column:
    """A triangular taper of n samples that rises and falls; left or right: only one side of it."""
    half = (n + 1) / 2
    i = F.sequence(F.lit(1), F.lit(n))
    rise, fall = (lambda x: x / F.lit(half)), (lambda x: (F.lit(n + 1.0) - x) / F.lit(half))
    shape = {"center": lambda x: F.least(rise(x), fall(x)), "right": lambda x: F.when(x <= half, F.lit(1.0)).otherwise(fall(x)), "left": lambda x: F.when(x >= half, F.lit(1.0)).otherwise(rise(x))}[mode]
    return F.transform(i, lambda x: shape(x.cast("double")))


def _tukey(place: Column, width: int | Column, edge: int = 10) -> Column:
    """Flat but for `edge` samples that rise and as many that fall, as a cosine."""
    near = F.least(place, width - place)
    return F.when(near < edge, 0.5 - 0.5 * F.cos(math.pi * near / edge)).otherwise(1.0)


#: Tapers by name: the weight of a place (from 0) in a window of so many samples; the window after the last place begins anew. Add your own.
TAPERS: dict[str, Callable[[Column, int | Column], Column]] = {
    "none": lambda place, width: F.lit(1.0),
    "hann": lambda place, width: 0.5 - 0.5 * F.cos(2 * math.pi * place / width),
    "hamming": lambda place, width: 0.54 - 0.46 * F.cos(2 * math.pi * place / width),
    "blackman": lambda place, width: 0.42 - 0.5 * F.cos(2 * math.pi * place / width) + 0.08 * F.cos(4 * math.pi * place / width),
    "tukey_ten_sample_taper": _tukey,
}
#: By how many samples a window of whole cycles is longer with a taper.
LONGER = {"tukey_ten_sample_taper": 10}


def longer(taper: str) -> int:
    return LONGER.get(taper, 0)


def taper_table(spark: SparkSession, shape: str, width: int) -> DataFrame:
    """(place, weight) of a taper."""
    return spark.range(width).select(F.col("id").alias("place"), TAPERS[shape](F.col("id").cast("double"), width).alias("weight"))


def windowed_bins(df: DataFrame, keys: list[str], index: str, value: str, width: int, hop: int, bins: list[float], taper: str = "hann", named: list[int] | None = None) -> DataFrame:
    """(keys, win, bin, re, im) of each full window of `width` samples that begins at a multiple of `hop`: the tapered sum of
    value * exp(-2 pi i * bin * place / width), by the taper's sum. Only the wanted bins are computed, which need not be whole (`named`: what to call
    them). A sample meets only the windows that hold it (width / hop of them, rounded up), and the weight of its place; taper names one of TAPERS."""
    i = F.col(index)
    first = F.greatest(F.lit(0), F.ceil((i - width + 1) / hop)).cast("long")
    last = F.floor(i / hop).cast("long")
    windows = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    long = df.select(*keys, i.alias("_i"), F.col(value).alias("_v"), F.explode(windows).alias("win")).withColumn("_p", F.col("_i") - F.col("win") * hop)
    long = long.withColumn("_w", TAPERS[taper](F.col("_p"), width))
    aggs = [F.sum("_w").alias("_t")]
    for k, b in enumerate(bins):
        angle = 2 * math.pi * b * F.col("_p") / width
        aggs += [F.sum(F.col("_v") * F.col("_w") * F.cos(angle)).alias(f"re{k}"), (-F.sum(F.col("_v") * F.col("_w") * F.sin(angle))).alias(f"im{k}")]
    wide = long.groupBy(*keys, "win").agg(F.count("_v").alias("_n"), *aggs).where(F.col("_n") == width)
    stacked = ", ".join(f"{b}, re{k} / _t, im{k} / _t" for k, b in enumerate(bins if named is None else named))
    return wide.select(*keys, "win", F.expr(f"stack({len(bins)}, {stacked}) as (bin, re, im)"))


def harmonic_bins(df: DataFrame, keys: list[str], index: str, value: str, cycle: str, width: str, hop: str, harmonics: tuple[int, ...], taper: str = "hann") -> DataFrame:
    """(keys, win, harmonic, re, im): windowed_bins() at multiples of the frequency of a cycle, where cycle, width and hop are columns, each the same for all
    samples of a series and among the keys. So series of any rates and frequencies go in one plan."""
    i = F.col(index)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((i - F.col(width) + 1) / F.col(hop)))
    last = F.floor(i / F.col(hop))
    windows = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    long = df.select(*keys, i.alias("_i"), F.col(value).alias("_v"), F.explode(windows).alias("win")).withColumn("_p", F.col("_i") - F.col("win") * F.col(hop))
    long = long.withColumn("_w", TAPERS[taper](F.col("_p"), F.col(width)))
    sums = [F.sum("_w").alias("_t")]
    for h in harmonics:
        angle = 2 * math.pi * h * F.col("_p") / F.col(cycle)
        sums += [F.sum(F.col("_v") * F.col("_w") * F.cos(angle)).alias(f"re{h}"), (-F.sum(F.col("_v") * F.col("_w") * F.sin(angle))).alias(f"im{h}")]
    wide = long.groupBy(*keys, "win").agg(F.count("_v").alias("_n"), *sums).where(F.col("_n") == F.col(width))
    each = F.array(*[F.struct(F.lit(h).alias("harmonic"), (F.col(f"re{h}") / F.col("_t")).alias("re"), (F.col(f"im{h}") / F.col("_t")).alias("im")) for h in harmonics])
    return wide.select(*keys, "win", F.inline(each))


def least_squares(pairs: DataFrame, keys: list[str], tx: str = "t", rx: str = "r") -> DataFrame:
    """(keys, n, re, im, v): H = sum conj(T) R / sum |T|^2 and its variance from the residuals, in a second pass so that nothing cancels."""
    (tr, ti), (rr, ri) = pair(tx), pair(rx)
    power = F.sum(tr * tr + ti * ti)
    h = pairs.groupBy(*keys).agg(F.count("*").alias("n"), power.alias("_p"), F.sum(tr * rr + ti * ri).alias("_a"), F.sum(tr * ri - ti * rr).alias("_b"))
    h = h.withColumns({"re": F.try_divide("_a", "_p"), "im": F.try_divide("_b", "_p")}).drop("_a", "_b")
    p = times((tr, ti), (F.col("re"), F.col("im")))
    rest = F.sum((rr - p[0]) ** 2 + (ri - p[1]) ** 2)
    both = pairs.join(h, keys).groupBy(*keys, "n", "re", "im", "_p").agg(rest.alias("_r"))
    return both.select(*keys, "n", "re", "im", F.try_divide(F.try_divide("_r", F.col("_p")), 2.0 * F.col("n") - 2).alias("v"))


def least_squares_cov(pairs: DataFrame, keys: list[str], tx: str = "t", rx: str = "r") -> DataFrame:
    """(keys, n, re, im, c_rr, c_ri, c_ii): H, and the covariance of its real and imaginary part that follows from the sample
    covariance of the residuals."""
    (tr, ti), (rr, ri) = pair(tx), pair(rx)
    h = least_squares(pairs, keys, tx, rx).drop("v")
    p = times((tr, ti), (F.col("re"), F.col("im")))
    own = pairs.join(h, keys).withColumns({"_x": rr - p[0], "_y": ri - p[1]})
    s = own.groupBy(*keys, "n", "re", "im").agg(F.var_samp("_x").alias("xx"), F.covar_samp("_x", "_y").alias("xy"), F.var_samp("_y").alias("yy"), F.sum(tr * tr + ti * ti).alias("p"), F.sum(tr * tr).alias("a"), F.sum(tr * ti).alias("b"), F.sum(ti * ti).alias("c"))
    # H - H0 = sum conj(T) (x + iy) / p: its parts are sum(tr x + ti y) / p and sum(tr y - ti x) / p
    q = F.nullif(F.col("p") * F.col("p"), F.lit(0.0))
    return s.select(
        *keys, "n", "re", "im",
        ((F.col("a") * F.col("xx") + 2 * F.col("b") * F.col("xy") + F.col("c") * F.col("yy")) / q).alias("c_rr"),
        ((F.col("a") * F.col("xy") - F.col("b") * F.col("xx") + F.col("b") * F.col("yy") - F.col("c") * F.col("xy")) / q).alias("c_ri"),
        ((F.col("a") * F.col("yy") - 2 * F.col("b") * F.col("xy") + F.col("c") * F.col("xx")) / q).alias("c_ii"),
    )


def mean_cov(df: DataFrame, keys: list[str], c: str = "h") -> DataFrame:
    """(keys, n, re, im, c_rr, c_ri, c_ii): mean of complex values, and the sample covariance of their parts."""
    re, im = pair(c)
    return df.groupBy(*keys).agg(F.count(re).alias("n"), F.avg(re).alias("re"), F.avg(im).alias("im"), F.var_samp(re).alias("c_rr"), F.covar_samp(re, im).alias("c_ri"), F.var_samp(im).alias("c_ii"))


def huber_weight(r: Column, r0: float = 1.5) -> Column:
    return F.when(F.abs(r) <= r0, F.lit(1.0)).otherwise(F.lit(r0) / F.abs(r))


def huber_loss(r: Column, r0: float = 1.5) -> Column:
    return F.when(F.abs(r) < r0, r * r / 2).otherwise(r0 * F.abs(r) - r0 * r0 / 2)


def postdarkened(c: Pair, turns: Column | float) -> Pair:
    """Undoes prewhitening of a coefficient at `turns` cycles a sample: c / (exp(2 pi i turns) - 1)."""
    angle = 2 * math.pi * (turns if isinstance(turns, Column) else F.lit(turns))
    return divided(c, (F.cos(angle) - 1, F.sin(angle)))
