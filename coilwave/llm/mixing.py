"""Mixing sources to target weights, by subset sums over exact document lengths (operator 2)."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: The dynamic programme fills what is left of a budget up to this many words; more than that is first filled length by length.
WINDOW = 1 << 16
#: Rows of one source and length that are ranked together, about.
RANKED = 1000


def targets(sizes: list[int], weights: list[int], share: Fraction, most: int) -> list[Fraction]:
    """Shares the budget (share * all sizes) by weight; a target stops at most * its source's size, the excess is shared
    anew by weight among the others until none is above. Sources without words get nothing."""
    left = share * sum(sizes)
    out = [Fraction(0)] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s]
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > whole * most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to the budget from below as they can.

    First the same share of every length, and the longest while they fit, until at most WINDOW words are left. Then a
    bounded knapsack: reach[s] tells whether s more words can be made up from the documents left (each count in powers of two),
    and from which step; the largest reachable sum is traced back."""
    take = np.zeros(len(lengths), np.int64)
    total = int(lengths @ counts)
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not len(lengths):
        return take
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int(lengths @ take)
    for i in np.argsort(-lengths, kind="stable").tolist():
        if left <= WINDOW:
            break
        more = int(min(counts[i] - take[i], (left - WINDOW) // lengths[i] + 1, left // lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    left_over = min(left, WINDOW)
    step = np.full(left_over + 1, -2, np.int64)
    step[0] = -1
    steps: list[tuple[int, int]] = []
    for i in range(len(lengths)):
        if lengths[i] > left_over:
            continue
        spare, q = int(min(counts[i] - take[i], left_over // lengths[i])), 1
        while spare > 0 and step[left_over] == -2:
            q = min(q, spare)
            by = q * int(lengths[i])
            if by <= left_over:
                fresh = np.flatnonzero((step[by:] == -2) & (step[: left_over + 1 - by] != -2)) + by
                step[fresh] = len(steps)
                steps.append((i, q))
            spare -= q
            q *= 2
        if step[left_over] != -2:
            break
    s = int(np.flatnonzero(step != -2)[-1])
    while s:
        i, q = steps[step[s]]
        take[i] += q
        s -= q * int(lengths[i])
    return take


def _fill_source(group: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram of lengths, with its budget for the last, partial round: filled from below, or from above by
    what to leave out, whichever comes nearer."""
    group = group.sort_values("size", kind="stable")
    sizes, counts, budget = group["size"].to_numpy(), group["n"].to_numpy(), int(group["budget"].iloc[0])
    below, above = fill(sizes, counts, budget), counts - fill(sizes, counts, int(sizes @ counts) - budget)
    group["n_take"] = above if int(sizes @ above) - budget < budget - int(sizes @ below) else below
    return group[["source_key", "size", "n", "n_take"]]


def mix(docs: DataFrame, *carried: str, weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 13) -> DataFrame:
    """(row, size, source_size, target, times): `carried` columns as a struct, the words of the text and of its source, the
    source's target, and how often the mix takes the row.

    Words are [^\\x20\\x09-\\x0D]+ (a null or empty text has none, and is taken as often as its source is taken whole). Sources stand
    in code point order, null last, and weigh `weights`, repeating; they share `share` of all words, see targets(). Every row
    is taken as often as the target holds its whole source; what is left of the target is a subset of rows whose words fill
    it, exactly if possible: fill() says how many of each length, a seeded hash of doc_id and text which. Of rows equal in
    both, as many as are wanted are taken, whichever they are. No row is taken more than `most` times. Reruns agree. An
    empty table gives no rows.

    Of each source, only sums come to the driver; its histogram has a row for each length that occurs, not for each document."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    source_key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    own = docs.select(F.struct(*[F.col(c) for c in carried]).alias("row"), source_key.alias("source_key"), size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("order"))
    small = written(own.select("source_key", "size", "order"), "sizes")
    sources = sorted((r.source_key, int(r.words)) for r in small.groupBy("source_key").agg(F.sum("size").alias("words")).collect())
    goal = targets([s for _, s in sources], [weights[i % len(weights)] for i in range(len(sources))], share, most)
    plan = []
    for (key, s), t in zip(sources, goal, strict=True):
        whole = int(t // s) if s else 0
        plan.append((key, s, float(t), whole, round(t - whole * s) if whole < most else 0))
    by_source = spark.createDataFrame(plan, "source_key string, source_size long, target double, whole int, budget long")
    histogram = small.where("size > 0").groupBy("source_key", "size").agg(F.count("*").alias("n"))
    histogram = histogram.join(F.broadcast(by_source.select("source_key", "budget")), "source_key")
    filled = written(histogram.groupBy("source_key").applyInPandas(_fill_source, "source_key string, size long, n long, n_take long"), "filled")

    # Of a length taken in part, the rows of least hash are taken. Ranges of hashes are counted, and only the hashes of the range
    # that the last row falls in are ranked; equal hashes are one, with its number of rows.
    keys = ["source_key", "size"]
    parts = F.ceil(F.col("n") / RANKED)
    part = F.least(F.floor((F.col("order").cast("double") / 2.0**64 + 0.5) * parts), parts - 1)
    ranged = small.join(filled.where("0 < n_take and n_take < n"), keys).withColumn("part", part)
    counts = ranged.groupBy(*keys, "part").agg(F.count("*").alias("c"), F.first("n_take").alias("n_take"))
    before = F.expr("sum(c) OVER (PARTITION BY source_key, size ORDER BY part) - c")
    cut = counts.withColumn("before", before).where("before < n_take and before + c >= n_take").select(*keys, "part", (F.col("n_take") - F.col("before")).alias("want"))
    ranked = ranged.join(cut, [*keys, "part"]).groupBy(*keys, "part", "order").agg(F.count("*").alias("c"), F.first("want").alias("want"))
    ranked = ranked.withColumn("before", F.expr("sum(c) OVER (PARTITION BY source_key, size, part ORDER BY order) - c"))
    last = ranked.where("before < want and before + c >= want").select(*keys, F.col("order").alias("last"), F.when(F.col("before") + F.col("c") > F.col("want"), F.col("want") - F.col("before")).alias("tied"))
    whole_length = filled.where("n_take = n").select(*keys, F.lit((1 << 63) - 1).cast("long").alias("last"), F.lit(None).cast("long").alias("tied"))
    rule = written(last.unionByName(whole_length), "rule")

    decided = own.join(F.broadcast(by_source.drop("budget")), "source_key").join(rule, keys, "left")
    out = lambda df, more: df.select("row", "size", "source_size", "target", (F.col("whole") + more).alias("times"))
    taken = F.when(F.col("order") <= F.col("last"), 1).otherwise(0)
    if rule.where("tied is not null").isEmpty():
        return out(decided, taken)
    # Of these equal rows only some are taken: they are written with the partition they came in and numbered partition by partition.
    at_last = F.coalesce(F.col("tied").isNotNull() & (F.col("order") == F.col("last")), F.lit(False))
    equal = written(decided.where(at_last).withColumn("came", F.spark_partition_id()), "equal")
    counts = equal.groupBy(*keys, "came").agg(F.count("*").alias("c")).withColumn("before", F.expr("sum(c) OVER (PARTITION BY source_key, size ORDER BY came) - c"))
    numbered = equal.withColumn("k", F.expr("row_number() OVER (PARTITION BY source_key, size, came ORDER BY order)")).join(counts, [*keys, "came"])
    return out(decided.where(~at_last), taken).unionByName(out(numbered, F.when(F.col("before") + F.col("k") <= F.col("tied"), 1).otherwise(0)))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row as often as the mix takes it, with all columns of docs."""
    mixed = mix(docs, *docs.columns, **how)
    return mixed.select(F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*")
