"""Shards of nearly equal size, by minimax contiguous partition (operator 6)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Texts are ordered by hash; so many equal ranges of hashes are the atomic groups. Equal texts share a hash, so no cut parts them.
CELLS = 1 << 16


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity with which `shards` contiguous runs of `sizes` suffice: binary search, each guess tried greedily."""
    sums = np.cumsum(sizes)
    total = int(sums[-1]) if len(sums) else 0
    low, high = max(int(sizes.max(initial=0)), -(-total // shards)), total
    while low < high:
        guess = (low + high) // 2
        if len(cuts(sums, guess, shards)) <= shards:
            high = guess
        else:
            low = guess + 1
    return low


def cuts(sums: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Greedy ends (exclusive) of runs of at most `capacity` over prefix sums; stops one beyond `shards`."""
    ends, at = [], 0
    while at < len(sums) and len(ends) <= shards:
        before = int(sums[at - 1]) if at else 0
        at = int(np.searchsorted(sums, before + capacity, "right"))
        ends.append(at)
    return ends


def even_cuts(sums: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """Ends of the shards: each as near to an even share of what is left as the capacity allows, here and in the shards to come."""
    n, total = len(sums), int(sums[-1])
    sums = np.append(0, sums)
    need = [n]  # from where on the last 0, 1, ... shards can hold the rest
    for _ in range(shards - 1):
        need.append(int(np.searchsorted(sums, sums[need[-1]] - capacity, "left")))
    ends, at = [], 0
    for left in range(shards, 0, -1):
        goal = sums[at] + (total - int(sums[at])) / left
        near = int(np.searchsorted(sums, goal, "left"))
        if near > at and goal - sums[near - 1] < sums[min(near, n)] - goal:
            near -= 1
        most = int(np.searchsorted(sums, sums[at] + capacity, "right")) - 1
        at = max(at, min(max(near, need[left - 1]), most))
        ends.append(at)
    return np.array(ends)


def shard(docs: DataFrame, *carried: str, shards: int = 16, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row, and `row`, a struct of the carried columns, if there are any.

    size: UTF-8 bytes of the text, plus 1 (a null text has none, and crc32 0). Law `bytes`: shards hold runs of atomic
    groups in order of text hash, cut so that the largest shard is as small as whole groups allow; equal texts, repeated
    rows among them, stay together, null and empty texts too. slot numbers the rows of a shard from 0 without gaps.
    grown_shard is null: under this law a new count of shards cuts anew. A null doc_id is a row like any other (it
    comes first among its equals). An empty table gives no rows. Other columns are ignored. Rows equal in doc_id and text
    are numbered in one task.

    Only sums by cell (at most `cells`), and by parts of crowded cells, come to the driver."""
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    cell = F.shiftrightunsigned(hashed, 64 - int(cells).bit_length() + 1).cast("int")
    rows = written(
        docs.select(
            *([F.struct(*carried).alias("row")] if carried else []), "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"), hashed.alias("hash"), cell.alias("cell")
        ),
        "sized",
    )
    spark = docs.sparkSession
    found = {r.cell: (r.size, r.n) for r in rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    order = sorted(found)
    sizes = np.array([found[c][0] for c in order], np.int64)
    sums = np.cumsum(sizes)
    ends = even_cuts(sums, smallest_capacity(sizes, shards), shards) if order else np.zeros(0, int)
    shard_of = np.searchsorted(ends, np.arange(len(order)), "right")

    # Crowded cells (a hot text) are numbered in parts: so many that a part has about as many rows as a usual cell, at most `cells` more in all.
    usual = max(1000, -(-sum(n for _, n in found.values()) // cells) * 4)
    parts = {c: -(-found[c][1] // usual) for c in order if found[c][1] > usual}
    part_counts: dict[tuple[int, int], int] = {}
    split = spark.createDataFrame([(c, k) for c, k in parts.items()] or [(-1, 1)], "cell int, parts int")
    parted = rows.join(F.broadcast(split), "cell", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "size", "hash"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    if parts:
        crowded = parted.join(F.broadcast(split), "cell", "left_semi")
        part_counts = {(r.cell, r.part): r.n for r in crowded.groupBy("cell", "part").agg(F.count("*").alias("n")).collect()}
    plan, slot, last = [], 0, -1
    for c, s in zip(order, shard_of.tolist(), strict=True):
        if s != last:
            slot, last = 0, s
        for p in range(parts.get(c, 1)):
            plan.append((c, p, s, slot))
            slot += part_counts.get((c, p), 0) if c in parts else found[c][1]
    table = spark.createDataFrame(plan, "cell int, part int, shard int, base long")
    # Rows alike in every column may take each other's slots; nothing else tells them apart.
    number = F.expr("row_number() OVER (PARTITION BY cell, part ORDER BY hash, doc_id NULLS FIRST, size) - 1")
    placed = parted.join(F.broadcast(table), ["cell", "part"])
    return placed.select(*(["row"] if carried else []), "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + number).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs with all their columns, and size, text_crc32, law, shard, slot and grown_shard, which take the place of columns of
    these names. To write the shards as folders: sharded_rows(docs).write.partitionBy("shard")."""
    own = shard(docs, *docs.columns, **how)
    added = [c for c in own.columns if c not in ("row", "doc_id")]
    return own.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)
