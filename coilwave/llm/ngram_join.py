"""Documents that share most of their n-grams, by a blocked sparse product of the incidence matrix (operator 4).

Rows of the matrix are distinct sets of shingles (copies with equal sets are one row), columns are shingles. A pair of
rows can link only if it shares one of the first columns of both, in an order that puts rare columns first; how many
columns are first follows from the size. So (1) columns are counted over all documents, (2) each row's first columns
are dealt to the tasks by column, where rows that meet form lists, (3) pairs from the lists that pass the bounds on
size and place are multiplied out over the whole rows, in blocks of columns, and dropped as soon as the overlap
counted so far and what is left cannot reach the bound. Pairs inside one component need no product to find the
component: of long lists only a pair a row is tried first, and then only pairs between components that are still
apart. (4) For the links themselves, all rows of a component are multiplied out with each other, in blocks of rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .components import components
from .shared import NULL_KEYS, keyed, written

Batches = Iterator[pa.RecordBatch]
U = np.uint64

#: Counts are kept by the first 24 bits of a shingle's hash (so the table has one size, whatever the corpus), apart by 8 more bits.
CELL_BITS = 24
#: log2 of the buckets that are counted in tasks of their own: more for larger tables, so that one has this much text on average.
BUCKET_BITS, BUCKET_BYTES = (8, 16), 256 << 20
#: Shingles of a task that are counted together.
COUNTED = 4_000_000
#: Counts below 2 ** 4 all rank first.
LEAST_LEVEL = 4
#: A column met more often than 2 ** SPLIT_LEVEL is dealt to several tasks.
SPLIT_LEVEL = 12
#: A list of at most SHORT rows, or with at most PAIRS_A_ROW pairs a row, is worked off at once; another one first gets one partner a row.
SHORT = 16
PAIRS_A_ROW = 4
#: Rows of a list that one task multiplies with as many others in the last round.
BLOCK_ROWS = 512
COLUMN_BLOCKS = 8
#: A row's profile counts its columns in so many blocks.
PROFILE = 128

COUNT = pa.schema([("bucket", pa.int32()), ("cells", pa.binary()), ("n", pa.int32())])
#: kind 0: a row in a column's list; 1: a document and its row; 2: a pair (a, b) = (gram, row).
LIST = pa.schema([("kind", pa.int32()), ("gram", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("key", pa.int64())])
LIST_DDL = "kind int, gram long, row long, n int, pos int, key long"
SET = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("profile", pa.binary()), ("grams", pa.binary())])


def shingle_sets(part_data: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    data = B.LOWER[part_data]
    start, end, first = B.words(data, at, B.BLANKS)
    word = B.span_hashes(B.prefix_hashes(data), start, end)
    gram = B.gram_hashes(word, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(gram[a : b - width + 1])
        else:
            yield B.gram_hashes(word[a:b], b - a) if b > a else word[:0]


def row_id(grams: np.ndarray) -> int:
    """Names a set: equal sets have equal ids."""
    both = np.array([np.add.reduce(B.mix(grams)), np.bitwise_xor.reduce(grams * U(3)), len(grams)], np.uint64)
    return int(B.signed(B.gram_hashes(both, 3))[0])


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How much sets of these sizes must share so that 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _counts(width: int, bits: int) -> Callable[[Batches], Batches]:
    """Sorted hashes (32 bits) of the shingles of distinct sets, by bucket; steps between them, byte planes apart, compress well."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        own = np.sort(np.concatenate(held))
        cut = np.searchsorted(own, np.arange((1 << bits) + 1, dtype=np.uint64) << U(32 - bits))
        blobs = [np.diff(own[a:b], prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(1 << bits, dtype=np.int32)), pa.array([zlib.compress(x, 1) for x in blobs], pa.binary()), pa.array(np.diff(cut).astype(np.int32))], schema=COUNT)

    def run(batches: Batches) -> Batches:
        held, size, seen = [], 0, set()
        for batch in batches:
            for _, data, at in B.chunks(batch):
                for grams in shingle_sets(data, at, width):
                    if len(grams) and (r := row_id(grams)) not in seen:
                        seen.add(r)
                        held.append(grams >> U(32))
                        size += len(grams)
                if size >= COUNTED:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _levels(bits: int) -> Callable[[Batches], Batches]:
    """Each bucket's part of the table of levels: log2 of the largest count among a cell's hashes. A bucket's blobs are all here."""

    def run(batches: Batches) -> Batches:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, cells, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "cells", "n")), strict=True):
                steps = np.frombuffer(zlib.decompress(cells), np.uint8).reshape(4, n).T.copy().view("<u4")[:, 0]
                value, count = np.unique(np.cumsum(steps, dtype=np.uint64), return_counts=True)
                parts.setdefault(b, []).append(np.stack([value, count.astype(np.uint64)]))
                if len(parts[b]) == 16:
                    parts[b] = [_summed(parts[b])]
        for b, held in parts.items():
            value, count = _summed(held)
            often = count >= U(1 << LEAST_LEVEL)
            level = np.zeros(1 << (CELL_BITS - bits), np.uint8)
            np.maximum.at(level, ((value[often] >> U(32 - CELL_BITS)) & U(len(level) - 1)).astype(np.int64), np.log2(count[often].astype(float)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(level.tobytes())], pa.binary())], ["bucket", "level"])

    return run


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate(parts, axis=1)
    value, at = np.unique(both[0], return_inverse=True)
    return np.stack([value, np.bincount(at, both[1].astype(float), len(value)).astype(np.uint64)])


def column_levels(docs: DataFrame, width: int) -> np.ndarray:
    """How common each cell of shingles is: one byte for each of 2 ** CELL_BITS cells, whatever the size of the corpus."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least, most = BUCKET_BITS
    bits = min(most, max(least, int(total // BUCKET_BYTES).bit_length()))
    counted = docs.select("text").mapInArrow(_counts(width, bits), "bucket int, cells binary, n int")
    table = np.zeros((1 << bits, 1 << (CELL_BITS - bits)), np.uint8)
    for r in counted.repartition("bucket").mapInArrow(_levels(bits), "bucket int, level binary").collect():
        table[r.bucket] = np.frombuffer(zlib.decompress(bytes(r.level)), np.uint8)
    return table.reshape(-1)


def _first_columns(width: int, percent: int, levels: Broadcast) -> Callable[[Batches], Batches]:
    """Each document with its row; and, once a row and task, the row's first columns: so many that any linked row has one of them among its own."""

    def run(batches: Batches) -> Batches:
        seen: set[int] = set()
        for batch in batches:
            for part, data, at in B.chunks(batch):
                keys = part.column("key").to_numpy()
                rows, sizes, columns, of, place = [], [], [], [], []
                for t, grams in enumerate(shingle_sets(data, at, width)):
                    n = len(grams)
                    r = row_id(grams) if n else None
                    rows.append(r)
                    sizes.append(n)
                    if n and r not in seen:
                        seen.add(r)
                        level = levels.value[(grams >> U(64 - CELL_BITS)).astype(np.int64)]
                        k = n + percent * -n // 100 + 1
                        columns.append(grams[np.argsort(level, kind="stable")[:k]])
                        of.append(np.full(k, t))
                        place.append(np.arange(k, dtype=np.int32))
                n = np.array(sizes, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int32)), pa.array(keys), pa.array(rows, pa.int64()), pa.array(n), pa.array(np.zeros(len(n), np.int32)), pa.array(keys)], schema=LIST)
                if columns:
                    t = np.concatenate(of)
                    row = np.array([x or 0 for x in rows], np.int64)[t]
                    gram = np.concatenate(columns)
                    level = levels.value[(gram >> U(64 - CELL_BITS)).astype(np.int64)].astype(np.int64)
                    # where a very common column is dealt to: one of several tasks, by row
                    split = np.where(level > SPLIT_LEVEL, 1 + (B.mix(row.view(np.uint64)) % (U(1) << np.maximum(level - SPLIT_LEVEL, 0).astype(np.uint64))).astype(np.int64), 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(t), np.int32)), pa.array(B.signed(gram)), pa.array(row), pa.array(n[t]), pa.array(np.concatenate(place)), pa.array(split)], schema=LIST)

    return run


def _star(row: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """A partner for each row of a list (sorted by size): one from the middle of the rows of nearly its size."""
    pairs, i = [], 0
    while i < len(row):
        j = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
        c = (i + j) // 2
        own = row[i:j][row[i:j] != row[c]]
        pairs.append(np.stack([np.full(len(own), row[c]), own], axis=1))
        i = j
    return np.concatenate(pairs)


def _lists(percent: int) -> Callable[[Batches], Batches]:
    """Lists of the columns that several rows have, and the first pairs to try. All entries of a column (and split) are in one partition."""

    def run(batches: Batches) -> Batches:
        held = []
        for batch in batches:
            doc = batch.column("kind").to_numpy() == 1
            if doc.any():
                yield batch.filter(pa.array(doc))
            if not doc.all():
                entries = batch.filter(pa.array(~doc))  # without the nulls of documents that have no row
                held.append([entries.column(c).to_numpy() for c in ("gram", "row", "n", "pos", "key")])
        if not held:
            return
        gram, row, n, pos, split = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((row, n, split, gram))
        gram, row, n, pos, split = (x[order] for x in (gram, row, n, pos, split))
        own = np.append(True, (np.diff(gram) != 0) | (np.diff(row) != 0) | (np.diff(split) != 0))
        gram, row, n, pos, split = (x[own] for x in (gram, row, n, pos, split))
        head = np.flatnonzero(np.append(True, (np.diff(gram) != 0) | (np.diff(split) != 0)))
        size = np.diff(np.append(head, len(gram)))
        # Short lists are worked off here: every pair within bounds is tried.
        short = np.repeat((size > 1) & (size <= SHORT) & (split[head] == 0), size)
        g, r, m, p = (x[short] for x in (gram, row, n, pos))
        pairs = []
        for d in range(1, SHORT):
            i = np.flatnonzero(g[d:] == g[:-d])
            if not len(i):
                break
            i = i[_may_link(m[i], m[i + d], p[i], p[i + d], percent)]
            pairs.append(np.stack([r[i], r[i + d]], axis=1))
        # Longer ones too if few pairs are within bounds; else a partner a row is tried now, and the rest once components are known.
        for h, k, part in zip(head.tolist(), size.tolist(), split[head].tolist(), strict=True):
            if k > SHORT or part:
                e = h + k
                found = _within(row[h:e], n[h:e], pos[h:e], percent) if k <= BLOCK_ROWS and not part else None
                if found is None:
                    found = _star(row[h:e], n[h:e], percent)
                    yield _entries(0, gram[h:e], row[h:e], n[h:e], pos[h:e])
                pairs.append(found)
        pair = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        pair = np.unique(np.sort(pair, axis=1), axis=0)
        yield _entries(2, pair[:, 0], pair[:, 1], np.zeros(len(pair)), np.zeros(len(pair)))

    return run


def _may_link(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows of sizes n and m can link if the column at places i and j is the first that they share. (A linked pair
    passes in the list of its first shared column, so it is enough to judge each list as if it were that one.)"""
    n, m = n.astype(np.int64), m.astype(np.int64)
    return np.minimum(n - i, m - j) >= least_overlap(n, m, percent)


def _within(row: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray | None:
    """The pairs of a list that are within bounds, unless there are more than PAIRS_A_ROW for each row."""
    i, j = np.nonzero(np.triu(_may_link(n[:, None], n[None], pos[:, None], pos[None], percent), 1))
    return np.stack([row[i], row[j]], axis=1) if len(i) <= PAIRS_A_ROW * len(row) else None


def _entries(kind: int, gram: np.ndarray, row: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), kind, np.int32)), pa.array(gram), pa.array(row), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.nulls(len(gram), pa.int64())], schema=LIST)


def profile(grams: np.ndarray) -> bytes:
    return np.minimum(np.bincount((grams >> U(57)).astype(np.int64), minlength=PROFILE), 255).astype(np.uint8).tobytes()


def _profiles(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, PROFILE).astype(np.int16)


def _alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether profiles allow a link: what blocks of columns have more of on one side cannot be shared."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    return np.abs(x - y).sum(axis=-1) <= n + m - 2 * least_overlap(n, m, percent)


def _plausible(percent: int) -> Callable[[Batches], Batches]:
    """The pairs (a, b) whose profiles allow a link."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ok = _alike(_profiles(batch.column("profile")), _profiles(batch.column("profile_b")), batch.column("n").to_numpy(), batch.column("n_b").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _sets(width: int) -> Callable[[Batches], Batches]:
    """(row, n, profile, grams) of documents (wanted, text) whose set is the wanted row."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part, data, at in B.chunks(batch):
                wanted = part.column("wanted").to_pylist()
                found = [(r, len(g), profile(g), g.tobytes()) for r, g in zip(wanted, shingle_sets(data, at, width), strict=True) if len(g) and row_id(g) == r]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), SET, strict=True)], schema=SET)

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Overlap of left[i] and right[i] (sorted sets), or -1 where it is below need[i].

    The products of all pairs are taken one block of columns after another; a pair is dropped as soon as the overlap
    so far and the smaller rest cannot reach what it needs."""
    edges = (np.arange(COLUMN_BLOCKS + 1, dtype=np.float64) * (2.0**64 / COLUMN_BLOCKS))[1:-1].astype(np.uint64)
    cut_l = np.array([[0, *np.searchsorted(x, edges), len(x)] for x in left])
    cut_r = np.array([[0, *np.searchsorted(x, edges), len(x)] for x in right])
    total = np.zeros(len(left), np.int64)
    live = np.arange(len(left))
    for k in range(COLUMN_BLOCKS):
        if not len(live):
            break
        parts = [x for i in live for x in (left[i][cut_l[i, k] : cut_l[i, k + 1]], right[i][cut_r[i, k] : cut_r[i, k + 1]])]
        gram = np.concatenate(parts)
        pair = np.repeat(np.repeat(np.arange(len(live)), 2), [len(x) for x in parts])
        order = np.lexsort((gram, pair))
        gram, pair = gram[order], pair[order]
        same = (gram[1:] == gram[:-1]) & (pair[1:] == pair[:-1])
        total[live] += np.bincount(pair[1:][same], minlength=len(live))
        rest = np.minimum(cut_l[live, -1] - cut_l[live, k + 1], cut_r[live, -1] - cut_r[live, k + 1])
        live = live[total[live] + rest >= need[live]]
    out = np.full(len(left), -1, np.int64)
    out[live] = total[live]
    return out


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(percent: int) -> Callable[[Batches], Batches]:
    """The pairs that link, from entries (a, b, row, grams) sorted by pair."""

    def product(held: list[tuple]) -> pa.RecordBatch:
        left, right = ([np.frombuffer(x[k], np.uint64) for x in held] for k in (2, 3))
        size = np.array([[len(x), len(y)] for x, y in zip(left, right, strict=True)])
        ok = overlaps(left, right, least_overlap(size[:, 0], size[:, 1], percent)) >= 0
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x, o in zip(held, ok, strict=True) if o], pa.int64()) for k in (0, 1)], schema=PAIR)

    def run(batches: Batches) -> Batches:
        last, held, size = None, [], 0
        for batch in batches:
            for a, b, row, grams in zip(*(batch.column(c) for c in ("a", "b", "row", "grams")), strict=True):
                a, b, row = a.as_py(), b.as_py(), row.as_py()
                if last and last[:2] == (a, b) and last[2] != row:
                    held.append((a, b, last[3], grams.as_buffer()))
                    size += len(last[3]) + len(held[-1][3])
                    last = None
                    if size > 16 << 20:
                        yield product(held)
                        held, size = [], 0
                elif not (last and last[:3] == (a, b, row)):
                    last = (a, b, row, grams.as_buffer())
        if held:
            yield product(held)

    return run


def _multiplied(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b): first by profiles, then by whole sets, which join rows to pairs one side at a time."""
    short = sets.select("row", "n", "profile").dropDuplicates(["row"])
    left = pairs.join(short.withColumnRenamed("row", "a"), "a")
    right = short.select(F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("profile").alias("profile_b"))
    pairs = left.join(right, "b").mapInArrow(_plausible(percent), "a long, b long")
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("row"))
    both = ends.join(sets.select("row", "grams"), "row").repartition("a", "b").sortWithinPartitions("a", "b", "row")
    return both.mapInArrow(_linked(percent), "a long, b long")


def _apart(percent: int) -> Callable[[Batches], Batches]:
    """Pairs of different components from blocks of entries (gram, cell, block, other, side, guest, strange, row, label, n, pos, profile),
    sorted by block: entries of side 0 or 2 meet those of side 1 or 2, but guests no guests."""

    def one(side: np.ndarray, guest: np.ndarray, strange: np.ndarray, row: np.ndarray, lab: np.ndarray, n: np.ndarray, pos: np.ndarray, prof: np.ndarray) -> np.ndarray:
        x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        pairs = [np.zeros((0, 2), np.int64)]
        for i in x.tolist():
            # two strange rows meet twice, of which one is enough
            hit = y[(lab[y] != lab[i]) & ~(guest[y] & guest[i]) & (~strange[y] | (row[y] > row[i]))]
            hit = hit[_may_link(n[i], n[hit], pos[i], pos[hit], percent)]
            hit = hit[_alike(prof[i], prof[hit], n[i], n[hit], percent)]
            pairs.append(np.stack([np.full(len(hit), row[i]), row[hit]], axis=1))
        return np.concatenate(pairs)

    def run(batches: Batches) -> Batches:
        names = ("gram", "cell", "block", "other", "side", "guest", "strange", "row", "label", "n", "pos")
        rest = None
        for batch in [*batches, None]:
            now = None if batch is None else [*(batch.column(c).to_numpy(zero_copy_only=False) for c in names), _profiles(batch.column("profile"))]
            held = [np.concatenate(c) for c in zip(rest, now, strict=True)] if rest and now else now or rest
            if held is None:
                return
            new = np.append(True, np.any([np.diff(x) != 0 for x in held[:4]], axis=0)) if len(held[0]) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            stop = len(held[0]) if batch is None else int(head[-1]) if len(head) else 0
            rest = [x[stop:] for x in held]
            ends = np.append(head[head < stop], stop)
            found = [one(*(x[s:e] for x in held[4:])) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            if found:
                pair = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], schema=PAIR)

    return run


def _cross_pairs(lists: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs to try between components that a list holds and that are still apart.

    Rows of a list's largest component meet only the strange rows, those of other components; so a large list with few of them
    makes few blocks. A list of over BLOCK_ROWS rows is first cut by size: sizes of linked rows are of the same or neighbouring
    classes, so a row is dealt to the cell of its class, and as a guest to the next one, where guests do not meet each other."""
    named = lists.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
    by_label = named.groupBy("gram", "label").agg(F.count("*").alias("c"))
    mixed = by_label.groupBy("gram").agg(F.max(F.struct("c", "label"))["label"].alias("top"), F.sum("c").alias("m"), F.count("*").alias("k")).where("k > 1").drop("k")
    # a little more than the ratio of linked sizes, so that rounding parts no pair by two classes
    size_class = F.floor(F.log("n") / math.log(max(100 / percent, 1.01) * 1.001)).cast("int")
    own, guest = F.struct(size_class.alias("cell"), F.lit(False).alias("guest")), F.struct((size_class + 1).alias("cell"), F.lit(True).alias("guest"))
    whole = F.array(F.struct(F.lit(0).alias("cell"), F.lit(False).alias("guest")))
    named = named.join(mixed, "gram").withColumn("strange", F.col("label") != F.col("top"))
    celled = named.select("gram", "row", "label", "n", "pos", "strange", F.explode(F.when(F.col("m") > BLOCK_ROWS, F.array(own, guest)).otherwise(whole)).alias("at")).select("gram", "at.*", "row", "label", "n", "pos", "strange")
    sizes = celled.groupBy("gram", "cell").agg(F.count_if("strange").alias("f"), F.count("*").alias("t"), F.count_if(~F.col("guest")).alias("own")).where("f > 0 and own > 0")
    blocks, others = F.ceil(F.col("f") / BLOCK_ROWS).cast("int"), F.ceil(F.col("t") / (8 * BLOCK_ROWS)).cast("int")
    short = sets.select("row", "profile").dropDuplicates(["row"])
    met = celled.join(sizes, ["gram", "cell"]).join(short, "row").withColumns({"_b": blocks, "_o": others})
    met = met.withColumns({"_x": F.pmod(F.xxhash64("row"), "_b").cast("int"), "_y": F.pmod(F.xxhash64("row", F.lit(1)), "_o").cast("int")})
    # as one of all rows it meets every block of strange rows; a strange row also meets, from its block, every block of all rows
    place = lambda i, j, side: F.struct(i.cast("int").alias("block"), j.cast("int").alias("other"), F.lit(side).alias("side"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    as_all = F.transform(every(F.col("_b")), lambda i: place(i, F.col("_y"), 1))
    elsewhere = F.filter(as_all, lambda p: p["block"] != F.col("_x"))
    as_strange = F.transform(F.filter(every(F.col("_o")), lambda j: j != F.col("_y")), lambda j: place(F.col("_x"), j, 0))
    places = F.when(F.col("strange"), F.concat(elsewhere, as_strange, F.array(place(F.col("_x"), F.col("_y"), 2)))).otherwise(as_all)
    block = ["gram", "cell", "block", "other"]
    dealt = met.select("gram", "cell", "guest", "strange", "row", "label", "n", "pos", "profile", F.explode(places).alias("met")).select(*block[:2], "met.*", "guest", "strange", "row", "label", "n", "pos", "profile")
    return dealt.repartition(*block).sortWithinPartitions(*block).mapInArrow(_apart(percent), "a long, b long").distinct()


def _in_blocks(percent: int, as_pairs: bool) -> Callable[[Batches], Batches]:
    """Links between two blocks of a component's rows (side 0 and 1; or in one block, with side 0 alone), from entries (label,
    block, other, side, row, copies, grams) sorted by block: pairs (a, b), or (row, links), where links counts copies."""

    def product(held: list[tuple], alone: bool) -> pa.RecordBatch:
        side, row, copies = (np.array([x[i] for x in held], np.int64) for i in range(3))
        sets = [np.frombuffer(x[3], np.uint64) for x in held]
        n = np.array([len(x) for x in sets])
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not alone and not (len(x) and len(y)):  # a block that the hash left empty
            return pa.RecordBatch.from_pylist([], PAIR if as_pairs else pa.schema([("row", pa.int64()), ("links", pa.int64())]))
        y = x if alone else y
        _, column, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(n)), n)
        # columns that one row has alone are shared by none
        number = np.cumsum(met > 1) - 1
        keep = met[column] > 1
        of, column = of[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        of, column = of[order], column[order]
        shared = np.zeros((len(x), len(y)), np.float32)
        width = int(number[-1]) + 1
        for low in range(0, width, COLUMNS_AT_ONCE):
            a, b = np.searchsorted(column, (low, low + COLUMNS_AT_ONCE))
            part = np.zeros((len(n), min(COLUMNS_AT_ONCE, width - low)), np.float32)
            part[of[a:b], column[a:b] - low] = 1
            shared += part[x] @ part[y].T
        linked = shared >= least_overlap(n[x][:, None], n[y][None], percent)
        if as_pairs:
            i, j = np.nonzero(np.triu(linked, 1) if alone else linked)
            pair = np.sort(np.stack([row[x][i], row[y][j]], axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], schema=PAIR)
        if alone:
            np.fill_diagonal(linked, False)
            ends = [(row[x], linked @ copies[x])]
        else:
            ends = [(row[x], linked @ copies[y]), (row[y], linked.T @ copies[x])]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[i] for e in ends])) for i in (0, 1)], names=["row", "links"])

    def run(batches: Batches) -> Batches:
        last, held = None, []
        for batch in batches:
            place = zip(*(batch.column(c).to_pylist() for c in ("label", "block", "other")), strict=True)
            own = zip(*(batch.column(c).to_pylist() for c in ("side", "row", "copies", "grams")), strict=True)
            for at, entry in zip(place, own, strict=True):
                if at != last and held:
                    yield product(held, last[1] == last[2])
                    held = []
                last = at
                held.append(entry)
        if held:
            yield product(held, last[1] == last[2])

    return run


#: Columns that are dense at a time in a product of two blocks.
COLUMNS_AT_ONCE = 4096


def _links_within(of_row: DataFrame, sets: DataFrame, percent: int, as_pairs: bool) -> DataFrame:
    """All links between rows: they lie within components, so each pair of rows of a component is multiplied out once, in blocks.
    of_row: (row, label, copies)."""
    sizes = of_row.groupBy("label").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    members = of_row.join(sizes, "label").join(sets.select("row", "grams").dropDuplicates(["row"]), "row").withColumn("own", F.pmod(F.xxhash64("row"), blocks).cast("int"))
    # block i meets every block j >= i, as side 0, and every block below i as side 1
    met = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least("own", j).alias("block"), F.greatest("own", j).alias("other"), (F.col("own") > j).cast("int").alias("side")))
    dealt = members.select("label", "row", "copies", "grams", F.explode(met).alias("met")).select("label", "met.*", "row", "copies", "grams")
    both = dealt.repartition("label", "block", "other").sortWithinPartitions("label", "block", "other")
    return both.mapInArrow(_in_blocks(percent, as_pairs), "a long, b long" if as_pairs else "row long, links long")


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row.

    Texts are lower-cased (A-Z) and split into words [^\\x20\\x09-\\x0D]+. A document's set: its distinct shingles of
    `width` words; with fewer words, all of them as one; a null or empty text has none and links with nothing. Two
    documents link if 100 * intersection >= percent * union; component_id is the smallest doc_id that links lead to,
    its own included. Repeated rows and rows of one doc_id are documents like any other. Rows without doc_id link too,
    but count last; component_id is null where no row of the component has one. Other columns are ignored.

    Sets are compared by 64-bit hashes of their shingles. No partner is capped: what the first pairs leave in different
    components is compared with all of the list that is within bounds."""
    documents, of_row, _ = _rows(docs, width, percent)
    return _answer(docs, documents, of_row)


def linked(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """link(), and n_links: with how many other documents (rows) each document links. Copies link; a document without shingles has none."""
    documents, of_row, sets = _rows(docs, width, percent)
    of_row = written(of_row, "rows")
    links = _links_within(of_row, sets, percent, as_pairs=False).groupBy("row").agg(F.sum("links").alias("links"))
    return _answer(docs, documents, of_row.join(links, "row", "left"))


def linked_pairs(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row): each document's class of equal sets (null: no shingles); and (a, b): all pairs of classes that link."""
    documents, of_row, sets = _rows(docs, width, percent)
    own = F.when(F.col("key") < NULL_KEYS, F.col("key")).cast(docs.schema["doc_id"].dataType)
    return documents.select(own.alias("doc_id"), "row"), _links_within(of_row, sets, percent, as_pairs=True)


def _rows(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (key, row, n), rows with their components (row, key, copies, label), and the sets of all rows that may link."""
    source = keyed(docs)
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(column_levels(docs, width))
    dealt = source.select("key", "text").mapInArrow(_first_columns(width, percent, levels), LIST_DDL)
    found = written(dealt.repartition("gram", F.when(F.col("kind") == 0, F.col("key"))).mapInArrow(_lists(percent), LIST_DDL), "lists")
    documents = found.where("kind = 1").select("key", "row", "n")
    lists = found.where("kind = 0").select("gram", "row", "n", "pos")
    pairs = written(found.where("kind = 2").select(F.col("gram").alias("a"), F.col("row").alias("b")).distinct(), "pairs")

    members = pairs.select(F.explode(F.array("a", "b")).alias("row")).unionByName(lists.select("row")).distinct()
    wanted = documents.join(members, "row", "left_semi").groupBy("row").agg(F.min("key").alias("key"))
    texts = source.select("key", "text").join(wanted.withColumnRenamed("row", "wanted"), "key")
    sets = written(texts.select("wanted", "text").mapInArrow(_sets(width), "row long, n int, profile binary, grams binary"), "sets")
    links = written(_multiplied(pairs, sets, percent), "links")
    labels = written(components(links, "a", "b").select(F.col("node").alias("row"), "label"), "labels")
    more = written(_cross_pairs(lists, sets, labels, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = written(_multiplied(more, sets, percent).unionByName(labels.select(F.col("row").alias("a"), F.col("label").alias("b"))), "links")
        labels = components(links, "a", "b").select(F.col("node").alias("row"), "label")
    of_row = documents.where("row is not null").groupBy("row").agg(F.min("key").alias("key"), F.count("*").alias("copies")).join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
    return documents, of_row, sets


def _answer(docs: DataFrame, documents: DataFrame, of_row: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    smallest = of_row.groupBy("label").agg(F.min("key").alias("least"))
    counted = ["links"] if "links" in of_row.columns else []
    least = of_row.join(smallest, "label").select("row", "least", "copies", *counted)
    joined = documents.join(least, "row", "left").withColumn("least", F.coalesce("least", "key"))
    own = lambda c: F.when(F.col(c) < NULL_KEYS, F.col(c)).cast(kind)
    n_links = [F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links")] if counted else []
    return joined.select(own("key").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), own("least").alias("component_id"), *n_links)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose doc_id is the smallest of their component, with all their columns. Rows of one doc_id are documents of
    their own: of those in one component, one stays (that of the least hash of doc_id and text; of rows equal in both any).
    Rows without doc_id come last. Texts without shingles all stay."""
    if keyed(docs).groupBy("key").count().where("count > 1").isEmpty():
        gone = link(docs, width, percent).where("doc_id is not null and doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Rows are named by a hash of doc_id and text here.
    named = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).alias("doc_id"), "text", F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long")).alias("rank"))
    found = written(link(named.select("doc_id", "text"), width, percent).where("n_shingles > 0").distinct(), "found")
    ranked = found.join(named.select("doc_id", "rank").distinct(), "doc_id")
    stays = ranked.groupBy("component_id").agg(F.min(F.struct("rank", "doc_id"))["doc_id"].alias("doc_id")).select("doc_id")
    kept = named.join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    without = named.join(found, "doc_id", "left_anti")
    return kept.unionByName(without).select("doc.*")
