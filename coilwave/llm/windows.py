"""Finding repeated windows of a fixed width across all documents without comparing documents pairwise.

Every window of `width` units (words or bytes) has one anchor: its gram of least hash. Equal windows
have equal anchors, so (1) anchors are counted over the whole corpus, (2) only text around anchors met
twice is sent on, (3) to the shard its anchor's hash names, where an index finds the repeats exactly.
Anchors that a chunk of texts has several times are known to be met again there, so each chunk sends one
row for them to be counted. Anchors met very often are too much for one shard; groups of their windows are
counted by hash of what a group has in common first, and only groups met again go on, to shards named by that
hash. A group met too often even for that (it reaches from a common passage into each document's own text) is
counted window by window, and windows met again go on by their own hash. Equal pieces within a task are merged
before any shuffle: the copies that a task holds of one piece are repeats of each other, and one of them stands for all in
the index. (On tables with large groups of copies that settles most rows of the groups; every distinct piece is indexed.)

(key, twin) names a document, see shared.twinned().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .shared import written

Batches = Iterator[pa.RecordBatch]
U64 = np.uint64


@dataclass(frozen=True)
class Spec:
    """unit: "word" or "byte". first_stays: the earliest copy of a window is no repeat of the others."""

    unit: str
    width: int
    gram: int
    first_stays: bool
    #: An anchor is hot if it is met more often than this, or than one in 2 ** HOT_ANCHORS of all anchors if that is more.
    hot: int = 4_000
    #: A group of windows that more rows than this have is taken apart.
    crowd: int = 400

    @property
    def step(self) -> int:
        """At a hot anchor so many neighbouring windows form a group."""
        return max(1, min(48, (self.width - self.gram + 1) // 8))

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the gram at each unit, each unit's place in data (one more entry), each text's first unit."""
        if self.unit == "byte":
            start = np.arange(max(0, len(data) - self.gram + 1))
            return B.span_hashes(B.prefix_hashes(data), start, start + self.gram), np.arange(len(data) + 1), at
        start, end, first = B.words(data, at, B.BLANKS)
        return B.gram_hashes(B.span_hashes(B.prefix_hashes(data), start, end), self.gram), np.append(start, len(data)), first

    def body(self, data: np.ndarray, place: np.ndarray, first: int, last: int) -> bytes:
        """The units first..last-1; words are joined by single blanks."""
        piece = data[place[first] : place[last]].tobytes()
        return piece if self.unit == "byte" else b" ".join(piece.split()[: last - first])


def anchored(grams: np.ndarray, first: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor, first window, number of windows, text. All in units of the chunk."""
    n, w = int(first[-1]), width - gram + 1
    empty = np.zeros(0, np.int64)
    if n < width:
        return empty, empty, empty, empty
    bits = U64(int(n).bit_length())
    low = (U64(1) << bits) - U64(1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    count = np.maximum(np.diff(first) - width + 1, 0)
    start = B.spread(first[:-1], count)
    if not len(start):
        return empty, empty, empty, empty
    anchor = (key[start] & low).astype(np.int64)
    new = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
    return anchor[new], start[new], np.diff(np.append(new, len(start))), np.repeat(np.arange(len(count)), count)[new]


#: In place of a group's offset: a window by itself.
LONE = 63


#: log2 of how many anchors can be hot, and of the cells that one hot anchor has to itself on average.
HOT_ANCHORS, CELLS_EACH = 24, 4
#: Bytes of text whose anchors, or pieces, one partition takes at most on average.
PART_BYTES = 256 << 20
#: Bytes of pieces that a task holds to merge equal ones.
MERGED_BYTES = 128 << 20

NAME = [("key", pa.int64()), ("twin", pa.int64())]
ANCHOR = pa.schema([("fp", pa.int64()), *NAME, ("pos", pa.int32()), ("n", pa.int32())])
#: hit: a place * 2, or a group of windows * 2 + 1. n counts an anchor that is met more often than `often`.
HIT = pa.schema([*NAME, ("hit", pa.int64()), ("fp", pa.int64()), ("n", pa.int64())])
SEGMENT = pa.schema([("route", pa.int64()), *NAME, ("start", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
HASHED = pa.schema([("wh", pa.int64()), *NAME, ("pos", pa.int64()), ("n", pa.int32())])
RUN = pa.schema([*NAME, ("start", pa.int32()), ("n", pa.int32())])
DDL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


def _batch(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _batched(rows: list[tuple], schema: pa.Schema, size: int = 20_000) -> Batches:
    for i in range(0, len(rows), size):
        yield _batch(schema, *zip(*rows[i : i + size], strict=True))


def _names(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column("key").to_numpy(), part.column("twin").to_numpy()


def _anchors(spec: Spec) -> Callable[[Batches], Batches]:
    """A row for each anchor. n is 0 if the chunk has the anchor several times, but for the first of those, which counts them."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part, data, at in B.chunks(batch):
                grams, _, first = spec.units(data, at)
                anchor, start, _, text = anchored(grams, first, spec.width, spec.gram)
                key, twin = _names(part)
                fp = B.signed(grams[anchor])
                _, begin, n = np.unique(fp, return_index=True, return_counts=True)
                counted = np.zeros(len(fp), np.int32)
                counted[begin] = n
                yield _batch(ANCHOR, fp, key[text], twin[text], (start - first[text]).astype(np.int32), counted)

    return run


def _met(often: int) -> Callable[[Batches], Batches]:
    """Hits among the anchors of one partition: those met again, and those that a chunk knew to be. Every row of n > 0 of one anchor is here."""

    def run(batches: Batches) -> Batches:
        held = []
        for batch in batches:
            key, twin, pos, n = (batch.column(c).to_numpy() for c in ("key", "twin", "pos", "n"))
            known = n == 0
            yield _hits(key[known], twin[known], pos[known])
            held.append([batch.column("fp").to_numpy()[~known], key[~known], twin[~known], pos[~known], n[~known]])
        if not held:
            return
        fp, key, twin, pos, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(fp)
        head = np.flatnonzero(np.diff(fp[order]) != 0) + 1
        head = np.append(0, head) if len(order) else head
        total = np.add.reduceat(n[order].astype(np.int64), head) if len(order) else n
        met = order[np.repeat(total > 1, np.diff(np.append(head, len(order))))]
        yield _hits(key[met], twin[met], pos[met])
        hot = total > often
        none = np.full(int(hot.sum()), -1)
        yield _batch(HIT, none, none, none, fp[order[head[hot]]], total[hot])

    return run


def _hits(key: np.ndarray, twin: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(key), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(twin), pa.array(pos.astype(np.int64) * 2), none, none], schema=HIT)


@dataclass(frozen=True)
class Hot:
    """Which anchors are hot: a bit for each cell of hashes, so its size has a bound. An anchor that shares a cell with a hot one
    is treated like it, which changes its way to the index and not the result."""

    words: np.ndarray
    bits: int

    def __call__(self, fp: np.ndarray) -> np.ndarray:
        cell = fp >> U64(64 - self.bits)
        return (self.words[(cell >> U64(6)).astype(np.int64)] >> (cell & U64(63))) & U64(1) == 1


def hot_anchors(fps: DataFrame, most: int) -> Hot | None:
    """From (fp) of at most `most` hot anchors; None if there are none. A row comes to the driver for each 64 cells with a hot anchor."""
    bits = min(HOT_ANCHORS + CELLS_EACH, max(10, int(most).bit_length() + CELLS_EACH))
    cell = fps.select(F.shiftrightunsigned("fp", 64 - bits).alias("cell"))
    rows = cell.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits")).toPandas()
    if not len(rows):
        return None
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return Hot(words, bits)


class _Merged:
    """Pieces of one task; of equal ones the earliest stays, the others are settled: all their windows are repeats."""

    def __init__(self, spec: Spec) -> None:
        self.spec, self.kept, self.settled, self.size = spec, {}, [], 0

    def add(self, route: int, body: bytes, doc: tuple[int, int], start: int, n: int) -> None:
        own = (doc, start, n)
        old = self.kept.setdefault((route, body), own)
        if old is own:
            self.size += len(body)
        elif not self.spec.first_stays:
            self.settled += [own, old]
        elif old != own:  # rows equal in doc_id and text are no earlier copies of each other
            self.kept[(route, body)] = min(own, old)
            self.settled.append(max(own, old))


def _settled(merged: _Merged, route: int | None) -> list[tuple]:
    """The settled runs of a task as (route or key, key, twin, start, n); runs of a text that meet or overlap are one."""
    if not merged.settled:
        return []
    key, twin, start, n = (np.array(c, np.int64) for c in zip(*((*doc, s, n) for doc, s, n in merged.settled), strict=True))
    order = np.lexsort((start, twin, key))
    key, twin, start, end = key[order], twin[order], start[order], (start + n)[order]
    lift = np.cumsum(np.append(0, (np.diff(key) != 0) | (np.diff(twin) != 0))) << 40
    far = np.maximum.accumulate(end + lift)
    head = np.flatnonzero(np.append(True, start[1:] + lift[1:] > far[:-1]))
    end = np.maximum.reduceat(end, head)
    return [(k if route is None else route, k, t, s, e - s) for k, t, s, e in zip(key[head].tolist(), twin[head].tolist(), start[head].tolist(), end.tolist(), strict=True)]


def _pieces(part: pa.RecordBatch, data: np.ndarray, at: np.ndarray, spec: Spec, hot: Hot | None) -> Iterator[tuple[int, bytes, tuple[int, int], int, int]]:
    """(route, body, document, first window, windows) of the pieces that a text's hits name: a place * 2 without hot anchors, or a group of windows at a hot anchor (see _hot_windows) or one of them (see _lone_windows)."""
    grams, place, first = spec.units(data, at)
    anchor, start, count, text = anchored(grams, first, spec.width, spec.gram)
    docs = list(zip(*(x.tolist() for x in _names(part)), strict=True))
    hits = part.column("hits")
    flat, cut = hits.flatten().to_numpy(), np.append(0, np.cumsum(hits.value_lengths().to_numpy(zero_copy_only=False)))
    which = np.repeat(np.arange(len(docs)), np.diff(cut))
    whole = (first[which] + (flat >> 1))[(flat & 1) == 0]
    chosen = np.flatnonzero(np.isin(start, whole))
    if hot:
        chosen = chosen[~hot(grams[anchor[chosen]])]
    fps = B.signed(grams[anchor[chosen]])
    for fp, s, n, t in zip(fps.tolist(), start[chosen].tolist(), count[chosen].tolist(), text[chosen].tolist(), strict=True):
        yield fp, spec.body(data, place, s, s + n + spec.width - 1), docs[t], s - int(first[t]), n
    grouped = (flat & 1) == 1
    code, own = flat[grouped] >> 1, which[grouped]
    for u, m, off, t in zip((first[own] + (code >> 12)).tolist(), (code >> 6 & 63).tolist(), (code & 63).tolist(), own.tolist(), strict=True):
        if u + m - 1 + spec.width <= first[t + 1]:
            common = spec.body(data, place, u, u + spec.width) if off == LONE else spec.body(data, place, u - off + spec.step - 1, u - off + spec.width)
            yield hash_bytes(common), spec.body(data, place, u, u + m - 1 + spec.width), docs[t], u - int(first[t]), m


def hash_bytes(body: bytes) -> int:
    data = np.frombuffer(body, np.uint8)
    return int(B.signed(B.span_hashes(B.prefix_hashes(data), np.array([0]), np.array([len(data)])))[0])


def _segments(spec: Spec, hot: Broadcast) -> Callable[[Batches], Batches]:
    def flush(merged: _Merged) -> Batches:
        rows = [(route, *doc, start, n, body) for (route, body), (doc, start, n) in merged.kept.items()]
        yield from _batched(rows + [(*x, None) for x in _settled(merged, None)], SEGMENT)

    def run(batches: Batches) -> Batches:
        merged = _Merged(spec)
        for batch in batches:
            for part, data, at in B.chunks(batch):
                for piece in _pieces(part, data, at, spec, hot.value):
                    merged.add(*piece)
                if merged.size > MERGED_BYTES:
                    yield from flush(merged)
                    merged = _Merged(spec)
        yield from flush(merged)

    return run


def _hot_windows(spec: Spec, hot: Broadcast) -> Callable[[Batches], Batches]:
    """Around hot anchors: settled runs (n > 0); and the pieces that stay, in groups of windows by their place at the anchor (n = 0),
    each with the hash of what all windows of the group have in common. Equal windows fall into groups of equal hash."""

    def flush(merged: _Merged, anchor_at: dict[bytes, int]) -> Batches:
        yield from _batched(_settled(merged, 0), HASHED)
        held: list[np.ndarray] = []
        for (_, body), ((key, twin), start, n) in merged.kept.items():
            data = np.frombuffer(body, np.uint8)
            sums = B.prefix_hashes(data)
            group = np.arange(n) - anchor_at[body] + spec.width
            at = np.flatnonzero(np.diff(group // spec.step, prepend=-1))
            off, size = group[at] % spec.step, np.diff(np.append(at, n))
            lo, hi = at - off + spec.step - 1, at - off + spec.width
            if spec.unit == "word":
                s, e, _ = B.words(data, np.array([0, len(data)]), B.BLANKS)
                lo, hi = s[lo], e[hi - 1]
            held.append(np.stack([B.signed(B.span_hashes(sums, lo, hi)), np.full(len(at), key), np.full(len(at), twin), ((start + at) * 64 + size) * 64 + off]))
        for i in range(0, len(held), 5_000):
            own = np.concatenate(held[i : i + 5_000], axis=1)
            yield _batch(HASHED, *own, np.zeros(own.shape[1], np.int32))

    def run(batches: Batches) -> Batches:
        merged, anchor_at = _Merged(spec), {}
        for batch in batches:
            for part, data, at in B.chunks(batch):
                grams, place, first = spec.units(data, at)
                anchor, start, count, text = anchored(grams, first, spec.width, spec.gram)
                chosen = np.flatnonzero(hot.value(grams[anchor]))
                docs = list(zip(*(x.tolist() for x in _names(part)), strict=True))
                for a, s, n, t in zip(anchor[chosen].tolist(), start[chosen].tolist(), count[chosen].tolist(), text[chosen].tolist(), strict=True):
                    body = spec.body(data, place, s, s + n + spec.width - 1)
                    anchor_at[body] = a - s
                    merged.add(0, body, docs[t], s - int(first[t]), n)
                if merged.size > MERGED_BYTES:
                    yield from flush(merged, anchor_at)
                    merged, anchor_at = _Merged(spec), {}
        yield from flush(merged, anchor_at)

    return run


#: Windows that a task holds to find equal ones.
LONE_AT_ONCE = 4_000_000


def _lone_windows(spec: Spec) -> Callable[[Batches], Batches]:
    """The windows of the groups that a text's hits name, one by one, each with its hash. n is 0 if the task has the window several
    times, but for the first of those, which counts them."""

    def flush(held: list[list[np.ndarray]]) -> Batches:
        wh, key, twin, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        _, begin, n = np.unique(wh, return_index=True, return_counts=True)
        counted = np.zeros(len(wh), np.int32)
        counted[begin] = n
        for i in range(0, len(wh), 100_000):
            yield _batch(HASHED, *(x[i : i + 100_000] for x in (wh, key, twin, pos, counted)))

    def run(batches: Batches) -> Batches:
        held, many = [], 0
        for batch in batches:
            for part, data, at in B.chunks(batch):
                grams, _, first = replace(spec, gram=spec.width).units(data, at)
                hits = part.column("hits")
                code, length = hits.flatten().to_numpy(), hits.value_lengths().to_numpy(zero_copy_only=False)
                which = np.repeat(np.arange(len(length)), length)
                start, size = code >> 12, code >> 6 & 63
                place, of = B.spread(start, size), np.repeat(which, size)
                key, twin = _names(part)
                held.append([B.signed(grams[first[of] + place]), key[of], twin[of], (place * 64 + 1) * 64 + LONE])
                many += len(place)
                if many > LONE_AT_ONCE:
                    yield from flush(held)
                    held, many = [], 0
        if held:
            yield from flush(held)

    return run


def _sharded(spec: Spec, index: Callable, limit: int) -> Callable[[Batches], Batches]:
    """Pieces come sorted by route; whole routes are gathered up to `limit` units and indexed together. Equal windows are on one route, so
    a piece alone on its route has no partner. (Equal windows of one piece would each have an anchor, and a piece, of their own.)"""

    def run(batches: Batches) -> Batches:
        held: list[tuple] = []
        own: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            bodies = batch.column("body")
            for r, *piece, b in zip(*(batch.column(c).to_pylist() for c in ("route", "key", "twin", "start", "n")), bodies.to_pylist(), strict=True):
                if b is None:
                    continue
                if r != last:
                    if len(own) > 1:
                        held += own
                        size += sum(p[4] + spec.width for p in own)
                    own, last = [], r
                    if size >= limit:
                        yield from index(held, spec)
                        held, size = [], 0
                own.append((r, *piece, b))
            done = np.array([not x for x in bodies.is_valid().to_pylist()])
            if done.any():
                yield batch.filter(pa.array(done)).select(RUN.names)
        if len(own) > 1:
            held += own
        if held:
            yield from index(held, spec)

    return run


def dealt(df: DataFrame, total: int, *by: str | Column) -> DataFrame:
    """df dealt by columns; to more partitions than the session has set if a table of `total` bytes needs them."""
    parts = total // PART_BYTES
    return df.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*by)


def repeated_runs(docs: DataFrame, spec: Spec, index: Callable, limit: int) -> DataFrame:
    """(key long, twin long, start int, n int): the windows start .. start+n-1 of a document are repeats.

    docs: (key, twin, text). index(pieces, spec) yields RUN batches for one shard's pieces (route, key, twin, start, n, body)."""
    spark = docs.sparkSession
    # About an anchor for every half gap between grams; the estimates set only what counts as hot, and the number of partitions.
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = int(2 * total / (1 if spec.unit == "byte" else 6) / (spec.width - spec.gram + 2))
    often = max(spec.hot, many >> HOT_ANCHORS)
    spread = F.when(F.col("n") == 0, F.xxhash64("key", "pos")).otherwise(F.col("fp"))
    anchors = dealt(docs.mapInArrow(_anchors(spec), ddl(ANCHOR)), total, spread)
    hits = written(anchors.mapInArrow(_met(often), ddl(HIT)), "hits")
    hot = spark.sparkContext.broadcast(hot_anchors(hits.where("fp is not null").select("fp"), many // often))
    named, settled = hits.where("fp is null").select("key", "twin", "hit"), None
    if hot.value:
        found = written(docs.mapInArrow(_hot_windows(spec, hot), ddl(HASHED)), "hot")
        windows = found.where("n = 0")
        met = written(windows.groupBy("wh").agg(F.count("*").alias("c")).where("c > 1"), "met")
        crowded = met.where(F.col("c") > spec.crowd).select("wh") if spec.step > 1 else None
        again = met.where(F.col("c") <= spec.crowd) if spec.step > 1 else met
        calm = windows if crowded is None else windows.join(crowded, "wh", "left_anti")
        grouped = calm.join(again.select("wh"), "wh").select("key", "twin", "pos")
        if crowded is not None:
            by_doc = windows.join(crowded, "wh").groupBy("key", "twin").agg(F.collect_set("pos").alias("hits"))
            lone = written(docs.join(by_doc, ["key", "twin"]).mapInArrow(_lone_windows(spec), ddl(HASHED)), "lone")
            counted = lone.where("n > 0")
            twice = counted.groupBy("wh").agg(F.sum("n").alias("c")).where("c > 1").select("wh")
            grouped = grouped.unionByName(counted.join(twice, "wh").select("key", "twin", "pos")).unionByName(lone.where("n = 0").select("key", "twin", "pos"))
        named = named.unionByName(grouped.select("key", "twin", (F.col("pos") * 2 + 1).alias("hit")))
        settled = found.where("n > 0").select("key", "twin", F.col("pos").cast("int").alias("start"), "n")
    # a set: rows equal in doc_id and text name the same places
    by_doc = named.groupBy("key", "twin").agg(F.collect_set("hit").alias("hits"))
    pieces = docs.join(by_doc, ["key", "twin"]).mapInArrow(_segments(spec, hot), ddl(SEGMENT))
    runs = dealt(pieces, total, "route").sortWithinPartitions("route").mapInArrow(_sharded(spec, index, limit), ddl(RUN))
    return runs if settled is None else runs.unionByName(settled)


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """docs (key, twin, ...) with each row's repeated runs as array<struct<start, n>> (null: none)."""
    return docs.join(runs.groupBy("key", "twin").agg(F.collect_set(F.struct("start", "n")).alias("runs")), ["key", "twin"], "left")


def covered(runs: pa.Array, first: np.ndarray, width: int) -> np.ndarray:
    """True for each unit of a chunk that a repeated window covers. runs: array<struct<start, n>> of each text; what would lie beyond a text counts nowhere."""
    lengths = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    which = np.repeat(np.arange(len(lengths)), lengths)
    flat = runs.flatten()
    start = first[which] + flat.field("start").to_numpy(zero_copy_only=False)
    end = start + flat.field("n").to_numpy(zero_copy_only=False) + width - 1
    depth = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(depth, np.minimum(start, first[which + 1]), 1)
    np.add.at(depth, np.minimum(end, first[which + 1]), -1)
    return np.cumsum(depth[:-1]) > 0
