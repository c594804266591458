"""Benchmark passages in documents, by Wu-Manber search over words (operator 7)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B

#: Benchmark text searched for in one pass over the documents; a larger benchmark takes several passes.
PASS_BYTES = 32 << 20
#: Documents are searched in pieces of so many words, side by side.
PIECE = 256
BLOCK = 2


class WuManber:
    """Searches for all windows of one length (in words) at once.

    shift: by block hash, how far the search may move on when a block (two words, or one for one-word windows) ends at
    the place looked at. Blocks that end a window have shift 0; their full hash names a bucket of windows, which are
    then compared word by word."""

    def __init__(self, length: int, windows: dict[bytes, list[int]]) -> None:
        self.length, self.block, self.items = length, min(BLOCK, length), windows
        data = np.frombuffer(b" ".join(windows), np.uint8)
        start, end, _ = B.words(data, np.array([0, len(data)]), B.NOT_ALNUM)
        word = B.span_hashes(B.prefix_hashes(data), start, end).reshape(-1, length)
        self.bits = min(24, max(10, int(word.size * 8).bit_length()))
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int32)
        for j in range(self.block, length + 1):
            at = self.slot(self.blocks(word[:, j - self.block : j]))
            np.minimum.at(self.shift, at, length - j)
        self.buckets: dict[int, set[bytes]] = defaultdict(set)
        for h, w in zip(self.blocks(word[:, length - self.block :]).tolist(), windows, strict=True):
            self.buckets[h].add(w)

    def blocks(self, word: np.ndarray) -> np.ndarray:
        return B.mix(word[..., -1] * B.U(0x9E3779B97F4A7C15) + (word[..., 0] if self.block > 1 else B.U(0)))

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> B.U(64 - self.bits)).astype(np.int64)

    def search(self, data: bytes, start: np.ndarray, end: np.ndarray, word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(first word, window) of each occurrence within one text; first: each text's first word."""
        m, n = self.length, np.diff(first)
        pieces = np.maximum(-(-(n - m + 1) // PIECE), 0)
        at = B.spread(np.zeros(len(n), np.int64), pieces) * PIECE + np.repeat(first[:-1], pieces) + m - 1
        stop = np.minimum(at + PIECE, np.repeat(first[1:], pieces))
        if self.block > 1:
            h = np.zeros(len(word), np.uint64)
            h[1:] = self.blocks(np.stack([word[:-1], word[1:]], axis=1))
        else:
            h = self.blocks(word[:, None])
        shift = self.shift[self.slot(h)]
        hits: list[np.ndarray] = []
        while len(at):
            by = shift[at]
            hits.append(at[by == 0])
            at = at + np.maximum(by, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        for e in np.concatenate(hits or [np.zeros(0, np.int64)]).tolist():
            if bucket := self.buckets.get(int(h[e])):
                s = e - m + 1
                found = b" ".join([data[a:b] for a, b in zip(start[s : e + 1].tolist(), end[s : e + 1].tolist(), strict=True)])
                if found in bucket:
                    yield s, found


class _Items:
    """A pass's items; a worker builds their tables once, for all its tasks."""

    def __init__(self, items: list[tuple[str, str | None]], width: int) -> None:
        self.items, self.width = items, width

    @cached_property
    def searches(self) -> list[WuManber]:
        return _windows([(i, _normal(t)) for i, t in self.items], self.width)


def _windows(items: list[tuple[str, bytes]], width: int) -> list[WuManber]:
    """One search for each window length that occurs: `width`, and the lengths of shorter items."""
    by_length: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
    for i, (_, text) in enumerate(items):
        ws = text.split()
        for k in range(max(1, len(ws) - width + 1) if ws else 0):
            w = ws[k : k + width]
            by_length[len(w)][b" ".join(w)].append(i)
    return [WuManber(n, dict(w)) for n, w in sorted(by_length.items())]


def _normal(text: str | None) -> bytes:
    data = B.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    start, end, _ = B.words(data, np.array([0, len(data)]), B.NOT_ALNUM)
    raw = data.tobytes()
    return b" ".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])


def _pass(docs: DataFrame, items: list[tuple[str, str | None]], width: int) -> DataFrame:
    """(doc_id, text, n_words, spans, items): spans are places [first, last] of hit words, items the ids with occurring windows."""
    held = docs.sparkSession.sparkContext.broadcast(_Items(items, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, searches = [i for i, _ in held.value.items], held.value.searches
        for batch in batches:
            for part, data, at in B.chunks(batch):
                data = B.LOWER[data]
                start, end, first = B.words(data, at, B.NOT_ALNUM)
                word = B.span_hashes(B.prefix_hashes(data), start, end)
                raw = data.tobytes()
                depth = np.zeros(len(start) + 1, np.int32)
                met: dict[int, set[str]] = defaultdict(set)
                for search in searches:
                    for s, w in search.search(raw, start, end, word, first):
                        depth[s] += 1
                        depth[s + search.length] -= 1
                        met[int(np.searchsorted(first, s, "right")) - 1].update(ids[i] for i in search.items[w])
                edge = np.diff((np.cumsum(depth[:-1]) > 0).astype(np.int8), prepend=0, append=0)
                opened, closed = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
                # runs that meet where one text ends and the next begins are two
                spans: list[list[dict]] = [[] for _ in range(len(part))]
                for a, b in zip(opened.tolist(), closed.tolist(), strict=True):
                    t = int(np.searchsorted(first, a, "right")) - 1
                    while a < b:
                        stop = min(b, int(first[t + 1]))
                        if stop > a:
                            spans[t].append({"first": a - int(first[t]), "last": stop - 1 - int(first[t])})
                        a, t = stop, t + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), pa.array(np.diff(first)), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array([sorted(met[t]) if t in met else [] for t in range(len(part))], pa.list_(pa.string()))],
                    ["doc_id", "text", "n_words", "spans", "items"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text string, n_words long, spans array<struct<first:int,last:int>>, items array<string>")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, text, n_words, n_hit, spans, items, contaminated) of each document.

    Texts are lower-cased (A-Z) and split into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is `width` consecutive
    words of a benchmark item; an item of fewer words, but not none, is one window. A document's word inside any
    occurrence of a window is hit. contaminated: some word is hit, and at least 5 % of the words are. A null or empty
    text has no words; such items match nothing, and items without an item_id count nowhere. Items of one item_id are
    one item. Rows of one doc_id are judged each on its own. Other columns are ignored.

    The benchmark goes to the tasks in passes of at most PASS_BYTES of text, so what is broadcast is bounded."""
    docs = docs.select("doc_id", "text")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    passes = 1 + int(size // PASS_BYTES)
    if passes == 1:
        found = _pass(docs, [tuple(r) for r in items.collect()], width)
    else:
        # Several passes: each adds its spans and items to what the row has.
        found = None
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
        for k in range(passes):
            one = _pass(docs if found is None else found.select(F.struct("doc_id", "n_words", "spans", "items").alias("doc_id"), "text"), [tuple(r) for r in items.where(part == k).collect()], width)
            if found is None:
                found = one
            else:
                found = one.select("doc_id.doc_id", "text", "doc_id.n_words", F.concat("doc_id.spans", "spans").alias("spans"), F.array_sort(F.array_union("doc_id.items", "items")).alias("items"))
        # Spans of several passes may overlap; each word counts once.
        found = found.withColumn("spans", _merged(F.array_sort("spans")))
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1), F.lit(0).cast("long"))
    found = found.withColumn("n_hit", n_hit)
    return found.select("doc_id", "text", "n_words", "n_hit", "spans", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The documents that are not contaminated (see find_benchmark), with all their columns."""
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    found = find_benchmark(docs.select(others.alias("doc_id"), "text"), benchmark, width)
    return found.where(~F.col("contaminated")).select("doc_id.*", "text").select(*docs.columns)


def _merged(spans: F.Column) -> F.Column:
    """Sorted spans with overlapping ones joined."""
    none = F.slice(spans, 1, 0)

    def add(done: F.Column, s: F.Column) -> F.Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))
        return F.when((F.size(done) > 0) & (last["last"] >= s["first"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, none, add)
