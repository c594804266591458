"""Repeated byte strings, by suffix arrays with bucket-pointer refinement (operator 3)."""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytetext as B
from .shared import twinned
from .windows import RUN, Batches, Spec, covered, repeated_runs, with_runs

#: Bytes of one suffix array; two bucket pointers and a place then fit one 64-bit sort key.
SHARD_BYTES = 1_400_000
#: Bytes of the first grams; the eighth byte of their sort key tells how many of them the piece has.
Q = 7
#: A pass goes through the buckets in so many parts, each of which uses what the parts before have refined.
PARTS = 8
U = np.uint64


def grams_of(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first Q bytes from each place, as sort keys; places with fewer bytes left come before those that go on."""
    padded = np.zeros(len(text) + Q, np.uint8)
    padded[: len(text)] = text
    gram = np.zeros(len(text), np.uint64)
    for j in range(Q):
        gram = (gram << U(8)) | np.where(left > j, padded[j : j + len(text)], 0)
    return (gram << U(8)) | np.minimum(left, Q).astype(np.uint64)


def refined_buckets(gram: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes sorted by at least their first `width` bytes, and each place's bucket pointer: the row where its bucket begins.

    Buckets start as Q-grams; a place with fewer bytes is a bucket of its own. A bucket whose members share their first
    d bytes is refined by sorting its members by the pointers of the places d further on. Pointers and depths are
    updated at once, so buckets refined later in a pass already sort by them, and a member gains all the depth that
    the bucket it points to has reached. Buckets of one member, or of `width` bytes, are done."""
    n = len(gram)
    bits = U(int(n).bit_length())
    low = (U(1) << bits) - U(1)
    order = np.argsort(gram)
    own = gram[order]
    new = (np.diff(own, prepend=own[:1]) != 0) | ((own & U(255)) < Q)
    new[:1] = True
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, n))
    pointer = np.empty(n, np.uint64)
    pointer[order] = np.repeat(head, size).astype(np.uint64)
    depth = np.full(n, Q, np.int64)
    active = order[np.repeat(size > 1, size)]
    while len(active):
        left = []
        # parts of the pass, cut where a bucket begins
        begin = np.flatnonzero(np.diff(pointer[active].astype(np.int64), prepend=-1) != 0)
        cut = np.unique(np.append(begin[np.linspace(0, len(begin), PARTS, endpoint=False).astype(np.int64)], len(active)))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            member = active[a:b]
            pair = (pointer[member] << bits) | pointer[member + depth[member]]
            if 3 * int(bits) <= 64:
                packed = np.sort((pair << bits) | member.astype(np.uint64))
                member, pair = (packed & low).astype(np.int64), packed >> bits
            else:
                by = np.argsort(pair, kind="stable")
                member, pair = member[by], pair[by]
            rows, old = np.arange(len(member)), pair >> bits
            new = np.diff(pair, prepend=pair[:1] + U(1)) != 0
            parent = np.maximum.accumulate(np.where(np.diff(old, prepend=old[:1] + U(1)) != 0, rows, 0))
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(member)))
            reached = depth[member] + depth[member + depth[member]]
            pointer[member] = old + (np.repeat(head, size) - parent).astype(np.uint64)
            depth[member] = reached
            left.append(member[np.repeat(size > 1, size) & (reached < width)])
        active = np.concatenate(left)
    return (np.sort((pointer << bits) | np.arange(n, dtype=np.uint64)) & low).astype(np.int64), pointer.astype(np.int64)


def repeated_places(text: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """True for each place of the pieces of text (of these lengths, one after another) whose next `width` (at least Q) bytes, within
    its piece, also begin elsewhere: a neighbour in the order of suffixes shares them. Members of one bucket do; where
    buckets were refined beyond `width`, neighbours are compared gram by gram."""
    # one place more after each piece, which no bytes follow
    end = np.cumsum(length + 1) - 1
    place = B.spread(end - length, length)
    slots = np.zeros(int(end[-1]) + 1, np.uint8)
    slots[place] = text
    left = np.repeat(end, length + 1) - np.arange(len(slots))
    gram = grams_of(slots, left)
    order, pointer = refined_buckets(gram, width)
    x, y = order[:-1], order[1:]
    near = np.flatnonzero((left[x] >= width) & (left[y] >= width))
    same = pointer[x[near]] == pointer[y[near]]
    again = near[same]
    near = near[~same]
    for k in [width - Q, *range(0, width - Q, Q)]:
        if not len(near):
            break
        near = near[gram[x[near] + k] == gram[y[near] + k]]
    found = np.zeros(len(slots), bool)
    for rows in (again, near):
        found[x[rows]] = found[y[rows]] = True
    return found[place]


def _index(pieces: list[tuple], spec: Spec) -> Batches:
    """Pieces of several routes are suffix-sorted together, each distinct one once. Pieces of one route that are equal as a whole (copies that
    different tasks sent) are repeats of each other already, and stand in the array for what others share with them."""
    own: list[list[tuple]] = []
    for _, route in groupby(pieces, key=lambda p: p[0]):
        same: dict[bytes, list[tuple]] = {}
        for p in route:
            same.setdefault(p[5], []).append(p)
        own += same.values()
    length = np.array([len(copies[0][5]) for copies in own])
    end = np.cumsum(length)
    found = repeated_places(np.frombuffer(b"".join(copies[0][5] for copies in own), np.uint8), length, spec.width).astype(np.int8)
    rows = [p[1:5] for copies in own if len(copies) > 1 for p in copies]
    edge = np.flatnonzero(np.diff(found, prepend=0, append=0))
    lo, hi = edge[::2], edge[1::2]
    at = np.searchsorted(end, lo, "right")
    for e, s, n in zip(at.tolist(), (lo - (end - length)[at]).tolist(), (hi - lo).tolist(), strict=True):
        if len(own[e]) == 1:
            _, key, twin, start, _, _ = own[e][0]
            rows.append((key, twin, start + s, n))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RUN, strict=True)], schema=RUN)


def repeated_strings(docs: DataFrame, width: int = 400) -> DataFrame:
    """(key, twin, start, n): strings of `width` bytes that also start anywhere else. See remove_repeats."""
    return _repeats(twinned(docs), width)


def _repeats(named: DataFrame, width: int) -> DataFrame:
    spec = Spec("byte", width, max(1, width * 4 // 25), first_stays=False)
    return repeated_runs(named.select("key", "twin", "text"), spec, _index, SHARD_BYTES)


def remove_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): each document without the bytes that a string of `width`
    bytes covers which also starts anywhere else, in the same or another document. All copies go.

    Texts are UTF-8 bytes; strings are judged on the input. kept holds the bytes left (binary: a cut may fall inside a
    character). A null or empty text has no bytes. Rows of one doc_id, and rows without doc_id, are documents of their
    own: they lose what they share like any others. width is at least 7. Other columns are ignored, whatever their names."""

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            for part, data, at in B.chunks(batch):
                gone = covered(part.column("runs"), at, width)
                lost = np.concatenate([[0], np.cumsum(gone)])
                opens = np.concatenate([[0], np.cumsum(np.diff(gone.astype(np.int8), prepend=0) > 0)])
                left = data[~gone].tobytes()
                kept_at = at - lost[at]
                texts = [left[a:b] for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), strict=True)]
                # a run that begins where a text begins counts there, even if the text before ends in a run
                joined = np.array([bool(0 < a < len(gone) and gone[a] and gone[a - 1] and b > a) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.array((lost[at[1:]] - lost[at[:-1]]).astype(np.int64)), pa.array((opens[at[1:]] - opens[at[:-1]]).astype(np.int64) + joined), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array(texts, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    named = twinned(docs)
    kept = with_runs(named, _repeats(named, width))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return kept.select("doc_id", "text", "runs").mapInArrow(cut, schema)
