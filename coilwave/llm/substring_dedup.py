"""Repeated passages of words, by FM-indexes of shards (operator 1)."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytetext as B
from .fm_index import FMIndex, matching_statistics
from .shared import twinned
from .windows import RUN, Batches, Spec, covered, repeated_runs, with_runs

#: Words of one FM-index.
SHARD_WORDS = 600_000


def _index(pieces: list[tuple], spec: Spec) -> Batches:
    """Builds the FM-index of a shard's pieces, in document order, and streams the pieces through it. Matching statistics count
    what at least two places of the index have; a window is a repeat if its match reaches the width and the matching
    suffixes begin earlier somewhere."""
    # rows equal in doc_id and text send equal pieces: they are one document
    pieces = sorted({p[1:] for p in pieces})
    ids: dict[bytes, int] = defaultdict(count(1).__next__)
    split = [p[4].split() for p in pieces]
    length = np.array([len(w) for w in split])
    end = np.cumsum(length + 1) - 1
    text = np.zeros(int(end[-1]) + 1, np.int64)
    text[B.spread(end - length, length)] = [ids[w] for ws in split for w in ws]
    index = FMIndex(text, len(ids) + 1, spec.width)
    match, row = matching_statistics(index, text, end, length, least=2)
    first = index.earliest[index.class_of_row[row]]
    repeat = (match >= spec.width) & (first < np.arange(len(text)))
    edge = np.flatnonzero(np.diff(repeat.astype(np.int8), prepend=0, append=0))
    lo, hi = edge[::2], edge[1::2]
    piece = np.searchsorted(end, lo)
    key, twin, start = (np.array([p[i] for p in pieces], np.int64)[piece] for i in range(3))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((key, twin, start + lo - (end - length)[piece], hi - lo), RUN, strict=True)], schema=RUN)


def repeated_passages(docs: DataFrame, width: int = 20) -> DataFrame:
    """(key, twin, start, n): windows of `width` words that also start earlier. See remove_repeats."""
    return _repeats(twinned(docs), width)


def _repeats(named: DataFrame, width: int) -> DataFrame:
    spec = Spec("word", width, max(1, width * 3 // 10), first_stays=True)
    return repeated_runs(named.select("key", "twin", "text"), spec, _index, SHARD_WORDS)


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): each document without the words that a window of `width`
    words covers whose words also start earlier (in a smaller doc_id, or earlier in the same document).

    Words are [^\\x20\\x09-\\x0D]+; windows are judged on the input. A null or empty text has no words and an empty
    kept_text. A null doc_id comes after all others. Rows of one doc_id (or of none) and different texts are documents of
    their own, in the order of a hash of the text; rows equal in both are one document, so none is an earlier copy of the
    other and both lose the same words. Other columns are ignored, whatever their names."""

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            for part, data, at in B.chunks(batch):
                start, end, first = B.words(data, at, B.BLANKS)
                gone = covered(part.column("runs"), first, width)
                raw, texts = data.tobytes(), []
                for t in range(len(part)):
                    own = slice(int(first[t]), int(first[t + 1]))
                    keep = ~gone[own]
                    texts.append(b" ".join([raw[s:e] for s, e in zip(start[own][keep].tolist(), end[own][keep].tolist(), strict=True)]))
                n = np.diff(first)
                lost = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array((lost[first[1:]] - lost[first[:-1]]).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    named = twinned(docs)
    kept = with_runs(named, _repeats(named, width))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return kept.select("doc_id", "text", "runs").mapInArrow(cut, schema)
