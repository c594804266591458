"""A quality classifier over bytes: a small convolutional network in NumPy (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B

#: Examples that training reads at most; an example is a labelled text, or a part of so many bytes of a longer one.
SAMPLE = 3000
SAMPLE_BYTES = 16_000
FILTERS = 24
WIDTH = 6
CHUNK = 1024
OVERLAP = 128


@dataclass
class Network:
    """table[j, byte]: a filter's weights for the byte at offset j. A chunk's pooled vector is the maximum of each
    filter's response over its places; the document's vector joins the mean and the maximum of its chunks."""

    table: np.ndarray  # WIDTH, 256, FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    offset: float


def chunk_starts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of overlapping chunks that cover each text, and the text of each. An empty text has none."""
    length = np.diff(at)
    step = CHUNK - OVERLAP
    count = np.where(length > 0, np.maximum(1, -(-(length - OVERLAP) // step)), 0)
    text = np.repeat(np.arange(len(length)), count)
    k = B.spread(np.zeros(len(count), np.int64), count)
    start = at[text] + k * step
    return start, np.minimum(start + CHUNK, at[text + 1]), text


def pooled(net: Network, data: np.ndarray, start: np.ndarray, end: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each chunk's maximum response by filter (and where it is). Places beyond a chunk read as byte 0."""
    vector = np.empty((len(start), FILTERS), np.float32)
    where = np.empty((len(start), FILTERS), np.int64) if places else None
    group = 64
    for i in range(0, len(start), group):
        s, e = start[i : i + group], end[i : i + group]
        longest = int((e - s).max())
        at = s[:, None] + np.arange(longest + WIDTH - 1)
        seen = np.where(at < e[:, None], data[np.minimum(at, len(data) - 1)], 0)
        response = net.table[0][seen[:, :longest]]
        for j in range(1, WIDTH):
            response += net.table[j][seen[:, j : j + longest]]
        if places:
            best = response.argmax(axis=1)
            where[i : i + group] = best
            vector[i : i + group] = np.take_along_axis(response, best[:, None, :], 1)[:, 0]
        else:
            vector[i : i + group] = response.max(axis=1)
    return vector + net.bias, where


def document_vectors(chunk: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and maximum over the chunks of each text (zeros without chunks), and the chunk of each maximum."""
    count = np.bincount(text, minlength=n)
    mean, top = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS), np.float32)
    best = np.zeros((n, FILTERS), np.int64)
    first = np.cumsum(count) - count
    full = np.flatnonzero(count)
    if len(full):
        mean[full] = np.add.reduceat(chunk, first[full], axis=0) / count[full, None]
        top[full] = np.maximum.reduceat(chunk, first[full], axis=0)
    return mean, top, first


def score(net: Network, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    start, end, text = chunk_starts(at)
    hidden = np.maximum(pooled(net, data, start, end)[0], 0) if len(start) else np.zeros((0, FILTERS), np.float32)
    mean, top, _ = document_vectors(hidden, text, n)
    return 1 / (1 + np.exp(-(np.hstack([mean, top]).astype(float) @ net.out + net.offset)))


def train(texts: list[bytes], label: np.ndarray, epochs: int = 8, seed: int = 7) -> Network:
    """Adam on the logistic loss, classes weighed evenly."""
    rng = np.random.default_rng(seed)
    net = Network((rng.normal(0, 0.15, (WIDTH, 256, FILTERS))).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 2 * FILTERS), 0.0)
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
    params = [net.table, net.bias, net.out, np.zeros(1)]
    first, second = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (0.5 ** (epoch // 3))
        order = rng.permutation(len(texts))
        for i in range(0, len(order), 32):
            pick = order[i : i + 32]
            own = [texts[k] for k in pick]
            data = np.frombuffer(b"".join(own), np.uint8)
            at = np.append(0, np.cumsum([len(x) for x in own]))
            if not len(data):
                continue
            start, end, text = chunk_starts(at)
            raw, where = pooled(net, data, start, end, places=True)
            hidden = np.maximum(raw, 0)
            mean, top, begin = document_vectors(hidden, text, len(own))
            joined = np.hstack([mean, top]).astype(float)
            p = 1 / (1 + np.exp(-(joined @ params[2] + params[3][0])))
            g = (p - label[pick]) * weight[pick] / len(pick)
            grad_out = joined.T @ g + 1e-4 * params[2]
            count = np.bincount(text, minlength=len(own))
            g_mean, g_top = g[:, None] * params[2][None, :FILTERS], g[:, None] * params[2][None, FILTERS:]
            g_chunk = g_mean[text] / count[text, None]
            at_top = hidden == top[text]
            g_chunk = (g_chunk + g_top[text] * at_top) * (raw > 0)
            grad_table = np.zeros(net.table.shape)
            f = np.broadcast_to(np.arange(FILTERS), where.shape)
            for j in range(WIDTH):
                place = start[:, None] + where + j
                byte = np.where(place < end[:, None], data[np.minimum(place, len(data) - 1)], 0)
                np.add.at(grad_table[j], (byte, f), g_chunk)
            grads = [grad_table, g_chunk.sum(0), grad_out, np.array([g.sum()])]
            step += 1
            for k, (q, d) in enumerate(zip(params, grads, strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                q -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(q.dtype)
    net.offset = float(params[3][0])
    return net


def _calibrated(net: Network, texts: list[bytes], label: np.ndarray, threshold: float) -> Network:
    """Shifts the offset so that `threshold` parts the two labels best on the training rows."""
    at = np.append(0, np.cumsum([len(x) for x in texts]))
    p = score(net, np.frombuffer(b"".join(texts), np.uint8), at)
    logit = np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    cuts = np.unique(np.quantile(logit, np.linspace(0.005, 0.6, 120)))
    gain = [((logit >= c) & (label == 1)).sum() / max(1, (label == 1).sum()) + ((logit < c) & (label == 0)).sum() / max(1, (label == 0).sum()) for c in cuts]
    best = np.flatnonzero(np.array(gain) >= max(gain) - 1e-12)
    net.offset += float(np.log(threshold / (1 - threshold)) - cuts[best].mean())
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[list[bytes], np.ndarray]:
    """At most `limit` examples from labelled texts that are not held out, the same each time: those of least hash of doc_id and
    place. A text of over SAMPLE_BYTES gives several examples that together hold all of it, so `limit` bounds the bytes too."""
    own = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.where("text is not null")
    sizes = texts.select("doc_id", F.octet_length("text").alias("n")).join(own, "doc_id")
    place = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / SAMPLE_BYTES)).cast("int"))
    # the examples are chosen by size alone; only their texts are read after that
    chosen = sizes.select("doc_id", "label", F.explode(place).alias("k")).orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k").limit(limit)
    chosen = chosen.groupBy("doc_id", "label").agg(F.collect_set("k").alias("ks"))  # `limit` rows at most
    found = texts.select("doc_id", F.encode("text", "utf-8").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text", F.explode("ks").alias("k"))
    parts = found.select("doc_id", "label", "k", F.expr(f"substring(text, k * {SAMPLE_BYTES} + 1, {SAMPLE_BYTES})").alias("part")).where(F.expr("k = 0 or length(part) > 0"))
    rows = parts.orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k", "part").limit(limit).collect()
    rows.sort(key=lambda r: (r.doc_id, r.k, bytes(r.part)))
    return [bytes(r.part) for r in rows], np.array([int(r.label) for r in rows])


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(4)) == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): how likely `labels.quality` is 1, from the bytes of the whole text alone.

    Rows with crc32(doc_id as text) mod 4 = 2 are held out: their labels are never read. The network is fitted on the
    driver to at most `limit` labelled examples of SAMPLE_BYTES each (a longer text gives several); every document is scored whole, in overlapping chunks. A null or
    empty text has no chunks and gets the score of the network's offset. Repeated rows are scored alike; a null doc_id
    is not held out. Without any labels the score is 0.5 for all. Other columns are ignored."""
    docs = docs.select("doc_id", "text")
    texts, label = labelled_sample(docs, labels, limit)
    net = None
    if len(set(label.tolist())) == 2:
        net = _calibrated(train(texts, label), texts, label, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in B.chunks(batch):
                p = score(net, data, at) if net else np.full(len(part), 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
