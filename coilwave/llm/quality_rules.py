"""Quality rules as weak supervision (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B

#: Counts of each text: characters of a set by column, over the whole text.
SETS = {"n_symbols": b"#*$%&|<>", "n_upper": bytes(range(65, 91)), "n_lower": bytes(range(97, 123)), "n_pipes": b"|", "n_shouts": b"!", "n_stops": b".?"}
COUNTS = ["n_words", "word_chars", "n_dup_lines", "n_repeat_words", *SETS]

#: Rule: (votes bad if, votes good if); it abstains if neither holds or a count is missing.
RULES = {
    "symbols": ("n_symbols > 0.2 * n_words", "n_symbols <= 0.02 * n_words and n_words >= 50"),
    "pipes": ("n_pipes > 0.2 * n_words", "false"),
    "shouting": ("n_upper > n_lower and n_words >= 5", "false"),
    "exclaiming": ("n_shouts > 0.3 * n_words", "false"),
    "repeating": ("n_repeat_words > 0.3 * n_words", "false"),
    "lines": ("n_dup_lines >= 3", "false"),
    "word_length": ("word_chars > 12 * n_words or word_chars < 2 * n_words", "false"),
    "length": ("n_words < 20", "false"),
    "sentences": ("n_stops * 200 < n_words", "n_stops * 50 >= n_words and n_words >= 50 and n_symbols * 50 <= n_words"),
}


def counted(docs: DataFrame, *carried: str) -> DataFrame:
    """`carried` columns of docs (as a struct `row`), and the counts of each text, over the whole of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in B.chunks(batch):
                start, end, first = B.words(data, at, B.BLANKS)
                n = np.diff(first)
                out = {"n_words": n}
                inside = np.zeros(len(data) + 1, np.int8)
                inside[start] += 1
                inside[end] -= 1
                lead = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((data & 0xC0) != 0x80)
                out["word_chars"] = _per_text(lead, at)
                lines = np.zeros(len(part), np.int64)
                raw = data.tobytes()
                for t, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    own = [x for x in raw[a:b].split(b"\n") if x.strip()]
                    lines[t] = len(own) - len(set(own))
                out["n_dup_lines"] = lines
                out["n_repeat_words"] = _repeated(B.span_hashes(B.prefix_hashes(data), start, end), first)
                for name, chars in SETS.items():
                    table = np.zeros(256, bool)
                    table[list(chars)] = True
                    out[name] = _per_text(table[data], at)
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(np.asarray(out[c], np.int64)) for c in COUNTS)], ["row", *COUNTS])

    source = docs.select(F.struct(*[F.col(c) for c in carried]).alias("row"), "text")
    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def _per_text(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def _repeated(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text inside three-word windows that the text has twice or more."""
    count = np.maximum(np.diff(first) - 2, 0)
    begin = B.spread(first[:-1], count)
    hit = np.zeros(len(word) + 3, np.int8)
    if len(begin):
        key = B.gram_hashes(word, 3)[begin] + B.mix(np.repeat(np.arange(len(count)), count).astype(np.uint64))
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        twice = begin[order[np.append(same, False) | np.append(False, same)]]
        hit[twice] = hit[twice + 1] = hit[twice + 2] = 1
    return _per_text(hit[: len(word)].astype(bool), first)


def votes() -> F.Column:
    """One letter a rule: g (good), b (bad) or - (abstains)."""
    return F.concat(*[F.when(F.expr(bad), "b").when(F.expr(good), "g").otherwise("-") for bad, good in RULES.values()])


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[str, float]]:
    """Expectation-maximisation over how often each pattern of votes occurs: the share of good documents, each rule's chances to vote
    bad, good or not at all (last axis) on bad and on good documents (first axis), and each pattern's posterior of being good.

    Not voting is an outcome like a vote, so it also tells. Chances lean on ten votes as all documents give them, and half a vote
    of each kind; a bad vote never speaks for a document, nor a good one against it. It starts from the votes counted,
    ten bad ones weighing as much as a hundred good ones."""
    names = sorted(patterns)
    weight = np.array([patterns[p] for p in names], float)
    table = np.array([["bg-".index(x) for x in p] for p in names])
    cast = (table[:, :, None] == np.arange(3)).astype(float)
    n_bad, n_good = (table == 0).sum(1), (table == 1).sum(1)
    posterior = (n_good + 8) / (n_good + 10 * n_bad + 10)
    prior = 10 * np.einsum("p,pro->ro", weight, cast) / max(1.0, weight.sum()) + 0.5
    good, chances = 0.8, np.zeros((2, len(RULES), 3))
    for _ in range(rounds):
        good = float(np.clip((weight @ posterior + 8) / (weight.sum() + 10), 0.05, 0.95))
        for label, p in enumerate((1 - posterior, posterior)):
            votes_cast = np.einsum("p,pro->ro", weight * p, cast) + prior
            chances[label] = votes_cast / votes_cast.sum(axis=1, keepdims=True)
        says = np.log(chances[1] / chances[0])
        says[:, 0], says[:, 1] = np.minimum(says[:, 0], 0), np.maximum(says[:, 1], 0)
        posterior = 1 / (1 + np.exp(-np.log(good / (1 - good)) - np.einsum("pro,ro->p", cast, says)))
    return good, chances, dict(zip(names, posterior.tolist(), strict=True))


def judge(docs: DataFrame, *carried: str) -> DataFrame:
    """`carried` columns (as a struct `row`), the counts, votes, p_good, base_failed and kept of each document.

    Words are [^\\x20\\x09-\\x0D]+. Base: fewer than 50 words, or more than half the words inside repeated three-word
    windows. Other documents are kept if the posterior probability of being good is at least 0.5. A null or empty text
    has no words and fails the base. Every row is judged on its own, so repeated rows and null ids do no harm.

    The vote patterns (at most 3 ** rules) are counted over all documents; only these counts come to the driver. Documents
    that fail the base are not judged by the rules, so chances are estimated on the others; p_good is given for all."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = counted(docs, *carried).withColumns({"votes": votes(), "base_failed": failed})
    patterns = {r.votes: r.n for r in found.groupBy("votes").agg(F.count_if(~F.col("base_failed")).alias("n")).collect()}
    posterior = estimate(patterns)[2] if patterns else {}
    table = docs.sparkSession.createDataFrame([(k, v) for k, v in sorted(posterior.items())], "votes string, p_good double")
    return found.join(F.broadcast(table), "votes", "left").withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= 0.5))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return judge(docs, *docs.columns).where("kept").select("row.*")
