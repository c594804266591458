"""Ranked lexical search over postings (operator 11)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NOT_TERM = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Buckets of terms, by hash.
BUCKETS = 256
#: Rows of item terms that are broadcast at most (about 100 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000
#: There each term is dealt to so many parts of the documents, as one term may be in all of them.
SALTS = 64
#: Texts are read in blocks of about so many bytes; tasks give so many postings at once.
BLOCK, GIVEN = 4 << 20, 1 << 18


def counted(data: bytes) -> Counter[bytes]:
    """Occurrences of each term of a text; only A-Z is lower-cased."""
    found, begin = Counter(), 0
    while begin < len(data):
        cut = _NOT_TERM.search(data, begin + BLOCK)
        end = cut.start() if cut else len(data)
        found.update(TERM.findall(data[begin:end].lower()))
        begin = end
    return found


def postings(texts: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """(bucket, term, row, id, tf, n, head): for each row of texts and each of its terms the occurrences tf; n is the number of all its
    terms, head marks one posting of each row. bucket is the term's hash. Rows are numbered; id is what id_column has."""
    source = texts.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, terms, tf, n, head = [], [], [], [], [], []

            def given(batch=batch) -> pa.RecordBatch:
                place = [i for i, m in zip(rows, lengths, strict=True) for _ in range(m)]
                own = batch.select(["row", "id"]).take(pa.array(place, pa.int64()))
                made = [pa.array(terms, pa.binary()).cast(pa.string()), own.column("row"), own.column("id"), pa.array(tf, pa.int64()), pa.array(n, pa.int64()), pa.array(head, pa.bool_())]
                for x in (rows, lengths, terms, tf, n, head):
                    x.clear()
                return pa.RecordBatch.from_arrays(made, ["term", "row", "id", "tf", "n", "head"])

            for i, data in enumerate(batch.column("text")):
                found = counted(data.as_py() or b"")
                if found:
                    rows.append(i)
                    lengths.append(len(found))
                    terms += found.keys()
                    tf += found.values()
                    n += [found.total()] * len(found)
                    head += [True] + [False] * (len(found) - 1)
                if len(terms) >= GIVEN:
                    yield given()
            if terms:
                yield given()

    kind = source.schema["id"].dataType.simpleString()
    made = source.mapInArrow(run, f"term string, row long, id {kind}, tf long, n long, head boolean")
    return made.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), "*")


def index(docs: DataFrame) -> DataFrame:
    """The postings of all documents as a written table. Each file holds the postings of its documents, sorted by bucket and term, so a
    search that asks for few terms reads the row groups of their buckets. One term's postings are spread over all files."""
    return written(postings(docs, "doc_id").sortWithinPartitions("bucket", "term"), "postings")


def weighed(found: DataFrame, asked: DataFrame) -> tuple[DataFrame, int, int]:
    """(bucket, term, item, item_id, weight) of the item terms that documents have, with the weight times the term's occurrences in the
    item; the number of documents with a term, and of all their terms."""
    whole = found.agg(F.count_if("head").alias("n_docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("n_terms")).first()
    n_docs, n_terms = int(whole.n_docs), int(whole.n_terms)
    vocabulary = asked.select("bucket", "term").distinct()
    if asked.count() <= BROADCAST_ROWS:
        vocabulary = F.broadcast(vocabulary)
    held = found.join(vocabulary, ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    own = asked.select("bucket", "term", F.col("row").alias("item"), F.col("id").alias("item_id"), "tf")
    terms = own.join(held, ["bucket", "term"]).select("bucket", "term", "item", "item_id", (weight * F.col("tf")).cast("long").alias("weight"))
    return written(terms.where("weight > 0"), "terms"), n_docs, n_terms


def ranked(found: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item by score, equal ones by doc_id (null last).

    found is index() of the documents, items has item_id and text. Item terms that all documents hold weigh 0 and are left out, as they add
    nothing. The score of every match is an integer; matches are summed by item and document, where each task sums its own
    documents first, and each task sends at most `top` documents of an item to be ranked."""
    asked = written(postings(items, "item_id"), "asked")
    terms, n_docs, n_terms = weighed(found, asked)
    m = F.expr(f"75 + (25 * n * {n_docs}L) div {max(1, n_terms)}L")
    own = found.select("bucket", "term", "row", F.col("id").alias("doc_id"), "tf", m.alias("m"))
    own = own.withColumn("part", F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)")).drop("tf", "m")
    if terms.count() <= BROADCAST_ROWS:
        matches = own.join(F.broadcast(terms), ["bucket", "term"])
    else:
        salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
        dealt = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matches = own.withColumn("salt", salt).join(dealt, ["bucket", "term", "salt"])
    scores = matches.groupBy("item", "item_id", "row", "doc_id").agg(F.sum(F.col("weight") * F.col("part")).alias("score")).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """ranked() over all documents for all items.

    Every row of docs is a document of its own, and every row of items an item, so repeated rows are ranked separately and null ids come
    along as null. Null and empty texts have no terms: such documents are never found, such items find none. An empty table of
    either gives no rows. Other columns are ignored."""
    return ranked(index(docs), items, top)
