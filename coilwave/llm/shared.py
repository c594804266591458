"""What the operators share: document keys, and tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coilwave.tables import shared_dir, written

__all__ = ["NULL_KEYS", "keyed", "shared_dir", "written"]

#: Keys of rows without a doc_id start here, so they come after all others; doc_ids are integers below it.
NULL_KEYS = (1 << 63) - (1 << 32)


def keyed(docs: DataFrame) -> DataFrame:
    """(key long, doc_id, text): key is the doc_id, an integer below NULL_KEYS. A row without doc_id gets a key from there
    on, from its text, so it comes last."""
    own = F.lit(NULL_KEYS) + F.xxhash64("text").bitwiseAND(F.lit((1 << 32) - 1))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), own).alias("key"), "doc_id", "text")


def twinned(docs: DataFrame) -> DataFrame:
    """keyed(), and twin: (key, twin) names a document. Where no key comes twice, twin is 0; else it is a hash of the text, so
    rows of one doc_id and different texts are documents of their own, in the order of their hashes. Only rows equal in
    both share a name."""
    own = keyed(docs)
    alone = own.groupBy("key").count().where("count > 1").isEmpty()
    return own.withColumn("twin", F.lit(0).cast("long") if alone else F.xxhash64("text"))
