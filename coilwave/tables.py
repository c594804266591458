"""Tables written to the shared folder, so that lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all machines share. Where it is unset, one machine (a local master)
    gets a temporary one; on a cluster that is an error, as every machine would write to a disk of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        at = tempfile.mkdtemp(prefix="coilwave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: later work survives lost executors without computing df
    again. The files stay, as the result may be read at any time; they lie in a folder named by the application, which can
    be removed once it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
