"""Cutting lineage where a plan is used several times."""

from __future__ import annotations

import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame


def _shared_folder(sc: SparkContext) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one is set here only where none is configured and all runs on this machine."""
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not (sc.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("/tmp/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later uses read it back and their plans start from it."""
    _shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut`` for large tables: columns, packed, in the same folder.

    A checkpoint computes its last stage twice (once to count, once to write) and writes
    each row as a serialized object; this computes once and later uses read only their columns.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    path = f"{_shared_folder(sc)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if sc.getConf().get("spark.cleaner.referenceTracking.cleanCheckpoints", "false") == "true":
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
