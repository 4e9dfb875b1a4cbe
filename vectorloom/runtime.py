"""Session services that every operator shares: lineage cuts, sizes and deterministic sampling."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one the session names, else a local one (tests, local mode)."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    target = named or f"file://{LOCAL_CHECKPOINTS}/{os.getpid()}"
    spark.sparkContext.setCheckpointDir(target)
    return target


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of the executors that computed it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session has been sized for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fits(df: DataFrame, max_rows: int) -> bool:
    """True if df has at most max_rows rows; reads no more than max_rows + 1 of them."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only behind a check of the row count; otherwise Spark shuffles the join."""
    return F.broadcast(df) if fits(df, max_rows) else df
