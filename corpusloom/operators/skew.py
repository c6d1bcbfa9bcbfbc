"""Joins and cuts that hold under skew and executor loss."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for written tables and checkpoints: the session's `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own, which goes
    with the process; on a cluster a missing setting is an error, since a
    machine-local folder would not survive the loss of its machine.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), f"corpusloom-{os.getpid()}")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def join_unique(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, hot_parts: int = 2000) -> DataFrame:
    """Left join to a table with one row per key, whatever the skew of the keys on the left.

    `weight` is the number of left rows of each right row and `total` their sum.
    Keys with more than 1/`hot_parts` of all rows — so at most `hot_parts` keys,
    whatever the size of the data — are broadcast; the rest is joined by shuffle,
    where no key can then hold more than that share.  `right` should be cheap to
    read twice (cut its lineage first).  Left keys must not be null.
    """
    least = max(1, total // hot_parts)
    payload = [c for c in right.columns if c not in on and c != weight]
    hot = right.where(F.col(weight) > least).select(*on, F.struct(*payload).alias("_hot"))
    cold = right.where(F.col(weight) <= least).select(*on, F.struct(*payload).alias("_cold"))
    tried = left.join(F.broadcast(hot), on, "left")
    keep = [F.col(f"_j.{c}").alias(c) for c in payload]
    done = tried.where(F.col("_hot").isNotNull()).select(*left.columns, F.col("_hot").alias("_j"))
    rest = tried.where(F.col("_hot").isNull()).drop("_hot").join(cold, on, "left").select(*left.columns, F.col("_cold").alias("_j"))
    return done.unionByName(rest).select(*left.columns, *keep)


def hash_bucket(c: Column, n: int | Column, seed: int = 0) -> Column:
    """Bucket 0..n-1 of a value, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), c), F.lit(n) if isinstance(n, int) else n).cast("int")


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size: the files' size for a scan, an upper bound in most other cases."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores, by `keys` if given, where a scan would leave some without work.

    For operators that spend far more on a row in Python than a shuffle of it costs.
    Files estimated under `spark.sql.files.maxPartitionBytes` a core are shuffled into
    two partitions a core; larger ones have splits enough and aren't.  Only where rows
    lie depends on it, and only statistics are asked for: nothing runs ahead.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(2 * cores, *keys) if plan_bytes(df) < cores * split else df
