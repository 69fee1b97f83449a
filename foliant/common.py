"""Session and table helpers that every part of the engine shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one parquet table; filters and column selection reach the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def latest(df: DataFrame, keys: list[str], ts: str, tie: list[Column] | None = None) -> DataFrame:
    """Rows with the latest ``ts`` of each key; one row a key.

    Null timestamps rank last. Equal ones are settled by ``tie``, cheap columns as a rule; rows that are equal in these
    too must not differ in what is used, or any of them may come out. Only keys, ``ts`` and ``tie`` are read besides the
    columns that are asked for later. Rows whose key is null are dropped: they name nothing.
    """
    rank = "__rank"
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last(), *(tie or []))
    return df.dropna(subset=keys).withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``checkpoint()`` in the folder the cluster names in spark.checkpoint.dir.

    A folder of our own is used only where that setting is absent and none was set, on one machine, as in tests; on a
    cluster its lack is an error, since executors couldn't read one another's files.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="foliant-checkpoint-"))
    return df.checkpoint(eager)
