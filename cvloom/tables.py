"""Access to the tables of a data directory, and the shared folder for checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of the directory (one Parquet file or folder per table)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    The cluster names a folder that all executors share in `spark.checkpoint.dir`. Only with a local master, where one
    machine is all there is, a temporary folder stands in for it; on a cluster without the setting this raises.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    jvm_folder = context._jsc.sc().getCheckpointDir()
    if not folder and jvm_folder.isDefined():
        return jvm_folder.get()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "cvloom-checkpoints")
    if not jvm_folder.isDefined():
        context.setCheckpointDir(folder)
    return folder


def are_small(*tables: DataFrame, rows: int = 100_000) -> bool:
    """Has each of the tables at most `rows` rows? They are counted, no further than that."""
    return all(t.select(F.lit(1)).limit(rows + 1).count() <= rows for t in tables)


#: Session setting: the splits that a scan should have at least; 0 leaves every scan as its files are split.
LEAST_SPLITS = "spark.cvloom.leastSplits"


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """The rows in at least `least` partitions (default: the setting LEAST_SPLITS, or else more than half of the cores).

    A file of one row group is one task however many cores there are. Where a step per row costs much more than moving the
    row, it pays to move it. A scan that has `least` splits already, as any table of more than a few files, is left as it
    is, without a shuffle; otherwise its rows are dealt out to all cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if least is None:
        least = int(df.sparkSession.conf.get(LEAST_SPLITS, str(cores // 2 + 1)))
    return df.repartition(max(least, cores)) if least and df.rdd.getNumPartitions() < least else df
