"""Session helpers shared by every operator: table loading and lineage cuts that survive lost executors."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_scrivane_shipped", False):
        return
    root = Path(__file__).parent
    name = os.path.join(tempfile.mkdtemp(prefix="scrivane-zip-"), "scrivane_package.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    sc._scrivane_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one Parquet table of a data folder; column pruning and filters reach the scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a local master gets a folder of its own, as in tests; a cluster is an error, because a folder of
    one machine would not outlive it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every machine shares")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="scrivane-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, replicated storage, nothing is recomputed when an executor is lost."""
    ship(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let the driver drop what finished jobs left, and give its memory back; else it grows to its bound first."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession, least: int = 12) -> int:
    """Number of hash buckets for operators that pack rows per bucket: follows spark.sql.shuffle.partitions."""
    ship(spark)
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows of a few-file input over all cores before costly per-row work.

    An input that already has two partitions for every core, as any large table has, is left alone: nothing is shuffled.
    (Splits of a file that hold no whole row group are empty, so fewer partitions than that may keep few cores busy.)
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < 2 * cores else df
