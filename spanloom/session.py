"""Session helpers: where lineage is cut and how tables are read."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with an eager checkpoint on shared storage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Where
    that is unset, a local session gets a private temporary folder; on a cluster
    it is an error, since executors share no such folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or _private_folder())
    return df.checkpoint(eager=True)


def _private_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spanloom-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one Parquet table of ``sf_dir``, pruned to ``columns`` if given."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
