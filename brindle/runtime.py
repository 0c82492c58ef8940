"""Session helpers: shared checkpoint folder, lineage cuts, table loading."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from brindle.errors import StorageError


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the cluster's ``spark.checkpoint.dir``; a local one only where Spark is local too."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise StorageError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="brindle-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The files are on storage all executors share, so a lost executor costs a re-read and not a recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
