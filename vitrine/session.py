"""Session helper for local runs and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vitrine")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for a local master without any.

    On a cluster each executor would write to a folder of its own there, and later reads would miss rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all of {master} shares")
        base = tempfile.mkdtemp(prefix="vitrine-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the work folder."""
    return f"{work_dir(spark)}/vitrine/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    For a frame with several consumers: the rows are computed one time, later readers prune
    columns from the file, and a lost executor costs a re-read instead of the whole lineage.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
