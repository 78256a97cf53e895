"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "textrec", cores: str = "*", conf: dict | None = None) -> SparkSession:
    """A one-machine session for tests and timing; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false",
        **(conf or {}),
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for name, value in settings.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a one-machine
    session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="textrec-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result must not be computed twice: row numbers that depend on
    how rows were partitioned, and replies that cost a model call each. The
    written table outlives any executor and cuts the lineage.
    """
    path = f"{shared_folder(df.sparkSession)}/textrec/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Delete all intermediate tables in the shared folder, replies of named runs among them.

    For when no run that uses the folder is going on.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/textrec")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
