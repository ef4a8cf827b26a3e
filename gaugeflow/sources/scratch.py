"""Scratch tables and folders in the place that the cluster names for them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, deleted when the program ends. Where that is unset a local master gets a temporary folder,
    and a cluster an error, as executors would not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gaugeflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE[path] = spark
    return path


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written once and read back: what follows reads the table, not its plan."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for path, spark in _MADE.items():
        try:
            if spark.sparkContext._jsc is not None:
                sc = spark.sparkContext
                p = sc._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            pass
