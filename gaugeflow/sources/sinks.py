"""Sinks: Parquet with a row count that is checked, CSV tables, JSON receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_checked(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write beside the target, compare rows written with rows read, then rename. An existing partial is an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    part, target = (sc._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.partial", path))
    fs = part.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(part):
        raise FileExistsError(f"{path}.partial")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy(*partition_by).parquet(f"{path}.partial")
    n = seen.get["n"]
    if (found := spark.read.schema(df.schema).parquet(f"{path}.partial").count()) != n:
        raise OSError(f"{found} of {n} rows")
    old = sc._jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    had = fs.exists(target)
    if had and not fs.rename(target, old):  # aside, so that a failed rename loses neither
        raise OSError(f"cannot rename {path}")
    if not fs.rename(part, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot rename {path}.partial")
    fs.delete(old, True)
    return n


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV with a header, for small aggregate tables."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_receipt(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def stands(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is at path."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table from the footers of its files alone: the count is pushed down to the reader, which opens no row group."""
    keys = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        return spark.read.parquet(path).agg(F.count("*")).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
