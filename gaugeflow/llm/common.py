"""Shared helpers: scratch tables in the cluster's shared folder, components, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a batch that goes to a Python worker and back while a table is written.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SESSION = uuid.uuid4().hex[:12]
_ROOTS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a local master (tests) gets a
    temporary one; a cluster without it is an error, as executors would not see a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gaugeflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    mine = f"{root.rstrip('/')}/gaugeflow-{_SESSION}"
    if mine not in _ROOTS:
        _ROOTS[mine] = spark
    return mine


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:10]}"
    before = int(spark.conf.get(_BATCH, "10000"))
    spark.conf.set(_BATCH, min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS)  # whole texts are long rows
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._gaugeflow_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    if path := getattr(df, "_gaugeflow_path", None):
        delete_path(df.sparkSession, path)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for root, spark in _ROOTS.items():
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, root)
        except Exception:  # the session has ended
            pass


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow; a worker gives memory back when its partition ends, as the next one may be another plan's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_schema(schema) -> pa.Schema:
    """The Arrow schema of a DDL string or StructType, as Spark expects it back from mapInArrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    return to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))


#: Edges (16 bytes each) up to which one task joins them with a union-find; beyond, stars do.
ONE_TASK_EDGES = 2_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
    nodes = list(root)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(find, part), pa.int64())], names=["node", "component"])


def components(edges: DataFrame, one_task_edges: int | None = None) -> DataFrame:
    """Connected components of edges(a long, b long) as (node, component), component the smallest node
    reachable. Up to one_task_edges distinct edges go through a union-find in one task; more through alternating large-star and small-star steps (Kiveris et al. 2014) over written tables:
    each round is two shuffles with map-side minima, O(log n) rounds in practice; a hub with any number
    of neighbours is only ever seen through its minimum, joined back with a splittable join. Self loops
    and null ends are ignored; nodes without edges are absent."""
    cur = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u is not null and v is not null and u <> v").distinct(), "cc")
    mark = _mark(cur)
    if mark[0] <= (ONE_TASK_EDGES if one_task_edges is None else one_task_edges):
        return map_batches(cur.coalesce(1), _joined, "node bigint, component bigint")
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        nxt = written(
            large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct(), "cc")
        for old in (cur, low, large, least):
            dropped(old)
        cur, before = nxt, mark
        mark = _mark(cur)
        if mark == before:
            break
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return out.union(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of whole texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in a partition sorted by key, each whole; memory is one run and one batch."""
    import numpy as np

    rest: pa.RecordBatch | None = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        start = 0
        for end in cut.tolist():
            yield batch.slice(start, end - start)
            start = end
        rest = batch.slice(start)
    if rest is not None and rest.num_rows:
        yield rest
