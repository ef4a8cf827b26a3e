"""Histogram sort: documents into shards of near equal bytes, with DataFrame functions only.

Documents are ordered by (CRC-32 of the text, 52 bits of a hash of the id): equal texts stand together, and a hot
group of them can still be cut by id. The exact bytes and rows below candidate boundaries are counted
across all partitions; stretches (leaves) of the order that hold an unmet splitter, or more than
1/HEAVY of all rows, are probed again at FANOUT boundaries between their least and largest key, until every splitter is
within tolerance. Only then do rows move, once, to be numbered within their leaf; a leaf's
first slot is known from the counts, so that no task ever holds more than one leaf.

The driver holds leaves, at most (1 << FIRST_BITS) + rounds * (HEAVY + shards) * FANOUT of them whatever the input,
and the same table is what is broadcast.

Law `bytes`: shard sizes are near equal; a splitter may be off by `tolerance` of a shard, or by
`group_tolerance` where that keeps a group of equal texts whole, or by the one row that it would cut.
Cases: null text has size 1 and CRC 0; empty tables give no rows; rows equal in text and id are one key and
stay in one shard; null ids are ordinary keys. Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

FIRST_BITS = 12
FANOUT = 64
HEAVY = 256


class _Leaf:
    __slots__ = ("bytes", "c0", "c1", "d0", "d1", "key", "rows")

    def __init__(self, key, n_bytes, rows, c0, c1, d0, d1):
        self.key, self.bytes, self.rows, self.c0, self.c1, self.d0, self.d1 = key, n_bytes, rows, c0, c1, d0, d1


def _small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _counted(df: DataFrame) -> list[_Leaf]:
    """Exact bytes and rows of every leaf, with its least and largest keys, in order."""
    found = df.groupBy("leaf").agg(
        F.sum("size").alias("b"), F.count("*").alias("n"), F.min("crc").alias("c0"), F.max("crc").alias("c1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    return sorted((_Leaf(*r) for r in found.collect()), key=lambda x: (x.c0, x.d0 if x.c0 == x.c1 else 0))


def _nearest(edges: list[int], goal: float) -> int:
    return min(range(len(edges)), key=lambda i: (abs(edges[i] - goal), i))


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, tolerance: float = 0.002, group_tolerance: float = 0.02) -> DataFrame:
    """(id, size, text_crc32, shard, slot): slots count from 0 without gaps in each shard, in key order."""
    spark = df.sparkSession
    raw = F.col(text_col).cast("string").cast("binary")
    narrow = written(df.select(
        F.col(id_col), (F.coalesce(F.octet_length(raw), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("bigint").alias("crc"), F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 12).alias("d")), "keys")
    cur = narrow.withColumn("leaf", F.shiftright("crc", 32 - FIRST_BITS))
    leaves = _counted(cur)
    total_bytes, total_rows = sum(x.bytes for x in leaves), sum(x.rows for x in leaves)
    ideal, base = total_bytes / shards, 1 << FIRST_BITS
    goals = [ideal * i for i in range(1, shards)]
    while True:
        edges, at = [0], 0
        for x in leaves:
            edges.append(at := at + x.bytes)
        again = {k for k, x in enumerate(leaves) if x.rows * HEAVY > total_rows}
        for goal in goals:
            k = next((i for i in range(len(leaves)) if edges[i] < goal <= edges[i + 1]), None)
            if k is not None:
                off = min(goal - edges[k], edges[k + 1] - goal)
                if off > (group_tolerance if leaves[k].c0 == leaves[k].c1 else tolerance) * ideal:
                    again.add(k)
        again = [k for k in sorted(again) if leaves[k].rows > 1 and (leaves[k].c0 < leaves[k].c1 or leaves[k].d0 < leaves[k].d1)]
        if not again:
            break
        probes = []
        for i, k in enumerate(again):
            x, by_crc = leaves[k], leaves[k].c0 < leaves[k].c1
            lo, hi = (x.c0, x.c1) if by_crc else (x.d0, x.d1)
            probes.append({"leaf": x.key, "by_crc": by_crc, "lo": lo, "span": hi - lo + 1, "first": base + i * FANOUT})
        base += len(again) * FANOUT
        probe = F.broadcast(_small_table(spark, probes, "leaf bigint, by_crc boolean, lo bigint, span bigint, first bigint"))
        sub = F.expr(f"first + ((if(by_crc, crc, d) - lo) * {FANOUT}) div span")
        cur = cur.join(probe, "leaf", "left").select(*narrow.columns, F.coalesce(sub, F.col("leaf")).alias("leaf"))
        fresh = _counted(cur.where(F.col("leaf") >= probes[0]["first"]))
        gone = set(again)
        leaves = sorted([x for k, x in enumerate(leaves) if k not in gone] + fresh, key=lambda x: (x.c0, x.d0 if x.c0 == x.c1 else 0))
    cuts = sorted(_nearest(edges, goal) for goal in goals) if leaves else []
    places, rows_before, shard = [], 0, 0
    for k, x in enumerate(leaves):
        while shard < len(cuts) and cuts[shard] <= k:
            shard, rows_before = shard + 1, 0
        places.append({"leaf": x.key, "shard": shard, "first_slot": rows_before})
        rows_before += x.rows
    place = F.broadcast(_small_table(spark, places, "leaf bigint, shard int, first_slot bigint"))
    order = Window.partitionBy("leaf").orderBy("crc", "d", id_col)
    return cur.join(place, "leaf").select(
        id_col, "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first_slot") + F.row_number().over(order) - 1).cast("bigint").alias("slot"))
