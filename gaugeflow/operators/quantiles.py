"""Expanding order statistics: quantiles of all that was known up to each moment, without a row for each moment and earlier day.

Days are cut into parts of PART_DAYS. A part is one sorted block of values; a moment's quantiles are order statistics over the blocks of the earlier
parts and the own part's days up to it, found by binary search in two sorted arrays. Blocks merge by merging sorted arrays, so what is shipped is
each block once to each later part of its key, and a task holds one key's values up to one part.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parts import joined

PART_DAYS = 4096


def kth(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The k-th smallest, from 0, of two sorted arrays together."""
    lo, hi = max(0, k + 1 - len(b)), min(k + 1, len(a))
    while lo < hi:
        mid = (lo + hi) // 2  # how many of the k + 1 smallest come from a
        if mid < len(a) and k - mid >= 0 and k - mid < len(b) and a[mid] < b[k - mid]:
            lo = mid + 1
        elif mid > 0 and k + 1 - mid < len(b) and a[mid - 1] > b[k + 1 - mid]:
            hi = mid
        elif mid < len(a) and k - mid >= len(b):
            lo = mid + 1
        else:
            lo = hi = mid
    left = a[lo - 1] if lo else -np.inf
    right = b[k - lo] if 0 <= k - lo < len(b) else -np.inf
    return float(max(left, right))


def quantile(a: np.ndarray, b: np.ndarray, p: float) -> float:
    """The linearly interpolated quantile of two sorted arrays together."""
    at = p * (len(a) + len(b) - 1)
    low = int(at)
    first = kth(a, b, low)
    return first if at == low else (low + 1 - at) * first + (at - low) * kth(a, b, low + 1)


def _part(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("0001-01-01").cast("date")) / PART_DAYS)


def expanding_quantiles(rows: DataFrame, moments: DataFrame, keys: list[str], known: str, at: str, wanted: dict[str, tuple[float, ...]]) -> DataFrame:
    """rows(keys, known date, values) and moments(keys, at date): for each distinct moment and each value column in wanted, the quantiles of the values that are not
    null and known on or before it, as `<column>_q` (null where there are none) and their number as `<column>_n`."""
    columns = list(wanted)
    cut = rows.where(F.col(known).isNotNull()).select(*keys, F.col(known).alias("_known"), *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("_part", _part(F.col("_known")))
    blocks = cut.groupBy(*keys, "_part").agg(
        F.struct(*[F.sort_array(F.collect_list(c)).alias(c) for c in columns]).alias("_block"), F.sort_array(F.collect_list(F.struct("_known", *columns))).alias("_own"))
    asked = moments.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at")).distinct().withColumn("_part", _part(F.col("_at"))).groupBy(*keys, "_part").agg(F.sort_array(F.collect_list("_at")).alias("_ats"))
    parts = asked.select(*keys, F.col("_part").alias("_for"))
    earlier = joined(parts, blocks.select(*keys, "_part", "_block"), keys, "inner").where("_part < _for").groupBy(*keys, "_for").agg(F.collect_list("_block").alias("_earlier")).withColumnRenamed("_for", "_part")
    both = joined(joined(asked, blocks.select(*keys, "_part", "_own"), [*keys, "_part"]), earlier, [*keys, "_part"]).select(*keys, "_ats", "_own", "_earlier")
    names = [*keys, at, *[f"{c}_{x}" for c in columns for x in "nq"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ats, own, before = (batch.column(c)[i].as_py() or [] for c in ("_ats", "_own", "_earlier"))
                found: dict[str, list] = {f"{c}_{x}": [] for c in columns for x in "nq"}
                for c in columns:
                    base = np.sort(np.concatenate([b[c] for b in before])) if before else np.empty(0)
                    mine: list[float] = []
                    k = 0
                    for t in ats:
                        while k < len(own) and own[k]["_known"] <= t:
                            if own[k][c] is not None:
                                insort(mine, own[k][c])
                            k += 1
                        n = len(base) + len(mine)
                        found[f"{c}_n"].append(n)
                        found[f"{c}_q"].append([quantile(base, mine, p) for p in wanted[c]] if n else None)
                head = [batch.column(c).take(pa.array([i] * len(ats))) for c in keys]
                yield pa.RecordBatch.from_arrays([*head, pa.array(ats, pa.date32()), *[pa.array(v, pa.int64() if n.endswith("_n") else pa.list_(pa.float64())) for n, v in found.items()]], names=names)

    kinds = dict(moments.dtypes)
    return both.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], f"`{at}` date", *[f"`{c}_n` bigint, `{c}_q` array<double>" for c in columns]]))
