"""Near-duplicate embeddings by a pivot-permutation index (Chavez et al. 2008; Amato and Savino 2008).

Every vector is described by its nearest pivots. Inverted lists are kept for sets of `shared` pivots, so that two
vectors meet in a list exactly if they have at least that many near pivots in common; the pair counts in the
list of its smallest common pivots only, and is verified by the cosine in double precision. A long list is cut
into chunks, and a task compares two chunks at a time; it gives each vector's count of links and a spanning forest, not the pairs.

Pivots of each vector length come from a bounded sample (SAMPLE vectors, at most MAX_PIVOTS of them, mutually far apart); a length that is
rare in the sample has MIN_PIVOTS random directions, which follow from the length. Every vector is indexed among those of its length.
Equal vectors fold into one that carries their number. Recall against brute force is tested.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths do not link; rows with a null id stay, unlinked, with a null component and kept; rows that repeat
an id are one node, whose links add up. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_batches, sorted_groups, written

#: Vectors sampled for pivots; pivots grow with the square root of the number of vectors between the two bounds.
SAMPLE = 16_384
MIN_PIVOTS, MAX_PIVOTS = 128, 8192
#: Cosine that two pivots may have at most.
APART = 0.5
CHUNK = 512


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _packed(df: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """(id, vec packed, digest) of every row; vec is null where it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, digest = [], []
            for x in batch.column(1):
                v = x.values
                raw = None
                if v is not None and len(v) and not v.null_count:
                    a = v.to_numpy(zero_copy_only=False).astype(kind)
                    norm = np.linalg.norm(a.astype(np.float64))
                    if np.isfinite(norm) and norm > 0:
                        raw = (a + 0).tobytes()  # -0.0 is 0.0
                out.append(raw)
                digest.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(digest, pa.binary())], names=["id", "vec", "digest"])

    return map_batches(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col)), run, "id bigint, vec binary, digest binary")


def _apart(units: np.ndarray, want: int) -> np.ndarray:
    """Greedily, up to want of units that are apart from each other, and others where too few are."""
    chosen = np.empty((min(want, len(units)), units.shape[1]))
    n, spare = 0, []
    for i, u in enumerate(units):
        if n == len(chosen):
            break
        if not n or (chosen[:n] @ u).max() < APART:
            chosen[n] = u
            n += 1
        else:
            spare.append(i)
    chosen[n:] = units[spare[: len(chosen) - n]]
    return chosen


def choose_pivots(reps: DataFrame, kind: str, count: int) -> dict[int, np.ndarray]:
    """Pivots for each length in a sample drawn by a hash of the id, as many as its share of the sample asks for."""
    rows = reps.select("vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("vec").to_pylist()
    size = np.dtype(kind).itemsize
    by_length: dict[int, list[bytes]] = {}
    for r in rows:
        by_length.setdefault(len(r) // size, []).append(r)
    want = lambda n: max(MIN_PIVOTS, min(MAX_PIVOTS, round((count * n / len(rows)) ** 0.5)))
    return {length: _apart(_unit(own, kind), want(len(own))) for length, own in by_length.items() if len(own) >= MIN_PIVOTS}


def _pivots_of(length: int, chosen: dict[int, np.ndarray]) -> np.ndarray:
    """Chosen pivots, or for a length that is rare in the sample random directions that depend on it alone."""
    if length not in chosen:
        v = np.random.default_rng(length).normal(size=(MIN_PIVOTS, length))
        chosen[length] = v / np.linalg.norm(v, axis=1, keepdims=True)
    return chosen[length]


def _list_key(length: int) -> int:
    """Lists of different lengths differ above the pivots' bits."""
    return length % (1 << 20) << 42


def _indexed(reps: DataFrame, pivots: dict[int, np.ndarray], kind: str, near: int, shared: int) -> DataFrame:
    """(id, keys, pivots near, ascending) of every vector, by the pivots of its length."""
    size, sent = np.dtype(kind).itemsize, reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            lengths = np.array([len(r) // size for r in raw], np.int64)
            keys: list[list[int]] = [[] for _ in raw]
            tops: list[bytes] = [b"" for _ in raw]
            for length in np.unique(lengths).tolist():
                if len(own) > 16:
                    own = {}
                if length not in own:
                    own[length] = sent.value[length] if length in sent.value else _pivots_of(length, {})
                mine = np.flatnonzero(lengths == length)
                for at in range(0, len(mine), 2000):
                    part = mine[at : at + 2000]
                    score = _unit([raw[i] for i in part], kind) @ own[length].T
                    top = np.sort(np.argpartition(-score, near - 1, 1)[:, :near], 1) if near < len(own[length]) else np.tile(np.arange(len(own[length])), (len(part), 1))
                    for i, t in zip(part.tolist(), top):
                        tops[i] = t.astype(np.uint16).tobytes()
                        for c in combinations(t.tolist(), shared):
                            key = 0
                            for p in c:
                                key = key * MAX_PIVOTS + p
                            keys[i].append(_list_key(length) + key)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("vec"), pa.array(tops, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "vec", "near", "keys"])

    return map_batches(reps.select("id", "n", "vec"), run, "id bigint, n bigint, vec binary, near binary, keys array<bigint>")


def _first_common(a: np.ndarray, b: np.ndarray, shared: int) -> np.ndarray:
    """The key of the smallest common pivots of each pair of rows (ascending pivots)."""
    common = (a[:, :, None] == b[:, None, :]).any(2)
    rank = np.cumsum(common, 1)
    key = np.zeros(len(a), np.int64)
    for s in range(1, shared + 1):
        at = np.argmax((rank == s) & common, 1)
        key = key * MAX_PIVOTS + a[np.arange(len(a)), at]
    return key


def _links(lists: DataFrame, kind: str, cosine: float, shared: int) -> DataFrame:
    """(id, links, root): vectors linked directly within a pair of chunks, and a node of the same component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "g"):
            for key in np.unique(group.column("key").to_numpy()):  # one, unless hashes collide
                part = group.filter(pa.array(group.column("key").to_numpy() == key))
                ids, n, own = (part.column(c).to_numpy() for c in ("id", "n", "own"))
                if len(ids) < 2:
                    continue
                unit = _unit(part.column("vec").to_pylist(), kind)
                near = np.frombuffer(b"".join(part.column("near").to_pylist()), np.uint16).reshape(len(ids), -1).astype(np.int64)
                i, j = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
                if part.column("cross")[0].as_py():
                    i, j = i[(o := own[i] != own[j])], j[o]
                ok = _list_key(unit.shape[1]) + _first_common(near[i], near[j], shared) == key
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                count = np.zeros(len(ids), np.int64)
                np.add.at(count, i, n[j])
                np.add.at(count, j, n[i])
                root = np.arange(len(ids))
                while True:
                    low = np.minimum(root[i], root[j])
                    new = root.copy()
                    np.minimum.at(new, i, low)
                    np.minimum.at(new, j, low)
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some]), pa.array(ids[root[some]])], names=["id", "links", "root"])

    return map_batches(lists.repartition("g").sortWithinPartitions("g"), run, "id bigint, links bigint, root bigint")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, near: int = 6, shared: int = 2) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    kind = "f8" if "double" in df.schema[vector_col].dataType.simpleString() else "f4"
    rows = written(_packed(df, id_col, vector_col, kind), "vectors")
    some = rows.where("vec is not null and id is not null")
    heads = written(some.groupBy("digest").agg(F.min("id").alias("head"), F.count("*").alias("n")), "heads")
    reps = written(
        some.join(heads, "digest").where("id = head").groupBy("id", "digest").agg(F.any_value("vec").alias("vec"), F.any_value("n").alias("n"))
        .select("id", "n", "vec"), "reps")
    shared = min(shared, near, 3)  # a list's key holds the places of three pivots
    index = written(_indexed(reps, choose_pivots(reps, kind, reps.count()), kind, near, shared), "index")
    posts = index.select("id", F.explode("keys").alias("key"))
    sizes = written(posts.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("bigint")), "sizes")
    dealt = (posts.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("chunks")))
             .select("id", "key", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("other"))
             .select("id", "key", "own", (F.col("own") != F.col("other")).alias("mixed"), F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g")))
    lists = dealt.join(index.select("id", "n", "vec", "near"), "id").select("g", "key", "own", F.col("mixed").alias("cross"), "id", "n", "vec", "near")
    found = written(_links(lists, kind, cosine, shared), "links")
    component = written(components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "head"), "component")
    links = written(found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "head"), "counts")
    own = heads.select("digest", "head", "n").join(links, "head", "left").join(component, "head", "left").select(
        "digest", "head", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "head").alias("component"))
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(written(own, "own"), "digest", "left")
    component_id = F.coalesce("component", "id")
    return out.select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))
