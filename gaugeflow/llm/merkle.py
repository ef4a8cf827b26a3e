"""Merkle manifest of a table: postorder traversal of aligned blocks, level by level of blocks.

A row is a leaf. Leaves are numbered within their group (a language) in one range sort; `arity ** levels` consecutive leaves make a
block, and one recursive traversal of a block returns its digest and, while it unwinds, appends the siblings met on the way to the
leaves below. The blocks' roots are the nodes of the next traversal, until one node a group is left; those, in order, are traversed in the
same way to the root of all. Siblings met above are joined down to the blocks below.

H is the lowercase hex SHA-256 of its inputs in a row, digests as hex text. A leaf is H of its fields, each `-` if null, else its
UTF-8 byte count, a colon and its text. A run of fewer than `arity` nodes, even of one, has a parent of its own; a lone leaf is its group's root.

No task holds more than one block. The driver holds the number of levels only. Tables between the steps are narrow and written.

Cases: an empty table has no rows; null ids come first; rows that repeat an id stand by their leaf, so that equal rows are neighbours and
any order of them gives the same digests; the null group comes first, then bytewise order. Columns that are no fields are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Levels of a block: with arity 2, 1024 leaves.
LEVELS = 10


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields, each with its length."""
    texts = [f.cast("string") for f in fields]
    return _digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with `at`, each row's place from 0 within its group, and `total`, the group's rows. One range sort; what crosses
    partitions is a row for each group and partition."""
    by = [F.col(c).asc_nulls_first() for c in group + order]
    place = F.monotonically_increasing_id()
    cur = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", place).withColumns({"_part": F.shiftright("_id", 33)}), "sorted")
    runs = cur.groupBy(*group, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part")
    runs = written(runs.withColumns({
        "_before": F.sum("_n").over(before) - F.col("_n"), "total": F.sum("_n").over(Window.partitionBy(*group))}), "runs")
    same = [cur[c].eqNullSafe(runs[c]) for c in [*group, "_part"]]
    out = cur.join(runs, same).select(*[cur[c] for c in df.columns], (cur["_id"] - runs["_first"] + runs["_before"]).alias("at"), runs["total"])
    return out


def _traversal(arity: int, levels: int, kept: list[str]):
    """For one block: each node with its siblings, two texts (left and right) a level, and the block's root."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        digests, at, total = table["digest"].to_pylist(), table["at"].to_pylist(), table["total"][0].as_py()
        height, left = 0, total
        while left > 1 and height < levels:
            height, left = height + 1, -(-left // arity)
        paths: list[list[str]] = [[] for _ in digests]

        def visit(lo: int, hi: int, h: int) -> str:
            if not h:
                return digests[lo]
            step = arity ** (h - 1)
            spans = [(s, min(s + step, hi)) for s in range(lo, hi, step)]
            found = [visit(s, e, h - 1) for s, e in spans]
            for k, (s, e) in enumerate(spans):
                pair = ["".join(found[:k]), "".join(found[k + 1 :])]
                for i in range(s, e):
                    paths[i] += pair
            return hashlib.sha256("".join(found).encode()).hexdigest()

        root = visit(0, len(digests), height)
        n, block = len(digests), at[0] // arity**levels
        none = {c: pa.nulls(1, table[c].type) for c in kept}
        columns = {
            "grp": [*table["grp"].to_pylist(), table["grp"][0].as_py()], "at": [*at, block], "total": [total] * n + [-(-total // arity**levels)],
            "digest": [*digests, root], "path": [*paths, []], "root": [False] * n + [True]}
        types = {"grp": pa.int64(), "at": pa.int64(), "total": pa.int64(), "digest": pa.string(), "path": pa.list_(pa.string()), "root": pa.bool_()}
        arrays = {c: pa.array(v, types[c]) for c, v in columns.items()} | {c: pa.concat_arrays([*table[c].chunks, none[c]]) for c in kept}
        return pa.table(arrays)

    return run


def climb(nodes: DataFrame, arity: int = 2, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """nodes(grp long, at, total, digest, more): every node with `path`, its siblings up to its group's root (for each level the digests left of
    it and those right of it), and (grp, digest) of the groups' roots."""
    size, kept = arity**levels, [c for c in nodes.columns if c not in ("grp", "at", "total", "digest")]
    most = nodes.agg(F.max("total")).first()[0] or 0
    fixed = "grp bigint, at bigint, total bigint, digest string, path array<string>, root boolean"
    tables, cur = [], nodes
    while True:
        own = kept if not tables else []
        more = "".join(f", `{c}` {nodes.schema[c].dataType.simpleString()}" for c in own)
        found = written(cur.groupBy("grp", F.floor(F.col("at") / size).alias("block")).applyInArrow(_traversal(arity, levels, own), fixed + more), "nodes")
        tables.append(found)
        cur, most = found.where("root").select("grp", "at", "total", "digest"), -(-most // size)
        if most <= 1:
            break
    roots = cur.select("grp", "digest")
    above = None
    for found in reversed(tables):
        here = found.where("not root").drop("root")
        if above is not None:
            up = above.select(F.col("grp").alias("_g"), F.col("at").alias("_b"), F.col("path").alias("_up"))
            here = here.join(up, (F.col("grp") == F.col("_g")) & (F.floor(F.col("at") / size) == F.col("_b"))).withColumn("path", F.concat("path", "_up")).drop("_g", "_b", "_up")
        above = here if found is tables[0] else written(here.select("grp", "at", "path"), "paths")
    return above, roots


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    levels = F.sequence(F.lit(0), F.greatest(F.size(path) - 2, F.lit(0)), F.lit(2))
    return F.aggregate(levels, leaf, lambda acc, i: F.when(F.size(path) > 0, _digest(F.concat(F.get(path, i), acc, F.get(path, i + 1)))).otherwise(acc))


def manifest(df: DataFrame, id_col: str, group_col: str, fields: list[str], changed: dict[str, Column] | None = None, arity: int = 2, levels: int = LEVELS) -> DataFrame:
    """(id, group, leaf, subroot, root, path, changed_leaf) of each row: fields make the leaf; changed holds other values of some
    fields, and changed_leaf is the leaf with them, null where it is the same."""
    changed = changed or {}
    other = leaf_digest([changed.get(c, F.col(c)) for c in fields])
    touched = F.lit(False)
    for c, v in changed.items():
        touched |= ~F.col(c).cast("string").eqNullSafe(v.cast("string"))
    rows = written(df.select(
        F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("name"), leaf_digest([F.col(c) for c in fields]).alias("digest"),
        F.when(touched, other).alias("changed_leaf")), "leaves")
    ranked = written(numbered(rows, ["name"], ["id", "digest"]), "ranked")
    names = written(numbered(ranked.where("at = 0").select("name", F.lit(0).cast("bigint").alias("grp")), ["grp"], ["name"])
                    .select("name", F.col("at").alias("grp"), F.col("total").alias("groups")), "names")
    leaves = written(ranked.join(names.withColumnRenamed("name", "_n"), ranked["name"].eqNullSafe(F.col("_n"))).select("grp", "at", "total", "digest", "id", "name", "changed_leaf"), "placed")
    below, subroots = climb(leaves, arity, levels)
    tops = subroots.join(names, "grp").select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("at"), F.col("groups").alias("total"), "digest")
    over, root = climb(tops, arity, levels)
    up = written(over.select(F.col("at").alias("_grp"), F.col("digest").alias("subroot"), F.col("path").alias("_up")).crossJoin(root.select(F.col("digest").alias("root"))), "tops")
    out = below.join(up, F.col("grp") == F.col("_grp")).select(
        F.col("id").alias(id_col), F.col("name").alias(group_col), F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "_up").alias("path"), "changed_leaf")
    for t in (rows, ranked):
        dropped(t)
    return out


def proof_digest(path: Column) -> Column:
    """H of the siblings, level by level, left to right."""
    return _digest(F.array_join(path, ""))


def verified_against(found: DataFrame) -> DataFrame:
    """manifest() rows with folded_root, from the changed leaf where there is one, and whether it is the root."""
    out = found.withColumn("folded_root", folded(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
