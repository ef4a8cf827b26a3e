"""Benchmark decontamination with suffix arrays over the training documents.

Each batch of a partition's documents is a shard: its words become ids of the benchmark's vocabulary (0 for any
other word and between documents), and the suffixes that could hold a window, i.e. begin a long enough
run of benchmark words, are sorted by their first words into a suffix array. Every suffix of every benchmark item is then binary-searched
in each shard. Hits on one diagonal join to the longest verbatim matches, with their places in both texts.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z become a-z. A window is `window` consecutive words of an
item; an item of fewer words is one window. The benchmark is read in blocks of bounded size; each block is
one map over the documents, so neither table is shuffled nor limited in size.

Cases: null or wordless texts have no words and no hits; wordless items match nothing; items with a null
id mark words but are not listed; repeated items are listed once. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_batches

WINDOW = 10
#: Bytes of benchmark text in a block; a block is held by every worker.
BLOCK_BYTES = 8 << 20
#: Words in a shard, beyond its last document.
SHARD_WORDS = 1 << 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_TABLE).split() if raw else []


class Queries:
    """The windows of one block of the benchmark, as keys to search for."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        self.window, self.vocab, self.names = window, {}, []
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            k = len(self.names)
            self.names.append(None if name is None else str(name))
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], ">u4")
            length = min(window, len(ids))
            for p in range(len(ids) - length + 1):
                self.places.setdefault(ids[p : p + length].tobytes(), []).append((k, p))
        self.keys = sorted(self.places)
        self.lengths = np.array([len(k) // 4 for k in self.keys], np.int64)
        full = 4 * window
        self.low = np.array([k.ljust(full, b"\x00") for k in self.keys], f"S{full}")
        self.high = np.array([k.ljust(full, b"\xff") for k in self.keys], f"S{full}")
        self.least = int(self.lengths.min()) if self.keys else window

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (place in ids, window) where a window occurs."""
        n, w = len(ids), self.window
        zero = np.flatnonzero(ids == 0)
        stops = np.append(zero, n)
        run = stops[np.searchsorted(zero, np.arange(n))] - np.arange(n)
        starts = np.flatnonzero(run >= self.least)
        if not len(starts) or not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        padded = np.concatenate([ids, np.zeros(w, ids.dtype)]).astype(">u4")
        suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, w)[starts]).view(f"S{4 * w}").ravel()
        order = np.argsort(suffix, kind="stable")
        array, suffix = starts[order], suffix[order]
        a = np.searchsorted(suffix, self.low, "left")
        b = np.searchsorted(suffix, self.high, "right")
        count = np.maximum(b - a, 0)
        which = np.repeat(np.arange(len(self.keys)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = array[np.repeat(a, count) + offset]
        fits = run[place] >= self.lengths[which]
        return place[fits], which[fits]


MATCHES = "array<struct<item:string,start:bigint,item_start:bigint,words:bigint>>"


def _shards(raw: list[bytes | None], vocab: dict[bytes, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last document of a shard, its ids, and where each of its documents begins."""
    first, parts, at, begins = 0, [], 0, []
    for i, text in enumerate(raw):
        words = words_of(text)
        begins.append(at)
        get = vocab.get
        parts.append(np.fromiter((get(w, 0) for w in words), np.uint32, len(words)))
        parts.append(np.zeros(1, np.uint32))
        at += len(words) + 1
        if at >= SHARD_WORDS:
            yield first, i + 1, np.concatenate(parts), np.array(begins)
            first, parts, at, begins = i + 1, [], 0, []
    if begins:
        yield first, len(raw), np.concatenate(parts), np.array(begins)


def _hits(q: Queries, raw: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[dict]]]:
    """Of each document: words; hit stretches [start, end) of words; longest matches with every item."""
    counts: list[int] = []
    hit: list[list[tuple[int, int]]] = []
    matches: list[list[dict]] = []
    for first, last, ids, begins in _shards(raw, q.vocab):
        place, which = q.search(ids)
        order = np.lexsort((which, place))
        place, which = place[order], which[order]
        doc = np.searchsorted(begins, place, "right") - 1
        ends = np.append(begins[1:], len(ids)) - 1
        counts += (ends - begins).tolist()
        cut = np.searchsorted(doc, np.arange(last - first + 1))
        for d in range(last - first):
            a, b = cut[d], cut[d + 1]
            if a == b:
                hit.append([])
                matches.append([])
                continue
            spans: list[list[int]] = []
            open_: dict[tuple[int, int], dict] = {}
            done: list[dict] = []
            for p, k in zip((place[a:b] - begins[d]).tolist(), which[a:b].tolist()):
                length = int(q.lengths[k])
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], p + length)
                else:
                    spans.append([p, p + length])
                for item, at in q.places[q.keys[k]]:
                    m = open_.get((item, p - at))
                    if m and p + length == m["start"] + m["words"] + 1:
                        m["words"] += 1
                    else:
                        m = open_[item, p - at] = {"item": q.names[item], "start": p, "item_start": at, "words": length}
                        done.append(m)
            hit.append([(x, y) for x, y in spans])
            matches.append(done)
    return counts, hit, matches


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> Iterator[Queries]:
    """The benchmark in blocks of at most block_bytes (or one item), one at a time on the driver."""
    items, size, some = [], 0, False
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator():
        if items and size + len(row[1] or b"") > block_bytes:
            yield Queries(items, window)
            items, size, some = [], 0, True
        items.append((row[0], bytes(row[1]) if row[1] is not None else None))
        size += len(row[1] or b"")
    if items or not some:
        yield Queries(items, window)


def _pass(df: DataFrame, q: Queries, names: list[str], text: str, out: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(q)
    kinds = df.schema
    schema = f"n bigint, hit array<struct<start:bigint,end:bigint>>, matches {MATCHES}"
    at, kind = names.index(text), arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(at).cast(pa.binary()).to_pylist()
            n, hit, found = _hits(shared.value, raw)
            own = pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in h] for h in hit], kind.field(1).type), pa.array(found, kind.field(2).type)],
                fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, out])

    from pyspark.sql.types import StructType, _parse_datatype_string

    return map_batches(df, run, StructType([*kinds.fields]).add(out, _parse_datatype_string(schema)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, matches) for each document: its words, how many of them lie in an occurrence of a
    window, the items (sorted as strings) whose windows occur, and the longest verbatim matches with places in words."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    passes = []
    for k, q in enumerate(benchmark_blocks(benchmark, item_id_col, item_text_col, block_bytes, window)):
        df = _pass(df, q, df.columns, "text", f"b{k}")
        passes.append(f"b{k}")
    spans = F.array_sort(F.flatten(F.array(*[F.col(b)["hit"] for b in passes])))
    union = F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["start"]))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")))
    found = F.flatten(F.array(*[F.col(b)["matches"] for b in passes]))
    items = F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda m: m["item"]), lambda i: i.isNotNull())))
    return df.select(F.col("id").alias(id_col), F.col("b0")["n"].alias("n_words"), union["n"].alias("n_hit"), items.alias("items"), found.alias("matches"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, in the columns they had; null texts stay."""
    names = docs.columns
    df = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = f"c{names.index(text_col)}"
    for q in benchmark_blocks(benchmark, item_id_col, item_text_col, block_bytes, window):
        df = _filter(df, q, df.columns.index(at))
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _filter(df: DataFrame, q: Queries, at: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, hit, _ = _hits(shared.value, batch.column(at).cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array([not h for h in hit], pa.bool_()))

    return map_batches(df, run, df.schema)
