"""Near-duplicate documents by HyperMinHash (Yu and Weber 2017).

A document's set holds its distinct k-word shingles, hashed to 64 bits. The first bits of a hash choose a
register; of the least remainder seen, the register keeps the count of leading zeros and a few mantissa
bits. Documents with equal word sequences fold into one representative; documents with equal sets of hashes are confirmed on full sets.
Bands of registers retrieve candidates: each band's least document is tied to the others of its bucket (stars), a Jaccard estimate
corrected for chance collisions of registers discards far pairs, and full sets verify the rest. Stars leave in a bucket only pairs
of different components untried. For those the documents of open buckets are posted under the rarest shingles of their sets: two
sets at the threshold share one of them (prefix filter, Bayardo et al. 2007), at places early enough in both (Xiao et al. 2008).
Documents that lists still leave possible together form a block. Posting lists and blocks are cut in chunks of bounded size; each pair of
chunks of a block intersects whole sets where it lies and gives a spanning forest only, so
that no pair of different components is lost, and what a list or block gives grows with its members, not with its pairs.

Links (similarity) are exact; a pair at Jaccard 0.8 shares no band of 6 registers with probability
(1 - 0.8 ** 6) ** 42, about 3e-6.

Cases: null and wordless texts have empty sets, which link with nothing; fewer words than a shingle are one shingle;
rows with a null id stay, unlinked, with a null component and kept; rows that repeat an id are one node,
each with its own set size. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, map_batches, small_batches, sorted_groups, written

REGISTER_BITS = 8
MANTISSA_BITS = 10
BAND = 6
EMPTY = 0xFFFF
#: Star rounds before the rest goes by posting lists; members and shingles in a chunk of a list or block.
STARS = 2
BLOCK = 512
BLOCK_SHINGLES = 1 << 18
#: Counters of the sketch that orders shingles by rarity. Any order is exact; a better one gives shorter lists.
COUNTERS = 1 << 20
#: Standard deviations that an estimate may lie below the threshold before the pair is dropped unverified.
SLACK = 5.0

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Runs of [^\\x20\\x09-\\x0D] after A-Z become a-z."""
    return raw.translate(_LOWER).split() if raw else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0xD6E8FEB86659FD93
#: Bytes of text that are hashed at once, beyond the last word.
STRETCH = 1 << 18
with np.errstate(over="ignore"):
    _CODE = _mixed(np.frombuffer(_LOWER, np.uint8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _power(sign: int, n: int) -> np.ndarray:
    """The first n powers of _STEP or of its inverse modulo 2 ** 64."""
    if len(_powers[sign]) < n:
        base = np.full(n, pow(_STEP, sign, 1 << 64), np.uint64)
        base[0] = 1
        _powers[sign] = np.cumprod(base)
    return _powers[sign][:n]


def _hashed(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First place and 64-bit hash of each word: differences of running sums of byte codes times powers."""
    code = np.frombuffer(joined, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[code], prepend=True, append=True))
    first, last = edge[::2], edge[1::2]
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(_CODE[code] * _power(1, len(code)), out=total[1:])
    h = (total[last] - total[first]) * _power(-1, len(code))[first]
    return first, _mixed(h + (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _stretches(raw: bytes) -> Iterator[bytes]:
    """raw cut at white space in stretches of about STRETCH bytes."""
    at = 0
    while len(raw) - at > STRETCH:
        end = at + STRETCH
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(raws: list[bytes | None]) -> list[np.ndarray]:
    """A hash of each word of each text."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush():
        nonlocal held, size
        if held:
            first, h = _hashed(b" ".join(held))
            ends = np.cumsum([len(x) + 1 for x in held])
            out.extend(np.split(h, np.searchsorted(first, ends[:-1])))
        held, size = [], 0

    for raw in raws:
        raw = raw or b""
        if len(raw) > STRETCH:
            flush()
            out.append(np.concatenate([_hashed(x)[1] for x in _stretches(raw)]))
            continue
        held.append(raw)
        size += len(raw) + 1
        if size >= STRETCH:
            flush()
    flush()
    return out


def shingled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each of the k-word shingles, from hashes of the words."""
    n = len(h) - k + 1
    s = np.full(max(n, 0), k, np.uint64)
    for i in range(k if n > 0 else 0):
        s = _mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i])
    return s


def shingle_hashes(raw: bytes | None, k: int, words: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a whole text; words, if given, are the hashes of its words."""
    h = word_hashes([raw])[0] if words is None else words
    s = np.sort(shingled(h, min(k, len(h)))) if len(h) else h
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def shingle_set(raw: bytes, k: int) -> set:
    words = words_of(raw)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the least remainder in each bucket; hashes are sorted."""
    buckets = np.arange(1 << REGISTER_BITS, dtype=np.uint64) << np.uint64(64 - REGISTER_BITS)
    at = np.searchsorted(hashes, buckets)
    full = at < len(hashes)
    least = np.zeros(len(buckets), np.uint64)
    least[full] = hashes[at[full]]
    full &= least >> np.uint64(64 - REGISTER_BITS) == buckets >> np.uint64(64 - REGISTER_BITS)
    rest = ((least << np.uint64(REGISTER_BITS)) >> np.uint64(REGISTER_BITS + 8)).astype(np.float64)  # 48 bits, exact
    part, exponent = np.frexp(np.maximum(rest, 1.0))
    mantissa = ((part * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    out = (48 - exponent) << MANTISSA_BITS | mantissa
    return np.where(full, out, EMPTY).astype(np.uint16)


def _borrowing() -> np.ndarray:
    """For each register, the registers it borrows from while it is empty, in order of trial."""
    place = np.arange(1 << REGISTER_BITS, dtype=np.uint64)
    turn = np.arange(TRIALS, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        return (_mixed(place * np.uint64(0x9E3779B97F4A7C15) + turn * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)) >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)


TRIALS = 1024
_BORROW = _borrowing()


def densified(regs: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first filled one in their order of trial (Shrivastava 2017), so that
    two sets agree in any register with probability equal to their similarity, however small they are."""
    full = regs != EMPTY
    empty = np.flatnonzero(~full)
    out = regs.copy()
    for trials in (64, TRIALS):
        if not len(empty) or not full.any():
            break
        tried = full[_BORROW[:trials, empty]]
        first, found = tried.argmax(0), tried.any(0)
        out[empty[found]] = regs[_BORROW[first[found], empty[found]]]
        empty = empty[~found]
    return out


def band_keys(regs: np.ndarray) -> list[int]:
    """A key for each band of densified registers."""
    dense = densified(regs)
    return [xxhash.xxh3_64_intdigest(dense[b * BAND : (b + 1) * BAND].tobytes(), seed=b + 1) - (1 << 63) for b in range(len(regs) // BAND)]


def passes_estimate(same: np.ndarray, filled: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's Jaccard estimate, less the collisions expected by chance, may reach threshold. same: registers that
    are filled and equal; filled: registers that either fills. The filled registers are a sample without replacement
    of the union, whose size follows from the set sizes at the threshold; hence the finite-population factor."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    ratio = large / np.maximum(small, 1)
    chance = 0.169919487159739 * 2.0 ** -MANTISSA_BITS * (4 * ratio / (1 + ratio) ** 2) * filled
    union = (n_a + n_b) / (1 + threshold)
    share = np.clip(1 - filled / np.maximum(union, 1), 0.02, 1.0)
    slack = SLACK * np.sqrt(threshold * (1 - threshold) * share / np.maximum(filled, 1)) + 2 / np.maximum(filled, 1)
    return (np.maximum(same - chance, 0) / np.maximum(filled, 1) >= threshold - slack) & (small >= threshold * large)


def sketch(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, n, digest, words, regs, bands) for each row: size and digest of the set, and a digest of the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, digest, words, regs, bands = [], [], [], [], []
                raws = part.column(1).to_pylist()
                for raw, own in zip(raws, word_hashes(raws)):
                    h = shingle_hashes(raw, shingle, own)
                    r = registers(h)
                    n.append(len(h))
                    digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    words.append(hashlib.blake2b(b" ".join(words_of(raw)), digest_size=16).digest())
                    regs.append(r.tobytes())
                    bands.append(band_keys(r) if len(h) else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, words, regs)), pa.array(bands, pa.list_(pa.int64()))],
                    names=["id", "n", "digest", "words", "regs", "bands"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary"))
    return map_batches(rows, run, "id bigint, n bigint, digest binary, words binary, regs binary, bands array<bigint>")


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, 1 << REGISTER_BITS)


def _estimated(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose estimate may reach the threshold."""
    side = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            if batch.num_rows:
                a, b = _regs(batch.column("r_a")), _regs(batch.column("r_b"))
                same, filled = ((a == b) & (a != EMPTY)).sum(1), ((a != EMPTY) | (b != EMPTY)).sum(1)
                ok = passes_estimate(same, filled, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    return map_batches(both, run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, set] = {}
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("t_a"), batch.column("t_b")):
                x, y = x.as_py(), y.as_py()
                if y not in memo:
                    if len(memo) >= 16:
                        memo.clear()
                    memo[y] = shingle_set(y, shingle)
                own, other = shingle_set(x, shingle), memo[y]
                common = len(own & other)
                ok.append(100 * common >= percent * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    some = texts.join(ids, "id", "left_semi")  # only texts that take part are shuffled, where Spark finds ids small enough to broadcast
    side = lambda x: some.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    out = written(map_batches(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b"), run, "a bigint, b bigint"), "links")
    dropped(ids)
    return out


def _hashed_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """rows(id, cluster, component, text) as (id, cluster, component, n, set): sorted hashes, 8 bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raws = batch.column("text").to_pylist()
            sets = [shingle_hashes(raw, shingle, own) for raw, own in zip(raws, word_hashes(raws))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("cluster"), batch.column("component"), pa.array(map(len, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                names=["id", "cluster", "component", "n", "set"])

    return map_batches(rows.select("id", "cluster", "component", "text"), run, "id bigint, cluster bigint, component bigint, n bigint, set binary")


def _terms(cluster: int, raw: bytes) -> np.ndarray:
    """A set's hashes, mixed with the cluster."""
    with np.errstate(over="ignore"):
        return _mixed(np.frombuffer(raw, np.uint64) + _mixed(np.array([cluster], np.int64).view(np.uint64)))


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many sets hold the terms of each counter; COUNTERS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(COUNTERS, np.int64)
        for batch in small_batches(batches):
            found = [_terms(*x) % np.uint64(COUNTERS) for x in zip(batch.column("cluster").to_pylist(), batch.column("set").to_pylist())]
            if found:
                count += np.bincount(np.concatenate(found).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["counter", "count"])

    rows = map_batches(sets.select("cluster", "set"), run, "counter bigint, count bigint").groupBy("counter").agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[rows.column("counter").to_numpy()] = rows.column("count").to_numpy()
    return out


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(term, id, component, n, pos): the rarest terms of each set, as many as two sets at the threshold need to share one, and their places."""
    shared = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = []
            n = batch.column("n").to_numpy()
            for cluster, raw, size in zip(batch.column("cluster").to_pylist(), batch.column("set").to_pylist(), n.tolist()):
                t = _terms(cluster, raw)
                found.append(t[np.lexsort((t, shared.value[(t % np.uint64(COUNTERS)).astype(np.int64)]))[: size + percent * -size // 100 + 1]])
            if not found:
                continue
            sizes = np.array([len(x) for x in found])
            row = np.repeat(np.arange(len(found)), sizes)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [np.concatenate(found).view(np.int64), batch.column("id").to_numpy()[row], batch.column("component").to_numpy()[row], n[row], pos]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["term", "id", "component", "n", "pos"])

    return map_batches(sets, run, "term bigint, id bigint, component bigint, n bigint, pos bigint")


def _possible(comp: np.ndarray, n: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """Pairs i < j of different components whose sets may reach the threshold, where left shingles of each, from a shared one on, are all they can share."""
    reach = (100 + percent) * np.minimum(left[:, None], left) >= percent * (n[:, None] + n)
    return np.triu(reach & (comp[:, None] != comp), 1)


def _intersections(sets: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets; step values at a time."""
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.append(True, every[1:] != every[:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(every)))
    keep = np.repeat(count > 1, count)
    row, place = row[keep], (np.cumsum(new[keep]) - 1)
    out = np.zeros((len(sets), len(sets)), np.float32)  # exact up to 2 ** 24
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        a, b = np.searchsorted(place, (low, low + step))
        m = np.zeros((len(sets), step), np.float32)
        m[row[a:b], place[a:b] - low] = 1
        out += m @ m.T
    return out.astype(np.int32)


def _forest(i: np.ndarray, j: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Some of the pairs (i, j), at most a few for each component, that join what all of them join."""
    root, out = comp.copy(), []
    while True:
        cross = root[i] != root[j]
        i, j = i[cross], j[cross]
        if not len(i):
            return out
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        _, at = np.unique(high, return_index=True)  # each component takes one smaller than itself
        out += zip(i[at].tolist(), j[at].tolist())
        up = dict(zip(high[at].tolist(), low[at].tolist()))
        for label in sorted(up):
            up[label] = up.get(up[label], up[label])
        root = np.array([up.get(x, x) for x in root.tolist()])


def _by_prefix(rest: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """rest(key, id, component): the documents of open buckets. (a, b): pairs of different components that reach the threshold, enough to join all that do."""
    low = rest.groupBy("key").agg(F.min("id").alias("low"))
    cluster = written(components(rest.join(low, "key").select(F.col("id").alias("a"), F.col("low").alias("b"))), "cluster")
    own = written(rest.select("id", "component").distinct().join(cluster.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id"), "own")
    sets = written(_hashed_sets(texts.join(own, "id"), shingle), "sets")
    posts = written(_postings(sets, percent), "posts")
    mixed = written(_chunked(posts.groupBy("term"), "term"), "lists")

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "g"):
            ids, comp, n, left = (group.column(c).to_numpy() for c in ("id", "component", "n", "left"))
            may = _possible(comp, n, left, percent)
            some = ids[may.any(0) | may.any(1)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), some.min(initial=np.iinfo(np.int64).max)))], names=["a", "b"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "g"):
            ids, comp, n = (group.column(c).to_numpy() for c in ("id", "component", "n"))
            if comp.min() == comp.max():
                continue
            common = _intersections([np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()])
            near = _possible(comp, n, n, percent) & (100 * common >= percent * (n[:, None] + n - common))
            found = _forest(*np.nonzero(near), comp)
            if found:
                i, j = (ids[list(x)] for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(i, j)), pa.array(np.minimum(i, j))], names=["a", "b"])

    rows = _dealt(posts.join(mixed, "term").select("term", "id", "component", "n", (F.col("n") - F.col("pos")).alias("left"), "chunks"), "term")
    some = written(map_batches(rows.select("g", "id", "component", "n", "left"), narrowed, "a bigint, b bigint").distinct(), "possible")
    dropped(posts)
    block = written(components(some).select(F.col("node").alias("id"), F.col("component").alias("block")), "block")
    sizes = written(_chunked(block.join(sets.select("id", "component", "n"), "id").groupBy("block"), "block"), "sizes")
    rows = _dealt(block.join(sizes, "block").join(sets.select("id", "component", "n", "set"), "id"), "block")
    out = written(map_batches(rows.select("g", "id", "component", "n", "set"), joined, "a bigint, b bigint").where("a <> b").distinct(), "near")
    for old in (cluster, own, sets, mixed, some, block, sizes):
        dropped(old)
    return out


def _chunked(members, key: str) -> DataFrame:
    """(key, chunks) of the groups of members(id, component, n) that hold two components."""
    return (members.agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("shingles")).where("lo < hi")
            .select(key, F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("bigint").alias("chunks")))


def _dealt(members: DataFrame, key: str) -> DataFrame:
    """members(key, id, chunks, ...) with g, a pair of chunks; partitions are sorted by g."""
    own, other = F.pmod(F.xxhash64("id", key), F.col("chunks")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    both = members.withColumn("own", own).withColumn("other", other)
    return both.withColumn("g", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).repartition("g").sortWithinPartitions("g")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: the smallest id reachable by links of Jaccard >= percent / 100."""
    threshold = percent / 100
    sketches = written(sketch(df, id_col, text_col, shingle), "sketch")
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    some = sketches.where("n > 0 and id is not null")
    heads = written(some.groupBy("digest").agg(F.min(F.struct("id", "words")).alias("x"), F.count("*").alias("copies")).select("digest", F.col("x.id").alias("head"), F.col("x.words").alias("own"), "copies"), "heads")
    copies = written(some.select("id", "digest", "words").join(heads.where("copies > 1"), "digest").select("id", "head", (F.col("words") == F.col("own")).alias("equal")).where("id <> head"), "copies")
    reps = written(
        some.join(heads.select("digest", "head"), "digest").where("id = head")
        .groupBy("id", "digest").agg(F.any_value(F.struct("n", "regs", "bands")).alias("x")).select("id", "x.n", "x.regs", "x.bands"), "reps")
    nodes = written(sketches.select("id", "n"), "nodes")
    dropped(sketches)
    dropped(heads)
    long = reps.select("id", F.explode("bands").alias("key"))
    shared = written(long.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("size")).where("size > 1").drop("size"), "buckets")
    members = written(long.join(shared, "key").select("key", "id", "low"), "members")
    dropped(shared)
    tie = copies.select(F.col("id").alias("a"), F.col("head").alias("b"), "equal").distinct()
    links = [written(tie.where("equal").select("a", "b"), "links")]
    pairs = members.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    for turn in range(STARS + 1):
        near = written(_estimated(pairs, reps, threshold), "near") if turn < STARS else pairs
        # equal sets of other word sequences pass their estimate by themselves
        links.append(_verified(near if turn else near.unionByName(tie.where("not equal").select("a", "b")), texts, shingle, percent))
        dropped(near)
        if turn == STARS:
            break
        found = written(components(_all(links)), "component")
        placed = written(
            members.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "placed")
        open_ = written(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
            F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("low")).where("lo < hi"), "open")
        rest = written(placed.join(open_.select("key"), "key", "left_semi"), "rest")
        if rest.isEmpty():
            break
        if turn < STARS - 1:
            head = rest.select("key", F.col("id").alias("low"), F.col("component").alias("own")).join(open_.select("key", "low"), ["key", "low"])
            pairs = written(rest.join(written(head, "head"), "key").where("component <> own")
                     .select(F.greatest("id", "low").alias("a"), F.least("id", "low").alias("b")).distinct(), "pairs")
        else:
            dropped(reps)
            dropped(members)
            pairs = _by_prefix(rest, texts, shingle, percent)
        for old in (found, placed, open_, rest):
            dropped(old)
    found = components(_all(links)).withColumnRenamed("node", "id")
    out = nodes.join(written(found, "component"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, in the columns it had: the one with the smallest id. Rows that repeat an id leave one row;
    rows without an id all stay."""
    found = near_duplicates(df, id_col, text_col, shingle, percent).where(~F.col("kept")).select(id_col).distinct()
    left = df.join(written(found, "dropped"), id_col, "left_anti").select(*df.columns)
    once = left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return once.unionByName(left.where(F.col(id_col).isNull()))
