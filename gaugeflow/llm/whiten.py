"""Whitening of embeddings: Chan's merging of counts, means and centred scatters (Chan, Golub and LeVeque 1979).

Entries are cut to whole steps, x = floor(scale * c) + offset. The fit list holds each distinct x vector once. Every partition of it
keeps, for each block of rows, count, exact sums, mean and scatter about the mean, and two such states merge by
`scatter + scatter' + outer(d, d) n n' / (n + n')` with d the difference of means; treeReduce merges those of the partitions. The driver
takes the eigenvectors of the covariance (divisor n), and a second pass over the fit list runs the same merging on the whitened rows,
whose covariance must be the identity. A third pass whitens every row.

A state takes 8 (d * d + 2 d) bytes for vectors of d entries; nothing else reaches the driver or is sent to tasks. Equal vectors fold before the fit.

Cases: rows whose vector is null or holds null or non-finite entries are left out, and so are empty vectors, which have no components; vectors of
different lengths have models of their own; rows with a null or repeated id stay. A component whose variance is not above rounding
(fewer distinct vectors than dimensions) has a null `whitened`, and takes no part in identity_error; `explained` is null where all
vectors are equal. An entry beyond 2**52 steps counts as that. `deviation` is exact, and null where it exceeds a long.
An empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, written

_MOST = 2.0**52
_BLOCK = 2048
_KINDS = ("<i2", "<i4", "<i8")


def _packed(steps: np.ndarray) -> bytes:
    """A vector's steps in the narrowest integers that hold them, so that equal vectors are equal bytes."""
    far = int(np.abs(steps).max())
    kind = next(k for k, kind in enumerate(_KINDS) if far <= np.iinfo(kind).max)
    return bytes([kind]) + steps.astype(_KINDS[kind]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, _KINDS[raw[0]], offset=1).astype(np.int64)


def _by_length(vectors: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, steps) of the vectors of each length, in blocks."""
    groups: dict[int, list[int]] = {}
    rows = [_unpacked(v) for v in vectors]
    for i, row in enumerate(rows):
        groups.setdefault(len(row), []).append(i)
    for length, places in groups.items():
        for at in range(0, len(places), _BLOCK):
            part = places[at : at + _BLOCK]
            yield length, np.array(part), np.stack([rows[i] for i in part])


def stepped(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, vec): vec holds floor(scale * c) of the entries, packed, of each row that can be whitened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                v, raw = x.values, None
                if v is not None and len(v) and not v.null_count:
                    a = v.cast(pa.float64()).to_numpy(zero_copy_only=False)
                    if np.isfinite(a).all():
                        with np.errstate(over="ignore"):
                            raw = _packed(np.clip(np.floor(scale * a), -_MOST, _MOST).astype(np.int64))
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>")), run, f"id {kind}, vec binary").where("vec is not null")


@dataclass
class State:
    """Count, exact sums (Python integers; floats on the second pass), mean and scatter about it."""

    n: int
    sums: list
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> State:
        wide = rows.dtype == np.int64 and len(rows) and float(np.abs(rows).max()) * len(rows) >= 2.0**62
        sums = [sum(map(int, c)) for c in rows.T] if wide else rows.sum(0).tolist()
        mean = np.array([s / len(rows) for s in sums], np.float64)
        centred = rows - mean
        return State(len(rows), sums, mean, centred.T @ centred)

    def merged(self, other: State) -> State:
        n = self.n + other.n
        d = other.mean - self.mean
        sums = [a + b for a, b in zip(self.sums, other.sums)]
        mean = np.array([s / n for s in sums], np.float64)
        return State(n, sums, mean, self.scatter + other.scatter + np.outer(d, d) * (self.n * other.n / n))


def merge_states(a: dict[int, State], b: dict[int, State]) -> dict[int, State]:
    """The states of two sets of rows as one, for each length of vectors."""
    out = dict(a)
    for length, state in b.items():
        out[length] = out[length].merged(state) if length in out else state
    return out


def _states(fit: DataFrame, rows_of) -> dict[int, State]:
    """Merged states of rows_of(length, steps) over the whole fit list."""

    def partition(rows) -> Iterator[dict[int, State]]:
        found: dict[int, State] = {}
        batch: list[bytes] = []

        def fold() -> None:
            nonlocal found
            for length, _, steps in _by_length(batch):
                if (part := rows_of(length, steps)) is not None:
                    found = merge_states(found, {length: State.of(part)})
            batch.clear()

        for row in rows:
            batch.append(bytes(row.vec))
            if len(batch) == _BLOCK:
                fold()
        fold()
        yield found

    rdd = fit.select("vec").rdd.mapPartitions(partition)
    return rdd.treeReduce(merge_states, 3) if rdd.getNumPartitions() else {}


@dataclass
class Model:
    """Of one vector length: n fitted vectors, sums of their steps, all eigenvalues (falling), and the kept components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    @property
    def firm(self) -> np.ndarray:
        """Which of the kept components have a variance above rounding."""
        kept = self.values[: self.vectors.shape[1]]
        return kept > max(self.values[0], 0.0) * len(self.values) * 1e-14 if len(kept) else np.zeros(0, bool)

    def whitened(self, steps: np.ndarray) -> np.ndarray:
        """Components of rows of steps; NaN where there is no variance."""
        mean = np.array([s / self.n for s in self.sums])
        kept = self.values[: self.vectors.shape[1]]
        return ((steps - mean) @ self.vectors) / np.sqrt(np.where(self.firm, kept, np.nan))

    def deviation(self, steps: np.ndarray) -> list[int | None]:
        """Sums over the entries of (n x - S)^2, exact; the offset cancels."""
        far = (steps.astype(np.float64) * self.n - np.array(self.sums, np.float64)) ** 2
        if max(far.sum(1).max(initial=0), float(np.abs(steps).max(initial=0)) * self.n) < 2.0**62 and all(abs(s) < 2**62 for s in self.sums):
            return ((steps * self.n - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((x * self.n - s) ** 2 for x, s in zip(row, self.sums)) for row in steps.tolist()]
        return [v if v < 2**63 else None for v in exact]


def fitted(fit: DataFrame, components: int) -> dict[int, Model]:
    """Models of the fit list, by vector length, with the identity verified in a second pass."""
    models: dict[int, Model] = {}
    for length, s in _states(fit, lambda _, steps: steps).items():
        values, vectors = np.linalg.eigh(s.scatter / s.n)
        values, vectors = values[::-1], vectors[:, ::-1][:, : min(components, length)]
        signs = np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        trace = float(np.trace(s.scatter / s.n))
        explained = [max(float(v), 0.0) / trace if trace > 0 else None for v in values[: vectors.shape[1]]]
        models[length] = Model(s.n, s.sums, values, vectors * signs, explained)

    def again(length: int, steps: np.ndarray) -> np.ndarray | None:
        firm = models[length].firm
        return models[length].whitened(steps)[:, firm] if firm.any() else None

    for length, s in _states(fit, again).items():
        models[length].identity_error = float(np.abs(s.scatter / s.n - np.eye(len(s.mean))).max())
    return models


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: float = 64.0) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component. The offset of x cancels in all of them."""
    rows = written(stepped(df, id_col, vector_col, scale), "steps")
    models = fitted(written(rows.select("vec").distinct(), "fit"), components)
    sent = df.sparkSession.sparkContext.broadcast(models)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, places, steps in _by_length(batch.column("vec").to_pylist()):
                m = sent.value[length]
                white = m.whitened(steps)
                k = white.shape[1]
                take = np.repeat(places, k)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(take)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(places))),
                    pa.array([m.n] * len(take), pa.int64()), pa.array([d for d in m.deviation(steps) for _ in range(k)], pa.int64()),
                    pa.array(white.ravel(), pa.float64(), from_pandas=True), pa.array(m.explained * len(places), pa.float64()),
                    pa.array([m.identity_error] * len(take), pa.float64())], names=names)

    out = map_batches(rows, run, f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
