"""Toxicity scores by a factorization machine (Rendle 2010) over hashed terms.

Terms are a text's distinct words and their first letters, hashed into 2 ** HASH_BITS places. The score is the logistic of
w0 + sum of w_i + the sum over pairs of <v_i, v_j>, so that a pair of terms, such as an insult with
a group mention, can weigh more than both alone. Two tests choose the terms, so that an uninformative term never moves a score, however long
the text: a term tells alone if chance explains its share of positive texts in fewer than one of all places (Chernoff's bound); a term tells in
a pair if chance does not explain, among all pairs, the share of positive texts that hold both, given the scores of the terms that tell alone.
Candidates for pairs come from a random projection of the residuals' co-moments (as a factorization machine's own
gradient would show them), the PAIR_TERMS strongest. Linear weights follow FTRL-proximal (McMahan et al. 2013), latent vectors of all chosen terms AdaGrad.

Training takes a sample of at most about MAX_ROWS labelled rows and MAX_BYTES of their terms, drawn by a hash of the id; the model
is bounded with it. Of rows with one label whose terms agree to 0.8 or more (found by bands of minima) the one with the smallest id teaches, as copies would vote
for every term they share. Scoring is a narrow map over whole texts.

Cases: null and wordless texts get the bias' score; without labelled rows the bias is log-odds of 1/2 of a case, a low
score; rows without a label or without an id teach nothing; repeated rows teach once. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_batches, written

HASH_BITS = 22
#: Labelled rows in a training sample.
MAX_ROWS = 20_000
#: Bytes of their terms (4 each), in expectation; one text has 2 ** HASH_BITS at most.
MAX_BYTES = 96 << 20
#: Texts that a term of a pair occurs in, at least; directions of the projection; candidates that it may pass on.
PAIR_TEXTS, PROJECTED, PAIR_TERMS = 8, 64, 512
FACTORS = 4
EPOCHS = 15
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")
_MEMO = 200_000


def chunk_terms(chunk: str) -> list[int]:
    """Places of the terms in a stretch of text without white space."""
    out = []
    for word in _WORD.findall(chunk):
        for term in (f"w{word}", f"4{word[:4]}", f"5{word[:5]}"):
            out.append(xxhash.xxh32_intdigest(term) & (1 << HASH_BITS) - 1)
    return out


class _Terms(dict):
    def __init__(self, keep: frozenset[int] | None = None):
        super().__init__()
        self.keep = keep

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) >= _MEMO:
            self.clear()
        found = tuple(t for t in chunk_terms(chunk) if self.keep is None or t in self.keep)
        if len(chunk) <= 64:
            self[chunk] = found
        return found


class FactorizationMachine:
    def __init__(self, bias: float, places: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        keep = (weights != 0) | (vectors != 0).any(1)
        self.bias, self.places, self.weights, self.vectors = bias, places[keep], weights[keep], vectors[keep]
        self.at: dict[int, int] | None = None
        self.memo: _Terms | None = None

    def __getstate__(self):
        return {**self.__dict__, "at": None, "memo": None}

    def score(self, text: str | None) -> float:
        if self.memo is None:
            self.at = {int(p): i for i, p in enumerate(self.places)}
            self.memo = _Terms(frozenset(self.at))
        z, get = self.bias, self.memo.__getitem__
        found = sorted({self.at[t] for terms in map(get, set((text or "").lower().split())) for t in terms})
        if found:
            v = self.vectors[found]
            total = v.sum(0)
            z += float(self.weights[found].sum() + 0.5 * (total @ total - (v * v).sum()))
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def _distinct(terms: list[np.ndarray], labels: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The first text of each group of one label whose terms agree to 0.8 or more."""
    seeds = np.arange(1, 25, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
    kept: dict[tuple, list[int]] = {}
    keep = []
    for i, t in enumerate(terms):
        least = (t.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) * seeds >> np.uint64(20)).min(0) if len(t) else seeds
        bands = [(labels[i], b, *least[b : b + 3].tolist()) for b in range(0, 24, 3)]
        tried = {k for band in bands for k in kept.get(band, ())}
        if any(5 * (c := len(np.intersect1d(t, terms[k], assume_unique=True))) >= 4 * (len(t) + len(terms[k]) - c) for k in tried):
            continue
        keep.append(i)
        for band in bands:
            kept.setdefault(band, []).append(i)
    return [terms[i] for i in keep], labels[keep]


def _away(hits: np.ndarray, count: np.ndarray, rate: np.ndarray | float) -> np.ndarray:
    """Chernoff's bound: minus the log of the chance that hits among count texts of a mean rate lie so far from it."""
    p = np.clip(hits / np.maximum(count, 1), 1e-12, 1 - 1e-12)
    return count * (p * np.log(p / rate) + (1 - p) * np.log((1 - p) / (1 - rate)))


def _telling(count: np.ndarray, hits: np.ndarray, rate: float) -> np.ndarray:
    """Whether each term is positive more often than chance explains in one of all of them."""
    return (_away(hits, count, rate) > np.log(max(len(count), 2))) & (hits > rate * count)


def _telling_pairs(rows: list[np.ndarray], size: int, labels: np.ndarray, scores: np.ndarray, seed: int) -> np.ndarray:
    """Of size terms, those that tell in a pair beyond the scores; rows are each text's terms."""
    left = labels - scores
    signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (size, PROJECTED))
    moment, variance = np.zeros((size, PROJECTED), np.float32), np.zeros(size)
    for k, e, q in zip(rows, left, scores * (1 - scores)):
        own = signs[k]
        moment[k] += np.float32(e) * (own.sum(0) - own)
        variance[k] += q * max(len(k) - 1, 0)
    excess = (moment.astype(float) ** 2).mean(1) / np.maximum(variance, 1e-9)
    strong = np.argsort(-excess, kind="stable")[:PAIR_TERMS]
    strong = strong[excess[strong] > 1 + 3 * (2 / PROJECTED) ** 0.5]
    if not len(strong):
        return strong
    texts = np.repeat(np.arange(len(rows)), [len(k) for k in rows])
    flat = np.concatenate(rows)
    order = np.argsort(flat, kind="stable")
    begin = np.searchsorted(flat[order], np.arange(size + 1))
    bar, found = 2 * np.log(size), set()
    for i in strong.tolist():
        where = texts[order[begin[i] : begin[i + 1]]]
        sizes = [len(rows[t]) for t in where.tolist()]
        other = np.concatenate([rows[t] for t in where.tolist()])
        count, hits, mean = (np.bincount(other, np.repeat(x[where], sizes), size) for x in (np.ones(len(rows)), labels, scores))
        rate = np.clip(mean / np.maximum(count, 1), 1e-6, 1 - 1e-6)
        tells = (_away(hits, count, rate) > bar) & (count >= PAIR_TEXTS)
        tells[i] = False
        if tells.any():
            found |= {i, *np.flatnonzero(tells).tolist()}
    return np.array(sorted(found), np.int64)


def _descend(rows: list[np.ndarray], labels: np.ndarray, bias: float, odds: np.ndarray, factors: int, epochs: int, rng: np.random.Generator) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors; odds are the first weights. Without factors it is the linear model."""
    alpha, beta, l1, l2, step, decay = 0.3, 1.0, 0.3, 0.01, 0.05, 1e-3
    z, g2 = -(odds * (beta / alpha + l2) + np.sign(odds) * l1), np.zeros(len(odds))
    v, gv = rng.normal(0, 0.05, (len(odds), factors)), np.full((len(odds), factors), 1e-2)
    bias_g = 1.0

    def weights(k):
        zk = z[k]
        return np.where(np.abs(zk) <= l1, 0.0, -(zk - np.sign(zk) * l1) / ((beta + np.sqrt(g2[k])) / alpha + l2))

    labels = labels.tolist()
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            k = rows[i]
            score = bias
            if len(k):
                w, vk = weights(k), v[k]
                total = vk.sum(0)
                score += w.sum() + 0.5 * (total @ total - (vk * vk).sum())
            g = 1 / (1 + math.exp(-min(max(score, -500.0), 500.0))) - labels[i]
            if abs(g) < 1e-4:
                continue
            bias_g += g * g
            bias -= 0.05 * g / math.sqrt(bias_g)
            if not len(k):
                continue
            root = np.sqrt(g2[k])
            g2[k] += g * g
            z[k] += g - (np.sqrt(g2[k]) - root) / alpha * w
            if factors and len(k) > 1:
                grad = g * (total - vk) + decay * vk
                gv[k] += grad * grad
                v[k] = vk - step * grad / np.sqrt(gv[k])
    return bias, weights(np.arange(len(odds))), v


def _within(terms: list[np.ndarray], places: np.ndarray) -> list[np.ndarray]:
    """For each text, the indices of its terms in places."""
    out = []
    for t in terms:
        k = np.searchsorted(places, t)
        k[k == len(places)] = 0
        out.append(k[places[k] == t] if len(places) else k[:0])
    return out


def fit(terms: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> FactorizationMachine:
    """Learn from the distinct places of each text and its label, 0 or 1."""
    if not len(terms):
        return FactorizationMachine(float(np.log(0.05 / 0.95)), np.empty(0, np.int64), np.empty(0), np.empty((0, factors)))
    terms, labels = _distinct(terms, labels)
    rng = np.random.default_rng(seed)
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(rate / (1 - rate)))
    count, hits = np.zeros(1 << HASH_BITS, np.int32), np.zeros(1 << HASH_BITS, np.int32)
    for t, label in zip(terms, labels):  # a text's places are distinct
        count[t] += 1
        if label:
            hits[t] += 1
    seen = np.flatnonzero(count)
    count, hits = count[seen].astype(float), hits[seen].astype(float)
    odds = np.log((hits + 0.5) / (count - hits + 0.5)) - bias
    alone = _telling(count, hits, rate)
    rows = _within(terms, seen[alone])
    linear_bias, linear, _ = _descend(rows, labels, bias, odds[alone], 0, epochs, rng)
    scores = 1 / (1 + np.exp(-np.clip([linear_bias + linear[k].sum() for k in rows], -8, 8)))
    often = np.flatnonzero(count >= PAIR_TEXTS)
    paired = often[_telling_pairs(_within(terms, seen[often]), len(often), labels, scores, seed)] if len(often) > 1 else often[:0]
    chosen = np.union1d(np.flatnonzero(alone), paired)
    first = np.where(alone, odds, 0.0)[chosen]
    bias, weights, vectors = _descend(_within(terms, seen[chosen]), labels, bias, first, factors, epochs, rng)
    return FactorizationMachine(bias, seen[chosen], weights, vectors)


def learn_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> FactorizationMachine:
    """Fit on a bounded sample of the labelled rows; allowed, a condition on the id, holds rows back (and those where it is null)."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    known = known.select(F.col(id_col), F.col(label_col).cast("int").alias("label"))
    share = min(1.0, max_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * max_rows)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Terms()
        for batch in batches:
            found = [np.unique(np.array([t for c in set((x or "").lower().split()) for t in memo[c]], np.uint32)).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.string()), batch.column("label"), pa.array(found, pa.binary())], names=["id", "label", "terms"])

    table = rows = written(map_batches(texts, run, "id string, label int, terms binary"), "terms")
    total = rows.select(F.sum(F.octet_length("terms"))).first()[0] or 0
    share = min(1.0, MAX_BYTES / max(1, total))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("bytes"), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = rows.toArrow()
    dropped(table)
    order = sorted(zip(found.column("id").to_pylist(), found.column("label").to_pylist(), range(found.num_rows)))
    terms = found.column("terms")
    return fit([np.frombuffer(terms[i].as_py(), np.uint32) for _, _, i in order], np.array([label for _, label, _ in order], np.float64))


def score_toxicity(df: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    return map_batches(df.select(F.col(id_col), F.col(text_col).cast("string")), run, f"`{id_col}` {kind}, score double")
