"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle 1994).

A language's profile is the ranked list of the most frequent character n-grams of its labelled texts; a document
takes the language whose profile has the least out-of-place distance to the document's own ranked list.
N-grams (1 to 3 characters) are taken within runs of letters, in lower case, with a word boundary mark
on both sides; an n-gram is packed in 63 bits, and ties of counts go to the smaller packed value.

Training counts all given rows: n-gram counts are gathered in the workers, summed by Spark, and
the top of each language is taken from every partition's own top, never gathering a language's n-grams. The profiles on the
driver are bounded by languages x PROFILE.

Cases: null, empty and letterless texts are `und` with score 0; a tie of distances goes to the smaller
language name; without training rows every text is `und`. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_batches, written

#: N-grams in a profile, and in a document's own list.
PROFILE = 300
#: Languages that a model may have; more is an error, not a cut.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
_EDGE = 1  # the code of the word boundary mark
#: Characters whose n-grams are counted at once.
_STRETCH = 1 << 19
_LETTER = np.zeros(0, bool)


def _letters() -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, with summed counts."""
    if not len(grams):
        return grams, counts
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    return grams[first], np.add.reduceat(counts, first)


def text_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams of a whole text in order, and their counts; long texts go by stretches
    that overlap by the two characters an n-gram needs."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one boundary after each word
    code = np.concatenate([[_EDGE], np.where(letter, code, _EDGE)[keep], [_EDGE]]).astype(np.int64)
    parts = []
    for a in range(1, len(code), _STRETCH):
        c = code[max(0, a - 2) : a + _STRETCH]
        inner = c != _EDGE
        fresh = slice(a - max(0, a - 2), None)
        one = c[fresh][inner[fresh]]
        k = fresh.start
        two = (c[k - 1 : -1] << 21 | c[k:])[inner[k - 1 : -1] | inner[k:]]
        three = (c[k - 2 : -2] << 42 | c[k - 1 : -1] << 21 | c[k:])[inner[k - 1 : -1]] if k >= 2 else (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inner[1:-1]]
        g = np.sort(np.concatenate([one, two, three]))
        if len(g):
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            parts.append((g[first], np.diff(np.append(first, len(g)))))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return parts[0] if len(parts) == 1 else merged(*map(np.concatenate, zip(*parts)))


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    return grams[np.lexsort((grams, -counts))[:most]]


class LanguageProfiles:
    """Ranked profiles of every learned language, ready for distances."""

    def __init__(self, ranks: dict[str, list[int]], size: int = PROFILE):
        self.size, self.names = size, sorted(ranks)
        self.grams = np.unique(np.array([g for name in self.names for g in ranks[name]], np.int64))
        self.places = np.full((len(self.names), len(self.grams)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.places[k, np.searchsorted(self.grams, np.array(ranks[name], np.int64))] = np.arange(len(ranks[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the runner-up's share of the two least distances, from 0.5 (tie) to 1."""
        own = ranked(*text_grams(text), self.size)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        place = np.where(known, self.places[:, at], -1)
        away = np.where(place < 0, self.size, np.abs(place - np.arange(len(own)))).sum(1)
        order = np.argsort(away, kind="stable")
        best = int(away[order[0]])
        if len(order) == 1:
            return self.names[0], 1.0 - best / (self.size * len(own))
        second = int(away[order[1]])
        return self.names[order[0]], second / (best + second) if second else 0.5


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, max_languages: int = MAX_LANGUAGES) -> LanguageProfiles:
    """Count the n-grams of every row that has a language and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def flush():
            for name, bag in bags.items():
                grams, counts = merged(*map(np.concatenate, zip(*bag)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])
            bags.clear()

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bags.setdefault(name, []).append(text_grams(text))
                held += len(bags[name][-1][0])
                if held > 4_000_000:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    total = written(map_batches(rows, run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    names = [r[0] for r in total.select("lang").distinct().limit(max_languages + 1).collect()]
    if len(names) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    top = {name: [r[0] for r in total.where(F.col("lang") == name).orderBy(F.desc("n"), "gram").limit(size).select("gram").collect()] for name in names}
    dropped(total)
    return LanguageProfiles(top, size)


def identify(df: DataFrame, model: LanguageProfiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row. A narrow map."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in both], pa.string()), pa.array([b for _, b in both], pa.float64())], names=[id_col, "lang_pred", "score"])

    return map_batches(df.select(F.col(id_col), F.col(text_col).cast("string")), run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(df: DataFrame, model: LanguageProfiles, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text has a language, in the columns they had; `und` rows go. A null language becomes the predicted one."""
    shared, at, label = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col), df.columns.index(lang_col) if lang_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t)[0] for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            if label is not None:
                known = columns[label].to_pylist()
                columns[label] = pa.array([f if k is None else k for k, f in zip(known, found)], columns[label].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([f != UNKNOWN for f in found], pa.bool_()))

    return map_batches(df, run, df.schema)
