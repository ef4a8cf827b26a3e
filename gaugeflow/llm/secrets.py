"""Secret scans: named patterns, and windows of high Shannon entropy in candidate strings.

A window of fixed width slides over each candidate string (a maximal run of token characters); counts of its
characters are kept per character class by adding the entering and taking off the leaving character,
so that each step costs O(1). A window whose class entropy reaches the class's threshold is marked; marked
windows that overlap make one span. Allow-listed candidates (identifiers that are public by form,
or literals that the caller names) add no span; spans of the named patterns always stay.

Cases: null text counts as empty: no spans. Offsets are code points, the end is exclusive. Spans of
entropy that lie inside a pattern's span are not repeated. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_batches

KINDS = ("assign", "access", "hex", "entropy")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")

#: For each class: its characters, window width, least entropy in bits, least digits in the window.
CLASSES = {
    "hex": (frozenset("0123456789abcdefABCDEF"), 24, 2.9, 6),
    "base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 24, 3.9, 2),
}
#: Candidates whose form says that they are no secret: UUIDs, dates and times, and plain numbers.
ALLOWED_FORMS = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"[0-9_/=+-]+"),
    re.compile(r"(?:[A-Za-z]+[/_=+-])*[A-Za-z]+"),
    re.compile(r"(.{1,8}?)\1+.{0,8}"),
)


def entropy_windows(text: str, allowed: frozenset[str] = frozenset(), classes: dict = CLASSES) -> list[tuple[int, int]]:
    """Spans of text whose windows reach their class's entropy."""
    found: list[tuple[int, int]] = []
    for m in _CANDIDATE.finditer(text):
        word = m[0]
        if word in allowed or any(f.fullmatch(word) for f in ALLOWED_FORMS):
            continue
        for chars, width, least, digits in classes.values():
            counts: dict[str, int] = {}
            inside = n_digits = 0
            total = 0.0  # sum of c * log2(c) over the window's counts
            for k, ch in enumerate(word):
                if k >= width and (old := word[k - width]) in chars:
                    c = counts[old]
                    total -= _clog(c) - _clog(c - 1)
                    counts[old] = c - 1
                    inside -= 1
                    n_digits -= old.isdigit()
                if ch in chars:
                    c = counts.get(ch, 0)
                    total += _clog(c + 1) - _clog(c)
                    counts[ch] = c + 1
                    inside += 1
                    n_digits += ch.isdigit()
                if inside == width and n_digits >= digits and n_digits < width and math.log2(width) - total / width >= least:
                    a, b = m.start() + k + 1 - width, m.start() + k + 1
                    found.append((a, b))
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_CLOG = [0.0, 0.0, *(c * math.log2(c) for c in range(2, 256))]


def _clog(c: int) -> float:
    return _CLOG[c] if c < 256 else c * math.log2(c)


def scan(text: str | None, allowed: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text, by start, then kind as listed."""
    text = text or ""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS) or not text.isascii():
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    named = sorted((a, b) for _, a, b in out)
    far = list(accumulate((b for _, b in named), max))  # the furthest end of the spans that begin no later
    for a, b in entropy_windows(text, allowed):  # disjoint
        k = bisect_right(named, a, key=lambda s: s[0])
        if not k or far[k - 1] < b:
            out.append(("entropy", a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow_list: Iterable[str] = ()) -> DataFrame:
    """(id, spans) for each row: every span with its kind, offsets and text. A narrow map."""
    allowed, kind = frozenset(allow_list), df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, spans {SPAN}"
    spans_type = arrow_schema(schema).field(1).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, a, b in scan(t, allowed)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, spans_type)], names=[id_col, "spans"])

    return map_batches(df.select(F.col(id_col), F.col(text_col).cast("string")), run, schema)


def redact(df: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", mark: str = "[secret]", allow_list: Iterable[str] = ()) -> DataFrame:
    """The rows with every found span replaced by mark, in the columns they had; rows stay, null texts too.
    count_col, where the table has it, is set to the new length of changed texts."""
    allowed, names = frozenset(allow_list), df.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = batch.column(at).to_pylist(), {}
            for i, t in enumerate(texts):
                if spans := scan(t, allowed):
                    out, done = [], 0
                    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                        if a >= done:
                            out += [t[done:a], mark]
                        done = max(done, b)
                    changed[i] = "".join([*out, t[done:]])
            if changed:
                cols = list(batch.columns)
                cols[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
                if count_col in names:
                    k = names.index(count_col)
                    cols[k] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(cols[k].to_pylist())], batch.schema.field(k).type)
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return map_batches(df, run, df.schema)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
