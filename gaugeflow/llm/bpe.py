"""Byte-pair encoding and decoding of whole texts.

A word's symbols stand in a doubly linked list; a priority queue holds the rank of every adjacent
pair that can merge. Popped entries whose symbols have changed meanwhile are stale and skipped.
Decoding joins the vocabulary strings of the ids with a space, as a tokenizer without a decoder does.

Cases: null text counts as empty, which has no ids and decodes to "". White space only: no ids.
Special tokens' strings in a text become their ids, as the library does by default. Repeated rows give
repeated results. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from .common import map_batches

#: Words kept with their ids in each Python worker during a partition; the memo starts anew beyond it.
MEMO_WORDS = 400_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(spare)) for b in range(256)]


class BpeCodec:
    """Encode and decode as one tokenizer file of the library prescribes (lower case, white space dropped,
    words split by its own pattern, byte-level letters, end-of-word suffix)."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: (left id, right id) packed in an int -> rank and the id of both together, packed likewise
        self.merges = {self.vocab[x] << 32 | self.vocab[y]: r << 32 | self.vocab[x + y] for r, (x, y) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.space = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
        letters = _byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.memo: dict[str, bytes] = _Memo(self.chunk, memo_words)

    def merge(self, word: str) -> list[int]:
        """The ids that one pre-token ends as."""
        raw, merges = word.encode("utf-8", "surrogatepass"), self.merges
        sym = [self.inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        n = len(sym)
        if n == 1:
            return sym
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [m >> 32 << 32 | i for i in range(n - 1) if (m := merges.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(queue)  # rank, then place
        while queue:
            top = heapq.heappop(queue)
            i = top & 0xFFFFFFFF
            j = right[i]
            if j < 0 or sym[i] < 0 or (m := merges.get(sym[i] << 32 | sym[j])) is None or m >> 32 != top >> 32:
                continue  # stale: a symbol has changed or gone since
            sym[i], sym[j] = m & 0xFFFFFFFF, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (m := merges.get(sym[i] << 32 | sym[k])) is not None:
                    heapq.heappush(queue, m >> 32 << 32 | i)
            if (h := left[i]) >= 0 and (m := merges.get(sym[h] << 32 | sym[i])) is not None:
                heapq.heappush(queue, m >> 32 << 32 | h)
        return [s for s in sym if s >= 0]

    def chunk(self, chunk: str) -> bytes:
        """Packed ids of a stretch without white space."""
        words = (chunk,) if chunk.isalpha() else self.words.findall(chunk)
        ids = [i for w in words for i in self.merge(w)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # split() takes these for white space
            return [c for c in self.space.split(text) if c]
        return text.split()

    def encode(self, text: str | None) -> bytes:
        """Ids packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self.parts.split(text or "") if self.parts and "<" in (text or "") else [text or ""]:
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            else:
                out += map(self.memo.__getitem__, self._chunks(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of packed ids, joined by a space."""
        return " ".join(map(self.strings.__getitem__, memoryview(ids).cast("I")))


class _Memo(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, chunk: str) -> bytes:
        ids = self.make(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """One codec for each path and worker."""
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode each row's whole text: (id, the columns of keep, n_tokens long, ids binary, decoded string).
    A narrow map without shuffle; each worker loads the tokenizer file from its own installation."""
    path = tokenizer or default_path()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    ids = [c.encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:-1], pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string())],
                        names=[id_col, *keep, "n_tokens", "ids", "decoded"])
        finally:
            c.memo.clear()

    schema = StructType([df.schema[c] for c in (id_col, *keep)]).add("n_tokens", LongType()).add("ids", BinaryType()).add("decoded", StringType())
    return map_batches(df.select(id_col, *keep, F.col(text_col).cast("string").alias("_text")), run, schema)
