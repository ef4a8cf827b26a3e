"""A content-addressed WARC archive: payloads once by digest, exact record headers apart, records restored by joins.

An archive is a folder with two Parquet tables. `payloads` (digest, shelves, copies, payload) holds each payload once, compressed by itself (zstd), addressed by the SHA-256 of its bytes;
`records` (digest, shelf, header) holds the exact header bytes of every record: the WARC header and the HTTP header,
each closed by an empty line. The first record of a payload is a response, the others revisit it; a record's bytes are its header, for
responses the payload, and two line ends. Restoring joins records to payloads, and raises where a payload's SHA-256 is not its
address, or its SHA-1 or length is not what the header says.

Scale: texts of pages are hashed where they are read, and only digests and ids are grouped; the payloads themselves move once, only those
of responses, compressed, dealt by (digest, id), so that copies do not meet. Records of a payload with many copies stand on several shelves
of at most SHELF records each; a restoring join meets one shelf a task, and the payload is repeated for each shelf, not for each record.
Nothing is collected or broadcast by this module.

Cases: a null payload is an empty one; a null URI has no target line, and line ends in a URI are percent-encoded. Null ids come last
and have no Page-Id line; a group of them alone has a response and revisits that refer to null. Rows that repeat an id and its payload are a response and its
revisits. Empty tables give empty archives. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, shared_dir, small_batches, written

#: Records of one payload that stand together.
SHELF = 4096
_END = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column, letters: int = 32) -> Column:
    """Upper-case base32 of a hex text of 20 bits times letters / 4."""
    quads = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(letters // 4)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def _urn(page_id: Column, digest: Column, row: Column) -> Column:
    """A record id that no other record has."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest, row.cast("string")).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))


def record_header(page_id: Column, url: Column, n_bytes: Column, sha1: Column, own: Column, revisit: Column, first: Column, first_id: Column, date: str) -> Column:
    """The exact header bytes of a record. own and first are record ids; first and first_id are used where revisit."""
    http = F.concat(F.lit(_HTTP), n_bytes.cast("string"), F.lit(_END + _END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(n_bytes)
    uri = F.replace(F.replace(url.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1" + _END), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", own),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", uri), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        _line("WARC-Profile", F.when(revisit, _REVISIT)), _line("WARC-Refers-To", F.when(revisit, first)),
        _line("Page-Id", page_id), _line("Refers-To-Page-Id", F.when(revisit, first_id)),
        _line("Content-Type", F.lit("application/http;msgtype=response")), _line("Content-Length", length), F.lit(_END), http).cast("binary")


def header_field(header: Column, name: str) -> Column:
    """A field of the WARC header, null where it is absent. The URI cannot forge one, as it holds no line ends."""
    warc = F.substring_index(header.cast("string"), _END + _END, 1)
    return F.nullif(F.regexp_extract(warc, rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))


def packed(rows: DataFrame) -> DataFrame:
    """rows(digest, key, payload) with each payload compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in small_batches(batches):
            payload = pa.array([pack.compress(x) for x in batch.column("payload").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("key"), payload], names=["digest", "key", "payload"])

    return map_batches(rows, run, "digest string, key string, payload binary")


def unpacked(both: DataFrame) -> DataFrame:
    """both(digest, header, payload) with each payload's bytes, held against their address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in small_batches(batches):
            out = []
            for digest, raw in zip(batch.column("digest").to_pylist(), batch.column("payload").to_pylist()):
                if raw is None:
                    raise ValueError(f"record without its payload {digest}")
                try:
                    payload = unpack.decompress(raw, allow_extra_data=False)
                except zstandard.ZstdError:
                    payload = None
                if payload is None or hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload differs from its address {digest}")
                out.append(payload)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("header"), pa.array(out, pa.binary())], names=["digest", "header", "payload"])

    return map_batches(both, run, "digest string, header binary, payload binary")


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
                  date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the records of pages as an archive in root. Of equal payloads of at least min_bytes bytes, the record with the smallest id is the response
    and the others revisit it; smaller ones are responses all."""
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    known = written(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("bigint").alias("n_bytes"), sha1_base32(F.col("payload")).alias("sha1"))
                    .withColumn("row", F.monotonically_increasing_id()), "known")
    lowest = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row"))
    firsts = written(known.groupBy("digest").agg(lowest.alias("f"), F.count("*").alias("copies"))
                     .select("digest", F.col("f.page_id").alias("first_id"), F.col("f.row").alias("first_row"), "copies", F.ceil(F.col("copies") / SHELF).cast("bigint").alias("shelves")), "firsts")
    # records of a payload with many copies are dealt over its shelves before they meet its first record
    many = written(firsts.where("shelves > 1").select("digest", "shelves"), "many")
    dealt = known.join(many, "digest", "left").select(known["*"], F.coalesce(F.pmod(F.xxhash64("row"), F.col("shelves")), F.lit(0)).cast("bigint").alias("shelf"))
    shelved = firsts.withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shelves") - 1)))
    revisit = (F.col("n_bytes") >= min_bytes) & (F.col("row") != F.col("first_row"))
    records = dealt.join(shelved, ["digest", "shelf"]).select("digest", "shelf", record_header(
        F.col("page_id"), F.col("url"), F.col("n_bytes"), F.col("sha1"), _urn(F.col("page_id"), F.col("digest"), F.col("row")), revisit,
        _urn(F.col("first_id"), F.col("digest"), F.col("first_row")), F.col("first_id"), date).alias("header"))
    records.write.parquet(f"{root}/records")
    # one plain key, so that the rows of the join stay where they are for the aggregation that follows
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key")
    wanted = firsts.select("digest", key("first_id"), "copies", "shelves")
    once = packed(rows.select("digest", key("page_id"), "payload")).join(wanted, ["digest", "key"]).groupBy("digest", "key").agg(*[F.first(c).alias(c) for c in ("copies", "shelves", "payload")])
    once.select("digest", "shelves", "copies", "payload").write.parquet(f"{root}/payloads")


def read_archive(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(records, payloads) of an archive."""
    records = spark.read.schema("digest string, shelf bigint, header binary").parquet(f"{root}/records")
    return records, spark.read.schema("digest string, shelves bigint, copies bigint, payload binary").parquet(f"{root}/payloads")


def restore(spark: SparkSession, root: str) -> DataFrame:
    """(header, payload) of every record, revisits with the payload of their response, verified; record_bytes() gives the record."""
    records, payloads = read_archive(spark, root)
    shelved = payloads.withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shelves") - 1))).select("digest", "shelf", "payload")
    both = unpacked(records.join(shelved, ["digest", "shelf"], "left").select("digest", "header", "payload"))
    agrees = header_field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), sha1_base32(F.col("payload")))
    return both.select("header", F.when(agrees, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("record without its payload "), F.col("digest"))).cast("binary")).alias("payload"))


def record_bytes(header: Column, payload: Column) -> Column:
    """A whole record as it stands in a WARC file."""
    block = F.when(header_field(header, "WARC-Type") == "response", payload).otherwise(F.lit(b""))
    return F.concat(header, block, F.lit(b"\r\n\r\n"))


def export_warc(spark: SparkSession, root: str, path: str) -> None:
    """The archive as plain WARC files, one a partition, by Spark's own committer: the text writer's line end closes each record."""
    restored = restore(spark, root)
    block = F.when(header_field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    restored.select(F.concat("header", block).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def archived(pages: DataFrame, root: str | None = None, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write pages as an archive (in the shared folder if root is not given), read it back and restore it: (page_id, header, payload) of each record."""
    spark = pages.sparkSession
    root = root or f"{shared_dir(spark)}/archive-{uuid.uuid4().hex[:10]}"
    write_archive(pages, root, min_bytes=min_bytes, **columns)
    return restore(spark, root)


def described(restored: DataFrame, id_type: str = "bigint") -> DataFrame:
    """What the restored records say and hold: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    h = F.col("header")
    return restored.select(
        header_field(h, "Page-Id").cast(id_type).alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"), header_field(h, "WARC-Type").alias("record_type"),
        header_field(h, "Refers-To-Page-Id").cast(id_type).alias("refers_to"))
