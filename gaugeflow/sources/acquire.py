"""Acquisition with receipts: a catalogue item in JSON, its chosen files copied in two phases and verified, one receipt row a file.

A file is streamed to `<name>.partial`, which must not exist, while its size and checksums are taken; if they are the catalogue's, it is renamed, else
deleted and an error. A file that stands already is verified and not copied. Files go to any file system that Arrow knows, a task each; the copy is safe to try again, as a
failed try deletes its partial file, and one that was cut off is an error for a person to look at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a receipt, in order.
RECEIPT = ("doi", "item_id", "item_url", "filename", "title", "resource_url", "byte_size", "sha256", "source_checksum_algorithm", "source_checksum", "source_date_uploaded",
           "item_last_updated", "response_last_modified", "response_etag", "access_timestamp_utc", "license", "local_raw_layer_id")
_FILE = "array<struct<name: string, title: string, url: string, downloadUri: string, size: bigint, dateUploaded: string, checksum: struct<type: string, value: string>>>"
ITEM = f"id string, link struct<url: string>, identifiers array<struct<key: string>>, provenance struct<lastUpdated: string>, rights string, files {_FILE}"
_BLOCK = 1 << 20


def read_catalogue(spark: SparkSession, path: str, item_id: str, doi: str) -> DataFrame:
    """The item in a JSON file; another id, or one that does not name the DOI, is an error."""
    item = spark.read.schema(ITEM).json(path, multiLine=True)
    n = item.where((F.col("id") == item_id) & F.array_contains(F.transform("identifiers", lambda x: x["key"]), f"doi:{doi}")).limit(2).count()
    if n != 1:
        raise ValueError(f"the catalogue does not hold item {item_id} with doi {doi} once")
    return item.withColumn("doi", F.lit(doi))


def select_resources(item: DataFrame, names: list[str]) -> DataFrame:
    """The named files of an item, one row each, checksums in lower case. Unsafe, repeated and absent names, and missing or unsupported checksums, are errors."""
    if not names or len(set(names)) != len(names) or any(not n or "/" in n or "\\" in n or n in (".", "..") for n in names):
        raise ValueError("names must be non-empty, unique and plain")
    stated = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("not_stated"))
    files = item.select("doi", F.col("id").alias("item_id"), stated(F.col("link.url")).alias("item_url"), stated(F.col("provenance.lastUpdated")).alias("item_last_updated"),
                        stated(F.trim("rights")).alias("license"), F.inline("files")).where(F.col("name").isin(*names))
    out = files.select("doi", "item_id", "item_url", "item_last_updated", "license", "name", stated(F.col("title")).alias("title"), F.coalesce("downloadUri", "url", F.lit("")).alias("url"), "size",
                       stated(F.col("dateUploaded")).alias("date_uploaded"), F.lower("checksum.type").alias("algorithm"), F.lower("checksum.value").alias("checksum"))
    found = {r.name: r.algorithm in hashlib.algorithms_available and bool(r.checksum) for r in out.select("name", "algorithm", "checksum").collect()}  # a row for each name asked for
    if gone := sorted(set(names) - set(found)):
        raise ValueError(f"{gone} are not in the catalogue")
    if bad := sorted(n for n, ok in found.items() if not ok):
        raise ValueError(f"no supported checksum of {bad}")
    return out


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _digests(file, algorithm: str, out=None) -> tuple[int, str, str]:
    """Size, checksum and SHA-256 of a stream, written to out as it is read."""
    own, strong, size = hashlib.new(algorithm), hashlib.sha256(), 0
    while block := file.read(_BLOCK):
        own.update(block)
        strong.update(block)
        size += len(block)
        if out is not None:
            out.write(block)
    return size, own.hexdigest(), strong.hexdigest()


def _verified(name: str, want_size: int, algorithm: str, want: str, size: int, own: str) -> None:
    if size != want_size:
        raise ValueError(f"{name}: size {size} is not {want_size}")
    if own != want:
        raise ValueError(f"{name}: {algorithm} differs")


def _one(r, folder: str) -> tuple[str, int, str]:
    from pyarrow import fs

    system, root = _system(folder)
    system.create_dir(root, recursive=True)
    target, partial = f"{root}/{r.name}", f"{root}/{r.name}.partial"
    there = lambda p: system.get_file_info(p).type != fs.FileType.NotFound
    outcome = "verified"
    if not there(target):
        if there(partial):
            raise FileExistsError(f"an interrupted copy stands: {r.name}.partial")
        outcome = "copied"
        source, own = _system(r.url)
        try:
            with source.open_input_stream(own) as read, system.open_output_stream(partial) as write:
                size, check, _ = _digests(read, r.algorithm, write)
            _verified(r.name, r.size, r.algorithm, r.checksum, size, check)
            system.move(partial, target)
        except BaseException:
            if there(partial):
                system.delete_file(partial)
            raise
    with system.open_input_stream(target) as read:
        size, check, strong = _digests(read, r.algorithm)
    _verified(r.name, r.size, r.algorithm, r.checksum, size, check)
    return outcome, size, strong


def acquire(resources: DataFrame, folder: str, layer: str = "raw") -> DataFrame:
    """outcome (copied, verified) and the receipt's fields of each resource. The work is done when the rows are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                outcome, size, strong = _one(r, folder)
                now = datetime.now(UTC).replace(microsecond=0).isoformat()
                rows.append((outcome, r.doi, r.item_id, r.item_url, r.name, r.title, r.url, size, strong, r.algorithm, r.checksum, r.date_uploaded, r.item_last_updated, "not_stated", "not_stated", now, r.license, f"{layer}/{r.name}"))
            yield pd.DataFrame(rows, columns=["outcome", *RECEIPT])

    fields = ", ".join(f"{c} {'bigint' if c == 'byte_size' else 'string'}" for c in RECEIPT)
    return resources.repartition("name").mapInPandas(run, f"outcome string, {fields}")


def write_receipt(acquired: DataFrame, path: str) -> None:
    acquired.select(*RECEIPT).coalesce(1).write.json(path, ignoreNullFields=False)


def read_receipt(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} {'bigint' if c == 'byte_size' else 'string'}" for c in RECEIPT)).json(path)
