"""Sources: ZIP archives of CSV members with a preamble, digests against a manifest, catalogues, aggregate tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import product_of_archive, station_of_member, water_year_of_member

PREAMBLE_LINES = 3


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, sha256, md5) of each file, hashed on the JVM."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def verify_manifest(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest(name, size, algorithm, checksum): its files with a verdict; size is held first, then the checksum."""
    d = manifest.join(digests, "name", "left")
    own = F.when(F.lower("algorithm") == "md5", F.col("md5")).when(F.lower("algorithm") == "sha256", F.col("sha256"))
    verdict = (F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("size"), "size_differs").when(own.isNull(), "unsupported_checksum")
               .when(own != F.lower("checksum"), "checksum_differs").otherwise("verified"))
    return d.select("name", "size", "length", verdict.alias("verdict"))


def select_resources(catalogue: DataFrame, names: list[str]) -> DataFrame:
    """catalogue(files array<struct<name, ...>>): the named files; an unsafe, repeated or absent name is an error."""
    if not names or len(set(names)) != len(names) or any(not n or "/" in n or "\\" in n or n in (".", "..") for n in names):
        raise ValueError("names must be non-empty, unique and plain")
    found = catalogue.select(F.inline("files")).where(F.col("name").isin(*names))
    n = found.select("name").distinct().count()
    if n != len(names):
        raise ValueError(f"{len(names) - n} of the named files are not in the catalogue")
    return found


def read_members(spark: SparkSession, path: str, product_time: dict[str, str] | None = None) -> DataFrame:
    """Long rows of archived CSV members: every field as text, by position. (archive, product, member, station, water_year_label, row_no,
    stamp_text, column, position, value_text). The first row of data is row 5 after a preamble of three lines and the header."""
    times = product_time or {"15_minute": "date_time_PST", "daily": "date"}

    def run(batches: Iterator) -> Iterator:
        import csv
        import io
        import zipfile

        import pandas as pd

        names = ["archive", "member", "row_no", "stamp_text", "column", "position", "value_text"]
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                archive = name.rsplit("/", 1)[-1]
                product = "15_minute" if "15_minute" in archive.lower() else "daily"
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if bad := z.testzip():
                        raise ValueError(f"bad CRC: {bad}")
                    for member in sorted(m.filename for m in z.infolist() if not m.is_dir()):
                        with z.open(member) as raw:
                            reader = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
                            for _ in range(PREAMBLE_LINES):
                                next(reader, None)
                            header = next(reader, [])
                            if not header or header[0] != times[product]:
                                raise ValueError(f"{member}: first column is not {times[product]}")
                            if product != "15_minute" and len(set(header)) != len(header):
                                raise ValueError(f"{member}: repeated header")
                            rows = []
                            for k, row in enumerate(reader, PREAMBLE_LINES + 2):
                                if len(row) != len(header):
                                    raise ValueError(f"{member}: line {k} has {len(row)} fields")
                                rows += [(archive, member, k, row[0], c, i, row[i]) for i, c in enumerate(header) if i]
                                if len(rows) > 50_000:
                                    yield pd.DataFrame(rows, columns=names)
                                    rows = []
                            yield pd.DataFrame(rows, columns=names)

    f = spark.read.format("binaryFile").load(path).select("path", "content")
    out = f.mapInPandas(run, "archive string, member string, row_no bigint, stamp_text string, column string, position int, value_text string")
    return out.withColumns({"product": product_of_archive(F.col("archive")), "station": station_of_member(F.col("member")), "water_year_label": water_year_of_member(F.col("member"))})


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An aggregate CSV under an explicit schema; malformed lines are errors."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")
