"""Monitoring archives as a Spark data source: ZIP files of CSV members, each member cut into byte ranges that are read in tasks of their own.

`spark.read.format("monitoring_archive").option("sensors", "R1,E2").load(folder)` after `register(spark)` gives one row for each source row: its
place, its stamp as text, and the fields of the chosen sensors. A member is plain UTF-8 CSV (with or without a byte order mark): three lines of
preamble, a header whose first column is the product's time column, and rows, whose numbers start at 5; empty lines are no rows.

A line belongs to the range that holds its first byte. ZIP members cannot be entered in the middle, so that a task inflates what stands before its
range and only counts the lines there; memory is one batch of lines whatever the size of archive or member. A member has at most RANGES ranges, so that
what is inflated grows no faster than the members. The task of a member's last range reads all of
it, and so holds the member's CRC-32 against the archive's. Planning reads the central directories only.

Archives are written in two steps: tasks deflate blocks of lines to pieces that can stand in any stream, then a task an archive puts its pieces in a row.

Errors: a name that tells no product or station, another time column, a repeated header of a sensor that may not repeat it, a column that ends
in two sensors' ids, a row with another number of fields than the header or with an open quote, a wrong CRC, no chosen column in all members.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import struct
import uuid
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What names of archives, members and columns tell.
PRODUCTS = {"15_minute": "date_time_PST", "daily": "date"}
STATIONS = ("middle", "toe", "upper")
PREAMBLE = 3
FIRST_ROW = PREAMBLE + 2
SCHEMA = ("archive string, product string, station string, water_year_label string, member string, row_no bigint, stamp_text string, "
          "fields array<struct<position int, column string, sensor string, ordinal int, value_text string>>")
PROFILE = ("archive string, archive_sha256 string, member string, first_byte bigint, crc32 string, compressed_bytes bigint, uncompressed_bytes bigint, product string, station string, water_year_label string, "
           "preamble string, time_column string, columns array<string>")
#: Ranges of a member at most, and bytes of a range unless a member has too many.
RANGES, RANGE_BYTES = 32, 8 << 20
_ROWS = 4096
_TEXT, _LONG = pa.string(), pa.int64()
_FIELD = pa.struct([("position", pa.int32()), ("column", _TEXT), ("sensor", _TEXT), ("ordinal", pa.int32()), ("value_text", _TEXT)])
_ROW_TYPES = [_TEXT] * 5 + [_LONG, _TEXT, pa.list_(_FIELD)]
_MEMBER_TYPES = [_TEXT, _TEXT, _TEXT, _LONG, _TEXT, _LONG, _LONG] + [_TEXT] * 5 + [pa.list_(_TEXT)]


def _names(ddl: str) -> list[str]:
    """The names of the outer columns of a DDL text."""
    return [c.split(" ")[0] for c in re.sub(r"<.*>", "", ddl).split(", ")]


def product_of(name: str) -> str:
    found = [p for p in PRODUCTS if p in name.lower()]
    if not found:
        raise ValueError(f"no product in the name of archive {name}")
    return found[0]


def station_of(member: str) -> str:
    name = member.rsplit("/", 1)[-1].lower()
    for station in STATIONS:
        if station in name:
            return station
    raise ValueError(f"no station in the name of member {member}")


def water_year_label(member: str) -> str:
    found = re.search(r"WY(\d{4})", member, re.IGNORECASE)
    return found[1] if found else "not_applicable"


def sensor_of(column: str, sensors: list[str]) -> str | None:
    found = [s for s in sensors if column.endswith(f"_{s}")]
    if len(found) > 1:
        raise ValueError(f"column {column} ends in the ids of {found}")
    return found[0] if found else None


@dataclass(frozen=True)
class Field:
    position: int
    column: str
    sensor: str
    ordinal: int


def chosen_fields(member: str, header: list[str], product: str, sensors: list[str], repeated: list[str], every: bool = False) -> list[Field]:
    """The header's columns of chosen sensors, by position from 2; ordinal counts a sensor's columns."""
    if not header or header[0] != PRODUCTS[product]:
        raise ValueError(f"{member}: first column is not {PRODUCTS[product]}")
    for name, n in Counter(header).items():
        if n > 1 and not every and (product != "15_minute" or sensor_of(name, sensors) not in repeated):
            raise ValueError(f"{member}: repeated header {name}")
    out, seen = [], Counter()
    for at, name in enumerate(header[1:], 2):
        if (sensor := sensor_of(name, sensors)) is not None:
            seen[sensor] += 1
            out.append(Field(at, name, sensor, seen[sensor]))
    return out


def opened(path: str):
    """A seekable file of any file system that Arrow knows."""
    from pyarrow import fs

    system, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(own)


def listed(path: str) -> list[str]:
    """The archive at path, or the archives in the folder."""
    from pyarrow import fs

    uri = "://" in path or path.startswith("file:")
    system, own = fs.FileSystem.from_uri(path) if uri else (fs.LocalFileSystem(), path)
    if system.get_file_info(own).type == fs.FileType.File:
        return [path]
    prefix = path[: len(path) - len(own)] if uri and path.endswith(own) else ("file://" if uri else "")
    return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(own)) if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))


@dataclass
class Range(InputPartition):
    path: str
    member: str
    start: int
    stop: int | None  # None: to the member's end


def planned(path: str, size: int) -> list[Range]:
    def of(archive: str) -> list[Range]:
        with opened(archive) as f, zipfile.ZipFile(f) as z:
            out = []
            for info in z.infolist():
                if not info.is_dir() and info.filename.lower().endswith(".csv"):
                    step = max(size, -(-info.file_size // RANGES))
                    starts = range(0, max(info.file_size, 1), step)
                    out += [Range(archive, info.filename, a, a + step if a + step < info.file_size else None) for a in starts]
            return out

    with ThreadPoolExecutor(16) as pool:
        return [r for some in pool.map(of, listed(path)) for r in some]


def _rows_in(block: bytes) -> int:
    """Lines of a block that are not empty."""
    if block.endswith(b"\n") and not (block.startswith(b"\n") or b"\n\n" in block or b"\r" in block):
        return block.count(b"\n")
    return sum(1 for line in block.split(b"\n") if line.strip(b"\r"))


def data_lines(raw, start: int, stop: int | None) -> Iterator[tuple[int, bytes] | list[str]]:
    """First the header, then (row number, line) of the rows that begin in the range; a member is read from its beginning."""
    at, lines = 0, io.BufferedReader(raw, 1 << 20)
    for _ in range(PREAMBLE):
        at += len(lines.readline())
    head = lines.readline()
    at += len(head)
    yield next(csv.reader([head.decode("utf-8-sig" if at == len(head) else "utf-8")]), [])
    number = PREAMBLE + 1
    while at < start and (block := lines.read(min(1 << 20, start - at))):  # lines that begin before the range
        block += b"" if block.endswith(b"\n") else lines.readline()
        at, number = at + len(block), number + _rows_in(block)
    for line in lines:
        here, at = at, at + len(line)
        if stop is not None and here >= stop:
            return
        if not line.strip(b"\r\n"):
            continue
        number += 1
        yield number, line


def parsed(member: str, some: list[tuple[int, bytes]], width: int) -> list[list[str]]:
    """The fields of numbered lines; those without quotes need no CSV reader."""
    bare = [line.rstrip(b"\r\n") for _, line in some]
    whole = b"\n".join(bare)
    rows: list[list[str]] = []
    if not (b'"' in whole or b"\r" in whole) and max(map(len, bare)) < csv.field_size_limit():
        try:
            rows = [line.split(",") for line in whole.decode("utf-8").split("\n")]
        except UnicodeDecodeError:  # found again below, with its line
            pass
    for at, (number, line) in enumerate(some):
        if at == len(rows):
            try:
                rows += csv.reader([line.decode("utf-8")], strict=True)
            except (csv.Error, ValueError) as bad:
                raise ValueError(f"{member}: line {number}: {bad}") from bad
        if len(rows[at]) != width:
            raise ValueError(f"{member}: line {number} has {len(rows[at])} fields")
    return rows


class MonitoringReader(DataSourceReader):
    def __init__(self, path: str, sensors: list[str], repeated: list[str], size: int, every: bool):
        self.path, self.sensors, self.repeated, self.size, self.every = path, sensors, repeated, size, every

    def partitions(self) -> list[Range]:
        found = planned(self.path, self.size)
        if not self.every and not any(self._fields(r) for r in found if r.start == 0):  # stops at the first member that has some
            raise ValueError(f"no column of {self.sensors} in {self.path}")
        return found

    def _fields(self, part: Range) -> list[Field]:
        with opened(part.path) as f, zipfile.ZipFile(f) as z, z.open(part.member) as raw:
            return self._chosen(part, next(data_lines(raw, 0, 0)))

    def _chosen(self, part: Range, header: list[str]) -> list[Field]:
        return chosen_fields(part.member, header, product_of(part.path.rsplit("/", 1)[-1]), self.sensors, self.repeated, self.every)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        archive = part.path.rsplit("/", 1)[-1]
        head = [archive, product_of(archive), station_of(part.member), water_year_label(part.member), part.member]
        with opened(part.path) as f, zipfile.ZipFile(f) as z, z.open(part.member) as raw:
            found = data_lines(raw, part.start, part.stop)
            header = next(found)
            fields = self._chosen(part, header)
            kinds = [[getattr(x, name) for x in fields] for name in ("position", "column", "sensor", "ordinal")]
            while some := list(islice(found, _ROWS)):
                rows, n = parsed(part.member, some, len(header)), len(some)
                if not (fields or self.every):
                    continue
                values = [row[x.position - 1] for row in rows for x in fields]
                inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip([*(k * n for k in kinds), values], _FIELD)], fields=list(_FIELD))
                unfolded = pa.ListArray.from_arrays(pa.array([i * len(fields) for i in range(n + 1)], pa.int32()), inner)
                columns = [*([v] * n for v in head), [number for number, _ in some], [row[0] for row in rows]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _ROW_TYPES)), unfolded], names=_names(SCHEMA))


class MonitoringArchive(DataSource):
    """Options: sensors (comma-separated ids), repeated (those that may stand twice in a header), bytes (of a range), every (rows of members
    without a chosen column too, whatever repeats in their header)."""

    @classmethod
    def name(cls) -> str:
        return "monitoring_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MonitoringReader:
        listed_ = lambda key: [s for s in self.options.get(key, "").split(",") if s]
        return MonitoringReader(self.options["path"], listed_("sensors"), listed_("repeated"), int(self.options.get("bytes", RANGE_BYTES)), self.options.get("every") == "true")


def read_rows(spark: SparkSession, path: str, sensors: list[str], repeated: list[str] = (), range_bytes: int = RANGE_BYTES, every: bool = False) -> DataFrame:
    """The source rows of an archive or a folder of archives."""
    spark.dataSource.register(MonitoringArchive)
    return (spark.read.format("monitoring_archive").option("sensors", ",".join(sensors)).option("repeated", ",".join(repeated))
            .option("bytes", range_bytes).option("every", str(every).lower()).load(path))


def streamed_digest(file, size: int = 1 << 20) -> str:
    found = hashlib.sha256()
    while block := file.read(size):
        found.update(block)
    return found.hexdigest()


def members(spark: SparkSession, path: str) -> DataFrame:
    """What the archive, its central directory and the first lines of each member tell, one task an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive_path in batch.column(0).to_pylist():
                archive, rows = archive_path.rsplit("/", 1)[-1], []
                with opened(archive_path) as f:
                    digest = streamed_digest(f)
                with opened(archive_path) as f, zipfile.ZipFile(f) as z:
                    for info in z.infolist():
                        if info.is_dir() or not info.filename.lower().endswith(".csv"):
                            continue
                        with z.open(info) as raw:
                            lines = io.TextIOWrapper(raw, "utf-8-sig", newline="")
                            preamble = [lines.readline().rstrip("\r\n") for _ in range(PREAMBLE)]
                            header = next(csv.reader([lines.readline()]), [])
                        product = product_of(archive)
                        if not header or header[0] != PRODUCTS[product]:
                            raise ValueError(f"{info.filename}: first column is not {PRODUCTS[product]}")
                        rows.append((archive, digest, info.filename, info.header_offset, f"{info.CRC:08x}", info.compress_size, info.file_size, product, station_of(info.filename),
                                     water_year_label(info.filename), preamble[-1], header[0], header))
                if not rows:
                    raise ValueError(f"no CSV members in {archive}")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _MEMBER_TYPES)], names=_names(PROFILE))

    names = spark.createDataFrame([(p,) for p in listed(path)], "path string")
    return names.repartition(max(1, min(names.count(), 1000)), "path").mapInArrow(run, PROFILE)


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo the CRC-32's; the highest bit is the lowest power."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, n: int) -> int:
    """The CRC-32 of two texts in a row from theirs; the second has n bytes."""
    shift, square = 1 << 31, 1 << 23  # 1 and x ** 8
    while n:
        shift, square, n = _times(shift, square) if n & 1 else shift, _times(square, square), n >> 1
    return _times(shift, first) ^ second


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_archives(lines: DataFrame, folder: str, compressed: bool = True) -> int:
    """Write lines(archive, member, line_no, line) as ZIP files in a folder. Lines are dealt out in order of (archive, member, line_no); each task deflates its own
    to a file of pieces, ended so that others can follow, and tells their place, length and CRC-32. One task an archive then copies its pieces, a block at a time, with the members' headers; an archive is
    written beside its name and renamed when whole, so that a task that is tried again leaves one. Returns the number of archives. A batch of lines is held in memory."""
    how = zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED
    scratch = f".pieces-{uuid.uuid4().hex}"
    names, types = ["archive", "member", "line_no", "file", "first", "stored", "bytes", "crc"], [_TEXT, _TEXT, _LONG, _TEXT, _LONG, _LONG, _LONG, _LONG]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, own = _system(folder)
        path, out, at = f"{own}/{scratch}/{uuid.uuid4().hex}", None, 0
        try:
            for batch in batches:
                found = []
                rows = zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "line_no", "line")))
                for (a, m), some in groupby(rows, key=lambda r: r[:2]):
                    some = list(some)
                    raw = "".join(f"{r[3]}\n" for r in some).encode()
                    deflate = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
                    data = deflate.compress(raw) + deflate.flush(zlib.Z_FULL_FLUSH) if compressed else raw
                    if out is None:
                        out = system.open_output_stream(path)
                    out.write(data)
                    found.append((a, m, some[0][2], path, at, len(data), len(raw), zlib.crc32(raw)))
                    at += len(data)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)
        finally:
            if out is not None:
                out.close()

    def put(z: zipfile.ZipFile, system, member: str, rows: Iterator[tuple]) -> None:
        info = zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0))
        info.compress_type, info.header_offset, info.flag_bits, info.file_size, info.compress_size, info.CRC = how, z.fp.tell(), 0x08, 0, 0, 0  # sizes and CRC follow the bytes
        z.fp.write(info.FileHeader(zip64=True))
        for path, some in groupby(rows, key=lambda r: r[3]):
            with system.open_input_file(path) as f:
                for _, _, _, _, first, stored, n, crc in some:
                    f.seek(first)
                    z.fp.write(f.read(stored))
                    info.file_size, info.compress_size, info.CRC = info.file_size + n, info.compress_size + stored, joined_crc(info.CRC, crc, n)
        if compressed:
            z.fp.write(b"\x03\x00")  # an empty last block
            info.compress_size += 2
        z.fp.write(struct.pack("<LLQQ", 0x08074B50, info.CRC, info.compress_size, info.file_size))
        z.infolist().append(info)
        z.start_dir = z.fp.tell()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, own = _system(folder)
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names)))
        for archive, of_archive in groupby(rows, key=lambda r: r[0]):
            partial = f"{own}/.{archive}.partial-{uuid.uuid4().hex}"
            with system.open_output_stream(partial) as out, zipfile.ZipFile(out, "w", how) as z:
                for member, of_member in groupby(of_archive, key=lambda r: r[1]):
                    put(z, system, member, of_member)
            system.move(partial, f"{own}/{archive}")
            yield pa.RecordBatch.from_arrays([pa.array([archive], _TEXT)], names=["archive"])

    system, own = _system(folder)
    system.create_dir(f"{own}/{scratch}", recursive=True)
    by = ["archive", "member", "line_no"]
    dealt = lines.select(*by[:2], F.col("line_no").cast("bigint").alias("line_no"), "line").repartitionByRange(*by).sortWithinPartitions(*by)
    told = dealt.mapInArrow(pieces, "archive string, member string, line_no bigint, file string, first bigint, stored bigint, bytes bigint, crc bigint")
    try:
        return told.repartition("archive").sortWithinPartitions(*by, "file", "first").mapInArrow(run, "archive string").count()
    finally:
        system.delete_dir(f"{own}/{scratch}")
