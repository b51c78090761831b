"""Tar archives as tables: an index of members, their contents by byte ranges, and the rows of a metadata member.

The index holds where each member's bytes are. With it, several tasks read one archive at once, each its own ranges, and only the
members that are wanted; a compressed archive has no ranges, so one task reads it, once, up to the last wanted member.
"""

from __future__ import annotations

import codecs
import csv
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

PACKED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ")
BATCH = 16 << 20


def opened(path: str):
    """A file that can be read at any place, of any file system that Arrow knows."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def is_packed(path: str) -> bool:
    with opened(path) as f:
        return f.read(6).startswith(PACKED)


class TarIndex(DataSource):
    """spark.read.format("tar_index").load(path or comma-separated paths): the members of archives without their contents.

    One task an archive; of one that isn't compressed only the headers are read.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_index"

    def schema(self) -> str:
        return "archive string, place int, ordinal long, name string, offset long, size long, packed boolean"

    def reader(self, schema) -> DataSourceReader:
        return TarIndexReader(self.options)


class TarIndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((place, path)) for place, path in enumerate(self.paths)]

    def read(self, partition: InputPartition):
        place, path = partition.value
        packed = is_packed(path)
        with opened(path) as f, tarfile.open(fileobj=f, mode="r|*" if packed else "r:") as tar:
            for ordinal, member in enumerate(tar):
                if member.isfile():
                    yield path, place, ordinal, member.name, member.offset_data, member.size, packed


class TarSource(DataSource):
    """spark.read.format("tar_members").load(path or comma-separated paths): members with their contents, one task an archive.

    With the option pushdown (and spark.sql.python.filterPushdown.enabled, which Spark wants for it), contents are read only of
    members whose names a filter lets through.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "archive string, ordinal long, name string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return (PushingTarReader if self.options.get("pushdown", "false").lower() == "true" else TarReader)(self.options)


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.suffix = options.get("suffix", "")
        self.tests: list[tuple[str, object]] = []

    def passes(self, name: str) -> bool:
        of = {"equal": lambda v: name == v, "in": lambda v: name in v, "starts": name.startswith, "ends": name.endswith}
        return all(of[kind](value) for kind, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        path = partition.value
        with opened(path) as f, tarfile.open(fileobj=f, mode="r|*" if is_packed(path) else "r:") as tar:
            for ordinal, member in enumerate(tar):
                if member.isfile() and self.passes(member.name):
                    wanted = not self.suffix or member.name.endswith(tuple(self.suffix.split("|")))
                    yield path, ordinal, member.name, tar.extractfile(member).read() if wanted else None


class PushingTarReader(TarReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the whole name are applied before contents are read; the others are left to Spark."""
        kinds = {EqualTo: "equal", In: "in", StringStartsWith: "starts", StringEndsWith: "ends"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("name",):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f


def tar_index(spark: SparkSession, path: str) -> DataFrame:
    """archive, place (of the archive in the list), ordinal, name, offset, size, packed of every file in the archives."""
    spark.dataSource.register(TarIndex)
    return spark.read.format("tar_index").load(path)


class Contents:
    """Reads members in the order of their archives and ordinals; an archive stays open until the next one."""

    def __init__(self):
        self.path, self.file, self.tar, self.members = None, None, None, None

    def read(self, path: str, ordinal: int, offset: int, size: int, packed: bool) -> bytes:
        if path != self.path:
            self.close()
            self.path, self.file = path, opened(path)
            self.tar = tarfile.open(fileobj=self.file, mode="r|*") if packed else None  # noqa: SIM115  closed with the file
            self.members, self.last = enumerate(self.tar or ()), (-1, b"")
        if not packed:
            return self.file.read_at(size, offset)
        if self.last[0] != ordinal:
            member = next(m for n, m in self.members if n == ordinal)
            self.last = ordinal, self.tar.extractfile(member).read()
        return self.last[1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def member_contents(members: DataFrame, range_bytes: int = 64 << 20) -> DataFrame:
    """Adds content to rows of an index (with any further columns): each member's bytes, read from its place in the archive.

    Members of one range of an archive are read together by one task, ranges by as many tasks as there are. A member that comes
    in several rows is read for each.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(parts, "archive", F.when(F.col("packed"), 0).otherwise(F.floor(F.col("offset") / range_bytes))).sortWithinPartitions("archive", "ordinal")
    schema = T.StructType([*members.schema.fields, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Contents()
        for b in batches:
            first, contents, size = 0, [], 0
            keys = [b.column(c).to_pylist() for c in ("archive", "ordinal", "offset", "size", "packed")]
            for n, key in enumerate(zip(*keys, strict=True)):
                contents.append(held.read(*key))
                size += len(contents[-1])
                if size >= BATCH or n == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*b.slice(first, len(contents)).columns, pa.array(contents, pa.binary())], names=schema.names)
                    first, contents, size = n + 1, [], 0
        held.close()

    return dealt.mapInArrow(read, schema)


def lines_of(parts: Iterator[bytes]) -> Iterator[str]:
    """The lines of UTF-8 text that comes in parts; all of Unicode's line ends count."""
    decode, rest = codecs.getincrementaldecoder("utf-8")().decode, ""
    for part in parts:
        lines = (rest + decode(part)).splitlines(keepends=True)
        # The last line may go on, and a carriage return at the end may belong to a line feed to come.
        rest = lines.pop() if lines else ""
        yield from (line.splitlines()[0] for line in lines)
    yield from (rest + decode(b"", True)).splitlines()


def metadata_rows(members: DataFrame, block: int = 1 << 20) -> DataFrame:
    """archive, place, line (from 0), path, sentence, client_id of the rows of index members that are TSV files with a header.

    path and sentence may go by the names filename and text; null where a file has no such column. A file is read in blocks and
    its rows are handed on as they come.
    """
    schema = "archive string, place int, line long, path string, sentence string, client_id string"

    def blocks(key: tuple) -> Iterator[bytes]:
        path, ordinal, offset, size, packed = key
        if packed:
            held = Contents()
            yield held.read(*key)
            held.close()
            return
        with opened(path) as f:
            for at in range(0, size, block):
                yield f.read_at(min(block, size - at), offset + at)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            for row in b.to_pylist():
                reader = csv.DictReader(lines_of(blocks((row["archive"], row["ordinal"], row["offset"], row["size"], row["packed"]))), delimiter="\t")
                out: list[tuple] = []
                for line, r in enumerate(reader):
                    out.append((row["archive"], row["place"], line, r.get("path", r.get("filename")), r.get("sentence", r.get("text")), r.get("client_id")))
                    if len(out) == 10_000:
                        yield made(out, names)
                        out = []
                yield made(out, names)

    def made(out: list[tuple], names: list[str]) -> pa.RecordBatch:
        types = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 3]
        columns = zip(*out, strict=True) if out else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.select("archive", "place", "ordinal", "offset", "size", "packed").repartition(parts, "archive").mapInArrow(parse, schema)
