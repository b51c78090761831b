"""Sinks whose result is there as a whole or not at all: files of bytes, one JSON array, checkpoints with retention.

Tasks write under names of their own in a hidden folder; what a task that died has left there is never seen. When all tasks
have finished, the driver moves their files into place and, last, writes the mark `_SUCCESS`; when the job fails, the hidden folder
goes. Moving is renaming on file systems that can. Folders may lie on any file system that Arrow knows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MARK = "_SUCCESS"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its place among the tasks, the hidden folder, and the names in it."""

    part: int
    folder: str
    names: list[str] = field(default_factory=list)


class Folder:
    """A folder by its path or address."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path.rstrip("/"))

    def create(self, name: str = "") -> None:
        self.fs.create_dir(f"{self.root}/{name}".rstrip("/"), recursive=True)

    def write(self, name: str, data: bytes) -> None:
        with self.fs.open_output_stream(f"{self.root}/{name}") as f:
            f.write(data)

    def move(self, name: str, to: str) -> None:
        self.fs.move(f"{self.root}/{name}", f"{self.root}/{to}")

    def names(self, kind: str) -> list[str]:
        from pyarrow import fs

        return [x.base_name for x in self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True)) if x.type == fs.FileType.File and re.fullmatch(kind, x.base_name)]

    def delete(self, name: str) -> None:
        self.fs.delete_file(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        from pyarrow import fs

        if self.fs.get_file_info(f"{self.root}/{name}").type == fs.FileType.Directory:
            self.fs.delete_dir(f"{self.root}/{name}")


class FileSetWriter(DataSourceWriter):
    """Rows (name, content) become files; names are base names, unique in the table. The commit is one renaming a file."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"], f"_hidden-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        here, context = Folder(self.path), TaskContext.get()
        part = context.partitionId() if context else 0
        made = Written(part, f"{self.job}/{part}-{uuid.uuid4().hex}")
        here.create(made.folder)
        for row in iterator:
            here.write(f"{made.folder}/{row['name']}", bytes(row["content"]))
            made.names.append(row["name"])
        return made

    def commit(self, messages: list[Written | None]) -> None:
        here = Folder(self.path)
        done = [m for m in messages if m]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            here.drop(self.job)
            raise ValueError("Two rows have the same file name")
        for m in done:
            for n in m.names:
                here.move(f"{m.folder}/{n}", n)
        self.finish(here)
        here.create()
        here.drop(self.job)
        here.write(MARK, b"")

    def finish(self, here: Folder) -> None:
        """What else belongs to the commit."""

    def abort(self, messages: list[Written | None]) -> None:
        Folder(self.path).drop(self.job)


class CheckpointWriter(FileSetWriter):
    """Files `<model>_step_<number>.pt`; only the newest `keep` steps of the model outlive the commit."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.model, self.keep = options["model"], int(options["keep"])

    def finish(self, here: Folder) -> None:
        steps = sorted(here.names(rf"{re.escape(self.model)}_step_\d+\.pt"), key=lambda n: int(re.search(r"(\d+)\.pt$", n)[1]))
        for name in steps[: max(0, len(steps) - self.keep)]:
            here.delete(name)


class JsonArrayWriter(DataSourceWriter):
    """Rows (json), in the order of partitions and rows, become one file with a JSON array.

    Tasks write their parts; the commit puts them together in blocks of `block` bytes.
    """

    def __init__(self, options: dict, block: int = 4 << 20):
        self.folder, _, self.name = options["path"].rpartition("/")
        self.job, self.block = f"_hidden-{uuid.uuid4().hex}", block

    def write(self, iterator: Iterator) -> Written:
        here, context = Folder(self.folder), TaskContext.get()
        part = context.partitionId() if context else 0
        made = Written(part, self.job)
        first, name = next(iterator, None), f"{part}-{uuid.uuid4().hex}"
        if first is not None:
            here.create(self.job)
            with here.fs.open_output_stream(f"{here.root}/{self.job}/{name}") as f:
                f.write(first["json"].encode())
                for row in iterator:
                    f.write(b",\n" + row["json"].encode())
            made.names.append(name)
        return made

    def commit(self, messages: list[Written | None]) -> None:
        here = Folder(self.folder)
        here.create(self.job)
        parts = [n for m in sorted((m for m in messages if m), key=lambda m: m.part) for n in m.names]
        with here.fs.open_output_stream(f"{here.root}/{self.job}/whole") as out:
            out.write(b"[\n")
            for k, name in enumerate(parts):
                out.write(b",\n" if k else b"")
                with here.fs.open_input_stream(f"{here.root}/{self.job}/{name}") as f:
                    while data := f.read(self.block):
                        out.write(data)
            out.write(b"\n]" if parts else b"]")
        here.move(f"{self.job}/whole", self.name)
        here.drop(self.job)

    def abort(self, messages: list[Written | None]) -> None:
        Folder(self.folder).drop(self.job)


class FileSet(DataSource):
    """df.write.format("file_set").mode("append").save(folder)"""

    @classmethod
    def name(cls) -> str:
        return "file_set"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileSetWriter(self.options)


class Checkpoints(FileSet):
    @classmethod
    def name(cls) -> str:
        return "checkpoint_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return CheckpointWriter(self.options)


class JsonArray(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "json string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return JsonArrayWriter(self.options)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> None:
    """Each row's bytes to a file of its own; all of them are there when this returns, and none is half written."""
    df.sparkSession.dataSource.register(FileSet)
    df.select(F.col(name).alias("name"), F.col(content).alias("content")).write.format("file_set").mode("append").save(folder)


def write_checkpoints(df: DataFrame, folder: str, model: str, step: str, content: str, keep: int) -> None:
    """Each row's bytes as a checkpoint of its step; older ones than the newest `keep` go with the same commit."""
    df.sparkSession.dataSource.register(Checkpoints)
    rows = df.select(F.format_string(f"{model}_step_%08d.pt", step).alias("name"), F.col(content).alias("content"))
    rows.write.format("checkpoint_files").option("model", model).option("keep", keep).mode("append").save(folder)


def pretty_json(columns: Iterable[str]):
    """A record as indented JSON, as it stands in an indented array."""
    return F.concat(F.lit("  "), F.replace(F.to_json(F.struct(*columns), {"pretty": "true"}), F.lit("\n"), F.lit("\n  ")))


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """All records by `order` (which is left out) as one file with an indented JSON array; sorted by ranges, written in parts."""
    df.sparkSession.dataSource.register(JsonArray)
    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    ranged.select(pretty_json([c for c in df.columns if c != order]).alias("json")).write.format("json_array").mode("append").save(path)
