"""Result files, a JSON object of id to reading with a ``_meta`` entry, as a data source: many tasks a file, and writes that are all or nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "id string, text string, tables array<string>, time double, error boolean"
MANIFEST = "_manifest.json"
#: Before every entry of a file: a line that begins with one space and a quote. Line ends within strings are escaped.
MARK = b'\n "'
#: Bytes that a task reads of a file, and bytes that are read at a time.
SPLIT, STEP = 32 << 20, 1 << 20


def open_folder(path: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int
    whole: bool


class ResultReader(DataSourceReader):
    def __init__(self, path: str, split: int, meta: bool):
        self.path, self.split, self.meta = path, split, meta

    def _files(self) -> list[tuple[str, int]]:
        """A file, or the files of a folder: those that its manifest names, or else all that end in .json."""
        from pyarrow import fs

        system, path = open_folder(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        if system.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_file(f"{path}/{MANIFEST}") as f:
                names = json.loads(f.readall())["files"]
            return [(f"{path}/{n}", system.get_file_info(f"{path}/{n}").size) for n in names]
        found = system.get_file_info(fs.FileSelector(path))
        return sorted((f.path, f.size) for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("_"))

    def partitions(self) -> list[InputPartition]:
        """Stretches of bytes of the files whose entries begin a line; other files are one stretch each."""
        system, _ = open_folder(self.path)
        out: list[InputPartition] = []
        for path, size in self._files():
            with system.open_input_file(path) as f:
                lined = f.read(len(MARK) + 1) == b"{" + MARK
            step = self.split if lined else max(size, 1)
            out += [Stretch(path, a, min(a + step, size), not lined) for a in range(0, max(size, 1), step)]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        """The entries that begin in the stretch; the last of them is read to its end."""
        system, _ = open_folder(self.path)
        with system.open_input_file(partition.path) as f:
            if partition.whole:
                yield from self._rows(json.loads(f.readall() or b"{}").items())
                return
            f.seek(partition.start)
            held, at, inside = b"", partition.start, False  # held: bytes from ``at`` on
            while True:
                more = f.read(STEP)
                held += more
                if not inside:
                    mark = held.find(MARK)
                    if mark < 0 or at + mark >= partition.end:
                        if not more or at + len(held) - len(MARK) >= partition.end:
                            return
                        cut = max(0, len(held) - len(MARK) + 1)
                        held, at = held[cut:], at + cut
                        continue
                    held, at, inside = held[mark:], at + mark, True
                while (mark := held.find(MARK, 1)) > 0:
                    if at >= partition.end:
                        return
                    yield from self._entry(held[:mark])
                    held, at = held[mark:], at + mark
                if not more:
                    if at < partition.end:
                        yield from self._entry(held.rstrip().removesuffix(b"}"))
                    return

    def _entry(self, raw: bytes) -> Iterator[tuple]:
        body = raw.rstrip().removesuffix(b",")
        if body.strip():
            yield from self._rows(json.loads(b"{" + body + b"}").items())

    def _rows(self, items) -> Iterator[tuple]:
        for key, r in items:
            if self.meta:
                if key == "_meta":
                    yield (json.dumps(r, ensure_ascii=False),)
            elif key != "_meta":
                r = r or {}
                time = r.get("time")
                yield key, r.get("text"), r.get("tables"), None if time is None else float(time), r.get("error")


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    errors: int


class ResultWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, meta: dict, columns: list[str]):
        self.path, self.overwrite, self.meta, self.columns = path, overwrite, meta, columns

    def write(self, iterator) -> WriterCommitMessage:
        """One file of the task's rows, under a name of its own; nobody reads it before the manifest names it."""
        system, path = open_folder(self.path)
        system.create_dir(path, recursive=True)
        name, rows, errors = f"part-{uuid.uuid4().hex}.json", 0, 0
        with system.open_output_stream(f"{path}/{name}") as f:
            f.write(b"{")
            for row in iterator:
                r = dict(zip(self.columns, row, strict=True))
                key = json.dumps(r["id"] or "", ensure_ascii=False)
                reading = json.dumps({c: r.get(c) for c in ("text", "tables", "time", "error")}, ensure_ascii=False)
                f.write((b"," if rows else b"") + f"\n {key}: {reading}".encode())
                rows, errors = rows + 1, errors + bool(r.get("error"))
            f.write(b"\n}\n")
        return Written(name, rows, errors)

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest makes all files visible at once; files that it no longer names are then deleted."""
        from pyarrow import fs

        system, path = open_folder(self.path)
        system.create_dir(path, recursive=True)
        done = [m for m in messages if m is not None]
        before = []
        old = system.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.File
        if old:
            with system.open_input_file(f"{path}/{MANIFEST}") as f:
                before = json.loads(f.readall())["files"]
        meta = f"meta-{uuid.uuid4().hex}.json"
        entry = {"_meta": self.meta | {"n": sum(m.rows for m in done), "errors": sum(m.errors for m in done)}}
        with system.open_output_stream(f"{path}/{meta}") as f:
            f.write(json.dumps(entry, ensure_ascii=False, indent=1).encode())
        names = ([] if self.overwrite else before) + [m.name for m in done if m.rows] + [meta]
        with system.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps({"files": names}).encode())
        for name in set(before) - set(names):
            system.delete_file(f"{path}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        """Files of tasks that had finished go; what was there before stays visible."""
        system, path = open_folder(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{path}/{m.name}")


class ResultFiles(DataSource):
    """``format("result_files")``: options ``path`` (a file or folder), ``split`` (bytes a task), ``meta`` ("true" reads the ``_meta`` entries as JSON).

    Options that begin with ``meta.`` are written into the ``_meta`` entry, beside the numbers of rows and errors.
    """

    @classmethod
    def name(cls) -> str:
        return "result_files"

    def _meta(self) -> bool:
        return self.options.get("meta", "false").lower() == "true"

    def schema(self) -> str:
        return "meta string" if self._meta() else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ResultReader(self.options["path"], int(self.options.get("split", SPLIT)), self._meta())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if "id" not in schema.fieldNames():
            raise ValueError("results have an id")
        return ResultWriter(self.options["path"], overwrite, {k[5:]: v for k, v in self.options.items() if k.startswith("meta.")}, schema.fieldNames())


def register_results(spark: SparkSession) -> None:
    spark.dataSource.register(ResultFiles)
