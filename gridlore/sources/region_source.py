"""Region files as a registered data source: spark.read.format("region") and df.write.format("region").

Options: path (a folder's URI), suffix, signature (text), layout (rows or columnar), modelled (true: the newest
grid is entropy-coded when written), newest (read only so many snapshots of a history), level (of compression).
Reading: a partition for each file, files by path; rows as in region_files. Writing: rows with a path are
gathered by it inside a partition, so repartition by path first; a path in two partitions is refused. Files get their
names when the whole job commits; an aborted job leaves none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import regions as rg
from .region_files import FIELDS, NAMES, from_records, to_records


def _layout(options: dict[str, str]) -> rg.Layout:
    kind = options.get("layout", "rows")
    if kind not in ("rows", "columnar"):
        raise ValueError(f"layout {kind}")
    return rg.Layout(
        options["signature"].encode(), columnar=kind == "columnar", level=int(options.get("level", 8)), newest=int(options.get("newest", 0)),
        modelled=options.get("modelled", "false").lower() == "true",
    )


def _files(root: str, suffix: str) -> list[str]:
    fs, base = pafs.FileSystem.from_uri(root)
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
    hidden = lambda p: any(part.startswith((".", "_")) for part in p[len(base) :].split("/"))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(f".{suffix}") and not hidden(f.path))


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.options["path"], self.options["suffix"])] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, base = pafs.FileSystem.from_uri(self.options["path"])
        name = partition.path[len(base) :].lstrip("/")
        try:
            with fs.open_input_file(partition.path) as file:
                rows = to_records(_layout(self.options).decode(file.read()))
        except ValueError as e:
            rows = iter([{"error": str(e)}])
        for r in rows:
            yield (name, *(r.get(n) for n in NAMES))


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (temporary, path)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.options, self.overwrite, self.job = dict(options), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> _Written:
        layout, regions = _layout(self.options), {}
        for r in rows:  # a region's rows are bounded by its format
            if r["error"] is None:
                regions.setdefault(r["path"], []).append(r.asDict())
        fs, base = pafs.FileSystem.from_uri(self.options["path"])
        fs.create_dir(f"{base}/.{self.job}", recursive=True)
        done = []
        while regions:
            path, records = regions.popitem()
            beside = f"{base}/.{self.job}/{uuid.uuid4().hex}"
            with fs.open_output_stream(beside) as out:
                out.write(layout.encode(from_records(records)))
            done.append((beside, f"{base}/{path}"))
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.options["path"])
        files = [f for m in messages if m for f in m.files]
        if len({p for _, p in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows of one path were in several partitions")
        if self.overwrite:
            for old in set(_files(self.options["path"], self.options["suffix"])) - {p for _, p in files}:
                fs.delete_file(old)
        for beside, path in files:
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            fs.move(beside, path)
        fs.delete_dir(f"{base}/.{self.job}")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, base = pafs.FileSystem.from_uri(self.options["path"])
        if fs.get_file_info(f"{base}/.{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/.{self.job}")


class RegionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "region"

    def schema(self) -> str:
        return f"path string, {FIELDS}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)
