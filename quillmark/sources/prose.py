"""A Spark data source for folders of prose: ``spark.read.format("prose").load(folder)``, a stream of it, and a writer.

Reading gives DOCUMENT, a row for each file, as ``read_files`` does: the same ids, languages by extension, bytes that are
no UTF-8 as replacement characters; empty files, which ``read_files`` has no rows of, are empty texts. Files are dealt into partitions of about ``partitionBytes``; what Python can't open
through pyarrow's file systems is for ``read_files``, as are folders too large to be listed on the driver.

As a stream, files are taken in the order of their time and path; an offset is the last file taken, so a restart goes on
behind it. A file that appears with a time before that offset is not seen.

Writing takes rows of ``path`` (relative) and ``content`` (binary) and puts each into a file of its own. A task writes
into a hidden folder; committing renames it, one rename for each task, and a failed job leaves nothing that a reader sees.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quillmark.operators.masking import resolve_lang
from quillmark.sources.files import DOCUMENT

PARTITION_BYTES = 64 << 20
#: Spark's seed of xxhash64.
SEED = 42


def _system(path: str):
    """(file system, path in it, what its paths begin with outside)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = f"file://{posixpath.abspath(path)}"
    elif path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/"), "file:" if path.startswith("file:") else path.split(inner, 1)[0]


def _files(path: str) -> list[tuple[int, str, int]]:
    """(time, path, bytes) of the files below, in the order of a stream; hidden ones and those in hidden folders are left out."""
    from pyarrow import fs

    system, inner, _ = _system(path)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    seen = (f for f in found if f.is_file and not any(p.startswith((".", "_")) for p in f.path[len(inner) :].split("/")))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in seen)


@dataclass
class Files(InputPartition):
    paths: list[str]


def dealt(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    """Neighbours together up to ``most`` bytes; a larger file alone."""
    out, now, size = [], [], 0
    for _, path, n in files:
        if now and size + n > most:
            out.append(Files(now))
            now, size = [], 0
        now.append(path)
        size += n
    return [*out, Files(now)] if now else out


class Prose(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prose"

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Stream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, schema, overwrite)


class _Rows:
    def __init__(self, options: dict):
        self.path, self.most, self.lang = options["path"], int(options.get("partitionBytes", PARTITION_BYTES)), options.get("lang")

    def read(self, partition: Files) -> Iterator:
        import pyarrow as pa
        import xxhash

        system, _, lead = _system(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                raw = f.read()
            name = lead + path
            row = [xxhash.xxh64_intdigest(name.encode(), SEED), name, raw.decode("utf-8", "replace"), resolve_lang(self.lang, path)]
            row[0] -= (row[0] >> 63) << 64
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["doc_id", "path", "text", "lang"])


class Reader(_Rows, DataSourceReader):
    def partitions(self) -> list[Files]:
        return dealt(_files(self.path), self.most) or [Files([])]


class Stream(_Rows, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, last = (start["time"], start["path"]), (end["time"], end["path"])
        return dealt([f for f in _files(self.path) if after < f[:2] <= last], self.most)


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    rows: int


class Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if [f.name for f in schema.fields] != ["path", "content"]:
            raise ValueError("prose is written from the columns path and content")
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator) -> Written:
        system, inner, _ = _system(self.path)
        folder, rows = f"_{uuid.uuid4().hex}", 0
        for row in iterator:
            name = posixpath.normpath(row.path)
            if name.startswith(("/", "..")):
                raise ValueError(f"{row.path!r} is no path below the folder")
            target = f"{inner}/{folder}/{name}"
            system.create_dir(posixpath.dirname(target), recursive=True)
            with system.open_output_stream(target) as f:
                f.write(bytes(row.content or b""))
            rows += 1
        return Written(folder if rows else None, rows)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, inner, _ = _system(self.path)
        if self.overwrite:
            mine = {m.folder for m in messages if m}
            for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                if f.base_name not in mine:
                    system.delete_dir(f.path) if f.type == fs.FileType.Directory else system.delete_file(f.path)
        system.create_dir(inner, recursive=True)
        for m in messages:
            if m and m.folder:
                system.move(f"{inner}/{m.folder}", f"{inner}/part{m.folder}")

    def abort(self, messages: list) -> None:
        system, inner, _ = _system(self.path)
        for m in messages:
            if m and m.folder:
                system.delete_dir(f"{inner}/{m.folder}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Prose)
