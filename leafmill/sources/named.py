"""A sink of named files: rows of one name, in order, become one file of that name, and all files appear when the job is done."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from leafmill.scratch import written

FORMAT = "named_files"
#: Files of a batch at most that is read back, and their bytes, but for a larger file alone.
BATCH_FILES, BATCH_BYTES = 256, 4 << 20


@dataclass
class Written(WriterCommitMessage):
    """Where the list of the files stands that one task has finished. Their names stay there, so what reaches the driver does not grow with the files."""

    listed: str


class NamedFiles(DataSource):
    """[K6, K7] ``df.write.format("named_files").mode("append").save(folder)`` for rows (name, content), a name's rows one behind the other in a task."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["job"])


class _Writer(DataSourceArrowWriter):
    """Each task writes to a folder of its own attempt and lists its files; the driver puts the lists of committed tasks together. ``_moved`` gives the files their names."""

    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def _at(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, _below(root, self.job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, below = self._at()
        folder, listed = f"{below}/{uuid.uuid4().hex}", []
        system.create_dir(folder)
        now, out = None, None
        try:
            for batch in iterator:
                for name, content in zip(batch.column(0), batch.column(1), strict=True):
                    if name.as_py() != now:
                        if out:
                            out.close()
                        now = name.as_py()
                        listed.append({"place": f"{folder}/{len(listed)}", "name": now})
                        out = system.open_output_stream(listed[-1]["place"])
                    out.write(content.as_py() or b"")
        finally:
            if out:
                out.close()
        pq.write_table(pa.Table.from_pylist(listed, pa.schema([("place", pa.string()), ("name", pa.string())])), f"{folder}/list", filesystem=system)
        return Written(f"{folder}/list")

    def commit(self, messages: list[Written | None]) -> None:
        system, below = self._at()
        system.create_dir(f"{below}/{LISTS}")
        for k, message in enumerate(messages):
            if message:
                system.move(message.listed, f"{below}/{LISTS}/{k}.parquet")

    def abort(self, messages: list[Written | None]) -> None:
        system, below = self._at()
        _delete(system, below)


#: The folder, below a job's temporary one, of the lists of its committed tasks.
LISTS = "lists"


def _below(root: str, job: str) -> str:
    return f"{root}/_temporary-{job}"


def _delete(system: fs.FileSystem, folder: str) -> None:
    if system.get_file_info(folder).type != fs.FileType.NotFound:
        system.delete_dir(folder)


def _move(system: fs.FileSystem, place: str, goal: str) -> None:
    """Moved from a place to its goal; a task that is run again finds some there."""
    try:
        system.move(place, goal)
    except OSError:
        found = system.get_file_info([place, goal])
        if found[0].type != fs.FileType.NotFound or found[1].type == fs.FileType.NotFound:
            raise


def _moved(listed: DataFrame, uri: str) -> DataFrame:
    """(name) of the files of ``listed`` (place, name), each moved to its name below ``uri``, by tasks."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for place, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _move(system, place, f"{root}/{name}")
            yield batch.select(["name"])

    return listed.mapInArrow(move, "name string")


def _taken_back(listed: DataFrame, uri: str) -> None:
    """Deletes those files of ``listed`` that have been moved to their names."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for place, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = system.get_file_info([place, f"{root}/{name}"])
                if found[0].type == fs.FileType.NotFound and found[1].type == fs.FileType.File:
                    system.delete_file(f"{root}/{name}")
            yield batch.slice(0, 0)

    listed.mapInArrow(take, listed.schema).count()


def write_named(rows: DataFrame, path: str, name: str, order: list[str], content: str) -> DataFrame:
    """One file below the folder ``path`` for each value of ``name``: the ``content`` (text or bytes) of its rows in ``order``, streamed. Returns (name) of the files, a scratch table.

    The folder must be one that the driver and all tasks reach, by a path or an address (``file:``, ``hdfs:``, ``s3:``). A name's rows are sorted into one
    task and never held together. Files appear only when all tasks have ended; a lost task writes its own files again under another temporary
    name, and a job that fails leaves none. Tasks list their files and give them their names, so the driver holds a row a task, however many files there are. Null contents are empty, rows of null name are left out, slashes in names become ``-``.
    """
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    safe = F.replace(F.col(name), F.lit("/"), F.lit("-"))
    dealt = rows.where(F.col(name).isNotNull()).select(safe.alias("__name"), F.col(content).cast("binary").alias("__content"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)])
    sorted_rows = dealt.repartition("__name").sortWithinPartitions("__name", *[f"__o{k}" for k in range(len(order))]).select("__name", "__content")
    uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
    system, root = fs.FileSystem.from_uri(uri)
    system.create_dir(root)
    job = uuid.uuid4().hex
    sorted_rows.write.format(FORMAT).mode("append").option("job", job).save(uri)
    listed = spark.read.schema("place string, name string").parquet(f"{uri}/{_below('', job)[1:]}/{LISTS}")
    try:
        return written(_moved(listed, uri), "names")[0]
    except Exception:
        _taken_back(listed, uri)
        raise
    finally:
        _delete(system, _below(root, job))


def read_named(names: DataFrame, path: str) -> DataFrame:
    """(name, content) of the files below the folder ``path`` named in the one column of ``names``, opened by tasks.

    A reader that lists the folder would hold an entry a file in the driver.
    """
    uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
    schema = pa.schema([("name", pa.string()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            rows, size = [], 0
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as file:
                    rows.append({"name": name, "content": file.read()})
                size += len(rows[-1]["content"])
                if len(rows) >= BATCH_FILES or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    return names.repartition(names.sparkSession.sparkContext.defaultParallelism).mapInArrow(read, "name string, content binary")
