"""JSON documents of any size as single files at given paths, written by a Python data source.

A document is not one row but sorted rows: ``path``, ``field`` and ``json``, a field's value (``kind`` value), the start of an array (array) or an item of
the array that was started last (item). A row of the kind text is a file's whole content, whatever it is. A task streams the rows of each of its documents into one file, so that a document with millions of
items needs no more memory than its largest item. Files are written below a staging folder and moved to their places when all tasks
are done: nothing is seen of a run that fails, files that a run doesn't write are left alone, and attempts of lost or repeated tasks
don't count. The driver hears of one folder a task: the names of a task's files lie in a list beside them, and tasks move them.
"""

from __future__ import annotations

import io
import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quernel.session import BATCH_BYTES

ROWS = "path string, kind string, field string, json string"
INDENT = 2
LIST = "files"  # final paths of a task's files, one JSON text a line, in the order of their numbers
CONTENTS = "path string, content binary"
BATCH_FILES = 1000


def file_system(path: str):
    """(file system, path in it) of a path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def laid_out(value: str, depth: int) -> str:
    """JSON text over several lines, indented below its first line."""
    text = json.dumps(json.loads(value), ensure_ascii=False, indent=INDENT)
    return text.replace("\n", "\n" + " " * (INDENT * depth))


@dataclass
class Staged(WriterCommitMessage):
    attempt: str  # the folder below the staging folder


class _File:
    """One document that is being written."""

    def __init__(self, stream):
        self.stream, self.fields, self.items = stream, 0, None  # items: number of those in the open array

    def put(self, text: str) -> None:
        self.stream.write(text.encode("utf-8"))

    def end_array(self) -> None:
        if self.items is not None:
            self.put(f"\n{' ' * INDENT}]" if self.items else "]")
            self.items = None

    def add(self, kind: str, field: str, value: str | None) -> None:
        if kind == "text":
            self.put(value)
            self.fields = None
            return
        if kind == "item":
            if self.items is None:
                raise ValueError(f"an item of {field} without its array")
            self.put(f"{',' if self.items else ''}\n{' ' * (2 * INDENT)}{laid_out(value, 2)}")
            self.items += 1
            return
        self.end_array()
        self.put(f"{',' if self.fields else '{'}\n{' ' * INDENT}{json.dumps(field, ensure_ascii=False)}: ")
        self.fields += 1
        if kind == "array":
            self.put("[")
            self.items = 0
        else:
            self.put(laid_out(value, 1))

    def close(self) -> None:
        self.end_array()
        if self.fields is not None:
            self.put("\n}" if self.fields else "{}")
        self.stream.close()


class JsonFilesWriter(DataSourceWriter):
    """Leaves the files in the staging folder, with the attempts that count in the file ``LIST`` there."""

    def __init__(self, staging: str):
        self.staging = staging

    def write(self, rows) -> Staged:
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}"
        system, folder = file_system(f"{self.staging}/{attempt}")
        system.create_dir(folder, recursive=True)
        number, path, current = 0, None, None
        with system.open_output_stream(f"{folder}/{LIST}") as names:
            for row in rows:
                if current is None or row.path != path:
                    if current:
                        current.close()
                    current, path = _File(system.open_output_stream(f"{folder}/{number}")), row.path
                    names.write(f"{json.dumps(path)}\n".encode())
                    number += 1
                current.add(row.kind, row.field, row.json)
            if current:
                current.close()
        return Staged(attempt)

    def commit(self, messages) -> None:
        system, folder = file_system(self.staging)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{LIST}") as out:
            out.write("\n".join(m.attempt for m in messages if m).encode())

    def abort(self, messages) -> None:
        delete(self.staging)


def delete(path: str) -> None:
    system, folder = file_system(path)
    if system.get_file_info(folder).type.name == "Directory":
        system.delete_dir(folder)


def _move(staging: str, attempts: list[str]):
    """Moves the files of attempts (their numbers come as rows) to their places; what a lost task has moved already is passed over."""

    def move(system, source: str, target: str) -> None:
        try:
            system.move(source, target)
        except OSError:
            if system.get_file_info(source).type.name != "NotFound" or system.get_file_info(target).type.name != "File":
                raise

    def run(batches):
        for batch in batches:
            for attempt in batch.column(0).to_pylist():
                system, folder = file_system(f"{staging}/{attempts[attempt]}")
                number, made = -1, set()
                with system.open_input_stream(f"{folder}/{LIST}") as names:
                    for number, line in enumerate(io.TextIOWrapper(names, encoding="utf-8")):
                        target = file_system(json.loads(line))[1]
                        parent = target.rsplit("/", 1)[0]
                        if parent not in made:
                            system.create_dir(parent, recursive=True)
                            made.add(parent)
                        move(system, f"{folder}/{number}", target)
                yield pa.RecordBatch.from_arrays([pa.array([number + 1], pa.int64())], ["files"])

    return run


class JsonFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_files"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> JsonFilesWriter:
        return JsonFilesWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str, order: list) -> None:
    """Write ``rows`` (path, kind, field, json and the columns of ``order``) as one file for each path; paths lie below ``folder``, where files
    are staged. ``order`` is the order of the rows of a document."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(JsonFiles)
    placed = rows.repartition("path").sortWithinPartitions("path", *order)
    staging = f"{folder.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    try:
        placed.select("path", "kind", "field", "json").write.format("json_files").mode("append").option("path", staging).save()
        system, staged = file_system(staging)
        with system.open_input_stream(f"{staged}/{LIST}") as found:
            attempts = found.read().decode().split()  # one a task
        if attempts:
            numbers = spark.range(0, len(attempts), 1, len(attempts))
            numbers.mapInArrow(_move(staging, attempts), "files long").agg(F.sum("files")).collect()
    finally:
        delete(staging)


def read_folders(folders: DataFrame) -> DataFrame:
    """(path, content) of the files that lie in folders (folder, each once): tasks list and read them, so that no name passes through the driver.

    A folder is one task's work at a time; batches end at about BATCH_BYTES.
    """
    spark = folders.sparkSession
    spread = folders.select("folder").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folder")
    return spread.mapInArrow(_contents, CONTENTS)


def _contents(batches):
    def batch_of(rows):
        paths, contents = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    rows, size = [], 0
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            system, place = file_system(folder)
            for info in system.get_file_info(fs.FileSelector(place)):
                if info.type == fs.FileType.File:
                    with system.open_input_stream(info.path) as stream:
                        rows.append((f"{folder}/{info.base_name}", stream.read()))
                    size += len(rows[-1][1])
                    if size >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                        yield batch_of(rows)
                        rows, size = [], 0
    if rows:
        yield batch_of(rows)


def field_rows(documents: DataFrame, fields: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """(keep, at, kind, field, json) of documents that are rows: ``fields`` are names and columns, of which arrays become an array and its items."""
    parts = []
    for at, (name, column) in enumerate(fields):
        whole = F.to_json(F.struct(F.col(column).alias("v")), {"ignoreNullFields": "false"})
        value = F.substring(whole, F.lit(6), F.length(whole) - 6)  # between {"v": and }
        parts.append(F.struct(F.lit(at).alias("at"), F.lit("value").alias("kind"), F.lit(name).alias("field"), value.alias("json")))
    return documents.select(*keep, F.explode(F.array(*parts)).alias("f")).select(*keep, "f.*")
