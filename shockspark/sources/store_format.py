"""The store as a data source of its own: ``spark.read.format("shockstore")``.

After ``register(spark)`` a table is a folder of Parquet files and of commits:

* a write task makes files of at most ``rowsPerFile`` rows in a folder of the job and
  reports their names and row counts; the job's commit lists them in ``commits/<n>.json``,
  put in place by a rename.  A job that fails deletes its folder, and nothing of it is ever
  visible: readers take files from the newest commit only.  ``overwrite`` starts a new
  list, ``append`` adds to the old one; files of older commits stay for their readers;
* a read makes one partition a file, reads the asked columns only, as Arrow batches, and
  takes comparisons of whole numbers, dates and texts with constants into the scan, where
  statistics skip row groups.  Other filters stay with Spark.

A path is anything ``pyarrow.fs`` opens (local, ``hdfs://``, ``s3://``) that all executors
reach.  Defined cases: an empty frame makes an empty table with its columns; reading a
folder without a commit is an error that names it; nulls match no pushed comparison.  One
writer at a time is assumed: of two jobs that start from the same commit the later one wins
(``versioned.py`` rejects it instead).
"""

from __future__ import annotations

import json
import posixpath
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "shockstore"
ROWS_PER_FILE = 1_000_000
COMPARED = {D.EqualTo: "__eq__", D.GreaterThan: "__gt__", D.GreaterThanOrEqual: "__ge__", D.LessThan: "__lt__", D.LessThanOrEqual: "__le__"}
EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.StringType)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _commits(files: fs.FileSystem, root: str) -> list[str]:
    """Paths of the commits, oldest first."""
    found = files.get_file_info(fs.FileSelector(posixpath.join(root, "commits"), allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))


def _content(path: str, number: int | None = None) -> dict | None:
    """The newest commit or that of a number (None if there is no such commit)."""
    files, root = _opened(path)
    commits = [c for c in _commits(files, root) if number in (None, int(posixpath.basename(c)[:-5]))]
    if not commits:
        return None
    with files.open_input_stream(commits[-1]) as f:
        return json.loads(f.read())


@dataclass
class FilePartition(D.InputPartition):
    file: str


@dataclass
class Written(D.WriterCommitMessage):
    files: list[tuple[str, int]]


class StoreReader(D.DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, files: list):
        self.path, self.schema, self.files = path, schema, files
        self.kept: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Keep the comparisons whose result is the same here and in Spark, return the rest."""
        types = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            exact = isinstance(types.get(column), EXACT)
            if exact and type(f) in COMPARED and f.value is not None:
                self.kept.append((column, COMPARED[type(f)], f.value))
            elif exact and isinstance(f, D.In) and None not in f.value:
                self.kept.append((column, "isin", list(f.value)))
            elif column in types and isinstance(f, D.IsNotNull):
                self.kept.append((column, "is_valid", None))
            else:
                yield f

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(name) for name, count in self.files if count]

    def read(self, partition: FilePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not getattr(partition, "file", None):
            return
        files, root = _opened(self.path)
        condition = None
        for column, test, value in self.kept:
            field = ds.field(column)
            one = field.is_valid() if test == "is_valid" else getattr(field, test)(value if test == "isin" else pa.scalar(value))
            condition = one if condition is None else condition & one
        table = ds.dataset(posixpath.join(root, partition.file), filesystem=files, format="parquet")
        yield from table.to_batches(columns=[f.name for f in self.schema.fields], filter=condition, use_threads=False)


class StoreWriter(D.DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, rows_per_file: int):
        self.path, self.schema, self.overwrite, self.rows_per_file = path, schema, overwrite, rows_per_file
        self.folder = posixpath.join("data", uuid.uuid4().hex)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = _opened(self.path)
        files.create_dir(posixpath.join(root, self.folder))
        shape = to_arrow_schema(self.schema)
        done: list[tuple[str, int]] = []
        out, count = None, 0
        try:
            for batch in batches:
                if out is None:
                    # a name of its own for every attempt of a task
                    name = posixpath.join(self.folder, f"{uuid.uuid4().hex}.parquet")
                    out, count = pq.ParquetWriter(posixpath.join(root, name), shape, filesystem=files), 0
                out.write_table(pa.Table.from_batches([batch]).cast(shape))
                count += batch.num_rows
                if count >= self.rows_per_file:
                    out.close()
                    out = None
                    done.append((name, count))
        finally:
            if out is not None:
                out.close()
        return Written(done + [(name, count)] if out is not None else done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        old = None if self.overwrite else _content(self.path)
        if old and old["schema"] != self.schema.jsonValue():
            raise ValueError(f"the rows appended to {self.path} have other columns than the table")
        listed = (old["files"] if old else []) + sorted(f for m in messages if m for f in m.files)
        commits = _commits(files, root)
        number = int(posixpath.basename(commits[-1]).split(".")[0]) + 1 if commits else 0
        folder = posixpath.join(root, "commits")
        files.create_dir(folder)
        beside = posixpath.join(folder, f".{uuid.uuid4().hex}.json")
        with files.open_output_stream(beside) as f:
            f.write(json.dumps({"schema": self.schema.jsonValue(), "files": listed}).encode())
        files.move(beside, posixpath.join(folder, f"{number:012d}.json"))

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        if files.get_file_info(posixpath.join(root, self.folder)).type == fs.FileType.Directory:
            files.delete_dir(posixpath.join(root, self.folder))


class StoreFormat(D.DataSource):
    """Options: ``path``, for reads ``commit`` (a number; else the newest when the frame is
    planned), for writes ``rowsPerFile``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def committed(self) -> dict:
        number = self.options.get("commit")
        content = _content(self.options["path"], None if number is None else int(number))
        if content is None:
            raise FileNotFoundError(f"no committed table at {self.options['path']}")
        return content

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.committed()["schema"])

    def reader(self, schema: T.StructType) -> StoreReader:
        return StoreReader(self.options["path"], schema, self.committed()["files"])

    def writer(self, schema: T.StructType, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options["path"], schema, overwrite, int(self.options.get("rowsPerFile", ROWS_PER_FILE)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it.  The classes travel to
    the workers by value, so these need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreFormat)
