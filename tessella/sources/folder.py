"""A folder of text files as a table. Tasks list paths and read contents, a failure in one row."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.scratch import materialise

EXTENSIONS = ("txt", "md", "markdown", "csv", "tsv", "json", "log", "text")
SCHEMA = "path string, file_name string, size long, mtime_ms long, sha256 string, text string, char_count long, error string"


def _is_source(name: str) -> bool:
    return "." in name[1:] and name.rpartition(".")[2].lower() in EXTENSIONS


def _files(folder: str, deep: bool) -> Iterator[str]:
    """Regular files of the known extensions in a folder, or anywhere below it. Folders that can't be read are passed over."""
    for d, below, names in os.walk(folder):
        yield from (p for p in (os.path.join(d, n) for n in names if _is_source(n)) if os.path.isfile(p) and not os.path.islink(p))
        if not deep:
            below.clear()


def list_files(spark: SparkSession, root: str, folders: int = 64) -> DataFrame:
    """(path) of regular files of the known extensions below root. Hidden and empty ones count; unreadable folders don't stop it.

    The driver goes down only until it has enough folders to deal out; tasks list what is in and below them.
    """
    todo, done = [root], []
    while todo and len(todo) < folders:
        folder = todo.pop(0)
        done.append((folder, False))
        try:
            with os.scandir(folder) as entries:
                todo += sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
        except OSError:
            continue
    rows = done + [(d, True) for d in todo]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, deep in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for some in batched(_files(folder, deep), 10_000):
                    yield pa.RecordBatch.from_pydict({"path": pa.array(some, pa.string())})

    return spark.createDataFrame(rows, "folder string, deep boolean").repartition(len(rows)).mapInArrow(run, "path string")


def _read(path: str, text: bool) -> tuple:
    try:
        with open(path, "rb") as f:
            data = f.read()
        found = data.decode("utf-8", "replace")
        return path, os.path.basename(path), len(data), os.stat(path).st_mtime_ns // 1_000_000, hashlib.sha256(data).hexdigest(), found if text else None, len(found), None
    except OSError as e:
        return path, os.path.basename(path), None, None, None, None, None, str(e)


def read_files(paths: DataFrame, text: bool = True) -> DataFrame:
    """Each file's text, digest, size and time, from its path; a file that can't be read has an error instead.

    Bytes that aren't UTF-8 become U+FFFD. Without text, that column is null and files only pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        labels = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for i in range(0, b.num_rows, 16):
                rows = [_read(p, text) for p in b.column(0).slice(i, 16).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=labels)

    return paths.select("path").mapInArrow(run, SCHEMA)


def read_folder(spark: SparkSession, root: str, per_task: int = 64, text: bool = True) -> DataFrame:
    """read_files for all files below root.

    The folder must be one that all executors see. Spark's own file sources skip names that begin
    with a dot or underscore, and empty files, so the names are listed by tasks of our own.
    """
    paths = materialise(list_files(spark, root), "paths")
    return read_files(paths.repartition(max(1, paths.count() // per_task)), text)
