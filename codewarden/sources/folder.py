"""A data source for source trees on a mounted folder: ``spark.read.format("codefolder")``.

The folder is walked once for names and sizes; a skipped directory is never
entered and a skipped file never opened, so what lies in them does not matter.
Files are dealt out to tasks by size, and only a task opens its own files.
Options: ``path`` (the root), ``repo`` (its name in the rows), ``limit`` (bytes
above which a file has no content) and ``taskbytes`` (bytes dealt to a task).

* links and special files are left out, like directories that cannot be listed;
* a file that is gone or unreadable by the time it is opened has no content;
* bytes that are not UTF-8 become replacement characters.

Trees in a store that only Spark can open are read by `corpus.read_files`.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.fixed import MAX_FILE_BYTES, SKIP_DIRS, SKIP_ENDINGS, SKIP_NAMES

SCHEMA = "repo string, path string, size long, content string"
#: Bytes that a task reads, about; a file costs at least ``OPEN`` of them.
TASK_BYTES, OPEN = 64 << 20, 64 << 10
#: A tree of more tasks than this gets longer ones: starting a task costs more than opening its few files.
MAX_TASKS = 1024
#: Content handed on at once.
BATCH_BYTES = 8 << 20


def listing(root: str) -> Iterator[tuple[str, int]]:
    """(relative path, size) of the files that are wanted, folder by folder in name order."""
    waiting = [""]
    while waiting:
        folder = waiting.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            continue
        below = []
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in SKIP_DIRS:
                    below.append(path)
            elif e.is_file(follow_symlinks=False) and e.name.lower() not in SKIP_NAMES and not e.name.lower().endswith(tuple(SKIP_ENDINGS)):
                try:
                    yield path, e.stat(follow_symlinks=False).st_size
                except OSError:
                    continue
        waiting += reversed(below)


def dealt(files: list[tuple[str, int]], limit: int, task_bytes: int, most: int = MAX_TASKS) -> list[list[tuple[str, int]]]:
    """Files in order, cut into runs of about ``task_bytes`` to read, or more where that gives over about ``most`` of them;
    those without content cost their opening only."""
    price = lambda size: max(size if size <= limit else 0, OPEN)
    task_bytes = max(task_bytes, -(-sum(price(size) for _, size in files) // most))
    out, used = [], task_bytes
    for path, size in files:
        cost = price(size)
        if used + cost > task_bytes:
            out.append([])
            used = 0
        out[-1].append((path, size))
        used += cost
    return out


@dataclass
class FolderPart(InputPartition):
    files: list[tuple[str, int]]


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.repo = options.get("repo", os.path.basename(self.root.rstrip("/")))
        self.limit = int(options.get("limit", MAX_FILE_BYTES))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def partitions(self):
        return [FolderPart(f) for f in dealt(list(listing(self.root)), self.limit, self.task_bytes)] or [FolderPart([])]

    def _content(self, path: str, size: int) -> str | None:
        if size > self.limit:
            return None
        try:
            # A path that became a link since the listing is not followed.
            with open(os.open(os.path.join(self.root, path), os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
                return f.read(self.limit).decode("utf-8", "replace")
        except OSError:
            return None

    def read(self, partition: FolderPart):
        rows, held = [], 0

        def batch():
            path, size, content = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array([self.repo] * len(rows)), pa.array(path), pa.array(size, pa.int64()), pa.array(content, pa.string())],
                                              ["repo", "path", "size", "content"])

        for path, size in partition.files:
            rows.append((path, size, self._content(path, size)))
            held += len(rows[-1][2] or "") + 256
            if held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codefolder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def read_folder(spark: SparkSession, root: str, repo: str, limit: int = MAX_FILE_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(repo, path, size, content) of a tree on a folder that all nodes have mounted."""
    spark.dataSource.register(FolderSource)
    return spark.read.format(FolderSource.name()).options(repo=repo, limit=limit, taskbytes=task_bytes).load(root)
