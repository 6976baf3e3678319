"""A file tree as a table, with times in nanoseconds.

Spark's own listings have times in microseconds; equality of times decides what
is processed again, so this data source reads them whole. Each direct folder of
the root is a partition, so a large tree is listed by many tasks.
"""

from __future__ import annotations

import hashlib
import os
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Folder(InputPartition):
    def __init__(self, name: str):
        self.name = name


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].removeprefix("file://")
        self.flat = str(options.get("flat", "false")).lower() == "true"
        self.hash = str(options.get("hash", "false")).lower() == "true"

    def partitions(self):
        if self.flat:
            return [_Folder("")]
        return [_Folder(e.name) for e in sorted(os.scandir(self.root), key=lambda e: e.name) if e.is_dir() and not e.name.startswith((".", "~$"))] or [_Folder("\0")]

    def read(self, partition):
        if partition.name == "\0":
            return
        folder = os.path.join(self.root, partition.name) if partition.name else self.root
        for e in os.scandir(folder):
            if e.is_file():
                stat = e.stat()
                digest = None
                if self.hash:
                    with open(e.path, "rb") as f:
                        digest = hashlib.file_digest(f, "sha256").hexdigest()
                yield partition.name, e.name, str(PurePosixPath(partition.name, e.name)), stat.st_size, stat.st_mtime_ns, digest


class TreeSource(DataSource):
    """``spark.read.format("leafplan_tree").load(root)``; options flat and hash."""

    @classmethod
    def name(cls):
        return "leafplan_tree"

    def schema(self):
        return "employee_name string, file_name string, relative_path string, size long, mtime_ns long, sha256 string"

    def reader(self, schema):
        return TreeReader(self.options)


def file_tree(spark: SparkSession, root: str, *, flat: bool = False, content_hash: bool = False) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("leafplan_tree").options(flat=flat, hash=content_hash).load(root)
