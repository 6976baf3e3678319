"""State tables as versioned snapshots behind a pointer.

A save writes a whole snapshot to a folder of its own and then moves a pointer
to it, so a reader sees the old state or the new one, never a part. A broken
pointer is set aside and the state starts empty, or it is an error if asked for.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VERSION = 2


class StateStore:
    """The state of one root in a folder of any file system that Hadoop knows and that renames atomically."""

    def __init__(self, spark: SparkSession, path: str, schema: str, root_id: str):
        self.spark, self.schema, self.root_id = spark, T.StructType.fromDDL(schema), root_id
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        at = self._path(path)
        self.files = at.getFileSystem(context._jsc.hadoopConfiguration())
        # Snapshots and pointer go by one file system, also for a path without a scheme.
        self.path = self.files.makeQualified(at).toString()

    @property
    def pointer(self) -> str:
        return f"{self.path}/current.json"

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _read(self, path: str) -> bytes:
        stream = self.files.open(self._path(path))
        try:
            return bytes(stream.readAllBytes())
        except Py4JJavaError as error:
            if "ChecksumException" in error.java_exception.getClass().getName():
                raise ValueError(f"{path} is damaged") from error
            raise
        finally:
            stream.close()

    def _replace(self, staged: str, target: str) -> None:
        """Moves ``staged`` over ``target``; where that is no single step, a reader meanwhile finds the backup."""
        a, b = self._path(staged), self._path(target)
        if self.files.exists(b):
            backup = self._path(f"{target}.last")
            self.files.delete(backup, False)
            self.files.rename(b, backup)
        if not self.files.rename(a, b):
            raise OSError(f"{target} can't be replaced")

    def load(self, *, strict: bool = False) -> DataFrame:
        """The current snapshot. Another root's state is always an error."""
        pointer = next((p for p in (self.pointer, f"{self.pointer}.last") if self.files.exists(self._path(p))), None)
        if pointer is None:
            return self.empty()
        try:
            at = json.loads(self._read(pointer).decode("utf-8"))
            if at["version"] != VERSION:
                raise ValueError(f"state version {at['version']}")
            snapshot, root = at["snapshot"], at["root_id"]
        except (ValueError, KeyError, TypeError):
            if strict:
                raise
            self.files.rename(self._path(pointer), self._path(f"{self.pointer}.corrupt-{time.time_ns()}"))
            self.files.delete(self._path(f"{self.pointer}.last"), False)
            return self.empty()
        if root != self.root_id:
            raise ValueError("this state belongs to another root")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{snapshot}")

    def save(self, state: DataFrame) -> str:
        """Writes a snapshot and makes it the current one; its name."""
        name = f"snapshot-{uuid.uuid4().hex}"
        state.select(*self.schema.names).write.parquet(f"{self.path}/{name}")
        staged = f"{self.pointer}.{uuid.uuid4().hex}"
        out = self.files.create(self._path(staged), False)
        try:
            out.write(json.dumps({"version": VERSION, "root_id": self.root_id, "snapshot": name}, sort_keys=True).encode())
            out.hsync()
        finally:
            out.close()
        self._replace(staged, self.pointer)
        return name


def commit_files(staged: dict[str, str], persist) -> None:
    """Puts staged files at their targets and calls ``persist``; on any failure all targets are as before."""
    backups: dict[str, str | None] = {}
    try:
        for target, source in staged.items():
            if os.path.getsize(source) == 0:
                raise ValueError(f"{source} is empty")
            backup = f"{target}.backup-{uuid.uuid4().hex}" if os.path.exists(target) else None
            if backup:
                os.replace(target, backup)
            backups[target] = backup
            os.replace(source, target)
        persist()
    except BaseException:
        for target, backup in backups.items():
            if backup:
                os.replace(backup, target)
            elif os.path.exists(target):
                os.remove(target)
        raise
    for backup in backups.values():
        if backup:
            os.remove(backup)


def free_name(wanted: str, taken: set[str]) -> str:
    """``wanted``, or its first form with ``_1``, ``_2``... that isn't taken."""
    stem, dot, ext = wanted.rpartition(".")
    stem, ext = (stem, dot + ext) if stem else (wanted, "")
    k, name = 0, wanted
    while name in taken:
        k += 1
        name = f"{stem}_{k}{ext}"
    return name
