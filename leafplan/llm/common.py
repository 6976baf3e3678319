"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word: space and the range TAB..CR.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names, by Hadoop's default file system
    if it has no scheme. Only on a local master, where driver and executors are
    one process, a temporary folder is made if that is unset; elsewhere that is
    an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="leafplan-")
        context.setCheckpointDir(root)
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder below the shared one that nothing else uses."""
    return f"{shared_root(spark)}/leafplan-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage: what follows is computed once, and a lost executor
    costs a read, not the stages above. ``files`` deals a table of small rows to
    so many files; without it there is one for each task that has rows.
    """
    path = new_folder(df.sparkSession, name)
    (df if files is None else df.repartition(files)).write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`stored` that nothing lazy reads any more."""
    for table in tables:
        at = table.__dict__.pop("_stored_at", None)
        if at:
            context = table.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns in ``names``, compared without case."""
    gone = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in gone])


def quoted(name: str) -> Column:
    """Column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def hash_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 random bits, decided by ``parts`` alone.

    It is md5 of the parts, joined by colons, so that any SQL engine can make
    the same draw. Null parts read ``null``.
    """
    return hash_bits(*parts) / F.lit(float(1 << 52))


def hash_bits(*parts: Column | str) -> Column:
    """The 52 bits behind :func:`hash_unit` as a long."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 13), 16, 10).cast("long")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def filesystem(uri: str):
    """pyarrow file system and path behind a URI (file, hdfs, s3, gs, ...)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def freeing(run):
    """``run`` (a function of Arrow batches), after which the worker gives freed memory back to the system.

    Workers outlive their tasks and serve other stages: what one stage has freed
    must not count against the next.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            free_memory()

    return wrapped


def free_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc alone has it
        trim(0)


def append_columns(df: DataFrame, fields: str, make, uses: tuple[str, ...] = ("text",), carry: list[str] | None = None, rows_at_once: int = 1 << 30) -> DataFrame:
    """``df`` with columns that Python computes from Arrow batches.

    ``make()`` is called once a task and gives a function from the ``uses``
    columns (pyarrow arrays of up to ``rows_at_once``) to the arrays of
    ``fields`` (DDL). ``carry`` names the input columns to hand on, all of them
    if None. Input columns with the name of a new one, compared without case,
    are left out.
    """
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(fields)
    taken = {f.name.lower() for f in new}
    keep = [c for c in (df.columns if carry is None else carry) if c.lower() not in taken]
    given = df.select(*[quoted(c) for c in keep], *[quoted(u).alias(f"__lp_use{i}") for i, u in enumerate(uses) if u not in keep])
    at = [keep.index(u) if u in keep else given.columns.index(f"__lp_use{i}") for i, u in enumerate(uses)]
    schema = T.StructType([given.schema[i] for i in range(len(keep))] + list(new))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        compute, out = make(), to_arrow_schema(schema)
        for whole in batches:
            for first in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(first, rows_at_once)
                made = compute(*[batch.column(i) for i in at])
                made = [x.cast(out.field(len(keep) + i).type) if isinstance(x, pa.Array) else pa.array(x, type=out.field(len(keep) + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=out.names)

    return given.mapInArrow(freeing(run), schema)


def pieces_of(texts: list, limit: int):
    """Ranges of ``texts`` that hold up to about ``limit`` characters each."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def byte_slices(texts, limit: int):
    """Ranges of a pyarrow string array (null: empty) that hold up to about ``limit`` bytes each."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(texts).fill_null(0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
