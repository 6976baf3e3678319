"""Inventory of a file tree: filters, names, collisions, natural order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafplan.functions import strings as S


def visible(files: DataFrame) -> DataFrame:
    """Without hidden and system files (column ``file_name``; ``system_flag`` if the source has it)."""
    keep = ~S.is_hidden(F.col("file_name"))
    if "system_flag" in files.columns:
        keep = keep & ~F.coalesce(F.col("system_flag"), F.lit(False))
    return files.where(keep)


def inventory(files: DataFrame, group: str = "employee_name") -> DataFrame:
    """Supported visible files with ``target_pdf`` and ``is_collision``.

    Files of one group whose stems are equal without case collide, and each
    then names its extension in its target.
    """
    some = visible(files).where(S.file_extension(F.col("file_name")).isin(*S.SUPPORTED_EXTENSIONS))
    stem = F.lower(S.file_stem(F.col("file_name")))
    # Files with the same name are one file; only different ones collide.
    peers = W.partitionBy(group, stem)
    collides = (F.min("file_name").over(peers) != F.max("file_name").over(peers))
    return some.withColumn("is_collision", collides).withColumn("target_pdf", S.target_pdf(F.col("file_name"), F.col("is_collision")))


def in_natural_order(files: DataFrame, group: str = "employee_name") -> DataFrame:
    """Sorted by group and name as people count; equal keys by the raw names."""
    return files.orderBy(S.natural_key(F.col(group)), F.col(group), S.natural_key(F.col("file_name")), F.col("file_name"))


def natural_position(files: DataFrame, group: str = "employee_name", by: str = "file_name", tie: str = "relative_path") -> DataFrame:
    """Adds ``position`` from 1 within each group, in natural order."""
    return files.withColumn("position", F.row_number().over(W.partitionBy(group).orderBy(S.natural_key(F.col(by)), F.col(by), F.col(tie))))


def unsupported_count(files: DataFrame, group: str = "employee_name") -> DataFrame:
    """Per group: supported and unsupported visible files."""
    good = S.file_extension(F.col("file_name")).isin(*S.SUPPORTED_EXTENSIONS)
    return visible(files).groupBy(group).agg(F.count_if(good).alias("supported"), F.count_if(~good).alias("unsupported"))


def collision_free_names(pages: DataFrame) -> DataFrame:
    """Adds ``artifact_name``: only names that several pages share get a fingerprint.

    Columns: employee_name, year, month, page_type, page_order, relative_path.
    """
    base = S.page_file_name(*[F.col(c) for c in ("employee_name", "year", "month", "page_type", "page_order", "relative_path")])
    shared = F.count(F.lit(1)).over(W.partitionBy("base_name")) > 1
    named = pages.withColumn("base_name", base)
    return named.withColumn("artifact_name", F.when(shared, F.concat(F.regexp_replace("base_name", r"\.pdf$", ""), F.lit("_"), S.source_fingerprint(F.col("relative_path")), F.lit(".pdf"))).otherwise(F.col("base_name")))
