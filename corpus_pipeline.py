"""From raw documents to piece ids of a cleaned, deduplicated, weighted mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``; all but the last return
the columns of ``documents``. Every stage works on all that its predecessor kept.

In every stage a null text counts as an empty one (no stage but the classifier
and the rules rejects it), a null doc_id is a document like any other, rows of
one doc_id with different texts are documents of their own, texts of any length
are taken whole, an empty table gives an empty one, and columns beyond those of
``documents`` are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The operators are imported by the stages that call them.

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it is fitted on the labelled among ``docs``."""
    from leafplan.llm import kn_classifier
    from leafplan.llm.common import quoted

    judged = kn_classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = judged.where("not kept").select(F.col("doc_id").alias("__lp_id"), F.col("text_key").alias("__lp_key")).distinct()
    key = F.xxhash64(F.coalesce(quoted("text"), F.lit("")))
    return docs.join(rejected, quoted("doc_id").eqNullSafe(F.col("__lp_id")) & (key == F.col("__lp_key")), "left_anti").select(*COLUMNS)


def quality_rule_cascade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and every rule."""
    from leafplan.llm import quality_rules

    return quality_rules.judge_quality(docs).where("kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles), once: that of the least doc_id, and of its texts that of the least hash.

    Rows are told apart by doc_id and text: different texts of one doc_id are
    documents of their own, and only true copies of a row are reduced to one.
    """
    from leafplan.llm import near_dedup
    from leafplan.llm.common import quoted

    near = near_dedup.near_duplicates(docs, with_text_key=True)
    first = near.where("first").select(F.col("doc_id").alias("__lp_id"), F.col("text_key").alias("__lp_first")).distinct()
    keyed = docs.withColumn("__lp_key", F.xxhash64(F.coalesce(quoted("text").cast("string"), F.lit(""))))
    joined = keyed.join(first, quoted("doc_id").eqNullSafe(F.col("__lp_id")) & (F.col("__lp_key") == F.col("__lp_first")), "left_semi")
    return joined.dropDuplicates(["doc_id", "__lp_key"]).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order."""
    from leafplan.llm import mixing
    from leafplan.llm.queries import SOURCE_WEIGHTS

    return mixing.mix_sources(docs, SOURCE_WEIGHTS).select(*COLUMNS)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document, with digests of a decoding."""
    from leafplan.llm import piece_codec
    from leafplan.llm.queries import tokenizer_file

    model = tokenizer_file("piece_bpe_32k.model")
    return piece_codec.piece_digests(docs, model, carry=["doc_id", "lang", "source"], with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rule_cascade),
    ("near_dedup", near_dedup_stage),
    ("source_mixing", source_mixing),
    ("sentencepiece", piece_encoding),
]

#: Training a model, near-duplicate components and piece ids can't be put in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    from leafplan.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
