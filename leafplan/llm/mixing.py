"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is ``epochs * share * total / size``: its
share of the target weights against the size that it has. A document is then
repeated a Poisson number of times with that mean. The number comes from
inverting the distribution at a hash of seed and doc_id, so it neither depends
on partitions nor changes when a task runs again. Copies are exploded and dealt
out by another hash, which is a global shuffle.

Only the per-source totals are ever gathered; a source that holds most rows is
pre-aggregated by each task and never moved as a group.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_bits, quoted, stored, without

#: A rate table of up to so many sources (tens of bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Largest mean of one draw; a larger rate is the sum of several draws.
LARGEST_MEAN = 500.0


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, *, default_weight: float = 1.0, epochs: float = 1.0) -> tuple[DataFrame, int]:
    """One row per source: ``source, size, weight, rate`` and the number of sources.

    A document's size is its characters plus one, so no source has size zero. A
    source without an entry in ``weights``, the null source included, has
    ``default_weight``. If all weights are zero, all rates are.
    """
    weight = F.lit(float(default_weight))
    if weights:
        table = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))])
        weight = F.coalesce(F.element_at(table, F.coalesce(F.col("source"), F.lit("\0"))), weight)
    sizes = docs.select(quoted("source").cast("string").alias("source"), (F.coalesce(F.length(quoted("text").cast("string")), F.lit(0)) + 1).cast("long").alias("size"))
    sums = stored(sizes.groupBy("source").agg(F.sum("size").alias("size")).withColumn("weight", weight), "rates")
    n, total, all_weights = sums.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    share = F.col("weight") / F.lit(all_weights) if all_weights > 0 else F.lit(0.0)
    return sums.withColumn("rate", F.lit(float(epochs)) * share * F.lit(float(total)) / F.col("size")), n


def with_distribution(rates: DataFrame) -> DataFrame:
    """Adds ``draws`` and the cumulative distribution ``cdf`` of one draw."""
    out = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN).cast("int"))).withColumn("mean", F.col("rate") / F.col("draws"))
    reach = F.ceil(F.col("mean") + 12 * F.sqrt(F.col("mean")) + 40).cast("int")
    first = F.exp(-F.col("mean"))
    terms = F.aggregate(
        F.sequence(F.lit(1), reach),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")),
        lambda a, k: F.struct((a["p"] * F.col("mean") / k).alias("p"), (a["c"] + a["p"] * F.col("mean") / k).alias("c"), F.concat(a["all"], F.array(a["c"] + a["p"] * F.col("mean") / k)).alias("all")),
        lambda a: a["all"],
    )
    return out.withColumn("cdf", terms).drop("mean")


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, *, default_weight: float = 1.0, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs`` replicated to the target weights and shuffled globally.

    Adds ``copy`` (int, from 0) and ``shuffle_key`` (long; rows of a partition
    stand in its order, and partitions are dealt by its hash). Columns needed:
    doc_id, text, source. A null or repeated doc_id draws like any other value,
    rows with the same doc_id alike; an empty table gives an empty one.
    """
    rates, n = source_rates(docs, weights, default_weight=default_weight, epochs=epochs)
    rates = with_distribution(rates).select(F.col("source").alias("__lp_source"), F.col("draws").alias("__lp_draws"), F.col("cdf").alias("__lp_cdf"))
    rates = F.broadcast(rates) if n <= BROADCAST_SOURCES else rates
    docs = without(docs, ["copy", "shuffle_key"])
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col("__lp_draws") - 1),
        F.lit(0),
        lambda a, i: a + F.size(F.filter(F.col("__lp_cdf"), lambda c: c <= hash_bits(seed, i, quoted("doc_id")) / F.lit(float(1 << 52)))),
    )
    # One draw is the rule; outside the lambda its hash is made once, not once for each entry.
    one = hash_bits(seed, F.lit(0), quoted("doc_id")) / F.lit(float(1 << 52))
    out = docs.join(rates, quoted("source").cast("string").eqNullSafe(F.col("__lp_source")), "left").withColumn("__lp_u", one)
    copies = F.when(F.col("__lp_draws") == 1, F.size(F.filter("__lp_cdf", lambda c: c <= F.col("__lp_u")))).otherwise(drawn)
    out = out.withColumn("__lp_n", copies).where(F.col("__lp_n") > 0)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__lp_n") - 1)))
    out = out.withColumn("shuffle_key", hash_bits(seed + ":order", quoted("doc_id"), F.col("copy")))
    out = out.drop("__lp_source", "__lp_draws", "__lp_cdf", "__lp_u", "__lp_n")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")
