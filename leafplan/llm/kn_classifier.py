"""Quality classifier: an n-gram model with interpolated modified Kneser-Ney smoothing.

The model is trained on trusted text (labelled of good quality and not toxic)
and gives each document a perplexity; a document whose perplexity is over its
language's threshold is rejected. Symbols are the bytes of the text in 64 fixed
classes, and the order is 5: words of the corpora that this is for are so often
new that a word model would tell little.

* Training takes all trusted rows but the one in ``1 / HELD_OUT`` by hash of
  doc_id that is held out, and the thresholds take all of those. Counts of
  5-grams are summed by key; lower orders are continuation counts of distinct
  longer grams. Count tables of orders 1 and 2 have 64 and 4096 cells and are
  known to every task.
* Scoring covers all documents. Each task packs its documents into blocks and
  asks for each block's distinct 5-grams. Requests and counts meet by shard of
  the gram (its context's last two classes, which all orders from 3 to 5 share),
  and the answers go back to their blocks. So what moves is the packed text once
  and the distinct grams of each block, not a row for each gram of a document.
* The threshold of a language is a high quantile of the held-out trusted
  documents' log perplexity and nothing beyond it. It is exact on a fixed grid,
  so it depends on nothing but the rows. A language without
  any of them has the threshold of all languages together.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, freeing, hash_bits, pieces_of, quoted, stored

ORDER, CLASS_BITS = 5, 6
CLASSES = 1 << CLASS_BITS
HELD_OUT = 0.25
#: Bits of the filter that keeps other documents' texts out of the shuffle of the trusted, in rows of 2 ** 15.
FILTER_BITS = 1 << 26
QUANTILE = 0.995
#: Steps of the grid of log perplexities.
GRID = 1e-4
#: Characters in a block, shards of the counts, rows of documents for each copy of a shard.
BLOCK_CHARS, SHARDS, ROWS_A_COPY = 2_000_000, 64, 500_000
#: Discounts of counts 1, 2 and more where the text doesn't give them, and the least that it may give.
USUAL_DISCOUNTS, LEAST_DISCOUNT = (0.5, 1.0, 1.5), 0.05
#: Files of the tables of orders 4 and 3, which hold 2 ** 24 and 2 ** 18 grams at most.
LEVEL_FILES = 4


def byte_classes() -> np.ndarray:
    """The class of each byte: white space and controls 0, letters without case, digits together, marks in three kinds, others by their low bits."""
    table = np.zeros(256, np.uint32)
    for b in range(33, 127):
        table[b] = 31
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = k + 1
    table[ord("0") : ord("9") + 1] = 27
    table[ord(".")], table[ord(",")] = 28, 29
    for ch in b"#*$%&|<>!":
        table[ch] = 30
    table[128:] = 32 + (np.arange(128) & 31)
    return table


_CLASS = byte_classes()


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at each byte of the joined texts, and each text's bytes. A text starts after white space."""
    pad = b" " * (ORDER - 1)
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(raw):
        return np.zeros(0, np.uint32), sizes
    c = _CLASS[raw]
    grams = np.zeros(len(c), np.uint32)
    for k in range(ORDER):
        grams[ORDER - 1 :] |= c[k : len(c) - ORDER + 1 + k] << np.uint32(CLASS_BITS * (ORDER - 1 - k))
    keep = np.ones(len(c), bool)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
    for k in range(ORDER - 1):
        keep[starts + k] = False
    return grams[keep], sizes


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return ((grams >> np.uint32(CLASS_BITS) & np.uint32(0xFFF)) * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(shards)


# -- the model ---------------------------------------------------------------


@dataclass(frozen=True)
class Low:
    """What every task knows: discounts of orders 1 to 5 and the probabilities of order 2 (4096 cells)."""

    discounts: tuple[tuple[float, float, float], ...]
    p2: np.ndarray


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts for counts 1, 2 and more, each over 0 and at most its count.

    Where counts of counts are missing or give anything else, as in an order whose
    grams have nearly all been seen, the usual fixed ones: without a discount an
    unseen symbol would have no probability at all.
    """
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        d = tuple(k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        if all(LEAST_DISCOUNT <= x <= k for k, x in enumerate(d, 1)):
            return d
    return USUAL_DISCOUNTS


def _less(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """The discount of each count."""
    return np.where(counts >= 3, d[2], np.where(counts == 2, d[1], np.where(counts == 1, d[0], 0.0)))


def low_model(t1: np.ndarray, t2: np.ndarray, d: tuple[tuple[float, float, float], ...]) -> Low:
    """From continuation counts of orders 1 (64) and 2 (64 x 64: context, class)."""
    total = t1.sum()
    p1 = (t1 - _less(t1, d[0])) / total + _less(t1, d[0]).sum() / total / CLASSES if total else np.full(CLASSES, 1 / CLASSES)
    sums = t2.sum(axis=1, keepdims=True)
    off = _less(t2, d[1])
    p2 = np.where(sums > 0, (t2 - off + off.sum(axis=1, keepdims=True) * p1) / np.maximum(sums, 1), p1)
    return Low(d, p2)


class Shard:
    """Orders 3 to 5 of one shard, made from its 5-grams (sorted) and counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: Low):
        self.low, self.levels = low, []
        for order in (5, 4, 3):
            d = low.discounts[order - 1]
            context = grams >> np.uint32(CLASS_BITS)
            at = np.flatnonzero(np.diff(context, prepend=~context[:1])) if len(grams) else np.zeros(0, np.int64)
            off = _less(counts, d)
            sums = np.add.reduceat(counts, at) if len(at) else np.zeros(0)
            spare = np.add.reduceat(off, at) if len(at) else np.zeros(0)
            self.levels.append((grams, counts - off, context[at], sums, spare))
            # Distinct longer grams are what a shorter one is counted by.
            grams, counts = np.unique(grams & np.uint32((1 << CLASS_BITS * (order - 1)) - 1), return_counts=True)
            counts = counts.astype(np.float64)

    def log_probabilities(self, asked: np.ndarray) -> np.ndarray:
        p = self.low.p2.ravel()[asked & np.uint32(0xFFF)]
        for order, (grams, rest, contexts, sums, spare) in zip((3, 4, 5), reversed(self.levels)):
            if not len(grams):
                continue
            g = asked & np.uint32((1 << CLASS_BITS * order) - 1)
            i = np.minimum(np.searchsorted(contexts, g >> np.uint32(CLASS_BITS)), len(contexts) - 1)
            seen = contexts[i] == g >> np.uint32(CLASS_BITS)
            k = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
            mine = np.where(grams[k] == g, rest[k], 0.0)
            p = np.where(seen, (mine + spare[i] * p) / sums[i], p)
        return np.log(p)


def _bits(order: int) -> int:
    return (1 << CLASS_BITS * order) - 1


def train(trusted: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, Low]:
    """Packed counts by shard (``shard, load``) and the low orders, from the ``text`` of ``trusted``."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in pieces_of(texts, BLOCK_CHARS):
                grams, n = np.unique(grams_of([t.encode() for t in texts[a:b]])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(n, pa.int64())], names=["gram", "n"])

    table = stored(trusted.select(F.coalesce(quoted("text").cast("string"), F.lit("")).alias("text")).mapInArrow(freeing(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    # Each order is made once, from the one above it; they shrink, and orders 2 and 1 are tiny.
    levels = {ORDER: table}
    for order in range(ORDER - 1, 0, -1):
        less = levels[order + 1].groupBy(F.col("gram").bitwiseAND(F.lit(_bits(order))).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels[order] = stored(less, f"grams{order}", LEVEL_FILES) if order > 2 else less
    # At most 4 rows for each order, 4096 of order 2 and 64 of order 1 come to the driver.
    of_counts = {o: {r["n"]: r["k"] for r in t.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()} for o, t in levels.items()}
    t2, t1 = np.zeros(CLASSES * CLASSES), np.zeros(CLASSES)
    for into, order in ((t2, 2), (t1, 1)):
        for r in levels[order].collect():
            into[r["gram"]] = r["n"]
    discard(levels[4], levels[3])
    low = low_model(t1, t2.reshape(CLASSES, CLASSES), tuple(discounts(*(of_counts[o].get(k, 0) for k in (1, 2, 3, 4))) for o in range(1, ORDER + 1)))

    def pack(batches):
        import pyarrow as pa

        held: list = []
        for batch in batches:
            held.append((batch.column(0).to_numpy().astype(np.uint32), batch.column(1).to_numpy()))
        if held:
            grams, n = (np.concatenate(x) for x in zip(*held))
            shard = shard_of(grams, shards)
            for s in np.unique(shard).tolist():
                at = np.flatnonzero(shard == s)
                at = at[np.argsort(grams[at])]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(np.diff(grams[at], prepend=np.uint32(0)).tobytes() + n[at].tobytes(), 1)])], names=["shard", "load"])

    # A shard's grams meet in one task; there are as many tasks as the session's shuffles have.
    placed = table.select("gram", "n", _shard_column(F.col("gram"), shards).alias("shard")).repartition("shard").select("gram", "n")
    return stored(placed.mapInArrow(freeing(pack), "shard int, load binary"), "counts"), low


def _shard_column(gram, shards: int):
    """:func:`shard_of` as a column."""
    key = F.shiftright(gram, CLASS_BITS).bitwiseAND(F.lit(0xFFF)) * F.lit(2654435761)
    return F.pmod(F.shiftright(key.bitwiseAND(F.lit(0xFFFFFFFF)), 8), F.lit(shards)).cast("int")


# -- scoring -----------------------------------------------------------------


def score(docs: DataFrame, counts: DataFrame, low: Low, shards: int = SHARDS) -> DataFrame:
    """``doc_id, lang, text_key, n_bytes, log_perplexity`` of each row of ``docs``; the last is null for a text of no bytes.

    ``text_key`` is a hash of the text, to tell rows of one doc_id apart.
    """
    rows = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("lang").cast("string").alias("lang"), F.xxhash64(F.coalesce(quoted("text").cast("string"), F.lit(""))).alias("text_key"), quoted("text").cast("string").alias("text"))

    def pack(batches):
        import pyarrow as pa
        import zstandard

        compress = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            ids, langs, keys, texts = (c.to_pylist() for c in batch.columns)
            texts = [t or "" for t in texts]
            for a, b in pieces_of(texts, BLOCK_CHARS):
                raw = [t.encode() for t in texts[a:b]]
                body = b"".join(raw)
                name = hashlib.md5(repr((ids[a:b], keys[a:b], langs[a:b])).encode() + body).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([ids[a:b]], pa.list_(pa.int64())), pa.array([langs[a:b]], pa.list_(pa.string())), pa.array([keys[a:b]], pa.list_(pa.int64())), pa.array([list(map(len, raw))], pa.list_(pa.int64())), pa.array([compress(body)])],
                    names=["block", "doc_id", "lang", "text_key", "size", "body"],
                )

    # Both uses of the blocks read this one shuffle.
    blocks = rows.mapInArrow(freeing(pack), "block string, doc_id array<long>, lang array<string>, text_key array<long>, size array<long>, body binary").repartition("block")

    def texts_of(batch, k):
        import zstandard

        body, sizes = zstandard.ZstdDecompressor().decompress(batch.column(5)[k].as_py()), batch.column(4)[k].as_py()
        ends = np.cumsum(sizes).tolist()
        return [body[e - n : e] for n, e in zip(sizes, ends)]

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                grams = np.unique(grams_of(texts_of(batch, k))[0])
                shard = shard_of(grams, shards)
                found = [(s, zlib.compress(np.diff(grams[shard == s], prepend=np.uint32(0)).tobytes(), 1)) for s in np.unique(shard).tolist()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(found)), pa.array([s for s, _ in found], pa.int32()), pa.array([x for _, x in found])], names=["block", "shard", "load"])

    copies = max(1, -(-docs.count() // ROWS_A_COPY))
    asked = blocks.mapInArrow(freeing(ask), "block string, shard int, load binary").select("shard", F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int").alias("copy"), F.lit(1).alias("turn"), "block", "load")
    known = counts.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("turn"), F.lit("").alias("block"), "load")
    meeting = asked.unionByName(known).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "turn")

    def answer(batches):
        import pyarrow as pa

        at, model = None, None
        for batch in batches:
            found = []
            for s, turn, block, load in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                raw = zlib.decompress(load.as_py())
                if turn == 0:
                    n = len(raw) // 12
                    at, model = s, Shard(np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.uint32), np.frombuffer(raw, np.int64, n, 4 * n).astype(np.float64), low)
                    continue
                if at != s:
                    at, model = s, Shard(np.zeros(0, np.uint32), np.zeros(0), low)
                p = model.log_probabilities(np.cumsum(np.frombuffer(raw, np.uint32), dtype=np.uint32))
                if not np.isfinite(p).all():
                    raise RuntimeError("the model gives a symbol no probability")
                found.append((block, s, p.astype(np.float32).tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int32(), pa.binary()))], names=["block", "shard", "load"])

    # A row for each shard and block at most: what a block gets is bounded by its own size.
    answers = meeting.mapInArrow(freeing(answer), "block string, shard int, load binary").groupBy("block").agg(F.collect_list(F.struct("shard", "load")).alias("answers"))

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                grams, sizes = grams_of(texts_of(batch, k))
                distinct = np.unique(grams)
                shard, logs = shard_of(distinct, shards), np.full(len(distinct), np.nan)
                for x in batch.column(6)[k].as_py() or []:
                    logs[shard == x["shard"]] = np.frombuffer(x["load"], np.float32)
                if np.isnan(logs).any():
                    raise RuntimeError("a block has no answer for some of its grams")
                sums = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(distinct, grams)])])
                ends = np.cumsum(sizes)
                value = (sums[ends - sizes] - sums[ends]) / np.maximum(sizes, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column(1)[k].as_py(), pa.int64()), pa.array(batch.column(2)[k].as_py(), pa.string()), pa.array(batch.column(3)[k].as_py(), pa.int64()), pa.array(sizes), pa.array(np.round(value, 6), mask=sizes == 0)],
                    names=["doc_id", "lang", "text_key", "n_bytes", "log_perplexity"],
                )

    return blocks.join(answers, "block", "left").mapInArrow(freeing(finish), "doc_id long, lang string, text_key long, n_bytes long, log_perplexity double")


def thresholds(held_out: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``lang, threshold`` of log perplexity; the row of lang null is that of all languages together.

    The quantile is the least grid value with at least that part of the rows at
    or below it.
    """
    some = held_out.where("log_perplexity is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), F.ceil(F.col("log_perplexity") / GRID).cast("long").alias("bin"))
    bins = some.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n")
    run = bins.unionByName(every).withColumn("upto", F.sum("n").over(W.partitionBy("lang").orderBy("bin"))).withColumn("total", F.sum("n").over(W.partitionBy("lang")))
    at = run.groupBy("lang").agg(F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * quantile), F.col("bin"))).alias("high"))
    return at.select("lang", (F.col("high") * GRID).alias("threshold"))


def texts_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of the rows of ``docs`` whose doc_id is in ``ids`` (``doc_id long``, distinct).

    The join is exact and deals both sides by doc_id. Before it, a bit map of
    hashed ids drops nearly all rows that have no partner, so that few texts
    move for nothing. The map has ``FILTER_BITS`` bits however many ids there are.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bit = F.bitmap_bit_position(place)
    maps = ids.groupBy(F.bitmap_bucket_number(place).alias("__lp_row")).agg(F.bitmap_construct_agg(bit).alias("__lp_map"))
    rows = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text")).withColumns({"__lp_at": F.bitmap_bucket_number(place), "__lp_bit": bit})
    byte = F.conv(F.hex(F.substring(F.col("__lp_map"), (F.col("__lp_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    near = rows.join(F.broadcast(maps), F.col("__lp_at") == F.col("__lp_row")).where(F.call_function("shiftright", byte, (F.col("__lp_bit") % 8).cast("int")) % 2 == 1)
    return near.select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left_semi")


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, text_key, n_bytes, log_perplexity, threshold, kept`` for each row of ``docs``.

    ``labels`` has doc_id, quality (1: good) and toxic (1: toxic). A text of no
    bytes has no perplexity and is not kept. Without trusted text there are no
    thresholds, and every other document is kept. A null language is judged by
    its own rows, as any other; rows of equal doc_id and text are judged alike.
    A long text is a block of its own, held whole by one task; an empty table
    gives an empty one; no column but doc_id, text and lang is read.
    """
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = stored(good.withColumn("held", hash_bits("held-out", F.col("doc_id")) < F.lit(int(HELD_OUT * (1 << 52)))), "trusted")
    counts, low = train(texts_among(docs, trusted.where("not held").select("doc_id")))
    scored = stored(score(docs, counts, low), "scores")
    limits = stored(thresholds(scored.join(trusted.where("held").select("doc_id"), "doc_id", "left_semi"), quantile), "thresholds", 1)
    general = limits.where("lang is null").first()
    # A row for each language that has held-out documents: a few, which the planner broadcasts by their size.
    own = limits.where("lang is not null").select(F.col("lang").alias("__lp_lang"), "threshold")
    out = scored.join(own, F.coalesce("lang", F.lit("")) == F.col("__lp_lang"), "left").drop("__lp_lang")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(general["threshold"] if general else None).cast("double")))
    kept = F.col("log_perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("log_perplexity") <= F.col("threshold")))
    return out.withColumn("kept", kept)
