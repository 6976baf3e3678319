"""Near-duplicate documents: MinHash, banding, verification, components.

A document's set holds its distinct shingles of so many words, five unless told
otherwise (A-Z lower-cased, words end at ASCII white space; fewer words are one
shingle). Documents are linked if 100 * intersection >= 80 * union.

1. Each task hashes its documents' shingles and takes many universal hash
   minima. Equal sets are one node from here on, whatever their number.
2. Minima are cut into bands; nodes that agree in a whole band share a bucket.
   Each bucket's least node is its hub, found by pre-aggregation, and pairs are
   (node, hub): as many as nodes, not as pairs of nodes.
3. Pairs pass a check of part of the signature, then of the full sets.
4. Links become components by alternating large-star and small-star.
5. A bucket whose nodes are still in several components may hide links between
   nodes that aren't its hub. In such buckets, the nodes outside the least
   component are paired with a random node of it, and the components made again.
6. What is then still open is searched in full, in blocks of bounded size,
   comparing signatures and then full sets, and gives only links that join
   components. With these the components are made a last time.

The pairs of a hub with many nodes are dealt to several tasks, each with a copy
of the hub. With 48 bands of 7, a pair at the threshold shares no bucket with
probability (1 - 0.8^7)^48, about 1 in 80 000, and pairs above it far less.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, discard, freeing, quoted, stored

BANDS, ROWS = 48, 7
#: Minima (8 bits each) that the signature check compares, and the agreement that it asks for:
#: five standard deviations below a similarity of 0.8.
SIGNATURE, AGREEMENT = 256, 0.675
#: Similarity in hundredths, and words of a shingle.
THRESHOLD, WIDTH = 80, 5
#: Nodes that one task compares with a hub, and nodes in a block of the search in full.
HUB_SHARE, BLOCK = 2_000, 4_000
REMEMBERED_WORDS = 100_000
#: Documents that a task turns into features at once.
BATCH_ROWS = 512
#: Documents for each file of a table of pairs, nodes or links.
ROWS_A_FILE = 200_000

_M48 = np.uint64((1 << 48) - 1)


# -- sets and signatures -----------------------------------------------------


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        self[word] = value = xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def shingle_set(lowered: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted 48-bit hashes of a text's distinct shingles of ``width`` words; fewer words are one shingle."""
    words = lowered.split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > REMEMBERED_WORDS:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(width, len(h))
    n = len(h) - size + 1
    runs = h[:n]
    if size < width:
        # As long a shingle of another text is none of this one's.
        runs = _mix(runs ^ np.uint64(0x5851F42D4C957F2D) * np.uint64(size))
    for k in range(1, size):
        runs = _mix(runs * np.uint64(0x9E3779B97F4A7C15) + _mix(h[k : n + k]))
    return np.unique(_mix(runs) & _M48)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_817)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


_A, _B = _coefficients()
_POWERS = np.array([pow(0x2545F4914F6CDD1D, k + 1, 1 << 64) for k in range(ROWS)], np.uint64)
_SEEDS = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash ``(a * x + b) >> 32`` over a set."""
    out = np.full(len(_A), ~np.uint64(0), np.uint64)
    for at in range(0, len(shingles), 4096):
        x = shingles[at : at + 4096]
        for k in range(0, len(_A), 48):
            np.minimum(out[k : k + 48], (_A[k : k + 48, None] * x + _B[k : k + 48, None]).min(axis=1), out=out[k : k + 48])
    return out >> np.uint64(32)


def band_keys(least: np.ndarray) -> np.ndarray:
    return _mix((least.reshape(BANDS, ROWS) * _POWERS).sum(axis=1, dtype=np.uint64) ^ _SEEDS).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are as similar as the threshold asks."""
    if not len(a) or not len(b) or THRESHOLD * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    union = len(np.unique(np.concatenate([a, b])))
    return 100 * (len(a) + len(b) - union) >= THRESHOLD * union


def shingle_features(docs: DataFrame, width: int = WIDTH, with_text_key: bool = False) -> DataFrame:
    """A row for each row of ``docs``, stored: ``rid`` (unique), ``doc_id, n_shingles, fp, sig, bands, body``, and ``text_key`` if asked for."""

    def make():
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress

        def features(texts):
            sizes, prints, sigs, bodies, bands = [], [], [], [], []
            at = np.zeros(len(texts) + 1, np.int32)
            for i, t in enumerate(texts):
                lowered = (t.as_py() or "").encode().lower()
                shingles = shingle_set(lowered, width)
                if len(shingles):
                    least = minima(shingles)
                    sigs.append(least[:SIGNATURE].astype(np.uint8).tobytes())
                    bands.append(band_keys(least))
                else:
                    sigs.append(b"")
                at[i + 1] = len(bands) * BANDS
                sizes.append(len(shingles))
                prints.append(hashlib.md5(shingles.tobytes()).digest())
                bodies.append(pack(lowered))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            return [sizes, prints, sigs, pa.ListArray.from_arrays(pa.array(at), flat), bodies]

        return features

    rows = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text"))
    if with_text_key:
        rows = rows.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    fields = "n_shingles long, fp binary, sig binary, bands array<long>, body binary"
    made = append_columns(rows, fields, make, carry=["doc_id", "text_key"] if with_text_key else ["doc_id"], rows_at_once=BATCH_ROWS)
    return stored(made.withColumn("rid", F.monotonically_increasing_id()), "shingles")


# -- pairs -------------------------------------------------------------------


def _agree(a: bytes, b: bytes) -> bool:
    return (np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean() >= AGREEMENT


def _set_of(width: int):
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return lambda body: shingle_set(unpack(body), width)


def _passing(pairs: DataFrame, payload: DataFrame, prepare, test) -> DataFrame:
    """The pairs (hub, node) whose payloads pass ``test``.

    ``payload`` is (rid, load). Each hub goes ahead of its nodes to as many
    tasks as they fill; a task holds one hub's payload at a time.
    """
    shares = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_SHARE).cast("int").alias("shares"))
    dealt = pairs.join(shares, "hub").select("hub", F.col("node").alias("rid"), F.pmod(F.xxhash64("node"), "shares").cast("int").alias("share"), F.lit(1).alias("turn"))
    hubs = shares.select("hub", F.col("hub").alias("rid"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("turn"))
    # One plan at every size: a small table of pairs would be broadcast, a large one can't be.
    rows = dealt.unionByName(hubs).join(payload.hint("merge"), "rid").select("hub", "share", "turn", "rid", "load")
    rows = rows.repartition("hub", "share").sortWithinPartitions("hub", "share", "turn")

    def run(batches):
        import pyarrow as pa

        ready, hub, held = prepare(), None, None
        for batch in batches:
            found = []
            for h, turn, rid, load in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if turn == 0:
                    hub, held = h, ready(load.as_py())
                elif h == hub and test(held, ready(load.as_py())):
                    found.append((h, rid))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["hub", "node"])

    return rows.mapInArrow(freeing(run), "hub long, node long")


def _confirmed(pairs: DataFrame, rows: DataFrame, width: int, files: int) -> DataFrame:
    """The pairs that pass the signature and then the full sets, stored."""
    likely = stored(_passing(pairs, rows.select("rid", F.col("sig").alias("load")), lambda: bytes, _agree), "likely", files)
    links = stored(_passing(likely, rows.select("rid", F.col("body").alias("load")), lambda: _set_of(width), linked), "links", files)
    discard(likely)
    return links


def _second_hubs(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs (hub, node) for buckets (key, node) whose nodes are in several components.

    The hub is a node of the least component, another one in each bucket, and
    its pairs are the nodes of other components: most of those that the first
    hub is too far from are near one of these.
    """
    placed = buckets.join(components, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    hubs = placed.groupBy("key").agg(F.min(F.struct("component", F.xxhash64("node", "key").alias("draw"), "node")).alias("least"), F.max("component").alias("high")).where("least.component < high")
    hubs = hubs.select("key", F.col("least.component").alias("low"), F.col("least.node").alias("hub"))
    return placed.join(hubs, "key").where("component <> low").select("hub", "node").distinct()


def _hidden_links(buckets: DataFrame, components: DataFrame, rows: DataFrame, width: int, files: int) -> DataFrame:
    """Links between different components within ``buckets`` (key, node), stored: enough to join what belongs together.

    Two nodes are compared in the first bucket that they share and in no other.
    """
    placed = buckets.join(components, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    chosen = placed.join(open_.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key")
    # Block i meets each block j: a node goes to as many searches as its bucket has blocks.
    mine = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    spread = chosen.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "component")
    order = ["key", "i", "j"]
    given = spread.join(rows.select(F.col("rid").alias("node"), "sig", "bands").hint("merge"), "node").select(*order, "node", "component", "sig", "bands")

    def searches(batches, width: int):
        """Each search's key and its rows; of the rows, nodes and components as lists, signatures and bands as matrices."""
        key, held = None, []

        def done():
            sigs = np.frombuffer(b"".join(h[2] for h in held), np.uint8).reshape(len(held), -1)
            return key, [h[0] for h in held], np.array([h[1] for h in held]), sigs, np.array([h[3] for h in held]), [h[4] for h in held] if width > 4 else None

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] != key:
                    if held:
                        yield done()
                    key, held = row[:3], []
                held.append(row[3:])
        if held:
            yield done()

    def outside(component):
        """Rows that aren't in the largest component: one of any two rows of different ones is."""
        names, counts = np.unique(component, return_counts=True)
        return np.flatnonzero(component != names[counts.argmax()]).tolist()

    def resembling(key, a, component, sigs, bands):
        """Rows of other components that resemble row ``a`` and share no bucket with it before this one."""
        others = np.flatnonzero(component != component[a])
        like = others[(sigs[others] == sigs[a]).mean(axis=1) >= AGREEMENT]
        return like[bands[a][(bands[like] == bands[a]).argmax(axis=1)] == key[0]] if len(like) else like

    def near(batches):
        """Nodes that resemble a node of another component, for each search."""
        import pyarrow as pa

        for key, nodes, component, sigs, bands, _ in searches(batches, 4):
            hit = np.zeros(len(nodes), bool)
            for a in outside(component):
                like = resembling(key, a, component, sigs, bands)
                hit[like] = True
                hit[a] |= len(like) > 0
            at = np.flatnonzero(hit)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int64()) for k in key] + [pa.array(np.array(nodes)[at]), pa.array(component[at])], names=[*order, "node", "component"])

    close = stored(given.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(freeing(near), "key long, i long, j long, node long, component long"), "close", files)
    bodies = close.join(rows.select(F.col("rid").alias("node"), "sig", "bands", "body").hint("merge"), "node").select(*order, "node", "component", "sig", "bands", "body")

    def confirm(batches):
        import pyarrow as pa

        unpack = _set_of(width)
        for key, nodes, component, sigs, bands, loads in searches(batches, 5):
            root = {c: c for c in component.tolist()}

            def top(c):
                while root[c] != c:
                    c = root[c]
                return c

            sets: dict[int, np.ndarray] = {}

            def one(k):
                if k not in sets:
                    sets[k] = unpack(loads[k])
                return sets[k]

            found = []
            for a in outside(component):
                for b in resembling(key, a, component, sigs, bands).tolist():
                    x, y = top(int(component[a])), top(int(component[b]))
                    if x != y and linked(one(a), one(b)):
                        root[max(x, y)] = min(x, y)
                        found.append((nodes[a], nodes[b]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["hub", "node"])

    links = stored(bodies.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(freeing(confirm), "hub long, node long"), "hidden", files)
    discard(close)
    return links


# -- components --------------------------------------------------------------


def connected_components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """``node, component`` (its least node) for every node in ``edges`` (two long columns), stored.

    Large-star ties each node's larger neighbours to its least neighbour,
    small-star its smaller ones; they alternate until nothing changes, which
    takes steps as the logarithm of the longest path. Neighbours are never
    gathered: a node's minimum is pre-aggregated and joined to its edges. Each
    round is written to the shared folder.
    """
    u, v = [quoted(c) for c in edges.columns[:2]]
    now = stored(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges", files)
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, now = now, stored(small, "edges", files)
        discard(last)
        after = mark(now)
        if after == before:
            break
        before = after
    out = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = stored(out, "components", files)
    discard(now)
    return out


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, with_text_key: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    ``component_id`` is the least doc_id that links lead to, itself included;
    ``kept`` says that it is the row's own. A text without words is linked with
    nothing. Null doc_ids take part in links, but a component's id is null only
    if all of its doc_ids are, and then its rows are all kept. Repeated rows are
    copies of each other and all kept if one is. A text of any length is compared
    whole, in memory of one task; an empty table gives an empty one; no column
    but doc_id and text is read.

    ``with_text_key`` adds ``text_key``, a hash of the text, and ``first``: of a
    component's rows, those of the least doc_id and then of the least text_key.
    """
    rows = shingle_features(docs, width, with_text_key)
    files = 2 + rows.count() // ROWS_A_FILE
    nodes = stored(rows.where("n_shingles > 0").groupBy("fp").agg(F.min("rid").alias("node")), "nodes", files)
    keys = rows.select(F.col("rid").alias("node"), "bands").join(nodes.select("node"), "node", "left_semi").select("node", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    buckets = stored(keys.join(hubs, "key").select("key", "node", "hub"), "buckets")
    loads = rows.select("rid", "sig", "bands", "body")
    pairs = stored(buckets.where("node <> hub").select("hub", "node").distinct(), "pairs", files)
    links = _confirmed(pairs, loads, width, files)
    last = connected_components(links, files)
    # Without an open bucket the pairs are none, and nothing is left to do.
    second = stored(_second_hubs(buckets.select("key", "node"), last), "pairs", files)
    spent = [buckets, pairs, second, links]
    if not second.isEmpty():
        more = _confirmed(second, loads, width, files)
        spent.append(more)
        every = links.unionByName(more)
        if not more.isEmpty():
            spent.append(last)
            last = connected_components(every, files)
        hidden = _hidden_links(buckets.select("key", "node"), last, loads, width, files)
        spent.append(hidden)
        if not hidden.isEmpty():
            spent.append(last)
            last = connected_components(every.unionByName(hidden), files)
    discard(*spent)

    of_node = nodes.join(last, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    # A row without words is a component of its own; ids of rows and of nodes are the same.
    more = ["text_key"] if with_text_key else []
    light = rows.select("rid", "doc_id", "n_shingles", *more, F.when(F.col("n_shingles") > 0, F.col("fp")).alias("fp"))
    placed = light.join(of_node, "fp", "left").select("rid", "doc_id", "n_shingles", *more, F.coalesce("component", "rid").alias("component"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    least = [F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))["text_key"].alias("least")] if with_text_key else []
    ids = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), *least)
    return placed.join(ids, "component").select("doc_id", "n_shingles", "component_id", kept.alias("kept"), *more, *[(kept & (F.col("text_key") == F.col("least"))).alias("first") for _ in more])
