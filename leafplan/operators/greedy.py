"""Operators whose result depends on the order of earlier decisions.

A greedy choice can't be put as a set expression, so each of these takes the
rows of one small group (an image's candidates, lines or positions) one after
another. Groups are bounded by what one image yields; images are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _grouped(rows: DataFrame, order: list, fn: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fn`` of each group's key and rows. The first column is the group's key.

    Groups are dealt by key and come sorted by ``order``; a task goes through
    them one after another, so there is no call from the JVM for each of them.
    """
    by, kind = rows.columns[0], T.StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(kind)
        each = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        made = (row for key, held in groupby(each, key=itemgetter(0)) for row in fn(key, [r[1:] for r in held]))
        while part := list(islice(made, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*part), out)], schema=out)

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


# -- convex polygons in NumPy --------------------------------------------------


def polygon_area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2)


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a convex polygon within another, by half planes."""
    x, y = window[:, 0], window[:, 1]
    ring = window if np.dot(x, np.roll(y, -1)) >= np.dot(np.roll(x, -1), y) else window[::-1]
    for s, e in zip(ring, np.roll(ring, -1, axis=0)):
        if not len(subject):
            break
        side = (e[0] - s[0]) * (subject[:, 1] - s[1]) - (e[1] - s[1]) * (subject[:, 0] - s[0])
        kept = []
        for k in range(len(subject)):
            a, b, da, db = subject[k - 1], subject[k], side[k - 1], side[k]
            if (da >= -1e-7) != (db >= -1e-7):
                kept.append(a + (b - a) * (da / (da - db)))
            if db >= -1e-7:
                kept.append(b)
        subject = np.array(kept).reshape(-1, 2)
    return subject


def convex_iou(a: np.ndarray, b: np.ndarray) -> float:
    shared = polygon_area(clip(a, b))
    union = polygon_area(a) + polygon_area(b) - shared
    return shared / union if union > 1e-9 else 0.0


def distinct_quads(candidates: DataFrame, *, by: str = "image_id", iou: float = 0.96, corner: float = 8.0, keep: int = 16) -> DataFrame:
    """Adds ``kept``: candidates in order of score, but for those near one kept before.

    Near means an overlap of ``iou`` or more, or no corner further than
    ``corner`` pixels. Columns: by, candidate_id, score, corners.
    """

    def may_overlap(a, b) -> bool:
        """False if areas or bounding boxes alone rule the overlap out."""
        (p, pa, plo, phi), (q, qa, qlo, qhi) = a, b
        box = np.prod(np.maximum(np.minimum(phi, qhi) - np.maximum(plo, qlo), 0))
        return min(pa, qa) >= iou * max(pa, qa) and box >= iou * max(pa, qa)

    def fn(key, rows):
        held: list[tuple] = []
        for candidate, score, corners in rows:
            q = np.array([(p["x"], p["y"]) for p in corners], float)
            mine = (q, polygon_area(q), q.min(axis=0), q.max(axis=0))
            near = len(held) >= keep or any(np.hypot(*(q - h[0]).T).max() <= corner or (may_overlap(mine, h) and convex_iou(q, h[0]) >= iou) for h in held)
            if not near:
                held.append(mine)
            yield key, candidate, score, not near

    return _grouped(candidates.select(by, "candidate_id", "score", "corners"), [F.desc("score"), "candidate_id"], fn, f"{by} long, candidate_id long, score double, kept boolean")


def line_clusters(segments: DataFrame, *, by: str = "image_id", angle: float = 5.0, offset: float = 12.0) -> DataFrame:
    """Adds ``cluster``: each segment joins the first cluster whose first member is near, else begins one.

    Columns: by, segment_id, support, length, angle, offset; stronger segments come first.
    """

    def fn(key, rows):
        heads: list[tuple[float, float]] = []
        for segment, _, _, a, o in rows:
            for k, (ha, ho) in enumerate(heads):
                gap = abs(a - ha) % 180
                # Past the wrap of directions an offset changes its sign.
                same = abs(o - ho) if gap <= 90 else abs(o + ho)
                if min(gap, 180 - gap) <= angle and same <= offset:
                    break
            else:
                k = len(heads)
                heads.append((a, o))
            yield key, segment, k

    return _grouped(segments.select(by, "segment_id", "support", "length", "angle", "offset"), [F.desc("support"), F.desc("length"), "segment_id"], fn, f"{by} long, segment_id long, cluster int")


def merged_positions(rows: DataFrame, *, by: str, position: str, weight: str, gap: float) -> DataFrame:
    """Sorted seeds merged while the next is within ``gap`` of the running weighted mean."""

    def fn(key, seeds):
        out: list[tuple[float, float]] = []
        for x, w in seeds:
            if out and x - out[-1][0] <= gap:
                mean, total = out[-1]
                out[-1] = ((mean * total + x * w) / (total + w), total + w)
            else:
                out.append((x, w))
        return ((key, k, mean, total) for k, (mean, total) in enumerate(out))

    cast = [F.col(c).cast("double").alias(c) for c in (position, weight)]
    return _grouped(rows.select(by, *cast), [position, weight], fn, f"{by} long, merged int, mean double, weight double")


def suppressed_peaks(rows: DataFrame, *, by: str, position: str, value: str, distance: float, keep: int, percentile: float | None = None) -> DataFrame:
    """Local maxima, the greatest first, without those within ``distance`` of one taken before.

    Maxima are found by lag and lead; only they are gone through in turn. With
    ``percentile`` (0 to 1) only those at or above that interpolated percentile
    of their group's values count.
    """
    order = W.partitionBy(by).orderBy(position)
    top = rows.withColumn("__b", F.lag(value).over(order)).withColumn("__a", F.lead(value).over(order))
    if percentile is not None:
        limit = rows.groupBy(by).agg(F.percentile(value, F.lit(percentile)).alias("__limit"))
        top = top.join(limit, by).where(F.col(value) >= F.col("__limit"))
    peaks = top.where(F.coalesce(F.col(value) > F.col("__b"), F.lit(True)) & F.coalesce(F.col(value) >= F.col("__a"), F.lit(True)))

    def fn(key, found):
        taken: list[float] = []
        for x, v in found:
            if len(taken) < keep and all(abs(x - t) > distance for t in taken):
                yield key, len(taken), x, v
                taken.append(x)

    cast = [F.col(c).cast("double").alias(c) for c in (position, value)]
    return _grouped(peaks.select(by, *cast), [F.desc(value), position], fn, f"{by} long, rank int, {position} double, {value} double")


def spaced(rows: DataFrame, *, by: str, position: str, support: str, minimum: float) -> DataFrame:
    """Neighbours closer than ``minimum`` to the last kept one: the better supported stays."""

    def fn(key, found):
        kept: list[tuple[float, float]] = []
        for x, s in found:
            if kept and x - kept[-1][0] < minimum:
                if s > kept[-1][1]:
                    kept[-1] = (x, s)
            else:
                kept.append((x, s))
        return ((key, k, x, s) for k, (x, s) in enumerate(kept))

    cast = [F.col(c).cast("double").alias(c) for c in (position, support)]
    return _grouped(rows.select(by, *cast), [position, support], fn, f"{by} long, kept int, {position} double, {support} double")


# -- forms that windows can express --------------------------------------------


def position_groups(rows: DataFrame, *, by: str, position: str, gap: float) -> DataFrame:
    """Gaps and islands: positions further than ``gap`` from the one before begin a group.

    A group's mean is rounded half to even.
    """
    order = W.partitionBy(by).orderBy(position)
    first = F.coalesce(F.col(position) - F.lag(position).over(order) > gap, F.lit(True)).cast("int")
    marked = rows.withColumn("__first", first).withColumn("island", F.sum("__first").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(by, "island").agg(F.bround(F.avg(position)).cast("long").alias("mean"), F.count(F.lit(1)).alias("n"))


def without_isolated_first(rows: DataFrame, *, by: str, position: str, factor: float = 2.2) -> DataFrame:
    """Drops a group's first position if its gap is ``factor`` times the least gap or more."""
    order = W.partitionBy(by).orderBy(position)
    gaps = rows.withColumn("__gap", F.lead(position).over(order) - F.col(position)).withColumn("__rn", F.row_number().over(order))
    rest = F.min(F.when(F.col("__rn") > 1, F.col("__gap"))).over(W.partitionBy(by))
    return gaps.withColumn("__least", rest).where(~F.coalesce((F.col("__rn") == 1) & (F.col("__least") > 0) & (F.col("__gap") >= factor * F.col("__least")), F.lit(False))).drop("__gap", "__rn", "__least")


def kept_in_order(rows: DataFrame, *, by: str, seq: str, position: str, gap: float) -> DataFrame:
    """Positions raised so that each is ``gap`` or more after the one before; and by how much at most."""
    order = W.partitionBy(by).orderBy(seq)
    base = rows.withColumn("__rn", F.row_number().over(order) - 1)
    raised = F.max(F.col(position) - F.col("__rn") * gap).over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("__rn") * gap
    return base.withColumn("ordered", raised).withColumn("moved", F.col("ordered") - F.col(position)).drop("__rn")


def filled_gaps(rows: DataFrame, fallback: DataFrame, *, by: str, position: str, factor: float = 1.6) -> DataFrame:
    """Positions and, in gaps of ``factor`` times the median gap or more, the fallback positions within them."""
    order = W.partitionBy(by).orderBy(position)
    gaps = rows.select(by, position).withColumn("after", F.lead(position).over(order)).where("after is not null").withColumn("gap", F.col("after") - F.col(position))
    middle = gaps.groupBy(by).agg(F.median("gap").alias("median"))
    wide = gaps.join(middle, by).where(F.col("gap") >= factor * F.col("median")).select(by, F.col(position).alias("__lo"), F.col("after").alias("__hi"))
    more = fallback.select(by, position).join(wide, by).where((F.col(position) > F.col("__lo")) & (F.col(position) < F.col("__hi"))).select(by, position)
    return rows.select(by, position, F.lit(False).alias("filled")).unionByName(more.withColumn("filled", F.lit(True)))


def along_ring(rows: DataFrame, *, by: str, seq: str, x: str, y: str) -> DataFrame:
    """Adds ``arc`` (length from the first point) and ``total`` (all around) of a closed ring."""
    order = W.partitionBy(by).orderBy(seq)
    whole = W.partitionBy(by)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(order), F.col(y) - F.lag(y).over(order)), F.lit(0.0))
    out = rows.withColumn("__step", step)
    ends = whole.orderBy(seq).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    closing = F.hypot(F.first(x).over(ends) - F.last(x).over(ends), F.first(y).over(ends) - F.last(y).over(ends))
    return out.withColumn("arc", F.sum("__step").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("__step").over(whole) + closing).drop("__step")


def segment_families(segments: DataFrame, *, by: str = "image_id", cap: int = 32) -> DataFrame:
    """Up to ``cap`` combinations of two horizontal and two vertical segments an image, in order of ids.

    The first ``cap`` of pairs x pairs take the first ``cap`` pairs of each kind
    at most, and those the first ``cap + 1`` segments: (1, 2) to (1, cap + 1). So
    the pairs stay few however many segments an image has.
    Columns: by, h1, h2, v1, v2, combination.
    """
    few = segments.where(F.col("orientation").isin("horizontal", "vertical")).select(by, "orientation", "segment_id")
    few = few.withColumn("__rn", F.row_number().over(W.partitionBy(by, "orientation").orderBy("segment_id"))).where(F.col("__rn") <= cap + 1)
    ids = lambda k: F.array_sort(F.array_compact(F.collect_list(F.when(F.col("orientation") == k, F.col("segment_id")))))
    # At most cap + 1 ids of each kind; pairs and combinations are made within the row.
    both = few.groupBy(by).agg(ids("horizontal").alias("h"), ids("vertical").alias("v"))
    pairs = lambda c: F.slice(F.flatten(F.transform(c, lambda a, i: F.transform(F.slice(c, i + 2, F.lit(cap + 1)), lambda b: F.struct(a.alias("a"), b.alias("b"))))), 1, cap)
    both = both.select(by, pairs(F.col("h")).alias("h"), pairs(F.col("v")).alias("v"))
    every = F.slice(F.flatten(F.transform("h", lambda h: F.transform(F.col("v"), lambda v: F.struct(h["a"].alias("h1"), h["b"].alias("h2"), v["a"].alias("v1"), v["b"].alias("v2"))))), 1, cap)
    return both.select(by, F.posexplode(every).alias("at", "c")).select(by, "c.*", (F.col("at") + 1).alias("combination"))


def majority_orientation(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The most frequent orientation; of equals horizontal, then vertical, then diagonal."""
    counts = rows.groupBy(*by, "orientation").agg(F.count(F.lit(1)).alias("n"))
    place = F.when(F.col("orientation") == "horizontal", 2).when(F.col("orientation") == "vertical", 1).otherwise(0)
    return counts.groupBy(*by).agg(F.max_by("orientation", F.struct("n", place)).alias("orientation"), F.max("n").alias("n"))
