"""Decisions about detections: page kinds, decision paths, evidence of edges and ridges, order gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafplan.functions import geometry as G

# Day columns of the two page kinds.
FIRST_COLUMNS, SECOND_COLUMNS = 21, 10


def column_score(columns: Column, expected: int) -> Column:
    """Likeness of a number of detected day columns to the expected one."""
    return F.when(columns <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(columns - expected) / F.lit(float(expected)) * 1.5))


def page_kinds(rows: DataFrame, *, min_ink: float, min_confidence: float, min_margin: float) -> DataFrame:
    """Adds ``page_type, page_order, confidence``; weak or near even evidence is UNKNOWN.

    Columns: columns (detected), ink_ratio.
    """
    first, second = column_score(F.col("columns"), FIRST_COLUMNS), column_score(F.col("columns"), SECOND_COLUMNS)
    best = F.greatest(first, second)
    weak = (F.col("ink_ratio") < min_ink) | (best < min_confidence) | (F.abs(first - second) < min_margin)
    kind = F.when(weak, "UNKNOWN").when(first >= second, "FIRST_HALF").otherwise("SECOND_HALF")
    order = F.when(kind == "FIRST_HALF", 1).when(kind == "SECOND_HALF", 2)
    return rows.withColumns({"page_type": kind, "page_order": order, "confidence": best})


def decision_path(state: Column, status: Column, source: Column) -> Column:
    """How a detection came about, from the segmentation's state, the ranking's status and the chosen source (null: none)."""
    return (
        F.when(status == "ambiguous", "ambiguous")
        .when(source.isNull(), F.when(status == "below_threshold", "below_threshold").otherwise("no_candidate"))
        .when(state.isin("failed", "not_configured"), "cv_fallback")
        .when(source == "mixed", "agreement")
        .when(source == "mask_fit", "segmentation_first")
        .otherwise("disagreement")
    )


def detection_warnings(state: Column, status: Column, enclosed_ridges: Column) -> Column:
    """Ordered warnings; ``enclosed_ridges`` counts those of the chosen candidate, null or 0 for none."""
    return F.array_compact(F.array(
        F.when(state.isin("failed", "ambiguous", "not_configured"), "SEGMENTATION_FALLBACK"),
        F.when(state.isin("failed", "not_configured"), "SEGMENTATION_LOW_CONFIDENCE"),
        F.when(status == "ambiguous", "DETECTION_AMBIGUOUS"),
        F.when(enclosed_ridges > 0, "OCCLUSION_RISK"),
    ))


def edges(quads: DataFrame, key: str = "image_id") -> DataFrame:
    """Four rows for each quadrilateral: ``edge`` 0 to 3 with its ends, direction and middle."""
    pairs = [F.struct(F.lit(i).alias("edge"), *[v.alias(n) for n, v in zip(("ax", "ay", "bx", "by"), (*G.corner(F.col("corners"), i), *G.corner(F.col("corners"), i + 1)))]) for i in G.QUAD]
    rows = quads.select(key, F.explode(F.array(*pairs)).alias("e")).select(key, "e.*")
    return rows.withColumns({"edge_angle": G.segment_angle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), "mx": (F.col("ax") + F.col("bx")) / 2, "my": (F.col("ay") + F.col("by")) / 2})


def segments_by_edge(quads: DataFrame, segments: DataFrame, *, distance: float, angle: float, key: str = "image_id") -> DataFrame:
    """Segments along each edge: near in direction, with their middle near the edge's middle."""
    gap = F.abs(F.col("angle") - F.col("edge_angle"))
    near = (F.least(gap, 180.0 - gap) <= angle) & (F.hypot((F.col("x1") + F.col("x2")) / 2 - F.col("mx"), (F.col("y1") + F.col("y2")) / 2 - F.col("my")) <= distance)
    return edges(quads, key).join(segments, key).where(near)


def ridges_within(candidates: DataFrame, ridges: DataFrame, *, samples: int = 20, part: float = 0.8, key: str = "image_id") -> DataFrame:
    """Per candidate: ridges of which ``part`` of the sample points lie inside, and their length.

    Candidates: key, candidate_id, corners (convex, in order). Ridges: key, ridge_id, x1, y1, x2, y2.
    """
    t = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: k / F.lit(float(samples - 1)))
    both = candidates.select(key, "candidate_id", "corners").join(ridges, key)

    def inside(s):
        x, y = F.col("x1") + s * (F.col("x2") - F.col("x1")), F.col("y1") + s * (F.col("y2") - F.col("y1"))
        return G.every([G.cross(G.corner(F.col("corners"), i), G.corner(F.col("corners"), i + 1), (x, y)) >= 0 for i in G.QUAD])

    share = F.size(F.filter(t, inside)) / F.lit(float(samples))
    held = both.withColumn("share", share).where(F.col("share") >= part)
    return held.groupBy(key, "candidate_id").agg(F.count(F.lit(1)).alias("enclosed_ridges"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("enclosed_length"))


def order_gate(plan: DataFrame, orders: DataFrame, skipped: DataFrame) -> DataFrame:
    """What keeps a grouped run from starting: ``group_key, problem``.

    Each group under review needs an order or to be skipped; an order must be a
    permutation of the group's sources. Plan: group_key, source_paths,
    review_required. Orders: group_key, manual_order. Skipped: group_key.
    """
    rows = plan.join(skipped, "group_key", "left_anti").join(orders, "group_key", "left")
    wrong = F.col("manual_order").isNotNull() & ((F.size(F.array_distinct("manual_order")) != F.size("manual_order")) | (F.array_sort("manual_order") != F.array_sort("source_paths")))
    problem = F.when(F.col("review_required") & F.col("manual_order").isNull(), "order_required").when(wrong, "order_mismatch")
    return rows.select("group_key", problem.alias("problem")).where("problem is not null")


def annotation_summary(records: DataFrame) -> DataFrame:
    """Counts of an annotation session by kind and value, in one pass.

    Columns: status, split, scenario_tags, document_polygon, mask_path, document_visible.
    """
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    flag = lambda kind, test: F.when(test, one(kind, F.lit("yes")))
    kinds = F.array_compact(F.array(one("status", F.col("status")), one("split", F.col("split")), flag("polygon", F.col("document_polygon").isNotNull()), flag("mask", F.col("mask_path").isNotNull()), flag("visible", F.col("document_visible"))))
    tags = F.transform("scenario_tags", lambda t: one("tag", t))
    return records.select(F.explode(F.concat(kinds, tags)).alias("k")).groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))


def finalize_problems(records: DataFrame, least: int, most: int) -> DataFrame:
    """Why a session can't be made final: its size, records not annotated, corners outside."""
    inside = G.every([(x >= 0) & (x <= F.col("width") - 1) & (y >= 0) & (y <= F.col("height") - 1) for x, y in (G.corner(F.col("corners"), i) for i in G.QUAD)])
    counts = records.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "annotated").alias("open"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside"))
    tests = [F.when(~F.col("n").between(least, most), "record_count"), F.when(F.col("open") > 0, "not_annotated"), F.when(F.col("outside") > 0, "out_of_bounds")]
    return counts.withColumn("problems", F.array_compact(F.array(*tests)))


def first_free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Adds ``free_name``: the wanted name, or its first form with ``_1``, ``_2``... that no one has.

    Of rows that want one name, the first by path has it unless it is taken, and
    the others the next free numbers in order of their path. A number isn't free
    if that form is taken or wanted by any row, so all names differ. The k-th
    free number is k and as many more as blocked ones stand before it, which one
    running count by name gives: nothing is gathered, and work and memory are as
    the rows. Columns: path (unique), name; taken: name. Null names stay null.
    """
    from pyspark.sql import Window as W

    ext = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    base = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    number = F.regexp_extract(base("name"), r"_([1-9][0-9]{0,17})$", 1)
    named = wanted.select("path", "name")
    # Names that can't be had: those taken, and as numbered forms those wanted as well.
    held = taken.select("name").withColumn("gone", F.lit(True)).unionByName(named.select("name").withColumn("gone", F.lit(False))).groupBy("name").agg(F.bool_or("gone").alias("gone"))
    blocked = held.where(number != "").select(F.concat(F.regexp_replace(base("name"), r"_[0-9]+$", ""), ext).alias("name"), number.cast("long").alias("k"))
    order = W.partitionBy("name").orderBy("path")
    rows = named.where("name is not null").join(held.where("gone").select("name", "gone"), "name", "left")
    rows = rows.withColumn("k", F.row_number().over(order) - F.when(F.col("gone"), 0).otherwise(1)).select("path", "name", "k")
    # A blocked number b with i blocked ones up to it stands before the k-th free one if b - i < k.
    stops = blocked.withColumn("i", F.row_number().over(W.partitionBy("name").orderBy("k"))).select(F.lit(None).cast("string").alias("path"), "name", (F.col("k") - F.col("i")).alias("at"), F.lit(1).alias("stop"), F.lit(None).cast("long").alias("k"))
    both = rows.select("path", "name", F.col("k").alias("at"), F.lit(0).alias("stop"), F.col("k").cast("long").alias("k")).unionByName(stops)
    before = F.sum("stop").over(W.partitionBy("name").orderBy("at", "stop").rowsBetween(W.unboundedPreceding, W.currentRow))
    numbered = both.withColumn("n", F.col("k") + before).where("stop = 0")
    free = F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat(base("name"), F.lit("_"), F.col("n").cast("string"), ext))
    return numbered.select("path", "name", free.alias("free_name")).unionByName(named.where("name is null").withColumn("free_name", F.lit(None).cast("string")))
