"""Corners refined by fitted lines, and ridges between the dents of an outline: arithmetic on columns.

A line is a struct (normal_a, normal_b, normal_c, confidence, fallback_used,
source) with normal_a * x + normal_b * y + normal_c = 0; an image has four, top,
right, bottom and left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafplan.functions import geometry as G
from leafplan.operators.evaluation import quad_findings

EDGES = ("top", "right", "bottom", "left")


@dataclass(frozen=True)
class RefinementPolicy:
    max_px: float = 80.0
    max_ratio: float = 0.08
    least_confidence: float = 0.35
    least_edges: int = 2
    allow_partial: bool = True
    support_drop: float = 0.05


def refined_corners(rows: DataFrame, policy: RefinementPolicy | None = None) -> DataFrame:
    """Adds ``accepted, refined, selected, displacement_px, max_displacement_px, refined_edges, fallback_edges, reasons``.

    Columns: width, height, corners (canonical), lines (four); before_support and
    after_support if they are known. An unusable line gives way to the edge as it
    was. A corner is where its two lines meet; lines that are nearly parallel
    leave it where it was, which is a reason to refuse. So are too few usable
    lines, corners that moved too far, a quadrilateral that isn't valid, and
    edges that lost support; a refused one keeps the corners it had.
    """
    p = policy or RefinementPolicy()
    corner = [G.corner(F.col("corners"), i) for i in G.QUAD]

    def own(i):
        (ax, ay), (bx, by) = corner[i], corner[(i + 1) % 4]
        size = F.greatest(F.hypot(bx - ax, by - ay), F.lit(1e-9))
        na, nb = -(by - ay) / size, (bx - ax) / size
        return na, nb, -(na * ax + nb * ay)

    given = [F.get("lines", F.lit(i)) for i in G.QUAD]
    usable = [F.coalesce((x["source"] != "none") & ~x["fallback_used"] & (x["confidence"] >= p.least_confidence), F.lit(False)) for x in given]
    out = rows.withColumn("__use", F.array(*usable))
    use = [F.get("__use", F.lit(i)) for i in G.QUAD]
    line = [F.struct(*[F.when(use[i], given[i][n]).otherwise(v).alias(k) for k, n, v in zip("abc", ("normal_a", "normal_b", "normal_c"), own(i))]) for i in G.QUAD]
    out = out.withColumn("__line", F.array(*line))
    lines = [F.get("__line", F.lit(i)) for i in G.QUAD]

    def meet(i):
        s, t = lines[i - 1], lines[i]
        det = s["a"] * t["b"] - t["a"] * s["b"]
        return F.when(F.abs(det) >= 1e-8, G.point((s["b"] * t["c"] - t["b"] * s["c"]) / det, (t["a"] * s["c"] - s["a"] * t["c"]) / det))

    out = out.withColumn("__met", F.array(*[meet(i) for i in G.QUAD]))
    met = [F.get("__met", F.lit(i)) for i in G.QUAD]
    out = out.withColumn("__new", F.array(*[F.coalesce(m, G.point(*corner[i])) for i, m in enumerate(met)]))
    count = F.size(F.filter("__use", lambda u: u))
    early = F.when((count < 4) & F.lit(not p.allow_partial), "partial_not_allowed").when(count < p.least_edges, "no_usable_lines")
    order = G.order_corners(F.col("__new"))
    out = out.withColumns({"__early": early, "__same": F.when(order.isNotNull() & G.valid_quad(order), order)})
    reached = F.when(F.col("__early").isNull(), F.col("__same"))
    moved = F.when(reached.isNotNull(), G.corner_distances(F.col("corners"), F.col("__same"))).otherwise(F.array(*[F.lit(0.0)] * 4))
    out = out.withColumns({"refined": F.coalesce(reached, F.col("corners")), "displacement_px": moved})
    checked = quad_findings(out.select(F.monotonically_increasing_id().alias("__id"), *out.columns).withColumnRenamed("corners", "__before").withColumn("corners", F.col("refined")))
    # quad_findings reads ``corners``; the ones before come back under their name.
    keep = [c for c in rows.columns]
    checked = checked.withColumnRenamed("valid", "__valid").withColumnRenamed("reasons", "__geometry").drop("corners").withColumnRenamed("__before", "corners")
    limit = F.least(F.lit(p.max_px), p.max_ratio * F.hypot("width", "height"))
    known = {c.lower() for c in rows.columns}
    drop = F.col("after_support") + p.support_drop < F.col("before_support") if {"before_support", "after_support"} <= known else F.lit(False)
    late = F.array_compact(F.array(
        F.when(F.exists("__met", lambda m: m.isNull()), F.lit("near_parallel_lines")),
        F.when(F.col("__same").isNotNull() & (F.array_max("displacement_px") > limit), F.lit("displacement_too_large")),
        F.when(F.col("__same").isNull() | ~F.coalesce("__valid", F.lit(False)), F.lit("geometry_invalid")),
        F.when(F.col("__same").isNotNull() & F.coalesce(drop, F.lit(False)), F.lit("edge_support_drop")),
    ))
    why = F.when(F.col("__early").isNotNull(), F.array("__early")).otherwise(late)
    names = F.array(*map(F.lit, EDGES))
    picked = lambda flag: F.transform(F.filter(F.arrays_zip(names.alias("n"), F.col("__use").alias("u")), lambda z: z["u"] == flag), lambda z: z["n"])
    done = checked.withColumns({"__why": why, "refined_edges": picked(True), "fallback_edges": picked(False)})
    accepted = F.size("__why") == 0
    return done.select(
        *keep, accepted.alias("accepted"), "refined", F.when(accepted, F.col("refined")).otherwise(F.col("corners")).alias("selected"), "displacement_px",
        F.array_max("displacement_px").alias("max_displacement_px"), "refined_edges", "fallback_edges",
        F.when(accepted, F.array(F.when(F.size("fallback_edges") > 0, F.lit("partial")).otherwise(F.lit("accepted")))).otherwise(F.col("__why")).alias("reasons"),
    )


def dent_pairs(dents: DataFrame, *, key: str = "image_id", keep: int = 8, arc: float = 0.15, distance: float = 0.20, least_px: float = 40.0, widest: float = 170.0, transverse: float = 25.0) -> DataFrame:
    """Pairs of dents of an outline that a ridge may join, in the order in which they are tried.

    Dents: key, dent_id, depth, x, y, arc (length along the outline up to it),
    total (all around), in_x, in_y, out_x, out_y (ways to the outline before and
    after), width, height. The ``keep`` deepest of an image meet each other once.
    A pair needs ``arc`` of the outline between its dents, the shorter way, and
    ``distance`` of the image's shorter side; both dents must be bent to
    ``widest`` degrees or less, and the line between them must leave all four
    ways by ``transverse`` degrees or more. Which of them bear an edge is for
    pixels to say.
    """
    order = W.partitionBy(key).orderBy(F.desc("depth"), "dent_id")
    deep = dents.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    bent = deep.where(G.between((F.col("in_x"), F.col("in_y")), (F.col("out_x"), F.col("out_y"))) <= widest)
    side = lambda n: bent.select(F.col(key), *[F.col(c).alias(n + c) for c in ("place", "dent_id", "depth", "x", "y", "arc", "in_x", "in_y", "out_x", "out_y")], *([F.col(c) for c in ("total", "width", "height")] if n == "a_" else []))
    both = side("a_").join(side("b_"), key).where("a_place < b_place")
    gap = F.abs(F.col("a_arc") - F.col("b_arc"))
    both = both.withColumns({"length_px": F.hypot(F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")), "arc_px": F.least(gap, F.col("total") - gap)})
    way = (F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y"))
    back = (-way[0], -way[1])
    apart = [G.between(w, (F.col(f"{n}_{d}_x"), F.col(f"{n}_{d}_y"))) >= transverse for n, w in (("a", way), ("b", back)) for d in ("in", "out")]
    held = both.where((F.col("arc_px") >= arc * F.col("total")) & (F.col("length_px") >= distance * F.least("width", "height")) & (F.col("length_px") >= least_px) & G.every(apart))
    slope = F.degrees(F.atan2(F.abs(F.col("b_y") - F.col("a_y")), F.abs(F.col("b_x") - F.col("a_x"))))
    return held.select(key, "a_dent_id", "b_dent_id", F.row_number().over(W.partitionBy(key).orderBy("a_place", "b_place")).alias("turn"), "length_px", "arc_px", slope.alias("angle_deg"))


def verified_ridges(pairs: DataFrame, support: DataFrame, *, key: str = "image_id", least_support: float, least_continuity: float, most: int = 4) -> DataFrame:
    """Of the pairs that pixels bear out, the first ``most`` of each image, numbered from 0.

    Support: key, a_dent_id, b_dent_id, edge_support, continuity.
    """
    good = pairs.join(support, [key, "a_dent_id", "b_dent_id"]).where((F.col("edge_support") >= least_support) & (F.col("continuity") >= least_continuity))
    ranked = good.withColumn("ridge_id", F.row_number().over(W.partitionBy(key).orderBy("turn")) - 1)
    return ranked.where(F.col("ridge_id") < most)


def simple_order(p: Column) -> Column:
    """Top left, top right, bottom right and bottom left by sums and differences, each the first extreme, even if one corner has two roles."""
    return F.transform(G.corner_order(p), lambda i: F.get(p, i))
