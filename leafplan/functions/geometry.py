"""Geometry of quadrilaterals and segments as column expressions.

A polygon is ``array<struct<x: double, y: double>>``. Quadrilaterals are
unrolled to plain arithmetic, which the code generator compiles; polygons of
other sizes go through array functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGON = "array<struct<x:double,y:double>>"
QUAD = range(4)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad(*points: Column) -> Column:
    return F.array(*points)


def corner(p: Column, i: int) -> tuple[Column, Column]:
    return F.get(p, i % 4)["x"], F.get(p, i % 4)["y"]


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.hypot(b[0] - a[0], b[1] - a[1])


def cross(a, b, c) -> Column:
    """Cross product of ab and ac."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def total(values: Sequence[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def every(values: Sequence[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out & v
    return out


def either(values: Sequence[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out | v
    return out


def unit(value: Column) -> Column:
    """``value`` kept between 0 and 1. Null gives 0, as least and greatest leave nulls out."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def rounded(value: Column, places: int) -> Column:
    """``value`` rounded as DuckDB rounds doubles: multiplied first, then halves away from 0.

    Spark's own ``round`` goes by the shortest decimal text, which may say half where the product is just off it.
    """
    return F.round(value * 10.0**places) / 10.0**places


def quad_signed_area(p: Column) -> Column:
    c = [corner(p, i) for i in QUAD]
    return total([c[i][0] * c[(i + 1) % 4][1] - c[(i + 1) % 4][0] * c[i][1] for i in QUAD]) / 2


def quad_area(p: Column) -> Column:
    return F.abs(quad_signed_area(p))


def polygon_area(p: Column) -> Column:
    """Area of a polygon of any size; 0 for under three points."""
    n = F.size(p)
    terms = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + F.get(p, i)["x"] * F.get(p, (i + 1) % n)["y"] - F.get(p, (i + 1) % n)["x"] * F.get(p, i)["y"]
    )
    return F.when(n >= 3, F.abs(terms) / 2).otherwise(F.lit(0.0))


def quad_crosses(p: Column) -> list[Column]:
    return [cross(corner(p, i), corner(p, i + 1), corner(p, i + 2)) for i in QUAD]


def quad_is_convex(p: Column) -> Column:
    values = quad_crosses(p)
    return every([v > 1e-6 for v in values]) | every([v < -1e-6 for v in values])


def quad_turns_one_way(p: Column) -> Column:
    """Whether all four turns are to one side: convex, with no tolerance and no straight corner."""
    values = quad_crosses(p)
    return every([v > 0 for v in values]) | every([v < 0 for v in values])


def corner_order(p: Column) -> Column:
    """Indexes of top left, top right, bottom right and bottom left; the lowest index of equals."""
    sums = [F.struct((corner(p, i)[0] + corner(p, i)[1]).alias("k"), F.lit(i).alias("i")) for i in QUAD]
    less = [F.struct((corner(p, i)[1] - corner(p, i)[0]).alias("k"), F.lit(i).alias("i")) for i in QUAD]
    sums_last = [F.struct((corner(p, i)[0] + corner(p, i)[1]).alias("k"), F.lit(-i).alias("i")) for i in QUAD]
    less_last = [F.struct((corner(p, i)[1] - corner(p, i)[0]).alias("k"), F.lit(-i).alias("i")) for i in QUAD]
    return F.array(F.least(*sums)["i"], F.least(*less)["i"], -F.greatest(*sums_last)["i"], -F.greatest(*less_last)["i"])


def order_corners(p: Column) -> Column:
    """The corners in canonical order; null if two roles fall on one corner."""
    order = corner_order(p)
    return F.when(F.size(F.array_distinct(order)) == 4, F.transform(order, lambda i: F.get(p, i)))


def valid_quad(p: Column) -> Column:
    """Whether ``p`` is a finite convex quadrilateral of area 1 or more with its corners in canonical order."""
    coords = [v for i in QUAD for v in corner(p, i)]
    finite = every([v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) for v in coords])
    distinct = F.size(F.array_distinct(F.transform(p, lambda q: F.struct(F.bround(q["x"], 6), F.bround(q["y"], 6))))) == 4
    good = finite & every([v > 1e-6 for v in quad_crosses(p)]) & distinct & (quad_area(p) >= 1.0) & (corner_order(p) == F.array(*map(F.lit, QUAD)))
    return F.coalesce((F.size(p) == 4) & good, F.lit(False))


def clip_convex(subject: Column, clip: Column) -> Column:
    """The part of a convex polygon within a convex quadrilateral, edge by edge."""
    turned = F.when(quad_signed_area(clip) < 0, F.reverse(clip)).otherwise(clip)
    edges = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get(turned, i).alias("s"), F.get(turned, (i + 1) % 4).alias("e")))

    def inside(e, q):
        return (e["e"]["x"] - e["s"]["x"]) * (q["y"] - e["s"]["y"]) - (e["e"]["y"] - e["s"]["y"]) * (q["x"] - e["s"]["x"]) >= -1e-7

    def meet(a, b, e):
        dx, dy, ex, ey = b["x"] - a["x"], b["y"] - a["y"], e["e"]["x"] - e["s"]["x"], e["e"]["y"] - e["s"]["y"]
        den = dx * ey - dy * ex
        t = ((e["s"]["x"] - a["x"]) * ey - (e["s"]["y"] - a["y"]) * ex) / den
        return F.when(F.abs(den) < 1e-9, b).otherwise(point(a["x"] + t * dx, a["y"] + t * dy))

    def cut(poly, e):
        def step(q, i):
            before = F.when(i == 0, F.element_at(poly, -1)).otherwise(F.get(poly, i - 1))
            now, was = inside(e, q), inside(e, before)
            none = F.array().cast(POLYGON)
            return F.when(now & was, F.array(q)).when(now, F.array(meet(before, q, e), q)).when(was, F.array(meet(before, q, e))).otherwise(none)

        return F.when(F.size(poly) == 0, poly).otherwise(F.flatten(F.transform(poly, step)))

    return F.aggregate(edges, subject.cast(POLYGON), lambda poly, e: cut(poly, e).cast(POLYGON))


def polygon_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two convex quadrilaterals; null if either isn't one."""
    shared = polygon_area(clip_convex(a, b))
    union = quad_area(a) + quad_area(b) - shared
    return F.when(quad_is_convex(a) & quad_is_convex(b) & (union > 1e-9), unit(shared / union))


def corner_distances(a: Column, b: Column) -> Column:
    """Distances of matching corners, in order."""
    return F.zip_with(a, b, lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))


def angle_at(before, at, after) -> Column:
    """Angle in degrees between the ways from ``at`` to its neighbours."""
    ax, ay, bx, by = before[0] - at[0], before[1] - at[1], after[0] - at[0], after[1] - at[1]
    size = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.when(size > 1e-9, F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (ax * bx + ay * by) / size))))).otherwise(0.0)


def between(a, b) -> Column:
    """Angle in degrees between two vectors."""
    return angle_at(a, (F.lit(0.0), F.lit(0.0)), b)


def segments_cross(a, b, c, d) -> Column:
    """Whether two segments properly cross."""
    return (cross(a, b, c) * cross(a, b, d) < 0) & (cross(c, d, a) * cross(c, d, b) < 0)


def quad_crosses_itself(p: Column) -> Column:
    c = [corner(p, i) for i in QUAD]
    return segments_cross(c[0], c[1], c[2], c[3]) | segments_cross(c[1], c[2], c[3], c[0])


def quad_touches_itself(p: Column, tolerance: float = 1e-7) -> Column:
    """Whether opposite edges cross or touch; ends within ``tolerance`` of a line count as on it."""
    side = lambda a, b, c: F.when(F.abs(cross(a, b, c)) < tolerance, 0).otherwise(F.signum(cross(a, b, c)))
    c = [corner(p, i) for i in QUAD]
    apart = lambda a, b, d, e: (side(a, b, d) != side(a, b, e)) & (side(d, e, a) != side(d, e, b))
    return apart(c[0], c[1], c[2], c[3]) | apart(c[1], c[2], c[3], c[0])


def raw_findings(p: Column, width: Column, height: Column, tolerance: float = 2.0) -> list[tuple[str, Column]]:
    """What is wrong with the corners of a quadrilateral as they were given, by reason."""
    raw = [corner(p, i) for i in QUAD]
    outside = either([(x < -tolerance) | (x > width - 1 + tolerance) | (y < -tolerance) | (y > height - 1 + tolerance) for x, y in raw])
    return [("quad_self_intersection", quad_crosses_itself(p)), ("quad_out_of_bounds", outside)]


def border_contact(q: Column, width: Column, height: Column, margin: Column) -> Column:
    """The image borders that canonical corners come near."""
    c = [corner(q, i) for i in QUAD]
    return F.array_compact(F.array(
        F.when(either([x <= margin for x, _ in c]), "left"), F.when(either([y <= margin for _, y in c]), "top"),
        F.when(either([x >= width - 1 - margin for x, _ in c]), "right"), F.when(either([y >= height - 1 - margin for _, y in c]), "bottom"),
    ))


def quad_sides(q: Column) -> Column:
    c = [corner(q, i) for i in QUAD]
    return F.array(*[distance(c[i], c[(i + 1) % 4]) for i in QUAD])


def quad_angles(q: Column) -> Column:
    c = [corner(q, i) for i in QUAD]
    return F.array(*[angle_at(c[i - 1], c[i], c[(i + 1) % 4]) for i in QUAD])


def quad_skew(q: Column) -> Column:
    """The larger angle in degrees between opposite sides."""
    c = [corner(q, i) for i in QUAD]
    way = lambda i, j: (c[j][0] - c[i][0], c[j][1] - c[i][1])
    return F.greatest(between(way(0, 1), way(3, 2)), between(way(0, 3), way(1, 2)))


def line_meet(a, b, c, d, parallel: float = 1e-9) -> Column:
    """Where the lines ab and cd meet; null if they are near parallel."""
    den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
    t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
    return F.when(F.abs(den) >= parallel, point(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def segment_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Direction in [0, 180) degrees."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))


def segment_orientation(angle: Column, tolerance: float = 15.0) -> Column:
    flat = F.least(angle, 180.0 - angle)
    return F.when(flat <= tolerance, "horizontal").when(F.abs(angle - 90.0) <= tolerance, "vertical").otherwise("diagonal")


def segment_offset(x1: Column, y1: Column, angle: Column, width: Column, height: Column) -> Column:
    """Signed distance of the segment's line from the image centre."""
    r = F.radians(angle)
    return -F.sin(r) * (x1 - width / 2) + F.cos(r) * (y1 - height / 2)


def circular_mean_angle(angle: Column) -> Column:
    """Aggregate: the mean direction, modulo 180 degrees."""
    twice = F.radians(2 * angle)
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(twice)), F.sum(F.cos(twice)))) / 2, F.lit(180.0))


def warp_size(p: Column) -> tuple[Column, Column]:
    """Width and height after straightening: the longer of opposite sides, rounded half to even."""
    c = [corner(p, i) for i in QUAD]
    width = F.greatest(distance(c[0], c[1]), distance(c[3], c[2]))
    height = F.greatest(distance(c[1], c[2]), distance(c[0], c[3]))
    return F.greatest(F.lit(1), F.bround(width).cast("int")), F.greatest(F.lit(1), F.bround(height).cast("int"))


def exif_point(x: Column, y: Column, width: Column, height: Column, orientation: Column) -> Column:
    """A point of the stored image after turning by its EXIF orientation."""
    turned = {2: (width - 1 - x, y), 3: (width - 1 - x, height - 1 - y), 4: (x, height - 1 - y), 5: (y, x), 6: (height - 1 - y, x), 7: (height - 1 - y, width - 1 - x), 8: (y, width - 1 - x)}
    out = point(x, y)
    for k, (a, b) in turned.items():
        out = F.when(orientation == k, point(a, b)).otherwise(out)
    return out


def fit_page(width: Column, height: Column, page_width: float, page_height: float) -> dict[str, Column]:
    """Placement of an image in a page: scaled to fit and centred."""
    scale = F.least(F.lit(page_width) / width, F.lit(page_height) / height)
    w, h = F.greatest(F.lit(1), F.bround(width * scale).cast("int")), F.greatest(F.lit(1), F.bround(height * scale).cast("int"))
    return {"draw_width": w, "draw_height": h, "left": F.floor((F.lit(int(page_width)) - w) / 2).cast("int"), "top": F.floor((F.lit(int(page_height)) - h) / 2).cast("int")}


def downscale(width: Column, height: Column, longest: Column) -> tuple[Column, Column]:
    """Size with its longer side at most ``longest``; never larger than it was."""
    scale = F.least(F.lit(1.0), longest / F.greatest(width, height))
    return F.greatest(F.lit(1), F.bround(width * scale).cast("int")), F.greatest(F.lit(1), F.bround(height * scale).cast("int"))


def extended_segment(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, most: float = 3.0) -> Column:
    """The segment drawn out to the image borders, by at most ``most`` of its lengths at each end.

    A struct of ``x1, y1, x2, y2, length``; the segment itself if its line doesn't
    meet two borders, null if it has no length.
    """
    length = F.hypot(x2 - x1, y2 - y1)
    ux, uy = (x2 - x1) / length, (y2 - y1) / length

    def ways(at: Column, step: Column, other: Column, other_step: Column, end: Column, other_end: Column) -> list[Column]:
        """How far along the line two parallel borders are; null where it misses them."""
        out = []
        for border in (F.lit(0.0), end):
            t = F.when(F.abs(step) > 1e-9, (border - at) / step)
            out.append(F.when((other + t * other_step).between(-1e-6, other_end + 1e-6), t))
        return out

    met = F.array_compact(F.array(*ways(x1, ux, y1, uy, width - 1.0, height - 1.0), *ways(y1, uy, x1, ux, height - 1.0, width - 1.0)))
    two = F.size(met) >= 2
    low = F.when(two, F.greatest(F.array_min(met), -most * length)).otherwise(F.lit(0.0))
    high = F.when(two, F.least(F.array_max(met), (1 + most) * length)).otherwise(length)
    return F.when(length > 1e-9, F.struct((x1 + low * ux).alias("x1"), (y1 + low * uy).alias("y1"), (x1 + high * ux).alias("x2"), (y1 + high * uy).alias("y2"), (high - low).alias("length")))


def unletterboxed(points: Column, pad_x: Column, pad_y: Column, scale_x: Column, scale_y: Column) -> Column:
    """Points of a model's input, padded and scaled, as points of the source image."""
    return F.transform(points, lambda q: point((q["x"] - pad_x) / scale_x, (q["y"] - pad_y) / scale_y))
