"""Whether outlines and result rows are what they claim to be: reasons, confidences and inconsistencies as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafplan.functions import geometry as G


def first_reason(tests: list[tuple[str, Column]]) -> Column:
    """The name of the first test that holds; null if none does."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in tests])


def _symmetry(sides: list[Column], least: float) -> Column:
    ratio = lambda a, b: F.least(a, b) / F.greatest(a, b, F.lit(least))
    return (ratio(sides[0], sides[2]) + ratio(sides[1], sides[3])) / 2


def outlines_checked(
    quads: DataFrame, *, min_area: float = 0.01, max_area: float = 0.995, min_side: float = 0.05, min_angle: float = 15.0, max_angle: float = 165.0, margin: float = 5.0
) -> DataFrame:
    """Adds ``reason`` (the first check that fails, else null) and ``confidence`` (0 with a reason).

    Checks: convex on whole pixels, share of the image, shortest side, angles,
    and corners no further than ``margin`` outside. Columns: corners (top left
    first, clockwise), width, height.
    """
    p, w, h = F.col("corners"), F.col("width"), F.col("height")
    whole = F.transform(p, lambda q: F.struct(q["x"].cast("int").cast("double").alias("x"), q["y"].cast("int").cast("double").alias("y")))
    measured = quads.withColumns({"__share": G.quad_area(p) / (w * h), "__sides": G.quad_sides(p), "__angles": G.quad_angles(p), "__convex": G.quad_turns_one_way(whole)})
    share, sides, angles = F.col("__share"), [F.get("__sides", F.lit(i)) for i in G.QUAD], [F.get("__angles", F.lit(i)) for i in G.QUAD]
    outside = G.either([(x < -margin) | (x > w + margin) | (y < -margin) | (y > h + margin) for x, y in (G.corner(p, i) for i in G.QUAD)])
    reason = first_reason([
        ("non_convex", ~F.col("__convex")),
        ("area_ratio_out_of_bounds", ~share.between(min_area, max_area)),
        ("side_too_short", F.array_min("__sides") < F.least(w, h) * min_side),
        ("angle_out_of_bounds", G.either([~a.between(min_angle, max_angle) for a in angles])),
        ("corner_out_of_image_bounds", outside),
    ])
    square = F.greatest(F.lit(0.0), 1 - G.total([F.abs(a - 90.0) for a in angles]) / 180.0)
    confidence = G.unit(0.4 * _symmetry(sides, 1e-6) + 0.4 * square + 0.2 * F.least(F.lit(1.0), share / 0.3))
    judged = measured.withColumn("reason", reason)
    return judged.withColumn("confidence", F.when(F.col("reason").isNull(), confidence).otherwise(0.0)).drop("__share", "__sides", "__angles", "__convex")


def contour_candidates(
    quads: DataFrame, *, min_area: float = 0.01, max_area: float = 0.995, min_side: float = 0.05, min_angle: float = 15.0, max_angle: float = 165.0
) -> DataFrame:
    """Adds ``valid`` and ``confidence`` of outlines found in contours; points off the border count a little.

    Columns: corners, width, height.
    """
    p, w, h = F.col("corners"), F.col("width"), F.col("height")
    measured = quads.withColumns({"__share": G.quad_area(p) / (w * h), "__sides": G.quad_sides(p), "__angles": G.quad_angles(p)})
    share, sides, angles = F.col("__share"), [F.get("__sides", F.lit(i)) for i in G.QUAD], [F.get("__angles", F.lit(i)) for i in G.QUAD]
    four = (F.size(p) == 4) & (F.size(F.array_distinct(F.transform(p, lambda q: F.struct(F.bround(q["x"], 5), F.bround(q["y"], 5))))) == 4)
    shape = share.between(min_area, max_area) & (F.array_min("__sides") >= F.least(w, h) * min_side) & G.every([a.between(min_angle, max_angle) for a in angles])
    # NaN compares as the largest number, so areas and sides that aren't finite fail the upper bounds.
    valid = F.coalesce(four & G.quad_turns_one_way(p) & shape, F.lit(False))
    square = F.greatest(F.lit(0.0), 1 - G.total([F.abs(a - 90.0) for a in angles]) / 180.0)
    inset = F.least(*[v for i in G.QUAD for x, y in [G.corner(p, i)] for v in (x, w - x, y, h - y)])
    confidence = G.unit(0.45 * _symmetry(sides, 1e-9) + 0.3 * square + 0.2 * F.least(F.lit(1.0), share / 0.3) + 0.05 * G.unit(inset / (0.05 * F.least(w, h))))
    return measured.withColumns({"valid": valid, "confidence": confidence}).drop("__share", "__sides", "__angles")


def combined_gate(mask_reasons: Column, quad_reasons: Column, mask_quality: Column, quad_quality: Column) -> dict[str, Column]:
    """One verdict from a mask's and a quadrilateral's: valid without reasons, reasons once each in order, mean quality."""
    reasons = F.array_distinct(F.concat(mask_reasons, quad_reasons))
    return {"valid": F.size(reasons) == 0, "reason_codes": reasons, "quality_score": (mask_quality + quad_quality) / 2}


# -- result rows ---------------------------------------------------------------


def detection_problem(detected: Column, corners: Column, failure_code: Column) -> Column:
    """Why a detection's state contradicts itself; null if it doesn't."""
    return first_reason([
        ("corners_required", detected & corners.isNull()),
        ("corners_not_allowed", ~detected & corners.isNotNull()),
        ("failure_code_required", ~detected & failure_code.isNull()),
        ("failure_code_not_allowed", detected & failure_code.isNotNull()),
    ])


def quick_scan_problem(success: Column, error_code: Column) -> Column:
    """A quick scan has an error code if and only if it failed."""
    return first_reason([("error_code_not_allowed", success & error_code.isNotNull()), ("error_code_required", ~success & error_code.isNull())])


def acceptance_problem(accepted: Column, clipped: Column, rejection_reason: Column, corners: Column) -> Column:
    """Why an accepted or rejected outline contradicts itself; null if it doesn't."""
    return first_reason([
        ("clipped_accepted", accepted & clipped),
        ("reason_not_allowed", accepted & rejection_reason.isNotNull()),
        ("reason_required", ~accepted & rejection_reason.isNull()),
        ("four_corners_required", accepted & (F.coalesce(F.size(corners), F.lit(0)) != 4)),
    ])


def needs_review(completeness: Column, review_required: Column) -> Column:
    """An ambiguous group is always reviewed."""
    return F.coalesce(completeness == "ambiguous", F.lit(False)) | F.coalesce(review_required, F.lit(False))


def reference_problems(records: DataFrame, images: DataFrame) -> DataFrame:
    """``sample_id, problem`` for records whose image is missing or has another size.

    Records: sample_id, image_path, width, height. Images: path, width, height.
    """
    found = images.select(F.col("path").alias("image_path"), F.col("width").alias("found_width"), F.col("height").alias("found_height"))
    problem = first_reason([("image_missing", F.col("found_width").isNull()), ("size_differs", (F.col("found_width") != F.col("width")) | (F.col("found_height") != F.col("height")))])
    return records.join(found, "image_path", "left").select("sample_id", problem.alias("problem")).where("problem is not null")
