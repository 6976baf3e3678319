"""Evaluation of detections against truth, gates, and the release decision."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafplan.functions import geometry as G
from leafplan.functions import strings as S

REQUIRED_DETECTORS = ("v1_cv", "reference", "segmentation_only", "cv_v2", "hybrid")


@dataclass(frozen=True)
class Thresholds:
    """Gate limits; None sets no limit. The defaults are the release targets."""

    min_detection_success_rate: float | None = 0.98
    min_mean_iou: float | None = 0.95
    max_p95_normalized_corner_error: float | None = 0.01
    max_false_detection_rate: float | None = 0.01


def score_samples(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Truth rows with the scores of their predictions.

    Truth: sample_id, width, height, corners, scenario_tags. Predictions:
    sample_id, detected, raw_corners, corners, failure_reason. A sample without
    a prediction fails as ``missing_prediction``; errors of raw corners count
    even where nothing was detected.
    """
    p = predictions.select("sample_id", F.lit(True).alias("__there"), F.col("detected").alias("__said"), F.col("raw_corners").alias("__raw"), F.col("corners").alias("__found"), F.col("failure_reason").alias("__why"))
    rows = truth.join(p, "sample_id", "left")
    there, said = F.coalesce("__there", F.lit(False)), F.coalesce("__said", F.lit(False))
    # What several columns need is a column of its own, or its expression would be repeated in each.
    rows = rows.withColumns({"detected": there & said & G.valid_quad(F.col("__found")), "__raw_ok": there & G.valid_quad(F.col("__raw")), "__diagonal": F.hypot("width", "height")})
    good = F.col("detected")
    rows = rows.withColumns({
        "corner_px": F.when(good, G.corner_distances(F.col("__found"), F.col("corners"))),
        "raw_corner_px": F.when(F.col("__raw_ok"), G.corner_distances(F.col("__raw"), F.col("corners"))),
        "__shared": F.when(good, G.polygon_area(G.clip_convex(F.col("__found"), F.col("corners")))),
        "__areas": F.when(good & G.quad_is_convex(F.col("corners")), G.quad_area(F.col("__found")) + G.quad_area(F.col("corners"))),
    })
    union = F.col("__areas") - F.col("__shared")
    slug = S.failure_slug(F.when(~said, F.coalesce("__why", F.lit("not_detected"))).otherwise(F.coalesce("__why", F.lit("invalid_geometry"))))
    over = lambda c: F.transform(c, lambda v: v / F.col("__diagonal"))
    return rows.select(
        *truth.columns,
        "detected",
        good.alias("valid_geometry"),
        F.when(union > 1e-9, G.unit(F.col("__shared") / union)).alias("polygon_iou"),
        "corner_px",
        over("corner_px").alias("corner_normalized"),
        "raw_corner_px",
        over("raw_corner_px").alias("raw_corner_normalized"),
        F.when(~there, "missing_prediction").when(~good, slug).alias("failure_reason"),
    )


def quad_findings(quads: DataFrame, *, min_side: float = 10.0, min_perimeter: float = 40.0, area: tuple[float, float] = (0.01, 0.995), angles: tuple[float, float] = (15.0, 165.0), border: float = 0.015, aspect_hint: float | None = None) -> DataFrame:
    """Adds what can be said about the quadrilateral ``corners`` in an image of ``width`` and ``height``.

    ``reasons`` come in a fixed order; all but ``border_touching`` make it
    invalid. Measures are of the corners in canonical order, null if they have none.
    """
    raw = G.raw_findings(F.col("corners"), F.col("width"), F.col("height"))
    rows = quads.withColumns({"__q": G.order_corners(F.col("corners")), "__raw": F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in raw]))})
    rows = rows.withColumn("__q", F.when(G.every([v > 1e-6 for v in G.quad_crosses(F.col("__q"))]), F.col("__q")))
    margin = F.greatest("width", "height") * border
    q = F.col("__q")
    known = lambda v: F.when(q.isNotNull(), v)
    rows = rows.withColumns({
        "__sides": known(G.quad_sides(q)), "angles_deg": known(G.quad_angles(q)), "area_ratio": known(G.quad_area(q) / (F.col("width") * F.col("height"))),
        "border_contact": known(G.border_contact(q, F.col("width"), F.col("height"), margin)), "parallelism_score": known(G.unit(1.0 - F.greatest(F.lit(0.0), G.quad_skew(q) - 5.0) / 40.0)),
    })
    side = lambda i: F.get("__sides", F.lit(i))
    rows = rows.withColumns({"perimeter_px": side(0) + side(1) + side(2) + side(3), "minimum_side_px": F.array_min("__sides"), "aspect_ratio": (side(0) + side(2)) / F.greatest(side(1) + side(3), F.lit(1e-9))})
    tests = [
        (q.isNull(), "quad_non_canonical"), (F.col("minimum_side_px") < min_side, "quad_side_too_short"), (F.col("perimeter_px") < min_perimeter, "quad_degenerate"),
        ((F.col("area_ratio") < area[0]) | (F.col("area_ratio") > area[1]), "quad_area_out_of_range"),
        (F.exists("angles_deg", lambda a: (a < angles[0]) | (a > angles[1])), "quad_extreme_angle"), (F.size("border_contact") > 0, "border_touching"),
    ]
    quality = 0.85 * F.least(F.lit(1.0), F.col("area_ratio") / 0.5) + 0.15 * F.col("parallelism_score")
    if aspect_hint is not None:
        quality = 0.8 * quality + 0.2 * G.unit(1.0 - F.abs(F.col("aspect_ratio") - aspect_hint) / aspect_hint)
    rows = rows.withColumn("reasons", F.concat("__raw", F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))))
    rows = rows.withColumns({"valid": F.size(F.array_except("reasons", F.array(F.lit("border_touching")))) == 0, "quality_score": G.unit(quality)})
    return rows.select(*quads.columns, "valid", "reasons", "area_ratio", "perimeter_px", "minimum_side_px", "angles_deg", "aspect_ratio", "border_contact", "parallelism_score", "quality_score")


def unknown_predictions(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions for samples that aren't in the truth; there should be none."""
    return predictions.join(truth.select("sample_id"), "sample_id", "left_anti")


def percentiles(values: Column, suffix: str, accuracy: int | None = None) -> list[Column]:
    """Mean and interpolated 50th, 95th and 99th percentiles, null without values.

    They are exact, which takes memory as the distinct values of a group;
    ``accuracy`` asks for a sketch instead, off by a rank in that many at most.
    """
    points = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))
    parts = F.percentile(values, points) if accuracy is None else F.percentile_approx(values, points, F.lit(accuracy))
    return [F.avg(values).alias(f"mean_{suffix}"), *[F.get(parts, i).alias(f"p{k}_{suffix}") for i, k in enumerate((50, 95, 99))]]


def _whole(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def metrics(scored: DataFrame, by: tuple[str, ...] = (), accuracy: int | None = None) -> DataFrame:
    """The metric block of each group of ``by`` (one row without).

    Corner errors are per corner: each sample becomes four rows, of which the
    first counts for the sample, so that one aggregate over one scan serves both.
    ``accuracy`` is that of :func:`percentiles`.
    """
    corner = lambda c: F.get(c, F.col("__k")).alias(c)
    first = F.col("__k") == 0
    held = scored.select(*by, "detected", "polygon_iou", "failure_reason", "corner_px", "corner_normalized", "raw_corner_px")
    rows = held.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    rows = rows.select(*by, "__k", *[F.when(first, F.col(c)).alias(c) for c in ("detected", "polygon_iou", "failure_reason")], *map(corner, ("corner_px", "corner_normalized", "raw_corner_px")))
    n = F.count_if(first)
    rate = lambda k: F.coalesce(k / F.nullif(n, F.lit(0)), F.lit(0.0))
    found = F.count_if("detected")
    invalid = F.count_if(F.col("failure_reason") == "invalid_geometry")
    return rows.groupBy(*by).agg(
        n.alias("sample_count"),
        found.alias("detected_count"),
        rate(found).alias("detection_success_rate"),
        invalid.alias("false_detection_invalid_geometry_count"),
        rate(invalid).alias("false_detection_rate"),
        F.count("polygon_iou").alias("polygon_iou_count"),
        F.avg("polygon_iou").alias("mean_iou"),
        F.count_if(F.col("detected") & (F.col("polygon_iou") < 0.5)).alias("silent_wrong_crop_count"),
        F.count("corner_px").alias("corner_error_count"),
        *percentiles(F.col("corner_px"), "corner_error_px", accuracy),
        *percentiles(F.col("corner_normalized"), "normalized_corner_error", accuracy),
        F.count("raw_corner_px").alias("raw_corner_error_count"),
        F.avg("raw_corner_px").alias("mean_raw_corner_error_px"),
    )


def memory_summary(predictions: DataFrame, by: tuple[str, ...] = (), column: str = "memory_peak_bytes") -> DataFrame:
    """Count, mean, percentiles and greatest of the known peaks of memory; all null where none is known."""
    value = F.col(column).cast("double")
    return predictions.groupBy(*by).agg(F.count(column).alias("n"), *percentiles(value, "memory_bytes"), F.max(value).alias("max_memory_bytes"))


def failure_taxonomy(scored: DataFrame) -> DataFrame:
    return scored.where("failure_reason is not null").groupBy("failure_reason").agg(F.count(F.lit(1)).alias("n"))


#: Bins of a normalised error of 1; what is over 64 shares one.
ERROR_BINS = 1 << 14


def scenario_metrics(scored: DataFrame) -> DataFrame:
    """Metrics by scenario tag; here the 95th percentile is the nearest rank of sample means.

    Equal errors of a tag are counted first, then errors meet in bins, and only
    the bins of a tag are brought in order: the wanted rank is looked up in the
    one bin that holds it, so no task sorts all the rows of a tag.
    """
    tags = F.when(F.size("scenario_tags") > 0, F.col("scenario_tags")).otherwise(F.array(F.lit("untagged")))
    mean = F.aggregate("corner_normalized", F.lit(0.0), lambda a, v: a + v) / F.size("corner_normalized")
    wrong = F.coalesce(F.col("detected") & (F.col("polygon_iou") < 0.5), F.lit(False))
    rows = scored.select(F.explode(tags).alias("tag"), mean.alias("error"), "detected", "polygon_iou", wrong.alias("wrong"))
    sums = {"n": F.sum("n"), "found": F.sum("found"), "iou": F.sum("iou"), "ious": F.sum("ious"), "wrong": F.sum("wrong")}
    again = [v.alias(k) for k, v in sums.items()]
    equal = rows.groupBy("tag", "error").agg(F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("found"), F.sum("polygon_iou").alias("iou"), F.count("polygon_iou").alias("ious"), F.count_if("wrong").alias("wrong"))
    bin_ = F.when(F.col("error").isNotNull(), F.least(F.floor(F.col("error") * ERROR_BINS), F.lit(64 * ERROR_BINS)))
    value = F.when(F.col("error").isNotNull(), F.struct("error", "n"))
    bins = equal.withColumn("bin", bin_).groupBy("tag", "bin").agg(F.array_sort(F.collect_list(value)).alias("values"), F.sum(F.when(F.col("error").isNotNull(), F.col("n"))).alias("errors"), *again)
    tag = W.partitionBy("tag")
    upto = F.coalesce(F.sum("errors").over(tag.orderBy(F.col("bin").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0))
    place = bins.withColumns({"upto": upto, "all": F.coalesce(F.sum("errors").over(tag), F.lit(0))})
    nearest = F.greatest(F.lit(1), F.bround(0.95 * F.col("all")).cast("int"))
    left = nearest - (F.col("upto") - F.coalesce("errors", F.lit(0)))
    # The first value of the bin up to which so many errors stand.
    found = F.aggregate("values", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("hit")), lambda a, v: F.struct((a["seen"] + v["n"]).alias("seen"), F.when((a["seen"] < F.col("left")) & (a["seen"] + v["n"] >= F.col("left")), v["error"]).otherwise(a["hit"]).alias("hit")))["hit"]
    place = place.withColumn("left", left).withColumn("hit", F.when((F.col("errors") > 0) & (F.col("left") >= 1) & (F.col("left") <= F.col("errors")), found))
    return place.groupBy("tag").agg(
        F.sum("n").alias("sample_count"),
        (F.sum("found") / F.sum("n")).alias("detection_success_rate"),
        (F.sum("iou") / F.nullif(F.sum("ious"), F.lit(0))).alias("mean_iou"),
        F.max("hit").alias("p95_normalized_corner_error"),
        F.sum("wrong").alias("silent_wrong_crop_count"),
    )


def gate(metric_rows: DataFrame, thresholds: Thresholds | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each limit: value, target, operator, passed. An unknown value fails."""
    limits = {k: v for k, v in asdict(thresholds or Thresholds()).items() if v is not None}
    checks = [F.struct(F.lit(k[4:]).alias("metric"), F.col(k[4:]).cast("double").alias("value"), F.lit(v).alias("target"), F.lit(">=" if k.startswith("min") else "<=").alias("operator")) for k, v in limits.items()]
    rows = metric_rows.select(*by, F.explode(F.array(*checks)).alias("c")).select(*by, "c.*")
    passed = F.when(F.col("operator") == ">=", F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return rows.withColumn("passed", F.coalesce(passed, F.lit(False)))


def gate_passed(checks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return checks.groupBy(*by).agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def decision(metric_rows: DataFrame, checks: DataFrame, available: DataFrame) -> DataFrame:
    """READY or BLOCKED, the selected detector and the blockers.

    ``metric_rows`` and ``checks`` have a column detector; ``available`` has
    detector and has_checksum. The hybrid must pass its gate, crop nothing
    wrongly in silence, be no worse than the baseline and better in something.
    """
    needs = ("segmentation_only", "cv_v2", "hybrid")
    row = available.agg(*[F.bool_or(F.col("detector") == d).alias(f"has_{d}") for d in needs], *[F.bool_or((F.col("detector") == d) & F.col("has_checksum")).alias(f"sum_{d}") for d in needs])
    lacking = F.array_compact(F.array(*[F.when(~F.coalesce(f"has_{d}", F.lit(False)), F.lit(f"Missing prediction bundle for {d}")).when(~F.coalesce(f"sum_{d}", F.lit(False)), F.lit(f"Missing model checksum for {d}")) for d in needs]))
    pick = lambda d, c: F.max(F.when(F.col("detector") == d, F.col(c)))
    names = ("mean_iou", "detection_success_rate", "p95_normalized_corner_error", "silent_wrong_crop_count")
    sides = metric_rows.agg(*[pick(d, c).alias(f"{k}_{c}") for k, d in (("b", "v1_cv"), ("h", "hybrid")) for c in names])
    passed = gate_passed(checks, ("detector",)).where("detector = 'hybrid'").agg(F.bool_and("passed").alias("gate"))
    one = row.crossJoin(F.broadcast(sides)).crossJoin(F.broadcast(passed))
    b, h = (lambda c: F.col(f"b_{c}")), (lambda c: F.col(f"h_{c}"))
    iou_b, iou_h, ok_b, ok_h = _whole(b("mean_iou")), _whole(h("mean_iou")), _whole(b("detection_success_rate")), _whole(h("detection_success_rate"))
    corner = h("p95_normalized_corner_error") - b("p95_normalized_corner_error")
    no_worse = (ok_h >= ok_b) & (iou_h >= iou_b) & F.coalesce(corner <= 0, F.lit(True))
    better = (iou_h > iou_b) | (ok_h > ok_b) | F.coalesce(corner < 0, F.lit(False))
    wins = F.coalesce("gate", F.lit(False)) & (F.coalesce(h("silent_wrong_crop_count"), F.lit(0)) == 0) & no_worse & better
    one = one.withColumn("lacking", lacking).withColumn("wins", wins & (F.size("lacking") == 0))
    blockers = F.array_sort(F.array_distinct(F.when((F.size("lacking") == 0) & ~F.col("wins"), F.array(F.lit("Hybrid is not proven better than the baseline"))).otherwise(F.col("lacking"))))
    return one.select(F.when(F.col("wins"), "READY").otherwise("BLOCKED").alias("decision_status"), F.when(F.col("wins"), "hybrid").alias("selected_detector"), blockers.alias("blockers"))


def timing_summary(timings: DataFrame) -> DataFrame:
    """Count and percentiles of each fixed stage; stages without values stay, with count 0.

    Columns: key, ms. Keys are stage names or their aliases.
    """
    stages = timings.sparkSession.createDataFrame([(s,) for s in S.TIMING_STAGES], "stage string")
    known = timings.withColumn("stage", S.timing_stage(F.col("key"))).where("stage is not null")
    sums = known.groupBy("stage").agg(F.count("ms").alias("n"), *percentiles(F.col("ms"), "ms"))
    return stages.join(sums, "stage", "left").fillna(0, ["n"])


def latency_summary(timings: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return timings.groupBy(*by).agg(F.count("ms").alias("n"), *percentiles(F.col("ms"), "ms"), F.max("ms").alias("max_ms"))


# The latency limits in milliseconds (mode, boundary, p50, p95).
SLA = (("classic", "end_to_end", 1200.0, 1800.0), ("classic", "pipeline", 400.0, 700.0), ("ai_enhanced", "end_to_end", 2800.0, 3800.0), ("ai_enhanced", "pipeline", 1200.0, 1800.0))


def within_sla(timings: DataFrame, *, model_available: bool) -> DataFrame:
    """Per mode: whether both boundaries were measured and keep their limits; AI needs its model too.

    Columns: mode, boundary, ms.
    """
    limits = timings.sparkSession.createDataFrame(SLA, "mode string, boundary string, p50 double, p95 double")
    got = latency_summary(timings, ("mode", "boundary"))
    kept = F.coalesce((F.col("p50_ms") <= F.col("p50")) & (F.col("p95_ms") <= F.col("p95")), F.lit(False))
    rows = limits.join(got, ["mode", "boundary"], "left").withColumn("kept", kept)
    return rows.groupBy("mode").agg((F.bool_and("kept") & ((F.col("mode") == "classic") | F.lit(model_available))).alias("within_sla"), F.count("p50_ms").alias("measured"))


def metric_deltas(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``metric, current, baseline, delta`` of two long tables (metric, value)."""
    return current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "left").withColumn("delta", F.col("current") - F.col("baseline"))


def corpus_hash(rows: DataFrame, text: str, digits: int = 3) -> DataFrame:
    """One hash of all texts, whatever their order, as a tree: of hashes of sorted hashes.

    The SHA-256 of each text goes to the bucket of its first ``digits`` hex
    digits; a bucket's hash is of its sorted hashes put together, and the result
    of the bucket hashes in order. So no task gathers more than a bucket, and the
    last one ``16 ** digits`` hashes. It isn't the hash of the joined texts, which
    is :func:`joined_hash`.
    """
    each = rows.select(F.sha2(F.col(text), 256).alias("h"))
    buckets = each.groupBy(F.substring("h", 1, digits).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "")
    return buckets.agg(F.sha2(joined, 256).alias("corpus_sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def joined_hash(rows: DataFrame, text: str, by: tuple[str, ...] = ()) -> DataFrame:
    """SHA-256 of a group's texts in sorted order put together: for manifests of few documents, which one task joins."""
    return rows.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ""), 256).alias("corpus_sha256"), F.count(text).alias("n"))


def round_robin_sample(pool: DataFrame, n: int, seed: int, *, bucket: str = "bucket", key: str = "image_path") -> DataFrame:
    """``n`` rows, in turn from each bucket, within a bucket by a seeded hash; a key counts once.

    The rank within a bucket comes first in the order, so the turn is a top-n
    that Spark cuts in every task.
    """
    first = pool.groupBy(key).agg(F.min(bucket).alias(bucket))
    spun = first.withColumn("turn", F.row_number().over(W.partitionBy(bucket).orderBy(S.stable_key(seed, F.col(key)), key)))
    return spun.orderBy("turn", bucket).limit(n)


def truth_violations(rows: DataFrame) -> DataFrame:
    """Adds ``violations``: every constraint of a truth row that it breaks.

    Columns: sample_id, image_path, width, height, corners, visible, visibility_reason.
    """
    inside = G.every([(x >= 0) & (x <= F.col("width")) & (y >= 0) & (y <= F.col("height")) for x, y in (G.corner(F.col("corners"), i) for i in G.QUAD)])
    tests = {
        "empty_id": F.trim("sample_id") == "",
        "bad_path": ~S.relative_path_ok(F.col("image_path")),
        "bad_size": (F.col("width") <= 0) | (F.col("height") <= 0),
        "bad_geometry": ~G.valid_quad(F.col("corners")),
        "out_of_bounds": ~F.coalesce(inside, F.lit(False)),
        "visibility": F.col("visible") & F.col("visibility_reason").isNotNull() | ~F.col("visible") & F.col("visibility_reason").isNull(),
    }
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])))


def identity_violations(rows: DataFrame) -> DataFrame:
    """Ids and paths that several rows have, and sequences in several splits."""
    many = lambda c, kind: rows.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), "value", "n")
    split = rows.where("sequence_id is not null").groupBy(F.col("sequence_id").alias("value")).agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("sequence_split").alias("kind"), "value", "n")
    return many("sample_id", "sample_id").unionByName(many("image_path", "image_path")).unionByName(split)


def truth_summary(rows: DataFrame) -> DataFrame:
    """Counts by split, dataset and tag in one pass over the rows."""
    kinds = F.explode(F.concat(F.array(F.struct(F.lit("split").alias("kind"), F.col("split").alias("value")), F.struct(F.lit("dataset").alias("kind"), F.col("dataset").alias("value"))), F.transform("scenario_tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("value")))))
    return rows.select(kinds.alias("k")).groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))


def recommended(rows: DataFrame, by: tuple[str, ...], name: str, score: str, priority: str) -> DataFrame:
    """The name with the best score in each group; of equals the first by priority."""
    return rows.groupBy(*by).agg(F.max_by(name, F.struct(F.col(score), -F.col(priority))).alias(name), F.max(score).alias(score))


def readability(edge_recall: Column, contrast: Column, density: Column, colour: Column) -> Column:
    return G.unit(0.50 * edge_recall + 0.25 * contrast + 0.10 * density + 0.15 * colour)
