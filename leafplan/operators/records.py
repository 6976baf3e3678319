"""Projections and joins of result records: names of fields, flat state rows, chosen candidates, given orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys, without case and punctuation, of fields that never leave the engine.
INTERNAL_KEYS = ("rawmask", "binarymask", "probabilitymask", "probabilitymap", "maskarray")

# Other names of the fields of a plan record.
PLAN_ALIASES = {
    "employees": ("total_employees", "totalEmployees"),
    "new": ("new_count", "newCount"),
    "modified": ("modified_count", "modifiedCount"),
    "rebuild": ("rebuild_count", "rebuildCount"),
    "unchanged": ("unchanged_count", "unchangedCount"),
}

# Model versions of the detectors.
CLASSIC_DETECTOR, CLASSIC_VERSION, MODEL_VERSION = "v1_cv", "opencv-classical", "deeplabv3-mobilenetv3-large-384"


def plan_records(records: DataFrame) -> DataFrame:
    """Plan records under their canonical names; a missing number of files to process is the sum of its parts."""
    have, quoted = set(records.columns), lambda c: F.col(f"`{c}`")
    out = records
    for name, others in PLAN_ALIASES.items():
        given = [quoted(c) for c in (name, *others) if c in have]
        if given:
            out = out.withColumn(name, F.coalesce(*given))
    parts = [F.coalesce(quoted(c), F.lit(0)) for c in ("new", "modified", "rebuild") if c in out.columns]
    counts = [quoted(c) for c in ("files_to_process", "filesToProcess") if c in have]
    files = F.coalesce(*counts, sum(parts[1:], parts[0]) if parts else F.lit(0))
    drop = [c for others in PLAN_ALIASES.values() for c in others if c in have] + [c for c in ("filesToProcess",) if c in have]
    return out.withColumn("files_to_process", files).drop(*drop)


def scalar_diagnostics(values: Column) -> Column:
    """The scalars of ``values`` (map of JSON texts by key): objects and arrays go, nulls stay."""
    return F.map_filter(values, lambda _, v: v.isNull() | ~F.ltrim(v).substr(1, 1).isin("{", "["))


def internal_keys(values: Column) -> Column:
    """The keys of a map that must not be written out."""
    return F.filter(F.map_keys(values), lambda k: F.regexp_replace(F.lower(k), r"[^\p{L}\p{N}]", "").isin(*INTERNAL_KEYS))


def detection_status(detected: Column, fallback: Column) -> Column:
    return F.when(detected, "detected").when(fallback, "fallback").otherwise("failed")


def detector_provenance(detector_name: Column, model_sha256: Column) -> dict[str, Column]:
    """Name, model version and model hash that reusable state must have; a null hash means that there is no model."""
    classic = detector_name == CLASSIC_DETECTOR
    return {
        "detector_name": detector_name,
        "detector_model_version": F.when(classic, CLASSIC_VERSION).when(model_sha256.isNotNull(), MODEL_VERSION),
        "detector_model_checksum": F.when(~classic, model_sha256),
    }


def refinement_fields(diagnostics: Column) -> dict[str, Column]:
    """Flat fields of a refinement's diagnostics (JSON object text); a measure that isn't a number is null."""
    d = F.from_json(diagnostics, "enabled boolean, attempted boolean, accepted boolean, reason string, max_displacement_px double, refinedMaskIoU double, afterEdgeSupport double")
    flag = lambda c: F.coalesce(d[c], F.lit(False))
    return {
        "cornerRefinementEnabled": flag("enabled"),
        "cornerRefinementAttempted": flag("attempted"),
        "cornerRefinementAccepted": flag("accepted"),
        "cornerRefinementReason": F.coalesce(d["reason"], F.when(flag("accepted"), "accepted").otherwise("not_run")),
        "cornerRefinementMaxDisplacementPx": d["max_displacement_px"],
        "cornerRefinementMaskIoU": d["refinedMaskIoU"],
        "cornerRefinementEdgeSupport": d["afterEdgeSupport"],
    }


def _comparable_path(path: Column) -> Column:
    slashed = F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), r"\\", "/")
    return F.when(slashed.rlike("^[a-zA-Z]:/"), F.lower(slashed)).otherwise(slashed)


def plan_fingerprint(input_root: Column, output_root: Column, mode: Column, detector: Column, year: Column, month: Column, export: Column, reprocess: Column) -> Column:
    """A JSON text that changes whenever a shown plan is out of date; drive paths compare without case."""
    fields = {"input": _comparable_path(input_root), "output": _comparable_path(output_root), "mode": mode, "detector": detector, "year": year, "month": month, "export": export, "reprocess": reprocess}
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def chosen_candidates(rankings: DataFrame, candidates: DataFrame, key: str = "image_id") -> DataFrame:
    """Each ranking with the candidate that it chose; fields are null without a choice."""
    chosen = rankings.select(key, F.col("selected_candidate_id").alias("candidate_id"))
    return chosen.join(candidates, [key, "candidate_id"], "left")


def given_orders(orders: DataFrame, files: DataFrame, state: DataFrame, *, year: int, month: int) -> DataFrame:
    """The users' page orders that apply to a run: ``employee_name, ordered_source_paths``.

    A group's id is ``employee:year-month``. Skipped: ids of another form or
    period, employees without files, and those with a file that has no state.
    Orders: group_id, ordered_source_paths. Files: employee_name, relative_path.
    State: relative_path.
    """
    known = state.select("relative_path").distinct().withColumn("known", F.lit(True))
    ready = files.select("employee_name", F.translate("relative_path", "\\", "/").alias("relative_path")).join(known, "relative_path", "left")
    ready = ready.groupBy("employee_name").agg(F.bool_and(F.col("known").isNotNull()).alias("all_known")).where("all_known").select("employee_name")
    form = r"^([\s\S]*):\s*([0-9]+)\s*-\s*([0-9]+)\s*$"
    part = lambda i: F.regexp_extract("group_id", form, i)
    parsed = orders.select(part(1).alias("employee_name"), part(2).try_cast("int").alias("year"), part(3).try_cast("int").alias("month"), "ordered_source_paths")
    return parsed.where((F.col("year") == year) & (F.col("month") == month)).join(ready, "employee_name", "left_semi").select("employee_name", "ordered_source_paths")


def repeated_timings(calls: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The first call's time and mean and exact percentiles of the others, in one pass.

    Columns: those of ``by``, seq (0 is the first), ms.
    """
    later = F.when(F.col("seq") > 0, F.col("ms"))
    tails = [F.percentile(later, q / 100).alias(f"p{q}_ms") for q in (50, 95, 99)]
    return calls.groupBy(*by).agg(F.max(F.when(F.col("seq") == 0, F.col("ms"))).alias("first_ms"), F.count(later).alias("iterations"), F.avg(later).alias("mean_ms"), *tails)
