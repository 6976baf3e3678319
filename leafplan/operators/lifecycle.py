"""What becomes of a file in a run: its outcome, its new state row, its group's pages and its events.

All of it is joins by path and column expressions, so one shuffle by path serves
outcomes, state and files. State rows have: relative_path, size, mtime_ns,
sha256, output_relative_path, output_relative_paths, status, pipeline_version,
period (year, month), group_key (employee_relative_dir, year, month),
artifact_dependencies, detection_status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafplan.functions import strings as S

PATHS = "array<string>"


def _slashes(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def synced_outputs(one: Column, many: Column) -> tuple[Column, Column]:
    """The single output path and the list, each completed from the other."""
    single = F.when(F.coalesce(one, F.lit("")) != "", one)
    listed = F.coalesce(many, F.array().cast(PATHS))
    both = F.when(single.isNotNull() & ~F.array_contains(listed, F.coalesce(single, F.lit(""))), F.concat(listed, F.array(single))).otherwise(listed)
    return F.coalesce(single, F.get(listed, F.lit(0)), one), both


def with_context(rows: DataFrame, period: Column, employee: Column) -> DataFrame:
    """``rows`` whose ``period`` and ``group_key`` are assigned where they are null, and only there."""
    out = rows.withColumn("period", F.coalesce("period", period))
    key = F.struct(employee.alias("employee_relative_dir"), F.col("period.year").alias("year"), F.col("period.month").alias("month"))
    return out.withColumn("group_key", F.when(F.col("group_key").isNotNull(), F.col("group_key")).when(F.col("period").isNotNull(), key))


def changed_while_processed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose size or time, listed before the work, differ from those listed after it, or that are gone."""
    now = after.select("relative_path", F.col("size").alias("__size"), F.col("mtime_ns").alias("__mtime"))
    same = F.col("size").eqNullSafe(F.col("__size")) & F.col("mtime_ns").eqNullSafe(F.col("__mtime"))
    return before.join(now, "relative_path", "left").where(~same).select("relative_path")


def file_results(scans: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """One result a file: ``status, warning, duration_ms, error_code`` from what its scan gave.

    Scans: relative_path, employee_name, target_relative_pdf, document_detected,
    warnings (list of codes), total_duration_ms (double), error_code (null: none).
    A file in ``changed`` (relative_path) fails, whatever its scan gave, and is
    so tried again in the next run. Durations round half to even.
    """
    rows = scans if changed is None else scans.join(changed.select("relative_path", F.lit(True).alias("__moved")), "relative_path", "left")
    moved = F.lit(False) if changed is None else F.coalesce("__moved", F.lit(False))
    code = F.when(moved, F.coalesce("error_code", F.lit("IMAGE_PROCESS_FAILED"))).otherwise(F.col("error_code"))
    warning = F.when(F.size(F.coalesce("warnings", F.array().cast(PATHS))) > 0, F.array_join("warnings", ", "))
    failed = code.isNotNull()
    return rows.select(
        "relative_path", "employee_name", "target_relative_pdf",
        F.when(failed, "failed").when(warning.isNotNull(), "warning").otherwise("success").alias("status"),
        (F.coalesce("document_detected", F.lit(False)) & ~failed).alias("document_detected"),
        F.when(~failed, warning).alias("warning"), F.bround("total_duration_ms").cast("long").alias("duration_ms"), code.alias("error_code"),
    )


def state_after(results: DataFrame, files: DataFrame, state: DataFrame, *, pipeline_version: str, period: tuple[int, int] | None = None, grouped: bool = False) -> DataFrame:
    """The state rows that a run leaves for its results, to be upserted.

    Files: relative_path, size, mtime_ns, sha256 as they were when they were
    read. A failed file keeps the artifacts of its earlier row, or names the one
    intended. A good one has its target; ``grouped``, it has what it had, since
    its group's artifact is committed later. Period and group stay as they were
    and are assigned where there were none.
    """
    was = state.select("relative_path", F.struct("output_relative_path", "output_relative_paths", "period", "group_key", "artifact_dependencies").alias("was"))
    now = files.select("relative_path", "size", "mtime_ns", "sha256")
    rows = results.join(now, "relative_path").join(was, "relative_path", "left")
    none, target = F.array().cast(PATHS), F.array("target_relative_pdf")
    had = F.col("was").isNotNull()
    listed = F.coalesce("was.output_relative_paths", none)
    deps = F.when(had, F.coalesce("was.artifact_dependencies", none))
    failed = F.col("status") == "failed"
    bare = ~had | ((F.size(listed) == 0) & F.col("was.output_relative_path").isNull())
    if grouped:
        good = (F.when(had, F.col("was.output_relative_path")), F.when(had, listed).otherwise(none), F.coalesce(deps, none))
    else:
        good = (F.col("target_relative_pdf"), F.when(had, listed).otherwise(target), F.coalesce(deps, target))
    bad = (F.when(bare, F.col("target_relative_pdf")).otherwise(F.col("was.output_relative_path")), F.when(bare, target).otherwise(listed), F.coalesce(deps, target))
    one, many, needs = (F.when(failed, b).otherwise(g) for b, g in zip(bad, good))
    single, both = synced_outputs(one, many)
    out = rows.select(
        "relative_path", "size", "mtime_ns", "sha256", single.alias("output_relative_path"), both.alias("output_relative_paths"), "status",
        F.lit(pipeline_version).alias("pipeline_version"), F.col("was.period").alias("period"), F.col("was.group_key").alias("group_key"), needs.alias("artifact_dependencies"),
        F.when(failed, "failed").when(F.col("document_detected"), "detected").otherwise("fallback").alias("detection_status"), "employee_name",
    )
    if period is not None:
        out = with_context(out, F.struct(F.lit(period[0]).alias("year"), F.lit(period[1]).alias("month")), F.col("employee_name"))
    return out.drop("employee_name")


def group_pages(groups: DataFrame, results: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """The pages of each group that can be exported whole, in the order of its sources.

    Groups: group_key, source_relative_paths. A group takes part if any of its
    sources has a result; if one of them has none, or failed, the group gives
    no page.
    """
    asked = groups if skipped is None else groups.join(skipped, "group_key", "left_anti")
    each = asked.select("group_key", F.posexplode("source_relative_paths").alias("position", "relative_path")).withColumn("relative_path", _slashes(F.col("relative_path")))
    found = results.select(_slashes(F.col("relative_path")).alias("relative_path"), F.col("status").alias("__status"))
    pages = each.join(found, "relative_path", "left")
    whole = F.min(F.coalesce(F.col("__status") != "failed", F.lit(False))).over(W.partitionBy("group_key"))
    return pages.withColumn("__whole", whole).where("__whole").select("group_key", "position", "relative_path")


def flat_work_items(files: DataFrame, state: DataFrame) -> DataFrame:
    """Wanted output names of single images: the stored name if the mode is still the same, else the preferred one.

    Files: relative_path, target_relative_pdf. State: relative_path, export_mode,
    output_relative_path. ``kept`` says that the name is the file's own already;
    the others go through ``first_free_names``.
    """
    was = state.where("export_mode = 'PER_IMAGE' and coalesce(output_relative_path, '') <> ''").select("relative_path", F.col("output_relative_path").alias("__own"))
    rows = files.join(was, "relative_path", "left")
    return rows.select("relative_path", F.coalesce("__own", "target_relative_pdf").alias("name"), F.col("__own").isNotNull().alias("kept"))


def merged_name(folder: str, stored: str | None, taken: set[str]) -> str:
    """The one output of merged images: the stored name, else the first free form of the folder's."""
    from leafplan.sources.state import free_name

    return stored or free_name(f"{folder}_merged.pdf", taken)


def in_result_order(results: DataFrame) -> DataFrame:
    """Results by path without regard to case, then by path."""
    return results.orderBy(F.lower("relative_path"), "relative_path")


def best_turn(turns: DataFrame, key: str = "image_id") -> DataFrame:
    """Per image the turn with the greatest confidence (null: 0); of equals the first by ``position``.

    Columns: key, position, turns, page_type, confidence.
    """
    score = F.coalesce("confidence", F.lit(0.0))
    best = F.max_by(F.struct("turns", "page_type", "confidence"), F.struct(score, -F.col("position")))
    return turns.groupBy(key).agg(best.alias("b")).select(key, "b.*")


# -- user orders ------------------------------------------------------------------


def manual_orders(spark, payload: str | None) -> DataFrame:
    """``group_key, manual_order`` from a JSON object of lists of paths; anything else is an error."""
    import json

    raw = {} if payload is None else json.loads(payload)
    if not isinstance(raw, dict):
        raise ValueError("manual orders must be a JSON object")
    rows = []
    for group, paths in raw.items():
        if not group.strip() or not isinstance(paths, list) or not all(isinstance(p, str) and p.strip() for p in paths):
            raise ValueError("a manual order is a list of paths of a named group")
        clean = [p.replace("\\", "/") for p in paths]
        if len(set(clean)) != len(clean):
            raise ValueError(f"the order of {group!r} has a path twice")
        rows.append((group, clean))
    return spark.createDataFrame(rows, "group_key string, manual_order array<string>")


def skipped_groups(spark, payload: str | None) -> DataFrame:
    """``group_key`` from a JSON list of different names; anything else is an error."""
    import json

    raw = [] if payload is None else json.loads(payload)
    if not isinstance(raw, list) or not all(isinstance(g, str) for g in raw):
        raise ValueError("skipped groups must be a JSON list of names")
    names = {g.strip() for g in raw}
    if "" in names or len(names) != len(raw):
        raise ValueError("skipped groups must be named and different")
    return spark.createDataFrame([(g,) for g in sorted(names)], "group_key string")


def batch_period(year: int | None, month: int | None) -> tuple[int, int] | None:
    """Year and month, both or neither; the clock is never asked."""
    if (year is None) != (month is None):
        raise ValueError("year and month go together")
    if year is None:
        return None
    if not 1 <= month <= 12 or not 1 <= year <= 9999:
        raise ValueError("no such month")
    return year, month


# -- errors and messages ----------------------------------------------------------


def error_code(error: BaseException, operation: str = "unknown") -> str:
    """The stable code of an error: its own ``code``, or by kind and what was being done."""
    own = getattr(error, "code", None)
    if isinstance(own, str) and own.isupper():
        return own
    if isinstance(error, PermissionError) and operation in ("output", "state"):
        return "STATE_WRITE_FAILED" if operation == "state" else "OUTPUT_NOT_WRITABLE"
    if isinstance(error, (FileNotFoundError, IsADirectoryError, NotADirectoryError)) and operation == "file":
        return "IMAGE_DECODE_FAILED"
    return "INVALID_REQUEST" if isinstance(error, ValueError) and operation == "request" else "UNEXPECTED_ERROR"


def technical_message(error: BaseException) -> str:
    """At most 2000 characters of the error's text, or its kind."""
    text = str(error) or type(error).__name__
    return text[:2000] + ("…" if len(text) > 2000 else "")


def with_messages(rows: DataFrame, messages: DataFrame, code: str = "code") -> DataFrame:
    """Adds ``user_message`` by a table ``code, message``; an unknown code, trimmed and in capitals, is its own message."""
    table = messages.select(F.upper(F.trim("code")).alias("__code"), F.col("message").alias("__message"))
    plain = F.upper(F.trim(F.col(code)))
    return rows.withColumn("__code", plain).join(table, "__code", "left").withColumn("user_message", F.coalesce("__message", "__code")).drop("__code", "__message")


def provenance(rows: DataFrame, found: dict[str, str | None]) -> DataFrame:
    """``rows`` with what is known of the run that made them, as text columns."""
    return rows.withColumns({k: F.lit(v).cast("string") for k, v in sorted(found.items())})


# -- events -----------------------------------------------------------------------


def plan_event(summary: DataFrame, roots: tuple[str, str], timestamp: str) -> DataFrame:
    """The ``scan_plan`` event of a one-row summary with the counters of the plan."""
    counters = ("new", "modified", "unchanged", "rebuild")
    total = F.col("new") + F.col("modified") + F.col("rebuild")
    return summary.select(
        F.lit(1).alias("protocolVersion"), F.lit("scan_plan").alias("type"), F.lit(timestamp).alias("timestamp"), F.lit(roots[0]).alias("inputRoot"), F.lit(roots[1]).alias("outputRoot"),
        F.col("total_files").cast("int").alias("totalImages"), *[F.col(c).cast("int").alias(c) for c in counters], total.cast("int").alias("filesToProcess"),
    )


def file_events(results: DataFrame, run: str, order: list[str], timestamp: str) -> DataFrame:
    """A started and a terminal event for each result, in order of arrival ``seq`` within a run.

    A file's terminal event stands right after its start; all of them are made
    of the results, that is after these are durable.
    """
    place = F.row_number().over(W.partitionBy(run).orderBy(*order))
    total = F.count(F.lit(1)).over(W.partitionBy(run))
    rows = results.withColumns({"index": place, "total": total.cast("int")})
    base = {"protocolVersion": F.lit(1), "timestamp": F.lit(timestamp), "relativePath": F.col("relative_path"), "employeeName": F.col("employee_name"), "index": F.col("index"), "total": F.col("total")}
    failed = F.col("status") == "failed"
    done = {
        "outputRelativePath": F.when(~failed, F.col("target_relative_pdf")), "documentDetected": F.when(~failed, F.col("document_detected")),
        "warning": F.when(~failed, F.col("warning")), "durationMs": F.when(~failed, F.col("duration_ms")), "errorCode": F.when(failed, F.col("error_code")),
    }
    started = F.struct((2 * F.col("index") - 1).cast("long").alias("seq"), F.lit("file_started").alias("type"), *[v.alias(k) for k, v in base.items()], *[F.lit(None).cast(t).alias(k) for k, t in zip(done, ("string", "boolean", "string", "long", "string"))])
    ended = F.struct((2 * F.col("index")).cast("long").alias("seq"), F.when(failed, "file_failed").otherwise("file_completed").alias("type"), *[v.alias(k) for k, v in base.items()], *[v.alias(k) for k, v in done.items()])
    return rows.select(run, F.explode(F.array(started, ended)).alias("e")).select(run, "e.*")


def completed_event(results: DataFrame, run: str, timestamp: str) -> DataFrame:
    """The ``scan_completed`` event of each run."""
    of = lambda k: F.count_if(F.col("status") == k).cast("int")
    risk = F.count_if(S.has_warning(F.col("warning"), "OCCLUSION_RISK")).cast("int")
    return results.groupBy(run).agg(F.lit(1).alias("protocolVersion"), F.lit("scan_completed").alias("type"), F.lit(timestamp).alias("timestamp"), F.count(F.lit(1)).cast("int").alias("totalProcessed"), of("success").alias("success"), of("warning").alias("warning"), of("failed").alias("failed"), risk.alias("occlusionRiskCount"))
