"""Incremental planning: what to process again, and why.

Sources meet the state of the last run in one left join; a file's class is the
first rule that holds. The join and the roll-ups are on the path, so one
shuffle by path serves them, and a state stored by path costs none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROCESSED = ("new", "modified", "rebuild")


@dataclass(frozen=True)
class ReprocessPolicy:
    """The versions that outputs should have; None asks for nothing."""

    pipeline_version: str
    detector_name: str | None = None
    detector_mode: str | None = None
    model_version: str | None = None
    model_checksum: str | None = None
    opt_in: bool = False


def version_reasons(policy: ReprocessPolicy) -> Column:
    """Ordered reasons why a state row is out of date; details count only where both sides know them."""
    asked = (("detector_name", policy.detector_name, "DETECTOR_NAME_CHANGED"), ("detector_mode", policy.detector_mode, "DETECTOR_MODE_CHANGED"), ("detector_model_version", policy.model_version, "MODEL_VERSION_CHANGED"), ("detector_model_checksum", policy.model_checksum, "MODEL_CHECKSUM_CHANGED"))
    tests = [F.when(~F.col("pipeline_version").eqNullSafe(policy.pipeline_version), F.lit("PIPELINE_VERSION_CHANGED"))]
    tests += [F.when(F.col(name) != value, F.lit(code)) for name, value, code in asked if value is not None]
    return F.array_compact(F.array(*tests))


def outputs_exist(state: DataFrame, outputs: DataFrame, key: str = "relative_path", paths: str = "output_relative_paths") -> DataFrame:
    """``key, outputs_exist``: all recorded outputs are there; false if none is recorded.

    Paths are compared with ``/`` between their parts, however they were
    recorded or listed. One that leaves the root counts as missing.
    """
    each = state.select(key, F.explode_outer(paths).alias("output_path")).withColumn("output_path", F.translate("output_path", "\\", "/"))
    there = outputs.select(F.translate("path", "\\", "/").alias("output_path"), F.lit(True).alias("there")).distinct()
    safe = ~F.coalesce(F.array_contains(F.split("output_path", "/"), "..") | F.col("output_path").startswith("/"), F.lit(True))
    return each.join(there, "output_path", "left").groupBy(key).agg(F.min(F.coalesce("there", F.lit(False)) & safe).alias("outputs_exist"))


def classify(files: DataFrame, state: DataFrame, outputs: DataFrame, *, pipeline_version: str, policy: ReprocessPolicy | None = None, per_image: bool = False) -> DataFrame:
    """``files`` with ``classification``, ``reprocess_reason`` and ``outdated``.

    Files: relative_path, size, mtime_ns, sha256 (and expected_output if
    ``per_image``). The first rule that holds decides:

    1. no state: new; 2. without a policy, another pipeline version: rebuild;
    3. the expected output isn't recorded: rebuild; 4. an output is missing:
    rebuild; 5. the last run failed: modified; 6. the same size and time, or the
    same content: unchanged, or by the policy rebuild or needs_reprocess;
    7. otherwise modified. ``metadata_moved`` marks rows whose content is the
    same under another size or time: the state takes those over.
    """
    version = policy.pipeline_version if policy else pipeline_version
    known = state.join(outputs_exist(state, outputs), "relative_path", "left")
    known = known.select("relative_path", F.struct(*[c for c in known.columns if c != "relative_path"]).alias("was"))
    s = lambda name: F.col("was." + name)
    joined = files.join(known, "relative_path", "left")
    reasons = F.array().cast("array<string>")
    if policy:
        flat = {c: s(c) for c in ("pipeline_version", "detector_name", "detector_mode", "detector_model_version", "detector_model_checksum")}
        joined = joined.withColumns({f"__{k}": v for k, v in flat.items()})
        asked = (("detector_name", policy.detector_name, "DETECTOR_NAME_CHANGED"), ("detector_mode", policy.detector_mode, "DETECTOR_MODE_CHANGED"), ("detector_model_version", policy.model_version, "MODEL_VERSION_CHANGED"), ("detector_model_checksum", policy.model_checksum, "MODEL_CHECKSUM_CHANGED"))
        tests = [F.when(~F.col("__pipeline_version").eqNullSafe(version), F.lit("PIPELINE_VERSION_CHANGED"))]
        tests += [F.when(F.col(f"__{n}") != v, F.lit(code)) for n, v, code in asked if v is not None]
        reasons = F.array_compact(F.array(*tests))
    same_meta = (F.col("size") == s("size")) & (F.col("mtime_ns") == s("mtime_ns"))
    same_content = s("sha256").isNotNull() & (F.col("sha256") == s("sha256"))
    outcome = F.lit("unchanged") if not policy else F.when(F.size("__reasons") == 0, "unchanged").otherwise("rebuild" if policy.opt_in else "needs_reprocess")
    out = joined.withColumn("__reasons", reasons)
    rule = F.when(F.col("was").isNull(), "new")
    if not policy:
        rule = rule.when(~s("pipeline_version").eqNullSafe(version), "rebuild")
    if per_image:
        rule = rule.when(~F.coalesce(F.array_contains(s("output_relative_paths"), F.col("expected_output")), F.lit(False)), "rebuild")
    rule = rule.when(~F.coalesce(s("outputs_exist"), F.lit(False)), "rebuild").when(~F.coalesce(s("status").isin("success", "warning"), F.lit(False)), "modified")
    settled = rule.when(F.coalesce(same_meta | same_content, F.lit(False)), F.lit("settled")).otherwise("modified")
    out = out.withColumn("__rule", settled)
    out = out.withColumn("classification", F.when(F.col("__rule") == "settled", outcome).otherwise(F.col("__rule")))
    return out.withColumns({
        "reprocess_reason": F.when(F.col("classification") == "needs_reprocess", F.concat_ws(",", "__reasons")),
        "outdated": F.coalesce(F.col("was").isNotNull() & ~s("pipeline_version").eqNullSafe(version), F.lit(False)),
        "metadata_moved": (F.col("__rule") == "settled") & ~F.coalesce(same_meta, F.lit(False)),
    }).select(*files.columns, "classification", "reprocess_reason", "outdated", "metadata_moved")


def refreshed_state(classified: DataFrame, state: DataFrame) -> DataFrame:
    """The state with sizes and times taken over where the content is the same."""
    moved = classified.where("metadata_moved").select("relative_path", F.col("size").alias("__size"), F.col("mtime_ns").alias("__mtime"))
    out = state.join(moved, "relative_path", "left")
    return out.withColumns({"size": F.coalesce("__size", "size"), "mtime_ns": F.coalesce("__mtime", "mtime_ns")}).select(*state.columns)


def plan_summary(classified: DataFrame) -> DataFrame:
    """One row of counters; ``files_to_process`` is new, modified and rebuild together."""
    of = lambda k: F.count_if(F.col("classification") == k)
    return classified.agg(
        F.count(F.lit(1)).alias("total_files"),
        *[of(k).alias(k) for k in ("new", "modified", "unchanged", "rebuild", "needs_reprocess")],
        F.count_if(F.col("classification").isin(*PROCESSED)).alias("files_to_process"),
        F.count_if("outdated").alias("outdated_pipeline"),
    )


def reason_histogram(classified: DataFrame) -> DataFrame:
    return classified.where("classification = 'needs_reprocess'").select(F.explode(F.split(F.coalesce("reprocess_reason", F.lit("NEEDS_REPROCESS")), ",")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def source_order_fingerprint(path: str = "relative_path") -> Column:
    """Aggregate: a hash of the rows' identity and metadata, whatever their order."""
    normal = F.translate(path, "\\", "/")
    line = F.concat_ws(":", normal, F.col("size").cast("string"), F.col("mtime_ns").cast("string"), F.coalesce("sha256", F.lit("")))
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(normal.alias("p"), line.alias("l")))), lambda r: r["l"]), "|"), 256)


def removed_sources(groups: DataFrame, files: DataFrame) -> DataFrame:
    """``group_key, missing_sources``: recorded sources that are no longer there."""
    gone = groups.select("group_key", F.explode("source_relative_paths").alias("relative_path")).join(files.select("relative_path"), "relative_path", "left_anti")
    return gone.groupBy("group_key").agg(F.array_sort(F.collect_list("relative_path")).alias("missing_sources"))


def orphaned(state: DataFrame, files: DataFrame, outputs: DataFrame) -> DataFrame:
    """State rows whose source is gone and that have no output left."""
    gone = state.join(files.select("relative_path"), "relative_path", "left_anti")
    held = gone.select("relative_path", F.explode("output_relative_paths").alias("path")).join(outputs.select("path"), "path", "left_semi")
    return gone.join(held.select("relative_path").distinct(), "relative_path", "left_anti")


def orphaned_groups(groups: DataFrame, files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Groups without any source and any artifact left."""
    alive = groups.select("group_key", F.explode("source_relative_paths").alias("relative_path")).join(files.select("relative_path"), "relative_path", "left_semi").select("group_key")
    held = groups.select("group_key", F.explode("artifact_relative_paths").alias("path")).join(outputs.select("path"), "path", "left_semi").select("group_key")
    return groups.join(alive.unionByName(held).distinct(), "group_key", "left_anti")


REVIEW_REASONS = ("unknown_page_identity", "duplicate_page_order", "manual_order_invalidated", "missing_expected_page", "grouped_artifact_stale")


def group_plan(pages: DataFrame, groups: DataFrame, outputs: DataFrame, *, grouped: bool = True) -> DataFrame:
    """The groups that are affected, with ordered reasons, status and what to process.

    Pages (one for each discovered file): group_key, relative_path, position,
    classification, size, mtime_ns, sha256, known (has a state row), page_type,
    page_order. Groups: group_key, source_relative_paths, artifact_relative_paths,
    completeness_status, review_required, manual_order, manual_order_fingerprint,
    artifact_stale.
    """
    ordered = lambda c, when=None: F.transform(F.array_sort(F.collect_list(F.struct("position", c) if when is None else F.when(when, F.struct("position", c)))), lambda r: r[c])
    todo = F.col("classification").isin(*PROCESSED)
    now = pages.groupBy("group_key").agg(
        ordered("relative_path").alias("paths"),
        ordered("relative_path", todo).alias("changed"),
        F.array_distinct(F.transform(ordered("classification", todo), lambda c: F.concat(F.lit("source_"), c))).alias("source_reasons"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("known").alias("n_known"),
        F.count_if(~F.col("known") | (F.coalesce("page_type", F.lit("UNKNOWN")) == "UNKNOWN")).alias("n_unknown"),
        F.count(F.when(F.col("known"), F.col("page_order"))).alias("n_orders"),
        F.count_distinct(F.when(F.col("known"), F.col("page_order"))).alias("n_distinct"),
        source_order_fingerprint().alias("fingerprint"),
    )
    artifacts = outputs_exist(groups, outputs, "group_key", "artifact_relative_paths")
    was = groups.join(artifacts, "group_key", "left").withColumn("persisted", F.lit(True))
    gone = removed_sources(groups, pages)
    both = now.withColumn("current", F.lit(True)).join(was, "group_key", "full_outer").join(gone, "group_key", "left")
    empty = F.array().cast("array<string>")
    current, persisted = F.coalesce("current", F.lit(False)), F.coalesce("persisted", F.lit(False))
    manual = F.coalesce("manual_order", empty)
    missing = F.coalesce("missing_sources", empty)
    held = F.size(manual) > 0
    valid = F.coalesce(persisted & held & F.col("manual_order_fingerprint").isNotNull() & (F.col("n_known") == F.col("n")) & (F.size(F.array_distinct(manual)) == F.size(manual)) & (F.array_sort(manual) == F.array_sort("paths")) & (F.col("fingerprint") == F.col("manual_order_fingerprint")), F.lit(False))
    both = both.withColumns({"__valid": valid, "__missing": missing})
    open_order = F.lit(grouped) & ~F.col("__valid")
    reasons = F.concat(
        F.coalesce("source_reasons", empty),
        F.array_compact(F.array(
            F.when(F.size("__missing") > 0, "source_removed"),
            F.when(open_order & held, "manual_order_invalidated"),
            F.when(open_order & (F.col("n_unknown") > 0), "unknown_page_identity"),
            F.when(open_order & (F.col("n_orders") != F.col("n_distinct")), "duplicate_page_order"),
            F.when(open_order & (F.col("n") < 2), "missing_expected_page"),
            F.when(persisted & ~F.coalesce("outputs_exist", F.lit(False)), "missing_grouped_output"),
            F.when(persisted & F.coalesce("artifact_stale", F.lit(False)), "grouped_artifact_stale"),
        )),
    )
    vanished = ~current & (F.size("__missing") > 0) & F.coalesce("outputs_exist", F.lit(False))
    both = both.withColumn("reasons", F.when(current, F.array_distinct(reasons)).when(vanished, F.array(F.lit("source_removed"))).otherwise(empty)).where(F.size("reasons") > 0)
    review = F.when(current, F.coalesce("review_required", F.lit(False)) | (F.size("__missing") > 0) | F.arrays_overlap("reasons", F.array(*map(F.lit, REVIEW_REASONS)))).otherwise(False)
    incomplete = (F.size("__missing") > 0) | F.array_contains("reasons", "missing_expected_page") | ~current
    status = F.when(incomplete, "INCOMPLETE").otherwise(F.coalesce("completeness_status", F.lit("AMBIGUOUS")))
    both = both.withColumns({"__review": review, "__status": status})
    return both.select(
        "group_key",
        F.coalesce("paths", "source_relative_paths").alias("source_paths"),
        F.when(~current, empty).when(F.lit(grouped), F.col("paths")).otherwise(F.col("changed")).alias("process_paths"),
        "reasons",
        F.when(F.col("__review") & (F.col("__status") == "COMPLETE"), "AMBIGUOUS").otherwise(F.col("__status")).alias("completeness_status"),
        F.col("__review").alias("review_required"),
    )


def review_groups(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Affected groups that people must look at: they need review or are ambiguous, and a source is still there."""
    some = plan.where(F.col("review_required") | (F.col("completeness_status") == "AMBIGUOUS"))
    alive = some.select("group_key", F.explode("source_paths").alias("relative_path")).join(files.select("relative_path"), "relative_path", "left_semi").select("group_key").distinct()
    return some.join(alive, "group_key", "left_semi")


def group_counts(plan: DataFrame) -> DataFrame:
    of = lambda k: F.count_if(F.col("completeness_status") == k)
    return plan.agg(F.count(F.lit(1)).alias("groups"), of("COMPLETE").alias("complete"), of("INCOMPLETE").alias("incomplete"), of("AMBIGUOUS").alias("ambiguous"), F.count_if("review_required").alias("need_review"))


def group_provenance(entries: DataFrame, key: str) -> DataFrame:
    """Detector provenance of a group: a value only where all that know one agree."""
    same = lambda c: F.when(F.count_distinct(c) == 1, F.max(c))
    status = F.col("detection_status")
    kinds = F.collect_set(status)
    whole = F.when(F.array_contains(kinds, "failed"), "failed").when(F.array_contains(kinds, "fallback"), "fallback").when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))
    return entries.groupBy(key).agg(
        *[same(c).alias(c) for c in ("pipeline_version", "detector_name", "detector_model_version")],
        whole.alias("detection_status"),
        F.bool_or("detection_fallback_used").alias("detection_fallback_used"),
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(F.coalesce("detection_fallback_used", F.lit(False))).alias("fallback_page_count"),
        F.count_if(status == "failed").alias("failed_page_count"),
        F.size(F.collect_set(F.struct("detector_name", "detector_model_version"))).alias("detector_variant_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("detection_reason_codes")))).alias("detection_reason_codes"),
    )


def blocked_by_failure(outcomes: DataFrame, group: str = "group_key") -> DataFrame:
    """Adds ``blocked``: a page of the group failed, so none of it is exported."""
    return outcomes.withColumn("blocked", F.bool_or(F.col("status") == "failed").over(W.partitionBy(group)))


def ordered_pages(pages: DataFrame, group: str = "group_key") -> DataFrame:
    """Per group: paths by page order if all are known and different, else as they came, for review.

    Columns: group, seq (how they came), relative_path, page_type, page_order.
    """
    known = F.col("page_type") != "UNKNOWN"
    agg = pages.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(known).alias("n_known"),
        F.count("page_order").alias("n_orders"),
        F.count_distinct("page_order").alias("n_distinct"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "relative_path"))), lambda r: r["relative_path"]).alias("came"),
        F.transform(F.array_sort(F.collect_list(F.struct("page_order", "seq", "relative_path"))), lambda r: r["relative_path"]).alias("by_order"),
    )
    reason = F.when(F.col("n_known") < F.col("n"), "unknown_page_identity").when((F.col("n_orders") < F.col("n")) | (F.col("n_distinct") < F.col("n")), "duplicate_or_missing_page_order")
    return agg.select(group, F.when(reason.isNull(), F.col("by_order")).otherwise(F.col("came")).alias("ordered"), reason.isNotNull().alias("review_required"), reason.alias("reason"))


def batch_summary(outcomes: DataFrame, discovered: int | None = None) -> DataFrame:
    """Counts by status, what was skipped, and the exit code (2 if any failed)."""
    of = lambda k: F.count_if(F.col("status") == k)
    n = F.count(F.lit(1))
    return outcomes.agg(n.alias("total_processed"), of("success").alias("success"), of("warning").alias("warning"), of("failed").alias("failed"), F.greatest(F.lit(0), F.lit(discovered or 0) - n).alias("skipped"), F.when(of("failed") > 0, 2).otherwise(0).alias("exit_code"))


def flat_unchanged(items: DataFrame, state: DataFrame, outputs: DataFrame, fields: list[str]) -> DataFrame:
    """Adds ``unchanged``: every field equals the state's, null or not, and the output's hash is the recorded one."""
    was = state.select("source_relative_path", F.struct(*fields, "output_relative_path", "output_fingerprint").alias("was"))
    there = outputs.select(F.col("path").alias("output_relative_path"), F.col("sha256").alias("current_output"))
    joined = items.join(was, "source_relative_path", "left").join(there, "output_relative_path", "left")
    same = F.col("was").isNotNull()
    for f in [*fields, "output_relative_path"]:
        same = same & F.col(f).eqNullSafe(F.col(f"was.{f}"))
    return joined.withColumn("unchanged", same & F.coalesce(F.col("current_output") == F.col("was.output_fingerprint"), F.lit(False))).drop("was", "current_output")


def deleted_sources(state: DataFrame, items: DataFrame) -> DataFrame:
    return state.join(items.select("source_relative_path"), "source_relative_path", "left_anti")


def migrated_entries(old: DataFrame) -> DataFrame:
    """Rows of the first state format in the form of the second: no period, unknown page, outputs as a list."""
    return old.select(
        F.translate("relative_path", "\\", "/").alias("relative_path"), "size", "mtime_ns",
        F.array_compact(F.array("output_relative_path")).alias("output_relative_paths"), "status", "pipeline_version",
        F.lit(None).cast("struct<year:int,month:int>").alias("period"), F.lit("UNKNOWN").alias("page_type"), F.lit(None).cast("int").alias("page_order"),
    )


def migrated_artifacts(entries: DataFrame) -> DataFrame:
    """One row for each output; of several sources that name it the first path wins."""
    each = entries.select(F.explode("output_relative_paths").alias("output_relative_path"), "relative_path")
    return each.groupBy("output_relative_path").agg(F.min("relative_path").alias("relative_path"))


def upserted(state: DataFrame, updates: DataFrame, key: str = "relative_path") -> DataFrame:
    """``state`` with rows of ``updates`` in place of those of the same key."""
    return state.join(updates.select(key), key, "left_anti").unionByName(updates, allowMissingColumns=True)
