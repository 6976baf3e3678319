"""All queries over the capture tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafplan.functions import geometry as G
from leafplan.functions import strings as S
from leafplan.operators import detection as D
from leafplan.operators import evaluation as EV
from leafplan.operators import events as E
from leafplan.operators import greedy as GR
from leafplan.operators import inventory as I
from leafplan.operators import lifecycle as LC
from leafplan.operators import planning as P
from leafplan.operators import ranking as R
from leafplan.operators import records as RC
from leafplan.operators import validity as VA

from .surrogates import frame, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

POLICY = P.ReprocessPolicy("0.4.0", detector_name="hybrid", model_version="m1")


def query(*views: str, sql: str | None = None):
    """Registers a function of the capture tables ``views``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[frame(spark, sf_dir, v) for v in views])

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE_SQL[fn.__name__] = with_views(sql, *views)
        return fn

    return register


def r6(*names: str) -> list:
    """Columns rounded to six places, without a negative zero."""
    return [(F.round(F.col(n), 6) + 0.0).alias(n) for n in names]


# -- inventory -----------------------------------------------------------------

_STEM = "regexp_replace(file_name, '\\.[^.]*$', '')"
_EXTS = "lower(regexp_extract(file_name, '\\.([^.]*)$', 1))"


@query("v_files", sql=f"""
WITH picked AS (SELECT *, {_STEM} AS stem, {_EXTS} AS ext FROM v_files WHERE {_EXTS} IN ('jpg', 'jpeg', 'png', 'webp') AND NOT starts_with(file_name, '.')),
c AS (SELECT *, COUNT(DISTINCT file_name) OVER (PARTITION BY employee_name, lower(stem)) > 1 AS is_collision FROM picked)
SELECT relative_path, file_name, is_collision, CASE WHEN is_collision THEN stem || '__' || ext || '.pdf' ELSE stem || '.pdf' END AS target_pdf FROM c""")
def inventory_targets(files):
    return I.inventory(files).select("relative_path", "file_name", "is_collision", "target_pdf")


@query("v_files", sql=f"""
SELECT relative_path, ROW_NUMBER() OVER (PARTITION BY employee_name ORDER BY regexp_extract(file_name, '^([a-z]+)-', 1), CAST(regexp_extract(file_name, '(\\d+)', 1) AS INT), {_EXTS}, file_name, relative_path) AS position FROM v_files""")
def inventory_natural_order(files):
    return I.natural_position(files).select("relative_path", "position")


@query("v_files", sql=f"""
SELECT employee_name, COUNT(*) FILTER (WHERE {_EXTS} <> 'txt') AS supported, COUNT(*) FILTER (WHERE {_EXTS} = 'txt') AS unsupported FROM v_files GROUP BY 1""")
def inventory_unsupported(files):
    return I.unsupported_count(files)


@query("v_entries", sql="""
WITH base AS (SELECT relative_path, '2024-03_' || split_part(group_key, ':', 1) || '_' || CASE WHEN page_order IS NOT NULL AND page_type <> 'UNKNOWN' THEN 'p' || lpad(CAST(page_order AS VARCHAR), 2, '0') ELSE substr(sha256(relative_path), 1, 8) END || '.pdf' AS base_name FROM v_entries)
SELECT relative_path, CASE WHEN COUNT(*) OVER (PARTITION BY base_name) > 1 THEN replace(base_name, '.pdf', '') || '_' || substr(sha256(relative_path), 1, 8) || '.pdf' ELSE base_name END AS artifact_name FROM base""")
def artifact_names(entries):
    pages = entries.select(F.split_part("group_key", F.lit(":"), F.lit(1)).alias("employee_name"), F.lit(2024).alias("year"), F.lit(3).alias("month"), "page_type", "page_order", "relative_path")
    return I.collision_free_names(pages).select("relative_path", "artifact_name")


@query("v_files", sql="""
SELECT relative_path, substr(sha256(relative_path), 1, 24) AS root_id, substr(sha256(employee_name || chr(10) || file_name), 1, 32) AS flat_id, employee_name || ':2024-03' AS group_key,
  CASE doc_id % 4 WHEN 0 THEN '0.4.0' WHEN 1 THEN '0.4.0:color' WHEN 2 THEN '0.4.0:smart_document' ELSE '0.4.0:bw' END AS version,
  CASE doc_id % 3 WHEN 0 THEN '_CON' WHEN 1 THEN 'a_b_c' ELSE 'employee' END AS safe_name,
  substr(sha256(relative_path || ':' || CAST(size AS VARCHAR) || ':' || CAST(mtime_ns AS VARCHAR)), 1, 24) || '.pdf' AS draft, split_part(relative_path, '/', 2) AS base_name FROM v_files""")
def naming_rules(files):
    k = F.col("doc_id")
    mode = F.when(k % 4 == 0, "gray").when(k % 4 == 1, "Color_Enhanced").when(k % 4 == 2, "smart").otherwise("bw")
    odd = F.when(k % 3 == 0, "CON").when(k % 3 == 1, " a<b|c. ").otherwise(" .. ")
    return files.select("relative_path", S.root_id(F.col("relative_path")).alias("root_id"), S.flat_manifest_id(F.col("employee_name"), F.col("file_name")).alias("flat_id"), S.group_key_text(F.col("employee_name"), F.lit(2024), F.lit(3)).alias("group_key"), S.version_for_mode(F.lit(S.PIPELINE_VERSION), mode).alias("version"), S.safe_component(odd).alias("safe_name"), S.draft_name(F.col("relative_path"), F.col("size"), F.col("mtime_ns")).alias("draft"), S.base_name(F.col("relative_path")).alias("base_name"))


# -- planning ------------------------------------------------------------------

_KNOWN = """k AS (SELECT f.relative_path, f.size, f.mtime_ns, f.sha256, s.relative_path IS NOT NULL AS known, s.pipeline_version AS v, s.status, s.detector_name AS dn, s.detector_model_version AS mv,
  s.size = f.size AND s.mtime_ns = f.mtime_ns AS meta, s.sha256 = f.sha256 AS content, COALESCE(o.path IS NOT NULL, FALSE) AS there
  FROM v_files f LEFT JOIN v_state s USING (relative_path) LEFT JOIN v_outputs o ON o.path = s.output_relative_paths[1])"""
_PLAIN = f"""{_KNOWN}, c AS (SELECT *, known AND v <> '0.4.0' AS outdated, CASE WHEN NOT known THEN 'new' WHEN v <> '0.4.0' THEN 'rebuild' WHEN NOT there THEN 'rebuild' WHEN status NOT IN ('success', 'warning') THEN 'modified'
  WHEN meta OR content THEN 'unchanged' ELSE 'modified' END AS classification, NULL AS reprocess_reason FROM k)"""
_UNDER = f"""{_KNOWN}, r AS (SELECT *, concat_ws(',', CASE WHEN v <> '0.4.0' THEN 'PIPELINE_VERSION_CHANGED' END, CASE WHEN dn <> 'hybrid' THEN 'DETECTOR_NAME_CHANGED' END, CASE WHEN mv <> 'm1' THEN 'MODEL_VERSION_CHANGED' END) AS why FROM k),
  c AS (SELECT *, known AND v <> '0.4.0' AS outdated, CASE WHEN NOT known THEN 'new' WHEN NOT there THEN 'rebuild' WHEN status NOT IN ('success', 'warning') THEN 'modified' WHEN meta OR content THEN CASE WHEN why = '' THEN 'unchanged' ELSE 'needs_reprocess' END ELSE 'modified' END AS classification,
  CASE WHEN known AND there AND status IN ('success', 'warning') AND (meta OR content) AND why <> '' THEN why END AS reprocess_reason FROM r)"""
_COUNTS = "COUNT(*) AS total_files, " + ", ".join(f"COUNT(*) FILTER (WHERE classification = '{c}') AS {c}" for c in ("new", "modified", "unchanged", "rebuild", "needs_reprocess")) + ", COUNT(*) FILTER (WHERE classification IN ('new', 'modified', 'rebuild')) AS files_to_process, COUNT(*) FILTER (WHERE outdated) AS outdated_pipeline"
_PLAN = ("v_files", "v_state", "v_outputs")


def _files(files):
    return files.select("relative_path", "size", "mtime_ns", "sha256")


@query(*_PLAN, sql=f"WITH {_PLAIN} SELECT {_COUNTS} FROM c")
def plan_summary(files, state, outputs):
    return P.plan_summary(P.classify(_files(files), state, outputs, pipeline_version="0.4.0"))


@query(*_PLAN, sql=f"WITH {_UNDER} SELECT {_COUNTS} FROM c")
def plan_summary_under_policy(files, state, outputs):
    return P.plan_summary(P.classify(_files(files), state, outputs, pipeline_version="0.4.0", policy=POLICY))


@query(*_PLAN, sql=f"WITH {_UNDER} SELECT relative_path, classification, reprocess_reason, outdated FROM c")
def plan_classes(files, state, outputs):
    return P.classify(_files(files), state, outputs, pipeline_version="0.4.0", policy=POLICY).select("relative_path", "classification", "reprocess_reason", "outdated")


@query(*_PLAN, sql=f"WITH {_UNDER} SELECT reason, COUNT(*) AS n FROM (SELECT unnest(string_split(reprocess_reason, ',')) AS reason FROM c WHERE classification = 'needs_reprocess') GROUP BY 1")
def plan_reasons(files, state, outputs):
    return P.reason_histogram(P.classify(_files(files), state, outputs, pipeline_version="0.4.0", policy=POLICY))


@query(*_PLAN, sql="""SELECT f.relative_path, CASE WHEN s.relative_path IS NULL THEN 'new' WHEN o.path IS NULL OR e.x <> s.output_relative_paths[1] THEN 'rebuild' WHEN s.status = 'failed' THEN 'modified'
  WHEN (s.size = f.size AND s.mtime_ns = f.mtime_ns) OR s.sha256 = f.sha256 THEN CASE WHEN s.pipeline_version <> '0.4.0' OR s.detector_name <> 'hybrid' OR s.detector_model_version <> 'm1' THEN 'rebuild' ELSE 'unchanged' END ELSE 'modified' END AS classification
  FROM v_files f JOIN (SELECT relative_path, CASE WHEN doc_id % 43 = 0 THEN 'else.pdf' ELSE concat(employee_name, '/', CAST(doc_id AS VARCHAR), '.pdf') END AS x FROM v_files) e USING (relative_path)
  LEFT JOIN v_state s USING (relative_path) LEFT JOIN v_outputs o ON o.path = s.output_relative_paths[1]""")
def plan_per_image_opt_in(files, state, outputs):
    expected = F.when(F.col("doc_id") % 43 == 0, "else.pdf").otherwise(F.concat("employee_name", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    policy = P.ReprocessPolicy("0.4.0", detector_name="hybrid", model_version="m1", opt_in=True)
    rows = files.select("relative_path", "size", "mtime_ns", "sha256", expected.alias("expected_output"))
    return P.classify(rows, state, outputs, pipeline_version="0.4.0", policy=policy, per_image=True).select("relative_path", "classification")


@query(*_PLAN, sql=f"""WITH {_PLAIN} SELECT s.relative_path, CASE WHEN c.classification = 'unchanged' AND NOT c.meta THEN c.size ELSE s.size END AS size, CASE WHEN c.classification = 'unchanged' AND NOT c.meta THEN c.mtime_ns ELSE s.mtime_ns END AS mtime_ns
  FROM v_state s LEFT JOIN c USING (relative_path)""")
def plan_refreshed_state(files, state, outputs):
    return P.refreshed_state(P.classify(_files(files), state, outputs, pipeline_version="0.4.0"), state).select("relative_path", "size", "mtime_ns")


@query(*_PLAN, sql="SELECT s.relative_path FROM v_state s WHERE NOT EXISTS (SELECT 1 FROM v_files f WHERE f.relative_path = s.relative_path) AND NOT EXISTS (SELECT 1 FROM v_outputs o WHERE o.path = s.output_relative_paths[1])")
def plan_orphaned_state(files, state, outputs):
    return P.orphaned(state, files, outputs).select("relative_path")


def _groups(entries):
    every = entries.groupBy("group_key").agg(F.array_sort(F.collect_list("relative_path")).alias("source_relative_paths"), F.max("seq").alias("m"), P.source_order_fingerprint().alias("fp"))
    m = F.col("m")
    return every.select(
        "group_key",
        F.when(m % 5 == 1, F.array_append("source_relative_paths", F.lit("gone/x.jpg"))).otherwise(F.col("source_relative_paths")).alias("source_relative_paths"),
        F.array(F.concat(F.split_part("group_key", F.lit(":"), F.lit(1)), F.lit("/"), m.cast("string"), F.lit(".pdf"))).alias("artifact_relative_paths"),
        F.when(m % 3 == 0, "COMPLETE").otherwise("AMBIGUOUS").alias("completeness_status"),
        (m % 4 == 0).alias("review_required"),
        F.when(m % 2 == 0, F.col("source_relative_paths")).otherwise(F.array().cast("array<string>")).alias("manual_order"),
        F.when(m % 6 == 0, F.lit("old")).otherwise(F.col("fp")).alias("manual_order_fingerprint"),
        (m % 7 == 0).alias("artifact_stale"),
    )


def _group_pages(entries):
    cls = F.when(F.col("seq") % 8 == 0, "modified").when(F.col("seq") % 9 == 0, "new").otherwise("unchanged")
    return entries.select("group_key", "relative_path", F.col("seq").alias("position"), cls.alias("classification"), "size", "mtime_ns", "sha256", F.lit(True).alias("known"), "page_type", "page_order")


_GROUP_SQL = """WITH g AS (SELECT group_key, list(relative_path ORDER BY relative_path) AS sources, max(seq) AS m,
   sha256(string_agg(relative_path || ':' || size || ':' || mtime_ns || ':' || sha256, '|' ORDER BY relative_path)) AS fp,
   list(relative_path ORDER BY seq) AS paths, list(CASE WHEN seq % 8 = 0 THEN 'source_modified' ELSE 'source_new' END ORDER BY seq) FILTER (WHERE seq % 8 = 0 OR seq % 9 = 0) AS why,
   count(*) AS n, count(*) FILTER (WHERE page_type = 'UNKNOWN') AS unknown, count(page_order) AS orders, count(DISTINCT page_order) AS distinct_orders FROM v_entries GROUP BY 1),
 a AS (SELECT g.*, m % 5 = 1 AS gone, m % 2 = 0 AS manual, m % 2 = 0 AND m % 6 <> 0 AS valid, o.path IS NOT NULL AS there FROM g LEFT JOIN v_outputs o ON o.path = split_part(group_key, ':', 1) || '/' || m || '.pdf'),
 r AS (SELECT *, array_to_string(list_concat(
   CASE WHEN why IS NULL THEN [] WHEN list_contains(why, 'source_modified') AND list_contains(why, 'source_new') THEN [why[1], CASE why[1] WHEN 'source_new' THEN 'source_modified' ELSE 'source_new' END] ELSE [why[1]] END,
   list_filter([CASE WHEN gone THEN 'source_removed' END, CASE WHEN manual AND NOT valid THEN 'manual_order_invalidated' END, CASE WHEN NOT valid AND unknown > 0 THEN 'unknown_page_identity' END,
     CASE WHEN NOT valid AND orders <> distinct_orders THEN 'duplicate_page_order' END, CASE WHEN NOT valid AND n < 2 THEN 'missing_expected_page' END, CASE WHEN NOT there THEN 'missing_grouped_output' END, CASE WHEN m % 7 = 0 THEN 'grouped_artifact_stale' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM a),
 s AS (SELECT *, m % 4 = 0 OR gone OR regexp_matches(reasons, 'unknown_page|duplicate_page|manual_order|missing_expected|stale') AS review, CASE WHEN gone OR contains(reasons, 'missing_expected_page') THEN 'INCOMPLETE' WHEN m % 3 = 0 THEN 'COMPLETE' ELSE 'AMBIGUOUS' END AS status FROM r WHERE reasons <> '')"""


@query("v_entries", "v_outputs", sql=_GROUP_SQL + " SELECT group_key, reasons, CASE WHEN review AND status = 'COMPLETE' THEN 'AMBIGUOUS' ELSE status END AS completeness_status, review AS review_required, len(paths) AS n_process FROM s")
def group_plan(entries, outputs):
    plan = P.group_plan(_group_pages(entries), _groups(entries), outputs)
    return plan.select("group_key", F.concat_ws(",", "reasons").alias("reasons"), "completeness_status", "review_required", F.size("process_paths").cast("long").alias("n_process"))


@query("v_entries", "v_outputs", sql=_GROUP_SQL + ", t AS (SELECT *, CASE WHEN review AND status = 'COMPLETE' THEN 'AMBIGUOUS' ELSE status END AS final FROM s) SELECT COUNT(*) AS groups, COUNT(*) FILTER (WHERE final = 'COMPLETE') AS complete, COUNT(*) FILTER (WHERE final = 'INCOMPLETE') AS incomplete, COUNT(*) FILTER (WHERE final = 'AMBIGUOUS') AS ambiguous, COUNT(*) FILTER (WHERE review) AS need_review FROM t")
def group_counts(entries, outputs):
    return P.group_counts(P.group_plan(_group_pages(entries), _groups(entries), outputs))


@query("v_entries", "v_outputs", sql=_GROUP_SQL + " SELECT group_key, array_to_string(sources, ',') AS sources FROM s WHERE review OR CASE WHEN review AND status = 'COMPLETE' THEN 'AMBIGUOUS' ELSE status END = 'AMBIGUOUS'")
def group_reviews(entries, outputs):
    plan = P.review_groups(P.group_plan(_group_pages(entries), _groups(entries), outputs), entries)
    return plan.select("group_key", F.array_join(F.array_sort("source_paths"), ",").alias("sources"))


@query("v_entries", sql="SELECT group_key, 1 AS n_missing FROM v_entries GROUP BY 1 HAVING max(seq) % 5 = 1")
def group_removed_sources(entries):
    return P.removed_sources(_groups(entries), entries).select("group_key", F.size("missing_sources").alias("n_missing"))


@query("v_entries", sql="""SELECT group_key, CASE WHEN count(DISTINCT pipeline_version) = 1 THEN max(pipeline_version) END AS pipeline_version, CASE WHEN count(DISTINCT detector_name) = 1 THEN max(detector_name) END AS detector_name,
  CASE WHEN count(DISTINCT detector_model_version) = 1 THEN max(detector_model_version) END AS detector_model_version,
  CASE WHEN bool_or(detection_status = 'failed') THEN 'failed' WHEN bool_or(detection_status = 'fallback') THEN 'fallback' ELSE max(detection_status) END AS detection_status, bool_or(detection_fallback_used) AS detection_fallback_used,
  count(*) AS page_count, count(*) FILTER (WHERE detection_fallback_used) AS fallback_page_count, count(*) FILTER (WHERE detection_status = 'failed') AS failed_page_count,
  CAST(len(list(DISTINCT coalesce(detector_name, '-') || coalesce(detector_model_version, '-'))) AS INT) AS detector_variant_count, array_to_string(list_sort(list_distinct(flatten(list(detection_reason_codes)))), ',') AS detection_reason_codes FROM v_entries GROUP BY 1""")
def group_provenance(entries):
    return P.group_provenance(entries, "group_key").withColumn("detection_reason_codes", F.array_join("detection_reason_codes", ","))


@query("v_pages", sql="""WITH g AS (SELECT group_key, array_to_string(list(relative_path ORDER BY seq, relative_path), ',') AS came, array_to_string(list(relative_path ORDER BY page_order, seq, relative_path), ',') AS by_order,
  CASE WHEN bool_or(page_type = 'UNKNOWN') THEN 'unknown_page_identity' WHEN count(page_order) < count(*) OR count(DISTINCT page_order) < count(*) THEN 'duplicate_or_missing_page_order' END AS reason FROM v_pages GROUP BY 1)
  SELECT group_key, CASE WHEN reason IS NULL THEN by_order ELSE came END AS ordered, reason IS NOT NULL AS review_required, reason FROM g""")
def page_order(pages):
    return P.ordered_pages(pages).withColumn("ordered", F.array_join("ordered", ","))


@query("v_pages", sql="SELECT group_key, relative_path, bool_or(status = 'failed') OVER (PARTITION BY group_key) AS blocked FROM v_pages")
def group_blocking(pages):
    return P.blocked_by_failure(pages).select("group_key", "relative_path", "blocked")


@query("v_pages", sql="SELECT count(*) AS total_processed, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'warning') AS warning, count(*) FILTER (WHERE status = 'failed') AS failed, greatest(0, 600 - count(*)) AS skipped, CASE WHEN bool_or(status = 'failed') THEN 2 ELSE 0 END AS exit_code FROM v_pages")
def batch_summary(pages):
    return P.batch_summary(pages, 600)


@query("v_entries", sql="SELECT group_key, sha256(string_agg(relative_path || ':' || size || ':' || mtime_ns || ':' || coalesce(sha256, ''), '|' ORDER BY relative_path)) AS fingerprint FROM v_entries GROUP BY 1")
def order_fingerprints(entries):
    return entries.groupBy("group_key").agg(P.source_order_fingerprint().alias("fingerprint"))


_FLAT = "SELECT relative_path AS source_relative_path, sha256 AS content_fingerprint, 'gray' AS scan_mode, CASE WHEN doc_id % 12 = 0 THEN NULL ELSE 'm1' END AS detector_model_version, output_relative_paths[1] AS output_relative_path FROM v_state"


@query(*_PLAN, sql="""SELECT f.relative_path AS source_relative_path, coalesce(s.sha256 = f.sha256 AND (CASE WHEN s.doc_id % 12 = 0 THEN NULL ELSE 'm1' END) IS NOT DISTINCT FROM (CASE WHEN f.doc_id % 24 = 0 THEN NULL ELSE 'm1' END) AND o.path IS NOT NULL AND s.doc_id % 21 <> 1, FALSE) AS unchanged
  FROM v_files f LEFT JOIN v_state s USING (relative_path) LEFT JOIN v_outputs o ON o.path = concat(f.employee_name, '/', CAST(f.doc_id AS VARCHAR), '.pdf')""")
def flat_unchanged(files, state, outputs):
    model = lambda k: F.when(F.col("doc_id") % k == 0, F.lit(None).cast("string")).otherwise("m1").alias("detector_model_version")
    items = files.select(F.col("relative_path").alias("source_relative_path"), F.col("sha256").alias("content_fingerprint"), model(24), F.concat("employee_name", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("output_relative_path"))
    was = state.select(F.col("relative_path").alias("source_relative_path"), F.col("sha256").alias("content_fingerprint"), model(12), F.get("output_relative_paths", F.lit(0)).alias("output_relative_path"), F.when(F.col("doc_id") % 21 == 1, "other").otherwise("out").alias("output_fingerprint"))
    return P.flat_unchanged(items, was, outputs.select("path", F.lit("out").alias("sha256")), ["content_fingerprint", "detector_model_version"]).select("source_relative_path", "unchanged")


@query("v_files", "v_state", sql="SELECT relative_path FROM v_state WHERE relative_path NOT IN (SELECT relative_path FROM v_files)")
def flat_deleted_sources(files, state):
    rename = lambda df: df.withColumnRenamed("relative_path", "source_relative_path")
    return P.deleted_sources(rename(state), rename(files)).select(F.col("source_relative_path").alias("relative_path"))


@query("v_state", sql="SELECT output_relative_paths[1] AS output_relative_path, min(relative_path) AS relative_path FROM v_state GROUP BY 1")
def state_migration(state):
    old = state.withColumn("output_relative_path", F.get("output_relative_paths", F.lit(0)))
    return P.migrated_artifacts(P.migrated_entries(old))


@query("v_state", sql="SELECT relative_path, CASE WHEN doc_id % 6 = 0 AND relative_path NOT LIKE 'gone/%' THEN 'failed' ELSE status END AS status FROM v_state")
def state_upsert(state):
    updates = state.where("doc_id % 6 = 0 and relative_path not like 'gone/%'").withColumn("status", F.lit("failed"))
    return P.upserted(state, updates).select("relative_path", "status")


# -- ranking -------------------------------------------------------------------

_SCORE = """WITH b AS (SELECT *, 0.4 * coalesce(mask_quad_iou, 0.5) + 0.05 * CASE WHEN mask_coverage IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, mask_coverage)) END + 0.1 * 0.5 + 0.1 * coalesce(edge_support, 0.5) + 0.15 * geometry_quality + 0.05 + 0.05 * CASE WHEN border_contact THEN 0.8 ELSE 1.0 END + 0.05 * 0.5
   + 0.1 * CASE source WHEN 'mask_fit' THEN 0.95 WHEN 'mixed' THEN 0.9 WHEN 'contour' THEN 0.65 WHEN 'hough' THEN 0.6 ELSE 0.5 END AS base,
   CASE WHEN has_overlap THEN 0.25 * least(1.0, greatest(enclosed_length, 0) / greatest(1e-6, 0.25 * perimeter)) ELSE 0 END AS penalty, CASE WHEN has_overlap AND aligns THEN 0.08 ELSE 0 END AS bonus FROM v_candidates),
 s AS (SELECT *, least(1.0, greatest(0.0, base / 1.05 - penalty + bonus)) AS final_score, CASE WHEN mask_coverage IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, mask_coverage)) END AS cov_key FROM b),
 r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(final_score, 9) DESC, cov_key DESC, geometry_quality DESC, source, candidate_id) AS rank, max(final_score) OVER (PARTITION BY image_id) AS top FROM s)"""


@query("v_candidates", sql=_SCORE + " SELECT image_id, candidate_id, round(final_score, 6) AS final_score, CASE WHEN rank <= 3 THEN rank END AS top_rank FROM r")
def candidate_ranking(candidates):
    rows = R.ranked(candidates)
    return rows.select("image_id", "candidate_id", G.rounded(F.col("final_score"), 6).alias("final_score"), F.when(F.col("rank") <= 3, F.col("rank").cast("long")).alias("top_rank"))


def _decision_sql(margin: float, least: float) -> str:
    return _SCORE + f""", n AS (SELECT *, top - final_score <= {margin} AS near, coalesce(mask_coverage, 0) AS cov, coalesce(mask_quad_iou, 0) AS iou, CASE WHEN has_overlap THEN enclosed_ridges ELSE 0 END AS ridges, has_overlap AND aligns AS lined FROM r),
 few AS (SELECT *, near AND ridges = min(CASE WHEN near THEN ridges END) OVER (PARTITION BY image_id) AS win FROM n),
 fit AS (SELECT *, row_number() OVER (PARTITION BY image_id, near ORDER BY iou DESC, geometry_quality DESC, candidate_id) AS fit_rank, row_number() OVER (PARTITION BY image_id, near ORDER BY cov DESC, geometry_quality DESC, candidate_id) AS cov_rank FROM few),
 g AS (SELECT image_id, max(final_score) FILTER (WHERE rank = 1) AS top_score, max(final_score) FILTER (WHERE rank = 2) AS second_score, max(candidate_id) FILTER (WHERE rank = 1) AS first_id, count(*) FILTER (WHERE win) AS n_few, max(candidate_id) FILTER (WHERE win) AS few_id,
   count(*) FILTER (WHERE win AND lined) AS n_lined, count(*) FILTER (WHERE win AND NOT lined) AS n_unlined, max(candidate_id) FILTER (WHERE win AND lined) AS lined_id, max(cov) FILTER (WHERE near) - min(cov) FILTER (WHERE near) AS gap, max(candidate_id) FILTER (WHERE near AND cov_rank = 1) AS full_id,
   max(iou) FILTER (WHERE near AND fit_rank = 1) - max(iou) FILTER (WHERE near AND fit_rank = 2) AS d_iou, max(geometry_quality) FILTER (WHERE near AND fit_rank = 1) - max(geometry_quality) FILTER (WHERE near AND fit_rank = 2) AS d_geo, max(candidate_id) FILTER (WHERE near AND fit_rank = 1) AS fit_id FROM fit GROUP BY 1),
 h AS (SELECT *, CASE WHEN n_few = 1 THEN few_id WHEN n_lined = 1 AND n_unlined > 0 THEN lined_id WHEN gap >= 0.08 THEN full_id WHEN d_iou >= 0.005 THEN fit_id WHEN d_geo >= 0.02 THEN fit_id END AS resolved, second_score IS NOT NULL AND top_score - second_score <= {margin} AS close FROM g)
 SELECT image_id, CASE WHEN top_score < {least} THEN 'below_threshold' WHEN close AND resolved IS NULL THEN 'ambiguous' ELSE 'selected' END AS status, CASE WHEN top_score < {least} THEN NULL WHEN close THEN resolved ELSE first_id END AS selected_candidate_id, round(top_score, 6) AS top_score FROM h"""


@query("v_candidates", sql=_decision_sql(0.03, 0.55))
def candidate_decisions(candidates):
    return R.decisions(candidates).select("image_id", "status", F.col("selected_candidate_id").cast("long").alias("selected_candidate_id"), G.rounded(F.col("top_score"), 6).alias("top_score"))


@query("v_candidates", sql="""WITH s AS (SELECT *, round(least(1.0, greatest(0.0, 0.45 * geometry_quality + 0.4 * coalesce(mask_quad_iou, 0) + 0.1 * coalesce(edge_support, 0) + 0.05 * coalesce(mask_coverage, 1))) + 1e-8, 6) AS pool_score FROM v_candidates)
 SELECT image_id, candidate_id, pool_score FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY pool_score DESC, candidate_id) <= 2""")
def candidate_pool_top(candidates):
    score = R.pool_score(*[F.col(c) for c in ("mask_quad_iou", "mask_coverage", "edge_support", "geometry_quality")])
    # The shift keeps halves from being rounded both ways.
    rows = candidates.withColumn("pool_score", F.round(score + 1e-8, 6))
    return R.top_k(rows, ("image_id",), [F.desc("pool_score"), "candidate_id"], 2).select("image_id", "candidate_id", "pool_score")


@query("v_candidates", sql="SELECT source, count(*) AS n FROM v_candidates GROUP BY 1")
def candidate_sources(candidates):
    return R.source_counts(candidates)


@query("v_candidates", sql="""WITH r AS (SELECT image_id, candidate_id AS label, round(geometry_quality, 6) AS score, lead(round(geometry_quality, 6)) OVER w AS next, row_number() OVER w AS rank FROM v_candidates WINDOW w AS (PARTITION BY image_id ORDER BY round(geometry_quality, 6) DESC, perimeter DESC, candidate_id))
 SELECT image_id, label, score, coalesce(round(score - next, 6) <= 0.08, FALSE) AS ambiguous FROM r WHERE rank = 1""")
def component_choice(candidates):
    rows = candidates.select("image_id", F.col("candidate_id").alias("label"), F.col("perimeter").alias("area"), F.round("geometry_quality", 6).alias("score"))
    return R.pick_component(rows, 0.0800005)


_PARTS = (
    ("mask_iou", "mask_quad_iou", "0.5", 0.4, "mask_quad_iou"), ("mask_coverage", "CASE WHEN mask_coverage IS NOT NULL THEN least(1.0, greatest(0.0, mask_coverage)) END", "0.5", 0.05, "mask_coverage"), ("mask_confidence", "NULL", "0.5", 0.1, "mask_confidence"),
    ("edge_support", "edge_support", "0.5", 0.1, "edge_support"), ("geometry", "geometry_quality", "0", 0.15, "geometry_gate_quality"), ("convexity", "1.0", "0", 0.05, "convexity"),
    ("border", "CASE WHEN border_contact THEN 0.8 WHEN NOT border_contact THEN 1.0 END", "1.0", 0.05, "border_touch_allowed"), ("aspect", "NULL", "0.5", 0.05, "soft_aspect_hint"),
    ("source_reliability", "CASE source WHEN 'mask_fit' THEN 0.95 WHEN 'mixed' THEN 0.9 WHEN 'contour' THEN 0.65 WHEN 'hough' THEN 0.6 ELSE 0.5 END", "0.5", 0.1, "source_reliability"),
)
_RIDGE = "CASE WHEN has_overlap THEN least(1.0, greatest(enclosed_length, 0) / greatest(1e-6, 0.25 * perimeter)) ELSE 0 END"


def _part_sql(name: str, value: str, neutral: str, weight: float, policy: str) -> str:
    missing = "neutral:border_not_reported" if name == "border" else f"neutral:{policy}"
    return f"SELECT image_id, candidate_id, '{name}' AS component, round(coalesce({value}, {neutral})::DOUBLE, 6) AS value, round(coalesce({value}, {neutral})::DOUBLE * {weight} / 1.05, 6) + 0.0 AS contribution, ({value}) IS NOT NULL AS applicable, CASE WHEN ({value}) IS NOT NULL THEN '{policy}' ELSE '{missing}' END AS policy FROM v_candidates"


@query("v_candidates", sql=" UNION ALL ".join([_part_sql(*x) for x in _PARTS] + [
    f"SELECT image_id, candidate_id, 'occlusion_penalty', round(({_RIDGE})::DOUBLE, 6), round(-0.25 * ({_RIDGE})::DOUBLE, 6) + 0.0, has_overlap, CASE WHEN has_overlap THEN 'verified_occlusion_ridge_penalty' ELSE 'neutral:no_occlusion' END FROM v_candidates",
    "SELECT image_id, candidate_id, 'occlusion_alignment', CASE WHEN has_overlap AND aligns THEN 1.0::DOUBLE ELSE 0 END, CASE WHEN has_overlap AND aligns THEN 0.08::DOUBLE ELSE 0 END, has_overlap AND aligns, CASE WHEN has_overlap AND aligns THEN 'verified_occlusion_ridge_alignment' ELSE 'neutral:no_occlusion' END FROM v_candidates"]))
def candidate_breakdown(candidates):
    rows = R.with_scores(candidates, explain=True).select("image_id", "candidate_id", F.explode("breakdown").alias("component", "p"))
    return rows.select("image_id", "candidate_id", "component", (F.round("p.value", 6) + 0.0).alias("value"), (F.round("p.contribution", 6) + 0.0).alias("contribution"), "p.applicable", "p.policy")


@query("v_candidates", sql=" UNION ALL ".join(f"SELECT '{name}' AS policy, * FROM ({_decision_sql(margin, least)})" for name, margin, least in (("default", 0.03, 0.55), ("wide", 0.06, 0.55), ("strict", 0.03, 0.7))))
def candidate_sweep(candidates):
    found = R.sweep(candidates, {"default": R.ScoringPolicy(), "wide": R.ScoringPolicy(margin=0.06), "strict": R.ScoringPolicy(minimum_score=0.7)})
    return found.select("policy", "image_id", "status", F.col("selected_candidate_id").cast("long").alias("selected_candidate_id"), G.rounded(F.col("top_score"), 6).alias("top_score"))


# -- evaluation ----------------------------------------------------------------

_T = [f"t.corners[{i}]" for i in range(1, 5)]
_AREA = lambda a: f"abs({' + '.join(f'{a}[{i}].x * {a}[{i % 4 + 1}].y - {a}[{i % 4 + 1}].x * {a}[{i}].y' for i in range(1, 5))}) / 2"
# The area that two convex quadrilaterals share: of the points of one in the other and the crossings of edges, in turn around their middle.
_SHARED = """q AS (SELECT t.sample_id, t.corners AS a, p.corners AS b FROM v_truth t JOIN v_pred p USING (sample_id) WHERE p.detected AND t.sample_id % 13 <> 0),
 i4(i) AS (VALUES (1), (2), (3), (4)),
 ea AS (SELECT sample_id, i, a[i].x AS x1, a[i].y AS y1, a[i % 4 + 1].x AS x2, a[i % 4 + 1].y AS y2 FROM q, i4),
 eb AS (SELECT sample_id, i, b[i].x AS x1, b[i].y AS y1, b[i % 4 + 1].x AS x2, b[i % 4 + 1].y AS y2 FROM q, i4),
 pts AS (
  SELECT p.sample_id, p.x1 AS x, p.y1 AS y FROM ea p JOIN eb e ON p.sample_id = e.sample_id GROUP BY p.sample_id, p.i, p.x1, p.y1 HAVING bool_and((e.x2 - e.x1) * (p.y1 - e.y1) - (e.y2 - e.y1) * (p.x1 - e.x1) >= 0)
  UNION ALL SELECT p.sample_id, p.x1, p.y1 FROM eb p JOIN ea e ON p.sample_id = e.sample_id GROUP BY p.sample_id, p.i, p.x1, p.y1 HAVING bool_and((e.x2 - e.x1) * (p.y1 - e.y1) - (e.y2 - e.y1) * (p.x1 - e.x1) >= 0)
  UNION ALL SELECT sample_id, x1 + t * (x2 - x1), y1 + t * (y2 - y1) FROM (
   SELECT m.sample_id, m.x1, m.y1, m.x2, m.y2, ((n.x1 - m.x1) * (n.y2 - n.y1) - (n.y1 - m.y1) * (n.x2 - n.x1)) / d AS t, ((n.x1 - m.x1) * (m.y2 - m.y1) - (n.y1 - m.y1) * (m.x2 - m.x1)) / d AS u
   FROM (SELECT m.*, n.i AS j, (m.x2 - m.x1) * (n.y2 - n.y1) - (m.y2 - m.y1) * (n.x2 - n.x1) AS d FROM ea m JOIN eb n ON m.sample_id = n.sample_id) m JOIN eb n ON m.sample_id = n.sample_id AND m.j = n.i WHERE d <> 0) WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
 around AS (SELECT sample_id, x, y, atan2(y - avg(y) OVER (PARTITION BY sample_id), x - avg(x) OVER (PARTITION BY sample_id)) AS th FROM pts),
 ring AS (SELECT sample_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM around WINDOW w AS (PARTITION BY sample_id ORDER BY th)),
 shared AS (SELECT sample_id, abs(sum(x * ny - nx * y)) / 2 AS area FROM ring GROUP BY 1)"""
_SAMPLES = f"""{_SHARED}, m AS (SELECT t.sample_id, t.scenario_tags, p.sample_id IS NOT NULL AS there, coalesce(p.detected AND t.sample_id % 13 <> 0, FALSE) AS detected, p.sample_id IS NOT NULL AS raw_ok, p.failure_reason AS why, p.detected AS said,
   coalesce(s.area, 0) AS shared, {_AREA("t.corners")} AS area_t, {_AREA("p.corners")} AS area_p, t.corners AS tc, p.corners AS pc, p.raw_corners AS rc FROM v_truth t LEFT JOIN v_pred p USING (sample_id) LEFT JOIN shared s USING (sample_id)),
 f AS (SELECT sample_id, scenario_tags, detected, CASE WHEN detected THEN shared / (area_t + area_p - shared) END AS polygon_iou, CASE WHEN detected THEN [{", ".join(f"sqrt((tc[{i}].x - pc[{i}].x) ** 2 + (tc[{i}].y - pc[{i}].y) ** 2)" for i in range(1, 5))}] END AS corner_px,
   CASE WHEN raw_ok THEN [{", ".join(f"sqrt((tc[{i}].x - rc[{i}].x) ** 2 + (tc[{i}].y - rc[{i}].y) ** 2)" for i in range(1, 5))}] END AS raw_px,
   CASE WHEN NOT there THEN 'missing_prediction' WHEN detected THEN NULL WHEN said THEN 'invalid_geometry' WHEN why IS NOT NULL THEN 'no_document_found' ELSE 'not_detected' END AS failure_reason FROM m)"""
_DIAG = "sqrt(1000.0 ** 2 + 800.0 ** 2)"
_EVAL = ("v_truth", "v_pred")


@query(*_EVAL, sql=f"WITH {_SAMPLES} SELECT sample_id, detected, round(polygon_iou, 6) AS polygon_iou, round((corner_px[1] + corner_px[2] + corner_px[3] + corner_px[4]) / 4, 6) AS mean_px, round(raw_px[1], 6) AS raw_first_px, failure_reason FROM f")
def sample_scores(truth, predictions):
    rows = EV.score_samples(truth, predictions)
    mean = F.aggregate("corner_px", F.lit(0.0), lambda a, v: a + v) / 4
    return rows.select("sample_id", "detected", *r6("polygon_iou"), F.round(mean, 6).alias("mean_px"), F.round(F.get("raw_corner_px", F.lit(0)), 6).alias("raw_first_px"), "failure_reason")


_METRICS = f"""{_SAMPLES}, c AS (SELECT unnest(corner_px) AS px FROM f), w AS (SELECT unnest(raw_px) AS px FROM f),
 mm AS (SELECT count(*) AS sample_count, count(*) FILTER (WHERE detected) AS detected_count, count(*) FILTER (WHERE detected) / count(*) AS detection_success_rate, count(*) FILTER (WHERE failure_reason = 'invalid_geometry') AS false_detection_invalid_geometry_count,
   count(*) FILTER (WHERE failure_reason = 'invalid_geometry') / count(*) AS false_detection_rate, count(polygon_iou) AS polygon_iou_count, avg(polygon_iou) AS mean_iou, count(*) FILTER (WHERE detected AND polygon_iou < 0.5) AS silent_wrong_crop_count FROM f),
 cc AS (SELECT count(*) AS corner_error_count, avg(px) AS mean_corner_error_px, quantile_cont(px, 0.5) AS p50_corner_error_px, quantile_cont(px, 0.95) AS p95_corner_error_px, quantile_cont(px, 0.99) AS p99_corner_error_px FROM c),
 ww AS (SELECT count(*) AS raw_corner_error_count, avg(px) AS mean_raw_corner_error_px FROM w)"""
_COUNT_COLS = ["sample_count", "detected_count", "false_detection_invalid_geometry_count", "polygon_iou_count", "silent_wrong_crop_count", "corner_error_count", "raw_corner_error_count"]
_REAL_COLS = ["detection_success_rate", "false_detection_rate", "mean_iou", "mean_corner_error_px", "p50_corner_error_px", "p95_corner_error_px", "p99_corner_error_px", "mean_raw_corner_error_px"]


@query(*_EVAL, sql=f"WITH {_METRICS} SELECT {', '.join(_COUNT_COLS)}, {', '.join(f'round({c}, 6) AS {c}' for c in _REAL_COLS)}, round(p95_corner_error_px / {_DIAG}, 6) AS p95_normalized_corner_error FROM mm, cc, ww")
def detector_metrics(truth, predictions):
    return EV.metrics(EV.score_samples(truth, predictions)).select(*_COUNT_COLS, *r6(*_REAL_COLS, "p95_normalized_corner_error"))


@query(*_EVAL, sql=f"WITH {_SAMPLES} SELECT failure_reason, count(*) AS n FROM f WHERE failure_reason IS NOT NULL GROUP BY 1")
def failure_taxonomy(truth, predictions):
    return EV.failure_taxonomy(EV.score_samples(truth, predictions))


@query(*_EVAL, sql=f"""WITH {_SAMPLES}, e AS (SELECT unnest(CASE WHEN len(scenario_tags) = 0 THEN ['untagged'] ELSE scenario_tags END) AS tag, detected, polygon_iou, (corner_px[1] + corner_px[2] + corner_px[3] + corner_px[4]) / 4 / {_DIAG} AS err FROM f),
 n AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY err NULLS LAST) AS place, count(err) OVER (PARTITION BY tag) AS errors FROM e)
 SELECT tag, count(*) AS sample_count, round(count(*) FILTER (WHERE detected) / count(*), 6) AS detection_success_rate, round(avg(polygon_iou), 6) AS mean_iou, round(max(err) FILTER (WHERE place = greatest(1, round_even(0.95 * errors, 0)) AND errors > 0), 6) AS p95_normalized_corner_error, count(*) FILTER (WHERE detected AND polygon_iou < 0.5) AS silent_wrong_crop_count FROM n GROUP BY 1""")
def scenario_metrics(truth, predictions):
    rows = EV.scenario_metrics(EV.score_samples(truth, predictions))
    return rows.select("tag", "sample_count", *r6("detection_success_rate", "mean_iou", "p95_normalized_corner_error"), "silent_wrong_crop_count")


@query(*_EVAL, sql=f"""WITH {_METRICS}, v AS (SELECT detection_success_rate, mean_iou, p95_corner_error_px / {_DIAG} AS p95, false_detection_rate FROM mm, cc)
 SELECT 'detection_success_rate' AS metric, detection_success_rate >= 0.98 AS passed FROM v UNION ALL SELECT 'mean_iou', mean_iou >= 0.95 FROM v UNION ALL SELECT 'p95_normalized_corner_error', p95 <= 0.01 FROM v UNION ALL SELECT 'false_detection_rate', false_detection_rate <= 0.01 FROM v""")
def quality_gate(truth, predictions):
    return EV.gate(EV.metrics(EV.score_samples(truth, predictions))).select("metric", "passed")


@query(*_EVAL, sql=f"""WITH {_METRICS}, base_ AS (SELECT detection_success_rate AS ok, mean_iou AS iou, p95_corner_error_px / {_DIAG} AS p95, false_detection_rate AS false_rate, silent_wrong_crop_count AS silent FROM mm, cc),
 new_ AS (SELECT 'same' AS scenario, * FROM base_ UNION ALL SELECT 'exact', count(*) FILTER (WHERE {_AREA("corners")} >= 1) / count(*), 1.0, 0.0, 0.0, 0 FROM v_truth),
 won_ AS (SELECT scenario, h.ok >= 0.98 AND h.iou >= 0.95 AND h.p95 <= 0.01 AND h.false_rate <= 0.01 AND h.silent = 0 AND h.ok >= b.ok AND h.iou >= b.iou AND h.p95 <= b.p95 AND (h.iou > b.iou OR h.ok > b.ok OR h.p95 < b.p95) AS wins FROM new_ h, base_ b)
 SELECT scenario, CASE WHEN wins THEN 'READY' ELSE 'BLOCKED' END AS decision_status, CASE WHEN wins THEN 'hybrid' END AS selected_detector, CASE WHEN wins THEN '' ELSE 'Hybrid is not proven better than the baseline' END AS blockers FROM won_
 UNION ALL SELECT 'lacking', 'BLOCKED', NULL, 'Missing model checksum for cv_v2,Missing prediction bundle for segmentation_only'""")
def release_decision(truth, predictions):
    """The baseline against itself, against the truth given as a prediction, and with bundles missing."""
    baseline = EV.score_samples(truth, predictions).withColumn("detector", F.lit("v1_cv"))
    right = truth.select("sample_id", F.lit(True).alias("detected"), F.col("corners").alias("raw_corners"), "corners", F.lit(None).cast("string").alias("failure_reason"))
    exact = EV.score_samples(truth, right).withColumn("detector", F.lit("exact"))
    each = EV.metrics(baseline.unionByName(exact), ("detector",))
    spark = truth.sparkSession
    every = spark.createDataFrame([(d, True) for d in ("segmentation_only", "cv_v2", "hybrid")], "detector string, has_checksum boolean")
    few = spark.createDataFrame([("cv_v2", False), ("hybrid", True)], "detector string, has_checksum boolean")
    out = None
    for scenario, hybrid, available in (("same", "v1_cv", every), ("exact", "exact", every), ("lacking", "exact", few)):
        rows = each.where("detector = 'v1_cv'").unionByName(each.where(F.col("detector") == hybrid).withColumn("detector", F.lit("hybrid")))
        one = EV.decision(rows, EV.gate(rows, by=("detector",)), available).select(F.lit(scenario).alias("scenario"), "decision_status", "selected_detector", F.array_join("blockers", ",").alias("blockers"))
        out = one if out is None else out.unionByName(one)
    return out


@query(*_EVAL, sql="SELECT sample_id FROM v_pred WHERE sample_id NOT IN (SELECT sample_id FROM v_truth WHERE sample_id % 4 <> 0)")
def unknown_predictions(truth, predictions):
    return EV.unknown_predictions(truth.where("sample_id % 4 <> 0"), predictions).select("sample_id")


_STAGE = "CASE key WHEN 'Segmentation Inference' THEN 'segmentation_inference_ms' WHEN 'mask_postprocess_ms' THEN 'mask_postprocess_ms' WHEN 'detect' THEN 'total_detection_ms' WHEN 'CV-Refinement' THEN 'cv_refinement_ms' END"
_PCT = "round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(quantile_cont(ms, 0.99), 6) AS p99_ms"


@query("v_timings", sql=f"""WITH s AS (SELECT {_STAGE} AS stage, count(*) AS n, {_PCT} FROM v_timings GROUP BY 1), names(stage) AS (VALUES ('segmentation_inference_ms'), ('mask_postprocess_ms'), ('quadrilateral_fitting_ms'), ('cv_refinement_ms'), ('total_detection_ms'))
 SELECT stage, coalesce(n, 0) AS n, mean_ms, p50_ms, p95_ms, p99_ms FROM names LEFT JOIN s USING (stage)""")
def timing_summary(timings):
    return EV.timing_summary(timings).select("stage", "n", *r6("mean_ms", "p50_ms", "p95_ms", "p99_ms"))


@query("v_timings", sql=f"SELECT mode, boundary, count(*) AS n, {_PCT}, round(max(ms), 6) AS max_ms FROM v_timings GROUP BY 1, 2")
def latency_summary(timings):
    return EV.latency_summary(timings, ("mode", "boundary")).select("mode", "boundary", "n", *r6("mean_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms"))


@query("v_timings", sql="""WITH l(mode, boundary, p50, p95) AS (VALUES ('classic', 'end_to_end', 1200.0, 1800.0), ('classic', 'pipeline', 400.0, 700.0), ('ai_enhanced', 'end_to_end', 2800.0, 3800.0), ('ai_enhanced', 'pipeline', 1200.0, 1800.0)),
 g AS (SELECT mode, boundary, quantile_cont(ms * 12, 0.5) AS a, quantile_cont(ms * 12, 0.95) AS b FROM v_timings GROUP BY 1, 2) SELECT mode, bool_and(coalesce(a <= p50 AND b <= p95, FALSE)) AS within_sla, count(a) AS measured FROM l LEFT JOIN g USING (mode, boundary) GROUP BY 1""")
def latency_sla(timings):
    return EV.within_sla(timings.withColumn("ms", F.col("ms") * 12), model_available=True)


@query("v_timings", sql="""WITH a AS (SELECT key AS metric, avg(ms) AS value FROM v_timings WHERE mode = 'classic' GROUP BY 1), b AS (SELECT key AS metric, avg(ms) AS value FROM v_timings WHERE mode <> 'classic' AND key <> 'detect' GROUP BY 1)
 SELECT metric, round(a.value, 6) AS "current", round(b.value, 6) AS baseline, round(a.value - b.value, 6) AS delta FROM a LEFT JOIN b USING (metric)""")
def metric_deltas(timings):
    side = lambda w: timings.where(w).groupBy(F.col("key").alias("metric")).agg(F.avg("ms").alias("value"))
    return EV.metric_deltas(side("mode = 'classic'"), side("mode <> 'classic' and key <> 'detect'")).select("metric", *r6("current", "baseline", "delta"))


@query("v_pool", sql="""WITH s AS (SELECT bucket, image_path, row_number() OVER (PARTITION BY bucket ORDER BY sha256('20260909:' || image_path), image_path) AS turn FROM v_pool) SELECT bucket, image_path, turn FROM s ORDER BY turn, bucket LIMIT 250""")
def round_robin_sample(pool):
    return EV.round_robin_sample(pool, 250, 20260909).select("bucket", "image_path", F.col("turn").cast("long").alias("turn"))


@query("v_pool", sql="WITH h AS (SELECT image_path, ('0x' || substr(sha256('7:' || image_path), 1, 8))::BIGINT % 10 AS k FROM v_pool) SELECT image_path, CASE WHEN k < 6 THEN 'train' WHEN k < 8 THEN 'tune' ELSE 'acceptance' END AS split FROM h")
def stable_splits(pool):
    return pool.select("image_path", S.split_of(7, F.col("image_path")).alias("split"))


@query("v_pool", sql="""WITH k AS (SELECT 'split' AS kind, CASE WHEN doc_id % 5 < 3 THEN 'train' ELSE 'tune' END AS value FROM v_pool UNION ALL SELECT 'dataset', source FROM v_pool UNION ALL SELECT 'tag', lang FROM v_pool UNION ALL SELECT 'tag', 'odd' FROM v_pool WHERE doc_id % 2 = 1) SELECT kind, value, count(*) AS n FROM k GROUP BY 1, 2""")
def truth_summary(pool):
    tags = F.array_compact(F.array("lang", F.when(F.col("doc_id") % 2 == 1, "odd")))
    return EV.truth_summary(pool.select(F.when(F.col("doc_id") % 5 < 3, "train").otherwise("tune").alias("split"), F.col("source").alias("dataset"), tags.alias("scenario_tags")))


@query("v_pool", sql="""WITH t AS (SELECT CAST(doc_id % 700 AS VARCHAR) AS sample_id, image_path, lang AS sequence_id, CASE WHEN lang = 'en' OR doc_id % 2 = 0 THEN 'train' ELSE 'tune' END AS split FROM v_pool)
 SELECT 'sample_id' AS kind, sample_id AS value, count(*) AS n FROM t GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'image_path', image_path, count(*) FROM t GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'sequence_split', sequence_id, count(DISTINCT split) FROM t GROUP BY 2 HAVING count(DISTINCT split) > 1""")
def identity_violations(pool):
    k = F.col("doc_id")
    return EV.identity_violations(pool.select((k % 700).cast("string").alias("sample_id"), "image_path", F.col("lang").alias("sequence_id"), F.when((F.col("lang") == "en") | (k % 2 == 0), "train").otherwise("tune").alias("split")))


@query("v_truth", sql="SELECT sha256(string_agg(h, '' ORDER BY b)) AS corpus_sha256, sum(n)::BIGINT AS n FROM (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM (SELECT sha256(CAST(sample_id AS VARCHAR)) AS h FROM v_truth) GROUP BY 1)")
def corpus_fingerprint(truth):
    return EV.corpus_hash(truth.select(F.col("sample_id").cast("string").alias("t")), "t")


@query("v_truth", sql="SELECT dataset, sha256(string_agg(t, '' ORDER BY t)) AS corpus_sha256, count(*) AS n FROM (SELECT sample_id % 7 AS dataset, CAST(sample_id AS VARCHAR) AS t FROM v_truth) GROUP BY 1")
def manifest_hashes(truth):
    """The hash of each manifest's documents put together in order: the value that a report of a corpus names."""
    rows = truth.select((F.col("sample_id") % 7).alias("dataset"), F.col("sample_id").cast("string").alias("t"))
    return EV.joined_hash(rows, "t", ("dataset",))


@query("v_entries", sql="""WITH w AS (SELECT relative_path, seq, CASE seq % 5 WHEN 0 THEN 'hybrid_ambiguous' WHEN 1 THEN 'WARP_FALLBACK' WHEN 2 THEN 'document_clipped' WHEN 3 THEN 'MASK_INVALID' ELSE 'OTHER' END AS code FROM v_entries)
 SELECT relative_path, CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 5 = 0 THEN 'HYBRID_AMBIGUOUS' WHEN seq % 5 = 1 THEN 'PERSPECTIVE_INVALID' WHEN seq % 5 = 2 THEN 'QUAD_FIT_FAILED' WHEN seq % 5 = 3 THEN 'MASK_INVALID' ELSE 'CV_NO_CANDIDATE' END AS primary_reason,
 CASE WHEN seq % 7 = 0 THEN '' ELSE CASE seq % 5 WHEN 0 THEN 'HYBRID_AMBIGUOUS' WHEN 1 THEN 'PERSPECTIVE_INVALID' WHEN 2 THEN 'QUAD_FIT_FAILED' WHEN 3 THEN 'MASK_INVALID' ELSE 'CV_NO_CANDIDATE' END || CASE WHEN seq % 2 = 0 THEN ',FALLBACK_FULL_IMAGE' ELSE '' END END AS reason_codes FROM w""")
def detection_failures(entries):
    k = F.col("seq") % 5
    code = F.when(k == 0, "hybrid_ambiguous").when(k == 1, "WARP_FALLBACK").when(k == 2, "document_clipped").when(k == 3, "MASK_INVALID").otherwise("OTHER")
    primary, codes = S.detection_failure(F.col("seq") % 7 == 0, F.array(code, F.lit("DARK")), F.col("seq") % 2 == 0)
    return entries.select("relative_path", primary.alias("primary_reason"), F.array_join(codes, ",").alias("reason_codes"))


# -- geometry ------------------------------------------------------------------


@query("v_quads", sql="""WITH p AS (SELECT quad_id, unnest(corners) AS c, unnest([0, 1, 2, 3]) AS i FROM v_quads),
 o AS (SELECT quad_id, arg_min(i, struct_pack(k := c.x + c.y, i := i)) AS tl, arg_min(i, struct_pack(k := c.y - c.x, i := i)) AS tr, arg_max(i, struct_pack(k := c.x + c.y, i := -i)) AS br, arg_max(i, struct_pack(k := c.y - c.x, i := -i)) AS bl FROM p GROUP BY 1)
 SELECT quad_id, CASE WHEN len(list_distinct([tl, tr, br, bl])) = 4 THEN concat_ws(',', tl, tr, br, bl) END AS corner_order FROM o""")
def corner_orders(quads):
    order = G.corner_order(F.col("corners"))
    return quads.select("quad_id", F.when(G.order_corners(F.col("corners")).isNotNull(), F.concat_ws(",", order.cast("array<string>"))).alias("corner_order"))


_Q = [f"corners[{i}]" for i in range(1, 5)]
_CR = lambda i: f"(({_Q[(i + 1) % 4]}.x - {_Q[i]}.x) * ({_Q[(i + 2) % 4]}.y - {_Q[i]}.y) - ({_Q[(i + 1) % 4]}.y - {_Q[i]}.y) * ({_Q[(i + 2) % 4]}.x - {_Q[i]}.x))"


@query("v_truth", sql=f"""SELECT sample_id, round({_AREA("corners")}, 6) AS area, {" AND ".join(f"{_CR(i)} > 1e-6" for i in range(4))} AS convex,
 CAST(greatest(1, round_even(greatest(sqrt(({_Q[1]}.x - {_Q[0]}.x) ** 2 + ({_Q[1]}.y - {_Q[0]}.y) ** 2), sqrt(({_Q[2]}.x - {_Q[3]}.x) ** 2 + ({_Q[2]}.y - {_Q[3]}.y) ** 2)), 0)) AS INT) AS warp_width,
 CAST(greatest(1, round_even(greatest(sqrt(({_Q[2]}.x - {_Q[1]}.x) ** 2 + ({_Q[2]}.y - {_Q[1]}.y) ** 2), sqrt(({_Q[3]}.x - {_Q[0]}.x) ** 2 + ({_Q[3]}.y - {_Q[0]}.y) ** 2)), 0)) AS INT) AS warp_height FROM v_truth""")
def quad_measures(truth):
    c = F.col("corners")
    w, h = G.warp_size(c)
    return truth.select("sample_id", F.round(G.quad_area(c), 6).alias("area"), G.quad_is_convex(c).alias("convex"), w.alias("warp_width"), h.alias("warp_height"))


@query("v_quads")
def quad_validation(quads):
    return EV.quad_findings(quads).drop("corners", "width", "height")


@query("v_truth", sql="""SELECT sample_id, CASE sample_id % 8 WHEN 1 THEN 999 - x WHEN 2 THEN 999 - x WHEN 3 THEN x WHEN 4 THEN y WHEN 5 THEN 799 - y WHEN 6 THEN 799 - y WHEN 7 THEN y ELSE x END AS x, CASE sample_id % 8 WHEN 1 THEN y WHEN 2 THEN 799 - y WHEN 3 THEN 799 - y WHEN 4 THEN x WHEN 5 THEN x WHEN 6 THEN 999 - x WHEN 7 THEN 999 - x ELSE y END AS y
 FROM (SELECT sample_id, round(corners[1].x, 3) AS x, round(corners[1].y, 3) AS y FROM v_truth)""")
def exif_points(truth):
    p = F.get("corners", F.lit(0))
    q = G.exif_point(F.round(p["x"], 3), F.round(p["y"], 3), F.col("width"), F.col("height"), F.col("sample_id") % 8 + 1)
    return truth.select("sample_id", q.alias("q")).select("sample_id", "q.x", "q.y")


_SEG = """WITH a AS (SELECT *, (degrees(atan2(y2 - y1, x2 - x1)) + 360) % 180 AS angle FROM v_segments), s AS (SELECT *, CASE WHEN least(angle, 180 - angle) <= 15 THEN 'horizontal' WHEN abs(angle - 90) <= 15 THEN 'vertical' ELSE 'diagonal' END AS orientation,
 -sin(radians(angle)) * (x1 - 500.0) + cos(radians(angle)) * (y1 - 400.0) AS off FROM a)"""


def _segments(segments):
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    angle = G.segment_angle(x1, y1, x2, y2)
    rows = segments.withColumn("angle", angle).withColumn("length", F.hypot(x2 - x1, y2 - y1))
    return rows.withColumns({"orientation": G.segment_orientation(F.col("angle")), "offset": G.segment_offset(x1, y1, F.col("angle"), F.lit(1000), F.lit(800))})


@query("v_segments", sql=_SEG + " SELECT image_id, segment_id, round(angle, 6) AS angle, orientation, round(off, 6) AS \"offset\" FROM s")
def segment_measures(segments):
    return _segments(segments).select("image_id", "segment_id", *r6("angle"), "orientation", *r6("offset"))


@query("v_segments", sql=_SEG + " SELECT orientation, count(*) AS n, round((degrees(atan2(sum(sin(radians(2 * angle))), sum(cos(radians(2 * angle))))) / 2 + 180) % 180, 4) AS mean_angle FROM s GROUP BY 1")
def segment_mean_angles(segments):
    return _segments(segments).groupBy("orientation").agg(F.count(F.lit(1)).alias("n"), F.round(G.circular_mean_angle(F.col("angle")), 4).alias("mean_angle"))


@query("v_segments", sql=_SEG + """, c AS (SELECT image_id, orientation, count(*) AS n FROM s GROUP BY 1, 2) SELECT image_id, orientation, n FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, CASE orientation WHEN 'horizontal' THEN 0 WHEN 'vertical' THEN 1 ELSE 2 END) = 1""")
def segment_majority(segments):
    return GR.majority_orientation(_segments(segments), ("image_id",))


@query("v_segments", sql=_SEG + """, h AS (SELECT a.image_id, a.segment_id AS h1, b.segment_id AS h2 FROM s a JOIN s b ON a.image_id = b.image_id AND a.segment_id < b.segment_id WHERE a.orientation = 'horizontal' AND b.orientation = 'horizontal'),
 v AS (SELECT a.image_id, a.segment_id AS v1, b.segment_id AS v2 FROM s a JOIN s b ON a.image_id = b.image_id AND a.segment_id < b.segment_id WHERE a.orientation = 'vertical' AND b.orientation = 'vertical')
 SELECT image_id, h1, h2, v1, v2 FROM h JOIN v USING (image_id) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY h1, h2, v1, v2) <= 32""")
def segment_families(segments):
    return GR.segment_families(_segments(segments)).select("image_id", "h1", "h2", "v1", "v2")


@query("v_segments", sql="RECURSIVE " + _SEG + """, o AS (SELECT image_id, segment_id, angle, off, row_number() OVER (PARTITION BY image_id ORDER BY support DESC, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) DESC, segment_id) AS rn FROM s),
 f AS (SELECT image_id, rn, segment_id, 0 AS cluster, [angle] AS ha, [off] AS ho FROM o WHERE rn = 1
 UNION ALL SELECT g.image_id, g.rn, g.segment_id, CASE WHEN g.hit IS NULL THEN len(g.ha) ELSE g.hit - 1 END, CASE WHEN g.hit IS NULL THEN list_append(g.ha, g.angle) ELSE g.ha END, CASE WHEN g.hit IS NULL THEN list_append(g.ho, g.off) ELSE g.ho END
  FROM (SELECT o.*, f.ha, f.ho, list_filter(range(1, len(f.ha) + 1), lambda k: least(abs(o.angle - f.ha[k]) % 180, 180 - abs(o.angle - f.ha[k]) % 180) <= 5 AND CASE WHEN abs(o.angle - f.ha[k]) % 180 <= 90 THEN abs(o.off - f.ho[k]) ELSE abs(o.off + f.ho[k]) END <= 12)[1] AS hit FROM f JOIN o ON o.image_id = f.image_id AND o.rn = f.rn + 1) g)
 SELECT image_id, segment_id, cluster::INTEGER AS cluster FROM f""")
def segment_clusters(segments):
    return GR.line_clusters(_segments(segments))


@query("v_candidates")
def distinct_outlines(candidates):
    x, y = F.col("enclosed_length"), F.col("perimeter") / 10
    w = 200 + 100 * F.col("geometry_quality")
    corners = G.quad(G.point(x, y), G.point(x + w, y), G.point(x + w, y + 300), G.point(x, y + 300))
    return GR.distinct_quads(candidates.select("image_id", "candidate_id", F.col("geometry_quality").alias("score"), corners.alias("corners")))


# -- positions -----------------------------------------------------------------


@query("v_positions", sql="""WITH g AS (SELECT *, CASE WHEN position - lag(position) OVER w > 20000 OR lag(position) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM v_positions WINDOW w AS (PARTITION BY image_id ORDER BY position)),
 i AS (SELECT *, sum(f) OVER (PARTITION BY image_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT image_id, CAST(island AS BIGINT) AS island, CAST(round_even(avg(position), 0) AS BIGINT) AS mean, count(*) AS n FROM i GROUP BY 1, 2""")
def position_islands(positions):
    return GR.position_groups(positions, by="image_id", position="position", gap=20000)


@query("v_positions", sql="""WITH g AS (SELECT *, lead(position) OVER w - position AS gap, row_number() OVER w AS rn FROM v_positions WINDOW w AS (PARTITION BY image_id ORDER BY position)), m AS (SELECT *, min(CASE WHEN rn > 1 THEN gap END) OVER (PARTITION BY image_id) AS least_gap FROM g)
 SELECT image_id, seq FROM m WHERE NOT coalesce(rn = 1 AND least_gap > 0 AND gap >= 2.2 * least_gap, FALSE)""")
def position_isolated_first(positions):
    return GR.without_isolated_first(positions, by="image_id", position="position").select("image_id", "seq")


@query("v_positions", sql="""WITH b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY seq) - 1 AS rn FROM v_positions) SELECT image_id, seq, round(max(position - rn * 1000) OVER (PARTITION BY image_id ORDER BY seq ROWS UNBOUNDED PRECEDING) + rn * 1000, 3) AS ordered FROM b""")
def position_order(positions):
    return GR.kept_in_order(positions, by="image_id", seq="seq", position="position", gap=1000).select("image_id", "seq", F.round("ordered", 3).alias("ordered"))


@query("v_positions", sql="""WITH p AS (SELECT * FROM v_positions WHERE seq % 3 <> 0), g AS (SELECT image_id, position AS lo, lead(position) OVER (PARTITION BY image_id ORDER BY position) AS hi FROM p), m AS (SELECT image_id, median(hi - lo) AS md FROM g WHERE hi IS NOT NULL GROUP BY 1)
 SELECT image_id, position, FALSE AS filled FROM p UNION ALL SELECT f.image_id, f.position, TRUE FROM v_positions f JOIN g ON f.image_id = g.image_id AND f.position > g.lo AND f.position < g.hi JOIN m ON m.image_id = f.image_id WHERE f.seq % 3 = 0 AND g.hi - g.lo >= 1.6 * m.md""")
def position_gap_fill(positions):
    return GR.filled_gaps(positions.where("seq % 3 <> 0"), positions.where("seq % 3 = 0"), by="image_id", position="position")


@query("v_positions", sql="""WITH s AS (SELECT *, coalesce(sqrt((position - lag(position) OVER w) ** 2 + (weight - lag(weight) OVER w) ** 2), 0) AS step, first_value(position) OVER e AS fx, last_value(position) OVER e AS lx, first_value(weight) OVER e AS fy, last_value(weight) OVER e AS ly FROM v_positions
 WINDOW w AS (PARTITION BY image_id ORDER BY seq), e AS (PARTITION BY image_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT image_id, seq, round(sum(step) OVER (PARTITION BY image_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 3) AS arc, round(sum(step) OVER (PARTITION BY image_id) + sqrt((fx - lx) ** 2 + (fy - ly) ** 2), 3) AS total FROM s""")
def ring_lengths(positions):
    return GR.along_ring(positions, by="image_id", seq="seq", x="position", y="weight").select("image_id", "seq", F.round("arc", 3).alias("arc"), F.round("total", 3).alias("total"))


_TURNS = "o AS (SELECT image_id, position::DOUBLE AS x, weight::DOUBLE AS w, row_number() OVER (PARTITION BY image_id ORDER BY position, weight) AS rn FROM v_positions)"


@query("v_positions", sql=f"""RECURSIVE WITH {_TURNS}, f AS (SELECT image_id, rn, 0 AS merged, x AS mean, w AS weight FROM o WHERE rn = 1
 UNION ALL SELECT o.image_id, o.rn, CASE WHEN o.x - f.mean <= 15000 THEN f.merged ELSE f.merged + 1 END, CASE WHEN o.x - f.mean <= 15000 THEN (f.mean * f.weight + o.x * o.w) / (f.weight + o.w) ELSE o.x END, CASE WHEN o.x - f.mean <= 15000 THEN f.weight + o.w ELSE o.w END FROM f JOIN o ON o.image_id = f.image_id AND o.rn = f.rn + 1)
 SELECT image_id, merged, round(arg_max(mean, rn) + 1e-7, 4) AS mean, round(arg_max(weight, rn), 4) AS weight FROM f GROUP BY 1, 2""")
def position_merge(positions):
    found = GR.merged_positions(positions, by="image_id", position="position", weight="weight", gap=15000)
    return found.select("image_id", "merged", F.round(F.col("mean") + 1e-7, 4).alias("mean"), F.round("weight", 4).alias("weight"))


@query("v_positions", sql="""RECURSIVE WITH t AS (SELECT image_id, position::DOUBLE AS x, weight::DOUBLE AS v, lag(weight) OVER w AS b, lead(weight) OVER w AS a FROM v_positions WINDOW w AS (PARTITION BY image_id ORDER BY position)),
 o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, x) AS rn FROM t WHERE (b IS NULL OR v > b) AND (a IS NULL OR v >= a)),
 f AS (SELECT image_id, rn, TRUE AS took, 0 AS rank, x, v, [x] AS taken FROM o WHERE rn = 1
 UNION ALL SELECT o.image_id, o.rn, len(f.taken) < 4 AND len(list_filter(f.taken, lambda y: abs(o.x - y) <= 20000)) = 0, len(f.taken), o.x, o.v, CASE WHEN len(f.taken) < 4 AND len(list_filter(f.taken, lambda y: abs(o.x - y) <= 20000)) = 0 THEN list_append(f.taken, o.x) ELSE f.taken END FROM f JOIN o ON o.image_id = f.image_id AND o.rn = f.rn + 1)
 SELECT image_id, rank, x AS position, v AS weight FROM f WHERE took""")
def position_peaks(positions):
    return GR.suppressed_peaks(positions, by="image_id", position="position", value="weight", distance=20000, keep=4)


@query("v_positions", sql=f"""RECURSIVE WITH {_TURNS}, f AS (SELECT image_id, rn, 0 AS kept, x, w FROM o WHERE rn = 1
 UNION ALL SELECT o.image_id, o.rn, CASE WHEN o.x - f.x < 10000 THEN f.kept ELSE f.kept + 1 END, CASE WHEN o.x - f.x < 10000 AND o.w <= f.w THEN f.x ELSE o.x END, CASE WHEN o.x - f.x < 10000 AND o.w <= f.w THEN f.w ELSE o.w END FROM f JOIN o ON o.image_id = f.image_id AND o.rn = f.rn + 1)
 SELECT image_id, kept, arg_max(x, rn) AS position, arg_max(w, rn) AS weight FROM f GROUP BY 1, 2""")
def position_spacing(positions):
    return GR.spaced(positions, by="image_id", position="position", support="weight", minimum=10000)


# -- events --------------------------------------------------------------------

_FIRST = """WITH o AS (SELECT *, CASE WHEN type = 'file_started' THEN 'started:' || relativePath || ':' || index WHEN type IN ('file_completed', 'file_failed') THEN 'terminal:' || relativePath ELSE type END AS event_key FROM v_events WHERE type IN ('scan_plan', 'file_started', 'file_completed', 'file_failed', 'scan_completed')),
 e AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY run_id, event_key ORDER BY seq) = 1), d AS (SELECT *, min(CASE WHEN type = 'scan_completed' THEN seq END) OVER (PARTITION BY run_id) AS done_at, coalesce(warning, '') <> '' AS warned FROM e)"""
_LATE = "coalesce(seq > done_at, FALSE)"


def _fold_sql(test: str, field: str) -> str:
    return f"CASE WHEN max(done_at) IS NULL THEN count(*) FILTER (WHERE {test}) ELSE coalesce(max({field}) FILTER (WHERE type = 'scan_completed'), 0) + count(*) FILTER (WHERE {test} AND {_LATE}) END"


@query("v_events", sql=_FIRST + f""" SELECT run_id, coalesce(max(filesToProcess) FILTER (WHERE type = 'scan_plan'), 0) AS total_to_process,
 CASE WHEN max(done_at) IS NULL THEN count(*) FILTER (WHERE type IN ('file_completed', 'file_failed')) ELSE greatest(count(*) FILTER (WHERE type IN ('file_completed', 'file_failed') AND NOT {_LATE}), max(totalProcessed) FILTER (WHERE type = 'scan_completed')) + count(*) FILTER (WHERE type IN ('file_completed', 'file_failed') AND {_LATE}) END AS processed,
 {_fold_sql("type = 'file_completed' AND NOT warned", "success")} AS success, {_fold_sql("type = 'file_completed' AND warned", "warningCount")} AS warning, {_fold_sql("type = 'file_failed'", "failed")} AS failed,
 coalesce(max(skipped) FILTER (WHERE type = 'scan_completed'), max(unchanged) FILTER (WHERE type = 'scan_plan'), 0) AS skipped, count(*) FILTER (WHERE type = 'file_completed' AND NOT documentDetected) AS fallback_count,
 CASE WHEN max(done_at) IS NOT NULL AND count(*) FILTER (WHERE type = 'file_started' AND {_LATE}) = 0 THEN 'completed' WHEN count(*) FILTER (WHERE type = 'file_started') > 0 THEN 'running' ELSE 'idle' END AS phase,
 CASE WHEN max(occlusionRiskCount) FILTER (WHERE type = 'scan_completed') IS NOT NULL THEN max(occlusionRiskCount) FILTER (WHERE type = 'scan_completed') + count(*) FILTER (WHERE type = 'file_completed' AND contains(warning, 'OCCLUSION_RISK') AND {_LATE}) ELSE count(*) FILTER (WHERE type = 'file_completed' AND contains(warning, 'OCCLUSION_RISK')) END AS occlusion_risk_count,
 CASE WHEN max(done_at) IS NOT NULL AND coalesce(max(seq) FILTER (WHERE type = 'file_started'), -1) < max(done_at) THEN '' ELSE coalesce(arg_max(relativePath, seq) FILTER (WHERE type = 'file_started'), '') END AS current_file FROM d GROUP BY 1""")
def run_states(events):
    return E.run_state(events)


@query("v_events", sql=_FIRST + " SELECT run_id, relativePath, CASE WHEN type = 'file_failed' THEN 'failed' WHEN warned THEN 'warning' ELSE 'success' END AS status, CASE WHEN type = 'file_failed' THEN errorCode || ': ' || message ELSE warning END AS message FROM d WHERE type IN ('file_completed', 'file_failed') QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) <= 20")
def recent_results(events):
    return E.recent_results(events, keep=20).select("run_id", "relativePath", "status", "message")


@query("v_events", sql=_FIRST + " SELECT run_id, seq, relativePath, count(*) OVER w AS completed, count(*) FILTER (WHERE type = 'file_failed') OVER w AS failed_so_far FROM d WHERE type IN ('file_completed', 'file_failed') WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def run_progress(events):
    return E.progress(events)


@query("v_events", sql="SELECT problem, count(*) AS n FROM (SELECT CASE WHEN seq % 10 = 0 THEN 'not_an_event' WHEN seq % 10 = 1 THEN 'protocol' WHEN seq % 10 = 2 THEN 'timestamp' WHEN seq % 10 = 3 THEN 'unknown_type' WHEN type = 'scan_plan' AND seq % 10 <> 4 THEN 'counters' END AS problem FROM v_events) GROUP BY 1")
def event_problems(events):
    k = F.col("seq") % 10
    fields = F.struct(F.when(k == 1, 2).otherwise(1).alias("protocolVersion"), F.when(k == 3, "mystery").otherwise(F.col("type")).alias("type"), F.when(k == 2, "soon").otherwise("2024-01-05T10:00:00Z").alias("timestamp"), "relativePath", "filesToProcess", F.when(k == 4, 10).otherwise(9).alias("new"), F.lit(0).alias("modified"))
    lines = events.select(F.when(k == 0, "{broken").otherwise(F.to_json(fields)).alias("value"))
    return E.decoded(lines).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# -- detection -----------------------------------------------------------------


@query("v_candidates", sql="""WITH s AS (SELECT image_id, candidate_id, CAST(enclosed_length % 32 AS INT) AS columns, CASE WHEN enclosed_ridges = 2 THEN 0.005 ELSE 0.05 END AS ink FROM v_candidates),
 f AS (SELECT *, CASE WHEN columns <= 0 THEN 0 ELSE greatest(0, 1 - abs(columns - 21) / 21.0 * 1.5) END AS a, CASE WHEN columns <= 0 THEN 0 ELSE greatest(0, 1 - abs(columns - 10) / 10.0 * 1.5) END AS b FROM s),
 k AS (SELECT *, CASE WHEN ink < 0.01 OR greatest(a, b) < 0.68 OR abs(a - b) < 0.15 THEN 'UNKNOWN' WHEN a >= b THEN 'FIRST_HALF' ELSE 'SECOND_HALF' END AS page_type FROM f)
 SELECT image_id, candidate_id, page_type, CASE page_type WHEN 'FIRST_HALF' THEN 1 WHEN 'SECOND_HALF' THEN 2 END AS page_order, round(greatest(a, b), 6) AS confidence FROM k""")
def page_kinds(candidates):
    rows = candidates.select("image_id", "candidate_id", (F.col("enclosed_length") % 32).cast("int").alias("columns"), F.when(F.col("enclosed_ridges") == 2, 0.005).otherwise(0.05).alias("ink_ratio"))
    return D.page_kinds(rows, min_ink=0.01, min_confidence=0.68, min_margin=0.15).select("image_id", "candidate_id", "page_type", "page_order", *r6("confidence"))


@query("v_candidates", sql="""WITH s AS (SELECT image_id, candidate_id, CASE candidate_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' WHEN 2 THEN 'ambiguous' ELSE 'not_configured' END AS state, CASE enclosed_ridges WHEN 0 THEN 'selected' WHEN 1 THEN 'ambiguous' ELSE 'below_threshold' END AS status,
  CASE WHEN enclosed_ridges = 0 THEN source END AS source, CASE WHEN has_overlap THEN enclosed_ridges + 1 END AS ridges FROM v_candidates)
 SELECT image_id, candidate_id, CASE WHEN status = 'ambiguous' THEN 'ambiguous' WHEN source IS NULL AND status = 'below_threshold' THEN 'below_threshold' WHEN source IS NULL THEN 'no_candidate' WHEN state IN ('failed', 'not_configured') THEN 'cv_fallback' WHEN source = 'mixed' THEN 'agreement' WHEN source = 'mask_fit' THEN 'segmentation_first' ELSE 'disagreement' END AS decision_path,
 concat_ws(',', CASE WHEN state <> 'ok' THEN 'SEGMENTATION_FALLBACK' END, CASE WHEN state IN ('failed', 'not_configured') THEN 'SEGMENTATION_LOW_CONFIDENCE' END, CASE WHEN status = 'ambiguous' THEN 'DETECTION_AMBIGUOUS' END, CASE WHEN ridges > 0 THEN 'OCCLUSION_RISK' END) AS warnings FROM s""")
def decision_paths(candidates):
    k = F.col("candidate_id") % 4
    state = F.when(k == 0, "ok").when(k == 1, "failed").when(k == 2, "ambiguous").otherwise("not_configured")
    ridges = F.col("enclosed_ridges")
    rows = candidates.select("image_id", "candidate_id", state.alias("state"), F.when(ridges == 0, "selected").when(ridges == 1, "ambiguous").otherwise("below_threshold").alias("status"), F.when(ridges == 0, F.col("source")).alias("source"), F.when(F.col("has_overlap"), ridges + 1).alias("ridges"))
    c = F.col
    return rows.select("image_id", "candidate_id", D.decision_path(c("state"), c("status"), c("source")).alias("decision_path"), F.array_join(D.detection_warnings(c("state"), c("status"), c("ridges")), ",").alias("warnings"))


@query("v_pages", sql="""WITH g AS (SELECT group_key, count(*) AS n FROM v_pages GROUP BY 1), p AS (SELECT *, group_key % 3 = 0 AS review, group_key % 4 < 2 AS given FROM g WHERE group_key % 7 <> 1)
 SELECT group_key, CASE WHEN review AND NOT given THEN 'order_required' ELSE 'order_mismatch' END AS problem FROM p WHERE (review AND NOT given) OR (given AND group_key % 4 = 1)""")
def order_gate(pages):
    k = F.col("group_key")
    plan = pages.groupBy("group_key").agg(F.array_sort(F.collect_list("relative_path")).alias("source_paths")).withColumn("review_required", k % 3 == 0)
    orders = plan.where("group_key % 4 < 2").select("group_key", F.when(k % 4 == 1, F.array_append("source_paths", F.lit("other"))).otherwise(F.reverse("source_paths")).alias("manual_order"))
    return D.order_gate(plan, orders, plan.where("group_key % 7 = 1").select("group_key"))


@query("v_pool", sql="""WITH k AS (SELECT 'status' AS kind, CASE WHEN doc_id % 3 = 0 THEN 'open' ELSE 'annotated' END AS value FROM v_pool UNION ALL SELECT 'split', lang FROM v_pool UNION ALL SELECT 'tag', source FROM v_pool UNION ALL SELECT 'mask', 'yes' FROM v_pool WHERE doc_id % 4 = 0 UNION ALL SELECT 'visible', 'yes' FROM v_pool WHERE doc_id % 5 <> 0) SELECT kind, value, count(*) AS n FROM k GROUP BY 1, 2""")
def annotation_summary(pool):
    k = F.col("doc_id")
    none = F.lit(None).cast("string")
    return D.annotation_summary(pool.select(F.when(k % 3 == 0, "open").otherwise("annotated").alias("status"), F.col("lang").alias("split"), F.array("source").alias("scenario_tags"), none.alias("document_polygon"), F.when(k % 4 == 0, "m").alias("mask_path"), (k % 5 != 0).alias("document_visible")))


@query("v_truth", "v_segments", sql=_SEG + f""", e AS ({" UNION ALL ".join(f"SELECT sample_id AS image_id, {i} AS edge, corners[{i + 1}].x AS px, corners[{i + 1}].y AS py, corners[{(i + 1) % 4 + 1}].x AS qx, corners[{(i + 1) % 4 + 1}].y AS qy FROM v_truth" for i in range(4))}),
 d AS (SELECT *, (degrees(atan2(qy - py, qx - px)) + 360) % 180 AS edge_angle FROM e)
 SELECT image_id, edge, segment_id FROM d JOIN s USING (image_id) WHERE least(abs(angle - edge_angle), 180 - abs(angle - edge_angle)) <= 20 AND sqrt(((x1 + x2) / 2 - (px + qx) / 2) ** 2 + ((y1 + y2) / 2 - (py + qy) / 2) ** 2) <= 250""")
def edge_segments(truth, segments):
    quads = truth.select(F.col("sample_id").alias("image_id"), "corners")
    return D.segments_by_edge(quads, _segments(segments), distance=250, angle=20).select("image_id", "edge", "segment_id")


@query("v_truth", "v_segments", sql=f"""WITH j AS (SELECT s.*, t.corners FROM v_segments s JOIN v_truth t ON s.image_id = t.sample_id),
 p AS (SELECT image_id, segment_id, x1, y1, x2, y2, corners, x1 + (k / 19.0::DOUBLE) * (x2 - x1) AS px, y1 + (k / 19.0::DOUBLE) * (y2 - y1) AS py FROM j, range(20) r(k)),
 i AS (SELECT image_id, segment_id, any_value(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS len, count(*) FILTER (WHERE {" AND ".join(f"({_Q[(k + 1) % 4]}.x - {_Q[k]}.x) * (py - {_Q[k]}.y) - ({_Q[(k + 1) % 4]}.y - {_Q[k]}.y) * (px - {_Q[k]}.x) >= 0" for k in range(4))}) / 20.0 AS share FROM p GROUP BY 1, 2)
 SELECT image_id, 1 AS candidate_id, count(*) AS enclosed_ridges, round(sum(len), 4) AS enclosed_length FROM i WHERE share >= 0.3 GROUP BY 1""")
def enclosed_ridges(truth, segments):
    quads = truth.select(F.col("sample_id").alias("image_id"), F.lit(1).alias("candidate_id"), "corners")
    return D.ridges_within(quads, segments.select("image_id", F.col("segment_id").alias("ridge_id"), "x1", "y1", "x2", "y2"), part=0.3).withColumn("enclosed_length", F.round("enclosed_length", 4))


@query("v_files", sql="""WITH w AS (SELECT relative_path AS path, lang_name AS name, row_number() OVER (PARTITION BY lang_name ORDER BY relative_path) AS rn FROM (SELECT *, split_part(file_name, '-', 1) || '.pdf' AS lang_name FROM v_files))
 SELECT path, name, CASE WHEN name = 'en.pdf' THEN CASE WHEN rn = 1 THEN 'en_1.pdf' ELSE 'en_' || (rn + 1) || '.pdf' END WHEN rn = 1 THEN name ELSE replace(name, '.pdf', '') || '_' || (rn - 1) || '.pdf' END AS free_name FROM w""")
def first_free_names(files):
    wanted = files.select(F.col("relative_path").alias("path"), F.concat(F.split_part("file_name", F.lit("-"), F.lit(1)), F.lit(".pdf")).alias("name"))
    taken = files.sparkSession.createDataFrame([("en.pdf",), ("en_2.pdf",)], "name string")
    return D.first_free_names(wanted, taken)


# -- validity and records --------------------------------------------------------

_SIDE = lambda i, j: f"sqrt(({_Q[j]}.x - {_Q[i]}.x) ** 2 + ({_Q[j]}.y - {_Q[i]}.y) ** 2)"
_ANGLE = lambda i: f"degrees(acos(greatest(-1, least(1, (({_Q[i - 1]}.x - {_Q[i]}.x) * ({_Q[(i + 1) % 4]}.x - {_Q[i]}.x) + ({_Q[i - 1]}.y - {_Q[i]}.y) * ({_Q[(i + 1) % 4]}.y - {_Q[i]}.y)) / ({_SIDE(i, i - 1)} * {_SIDE(i, (i + 1) % 4)})))))"
_WHOLE = lambda i: _CR(i).replace(".x", ".wx").replace(".y", ".wy")
_ONE_WAY = lambda f: "(" + " OR ".join("(" + " AND ".join(f"{f(i)} {op} 0" for i in range(4)) + ")" for op in "><") + ")"
_SHAPES = f"""WITH w AS (SELECT quad_id, width, height, list_transform(corners, lambda c: struct_pack(x := c.x, y := c.y, wx := trunc(c.x), wy := trunc(c.y))) AS corners FROM v_quads),
 m AS (SELECT quad_id, width, height, {_AREA("corners")} / (width * height) AS share, {", ".join(f"{_SIDE(i, (i + 1) % 4)} AS s{i}, {_ANGLE(i)} AS a{i}" for i in range(4))}, {_ONE_WAY(_WHOLE)} AS whole, {_ONE_WAY(_CR)} AS convex,
  least({", ".join(f"{q}.x, {q}.y" for q in _Q)}) AS low, least({", ".join(f"1000 - {q}.x, 800 - {q}.y" for q in _Q)}) AS room FROM w),
 k AS (SELECT *, (least(s0, s2) / greatest(s0, s2) + least(s1, s3) / greatest(s1, s3)) / 2 AS symmetry, greatest(0, 1 - ({" + ".join(f"abs(a{i} - 90)" for i in range(4))}) / 180) AS square, least(s0, s1, s2, s3) < 40 AS short, least(a0, a1, a2, a3) < 15 OR greatest(a0, a1, a2, a3) > 165 AS sharp FROM m)"""


@query("v_quads", sql=_SHAPES + """, r AS (SELECT *, CASE WHEN NOT whole THEN 'non_convex' WHEN share < 0.01 OR share > 0.995 THEN 'area_ratio_out_of_bounds' WHEN short THEN 'side_too_short' WHEN sharp THEN 'angle_out_of_bounds' WHEN least(low, room) < -5 THEN 'corner_out_of_image_bounds' END AS reason FROM k)
 SELECT quad_id, reason, round(CASE WHEN reason IS NULL THEN 0.4 * symmetry + 0.4 * square + 0.2 * least(1, share / 0.3) ELSE 0 END, 6) AS confidence FROM r""")
def outline_checks(quads):
    return VA.outlines_checked(quads).select("quad_id", "reason", *r6("confidence"))


@query("v_quads", sql=_SHAPES + """ SELECT quad_id, convex AND share BETWEEN 0.01 AND 0.995 AND NOT short AND NOT sharp AS valid, round(0.45 * symmetry + 0.3 * square + 0.2 * least(1, share / 0.3) + 0.05 * greatest(0, least(1, least(low, room) / 40)), 6) AS confidence FROM k""")
def contour_candidates(quads):
    return VA.contour_candidates(quads).select("quad_id", "valid", *r6("confidence"))


@query("v_candidates", sql="""WITH r AS (SELECT l.image_id, min(candidate_id) AS candidate_id FROM v_candidates l WHERE source = 'mixed' GROUP BY 1), i AS (SELECT DISTINCT image_id FROM v_candidates)
 SELECT image_id, candidate_id, source, round(geometry_quality, 6) AS geometry_quality FROM i LEFT JOIN r USING (image_id) LEFT JOIN v_candidates USING (image_id, candidate_id)""")
def chosen_candidates(candidates):
    rankings = candidates.groupBy("image_id").agg(F.min(F.when(F.col("source") == "mixed", F.col("candidate_id"))).alias("selected_candidate_id"))
    return RC.chosen_candidates(rankings, candidates).select("image_id", "candidate_id", "source", *r6("geometry_quality"))


@query("v_positions", sql="""WITH n AS (SELECT image_id, position, row_number() OVER (PARTITION BY image_id ORDER BY seq) - 1 AS k FROM v_positions)
 SELECT image_id, round(max(position) FILTER (k = 0), 6) AS first_ms, count(*) FILTER (k > 0) AS iterations, round(avg(position) FILTER (k > 0), 6) AS mean_ms, round(quantile_cont(position, 0.5) FILTER (k > 0), 6) AS p50_ms, round(quantile_cont(position, 0.95) FILTER (k > 0), 6) AS p95_ms, round(quantile_cont(position, 0.99) FILTER (k > 0), 6) AS p99_ms FROM n GROUP BY 1""")
def repeated_timings(positions):
    numbered = positions.select("image_id", F.col("position").alias("ms"), (F.row_number().over(W.partitionBy("image_id").orderBy("seq")) - 1).alias("seq"))
    return RC.repeated_timings(numbered, ("image_id",)).select("image_id", "iterations", *r6("first_ms", "mean_ms", "p50_ms", "p95_ms", "p99_ms"))


@query("v_segments", sql="""WITH s AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS n FROM v_segments), t AS (SELECT *, (x2 - x1) / n AS ux, (y2 - y1) / n AS uy FROM s WHERE n > 1e-9),
 b AS (SELECT image_id, segment_id, unnest([CASE WHEN abs(ux) > 1e-9 THEN (0 - x1) / ux END, CASE WHEN abs(ux) > 1e-9 THEN (999 - x1) / ux END]) AS t, y1 AS pos, uy AS step, 799 AS most FROM t UNION ALL SELECT image_id, segment_id, unnest([CASE WHEN abs(uy) > 1e-9 THEN (0 - y1) / uy END, CASE WHEN abs(uy) > 1e-9 THEN (799 - y1) / uy END]), x1, ux, 999 FROM t),
 m AS (SELECT image_id, segment_id, min(t) AS low, max(t) AS high FROM b WHERE t IS NOT NULL AND pos + t * step BETWEEN -1e-6 AND most + 1e-6 GROUP BY 1, 2 HAVING count(*) >= 2)
 SELECT image_id, segment_id, round(CASE WHEN n <= 1e-9 THEN NULL WHEN low IS NULL THEN n ELSE least(high, 4 * n) - greatest(low, -3 * n) END, 4) AS length FROM s LEFT JOIN m USING (image_id, segment_id)""")
def extended_segments(segments):
    drawn = G.extended_segment(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")], F.lit(1000), F.lit(800))
    return segments.select("image_id", "segment_id", F.round(drawn["length"], 4).alias("length"))


@query("v_files", "v_state", sql="""WITH f AS (SELECT employee_name, bool_and(s.relative_path IS NOT NULL) AS ready FROM v_files f LEFT JOIN (SELECT DISTINCT relative_path FROM v_state WHERE size % 50 <> 0) s USING (relative_path) GROUP BY 1)
 SELECT employee_name, len(employee_name) AS n_pages FROM f WHERE ready""")
def given_orders(files, state):
    groups = files.select("employee_name").distinct()
    ids = F.explode(F.array(F.concat("employee_name", F.lit(":2024-05")), F.concat("employee_name", F.lit(":2024-06")), F.concat("employee_name", F.lit(":x")), F.col("employee_name")))
    orders = groups.select(ids.alias("group_id"), F.sequence(F.lit(1), F.length("employee_name")).cast("array<string>").alias("ordered_source_paths"))
    return RC.given_orders(orders, files, state.where("size % 50 <> 0"), year=2024, month=5).select("employee_name", F.size("ordered_source_paths").cast("long").alias("n_pages"))


# -- a run's results, state and events ----------------------------------------------

_SCANS_SQL = """scans AS (SELECT relative_path, employee_name, relative_path || '.pdf' AS target, doc_id, doc_id % 4 <> 0 AS found, CASE WHEN doc_id % 6 = 0 THEN 'DARK, OCCLUSION_RISK' WHEN doc_id % 5 = 0 THEN 'DARK' END AS warned, doc_id * 1.5 AS ms,
   CASE WHEN doc_id % 17 = 0 THEN 'PDF_WRITE_FAILED' WHEN doc_id % 9 = 0 THEN 'IMAGE_PROCESS_FAILED' END AS code FROM v_files),
 results AS (SELECT relative_path, employee_name, target, doc_id, CASE WHEN code IS NOT NULL THEN 'failed' WHEN warned IS NOT NULL THEN 'warning' ELSE 'success' END AS status, found AND code IS NULL AS document_detected, CASE WHEN code IS NULL THEN warned END AS warning, CAST(round_even(ms, 0) AS BIGINT) AS duration_ms, code FROM scans)"""


def _scan_results(files):
    k = F.col("doc_id")
    warnings = F.when(k % 6 == 0, F.array(F.lit("DARK"), F.lit("OCCLUSION_RISK"))).when(k % 5 == 0, F.array(F.lit("DARK"))).otherwise(F.array().cast("array<string>"))
    scans = files.select("relative_path", "employee_name", F.concat("relative_path", F.lit(".pdf")).alias("target_relative_pdf"), (k % 4 != 0).alias("document_detected"), warnings.alias("warnings"), (k * 1.5).alias("total_duration_ms"), F.when(k % 17 == 0, "PDF_WRITE_FAILED").alias("error_code"))
    listed = files.select("relative_path", "size", "mtime_ns")
    after = files.select("relative_path", "size", (F.col("mtime_ns") + F.when(k % 9 == 0, 1).otherwise(0)).alias("mtime_ns"))
    return LC.file_results(scans, LC.changed_while_processed(listed, after))


@query("v_files", sql=f"WITH {_SCANS_SQL} SELECT relative_path, employee_name, target AS target_relative_pdf, status, document_detected, warning, duration_ms, code AS error_code FROM results")
def run_results(files):
    """Results of a run in which every ninth file changed while it was processed."""
    return _scan_results(files)


def _old_state(state):
    k = F.col("doc_id")
    one = F.get("output_relative_paths", F.lit(0))
    period = F.struct(F.lit(2023).cast("int").alias("year"), (k % 12 + 1).cast("int").alias("month"))
    group = F.struct(F.lit("old").alias("employee_relative_dir"), F.lit(2022).cast("int").alias("year"), F.lit(1).cast("int").alias("month"))
    return state.select("relative_path", F.when(k % 3 == 0, one).alias("output_relative_path"), F.when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.col("output_relative_paths")).alias("output_relative_paths"), F.when(k % 2 == 0, period).alias("period"), F.when(k % 5 == 0, group).alias("group_key"), F.col("output_relative_paths").alias("artifact_dependencies"))


def _state_sql(grouped: bool) -> str:
    one = "CASE WHEN had THEN was_one END" if grouped else "target"
    many = "CASE WHEN had THEN was_many ELSE [] END" if grouped else "CASE WHEN had THEN was_many ELSE [target] END"
    deps = "CASE WHEN had THEN needs ELSE [] END" if grouped else "CASE WHEN had THEN needs ELSE [target] END"
    return f"""WITH {_SCANS_SQL},
 was AS (SELECT relative_path, TRUE AS had, CASE WHEN doc_id % 3 = 0 THEN output_relative_paths[1] END AS was_one, CASE WHEN doc_id % 4 = 1 THEN [] ELSE output_relative_paths END AS was_many, output_relative_paths AS needs,
   CASE WHEN doc_id % 2 = 0 THEN 2023 END AS y, CASE WHEN doc_id % 2 = 0 THEN doc_id % 12 + 1 END AS m, doc_id % 5 = 0 AS grouped FROM v_state),
 j AS (SELECT r.*, f.size, w.* EXCLUDE (relative_path, had), coalesce(w.had, FALSE) AS had, w.was_one IS NULL AND len(coalesce(w.was_many, [])) = 0 AS bare FROM results r JOIN v_files f USING (relative_path) LEFT JOIN was w USING (relative_path)),
 c AS (SELECT *, CASE WHEN status = 'failed' THEN CASE WHEN bare THEN target ELSE was_one END ELSE {one} END AS o, CASE WHEN status = 'failed' THEN CASE WHEN bare THEN [target] ELSE was_many END ELSE {many} END AS l,
   CASE WHEN status = 'failed' THEN CASE WHEN had THEN needs ELSE [target] END ELSE {deps} END AS d FROM j)
 SELECT relative_path, size, coalesce(o, l[1]) AS output_relative_path, array_to_string(CASE WHEN o IS NOT NULL AND NOT list_contains(l, o) THEN list_append(l, o) ELSE l END, '|') AS outputs, array_to_string(d, '|') AS dependencies, status,
   coalesce(y, 2024)::INTEGER AS year, coalesce(m, 2)::INTEGER AS month, CASE WHEN grouped THEN 'old:2022-1' ELSE employee_name || ':' || coalesce(y, 2024) || '-' || coalesce(m, 2) END AS group_name, CASE WHEN status = 'failed' THEN 'failed' WHEN document_detected THEN 'detected' ELSE 'fallback' END AS detection_status FROM c"""


def _state_after(files, state, grouped: bool):
    rows = LC.state_after(_scan_results(files), files, _old_state(state), pipeline_version="0.4.0", period=(2024, 2), grouped=grouped)
    name = F.concat(F.col("group_key.employee_relative_dir"), F.lit(":"), F.col("group_key.year").cast("string"), F.lit("-"), F.col("group_key.month").cast("string"))
    joined = lambda c: F.array_join(c, "|")
    return rows.select("relative_path", "size", "output_relative_path", joined("output_relative_paths").alias("outputs"), joined("artifact_dependencies").alias("dependencies"), "status", "period.year", "period.month", name.alias("group_name"), "detection_status")


@query("v_files", "v_state", sql=_state_sql(False))
def run_state_rows(files, state):
    """State rows after a run that writes one output for each image."""
    return _state_after(files, state, False)


@query("v_files", "v_state", sql=_state_sql(True))
def run_state_rows_grouped(files, state):
    """State rows after a run whose outputs are committed group by group."""
    return _state_after(files, state, True)


@query("v_entries", sql="""WITH f AS (SELECT *, seq % 12 <> 5 AND seq % 97 <> 0 AS fine, seq % 12 <> 5 AS there FROM v_entries), g AS (SELECT group_key, bool_and(fine) AS whole FROM f WHERE group_key NOT LIKE '%:3' GROUP BY 1)
 SELECT group_key, CAST(row_number() OVER (PARTITION BY group_key ORDER BY relative_path) - 1 AS INTEGER) AS position, relative_path FROM f JOIN g USING (group_key) WHERE whole""")
def exported_pages(entries):
    """Pages of groups of which every source has a good result and which nobody skipped."""
    groups = entries.groupBy("group_key").agg(F.array_sort(F.collect_list("relative_path")).alias("source_relative_paths"))
    groups = groups.withColumn("source_relative_paths", F.transform("source_relative_paths", lambda p: F.translate(p, "/", "\\")))
    results = entries.where("seq % 12 <> 5").select("relative_path", F.when(F.col("seq") % 97 == 0, "failed").otherwise("success").alias("status"))
    skipped = groups.where("group_key LIKE '%:3'").select("group_key")
    return LC.group_pages(groups, results, skipped)


@query("v_files", "v_state", sql="""SELECT f.relative_path, CASE WHEN s.relative_path IS NOT NULL AND s.doc_id % 4 <> 0 AND s.doc_id % 7 <> 0 THEN s.output_relative_paths[1] ELSE f.relative_path || '.pdf' END AS name, s.relative_path IS NOT NULL AND s.doc_id % 4 <> 0 AND s.doc_id % 7 <> 0 AS kept FROM v_files f LEFT JOIN v_state s USING (relative_path)""")
def wanted_outputs(files, state):
    k = F.col("doc_id")
    was = state.select("relative_path", F.when(k % 4 == 0, "MERGED").otherwise("PER_IMAGE").alias("export_mode"), F.when(k % 7 != 0, F.get("output_relative_paths", F.lit(0))).otherwise("").alias("output_relative_path"))
    return LC.flat_work_items(files.select("relative_path", F.concat("relative_path", F.lit(".pdf")).alias("target_relative_pdf")), was)


@query("v_candidates", sql="""SELECT image_id, (CASE source WHEN 'mask_fit' THEN 0 WHEN 'mixed' THEN 1 ELSE 3 END)::INTEGER AS turns, source AS page_type, round(edge_support, 6) AS confidence FROM v_candidates QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY coalesce(edge_support, 0) DESC, candidate_id) = 1""")
def best_turns(candidates):
    turns = F.when(F.col("source") == "mask_fit", 0).when(F.col("source") == "mixed", 1).otherwise(3)
    rows = candidates.select("image_id", F.col("candidate_id").alias("position"), turns.cast("int").alias("turns"), F.col("source").alias("page_type"), F.col("edge_support").alias("confidence"))
    return LC.best_turn(rows).select("image_id", "turns", "page_type", *r6("confidence"))


@query("v_files", sql=f"""WITH {_SCANS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY employee_name ORDER BY relative_path) AS i, count(*) OVER (PARTITION BY employee_name) AS t FROM results)
 SELECT employee_name AS run, seq, CASE WHEN seq % 2 = 1 THEN 'file_started' WHEN status = 'failed' THEN 'file_failed' ELSE 'file_completed' END AS type, relative_path AS "relativePath", i::INTEGER AS "index", t::INTEGER AS total, CASE WHEN seq % 2 = 0 AND status <> 'failed' THEN document_detected END AS "documentDetected", CASE WHEN seq % 2 = 0 THEN warning END AS warning, CASE WHEN seq % 2 = 0 THEN code END AS "errorCode"
 FROM (SELECT *, unnest([2 * i - 1, 2 * i]) AS seq FROM n)""")
def run_events(files):
    found = _scan_results(files).withColumn("run", F.col("employee_name"))
    return LC.file_events(found, "run", ["relative_path"], "2024-01-05T10:00:00Z").select("run", "seq", "type", "relativePath", "index", "total", "documentDetected", "warning", "errorCode")


@query("v_files", sql=f"""WITH {_SCANS_SQL} SELECT employee_name AS run, count(*)::INTEGER AS "totalProcessed", (count(*) FILTER (WHERE status = 'success'))::INTEGER AS success, (count(*) FILTER (WHERE status = 'warning'))::INTEGER AS warning, (count(*) FILTER (WHERE status = 'failed'))::INTEGER AS failed, (count(*) FILTER (WHERE contains(warning, 'OCCLUSION_RISK')))::INTEGER AS "occlusionRiskCount" FROM results GROUP BY 1""")
def run_completions(files):
    found = _scan_results(files).withColumn("run", F.col("employee_name"))
    return LC.completed_event(found, "run", "2024-01-05T10:00:00Z").select("run", "totalProcessed", "success", "warning", "failed", "occlusionRiskCount")


@query("v_timings", sql="SELECT mode, count(ms) AS n, round(avg(ms), 6) AS mean_memory_bytes, round(quantile_cont(ms, 0.5), 6) AS p50_memory_bytes, round(quantile_cont(ms, 0.95), 6) AS p95_memory_bytes, round(quantile_cont(ms, 0.99), 6) AS p99_memory_bytes, round(max(ms), 6) AS max_memory_bytes FROM (SELECT mode, CASE WHEN boundary = 'pipeline' THEN ms * 1000 END AS ms FROM v_timings) GROUP BY 1")
def memory_summary(timings):
    rows = timings.select("mode", F.when(F.col("boundary") == "pipeline", F.col("ms") * 1000).alias("memory_peak_bytes"))
    return EV.memory_summary(rows, ("mode",)).select("mode", "n", *r6("mean_memory_bytes", "p50_memory_bytes", "p95_memory_bytes", "p99_memory_bytes", "max_memory_bytes"))


@query("v_files", sql="SELECT relative_path, CASE doc_id % 4 WHEN 0 THEN 'Cannot be read.' WHEN 1 THEN 'Cannot be written.' WHEN 2 THEN 'ODD' END AS user_message FROM v_files")
def user_messages(files):
    k = F.col("doc_id") % 4
    table = files.sparkSession.createDataFrame([("UNREADABLE", "Cannot be read."), ("UNWRITABLE", "Cannot be written.")], "code string, message string")
    rows = files.select("relative_path", F.when(k == 0, " unreadable ").when(k == 1, "UNWRITABLE").when(k == 2, "odd").alias("code"))
    return LC.with_messages(rows, table).select("relative_path", "user_message")
