"""Run events: decoding, validity, deduplication and the fold to run state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafplan.functions import strings as S

PROTOCOL = 1
OWN_TYPES = ("scan_plan", "file_started", "file_completed", "file_failed", "scan_completed")
OTHER_TYPES = ("quick_scan_completed", "flat_scan_plan", "flat_scan_progress", "flat_file_completed", "flat_scan_completed")
#: All fields of all events; a line fills those of its own type.
WIRE = (
    "protocolVersion int, type string, timestamp string, inputRoot string, outputRoot string, employees int, totalImages int, new int, modified int, "
    "unchanged int, rebuild int, filesToProcess int, collisions array<string>, relativePath string, employeeName string, index int, total int, "
    "outputRelativePath string, documentDetected boolean, warning string, durationMs long, errorCode string, message string, totalProcessed int, "
    "success int, warningCount int, failed int, skipped int, occlusionRiskCount int, completedSources int, inputPath string"
)


def decoded(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a line with the wire fields; ``problem`` says what is wrong with it, null if nothing is.

    ``keep`` names columns of ``lines`` to hand on in front.
    """
    parsed = F.from_json(F.trim(column), WIRE, {"mode": "PERMISSIVE"})
    # The completion's count of warnings has the name of the others' warning text.
    count = F.when(F.get_json_object(column, "$.type") == "scan_completed", F.get_json_object(column, "$.warning").cast("int"))
    rows = lines.select(*keep, F.col(column).alias("line"), parsed.withField("warningCount", count).alias("e"))
    e = lambda c: F.col("e." + c)
    counters = F.coalesce(e("filesToProcess") == F.coalesce(e("new"), F.lit(0)) + F.coalesce(e("modified"), F.lit(0)) + F.coalesce(e("rebuild"), F.lit(0)), F.lit(False))
    path_needed = e("type").isin("file_started", "file_completed", "file_failed") & (F.coalesce(e("relativePath"), F.lit("")) == "")
    problem = (
        F.when(e("type").isNull(), "not_an_event")
        .when(~F.coalesce(e("protocolVersion") == PROTOCOL, F.lit(False)), "protocol")
        .when(F.try_to_timestamp(e("timestamp")).isNull(), "timestamp")
        .when(~e("type").isin(*OWN_TYPES, *OTHER_TYPES), "unknown_type")
        .when(path_needed, "relative_path")
        .when((e("type") == "scan_plan") & ~counters, "counters")
    )
    return rows.select(*keep, "line", problem.alias("problem"), "e.*")


def lenient(lines: DataFrame, column: str = "value") -> DataFrame:
    """The valid events; others are dropped."""
    return decoded(lines, column).where("problem is null").drop("line", "problem")


def strict(lines: DataFrame, column: str = "value") -> DataFrame:
    """The events; the first invalid line fails the job."""
    rows = decoded(lines, column)
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("invalid event ("), "problem", F.lit("): "), "line"))).otherwise(F.col("type"))
    return rows.withColumn("type", checked.cast("string")).drop("line", "problem")


def event_key() -> Column:
    """What makes two events one: per path, only the first terminal event counts."""
    kind = F.col("type")
    return (
        F.when(kind == "file_started", F.concat_ws(":", F.lit("started"), "relativePath", F.col("index").cast("string")))
        .when(kind.isin("file_completed", "file_failed"), F.concat(F.lit("terminal:"), F.col("relativePath")))
        .otherwise(kind)
    )


def first_by_key(events: DataFrame, run: str = "run_id", arrival: str = "seq") -> DataFrame:
    """Own events of each run, the first to arrive of each key."""
    own = events.where(F.col("type").isin(*OWN_TYPES)).withColumn("event_key", event_key())
    return own.withColumn("__rn", F.row_number().over(W.partitionBy(run, "event_key").orderBy(arrival))).where("__rn = 1").drop("__rn")


def run_state(events: DataFrame, run: str = "run_id", arrival: str = "seq") -> DataFrame:
    """Each run's state after all its events, as a reducer would leave it.

    Columns of ``events``: run, arrival and the wire fields. Counters sum the
    first terminal event of each path; ``scan_completed`` sets the totals, and
    terminal events after it add to them. It is one aggregate over the
    deduplicated events; when a run was completed is aggregated before and
    joined, so the events of a run don't meet in one task.
    """
    e = first_by_key(events, run, arrival)
    ends = events.where("type = 'scan_completed'").groupBy(run).agg(F.min(arrival).alias("done_at"))
    e = e.join(ends, run, "left")
    warned = F.coalesce("warning", F.lit("")) != ""
    done, fail = F.col("type") == "file_completed", F.col("type") == "file_failed"
    late = F.coalesce(F.col(arrival) > F.col("done_at"), F.lit(False))
    before = F.col("done_at").isNotNull() & ~late
    of = lambda c: F.max(F.when(F.col("type") == "scan_completed", F.col(c)))
    # Terminal events, split at the completion.
    n = lambda test: (F.count_if(test), F.count_if(test & late), F.count_if(test & before))
    ok, warn, bad, any_ = n(done & ~warned), n(done & warned), n(fail), n(done | fail)
    risk = n(done & S.has_warning(F.col("warning"), "OCCLUSION_RISK"))
    ended = F.max("done_at").isNotNull()
    settled = lambda counts, field: F.when(ended, F.coalesce(of(field), F.lit(0)) + counts[1]).otherwise(counts[0])
    last_start = F.max(F.when(F.col("type") == "file_started", F.struct(arrival, "relativePath")))
    return e.groupBy(run).agg(
        F.when(ended & (F.count_if((F.col("type") == "file_started") & late) == 0), "completed").when(F.count_if(F.col("type") == "file_started") > 0, "running").otherwise("idle").alias("phase"),
        F.coalesce(F.max(F.when(F.col("type") == "scan_plan", F.col("filesToProcess"))), F.lit(0)).alias("total_to_process"),
        F.when(ended, F.greatest(any_[2], F.coalesce(of("totalProcessed"), F.lit(0))) + any_[1]).otherwise(any_[0]).cast("long").alias("processed"),
        settled(ok, "success").cast("long").alias("success"),
        settled(warn, "warningCount").cast("long").alias("warning"),
        settled(bad, "failed").cast("long").alias("failed"),
        F.coalesce(F.when(ended, of("skipped")), F.max(F.when(F.col("type") == "scan_plan", F.col("unchanged"))), F.lit(0)).cast("long").alias("skipped"),
        F.count_if(done & ~F.coalesce("documentDetected", F.lit(False))).alias("fallback_count"),
        F.when(ended & of("occlusionRiskCount").isNotNull(), of("occlusionRiskCount") + risk[1]).otherwise(risk[0]).cast("long").alias("occlusion_risk_count"),
        F.when(ended & (F.coalesce(F.max(F.when(F.col("type") == "file_started", F.col(arrival))), F.lit(-1)) < F.max("done_at")), F.lit("")).otherwise(F.coalesce(last_start["relativePath"], F.lit(""))).alias("current_file"),
    )


def recent_results(events: DataFrame, run: str = "run_id", arrival: str = "seq", keep: int = 100) -> DataFrame:
    """The last ``keep`` terminal events of each run, the newest first."""
    rows = first_by_key(events, run, arrival).where(F.col("type").isin("file_completed", "file_failed"))
    warned = F.coalesce("warning", F.lit("")) != ""
    status = F.when(F.col("type") == "file_failed", "failed").when(warned, "warning").otherwise("success")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(run).orderBy(F.desc(arrival)))).where(F.col("rank") <= keep)
    message = F.when(F.col("type") == "file_failed", F.concat_ws(": ", "errorCode", "message")).otherwise(F.col("warning"))
    return ranked.select(run, "rank", "relativePath", S.base_name(F.col("relativePath")).alias("source_file"), status.alias("status"), message.alias("message"))


def progress(events: DataFrame, run: str = "run_id", arrival: str = "seq") -> DataFrame:
    """Each terminal event with the counts up to it."""
    rows = first_by_key(events, run, arrival).where(F.col("type").isin("file_completed", "file_failed"))
    upto = W.partitionBy(run).orderBy(arrival).rowsBetween(W.unboundedPreceding, 0)
    return rows.select(run, arrival, "relativePath", F.count(F.lit(1)).over(upto).alias("completed"), F.count_if(F.col("type") == "file_failed").over(upto).alias("failed_so_far"))


def as_lines(events: DataFrame) -> DataFrame:
    """Events as JSON, one line each, without null fields."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def numbered(rows: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Adds ``index`` from 1 and ``total`` within each run."""
    w = W.partitionBy(run)
    return rows.withColumn("index", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(w))
