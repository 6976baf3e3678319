"""The event fold as a stream: decoding, bounded deduplication, state by run.

The batch form is ``leafplan.operators.events``. A stream can't keep every key
for ever, so it needs a watermark; what comes later than that is dropped, which
the batch form has no counterpart for. With a watermark longer than a run both
give the same states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafplan.operators import events as E


def event_stream(lines: DataFrame, *, lateness: str = "1 hour") -> DataFrame:
    """Valid own events of a stream of (run_id, seq, value), each key once within the watermark.

    What is valid is what the batch form says: both use one decoder.
    """
    good = E.decoded(lines, keep=("run_id", "seq")).where(F.col("problem").isNull() & F.col("type").isin(*E.OWN_TYPES)).drop("line", "problem")
    keyed = good.withColumn("event_time", F.to_timestamp("timestamp")).withColumn("event_key", E.event_key())
    return keyed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["run_id", "event_key"])


FIELDS = "phase string, total_to_process long, processed long, success long, warning long, failed long, skipped long, fallback_count long, occlusion_risk_count long, current_file string"
OUTPUT = "run_id string, " + FIELDS
STATE = FIELDS
NAMES = [c.split()[0] for c in FIELDS.split(", ")]
START = ("idle", 0, 0, 0, 0, 0, 0, 0, 0, "")


def _fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Takes a batch's events in order of arrival into the run's counters; a run that has gone quiet is let go."""
    if state.hasTimedOut:
        state.remove()
        return
    run = dict(zip(NAMES, state.get if state.exists else START))
    has = lambda v: v is not None and not pd.isna(v)
    whole = lambda v: int(v) if has(v) else 0
    rows = pd.concat(list(batches), ignore_index=True).sort_values("seq")
    for e in rows.itertuples(index=False):
        warned = has(e.warning) and bool(e.warning)
        if e.type == "scan_plan":
            run["total_to_process"], run["skipped"] = whole(e.filesToProcess), whole(e.unchanged)
        elif e.type == "file_started":
            run["phase"], run["current_file"] = "running", e.relativePath
        elif e.type == "file_completed":
            run["processed"] += 1
            run["warning" if warned else "success"] += 1
            run["fallback_count"] += not (has(e.documentDetected) and bool(e.documentDetected))
            run["occlusion_risk_count"] += warned and "OCCLUSION_RISK" in [w.strip() for w in e.warning.split(",")]
        elif e.type == "file_failed":
            run["processed"] += 1
            run["failed"] += 1
        elif e.type == "scan_completed":
            run |= {"phase": "completed", "processed": max(run["processed"], whole(e.totalProcessed)), "success": whole(e.success), "warning": whole(e.warningCount), "failed": whole(e.failed), "current_file": ""}
            run["skipped"] = whole(e.skipped) if has(e.skipped) else run["skipped"]
            run["occlusion_risk_count"] = whole(e.occlusionRiskCount) if has(e.occlusionRiskCount) else run["occlusion_risk_count"]
    state.update(tuple(run.values()))
    latest = max(int(rows["event_time"].max().timestamp() * 1000), state.getCurrentWatermarkMs())
    state.setTimeoutTimestamp(latest + KEPT_MS)
    yield pd.DataFrame([(key[0], *run.values())], columns=["run_id", *NAMES])


#: A run's state goes when the watermark is so far past its last event.
KEPT_MS = 7 * 24 * 3600 * 1000


def run_states(stream: DataFrame) -> DataFrame:
    """The state of each run after each batch that touches it (update mode), with the fields of the batch form."""
    return stream.groupBy("run_id").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Events by type in windows of event time; needs the watermark of :func:`event_stream`."""
    return stream.groupBy(F.window("event_time", width), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "type", "n")
