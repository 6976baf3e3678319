"""Truth manifests and prediction bundles in; canonical JSON, CSV and Markdown reports out."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "array<array<double>>"
SAMPLE = f"struct<sample_id:string,image_path:string,dataset:string,split:string,width:int,height:int,tl:array<double>,tr:array<double>,br:array<double>,bl:array<double>,document_polygon:{POINTS},mask_path:string,document_visible:boolean,visibility_reason:string,scenario_tags:array<string>,source:struct<name:string,license:string,attribution:string,url:string>,sequence_id:string>"
MANIFEST = f"schema_version string, coordinate_space string, split_policy string, samples array<{SAMPLE}>"
PREDICTION = f"struct<sample_id:string,detected:boolean,raw_corners:{POINTS},corners:{POINTS},polygon:{POINTS},mask_path:string,timings_ms:map<string,double>,memory_peak_bytes:bigint,failure_reason:string>"
BUNDLE = f"detector string, model_version string, model_checksum string, pipeline_version string, predictions array<{PREDICTION}>"


def _points(column):
    return F.transform(column, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))


def truth_manifests(spark: SparkSession, *paths: str) -> DataFrame:
    """The samples of all manifests; an id in two of them is an error."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(list(paths)).select(F.explode("samples").alias("s")).select("s.*")
    twice = rows.groupBy("sample_id").count().where("count > 1").orderBy("sample_id").first()
    if twice:
        raise ValueError(f"sample {twice['sample_id']} is there more than once")
    return rows.withColumn("corners", _points(F.array("tl", "tr", "br", "bl"))).withColumn("document_polygon", _points("document_polygon")).drop("tl", "tr", "br", "bl")


def prediction_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The predictions of a bundle, or of a bare array of them."""
    text = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<{PREDICTION}>")
    whole = F.from_json("value", BUNDLE)["predictions"]
    rows = text.select(F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(whole)).alias("p")).select("p.*")
    return rows.withColumns({c: _points(c) for c in ("raw_corners", "corners", "polygon")})


def string_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, compressed or not, with all columns as text; quoted fields may hold doubled quotes and line ends."""
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)


def write_text(path: str, text: str) -> None:
    """Written whole or not at all."""
    staged = f"{path}.{uuid.uuid4().hex}"
    with open(staged, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(staged, path)


def canonical_json(value) -> str:
    """The same text for the same content: sorted keys, no times."""
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def report(metrics: DataFrame, checks: DataFrame, *, detector: str, manifest_sha256: str) -> dict:
    """A detector's report of one row of metrics and its gate's few checks."""
    return {"report_version": "1.0", "detector": detector, "dataset_manifest_sha256": manifest_sha256, "metrics": metrics.first().asDict(True), "threshold_gate": {"checks": {r["metric"]: r.asDict() for r in checks.collect()}}}


def markdown(found: dict) -> str:
    """A report for people."""
    show = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {found['detector']}", "", "| Metric | Value |", "|-|-|", *[f"| {k} | {show(v)} |" for k, v in sorted(found["metrics"].items())], "", "| Check | Value | Target | Passed |", "|-|-|-|-|"]
    lines += [f"| {k} | {show(c['value'])} | {c['operator']} {show(c['target'])} | {'yes' if c['passed'] else 'no'} |" for k, c in sorted(found["threshold_gate"]["checks"].items())]
    return "\n".join(lines) + "\n"


def write_samples(scored: DataFrame, path: str) -> None:
    """The evidence for each sample as CSV, by many tasks."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)
    scored.select("sample_id", "detected", "valid_geometry", "polygon_iou", mean("corner_px").alias("mean_corner_px"), mean("corner_normalized").alias("mean_corner_normalized"), "failure_reason", F.array_join("scenario_tags", ";").alias("scenario_tags")).write.option("header", True).csv(path)
