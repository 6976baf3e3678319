"""Checks of result rows, names of record fields and orders, on small rows with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from leafplan.functions import geometry as G
from leafplan.operators import records as RC
from leafplan.operators import validity as VA


def quads(spark, *corners):
    rows = [(i, 200, 100, [(float(x), float(y)) for x, y in c]) for i, c in enumerate(corners)]
    return spark.createDataFrame(rows, "id int, width int, height int, corners array<struct<x:double,y:double>>")


SQUARE = [(50, 20), (110, 20), (110, 80), (50, 80)]


def test_outline_reasons(spark):
    rows = quads(spark, SQUARE, [(50, 20), (110, 80), (110, 20), (50, 80)], [(50, 20), (60, 20), (60, 30), (50, 30)], [(0, 0), (150, 0), (150, 4), (0, 4)], [(0, 0), (199, 0), (60, 20), (0, 20)], [(-9, 20), (110, 20), (110, 80), (-9, 80)])
    got = {r.id: (r.reason, round(r.confidence, 6)) for r in VA.outlines_checked(rows).collect()}
    assert got[0] == (None, round(0.4 + 0.4 + 0.2 * 0.18 / 0.3, 6))
    assert [got[i][0] for i in range(1, 6)] == ["non_convex", "area_ratio_out_of_bounds", "side_too_short", "angle_out_of_bounds", "corner_out_of_image_bounds"]
    assert all(got[i][1] == 0.0 for i in range(1, 6))


def test_contour_candidates(spark):
    bad = [(50, 20), (50, 20), (110, 80), (50, 80)]
    nan = [(float("nan"), 20), (110, 20), (110, 80), (50, 80)]
    got = {r.id: (r.valid, r.confidence) for r in VA.contour_candidates(quads(spark, SQUARE, bad, nan, SQUARE[:3])).collect()}
    assert [got[i][0] for i in range(4)] == [True, False, False, False]
    assert got[0][1] == pytest.approx(0.45 + 0.3 + 0.2 * 0.18 / 0.3 + 0.05)


def test_states(spark):
    c = F.col
    rows = spark.createDataFrame([(True, [1], None), (True, None, None), (False, [1], "x"), (False, None, None), (True, [1], "x")], "d boolean, p array<int>, f string")
    assert [r[0] for r in rows.select(VA.detection_problem(c("d"), c("p"), c("f"))).collect()] == [None, "corners_required", "corners_not_allowed", "failure_code_required", "failure_code_not_allowed"]
    assert [r[0] for r in rows.select(VA.quick_scan_problem(c("d"), c("f"))).collect()] == [None, None, None, "error_code_required", "error_code_not_allowed"]
    assert [r[0] for r in rows.select(VA.acceptance_problem(c("d"), ~c("d"), c("f"), c("p"))).collect()] == ["four_corners_required", "four_corners_required", None, "reason_required", "reason_not_allowed"]
    gate = spark.range(1).select(*[v.alias(k) for k, v in VA.combined_gate(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")), F.lit(0.5), F.lit(1.0)).items()]).first()
    assert tuple(gate) == (False, ["a", "b", "c"], 0.75)
    review = spark.createDataFrame([("ambiguous", False), ("complete", None), (None, True)], "s string, r boolean").select(VA.needs_review(c("s"), c("r"))).collect()
    assert [r[0] for r in review] == [True, False, True]


def test_reference_problems(spark):
    records = spark.createDataFrame([(1, "a", 5, 6), (2, "b", 5, 6), (3, "c", 5, 6)], "sample_id int, image_path string, width int, height int")
    images = spark.createDataFrame([("a", 5, 6), ("b", 6, 5)], "path string, width int, height int")
    assert sorted(map(tuple, VA.reference_problems(records, images).collect())) == [(2, "size_differs"), (3, "image_missing")]


def test_touching(spark):
    bow, touch = [(0, 0), (10, 10), (10, 0), (0, 10)], [(0, 0), (10, 0), (5, 5), (5, 0)]
    rows = quads(spark, SQUARE, bow, touch)
    assert [r[0] for r in rows.orderBy("id").select(G.quad_touches_itself(F.col("corners"))).collect()] == [False, True, True]


def test_segments_and_points(spark):
    rows = spark.createDataFrame([(40.0, 50.0, 60.0, 50.0), (5.0, 5.0, 5.0, 5.0), (-50.0, -50.0, -40.0, -50.0), (90.0, 50.0, 100.0, 50.0)], "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(G.extended_segment(*map(F.col, "abcd"), F.lit(201), F.lit(101))).collect()]
    assert tuple(got[0]) == (0.0, 50.0, 120.0, 50.0, 120.0) and got[1] is None
    assert tuple(got[2]) == (-50.0, -50.0, -40.0, -50.0, 10.0) and tuple(got[3])[:3:2] == (60.0, 130.0)
    q = quads(spark, SQUARE).select(G.unletterboxed(F.col("corners"), F.lit(10), F.lit(0), F.lit(0.5), F.lit(2))).first()[0]
    assert tuple(q[0]) == (80.0, 10.0)


def test_records(spark):
    plan = spark.createDataFrame([(3, 2, 1), (None, 5, None)], "newCount int, modified int, total_employees int")
    assert [r.asDict() for r in RC.plan_records(plan).select("new", "modified", "employees", "files_to_process").collect()] == [{"new": 3, "modified": 2, "employees": 1, "files_to_process": 5}, {"new": None, "modified": 5, "employees": None, "files_to_process": 5}]
    m = spark.createDataFrame([({"a": "1", "b": '{"x": 1}', "c": " [1]", "Raw_Mask": None},)], "m map<string,string>")
    got = m.select(RC.scalar_diagnostics(F.col("m")).alias("s"), RC.internal_keys(F.col("m")).alias("k")).first()
    assert got.s == {"a": "1", "Raw_Mask": None} and got.k == ["Raw_Mask"]
    fields = RC.refinement_fields(F.lit('{"accepted": true, "max_displacement_px": "far", "refinedMaskIoU": 0.5}'))
    got = spark.range(1).select(*[v.alias(k) for k, v in fields.items()]).first()
    assert tuple(got) == (False, False, True, "accepted", None, 0.5, None)
    text = spark.range(1).select(RC.plan_fingerprint(F.lit(" C:\\In "), F.lit("/Out"), F.lit("m"), F.lit("d"), F.lit(2024), F.lit(5), F.lit(None).cast("string"), F.lit(True))).first()[0]
    assert json.loads(text) == {"input": "c:/in", "output": "/Out", "mode": "m", "detector": "d", "year": 2024, "month": 5, "export": None, "reprocess": True}
    rows = spark.createDataFrame([("v1_cv", "h", True, False), ("hybrid", "h", False, True), ("hybrid", None, False, False)], "n string, h string, d boolean, f boolean")
    made = [tuple(r) for r in rows.select(*RC.detector_provenance(F.col("n"), F.col("h")).values(), RC.detection_status(F.col("d"), F.col("f"))).collect()]
    assert made == [("v1_cv", "opencv-classical", None, "detected"), ("hybrid", RC.MODEL_VERSION, "h", "fallback"), ("hybrid", None, None, "failed")]


def test_given_orders(spark):
    orders = spark.createDataFrame([("a:b:2024-05", ["1"]), ("a:b:2024-6", ["2"]), ("c:2024-05", ["3"]), ("none:2024-05", ["4"]), ("a:b", ["5"]), ("a:b:x-05", ["6"])], "group_id string, ordered_source_paths array<string>")
    files = spark.createDataFrame([("a:b", "p\\1"), ("a:b", "p/2"), ("c", "q/1"), ("c", "q/2")], "employee_name string, relative_path string")
    state = spark.createDataFrame([("p/1",), ("p/2",), ("q/1",)], "relative_path string")
    assert [tuple(r) for r in RC.given_orders(orders, files, state, year=2024, month=5).collect()] == [("a:b", ["1"])]
