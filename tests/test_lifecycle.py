"""Runs, names, refinement and plans against plain loops."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafplan.operators import detection as D
from leafplan.operators import evaluation as EV
from leafplan.operators import lifecycle as LC
from leafplan.operators import planning as P
from leafplan.operators import ranking as R
from leafplan.operators import refinement as RF
from leafplan.plans.catalogue import QUERIES
from leafplan.sources.reports import string_table
from leafplan.sources.state import StateStore

from .conftest import DATA


def names_by_loop(wanted, taken):
    gone, firsts, out = set(taken) | {n for _, n in wanted}, set(), {}
    for path, name in sorted(wanted):
        if name not in taken and name not in firsts:
            firsts.add(name)
            out[path] = name
            continue
        stem, dot, ext = name.rpartition(".")
        k = 1
        while (form := f"{stem}_{k}{dot}{ext}") in gone:
            k += 1
        gone.add(form)
        out[path] = form
    return out


def test_free_names_are_all_different(spark):
    cases = [
        ([("a", "x.pdf"), ("b", "x.pdf"), ("c", "x_1.pdf")], []),
        ([("a", "x.pdf"), ("b", "x.pdf"), ("c", "x.pdf"), ("d", "y_2.pdf")], ["x_1.pdf", "x_3.pdf", "y_2.pdf", "x.png"]),
        ([(f"p{k:03}", "x.pdf") for k in range(60)] + [("q", "x_1_1.pdf")], ["x.pdf", "x_1.pdf", "x_2.pdf", "x_7.pdf", "x_007.pdf", "x_0.pdf", "x_1_1.pdf"]),
    ]
    rnd = random.Random(3)
    cases.append(([(f"p{k:03}", rnd.choice(["a.pdf", "a_1.pdf", "a_2.pdf", "b.pdf", "b_4.png"])) for k in range(120)], ["a_5.pdf", "b.pdf", "b_1.pdf", "b_4_3.png", "a_1_2.pdf"]))
    for wanted, taken in cases:
        got = D.first_free_names(spark.createDataFrame(wanted, "path string, name string").repartition(3), spark.createDataFrame([(t,) for t in taken], "name string")).collect()
        found = {r.path: r.free_name for r in got}
        assert found == names_by_loop(wanted, taken) and len(set(found.values())) == len(wanted) and not set(found.values()) & set(taken)
    null = D.first_free_names(spark.createDataFrame([("a", None), ("b", "x")], "path string, name string"), spark.createDataFrame([("x",)], "name string")).collect()
    assert sorted((r.path, r.free_name) for r in null) == [("a", None), ("b", "x_1")]


def test_plans_stay_small(spark):
    """Metrics and the sweep read their table once, and segment pairs take one window."""
    plan = lambda name: QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scans = lambda text: len(re.findall(r"FileScan|Scan parquet", text))
    assert scans(plan("detector_metrics")) == 2 and scans(plan("scenario_metrics")) == 2
    assert scans(plan("candidate_sweep")) == scans(plan("candidate_decisions")) == 1
    assert scans(plan("segment_families")) == 1 and len(re.findall(r"Window(?!GroupLimit)", plan("segment_families"))) <= 3
    # No window over a tag has more than its bins; the rows of a tag are aggregated before.
    assert "collect_list" in plan("scenario_metrics") and plan("scenario_metrics").index("Window") > 0


def test_scenario_rank_of_equal_and_large_errors(spark):
    rnd = random.Random(1)
    rows = []
    for tag, values in (("same", [0.01] * 50), ("spread", [rnd.random() * 3 for _ in range(333)]), ("large", [100.0 + k for k in range(41)]), ("none", []), ("few", [0.5, 0.25])):
        rows += [(tag, True, 0.4 if k % 3 else 0.9, [v] * 4) for k, v in enumerate(values)] + [(tag, False, None, None)] * 3
    df = spark.createDataFrame(rows, "tag string, detected boolean, polygon_iou double, corner_normalized array<double>").select(F.array("tag").alias("scenario_tags"), "detected", "polygon_iou", "corner_normalized")
    for r in EV.scenario_metrics(df).collect():
        mine = [x for x in rows if x[0] == r.tag]
        errors = sorted(x[3][0] for x in mine if x[3])
        want = errors[max(1, round(0.95 * len(errors))) - 1] if errors else None
        assert r.p95_normalized_corner_error == (pytest.approx(want) if errors else None)
        assert (r.sample_count, r.silent_wrong_crop_count) == (len(mine), sum(bool(x[1]) and x[2] < 0.5 for x in mine))


def test_breakdown_adds_up(spark):
    rows = [(1, 1, "mixed", 0.9, None, None, 0.8, None, True, 100.0, 1, True, 2000.0, 0.7, 0.25)]
    df = spark.createDataFrame(rows, "image_id long, candidate_id long, source string, mask_quad_iou double, mask_coverage double, edge_support double, geometry_quality double, border_contact boolean, has_overlap boolean, enclosed_length double, enclosed_ridges int, aligns boolean, perimeter double, aspect_ratio double, convex double")
    policy = R.ScoringPolicy(neutral_mask=0.1, neutral_edge=0.2, neutral_aspect=0.3)
    r = R.with_scores(df, policy, explain=True).first()
    parts = r.breakdown
    assert (parts["convexity"].value, parts["mask_coverage"].value, parts["edge_support"].value, parts["aspect"].value) == (0.25, 0.1, 0.2, 0.3)
    assert parts["border"].policy == "neutral:border_not_reported" and not parts["border"].applicable and parts["mask_iou"].applicable
    assert r.final_score == pytest.approx(sum(p.contribution for p in parts.values()))


def test_outputs_are_compared_with_one_separator(spark):
    state = spark.createDataFrame([("a", ["x\\1.pdf"]), ("b", ["x/2.pdf"]), ("c", ["..\\3.pdf"]), ("d", [])], "relative_path string, output_relative_paths array<string>")
    outputs = spark.createDataFrame([("x/1.pdf",), ("x\\2.pdf",), ("../3.pdf",)], "path string")
    assert {r.relative_path: r.outputs_exist for r in P.outputs_exist(state, outputs).collect()} == {"a": True, "b": True, "c": False, "d": False}


def test_csv_with_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"say ""so""","two\nlines"\nplain,\n', encoding="utf-8")
    got = string_table(spark, str(tmp_path / "t.csv")).collect()
    assert [tuple(r) for r in got] == [('say "so"', "two\nlines"), ("plain", None)]


def test_state_store_reads_the_backup(spark, tmp_path):
    """A reader that comes between the two renames of a save finds the state before."""
    store = StateStore(spark, f"file://{tmp_path}/s", "k string, v int", "root")
    for v in (1, 2):
        store.save(spark.createDataFrame([("a", v)], "k string, v int"))
    assert store.load().first().v == 2
    store.files.delete(store._path(store.pointer), False)
    assert store.load().first().v == 1


def test_orders_and_skips(spark):
    got = LC.manual_orders(spark, '{"g": ["a\\\\b", "c"]}').collect()
    assert [(r.group_key, r.manual_order) for r in got] == [("g", ["a/b", "c"])] and LC.manual_orders(spark, None).count() == 0
    assert [r.group_key for r in LC.skipped_groups(spark, '["b", " a "]').collect()] == ["a", "b"]
    for bad in ("[]", '{"": ["a"]}', '{"g": "a"}', '{"g": [" "]}', '{"g": ["a", "a"]}', "{"):
        with pytest.raises(ValueError):
            LC.manual_orders(spark, bad)
    for bad in ("{}", '[""]', '["a", "a "]', "[1]"):
        with pytest.raises(ValueError):
            LC.skipped_groups(spark, bad)
    assert LC.batch_period(None, None) is None and LC.batch_period(2024, 5) == (2024, 5)
    for bad in ((2024, None), (None, 5), (2024, 13)):
        with pytest.raises(ValueError):
            LC.batch_period(*bad)


def test_error_codes():
    class Own(Exception):
        code = "PDF_WRITE_FAILED"

    found = [LC.error_code(e, o) for e, o in ((Own(), "file"), (PermissionError(), "output"), (PermissionError(), "state"), (PermissionError(), "file"), (FileNotFoundError(), "file"), (ValueError(), "request"), (ValueError(), "file"))]
    assert found == ["PDF_WRITE_FAILED", "OUTPUT_NOT_WRITABLE", "STATE_WRITE_FAILED", "UNEXPECTED_ERROR", "IMAGE_DECODE_FAILED", "INVALID_REQUEST", "UNEXPECTED_ERROR"]
    assert LC.technical_message(ValueError()) == "ValueError" and len(LC.technical_message(ValueError("x" * 5000))) == 2001


LINE = "struct<normal_a:double,normal_b:double,normal_c:double,confidence:double,fallback_used:boolean,source:string>"


def through(a, b, confidence=0.9, fallback=False, source="fit"):
    (ax, ay), (bx, by) = a, b
    size = math.hypot(bx - ax, by - ay)
    na, nb = -(by - ay) / size, (bx - ax) / size
    return (na, nb, -(na * ax + nb * ay), confidence, fallback, source)


def test_refined_corners(spark):
    old = [(100.0, 100.0), (900.0, 100.0), (900.0, 700.0), (100.0, 700.0)]
    new = [(110.0, 95.0), (905.0, 108.0), (893.0, 706.0), (102.0, 690.0)]
    sides = lambda c, **k: [through(c[i], c[(i + 1) % 4], **k) for i in range(4)]
    far = [(x + 70, y + 70) for x, y in old]
    weak, few, parallel = sides(new), sides(new), sides(new)
    weak[2] = through(new[2], new[3], confidence=0.1)
    few = [through(new[i], new[(i + 1) % 4], fallback=i > 0) for i in range(4)]
    parallel[1] = through(new[0], new[1])
    cases = {"all": sides(new), "weak": weak, "few": few, "far": sides(far), "parallel": parallel, "none": sides(new, source="none")}
    point = lambda c: [{"x": x, "y": y} for x, y in c]
    df = spark.createDataFrame([(k, 1000, 800, point(old), v, 0.8, 0.6 if k == "weak" else 0.79) for k, v in cases.items()], f"k string, width int, height int, corners array<struct<x double, y double>>, lines array<{LINE}>, before_support double, after_support double")
    got = {r.k: r for r in RF.refined_corners(df).collect()}
    xy = lambda c: [(p.x, p.y) for p in c]
    assert got["all"].accepted and got["all"].reasons == ["accepted"] and np.allclose(xy(got["all"].selected), new) and got["all"].refined_edges == list(RF.EDGES)
    assert got["all"].max_displacement_px == pytest.approx(max(math.dist(a, b) for a, b in zip(old, new)))
    assert not got["weak"].accepted and got["weak"].reasons == ["edge_support_drop"] and got["weak"].fallback_edges == ["bottom"] and xy(got["weak"].selected) == old
    # The weak edge gives way to the old one: the line through the old bottom.
    assert xy(got["weak"].refined)[2][1] == pytest.approx(700.0)
    assert got["few"].reasons == ["no_usable_lines"] and got["few"].max_displacement_px == 0 and got["none"].reasons == ["no_usable_lines"]
    assert "displacement_too_large" in got["far"].reasons and xy(got["far"].selected) == old
    assert got["parallel"].reasons[0] == "near_parallel_lines" and not got["parallel"].accepted
    strict = RF.refined_corners(df, RF.RefinementPolicy(allow_partial=False, max_px=5.0)).collect()
    assert {r.k: r.reasons for r in strict}["weak"] == ["partial_not_allowed"] and {r.k: r.reasons for r in strict}["all"] == ["displacement_too_large"]


def test_dent_pairs(spark):
    rnd = random.Random(9)
    rows = []
    for image in range(40):
        for k in range(rnd.randrange(0, 12)):
            rows.append((image, k, rnd.uniform(10, 60), rnd.uniform(0, 1000), rnd.uniform(0, 800), rnd.uniform(0, 3000), 3000.0, *[rnd.uniform(-30, 30) for _ in range(4)], 1000, 800))
    df = spark.createDataFrame(rows, "image_id long, dent_id long, depth double, x double, y double, arc double, total double, in_x double, in_y double, out_x double, out_y double, width int, height int")

    def angle(u, v):
        size = math.hypot(*u) * math.hypot(*v)
        return math.degrees(math.acos(max(-1.0, min(1.0, (u[0] * v[0] + u[1] * v[1]) / size)))) if size > 1e-9 else 0.0

    want = []
    for image in range(40):
        deep = sorted((r for r in rows if r[0] == image), key=lambda r: (-r[2], r[1]))[:8]
        for a, b in itertools.combinations(deep, 2):
            gap, way = abs(a[5] - b[5]), (b[3] - a[3], b[4] - a[4])
            back = (-way[0], -way[1])
            if min(gap, 3000 - gap) >= 450 and math.hypot(*way) >= 160 and angle(a[7:9], a[9:11]) <= 170 and angle(b[7:9], b[9:11]) <= 170 and min(angle(way, a[7:9]), angle(way, a[9:11]), angle(back, b[7:9]), angle(back, b[9:11])) >= 25:
                want.append((image, a[1], b[1]))
    pairs = RF.dent_pairs(df)
    got = sorted(pairs.collect(), key=lambda r: (r.image_id, r.turn))
    assert [(r.image_id, r.a_dent_id, r.b_dent_id) for r in got] == want and len(want) > 20
    support = pairs.select("image_id", "a_dent_id", "b_dent_id", F.lit(0.9).alias("edge_support"), (F.col("turn") % 2).cast("double").alias("continuity"))
    ridges = RF.verified_ridges(pairs, support, least_support=0.5, least_continuity=0.5, most=2).collect()
    assert ridges and max(r.ridge_id for r in ridges) <= 1 and all(r.turn % 2 == 1 for r in ridges)


def test_simple_order_keeps_a_corner_with_two_roles(spark):
    df = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 9.0}, {"x": 5.0, "y": 5.0}, {"x": 1.0, "y": 8.0}],)], "p array<struct<x double, y double>>")
    got = df.select(RF.simple_order(F.col("p")).alias("q")).first().q
    assert [(p.x, p.y) for p in got] == [(0, 0), (0, 0), (9, 9), (1, 8)]
