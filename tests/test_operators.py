import random
import zlib
from itertools import combinations, islice, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafplan.functions import geometry as G
from leafplan.functions import strings as S
from leafplan.operators import evaluation as EV
from leafplan.operators import events as E
from leafplan.operators import greedy as GR
from leafplan.operators import kernels as K
from leafplan.operators import planning as P
from leafplan.operators import ranking as R
from leafplan.sources.listing import file_tree
from leafplan.sources.pdf import grouped_pdfs, pdf_bytes
from leafplan.sources.state import StateStore, commit_files, free_name

STATE = "relative_path string, size long, mtime_ns long, sha256 string, pipeline_version string, status string, output_relative_paths array<string>, detector_name string, detector_mode string, detector_model_version string, detector_model_checksum string"


def test_natural_order(spark):
    names = ["10.jpg", "2.jpg", "b2", "b02", "a", "A1", "a10", "a9"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(S.natural_key(F.col("n")), "n").collect()]
    assert got == ["2.jpg", "10.jpg", "a", "A1", "a9", "a10", "b02", "b2"]


def test_names(spark):
    row = spark.createDataFrame([("x.tar.JPG", " a<b. ", "nul", "..", "Warp -- Fallback!", "a,OCCLUSION_RISK ,b", "../x", "data:image/png;base64,aGk=")], "a string, b string, c string, d string, e string, f string, g string, h string")
    got = row.select(
        S.target_pdf(F.col("a"), F.lit(True)), S.safe_component(F.col("b")), S.safe_component(F.col("c")), S.safe_component(F.col("d")), S.failure_slug(F.col("e")), S.has_warning(F.col("f"), "OCCLUSION_RISK"), S.relative_path_ok(F.col("g")), S.data_image_ok(F.col("h")), S.timing_stage(F.lit("Detect")), S.timing_stage(F.lit("other"))
    ).first()
    assert tuple(got) == ("x.tar__jpg.pdf", "a_b", "_nul", "employee", "warp_fallback", True, False, True, "total_detection_ms", None)


def test_plan_apply_plan_gives_no_work(spark):
    files = spark.createDataFrame([(f"e/{i}.jpg", i, i * 10, f"h{i}") for i in range(20)], "relative_path string, size long, mtime_ns long, sha256 string")
    empty = spark.createDataFrame([], STATE)
    none = spark.createDataFrame([], "path string")
    first = P.plan_summary(P.classify(files, empty, none, pipeline_version="0.4.0")).first()
    assert (first.new, first.files_to_process) == (20, 20)
    state = files.select("relative_path", "size", "mtime_ns", "sha256", F.lit("0.4.0").alias("pipeline_version"), F.lit("success").alias("status"), F.array(F.concat("relative_path", F.lit(".pdf"))).alias("output_relative_paths"), *[F.lit(None).cast("string").alias(c) for c in ("detector_name", "detector_mode", "detector_model_version", "detector_model_checksum")])
    outputs = state.select(F.explode("output_relative_paths").alias("path"))
    again = P.plan_summary(P.classify(files, state, outputs, pipeline_version="0.4.0")).first()
    assert (again.unchanged, again.files_to_process) == (20, 0)
    touched = files.withColumn("mtime_ns", F.col("mtime_ns") + F.when(F.col("size") < 5, 1).otherwise(0)).withColumn("sha256", F.when(F.col("size") < 3, "new").otherwise(F.col("sha256")))
    rows = P.classify(touched, state, outputs, pipeline_version="0.4.0")
    assert {r.classification: r["count"] for r in rows.groupBy("classification").count().collect()} == {"modified": 3, "unchanged": 17}
    assert P.refreshed_state(rows, state).where("mtime_ns % 10 = 1").count() == 2
    assert P.plan_summary(P.classify(files, state, none, pipeline_version="0.4.0")).first().rebuild == 20


def test_new_single_file_group_needs_review(spark):
    pages = spark.createDataFrame([("g", "a.jpg", 1, "new", 1, 1, "h", False, None, None)], "group_key string, relative_path string, position long, classification string, size long, mtime_ns long, sha256 string, known boolean, page_type string, page_order int")
    groups = spark.createDataFrame([], "group_key string, source_relative_paths array<string>, artifact_relative_paths array<string>, completeness_status string, review_required boolean, manual_order array<string>, manual_order_fingerprint string, artifact_stale boolean")
    row = P.group_plan(pages, groups, spark.createDataFrame([], "path string")).first()
    assert row.reasons == ["source_new", "unknown_page_identity", "missing_expected_page"]
    assert (row.completeness_status, row.review_required, row.process_paths) == ("INCOMPLETE", True, ["a.jpg"])


def quad(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_iou_is_symmetric_and_matches_numpy(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(150):
        a, b = ([(x + rnd.uniform(-30, 30), y + rnd.uniform(-30, 30)) for x, y in ((50, 50), (200, 50), (200, 180), (50, 180))] for _ in "ab")
        if k % 5 == 0:
            b = [(x + 400, y) for x, y in b]
        if k % 7 == 0:
            b = a
        rows.append((k, quad(a), quad(b)))
    df = spark.createDataFrame(rows, f"k int, a {G.POLYGON}, b {G.POLYGON}")
    for r in df.select("k", G.polygon_iou(F.col("a"), F.col("b")).alias("ab"), G.polygon_iou(F.col("b"), F.col("a")).alias("ba")).collect():
        a, b = (np.array([(p["x"], p["y"]) for p in q]) for q in rows[r.k][1:])
        assert r.ab == pytest.approx(GR.convex_iou(a, b), abs=1e-9) == pytest.approx(r.ba, abs=1e-9)
        assert r.k % 7 or r.ab == pytest.approx(1)


def test_perfect_predictions_pass_everything(spark):
    corners = quad([(10, 10), (90, 10), (90, 90), (10, 90)])
    truth = spark.createDataFrame([(1, 100, 100, corners, []), (2, 100, 100, corners, ["t"])], f"sample_id long, width int, height int, corners {G.POLYGON}, scenario_tags array<string>")
    good = truth.select("sample_id", F.lit(True).alias("detected"), F.col("corners").alias("raw_corners"), "corners", F.lit(None).cast("string").alias("failure_reason"))
    m = EV.metrics(EV.score_samples(truth, good))
    assert all(r.passed for r in EV.gate(m).collect())
    assert m.first().mean_iou == pytest.approx(1) and m.first().p99_corner_error_px == 0
    none = EV.metrics(EV.score_samples(truth, good.limit(0)))
    assert not any(r.passed for r in EV.gate(none).where("metric != 'false_detection_rate'").collect())
    assert none.first().mean_iou is None and none.first().corner_error_count == 0
    wrong = good.withColumn("corners", F.lit([])).withColumn("corners", F.col("raw_corners").cast(G.POLYGON)).withColumn("corners", F.reverse("corners"))
    assert {r.failure_reason for r in EV.score_samples(truth, wrong).collect()} == {"invalid_geometry"}


def test_ready_only_if_better(spark):
    rows = spark.createDataFrame([("v1_cv", 0.96, 0.98, 0.009, 0), ("hybrid", 0.97, 0.99, 0.008, 0)], "detector string, mean_iou double, detection_success_rate double, p95_normalized_corner_error double, silent_wrong_crop_count long")
    checks = spark.createDataFrame([("hybrid", True)], "detector string, passed boolean")
    have = spark.createDataFrame([(d, True) for d in ("segmentation_only", "cv_v2", "hybrid")], "detector string, has_checksum boolean")
    assert EV.decision(rows, checks, have).first().decision_status == "READY"
    crop = rows.withColumn("silent_wrong_crop_count", F.lit(1))
    assert EV.decision(crop, checks, have).first().decision_status == "BLOCKED"
    same = rows.withColumns({"mean_iou": F.lit(0.96), "detection_success_rate": F.lit(0.98), "p95_normalized_corner_error": F.lit(0.009)})
    assert EV.decision(same, checks, have).first().selected_detector is None
    assert EV.decision(rows, checks, have.limit(1)).first().blockers


def test_nearest_rank_and_linear_percentiles_differ(spark):
    v = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert v.agg(*EV.percentiles(F.col("v"), "x")).first().p95_x == pytest.approx(9.55)
    assert v.limit(0).agg(*EV.percentiles(F.col("v"), "x")).first().p50_x is None


def candidate(i, iou, cov=0.9, geo=0.9, ridges=0, aligns=False, overlap=False):
    return ("i", i, "mask_fit", iou, cov, 0.9, geo, False, overlap, 0.0, ridges, aligns, 1000.0, 1.0)


@pytest.mark.parametrize(
    "rows, status, chosen",
    [
        ([candidate(1, 0.95)], "selected", 1),
        ([candidate(1, 0.95), candidate(2, 0.5)], "selected", 1),
        ([candidate(1, 0.95), candidate(2, 0.95)], "ambiguous", None),
        ([candidate(1, 0.95), candidate(2, 0.94)], "selected", 1),
        ([candidate(1, 0.95, cov=0.8), candidate(2, 0.94, cov=0.9)], "selected", 2),
        ([candidate(1, 0.95, ridges=2, overlap=True), candidate(2, 0.95, ridges=1, overlap=True)], "selected", 2),
        ([candidate(1, 0.0, cov=0.0, geo=0.1)], "below_threshold", None),
    ],
)
def test_decisions(spark, rows, status, chosen):
    schema = "image_id string, candidate_id long, source string, mask_quad_iou double, mask_coverage double, edge_support double, geometry_quality double, border_contact boolean, has_overlap boolean, enclosed_length double, enclosed_ridges int, aligns boolean, perimeter double, aspect_ratio double"
    got = R.decisions(spark.createDataFrame(rows, schema)).first()
    assert (got.status, got.selected_candidate_id) == (status, chosen)


LINES = [
    '{"protocolVersion":1,"type":"scan_plan","timestamp":"2024-01-05T10:00:00Z","new":2,"modified":0,"unchanged":4,"filesToProcess":2}',
    '{"protocolVersion":1,"type":"file_started","timestamp":"2024-01-05T10:00:01Z","relativePath":"a/1.jpg","index":1,"total":2}',
    '{"protocolVersion":1,"type":"file_completed","timestamp":"2024-01-05T10:00:02Z","relativePath":"a/1.jpg","documentDetected":true,"warning":null}',
    '{"protocolVersion":1,"type":"file_failed","timestamp":"2024-01-05T10:00:03Z","relativePath":"a/1.jpg","errorCode":"E","message":"m"}',
    '{"protocolVersion":1,"type":"file_completed","timestamp":"2024-01-05T10:00:04Z","relativePath":"a/2.jpg","documentDetected":false,"warning":"DARK, OCCLUSION_RISK"}',
    "nonsense",
    '{"protocolVersion":1,"type":"scan_completed","timestamp":"2024-01-05T10:00:05Z","totalProcessed":2,"success":1,"failed":0,"warning":1,"skipped":4}',
]


def test_event_fold(spark):
    lines = spark.createDataFrame([(k, v) for k, v in enumerate(LINES)], "seq long, value string")
    assert [r.problem for r in E.decoded(lines.orderBy("seq")).collect()].count("not_an_event") == 1
    with pytest.raises(Exception, match="invalid event"):
        E.strict(lines).collect()
    events = None
    for k, v in enumerate(LINES):
        row = E.lenient(spark.createDataFrame([(v,)], "value string")).withColumns({"run_id": F.lit("r"), "seq": F.lit(k)})
        events = row if events is None else events.unionByName(row)
    got = E.run_state(events).first()
    assert (got.phase, got.processed, got.success, got.warning, got.failed, got.skipped, got.fallback_count) == ("completed", 2, 1, 1, 0, 4, 1)
    running = E.run_state(events.where("seq < 5")).first()
    assert (running.phase, running.processed, running.success, running.warning, running.failed, running.skipped, running.occlusion_risk_count) == ("running", 2, 1, 1, 0, 4, 1)


def test_streaming_fold_equals_batch(spark, tmp_path):
    from leafplan.streaming.fold import event_stream, run_states

    rows = [(f"r{r}", k, v) for r in range(3) for k, v in enumerate(LINES)]
    spark.createDataFrame(rows, "run_id string, seq long, value string").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, seq long, value string").parquet(str(tmp_path / "in"))
    q = run_states(event_stream(stream)).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.run_id: r.asDict() for r in spark.table("folded").collect()}
    events = E.lenient(spark.createDataFrame(rows, "run_id string, seq long, value string")) if False else E.decoded(spark.createDataFrame(rows, "run_id string, seq long, value string"), keep=("run_id", "seq")).where("problem is null")
    want = {r.run_id: r.asDict() for r in E.run_state(events).collect()}
    assert got == want and {(r["phase"], r["processed"], r["success"], r["warning"], r["failed"], r["skipped"]) for r in got.values()} == {("completed", 2, 1, 1, 0, 4)}


def test_streaming_fold_takes_nulls_and_refuses_what_the_batch_refuses(spark, tmp_path):
    """A plan without counts doesn't end the stream, and events without a path or with wrong counters are left out."""
    from leafplan.streaming.fold import event_stream, run_states

    head = '{"protocolVersion":1,"timestamp":"2024-01-05T10:00:0%d",'
    lines = [
        (head % 0).replace(':00"', ':00Z"') + '"type":"scan_plan","unchanged":null,"filesToProcess":0}',
        (head % 1).replace(':01"', ':01Z"') + '"type":"scan_plan","filesToProcess":9,"new":1}',
        (head % 2).replace(':02"', ':02Z"') + '"type":"file_completed","documentDetected":null,"warning":"OCCLUSION_RISK"}',
        (head % 3).replace(':03"', ':03Z"') + '"type":"file_started","relativePath":"a/1.jpg","index":1}',
        (head % 4).replace(':04"', ':04Z"') + '"type":"file_completed","relativePath":"a/1.jpg","documentDetected":null,"warning":"OCCLUSION_RISK"}',
    ]
    df = spark.createDataFrame([("r", k, v) for k, v in enumerate(lines)], "run_id string, seq long, value string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = run_states(event_stream(stream)).writeStream.outputMode("update").format("memory").queryName("nulls").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("nulls").first()
    want = E.run_state(E.decoded(df, keep=("run_id", "seq")).where("problem is null")).first()
    assert got.asDict() == want.asDict() and (got.phase, got.processed, got.warning, got.occlusion_risk_count, got.fallback_count, got.current_file) == ("running", 1, 1, 1, 1, "a/1.jpg")


def test_greedy_is_independent_of_partitions(spark):
    rows = [(1, k, float(10 - k), quad([(k * 3, 0), (k * 3 + 100, 0), (k * 3 + 100, 100), (k * 3, 100)])) for k in range(8)]
    df = spark.createDataFrame(rows, f"image_id long, candidate_id long, score double, corners {G.POLYGON}")
    kept = lambda d: {r.candidate_id for r in GR.distinct_quads(d).where("kept").collect()}
    assert kept(df) == kept(df.repartition(5)) == {0, 3, 6}


def test_warp_recovers_a_rectangle():
    rnd = np.random.default_rng(1)
    page = K.resize(rnd.integers(0, 255, (8, 10, 3), np.uint8), 120, 90)
    corners = np.array([(30, 20), (180, 35), (170, 150), (25, 140)], float)
    canvas = np.zeros((180, 220, 3), np.uint8)
    m = K.homography(corners, np.array([(0, 0), (119, 0), (119, 89), (0, 89)], float))
    x, y = np.meshgrid(np.arange(220), np.arange(180))
    p = K.project(m, np.c_[x.ravel(), y.ravel()]).reshape(180, 220, 2)
    inside = K.fill_polygon(corners, 220, 180)
    canvas[inside] = K.sample(page, p[..., 0], p[..., 1])[inside]
    back = K.warp(canvas, corners, 120, 90)
    assert np.abs(back[3:-3, 3:-3].astype(int) - page[3:-3, 3:-3]).mean() < 4
    assert min(K.edge_support(K.edge_map(canvas), corners)) > 0.3


def test_masks():
    mask = K.fill_polygon(np.array([(2, 2), (12, 2), (12, 9), (2, 9)]), 30, 20) | K.fill_polygon(np.array([(20, 12), (27, 12), (27, 17), (20, 17)]), 30, 20)
    table = K.component_table(mask)
    assert [c["area"] for c in table] == [88, 48]
    assert K.mask_iou(mask, mask) == 1.0 and K.mask_iou(mask & False, mask & False) == 1.0 and K.mask_iou(mask, mask[:5]) is None
    noisy = mask.astype(float)
    noisy[18, 1] = 1
    assert K.components(K.clean_mask(noisy))[1] == 2
    for shape in ((1, 8, 8), (8, 8, 2), (2, 8, 8)):
        assert K.decode_logits(np.random.default_rng(0).normal(size=shape), "logits").shape == (8, 8)


def test_images_fail_alone(spark):
    good = K.to_struct(np.full((6, 8, 3), 200, np.uint8))
    bad = {"height": -1, "width": -1, "channels": -1, "data": b""}
    df = spark.createDataFrame([("a", good), ("b", bad), ("c", None)], f"path string, image {K.IMAGE}")
    got = {r.path: (r.n, r.error) for r in K.map_images(df, lambda a: {"n": int(a.size)}, "n int").collect()}
    assert got == {"a": (144, None), "b": (None, "DECODE_FAILED"), "c": (None, "DECODE_FAILED")}
    for mode in ("gray", "bw", "color", "smart_document"):
        assert K.enhance(K.to_array(good), mode).shape[:2] == (6, 8)


def test_pdf(spark):
    raw = pdf_bytes([np.zeros((4, 6), np.uint8), np.zeros((4, 6, 3), np.uint8)])
    assert raw.startswith(b"%PDF") and raw.count(b"/Type /Page ") == 2
    start = raw.index(b"stream\n") + 7
    assert len(zlib.decompress(raw[start : raw.index(b"\nendstream", start)])) == 24
    df = spark.createDataFrame([(g, p, K.to_struct(np.zeros((3, 3), np.uint8))) for g in "ab" for p in (2, 1)], f"group_key string, position int, image {K.IMAGE}")
    assert sorted((r.group_key, r.n_pages) for r in grouped_pdfs(df).collect()) == [("a", 2), ("b", 2)]


def test_tree_and_state(spark, tmp_path):
    for e, f in (("n1", "1.jpg"), ("n1", "2.png"), ("n2", "3.jpg"), (".hidden", "4.jpg")):
        (tmp_path / "in" / e).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / e / f).write_bytes(f.encode())
    rows = file_tree(spark, str(tmp_path / "in"), content_hash=True).collect()
    assert sorted(r.relative_path for r in rows) == ["n1/1.jpg", "n1/2.png", "n2/3.jpg"]
    assert all(r.mtime_ns == (tmp_path / "in" / r.relative_path).stat().st_mtime_ns for r in rows)
    store = StateStore(spark, str(tmp_path / "state"), "k string, v int", "root")
    assert store.load().count() == 0
    (tmp_path / "state").mkdir()
    store.save(spark.createDataFrame([("a", 1)], "k string, v int"))
    assert store.load().collect() == [("a", 1)]
    with pytest.raises(ValueError):
        StateStore(spark, str(tmp_path / "state"), "k string, v int", "other").load()
    (tmp_path / "state" / "current.json").write_text("{")
    assert store.load().count() == 0 and list((tmp_path / "state").glob("current.json.corrupt-*"))


def test_commit_rolls_back(tmp_path):
    old, new = tmp_path / "a.pdf", tmp_path / "new"
    old.write_bytes(b"old")
    new.write_bytes(b"new")

    def fail():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        commit_files({str(old): str(new)}, fail)
    assert old.read_bytes() == b"old"
    new.write_bytes(b"new")
    commit_files({str(old): str(new)}, lambda: None)
    assert old.read_bytes() == b"new" and len(list(tmp_path.iterdir())) == 1
    assert free_name("a.pdf", {"a.pdf", "a_1.pdf"}) == "a_2.pdf"


def test_reports(spark, tmp_path):
    import json

    from leafplan.sources import reports as Q

    corners = [[10, 10], [90, 10], [90, 90], [10, 90]]
    sample = {"sample_id": "s1", "image_path": "a.jpg", "dataset": "d", "split": "tune", "width": 100, "height": 100, "tl": corners[0], "tr": corners[1], "br": corners[2], "bl": corners[3], "document_visible": True, "scenario_tags": []}
    (tmp_path / "truth.json").write_text(json.dumps({"schema_version": "1.0", "coordinate_space": "exif_normalized_pixels", "split_policy": "sequence_group", "samples": [sample]}))
    prediction = {"sample_id": "s1", "detected": True, "raw_corners": corners, "corners": corners, "timings_ms": {"detect": 3.0}}
    (tmp_path / "bare.json").write_text(json.dumps([prediction]))
    (tmp_path / "bundle.json").write_text(json.dumps({"detector": "hybrid", "predictions": [prediction]}))
    truth = Q.truth_manifests(spark, str(tmp_path / "truth.json"))
    with pytest.raises(ValueError):
        Q.truth_manifests(spark, str(tmp_path / "truth.json"), str(tmp_path / "truth.json"))
    for name in ("bare.json", "bundle.json"):
        m = EV.metrics(EV.score_samples(truth, Q.prediction_bundle(spark, str(tmp_path / name))))
        found = Q.report(m, EV.gate(m), detector="hybrid", manifest_sha256="0" * 64)
        assert found["metrics"]["mean_iou"] == pytest.approx(1) and all(c["passed"] for c in found["threshold_gate"]["checks"].values())
    Q.write_text(str(tmp_path / "r.json"), Q.canonical_json(found))
    assert json.loads((tmp_path / "r.json").read_text()) == found and "| mean_iou | 1.0000 |" in Q.markdown(found)


def test_order_gate_and_free_names(spark):
    from leafplan.operators import detection as D

    plan = spark.createDataFrame([("a", ["1", "2"], True), ("b", ["3", "4"], True), ("c", ["5"], False), ("d", ["6"], True)], "group_key string, source_paths array<string>, review_required boolean")
    orders = spark.createDataFrame([("a", ["2", "1"]), ("c", ["5", "5"])], "group_key string, manual_order array<string>")
    got = {r.group_key: r.problem for r in D.order_gate(plan, orders, spark.createDataFrame([("d",)], "group_key string")).collect()}
    assert got == {"b": "order_required", "c": "order_mismatch"}
    wanted = spark.createDataFrame([("p1", "x.pdf"), ("p2", "x.pdf"), ("p3", "y.pdf")], "path string, name string")
    taken = spark.createDataFrame([("x.pdf",), ("x_2.pdf",)], "name string")
    assert {r.path: r.free_name for r in D.first_free_names(wanted, taken).collect()} == {"p1": "x_1.pdf", "p2": "x_3.pdf", "p3": "y.pdf"}


def test_segment_families_of_many_segments(spark):
    sizes = {1: (2, 12), 2: (12, 2), 3: (2, 40), 4: (40, 2), 5: (3, 12), 6: (40, 40), 7: (1, 40), 8: (2, 9), 9: (33, 3), 10: (2, 33)}
    ids = {}
    for image, (h, v) in sizes.items():
        mixed = ["horizontal"] * h + ["vertical"] * v + ["diagonal"] * 3
        random.Random(image).shuffle(mixed)
        ids[image] = list(enumerate(mixed, 1))
    rows = spark.createDataFrame([(i, k, o) for i, held in ids.items() for k, o in held], "image_id long, segment_id int, orientation string").repartition(3)
    want = set()
    for i, held in ids.items():
        h, v = ([k for k, o in held if o == kind] for kind in ("horizontal", "vertical"))
        want |= {(i, *a, *b) for a, b in islice(product(combinations(h, 2), combinations(v, 2)), 32)}
    got = [tuple(r) for r in GR.segment_families(rows).select("image_id", "h1", "h2", "v1", "v2").collect()]
    assert len(got) == len(want) and set(got) == want
