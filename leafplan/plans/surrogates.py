"""Capture tables derived from the test tables, in the SQL of two engines.

The test tables know nothing of scans, so each capture table is a fixed
derivation of one of them. A derivation is written once; ``Dialect`` spells the
few things that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark
        self.text_type = "STRING" if spark else "VARCHAR"

    def text(self, x: str) -> str:
        return f"CAST({x} AS {self.text_type})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})" if self.spark else f"[{', '.join(xs)}]"

    def point(self, x: str, y: str) -> str:
        return f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))" if self.spark else f"struct_pack(x := CAST({x} AS DOUBLE), y := CAST({y} AS DOUBLE))"

    def quad(self, *xy: tuple[str, str]) -> str:
        return self.array(*[self.point(*p) for p in xy])

    def at(self, a: str, k: int) -> str:
        return f"CAST({a}[{k}] AS DOUBLE)" if self.spark else f"CAST({a}[{k + 1}] AS DOUBLE)"

    def none(self, kind: str) -> str:
        return f"CAST(NULL AS {self.text_type if kind == 'text' else kind})"

    def micros(self, x: str) -> str:
        return f"unix_micros({x})" if self.spark else f"epoch_us({x})"


_EXT = "CASE doc_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'png' WHEN 3 THEN 'webp' ELSE 'txt' END"


def v_files(d: Dialect) -> str:
    return f"""SELECT doc_id, source AS employee_name, concat(lang, '-', {d.text("doc_id % 40")}, '.', {_EXT}) AS file_name,
      concat(source, '/', {d.text("doc_id")}, '.', {_EXT}) AS relative_path, n_chars AS size, doc_id * 1000 AS mtime_ns, {d.sha("text")} AS sha256 FROM documents"""


def v_state(d: Dialect) -> str:
    row = f"""size + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, mtime_ns + CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 5 ELSE 0 END AS mtime_ns,
      CASE WHEN doc_id % 7 = 0 THEN {d.sha("sha256")} ELSE sha256 END AS sha256, CASE WHEN doc_id % 13 = 0 THEN '0.3.0' ELSE '0.4.0' END AS pipeline_version,
      CASE WHEN doc_id % 17 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'warning' ELSE 'success' END AS status,
      {d.array(f"concat(employee_name, '/', {d.text('doc_id')}, '.pdf')")} AS output_relative_paths,
      CASE WHEN doc_id % 23 = 0 THEN 'v1_cv' WHEN doc_id % 29 = 0 THEN NULL ELSE 'hybrid' END AS detector_name, {d.none("text")} AS detector_mode,
      CASE WHEN doc_id % 31 = 0 THEN 'm0' ELSE 'm1' END AS detector_model_version, {d.none("text")} AS detector_model_checksum"""
    return f"SELECT relative_path, employee_name, doc_id, {row} FROM v_files WHERE doc_id % 10 <> 0 UNION ALL SELECT concat('gone/', relative_path) AS relative_path, employee_name, doc_id, {row} FROM v_files WHERE doc_id % 50 = 3"


def v_outputs(d: Dialect) -> str:
    return f"SELECT DISTINCT concat(source, '/', {d.text('doc_id')}, '.pdf') AS path FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 19 <> 0 AND doc_id % 100 <> 53"


def v_entries(d: Dialect) -> str:
    """State rows of pages in groups of a source and a tenth of the ids."""
    return f"""SELECT concat(employee_name, ':', {d.text("doc_id % 10")}) AS group_key, relative_path, doc_id AS seq, pipeline_version, detector_name, detector_model_version,
      CASE WHEN doc_id % 37 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'fallback' WHEN doc_id % 41 = 0 THEN NULL ELSE 'detected' END AS detection_status,
      CASE WHEN doc_id % 41 = 0 THEN NULL ELSE doc_id % 5 = 0 END AS detection_fallback_used,
      {d.array("CASE WHEN doc_id % 3 = 0 THEN 'QUAD_FIT_FAILED' ELSE 'MASK_INVALID' END")} AS detection_reason_codes,
      CASE WHEN doc_id % 4 = 3 THEN 'UNKNOWN' WHEN doc_id % 2 = 0 THEN 'FIRST_HALF' ELSE 'SECOND_HALF' END AS page_type,
      CASE WHEN doc_id % 6 = 5 THEN NULL ELSE CAST(doc_id % 9 AS INT) END AS page_order, size, mtime_ns, sha256, status FROM v_state WHERE relative_path NOT LIKE 'gone/%'"""


def v_pages(d: Dialect) -> str:
    """Conversations as groups of pages: the turn is the order, the role the kind."""
    return f"""SELECT conv_id AS group_key, concat({d.text("conv_id")}, '/', {d.text("turn")}) AS relative_path, turn * 7 % 5 * 100 + turn AS seq,
      CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN 'UNKNOWN' WHEN turn % 2 = 0 THEN 'FIRST_HALF' ELSE 'SECOND_HALF' END AS page_type,
      CASE WHEN conv_id % 7 = 0 THEN CAST(turn % 3 AS INT) WHEN conv_id % 11 = 0 THEN NULL ELSE CAST(turn AS INT) END AS page_order,
      CASE WHEN (conv_id * 31 + turn) % 23 = 0 THEN 'failed' WHEN turn % 3 = 0 THEN 'warning' ELSE 'success' END AS status FROM conversations"""


def v_candidates(d: Dialect) -> str:
    return """SELECT l_orderkey AS image_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS candidate_id,
      CASE l_returnflag WHEN 'A' THEN 'mask_fit' WHEN 'N' THEN 'mixed' ELSE 'hough' END AS source,
      CASE WHEN l_quantity % 5 = 0 THEN NULL ELSE 0.5 + l_discount * 5 END AS mask_quad_iou, CASE WHEN l_quantity % 7 = 0 THEN NULL ELSE 0.6 + l_tax * 5 END AS mask_coverage,
      CASE WHEN l_quantity % 3 = 0 THEN NULL ELSE l_quantity / 50.0 END AS edge_support, 0.3 + (l_extendedprice % 700) / 1000.0 AS geometry_quality,
      CASE WHEN l_quantity % 11 = 0 THEN NULL ELSE l_quantity % 2 = 0 END AS border_contact, l_linestatus = 'O' AS has_overlap,
      (l_partkey % 300) * 1.0 AS enclosed_length, CAST(l_partkey % 3 AS INT) AS enclosed_ridges, l_suppkey % 2 = 0 AS aligns, 2000.0 + (l_partkey % 1000) AS perimeter,
      0.7 + l_discount AS aspect_ratio FROM lineitem"""


def _corner(d: Dialect, x: int, y: int, k: int, extra: bool) -> tuple[str, str]:
    e = lambda i: d.at("embedding", i)
    more = lambda i: f" + 60.0 * {e(8 + i)}" if extra else ""
    return f"{x}.0 + 40.0 * {e(2 * k)}{more(2 * k)}", f"{y}.0 + 40.0 * {e(2 * k + 1)}{more(2 * k + 1)}"


_BASE = ((150, 120), (850, 120), (850, 680), (150, 680))


def v_truth(d: Dialect) -> str:
    corners = d.quad(*[_corner(d, x, y, k, False) for k, (x, y) in enumerate(_BASE)])
    return f"""SELECT vec_id AS sample_id, 1000 AS width, 800 AS height, {corners} AS corners,
      CASE WHEN vec_id % 10 = 0 THEN {d.array()} ELSE {d.array(f"concat('tag', {d.text('label')})", f"concat('odd', {d.text('vec_id % 2')})")} END AS scenario_tags FROM embeddings"""


def v_pred(d: Dialect) -> str:
    c = [_corner(d, x, y, k, True) for k, (x, y) in enumerate(_BASE)]
    return f"""SELECT vec_id AS sample_id, vec_id % 11 <> 0 AS detected, {d.quad(*c)} AS raw_corners,
      CASE WHEN vec_id % 13 = 0 THEN {d.quad(c[0], c[2], c[1], c[3])} ELSE {d.quad(*c)} END AS corners,
      CASE WHEN vec_id % 11 = 0 AND vec_id % 2 = 0 THEN 'No Document -- found!' ELSE NULL END AS failure_reason FROM embeddings WHERE vec_id % 9 <> 0"""


def v_quads(d: Dialect) -> str:
    """Quadrilaterals of all kinds, corners in no special order."""
    e = lambda k: d.at("embedding", k)
    pts = [(f"{x}.0 + {s}.0 * {e(2 * k)}", f"{y}.0 + {s}.0 * {e(2 * k + 1)}") for k, (x, y, s) in enumerate(((850, 680, 400), (150, 120, 300), (150, 680, 500), (850, 120, 200)))]
    return f"SELECT vec_id AS quad_id, 1000 AS width, 800 AS height, {d.quad(*pts)} AS corners FROM embeddings"


def v_timings(d: Dialect) -> str:
    return """SELECT CASE event_type WHEN 'click' THEN 'Segmentation Inference' WHEN 'view' THEN 'mask_postprocess_ms' WHEN 'purchase' THEN 'detect' WHEN 'signup' THEN 'CV-Refinement' ELSE 'unknown' END AS key,
      CASE WHEN user_id % 2 = 0 THEN 'classic' ELSE 'ai_enhanced' END AS mode, CASE WHEN event_id % 3 = 0 THEN 'end_to_end' ELSE 'pipeline' END AS boundary, CAST(value AS DOUBLE) AS ms FROM events"""


def v_events(d: Dialect) -> str:
    kind = "CASE WHEN event_id % 97 = 0 THEN 'scan_completed' WHEN event_type = 'view' THEN 'file_started' WHEN event_type = 'purchase' THEN 'file_failed' WHEN event_id % 53 = 0 THEN 'scan_plan' WHEN event_id % 31 = 0 THEN 'flat_scan_progress' ELSE 'file_completed' END"
    return f"""SELECT {d.text("user_id % 40")} AS run_id, event_id AS seq, {kind} AS type, concat('e', {d.text("user_id % 5")}, '/p', {d.text("event_id % 60")}, '.jpg') AS relativePath,
      CAST(event_id % 7 AS INT) AS index, CASE WHEN event_id % 4 = 0 THEN 'DARK, OCCLUSION_RISK' WHEN event_id % 9 = 0 THEN 'DARK' ELSE NULL END AS warning, event_id % 5 <> 0 AS documentDetected,
      'E1' AS errorCode, 'broken' AS message, CAST(10 AS INT) AS filesToProcess, CAST(3 AS INT) AS unchanged, CAST(event_id % 30 AS INT) AS totalProcessed, CAST(event_id % 11 AS INT) AS success,
      CAST(event_id % 5 AS INT) AS warningCount, CAST(event_id % 3 AS INT) AS failed, CAST(event_id % 4 AS INT) AS skipped, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 6 AS INT) ELSE NULL END AS occlusionRiskCount FROM events"""


def v_pool(d: Dialect) -> str:
    return f"SELECT concat(source, ':', lang) AS bucket, concat('img/', {d.text('doc_id')}, '.jpg') AS image_path, doc_id, source, lang FROM documents"


def v_segments(d: Dialect) -> str:
    return """SELECT l_orderkey AS image_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS segment_id,
      (l_partkey % 900) * 1.0 AS x1, (l_suppkey % 700) * 1.0 AS y1, (l_partkey % 900) + (l_extendedprice % 400) - 150 AS x2, (l_suppkey % 700) + l_quantity * CASE WHEN l_returnflag = 'A' THEN 9 ELSE 1 END AS y2,
      l_discount * 10 AS support FROM lineitem"""


def v_positions(d: Dialect) -> str:
    return "SELECT o_custkey AS image_id, o_orderkey AS seq, o_totalprice AS position, 1.0 + (o_orderkey % 9) AS weight FROM orders"


#: In this order: later ones may use earlier ones.
VIEWS = {f.__name__: f for f in (v_files, v_state, v_outputs, v_entries, v_pages, v_candidates, v_truth, v_pred, v_quads, v_timings, v_events, v_pool, v_segments, v_positions)}
BASES = {"v_files": "documents", "v_outputs": "documents", "v_pages": "conversations", "v_candidates": "lineitem", "v_truth": "embeddings", "v_pred": "embeddings", "v_quads": "embeddings", "v_timings": "events", "v_events": "events", "v_pool": "documents", "v_segments": "lineitem", "v_positions": "orders"}
USES = {"v_state": ("v_files",), "v_entries": ("v_state",)}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The capture table ``name`` over the tables in ``sf_dir``."""
    source = frame(spark, sf_dir, USES[name][0]) if name in USES else spark.read.parquet(f"{sf_dir}/{BASES[name]}.parquet")
    over = USES[name][0] if name in USES else BASES[name]
    text = VIEWS[name](Dialect(True)).replace(f" {over}", " {__base}")
    return spark.sql(text, __base=source)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the capture tables that it uses in front."""
    wanted: list[str] = []

    def add(n: str) -> None:
        for u in USES.get(n, ()):
            add(u)
        if n not in wanted:
            wanted.append(n)

    for n in names:
        add(n)
    head = ", ".join(f"{n} AS ({VIEWS[n](Dialect(False))})" for n in wanted)
    body = sql.strip()
    recursive = body.startswith("RECURSIVE")
    body = body.removeprefix("RECURSIVE").strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"
