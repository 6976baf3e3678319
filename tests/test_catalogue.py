"""Every query against its SQL on the smallest tables."""

import math
from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from leafplan.plans.catalogue import ORACLE_SQL, QUERIES, edge_segments

from .conftest import DATA


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(f"{v:.6g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cursor.description]
    assert sorted(cols) == names
    want = sorted((tuple(normal(r[cols.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_edge_segments_of_all_images(spark):
    """Images far from each other are compared with plain loops."""
    box = [(150.0, 120.0), (850.0, 130.0), (840.0, 680.0), (150.0, 690.0)]
    images = (3, 499, 500, 501, 1999, 70_000)
    lines = [(k, 100.0 + 37 * k, 90.0 + 53 * k % 640, 100.0 + 37 * k + dx, 90.0 + 53 * k % 640 + dy) for k, (dx, dy) in enumerate([(300.0, 10.0), (5.0, 250.0), (200.0, 190.0), (-280.0, 20.0), (12.0, -300.0), (400.0, 60.0), (-8.0, 330.0), (90.0, 5.0)] * 2, 1)]
    truth = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in box]) for i in images], "sample_id long, corners array<struct<x double, y double>>")
    segments = spark.createDataFrame([(i, *x) for i in images for x in lines], "image_id long, segment_id int, x1 double, y1 double, x2 double, y2 double")
    turn = lambda ax, ay, bx, by: math.degrees(math.atan2(by - ay, bx - ax)) % 180
    want = set()
    for k, ((px, py), (qx, qy)) in enumerate(zip(box, box[1:] + box[:1])):
        for s, x1, y1, x2, y2 in lines:
            gap = abs(turn(x1, y1, x2, y2) - turn(px, py, qx, qy))
            if min(gap, 180 - gap) <= 20 and math.hypot((x1 + x2 - px - qx) / 2, (y1 + y2 - py - qy) / 2) <= 250:
                want |= {(i, k, s) for i in images}
    assert {k for _, k, _ in want} == {0, 1, 2, 3}
    got = [tuple(r) for r in edge_segments(truth, segments).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.fixture(scope="module")
def close_scores(tmp_path_factory):
    """A folder with line items whose scores are halves of the sixth place, or ties of which a sum of doubles may be a bit off."""
    rows = [(k, 100 + k % 3, 7, j, q, price, discount, tax, "A", line) for k, (q, price, d, line) in enumerate((q, price, d, line) for q in (7.0, 13.0, 22.0, 31.0, 46.0) for price in (901.37, 20498.16, 97659.1) for d in range(10) for line in "FO") for j, discount, tax in ((1, round(d / 100 + 0.01, 2), 0.0), (2, d / 100, 0.08))]
    rows += [(1000, 48048, 2900, 4, 14.0, 20498.16, 0.1, 0.03, "R", "O"), (1001, 46560, 2904, 6, 37.0, 62295.96, 0.06, 0.08, "A", "O"), (1002, 6560, 904, 6, 37.0, 62295.96, 0.06, 0.08, "A", "O")]
    # Halves in the product alone, not in the decimal text, and two candidates right at the wide margin.
    rows += [(1003, 622560, 31872, 2, 15.0, 21814.95, 0.05, 0.02, "A", "O"), (1004, 159048, 45984, 6, 20.0, 991.76, 0.05, 0.03, "N", "O")]
    rows += [(1005, 572817, 12907, 3, 16.0, 42272.57, 0.03, 0.05, "N", "F"), (1005, 197610, 56209, 5, 33.0, 14122.57, 0.06, 0.02, "A", "F")]
    names = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()
    folder = tmp_path_factory.mktemp("close")
    pq.write_table(pa.table({**{n: list(v) for n, v in zip(names, zip(*rows))}, "l_shipdate": [datetime(1997, 10, 6)] * len(rows)}), folder / "lineitem.parquet")
    return str(folder)


def same_to_the_bit(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{folder}/lineitem.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cursor.description]
    assert sorted(map(tuple, QUERIES[name](spark, folder).select(*cols).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_ranking_of_close_scores(spark, close_scores):
    same_to_the_bit(spark, close_scores, "candidate_ranking")


@pytest.mark.parametrize("name", ["candidate_sweep", "candidate_decisions"])
def test_decisions_of_close_scores(spark, close_scores, name):
    same_to_the_bit(spark, close_scores, name)
