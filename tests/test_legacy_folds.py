"""Greedy folds of the older map against plain passes."""

import random

from atrium.operators import legacy


def plain_weld(rows, gap, overlap, lo, hi, c0, c1):
    """Every pair in order; a later pair sees what an earlier one moved."""
    rows = [dict(r) for r in sorted(rows, key=lambda r: r["ord"])]
    for a in rows:
        for b in rows:
            if 0 < b[lo] - a[hi] < gap:
                shared = min(a[c1], b[c1]) - max(a[c0], b[c0])
                if shared >= overlap * min(a[c1] - a[c0], b[c1] - b[c0]):
                    a[hi] = b[lo] = round((a[hi] + b[lo]) / 2, 2)
    return rows


def test_weld_is_the_plain_pass(spark):
    rng = random.Random(7)
    rows = []
    for k in range(400):
        x, y = rng.uniform(0, 60), rng.choice([0.0, 1.0, 4.0, 7.5])
        rows.append({"row": k % 8, "ord": k, "x0": round(x, 1), "y0": y, "x1": round(x + rng.uniform(1, 6), 1), "y1": y + rng.uniform(1, 6)})
    schema = "row long, ord long, x0 double, y0 double, x1 double, y1 double"
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    for axis, names in (("x", ("x0", "x1", "y0", "y1")), ("y", ("y0", "y1", "x0", "x1"))):
        got = {r["ord"]: r.asDict() for r in legacy.weld(frame, axis=axis).collect()}
        want = {r["ord"]: r for n in range(8) for r in plain_weld([r for r in rows if r["row"] == n], 5.0, 0.5, *names)}
        assert got == want and got != {r["ord"]: r for r in rows}
    assert legacy.weld(frame.where("false")).count() == 0


def test_columns_are_packed_by_one_ordered_fold(spark):
    rng = random.Random(9)
    rows = []
    for k in range(500):
        x = round(rng.uniform(0, 80), 1)
        rows.append((k % 9, k, x, round(x + rng.uniform(0.5, 5), 1), rng.choice(["top", "bottom", "whole"])))
    want = {}
    for block in range(9):
        columns = []  # [x0, x1, sides] of each
        for _, o, x0, x1, side in sorted((r for r in rows if r[0] == block), key=lambda r: (r[2], r[1])):
            a = columns[-1] if columns else None
            if a and side not in a[2] and min(x1, a[1]) - max(x0, a[0]) > 0.5 * min(x1 - x0, a[1] - a[0]):
                a[2].append(side)
            else:
                columns.append([x0, x1, [side]])
            want[o] = len(columns) - 1
    got = legacy.pack_columns(spark.createDataFrame(rows, "block long, ord long, x0 double, x1 double, side string")).collect()
    assert {r["ord"]: r["column"] for r in got} == want and max(want.values()) > 5


def test_layouts_that_are_not_what_they_should_be_fail(spark):
    import pytest

    streets = [(0, "RUA A", 0.0, 60.0 * r, 50.0) for r in range(9)] + [(0, "RUA A", 70.0, 60.0 * r, 90.0) for r in range(9)]
    frame = spark.createDataFrame(streets, "venue long, name string, x0 double, y0 double, x1 double")
    shapes = spark.createDataFrame([(0, 50.0, 0.0, 70.0, 17.0), (0, -5.0, 480.0, 100.0, 500.0), (4, 1.0, 1.0, 2.0, 2.0)], "venue long, x0 double, y0 double, x1 double, y1 double")
    got = {(r["venue"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in legacy.straighten(shapes, frame, rows=9).collect()}
    assert got == {(0, 50.0, 0.0, 70.0, 17.0), (0, -5.0, 456.0, 100.0, 476.0), (4, 1.0, 1.0, 2.0, 2.0)}
    with pytest.raises(Exception, match="expected 10 rows"):
        legacy.straighten(shapes, frame).collect()
    close = frame.union(spark.createDataFrame([(0, "RUA B", 0.0, 66.0, 50.0)], frame.schema))  # a row inside another's height folds the axis
    with pytest.raises(Exception, match="don't rise"):
        legacy.straighten(shapes, close, rows=10).collect()
    with pytest.raises(ValueError):
        legacy.axis_warp("x0", [(0.0, 0.0), (5.0, 5.0), (4.0, 6.0)])


def test_welds_and_columns_go_on_over_batches(spark):
    """Groups are streamed, not a pandas call each, and one that a batch cuts is still one."""
    from atrium.operators.legacy import pack_columns, weld

    boxes = spark.range(3000).selectExpr("id div 7 as row", "id as ord", "cast(id % 7 * 10 as double) as x0", "0D as y0", "id % 7 * 10 + 8D - id % 3 as x1", "5D as y1")
    cells = boxes.selectExpr("row as block", "ord", "x0", "x0 + 11D + ord % 4 as x1", "y0", "y1", "case when ord % 3 = 0 then 'sul' else 'norte' end as side")
    got = []
    for size in ("10", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            welded, packed = weld(boxes), pack_columns(cells)
            assert not [p for p in (welded, packed) if "FlatMapGroupsInPandas" in p._jdf.queryExecution().executedPlan().toString()]
            got.append((sorted(tuple(r) for r in welded.collect()), sorted(tuple(r) for r in packed.collect())))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and len(got[0][0]) == len(got[0][1]) == 3000
    ends = {(r[0], r[1]): (r[2], r[4]) for r in got[0][0]}  # neighbours share the middle of their gap
    assert all(ends[r, n][1] == ends[r, n + 1][0] for r, n in ends if (r, n + 1) in ends)
