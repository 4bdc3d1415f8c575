"""Clips of drawings against a plain fold, page after page."""

import random

from atrium.operators import drawing

WINDOW = (5.0, 0.0, 90.0, 50.0)
SCHEMA = "page long, seq long, level int, type string, filled boolean, x0 double, y0 double, x1 double, y1 double"


def plain_scan(rows):
    out, clips = set(), []
    for n, (page, seq, level, kind, filled, *box) in enumerate(rows):
        if not n or page != rows[n - 1][0]:
            clips = []
        clips = [c for c in clips if c[0] < level] + ([(level, box)] if kind == "clip" else [])
        over = [WINDOW] + [c[1] for c in clips[-1:]]
        if kind == "f" and filled and all(max(o[0], box[0]) < min(o[2], box[2]) and max(o[1], box[1]) < min(o[3], box[3]) for o in over):
            out.add((page, seq))
    return out


def test_pages_are_folded_as_a_stream(spark):
    """Pages go by many at a time, and one longer than a batch over several: no task or batch for each page."""
    rng = random.Random(4)
    rows = []
    for page in range(60):
        for seq in range(200 if page == 7 else rng.randint(1, 9)):
            x, y = rng.uniform(-10, 100), rng.uniform(-10, 60)
            rows.append((page, seq, rng.randint(0, 4), rng.choice(["clip", "group", "f", "f"]), rng.choice([True, True, None, False]), x, y, x + rng.uniform(1, 60), y + rng.uniform(1, 40)))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        found = drawing.visible_paths(spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA), WINDOW)
        assert {(r["page"], r["seq"]) for r in found.collect()} == plain_scan(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
