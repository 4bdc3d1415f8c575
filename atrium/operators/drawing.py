"""Drawing operations to rings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atrium import params
from atrium.functions import geometry as geo

CURVE_STEPS = 6


def visible_paths(paths: DataFrame, window: tuple) -> DataFrame:
    """The filled paths of each page that the read window and the clip in force let through.

    ``paths``: page, seq, level, type (clip, group or a fill), filled, x0, y0, x1, y1. A clip holds for
    the deeper levels after it, until a row of its level or above; the innermost one counts. Boxes that
    only touch don't meet. The stack is a fold over a page's rows: pages are dealt by hash and their rows sorted on
    disk, and a task folds them as a stream, many pages a batch and a page of any length over several.
    """
    x0, y0, x1, y1 = window

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, clips = None, []
        for batch in batches:
            keep = []
            for of, level, kind, filled, *box in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("page", "level", "type", "filled", "x0", "y0", "x1", "y1"))):
                if of != page:
                    page, clips = of, []
                while clips and not clips[-1][0] < level:
                    clips.pop()
                if kind == "clip":
                    clips.append((level, box))
                meets = lambda o: max(o[0], box[0]) < min(o[2], box[2]) and max(o[1], box[1]) < min(o[3], box[3])  # noqa: E731, B023
                keep.append(kind not in ("clip", "group") and bool(filled) and meets((x0, y0, x1, y1)) and (not clips or meets(clips[-1][1])))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return paths.repartition("page").sortWithinPartitions("page", "seq").mapInArrow(scan, paths.schema)


def text_labels(spans: DataFrame, window: tuple, scale: float = params.M_PER_POINT, by_line: bool = False) -> DataFrame:
    """The labels of a page's text in metres: (page, block, line, pos, txt, x, y, size).

    ``spans``: page, block, line, pos, text, size, x0, y0, x1, y1 in points; those whose box meets the window
    count. Each span is a label, for codes, or each line, for names: its spans' texts in order with a space
    between, the middle of all their boxes, the largest size, and pos null. Blank labels are none.
    """
    x0, y0, x1, y1 = window
    rows = spans.where(f"greatest(x0, {x0}D) < least(x1, {x1}D) and greatest(y0, {y0}D) < least(y1, {y1}D)")
    if by_line:
        said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ")
        rows = rows.groupBy("page", "block", "line").agg(said.alias("text"), F.max("size").alias("size"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        rows = rows.withColumn("pos", F.lit(None).cast("int"))
    txt = F.regexp_replace("text", r"^\s+|\s+$", "")
    middle = lambda a, b, start: F.round(((F.col(a) + F.col(b)) / 2 - start) * scale, 3)
    out = rows.select("page", "block", "line", "pos", txt.alias("txt"), middle("x0", "x1", x0).alias("x"), middle("y0", "y1", y0).alias("y"), (F.col("size") * scale).alias("size"))
    return out.where("txt <> ''")


def flattened(op, points):
    """The points an operation adds: a cubic curve is CURVE_STEPS chords, others are as they stand."""
    p = geo.col(points)

    def bezier(i):
        t = i / F.lit(float(CURVE_STEPS))
        part = lambda c: (1 - t) * (1 - t) * (1 - t) * p[0][c] + 3 * (1 - t) * (1 - t) * t * p[1][c] + 3 * (1 - t) * t * t * p[2][c] + t * t * t * p[3][c]
        return geo.point(part("x"), part("y"))

    return F.when(geo.col(op) == "c", F.concat(F.slice(p, 1, 1), F.transform(F.sequence(F.lit(1), F.lit(CURVE_STEPS)), bezier))).otherwise(p)


def rings_of(ops: DataFrame, least_area: float = params.RING_MIN_AREA) -> DataFrame:
    """Rings (path_id, ring, points) of operations (path_id, seq, op, points).

    op: l (line), c (cubic curve, four points), re or qu (a closed shape of its own). A line or
    curve that doesn't start at the last point, and every closed shape, opens a ring. Rings of fewer
    than three points or of no more than ``least_area`` are gone; ring counts those that remain.
    """
    rows = ops.withColumn("pts", flattened("op", "points"))
    rows = rows.withColumns({"a": F.col("pts")[0], "z": F.element_at("pts", -1)})
    before = "lag({0}) over (partition by path_id order by seq)"
    rows = rows.selectExpr("*", f"case when op in ('re', 'qu') or coalesce({before.format('op')}, 're') in ('re', 'qu') or a <> {before.format('z')} then 1 else 0 end as opens")
    rows = rows.selectExpr("*", "sum(opens) over (partition by path_id order by seq) as part")
    tail = F.when(F.col("opens") == 1, F.col("pts")).otherwise(F.slice("pts", F.lit(2), F.greatest(F.size("pts") - 1, F.lit(0))))
    rings = rows.withColumn("tail", tail).groupBy("path_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "tail"))).alias("t"))
    points = F.flatten(F.transform("t", lambda r: r["tail"]))
    rings = rings.withColumn("p", points).withColumn("points", F.when((F.size("p") > 1) & (F.col("p")[0] == F.element_at("p", -1)), F.slice("p", F.lit(1), F.size("p") - 1)).otherwise(F.col("p")))
    rings = rings.where((F.size("points") >= 3) & (F.abs(geo.ring_area("points")) > least_area))
    return rings.selectExpr("path_id", "cast(row_number() over (partition by path_id order by part) as int) as ring", "points")
