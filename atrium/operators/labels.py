"""Labels on shapes: containment, nearest label, broken codes, rows and cuts.

Shapes meet labels by equi-joins on grid cells of CELL metres: a shape is listed in the cells its box
touches, a label in its own. So a label is compared with the shapes near it only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium import params
from atrium.functions import geometry as geo
from atrium.functions.text import title_case

CELL = 16


def cells_of_box(x0: str, y0: str, x1: str, y1: str, pad: float = 0.0) -> Column:
    """The grid cells that a padded box touches, as an array of (i, j)."""
    span = lambda a, b: f"sequence(cast(floor(({a} - {pad}D) / {CELL}) as int), cast(floor(({b} + {pad}D) / {CELL}) as int))"
    return F.expr(f"flatten(transform({span(x0, x1)}, i -> transform({span(y0, y1)}, j -> struct(i, j))))")


def cells_of_segment(ax: str, ay: str, bx: str, by: str) -> Column:
    """The grid cells that the boxes of a segment's pieces of at most a cell's length touch: as many as the segment is long."""
    n = f"greatest(1, cast(ceil(greatest(abs({bx} - {ax}), abs({by} - {ay})) / {CELL}) as int))"
    at = lambda a, b, k: f"{a} + ({b} - {a}) * {k} / {n}"
    span = lambda a, b: f"sequence(cast(floor(least({at(a, b, 'k')}, {at(a, b, '(k + 1)')}) / {CELL}) as int), cast(floor(greatest({at(a, b, 'k')}, {at(a, b, '(k + 1)')}) / {CELL}) as int))"
    return F.expr(f"array_distinct(flatten(transform(sequence(0, {n} - 1), k -> flatten(transform({span(ax, bx)}, i -> transform({span(ay, by)}, j -> struct(i, j)))))))")


def cell_of(x: str, y: str) -> Column:
    return F.expr(f"struct(cast(floor({x} / {CELL}) as int) as i, cast(floor({y} / {CELL}) as int) as j)")


def inside(shapes: DataFrame, labels: DataFrame, key: str = "venue") -> DataFrame:
    """Pairs of shapes (key, ord, ring, x0..y1) and labels (key, label_id, txt, x, y, size) inside them."""
    s = shapes.select(key, "ord", "ring", "x0", "y0", "x1", "y1", F.explode(cells_of_box("x0", "y0", "x1", "y1")).alias("cell"))
    near = labels.withColumn("cell", cell_of("x", "y")).join(s.hint("merge"), [key, "cell"])
    return near.where("x >= x0 and x <= x1 and y >= y0 and y <= y1").where(geo.in_ring("x", "y", "ring")).drop("cell", "ring", "x0", "y0", "x1", "y1")


def claim_codes(shapes: DataFrame, codes: DataFrame, key: str = "venue") -> DataFrame:
    """(key, ord, label_id, txt): each code goes to the first shape in drawing order that holds it."""
    found = inside(shapes, codes, key)
    return found.groupBy(key, "label_id", "txt").agg(F.min("ord").alias("ord")).select(key, "ord", "label_id", "txt")


def names_inside(shapes: DataFrame, labels: DataFrame, key: str = "venue", by: tuple = ("label_id",)) -> DataFrame:
    """(key, ord, name): texts of the labels inside each shape, in the given order, joined by a space."""
    found = inside(shapes, labels, key).groupBy(key, "ord").agg(F.array_sort(F.collect_list(F.struct(*by, F.col("txt").alias("_t")))).alias("t"))
    return found.select(key, "ord", F.nullif(F.trim(F.array_join(F.transform("t", lambda r: r["_t"]), " ")), F.lit("")).alias("name"))


def street_name(name) -> Column:
    """The name of a street arrow in upper case, or null if it isn't one."""
    n = F.col(name) if isinstance(name, str) else name
    return F.when(n.rlike(params.STREET_RE), F.upper(n))


def door_labels(labels: DataFrame) -> DataFrame:
    """The labels that name an entrance, exit or access."""
    return labels.where(F.col("txt").rlike(params.POI_WORDS_RE))


def with_directory(stands: DataFrame, directory: DataFrame, on: str = "code") -> DataFrame:
    """``stands`` with name: the title of their entry in the directory (``on``, name), null if there is none."""
    entries = directory.select(F.col(on), F.col("name").alias("_entry")).groupBy(on).agg(F.min("_entry").alias("_entry"))
    return stands.join(entries, on, "left").withColumn("name", title_case("_entry")).drop("_entry")


def nearest_label(points: DataFrame, labels: DataFrame, radius: float = params.POI_LABEL_RADIUS, key: str = "venue") -> DataFrame:
    """``points`` (key, ord, px, py) with the text of the nearest label closer than ``radius``, or null."""
    p = points.withColumn("cell", F.explode(cells_of_box("px", "py", "px", "py", radius)))
    near = p.join(labels.withColumn("cell", cell_of("x", "y")), [key, "cell"]).withColumn("d", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).where(F.col("d") < radius)
    best = near.groupBy(key, "ord").agg(F.min(F.struct("d", "label_id", "txt")).alias("m")).select(key, "ord", F.col("m.txt").alias("name"), F.col("m.d").alias("distance"))
    return points.join(best, [key, "ord"], "left")


def repair_codes(labels: DataFrame, key: str = "venue") -> DataFrame:
    """Codes broken over two labels, joined: (key, label_id, txt, joined).

    A tail lies at most 1.2 sizes below its head and within one size sideways, and both make a code.
    Heads in order take their first tail that is still free; the greedy pass runs over the pairs of a
    venue, in a small pandas kernel.
    """
    t = labels.select(F.col(key), F.col("label_id").alias("tail"), F.col("txt").alias("tail_txt"), F.col("x").alias("tx"), F.col("y").alias("ty"), cell_of("x", "y").alias("cell"))
    near = labels.withColumn("cell", F.explode(cells_of_box("x", "y", "x", "y", 3.0))).join(t, [key, "cell"])
    pairs = near.where("tail <> label_id and ty - y > 0 and ty - y <= 1.2 * size and abs(tx - x) <= size").where(F.concat("txt", "tail_txt").rlike(params.CODE_RE) & ~F.col("tail_txt").rlike(params.CODE_RE))
    pairs = pairs.select(key, "label_id", "tail", F.concat("txt", "tail_txt").alias("joined"))

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label_id", "tail"])
        heads, tails, keep = set(), set(), []
        for i, head, tail in zip(rows.index, rows["label_id"], rows["tail"]):
            if head not in heads and tail not in tails and head not in tails and tail not in heads:
                heads.add(head)
                tails.add(tail)
                keep.append(i)
        return rows.loc[keep, [key, "label_id", "tail", "joined"]]

    schema = f"{key} long, label_id long, tail long, joined string"
    done = pairs.groupBy(key).applyInPandas(greedy, schema)
    rest = labels.join(done.select(key, F.col("tail").alias("label_id")), [key, "label_id"], "left_anti")
    out = rest.join(done.select(key, "label_id", F.col("joined").alias("whole")), [key, "label_id"], "left")
    return out.withColumns({"joined": F.col("whole").isNotNull(), "txt": F.coalesce("whole", "txt")}).drop("whole")


def label_rows(labels: DataFrame, block: str, gap: str) -> DataFrame:
    """``labels`` with line: their row inside a block, a new one where y is more than ``gap`` below the row's first.

    A drawn block holds few labels: their heights are folded as one array of distinct values a block.
    """
    heights = labels.groupBy(block).agg(F.array_sort(F.collect_set("y")).alias("_ys"))
    start = F.expr("cast(array() as array<struct<y:double,line:int,first:double>>)")

    def fold(rows: Column, y: Column) -> Column:
        last = F.get(rows, F.size(rows) - 1)
        new = (F.size(rows) > 0) & (y - last["first"] > F.expr(gap))
        line = F.when(F.size(rows) == 0, 0).otherwise(last["line"] + new.cast("int"))
        first = F.when((F.size(rows) == 0) | new, y).otherwise(last["first"])
        return F.concat(rows, F.array(F.struct(y.alias("y"), line.alias("line"), first.alias("first"))))

    lines = heights.withColumn("_ys", F.transform("_ys", lambda y: y.cast("double"))).select(block, F.inline(F.aggregate("_ys", start, fold))).select(block, F.col("y").alias("_y"), "line")
    rows = labels.withColumn("_y", F.col("y").cast("double"))
    return rows.join(lines, [block, "_y"]).drop("_y")


def cut_at_midpoints(labels: DataFrame, block: str, line: str = "line") -> DataFrame:
    """``labels`` (x, y and their block's x0, y0, x1, y1) with the rectangle of each: cuts lie midway between
    neighbours of a line and between the lines' mean heights."""
    at = f"over (partition by {block}, {line} order by x, label_id)"
    cut = labels.selectExpr("*", f"coalesce((lag(x) {at} + x) / 2, x0) as xa", f"coalesce((lead(x) {at} + x) / 2, x1) as xb")
    heights = labels.groupBy(block, line).agg(F.avg("y").alias("h"), F.first("y0").alias("b0"), F.first("y1").alias("b1"))
    up = f"over (partition by {block} order by {line})"
    heights = heights.selectExpr(block, line, f"coalesce((lag(h) {up} + h) / 2, b0) as ya", f"coalesce((lead(h) {up} + h) / 2, b1) as yb")
    return cut.join(heights, [block, line])


def number_booths(booths: DataFrame, key: str = "venue") -> DataFrame:
    """``booths`` (cx, cy) with code TL01, TL02, ... by (cy / 2 rounded half to even, cx), in each venue."""
    rows = booths.selectExpr("*", f"row_number() over (partition by {key} order by bround(cy / 2), cx, ord) as nth")
    return rows.withColumn("booth", F.format_string("TL%02d", "nth")).drop("nth")
