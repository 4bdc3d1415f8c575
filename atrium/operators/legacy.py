"""Operators of the older, declarative map: warps, snapping, sessions, rows, rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium import params
from atrium.functions import geometry as geo
from atrium.functions.text import ascii_fold, title_case

from .classify import first_colour
from .labels import cells_of_box


def axis_warp(value: str, knots: list[tuple[float, float]], tail: float = 1.0) -> Column:
    """Piecewise-linear map of a column through its knots (from, to); beyond them the slope is ``tail``.

    Knots must rise on both sides: a warp that folds the axis raises.
    """
    if any(c <= a or d <= b for (a, b), (c, d) in zip(knots, knots[1:])):
        raise ValueError("the knots don't rise")
    (a0, b0), (az, bz) = knots[0], knots[-1]
    v = F.col(value)
    out = F.when(v <= a0, (v - a0) * tail + b0)
    for (a, b), (c, d) in zip(knots, knots[1:]):
        out = out.when(v <= c, b + (v - a) * ((d - b) / (c - a)))
    return out.otherwise((v - az) * tail + bz)


def rising(knots: Column) -> Column:
    """The knots (old, new) as they are, if they rise on both sides; else the job fails, since a warp would fold the axis."""
    pairs = F.zip_with(F.slice(knots, F.lit(1), F.size(knots) - 1), F.slice(knots, F.lit(2), F.size(knots) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    falls = F.exists(pairs, lambda s: (s["q"]["old"] <= s["p"]["old"]) | (s["q"]["new"] <= s["p"]["new"]))
    return F.when(F.size(knots) < 2, knots).when(~falls, knots).otherwise(F.raise_error(F.lit("the knots don't rise")).cast("array<struct<old:double,new:double>>"))


def row_knots(streets: DataFrame, rows: int = params.HALL_ROWS, key: str = "venue") -> DataFrame:
    """(key, ys): the knots that set a hall's street rows at an even pitch, a row and a band high, from the first on.

    ``streets``: key, name, x0, y0, x1. Those of the hall, named and west of HALL_X, whose tops round to the same
    ten make a row, as high as their mean. A hall that hasn't ``rows`` of them fails the job.
    """
    hall = streets.where(f"name is not null and x0 < {params.HALL_X}").groupBy(key, F.bround(F.col("y0") / 10).alias("_row")).agg(F.avg("y0").alias("y"))
    per = hall.groupBy(key).agg(F.array_sort(F.collect_list("y")).alias("y"))
    y = F.when(F.size("y") == rows, F.col("y")).otherwise(F.raise_error(F.concat(F.lit(f"expected {rows} rows of streets, found "), F.size("y"))).cast("array<double>"))
    per = per.select(key, y.alias("y"))
    knot = lambda old, new: F.struct(old.alias("old"), new.alias("new"))
    at = lambda i: F.col("y")[0] + i * (params.ROW_HIGH + params.BAND_HIGH)
    both = F.transform("y", lambda v, i: F.array(knot(v, at(i)), knot(v + params.ROW_HIGH, at(i) + params.ROW_HIGH)))
    return per.select(key, rising(F.flatten(both)).alias("ys"))


def aisle_knots(streets: DataFrame, key: str = "venue") -> DataFrame:
    """(key, xs): the knots that make a hall's aisles AISLE_WIDE, each around the middle it has now.

    Gaps of AISLE_GAP between neighbouring streets of a row, whose middles follow each other closer than
    AISLE_APART, are one aisle: its sides and middle are their means.
    """
    hall = streets.where(f"name is not null and x0 < {params.HALL_X}").withColumn("_row", F.bround(F.col("y0") / 10))
    gaps = hall.selectExpr(key, "x1 as west", f"lead(x0) over (partition by {key}, _row order by x0) as east").where(f"east - west > {params.AISLE_GAP[0]} and east - west < {params.AISLE_GAP[1]}").withColumn("mid", F.expr("(west + east) / 2"))
    # Middles are counted first: what is ordered is a hall's distinct gaps.
    gaps = gaps.groupBy(key, "mid", "west", "east").agg(F.count("*").alias("n"))
    gaps = gaps.selectExpr("*", f"case when mid - lag(mid) over (partition by {key} order by mid, west, east) < {params.AISLE_APART} then 0 else 1 end as opens")
    gaps = gaps.selectExpr("*", f"sum(opens) over (partition by {key} order by mid, west, east) as aisle")
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    per = gaps.groupBy(key, "aisle").agg(mean("west"), mean("mid"), mean("east"))
    knots = F.expr(f"array(struct(west as old, mid - {params.AISLE_WIDE / 2}D as new), struct(east as old, mid + {params.AISLE_WIDE / 2}D as new))")
    return per.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(knots))).alias("xs")).select(key, rising(F.col("xs")).alias("xs"))


def warped(value, knots) -> Column:
    """Piecewise-linear map of a column through an array of knots (old, new); beyond them a shift. No knots, no change."""
    v, k = geo.col(value), geo.col(knots)
    legs = F.zip_with(F.slice(k, F.lit(1), F.size(k) - 1), F.slice(k, F.lit(2), F.size(k) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    leg = F.get(F.filter(legs, lambda s: v <= s["q"]["old"]), F.lit(0))
    first, last = F.get(k, F.lit(0)), F.get(k, F.size(k) - 1)
    inner = leg["p"]["new"] + (v - leg["p"]["old"]) / (leg["q"]["old"] - leg["p"]["old"]) * (leg["q"]["new"] - leg["p"]["new"])
    return F.when(k.isNull() | (F.size(k) == 0), v).when(v <= first["old"], v + first["new"] - first["old"]).when(v >= last["old"], v + last["new"] - last["old"]).otherwise(inner)


def straighten(shapes: DataFrame, streets: DataFrame, rows: int = params.HALL_ROWS, key: str = "venue") -> DataFrame:
    """``shapes`` (key, x0, y0, x1, y1) on the regular grid of their hall's ``streets``: rows at an even pitch, aisles of one
    width. A hall is one row of knots, which its shapes meet by a join."""
    knots = row_knots(streets, rows, key).join(aisle_knots(streets, key), key, "left")
    both = shapes.join(knots, key, "left")
    return both.withColumns({c: F.round(warped(c, "xs" if c[0] == "x" else "ys"), 2) for c in ("x0", "y0", "x1", "y1")}).drop("xs", "ys")


def row_pitch(rows: DataFrame, street: float, band: float, key: str = "venue") -> DataFrame:
    """``rows`` (key, row, y) with target: the first stays, each further one lies a street and a band below the last."""
    nth = F.expr(f"row_number() over (partition by {key} order by y, row) - 1")
    return rows.withColumn("target", F.expr(f"first(y) over (partition by {key} order by y, row)") + nth * (street + band))


def on_map(box: tuple = ("x0", "y0", "x1", "y1")) -> Column:
    """Whether a shape belongs to the plan: large enough, outside the legend, between decoration and list, not in the corner."""
    x0, y0, x1, y1 = (F.col(c) for c in box)
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    a, b, c, d = params.LEGEND_BOX
    large = (x1 - x0 >= params.SHAPE_SIDE) & (y1 - y0 >= params.SHAPE_SIDE)
    legend = (cx >= a) & (cx <= c) & (cy >= b) & (cy <= d)
    return large & ~legend & (y0 < params.LIST_Y) & (y0 > params.DECOR_Y) & ~((cx > params.CORNER[0]) & (cy < params.CORNER[1]))


def colour_kind(r="r", g="g", b="b", area="area") -> Column:
    """The category of a shape by its colour: stands, then areas, then the pale outer ground if it is large."""
    pale = F.when(F.col(area) > params.LEGACY_PALE_AREA, first_colour(r, g, b, [(params.LEGACY_PALE, "externo")], params.LEGACY_PALE_TOL))
    return F.coalesce(first_colour(r, g, b, params.LEGACY_STANDS, params.LEGACY_TOL), first_colour(r, g, b, params.LEGACY_AREAS, params.LEGACY_TOL), pale)


def is_marker(w="w", h="h", cx="cx", r="r", g="g", b="b") -> Column:
    """A thin upright strip of a vivid colour at the rows' western end."""
    chroma = F.greatest(r, g, b) - F.least(r, g, b)
    return F.col(w).between(*params.MARKER_WIDTH) & F.col(h).between(*params.MARKER_HEIGHT) & (F.col(cx) < params.MARKER_X) & (chroma > params.MARKER_CHROMA)


def is_decoration(has_text: Column, cat="cat", w="w", h="h") -> Column:
    """A shape without text that is too thin or too small to be a place; markers and outer ground are none."""
    small = (F.least(w, h) < params.DECOR_SIDE) | (F.col(w) * F.col(h) < params.DECOR_AREA)
    return ~has_text & ~F.coalesce(F.col(cat).isin("marcador", "externo"), F.lit(False)) & small


def flattened_ring(ring: str, snapped: str) -> Column:
    """A ring's box in its place if it was snapped, has at most five points or nearly fills the box; else the ring."""
    b = geo.ring_bbox(ring)
    flat = F.col(snapped) | (F.size(ring) <= 5) | (geo.fill_ratio(ring) > 0.92)
    return F.when(flat, geo.rectangle(b["x0"], b["y0"], b["x1"], b["y1"])).otherwise(F.col(ring))


def composition(ops: DataFrame) -> DataFrame:
    """(ops, n): how often each sequence of drawing operations (path_id, seq, op) makes a path."""
    paths = ops.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "op"))), lambda o: o["op"]), "").alias("ops"))
    return paths.groupBy("ops").agg(F.count("*").alias("n"))


def fixed_typos(stands: DataFrame, typos: list[tuple[str, str, str]], key: str = "venue") -> DataFrame:
    """``stands`` (key, ord, code, x0, y0) with misprinted codes mended: where exactly two have the old code and none
    the new one, that with the largest x0 or y0 (of equals the later) takes the new."""
    for old, new, axis in typos:
        found = F.expr(f"sum(case when code = '{old}' then 1 else 0 end) over (partition by {key}) = 2 and max(case when code = '{new}' then 1 else 0 end) over (partition by {key}) = 0")
        last = F.expr(f"row_number() over (partition by {key}, code order by {axis} desc, ord desc) = 1")
        stands = stands.withColumn("code", F.when(found & last & (F.col("code") == old), new).otherwise(F.col("code")))
    return stands


def split_fused(words: DataFrame) -> DataFrame:
    """``words`` (txt, x0, y0, x1, y1) with two fused artists' codes as two words, each with half of the box."""
    part = lambda n: F.regexp_extract("txt", r"^(TI[0-9]{2})(TI[0-9]{2})$", n)
    middle = (F.col("x0") + F.col("x1")) / 2
    halves = F.array(F.struct(part(1).alias("txt"), F.col("x0"), middle.alias("x1")), F.struct(part(2).alias("txt"), middle.alias("x0"), F.col("x1")))
    whole = F.array(F.struct("txt", "x0", "x1"))
    rows = words.withColumn("_w", F.explode(F.when(part(1) != "", halves).otherwise(whole)))
    return rows.select(*[F.col("_w")[c].alias(c) if c in ("txt", "x0", "x1") else F.col(c) for c in words.columns])


def missing_numbers(found: DataFrame, most: int) -> DataFrame:
    """(n): the numbers from 1 to ``most`` that ``found`` (n) lacks."""
    return found.sparkSession.range(1, most + 1).select(F.col("id").alias("n")).join(found.select(F.col("n").cast("long")).distinct(), "n", "left_anti")


def annex_box(anchored: DataFrame, from_x: float, pad: float = 4.0, key: str = "venue") -> DataFrame:
    """The padded box around what stands east of ``from_x``."""
    return anchored.where(F.col("x0") > from_x).groupBy(key).agg((F.min("x0") - pad).alias("x0"), (F.min("y0") - pad).alias("y0"), (F.max("x1") + pad).alias("x1"), (F.max("y1") + pad).alias("y1"))


def keep_smallest(areas: DataFrame, key: str = "venue") -> DataFrame:
    """``areas`` (key, ord, code, x0..y1) where of those that share a code only the smallest, the first of equals, keeps it."""
    nth = F.expr(f"row_number() over (partition by {key}, code order by (x1 - x0) * (y1 - y0), ord)")
    return areas.withColumn("code", F.when(nth == 1, F.col("code")))


def synthetic_lanes(missing: DataFrame, lanes: DataFrame, key: str = "venue") -> DataFrame:
    """Lanes for names that stand alone (key, ord, name, cx, cy): as high as the nearest lane of the name, as wide as
    the nearest lane above or below. ``lanes``: key, lane, name, x0..y1. Without either there is none."""
    l = lanes.selectExpr(key, "lane", "name as lname", "x0", "y0", "x1", "y1", "(y0 + y1) / 2 as ly")  # noqa: E741
    near = F.struct(F.abs(F.col("ly") - F.col("cy")), F.col("lane"))
    sib = missing.join(l.withColumnRenamed("lname", "name").hint("merge"), [key, "name"]).groupBy(key, "ord").agg(F.min_by(F.struct("y0", "y1"), near).alias("s"))
    cells = lambda df, a, b: df.withColumn("cell", F.explode(F.expr(f"sequence(cast(floor({a} / 16) as int), cast(floor({b} / 16) as int))")))
    col = cells(missing, "cx", "cx").join(cells(l, "x0", "x1").hint("merge"), [key, "cell"]).where("cx between x0 and x1").groupBy(key, "ord").agg(F.min_by(F.struct("x0", "x1"), near).alias("c"))
    return missing.join(sib.hint("merge"), [key, "ord"]).join(col.hint("merge"), [key, "ord"]).select(key, "ord", "name", "c.x0", "s.y0", "c.x1", "s.y1")


def fit_highlights(cells: DataFrame, bands: DataFrame, gap: float = 5.0, key: str = "venue") -> DataFrame:
    """``cells`` (key, ord, cat, x0..y1) with highlighted ones (sponsors and institutions) fitted to their band.

    ``bands``: key, band, top, bottom; the first band whose range, three wider, holds a cell's middle. A
    highlight takes the height that most exhibitors of the band have, or the half of it nearer to it where
    another highlight shares over half of its width; then its sides meet neighbours within ``gap``.
    """
    middle = cells.withColumn("cy", F.expr("(y0 + y1) / 2"))
    listed = bands.withColumn("m", F.explode(F.expr("sequence(cast(floor(top - 3) as int), cast(ceil(bottom + 3) as int))")))
    hit = middle.withColumn("m", F.floor("cy").cast("int")).join(listed.hint("merge"), [key, "m"]).where("cy between top - 3 and bottom + 3")
    placed = middle.join(hit.groupBy(key, "ord").agg(F.min("band").alias("band")).hint("merge"), [key, "ord"]).join(bands, [key, "band"])
    edge = lambda c: placed.where("cat = 'expositor'").groupBy(key, "band", F.round(c, 1).alias("v")).agg(F.count("*").alias("n"), F.min("ord").alias("f")).groupBy(key, "band").agg(F.min(F.struct((-F.col("n")).alias("n"), "f", "v")).alias("m")).select(key, "band", F.col("m.v").alias(f"mode_{c}"))
    high = placed.where("cat in ('patrocinador', 'entidade')").join(edge("y0"), [key, "band"], "left").join(edge("y1"), [key, "band"], "left")
    high = high.withColumns({"top": F.coalesce("mode_y0", "top"), "bottom": F.coalesce("mode_y1", "bottom")}).withColumn("half", F.expr("(top + bottom) / 2"))
    other = high.selectExpr(key, "band", "ord as o", "x0 as ox0", "x1 as ox1")
    stacked = high.join(other, [key, "band"]).where("o <> ord and least(x1, ox1) - greatest(x0, ox0) > 0.5 * least(x1 - x0, ox1 - ox0)").select(key, "ord").distinct().withColumn("stacked", F.lit(True))
    high = high.join(stacked, [key, "ord"], "left")
    high = high.withColumns({"y0": F.expr("case when stacked and cy >= half then half else top end"), "y1": F.expr("case when stacked and cy < half then half else bottom end")})
    beside = middle.selectExpr(key, "ord as o", "x0 as ox0", "x1 as ox1", "y0 as oy0", "y1 as oy1").withColumn("cell", F.explode(cells_of_box("ox0", "oy0", "ox1", "oy1")))
    near = high.select(key, "ord", "x0", "y0", "x1", "y1", F.explode(cells_of_box("x0", "y0", "x1", "y1", gap)).alias("cell")).join(beside.hint("merge"), [key, "cell"]).where("o <> ord and least(y1, oy1) - greatest(y0, oy0) >= 0.5 * (y1 - y0)")
    sides = near.groupBy(key, "ord").agg(F.max(F.expr(f"case when x0 - ox1 > 0 and x0 - ox1 < {gap} then ox1 end")).alias("west"), F.min(F.expr(f"case when ox0 - x1 > 0 and ox0 - x1 < {gap} then ox0 end")).alias("east"))
    fitted = high.join(sides, [key, "ord"], "left").select(key, "ord", F.coalesce("west", "x0").alias("fx0"), F.col("y0").alias("fy0"), F.coalesce("east", "x1").alias("fx1"), F.col("y1").alias("fy1"))
    out = cells.join(fitted.hint("merge"), [key, "ord"], "left")
    return out.withColumns({c: F.coalesce(f"f{c}", c) for c in ("x0", "y0", "x1", "y1")}).drop("fx0", "fy0", "fx1", "fy1")


def import_structure(cells: DataFrame, bands: DataFrame, gap: float = 8.0, key: str = "venue") -> DataFrame:
    """Drawn cells (key, ord, code, x0..y1) as the declarative map's structure: band, block, column, side, width and
    the block's offset; a cell in no band comes back with nulls. ``bands``: key, band, top, bottom."""
    middle = cells.withColumn("cy", F.expr("(y0 + y1) / 2"))
    listed = bands.withColumn("m", F.explode(F.expr("sequence(cast(floor(top - 3) as int), cast(ceil(bottom + 3) as int))")))
    hit = middle.withColumn("m", F.floor("cy").cast("int")).join(listed.hint("merge"), [key, "m"]).where("cy between top - 3 and bottom + 3")
    first = hit.groupBy(key, "ord").agg(F.min("band").alias("band"))
    rows = middle.join(first.hint("merge"), [key, "ord"]).join(bands, [key, "band"]).withColumn("row", F.xxhash64(key, "band"))
    side = F.when(F.expr("y1 - y0 > 0.75 * (bottom - top)"), "cheia").when(F.expr("cy < (top + bottom) / 2"), "norte").otherwise("sul")
    blocks = gap_blocks(rows.withColumn("side", side), gap).withColumn("unit", F.xxhash64("row", "block"))
    packed = pack_columns(blocks, "unit").withColumn("offset", F.expr("min(x0) over (partition by unit)"))
    return cells.select(key, "ord", "code").join(packed.selectExpr(key, "ord", "band", "block", "column", "side", "x1 - x0 as width", "offset").hint("merge"), [key, "ord"], "left")


def generate(cells: DataFrame, streets: DataFrame, key: str = "venue") -> DataFrame:
    """The declarative map as boxes (key, kind, name, x0, y0, x1, y1) out of its structure.

    ``cells``: key, row, block, offset, column, side, width, code; ``streets``: key, row, name, nth (from
    0, north to south; a street lies above its row). Rows are a street and a band high; columns of a block
    stand side by side; halves share a column. Streets reach a ring around the whole, with an axis where
    blocks are; gaps of AISLE_MIN to AISLE_MAX between blocks of a row are aisles.
    """
    rows = streets.withColumn("y", F.col("nth") * (params.STREET_M + params.BAND_M))
    columns = cells.groupBy(key, "row", "block", "column").agg(F.max("width").alias("w"), F.min("offset").alias("offset"))
    columns = columns.withColumn("x", F.expr(f"offset + coalesce(sum(w) over (partition by {key}, row, block order by column rows between unbounded preceding and 1 preceding), 0)"))
    blocks = columns.groupBy(key, "row", "block").agg(F.min("x").alias("x0"), F.max(F.expr("x + w")).alias("x1")).join(rows, [key, "row"])
    whole = blocks.groupBy(key).agg((F.min("x0") - params.AISLE_M).alias("west"), (F.max("x1") + params.AISLE_M).alias("east"), F.min("y").alias("north"), (F.max("y") + params.STREET_M + params.BAND_M).alias("south"))
    top = f"y + {params.STREET_M} + ({params.BAND_M} - {params.CELL_M}) / 2"
    box = lambda df, kind, name, *sides: df.select(key, F.lit(kind).alias("kind"), F.expr(name).alias("name"), *[F.expr(s).cast("double").alias(c) for s, c in zip(sides, ("x0", "y0", "x1", "y1"))])
    placed = cells.join(columns.select(key, "row", "block", "column", "x"), [key, "row", "block", "column"]).join(rows, [key, "row"])
    upper, lower = f"case when side = 'sul' then {top} + {params.CELL_M} / 2 else {top} end", f"case when side = 'norte' then {top} + {params.CELL_M} / 2 else {top} + {params.CELL_M} end"
    per_row = blocks.groupBy(key, "row").agg(F.min("x0").alias("a"), F.max("x1").alias("b"))
    roads = rows.withColumnRenamed("name", "street").join(whole, key)
    aisles = blocks.withColumn("next", F.expr(f"lead(x0) over (partition by {key}, row order by block)")).where(f"next - x1 > {params.AISLE_MIN} and next - x1 <= {params.AISLE_MAX}")
    parts = [
        box(roads, "rua", "street", "west", "y", "east", f"y + {params.STREET_M}"),
        box(roads.join(per_row, [key, "row"]), "rua-eixo", "street", "a", f"y + {params.STREET_M} / 2", "b", f"y + {params.STREET_M} / 2"),
        box(placed, "estande", "code", "x", upper, "x + width", lower),
        box(blocks, "quadra", "cast(null as string)", "x0", top, "x1", f"{top} + {params.CELL_M}"),
        box(aisles, "rua", "cast(null as string)", "x1", f"y + {params.STREET_M}", "next", f"y + {params.STREET_M} + {params.BAND_M}"),
        box(whole, "rua", "cast(null as string)", f"west - {params.AISLE_M}", "north", "west", "south"),
        box(whole, "rua", "cast(null as string)", "east", "north", f"east + {params.AISLE_M}", "south"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def generate_anchored(areas: DataFrame, stands: DataFrame, streets: DataFrame, places: DataFrame, exhibitors: DataFrame, booths: DataFrame, key: str = "venue") -> DataFrame:
    """What the declarative map sets down by position: (key, kind, cat, code, name, weight, mini, x0, y0, x1, y1).

    ``areas`` (key, cat, code, name, x, y, w, h) with their size as weight; ``stands`` (key, cat, code, x, y, w, h) named
    by code from ``exhibitors`` (code, name), codes TL and a number from ``booths`` (n, name), and mini if a side is
    under MINI_SIDE; ``streets`` of the annex (key, name, x, y, w, h), each a box and its axis; ``places`` (key, cat,
    name, x, y), points. Stands beyond ANNEX_M get one floor a venue, as far as they reach and ANNEX_RIM around.
    """
    box = {"x0": "x", "y0": "y", "x1": "x + w", "y1": "y + h"}
    none = {"cat": "cast(null as string)", "code": "cast(null as string)", "name": "cast(null as string)", "weight": "cast(null as double)", "mini": "cast(null as boolean)"}

    def made(df: DataFrame, kind: str, sides: dict = box, **own: str) -> DataFrame:
        return df.select(key, F.lit(kind).alias("kind"), *[F.expr(e).alias(c) for c, e in {**none, **own}.items()], *[F.expr(e).cast("double").alias(c) for c, e in sides.items()])

    number = F.when(F.col("code").startswith("TL"), F.expr("try_cast(substring(code, 3) as int)"))
    by_code = exhibitors.groupBy("code").agg(F.min("name").alias("_entry"))
    by_number = booths.groupBy(F.col("n").cast("int").alias("_n")).agg(F.min("name").alias("_booth"))
    named = stands.withColumn("_n", number).join(by_code, "code", "left").join(by_number, "_n", "left")
    named = named.withColumn("name", title_case(F.when(F.col("code").startswith("TL"), F.col("_booth")).otherwise(F.col("_entry"))))
    floor = stands.where(F.col("x") > params.ANNEX_M).groupBy(key).agg(*[F.expr(e).alias(c) for c, e in {"x": "min(x)", "y": "min(y)", "e": "max(x + w)", "s": "max(y + h)"}.items()])
    rim, middle = params.ANNEX_RIM, "y + h / 2"
    out = made(areas, "area", cat="cat", code="code", name="name", weight="round(w * h, 1)")
    for more in (
        made(floor, "piso", {"x0": f"x - {rim}", "y0": f"y - {rim}", "x1": f"e + {rim}", "y1": f"s + {rim}"}),
        made(named, "estande", cat="cat", code="code", name="name", mini=f"w < {params.MINI_SIDE} or h < {params.MINI_SIDE}"),
        made(streets, "rua", name="name"), made(streets, "rua-eixo", {**box, "y0": middle, "y1": middle}, name="name"),
        made(places, "poi", {"x0": "x", "y0": "y", "x1": "x", "y1": "y"}, cat="cat", name="name"),
    ):
        out = out.unionByName(more)
    return out


def quantise(value: str, lines: list[float], tol: float = 4.0) -> Column:
    """The first of the lines within ``tol``, not the nearest; else the value."""
    return F.coalesce(F.get(F.filter(F.array(*[F.lit(float(x)) for x in lines]), lambda x: F.abs(F.col(value) - x) < tol), F.lit(0)), F.col(value))


def gap_blocks(cells: DataFrame, gap: float, by: str = "row") -> DataFrame:
    """``cells`` (row, x0, x1) with block: a new one where the gap to all before exceeds ``gap``."""
    rows = cells.selectExpr("*", f"max(x1) over (partition by {by} order by x0, ord rows between unbounded preceding and 1 preceding) as reach")
    return rows.selectExpr("*", f"cast(sum(case when x0 - reach > {gap} then 1 else 0 end) over (partition by {by} order by x0, ord) as int) as block").drop("reach")


def merge_intervals(spans: DataFrame, gap: float, by: str = "row") -> DataFrame:
    """(row, x0, x1) with spans closer than ``gap`` made one."""
    blocks = gap_blocks(spans, gap, by)
    return blocks.groupBy(by, "block").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("block")


def sessionise(tokens: DataFrame, starts: Column, gap: float) -> DataFrame:
    """``tokens`` (line, x0, x1, ord) with entry: a new one at a token that ``starts`` one (it sees ``space``, the gap
    before it, null at a line's first) or after a gap over ``gap``."""
    rows = tokens.selectExpr("*", "x0 - lag(x1) over (partition by line order by x0, ord) as space")
    rows = rows.withColumn("_new", F.when(F.col("space").isNull() | (F.col("space") > gap) | starts, 1).otherwise(0))
    return rows.selectExpr("*", "sum(_new) over (partition by line order by x0, ord) as entry").drop("_new")


def sequence_breaks(cells: DataFrame) -> DataFrame:
    """Cells (row, pos, number) against their row's dominant direction; ties go down, rows of under three values pass."""
    rows = cells.selectExpr("*", "number - lag(number) over (partition by row order by pos) as step")
    per = rows.groupBy("row").agg(F.sum(F.signum("step")).alias("s"), F.count("*").alias("n"))
    return rows.join(per, "row").where("n >= 3 and step is not null and (case when s > 0 then step <= 0 else step >= 0 end)").select("row", "pos", "number", "step")


def covered_anti(loose: DataFrame, coded: DataFrame, share: float = 0.6, key: str = "venue") -> DataFrame:
    """``loose`` boxes (key, ord, box) of which no coded box covers more than ``share``."""
    c = coded.select(F.col(key), *[F.col(x).alias(f"c{x}") for x in ("x0", "y0", "x1", "y1")], F.explode(cells_of_box("x0", "y0", "x1", "y1")).alias("cell"))
    near = loose.withColumn("cell", F.explode(cells_of_box("x0", "y0", "x1", "y1"))).join(c, [key, "cell"])
    hit = near.where(geo.overlap_share(("x0", "y0", "x1", "y1"), ("cx0", "cy0", "cx1", "cy1")) > share).select(key, "ord").distinct()
    return loose.join(hit, [key, "ord"], "left_anti")


def fuzzy_duplicates(areas: DataFrame, reach: float = 8.0, key: str = "venue") -> DataFrame:
    """(key, ord, of): areas (key, ord, name, x, y) that go, since one of the same folded name that stays lies less
    than ``reach`` beside and below or above them; ``of`` is the first such. What goes makes nothing else go, so the
    areas of one name are folded in order, as an array; a venue has few of a name."""
    kind = "array<struct<ord:bigint,x:double,y:double>>"
    start = F.struct(F.expr(f"cast(array() as {kind})").alias("kept"), F.expr("cast(array() as array<struct<ord:bigint,of:bigint>>)").alias("gone"))

    def step(state: Column, a: Column) -> Column:
        of = F.get(F.filter(state["kept"], lambda k: (F.abs(k["x"] - a["x"]) < reach) & (F.abs(k["y"] - a["y"]) < reach)), F.lit(0))["ord"]
        kept = F.when(of.isNull(), F.array_append(state["kept"], a)).otherwise(state["kept"])
        gone = F.when(of.isNull(), state["gone"]).otherwise(F.array_append(state["gone"], F.struct(a["ord"].alias("ord"), of.alias("of"))))
        return F.struct(kept.alias("kept"), gone.alias("gone"))

    rows = areas.select(key, ascii_fold("name").alias("folded"), F.struct(F.col("ord").cast("long").alias("ord"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("a")).where("folded <> ''")
    named = rows.groupBy(key, "folded").agg(F.array_sort(F.collect_list("a")).alias("all"))
    return named.select(key, F.inline(F.aggregate("all", start, step, lambda s: s["gone"])))


def nearest_unused(wanted: DataFrame, free: DataFrame, radius: float = 10.0, key: str = "venue") -> DataFrame:
    """(key, ord, code): each of ``wanted`` (ord, x, y) in order takes the nearest code of ``free`` (code, x, y) still unused.

    The order decides, so it is a greedy kernel over all candidate pairs of a venue: a code that one
    part of the venue takes is used in the others too. A venue has a fixed size.
    """
    w = wanted.withColumn("cell", F.explode(cells_of_box("x", "y", "x", "y", radius)))
    f = free.select(F.col(key), "code", F.col("x").alias("fx"), F.col("y").alias("fy"), F.explode(cells_of_box("x", "y", "x", "y")).alias("cell"))
    pairs = w.join(f, [key, "cell"]).withColumn("d", F.expr("hypot(fx - x, fy - y)")).where(F.col("d") <= radius).select(key, "ord", "code", "d")

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for o, own in rows.sort_values(["ord", "d", "code"]).groupby("ord", sort=True):
            code = next((c for c in own["code"] if c not in used), None)
            if code is not None:
                used.add(code)
                out.append((own[key].iloc[0], o, code))
        return pd.DataFrame(out, columns=[key, "ord", "code"])

    return pairs.groupBy(key).applyInPandas(take, f"{key} long, ord long, code string")


def weld(boxes: DataFrame, gap: float = 5.0, overlap: float = 0.5, by: str = "row", axis: str = "x") -> DataFrame:
    """``boxes`` (ord, x0, y0, x1, y1) with near ones of a group sharing the middle of their gap along an axis, if they
    overlap by half across it; later pairs see earlier edits, so a kernel per row or column,
    many of which a task takes one after the other."""
    a0, a1, c0, c1 = ("x0", "x1", "y0", "y1") if axis == "x" else ("y0", "y1", "x0", "x1")

    def settle(lo: np.ndarray, hi: np.ndarray, across: np.ndarray) -> None:
        size = across[:, 1] - across[:, 0]
        for k in range(len(lo)):
            shared = np.minimum(across[k, 1], across[:, 1]) - np.maximum(across[k, 0], across[:, 0])
            beside = np.flatnonzero(shared >= overlap * np.minimum(size[k], size))
            at = 0
            while at < len(beside):  # the next neighbour beyond the end that the last one moved
                apart = lo[beside[at:]] - hi[k]
                found = np.flatnonzero((apart > 0) & (apart < gap))
                if not len(found):
                    break
                at += found[0]
                n = beside[at]
                hi[k] = lo[n] = round(float(hi[k] + lo[n]) / 2, 2)
                at += 1

    def join(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        lo, hi, across = rows[a0].to_numpy(dtype=float).copy(), rows[a1].to_numpy(dtype=float).copy(), rows[[c0, c1]].to_numpy(dtype=float)
        for first, last in zip(starts, [*starts[1:], len(rows)]):
            settle(lo[first:last], hi[first:last], across[first:last])  # views: the groups' own edges
        return rows.assign(**{a0: lo, a1: hi})

    def stream(batches):
        rest = None
        for frame in batches:
            rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            group, before = rows[by], rows[by].shift()
            starts = np.flatnonzero(((group != before) & ~(group.isna() & before.isna())).to_numpy() | (np.arange(len(rows)) == 0))
            if not len(starts):
                continue
            end = starts[-1]  # the last group may go on in the next batch
            if end:
                yield join(rows.iloc[:end], starts[:-1])
            rest = rows.iloc[end:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield join(rest, np.array([0]))

    return boxes.repartition(by).sortWithinPartitions(by, F.col("ord").asc_nulls_last()).mapInPandas(stream, boxes.schema)


def pack_columns(cells: DataFrame, by: str = "block") -> DataFrame:
    """``cells`` (block, ord, x0, x1, side) with column: a cell joins the last column if it overlaps it by more than half
    and stands on the other side; an ordered fold per block, many of which a task takes one after the other."""

    def pack(batches):
        block, column, last = None, -1, None
        for frame in batches:
            out = []
            for own, x0, x1, side in zip(frame[by].tolist(), frame["x0"].tolist(), frame["x1"].tolist(), frame["side"].tolist()):
                if own != block:
                    block, column, last = own, -1, None
                if last and side not in last[2] and min(x1, last[1]) - max(x0, last[0]) > 0.5 * min(x1 - x0, last[1] - last[0]):
                    last[2].add(side)
                else:
                    column, last = column + 1, [x0, x1, {side}]
                out.append(column)
            yield frame.assign(column=out)

    ordered = cells.repartition(by).sortWithinPartitions(by, F.col("x0").asc_nulls_last(), "ord")
    return ordered.mapInPandas(pack, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in cells.schema)}, column int")


def clustered_rows(bands: DataFrame, tol: float = params.ROW_TOL, key: str = "venue") -> DataFrame:
    """``bands`` (key, y) with line: a band joins the row whose running mean height is within ``tol``, else opens one.

    Heights are counted first, so what is folded in order is an array of a venue's distinct heights.
    """
    kind = "array<struct<y:double,line:int,sum:double,n:bigint>>"
    counts = bands.groupBy(key, F.col("y").cast("double").alias("y")).agg(F.count("*").alias("n")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("ys"))

    def step(rows: Column, h: Column) -> Column:
        last = F.get(rows, F.size(rows) - 1)
        joins = F.abs(last["sum"] / last["n"] - h["y"]) <= tol
        row = F.struct(
            h["y"].alias("y"), F.when(joins, last["line"]).otherwise(last["line"] + 1).alias("line"),
            (F.when(joins, last["sum"]).otherwise(0.0) + h["y"] * h["n"]).alias("sum"), (F.when(joins, last["n"]).otherwise(0) + h["n"]).alias("n"),
        )
        return F.concat(rows, F.array(row))

    opened = lambda h: F.array(F.struct(h["y"].alias("y"), F.lit(0).alias("line"), (h["y"] * h["n"]).alias("sum"), h["n"].alias("n")))
    fold = lambda rows, h: F.when(F.size(rows) == 0, opened(h)).otherwise(step(rows, h))
    lines = counts.select(key, F.inline(F.aggregate("ys", F.expr(f"cast(array() as {kind})"), fold)))
    return bands.withColumn("_y", F.col("y").cast("double")).join(lines.select(key, F.col("y").alias("_y"), "line"), [key, "_y"]).drop("_y")


def corridor_graph(bands: DataFrame, annex_x: float = params.ANNEX_X, key: str = "venue") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the streets' bands (key, row, y, x0, x1, ord): nodes (key, row, x, y), edges (key, ax, ay, bx, by).

    Along a row nodes stand at its ends and in the middle of gaps between neighbouring bands; a wider gap
    is a break, with a node on both sides and no edge between. Rows next to each other, the hall's and
    the annex's apart, are joined where they overlap and are near: each node with the nearest of the next
    row, if that is close, the first of equals. Edges come once, whichever way they run.
    """
    low, high = params.GRAPH_GAP
    order = f"partition by {key}, row order by x0, ord"
    rows = bands.selectExpr("*", f"lag(x1) over ({order}) as prev", f"row_number() over ({order}) as nth", f"lead(ord) over ({order}) is null as final")
    gap = F.col("x0") - F.col("prev")
    at = lambda x, joined: F.struct(F.expr(x).cast("double").alias("x"), F.lit(joined).alias("joined"))
    stops = F.when(F.col("prev").isNull(), F.array(at("x0", False))).when(gap.between(low, high), F.array(at("(prev + x0) / 2", True))).when(gap > high, F.array(at("prev", True), at("x0", False))).otherwise(F.expr("cast(array() as array<struct<x:double,joined:boolean>>)"))
    stops = F.when(F.col("final"), F.array_append(stops, at("x1", True))).otherwise(stops)
    means = bands.groupBy(key, "row").agg(F.avg("y").alias("y"), F.min("x0").alias("west"), F.max_by("x1", F.struct("x0", "ord")).alias("east"))
    placed = rows.select(key, "row", "nth", F.posexplode(stops).alias("k", "s")).select(key, "row", "nth", "k", F.round("s.x", 1).alias("x"), "s.joined").join(means, [key, "row"]).withColumn("y", F.round("y", 1))
    before = placed.withColumn("px", F.expr(f"lag(x) over (partition by {key}, row order by nth, k)"))
    along = before.where("joined and px is not null").select(key, F.col("px").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    nodes = placed.select(key, "row", "x", "y").distinct()
    ranked = means.withColumn("part", (F.col("west") + F.col("east")) / 2 >= annex_x).withColumn("rank", F.expr(f"row_number() over (partition by {key}, part order by y, row)"))
    nxt = ranked.select(key, "part", (F.col("rank") - 1).alias("rank"), F.col("row").alias("row2"), F.col("y").alias("y2"), F.col("west").alias("w2"), F.col("east").alias("e2"))
    pairs = ranked.join(nxt, [key, "part", "rank"]).where(f"least(east, e2) - greatest(west, w2) >= {params.GRAPH_OVERLAP} and y2 - y <= {params.GRAPH_APART}").select(key, "row", "row2")
    n2 = nodes.select(F.col(key), F.col("row").alias("row2"), F.col("x").alias("bx"), F.col("y").alias("by"))
    close = nodes.join(pairs, [key, "row"]).join(n2, [key, "row2"]).where(f"abs(bx - x) < {params.GRAPH_ALIGN}")
    up = close.groupBy(key, "row", "x", "y").agg(F.min(F.struct(F.abs(F.col("bx") - F.col("x")).alias("d"), "bx", "by")).alias("m")).select(key, F.col("x").alias("ax"), F.col("y").alias("ay"), "m.bx", "m.by")
    every = along.unionByName(up).withColumns({"p": F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), "q": F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))}).where("p <> q")
    return nodes, every.select(key, F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct().select(key, F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by"))


def issues(cells: DataFrame, directory: DataFrame) -> DataFrame:
    """(severity, rule, msg) of cells (row, pos, code, letter, number, width): V1 prefix, V2 sequence, V3 duplicates,
    V4 directory both ways, V5 width."""
    one = lambda severity, rule, df, msg: df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), msg.alias("msg"))
    v1 = one("pending", "V1", cells.where("substring(code, 1, 1) <> letter"), F.concat("code", F.lit(" outside row "), "letter"))
    v2 = one("warning", "V2", sequence_breaks(cells), F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(" breaks at "), F.col("number").cast("string")))
    v3 = one("pending", "V3", cells.groupBy("code").count().where("count > 1"), F.concat("code", F.lit(" x"), F.col("count").cast("string")))
    v4a = one("warning", "V4", cells.select("code").distinct().join(directory, "code", "left_anti"), F.concat("code", F.lit(" has no name")))
    v4b = one("warning", "V4", directory.join(cells.select("code").distinct(), "code", "left_anti"), F.concat("code", F.lit(" has no cell")))
    v5 = one("warning", "V5", cells.where("width < 1 or width > 12"), F.concat("code", F.lit(" is "), F.format_string("%.1f", "width"), F.lit(" m wide")))
    return v1.unionByName(v2).unionByName(v3).unionByName(v4a).unionByName(v4b).unionByName(v5)


def area_name(label: str, code: str, entry: str | None = None) -> Column:
    """An area's name: its entry in the directory (column ``entry``); the artists' lane for a run of their codes; else its
    label without tokens that look like codes, if a restaurant is in it or it has at most four words and no code."""
    from atrium.functions.text import title_case_hyphens

    kept = F.array_join(F.filter(F.split(F.trim(F.col(label)), r"\s+"), lambda w: (w != "") & ~w.rlike(r"^[A-Z]{1,3}[0-9]{1,3}[A-Z]?$")), " ")
    fine = kept.rlike(params.RESTAURANTS) | (kept != "") & (F.size(F.split(kept, r"\s+")) <= 4) & F.col(code).isNull()
    title = lambda c: title_case_hyphens(c, params.PARTICLES_MORE)
    named = F.nullif(F.col(entry), F.lit("")) if entry else F.lit(None).cast("string")
    return F.when(named.isNotNull(), title(named)).when(F.trim(F.col(label)).startswith("TI01"), params.ARTISTS).when(fine, title(kept))
