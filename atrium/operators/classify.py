"""Colour and shape to feature kind: one rule for building and for testing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium import params
from atrium.functions.geometry import col


def _listed(rows) -> Column:
    """A literal array of (r, g, b, kind, cat)."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("r", "g", "b"), c)], *[F.lit(v).cast("string").alias(n) for n, v in zip(("kind", "cat"), of)]) for c, *of in rows])


def _first(rows, colour: Column, tol: int) -> Column:
    """The first of the listed colours within ``tol`` of ``colour`` on every channel; null if none."""
    near = lambda p: (F.abs(p["r"] - colour["r"]) <= tol) & (F.abs(p["g"] - colour["g"]) <= tol) & (F.abs(p["b"] - colour["b"]) <= tol)
    return F.get(F.filter(_listed(rows), near), F.lit(0))


def _rgb(r, g, b) -> Column:
    return F.struct(col(r).alias("r"), col(g).alias("g"), col(b).alias("b"))


def rgb_ints(c) -> Column:
    """A colour channel from 0..1 to 0..255, halves to even."""
    return F.bround(col(c) * 255).cast("int")


def first_colour(r, g, b, table, tol: int) -> Column:
    """The name of the first colour of the table within ``tol`` on every channel; null if none."""
    return _first([(c, name, None) for c, name in table], _rgb(r, g, b), tol)["kind"]


def in_box(ring, box: tuple) -> Column:
    """Whether a ring's box has its centre in a box, edges included."""
    from atrium.functions.geometry import bbox_centre

    c, (x0, y0, x1, y1) = bbox_centre(ring), box
    return c["x"].between(x0, x1) & c["y"].between(y0, y1)


def wholly_in(ring, box: tuple) -> Column:
    """Whether all of a ring's vertices are in a box, edges included."""
    x0, y0, x1, y1 = box
    return F.forall(col(ring), lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1))


def snapped(r, g, b, tol: int = params.SNAP_TOL) -> Column:
    """(kind, cat) of the first palette colour within ``tol`` on every channel, after aliases; null if none."""
    colour = _rgb(r, g, b)
    alias = F.get(F.filter(F.array(*[F.struct(_rgb(*[F.lit(v) for v in a]).alias("a"), _rgb(*[F.lit(v) for v in t]).alias("t")) for a, t in params.ALIASES]), lambda p: p["a"] == colour), F.lit(0))
    return _first(params.PALETTE, F.coalesce(alias["t"], colour), tol)


def classify(shapes: DataFrame, in_lane="in_lane") -> DataFrame:
    """``shapes`` with kind and cat, null where a shape is no feature.

    Needs r, g, b, area, n_vertices, x0, y0, x1, y1 and the boolean ``in_lane``. In order: street
    colour, access triangle, booth of the lane, palette (without thin strips and small areas), floor.
    """
    area, colour = F.col("area"), _rgb("r", "g", "b")
    exact = lambda rows: _first(rows, colour, 0)
    found = shapes.withColumns({
        "_poi": exact([(c, "poi", name) for c, name in params.POI_COLOURS]), "_hit": snapped("r", "g", "b"),
        "_other": exact([(params.STREET, "rua", None), ((255, 255, 255), "white", None), *[(c, "grey", None) for c in params.GREYS]])["kind"],
    })
    short, long_ = F.least(F.expr("x1 - x0"), F.expr("y1 - y0")), F.greatest(F.expr("x1 - x0"), F.expr("y1 - y0"))
    is_poi = F.col("_poi").isNotNull() & (area < params.POI_MAX_AREA) & (F.col("n_vertices") <= params.POI_MAX_VERTICES)
    booth = (F.col("_other") == "white") & (area < params.BOOTH_MAX_AREA) & col(in_lane)
    rejected = (short < params.STRIP_SHORT) & (long_ > params.STRIP_RATIO * short) | (F.col("_hit.kind") == "area") & (area < params.MIN_AREA_OF_AREA)
    in_palette = F.col("_hit").isNotNull() & (area >= params.MIN_AREA)
    of = lambda kind, cat: F.struct(F.lit(kind).alias("kind"), (F.lit(cat) if cat is None else cat).cast("string").alias("cat"))
    grey = (F.col("_other") == "grey") & (area >= params.MIN_AREA)
    hit = F.when(~rejected, F.struct(F.col("_hit.kind").alias("kind"), F.col("_hit.cat").alias("cat")))
    rule = F.when(F.col("_other") == "rua", of("rua", None)).when(is_poi, of("poi", F.col("_poi.cat"))).when(booth, of("estande", F.lit("travessa")))
    result = rule.when(in_palette, hit).when(grey, of("piso", None))
    return found.withColumn("_r", result).withColumns({"kind": F.col("_r.kind"), "cat": F.col("_r.cat")}).drop("_poi", "_hit", "_other", "_r")


def fix_prisms(shapes: DataFrame, key: str = "venue") -> DataFrame:
    """Tops of extruded blocks moved onto their base; the two side faces of each are gone.

    ``shapes`` has ord, x0, y0, x1, y1 and ``key``. A block's bottom face starts at its (x0, y1) and
    runs right and down by (d, e), its right face starts at (x1, y0); 0.5 < d, e < 2.5, within 0.4
    of each other, edges within 0.25. The first matching pair in order counts. Faces are found by
    equi-joins on the rounded corner, so a shape meets its few neighbours only.
    """
    low, high, even, tol = 0.5, 2.5, 0.4, 0.25
    own = shapes.select(key, "ord", "x0", "y0", "x1", "y1")
    # Faces are thin, so few: they are listed at the cells around their corner, shapes at their own only.
    f = own.selectExpr(key, "ord as face", "x0 as fx0", "y0 as fy0", "x1 as fx1", "y1 as fy1", "explode(sequence(-1, 1)) as a").selectExpr("*", "explode(sequence(-1, 1)) as c")
    f = f.selectExpr(key, "face", "fx0", "fy0", "fx1", "fy1", "floor(fx0) + a as i", "floor(fy0) + c as j")
    meeting = lambda x, y, thin: own.withColumns({"i": F.floor(x), "j": F.floor(y)}).join(f.where(thin).hint("merge"), [key, "i", "j"])
    bottoms = meeting("x0", "y1", f"fy1 - fy0 > {low} and fy1 - fy0 < {high}").where(
        f"face <> ord and abs(fx0 - x0) <= {tol} and abs(fy0 - y1) <= {tol} and fx1 - x1 > {low} and fx1 - x1 < {high} and abs((fx1 - x1) - (fy1 - fy0)) <= {even}"
    ).select(key, "ord", F.col("face").alias("bottom"), (F.col("fx1") - F.col("x1")).alias("dx"), (F.col("fy1") - F.col("fy0")).alias("dy"))
    rights = meeting("x1", "y0", f"fx1 - fx0 > {low} and fx1 - fx0 < {high}").where(
        f"face <> ord and abs(fx0 - x1) <= {tol} and abs(fy0 - y0) <= {tol}"
    ).select(key, "ord", F.col("face").alias("side"), (F.col("fx1") - F.col("fx0")).alias("wide"))
    pairs = bottoms.join(rights.hint("merge"), [key, "ord"]).where(f"abs(wide - dx) <= {tol} and bottom <> side")
    first = pairs.groupBy(key, "ord").agg(F.min(F.struct("bottom", "side", "dx", "dy")).alias("m")).select(key, "ord", "m.*")
    faces = first.select(key, F.col("bottom").alias("ord")).union(first.select(key, F.col("side").alias("ord"))).distinct()
    moved = shapes.join(faces.hint("merge"), [key, "ord"], "left_anti").join(first.select(key, "ord", "dx", "dy").hint("merge"), [key, "ord"], "left")
    d, e = F.coalesce("dx", F.lit(0.0)), F.coalesce("dy", F.lit(0.0))
    return moved.withColumns({"x0": F.col("x0") + d, "x1": F.col("x1") + d, "y0": F.col("y0") + e, "y1": F.col("y1") + e, "moved": F.col("dx").isNotNull()}).drop("dx", "dy")
