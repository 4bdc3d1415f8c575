"""Planar geometry as column expressions on array<struct<x,y>> rings: no Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def rectangle(x0, y0, x1, y1) -> Column:
    """The ring of a rectangle, counter-clockwise and open."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def following(ring) -> Column:
    """Each vertex's successor, the first after the last."""
    r = col(ring)
    return F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))


def edges(ring) -> Column:
    """array<struct<p,q>> of a ring's sides."""
    return F.zip_with(col(ring), following(ring), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def ring_area(ring) -> Column:
    """Signed shoelace area; the sign is the orientation."""
    return _sum(F.zip_with(col(ring), following(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def ring_centroid(ring) -> Column:
    """Centroid of the area, as a point; null for a ring without area."""
    cross = lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    six = F.nullif(ring_area(ring) * 6, F.lit(0.0))
    return point(_sum(F.transform(edges(ring), lambda e: (e["p"]["x"] + e["q"]["x"]) * cross(e))) / six, _sum(F.transform(edges(ring), lambda e: (e["p"]["y"] + e["q"]["y"]) * cross(e))) / six)


def vertex_mean(ring) -> Column:
    """Mean of the vertices of an open ring."""
    r = col(ring)
    return point(_sum(F.transform(r, lambda p: p["x"])) / F.size(r), _sum(F.transform(r, lambda p: p["y"])) / F.size(r))


def ring_bbox(ring) -> Column:
    xs, ys = F.transform(col(ring), lambda p: p["x"]), F.transform(col(ring), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def bbox_centre(ring) -> Column:
    """Middle of a ring's box: neither of the centroids."""
    b = ring_bbox(ring)
    return point((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2)


def fill_ratio(ring) -> Column:
    """Share of its box that a ring fills; 1 for a box without area."""
    b = ring_bbox(ring)
    box = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    return F.when(box == 0, 1.0).otherwise(F.abs(ring_area(ring)) / F.nullif(box, F.lit(0.0)))


def coordinate_box(coordinates) -> Column:
    """The box (west, south, east, north) of all positions in nested GeoJSON coordinates, given as text;
    180, 90, -180, -90 where there are none."""
    number = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
    axis = lambda n: F.transform(F.regexp_extract_all(col(coordinates), F.lit(rf"\[\s*({number})\s*,\s*({number})"), F.lit(n)), lambda v: v.cast("double"))
    xs, ys = axis(1), axis(2)
    return F.struct(
        F.least(F.lit(180.0), F.array_min(xs)).alias("west"), F.least(F.lit(90.0), F.array_min(ys)).alias("south"),
        F.greatest(F.lit(-180.0), F.array_max(xs)).alias("east"), F.greatest(F.lit(-90.0), F.array_max(ys)).alias("north"),
    )


def exterior(rings) -> Column:
    """The ring of largest absolute area; the first of equals."""
    ranked = F.transform(col(rings), lambda r, i: F.struct((-F.abs(ring_area(r))).alias("a"), i.alias("i"), r.alias("ring")))
    return F.array_min(ranked)["ring"]


def holes(rings, least: float = 1.0) -> Column:
    """The other rings of more than ``least`` area and less than the exterior's."""
    top = F.abs(ring_area(exterior(rings)))
    return F.filter(col(rings), lambda r: (F.abs(ring_area(r)) > least) & (F.abs(ring_area(r)) < top))


def in_ring(x, y, ring) -> Column:
    """Even-odd ray cast: half-open in y, strict in x."""
    x, y = col(x), col(y)
    crosses = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0.0)) + e["p"]["x"])
    return F.pmod(F.size(F.filter(edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))), F.lit(2)) == 1


def path_length(points) -> Column:
    """Length of an open polyline."""
    p = col(points)
    return _sum(F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point from a segment; a segment without length is its start."""
    px, py, ax, ay, bx, by = (col(c) for c in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(n, F.lit(0.0)))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def box_distance(x, y, x0, y0, x1, y1) -> Column:
    """Distance of a point from a box; 0 inside."""
    x, y, x0, y0, x1, y1 = (col(c) for c in (x, y, x0, y0, x1, y1))
    zero = F.lit(0.0)
    return F.hypot(F.greatest(x0 - x, zero, x - x1), F.greatest(y0 - y, zero, y - y1))


def angle_between(ux, uy, vx, vy) -> Column:
    """Angle of two vectors in degrees; 90 if one has no length."""
    ux, uy, vx, vy = (col(c) for c in (ux, uy, vx, vy))
    n = F.hypot(ux, uy) * F.hypot(vx, vy)
    cos = (ux * vx + uy * vy) / F.when(n == 0, 1.0).otherwise(n)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def turn_side(ux, uy, vx, vy, handedness) -> Column:
    """'esquerda' or 'direita': the cross product in a frame of the given handedness."""
    cross = col(ux) * col(vy) - col(uy) * col(vx)
    return F.when(cross * col(handedness) > 0, "esquerda").otherwise("direita")


def wrap_degrees(angle) -> Column:
    """The angle in (-180, 180]; the remainder truncates towards zero."""
    a = col(angle) % 360
    return F.when(a > 180, a - 360).when(a <= -180, a + 360).otherwise(a)


def module_deviation(length, scale) -> Column:
    """Distance of a scaled length from the nearest whole number."""
    part = F.pmod(col(length) * col(scale), F.lit(1.0))
    return F.least(part, 1 - part)


def js_round(x) -> Column:
    """Halves go towards positive infinity."""
    return F.floor(col(x) + 0.5)


def box_iou(a, b) -> Column:
    """Intersection over union of two boxes, each given by the names of x0, y0, x1, y1."""
    ax0, ay0, ax1, ay1 = (col(c) for c in a)
    bx0, by0, bx1, by1 = (col(c) for c in b)
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(zero, F.least(ay1, by1) - F.greatest(ay0, by0))
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def overlap_share(a, b) -> Column:
    """Share of box a's area that box b covers; 0 for a box without area."""
    ax0, ay0, ax1, ay1 = (col(c) for c in a)
    bx0, by0, bx1, by1 = (col(c) for c in b)
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(zero, F.least(ay1, by1) - F.greatest(ay0, by0))
    area = (ax1 - ax0) * (ay1 - ay0)
    return F.when(area > 0, inter / area).otherwise(0.0)


def side_of(e: Column, x: Column, y: Column) -> Column:
    """Signed distance of (x, y) from the line of a side: positive on its left; null for a side without length."""
    dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
    return (dx * (y - e["p"]["y"]) - dy * (x - e["p"]["x"])) / F.nullif(F.hypot(dx, dy), F.lit(0.0))


def run_inside(ax, ay, bx, by, ring, erode: float = 0.0) -> Column:
    """Length of a segment inside a convex ring less a rim of ``erode``: 0 if it passes by.

    Each side of the ring, moved inwards, is a half-plane; the segment enters it or leaves it at one
    parameter. What is between the last entry and the first exit is inside all of them.
    """
    ax, ay, bx, by, ring = (col(c) for c in (ax, ay, bx, by, ring))
    turn = F.signum(ring_area(ring))
    depth = lambda e, x, y: turn * side_of(e, x, y) - erode
    ends = F.filter(F.transform(edges(ring), lambda e: F.struct(depth(e, ax, ay).alias("a"), depth(e, bx, by).alias("b"))), lambda d: d["a"].isNotNull())
    cut = lambda d: d["a"] / F.nullif(d["a"] - d["b"], F.lit(0.0))
    enter = F.array_max(F.transform(ends, lambda d: F.when((d["a"] < 0) & (d["b"] < 0), 2.0).when(d["a"] < 0, cut(d)).otherwise(0.0)))
    leave = F.array_min(F.transform(ends, lambda d: F.when((d["a"] >= 0) & (d["b"] < 0), cut(d)).otherwise(1.0)))
    return F.coalesce(F.greatest(F.lit(0.0), leave - enter), F.lit(0.0)) * F.hypot(bx - ax, by - ay)


def clipped(ring, window) -> Column:
    """The part of any simple ring inside a convex window, as a ring: cut at the window's sides in turn.

    Parts that hang together only through the window's rim are joined along it by sides of no area, so
    the ring's area is that of the intersection.
    """
    ring, window = col(ring), col(window)
    turn = F.signum(ring_area(window))

    def keep(e: Column, m: Column) -> Column:
        p, q = m["p"], m["q"]
        t = m["d"] / F.nullif(m["d"] - m["e"], F.lit(0.0))
        at = F.array(point(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t))
        own = F.array(point(p["x"], p["y"]))
        return F.when((m["d"] >= 0) & (m["e"] >= 0), own).when(m["d"] >= 0, F.concat(own, at)).when(m["e"] >= 0, at).otherwise(F.slice(own, 1, 0))

    def cut(points: Column, e: Column) -> Column:
        depth = lambda v: F.coalesce(turn * side_of(e, v["x"], v["y"]), F.lit(0.0))
        marked = F.transform(edges(points), lambda s: F.struct(s["p"].alias("p"), s["q"].alias("q"), depth(s["p"]).alias("d"), depth(s["q"]).alias("e")))
        return F.flatten(F.transform(marked, lambda m: keep(e, m)))

    return F.aggregate(edges(window), F.transform(ring, lambda v: point(v["x"], v["y"])), cut)
