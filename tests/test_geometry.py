"""Clipping and runs inside rings against sampling and closed forms; coverage of legs by ways against a plain count."""

import math
import random

from pyspark.sql import functions as F

from atrium import params
from atrium.functions import geometry as geo
from atrium.operators import instructions, quality

RING = "array<struct<x:double,y:double>>"


def convex(rng, n, r):
    """A convex ring: points of a circle in order, moved and stretched."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    x, y, s = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0.5, 1.5)
    ring = [(x + r * math.cos(a), y + s * r * math.sin(a)) for a in angles]
    return ring if rng.random() < 0.5 else ring[::-1]


def inside(ring, x, y, rim=0.0):
    """Whether a point lies in a convex ring, deeper than the rim."""
    area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))
    return all(math.copysign(1, area) * ((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])) / math.dist(p, q) >= rim for p, q in zip(ring, ring[1:] + ring[:1]))


def star(rng, n):
    """A simple ring that isn't convex: distances from the middle go up and down."""
    return [(rng.uniform(2, 9) * math.cos(2 * math.pi * k / n), rng.uniform(2, 9) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def even_odd(ring, x, y):
    return sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def test_runs_inside_convex_rings(spark):
    rng = random.Random(1)
    rows = [(k, convex(rng, rng.randrange(3, 9), rng.uniform(2, 8)), *[rng.uniform(-12, 12) for _ in range(4)]) for k in range(120)]
    rows += [(500, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], 0.3, -5.0, 0.3, 9.0), (501, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], 0.2, -5.0, 0.2, 9.0), (502, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (4.0, 4.0), (0.0, 4.0)], 2.0, 2.0, 2.0, 2.0)]
    found = spark.createDataFrame(rows, f"k long, ring {RING}, ax double, ay double, bx double, by double").select("k", geo.run_inside("ax", "ay", "bx", "by", "ring", 0.3).alias("m"))
    got = {r["k"]: r["m"] for r in found.collect()}
    for k, ring, ax, ay, bx, by in rows[:120]:
        n = 4000
        share = sum(inside(ring, ax + (bx - ax) * (t + 0.5) / n, ay + (by - ay) * (t + 0.5) / n, 0.3) for t in range(n)) / n
        assert abs(got[k] - share * math.hypot(bx - ax, by - ay)) < 0.02
    assert abs(got[500] - 3.4) < 1e-9 and got[501] == 0.0 and got[502] == 0.0 and sum(m > 0.5 for m in got.values()) > 20


def test_clipped_rings(spark):
    rng = random.Random(2)
    rows = [(k, star(rng, 12) if k % 2 else star(rng, 9)[::-1], convex(rng, rng.randrange(3, 8), rng.uniform(2, 7))) for k in range(25)]
    far = [(100.0, 100.0), (101.0, 100.0), (100.0, 101.0)]
    frame = spark.createDataFrame(rows + [(99, rows[0][1], far)], f"k long, ring {RING}, window {RING}")
    got = {r["k"]: r["a"] for r in frame.select("k", F.abs(geo.ring_area(geo.clipped("ring", "window"))).alias("a")).collect()}
    for k, ring, window in rows:
        step = 0.1
        at = [(i + 0.5) * step for i in range(-100, 100)]  # the rings lie within ten of the middle
        n = sum(even_odd(ring, x, y) and inside(window, x, y) for x in at for y in at)
        assert abs(got[k] - n * step * step) < 0.5 + 0.01 * got[k], k
    assert got[99] == 0.0


def test_blocks_outside_a_slanted_building(spark):
    building = spark.createDataFrame([(0, [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)])], f"venue long, ring {RING}")
    blocks = spark.createDataFrame([(0, 1, 0.0, 0.0, 2.0, 2.0), (0, 2, 4.0, 4.0, 6.0, 6.0), (0, 3, 9.0, 9.0, 10.0, 10.0), (1, 4, 0.0, 0.0, 1.0, 1.0), (0, 5, 4.5, 4.5, 5.1, 5.1)], "venue long, k long, x0 double, y0 double, x1 double, y1 double")
    out = {r["k"]: (r["outside_m2"], r["share"]) for r in quality.outside_building(blocks, building).collect()}
    assert out == {2: (2.0, 50.0), 3: (1.0, 100.0), 4: (1.0, 100.0)}


def test_legs_take_the_best_way(spark):
    rng = random.Random(5)
    ways = [(v, o, f"w{o}", o % 2 == 0, rng.uniform(0, 80), rng.uniform(0, 80), rng.uniform(0, 80), rng.uniform(0, 80), rng.choice([2.0, 4.0, 9.0])) for v in (0, 1) for o in range(25)]
    ways += [(0, 50, "dot", False, 40.0, 40.0, 40.0, 40.0, 30.0), (0, 51, "twin", False, *ways[0][4:])]
    legs = [(k % 2, k, x := rng.uniform(0, 80), y := rng.uniform(0, 80), x + rng.uniform(-15, 15), y + rng.uniform(-15, 15)) for k in range(300)]
    legs += [(0, 900, 40.0, 40.0, 40.0, 40.0), (1, 901, 500.0, 500.0, 501.0, 501.0)]
    want = {}
    for v, k, px, py, qx, qy in legs:
        best = None
        for _, o, name, derived, ax, ay, bx, by, width in (w for w in ways if w[0] == v):
            hits = 0
            for s in range(params.WAY_SAMPLES + 1):
                x, y = px + (qx - px) * s / params.WAY_SAMPLES, py + (qy - py) * s / params.WAY_SAMPLES
                n = (bx - ax) ** 2 + (by - ay) ** 2
                t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0.0
                hits += math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) <= width / 2 + params.WAY_SLACK
            if hits / (params.WAY_SAMPLES + 1) >= params.WAY_COVERAGE:
                best = min(best or (9,), (-hits, -width, o, name))
        want[k] = (best[3], round(-best[0] / (params.WAY_SAMPLES + 1), 9)) if best else (None, None)
    frame = spark.createDataFrame(ways, "venue long, ord long, name string, derived boolean, ax double, ay double, bx double, by double, width double")
    got = instructions.leg_ways(spark.createDataFrame(legs, "venue long, leg long, pi double, pj double, qi double, qj double"), frame)
    assert {r["leg"]: (r["way"], r["coverage"]) for r in got.collect()} == want and sum(w is not None for w, _ in want.values()) > 50
