"""Labels in shapes of any form, contested codes, and heads that want one tail, against plain passes."""

import math
import random

from atrium.operators import labels

RING = "array<struct<x:double,y:double>>"


def even_odd(ring, x, y):
    """Half-open in y, strict in x."""
    return sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def star(rng, x, y):
    n = rng.randrange(3, 9)
    return [(round(x + rng.uniform(1, 7) * math.cos(2 * math.pi * k / n), 1), round(y + rng.uniform(1, 7) * math.sin(2 * math.pi * k / n), 1)) for k in range(n)]


def fixture(rng):
    shapes = [(0, o, star(rng, rng.uniform(0, 40), rng.uniform(0, 40))) for o in range(40)]
    shapes += [(0, 40, [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]), (0, 41, [(8.0, 0.0), (16.0, 0.0), (16.0, 8.0), (8.0, 8.0)]), (1, 42, [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0)])]
    points = [(0, k, f"A{k:02}", rng.uniform(-5, 45), rng.uniform(-5, 45)) for k in range(150)]
    # on sides, on corners, on the side two shapes share, and on vertices of the stars
    points += [(0, 200 + n, f"B{n:02}", x, y) for n, (x, y) in enumerate([(8.0, 4.0), (0.0, 4.0), (4.0, 0.0), (4.0, 8.0), (0.0, 0.0), (8.0, 8.0), (16.0, 8.0), (8.0, 0.0)])]
    points += [(0, 300 + n, f"C{n:02}", *shapes[n][2][0]) for n in range(20)] + [(1, 400, "D01", 6.0, 2.0), (1, 401, "D02", 2.0, 6.0)]
    return shapes, points


def test_contested_codes_go_to_the_first_shape(spark):
    shapes, points = fixture(random.Random(4))
    rows = [(v, o, ring, min(p[0] for p in ring), min(p[1] for p in ring), max(p[0] for p in ring), max(p[1] for p in ring)) for v, o, ring in shapes]
    frame = spark.createDataFrame(rows, f"venue long, ord long, ring {RING}, x0 double, y0 double, x1 double, y1 double")
    codes = spark.createDataFrame([(*p, 1.0) for p in points], "venue long, label_id long, txt string, x double, y double, size double")
    held = {k: [o for w, o, ring in shapes if w == v and even_odd(ring, x, y)] for v, k, _, x, y in points}
    got = {r["label_id"]: r["ord"] for r in labels.claim_codes(frame, codes).collect()}
    assert got == {k: min(o) for k, o in held.items() if o} and sum(len(o) > 1 for o in held.values()) > 10
    assert got[200] == min(held[200]) and 41 in held[200] and 40 not in held[200]  # the shared side belongs to the shape on its right
    names = {r["ord"]: r["name"] for r in labels.names_inside(frame, codes, by=("y", "x")).collect()}
    want = {}
    for o in {o for own in held.values() for o in own}:
        want[o] = " ".join(t for _, _, t in sorted((y, x, t) for v, k, t, x, y in points if o in held[k]))
    assert names == want


def test_heads_in_order_take_their_first_free_tail(spark):
    rng = random.Random(6)
    rows = []
    for k in range(260):
        head = k % 2 == 0
        rows.append((k % 3 // 2, k, rng.choice(["A", "BB", "K"]) if head else rng.choice(["07", "12", "3A", "X"]), round(rng.uniform(0, 30), 1), round(rng.uniform(0, 30), 1), rng.choice([1.0, 2.0, 2.5])))
    joined, used, taken = {}, set(), 0
    for v, k, txt, x, y, size in rows:  # heads in order, their tails in order
        for w, n, tail, tx, ty, _ in rows:
            near = w == v and n != k and 0 < ty - y <= 1.2 * size and abs(tx - x) <= size
            if near and labels_code(txt + tail) and not labels_code(tail) and not {(v, k), (v, n)} & used:
                joined[v, k], taken = txt + tail, taken + 1
                used |= {(v, k), (v, n)}
    want = {}
    for v, k, txt, *_ in rows:
        if (v, k) in joined:
            want[v, k] = (joined[v, k], True)
        elif (v, k) not in used:
            want[v, k] = (txt, False)
    got = labels.repair_codes(spark.createDataFrame(rows, "venue long, label_id long, txt string, x double, y double, size double")).collect()
    assert {(r["venue"], r["label_id"]): (r["txt"], r["joined"]) for r in got} == want and taken > 15


def labels_code(txt):
    import re

    return re.fullmatch(r"[A-Z]{1,3}\d{1,3}[A-Z]?", txt) is not None


def test_snapping_takes_the_first_ring_with_a_free_cell(spark):
    from atrium.operators import grid

    rng = random.Random(2)
    free = {(i, j): (i > 16 or j > 20) and rng.random() > 0.7 for i in range(30) for j in range(34)}
    points = [(0, k, rng.uniform(-2, 31), rng.uniform(-2, 35)) for k in range(300)] + [(0, 900, 3.5, 4.5), (0, 901, 500.0, 1.0), (5, 902, 3.0, 3.0)]
    cells = spark.createDataFrame([(0, i, j, f) for (i, j), f in free.items()], "venue long, i int, j int, free boolean")
    for limit in (2, 9):
        want = {}
        for v, k, fi, fj in points:
            ci, cj = math.floor(fi + 0.5), math.floor(fj + 0.5)
            near = [(max(abs(i - ci), abs(j - cj)), (i - fi) ** 2 + (j - fj) ** 2, j, i) for (i, j), f in free.items() if f and v == 0 and max(abs(i - ci), abs(j - cj)) <= limit]
            want[k] = (min(near)[3], min(near)[2], min(near)[0]) if near else (None, None, None)
        got = grid.snap_to_free(spark.createDataFrame(points, "venue long, id long, fi double, fj double"), cells, limit).collect()
        assert {r["id"]: (r["i"], r["j"], r["ring"]) for r in got} == want and any(w[2] and w[2] > 3 for w in want.values()) == (limit > 3)
